"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language. An unseen word backs off to its character
n-grams, the longest first, and to shorter ones only where none of a length is known. The languages of a text compare by
the sum over its words.

The model is learned from a bounded share of the labelled documents (``Bounds.documents`` for each language); its tables
have bounded sizes (``Bounds.words``, ``Bounds.grams``), so it may be broadcast. Scoring covers every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import handed_on, id_bucket, map_batches, table, with_kept

LETTER = regex.compile(r"\p{L}")
EDGES = regex.compile(r"^\P{L}+|\P{L}+$")
#: What separates words in the training, as ``str.split`` does in the scoring of texts.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Words that a worker remembers, at most, and those whose grams it gathers at once.
REMEMBERED = 300_000
AT_ONCE = 1000
UNKNOWN = "und"


@dataclass(frozen=True)
class Bounds:
    """Learned from: about so many documents of each of the languages that most documents have; entries of each table."""

    languages: int = 200
    documents: int = 4000
    words: int = 60_000
    grams: int = 60_000
    longest_gram: int = 4


@dataclass(frozen=True)
class Model:
    """Log frequencies by language: ``words`` and ``grams`` map a string to a row of ``word_logs``/``gram_logs``."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    longest_gram: int

    def vectors(self, tokens: list[str]) -> np.ndarray:
        """What each token adds for each language; zeros where it has no letter or nothing of it is known."""
        out = np.zeros((len(tokens), len(self.languages)), np.float32)
        whole, word_rows, backed, starts, gram_rows = [], [], [], [], []
        for i, token in enumerate(tokens):
            word = token.lower()
            if not (word[0].isalpha() and word[-1].isalpha()):
                word = EDGES.sub("", word)
                if not word:
                    continue
            at = self.words.get(word)
            if at is not None:
                whole.append(i)
                word_rows.append(at)
            elif known := self.known_grams(f" {word} "):
                backed.append(i)
                starts.append(len(gram_rows))
                gram_rows += known
        out[whole] = self.word_logs[word_rows]
        if backed:
            sums = np.add.reduceat(self.gram_logs[gram_rows], starts)
            out[backed] = sums / np.diff([*starts, len(gram_rows)]).astype(np.float32)[:, None]
        return out

    def known_grams(self, marked: str) -> list[int]:
        """Rows of the known n-grams of the greatest length that has any."""
        get = self.grams.get
        for n in range(min(self.longest_gram, len(marked)), 0, -1):
            known = [at for i in range(len(marked) - n + 1) if (at := get(marked[i : i + n])) is not None]
            if known:
                return known
        return []


class Scorer:
    """Scores texts in one worker; remembers the vectors of recent tokens."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, len(model.languages)), np.float32)

    def remember(self, tokens: list[str]) -> None:
        for start in range(0, len(tokens), AT_ONCE):
            some, first = tokens[start : start + AT_ONCE], len(self.rows)
            self.table[first : first + len(some)] = self.model.vectors(some)
            self.rows.update(zip(some, range(first, first + len(some)), strict=True))

    def score(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the likelihood, tempered by the number of words."""
        if not text or not self.model.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        tokens = text.split()  # at WHITE
        total = np.zeros(len(self.model.languages))
        for start in range(0, len(tokens), REMEMBERED // 2):
            some = tokens[start : start + REMEMBERED // 2]
            new = set(some).difference(self.rows)
            if len(self.rows) + len(new) > REMEMBERED:
                self.rows.clear()
                new = set(some)
            self.remember(list(new))
            at = np.fromiter(map(self.rows.__getitem__, some), np.int64, len(some))
            total += self.table[at].sum(axis=0, dtype=np.float64)
        mean = total / max(len(tokens), 1) * min(len(tokens), 8)
        best = int(mean.argmax())  # ties: the first language by name
        return self.model.languages[best], float(1 / np.exp(mean - mean[best]).sum())


def log_table(rows: list[tuple[str, str, int]], languages: list[str], totals: dict[str, float]) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies from (key, language, count)."""
    keys = {k: i for i, k in enumerate(sorted({r[0] for r in rows}))}
    column = {x: i for i, x in enumerate(languages)}
    counts = np.full((len(keys), len(languages)), 0.5)
    for k, lang, n in rows:
        counts[keys[k], column[lang]] += n
    logs = np.log(counts / np.array([totals.get(x, 0) + 0.5 * len(keys) + 1 for x in languages]))
    return keys, logs.astype(np.float32)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", bounds: Bounds = Bounds()) -> Model:  # noqa: B008
    """Learn from rows with a language and a text; rows without either are left out.

    Counting is done by Spark; only the most telling entries, as many as the bounds say, come to the driver.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(bounds.languages)
    sizes = {r[0]: r[1] for r in common.collect()}
    languages = sorted(sizes)
    share = F.lit(0)
    for x, n in sizes.items():
        share = F.when(F.col("lang") == x, math.ceil(min(1.0, bounds.documents / n) * 1_000_000)).otherwise(share)
    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share)
    token = F.regexp_replace(F.lower("token"), r"^[^\p{L}]+|[^\p{L}]+$", "")
    counts = (
        some.select("lang", F.explode(F.split("text", WHITE)).alias("token"))
        .select("lang", token.alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .persist()
    )
    totals = {r[0]: float(r[1]) for r in counts.groupBy("lang").agg(F.sum("n")).collect()}

    def most(df: DataFrame, key: str, sums: dict[str, float], top: int) -> list[tuple]:
        """The entries with the largest share of some language, with their counts in each."""
        total = F.lit(1.0)
        for x, n in sums.items():
            total = F.when(F.col("lang") == x, n).otherwise(total)
        best = df.groupBy(key).agg(F.max(F.col("n") / total).alias("share")).orderBy(F.desc("share"), key).limit(top)
        # Bounded by ``top`` keys; the counts of these in all languages.
        return [(r[0], r[1], r[2]) for r in df.join(F.broadcast(best.select(key)), key).select(key, "lang", "n").collect()]

    words, word_logs = log_table(most(counts, "word", totals, bounds.words), languages, totals)
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(bounds.longest_gram)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.char_length("marked") - n + 1, F.lit(1))), lambda i: F.substring(F.col("marked"), i, n)
            ),
        )
    )
    grams = (
        counts.withColumn("marked", marked)
        .select("lang", "n", F.explode(pieces).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    gram_rows = most(grams, "gram", totals, bounds.grams)
    counts.unpersist()
    gram_totals: dict[str, float] = {}
    for _, lang, n in gram_rows:
        gram_totals[lang] = gram_totals.get(lang, 0) + n
    gram_keys, gram_logs = log_table(gram_rows, languages, gram_totals)
    return Model(languages, words, word_logs, gram_keys, gram_logs, bounds.longest_gram)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) for every whole text, in a narrow stage.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. ``keep``: columns to carry along
    besides the id (the text among them if wished); one whose name a new column has is a ValueError. Very long texts are
    read whole. Repeated rows each give a row, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept, schema = with_kept(docs, id_col, text_col, keep, ["lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.score(t) for t in b.column("__text").to_pylist()]
            yield handed_on(b, text_col, keep) | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_batches(kept, run, f"{schema}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id, modulo 4, is not 2."""
    return docs.where(F.col("lang").isNotNull() & (id_bucket("doc_id", 4) != 2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    return predict(docs, model).select(
        "doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )

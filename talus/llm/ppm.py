"""Language-model scores by prediction by partial matching over bytes.

The model is the trie of all contexts of up to ``ORDER`` bytes of the training texts, with full counts at every order. A
byte is coded in its longest context that occurred; where it did not follow there, an escape (method D: half a count for each
symbol of the context) leads to the next shorter one, in which the symbols of the longer one are excluded; what no context
has seen is coded evenly. A text ends with a symbol of its own. As all symbols of a context also follow its shorter ones, what
is excluded depends only on two neighbouring nodes, and the whole code length of a byte only on the ORDER bytes before it: a
gram of ORDER + 1 bytes, one 64-bit number.

No task and no driver holds the trie. A split of the documents lists its distinct grams (and the hashes of its words, for the
unigram base) with their counts in training texts; nodes that share their last three context bytes meet in a bucket, where
counts are summed and costs computed by order, in numpy; the buckets then answer what each split has listed, and the split's
documents are scored from these answers. Only orders 0 to 2 go to all tasks: at most 2**24 counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import id_bucket, map_batches, materialise, table
from talus.llm.shingles import mix, word_hashes

ORDER = 5
#: Orders up to this one are known to every task; contexts meet by this many and one more last bytes.
LOW = 2
BUCKETS = 256
#: Bytes that are turned into grams at once, and listed grams after which a task sums up.
WINDOW, PENDING = 1 << 22, 1 << 21
#: Bytes that UTF-8 never has: before a text, and its end (fixed values).
BEFORE, END = 0xFE, 0xFF
#: The key of the token that ends a text.
END_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)
GRAMS, WORDS, LOWEST = 0, 1, 2

U = np.uint64


def mask(n: int) -> np.uint64:
    return U((1 << (8 * n)) - 1)


def grams(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, number of its text) of every byte and of the ends of texts, in windows of bounded size."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + order + 1
        if size >= WINDOW or i == len(texts) - 1:
            held = texts[first : i + 1]
            a = np.frombuffer(b"".join(bytes([BEFORE]) * order + x + bytes([END]) for x in held), np.uint8)
            of = np.repeat(np.arange(first, i + 1, dtype=np.int32), [len(x) + 1 + order for x in held])
            for at in range(0, len(a) - order, WINDOW):
                part = a[at : at + WINDOW + order]
                n = len(part) - order
                c = part[:n].astype(U)
                for j in range(1, order + 1):
                    np.left_shift(c, U(8), out=c)
                    np.bitwise_or(c, part[j : j + n], out=c)
                real = part[order:] != BEFORE
                yield c[real], of[at + order : at + order + n][real]
            first, size = i + 1, 0


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


class Sums:
    """Counts by key that are summed up whenever enough has gathered."""

    def __init__(self):
        self.parts, self.size, self.least = [], 0, PENDING

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.least:
            self.parts = [summed(self.parts)]
            self.size = len(self.parts[0][0])
            self.least = max(PENDING, 2 * self.size)

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(self.parts)


def counted(sums: Sums, keys: np.ndarray, train: np.ndarray) -> None:
    """Adds keys with how often they stand in training texts; others are listed with none."""
    sums.add(*np.unique(keys[train], return_counts=True))
    rest = np.unique(keys[~train])
    sums.add(rest, np.zeros(len(rest), np.int64))


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, U), dtype=U)


def find(there: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key among sorted ones."""
    if not len(there):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
    return at, there[at] == wanted


class Level:
    """The nodes of one order: grams of ``order`` + 1 bytes and counts, by context."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray):
        self.order, self.keys, self.counts = order, keys, counts
        self.contexts, self.start = np.unique(keys >> U(8), return_index=True)
        self.total = np.add.reduceat(counts, self.start) if len(keys) else counts
        self.symbols = np.diff(np.append(self.start, len(keys)))

    def shorter(self) -> Level:
        """The next lower order: the first context byte goes."""
        return Level(self.order - 1, *summed([(self.keys & mask(self.order), self.counts)]))

    def exclude(self, lower: Level) -> None:
        """What of each context's shorter one its own symbols take away: their counts there, and how many they are."""
        at, _ = find(lower.keys, self.keys & mask(self.order))
        self.taken = np.add.reduceat(lower.counts[at], self.start) if len(self.keys) else self.counts


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels LOW to 0 from the counts of level LOW."""
    levels = [Level(LOW, keys, counts)]
    while levels[-1].order:
        levels.append(levels[-1].shorter())
        levels[-2].exclude(levels[-1])
    return levels


def costs(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: list[Level], order: int = ORDER) -> np.ndarray:
    """log10 of the probability of the last byte of each wanted gram after the others.

    ``keys`` and ``counts``: training grams, complete for all contexts that share the last LOW + 1 bytes with a wanted one.
    """
    levels = [Level(order, keys, counts)]
    while levels[-1].order > LOW + 1:
        levels.append(levels[-1].shorter())
        levels[-2].exclude(levels[-1])
    levels[-1].exclude(low[0])
    out, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    above: Level | None = None
    for level in [*levels, *low]:
        gram = wanted & mask(level.order + 1)
        node, known = find(level.contexts, gram >> U(8))
        left = np.where(known, level.total[node] if len(level.keys) else 0, 0)
        kinds = np.where(known, level.symbols[node] if len(level.keys) else 0, 0)
        if above is not None and len(above.keys):
            longer, met = find(above.contexts, wanted >> U(8) & mask(above.order))
            left = left - np.where(met, above.taken[longer], 0)
            kinds = kinds - np.where(met, above.symbols[longer], 0)
        at, seen = find(level.keys, gram)
        here = open_ & (left > 0)
        hit, escape = here & seen, here & ~seen
        out[hit] += np.log10((2 * level.counts[at[hit]] - 1) / (2 * left[hit])) if hit.any() else 0
        out[escape] += np.log10(kinds[escape] / (2 * left[escape]))
        open_ &= ~hit
        above = level
    out[open_] -= np.log10(256 - len(low[-1].keys))
    return out


def bucket_of(keys: np.ndarray, space: int) -> np.ndarray:
    return ((mix(keys >> U(8) & mask(LOW + 1)) if space == GRAMS else keys) % U(BUCKETS)).astype(np.int32)


def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The distinct grams and words of each split that a task reads, with their counts in training texts, by bucket."""
    split, sums = None, None

    def rows() -> Iterator[dict]:
        for space, s in enumerate(sums):
            keys, counts = s.done()
            if space == GRAMS:
                trained = counts > 0
                lowest = summed([(keys[trained] & mask(LOW + 1), counts[trained])])
                yield {"space": [LOWEST], "bucket": [0], "split": [split], "keys": [packed(lowest[0])], "counts": [planes(lowest[1])]}
            bucket = bucket_of(keys, space)
            order = np.argsort(bucket, kind="stable")
            there, start = np.unique(bucket[order], return_index=True)
            for b, at in zip(there.tolist(), np.split(order, start[1:]) if len(start) else [], strict=True):
                yield {"space": [space], "bucket": [b], "split": [split], "keys": [packed(keys[at])], "counts": [planes(counts[at])]}

    for b in batches:
        splits = b.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(splits)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if int(splits[i]) != split:
                if sums is not None:
                    yield from rows()
                split, sums = int(splits[i]), (Sums(), Sums())
            texts = b.column(0).slice(i, j - i).to_pylist()
            train = b.column(1).slice(i, j - i).to_numpy(zero_copy_only=False)
            for codes, of in grams([(t or "").encode() for t in texts]):
                counted(sums[GRAMS], codes, train[of])
            words = word_hashes(texts)
            counted(sums[WORDS], np.concatenate([*words, np.full(len(texts), END_WORD)]), np.concatenate([np.repeat(train, [len(w) for w in words]), train]))
    if sums is not None:
        yield from rows()


LISTED = "space int, bucket int, split int, keys binary, counts binary"
ANSWERS = "space int, bucket int, keys binary, answers binary, distinct long, total long"


def answers_of(low) -> object:
    """What a bucket knows of each key: the cost of a gram, the count of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, sums = None, None

        def row() -> dict:
            keys, counts = sums.done()
            trained = counts > 0
            if now[0] == GRAMS:
                found = costs(keys, keys[trained], counts[trained], low.value).astype(np.float32)
            else:
                found = counts.astype(np.int64)
            return {"space": [now[0]], "bucket": [now[1]], "keys": [packed(keys)], "answers": [planes(found)], "distinct": [int(trained.sum())], "total": [int(counts.sum())]}

        for b in batches:
            for space, bucket, keys, counts in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if (space, bucket) != now:
                    if now is not None:
                        yield row()
                    now, sums = (space, bucket), Sums()
                sums.add(unpacked(keys), unplaned(counts, np.int64))
        if now is not None:
            yield row()

    return run


def kind_of(space: int) -> type:
    return np.float32 if space == GRAMS else np.int64


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A bucket's answers come first, then the listings of splits, which go on with their answers."""
    known = None
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("split", "space", "keys", "answers")}
        for space, split, keys, answers in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if split is None:
                known = unpacked(keys), unplaned(answers, kind_of(space))
            else:
                found = planes(known[1][np.searchsorted(known[0], unpacked(keys))])
                for k, v in zip(out, (split, space, keys, found), strict=True):
                    out[k].append(v)
        yield out


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A split's answers come first, then its documents, whose scores they give."""
    now, parts, index = None, None, None
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "logs", "score")}
        docs: list[tuple] = []

        def flush() -> None:
            texts = [d[2] for d in docs]
            total = np.zeros(len(texts))
            for codes, of in grams([(t or "").encode() for t in texts]):
                total += np.bincount(of, index[GRAMS][1][index[GRAMS][0].get_indexer(codes)].astype(np.float64), minlength=len(texts))
            words = word_hashes(texts)
            sizes = np.array([len(w) + 1 for w in words])
            flat = np.concatenate([np.append(w, END_WORD) for w in words])
            count = index[WORDS][1][index[WORDS][0].get_indexer(flat)]
            start = np.cumsum(sizes) - sizes
            known, logs = np.add.reduceat((count > 0).astype(np.int64), start), np.add.reduceat(np.log10(count + 1.0), start)
            for k, v in zip(out, ([d[0] for d in docs], [d[1] for d in docs], sizes.tolist(), known.tolist(), logs.tolist(), total.tolist()), strict=True):
                out[k] += v
            docs.clear()

        for split, space, keys, answers, doc_id, held, text in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
            if split != now:
                if docs:
                    flush()
                now, parts, index = split, ([], []), None
            if keys is not None:
                parts[space].append((unpacked(keys), unplaned(answers, kind_of(space))))
                continue
            if index is None:
                index = [(pd.Index(np.concatenate([k for k, _ in p])), np.concatenate([v for _, v in p])) for p in parts]
                parts = None
            docs.append((doc_id, held, text))
        if docs:
            flush()
        yield out


def scores(docs: DataFrame, learn: str = "learn", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; ``learn`` marks training rows.

    ``score`` is the log10 probability of the text under the byte model, its end included. ``base_score`` is that of its
    words (A-Z as a-z, between ASCII white space) and one end token under training counts plus one, with one unseen word.
    held_out: not learned from. Null and empty texts have an end only. Repeated rows are rows of their own, and are learned
    from as often. Very long texts are scored whole. Without training rows every byte costs log10(256) and the base is 0
    (one token is possible). An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[learn], F.lit(False)).alias("train"))
    kept = materialise(named.withColumn("split", F.spark_partition_id()), "lm-splits")
    listed = materialise(map_batches(kept.select("text", "train", "split"), listing, LISTED), "lm-listed")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for keys, counts in zip(*(b.column(c).to_pylist() for c in range(2)), strict=True):
                yield {"key": pa.array(unpacked(keys).astype(np.int64)), "n": pa.array(unplaned(counts, np.int64))}

    lowest = map_batches(listed.where(F.col("space") == LOWEST).select("keys", "counts"), exploded, "key long, n long")
    found = lowest.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # at most 2**24 rows, one for each three bytes
    low = spark.sparkContext.broadcast(low_levels(found.column("key").to_numpy().astype(U), found.column("n").to_numpy().astype(np.int64)))
    asked = listed.where(F.col("space") != LOWEST)
    by_bucket = asked.select("space", "bucket", "keys", "counts").repartition("space", "bucket").sortWithinPartitions("space", "bucket")
    model = materialise(map_batches(by_bucket, answers_of(low), ANSWERS), "lm-answers")
    distinct, total = model.where(F.col("space") == WORDS).agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    none = F.lit(None)
    both = model.select("space", "bucket", none.cast("int").alias("split"), "keys", "answers").unionByName(asked.select("space", "bucket", "split", "keys", none.cast("binary").alias("answers")))
    both = both.repartition("space", "bucket").sortWithinPartitions("space", "bucket", F.col("split").isNotNull()).select("space", "split", "keys", "answers")
    replies = map_batches(both, answered, "split int, space int, keys binary, answers binary")
    texts = kept.select("split", none.cast("int").alias("space"), none.cast("binary").alias("keys"), none.cast("binary").alias("answers"), "doc_id", (~F.col("train")).alias("held_out"), "text")
    ready = replies.select("*", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("string").alias("text")).unionByName(texts)
    ready = ready.repartition("split").sortWithinPartitions("split", F.col("keys").isNull())
    rows = map_batches(ready, scored, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learning from those whose crc32(doc_id as text) mod 7 is not 2; rows without an id are not learned from and not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("learn", id_bucket("doc_id", 7) != 2)
    return scores(docs).withColumn("held_out", F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(False)))

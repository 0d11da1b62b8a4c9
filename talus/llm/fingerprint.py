"""Document fingerprints: bottom-k sketches of word-shingle hashes, in Spark expressions only.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles, in ascending order. Sketches of parts merge
into the sketch of their union, and two of them estimate resemblance and containment; one estimates the number of
distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import table

K = 128
SHINGLE = 5
#: Rows of one window group when documents are put in order.
GROUP_ROWS = 2000
#: Quantile cells of the ids; inside a cell ids are split evenly.
CELLS = 256
#: Groups of ids, at most: beyond that they hold more rows. It bounds what the driver gets and broadcasts.
GROUPS = 1 << 17


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words_col: str, size: int = SHINGLE) -> Column:
    """Hash of each run of ``size`` words; of all words where there are fewer; none without words."""
    w = F.col(words_col)
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def add_sketch(df: DataFrame, text_col: str, out_col: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of ``text_col`` (an array of bigint, empty for texts without words)."""
    hidden = f"__words_of_{out_col}"
    return df.withColumn(hidden, words(df[text_col])).withColumn(out_col, bottom_k(shingle_hashes(hidden, size), k)).drop(hidden)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that is in both. 1 for two empty sketches."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(a == b, F.lit(1.0)).otherwise(both.cast("double") / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below ``k``; else (k - 1) over the k-th hash's place in the range of hashes."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 where ``a`` has none."""
    r = resemblance(a, b, k)
    both = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, key: str, sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each key from the sketches of its parts.

    Parts merge within (key, salt) first, so a key that holds most rows is spread over ``salts`` tasks, and each hands on
    at most ``k`` hashes. Null sketches count as empty.
    """
    h = (
        parts.select(F.col(key).alias("key"), F.explode_outer(F.col(sketch)).alias("h"))
        .withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
        .groupBy("key", "salt", "h")
        .agg(F.lit(1).alias("one"))
    )

    def lowest(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("h")
        return df.where(F.col("h").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    kept = lowest(lowest(h, "key", "salt"), "key").groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    keys = parts.select(F.col(key).alias("key")).distinct()
    on = keys["key"].eqNullSafe(kept["key"])
    empty = F.array().cast("array<bigint>")
    return keys.join(kept, on, "left").select(keys["key"].alias(key), F.coalesce(kept["sketch"], empty).alias(sketch))


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows dealt to groups of neighbouring ids, each with the next group's first row as a guest, and their order.

    The order is by descending id, rows without an id last; rows without one, and rows of an id that holds several quantiles,
    are ordered by a hash of the text, which also splits them over groups; ties by text. After the last comes the first. One
    pass over the ids finds quantiles and a second one the first row of each group; only these (two numbers for each of at
    most about ``2 * GROUPS`` groups) come to the driver and are broadcast. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    share = [i / CELLS for i in range(CELLS + 1)]
    counts = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.percentile_approx("doc_id", share, 10_000)).first()
    n, known, quantiles = counts[0], counts[1], counts[2] or [0]
    marks = sorted(set(quantiles))
    often = sorted({m for m in marks if quantiles.count(m) > 1})
    wanted = max(1, -(-n // GROUP_ROWS))
    split, sub = -(-min(wanted, GROUPS) // CELLS), min(wanted, 2 * GROUPS // CELLS)
    unknown = max(1, min(-(-(n - known) // GROUP_ROWS), GROUPS // 2))
    doc_id = F.col("doc_id")
    many = doc_id.isin(often) if often else F.lit(False)
    # The text is only read here for rows whose id does not place them.
    mixed = F.xxhash64("text")
    h = F.when(doc_id.isNull() | many, mixed) if often or known < n else F.lit(None).cast("long")
    at = (mixed.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)

    def bucket(parts: int) -> Column:
        return F.least(F.floor(at * parts), F.lit(parts - 1)) if parts > 1 else F.lit(0)

    bounds = F.array(*[F.lit(m).cast("long") for m in marks])
    cell = F.greatest(F.size(F.filter(bounds, lambda m: m <= doc_id)), F.lit(1))
    low = F.element_at(bounds, cell)
    high = F.element_at(bounds, F.least(cell + 1, F.lit(len(marks))))
    part = F.when(high > low, F.floor((doc_id - low) / (high - low) * split)).otherwise(0)
    part = F.greatest(F.lit(0), F.least(part, F.lit(split - 1)))
    # An id of many rows is a cell's lowest: its groups lie below those of the cell's other ids.
    inside = F.when(many, sub - 1 - bucket(sub)).otherwise(sub)
    group = F.when(doc_id.isNull(), -1 - bucket(unknown)).otherwise((cell * split + part) * (sub + 1) + inside).cast("long")
    heads = rows.select(group.alias("g"), "doc_id", h.alias("h")).groupBy("g").agg(F.max("doc_id"), F.min("h")).collect()
    firsts = sorted((tuple(r) for r in heads), key=lambda r: r[0], reverse=True)
    # Group i's first row is a guest of the group before it, and the very first row a guest of the last group.
    guests = [(first, mark, firsts[i - 1][0]) for i, (_, first, mark) in enumerate(firsts)]
    guests = spark.createDataFrame(guests, "doc_id long, h long, host long")
    rows = rows.withColumn("g", group).withColumn("h", h)
    hosted = rows.join(F.broadcast(guests), rows["doc_id"].eqNullSafe(guests["doc_id"]) & rows["h"].eqNullSafe(guests["h"]), "left")
    own = F.struct(F.col("g"), F.lit(False).alias("guest"))
    also = F.struct(F.col("host").alias("g"), F.lit(True).alias("guest"))
    dealt = hosted.select(
        rows["doc_id"], "text", rows["h"], F.inline(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, also)))
    )
    return dealt, Window.partitionBy("g").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h", "text")


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare.

    The edited text ends in the first third (of this text's code points) of the next document instead of its own last
    third. A null text is empty; texts without words have an empty fingerprint, and two of them are alike (1.0); a single
    document is its own next. Repeated rows each give a row; other columns are ignored. Very long texts are sketched whole, in
    one row's expression: the words of one text must fit a task's memory.
    """
    dealt, order = in_id_order(docs, id_col, text_col)
    third = F.floor(F.char_length("text") / 3).cast("int")
    rows = (
        dealt.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn(
            "edited",
            F.concat(
                F.substring(F.col("text"), F.lit(1), F.char_length("text") - third),
                F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third),
            ),
        )
        .drop("next_text")
    )
    rows = add_sketch(rows, "text", "sketch", k)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("guest"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = add_sketch(rows, "edited", "edited_sketch", k)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_in_text"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))

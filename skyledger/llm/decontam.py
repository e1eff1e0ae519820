"""Test items inside long documents, by size-partitioned MinHash containment search; Spark expressions only.

Items are partitioned by the size of their shingle sets. An item's sketch is the ``k`` shingles with
the smallest hashes; ``k`` is set for each partition so that a document with the asked share of any
item's shingles has one of the sketch at least. The search therefore finds every such pair, and the
pairs found are verified on all shingles.

Defined results: texts are lower-cased and cut into runs of letters and digits; a null or empty text,
or one of fewer words than a shingle has, has no shingles, and neither contains nor is contained;
rows with equal ids count as one document with the best containment; null ids are not searched;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Sketch rows up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(rows: DataFrame, n: int, words_col: str = "words", out: str = "shingles") -> DataFrame:
    """``rows`` with the hashes of all ``n``-word shingles; the words go."""

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))

    # Words are hashed once each, and a shingle from their hashes.
    numbers = F.transform(words_col, lambda x: F.xxhash64(x))
    # A lambda's variable holds the numbers: a plain column would be computed anew for every shingle once the optimizer inlines it.
    return rows.withColumn(out, F.get(F.transform(F.array(numbers), hashed), F.lit(0))).drop(words_col)


def sketches(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``items`` (item_id, shingles, distinct) with size_class and sketch."""
    size = F.size("shingles")
    # Sizes from 2**c to 2**(c + 1) - 1 are a partition; of its largest, so many shingles can be missing.
    sized = items.filter(size > 0).withColumn("size_class", F.floor(F.log2(size)).cast("int"))
    most_missing = F.floor((1 - threshold) * (F.pow(F.lit(2), F.col("size_class") + 1) - 1) + 1e-9)
    return sized.withColumn("sketch", F.slice(F.array_sort("shingles"), F.lit(1), F.least(most_missing + 1, size).cast("int")))


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair at or above the threshold."""
    rows = common.texts(docs, id_col, text_col).filter("doc_id is not null")
    asked = common.texts(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    items = sketches(shingles(asked.select("item_id", words(F.col("text")).alias("words")), n).withColumn("shingles", F.array_distinct("shingles")), threshold)
    items = common.saved(items, "items")
    keys = items.select("item_id", F.explode("sketch").alias("shingle"))
    small = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    light = F.broadcast if small <= BROADCAST_ROWS else lambda x: x
    hashed = shingles(rows.select("doc_id", words(F.col("text")).alias("words")), n)
    # An outer explode infers no filter that would compute the shingles twice.
    pairs = hashed.select("doc_id", F.explode_outer("shingles").alias("shingle")).join(light(keys), "shingle").select("doc_id", "item_id").distinct()
    pairs = common.saved(pairs, "candidates")
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda x: x
    wanted = pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids"))
    some = rows.join(few(wanted), "doc_id").select("doc_id", "item_ids", words(F.col("text")).alias("words"))
    whole = shingles(some, n).withColumn("shingles", F.array_distinct("shingles"))
    both = whole.select("doc_id", "shingles", F.explode_outer("item_ids").alias("item_id")).join(light(items.select("item_id", F.col("shingles").alias("own"))), "item_id")
    shared = both.select("doc_id", "item_id", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"), F.size("own").cast("long").alias("n_item"))
    best = shared.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= threshold)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that contain a test item."""
    found = common.small_or_not(common.saved(leaks(docs, benchmark, n, threshold, id_col, text_col).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked"))
    return docs.join(found, docs[id_col] == found["_leaked"], "left_anti")

"""Audit of how five text filters interact, by Walsh-Hadamard sums.

A document's failed filters are a mask of five bits. For each part and each label (all documents, good
ones, toxic ones) 32 signed sums are aggregated, one for each set of filters: a document counts 1 if it
fails an even number of the set, else -1. These sums are the Walsh-Hadamard transform of the 32 counts
of masks, and the same transform divided by 32 gives the counts back exactly. All 120 orders are then
evaluated on the counts: what is kept after a step depends on the masks alone. Over all orders each of
a document's k failed filters comes first in 120 / k, which sums up to the filter's Shapley number.

Only 96 sums a part leave a task; equal texts are found by their SHA-256, ids and digests being all that
is shuffled.

Defined results: a null text is empty, a null language the part ""; an empty language is that part too;
of equal texts those with the smallest id are first, and rows that share that id are all first; a row
with a null id is never a copy nor the first of copies, and has no label; a document is good (toxic) if
any of its rows in ``labels`` says so; rows with equal ids are documents of their own; texts are read
whole, whatever their length; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
SPACE = " \t\n\x0b\f\r"


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> DataFrame:
    """(doc_id, part, digest, mask) per row: bits 0 to 3 of the mask are what a text fails by itself."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    rows = rows.withColumn("words", words)
    fails = [
        F.size("words") < least_words,
        100 * F.size(F.array_distinct("words")).cast("long") < distinct_percent * F.size("words"),
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > capital_percent * F.length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).alias("mask"))


def with_copies(rows: DataFrame) -> DataFrame:
    """Bit 4 of the mask: a smaller id has the same text."""
    again = common.saved(rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").select(F.col("digest").alias("_digest"), "_first"), "copied")
    out = rows.join(common.small_or_not(again), F.col("digest") == F.col("_digest"), "left")
    return out.withColumn("mask", F.col("mask") + F.when(F.col("_first") < F.col("doc_id"), 1 << 4).otherwise(0)).drop("_digest", "_first")


def _odd(m: Column, s: Column | int) -> Column:
    return F.bit_count(m.bitwiseAND(s)) % 2


def sums(rows: DataFrame, good: Column, toxic: Column) -> DataFrame:
    """Per part three arrays of 32 signed sums: all documents, good ones and toxic ones."""
    signed = lambda weight: F.array(*(F.sum(weight * (1 - 2 * _odd(F.col("mask"), s))) for s in range(CELLS)))
    return rows.groupBy("part").agg(signed(F.lit(1)).alias("all"), signed(good.cast("int")).alias("good"), signed(toxic.cast("int")).alias("toxic"))


def inverted(name: str) -> Column:
    """Counts of the 32 masks from their signed sums; the division leaves no rest."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    cell = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.element_at(name, s + 1) * (1 - 2 * _odd(m, s)))
    return F.transform(every, lambda m: F.shiftright(cell(m), len(FILTERS)))


def audit(docs: DataFrame, labels: DataFrame, **options: str | int) -> DataFrame:
    """One row per part, order of the filters and step; the docstring above says what is counted."""
    rows = with_copies(common.saved(failures(docs, **options), "masks"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(says("quality").alias("_good"), says("toxic").alias("_toxic")).filter("_good or _toxic")
    rows = rows.join(common.small_or_not(common.saved(marked, "marked")), F.col("doc_id") == F.col("_id"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    cells = sums(rows, flag("_good"), flag("_toxic")).select("part", *(inverted(c).alias(c) for c in ("all", "good", "toxic")))

    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    at = lambda letter: F.instr("filter_order", letter)
    bits = lambda holds: sum((F.when(holds(at(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("own", bits(lambda i: i == F.col("step"))).withColumn("before", bits(lambda i: i < F.col("step")))

    def total(name: str, which, weight=lambda m: F.lit(1)) -> Column:
        masks = F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), which)
        return F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.element_at(name, m + 1) * weight(m))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part", "filter_order", "step", total("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("all", removed).alias("removed"), total("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.element_at("all", F.col("own") + 1).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        total("all", fails, lambda m: (120 / F.bit_count(m)).cast("long")).alias("shapley"),
    )

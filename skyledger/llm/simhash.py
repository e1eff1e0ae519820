"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by an inverted index of their bytes.

Two fingerprints that differ in at most ``bits`` = 3 bits differ in at most 3 of their 8 bytes, so
they share at least 5 bytes at the same positions. An index of single bytes would have lists of
1/256 of all fingerprints; here an entry is a set of positions with their bytes. The first entries
have 3 positions: those 8 sets of three that lie in one half of the fingerprint, since of 5 shared
positions 3 are in one half. A list of more than ``limit`` fingerprints is dealt again by one more
position, up to the 5 that a pair must share. Pairs of short lists are tallied: how many bytes they
share at equal positions; those that share the guaranteed number are verified bit by bit.

A list that is long with 5 positions is a dense cloud: its fingerprints differ in few bits of the
other 3 bytes. There no pairs are formed: for each three of the bits that vary in the list, those
that are equal in all other bits are within 3 bits of each other, and each is tied to the least of
them. Rows for a fingerprint are bounded by a number (2024 a list), whatever the length of the list.

Documents with equal fingerprints are one class and are joined once, so copies cost nothing.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of fewer
than ``n`` words is one shingle; ties of a bit are 0; rows with equal ids are documents of their own;
a row with a null id links like others, but no component is named after it: a component of such rows
alone is null; shingles of a text are hashed piece by piece, whatever its length; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

BYTES, SEED = 8, 42
#: Longest list whose pairs are formed, and shingles hashed at once.
LIMIT, PIECE = 64, 1 << 16


def fingerprint(text: str, n: int = 3) -> int:
    """As a signed number. Words are split at ASCII white space only, and only A-Z are lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1]
    ends, total, ones = ends[n - 1 :], len(words) - n + 1, np.zeros(64, np.int64)
    for k in range(0, total, PIECE):
        spans = zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, texts in common.by_text(batches):
            yield {"doc_id": ids, "fp": [fingerprint(t, n) for t in texts]}

    return common.map_batches(common.texts(docs, id_col, text_col), run, "doc_id long, fp long")


def _at(positions: Column) -> Column:
    """Bits of a fingerprint at a set of byte positions, itself given by bits."""
    return sum((F.when(positions.bitwiseAND(1 << p) != 0, F.lit(0xFF << 8 * p if p < 7 else -1 << 56)).otherwise(0).cast("long") for p in range(BYTES)), F.lit(0).cast("long"))


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the positions at which two fingerprints have equal bytes."""
    differ = a.bitwiseXOR(b)
    return sum(((F.shiftrightunsigned(differ, 8 * p).bitwiseAND(0xFF) == 0).cast("int") for p in range(BYTES)), F.lit(0))


def _postings(fps: DataFrame) -> DataFrame:
    """(at, key, fp): the lists of three positions in a half."""
    sets = [sum(1 << p for p in three) for half in (range(4), range(4, 8)) for three in combinations(half, 3)]
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, sets))).alias("at"))
    return rows.withColumn("key", F.col("fp").bitwiseAND(_at(F.col("at"))))


def _longer(rows: DataFrame) -> DataFrame:
    """The same fingerprints in lists of one position more."""
    more = F.filter(F.transform(F.array(*(F.lit(1 << p) for p in range(BYTES))), lambda p: F.col("at").bitwiseOR(p)), lambda s: s != F.col("at"))
    rows = rows.select("fp", F.explode(more).alias("at")).distinct()
    return rows.withColumn("key", F.col("fp").bitwiseAND(_at(F.col("at"))))


def _stars(rows: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) of long lists: ``vary`` has the bits that differ in a list."""
    ones = F.filter(F.array(*(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64))), lambda b: F.col("vary").bitwiseAND(b) != 0)
    masks = F.col("ones")
    for _ in range(bits - 1):
        masks = F.array_distinct(F.flatten(F.transform(masks, lambda m: F.transform(F.col("ones"), lambda b: m.bitwiseOR(b)))))
    rows = rows.withColumn("ones", ones).withColumn("masks", masks)
    # A mask of fewer bits adds nothing to one that holds it, except in a list that varies in fewer.
    full = F.filter("masks", lambda m: F.bit_count(m) == F.least(F.size("ones"), F.lit(bits)))
    lists = rows.select("at", "key", "fp", F.explode(full).alias("mask")).withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    least = lists.groupBy("at", "key", "mask", "rest").agg(F.min("fp").alias("v"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return lists.join(least, ["at", "key", "mask", "rest"]).filter("fp != v").select(F.col("fp").alias("u"), "v")


def near(fps: DataFrame, bits: int = 3, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that make up all components of those at most ``bits`` apart."""
    if not 0 < bits <= 3:
        raise ValueError("bits must be 1 to 3: lists of three positions rest on five shared bytes")
    least, links = BYTES - bits, []
    rows = _postings(fps)
    for width in range(3, least + 1):
        sizes = rows.groupBy("at", "key").agg(F.count("*").alias("_n"), F.expr("bit_or(fp)").bitwiseXOR(F.expr("bit_and(fp)")).alias("vary")).filter("_n > 1")
        met = common.saved(rows.join(sizes, ["at", "key"]), "postings")
        short = met.filter(F.col("_n") <= limit).select("at", "key", "fp")
        pairs = short.select("at", "key", F.col("fp").alias("u")).join(short.select("at", "key", F.col("fp").alias("v")), ["at", "key"]).filter("u > v")
        pairs = pairs.filter(shared_bytes(F.col("u"), F.col("v")) >= least).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
        links.append(pairs.select("u", "v"))
        dense = met.filter(F.col("_n") > limit)
        if dense.isEmpty():
            break
        rows = _longer(dense)
    else:
        links.append(_stars(dense.select("at", "key", "fp", "vary"), bits))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def deduplicated(docs: DataFrame, n: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row."""
    rows = common.saved(fingerprints(docs, n, id_col, text_col), "fingerprints")
    classes = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")), "classes")
    linked = components(near(classes.select("fp"), bits, limit), files=True).join(classes, F.col("id") == F.col("fp")).select("fp", "component_id", "first")
    least = linked.groupBy("component_id").agg(F.min("first").alias("least"))
    named = linked.join(least, "component_id").select("fp", "least")
    alone = classes.filter("_n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("least"))
    named = common.small_or_not(common.saved(named.union(alone).withColumnRenamed("fp", "_fp"), "named"))
    out = rows.join(named, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))

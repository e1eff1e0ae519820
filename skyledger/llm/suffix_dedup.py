"""Removal of long byte strings that stand earlier in the corpus, by a logarithmic family of suffix indexes.

A full suffix array needs several bytes for each byte of text. The index is therefore sparse: it has
the suffixes at anchors. The anchor of a ``length``-byte string is the ``k``-byte gram in it with
the smallest hash, so equal strings have their anchors at the same place, and every string of
``length`` bytes has one. An entry stands for the run of strings that share an anchor; it holds a
hash of the gram (where suffixes meet) and of all bytes that the run covers (its context).

Documents come in batches by id. A batch gets its sorted entries (a level), which are merge-scanned
with the levels there are; levels of about equal size are merged before the next batch, so there are
only logarithmically many. The scan decides most entries at once: one whose context stands earlier
is covered whole. Entries whose gram is known with another context lie at the borders of repeats;
there the single strings are read from the texts and compared by hash.

Defined results: a null or empty text has nothing to remove; null ids come before all others; rows
with equal ids, or none, are documents of their own, ordered by text, so that of equal rows one keeps
its text; a text of any length is scanned in blocks, and is held whole by one task; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ngram_join import mixed, signed

#: Bytes of a gram that anchors strings; and strings of a text handled at once.
GRAM, BLOCK = 32, 1 << 19
#: Entries that a task gathers before it looks for those it has twice.
FLUSH = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)))


class Hasher:
    """Hashes of all substrings of a text, from prefix sums modulo 2**64."""

    _table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    _up = _down = np.zeros(0, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Hasher._up) <= len(data):
            n = max(1 << 12, 2 * len(data))
            Hasher._up, Hasher._down = _powers(_ODD, n), _powers(_INVERSE, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(Hasher._table[data] * Hasher._up[: len(data)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hasher._down[start])

    def windows(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:m]) * Hasher._down[:m])


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: bytes, length: int = 100, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, context hash, first start, number of starts less one) of every run of strings with one anchor."""
    low = np.uint64((1 << 20) - 1)
    raw = np.frombuffer(data, dtype=np.uint8)
    for s in range(0, len(raw) - length + 1, BLOCK):
        part = raw[s : s + BLOCK + length - 1]
        h = Hasher(part)
        grams = h.windows(gram)
        at = smallest((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        place = at[first].astype(np.int64)
        context = h.of(first, last + length) ^ mixed(((place - first) << 8 | (last - first)).astype(np.uint64))
        yield grams[place], mixed(context), first + s, last - first


def split_firsts(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows are the first, by document and place, of those with their keys."""
    order = np.lexsort((pos, doc, *keys[::-1]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.zeros(len(order), dtype=bool)
    out[order[new]] = True
    return out


#: What a row of entries() is: an entry, one of a gram with several contexts, a witness of such a gram, or strings that are covered.
ENTRY, BORDER, WITNESS, COVERED = range(4)


def sorted_out(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of each row, rows that are witnesses as well) among the rows that one task holds."""
    first = split_firsts([gram, context], doc, pos)
    kind = np.where(first, ENTRY, COVERED)
    own = np.flatnonzero(first)
    own = own[np.lexsort((context[own], gram[own]))]
    again = gram[own][1:] == gram[own][:-1]
    several = np.zeros(len(own), dtype=bool)
    several[1:] |= again
    several[:-1] |= again
    kind[own[several]] = BORDER
    # The first two contexts of such a gram show to other tasks that it has several.
    starts = np.concatenate(([True], ~again)) if len(own) else np.zeros(0, dtype=bool)
    seconds = np.concatenate(([False], starts[:-1])) & ~starts if len(own) else starts
    return kind, own[several & (starts | seconds)]


def entries(docs: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """(kind, gram, context, doc, place) of a batch; place is the first start times 256, plus the number of further starts.

    A task sends one entry for each gram, or two witnesses, however often it has the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[dict]:
            g, c, d, p = (np.concatenate(x) for x in zip(*held))
            kind, seen = sorted_out(g, c, d, p)
            at = np.concatenate((np.arange(len(g)), seen))
            kind = np.concatenate((kind, np.full(len(seen), WITNESS)))
            plain = (kind == COVERED) | (kind == BORDER)
            yield {"kind": kind, "gram": pa.array(signed(g[at]), mask=plain), "context": pa.array(signed(c[at]), mask=plain), "doc": d[at], "place": p[at]}

        for ids, texts in common.by_text(batches):
            for doc, text in zip(ids, texts):
                for g, c, p, m in anchors(text.encode(), length, gram):
                    held.append((g, c, np.full(len(g), doc, np.int64), p << 8 | m))
                    size += len(g)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return common.map_batches(docs, run, "kind long, gram long, context long, doc long, place long")


class SuffixFamily:
    """The levels, what earlier batches have covered, and what is still to be compared string by string."""

    def __init__(self, spark, length: int = 100, gram: int = GRAM):
        self.spark, self.length, self.gram = spark, length, gram
        self.levels: list[tuple[int, DataFrame]] = []
        self.covered: list[DataFrame] = []
        self.border: list[DataFrame] = []

    def merge_levels(self) -> None:
        """Merges neighbours of about equal size, as a counter carries; a merged level has each context once, the first."""
        while len(self.levels) > 1 and self.levels[-2][0] <= 2 * self.levels[-1][0]:
            (_, a), (_, b) = self.levels[-2:]
            # What a later level has of contexts of an earlier was not kept, so a sorted union is the merge.
            both = common.saved(a.union(b).sortWithinPartitions("gram"), "level")
            self.levels[-2:] = [(both.count(), both)]
            common.discard(a, b)
            common.release(self.spark)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Indexes a batch (doc_id, text) whose ids all come after those before, and scans it with the levels.

        After the ``last`` batch no level is kept. Tables go as soon as what follows from them is written.
        """
        self.merge_levels()
        own = common.saved(entries(docs, self.length, self.gram), "entries")
        known = own.filter(F.col("kind").isin(ENTRY, WITNESS)).withColumn("level", F.lit(0))
        for _, level in self.levels:
            known = known.union(level.withColumn("level", F.lit(1)))
        by_gram = Window.partitionBy("gram")
        by_context = Window.partitionBy("gram", "context").orderBy("doc", "place")
        met = (
            known.repartition("gram")
            .withColumn("rank", F.row_number().over(by_context))
            .withColumn("low", F.min("context").over(by_gram))
            .withColumn("high", F.max("context").over(by_gram))
            .filter("level = 0 or low < high")
            .select("kind", "gram", "context", "doc", "place", "level", "rank", F.expr("low < high").alias("border"), F.expr("context in (low, high)").alias("end"))
        )
        if last:
            # Nothing will be compared with this batch, so only what is decided or at a border is written.
            met = met.filter(f"kind = {ENTRY} and level = 0 and (rank > 1 or border) or kind = {ENTRY} and rank = 1 and border")
        met = common.saved(met, "scan")
        entry = F.col("kind") == ENTRY
        plain = own.filter(F.col("kind").isin(COVERED, BORDER)).select("doc", "place", (F.col("kind") == COVERED).alias("covered"))
        later = met.filter(entry & (F.col("rank") > 1) & (F.col("level") == 0)).select("doc", "place", F.lit(True).alias("covered"))
        edge = met.filter(entry & (F.col("rank") == 1) & F.col("border")).select("doc", "place", F.lit(False).alias("covered"))
        found = common.saved(plain.union(later).union(edge), "found")
        self.covered.append(found.filter("covered").select("doc", "place"))
        self.border.append(found.filter("not covered").select("doc", "place"))
        if last:
            common.discard(*(level for _, level in self.levels))
            self.levels = []
        else:
            kept = met.filter("rank = 1 and level = 0 and (end or not border)")
            level = common.saved(kept.select(F.expr(f"if(border, {WITNESS}, kind)").cast("long").alias("kind"), "gram", "context", "doc", "place").sortWithinPartitions("gram"), "level")
            self.levels.append((level.count(), level))
            del kept, level
        common.discard(own, met)
        del own, known, met, plain, later, edge
        common.release(self.spark)

    def border_strings(self, docs: DataFrame) -> DataFrame:
        """(doc, place) of the strings at borders that stand earlier in another entry at a border."""
        length = self.length
        asked = self.border[0]
        for b in self.border[1:]:
            asked = asked.union(b)
        asked = asked.groupBy("doc").agg(F.collect_list("place").alias("places"))
        rows = docs.join(asked, docs.doc_id == asked.doc).select("doc", "text", "places")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            held: list[tuple] = []
            size = 0

            def flush() -> Iterator[dict]:
                h, d, p = (np.concatenate(x) for x in zip(*held))
                first = split_firsts([h], d, p)
                yield {"string": pa.array(signed(h), mask=~first), "doc": d, "place": p << 8}

            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    for doc, text, places in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                        raw = np.frombuffer(text.encode(), dtype=np.uint8)
                        places = np.unique(np.array(places, np.int64))
                        p, m = places >> 8, (places & 255) + 1
                        starts = np.repeat(p, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        starts = np.unique(starts)
                        for s in range(0, len(starts), BLOCK):
                            some = starts[s : s + BLOCK]
                            h = Hasher(raw[some[0] : some[-1] + length])
                            held.append((h.of(some - some[0], some - some[0] + length), np.full(len(some), doc, np.int64), some))
                            size += len(some)
                        if size >= FLUSH:
                            yield from flush()
                            held, size = [], 0
            if held:
                yield from flush()

        found = common.saved(common.map_batches(rows, run, "string long, doc long, place long"), "strings")
        # The shuffled texts go before the strings are shuffled.
        del rows, asked
        common.release(self.spark, wait=3)
        by = Window.partitionBy("string").orderBy("doc", "place")
        later = found.filter("string is not null").withColumn("rank", F.row_number().over(by)).filter("rank > 1")
        out = common.saved(found.filter("string is null").select("doc", "place").union(later.select("doc", "place")), "border")
        del later
        common.discard(found)
        common.release(self.spark)
        return out

    def removed(self, docs: DataFrame) -> DataFrame:
        """(doc, place): runs of strings that stand earlier."""
        out = self.border_strings(docs)
        for c in self.covered:
            out = out.union(c)
        return out


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` ranges of ids of about equal size."""
    if n < 2:
        return [docs]
    cuts = sorted(set(docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000)).first()[0] or []))
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = docs
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        out.append(part)
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """(doc_id, text, row): row is the id where it is of one row, in all of the table; else rows are numbered by id and text."""
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn("row", F.col("doc_id"))
    return common.saved(rows.orderBy("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")


def deduplicated(docs: DataFrame, length: int = 100, batches: int = 3, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""
    spark = docs.sparkSession
    rows = numbered(common.texts(docs, id_col, text_col))
    by_row = rows.select(F.col("row").alias("doc_id"), "text")
    family = SuffixFamily(spark, length)
    parts = batches_of(by_row, batches)
    for k, part in enumerate(parts):
        family.add(part, last=k == len(parts) - 1)
    cut = family.removed(by_row).groupBy("doc").agg(F.collect_list("place").alias("places"))
    joined = rows.join(cut, rows["row"] == cut["doc"], "left").select("doc_id", "text", "places")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts:
            for k in range(0, batch.num_rows, 500):
                out = defaultdict(list)
                for doc, text, places in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                    raw = text.encode()
                    places = np.array(places or [], np.int64)
                    p = places >> 8
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, p, 1)
                    np.add.at(change, p + (places & 255) + length, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    values = {"doc_id": doc, "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                    for name, v in (values | ({"kept": kept} if with_text else {})).items():
                        out[name].append(v)
                yield out

    return common.map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

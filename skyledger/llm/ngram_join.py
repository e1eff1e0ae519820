"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering, and its components.

Documents with equal sets of n-grams are one class and are joined once. Two classes at or above the
threshold share an n-gram of their prefixes, whatever order of n-grams all of them share. The order
here takes a sample of the n-grams (by hash) first, rare before frequent by exact counts of classes,
and then all others. The sample is a few times as large as a prefix, so prefixes come from it, and
only its n-grams are shuffled and counted. A class whose prefix holds only n-grams of its own links
with nothing and is done: of ordinary text about one class in six is left. Those are joined by the
same order over all their n-grams.

Classes that share a prefix n-gram form a group. In a small group all pairs that the length and
position filters allow are verified. In a large one, which near copies of one text or a common passage
make, every member is verified with the hub only, the member with the fewest n-grams of its own, as
an original has. Two members x and y that link, not both linked with the hub h, have differences
x ^ h and y ^ h that overlap: as sets, |x ^ y| is at most c (|x| + |y|) with c = (100 - percent) /
(100 + percent), while |y ^ h| is above c (|y| + |h|). So members are joined again by prefixes of
their differences, what the hub lacks first: independent edits of one text share none of it, and
groups that are still large go to the next round in the same way. No link is lost.

Pairs are verified once, on their n-grams, after a suffix filter over parts of the hash range.

Defined results: a null or empty text has no n-grams and is linked with nothing; a text shorter
than n words is one n-gram; equal texts are one class, tied to the smallest id; rows with equal ids
are one document for links; null ids are linked with nothing; texts may be of any length, one at a
time is held in memory; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components

_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: N-grams that a task gathers before it sends them, and classes of one of them from which it is frequent.
FLUSH, HOT = 1 << 20, 64
#: Largest group in which all pairs are formed, and rounds of hubs.
SMALL, ROUNDS = 8, 5
#: The side of a row that is a link.
LINK = -1


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Grams:
    """Distinct n-gram hashes of texts."""

    def __init__(self, n: int = 3):
        self.n = n

    def words(self, text: str) -> np.ndarray:
        # Splitting bytes cuts at ASCII white space only, and lower() changes A-Z only.
        ws = text.encode().lower().split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))

    def hashes(self, w: np.ndarray) -> np.ndarray:
        """One hash per place of an n-gram in a sequence of words."""
        n = self.n if len(w) >= self.n else len(w)
        x = mixed(w[: len(w) - n + 1] + np.uint64(n))
        for k in range(1, n):
            x = mixed(x * _ODD1 + w[k : len(w) - n + 1 + k] * _ODD2)
        return x

    def of_words(self, w: np.ndarray) -> np.ndarray:
        # As np.unique, which takes several times as long.
        x = np.sort(self.hashes(w)) if len(w) else w
        return x[np.append(True, x[1:] != x[:-1])] if len(x) else x

    def __call__(self, text: str) -> np.ndarray:
        return self.of_words(self.words(text))


def needed(total: int | np.ndarray, percent: int):
    """Least intersection of two sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sampled(grams: np.ndarray, eighths: int) -> np.ndarray:
    """Which n-grams come first in the order; by other bits than those that sort them."""
    return (grams & np.uint64(7)) < np.uint64(eighths)


def class_of(grams: np.ndarray) -> bytes:
    """128 bits of a whole set; the first 64 name its class."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def name_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def profile(docs: DataFrame, n: int, eighths: int) -> DataFrame:
    """(doc_id, n_shingles, n_sampled, key, cls) per row: key is that of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams = Grams(n)
        for ids, texts in common.by_text(batches):
            sets = [grams(t) for t in texts]
            keys = [class_of(g) for g in sets]
            yield {"doc_id": ids, "n_shingles": [len(g) for g in sets], "n_sampled": [int(sampled(g, eighths).sum()) for g in sets], "key": keys, "cls": [name_of(k) for k in keys]}

    return common.saved(common.map_batches(docs, run, "doc_id long, n_shingles long, n_sampled long, key binary, cls long"), "profile")


def sent(cls: np.ndarray, gram: np.ndarray) -> dict:
    """Rows for n-grams of the sample that a task holds.

    One that ``HOT`` classes have is frequent, whatever other tasks have. Its rows are dealt by class, so
    that no task gets all of them, and a row without a class tells the others' that it is.
    """
    order = np.argsort(gram)
    cls, gram = cls[order], gram[order]
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    runs = np.diff(np.append(starts, len(gram)))
    hot = np.repeat(runs >= HOT, runs)
    told = gram[starts[runs >= HOT]]
    k = len(gram)
    return {
        "at": np.concatenate((np.where(hot, cls, gram), told)),
        "gram": np.concatenate((gram, told)),
        "cls": pa.array(np.concatenate((cls, told)), mask=np.arange(k + len(told)) >= k),
        "weight": np.concatenate((np.where(hot, HOT, 1), np.full(len(told), HOT))),
    }


def repeated(docs: DataFrame, n: int, percent: int, eighths: int) -> DataFrame:
    """(cls, gram, often): n-grams of the sample that several classes have, often being how many, up to HOT; and
    with HOT + 1 those beyond the sample that the prefix of a class needs whose sample is too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams = Grams(n)
        held: list[tuple] = []
        size, seen = 0, set()
        for ids, texts in common.by_text(batches):
            beyond = defaultdict(list)
            for doc, t in zip(ids, texts):
                g = grams(t)
                if not len(g) or doc is None:
                    continue
                cls = name_of(class_of(g))
                if cls in seen:
                    continue
                seen.add(cls)
                inside = sampled(g, eighths)
                some = signed(g[inside])
                held.append((np.full(len(some), cls, np.int64), some))
                size += len(some)
                short = prefix_size(len(g), percent) - len(some)
                if short > 0:
                    rest = signed(g[~inside][:short])
                    beyond["at"].append(np.full(len(rest), cls, np.int64))
                    beyond["gram"].append(rest)
            if beyond:
                at = np.concatenate(beyond["at"])
                yield {"at": at, "gram": np.concatenate(beyond["gram"]), "cls": at, "weight": np.full(len(at), HOT + 1)}
            if size >= FLUSH:
                yield sent(*(np.concatenate(x) for x in zip(*held)))
                held, size, seen = [], 0, set()
        if size:
            yield sent(*(np.concatenate(x) for x in zip(*held)))

    rows = common.map_batches(docs, run, "at long, gram long, cls long, weight long")
    group = Window.partitionBy("at", "gram")
    counted = rows.select("*", F.dense_rank().over(group.orderBy("cls")).alias("_n"), F.lag("cls").over(group.orderBy("cls")).alias("_before"))
    counted = counted.select("*", F.max("_n").over(group).alias("_n_all"), F.max("weight").over(group).alias("_w"))
    often = F.when(F.col("_w") >= HOT, F.col("_w")).otherwise(F.least("_n_all", F.lit(HOT)))
    return counted.filter("cls is not null and not (_before <=> cls) and (_n_all > 1 or _w > 1)").select("cls", "gram", often.alias("often"))


def tokens(sizes: DataFrame, docs: DataFrame, n: int, percent: int, eighths: int) -> DataFrame:
    """Rows of groups: the prefix n-grams, shared ones, of classes that have any; see ``grouped``."""
    classes = sizes.filter("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.max("n_shingles").alias("size"), F.max("n_sampled").alias("_sampled"))
    # A class that several tasks have comes once, though frequent n-grams of it may have come by two ways.
    rows = repeated(docs, n, percent, eighths).repartition("cls").groupBy("cls", "gram").agg(F.max("often").alias("often")).join(classes, "cls")
    rows = rows.withColumn("own", F.col("_sampled") - F.sum(F.when(F.col("often") <= HOT, 1).otherwise(0)).over(Window.partitionBy("cls")))
    prefix = F.col("size") - F.ceil(percent * F.col("size") / 100) + 1
    rows = rows.withColumn("pos", F.col("own") + F.row_number().over(Window.partitionBy("cls").orderBy("often", "gram")) - 1).filter(F.col("pos") < prefix)
    return common.saved(rows.select(F.col("gram").alias("key"), "cls", "size", F.col("size").alias("len"), "pos", "own", F.lit(0).cast("long").alias("side")), "tokens")


def grouped(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups whose pairs are formed at once, members of large groups with their hub).

    A row is (key, cls, size, len, pos, own, side): the n-gram at ``pos`` in a list of ``len``. Sides 1 and 2
    only meet each other, and at once if one of them has few rows; all rows of side 0 meet.
    """
    hub = F.min(F.struct("own", "cls", "size")).alias("hub")
    of = lambda side: F.sum((F.col("side") == side).cast("long"))
    groups = rows.groupBy("key").agg(F.count("*").alias("_n"), of(1).alias("_n1"), of(2).alias("_n2"), hub)
    large = (F.least("_n1", "_n2") > small) | ((F.col("_n1") + F.col("_n2") == 0) & (F.col("_n") > small))
    groups = groups.filter("_n > 1 and (_n1 + _n2 = 0 or _n1 > 0 and _n2 > 0)").select("key", large.alias("_large"), "hub")
    met = common.saved(rows.join(groups, "key"), "met")
    # A hub need not be of the group: the best that any member has met serves all groups of an original's copies.
    big = met.filter("_large").select("key", "cls", "own", "hub")
    best = big.join(big.groupBy("cls").agg(F.min("hub").alias("best")), "cls").groupBy("key").agg(F.min("best").alias("best"))
    members = big.select("key", "cls", "own").join(best.select("key", F.col("best.cls").alias("h_cls")), "key")
    return met.filter("not _large").drop("_large", "hub"), members.filter("cls != h_cls").select("cls", "h_cls", "own").distinct()


def can_link(percent: int) -> Column:
    """Length and position: whether two rows of a group can be the first that a pair that links has in common."""
    total = F.col("size") + F.col("h_size")
    apart = F.floor((100 - percent) * total / (100 + percent))
    most = F.least(F.col("len") - F.col("pos"), F.col("h_len") - F.col("h_pos"))
    return (100 * F.least("size", "h_size") >= percent * F.greatest("size", "h_size")) & (2 * most >= F.col("len") + F.col("h_len") - apart)


def differences(x: np.ndarray, h: np.ndarray, percent: int, linked: bool) -> tuple[np.ndarray, int, list[tuple[int, int]]]:
    """(x ^ h, what h lacks first; its size; prefixes of it as (side, size)) to meet any y that links with x, one of the two not being linked with h.

    The overlap of x ^ h and y ^ h is (|x ^ h| + |y ^ h| - |x ^ y|) / 2. By the triangle inequality that is
    at least |x ^ h| - |x ^ y|; and more than (|x ^ h| + c (|h| - |x|)) / 2 if y is not linked with h. Those not
    linked with the hub meet each other on side 0; on sides 1 and 2 those linked meet those not linked.
    """
    both = np.concatenate((np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)))
    a = len(both)
    any_y = max(1, a - (100 - percent) * (len(x) + 100 * len(x) // percent) // (100 + percent))
    apart = max(any_y, (a * (100 + percent) + (100 - percent) * (len(h) - len(x))) // (2 * (100 + percent)) + 1)
    prefix = lambda least: max(0, a - least + 1)
    return both, a, [(1, prefix(apart))] if linked else [(0, prefix(apart)), (2, prefix(any_y))]


def verify(pairs: DataFrame, some: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) among ``pairs`` (u, v, own, hub), rows for the next round from pairs with hubs); ``some`` has texts of classes."""
    rows = pairs.join(some.select(F.col("cls").alias("u"), F.col("text").alias("a")), "u").join(some.select(F.col("cls").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "own", "hub", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams = Grams(n)
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out = defaultdict(list)

                def put(side: int, keys: np.ndarray, **values: int) -> None:
                    out["key"].append(signed(keys))
                    out["pos"].append(np.arange(len(keys)))
                    out["side"].append(np.full(len(keys), side))
                    for name, value in values.items():
                        out[name].append(np.full(len(keys), value, np.int64))

                for u, v, own, hub, a, b in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns)):
                    if v not in last:
                        last = {v: grams(b)}
                    x, y = grams(a), last[v]
                    linked = reaches(x, y, percent)
                    if linked:
                        put(LINK, x[:1], u=u, v=v, size=len(x), len=0, own=own)
                    if hub:
                        both, size, prefixes = differences(x, y, percent, linked)
                        for side, m in prefixes:
                            # Side 0 has keys of its own.
                            keys = mixed(both[:m] ^ mixed(np.array([v ^ -(side > 0)], np.int64).view(np.uint64)))
                            put(side, keys, u=u, v=v, size=len(x), len=size, own=own)
                if out:
                    yield {name: np.concatenate(parts) for name, parts in out.items()}

    found = common.saved(common.map_batches(rows, run, "key long, pos long, side long, u long, v long, size long, len long, own long"), "verified")
    return found.filter(f"side = {LINK}").select("u", "v"), found.filter(f"side != {LINK}").select("key", F.col("u").alias("cls"), "size", "len", "pos", "own", "side")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold. Suffix filter first: what parts of the hash range can share at most."""
    need = needed(len(x) + len(y), percent)
    if min(len(x), len(y)) < need or not need:
        return False
    edges = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    parts = [np.diff(np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))) for s in (x, y)]
    if np.minimum(*parts).sum() < need:
        return False
    return 2 * len(x) + 2 * len(y) - 2 * len(np.union1d(x, y)) >= 2 * need


def class_texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, text) of the wanted classes, one text each: that of the class's document whose n-grams they are."""
    ids = common.saved(reps.join(wanted, "cls").select(F.col("v").alias("_id"), F.col("cls").alias("_cls")), "wanted")
    rows = docs.join(common.small_or_not(ids), F.col("doc_id") == F.col("_id")).select("_cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams, seen = Grams(n), set()
        for classes, texts in common.by_text(batches):
            # A repeated id may have other texts too.
            kept = [(c, t) for c, t in zip(classes, texts) if name_of(class_of(grams(t))) == c and c not in seen]
            seen.update(c for c, _ in kept)
            yield {"cls": [c for c, _ in kept], "text": [t for _, t in kept]}

    out = common.saved(common.map_batches(rows, run, "cls long, text string"), "class-texts")
    common.discard(ids)
    return out


def links(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(profile of every row, links (u, v) of documents that make up all components)."""
    spark = docs.sparkSession
    rows = common.texts(docs, id_col, text_col)
    # The sample is two to three times as large as a prefix.
    eighths = min(8, max(2, -(-2 * 8 * (100 - percent) // 100)))
    sizes = profile(rows, n, eighths)
    reps = common.saved(sizes.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.first("cls").alias("cls"), F.min("doc_id").alias("v")).select("cls", "v"), "classes")
    first = tokens(sizes, rows, n, percent, eighths)
    common.release(spark)
    met = first.join(first.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "key")
    some = class_texts(rows, reps, met.select("cls").distinct(), n)
    common.release(spark)
    # The same again with what is left, a part of the texts, and all of its n-grams.
    now = tokens(sizes.withColumn("n_sampled", F.col("n_shingles")), some, n, percent, 8)
    common.discard(first)
    common.release(spark)
    found, tried = None, None
    for round_ in range(rounds):
        few, hubs = grouped(now, small if round_ < rounds - 1 else 1 << 62)
        other = few.select("key", *(F.col(c).alias(f"h_{c}") for c in ("cls", "size", "len", "pos", "side")))
        pairs = few.join(other, "key").filter("side = 0 and cls > h_cls or side = 1 and h_side = 2").filter(can_link(percent)).select(F.greatest("cls", "h_cls").alias("u"), F.least("cls", "h_cls").alias("v")).distinct()
        hubs = common.saved(hubs.select(F.col("cls").alias("u"), F.col("h_cls").alias("v"), "own", F.lit(True).alias("hub")), "hubs")
        known = hubs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        tried = known if tried is None else tried.union(known)
        pairs = common.saved(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        every = pairs.select("u", "v", F.lit(0).cast("long").alias("own"), F.lit(False).alias("hub")).union(hubs)
        more, now = verify(every, some, n, percent)
        found = more if found is None else found.union(more)
        common.release(spark)
        if hubs.isEmpty():
            break
    # Documents are tied to the first of their class, and classes that link by their first documents.
    same = sizes.filter("n_shingles > 0 and doc_id is not null").join(reps, "cls").filter("doc_id != v").select(F.col("doc_id").alias("u"), "v")
    first = lambda side: reps.select(F.col("cls").alias(side), F.col("v").alias(f"_{side}"))
    between = found.join(first("u"), "u").join(first("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return sizes, same.union(between)


def joined(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id per row."""
    sizes, found = links(docs, n, percent, id_col=id_col, text_col=text_col)
    comps = components(found).withColumnRenamed("id", "doc_id")
    return sizes.select("doc_id", "n_shingles").join(comps, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

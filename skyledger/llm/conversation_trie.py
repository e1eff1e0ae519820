"""Prefix trie of conversations, merged family by family.

A conversation is rebuilt from its base (the conversation with its id rounded down to a hundred) and its
own turns, so a family of at most a hundred conversations holds all that it needs. Families are
cogrouped by base id: their rows are dealt by it and sorted, and one pass over them rebuilds each
conversation (the base comes first and only its first turns are remembered) and adds it to the family's
small trie. Only the combined nodes of families are shuffled, by a digest of their whole prefix, and
merged with map-side combining, so the root or a common first turn is no hot key.

Sums over subtrees need no pass per depth. Every node has one owner, the family with its smallest
member. What a node adds to its ancestors is put at its owner's node and summed upwards inside that
family's trie, from the last node to the first; the families' sums of a node then add up to its own.

Memory: a family's trie holds at most ``limit`` nodes; later new nodes are sent as they come, which the
merge puts together just as well. A conversation of any length is streamed.

Defined results: a null role or text is empty; equal turns of a conversation are ordered by role, then
text; turns without a conv_id belong to no conversation and are left out; repeated rows are turns of
their own; a conversation whose rebuilt turns are none is a member of the root only; prefixes are told
apart by 128-bit digests; extra columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FAMILY, HEADS = 100, 6
#: Nodes of a family's trie that are combined in memory, rows sent at once, and ids per piece of a digest's text.
LIMIT, SENT, BLOCK = 100_000, 5_000, 100_000
ROOT = bytes(16)
NODES = "family long, idx long, up long, key binary, parent binary, depth long, chars long, n long, first long, ends_from long, ends string"


def heads(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def child(parent: bytes, role: str, text: str) -> bytes:
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(parent + len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()


class Node:
    __slots__ = ("idx", "up", "key", "parent", "depth", "chars", "n", "first", "ends")

    def __init__(self, idx: int, above: Node | None, key: bytes, chars: int, first: int):
        self.idx, self.key, self.chars, self.n, self.first, self.ends = idx, key, chars, 0, first, []
        self.up, self.parent, self.depth = (above.idx, above.key, above.depth + 1) if above else (None, None, 0)


def columns(family: int, nodes: list[Node]) -> dict:
    out = {c: [getattr(x, c) for x in nodes] for c in ("idx", "up", "key", "parent", "depth", "chars", "n", "first")}
    return out | {"family": [family] * len(nodes), "ends_from": [x.ends[0] if x.ends else None for x in nodes], "ends": [",".join(map(str, x.ends)) if x.ends else None for x in nodes]}


def rebuilt(conv_id: int, base: list[tuple[str, str]] | None, turns: Iterator[tuple[str, str]], keep: list | None) -> Iterator[tuple[str, str]]:
    """Turns of a conversation; ``keep`` gets the first ones of a base. ``base`` is None for the base itself, which is rebuilt as it is."""
    h = 0 if base is None else heads(conv_id)
    if base is not None:
        yield from base[:h]
    for k, turn in enumerate(turns):
        if keep is not None and k < HEADS - 1:
            keep.append(turn)
        if k >= h:
            yield turn


def family_nodes(rows: Iterator[tuple[int, int, str, str]], limit: int) -> Iterator[dict]:
    """Combined nodes of each family from rows (family, conv_id, role, text) in order. A node's number is above its parent's."""
    for family, mine in groupby(rows, lambda r: r[0]):
        base: list[tuple[str, str]] = []
        trie: dict[bytes, Node] = {}
        loose: list[Node] = []
        root, size = None, 1
        for conv_id, own in groupby(mine, lambda r: r[1]):
            is_base = conv_id == family
            node = root = root or Node(0, None, ROOT, 0, conv_id)
            root.n += 1
            sent = False
            for role, text in rebuilt(conv_id, None if is_base else base, ((r, t) for _, _, r, t in own), base if is_base else None):
                if sent:
                    loose.append(node)
                    if len(loose) >= SENT:
                        yield columns(family, loose)
                        loose = []
                key = child(node.key, role, text)
                after = trie.get(key)
                sent = after is None and len(trie) >= limit
                if after is None:
                    after = Node(size, node, key, len(text), conv_id)
                    size += 1
                    if not sent:
                        trie[key] = after
                after.n += 1
                node = after
            node.ends.append(conv_id)
            if sent:
                loose.append(node)
        every = [root, *trie.values(), *loose]
        for k in range(0, len(every), SENT):
            yield columns(family, every[k : k + SENT])


def families(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The combined nodes of all families."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.col("conv_id").cast("long")
    rows = conversations.filter(own.isNotNull()).select((own - F.pmod(own, F.lit(FAMILY))).alias("family"), own.alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.repartition("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        each = (row for b in batches for k in range(0, b.num_rows, 1000) for row in zip(*(c.to_pylist() for c in b.slice(k, 1000).columns)))
        yield from family_nodes(each, limit)

    return common.map_batches(rows, run, NODES)


def climbed(rows: DataFrame) -> DataFrame:
    """(key, saved, leaves): sums of what stands at the nodes of each family's trie, over subtrees. ``rows`` has nodes (with ``key`` and ``up``) and amounts at them."""
    rows = rows.repartition("family").sortWithinPartitions("family", F.desc("idx"), F.col("key").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        family, above = None, {}
        for b in batches:
            out = {"key": [], "saved": [], "leaves": []}
            for of, idx, up, key, saved, leaves in zip(*(c.to_pylist() for c in b.columns)):
                if of != family:
                    family, above = of, {}
                if key is None:  # amounts come before the node they stand at
                    x = above.get(idx, (0, 0))
                    above[idx] = (x[0] + saved, x[1] + leaves)
                    continue
                sums = above.pop(idx, (0, 0))
                if any(sums):
                    if up is not None:
                        x = above.get(up, (0, 0))
                        above[up] = (x[0] + sums[0], x[1] + sums[1])
                    for name, value in zip(out, (key, *sums)):
                        out[name].append(value)
            yield out

    return common.map_batches(rows, run, "key binary, saved long, leaves long")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): digests of the ids that end at a node, in order. They are joined in pieces of at most ``BLOCK`` ids; the pieces of a node are streamed."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ends_from", "ends"))), lambda x: x["ends"]), ",")
    rows = ends.groupBy("key", F.floor(F.col("ends_from") / BLOCK).alias("block")).agg(piece.alias("ids"))
    rows = rows.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = (row for b in batches for k in range(0, b.num_rows, 100) for row in zip(*(c.to_pylist() for c in b.slice(k, 100).columns)))
        keys, shas = [], []
        for key, some in groupby(pieces, lambda r: r[0]):
            h = hashlib.sha256()
            for k, (_, ids) in enumerate(some):
                h.update(b"," * (k > 0) + ids.encode())
            keys.append(key)
            shas.append(h.hexdigest())
            if len(keys) >= SENT:
                yield {"key": keys, "ends_sha256": shas}
                keys, shas = [], []
        yield {"key": keys, "ends_sha256": shas}

    return common.map_batches(rows, run, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the global trie."""
    parts = common.saved(families(conversations, limit), "families")
    owner = F.min(F.struct("first", "family", "idx")).alias("owner")
    nodes = common.saved(parts.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("n").alias("n_convs"), owner), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = common.saved(nodes.join(children, "key", "left").select("*", "owner.*").drop("owner").fillna(0, ["n_children"]), "merged")
    zero = F.lit(0).cast("long")
    amounts = nodes.select("family", "idx", F.lit(None).cast("long").alias("up"), F.lit(None).cast("binary").alias("key"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    sums = climbed(parts.select("family", "idx", "up", "key", zero.alias("saved"), zero.alias("leaves")).union(amounts)).groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = end_digests(parts.filter("ends_from is not null").select("key", "ends_from", "ends"))
    # The root, a row at most, is told to its children; the other parents are joined.
    root = F.broadcast(nodes.filter("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("first").alias("_root")))
    above = nodes.filter("depth > 0 and n_children > 0").select(F.col("key").alias("parent"), F.col("first").alias("_above"))
    out = nodes.join(sums, "key", "left").join(ends, "key", "left").join(above, "parent", "left").join(root, "depth", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("first").alias("conv_id"), "depth", F.coalesce("_root", "_above").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )

"""Packing of tokenised documents into fixed-length training sequences.

Shortest-pack-first over the length histogram: documents are cut at multiples of the sequence
length, the lengths of the pieces are counted, and only that histogram (at most ``max_len`` rows)
reaches the driver. Lengths are placed longest first, each into the packs with the most room, which
updates counts of packing patterns instead of single packs. Patterns are joined back to pieces by
the rank that a piece has among those of its length.

Defined results: a null text is empty, an empty text is the end token alone, repeated rows are
packed as often as they occur, a null id stays null, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ranks of one salted group are computed in one task; a group holds about this many pieces.
GROUP_ROWS = 200_000
#: Texts beyond this many characters are encoded in parts.
PART_CHARS = 1 << 16
#: Its id follows those of the words; it has no space, so that ``parts`` never cuts it.
SPECIAL = "<|endoftext|>"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters whose tokens are those of the whole.

    The byte-level pattern always starts a new word at a space between two non-spaces.
    """
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(vocabulary: str):
    """text -> ids in an array or a list, by a file of ``public_tokenizers``: ``.json`` by tokenizers, ``.tiktoken`` (the same ids, faster) by tiktoken.

    The special token is read where a text holds it, as tokenizers does; none is added.
    """
    import public_tokenizers

    path = common.local_path("public_tokenizers", vocabulary)
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: enc.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", max_len: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids as little-endian uint32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(vocabulary)
        for ids, texts in common.by_text(batches):
            out = defaultdict(list)
            for doc, text in zip(ids, texts):
                raw = b"".join(np.asarray(x, dtype="<u4").tobytes() for x in (*map(encode, parts(text)), [end_id]))
                for s in range(0, len(raw) // 4, max_len):
                    piece = raw[4 * s : 4 * (s + max_len)]
                    out["doc_id"].append(doc)
                    out["start"].append(s)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(raw) // 4)
                    if with_ids:
                        out["ids"].append(piece)
            if out:
                yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return common.map_batches(common.texts(docs, id_col, text_col), cut, schema)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in a pack) of every pattern; longest lengths first, each to the packs with most room.

    At most two patterns per length arise beyond those that end, so there are at most a few times ``max_len``.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by the room left
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        room = max_len
        while left:
            while room >= length and not open_.get(room):
                room -= 1
            if room < length:
                each = max_len // length
                full, rest = divmod(left, each)
                if full:
                    open_[max_len - each * length].append((full, (length,) * each))
                if rest:
                    open_[max_len - rest * length].append((1, (length,) * rest))
                break
            n, pack = open_[room].pop()
            used = min(n, left)
            if n > used:
                open_[room].append((n - used, pack))
            open_[room - length].append((used, (*pack, length)))
            left -= used
    return [x for room in sorted(open_) for x in open_[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset). Consecutive ranks fill one place of consecutive sequences."""
    rows, taken, seq = defaultdict(list), defaultdict(int), 0
    for n, lengths in patterns:
        at = 0
        for length in lengths:
            rows[length].append((taken[length], seq, at))
            taken[length] += n
            at += length
        seq += n
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(found: DataFrame, max_len: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``found`` (of ``pieces``) with sequence_id and offset. It is read more than once: pass a saved table."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, max_len)))
    salts = F.lit([1 + histogram.get(k, 0) // group_rows for k in range(max_len + 1)])
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.element_at(salts, F.col("length").cast("int") + 1)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for k in np.unique(lengths):
            rows, own = table.value[int(k)], np.flatnonzero(lengths == k)
            at = np.searchsorted(rows[:, 0], ranks[own], side="right") - 1
            seq[own] = rows[at, 1] + ranks[own] - rows[at, 0]
            off[own] = rows[at, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_place", place("length", "_rank")).select(*found.columns, "_place.sequence_id", "_place.offset")


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", max_len: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs ``docs``; one row per piece."""
    return pack(common.saved(pieces(docs, vocabulary, max_len, end_id, with_ids, id_col, text_col), "pieces"), max_len)


def sequences(placed: DataFrame, max_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """The training sequences themselves (sequence_id, n_tokens, ids): those of ``packed(..., with_ids=True)``, padded."""

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("offset")["ids"]), dtype="<u4").astype(np.int64)
        whole = np.concatenate([ids, np.full(max_len - len(ids), pad_id, np.int64)])
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [len(ids)], "ids": [whole]})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(fill, "sequence_id long, n_tokens long, ids array<long>")

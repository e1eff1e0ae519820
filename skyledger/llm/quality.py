"""Quality rules: counts inside a document, and line frequency across the documents of a host.

Lines are normalised (case, digits, white space) and hashed; for each host the distinct documents
with a line are counted. Lines of more documents than the limit are boilerplate and removed; a
document of which too little is left is rejected.

Defined results: a null or empty text has no words and fails; null hosts and empty ones form one host;
every row is judged by its own text, but rows with equal ids are one document to the count of a line, so
a repeated document doesn't make its lines boilerplate, and rows with null ids are one each; texts of any
length are read whole; a line that as many documents as the limit have stays; extra columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_DIGITS = re.compile(r"[0-9]+")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    k = len(seen)
    _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(n, dtype=bool)
    for j in range(3):
        covered[j : n - 2 + j] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def normal_lines(text: str) -> dict[int, int]:
    """Hash -> characters of all such lines, for the distinct normalised lines with a word."""
    out: dict[int, int] = defaultdict(int)
    for line in text.split("\n"):
        if line.strip(SPACE):
            norm = _DIGITS.sub("0", " ".join(line.lower().split()))
            out[xxhash.xxh3_64_intdigest(norm) - (1 << 63)] += len(line)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, host, the counts, and the distinct lines as parallel arrays of hashes and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out = defaultdict(list)
                for doc, host, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.encode().split()
                    lines = normal_lines(text)
                    for name, value in (
                        ("doc_id", doc), ("host", host), ("n_words", len(words)), ("word_chars", len(text) - sum(map(text.count, SPACE))), ("n_symbols", sum(map(text.count, SYMBOLS))),
                        ("n_dup_lines", duplicate_lines(text)), ("n_repeat_words", repeated(words)), ("lines", list(lines)), ("chars", list(lines.values())),
                    ):
                        out[name].append(value)
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return common.map_batches(rows, run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, chars array<long>")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = 20, keep_share: float = 0.5, least_words: int = 50) -> DataFrame:
    """Statistics and verdict per row.

    A line is boilerplate on a host when more than ``least_docs`` of its documents have it, however
    large the host is. A document is rejected when its lines left hold less than
    ``keep_share`` of its characters, when it has fewer than ``least_words`` words, or when more than
    half of its words repeat.
    """
    stats = common.saved(statistics(docs, id_col, text_col, host_col).withColumn("_row", F.monotonically_increasing_id()), "quality")
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("_row"))).alias("_document")
    lines = stats.select("_row", "host", document, F.explode(F.arrays_zip("lines", "chars")).alias("l")).select("_row", "host", "_document", F.col("l.lines").alias("_line"), F.col("l.chars").alias("_chars"))
    often = common.saved(lines.groupBy("host", "_line").agg(F.count_distinct("_document").alias("_n")).filter(F.col("_n") > least_docs).select("host", "_line"), "boilerplate")
    # All rows of a frequent line would meet in one task of a shuffled join.
    removed = lines.join(common.small_or_not(often), ["host", "_line"]).groupBy("_row").agg(F.sum("_chars").alias("_removed"), F.count("*").alias("n_boilerplate_lines"))
    total = F.coalesce(F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = total - F.coalesce("_removed", F.lit(0))
    return (
        stats.join(removed, "_row", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= keep_share * total))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("n_boilerplate_lines", F.lit(0)).cast("long").alias("n_boilerplate_lines"))
    )

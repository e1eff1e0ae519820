"""Toxicity by a weighted lexicon.

The lexicon (words and word beginnings, with their log odds) is learned from labelled documents. It
is matched with an Aho-Corasick automaton in a folded copy of the text, where homoglyphs are Latin
letters and digits and signs that stand for letters are those letters. Matches inside an exception
phrase don't count. The sum of weights, set against the length of the text, goes through a logistic
curve fitted on the same labelled documents.

Only the fit uses a bounded sample: at most ``train_rows`` labelled rows, those with the smallest
hashes. Counts of lexicon entries and scores come from whole texts.

Defined results: a null or empty text has no matches and gets the score of such a text; without
labelled rows of both classes every score is 0; null ids stay null; repeated rows get equal scores.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .pii import HOMOGLYPHS, INVISIBLE

#: The bound of the labelled sample.
TRAIN_ROWS = 12_000
# Digits and signs that stand for letters, and phrases in which a listed word means no harm.
LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "trash bag", "sore loser", "loser bracket", "pond scum", "scum line", "stupid simple", "idiot proof", "pathetic fallacy", "killer whale", "kill switch")

_FOLD = {ord(a): b.lower() for a, b in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE} | {ord(a): b for a, b in LETTERS.items()} | {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in LETTERS}
_OTHER = re.compile(r"[^\w ]")
# What ``fold`` makes of the characters below U+0100, and those of them that go: bytes are translated many times faster than strings.
_LATIN = [_OTHER.sub(" ", chr(c).translate(_FOLD)) for c in range(256)]
_BYTES, _GONE = "".join(x or " " for x in _LATIN).encode("latin-1"), bytes(c for c, x in enumerate(_LATIN) if not x)


def fold(text: str) -> str:
    """The text with a space at either end, in lower case, with only word characters and spaces."""
    low = text.lower()
    try:
        return f" {low.encode('latin-1').translate(_BYTES, _GONE).decode('latin-1')} "
    except UnicodeEncodeError:
        low = low.translate(_FOLD)
    return f" {low if low.isascii() else _OTHER.sub(' ', low)} "


def entries(word: str, shortest: int = 4, longest: int = 8) -> Iterator[str]:
    """Lexicon entries a word can match: itself between spaces, and its beginnings after one."""
    if len(word) > 2:
        yield f" {word} "
    for n in range(shortest, min(longest, len(word)) + 1):
        yield f" {word[:n]}"


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w))
        for x in self.exceptions:
            a.add_word(f" {x} ", (len(x) + 2, None))
        a.make_automaton()
        return a

    def features(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        """Log of the weight per 100 words, and log of the weight."""
        low = fold(text)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(low) if len(automaton) else ():
            s = end - n + 1
            if w is None:
                spared.append((s, end))
            else:
                hits[s] = max(w, hits.get(s, 0.0))
        spared.sort()
        starts, reach = [a for a, _ in spared], list(itertools.accumulate((b - 1 for _, b in spared), max))
        # A hit is spared if an exception that starts at it or before reaches it.
        inside = lambda s: (k := bisect.bisect_right(starts, s)) > 0 and reach[k - 1] >= s
        total = sum(w for s, w in hits.items() if not inside(s))
        return math.log1p(100 * total / max(1, low.count(" "))), math.log1p(total)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        c, a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(c + x @ np.array([a, b]), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Newton's method with a small ridge."""
    m = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(m.shape[1])
    pen = ridge * np.eye(len(w))
    pen[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + pen, m.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic) of at most ``train_rows`` labelled rows that aren't held out, near copies mostly once."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("_id")).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")

    @F.pandas_udf("long")
    def smallest(text: pd.Series) -> pd.Series:
        def one(t: str) -> int:
            w = t.split()
            return min((xxhash.xxh3_64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))), default=0) - (1 << 63)

        return text.map(one)

    return common.saved(rows.withColumn("_like", smallest("text")).dropDuplicates(["_like", "toxic"]).select("text", "toxic"), "toxic-sample")


def _counted(rows: DataFrame, among: set[str] | None) -> DataFrame:
    """(entry, n): documents with each lexicon entry; partial counts leave a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n: Counter = Counter()
        for (texts,) in ([b.column(0).to_pylist()] for b in batches):
            for t in texts:
                found = {e for w in set(fold(t).split()) for e in entries(w)}
                n.update(found if among is None else found & among)
        yield {"entry": list(n), "n": list(n.values())}

    return common.map_batches(rows.select("text"), run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least_docs: int = 6, least_odds: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and curve from the labelled sample. Entries are those of ``least_docs`` toxic documents at least, at most a few thousand."""
    rows = sample(docs, labels, train_rows, id_col, text_col)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model()
    if not sizes.get(1) or not sizes.get(0):
        return model
    least = max(2, min(least_docs, sizes[1] // 10))
    toxic = {r["entry"]: r["n"] for r in _counted(rows.filter("toxic = 1"), None).filter(F.col("n") >= least).collect()}
    clean = {r["entry"]: r["n"] for r in _counted(rows.filter("toxic = 0"), set(toxic)).collect()}
    odds = {e: math.log((n + 0.5) / (sizes[1] + 1)) - math.log((clean.get(e, 0) + 0.5) / (sizes[0] + 1)) for e, n in toxic.items()}
    for e in sorted((e for e, o in odds.items() if o >= least_odds and toxic[e] >= 4 * clean.get(e, 0)), key=lambda e: (len(e), e)):
        # A longer entry is of use only if it is clearer than a beginning that is listed.
        known = [model.weights[e[:n]] for n in range(4, len(e)) if e[:n] in model.weights]
        if not known or odds[e] > max(known) + 0.5:
            model.weights[e] = odds[e]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        auto = model.automaton()
        for b in batches:
            f = [model.features(t, auto) for t in b.column(0).to_pylist()]
            yield {"a": [x[0] for x in f], "b": [x[1] for x in f], "y": b.column(1).to_pylist()}

    got = np.array([tuple(r) for r in common.map_batches(rows.select("text", "toxic"), run, "a double, b double, y int").collect()])
    model.curve = logistic(got[:, :2], got[:, 2])
    return model


def score(model: Model, text_col: str = "text") -> Column:
    """Score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = model.automaton()
        for texts in parts:
            yield pd.Series(model.score(np.array([model.features(t or "", auto) for t in texts]).reshape(-1, 2)))

    return run(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).withColumn("score", score(model, "_text"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

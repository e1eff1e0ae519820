"""Every stage of the pipeline, and all of it, against brute force on a small corpus with odd rows; the scorer of toxicity against plain search."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import common, packing, secrets, toxicity

from .test_contracts import ODD, leaks_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _base string, _spans int, _marked int, _score double, row string"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    """A folder of documents (with clashing columns, null ids, repeated rows and ids, a long text), labels and benchmark."""
    docs = [tuple(r) for r in common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).collect()]
    top = max(r[0] for r in docs) + 1
    item = common.read(spark, sf_dir, "benchmark").first()["text"]
    docs += [(top + k, x, None, "odd", None) for k, x in enumerate(ODD)]
    far = " ".join(f"v{k}" for k in range(40))
    docs += [(top + 100, far, None, None, 1), (top + 100, far, None, None, 1), (top + 101, far + " z", "en", None, 1), (top + 102, "one text", None, None, 1), (top + 102, "another text", None, None, 1)]
    docs += [(None, far, None, None, None), (None, item, None, None, 3), (None, None, None, None, None), (top + 103, "pre " + item, None, None, 5), (top + 104, " ".join(f"q{k}" for k in range(150_000)), None, None, 9)]
    at = common.scratch(spark, "pipeline-test")
    spark.createDataFrame([(*r, "b", 1, 2, 0.9, "r") for r in docs], COLUMNS).repartition(4).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        common.read(spark, sf_dir, name).write.parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def near_copies_left(rows, n=5, percent=80):
    """Rows that stay: ids that aren't the smallest of their group go, and equal texts of an id that stays count once."""
    sets = defaultdict(list)
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
        if r[0] is not None:
            sets[r[0]].append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if b < a and any(x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in sets:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    left, seen = Counter(), set()
    for r, times in rows.items():
        if r[0] is None:
            left[r] += times
        elif root[r[0]] == r[0] and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            left[r] += 1
    return left


def test_stages(spark, tables):
    docs = common.read(spark, tables, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = rows_of(docs)
    model = toxicity.fit(docs, common.read(spark, tables, "labels"))
    auto = model.automaton()
    toxic = {t: float(model.score([model.features(t or "", auto)])[0]) for t in {r[1] for r in rows}}
    got = common.saved(stages["toxicity"](spark, docs, tables), "a")
    want = Counter({r: n for r, n in rows.items() if toxic[r[1]] < 0.5})
    assert got.columns == docs.columns and rows_of(got) == want and 0 < len(want) < len(rows)

    kept = common.saved(stages["ngram_join"](spark, got, tables), "b")
    left = near_copies_left(want)
    assert kept.columns == docs.columns and rows_of(kept) == left and sum(left.values()) < sum(want.values())

    free = common.saved(stages["decontamination"](spark, kept, tables), "c")
    items = [(r["item_id"], r["text"]) for r in common.read(spark, tables, "benchmark").collect()]
    leaked = {r[0] for r in left if r[0] is not None and leaks_of([(r[0], r[1])], items)}
    want = Counter({r: n for r, n in left.items() if r[0] not in leaked})
    assert free.columns == docs.columns and rows_of(free) == want and leaked

    masked = common.saved(stages["secret_scan"](spark, free, tables), "d")
    numbered = list(enumerate(sorted({r[1] for r in want}, key=str)))
    scan = secrets.scan(spark.createDataFrame(numbered, "doc_id long, text string"), secrets.train(secrets.labelled_samples(spark)))
    spans = {numbered[r["doc_id"]][1]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in scan.collect()}
    out = Counter()
    for r, times in want.items():
        text, at = "", 0
        for s, e in spans[r[1]]:
            if s >= at:
                text += r[1][at:s] + secrets.MASK
            at = max(at, e)
        text = None if r[1] is None else text + r[1][at:]
        out[(r[0], text, r[2], r[3], None if text is None else len(text), *r[5:])] += times
    assert masked.columns == docs.columns and rows_of(masked) == out and any(spans.values())

    pieces = stages["packing"](spark, masked, tables).collect()
    whole = rows_of(packing.pieces(masked).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == whole
    run = corpus_pipeline.run(spark, tables)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in run.collect()) == whole


def test_empty_tables(spark, tables):
    at = common.scratch(spark, "pipeline-empty")
    for name in ("documents", "labels", "benchmark"):
        common.read(spark, tables, name).limit(0).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_toxicity_scores_are_those_of_plain_search(spark, sf_dir):
    docs, labels = common.read(spark, "/root/testdata/sf0.01", "documents"), common.read(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(docs, labels)
    word = max(model.weights, key=model.weights.get).strip()
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(200).collect()] + ODD + [f"clown fish {word} trash can kill switch", f"{word.upper()} " * 3000 + "clown fish " * 3000, word.replace("o", "0").replace("i", "1")]
    df = spark.createDataFrame([(k, t, 1.0, "x") for k, t in enumerate(texts)], "doc_id long, text string, score double, _text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    c, a, b = model.curve
    for k, t in enumerate(texts):
        low = toxicity.fold(t or "")
        find = lambda x: [m.start() for m in re.finditer(f"(?={re.escape(x)})", low)]  # noqa: E731, B023
        spared = {s + j for x in model.exceptions for s in find(f" {x} ") for j in range(len(x) + 1)}
        best = {}
        for x, w in model.weights.items():
            for s in find(x):
                best[s] = max(w, best.get(s, 0.0))
        total = sum(w for s, w in best.items() if s not in spared)
        z = c + a * math.log1p(100 * total / max(1, low.count(" "))) + b * math.log1p(total)
        assert math.isclose(got[k], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9), t
    assert toxicity.scored(df.limit(0), model).count() == 0

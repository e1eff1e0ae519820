"""SimHash near-duplicates, the filter audit and the conversation trie against plain brute-force versions."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations, permutations

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from skyledger.llm import conversation_trie, filter_audit, license, quality, queries, simhash, warc

TABLES = "documents labels conversations".split()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(items, linked):
    """Item number -> smallest item number reachable, by plain search over all pairs."""
    near = defaultdict(list)
    for a, b in combinations(range(len(items)), 2):
        if linked(items[a], items[b]):
            near[a].append(b)
            near[b].append(a)
    out = {}
    for k in range(len(items)):
        todo = [] if k in out else [k]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo += near[x]
    return out


TEXTS = [None, "", "\x1c", " \n", "one", "One", "two words", "A b C", "a B c", "a b c d", "İi ÀÀ Σ ß", "x " * 5000, "ab\x00cd ef\x0bgh ij", "w1 w2 w3 w4 " * 30, "😀 日本 語 テ"]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = TEXTS + [" ".join(w if rng.random() > 0.02 else "edit" for w in base) for _ in range(60)] + [" ".join(base)] * 5
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, least string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.deduplicated(df).collect()}
    want = [plain_fingerprint(t) for t in texts]
    comp = groups(want, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got == {k: (f"{want[k]:016x}", comp[k]) for k in range(len(texts))}


@pytest.mark.parametrize("limit", [2, 5, 1000])
def test_simhash_dense_cloud_and_every_length_of_list(spark, limit):
    """A cloud in few bits, far clouds, and random fingerprints; links of long lists come by stars, of short ones by pairs."""
    rng = random.Random(limit)
    cloud = lambda center, bits, n: [center ^ sum(1 << b for b in bits if rng.random() < 0.5) for _ in range(n)]
    some = [rng.getrandbits(64) for _ in range(40)]
    fps = set(some) | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in some}
    fps |= set(cloud(0, [63, 1, 8, 9, 17], 20)) | set(cloud(1 << 40, range(30, 39), 60)) | set(cloud(rng.getrandbits(64), [rng.randrange(64) for _ in range(14)], 80)) | {0, (1 << 64) - 1, 0b1111, 0b11111 << 20}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = {tuple(r) for r in simhash.near(spark.createDataFrame([(f,) for f in signed], "fp long"), limit=limit).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    at = {f: k for k, f in enumerate(signed)}
    found = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    assert groups(range(len(fps)), lambda a, b: (a, b) in found) == groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (3, "a b c d"), (3, "other words in here"), (3, "other words in here"), (None, "nobody else says that"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.deduplicated(df).collect()), key=str)
    assert got == sorted([(None, 3), (7, 3), (3, 3), (3, 3), (3, 3), (None, None), (5, 5)], key=str)
    assert simhash.deduplicated(df.limit(0)).count() == 0
    assert simhash.fingerprint("a b c " * 60_000) == simhash.fingerprint("a b c " * 60_000 + " \n")


def test_simhash_pieces(monkeypatch):
    text = " ".join(str(k * k % 977) for k in range(2000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == want == (f if (f := plain_fingerprint(text)) < 1 << 63 else f - (1 << 64))


def plain_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    cells = defaultdict(list)
    for d, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), d is not None and first[text] < d]
        cells[lang or ""].append((d, {"ABCDE"[k] for k in range(5) if fails[k]}))
    out = []
    for part, docs in cells.items():
        shapley = defaultdict(int)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [(d, m) for d, m in docs if f in m and not m & set(order[:k])]
                shapley[f] += len(here)
                steps.append((part, order, k + 1, sum(not m & set(order[: k + 1]) for _, m in docs), len(here), sum(f in m and bool(m & set(order[:k])) for _, m in docs), sum(m == {f} for _, m in docs), sum(d in good for d, _ in here), sum(d in toxic for d, _ in here)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit_against_plain_orders(spark):
    rng = random.Random(1)
    many = lambda n, m: " ".join(f"word{rng.randrange(m)}" for _ in range(n))
    texts = [None, "", " ", "ABC", "a b c $", many(300, 1000), many(300, 20), many(199, 5000), many(200, 5000), many(400, 3), "Ä" * 300 + "ABC", "A" * 20 + many(250, 9000) + " | x", "x\ty\x0bz\x1cw", many(50_000, 40_000)]
    rows = [(k % 37, rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(150)] + [(None, texts[5], "en"), (None, texts[5], None), (200, texts[3], "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 40, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, mask int, step string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filter_audit.audit(docs, marks).collect()) == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        childless = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(key))
        out.append((
            convs[0], len(key), members[key[:-1]][0] if key else None, len(convs), sum(len(k) == len(key) + 1 for k in below), sum(map(childless, below)),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(9)
    say = lambda: rng.choice(["hi", "hello there", "ünïcödé", "", None])
    rows = []
    for c in [*range(0, 8), 99, 100, 101, *range(203, 230), 1000, *range(1001, 1012)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), say()))
    rows += [(c, t, "user", "the very same") for c in range(3000, 3050) for t in range(4)]
    rows += [(4000, t, "user", f"turn {t}") for t in range(300)] + [(4001, t, "user", f"turn {t}") for t in range(290)]
    return rows + [(None, 1, "user", "nobody"), (5000, 1, "x", "twice"), (5000, 1, "x", "twice"), (5000, 1, "w", "twice")]


@pytest.mark.parametrize("limit", [100_000, 7, 0])
def test_conversation_trie_against_plain_prefixes(spark, limit):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, family int, key string").repartition(3)
    assert sorted((tuple(r) for r in conversation_trie.trie(df, limit).collect()), key=str) == plain_trie(rows)


def test_conversation_trie_sends_pieces_and_ends_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 13)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in conversation_trie.trie(df).collect()), key=str) == plain_trie(rows)
    sent = list(conversation_trie.family_nodes(((0, c, "u", str(t)) for c in range(3) for t in range(12_000)), 5))
    assert max(len(x["idx"]) for x in sent) <= conversation_trie.SENT and sum(map(sum, (x["n"] for x in sent))) == 3 * 12_001
    assert conversation_trie.trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_conversation_trie"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    res = con.execute(queries.ORACLE_SQL[name])
    assert df.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(res.fetchall(), key=str)


def record(page, block=b"x" * 20):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (page, len(block), block)


@pytest.mark.parametrize("size", [64, 500, 1 << 20])
def test_warc_members_of_several_records_stored_archives_and_empty_files(spark, tmp_path, size):
    rng = random.Random(2)
    inner = b"".join(gzip.compress(record(900 + k, rng.randbytes(200))) for k in range(3))
    stored = gzip.compress(record(2, inner), compresslevel=0)
    files = {"several": gzip.compress(record(1) + record(11, b"WARC/1.0 no record") + record(12, b"")) + gzip.compress(record(3)), "nested": gzip.compress(record(4)) + stored + gzip.compress(record(5)), "empty": b""}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    table = spark.createDataFrame([(f"file://{tmp_path}/{k}", len(v)) for k, v in files.items()], "file string, bytes long")
    assert sorted(r["page_id"] for r in warc.scan(table, split_bytes=size).collect()) == [1, 2, 3, 4, 5, 11, 12]
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.scan(table, size, with_payload=True).collect()}[2] == inner
    assert warc.scan(table.filter("bytes = 0")).count() == 0


def test_quality_counts_documents_not_rows(spark):
    line = " ".join(f"word{k}" for k in range(60))
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k)) + "x"  # noqa: E731  (digits are alike to lines)
    text = line + "\n" + line.replace("word", "other")
    rows = [(1, text, "h")] * 25 + [(k, line.replace("word", letters(k)) + "\nfooter of the site", "h") for k in range(100, 130)] + [(None, text, None)] * 30 + [(7, None, "h"), (8, "", None)] + [(200 + k, line.replace("word", letters(k)) + "\nlimit line", "g") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_words": F.lit("x"), "lines": F.lit(1)})
    got = defaultdict(set)
    for r in quality.judge(df).collect():
        got[r["doc_id"]].add((r["kept"], r["n_boilerplate_lines"]))
    assert got[1] == {(True, 0)} and got[7] == got[8] == {(False, 0)} and got[110] == {(True, 1)} and got[205] == {(True, 0)}
    # Thirty rows without an id are thirty documents.
    assert got[None] == {(False, 2)}
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.judge(spark.createDataFrame([(1, "a b c d e f g h " * 200_000, "h")], "doc_id long, text string, source string")).first()["kept"] is False


def test_license_labels_go_by_row(spark):
    rows = [(5, "Released under the MIT License"), (5, "nothing at all here"), (None, "Released under the MIT License"), (None, None), (6, "word " * 50_000 + "released under the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "labels": F.lit("x")})
    got = sorted(((r["doc_id"], r["n_words"], r["labels"], r["score"]) for r in license.scan(df).collect()), key=str)
    assert got == sorted([(5, 5, "mit", 1.0), (5, 4, "", 0.0), (None, 5, "mit", 1.0), (None, 0, "", 0.0), (6, 50_005, "mit", 1.0)], key=str)

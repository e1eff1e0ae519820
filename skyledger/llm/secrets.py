"""Secrets in texts, by patterns and by two character Markov models; Spark expressions only.

The models give the probability of a character after the one before it, one for random strings and
one for ordinary identifiers, both counted from labelled samples. A token of 16 characters or more
with a letter is a secret when its mean log-likelihood ratio is above a threshold, which rises as
tokens shorten below 20 characters. Spans are code points,
end exclusive.

Defined results: a null or empty text has no spans; null ids stay null; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Tokens that the models judge: 16 characters or more, with a letter.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
RUN = r"[A-Za-z0-9+/_-]{16}"
#: Texts up to this size are cut at spaces to look for runs.
PIECES_BYTES = 4 << 20
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
MASK = "[SECRET]"


def no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")


# Words of which identifiers are made.
WORDS = (
    "account action address admin agent alert amount array asset audit base batch block branch buffer build button bytes cache call case change channel chart check class client cluster code column command config connection content context control count create current "
    "data date default delete detail device display document domain driver element email enable encoder engine entity entry error event example export factory feature field file filter first format frame function group handler header height history image import index info input "
    "instance invoice item key label language last layer layout length level limit line list loader local location logger manager map message method mode model module name network node number object offset option order output owner page param parent parser partition patch path "
    "payment plan point policy port position prefix price process profile project provider queue quota range rate reader record region release remote report request resource response result retry role root route rule sample schema score screen script search section segment server"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, secret): ``n`` random strings in several alphabets and ``n`` ordinary identifiers, the same in every run."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 512)
    base64 = F.base64(F.unhex(digest))
    kind = F.col("id") % 3
    random = spark.range(n).select(F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.substring(F.regexp_replace(base64, "[^A-Za-z0-9+/]", ""), 1, 40)).otherwise(F.substring(F.regexp_replace(base64, "[^A-Za-z0-9]", ""), 1, 32)).alias("text"), F.lit(True).alias("secret"))
    words = F.array(*map(F.lit, WORDS))
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(WORDS))).cast("int"))
    parts = [pick(k) for k in range(4)]
    capital = [F.initcap(p) for p in parts]
    number = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(2100)).cast("string")
    style = F.col("id") % 6
    ordinary = spark.range(n).select(
        F.when(style == 0, F.concat(parts[0], *capital[1:], number)).when(style == 1, F.concat_ws("_", *parts, number)).when(style == 2, F.concat_ws("-", *parts, number)).when(style == 3, F.concat_ws("/", *parts[:3], F.concat(parts[3], number))).when(style == 4, F.upper(F.concat_ws("_", *parts[:3], number))).otherwise(F.concat(*capital, F.lit("v"), number)).alias("text"),
        F.lit(False).alias("secret"),
    )
    return random.union(ordinary)


def train(samples: DataFrame, weight: float = 0.5) -> list[float]:
    """Log ratios of transition probabilities, by ``len(ALPHABET) * code before + code``; add-``weight`` smoothing.

    What comes to the driver is the table of counts, at most two for each pair of characters.
    """
    k = len(ALPHABET)
    chars = samples.filter("text is not null and secret is not null").select("secret", F.split("text", "").alias("c"))
    pairs = chars.select("secret", F.explode(F.expr("transform(sequence(1, greatest(size(c) - 1, 1)), i -> named_struct('a', c[i - 1], 'b', c[i]))")).alias("p")).select("secret", "p.a", "p.b")
    counts = [[weight] * (k * k) for _ in range(2)]
    for r in pairs.filter("length(a) = 1 and length(b) = 1").groupBy("secret", "a", "b").agg(F.count("*").alias("n")).filter(F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).collect():
        counts[r["secret"]][k * ALPHABET.index(r["a"]) + ALPHABET.index(r["b"])] += r["n"]
    totals = [[sum(c[k * a : k * a + k]) for a in range(k)] for c in counts]
    return [math.log(counts[1][i] / totals[1][i // k]) - math.log(counts[0][i] / totals[0][i // k]) for i in range(k * k)]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row: the variable of a lambda holds it, where the optimizer would copy a plain column to every place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(values: Column, block: int = 512) -> Column:
    """Sums before each element; in blocks, as building an array by appending takes time with the square of its length."""
    zero = F.lit(0).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda a, v: a + v)

    def running(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, first, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])

    def in_blocks(values: Column) -> Column:
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(block))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(values, s, F.lit(block)))

    return once(once(values, in_blocks), lambda blocks: F.flatten(F.zip_with(blocks, running(F.transform(blocks, total), zero), running)))


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """array<struct<start, rank, end, kind>> of all matches; ``keep`` judges the given group of each.

    Places are looked for only in texts of which a match is kept.
    """

    def placed(found: Column, kept: Column) -> Column:
        def rows(gaps: Column, lengths: Column) -> Column:
            before = prefix_sums(F.zip_with(gaps, lengths, lambda a, b: a + b))
            zipped = F.arrays_zip(before.alias("b"), gaps.alias("g"), lengths.alias("n"), kept.alias("k"))
            return F.transform(F.filter(zipped, lambda r: r["k"]), lambda r: F.struct((r["b"] + r["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (r["b"] + r["g"] + r["n"]).alias("end"), F.lit(kind).alias("kind")))

        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x).cast("long"))
        return once(gaps, lambda gaps: once(F.transform(found, lambda x: F.length(x).cast("long")), lambda lengths: rows(gaps, lengths)))

    def judged(found: Column) -> Column:
        asked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        flags = F.transform(asked, keep if keep else lambda m: F.lit(True))
        return once(flags, lambda kept: F.when(F.exists(kept, lambda k: k), placed(found, kept)).otherwise(no_spans()))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, judged(found)).otherwise(no_spans()))


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    k = len(ALPHABET)
    codes = F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    table = F.lit(model)
    first = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when((a["last"] >= 0) & (c >= 0), F.get(table, a["last"] * k + c)).otherwise(0.0)).alias("sum"), (a["n"] + F.when((a["last"] >= 0) & (c >= 0), 1).otherwise(0)).alias("n"))
    return F.aggregate(codes, first, step, lambda a: a["sum"] / F.greatest(a["n"], F.lit(1)))


def random(token: Column, model: list[float], threshold: float) -> Column:
    """Whether a token is taken for a secret.

    The mean of few transitions varies more, so that each character short of 20 raises the threshold by 0.125.
    Tokens that are short or of letters alone may be ruled lines: a repeated sign counts once there.
    """
    bare = F.regexp_replace(token, "=+$", "")
    judged = lambda bare: F.when((F.length(bare) >= 20) & bare.rlike("[0-9]"), bare).otherwise(F.regexp_replace(bare, r"([+/_-])\1+", "$1"))
    above = lambda judged: (F.length(judged) >= 16) & (ratio(judged, model) >= threshold + 0.125 * F.greatest(20 - F.length(judged), F.lit(0)))
    return once(once(bare, judged), above)


def may_assign(text: Column) -> Column:
    """False only if ``ASSIGN`` has no match: its words hold one of four beginnings or ends, free of letters whose case depends on the language."""
    return (text.contains(":") | text.contains("=")) & once(F.lower(text), lambda low: low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key"))


def has_run(text: Column) -> Column:
    """Whether 16 characters of tokens stand in a row, as they do in each match of the other patterns. No run goes across a space."""
    pieces = F.exists(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda x: (F.octet_length(x) >= 16) & x.rlike(RUN))
    return F.when(F.octet_length(text) <= PIECES_BYTES, pieces).otherwise(text.rlike(RUN))


def found(docs: DataFrame, model: list[float], threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the array columns ``_base`` and ``_spans`` (base and the models' spans, sorted)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    where = lambda guard, found: F.when(F.col(guard), found).otherwise(no_spans())
    base = F.array_sort(F.concat(where("_assign", spans(text, ASSIGN, "assign", lambda m: F.length(m) >= 6, 2)), where("_run", spans(text, ACCESS, "access")), where("_run", spans(text, HEX, "hex"))))
    more = spans(text, TOKEN, "random", lambda m: random(m, model, threshold))
    out = docs.withColumns({"_assign": may_assign(text), "_run": has_run(text)})
    out = out.withColumn("_base", F.when(F.col("_assign") | F.col("_run"), base).otherwise(no_spans())).withColumn("_more", where("_run", more))
    inside = lambda s: F.exists("_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    every = F.when(F.size("_more") > 0, F.array_sort(F.concat("_base", F.filter("_more", lambda s: ~inside(s))))).otherwise(F.col("_base"))
    return out.withColumn("_spans", every).drop("_assign", "_run", "_more")


def said(col: str) -> Column:
    return F.concat_ws(",", F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per base kind, base_sha256, spans and n_random."""
    rows = found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    count = lambda col, kind: F.size(F.filter(col, lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count("_base", k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(said("_base"), 256).alias("base_sha256"), said("_spans").alias("spans"), count("_spans", "random").alias("n_random"))


def redacted(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mask; texts without spans, nulls too, stay as they are."""
    # Rows are boxed, so that no column of theirs can clash with those of found().
    rows = found(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text")), model)
    text = F.col("text")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(MASK))).otherwise(a["out"])
    whole = F.aggregate("_spans", first, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), piece(a, s).alias("out")), lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return rows.select(F.col("row").withField(f"`{text_col}`", F.when(F.size("_spans") > 0, whole).otherwise(text)).alias("row")).select("row.*")

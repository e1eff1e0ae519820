"""A corpus from documents to training sequences, in stages that are each written and read again.

Defined results of every stage: a null text is an empty one and stays null; rows with a null id are
searched for toxicity and secrets, linked with nothing and never leaked; rows with equal ids are one
document to the near-copy and benchmark stages, and equal rows of an id stay once if the id is
looked at again; null language, source and length stay null (the length is set anew); texts of any
length are read whole; extra columns are kept until the documents are packed; empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import common, decontam, ngram_join, packing, secrets, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the lexicon is learned from the labelled rows among them."""
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(model) < 0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more."""
    ids = ngram_join.joined(docs, n=5, percent=80).groupBy("doc_id").agg(F.min("component_id").alias("_first"), F.count("*").alias("_rows"))
    # Most ids have one row and stay; the others are few or many, so their number is looked at.
    marked = common.saved(ids.filter("doc_id is not null and (_first < doc_id or _rows > 1)").select(F.col("doc_id").alias("_marked"), "_first"), "marked")
    out, again = common.small_or_not(marked.select("_marked")), common.small_or_not(marked.filter("_first = _marked").select("_marked"))
    rest = docs.join(out, docs["doc_id"] == out["_marked"], "left_anti")
    return rest.unionByName(docs.join(again, docs["doc_id"] == again["_marked"], "left_semi").dropDuplicates(["doc_id", "text"]))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them masked; n_chars follows the text."""
    model = secrets.train(secrets.labelled_samples(spark))
    return secrets.redacted(docs, model).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [("toxicity", without_toxic), ("ngram_join", without_near_copies), ("decontamination", without_test_items), ("secret_scan", without_secrets), ("packing", packed)]

#: The lexicon is learned and the packing follows a histogram: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the documents of ``sf_dir``."""
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return docs

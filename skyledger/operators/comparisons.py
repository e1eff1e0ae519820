"""Comparisons of sessions: history, stored coverage with a fallback, artefacts, pairs of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history(table: DataFrame, project=None, limit: int = 20, at: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest comparisons, of one project if it is given; a limit below 1 counts as 1."""
    rows = table if project is None else table.filter(F.col("project_id") == project)
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(max(1, limit))


def appended(table: DataFrame, records: DataFrame) -> DataFrame:
    return table.unionByName(records, allowMissingColumns=True)


def coverage_for(images: DataFrame, results: DataFrame, fallback: DataFrame, keys: tuple[str, ...] = ("coverage_percentage", "vegetation_coverage_pct"), image: str = "image_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """``images`` with coverage_percent and its source.

    The newest stored value of the first key that an image has, held to 0 to 100, from "plugin:<id>"; else
    ``fallback`` (image, coverage_percent) from "builtin:exg".
    """
    rank = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    rows = results.withColumn("_rank", rank).filter("_rank > 0 and value is not null")
    stored = rows.groupBy(image).agg(F.max_by(F.struct("value", "plugin_id"), F.struct(-F.col("_rank"), F.col(at), F.col(tie))).alias("_s"))
    other = fallback.select(image, F.col("coverage_percent").alias("_c"))
    held = F.when(F.col("_s").isNotNull(), F.least(F.greatest(F.col("_s.value"), F.lit(0.0)), F.lit(100.0)))
    out = images.join(stored, image, "left").join(other, image, "left")
    source = F.when(F.col("_s").isNotNull(), F.concat(F.lit("plugin:"), F.col("_s.plugin_id"))).when(F.col("_c").isNotNull(), "builtin:exg")
    return out.withColumns({"coverage_percent": F.coalesce(held, F.col("_c")), "source": source}).drop("_s", "_c")


def latest_artifact(artifacts: DataFrame, keys: list[str], format_prefix: str, image: str = "image_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """Per image the path of its newest artefact under the first of ``keys`` that has the format."""
    rank = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    rows = artifacts.withColumn("_rank", rank).filter((F.col("_rank") > 0) & F.coalesce(F.col("format"), F.lit("")).startswith(format_prefix) & F.col("file_path").isNotNull())
    return rows.groupBy(image).agg(F.max_by("file_path", F.struct(-F.col("_rank"), F.col(at), F.col(tie))).alias("file_path"))


def sessions_compared(pairs: DataFrame, sessions: DataFrame, observations: DataFrame) -> DataFrame:
    """Pairs (before, after) of session ids with the latest observation of each, the days between and the change of coverage.

    ``sessions``: id, project_id; ``observations``: session_id, image_id, captured_at, coverage. ``problem`` is
    session_mismatch where the projects differ and no_dated_images where a session has no dated image; else null.
    """
    dated = observations.filter("captured_at is not null").groupBy(F.col("session_id").alias("id"))
    last = dated.agg(F.max(F.struct("captured_at", "image_id", "coverage")).alias("_o"))
    known = sessions.select("id", "project_id").join(last, "id", "left")
    side = lambda n: known.select(F.col("id").alias(n), F.col("project_id").alias(f"_p_{n}"), F.col("_o").alias(f"_{n}"))
    rows = pairs.join(side("before"), "before").join(side("after"), "after")
    problem = F.when(~F.col("_p_before").eqNullSafe(F.col("_p_after")), "session_mismatch").when(F.col("_before").isNull() | F.col("_after").isNull(), "no_dated_images")
    ok = problem.isNull()
    return rows.select(
        *pairs.columns, F.when(ok, F.col("_before.image_id")).alias("before_image"), F.when(ok, F.col("_after.image_id")).alias("after_image"),
        F.when(ok, F.datediff("_after.captured_at", "_before.captured_at")).alias("days"), F.when(ok, F.col("_after.coverage") - F.col("_before.coverage")).alias("change"), problem.alias("problem"),
    )

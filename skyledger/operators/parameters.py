"""Parameters of documents against the definitions of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload


def problems(rows: DataFrame, definitions: Column, values: str = "v") -> DataFrame:
    """(other columns, key, problem) for each value that breaks its definition; a document that is no object is one problem without a key.

    ``definitions`` is the schema document, a constant: it is read once, and its parameters meet the
    values by name. Of definitions with one name the first counts.
    """
    listed = rows.sparkSession.range(1).select(F.posexplode(payload.parameter_definitions(definitions)).alias("_at", "_d")).select("_at", "_d.*")
    defs = listed.groupBy("name").agg(F.min_by(F.struct("type", "options", "least", "most"), "_at").alias("_d")).select("name", "_d.*")
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    held = rows.withColumn("_e", F.explode(F.coalesce(F.map_entries(F.try_variant_get(values, "$", "map<string, variant>")), none))).drop(values)
    others = [c for c in rows.columns if c != values]
    each = held.select(*others, F.col("_e.key").alias("key"), F.col("_e.value").alias("_value")).withColumn("_kind", payload.kind(F.col("_value")))
    # As many rows as the schema has parameters.
    found = each.join(F.broadcast(defs), F.col("key") == F.col("name"), "left")
    problem = F.when(F.col("key").isNull(), "not an object").otherwise(payload.parameter_problem({c: F.col(c) for c in ("type", "options", "least", "most")}, F.col("_kind"), F.col("_value")))
    return found.select(*others, "key", problem.alias("problem")).filter("problem is not null")

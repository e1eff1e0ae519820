"""Import plans: formats, duplicates by content, raw siblings, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def candidates(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source as candidates: name, extension, hash, format or why there is none."""
    ext = text.extension(F.col("path"))
    return files.select("path", "length", "modificationTime", text.basename(F.col("path")).alias("file_name"), ext.alias("extension"), F.sha2("content", 256).alias("content_hash"), text.image_format(F.substring("content", 1, 16), ext).alias("format"))


def plan(files: DataFrame, known: DataFrame, order: str = "seq", hash_col: str = "content_hash") -> DataFrame:
    """Files with duplicate_of: the known image of that content, else the first file that has it; null for what is imported."""
    old = known.filter(F.col(hash_col).isNotNull() & (F.col(hash_col) != "")).groupBy(hash_col).agg(F.min("image_id").alias("_known"))
    first = files.groupBy(hash_col).agg(F.min(order).alias("_first"))
    rows = files.join(old, hash_col, "left").join(first, hash_col, "left")
    return rows.withColumn("duplicate_of", F.coalesce(F.col("_known").cast("string"), F.when(F.col(order) != F.col("_first"), F.col("_first").cast("string")))).drop("_known", "_first")


def siblings(files: DataFrame, stem: str = "stem", fmt: str = "format", id_col: str = "id") -> DataFrame:
    """(stem, jpeg_id, dng_id) of stems with exactly one of each."""
    is_jpeg, is_dng = F.col(fmt) == "jpeg", F.col(fmt) == "dng"
    agg = files.groupBy(stem).agg(F.count_if(is_jpeg).alias("_j"), F.count_if(is_dng).alias("_d"), F.max(F.when(is_jpeg, F.col(id_col))).alias("jpeg_id"), F.max(F.when(is_dng, F.col(id_col))).alias("dng_id"))
    return agg.filter("_j = 1 and _d = 1").drop("_j", "_d")


def orphans(files: DataFrame, images: DataFrame, path: str = "path", known: str = "file_path") -> DataFrame:
    """Files that no image refers to."""
    return files.join(images.select(F.col(known).alias("_p")).distinct(), F.col(path) == F.col("_p"), "left_anti")


def completeness(df: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    """Present and missing field names, and the missing ones that are required."""
    have = lambda names, there: F.array_compact(F.array(*(F.when(F.col(n).isNotNull() if there else F.col(n).isNull(), n) for n in names)))
    return df.withColumns({"present": have(fields, True), "missing": have(fields, False), "missing_required": have(required, False)})


def filled(df: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``df`` with its null fields taken from the row of ``other`` with its key."""
    give = other.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in fields))
    rows = df.join(give, df[key] == give["_k"], "left")
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop("_k", *(f"_{c}" for c in fields))

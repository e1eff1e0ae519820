"""Blur outliers of a session: every score against the others, raw siblings after their JPEG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leave_one_out(scores: DataFrame, session: str = "session_id", score: str = "score") -> DataFrame:
    """Mean, population deviation and number of the other scores of the session.

    Sums are taken around the session's mean, so that they don't cancel; they are two aggregates and
    a join, and a session of any size needs no window.
    """
    mean = scores.groupBy(session).agg(F.avg(score).alias("_m"))
    rows = scores.join(mean, session).withColumn("_d", F.col(score) - F.col("_m"))
    sums = rows.groupBy(session).agg(F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q"), F.count(score).alias("_n"))
    out = rows.join(sums, session)
    n = F.col("_n") - 1
    shift = F.when(n > 0, (F.col("_s") - F.col("_d")) / n)
    variance = F.greatest((F.col("_q") - F.col("_d") * F.col("_d")) / n - shift * shift, F.lit(0.0))
    none = n < 1
    return out.withColumns({"others_mean": F.when(none, 0.0).otherwise(F.col("_m") + shift), "others_std": F.when(none, 0.0).otherwise(F.sqrt(variance)), "others_n": F.greatest(n, F.lit(0))}).drop("_m", "_d", "_s", "_q", "_n")


def is_blurry(score: Column, mean: Column, std: Column, n: Column, floor: float = 20.0, z: float = -1.5) -> Column:
    """By z score; by a fixed floor where fewer than 5 others are known or they are all alike."""
    return F.when((n < 5) | (std == 0), score < floor).otherwise((score - mean) / std < z)


def mirrored(images: DataFrame, id_col: str = "id", sibling: str = "raw_sibling_id", flag: str = "is_blurry", fmt: str = "format") -> DataFrame:
    """A raw file takes the flag of its JPEG."""
    jpeg = images.select(F.col(id_col).alias("_j"), F.col(flag).alias("_flag"))
    rows = images.join(jpeg, images[sibling] == jpeg["_j"], "left")
    return rows.withColumn(flag, F.when((F.col(fmt) == "dng") & F.col("_j").isNotNull(), F.col("_flag")).otherwise(F.col(flag))).drop("_j", "_flag")


def laplacian_variance(pixels: DataFrame, img: str = "img", value: str = "gray") -> DataFrame:
    """(img, blur_score): population variance of the 3x3 Laplacian, borders clamped. ``pixels`` has img, x, y and a value.

    A pixel hands its value to its neighbours, so the sum is an aggregate by place; nothing is joined.
    """
    size = pixels.groupBy(img).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    rows = pixels.join(size, img)
    here = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col(value).cast("double").alias("v"))
    edge = sum((F.when(c, 1).otherwise(0) for c in (F.col("x") == 0, F.col("y") == 0, F.col("x") == F.col("_w"), F.col("y") == F.col("_h"))), F.lit(0))
    own = F.struct(F.col("x"), F.col("y"), ((edge - 4) * F.col(value)).cast("double").alias("v"))
    given = rows.select(img, "_w", "_h", F.explode(F.array(own, here(1, 0), here(-1, 0), here(0, 1), here(0, -1))).alias("p")).select(img, "_w", "_h", "p.*")
    inside = given.filter("x >= 0 and y >= 0 and x <= _w and y <= _h")
    return inside.groupBy(img, "x", "y").agg(F.sum("v").alias("_l")).groupBy(img).agg(F.var_pop("_l").alias("blur_score"))

"""Frames of a walk: how sharp they are, which of them to take, and points taken back to where a frame was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sharpness(pixels: DataFrame, keys: tuple[str, ...] = ("capture", "frame")) -> DataFrame:
    """(keys, sharpness): variance of the four-neighbour Laplacian of the grey values ``grey`` of (row, col), inner pixels only."""
    g = F.col("grey")
    across, down = W.partitionBy(*keys, "row").orderBy("col"), W.partitionBy(*keys, "col").orderBy("row")
    d = pixels.select(*keys, "row", "col", "grey")
    d = d.withColumns({"w": F.lag(g).over(across), "e": F.lead(g).over(across)}).withColumns({"n": F.lag(g).over(down), "s": F.lead(g).over(down)})
    d = d.withColumn("lap", F.col("w") + F.col("e") + F.col("n") + F.col("s") - 4 * g).where("lap IS NOT NULL")
    return d.groupBy(*keys).agg(F.var_pop("lap").alias("sharpness"))


def sharpest_by_step(frames: DataFrame, step: int) -> DataFrame:
    """Of each ``step`` frames in a row of a capture the sharpest, the first of equal ones."""
    of = W.partitionBy("capture", F.floor(F.col("frame") / step)).orderBy(F.desc("sharpness"), "frame")
    return frames.withColumn("__k", F.row_number().over(of)).where("__k = 1").drop("__k")


def undo(points: DataFrame, shifts: DataFrame, x: str = "x", z: str = "z") -> DataFrame:
    """Points of the corrected plan (capture, chunk, x, z) where their chunk was measured: the inverse of its correction."""
    d = points.join(shifts.select("capture", "chunk", "cx", "cz", "dx", "dz", "yaw"), ["capture", "chunk"], "left")
    c, s = F.cos("yaw"), F.sin("yaw")
    u, v = F.col(x) - F.col("cx") - F.col("dx"), F.col(z) - F.col("cz") - F.col("dz")
    return d.withColumns({x: F.coalesce(c * u + s * v + F.col("cx"), F.col(x)), z: F.coalesce(c * v - s * u + F.col("cz"), F.col(z))}).drop("cx", "cz", "dx", "dz", "yaw")

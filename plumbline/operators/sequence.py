"""Ordered rows: argmax by window, runs with and without gaps, cyclic runs, ranks and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def window_argmax(rows: DataFrame, keys: list[str], window: Column, score: str, order: str, keep: list[str]) -> DataFrame:
    """The row with the greatest score of each window; of equal ones the first."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(order)).alias("neg"), *keep)).alias("m")
    return rows.groupBy(*keys, window.alias("window")).agg(best).select(*keys, "window", F.col("m.score").alias(score), *[F.col(f"m.{c}").alias(c) for c in keep])


def islands(rows: DataFrame, keys: list[str], at: str, gap: int = 1) -> DataFrame:
    """Runs of whole numbers whose neighbours differ by ``gap`` at most: first, last and count."""
    w = W.partitionBy(*keys).orderBy(at)
    d = rows.select(*keys, at).distinct().withColumn("__new", (F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(gap + 1)) > gap).cast("long"))
    d = d.withColumn("run", F.sum("__new").over(w))
    return d.groupBy(*keys, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def cyclic_islands(rows: DataFrame, keys: list[str], at: str, size: int) -> DataFrame:
    """Runs on a ring of ``size`` places: a run that ends at the last place goes on at the first."""
    d = islands(rows, keys, at)
    w = W.partitionBy(*keys)
    d = d.withColumns({"least": F.min("first").over(w), "most": F.max("last").over(w), "runs": F.count("*").over(w)})
    joined = (F.col("least") == 0) & (F.col("most") == size - 1) & (F.col("runs") > 1)
    run = F.when(joined & (F.col("last") == size - 1), 1).otherwise(F.col("run"))
    d = d.withColumn("run", run.cast("long")).withColumn("start", F.when(joined & (F.col("last") == size - 1), F.col("first") - size).otherwise(F.col("first")))
    return d.groupBy(*keys, "run").agg(F.pmod(F.min("start"), F.lit(size)).alias("first"), F.sum("n").alias("n"))


def best_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def margin(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """By how much the best row of each key beats the next; null where there is one."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    d = rows.withColumns({"__r": F.row_number().over(w), "__next": F.lead(score).over(w)}).where("__r = 1")
    return d.select(*keys, F.col(score).alias("best"), (F.col(score) - F.col("__next")).alias("margin"))

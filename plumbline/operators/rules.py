"""Rules: first-match classes, united findings, and the work that findings ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(rules: list[tuple[Column, str]], default: str) -> Column:
    """The class of the first rule that holds; a null condition does not hold."""
    out = F
    for holds, name in rules:
        out = out.when(F.coalesce(holds, F.lit(False)), name)
    return out.otherwise(default)


def flags(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, rule) for each rule that holds, once each: one pass however many rules there are."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return rows.select(key, F.explode(held).alias("rule")).distinct()


def scope(rows: DataFrame, class_: str, quantity: str, actions: DataFrame) -> DataFrame:
    """Summed quantity of each action that the classes ask for; null quantities count as none."""
    return rows.join(F.broadcast(actions), class_).groupBy("action").agg(F.coalesce(F.sum(quantity), F.lit(0.0)).alias("quantity"), F.count("*").alias("n"))

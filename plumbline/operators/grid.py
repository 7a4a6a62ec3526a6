"""Sparse grids: cell sets, coverage by height bands, morphology, polygons and components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count("*").alias("n"))


def band_coverage(points: DataFrame, keys: list[str], band: str, least: int = 3) -> DataFrame:
    """Cells whose points fill ``least`` height bands or more."""
    per_band = points.groupBy(*keys, band).agg(F.count("*").alias("n"))
    return per_band.groupBy(*keys).agg(F.count("*").alias("bands"), F.sum("n").alias("n")).where(F.col("bands") >= least)


def band_bitmap(points: DataFrame, keys: list[str], band: str, least: int = 3) -> DataFrame:
    """The same by one pass of bit sets, for up to 63 bands."""
    bits = F.expr(f"bit_count(bit_or(shiftleft(1L, cast({band} as int))))").cast("long")
    return points.groupBy(*keys).agg(bits.alias("bands")).where(F.col("bands") >= least)


def iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.select(*keys).distinct().withColumn("a", F.lit(1)).join(b.select(*keys).distinct().withColumn("b", F.lit(1)), keys, "full")
    return both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count("*").alias("either"))


def _pairs(cells: DataFrame, group: str) -> DataFrame:
    """(a, b): every two groups, the lesser first."""
    of = cells.select(group).distinct()
    a, b = of.withColumnRenamed(group, "a"), of.withColumnRenamed(group, "b")
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


def pair_ious(cells: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(a, b, both, either) of every two groups' cell sets; groups that share no cell have both = 0."""
    c = cells.select(group, *keys).distinct()
    shared = c.withColumnRenamed(group, "a").join(c.withColumnRenamed(group, "b"), keys).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    size = c.groupBy(group).agg(F.count("*").alias("n"))
    d = _pairs(c, group).join(shared, ["a", "b"], "left").na.fill(0, ["both"])
    for side in "ab":
        d = d.join(size.select(F.col(group).alias(side), F.col("n").alias(f"n_{side}")), side)
    return d.select("a", "b", "both", (F.col("n_a") + F.col("n_b") - F.col("both")).alias("either"))


def pair_cell_sets(cells: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(a, b, keys, part) of every two groups: a's cells that b has too, 'both', and those it has not, 'first'."""
    c = cells.select(group, *keys).distinct()
    firsts = c.withColumnRenamed(group, "a").join(F.broadcast(_pairs(c, group)), "a")
    d = firsts.join(c.withColumnRenamed(group, "b").withColumn("part", F.lit("both")), ["b", *keys], "left")
    return d.select("a", "b", *keys, F.coalesce("part", F.lit("first")).alias("part"))


def dilate(cells: DataFrame, x: str = "ix", z: str = "iz", by: tuple[str, ...] = ()) -> DataFrame:
    """Cells and their eight neighbours, in each group of ``by``: nine rows a cell, then distinct."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    d = cells.select(*by, x, z).withColumn("dx", F.explode(steps)).withColumn("dz", F.explode(steps))
    return d.select(*by, (F.col(x) + F.col("dx")).alias(x), (F.col(z) + F.col("dz")).alias(z)).distinct()


def erode(cells: DataFrame, x: str = "ix", z: str = "iz", by: tuple[str, ...] = ()) -> DataFrame:
    """Cells all of whose eight neighbours are cells of the same group too."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    d = cells.select(*by, x, z).distinct().withColumn("dx", F.explode(steps)).withColumn("dz", F.explode(steps))
    return d.groupBy(*by, (F.col(x) + F.col("dx")).alias(x), (F.col(z) + F.col("dz")).alias(z)).agg(F.count("*").alias("n")).where("n = 9").drop("n")


def close(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return erode(dilate(cells, by=by), by=by)


def inside(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of crossings to its right."""
    out = F.lit(False)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 != y1:
            straddles = (F.lit(y0) > y) != (F.lit(y1) > y)
            out = out != (straddles & (x < F.lit(x0) + (y - F.lit(y0)) * F.lit((x1 - x0) / (y1 - y0))))
    return out


def outline_distance(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    parts = []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        dx, dy = x1 - x0, y1 - y0
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x0) * dx + (y - y0) * dy) / F.lit(float(dx * dx + dy * dy))))
        parts.append(F.sqrt(F.pow(x - x0 - t * dx, F.lit(2)) + F.pow(y - y0 - t * dy, F.lit(2))))
    return F.least(*parts)


def shoelace(corners: DataFrame, keys: list[str]) -> DataFrame:
    """Area of polygons given as rows (keys, seq, x, y); a polygon's corners are ordered in an array."""
    d = corners.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    at = lambda i: F.get("p", F.pmod(i, F.size("p")))
    cross = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return d.select(*keys, (F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2).alias("area"))


def components(cells: DataFrame, save: Callable[[DataFrame], DataFrame], rounds: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ix, iz, label): eight-connected components of each group; the label is the least cell, as iz then ix.

    Labels spread to neighbours and then jump to their label's label, in all groups at once.
    Groups of ``by`` are not null. ``save`` writes and reads a table, or checkpoints it, so that
    no round's lineage grows.
    """
    key = F.struct("iz", "ix")
    nodes = save(cells.select(*by, "ix", "iz").distinct().withColumn("label", key))
    steps = F.sequence(F.lit(-1), F.lit(1))
    for _ in range(rounds):
        spread = nodes.withColumn("dx", F.explode(steps)).withColumn("dz", F.explode(steps))
        spread = spread.groupBy(*by, (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iz") + F.col("dz")).alias("iz")).agg(F.min("label").alias("low"))
        step = nodes.join(spread, [*by, "ix", "iz"])
        far = nodes.select(*by, key.alias("low"), F.col("label").alias("far"))
        step = save(step.join(far, [*by, "low"]).select(*by, "ix", "iz", F.least("low", "far").alias("label"), F.col("label").alias("was")))
        done = step.where("label <> was").isEmpty()
        nodes = step.drop("was")
        if done:
            return nodes
    raise RuntimeError("the labels have not settled")

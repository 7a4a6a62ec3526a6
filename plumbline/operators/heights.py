"""Floor and ceiling heights of noisy clouds, from histograms that are sums in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values, in metres.
SPIKE = 0.1
STEP = 0.02
CENTRE_WINDOW, KERNEL, CENTRE_BIN = 0.25, 0.06, 0.01
LEAST_POINTS = 300
SPREAD_WINDOW = 0.15


def strongest_spike(points: DataFrame, keys: tuple[str, ...] = ("capture",), y: str = "y", low: float = 0.005, high: float = 0.6, step: float = STEP, width: float = SPIKE) -> DataFrame:
    """(keys, floor, support): the height about which most points lie within ``width``, of all between two shares of the points.

    A mirror image below a glossy floor is weaker than the floor itself, so the strongest plane is
    taken and not the lowest. Shares and sums come from the histogram; equal ones go to the lowest.
    """
    n = points.groupBy(*keys, F.floor(F.col(y) / step).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("sum"))
    by, half = W.partitionBy(*keys).orderBy("bin"), round(width / step / 2)
    d = n.withColumns({"upto": F.sum("n").over(by) / F.sum("n").over(W.partitionBy(*keys)), "before": (F.sum("n").over(by) - F.col("n")) / F.sum("n").over(W.partitionBy(*keys))})
    around = W.partitionBy(*keys).orderBy("bin").rangeBetween(-half, half)
    d = d.withColumns({"support": F.sum("n").over(around), "mean": F.sum("sum").over(around) / F.sum("n").over(around)}).where((F.col("upto") > low) & (F.col("before") < high))
    best = d.groupBy(*keys).agg(F.max(F.struct("support", F.negative("bin").alias("low"), "mean")).alias("b"))
    return best.select(*keys, F.col("b.mean").alias("floor"), F.col("b.support").alias("support"))


def centred(points: DataFrame, guesses: DataFrame, guess: str, keys: tuple[str, ...] = ("capture",), y: str = "y", window: float = CENTRE_WINDOW, kernel: float = KERNEL, least: int = LEAST_POINTS) -> DataFrame:
    """(keys, centre, spread, refined): a guessed height moved to the middle of the densest ``kernel`` of points near it.

    The guess stays, with no spread, where fewer than ``least`` points lie within ``window`` of it.
    """
    near = points.select(*keys, F.col(y).alias("y")).join(guesses.select(*keys, F.col(guess).alias("guess")), list(keys)).where(F.abs(F.col("y") - F.col("guess")) <= window)
    bins = near.groupBy(*keys, F.floor((F.col("y") - F.col("guess")) / CENTRE_BIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    half = round(kernel / CENTRE_BIN / 2)
    dense = bins.withColumn("s", F.sum("n").over(W.partitionBy(*keys).orderBy("bin").rangeBetween(-half, half))).groupBy(*keys).agg(F.sum("n").alias("n"), F.max(F.struct("s", F.negative("bin").alias("low"))).alias("b"))
    peak = dense.where(F.col("n") >= least).select(*keys, F.negative("b.low").alias("bin"))
    core = near.join(peak, list(keys)).where(F.abs(F.col("y") - F.col("guess") - (F.col("bin") + 0.5) * CENTRE_BIN) <= kernel / 2 + CENTRE_BIN)
    centre = core.groupBy(*keys).agg(F.median("y").alias("centre"))
    middle = near.join(centre, list(keys)).where(F.abs(F.col("y") - F.col("centre")) <= SPREAD_WINDOW)
    usual = middle.groupBy(*keys, "centre").agg(F.median("y").alias("m"))
    spread = middle.join(usual.select(*keys, "m"), list(keys)).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col("y") - F.col("m")))).alias("spread"))
    d = guesses.select(*keys, F.col(guess).alias("guess")).join(centre, list(keys), "left").join(spread, list(keys), "left")
    return d.select(*keys, F.coalesce("centre", "guess").alias("centre"), F.coalesce("spread", F.lit(0.0)).alias("spread"), F.col("centre").isNotNull().alias("refined"))


def refine(points: DataFrame, guesses: DataFrame, keys: tuple[str, ...] = ("capture",)) -> DataFrame:
    """Floor and ceiling of each key moved to where their points lie; a null ceiling stays null. ``guesses`` has floor and ceiling."""
    floor = centred(points, guesses, "floor", keys).select(*keys, F.col("centre").alias("floor"), F.col("spread").alias("floor_spread"), F.col("refined").alias("floor_refined"))
    top = centred(points, guesses.where("ceiling IS NOT NULL"), "ceiling", keys).select(*keys, F.col("centre").alias("ceiling"), F.col("spread").alias("ceiling_spread"), F.col("refined").alias("ceiling_refined"))
    d = floor.join(top, list(keys), "left")
    return d.select(*keys, "floor", "ceiling", "floor_spread", F.coalesce("ceiling_spread", F.lit(0.0)).alias("ceiling_spread"), (F.col("floor_refined") & F.coalesce("ceiling_refined", F.lit(True))).alias("refined"), height().alias("height"))


def height() -> Column:
    return F.col("ceiling") - F.col("floor")

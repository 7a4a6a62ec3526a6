"""Robust aggregates: medians, spreads, intervals, histogram modes and ratio fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Of a normal distribution, the standard deviation by the median absolute deviation.
MAD_TO_SIGMA = 1.4826


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet too; ``b`` has a row a key, or a few, and goes to all tasks."""
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(F.broadcast(b), on, how).drop(*[f"__{k}" for k in keys])


def quantiles(rows: DataFrame, value: str | Column, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, a column a share): exact quantiles of few groups of many rows, interpolated as ``percentile`` does.

    Values fall into bins by their logarithm, some thousand however many rows there are. The bins that
    hold the wanted ranks are found from their counts, and only their values are then counted one by
    one, each different value once. Nulls take no part; a group without values has no row.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = rows.select(*keys, v.alias("__v")).where("__v IS NOT NULL")
    # log1p is monotonous as it is rounded; NaN is above all
    bin_ = F.when(F.isnan("__v"), F.lit(2**63 - 1)).otherwise(F.floor(F.signum("__v") * F.log1p(F.abs("__v") * 1e9) * 2048))
    d = d.withColumn("__bin", bin_)
    order = W.partitionBy(*keys).orderBy("__bin")  # a row a bin
    bins = d.groupBy(*keys, "__bin").agg(F.count("*").alias("__m")).withColumns({"__upto": F.sum("__m").over(order.rowsBetween(W.unboundedPreceding, 0)), "__n": F.sum("__m").over(W.partitionBy(*keys))})
    at = {name: (F.col("__n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    within = lambda rank, low, high: (rank >= low) & (rank < high)
    ends = [f(p) for p in at.values() for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for rank in ends:
        wanted = wanted | within(rank, F.col("__upto") - F.col("__m"), F.col("__upto"))
    wanted = bins.where(wanted).select(*keys, "__bin", (F.col("__upto") - F.col("__m")).alias("__before"), "__n")
    counted = same_keys(d, wanted, [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__n", "__v").agg(F.count("*").alias("__c"))
    high = F.col("__before") + F.sum("__c").over(W.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    counted = counted.withColumn("__high", high).withColumn("__low", F.col("__high") - F.col("__c"))
    pick = lambda rank: F.max(F.when(within(rank, F.col("__low"), F.col("__high")), F.col("__v")))
    picks = [x for name, p in at.items() for x in (pick(F.floor(p)).alias(f"__a_{name}"), pick(F.ceil(p)).alias(f"__z_{name}"))]
    out = counted.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)

    def between(name):
        a, z, p = F.col(f"__a_{name}"), F.col(f"__z_{name}"), at[name]
        return F.when(a == z, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * z).alias(name)

    return out.select(*keys, *[between(name) for name in shares])


def median_mad(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, med, spread, n) of few groups, however many rows they have."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    med = quantiles(rows, value, keys, {"med": 0.5})
    spread = quantiles(same_keys(rows.select(*keys, value), med, keys), F.abs(F.col(value) - F.col("med")), keys, {"mad": 0.5})
    d = same_keys(same_keys(n, med, keys, "left"), spread, keys, "left")
    return d.select(*keys, "med", (MAD_TO_SIGMA * F.col("mad")).alias("spread"), "n")


def small_median_mad(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The same for many groups of some rows each, which Spark's own median suits."""
    med = rows.groupBy(*keys).agg(F.median(value).alias("med"))
    near = rows.join(med, keys)
    return near.groupBy(*keys, "med").agg((MAD_TO_SIGMA * F.median(F.abs(F.col(value) - F.col("med")))).alias("spread"), F.count("*").alias("n"))


def robust_interval(rows: DataFrame, value: str, keys: list[str], stretch: float = 3.0) -> DataFrame:
    """Median with the 5 and 95 percent points; unstable where their span is over ``stretch`` robust spans."""
    d = same_keys(median_mad(rows, value, keys).drop("n"), quantiles(rows, value, keys, {"p5": 0.05, "p95": 0.95}), keys, "left")
    lo = F.when(F.col("med") >= 0, F.greatest(F.lit(0.0), F.col("p5"))).otherwise(F.col("p5"))
    return d.withColumns({"lo": lo, "hi": F.col("p95"), "stable": F.col("p95") - F.col("p5") <= stretch * 2 * F.col("spread")}).drop("p5", "p95")


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n): the bins that have values. A stray value is one bin, however far off it is."""
    return rows.select(F.floor(F.col(value) / width).cast("long").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def smoothed(bins: DataFrame, half: int = 3) -> DataFrame:
    """(bin, s): moving sums over 2 half + 1 bins, from the least to the greatest bin; bins whose sum is 0 have no row."""
    ends = bins.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    d = bins.select(F.explode(F.sequence(F.col("bin") - half, F.col("bin") + half)).alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("s"))
    return d.join(F.broadcast(ends), F.col("bin").between(F.col("a"), F.col("b"))).select("bin", "s")  # a one-row side


def mode(bins: DataFrame) -> DataFrame:
    """The bin with the greatest smoothed count; of equal ones the lowest."""
    return smoothed(bins).agg(F.max(F.struct("s", (-F.col("bin")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("bin"), F.col("m.s").alias("s"))


def highest_peak(bins: DataFrame, share: float = 0.5) -> DataFrame:
    """The highest bin that is a local maximum with at least ``share`` of the greatest smoothed count."""
    d = smoothed(bins)
    beside = lambda step, name: d.select((F.col("bin") + step).alias("bin"), F.col("s").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0))
    top = d.agg(F.max("s").alias("top"))
    peaks = d.join(F.broadcast(top), F.col("s") >= share * F.col("top")).join(beside(1, "before"), "bin", "left").join(beside(-1, "after"), "bin", "left")
    return peaks.where((F.col("s") >= zero("before")) & (F.col("s") > zero("after"))).agg(F.max(F.struct("bin", "s")).alias("m")).select("m.bin", "m.s")


def thin_stretches(bins: DataFrame, share: float = 0.5) -> DataFrame:
    """(first, last, n): stretches of bins whose smoothed count is under ``share`` of the median of those above 0.

    They are what lies between the stretches that are not thin, so empty bins are never listed one by one.
    """
    s = smoothed(bins)
    full = s.join(F.broadcast(s.agg(F.median("s").alias("m"))), F.col("s") >= share * F.col("m")).select("bin")  # a one-row side
    ends = bins.agg((F.min("bin") - 1).alias("a"), (F.max("bin") + 1).alias("b"))
    marks = full.union(ends.select("a")).union(ends.select("b"))
    # a quantity's occupied bins are few, and one task orders them
    d = marks.withColumn("next", F.lead("bin").over(W.orderBy("bin"))).where(F.col("next") - F.col("bin") > 1)
    return d.select((F.col("bin") + 1).alias("first"), (F.col("next") - 1).alias("last"), (F.col("next") - F.col("bin") - 1).alias("n"))


def ratio_fit(rows: DataFrame, ratio: str, keys: list[str], least: int = 3) -> DataFrame:
    """Median of the ratios within three robust spreads of the median; null where fewer than ``least`` are left."""
    d = small_median_mad(rows.select(*keys, ratio), ratio, keys).drop("n")
    near = rows.join(d, keys).where(F.abs(F.col(ratio) - F.col("med")) <= 3 * F.col("spread") + 1e-12)
    out = near.groupBy(*keys).agg(F.median(ratio).alias("fit"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def weighted_log_mean(rows: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.exp(F.sum(F.col(weight) * F.ln(value)) / F.sum(weight)).alias("mean"), F.stddev_samp(F.ln(value)).alias("spread"))


def weighted_moments(rows: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Weighted mean and variance from sums that can be added up as data come in."""
    w, v = F.col(weight), F.col(value)
    d = rows.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"))
    m = F.col("wv") / F.col("w")
    return d.select(*keys, m.alias("mean"), F.greatest(F.lit(0.0), F.col("wvv") / F.col("w") - m * m).alias("var"))

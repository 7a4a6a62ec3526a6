"""Lines of sight: the floor they cross, and the doorways they go through.

``rays`` has capture, frame, chunk, ox, oy, oz, ex, ey, ez in metres, y up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators import sequence

#: A line of sight is not trusted over its last stretch: metres, and share of its length.
MARGIN_ABS, MARGIN_REL = 0.15, 0.05
LEAST_FRAMES = 3


def _cells(rays: DataFrame, cell: float, length) -> DataFrame:
    """Cells that each ray crosses over its first ``length`` metres in plan: steps of half a cell, each cell once."""
    ux, uz = F.try_divide(F.col("ex") - F.col("ox"), F.col("plan")), F.try_divide(F.col("ez") - F.col("oz"), F.col("plan"))
    d = rays.withColumn("plan", F.hypot(F.col("ex") - F.col("ox"), F.col("ez") - F.col("oz"))).withColumn("reach", length).where("plan > 0 AND reach > 0")
    t = lambda k: F.least(k * (cell / 2), F.col("reach"))
    at = lambda o, u, k: F.floor((F.col(o) + u * t(k)) / cell).cast("long")
    steps = F.sequence(F.lit(0), F.ceil(F.col("reach") / (cell / 2)).cast("int"))
    return d.withColumn("__c", F.explode(F.array_distinct(F.transform(steps, lambda k: F.struct(at("ox", ux, k).alias("ix"), at("oz", uz, k).alias("iz"))))))


def carve(rays: DataFrame, heights: DataFrame, cell: float = 0.05, margin_abs: float = MARGIN_ABS, margin_rel: float = MARGIN_REL) -> DataFrame:
    """(capture, chunk, ix, iz, frames): how many frames saw across a cell. A ray counts up to its margin and above the floor.

    Each frame counts a cell once: frames are made distinct before they are counted, so both
    steps have partial sums.
    """
    d = rays.join(heights.select("capture", "floor"), "capture")
    plan = F.hypot(F.col("ex") - F.col("ox"), F.col("ez") - F.col("oz"))
    full = F.sqrt(plan * plan + F.pow(F.col("ey") - F.col("oy"), F.lit(2)))
    kept = F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(F.lit(margin_abs), full) - margin_rel)
    below = F.when(F.col("ey") < F.col("floor"), F.try_divide(F.col("oy") - F.col("floor"), F.col("oy") - F.col("ey"))).otherwise(F.lit(1.0))
    cells = _cells(d, cell, plan * F.least(kept, F.greatest(below, F.lit(0.0))))
    once = cells.select("capture", "chunk", "frame", "__c.ix", "__c.iz").distinct()
    return once.groupBy("capture", "chunk", "ix", "iz").agg(F.count("*").alias("frames"))


def seen(votes: DataFrame, least: int = LEAST_FRAMES) -> DataFrame:
    """Cells that ``least`` frames or more saw across, over all chunks given."""
    return votes.groupBy("capture", "ix", "iz").agg(F.sum("frames").alias("frames")).where(F.col("frames") >= least)


def doorways(rays: DataFrame, edges: DataFrame, bin_: float = 0.03, bridge: float = 0.1, narrow: float = 0.55, wide: float = 2.2, cell: float = 0.25, clear: float = 0.4, near: float = 0.2) -> DataFrame:
    """(capture, room, wall, t0, t1): stretches of walls that two frames or more, and more than end there, see through.

    ``edges`` has capture, room, wall, x0, z0, x1, z1, len. A ray goes through a wall when it
    ends ``clear`` metres or more behind it, and ends there within ``near``. Rays and walls meet
    in the cells that both cross, so that no ray meets a wall it does not come near.
    """
    full = F.hypot(F.col("ex") - F.col("ox"), F.col("ez") - F.col("oz")) + near
    r = rays.withColumn("ray", F.xxhash64("frame", "ox", "oz", "ex", "ey", "ez"))
    r = _cells(r, cell, full).select("capture", "frame", "ray", "ox", "oz", "ex", "ez", "__c.ix", "__c.iz")
    e = edges.select("capture", "room", "wall", "x0", "z0", "x1", "z1", "len", F.lit(0).alias("frame"), F.col("x0").alias("ox"), F.lit(0.0).alias("oy"), F.col("z0").alias("oz"), F.col("x1").alias("ex"), F.lit(0.0).alias("ey"), F.col("z1").alias("ez"))
    e = _cells(e, cell, F.col("len")).select("capture", "room", "wall", "x0", "z0", "x1", "z1", "len", "__c.ix", "__c.iz")
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    e = e.withColumn("dx", F.explode(steps)).withColumn("dz", F.explode(steps)).withColumns({"ix": F.col("ix") + F.col("dx"), "iz": F.col("iz") + F.col("dz")}).drop("dx", "dz").distinct()
    key = ["capture", "room", "wall"]
    d = r.join(e, ["capture", "ix", "iz"]).drop("ix", "iz").distinct()
    wx, wz, rx, rz = (F.col(a) - F.col(b) for a, b in (("x1", "x0"), ("z1", "z0"), ("ex", "ox"), ("ez", "oz")))
    det = rx * wz - rz * wx
    ax, az = F.col("x0") - F.col("ox"), F.col("z0") - F.col("oz")
    s, u = F.try_divide(ax * wz - az * wx, det), F.try_divide(ax * rz - az * rx, det)
    rest = (F.lit(1.0) - s) * F.abs(det) / F.col("len")  # how far behind the wall the ray ends
    d = d.withColumns({"s": s, "u": u, "rest": rest}).where("s > 0 AND u BETWEEN 0 AND 1")
    d = d.withColumn("kind", F.when(F.col("rest") >= clear, "through").when(F.abs(F.col("rest")) <= near, "hit")).where("kind IS NOT NULL")
    d = d.select(*key, "frame", "kind", F.floor(F.col("u") * F.col("len") / bin_).cast("long").alias("bin")).distinct()
    counts = d.groupBy(*key, "bin").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("through", "hit")])
    gap = int(bridge / bin_) + 1
    runs = sequence.islands(counts.where("through >= 2 AND through > hit"), key, "bin", gap)
    return runs.select(*key, (F.col("first") * bin_).alias("t0"), ((F.col("last") + 1) * bin_).alias("t1")).where((F.col("t1") - F.col("t0")).between(narrow, wide))


def best_views(gains: DataFrame, save: Callable[[DataFrame], DataFrame], most: int = 10, least: float = 0.02) -> DataFrame:
    """(surface, frame, place): the frames that add most to what is seen of a surface, one after another.

    ``gains`` has surface, frame, spot, quality. A frame adds what it betters of each spot's best
    so far; frames are taken while they add ``least`` of the sum of all spots' best. Each round
    is one grouped sum whose choice ``save`` writes; there are ``most`` rounds at most.
    """
    top = gains.groupBy("surface", "spot").agg(F.max("quality").alias("q")).groupBy("surface").agg(F.sum("q").alias("total"))
    seen_, chosen = None, None
    for place in range(most):
        d = gains if seen_ is None else gains.join(seen_, ["surface", "spot"], "left")
        had = F.lit(0.0) if seen_ is None else F.coalesce("had", F.lit(0.0))
        add = d.groupBy("surface", "frame").agg(F.sum(F.greatest(F.col("quality") - had, F.lit(0.0))).alias("gain"))
        w = W.partitionBy("surface").orderBy(F.desc("gain"), "frame")
        best = add.join(top, "surface").where(F.col("gain") >= least * F.col("total")).where("gain > 0").withColumn("__r", F.row_number().over(w)).where("__r = 1")
        best = save(best.select("surface", "frame", F.lit(place).alias("place")))
        if best.isEmpty():
            break
        chosen = best if chosen is None else chosen.unionByName(best)
        seen_ = gains.join(chosen.select("surface", "frame"), ["surface", "frame"], "left_semi").groupBy("surface", "spot").agg(F.max("quality").alias("had"))
    return gains.select("surface", "frame", F.lit(0).alias("place")).limit(0) if chosen is None else chosen

"""Up from walls: the direction along which the walls of a cloud are thinnest; and whether points spread over an area."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Degrees about the prior, heights about the camera and spreads in metres, a ratio.
CONE = 35.0
SLAB = (-0.6, 0.4)
LEAST_SPREAD = 0.3
LEAST_ASPECT = 0.12
AT_EDGE = 3.0

#: Rounds of the search: degrees about the best so far, degrees a step, cells of the plan in metres.
ROUNDS = ((CONE, 4.0, 0.1), (4.0, 1.0, 0.1), (1.0, 0.25, 0.05))

#: Plans, turned against each other, that a score is the mean of: walls along one plan's lines fill
#: its cells in a way that changes with the tilt more than thinness does.
PLANS = (0.3, 0.82, 1.35)

#: Candidates of all captures, some hundred bytes each, that are sent to every task; beyond, points and candidates meet by a shuffle.
SENT = 200_000
AXES = ("ux", "uy", "uz", "ex", "ey", "ez")


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _unit(v: list[Column]) -> list[Column]:
    size = F.sqrt(_dot(v, v))
    return [c / size for c in v]


def frames(priors: DataFrame) -> DataFrame:
    """(capture, u, e): the unit prior of each capture and a direction across it; priors without a direction have no row."""
    u = [F.col(c).cast("double") for c in ("ux", "uy", "uz")]
    d = priors.where(F.coalesce(_dot(u, u) > 0, F.lit(False))).select("capture", *[c.alias(n) for c, n in zip(_unit(u), AXES)])
    u = [F.col(c) for c in AXES[:3]]
    # the axis that lies furthest across, less its part along u
    pick = F.array_position(F.transform(F.array(*u), F.abs), F.least(*[F.abs(c) for c in u])) - 1
    e = [F.when(pick == k, 1.0).otherwise(0.0) for k in range(3)]
    along = _dot(e, u)
    return d.select("capture", *AXES[:3], *[c.alias(n) for c, n in zip(_unit([a - along * b for a, b in zip(e, u)]), AXES[3:])])


def candidates(around: DataFrame, half: float, step: float) -> DataFrame:
    """(capture, i, j, u, e): frames tilted by i and j steps about two directions, up to ``half`` degrees in all."""
    m = int(half / step + 1e-9)
    ways = F.sequence(F.lit(-m), F.lit(m))
    d = around.withColumn("i", F.explode(ways)).withColumn("j", F.explode(ways)).where(F.col("i") * F.col("i") + F.col("j") * F.col("j") <= (half / step + 1e-9) ** 2)
    u, e = [F.col(c) for c in AXES[:3]], [F.col(c) for c in AXES[3:]]
    a, b = F.tan(F.radians(F.col("i") * float(step))), F.tan(F.radians(F.col("j") * float(step)))
    d = d.withColumn("tilted", F.array(*_unit([p + a * q + b * r for p, q, r in zip(u, e, _cross(u, e))])))
    n = [F.col("tilted")[k] for k in range(3)]
    along = _dot(e, n)
    across = _unit([p - along * q for p, q in zip(e, n)])
    return d.select("capture", "i", "j", *[c.alias(x) for c, x in zip(n, AXES[:3])], *[c.alias(x) for c, x in zip(across, AXES[3:])])


def thinness(points: DataFrame, ways: DataFrame, cell: float, slab: tuple[float, float] = SLAB, plans: tuple[float, ...] = PLANS) -> DataFrame:
    """(capture, i, j, u, e, score): for each candidate the mean number of points that share a point's cell of a plan.

    ``points`` has capture, x, y, z about the camera and a weight n. All candidates are counted in one
    pass: a point meets its capture's candidates, partial counts are made before the shuffle. It is the candidates
    that travel: they are sent to the points up to ``SENT`` rows, whatever the points' size. Only points whose height
    is within the slab count; a candidate without any has no row. A mean over points and not over pairs, so
    that a tilt gains nothing by pushing points out of the slab.
    """
    key = ["capture", "i", "j"]
    p, u, e = [F.col(c) for c in "xyz"], [F.col(c) for c in AXES[:3]], [F.col(c) for c in AXES[3:]]
    h = _dot(p, u)
    sent = ways.limit(SENT + 1).count() <= SENT
    d = points.select("capture", "x", "y", "z", "n").join(ways.hint("broadcast" if sent else "shuffle_hash"), "capture").where((h > slab[0]) & (h < slab[1]))
    d = d.select(*key, "n", (_dot(p, e) / cell).alias("a"), (_dot(p, _cross(u, e)) / cell).alias("b"))
    turned = [(math.cos(t), math.sin(t)) for t in plans]
    # one number a cell: both of its own fit in 32 bits, and flat keys are grouped faster than structs
    at = lambda c, s: F.floor(c * F.col("a") + s * F.col("b")) * F.lit(1 << 32) + F.floor(c * F.col("b") - s * F.col("a"))
    d = d.select(*key, "n", F.posexplode(F.array(*[at(c, s) for c, s in turned])).alias("plan", "cell"))
    n = F.col("n").cast("double")
    score = d.groupBy(*key, "plan", "cell").agg(F.sum("n").alias("n")).groupBy(*key).agg((F.sum(n * n) / F.sum(n)).alias("score"))
    return ways.join(score, key)


def up_from_walls(points: DataFrame, priors: DataFrame, save: Callable[[DataFrame], DataFrame], rounds: tuple = ROUNDS) -> DataFrame:
    """(capture, ux, uy, uz, tilt, at_edge): up of each capture, its angle from the prior in degrees, and whether the cone ended the search.

    ``points`` has capture and x, y, z about the camera, ``priors`` capture and ux, uy, uz, such as the mean up of
    pictures held upright. Each round tries all tilts about the best so far, over all points reduced
    to voxels of half a cell, with their counts; of equal scores the least tilt wins. Captures without points in
    the slab keep their prior, with a tilt of 0; points with nulls or without a prior take no part.
    """
    known = points.select("capture", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    thin = min(cell for _, _, cell in rounds) / 2
    known = save(_voxels(known.withColumn("n", F.lit(1).cast("long")), thin))
    prior = save(frames(priors))
    best = prior
    for half, step, cell in rounds:
        scored = thinness(_voxels(known, cell / 2) if cell / 2 > thin else known, candidates(best, half, step), cell)
        i, j = F.col("i"), F.col("j")
        order = F.struct(F.round("score", 9).alias("s"), (-(i * i + j * j)).alias("t"), (-i).alias("i"), (-j).alias("j"))
        found = scored.groupBy("capture").agg(F.max_by(F.struct(*AXES), order).alias("m"))
        best = save(best.join(found, "capture", "left").select("capture", *[F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) for c in AXES]))
    was = prior.select("capture", *[F.col(c).alias(f"p{c}") for c in AXES[:3]])
    cos = _dot([F.col(c) for c in AXES[:3]], [F.col(f"p{c}") for c in AXES[:3]])
    tilt = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))))
    return best.join(was, "capture").select("capture", *AXES[:3], tilt.alias("tilt"), (tilt >= max(half for half, _, _ in rounds) - AT_EDGE).alias("at_edge"))


def _voxels(points: DataFrame, size: float) -> DataFrame:
    n = F.col("n")
    means = [(F.sum(F.col(c) * n) / F.sum(n)).alias(c) for c in "xyz"]
    d = points.groupBy("capture", *[F.floor(F.col(c) / size).alias(f"i{c}") for c in "xyz"]).agg(F.sum(n).alias("n"), *means)
    return d.select("capture", "x", "y", "z", "n")


def spreads(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, wide, narrow, area): standard deviations along the two widest axes, and whether points spread over an area.

    The eigenvalues of the covariance in closed form, so any number of planes takes one pass of sums. A slab
    through a wall is a line of points and no area, nor are fewer than ten points. Points with nulls take no part.
    """
    d = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    d = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in pairs])
    xx, yy, zz, xy, xz, yz = (F.col(f"v{p}") for p in pairs)
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)
    d = d.withColumns({"mean": mean, "p": p})
    a, b, c, p = xx - F.col("mean"), yy - F.col("mean"), zz - F.col("mean"), F.col("p")
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    half = F.when(p > 0, det / (2 * p * p * p)).otherwise(1.0)
    d = d.withColumn("t", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), half))) / 3)
    first = F.col("mean") + 2 * p * F.cos("t")
    last = F.col("mean") + 2 * p * F.cos(F.col("t") + F.lit(2.0943951023931953))
    side = lambda v: F.sqrt(F.greatest(F.lit(0.0), v))
    d = d.select(*keys, "n", side(first).alias("wide"), side(3 * F.col("mean") - first - last).alias("narrow"))
    return d.withColumn("area", (F.col("n") >= 10) & (F.col("narrow") >= LEAST_SPREAD) & (F.col("narrow") >= LEAST_ASPECT * F.col("wide")))

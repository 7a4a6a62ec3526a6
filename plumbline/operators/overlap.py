"""Depth of pictures taken from one spot, compared where two of them see the same ray.

``pixels`` has room, photo, u, v and z (depth along the axis). ``photos`` has room, photo, f (in
pixels), wide, high and the rotation q of its camera into the room's frame, a unit quaternion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import matching

# Fixed values.
STRIDE = 4
LEAST_DEPTH = 0.3
AHEAD = 0.2
LEAST_SHARE = 0.04
MOST_SPREAD = 0.15
QUARTILES_TO_SIGMA = 1.349


def _turned(q: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    w, a, b, c = q["w"], q["x"], q["y"], q["z"]
    return (
        (1 - 2 * (b * b + c * c)) * x + 2 * (a * b - w * c) * y + 2 * (a * c + w * b) * z,
        2 * (a * b + w * c) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - w * a) * z,
        2 * (a * c - w * b) * x + 2 * (b * c + w * a) * y + (1 - 2 * (a * a + b * b)) * z,
    )


def ratios(pixels: DataFrame, photos: DataFrame, stride: int = STRIDE, least_share: float = LEAST_SHARE) -> DataFrame:
    """(room, i, j, n, share, log_ratio, spread) of pictures i before j that overlap enough.

    Every ``stride``-th pixel of i is looked up in j, where its ray lands. A ray that both see has one
    length, so the logarithm of the two lengths' ratio is their scales' ratio: its median, and the
    distance of its quartiles as a standard deviation. ``share`` is how much of i's pixels were
    compared. Depths of 0.3 m and less, nulls and photos without a rotation take no part.
    Only rays that land in j are shuffled; a pair's are a sixteenth of a picture.
    """
    photos = photos.where("q IS NOT NULL")
    length = lambda u, v, f, wide, high, z: z * F.sqrt(1 + F.pow((u - wide / 2) / f, F.lit(2)) + F.pow((v - high / 2) / f, F.lit(2)))
    seen = pixels.where(f"z > {LEAST_DEPTH} AND NOT isnan(z)").join(photos, ["room", "photo"])
    seen = seen.withColumn("far", length(F.col("u"), F.col("v"), F.col("f"), F.col("wide"), F.col("high"), F.col("z"))).where("far < double('infinity')")
    other = photos.select("room", F.col("photo").alias("j"), F.col("f").alias("fj"), F.col("wide").alias("wj"), F.col("high").alias("hj"), F.col("q").alias("qj"))
    # a room has some twenty pictures, so a pixel of the grid is looked up in ten of them on average
    d = seen.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0)).withColumnRenamed("photo", "i").join(other, "room").where("i < j")
    there = matching.product(matching.inverse(F.col("qj")), F.col("q"))
    x, y, z = _turned(F.col("there"), (F.col("u") - F.col("wide") / 2) / F.col("f"), (F.col("v") - F.col("high") / 2) / F.col("f"), F.lit(1.0))
    d = d.withColumn("there", there).withColumns({"x": x, "y": y, "ahead": z}).where(F.col("ahead") > AHEAD)
    d = d.withColumns({"uj": F.col("x") / F.col("ahead") * F.col("fj") + F.col("wj") / 2, "vj": F.col("y") / F.col("ahead") * F.col("fj") + F.col("hj") / 2})
    d = d.where("uj >= 0 AND uj <= wj - 1 AND vj >= 0 AND vj <= hj - 1")
    total = F.ceil(F.col("wide") / stride) * F.ceil(F.col("high") / stride)
    d = d.select("room", "i", "j", F.rint("uj").cast("long").alias("u"), F.rint("vj").cast("long").alias("v"), "far", total.alias("total"))
    to = seen.select("room", F.col("photo").alias("j"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("far").alias("far_j"))
    d = d.join(to, ["room", "j", "u", "v"]).withColumn("lr", F.log(F.col("far") / F.col("far_j")))
    d = d.groupBy("room", "i", "j").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.percentile("lr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    d = d.withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= least_share)
    return d.select("room", "i", "j", "n", "share", F.col("p")[1].alias("log_ratio"), ((F.col("p")[2] - F.col("p")[0]) / QUARTILES_TO_SIGMA).alias("spread"))


def consistent(pairs: DataFrame, save: Callable[[DataFrame], DataFrame], most: float = MOST_SPREAD) -> tuple[DataFrame, DataFrame]:
    """The pairs that are left, and (room, photo, turn) of the pictures that went, in that order.

    Every turn settles the worst pair of each room whose spread is above ``most`` (ties: the last
    pair): of its two pictures the one goes whose best other pair is worse, none at all being worst.
    If neither is, only the pair goes. All rooms are gone through at once, and a room takes
    as many turns as it has bad pairs at most. ``pairs`` has room, i, j and spread.
    """
    live, gone, turn = save(pairs), [], 0
    while True:
        worst = live.where(F.col("spread") > most).groupBy("room").agg(F.max(F.struct("spread", "i", "j")).alias("bad"))
        worst = save(worst.select("room", F.col("bad.i").alias("bi"), F.col("bad.j").alias("bj")))
        if worst.isEmpty():
            break
        here = live.join(F.broadcast(worst) if worst.limit(100_001).count() <= 100_000 else worst, "room", "left")
        same = (F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj"))
        of = lambda c: F.min(F.when(~same & ((F.col("i") == F.col(c)) | (F.col("j") == F.col(c))), F.col("spread")))
        best = here.where("bi IS NOT NULL").groupBy("room", "bi", "bj").agg(of("bi").alias("of_i"), of("bj").alias("of_j"))
        none = F.lit(float("inf"))
        a, b = F.coalesce("of_i", none), F.coalesce("of_j", none)
        blame = save(best.select("room", "bi", "bj", F.when(a > b, F.col("bi")).when(b > a, F.col("bj")).alias("photo")))
        out = live.join(blame, "room", "left")
        goes = F.when(F.col("photo").isNull(), (F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj"))).otherwise((F.col("i") == F.col("photo")) | (F.col("j") == F.col("photo")))
        live = save(out.where(~F.coalesce(goes, F.lit(False))).select(*pairs.columns))
        gone.append(blame.where("photo IS NOT NULL").select("room", "photo", F.lit(turn).alias("turn")))
        turn += 1
    dropped = gone[0] if gone else pairs.select("room", F.col("i").alias("photo"), F.lit(0).alias("turn")).limit(0)
    for g in gone[1:]:
        dropped = dropped.union(g)
    return live, dropped

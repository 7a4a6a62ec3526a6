"""Surfaces of rooms unrolled from posed pictures: which frames look at which surface, and what each sees of it.

Axes of a world frame: x right, y up, z; a camera looks along its third axis, its second points
down. ``planes`` has capture, surface, kind, origin (ox, oy, oz), unit vectors of increasing column
(ux, uy, uz) and row (vx, vy, vz), the normal into the room (nx, ny, nz), and width and height.
``frames`` has capture, frame, the pose as camera centre (cx, cy, cz) and the rows of the rotation
to the camera (r11 to r33), fx, fy, px, py and the picture's size (wide, high). ``pixels`` of a frame
have capture, frame, row, col, r, g, b (0 to 1) and z, the depth there in metres or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metres, cosines and shares.
MPP = 0.005
LEAST_COS = 0.4
NEAR, FAR = 0.3, 5.0
DEPTH_ABS, DEPTH_REL = 0.10, 0.05
EDGE_ABS, EDGE_REL = 0.08, 0.05
LATTICE = (9, 6)
LIGHT_SPREAD = 0.06
USUAL_HEIGHT = 2.0
SHORTEST_WALL = 0.3
GAINS = (0.7, 1.4)

_XYZ = "xyz"


def planes(rooms: DataFrame) -> DataFrame:
    """Walls with points of their own, the floor, and the ceiling if it was observed, of every room.

    ``rooms`` has capture, room, floor, ceiling (null if not observed) and walls, an array of
    (x0, y0, x1, y1, seen) in plan coordinates, of which the second is -z.
    """
    mean = lambda c: F.expr(f"aggregate(walls, 0D, (a, w) -> a + w.{c}) / size(walls)")
    d = rooms.select("capture", "room", "floor", "ceiling", F.posexplode("walls").alias("k", "w"), mean("x0").alias("mx"), mean("y0").alias("my"))
    dx, dy = F.col("w.x1") - F.col("w.x0"), F.col("w.y1") - F.col("w.y0")
    d = d.withColumn("len", F.hypot(dx, dy)).where((F.col("len") >= SHORTEST_WALL) & F.col("w.seen"))
    tx, ty = dx / F.col("len"), dy / F.col("len")
    inward = tx * (F.col("my") - (F.col("w.y0") + F.col("w.y1")) / 2) - ty * (F.col("mx") - (F.col("w.x0") + F.col("w.x1")) / 2)
    side = F.when(inward < 0, -1.0).otherwise(1.0)
    named = lambda **c: [v.alias(k) if k in ("surface", "kind") else v.cast("double").alias(k) for k, v in c.items()]
    zero, one = F.lit(0.0), F.lit(1.0)
    wall = d.select("capture", "room", *named(
        surface=F.concat_ws("_w", "room", "k"), kind=F.lit("wall"), ox=F.col("w.x0"), oy=F.col("floor"), oz=-F.col("w.y0"), ux=tx, uy=zero, uz=-ty, vx=zero, vy=one, vz=zero,
        nx=-side * ty, ny=zero, nz=-side * tx, width=F.col("len"), height=F.coalesce(F.col("ceiling") - F.col("floor"), F.lit(USUAL_HEIGHT)),
    ))
    end = lambda c, f: f(F.transform("walls", lambda w: w[c]))
    flat = rooms.select("capture", "room", "floor", "ceiling", end("x0", F.array_min).alias("ax"), end("x0", F.array_max).alias("bx"), end("y0", F.array_min).alias("ay"), end("y0", F.array_max).alias("by")).where("ax IS NOT NULL")
    both = F.array(F.struct(F.lit("floor").alias("kind"), F.col("floor").alias("y"), one.alias("up")), F.struct(F.lit("ceiling").alias("kind"), F.col("ceiling").alias("y"), F.lit(-1.0).alias("up")))
    flat = flat.withColumn("s", F.explode(both)).where("s.y IS NOT NULL").select("capture", "room", *named(
        surface=F.concat_ws("_", "room", "s.kind"), kind=F.col("s.kind"), ox=F.col("ax"), oy=F.col("s.y"), oz=-F.col("ay"), ux=one, uy=zero, uz=zero, vx=zero, vy=zero, vz=F.lit(-1.0), nx=zero, ny=F.col("s.up"), nz=zero,
        width=F.col("bx") - F.col("ax"), height=F.col("by") - F.col("ay"),
    ))
    return wall.unionByName(flat)


def _on(s: Column, h: Column) -> list[Column]:
    return [(F.col(f"o{a}") + s * F.col(f"u{a}") + h * F.col(f"v{a}")).alias(a) for a in _XYZ]


def lattice(planes_: DataFrame, columns: int = LATTICE[0], rows: int = LATTICE[1]) -> DataFrame:
    """A few points x, y, z of each surface, from a twentieth of its size to nineteen."""
    at = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: 0.05 + 0.9 * k / (n - 1))
    d = planes_.withColumn("s", F.explode(at(columns))).withColumn("h", F.explode(at(rows)))
    return d.select("capture", "surface", *_on(F.col("s") * F.col("width"), F.col("h") * F.col("height")))


def grid(planes_: DataFrame, mpp: float = MPP) -> DataFrame:
    """A row a pixel of each surface: capture, surface, row, col, the normal, and its middle x, y, z."""
    up_to = lambda c: F.sequence(F.lit(0), F.greatest(F.ceil(F.col(c) / mpp).cast("int") - 1, F.lit(0)))
    d = planes_.withColumn("row", F.explode(up_to("height"))).withColumn("col", F.explode(up_to("width")))
    return d.select("capture", "surface", "row", "col", "nx", "ny", "nz", *_on((F.col("col") + 0.5) * mpp, (F.col("row") + 0.5) * mpp))


def project(points: DataFrame) -> DataFrame:
    """Rows of a point x, y, z with a frame's pose and lens, with zc (distance along the view), dist, and u, v, null behind the camera."""
    rel = [F.col(a) - F.col(f"c{a}") for a in _XYZ]
    cam = [F.col(f"r{i}1") * rel[0] + F.col(f"r{i}2") * rel[1] + F.col(f"r{i}3") * rel[2] for i in (1, 2, 3)]
    d = points.withColumns({"xc": cam[0], "yc": cam[1], "zc": cam[2], "dist": F.sqrt(rel[0] * rel[0] + rel[1] * rel[1] + rel[2] * rel[2])})
    ahead = F.col("zc") > 0
    return d.withColumns({"u": F.when(ahead, F.col("fx") * F.col("xc") / F.col("zc") + F.col("px")), "v": F.when(ahead, F.col("fy") * F.col("yc") / F.col("zc") + F.col("py"))}).drop("xc", "yc")


def in_view(margin: float = 0.0) -> Column:
    """Whether a projected point is in reach and in the picture, ``margin`` pixels off its border."""
    return (F.col("zc") > NEAR) & (F.col("zc") < FAR) & F.col("u").between(margin, F.col("wide") - 1 - margin) & F.col("v").between(margin, F.col("high") - 1 - margin)


def looks_at(lattice_: DataFrame, frames: DataFrame) -> DataFrame:
    """(capture, surface, frame, share): the frames that look at a surface, and at what share of its lattice."""
    seen = project(lattice_.join(frames, "capture")).groupBy("capture", "surface", "frame").agg(F.avg(F.when(in_view(), 1.0).otherwise(0.0)).alias("share"))
    return seen.where("share > 0")


def depth_edges(pixels: DataFrame) -> DataFrame:
    """(capture, frame, row, col): readings at a jump in depth or without depth, and those within two pixels of one."""
    key = ["capture", "frame"]
    here = pixels.select(*key, "row", "col", "z")
    bad = here.where("z IS NULL OR z <= 0").select(*key, "row", "col")
    for dr, dc in ((0, 1), (1, 0)):
        other = here.select(*key, (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("z").alias("z2"))
        jump = here.join(other, [*key, "row", "col"]).where(F.abs(F.col("z") - F.col("z2")) > EDGE_ABS + EDGE_REL * F.least("z", "z2"))
        bad = bad.union(jump.select(*key, "row", "col")).union(jump.select(*key, F.col("row") + dr, F.col("col") + dc))
    steps = F.sequence(F.lit(-2), F.lit(2))
    wide = bad.distinct().withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return wide.select(*key, (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).distinct()


def sightings(grid_: DataFrame, views: DataFrame, frames: DataFrame, pixels: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """A row for each surface pixel and frame that sees it face on: row, col, its colour, weight, light and relief.

    ``views`` says which frames to ask (capture, surface, frame). Where a frame has depth, it must
    agree with the surface; ``edges`` are pixels that do not count.
    """
    d = project(grid_.join(views.select("capture", "surface", "frame"), ["capture", "surface"]).join(frames, ["capture", "frame"]))
    along = sum(((F.col(a) - F.col(f"c{a}")) * F.col(f"n{a}") for a in _XYZ), F.lit(0.0))
    d = d.withColumn("cos", F.abs(along) / F.greatest("dist", F.lit(1e-6))).where(in_view(1.0) & (F.col("cos") > LEAST_COS))
    d = d.withColumns({"prow": F.round("v").cast("int"), "pcol": F.round("u").cast("int")})
    p = pixels.select("capture", "frame", F.col("row").alias("prow"), F.col("col").alias("pcol"), "r", "g", "b", F.col("z").alias("z_seen"))
    d = d.join(p, ["capture", "frame", "prow", "pcol"])
    if edges is not None:
        d = d.join(edges.withColumnRenamed("row", "prow").withColumnRenamed("col", "pcol"), ["capture", "frame", "prow", "pcol"], "left_anti")
    near = F.abs(F.col("z_seen") - F.col("zc")) <= F.greatest(F.lit(DEPTH_ABS), DEPTH_REL * F.col("zc"))
    d = d.where(F.col("z_seen").isNull() | ((F.col("z_seen") > 0) & near))
    weight = F.pow("cos", F.lit(3)) / F.pow(F.greatest("zc", F.lit(0.5)), F.lit(2))
    relief = (F.col("zc") - F.col("z_seen")) * F.col("dist") / F.col("zc") * F.col("cos")
    return d.select("capture", "surface", "frame", "row", "col", "r", "g", "b", weight.alias("weight"), (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("light"), relief.alias("relief"))


def level_exposure(seen: DataFrame, least: int = 500) -> DataFrame:
    """Sightings whose frames are as light as all frames of their pixels are on average, within GAINS; frames of few pixels stay."""
    key = ["capture", "surface"]
    usual = seen.groupBy(*key, "row", "col").agg((F.sum(F.col("weight") * F.col("light")) / F.sum("weight")).alias("usual"))
    by = seen.join(usual, [*key, "row", "col"]).groupBy(*key, "frame").agg(F.avg("usual").alias("want"), F.avg("light").alias("have"), F.count("*").alias("n"))
    gain = F.when(F.col("n") >= least, F.least(F.lit(GAINS[1]), F.greatest(F.lit(GAINS[0]), F.col("want") / F.greatest("have", F.lit(1e-3))))).otherwise(1.0)
    d = seen.join(by.select(*key, "frame", gain.alias("gain")), [*key, "frame"])
    return d.withColumns({c: F.least(F.lit(1.0), F.col(c) * F.col("gain")) for c in "rgb"} | {"light": F.col("light") * F.col("gain")}).drop("gain")


def patches(seen: DataFrame, least_views: int = 2) -> DataFrame:
    """(capture, surface, row, col, r, g, b, views, valid, relief): weighted means of a surface's pixels.

    One pass of sums, so frames can come in any order and a pixel that all frames see is no
    burden. Without depth, a pixel that three views or more see differently light is not valid.
    """
    w = F.col("weight")
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    known = F.col("relief").isNotNull()
    d = seen.groupBy("capture", "surface", "row", "col").agg(
        *[mean(c) for c in "rgb"], F.count("*").alias("views"), F.count_if(known).alias("deep"), mean("light"), (F.sum(w * F.col("light") * F.col("light")) / F.sum(w)).alias("light2"),
        (F.sum(F.when(known, w * F.col("relief"))) / F.sum(F.when(known, w))).alias("relief"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("light2") - F.col("light") * F.col("light")))
    agree = (F.col("deep") == F.col("views")) | (F.col("views") < 3) | (spread <= LIGHT_SPREAD)
    return d.select("capture", "surface", "row", "col", *"rgb", "views", ((F.col("views") >= least_views) & agree).alias("valid"), "relief")


def coverage(patches_: DataFrame, planes_: DataFrame, mpp: float = MPP, least: float = 0.30) -> DataFrame:
    """(capture, surface, seen, note): the share of each surface that was seen, with a note where it is under ``least``."""
    n = patches_.where("valid").groupBy("capture", "surface").agg(F.count("*").alias("n"))
    whole = F.greatest(F.ceil(F.col("width") / mpp), F.lit(1)) * F.greatest(F.ceil(F.col("height") / mpp), F.lit(1))
    d = planes_.join(n, ["capture", "surface"], "left").withColumn("seen", F.coalesce("n", F.lit(0)) / whole)
    return d.select("capture", "surface", "seen", F.when(F.col("seen") < least, F.format_string("%s: only %.0f%% of the surface was seen", "surface", F.col("seen") * 100)).alias("note"))

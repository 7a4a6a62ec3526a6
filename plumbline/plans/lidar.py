"""From a depth camera's walk to the document of its rooms.

What grows with points is aggregated by Spark: voxels, height histograms, and counts by cell,
band and chunk. What is left of a capture, some hundred thousand cells, goes to one task of
numpy for each replicate. Every table is keyed by capture, so that one plan takes many captures.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators import cloud, drift, sequence
from plumbline.operators.outline import Params, rooms
from plumbline.plans import contract, stitching
from plumbline.sources import captures

#: Height bands of walls: from 0.25 m above the floor, 0.15 m each.
BAND_FROM, BAND = 0.25, 0.15
#: Systematic errors of a depth camera: metres, and share of the value.
SYS_ABS, SYS_REL = 0.005, 0.002
#: Share of a room's cells that a ceiling fills; a cupboard's top fills less.
CEILING_SHARE = 0.25


def points(spark: SparkSession, root: str, target: int = 800, chunks: int = 20, voxel: float = 0.02, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cloud, path): voxel centroids capture, chunk, x, y, z, and the camera's places of the frames in use."""
    f = captures.chunked(captures.frames(spark, root), target, chunks)
    px = cloud.confident(captures.depth_pixels(spark, root, f, stride))
    d = cloud.rotate(cloud.back_project(px.join(f.drop("idx"), ["capture", "frame"])))
    cells = [cloud.cell(a, voxel).alias(f"i{a}") for a in "xyz"]
    d = d.groupBy("capture", "chunk", *cells).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return d.select("capture", "chunk", "x", "y", "z"), f.select("capture", "chunk", "idx", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


def _spikes(bins: pd.DataFrame) -> tuple[int, np.ndarray]:
    lo = int(bins["bin"].min())
    n = np.bincount(bins["bin"] - lo, bins["n"])
    return lo, np.convolve(n, np.ones(7), "same")


def floors(points: DataFrame) -> DataFrame:
    """(capture, floor, sharpness, n): the strongest height from the half percent point to 1.2 m above it."""
    bins = points.groupBy("capture", F.floor(F.col("y") / 0.01).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def pick(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lo, s = _spikes(g)
        c = np.cumsum(np.bincount(g["bin"] - lo, g["n"]))
        low = int(np.searchsorted(c, 0.005 * c[-1]))
        at = low + int(s[low : low + 121].argmax())
        return pd.DataFrame({"capture": [key[0]], "guess": [(at + lo + 0.5) * 0.01], "n": [int(c[-1])], "sharpness": [s[at] / c[-1]]})

    g = bins.groupBy("capture").applyInPandas(pick, "capture string, guess double, n long, sharpness double")
    near = points.join(g, "capture").where(F.abs(F.col("y") - F.col("guess")) <= 0.03)
    return near.groupBy("capture", "n", "sharpness").agg(F.median("y").alias("floor"))


def ceilings(points: DataFrame, keys: list[str], floor: str = "floor") -> DataFrame:
    """(keys, ceiling, filled): the highest level 1.9 to 5 m above the floor and the cells it fills; keys without one have no row.

    A level counts with a quarter of the strongest one's points and 100 or more.
    """
    h = points.where((F.col("y") - F.col(floor)).between(1.9, 5.0))
    bins = h.groupBy(*keys, F.floor(F.col("y") / 0.01).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def pick(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lo, s = _spikes(g)
        p = np.pad(s, 1)
        top = np.flatnonzero((p[1:-1] >= p[:-2]) & (p[1:-1] > p[2:]) & (s >= max(0.25 * s.max(), 100)))
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "guess": [(t + lo + 0.5) * 0.01 for t in top[-1:]] or [None]})

    types = {f.name: f.dataType.simpleString() for f in points.schema}
    g = bins.groupBy(*keys).applyInPandas(pick, ", ".join(f"{k} {types[k]}" for k in keys) + ", guess double").where("guess IS NOT NULL")
    near = h.join(g, keys).where(F.abs(F.col("y") - F.col("guess")) <= 0.03)
    return near.groupBy(*keys).agg(F.median("y").alias("ceiling"), F.count_distinct("ix", "iz").alias("filled"))


def replicates(count: int, chunks: int, drop: int = 2, seed: int = 0) -> list[tuple[int, int]]:
    """(replicate, chunk) that each replicate keeps; -1 keeps all."""
    rng = np.random.default_rng(seed)
    kept = [(-1, c) for c in range(chunks)]
    for r in range(count):
        out = set(rng.choice(chunks, min(drop, chunks - 1), replace=False).tolist())
        kept += [(r, c) for c in range(chunks) if c not in out]
    return kept


ROOMS = "capture string, replicate int, room int, visits int, area double, floor double, edges array<struct<x0: double, z0: double, x1: double, z1: double, support: double, supported: boolean>>, cells array<struct<ix: long, iz: long>>"


def estimate(points: DataFrame, path: DataFrame, heights: DataFrame, kept: list[tuple[int, int]], p: Params = Params()) -> DataFrame:
    """Rooms of every replicate. Cells are summed by chunk once; no replicate reads the points again."""
    h = F.col("y") - F.col("floor")
    band = F.when(F.abs(h) <= 0.08, -1).when((h >= BAND_FROM) & (h < BAND_FROM + p.bands * BAND), F.floor((h - BAND_FROM) / BAND)).cast("int")
    d = points.join(heights.select("capture", "floor"), "capture").withColumn("band", band).where("band IS NOT NULL")
    d = d.groupBy("capture", "floor", "chunk", cloud.cell("x", p.cell).alias("ix"), cloud.cell("z", p.cell).alias("iz"), "band")
    d = d.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("z").alias("sz"))
    spark = points.sparkSession
    rep = spark.createDataFrame(kept, "replicate int, chunk int")  # replicates times chunks: some hundred rows
    d = d.join(F.broadcast(rep), "chunk").groupBy("capture", "floor", "replicate", "ix", "iz", "band").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sz")])
    wall = F.col("band") >= 0
    d = d.groupBy("capture", "floor", "replicate", "ix", "iz").agg(
        F.count_if(wall & (F.col("n") >= 3)).alias("bands"), F.coalesce(F.sum(F.when(~wall, F.col("n"))), F.lit(0)).alias("floor_n"),
        *[F.coalesce(F.sum(F.when(wall, F.col(c))), F.lit(0)).cast("double").alias(c) for c in ("n", "sx", "sz")],
    )

    def build(key: tuple, cells: pd.DataFrame, walk: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or walk.empty:
            return pd.DataFrame(columns=["capture", "replicate", "room", "visits", "area", "floor", "edges", "cells"])
        n = np.maximum(cells["n"].to_numpy(), 1)
        found = rooms(*[cells[c].to_numpy() for c in ("ix", "iz", "bands", "floor_n")], cells["sx"].to_numpy() / n, cells["sz"].to_numpy() / n, cells["n"].to_numpy(), walk.sort_values("idx")[["x", "z"]].to_numpy(), p)
        return pd.DataFrame([{
            "capture": key[0], "replicate": key[1], "room": k, "visits": r["visits"], "area": r["area"], "floor": cells["floor"].iloc[0],
            "edges": [{"x0": e.p0[0], "z0": e.p0[1], "x1": e.p1[0], "z1": e.p1[1], "support": e.support, "supported": e.line is not None} for e in r["edges"]],
            "cells": [{"ix": int(a), "iz": int(b)} for a, b in r["cells"]],
        } for k, r in enumerate(found)], columns=["capture", "replicate", "room", "visits", "area", "floor", "edges", "cells"])

    walks = path.withColumn("replicate", F.explode(F.array(*[F.lit(r) for r in sorted({r for r, _ in kept})])))
    return d.groupBy("capture", "replicate").cogroup(walks.groupBy("capture", "replicate")).applyInPandas(build, ROOMS)


def interval(samples: DataFrame, keys: list[str], chunks: int, drop: int = 2) -> DataFrame:
    """(keys, lo, hi, stable) from ``value`` and each replicate's ``sample``.

    The half width is 1.96 jackknife deviations and the systematic errors in quadrature. It is
    unstable with fewer than five samples, or where 15 % or more lie over a tenth of the value
    away; the bounds are then stretched to the 5 and 95 percent points. Bounds of a value that
    is not negative are not negative.
    """
    scale = math.sqrt(max(chunks - drop, 1) / drop)
    med = samples.groupBy(*keys, "value").agg(F.median("sample").alias("med"))
    d = samples.join(med.drop("value"), keys)
    far = F.abs(F.col("sample") - F.col("value")) > 0.1 * F.abs(F.col("value"))
    d = d.groupBy(*keys, "value").agg(
        (1.4826 * F.median(F.abs(F.col("sample") - F.col("med")))).alias("sd"), F.count("sample").alias("n"), F.coalesce(F.avg(far.cast("double")), F.lit(0.0)).alias("far"),
        *[F.expr(f"percentile(sample, {q})").alias(a) for a, q in (("p5", 0.05), ("p95", 0.95))],
    )
    v = F.col("value")
    half = F.sqrt(F.pow(1.96 * scale * F.coalesce("sd", F.lit(0.0)), F.lit(2)) + SYS_ABS**2 + F.pow(SYS_REL * v, F.lit(2)))
    stable = (F.col("n") >= 5) & (F.col("far") < 0.15)
    lo, hi = F.when(stable, v - half).otherwise(F.least(v - half, "p5")), F.when(stable, v + half).otherwise(F.greatest(v + half, "p95"))
    return d.select(*keys, F.when(v >= 0, F.greatest(lo, F.lit(0.0))).otherwise(lo).alias("lo"), hi.alias("hi"), stable.alias("stable"))


def matched(est: DataFrame) -> DataFrame:
    """(capture, replicate, other, room): the replicate's room over half of whose union with a room is shared."""
    c = est.select("capture", "replicate", "room", F.size("cells").alias("size"), F.explode("cells").alias("c"))
    a = c.where("replicate = -1").select("capture", "room", F.col("size").alias("size_a"), "c")
    b = c.where("replicate >= 0").select("capture", "replicate", F.col("room").alias("other"), F.col("size").alias("size_b"), "c")
    d = a.join(b, ["capture", "c"]).groupBy("capture", "replicate", "room", "other", "size_a", "size_b").agg(F.count("*").alias("both"))
    return d.where(F.col("both") > 0.5 * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("capture", "replicate", "room", "other")


def _line(e: str) -> dict:
    dx, dz = F.col(f"{e}.x1") - F.col(f"{e}.x0"), F.col(f"{e}.z1") - F.col(f"{e}.z0")
    n = F.hypot(dx, dz)
    return {"tx": dx / n, "tz": dz / n, "len": n}


def wall_samples(est: DataFrame, match: DataFrame, max_offset: float = 0.15, min_cos: float = 0.98) -> DataFrame:
    """(capture, room, wall, value, sample): of each replicate the wall on the same line that shares most of its length."""
    full = est.where("replicate = -1").select("capture", "room", F.posexplode("edges").alias("wall", "a"))
    other = est.where("replicate >= 0").select("capture", "replicate", F.col("room").alias("other"), F.explode("edges").alias("b"))
    d = full.join(match, ["capture", "room"]).join(other, ["capture", "replicate", "other"])
    a, b = _line("a"), _line("b")
    along = lambda p: (F.col(f"b.x{p}") - F.col("a.x0")) * a["tx"] + (F.col(f"b.z{p}") - F.col("a.z0")) * a["tz"]
    off = F.abs(((F.col("b.x0") + F.col("b.x1")) / 2 - F.col("a.x0")) * a["tz"] - ((F.col("b.z0") + F.col("b.z1")) / 2 - F.col("a.z0")) * a["tx"])
    shared = F.least(a["len"], F.greatest(along(0), along(1))) - F.greatest(F.lit(0.0), F.least(along(0), along(1)))
    ok = (F.abs(a["tx"] * b["tx"] + a["tz"] * b["tz"]) >= min_cos) & (off <= max_offset) & (shared >= 0.5 * F.least(a["len"], b["len"]))
    best = d.where(ok).groupBy("capture", "room", "wall", "replicate").agg(F.max(F.struct(shared.alias("s"), b["len"].alias("sample"))).alias("m"))
    value = full.select("capture", "room", "wall", a["len"].alias("value"))
    return value.join(best.select("capture", "room", "wall", "m.sample"), ["capture", "room", "wall"], "left")


def openings(points: DataFrame, heights: DataFrame, edges: DataFrame, least: float = 0.55, most: float = 1.8, width: float = 0.01, band: float = 0.08, cell: float = 0.05) -> DataFrame:
    """(capture, room, wall, t0, t1): stretches of supported walls with hardly any points, as wide as doorways.

    Walls meet points by cells along them, not pair by pair. Stretches at a wall's ends are no doorways.
    """
    e = edges.where("supported")
    ux, uz = (F.col("x1") - F.col("x0")) / F.col("len"), (F.col("z1") - F.col("z0")) / F.col("len")
    at = e.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("len") / (cell / 2)).cast("int")), lambda k: k * (cell / 2))))
    at = at.withColumn("o", F.explode(F.array(*[F.lit(k * cell / 2) for k in range(-4, 5)])))
    px, pz = F.col("x0") + F.col("t") * ux - F.col("o") * uz, F.col("z0") + F.col("t") * uz + F.col("o") * ux
    place = ["capture", "room", "wall", "x0", "z0", "x1", "z1", "len"]
    at = at.select(*place, cloud.cell(px, cell).alias("ix"), cloud.cell(pz, cell).alias("iz")).distinct()
    h = F.col("y") - F.col("floor")
    p = points.join(heights.select("capture", "floor"), "capture").where((h >= BAND_FROM) & (h < 2.0)).select("capture", "x", "z", cloud.cell("x", cell).alias("ix"), cloud.cell("z", cell).alias("iz"))
    d = at.join(p, ["capture", "ix", "iz"])
    t = (F.col("x") - F.col("x0")) * ux + (F.col("z") - F.col("z0")) * uz
    off = F.abs((F.col("x") - F.col("x0")) * uz - (F.col("z") - F.col("z0")) * ux)
    key = ["capture", "room", "wall"]
    n = d.where((off <= band) & (t >= 0) & (t < F.col("len"))).groupBy(*key, F.floor(t / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = e.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / width).cast("long"))).alias("bin")).join(n, [*key, "bin"], "left")
    s = bins.withColumn("s", F.avg(F.coalesce("n", F.lit(0))).over(W.partitionBy(*key).orderBy("bin").rowsBetween(-2, 2)))
    usual = s.where("s > 0").groupBy(*key).agg(F.median("s").alias("m"), F.min("bin").alias("a"), F.max("bin").alias("z"))
    low = s.join(usual, key).where((F.col("s") < 0.5 * F.col("m")) & F.col("bin").between(F.col("a"), F.col("z")))
    runs = sequence.islands(low, key, "bin").select(*key, (F.col("first") * width).alias("t0"), ((F.col("last") + 1) * width).alias("t1"))
    return runs.where((F.col("t1") - F.col("t0")).between(least, most))


def plan(cloud_: DataFrame, path: DataFrame, save, tier: str = "lidar", reps: int = 20, chunks: int = 20, seed: int = 0, p: Params = Params()) -> DataFrame:
    """One row a capture in the contract's type. ``save`` writes a table and reads it again.

    A capture without rooms has an empty array and a note. Plan coordinates are (x, -z).
    """
    points = save(cloud_)
    heights = save(floors(points))
    est = save(estimate(points, path, heights, replicates(reps, chunks, seed=seed), p))
    full = est.where("replicate = -1")
    match = save(matched(est))

    cells = full.select("capture", "room", "floor", F.explode("cells").alias("c")).select("capture", "room", "floor", "c.ix", "c.iz")
    inside = points.withColumns({"ix": cloud.cell("x", p.cell), "iz": cloud.cell("z", p.cell)}).join(cells, ["capture", "ix", "iz"])
    top = ceilings(inside, ["capture", "room"]).join(full.select("capture", "room", F.size("cells").alias("size")), ["capture", "room"])
    top = top.where(F.col("filled") >= CEILING_SHARE * F.col("size")).drop("filled", "size")
    area = full.select("capture", "room", F.col("area").alias("value"))
    samples = area.join(match.join(est.select("capture", "replicate", F.col("room").alias("other"), F.col("area").alias("sample")), ["capture", "replicate", "other"]).select("capture", "room", "sample"), ["capture", "room"], "left")
    areas = interval(samples, ["capture", "room"], chunks)
    walls = interval(wall_samples(est, match), ["capture", "room", "wall"], chunks)

    rid = F.format_string("room_%d", "room")
    pt = lambda x, z: F.struct(F.bround(x, 4).alias("x"), F.bround(-z, 4).alias("y"))
    edges = save(full.select("capture", "room", F.posexplode("edges").alias("wall", "e")).select("capture", "room", "wall", "e.*").withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0"))))
    wid = F.format_string("r%d_w%d", "room", "wall")
    # the plan's second axis is -z, so what ran with its inside to the left is turned round
    w = edges.join(walls, ["capture", "room", "wall"], "left").withColumn("w", F.struct(
        wid.alias("id"), pt(F.col("x1"), F.col("z1")).alias("start"), pt(F.col("x0"), F.col("z0")).alias("end"),
        contract.measurement(F.col("len"), F.col("lo"), F.col("hi"), "m", "wall line", F.when(~F.col("stable"), "unstable between replicates")).alias("length"),
        F.when(F.col("supported"), "wall_points").otherwise("closure").alias("evidence"),
    ))
    w = w.groupBy("capture", "room").agg(F.transform(F.sort_array(F.collect_list(F.struct("wall", "w")), asc=False), lambda s: s["w"]).alias("walls"))
    o = openings(points, heights, edges).join(edges, ["capture", "room", "wall"])
    ux, uz = (F.col("x1") - F.col("x0")) / F.col("len"), (F.col("z1") - F.col("z0")) / F.col("len")
    on = lambda t: pt(F.col("x0") + t * ux, F.col("z0") + t * uz)
    size = F.col("t1") - F.col("t0")
    o = o.withColumn("k", F.row_number().over(W.partitionBy("capture", "room").orderBy("wall", "t0")) - 1).withColumn("o", F.struct(
        F.format_string("r%d_o%d", "room", "k").alias("id"), F.lit("doorway").alias("kind"), wid.alias("wall_id"), on(F.col("t0")).alias("start"), on(F.col("t1")).alias("end"),
        on((F.col("t0") + F.col("t1")) / 2).alias("centre"), contract.measurement(size, size - 0.02, size + 0.02, "m", "gap in wall points").alias("width"), F.lit(None).cast("string").alias("note"),
    ))
    o = o.groupBy("capture", "room").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o"))), lambda s: s["o"]).alias("openings"))

    key = ["capture", "room"]
    r = full.join(w, key).join(o, key, "left").join(areas, key, "left").join(top, key, "left")
    tall = F.col("ceiling") - F.col("floor")
    none = lambda f: F.array().cast(contract.field("rooms").elementType[f].dataType)
    room = F.struct(
        rid.alias("id"), rid.alias("name"), F.lit("capture").alias("frame"), F.transform("walls", lambda x: x["start"]).alias("polygon"), "walls",
        contract.measurement(tall, tall - 0.015, tall + 0.015, "m", "height of ceiling over floor", F.when(tall.isNull(), "ceiling not observed")).alias("ceiling_height"),
        contract.measurement(F.col("area"), F.col("lo"), F.col("hi"), "m2", "outline", F.when(~F.col("stable"), "unstable between replicates")).alias("floor_area"),
        F.coalesce("openings", none("openings")).alias("openings"), *[none(f).alias(f) for f in ("stations", "damage", "concealed_flags", "scope")],
        F.array_compact(F.array(F.when(tall.isNull(), "ceiling not observed"), F.when(F.exists("walls", lambda x: x["evidence"] != "wall_points"), "some walls have no points of their own"))).alias("flags"),
    )
    r = r.groupBy("capture").agg(F.transform(F.array_sort(F.collect_list(F.struct("room", room.alias("r")))), lambda s: s["r"]).alias("rooms"))
    d = path.groupBy("capture").agg(F.count("*").cast("int").alias("frames")).join(heights, "capture", "left").join(r, "capture", "left")
    diagnostics = F.struct(
        F.col("frames").alias("frames_used"), F.col("n").alias("points"), F.col("floor").alias("floor_height_world"), F.col("sharpness").alias("floor_sharpness"), F.lit(reps).alias("bootstrap_replicates"),
        F.lit(seed).alias("seed"), F.lit(None).alias("seconds"), F.lit("x right, y up, metres; plan (x, -z)").alias("conventions"), F.array().alias("models"), F.lit("depth camera").alias("scale_method"), F.lit(1.0).alias("scale_factor"),
        F.lit(None).alias("scale_rel_sigma"), F.array_compact(F.array(F.when(F.col("rooms").isNull(), "no room was found"))).alias("notes"),
    )
    return d.select(
        F.lit(contract.VERSION).alias("schema_version"), "capture", F.lit(tier).alias("tier"), F.lit("m").alias("units"),
        F.coalesce("rooms", F.array()).cast(contract.field("rooms")).alias("rooms"), F.lit(None).cast(contract.field("stitching")).alias("stitching"), diagnostics.cast(contract.field("diagnostics")).alias("diagnostics"),
    )


def run(spark: SparkSession, root: str, save, correct_drift: bool = True, **options) -> DataFrame:
    """The documents of all captures below ``root``, which may be a glob, with what their rooms make together."""
    chunks = options.get("chunks", 20)
    c, path = points(spark, root, chunks=chunks)
    if correct_drift:
        c = save(c)
        shifts = save(drift.estimate(drift.wall_cells(c, floors(c)), chunks))
        c, path = drift.correct(c, shifts), drift.correct(path, shifts)
    return stitching.describe(save(plan(c, path, save, **options)))

"""What the rooms of a capture make together: doorway links, shared floor and the footprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import placing, settling
from plumbline.plans import contract

#: What a document says of drift where rooms were placed by their doorways.
PLACED = "rooms lie in frames of their own and are placed by their doorways, so drift does not add up from room to room; a place errs by its doorway and by the thickness taken for the wall"


def tables(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, doors) of documents, as the operators on rooms take them."""
    r = plans.select("capture", F.explode("rooms").alias("r")).select("capture", F.col("r.id").alias("room"), "r.polygon", "r.openings")
    after = F.get("polygon", F.pmod(F.col("seq") + 1, F.size("polygon")))
    e = r.select("capture", "room", "polygon", F.posexplode("polygon").alias("seq", "p"))
    e = e.select("capture", "room", "seq", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), after["x"].alias("x1"), after["y"].alias("y1"))
    d = r.select("capture", "room", F.posexplode("openings").alias("seq", "o"))
    return e, d.select("capture", "room", "seq", F.col("o.id").alias("opening"), F.col("o.centre.x").alias("x"), F.col("o.centre.y").alias("y"), F.col("o.width.value").alias("width"))


def _moved(room: Column, at: Column) -> Column:
    """A room's outline, walls, openings and stations in the shared frame; as it is without a place."""
    c, s = F.cos(at["angle"]), F.sin(at["angle"])
    pt = lambda p: F.struct((c * p["x"] - s * p["y"] + at["shift"]["x"]).alias("x"), (s * p["x"] + c * p["y"] + at["shift"]["y"]).alias("y"))
    points = lambda v, *names: [v := v.withField(n, pt(v[n])) for n in names][-1]
    new = room.withField("frame", F.lit("capture")).withField("polygon", F.transform(room["polygon"], pt))
    new = new.withField("walls", F.transform(room["walls"], lambda w: points(w, "start", "end")))
    new = new.withField("openings", F.transform(room["openings"], lambda o: points(o, "start", "end", "centre")))
    new = new.withField("stations", F.transform(room["stations"], lambda p: points(p, "position")))
    return F.when(at.isNotNull(), new).otherwise(room)


def place(plans: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents whose rooms came in frames of their own, placed by their doorways, settled over all of them at once and described.

    Rooms without a place stay as they are, are named as unplaced and take no part in the footprint.
    """
    edges, doors = tables(plans)
    return describe(plans, save(settling.refine(edges, doors, save(placing.glue(edges, doors)))))


def describe(plans: DataFrame, placements: DataFrame | None = None) -> DataFrame:
    """Documents with their stitching: the footprint's bounds are as wide, in proportion, as those of all rooms' areas."""
    columns, drift = plans.columns, F.lit(None).cast("string")
    if placements is not None:
        p = placements.select("capture", "placed", F.struct("room", "angle", F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")).alias("shift"), "host", "host_opening", "opening", "overlap", "width_diff", "margin").alias("p"))
        here = lambda cond, v: F.array_sort(F.collect_list(F.when(cond, v)))
        p = p.groupBy("capture").agg(here(F.col("placed"), F.col("p")).alias("placements"), here(~F.col("placed"), F.col("p.room")).alias("unplaced"))
        spot = lambda r: F.get(F.filter("placements", lambda x: x["room"] == r["id"]), F.lit(0))
        plans = plans.join(p, "capture", "left").withColumn("rooms", F.transform("rooms", lambda r: _moved(r, spot(r))))
        drift = F.when(F.size("placements") > 1, PLACED)
    edges, doors = tables(plans)
    if placements is not None:
        there = placements.where("placed").select("capture", "room")
        edges, doors = (d.join(there, ["capture", "room"], "left_semi") for d in (edges, doors))
    runs = placing.floor_runs(edges)
    links = placing.adjacency(doors, edges).groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("room", "opening", "other", "gap", "mutual"))).alias("links"))
    shared = placing.overlaps(runs).groupBy("capture").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("neg"), "a", "b", "area"))), lambda s: F.struct(s["a"], s["b"], s["area"])).alias("overlaps"))
    d = plans.join(placing.footprint(runs), "capture", "left").join(links, "capture", "left").join(shared, "capture", "left")
    total = lambda f: F.aggregate(F.transform("rooms", lambda r: F.coalesce(r["floor_area"][f], r["floor_area"]["value"], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    part = lambda f: F.when(total("value") > 0, F.col("area") * total(f) / total("value"))
    t = contract.field("stitching")
    empty = lambda c: F.coalesce(c, F.array().cast(t[c].dataType)) if c in d.columns else F.array().cast(t[c].dataType)
    s = F.struct(
        contract.measurement(F.col("area"), part("lo"), part("hi"), "m2", "floor under all rooms, shared floor once", F.when(F.col("area").isNull(), "no room was found")).alias("footprint"),
        empty("links").cast(t["links"].dataType).alias("links"), empty("placements").alias("placements"), empty("overlaps").cast(t["overlaps"].dataType).alias("overlaps"), empty("unplaced").alias("unplaced"), drift.alias("drift"),
    )
    return d.withColumn("stitching", s.cast(t)).select(columns)

"""The document of a capture, as one nested type. A quantity that was not measured is null with a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "0.4.0"
POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
MEASUREMENT = "STRUCT<value: DOUBLE, lo: DOUBLE, hi: DOUBLE, unit: STRING, method: STRING, note: STRING>"
SURFACE = "STRUCT<kind: STRING, id: STRING>"
WALL = f"STRUCT<id: STRING, start: {POINT}, end: {POINT}, length: {MEASUREMENT}, evidence: STRING>"
OPENING = f"STRUCT<id: STRING, kind: STRING, wall_id: STRING, start: {POINT}, end: {POINT}, centre: {POINT}, width: {MEASUREMENT}, note: STRING>"
STATION = f"STRUCT<position: {POINT}, height_above_floor: DOUBLE>"
DAMAGE = f"STRUCT<id: STRING, surface: {SURFACE}, damage_class: STRING, class_confidence: DOUBLE, polygon: ARRAY<{POINT}>, centre: {POINT}, width: {MEASUREMENT}, height: {MEASUREMENT}, length: {MEASUREMENT}, area: {MEASUREMENT}, evidence: STRING>"
FLAG = f"STRUCT<id: STRING, rule: STRING, surface: {SURFACE}, damage_ids: ARRAY<STRING>, reason: STRING>"
SCOPE = f"STRUCT<id: STRING, surface: {SURFACE}, damage_ids: ARRAY<STRING>, action: STRING, quantity: {MEASUREMENT}>"
ROOM = f"STRUCT<id: STRING, name: STRING, frame: STRING, polygon: ARRAY<{POINT}>, walls: ARRAY<{WALL}>, ceiling_height: {MEASUREMENT}, floor_area: {MEASUREMENT}, openings: ARRAY<{OPENING}>, stations: ARRAY<{STATION}>, damage: ARRAY<{DAMAGE}>, concealed_flags: ARRAY<{FLAG}>, scope: ARRAY<{SCOPE}>, flags: ARRAY<STRING>>"
LINK = "STRUCT<room: STRING, opening: STRING, other: STRING, gap: DOUBLE, mutual: BOOLEAN>"
PLACEMENT = f"STRUCT<room: STRING, angle: DOUBLE, shift: {POINT}, host: STRING, host_opening: STRING, opening: STRING, overlap: DOUBLE, width_diff: DOUBLE, margin: DOUBLE>"
OVERLAP = "STRUCT<a: STRING, b: STRING, area: DOUBLE>"
STITCHING = f"STRUCT<footprint: {MEASUREMENT}, links: ARRAY<{LINK}>, placements: ARRAY<{PLACEMENT}>, overlaps: ARRAY<{OVERLAP}>, unplaced: ARRAY<STRING>, drift: STRING>"
DIAGNOSTICS = "STRUCT<frames_used: INT, points: BIGINT, floor_height_world: DOUBLE, floor_sharpness: DOUBLE, bootstrap_replicates: INT, seed: BIGINT, seconds: DOUBLE, conventions: STRING, models: ARRAY<STRING>, scale_method: STRING, scale_factor: DOUBLE, scale_rel_sigma: DOUBLE, notes: ARRAY<STRING>>"
PLAN = f"schema_version STRING, capture STRING, tier STRING, units STRING, rooms ARRAY<{ROOM}>, stitching {STITCHING}, diagnostics {DIAGNOSTICS}"


def schema() -> T.StructType:
    """The document's type; its text is read by a running session."""
    return T.StructType.fromDDL(PLAN)


def field(name: str) -> T.DataType:
    return schema()[name].dataType


def measurement(value: Column, lo: Column, hi: Column, unit: str, method: str, note: Column | None = None) -> Column:
    """Rounded to 4 places, halves to even; without a value there are no bounds and a note says why."""
    r = lambda c: F.when(value.isNotNull(), F.bround(c.cast("double"), 4))
    return F.struct(
        F.bround(value.cast("double"), 4).alias("value"), r(lo).alias("lo"), r(hi).alias("hi"), F.lit(unit).alias("unit"),
        F.lit(method).alias("method"), (F.lit(None).cast("string") if note is None else note.cast("string")).alias("note"),
    )


def widen(m: Column, *relative: float) -> Column:
    """A measurement whose half widths take up further errors, as shares of its value, in quadrature."""
    extra = sum(r * r for r in relative)
    half = lambda h: F.sqrt(h * h + extra * m["value"] * m["value"])
    return m.withField("lo", m["value"] - half(m["value"] - m["lo"])).withField("hi", m["value"] + half(m["hi"] - m["value"]))


def write(plans: DataFrame, path: str) -> None:
    """One line of JSON a capture, with its nulls: they say what was not measured."""
    plans.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary(plans: DataFrame) -> DataFrame:
    """(capture, room, class, n): findings of each room; a room without any has one row with a null class."""
    r = plans.select("capture", F.explode("rooms").alias("r"))
    d = r.select("capture", F.col("r.id").alias("room"), F.explode_outer("r.damage").alias("d"))
    return d.groupBy("capture", "room", F.col("d.damage_class").alias("class")).agg(F.count("d").alias("n"))


def drawing(plans: DataFrame, pixels: float = 60.0) -> DataFrame:
    """(capture, svg): outlines, walls and doorways; dashed walls have no points of their own."""
    xy = lambda p: F.format_string("%.1f,%.1f", p["x"] * pixels, -p["y"] * pixels)
    metres = lambda m: F.coalesce(F.format_string("%.2f m", m["value"]), F.lit("n/a"))
    line = lambda a, b, style: F.concat(F.lit('<path d="M'), xy(a), F.lit(" L"), xy(b), F.lit(f'" {style}/>'))

    def draw(r: Column) -> Column:
        walls = F.transform(r["walls"], lambda w: F.concat(
            F.when(w["evidence"] == "wall_points", line(w["start"], w["end"], 'stroke="black"')).otherwise(line(w["start"], w["end"], 'stroke="black" stroke-dasharray="4"')),
            F.format_string('<text x="%.1f" y="%.1f">%s</text>', (w["start"]["x"] + w["end"]["x"]) * pixels / 2, -(w["start"]["y"] + w["end"]["y"]) * pixels / 2, metres(w["length"])),
        ))
        doors = F.transform(r["openings"], lambda o: line(o["start"], o["end"], 'stroke="orange" stroke-width="4"'))
        return F.concat(F.lit('<polygon fill="#eee" points="'), F.array_join(F.transform(r["polygon"], xy), " "), F.lit('"/>'), F.array_join(walls, ""), F.array_join(doors, ""))

    xs, ys = (F.flatten(F.transform("rooms", lambda r: F.transform(r["polygon"], lambda p: s * p[a] * pixels))) for a, s in (("x", 1), ("y", -1)))
    box = F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.1f %.1f %.1f %.1f" font-size="12">',
        F.coalesce(F.array_min(xs), F.lit(0.0)) - 20, F.coalesce(F.array_min(ys), F.lit(0.0)) - 20,
        F.coalesce(F.array_max(xs) - F.array_min(xs), F.lit(0.0)) + 40, F.coalesce(F.array_max(ys) - F.array_min(ys), F.lit(0.0)) + 40,
    )
    return plans.select("capture", F.concat(box, F.array_join(F.transform("rooms", draw), ""), F.lit("</svg>")).alias("svg"))

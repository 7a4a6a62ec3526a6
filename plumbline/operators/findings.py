"""What damage means: classes, flags of damage out of sight, and lines of repair work.

``damage`` has a row a region: capture, room, id, kind (wall, ceiling or floor), surface,
class, x, y (on walls along and up, else plan coordinates) and nullable length, area, lo, hi.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.placing import edge_distance

# Limits of the rules in metres, their names, and the action and unit of each class.
LONG_CRACK = 0.5
LOW_ON_WALL = 0.6
LEAK_PATH = 0.8
SHARED_WALL = 0.4
ACTIONS = [
    ("water_stain", "Find and stop the moisture source, dry, seal and repaint", "m2"),
    ("mould", "Treat and clean the mould, then seal and repaint", "m2"),
    ("structural_crack", "Rout, fill and repaint the crack, and check its cause", "m"),
    ("peeling_paint", "Scrape back to sound paint, prime and repaint", "m2"),
    ("soot_or_fire", "Clean or seal the soot, then repaint", "m2"),
    ("efflorescence", "Brush off the salts, treat the wall and repaint", "m2"),
    ("hole_or_impact", "Patch the hole and repaint", "m2"),
    ("sagging_or_bulging", "Repair or replace the board or plaster and refinish", "m2"),
    ("other_anomaly", "Inspect the mark on site", "m2"),
]
INSPECT = "Open up the surface and inspect behind it"
#: Rules on one region alone: name, condition in SQL.
OWN_RULES = [
    ("ceiling_stain_source_above", "class = 'water_stain' AND kind = 'ceiling'"),
    ("moisture_low_on_wall", f"class IN ('water_stain', 'mould', 'efflorescence') AND kind = 'wall' AND y <= {LOW_ON_WALL}"),
    ("mould_moisture_behind_surface", "class = 'mould'"),
    ("moisture_migrating_through_coating", "class IN ('efflorescence', 'peeling_paint')"),
    ("long_crack_continues_behind_finish", f"class = 'structural_crack' AND length >= {LONG_CRACK}"),
    ("ceiling_sag_water_or_load", "class = 'sagging_or_bulging' AND kind = 'ceiling'"),
    ("wall_bulge_moisture_or_movement", "class = 'sagging_or_bulging' AND kind = 'wall'"),
    ("soot_char_behind_surface", "class = 'soot_or_fire'"),
]

#: Classes by a region's mean deviation in Lab, edge width, texture, solidity and area: the first that holds.
CLASSES = [
    ("soot_or_fire", "dl <= -15 AND sqrt(da * da + db * db) < 5 AND area >= 0.01 AND edge_cm >= 1.0"),
    ("mould", "dl <= -10 AND busy >= 1.8 AND area >= 0.002 AND db < 6 AND sqrt(da * da + db * db) < 25"),
    ("water_stain", "db >= 4 AND dl BETWEEN -35 AND -2 AND edge_cm >= 0.8 AND area >= 0.002"),
    ("peeling_paint", "dl >= 8 AND busy >= 1.5 AND solidity < 0.85"),
    ("efflorescence", "dl >= 5 AND sqrt(a_abs * a_abs + b_abs * b_abs) < 12 AND edge_cm >= 0.8"),
    ("hole_or_impact", "dl <= -30 AND edge_cm < 0.8 AND area <= 0.01"),
]


def on_walls(damage: DataFrame, walls: DataFrame) -> DataFrame:
    """Regions on walls with their plan place px, py; ``walls`` has capture, room, wall, x0, y0, x1, y1."""
    d = damage.where("kind = 'wall'").join(walls.withColumnRenamed("wall", "surface"), ["capture", "room", "surface"])
    n = F.greatest(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(1e-9))
    along = lambda a: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) / n * F.col("x")
    return d.withColumns({"px": along("x"), "py": along("y")}).drop("x0", "y0", "x1", "y1")


def _near(column: str, size: float):
    b = F.floor(F.col(column) / size).cast("long")
    return F.explode(F.array(b - 1, b, b + 1))


def concealed(damage: DataFrame, walls: DataFrame) -> DataFrame:
    """(capture, room, rule, kind, surface, damage_ids, other): each rule that fires, once for the same regions.

    ``other`` is the room behind a shared wall, of several the nearest and then the least. Stains
    meet the stains and walls of their neighbourhood only.
    """
    key = ["capture", "room"]
    none = F.lit(None).cast("string")
    fired = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in OWN_RULES]))
    own = damage.select(*key, F.explode(fired).alias("rule"), "kind", "surface", F.array("id").alias("damage_ids"), none.alias("other"))

    stained = on_walls(damage, walls).where("class = 'water_stain'").select(*key, "id", "kind", "surface", "px", "py")
    above = damage.where("kind = 'ceiling' AND class = 'water_stain'").select(*key, F.col("id").alias("above"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    above = above.withColumns({"bx": F.floor(F.col("cx") / LEAK_PATH).cast("long"), "by": F.floor(F.col("cy") / LEAK_PATH).cast("long")})
    near = stained.withColumn("bx", _near("px", LEAK_PATH)).withColumn("by", _near("py", LEAK_PATH)).join(above, [*key, "bx", "by"])
    near = near.where(F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")) <= LEAK_PATH).groupBy(*key, "id", "kind", "surface").agg(F.array_sort(F.collect_list("above")).alias("above"))
    leak = near.select(*key, F.lit("wall_stain_under_ceiling_stain").alias("rule"), "kind", "surface", F.concat(F.array("id"), "above").alias("damage_ids"), none.alias("other"))

    beside = edge_distance(stained.withColumnRenamed("room", "own"), "px", "py", walls, SHARED_WALL).where("own <> room")
    beside = beside.groupBy("capture", "own", "id", "kind", "surface").agg(F.min(F.struct("distance", "room")).alias("m"))
    shared = beside.select("capture", F.col("own").alias("room"), F.lit("stain_on_shared_wall").alias("rule"), "kind", "surface", F.array("id").alias("damage_ids"), F.col("m.room").alias("other"))
    return own.unionByName(leak).unionByName(shared).dropDuplicates([*key, "rule", "damage_ids"])


def scope(damage: DataFrame, flags: DataFrame) -> DataFrame:
    """(capture, room, kind, surface, damage_ids, action, value, lo, hi, unit): work on each region and each flagged surface.

    A region's quantity is its length or area, null if unknown. An inspection's is the summed
    area of the surface's own flagged regions, unknown ones counting as none.
    """
    key = ["capture", "room", "kind", "surface"]
    actions = damage.sparkSession.createDataFrame(ACTIONS, "class string, action string, unit string")
    by = F.col("unit") == "m"
    repair = damage.join(F.broadcast(actions), "class").select(
        *key, F.array("id").alias("damage_ids"), "action", F.when(by, F.col("length")).otherwise(F.col("area")).alias("value"),
        *[F.when(by, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")], "unit",
    )
    ids = flags.select(*key, F.explode("damage_ids").alias("id")).distinct()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    inspect = damage.withColumnRenamed("area", "value").join(ids, [*key, "id"]).groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("damage_ids"), total("value"), total("lo"), total("hi"))
    inspect = inspect.withColumns({"action": F.lit(INSPECT), "unit": F.lit("m2")})
    return repair.unionByName(inspect)

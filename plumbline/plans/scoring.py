"""Plans held against a tape measure and against each other: one-to-one pairs, errors, gates and their shares."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators import robust

# Fixed values of the gates: centimetres and shares.
CEILING_GATE, OPENING_GATE = 1.5, 2.0
REPEAT_ABS, REPEAT_REL = 1.0, 0.005
PAIRS = "i int, j int, a double, b double"


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(room, item, id, value): tape measures in cm of walls, ceilings, doors, and floor areas in m2 where two sides are given.

    The file is one JSON object with ``rooms``, an object by room; a room has walls, or a width and a
    length for two walls each.
    """
    wall = "ARRAY<STRUCT<id: STRING, length: DOUBLE>>"
    opening = "ARRAY<STRUCT<id: STRING, type: STRING, width: DOUBLE>>"
    room = f"STRUCT<walls: {wall}, width: DOUBLE, length: DOUBLE, ceiling_height: DOUBLE, openings: {opening}>"
    rooms = spark.read.schema(f"rooms MAP<STRING, {room}>").option("multiLine", True).json(path).select(F.explode("rooms").alias("room", "r"))
    sides = F.array(*[F.struct(F.lit(f"{n}{i}").alias("id"), F.col(f"r.{n}").alias("length")) for i, n in enumerate(["width", "length", "width", "length"])])
    item = lambda kind, id_, value: F.struct(F.lit(kind).alias("item"), id_.cast("string").alias("id"), value.cast("double").alias("value"))
    walls = F.transform(F.coalesce("r.walls", sides), lambda w: item("wall", w["id"], w["length"]))
    doors = F.transform(F.filter(F.coalesce("r.openings", F.array().cast(opening)), lambda o: o["type"] == "door"), lambda o: item("door", o["id"], o["width"]))
    area = F.when(F.col("r.walls").isNull(), F.col("r.width") * F.col("r.length") / 1e4)
    rest = F.array(item("ceiling", F.lit(None), F.col("r.ceiling_height")), item("area", F.lit(None), area))
    return rooms.select("room", F.explode(F.concat(walls, doors, rest)).alias("t")).select("room", "t.*").where("value IS NOT NULL")


def largest_rooms(plans: DataFrame) -> DataFrame:
    """(capture, room): each document's room of the largest floor, the first of equal ones; unknown areas count as none."""
    d = plans.select("capture", F.posexplode("rooms").alias("k", "room"))
    best = W.partitionBy("capture").orderBy(F.desc(F.coalesce("room.floor_area.value", F.lit(0.0))), "k")
    return d.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("capture", "room")


def pairs(a: list[float], b: list[float]) -> list[tuple[int, int]]:
    """One-to-one pairs of the shorter list's values with the longer's, of the least summed difference.

    On a line, best pairs never cross: both lists are sorted and the shorter one is laid along the
    longer, each value on the next or on a later one.
    """
    if len(a) > len(b):
        return sorted((j, i) for i, j in pairs(b, a))
    at, to = sorted(range(len(a)), key=a.__getitem__), sorted(range(len(b)), key=b.__getitem__)
    spare = len(b) - len(a)
    # cost[s]: the least sum so far with s of the longer list left out; came[k][s]: left out before the k-th pair
    cost, came = [0.0] * (spare + 1), []
    for k, i in enumerate(at):
        new, back, best = [], [], 0
        for s in range(spare + 1):
            best = s if cost[s] < cost[best] else best
            new.append(cost[best] + abs(a[i] - b[to[k + s]]))
            back.append(best)
        cost = new
        came.append(back)
    s, out = min(range(spare + 1), key=cost.__getitem__), []
    for k in range(len(at) - 1, -1, -1):
        out.append((at[k], to[k + s]))
        s = came[k][s]
    return sorted(out)


def assign(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, i, j, a, b): the pairs of each key's values, with their places in ``order`` on both sides and the values.

    A key's values are a room's walls or doors; keys that one side lacks give no rows. Null values take no part.
    """
    schema = left.select(*keys).schema
    side = lambda d: d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("int").alias("k"), F.col(value).cast("double").alias("v"))))).alias("s"))
    both = side(left).join(side(right).withColumnRenamed("s", "t"), keys)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            got = [(*(r[k] for k in keys), r["s"][i]["k"], r["t"][j]["k"], r["s"][i]["v"], r["t"][j]["v"]) for r in rows for i, j in pairs([x["v"] for x in r["s"]], [x["v"] for x in r["t"]])]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), [*(batch.schema.field(k).type for k in keys), pa.int32(), pa.int32(), pa.float64(), pa.float64()])], names=[*keys, "i", "j", "a", "b"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", " + PAIRS
    return both.mapInArrow(run, out)


def within(tape: Column, got: Column, share: float) -> Column:
    return F.abs(got / tape - 1) <= share


def repeats(a: Column, b: Column) -> Column:
    """Whether two measures in cm agree to 1 cm or half a per cent."""
    return F.abs(b - a) <= F.greatest(F.lit(REPEAT_ABS), REPEAT_REL * a)


def inside(tape: Column, lo: Column, hi: Column) -> Column:
    """'yes' or 'NO', or 'n/a' without an interval."""
    return F.when(lo.isNull() | hi.isNull(), "n/a").when(tape.between(lo, hi), "yes").otherwise("NO")


def stat(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, median, in1, in3, in10): of absolute differences in cm the median and the shares within 1, 3 and 10 cm."""
    d = F.abs(F.col(value))
    share = lambda x: F.avg(F.when(d.isNotNull(), (d <= x).cast("double"))).alias(f"in{x}")
    n = rows.groupBy(*(keys or [])).agg(F.count(value).alias("n"), share(1), share(3), share(10))
    d = robust.same_keys(n, robust.quantiles(rows, d, keys or [], {"median": 0.5}), keys or [], "left")
    return d.select(*(keys or []), "n", "median", "in1", "in3", "in10")


def tally(scored: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """(keys, passed, total): items that pass; a missing or surplus one counts in the total and has a null ``passed``."""
    return scored.groupBy(*keys).agg(F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("passed"), F.count("*").alias("total"))


def score_walls(tape: DataFrame, rooms: DataFrame, share: float = 0.03) -> DataFrame:
    """(capture, id, tape, got, error, passed): each taped wall with the plan's wall that it is paired with, null if none.

    ``tape`` is of ``truth`` with a capture column that says which room a capture is of; ``rooms`` of ``largest_rooms``.
    """
    t = tape.where("item = 'wall'").withColumn("k", F.row_number().over(W.partitionBy("capture").orderBy("id")).cast("int"))
    got = rooms.select("capture", F.posexplode("room.walls").alias("k", "w")).select("capture", "k", (F.col("w.length.value") * 100).alias("value"))
    p = assign(t, got, ["capture"], "k", "value").select("capture", F.col("i").alias("k"), F.col("b").alias("got"))
    d = t.join(p, ["capture", "k"], "left")
    return d.select("capture", "id", F.col("value").alias("tape"), "got", (F.col("got") / F.col("value") - 1).alias("error"), within(F.col("value"), F.col("got"), share).alias("passed"))


def repeatability(a: DataFrame, b: DataFrame) -> DataFrame:
    """(capture, i, j, a, b, passed): walls of the largest rooms of two walks of one place, in cm, paired by length."""
    side = lambda rooms: rooms.select("capture", F.posexplode("room.walls").alias("k", "w")).select("capture", "k", (F.col("w.length.value") * 100).alias("value"))
    return assign(side(a), side(b), ["capture"], "k", "value").withColumn("passed", repeats(F.col("a"), F.col("b")))


def reframed(damage: DataFrame, moves: DataFrame) -> DataFrame:
    """Damage on ceilings and floors where its room has moved to; on walls it moves with the wall.

    ``moves`` has capture, room and the walls before and after: k, ax, ay, bx, by and qax, qay, qbx,
    qby. The first wall over 0.3 m says how a room moved; if its length changed by more than 5 cm,
    the room's damage stays.
    """
    n, m = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), F.hypot(F.col("qbx") - F.col("qax"), F.col("qby") - F.col("qay"))
    walls = moves.withColumns({"n": n, "m": m}).where("n > 0.3")
    first = walls.groupBy("capture", "room").agg(F.min_by(F.struct("ax", "ay", "bx", "by", "qax", "qay", "qbx", "qby", "n", "m"), "k").alias("w")).select("capture", "room", "w.*").where("abs(m - n) <= 0.05")
    turn = F.atan2(F.col("qby") - F.col("qay"), F.col("qbx") - F.col("qax")) - F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    first = first.withColumn("turn", turn).select("capture", "room", F.cos("turn").alias("c"), F.sin("turn").alias("s"), "ax", "ay", "qax", "qay")
    d = damage.join(first, ["capture", "room"], "left")
    u, v = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    moved = F.col("kind").isin("ceiling", "floor") & F.col("c").isNotNull()
    x, y = F.bround(F.col("c") * u - F.col("s") * v + F.col("qax"), 4), F.bround(F.col("s") * u + F.col("c") * v + F.col("qay"), 4)
    return d.withColumns({"x": F.when(moved, x).otherwise(F.col("x")), "y": F.when(moved, y).otherwise(F.col("y"))}).drop("c", "s", "ax", "ay", "qax", "qay")


def renumbered(id_: Column, k: Column) -> Column:
    """An id of room 0 as one of room k: room_0 and r0_ at its start."""
    of = F.when(id_.rlike("^room_0(?![0-9])"), F.concat(F.lit("room_"), k.cast("string"), F.substring(id_, 7, 1000))).when(id_.rlike("^r0_"), F.concat(F.lit("r"), k.cast("string"), F.substring(id_, 3, 1000)))
    return of.otherwise(id_)

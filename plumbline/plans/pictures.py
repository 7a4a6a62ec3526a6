"""More registered queries: colours, damage, projections, scores and heights over the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.tables import writer
from plumbline.operators import alignment, cloud, damage, fan, findings, grid, heights, levelling, matching, overlap, rules, settling, sharpness, strips, surfaces
from plumbline.plans import scoring
from plumbline.plans.catalog import CLOUD, _cloud, _t, query


def _lin(c):
    return f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


def _f(t):
    return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END"


@query(f"""WITH p AS (SELECT l_linenumber AS surface, floor(l_quantity / 2)::INT AS i, floor(floor(l_extendedprice / 1000) / 2)::INT AS j, l_discount * 10 AS r, l_tax * 12.5 AS g, l_quantity / 50 AS b, l_returnflag <> 'R' AS valid FROM lineitem),
n AS (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM p), m AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS x, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM n),
f AS (SELECT *, {_f('x')} AS fx, {_f('y')} AS fy, {_f('z')} AS fz FROM m)
SELECT surface, i, j, count(*)::BIGINT AS n, count(*) FILTER (valid)::BIGINT AS seen, round(avg(116 * fy - 16) FILTER (valid), 4) AS l, round(avg(500 * (fx - fy)) FILTER (valid), 4) AS a, round(avg(200 * (fy - fz)) FILTER (valid), 4) AS b FROM f GROUP BY surface, i, j""")
def q62_lab_cells(spark, sf):
    """Order lines as pixels: Lab means of valid ones in cells of two by two."""
    p = _t(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("surface"), F.floor("l_quantity").cast("int").alias("row"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("col"),
        (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 12.5).alias("g"), (F.col("l_quantity") / 50).alias("b"), (F.col("l_returnflag") != "R").alias("valid"), F.lit(None).cast("double").alias("relief"),
    )
    d = damage.lab_cells(p, 0.005, 0.01, ("surface",))
    return d.select("surface", "i", "j", "n", "seen", *[F.round(c, 4).alias(c) for c in "lab"])


_FEATURES = {
    "dl": "l_quantity - 40", "da": "100 * l_tax - 4", "db": "100 * l_discount - 5", "a_abs": "100 * l_tax - 2", "b_abs": "100 * l_discount", "area": "l_extendedprice / 1e6", "solidity": "0.4 + l_tax * 7", "edge_cm": "l_suppkey % 11",
    "busy": "0.5 + l_partkey % 5 * 0.5", "length": "l_extendedprice / 2e5", "breadth": "l_quantity / 500", "rms": "l_discount / 10", "axis": "l_suppkey % 7", "bump": "l_tax / 3", "ring": "l_partkey % 12", "share": "l_discount * 4",
    "fill": "0.6 + l_tax * 5", "tilt": "l_partkey % 8", "side": "l_quantity / 200", "unseen": "l_discount * 5", "centre_h": "l_quantity / 25",
}
_PROPOSAL = "CASE l_orderkey % 8 WHEN 0 THEN 'pit' WHEN 1 THEN 'bulge' WHEN 2 THEN 'ridge' ELSE 'blob' END"
_SURFACE = "CASE l_linenumber % 3 WHEN 0 THEN 'floor' WHEN 1 THEN 'ceiling' ELSE 'wall' END"
_CLASS = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in findings.CLASSES) + " ELSE 'other_anomaly' END"


@query(f"""WITH m AS (SELECT {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _FEATURES.items())}, {_PROPOSAL} AS proposal, {_SURFACE} AS kind FROM lineitem),
l AS (SELECT *, proposal = 'ridge' OR (proposal = 'blob' AND {damage.LINE}) AS line FROM m),
c AS (SELECT *, CASE WHEN proposal = 'pit' THEN 'hole_or_impact' WHEN proposal = 'bulge' THEN 'sagging_or_bulging' WHEN line THEN 'structural_crack' ELSE {_CLASS} END AS class FROM l)
SELECT kind, class, count(*)::BIGINT AS n, round(sum((CASE WHEN class = 'other_anomaly' THEN 0.3 ELSE 0.6 END * CASE WHEN unseen > 0.3 THEN 0.7 ELSE 1 END)::DOUBLE), 4) AS sure FROM c
WHERE CASE WHEN proposal IN ('pit', 'bulge') THEN true WHEN line THEN NOT ({damage.JOINT}) AND NOT ({damage.FAINT}) AND NOT ({damage.MIXED}) AND NOT (proposal = 'blob' AND ({damage.OBJECT} OR ({damage.LIGHTING})))
ELSE NOT (({damage.LIGHTING}) OR {damage.OBJECT} OR {damage.PIECE} OR ({damage.TOO_LARGE}) OR ({damage.PANEL})) AND {damage.ON_KIND} END GROUP BY kind, class""")
def q63_damage_classes(spark, sf):
    """Order lines as measures of proposed regions: classes of those that count as damage."""
    d = _t(spark, sf, "lineitem").select(*[F.expr(e).cast("double").alias(n) for n, e in _FEATURES.items()], F.expr(_PROPOSAL).alias("proposal"), F.expr(_SURFACE).alias("kind"))
    return damage.judge(d).groupBy("kind", "class").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("sure"))


_CAMERAS = "(SELECT n_nationkey AS frame, cos(n_nationkey * 0.25) AS c, sin(n_nationkey * 0.25) AS s FROM nation)"


@query(f"""WITH p AS (SELECT k.frame, q.chunk, k.c * (q.x / 10 - 2.5) - k.s * (q.z / 3 - 1.5) AS xc, -(q.y / 40 - 1.2) AS yc, k.s * (q.x / 10 - 2.5) + k.c * (q.z / 3 - 1.5) AS zc FROM {CLOUD} q, {_CAMERAS} k)
SELECT frame, chunk, count(*)::BIGINT AS n, round(avg(60 * xc / zc + 40), 4) AS u, round(avg(60 * yc / zc + 30), 4) AS v FROM p WHERE zc > 0.3 AND zc < 5 AND 60 * xc / zc + 40 BETWEEN 0 AND 79 AND 60 * yc / zc + 30 BETWEEN 0 AND 59 GROUP BY frame, chunk""")
def q64_projection(spark, sf):
    """Points in the pictures of 25 cameras, of a count that does not grow, that look round from one place."""
    a = F.col("n_nationkey") * 0.25
    zero = F.lit(0.0)
    cameras = _t(spark, sf, "nation").select(
        F.col("n_nationkey").alias("frame"), F.lit(2.5).alias("cx"), F.lit(1.2).alias("cy"), F.lit(1.5).alias("cz"), F.cos(a).alias("r11"), zero.alias("r12"), (-F.sin(a)).alias("r13"), zero.alias("r21"), F.lit(-1.0).alias("r22"), zero.alias("r23"),
        F.sin(a).alias("r31"), zero.alias("r32"), F.cos(a).alias("r33"), *[F.lit(v).alias(n) for n, v in (("fx", 60.0), ("fy", 60.0), ("px", 40.0), ("py", 30.0), ("wide", 80), ("high", 60))],
    )
    p = _cloud(spark, sf).select("chunk", (F.col("x") / 10).alias("x"), (F.col("y") / 40).alias("y"), (F.col("z") / 3).alias("z"))
    seen = surfaces.project(p.crossJoin(F.broadcast(cameras))).where(surfaces.in_view())
    return seen.groupBy("frame", "chunk").agg(F.count("*").alias("n"), F.round(F.avg("u"), 4).alias("u"), F.round(F.avg("v"), 4).alias("v"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey % 7 AS col, l_quantity AS w, l_discount * 10 AS r, l_tax * 12 AS g, l_extendedprice / 1e5 AS b, CASE WHEN l_linenumber > 1 THEN l_tax - 0.04 END AS rel FROM lineitem),
m AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS t FROM s)
SELECT l_partkey, col, count(*)::BIGINT AS views, round(sum(w * r) / sum(w), 9) AS r, round(sum(w * rel) / sum(w) FILTER (rel IS NOT NULL), 9) + 0.0 AS relief,
count(*) >= 2 AND (count(rel) = count(*) OR count(*) < 3 OR sqrt(greatest(0, sum(w * t * t) / sum(w) - pow(sum(w * t) / sum(w), 2))) <= 0.06) AS valid FROM m GROUP BY 1, 2""")
def q65_surface_patches(spark, sf):
    """Order lines as sightings of a part's pixels: weighted colours, relief and whether a pixel counts."""
    d = _t(spark, sf, "lineitem").select(
        F.lit("c").alias("capture"), F.col("l_partkey").alias("surface"), F.lit(0).alias("row"), (F.col("l_suppkey") % 7).alias("col"), F.col("l_quantity").alias("weight"), (F.col("l_discount") * 10).alias("r"),
        (F.col("l_tax") * 12).alias("g"), (F.col("l_extendedprice") / 1e5).alias("b"), F.when(F.col("l_linenumber") > 1, F.col("l_tax") - 0.04).alias("relief"),
    ).withColumn("light", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    p = surfaces.patches(d)
    return p.select(F.col("surface").alias("l_partkey"), "col", "views", F.round("r", 9).alias("r"), (F.round("relief", 9) + 0.0).alias("relief"), "valid")


@query("""WITH o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
a AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY v, k) AS r FROM o WHERE k < n // 2), b AS (SELECT o_custkey, v, row_number() OVER (PARTITION BY o_custkey ORDER BY v, k) AS r FROM o WHERE k >= n // 2 AND k < 2 * (n // 2))
SELECT o_custkey, count(*)::BIGINT AS pairs, round(sum(abs(a.v - b.v)), 2) AS difference FROM a JOIN b USING (o_custkey, r) GROUP BY o_custkey""")
def q66_assignment(spark, sf):
    """Each customer's first half of orders paired with the second by price; for as many on both sides the SQL pairs by rank."""
    key = W.partitionBy("o_custkey")
    d = _t(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("v"), (F.row_number().over(key.orderBy("o_orderkey")) - 1).alias("k"), F.expr("count(*) OVER (PARTITION BY o_custkey) DIV 2").alias("half"))
    p = scoring.assign(d.where("k < half"), d.where("k >= half AND k < 2 * half"), ["o_custkey"], "k", "v")
    return p.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.round(F.sum(F.abs(F.col("a") - F.col("b"))), 2).alias("difference"))


@query(f"""WITH n AS (SELECT chunk, floor(y / 2)::BIGINT AS bin, count(*) AS n, sum(y) AS s FROM {CLOUD} GROUP BY 1, 2),
c AS (SELECT chunk, bin, sum(n) OVER (PARTITION BY chunk ORDER BY bin) / sum(n) OVER (PARTITION BY chunk) AS upto, (sum(n) OVER (PARTITION BY chunk ORDER BY bin) - n) / sum(n) OVER (PARTITION BY chunk) AS before, sum(n) OVER w AS support, sum(s) OVER w / sum(n) OVER w AS mean
FROM n WINDOW w AS (PARTITION BY chunk ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT chunk, round(arg_max(mean, (support, -bin)), 6) AS floor, max(support)::BIGINT AS support FROM c WHERE upto > 0.005 AND before < 0.6 GROUP BY chunk""")
def q67_strongest_spike(spark, sf):
    d = heights.strongest_spike(_cloud(spark, sf), ("chunk",), step=2.0, width=8.0)
    return d.select("chunk", F.round("floor", 6).alias("floor"), "support")


@query("""WITH m AS (SELECT s_suppkey, s_nationkey, s_acctbal / 1000 AS x, (s_suppkey % 9)::DOUBLE AS y, 0.1 * s_nationkey AS t, s_nationkey / 2.0 AS qx, -s_nationkey / 4.0 AS qy, CASE s_suppkey % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'ceiling' ELSE 'floor' END AS kind FROM supplier)
SELECT s_suppkey, kind, CASE WHEN kind = 'wall' OR s_nationkey % 5 = 0 THEN x ELSE round(cos(t) * (x - 1) - sin(t) * (y - 2) + qx, 4) END AS x, CASE WHEN kind = 'wall' OR s_nationkey % 5 = 0 THEN y ELSE round(sin(t) * (x - 1) + cos(t) * (y - 2) + qy, 4) END AS y FROM m""")
def q68_reframed_damage(spark, sf):
    """Suppliers as damage of nations' rooms that turned and moved; rooms whose wall changed its length stay."""
    k = F.col("s_nationkey")
    d = _t(spark, sf, "supplier").select(F.lit("c").alias("capture"), k.alias("room"), "s_suppkey", F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'ceiling' ELSE 'floor' END").alias("kind"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 9).cast("double").alias("y"))
    n, t = F.col("n_nationkey"), 0.1 * F.col("n_nationkey")
    long = F.when(n % 5 == 0, 2.2).otherwise(2.0)
    walls = _t(spark, sf, "nation").select(F.lit("c").alias("capture"), n.alias("room"), F.lit(0).alias("k"), F.lit(1.0).alias("ax"), F.lit(2.0).alias("ay"), F.lit(3.0).alias("bx"), F.lit(2.0).alias("by"), (n / 2).alias("qax"), (-n / 4).alias("qay"), (n / 2 + long * F.cos(t)).alias("qbx"), (-n / 4 + long * F.sin(t)).alias("qby"))
    return scoring.reframed(d, walls).select("s_suppkey", "kind", "x", "y")


@query("""WITH p AS (SELECT chunk, ix, iz, count(*)::DOUBLE AS grey FROM (SELECT l_linenumber AS chunk, floor(l_quantity)::BIGINT AS ix, floor(l_extendedprice / 2000)::BIGINT AS iz FROM lineitem) GROUP BY ALL),
w AS (SELECT *, lag(grey) OVER a AS w, lead(grey) OVER a AS e, lag(grey) OVER d AS n, lead(grey) OVER d AS s FROM p WINDOW a AS (PARTITION BY chunk, ix ORDER BY iz), d AS (PARTITION BY chunk, iz ORDER BY ix))
SELECT chunk, round(var_pop(w + e + n + s - 4 * grey), 6) AS sharpness FROM w WHERE w + e + n + s IS NOT NULL GROUP BY chunk""")
def q69_sharpness(spark, sf):
    d = _t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("chunk"), F.floor("l_quantity").alias("row"), F.floor(F.col("l_extendedprice") / 2000).alias("col")).agg(F.count("*").cast("double").alias("grey"))
    return sharpness.sharpness(d, ("chunk",)).withColumn("sharpness", F.round("sharpness", 6))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'room_' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'r' || c_nationkey || '_d' || c_custkey ELSE 'room_01' END AS id FROM customer")
def q70_renumbered(spark, sf):
    id_ = F.when(F.col("c_custkey") % 3 == 0, "room_0").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("r0_d"), "c_custkey")).otherwise("room_01")
    return _t(spark, sf, "customer").select("c_custkey", scoring.renumbered(id_, F.col("c_nationkey")).alias("id"))


@query("SELECT flag, n, median, in1, in3, in10 FROM (SELECT l_returnflag AS flag, count(*)::BIGINT AS n, round(median(abs(l_quantity - 25)), 6) AS median, round(avg((abs(l_quantity - 25) <= 1)::INT), 6) AS in1, round(avg((abs(l_quantity - 25) <= 3)::INT), 6) AS in3, round(avg((abs(l_quantity - 25) <= 10)::INT), 6) AS in10 FROM lineitem GROUP BY 1)")
def q71_difference_shares(spark, sf):
    d = scoring.stat(_t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") - 25).alias("d")), "d", ["flag"])
    return d.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("median", "in1", "in3", "in10")])


_DOORS = "(SELECT c_nationkey AS capture, c_custkey % 40 AS room, c_custkey AS opening, (c_custkey * 37 % 1009)::DOUBLE * 0.01 AS x, (c_custkey * 53 % 997)::DOUBLE * 0.01 AS y, radians((c_custkey % 4 * 90 + c_custkey % 7 * 2)::DOUBLE) AS t FROM customer)"


@query(f"""WITH d AS (SELECT capture, room, opening, x - cos(t) * 0.075 AS qx, y - sin(t) * 0.075 AS qy, cos(t) AS nx, sin(t) AS ny FROM {_DOORS})
SELECT a.capture, a.room AS room_a, a.opening AS opening_a, b.room AS room_b, b.opening AS opening_b, round(sqrt(pow(a.qx - b.qx, 2) + pow(a.qy - b.qy, 2)), 6) AS apart, round(degrees(acos(greatest(-1, least(1, -(a.nx * b.nx + a.ny * b.ny))))), 3) AS degrees
FROM d a JOIN d b ON a.capture = b.capture AND a.room < b.room WHERE sqrt(pow(a.qx - b.qx, 2) + pow(a.qy - b.qy, 2)) <= 0.5 AND degrees(acos(greatest(-1, least(1, -(a.nx * b.nx + a.ny * b.ny))))) <= 8.5""")
def q72_corridors(spark, sf):
    """Customers as doorways of forty rooms a nation: those that face each other through a wall."""
    k = F.col("c_custkey")
    t = F.radians((k % 4 * 90 + k % 7 * 2).cast("double"))
    d = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("capture"), (k % 40).alias("room"), k.alias("opening"), ((k * 37 % 1009).cast("double") * 0.01).alias("x"), ((k * 53 % 997).cast("double") * 0.01).alias("y"), F.cos(t).alias("nx"), F.sin(t).alias("ny"))
    p = settling.corridors(d, apart=0.5, turn=8.5)
    return p.select("capture", "room_a", "opening_a", "room_b", "opening_b", F.round("apart", 6).alias("apart"), F.round("degrees", 3).alias("degrees"))


_MASK = "(SELECT l_linenumber AS frame, l_quantity::BIGINT AS ix, floor(l_extendedprice / 300)::BIGINT AS iz FROM lineitem WHERE l_discount >= 0.03)"


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT frame, ix, iz FROM {_MASK} GROUP BY ALL HAVING count(*) >= 1),
e AS MATERIALIZED (SELECT c.frame, c.ix, c.iz, d.ix AS jx, d.iz AS jz FROM c JOIN (VALUES (-1), (0), (1)) a(dx) ON true JOIN (VALUES (-1), (0), (1)) b(dz) ON true JOIN c d ON c.frame = d.frame AND d.ix = c.ix + dx AND d.iz = c.iz + dz),
w(frame, ix, iz, label) USING KEY (frame, ix, iz) AS (SELECT frame, ix, iz, iz * 100000 + ix FROM c UNION
SELECT e.frame, e.jx, e.jz, min(w.label) FROM w JOIN e ON w.frame = e.frame AND w.ix = e.ix AND w.iz = e.iz JOIN recurring.w v ON v.frame = e.frame AND v.ix = e.jx AND v.iz = e.jz WHERE w.label < v.label GROUP BY 1, 2, 3),
m AS (SELECT frame, label, count(*)::BIGINT AS area, avg(ix::DOUBLE) AS cx, avg(iz::DOUBLE) AS cy, var_pop(ix::DOUBLE) AS vxx, var_pop(iz::DOUBLE) AS vyy, covar_pop(ix::DOUBLE, iz::DOUBLE) AS vxy, min(ix) AS l, max(ix) AS r, min(iz) AS t, max(iz) AS b FROM w GROUP BY 1, 2)
SELECT frame, label // 100000 AS lz, label % 100000 AS lx, area, l AS "left", r AS "right", t AS top, b AS bottom, round(cx, 5) AS cx, round(cy, 5) AS cy,
round(sqrt((vxx + vyy) / 2 + sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy)), 5) AS along, round(sqrt(greatest(0, (vxx + vyy) / 2 - sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy))), 3) AS across FROM m""")
def q73_patch_moments(spark, sf):
    """Order lines as coloured pixels of seven pictures: the shape of every patch from sums over its pixels."""
    d = _t(spark, sf, "lineitem").where("l_discount >= 0.03").select(F.col("l_linenumber").alias("frame"), F.col("l_quantity").cast("long").alias("ix"), F.floor(F.col("l_extendedprice") / 300).alias("iz"))
    m = strips.moments(grid.components(d, writer(spark, "patches"), by=("frame",)), by=("frame",))
    return m.select("frame", F.col("label.iz").alias("lz"), F.col("label.ix").alias("lx"), "area", "left", "right", "top", "bottom", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round("along", 5).alias("along"), F.round("across", 3).alias("across"))


_PHOTOS = "(SELECT vec_id // 400 AS room, vec_id % 8 AS photo, vec_id AS feature, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"""WITH f AS {_PHOTOS}, d AS MATERIALIZED (SELECT a.room, a.photo AS i, b.photo AS j, a.feature AS a, b.feature AS b, sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda k: (a.e[k] - b.e[k]) * (a.e[k] - b.e[k])))) AS far FROM f a JOIN f b ON a.room = b.room AND a.photo < b.photo),
r AS (SELECT *, row_number() OVER (PARTITION BY room, i, j, a ORDER BY far, b) AS there, row_number() OVER (PARTITION BY room, i, j, b ORDER BY far, a) AS back FROM d),
s AS (SELECT room, i, j, a, far AS second FROM r WHERE there = 2)
SELECT room::VARCHAR AS room, i, j, a, b, round(far, 6) AS distance FROM r JOIN s USING (room, i, j, a) WHERE there = 1 AND back = 1 AND far < 0.95 * second""")
def q74_mutual_matches(spark, sf):
    """Embeddings as features of eight pictures a room: those that are each other's nearest, by a margin."""
    k = F.col("vec_id")
    d = _t(spark, sf, "embeddings").select(F.floor(k / 400).alias("room"), (k % 8).alias("photo"), k.alias("feature"), F.col("embedding").alias("descriptor"))
    return matching.match(d, ratio=0.95, size=64).withColumn("distance", F.round("distance", 6))


_LINKS = "(SELECT c_nationkey AS room, r, r // 2 AS i, r AS j, radians((c_custkey % 90)::DOUBLE) AS t, c_custkey % 3 AS axis FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer))"


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT room, i, j, cos(t / 2) AS w, CASE WHEN axis = 0 THEN -sin(t / 2) ELSE 0 END AS x, CASE WHEN axis = 1 THEN -sin(t / 2) ELSE 0 END AS y, CASE WHEN axis = 2 THEN -sin(t / 2) ELSE 0 END AS z FROM {_LINKS}),
c AS (SELECT DISTINCT room, 0::BIGINT AS photo, 1::DOUBLE AS w, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS z FROM l
UNION ALL SELECT c.room, l.j, c.w * l.w - c.x * l.x - c.y * l.y - c.z * l.z, c.w * l.x + c.x * l.w + c.y * l.z - c.z * l.y, c.w * l.y - c.x * l.z + c.y * l.w + c.z * l.x, c.w * l.z + c.x * l.y - c.y * l.x + c.z * l.w FROM c JOIN l ON l.room = c.room AND l.i = c.photo)
SELECT room::VARCHAR AS room, photo, round(2 * (w * w + x * x) - 1, 6) + 0.0 AS r11, round(2 * (x * y - w * z), 6) + 0.0 AS r12, round(2 * (x * z + w * y), 6) + 0.0 AS r13, round(2 * (w * w + z * z) - 1, 6) + 0.0 AS r33 FROM c""")
def q75_rotation_chain(spark, sf):
    """Customers as rotations from one picture of their nation to another, a tree of them: every picture's rotation into the first one's frame."""
    r = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    d = _t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("room"), r.cast("long").alias("j"), F.radians((F.col("c_custkey") % 90).cast("double")).alias("t"), (F.col("c_custkey") % 3).alias("axis"))
    d = d.withColumn("i", F.floor(F.col("j") / 2))
    about = lambda k: F.when(F.col("axis") == k, F.sin(F.col("t") / 2)).otherwise(0.0)
    links = d.select("room", "i", "j", F.cos(F.col("t") / 2).alias("w"), about(0).alias("x"), about(1).alias("y"), about(2).alias("z"))
    zero = F.lit(0).cast("long")
    tree = d.select("room", F.col("j").alias("photo"), F.lit(0).alias("component"), F.col("i").alias("parent"))
    tree = tree.union(d.select("room").distinct().select("room", zero, F.lit(0), F.lit(None).cast("long")))
    c = matching.chain(links, tree, writer(spark, "chain")).select("room", "photo", "q.*")
    w, x, y, z = map(F.col, "wxyz")
    out = {"r11": 2 * (w * w + x * x) - 1, "r12": 2 * (x * y - w * z), "r13": 2 * (x * z + w * y), "r33": 2 * (w * w + z * z) - 1}
    return c.select("room", "photo", *[(F.round(v, 6) + 0.0).alias(n) for n, v in out.items()])


_SHOTS = "(SELECT l_orderkey // 40000 AS room, l_linenumber AS photo, l_orderkey % 32 AS v, l_quantity::BIGINT AS u, avg(l_extendedprice) / 20000 AS z FROM lineitem WHERE l_quantity < 48 GROUP BY ALL)"


@query(f"""WITH s AS MATERIALIZED (SELECT *, z * sqrt(1 + pow((u - 24) / 40.0, 2) + pow((v - 16) / 40.0, 2)) AS far FROM {_SHOTS} WHERE z > 0.3),
t AS (SELECT a.*, b.j, 0.12 * (a.photo - b.j) AS t FROM s a JOIN (SELECT DISTINCT room, photo AS j FROM s) b ON a.room = b.room AND a.photo < b.j WHERE a.u % 2 = 0 AND a.v % 2 = 0),
p AS (SELECT room, photo AS i, j, far, cos(t) * (u - 24) / 40.0 + sin(t) AS x, (v - 16) / 40.0 AS y, cos(t) - sin(t) * (u - 24) / 40.0 AS ahead FROM t),
q AS (SELECT *, x / ahead * 40 + 24 AS uj, y / ahead * 40 + 16 AS vj FROM p WHERE ahead > 0.2),
r AS (SELECT q.room, q.i, q.j, ln(q.far / s.far) AS lr FROM q JOIN s ON s.room = q.room AND s.photo = q.j AND s.u = round_even(q.uj, 0) AND s.v = round_even(q.vj, 0) WHERE uj BETWEEN 0 AND 47 AND vj BETWEEN 0 AND 31)
SELECT room, i, j, count(*)::BIGINT AS n, round(count(*) / 384, 6) AS share, round(median(lr), 5) AS log_ratio, round((quantile_cont(lr, 0.75) - quantile_cont(lr, 0.25)) / 1.349, 5) AS spread FROM r GROUP BY ALL HAVING count(*) / 384 >= 0.04""")
def q76_depth_ratios(spark, sf):
    """Order lines as depths of seven pictures a room, each turned a little further: how their scales compare where they overlap."""
    key = [F.floor(F.col("l_orderkey") / 40000).alias("room"), F.col("l_linenumber").cast("long").alias("photo"), (F.col("l_orderkey") % 32).alias("v"), F.col("l_quantity").cast("long").alias("u")]
    pixels = _t(spark, sf, "lineitem").where("l_quantity < 48").groupBy(*key).agg((F.avg("l_extendedprice") / 20000).alias("z"))
    half = 0.06 * F.col("photo")
    zero = F.lit(0.0)
    photos = pixels.where(f"z > {overlap.LEAST_DEPTH}").select("room", "photo").distinct().select("room", "photo", F.lit(40.0).alias("f"), F.lit(48).alias("wide"), F.lit(32).alias("high"), F.struct(F.cos(half).alias("w"), zero.alias("x"), F.sin(half).alias("y"), zero.alias("z")).alias("q"))
    d = overlap.ratios(pixels, photos, stride=2)
    return d.select("room", "i", "j", "n", *[F.round(c, k).alias(c) for c, k in (("share", 6), ("log_ratio", 5), ("spread", 5))])


@query(f"""WITH p AS (SELECT chunk, (x - 25.5) / 10 AS x, (y - 40) / 15 AS z FROM {CLOUD}),
o AS (SELECT chunk, floor((degrees(atan2(x, z)) + 180) / 10)::BIGINT AS sector, quantile_cont(sqrt(x * x + z * z), 0.1) - 0.3 AS reach FROM p GROUP BY 1, 2 HAVING count(*) >= 20),
f AS (SELECT chunk, sector, unnest(range(1, ceil(round(reach / 0.05, 9))::BIGINT)) AS step FROM o WHERE reach > 0)
SELECT chunk, sector, step, round(sin(radians((sector + 0.5) * 10 - 180)) * step * 0.05, 6) + 0.0 AS x, round(cos(radians((sector + 0.5) * 10 - 180)) * step * 0.05, 6) + 0.0 AS z FROM f
UNION ALL SELECT DISTINCT chunk, NULL, 0, 0.0, 0.0 FROM p""")
def q77_free_fan(spark, sf):
    """Each chunk's points about a station in its midst: free floor in thirty-six directions."""
    d = _cloud(spark, sf).select(F.col("chunk").alias("capture"), ((F.col("x") - 25.5) / 10).alias("x"), ((F.col("y") - 40) / 15).alias("z"))
    out = fan.fan(fan.reaches(d, bin_=10.0), d.select("capture"), bin_=10.0)
    return out.select(F.col("capture").alias("chunk"), "sector", "step", *[(F.round(c, 6) + 0.0).alias(c) for c in "xz"])


_WALLS = f"(SELECT chunk, (x - 25.5) / 10 AS x, (y - 40) / 60 AS y, z / 2.5 - 2 AS z FROM {CLOUD})"
_PLANS = " UNION ALL ".join(f"SELECT {k} AS plan, {math.cos(t)!r}::DOUBLE AS c, {math.sin(t)!r}::DOUBLE AS s" for k, t in enumerate(levelling.PLANS))


@query(f"""WITH g AS (SELECT i::INT AS i, j::INT AS j, tan(radians(i * 2.0::DOUBLE)) AS a, tan(radians(j * 2.0::DOUBLE)) AS b FROM range(-2, 3) s(i), range(-2, 3) t(j) WHERE i * i + j * j <= 4),
u AS (SELECT i, j, a / sqrt(a * a + 1 + b * b) AS ux, 1 / sqrt(a * a + 1 + b * b) AS uy, -b / sqrt(a * a + 1 + b * b) AS uz FROM g),
e AS (SELECT *, sqrt((1 - ux * ux) * (1 - ux * ux) + ux * uy * ux * uy + ux * uz * ux * uz) AS e FROM u), f AS (SELECT *, (1 - ux * ux) / e AS ex, -ux * uy / e AS ey, -ux * uz / e AS ez FROM e),
p AS (SELECT chunk, i, j, (x * ex + y * ey + z * ez) / 0.1 AS a, (x * (uy * ez - uz * ey) + y * (uz * ex - ux * ez) + z * (ux * ey - uy * ex)) / 0.1 AS b FROM {_WALLS}, f WHERE x * ux + y * uy + z * uz > -0.6 AND x * ux + y * uy + z * uz < 0.4),
n AS (SELECT chunk, i, j, plan, floor(c * a + s * b) AS a, floor(c * b - s * a) AS b, count(*)::DOUBLE AS n FROM p, ({_PLANS}) GROUP BY ALL),
s AS (SELECT chunk, i, j, sum(n * n) / sum(n) AS score FROM n GROUP BY ALL)
SELECT chunk, i, j, round(score, 4) AS score, row_number() OVER (PARTITION BY chunk ORDER BY round(score, 4) DESC, i * i + j * j, i, j) AS place FROM s""")
def q78_up_from_walls(spark, sf):
    """Each chunk's points as walls about a camera: thirteen directions ranked by how thin walls are along them."""
    d = _cloud(spark, sf).select(F.col("chunk").alias("capture"), ((F.col("x") - 25.5) / 10).alias("x"), ((F.col("y") - 40) / 60).alias("y"), (F.col("z") / 2.5 - 2).alias("z"), F.lit(1).cast("long").alias("n"))
    zero = F.lit(0.0)
    priors = d.select("capture").distinct().select("capture", zero.alias("ux"), F.lit(1.0).alias("uy"), zero.alias("uz"))
    out = levelling.thinness(d, levelling.candidates(levelling.frames(priors), 4.0, 2.0), 0.1)
    out = out.select(F.col("capture").alias("chunk"), "i", "j", F.round("score", 4).alias("score"))
    i, j = F.col("i"), F.col("j")
    return out.withColumn("place", F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("score"), i * i + j * j, "i", "j")).cast("long"))


_SPREADS = "(SELECT l_linenumber AS chunk, l_discount AS slab, l_quantity / 10 AS x, l_extendedprice * (l_discount + 0.01) / 6000 AS y, (l_quantity + l_extendedprice / 2000) / 40 AS z FROM lineitem)"


@query(f"""WITH m AS (SELECT chunk, slab, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM {_SPREADS} GROUP BY ALL),
c AS (SELECT *, xx + yy + zz AS c2, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS c1, xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy AS c0 FROM m),
q AS (SELECT *, greatest(c2 * c2 - 3 * c1, 0) AS q, c2 * c2 * c2 - 4.5 * c2 * c1 + 13.5 * c0 AS r FROM c),
t AS (SELECT *, CASE WHEN q > 0 THEN acos(greatest(-1, least(1, r / pow(q, 1.5)))) / 3 ELSE 0 END AS t FROM q),
v AS (SELECT chunk, slab, n, (c2 + 2 * sqrt(q) * cos(t)) / 3 AS a, (c2 + 2 * sqrt(q) * cos(t - 2 * pi() / 3)) / 3 AS b FROM t)
SELECT chunk, slab, n, round(sqrt(greatest(a, 0)), 4) AS wide, round(sqrt(greatest(b, 0)), 4) AS narrow, n >= 10 AND sqrt(greatest(b, 0)) >= 0.3 AND sqrt(greatest(b, 0)) >= 0.12 * sqrt(greatest(a, 0)) AS area FROM v WHERE n >= 10""")
def q79_area_tests(spark, sf):
    """Slabs of each chunk: how far their points spread along their two widest axes, and which are areas."""
    d = _t(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("chunk"), F.col("l_discount").alias("slab"), (F.col("l_quantity") / 10).alias("x"),
        (F.col("l_extendedprice") * (F.col("l_discount") + 0.01) / 6000).alias("y"), ((F.col("l_quantity") + F.col("l_extendedprice") / 2000) / 40).alias("z"),
    )
    return levelling.spreads(d, ["chunk", "slab"]).where("n >= 10").withColumns({c: F.round(c, 4) for c in ("wide", "narrow")})


@query(f"""WITH c AS (SELECT chunk, floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iz, count(*) AS n FROM {CLOUD} GROUP BY ALL), w AS MATERIALIZED (SELECT chunk, ix, iz FROM c QUALIFY n >= 1.5 * avg(n) OVER (PARTITION BY chunk)),
d AS MATERIALIZED (SELECT DISTINCT chunk, ix + dx AS ix, iz + dz AS iz FROM w, range(-1, 2) s(dx), range(-1, 2) t(dz)),
r AS (SELECT chunk, 0 AS degrees, ix, iz FROM w UNION ALL SELECT chunk, 90, -iz - 1, ix FROM w UNION ALL SELECT chunk, 180, -ix - 1, -iz - 1 FROM w UNION ALL SELECT chunk, 270, iz, -ix - 1 FROM w),
n AS (SELECT d.chunk AS a, r.chunk AS b, degrees, d.ix - r.ix AS dx, d.iz - r.iz AS dz, count(*) AS hits FROM d JOIN r ON r.chunk = d.chunk + 1 GROUP BY ALL),
o AS (SELECT chunk, count(*) AS cells FROM w GROUP BY 1)
SELECT a::VARCHAR AS a, b::VARCHAR AS b, degrees::DOUBLE AS degrees, dx, dz, hits, cells AS of, round(hits / cells, 6) AS share FROM n JOIN o ON o.chunk = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY hits DESC, degrees, dz, dx) = 1""")
def q80_scan_alignment(spark, sf):
    """Crowded cells of each chunk as the walls of a scan: how the next chunk is laid on it, by quarter turns."""
    c = _cloud(spark, sf).groupBy("chunk", cloud.cell("x", 1.0).alias("ix"), cloud.cell("y", 1.0).alias("iz")).agg(F.count("*").alias("n"))
    w = c.withColumn("usual", F.avg("n").over(W.partitionBy("chunk"))).where("n >= 1.5 * usual").select(F.col("chunk").alias("capture"), "ix", "iz")
    pairs = w.select("capture").distinct().select(F.col("capture").alias("a"), (F.col("capture") + 1).alias("b"))
    return alignment.align(w, pairs, 90.0).withColumn("share", F.round("share", 6))

"""Joins by distance, nearness and interval overlap, as equi-joins on buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def within(left: DataFrame, right: DataFrame, left_at: str, right_at: str, cutoff: float, unless: Column | None = None) -> DataFrame:
    """Pairs whose positions differ by ``cutoff`` at most: the left side meets three buckets of the right."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(cutoff)).cast("long")
    a = left.withColumn("__b", F.explode(F.array(bucket(left_at) - 1, bucket(left_at), bucket(left_at) + 1)))
    pairs = a.join(right.withColumn("__b", bucket(right_at)), "__b").drop("__b").withColumn("distance", F.abs(F.col(left_at) - F.col(right_at)))
    return pairs.where((F.col("distance") <= cutoff) & (F.lit(True) if unless is None else ~unless))


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_at: str, right_at: str, cutoff: float, differ: tuple[str, str] | None = None) -> DataFrame:
    """Each left row with the nearest right row, ties to the smaller id; null where none is near enough.

    With ``differ``, a column of each side, only rows that differ there meet, and nulls there meet none.
    No pairs are made: a stretch's rows stand in order of place, and each left row looks at the last
    right row before it and the first after it, or at the last and first of another ``differ``. A
    stretch is as wide as the cutoff and also has the right rows of its neighbours.
    """
    wide = cutoff * (1 + 1e-6)  # a distance just at the cutoff can be rounded
    bucket = lambda c: F.floor(F.col(c) / F.lit(wide)).cast("long")
    of = lambda k: F.lit(0) if differ is None else F.col(differ[k])
    a = left.select(F.lit(True).alias("__left"), bucket(left_at).alias("__b"), F.col(left_at).alias("__at"), of(0).alias("__of"), F.col(left_id).alias("__id"), F.lit(None).alias("__to"))
    b = right.select(F.lit(False).alias("__left"), F.explode(F.array(bucket(right_at) - 1, bucket(right_at), bucket(right_at) + 1)).alias("__b"), F.col(right_at).alias("__at"), of(1).alias("__of"), F.lit(None).alias("__id"), F.col(right_id).alias("__to"))
    known = "__at IS NOT NULL AND __of IS NOT NULL"
    d = a.where(known).unionByName(b.where(known))
    here = F.struct("__at", "__to", "__of")
    own = F.when(~F.col("__left"), here)
    # of equal places right rows come first, the smallest id as the last of them
    for side, order in (("before", F.asc("__at")), ("after", F.desc("__at"))):
        upto = W.partitionBy("__b").orderBy(order, F.asc("__left"), F.desc("__to")).rowsBetween(W.unboundedPreceding, 0)
        earlier = W.partitionBy("__b").orderBy(order, F.asc("__left"), F.desc("__to")).rowsBetween(W.unboundedPreceding, -1)
        d = d.withColumns({"__one": F.last(own, ignorenulls=True).over(upto), "__past": F.last(own, ignorenulls=True).over(earlier)})
        turn = F.when(~F.col("__left") & (F.col("__past.__of") != F.col("__of")), F.col("__past"))
        found = F.col("__one")
        if differ is not None:  # the last right row that is unlike the last one, where this is like the left row
            d = d.withColumn("__two", F.last(turn, ignorenulls=True).over(upto))
            found = F.when(F.col("__one.__of") != F.col("__of"), F.col("__one")).otherwise(F.col("__two"))
        d = d.withColumn(side, found).drop("__one", "__past", "__two")
    far = lambda side: F.abs(F.col("__at") - F.col(f"{side}.__at"))
    near = lambda side: F.when(far(side) <= cutoff, F.struct(far(side).alias("distance"), F.col(f"{side}.__to").alias(right_id)))
    best = d.where("__left").select(F.col("__id").alias(left_id), F.least(near("before"), near("after")).alias("m")).where("m IS NOT NULL")
    best = best.groupBy(left_id).agg(F.min("m").alias("m"))  # a row a left row, or several of a repeated id
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.distance").alias("distance"))


def knn(queries: DataFrame, points: DataFrame, k: int, dims: list[str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, near, rank): the k nearest points of each query other than itself, ties to the smaller id.

    Queries meet the points of their own cell and its neighbours. Whoever has k points within
    one cell's width is done; the others go on with wider cells, and the last round's
    cells hold all points. Fewer than k points give fewer rows; rows with a null place take no part.
    """
    known = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    queries, points = queries.where(known).select("id", *dims), points.where(known).select("id", *dims)
    inner = lambda share: lambda d: F.percentile_approx(d, share)  # noqa: E731 - where most points lie, whatever stray ones there are
    ends = points.unionByName(queries).agg(*[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max), ("from", inner(0.02)), ("to", inner(0.98)))]).first()
    total = points.count()
    if not total or ends["lo" + dims[0]] is None:
        return queries.select("id", F.col("id").alias("near"), F.lit(1).alias("rank")).limit(0)
    extent = max(ends[f"hi{d}"] - ends[f"lo{d}"] for d in dims) or 1.0
    most = max(ends[f"to{d}"] - ends[f"from{d}"] for d in dims) or extent
    size, done = min(extent, most * min(1.0, (k / total) ** (1 / len(dims)))), None
    rounds = 0
    while True:
        cells = lambda c: [F.floor((F.col(d) - ends[f"lo{d}"]) / size).cast("long").alias(f"__{d}") for d in c]  # noqa: E731, B023
        q = queries.select("id", *dims, *cells(dims))
        for d in dims:
            q = q.withColumn(f"__{d}", F.explode(F.array(*[F.col(f"__{d}") + s for s in (-1, 0, 1)])))
        p = points.select(F.col("id").alias("near"), *[F.col(d).alias(f"p{d}") for d in dims], *cells(dims))
        d2 = sum(((F.col(d) - F.col(f"p{d}")) * (F.col(d) - F.col(f"p{d}")) for d in dims), F.lit(0.0))
        near = q.join(p, [f"__{d}" for d in dims]).where("id <> near").select("id", "near", d2.alias("d2"))
        ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("d2", "near"))).where(F.col("rank") <= k)
        if size >= extent:  # neighbouring cells hold every point
            return ranked.select("id", "near", "rank") if done is None else done.unionByName(ranked.select("id", "near", "rank"))
        ranked = save(ranked)
        full = ranked.where((F.col("rank") == k) & (F.col("d2") < size * size)).select("id")
        found = ranked.join(full, "id", "left_semi").select("id", "near", "rank")
        done = found if done is None else done.unionByName(found)
        queries = save(queries.join(full, "id", "left_anti"))
        if queries.isEmpty():
            return done
        rounds += 1
        size *= 2 if rounds < 8 else 16  # what is left by then lies far off


def overlaps(rows: DataFrame, key: str, id_: str, start: str, end: str, share: float = 0.5, width: float = 1.0) -> DataFrame:
    """Pairs of a key's intervals that overlap by ``share`` of the shorter one or more.

    An interval belongs to the level whose stretches are twice as long as those of the level
    below, from ``width`` on, and as long as itself: it touches two of them at most. There it
    meets those of its own and lower levels, so that one endless interval neither becomes
    endless rows nor makes others meet. A pair counts in the stretch where the later one starts.
    """
    size = F.greatest(F.col(end) - F.col(start), F.lit(float(width))) / width
    d = rows.where(F.col(end) >= F.col(start)).select(key, F.col(id_).alias("id"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.ceil(F.log2(size)).cast("int").alias("own"))
    top = d.agg(F.coalesce(F.max("own"), F.lit(0)).alias("top"))
    wide = lambda level: F.pow(F.lit(2.0), level) * width
    stretches = lambda d: d.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("s") / wide(F.col("level"))).cast("long"), F.floor(F.col("e") / wide(F.col("level"))).cast("long"))))
    home = stretches(d.withColumn("level", F.col("own"))).select(key, "level", "stretch", F.col("id").alias("i"), F.col("s").alias("s0"), F.col("e").alias("e0"))
    met = stretches(d.join(F.broadcast(top)).withColumn("level", F.explode(F.sequence("own", "top")))).select(key, "level", "stretch", "own", F.col("id").alias("j"), F.col("s").alias("s1"), F.col("e").alias("e1"))  # a one-row side
    shared = F.least("e0", "e1") - F.greatest("s0", "s1")
    shorter = F.least(F.col("e0") - F.col("s0"), F.col("e1") - F.col("s1"))
    once = F.floor(F.greatest("s0", "s1") / wide(F.col("level"))).cast("long") == F.col("stretch")
    other = (F.col("own") < F.col("level")) | (F.col("i") < F.col("j"))
    pairs = home.join(met, [key, "level", "stretch"]).where(other & (F.col("i") != F.col("j")) & once & (shared >= share * shorter) & (shared > 0))
    return pairs.select(key, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), shared.alias("shared"))


def pair_overlaps(sets: DataFrame, owner: str, item: list[str]) -> DataFrame:
    """Shared items of each pair of owners, by an equi-join on the item."""
    s = sets.select(owner, *item).distinct()
    other = s.withColumnRenamed(owner, "__o")
    return s.join(other, item).where(F.col(owner) < F.col("__o")).groupBy(F.col(owner).alias("a"), F.col("__o").alias("b")).agg(F.count("*").alias("shared"))

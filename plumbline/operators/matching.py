"""Features of pictures matched both ways, rotations agreed on by matches, and chains of rotations.

Descriptors meet as blocks of a matrix: a block of one picture and a block of another are one row,
their distances one product, and only each feature's two nearest leave the task. A rotation is a unit
quaternion (w, x, y, z).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RATIO = 0.8
WITHIN = 1.5
LEAST_AGREEING = 20
LOOP = 3.0

_TWO = "room string, i long, j long, back boolean, feature long, near array<struct<far: double, other: long>>"


def _blocks(features: DataFrame, size: int) -> DataFrame:
    """(room, photo, block, ids, vecs): a picture's descriptors, ``size`` of them a row at most."""
    d = features.where("descriptor IS NOT NULL AND size(descriptor) > 0 AND NOT exists(descriptor, x -> x IS NULL OR isnan(x))")
    counts = d.groupBy("room", "photo").agg(F.ceil(F.count("*") / size).alias("blocks"))
    d = d.join(counts, ["room", "photo"]).withColumn("block", F.pmod(F.xxhash64("feature"), F.col("blocks")))
    rows = F.array_sort(F.collect_list(F.struct("feature", F.col("descriptor").cast("array<double>").alias("vec"))))
    return d.groupBy("room", "photo", "block").agg(rows.alias("rows")).select("room", "photo", "block", F.col("rows.feature").alias("ids"), F.col("rows.vec").alias("vecs"))


def match(features: DataFrame, ratio: float = RATIO, size: int = 1024) -> DataFrame:
    """(room, i, j, a, b, distance): features a of picture i and b of picture j, i before j, that are each other's nearest.

    ``features`` has room, photo, feature and descriptor, all of one length in a room. The nearest
    one of j to a is nearer than ``ratio`` times the second; pictures of fewer than three features
    have no matches. Ties go to the smaller number. Null descriptors take no part. Every pair of
    blocks of two pictures is one row; a feature's two nearest of each block are merged, both ways.
    """
    features = features.select(F.col("room").cast("string").alias("room"), F.col("photo").cast("long").alias("photo"), F.col("feature").cast("long").alias("feature"), "descriptor")
    blocks = _blocks(features, size)
    enough = blocks.groupBy("room", "photo").agg(F.sum(F.size("ids")).alias("n")).where("n >= 3").select("room", "photo")
    blocks = blocks.join(enough, ["room", "photo"], "left_semi")
    side = lambda p, c: blocks.select("room", F.col("photo").alias(p), F.col("ids").alias(f"{c}_ids"), F.col("vecs").alias(f"{c}_vecs"))
    pairs = side("i", "a").join(side("j", "b"), "room").where("i < j")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a row at a time, its vectors as they lie in Arrow: a batch as Python's numbers is many times as large
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                r = {c: one.column(c)[0].as_py() for c in ("room", "i", "j", "a_ids", "b_ids")}
                a, b = (one.column(c).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(r[k]), -1) for c, k in (("a_vecs", "a_ids"), ("b_vecs", "b_ids")))
                d = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]))
                out = []
                for back, m, own, other in ((False, d, r["a_ids"], np.array(r["b_ids"])), (True, d.T, r["b_ids"], np.array(r["a_ids"]))):
                    rows, x, y = (a, a, b) if not back else (b, b, a)
                    best = np.argsort(m, axis=1, kind="stable")[:, : min(4, m.shape[1])]
                    # what the product rounds is worked out exactly
                    exact = np.sqrt(((x[:, None, :] - y[best]) ** 2).sum(2))
                    for k in range(len(rows)):
                        two = sorted(zip(exact[k].tolist(), other[best[k]].tolist()))[:2]
                        out.append((r["room"], r["i"], r["j"], back, own[k], [{"far": f, "other": o} for f, o in two]))
                cols = list(zip(*out))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("far", pa.float64()), ("other", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["room", "i", "j", "back", "feature", "near"])

    found = pairs.mapInArrow(nearest, _TWO)
    two = found.groupBy("room", "i", "j", "back", "feature").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, 2).alias("near"))
    # both ways side by side, so that distances are worked out once
    back, first, second = F.col("back"), F.col("near")[0], F.get("near", F.lit(1))
    d = two.where(back | (first["far"] < ratio * second["far"]))
    d = d.select("room", "i", "j", F.when(back, first["other"]).otherwise(F.col("feature")).alias("a"), F.when(back, F.col("feature")).otherwise(first["other"]).alias("b"), "back", first["far"].alias("far"))
    d = d.groupBy("room", "i", "j", "a", "b").agg(F.bool_or("back").alias("mutual"), F.min(F.when(~back, F.col("far"))).alias("distance"))
    return d.where("mutual AND distance IS NOT NULL").drop("mutual")


def rotation(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The quaternion that best turns unit vectors a into b: the top eigenvector of their profile matrix."""
    s = (a * (1 if w is None else w[:, None])).T @ b
    d = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    n = np.empty((4, 4))
    n[0, 0], n[0, 1:], n[1:, 0] = np.trace(s), d, d
    n[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    q = np.linalg.eigh(n)[1][:, -1]
    return q if q[np.abs(q).argmax()] > 0 else -q


def matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ])


def _frames(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Right-handed axes of each pair of rays: along their middle, their difference, and across both."""
    m, d = u + v, u - v
    m, d = m / np.linalg.norm(m, axis=1, keepdims=True), d / np.linalg.norm(d, axis=1, keepdims=True)
    return np.stack([m, d, np.cross(m, d)], axis=2)


LINKS = "room string, i long, j long, w double, x double, y double, z double, inliers int"


def rotations(rays: DataFrame, within: float = WITHIN, least: int = LEAST_AGREEING, tries: int = 400, seed: int = 0) -> DataFrame:
    """(room, i, j, w, x, y, z, inliers): the rotation from i to j that most matches of two pictures agree on.

    ``rays`` has room, i, j and unit rays ax, ay, az and bx, by, bz of each match. A candidate turns
    two matches into each other; only two whose rays are as far apart in both pictures, and neither
    close nor opposite, can be right. All candidates are counted in one product, and the best is
    fitted again to those within ``within`` degrees until they stay the same. Fewer than ``least``
    agreeing matches give no row. Nulls take no part; a pair's matches, some thousand, are one task's.
    """
    limit = np.cos(np.radians(within))

    def agree(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[c.split()[0] for c in LINKS.split(", ")])
        g = g.dropna().sort_values(["ax", "ay", "az", "bx", "by", "bz"])
        a, b = g[["ax", "ay", "az"]].to_numpy(float), g[["bx", "by", "bz"]].to_numpy(float)
        if len(a) < max(least, 3):
            return empty
        rng = np.random.default_rng(seed)
        k, m = rng.integers(0, len(a), (2, 20 * tries))
        here, there = (a[k] * a[m]).sum(1), (b[k] * b[m]).sum(1)
        apart = np.abs(np.arccos(np.clip(here, -1, 1)) - np.arccos(np.clip(there, -1, 1)))
        fit = np.flatnonzero((np.abs(here) < np.cos(np.radians(4 * within))) & (apart < np.radians(2 * within)))[:tries]
        if not len(fit):
            return empty
        k, m = k[fit], m[fit]
        turn = _frames(b[k], b[m]) @ _frames(a[k], a[m]).transpose(0, 2, 1)
        votes = (np.einsum("tij,nj,ni->tn", turn, a, b, optimize=True) > limit).sum(1)
        best = turn[votes.argmax()]
        near, q = (a @ best.T * b).sum(1) > limit, None
        for _ in range(20):
            if near.sum() < max(least, 3):
                return empty
            q = rotation(a[near], b[near])
            now = (a @ matrix(q).T * b).sum(1) > limit
            if (now == near).all():
                break
            near = now
        if near.sum() < max(least, 3):
            return empty
        return pd.DataFrame([(*key, *q, int(near.sum()))], columns=empty.columns)

    return rays.groupBy("room", "i", "j").applyInPandas(agree, LINKS)


def product(p: Column, q: Column) -> Column:
    """The rotation q followed by p."""
    w = p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]
    x = p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"]
    y = p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"]
    z = p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"]
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def inverse(q: Column) -> Column:
    return F.struct(q["w"].alias("w"), (-q["x"]).alias("x"), (-q["y"]).alias("y"), (-q["z"]).alias("z"))


def chain(links: DataFrame, chains: DataFrame, save) -> DataFrame:
    """(room, photo, component, q): each picture's rotation into its root's frame, along the parents of ``dense.spanning_chains``.

    Each step doubles the way that is done, so a chain of n pictures takes as many steps as n has digits in base two.
    """
    q = F.struct("w", "x", "y", "z")
    there = links.select("room", F.col("i").alias("parent"), F.col("j").alias("photo"), inverse(q).alias("q"))
    both = there.union(links.select("room", F.col("j").alias("parent"), F.col("i").alias("photo"), q.alias("q")))
    unit = F.struct(F.lit(1.0).alias("w"), *[F.lit(0.0).alias(c) for c in "xyz"])
    d = chains.select("room", F.col("photo").cast("long").alias("photo"), "component", F.col("parent").cast("long").alias("parent"))
    d = save(d.join(both, ["room", "parent", "photo"], "left").withColumn("q", F.coalesce("q", unit)).select("room", "photo", "component", "parent", "q"))
    while not d.where("parent IS NOT NULL").isEmpty():
        up = d.select("room", F.col("photo").alias("parent"), F.col("parent").alias("next"), F.col("q").alias("up"))
        d = d.join(up, ["room", "parent"], "left").select("room", "photo", "component", F.col("next").alias("parent"), F.when(F.col("up").isNull(), F.col("q")).otherwise(product(F.col("up"), F.col("q"))).alias("q"))
        d = save(d)
    return d.drop("parent")


def loop_errors(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(room, i, j, degrees): how far each measured rotation is from the one that the chains give."""
    at = lambda p, n: placed.select("room", F.col("photo").alias(p), F.col("component").alias(f"c_{p}"), F.col("q").alias(n))
    d = links.select("room", "i", "j", F.struct("w", "x", "y", "z").alias("q")).join(at("i", "qi"), ["room", "i"]).join(at("j", "qj"), ["room", "j"]).where("c_i = c_j")
    off = product(inverse(F.col("q")), product(inverse(F.col("qj")), F.col("qi")))
    d = d.withColumn("off", off)
    sine = F.sqrt(F.col("off.x") * F.col("off.x") + F.col("off.y") * F.col("off.y") + F.col("off.z") * F.col("off.z"))
    return d.select("room", "i", "j", F.degrees(2 * F.atan2(sine, F.abs("off.w"))).alias("degrees"))


def register(links: DataFrame, photos: DataFrame, save) -> tuple[DataFrame, DataFrame]:
    """(room, photo, q) of the pictures of each room, null where not linked with the largest set, and (room, worst, flags).

    ``photos`` has room and photo. A room's rotations lead into the frame of its best linked picture.
    """
    from plumbline.operators import dense

    links = save(links)
    placed = chain(links, save(dense.spanning_chains(links.select("room", "i", "j", "inliers"))), save)
    worst = loop_errors(links, placed).groupBy("room").agg(F.max("degrees").alias("worst"))
    out = photos.join(placed.where("component = 0").select("room", "photo", "q"), ["room", "photo"], "left")
    n = out.groupBy("room").agg(F.count("q").alias("n"), F.array_sort(F.collect_list(F.when(F.col("q").isNull(), F.col("photo")))).alias("missing"))
    flags = F.array_compact(F.concat(
        F.array(F.when(F.col("worst") > LOOP, F.lit("pose_loop_inconsistent"))), F.transform("missing", lambda p: F.concat(F.lit("image_unregistered:"), p.cast("string"))),
        F.array(F.when(F.col("n") < 2, F.lit("insufficient_registration"))),
    ))
    return out, n.join(worst, "room", "left").select("room", "worst", flags.alias("flags"))

"""Depth of a model brought to one scale: ratios to sparse points by frame and chunk, known lengths, and scales that agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import cloud, planes, robust

#: Sightings a frame needs for its ratio.
LEAST_ANCHORS = 30
#: Spread of a chunk's ratios, as a share of their median, over which its scale is unstable.
UNSTABLE = 0.25


def frame_ratios(sightings: DataFrame, least: int = LEAST_ANCHORS) -> DataFrame:
    """(capture, frame, chunk, ratio, n) from sightings with depth (the model's) and z (the sparse point's).

    The median of depth over z within three robust spreads; frames with fewer sightings have no row.
    """
    d = sightings.where("z > 0 AND depth > 0").select("capture", "frame", "chunk", (F.col("depth") / F.col("z")).alias("r"))
    return robust.ratio_fit(d, "r", ["capture", "frame", "chunk"], least).withColumnRenamed("fit", "ratio")


def chunk_ratios(frames: DataFrame) -> DataFrame:
    """(capture, chunk, ratio, spread, unstable): medians over a chunk's frames."""
    d = robust.small_median_mad(frames.select("capture", "chunk", "ratio"), "ratio", ["capture", "chunk"])
    return d.select("capture", "chunk", F.col("med").alias("ratio"), "spread", (F.col("spread") > UNSTABLE * F.col("med")).alias("unstable"))


def model_scale(chunks: DataFrame) -> DataFrame:
    """(capture, scale, rel_sigma): metres a unit of the sparse points, with the median's error."""
    d = robust.small_median_mad(chunks.select("capture", "ratio"), "ratio", ["capture"])
    return d.select("capture", F.col("med").alias("scale"), F.hypot(F.lit(0.15), 1.2533 * F.try_divide("spread", "med") / F.sqrt("n")).alias("rel_sigma"))


def to_cloud(pixels: DataFrame, ratios: DataFrame, scale: float, rotation: np.ndarray, voxel: float = 0.03) -> DataFrame:
    """(capture, chunk, x, y, z) in metres, y up: world points of trusted pixels, thinned by voxel.

    ``pixels`` has capture, frame, chunk, u, v, z (the model's depth), intrinsics, and the
    frame's place px, py, pz and rotation r00 to r22 in units of the sparse points.
    """
    d = pixels.where("z > 0").join(ratios.select("capture", "frame", "ratio"), ["capture", "frame"]).withColumn("z", F.col("z") / F.col("ratio"))
    d = cloud.back_project(d)
    axis = ("cam_x", "cam_y", "cam_z")
    d = d.withColumns({c: sum((F.col(f"r{i}{j}") * F.col(a) for j, a in enumerate(axis)), F.col(f"p{c}")) for i, c in enumerate("xyz")})
    d = planes.rotated(d.select("capture", "chunk", "x", "y", "z"), rotation, scale)
    cells = [cloud.cell(a, voxel).alias(f"i{a}") for a in "xyz"]
    return d.groupBy("capture", "chunk", *cells).agg(*[F.avg(a).alias(a) for a in "xyz"]).select("capture", "chunk", "x", "y", "z")


def depth_edges(pixels: DataFrame, share: float = 0.05) -> DataFrame:
    """Pixels without those beside a jump of depth: the least and greatest of nine neighbours differ by over ``share``.

    A pixel goes to its neighbours as nine rows; partial minima and maxima keep the shuffle small.
    """
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    d = pixels.where("z > 0").select("capture", "frame", "u", "v", "z").withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps))
    d = d.groupBy("capture", "frame", (F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v")).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    calm = d.where(F.col("hi") - F.col("lo") <= share * F.col("lo")).select("capture", "frame", "u", "v")
    return pixels.where("z > 0").join(calm, ["capture", "frame", "u", "v"], "left_semi")


def meet(o: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The place nearest to all lines through o along the unit vectors d."""
    p = np.eye(3) - d[:, :, None] * d[:, None, :]
    return np.linalg.solve(p.sum(0) + 1e-12 * np.eye(3), np.einsum("nij,nj->i", p, o))


LENGTHS = "capture string, length double, rel_sigma double, frames int, angle double"


def known_length(sightings: DataFrame, drop: int = 2, groups: int = 10, replicates: int = 30, seed: int = 0) -> DataFrame:
    """(capture, length, rel_sigma, frames, angle): a straight object's length from rays to its two ends.

    ``sightings`` has a row a frame: ox, oy, oz and unit rays tx, ty, tz to the top and bx, by,
    bz to the bottom. Sightings off by three robust spreads go, three times over. The error is
    the jackknife's over ``groups`` less ``drop``. Fewer than two sightings give no row. A
    capture's sightings of one object are a few hundred.
    """

    def measure(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values("frame")
        o, t, b = (g[list(c)].to_numpy(float) for c in (("ox", "oy", "oz"), ("tx", "ty", "tz"), ("bx", "by", "bz")))
        empty = pd.DataFrame(columns=["capture", "length", "rel_sigma", "frames", "angle"])
        for _ in range(3):
            if len(o) < 2:
                return empty
            ends = meet(o, t), meet(o, b)
            off = sum(np.linalg.norm(np.cross(e - o, d), axis=1) for e, d in zip(ends, (t, b)))
            far = np.abs(off - np.median(off))
            keep = far <= 3 * 1.4826 * np.median(far) + 1e-9
            if keep.all():
                break
            o, t, b = o[keep], t[keep], b[keep]
        if len(o) < 2:
            return empty
        size = lambda k: float(np.linalg.norm(meet(o[k], t[k]) - meet(o[k], b[k])))
        length, n = size(slice(None)), min(groups, len(o))
        part, rng, got = np.arange(len(o)) * n // len(o), np.random.default_rng(seed), []
        for _ in range(replicates if n > drop + 1 else 0):
            got.append(size(~np.isin(part, rng.choice(n, drop, replace=False))))
        sigma = np.sqrt((n - drop) / drop) * np.std(got) / length if got and length > 0 else None
        angle = float(np.degrees(np.arccos(np.clip((t @ t.T).min(), -1, 1))))
        return pd.DataFrame({"capture": [key[0]], "length": [length], "rel_sigma": [sigma], "frames": [len(o)], "angle": [angle]})

    return sightings.groupBy("capture").applyInPandas(measure, LENGTHS)


def choose_scale(model: DataFrame, lengths: DataFrame, true_length: float) -> DataFrame:
    """(capture, scale, rel_sigma, method, flags): by the known length where it is within half to twice the model's scale."""
    d = model.withColumnRenamed("rel_sigma", "model_sigma").withColumnRenamed("scale", "model").join(lengths, "capture", "left")
    own = F.try_divide(F.lit(true_length), F.col("length"))
    ok: Column = F.coalesce(own.between(0.5 * F.col("model"), 2 * F.col("model")), F.lit(False))
    flags = F.array_compact(F.array(F.when(F.col("length").isNull(), "the object of known length was not seen"), F.when(F.col("length").isNotNull() & ~ok, "the known length disagrees with the depth model and is not used")))
    return d.select("capture", F.when(ok, own).otherwise(F.col("model")).alias("scale"), F.when(ok, F.coalesce("rel_sigma", "model_sigma")).otherwise(F.col("model_sigma")).alias("rel_sigma"), F.when(ok, "known length").otherwise("depth model").alias("method"), flags.alias("flags"))


HARMONY = "room string, photo int, log_scale double"


def harmonise(pairs: DataFrame) -> DataFrame:
    """(room, photo, log_scale): scales under which photos agree on the depth they share, by weighted least squares.

    ``pairs`` has room, i, j, log_ratio (of i's depth to j's) and spread. Scales sum to none
    within each set of photos that pairs link. A room has some twenty photos.
    """

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna()
        ids = sorted(set(g["i"]) | set(g["j"]))
        at = {p: k for k, p in enumerate(ids)}
        a, y = np.zeros((len(g), len(ids))), np.zeros(len(g))
        for k, r in enumerate(g.itertuples()):
            w = 1 / max(r.spread, 1e-3)
            a[k, at[r.i]], a[k, at[r.j]], y[k] = w, -w, -w * r.log_ratio
        # the shortest of all best answers has no common factor in any linked set
        x = np.linalg.lstsq(a, y, rcond=None)[0] if ids else []
        return pd.DataFrame({"room": key[0], "photo": ids, "log_scale": x})

    return pairs.groupBy("room").applyInPandas(solve, HARMONY)


def kabsch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that best turns the vectors a into b."""
    u, _, v = np.linalg.svd(a.T @ b)
    return v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T))]) @ u.T


CHAIN = "room string, photo int, component int, parent int, depth int"


def spanning_chains(links: DataFrame) -> DataFrame:
    """(room, photo, component, parent, depth): photos reached from the best linked one along the strongest links.

    ``links`` has room, i, j, inliers. Components are numbered from the largest, ties to the
    one with the least photo; the root has a null parent.
    """

    def chain(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        sets = {p: {p} for p in sorted(set(g["i"]) | set(g["j"]))}
        tree: dict = {p: [] for p in sets}
        weight = dict.fromkeys(sets, 0)
        for r in g.sort_values(["inliers", "i", "j"], ascending=[False, True, True]).itertuples():
            weight[r.i] += r.inliers
            weight[r.j] += r.inliers
            if sets[r.i] is not sets[r.j]:
                tree[r.i].append(r.j)
                tree[r.j].append(r.i)
                both = sets[r.i] | sets[r.j]
                for p in both:
                    sets[p] = both
        parts = sorted({id(s): s for s in sets.values()}.values(), key=lambda s: (-len(s), min(s)))
        rows = []
        for k, part in enumerate(parts):
            todo, done = [(max(sorted(part), key=lambda p: weight[p]), None, 0)], set()
            for p, parent, depth in todo:
                done.add(p)
                rows.append((key[0], p, k, parent, depth))
                todo += [(q, p, depth + 1) for q in sorted(tree[p]) if q not in done]
        return pd.DataFrame(rows, columns=["room", "photo", "component", "parent", "depth"]).astype({"parent": "Int32"})

    return links.groupBy("room").applyInPandas(chain, CHAIN)

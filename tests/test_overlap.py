"""Depth ratios of pictures from one spot, and pictures that agree with none."""

import itertools
import random

import numpy as np
import pytest

from plumbline.functions.tables import writer
from plumbline.operators import dense, matching, overlap

W_, H_, FOCAL = 96, 72, 80.0


def about_y(t):
    return np.array([np.cos(t / 2), 0.0, np.sin(t / 2), 0.0])


def shot(q, scale):
    """Depths of a box room of 5 by 3 by 4 m from its middle, off by a scale."""
    v, u = np.mgrid[0:H_, 0:W_]
    ray = np.stack([(u - W_ / 2) / FOCAL, (v - H_ / 2) / FOCAL, np.ones(u.shape)], -1) @ matching.matrix(q).T
    with np.errstate(divide="ignore"):
        return scale * (np.array([2.5, 1.5, 2.0]) / np.abs(ray)).min(axis=-1)


@pytest.fixture(scope="module")
def room(spark):
    scales, turns = [1.0, 1.3, 0.8, 1.1], [0.0, 0.4, 0.8, 2.9]
    pixels, photos = [], []
    for k, (s, t) in enumerate(zip(scales, turns)):
        z = shot(about_y(t), s)
        v, u = np.mgrid[0:H_, 0:W_]
        pixels += [("r", k, *x) for x in zip(u.ravel().tolist(), v.ravel().tolist(), z.ravel().tolist())]
        photos.append(("r", k, FOCAL, W_, H_, tuple(about_y(t).tolist())))
    pixels += [("r", 0, 400, 0, None), ("r", 9, 0, 0, 1.0), ("s", 0, 0, 0, 1.0)]
    photos += [("r", 9, FOCAL, W_, H_, None)]
    kind = "room string, photo int, f double, wide int, high int, q struct<w: double, x: double, y: double, z: double>"
    return spark.createDataFrame(pixels, "room string, photo int, u int, v int, z double"), spark.createDataFrame(photos, kind), scales


def test_ratios_are_those_of_the_scales(room):
    pixels, photos, scales = room
    got = {(r.i, r.j): r for r in overlap.ratios(pixels, photos).collect()}
    assert set(got) == {(0, 1), (1, 2), (0, 2)}  # the last picture looks the other way
    for (i, j), r in got.items():
        assert r.log_ratio == pytest.approx(np.log(scales[i] / scales[j]), abs=0.01) and r.spread < 0.02 and r.share >= 0.04
    assert got[0, 1].share > got[0, 2].share


def test_ratios_by_brute_force(room):
    """Pixel by pixel as the definition says."""
    pixels, photos, scales = room
    depth = {k: shot(about_y(t), s) for k, (s, t) in enumerate(zip(scales, [0.0, 0.4, 0.8, 2.9]))}
    for r in overlap.ratios(pixels, photos).collect():
        m = matching.matrix(about_y([0.0, 0.4, 0.8, 2.9][r.j])).T @ matching.matrix(about_y([0.0, 0.4, 0.8, 2.9][r.i]))
        lr = []
        for v, u in itertools.product(range(0, H_, 4), range(0, W_, 4)):
            d = np.array([(u - W_ / 2) / FOCAL, (v - H_ / 2) / FOCAL, 1])
            x, y, z = m @ d
            if z > 0.2:
                p, q = x / z * FOCAL + W_ / 2, y / z * FOCAL + H_ / 2
                if 0 <= p <= W_ - 1 and 0 <= q <= H_ - 1:
                    p, q = round(p), round(q)
                    e = np.array([(p - W_ / 2) / FOCAL, (q - H_ / 2) / FOCAL, 1])
                    lr.append(np.log(depth[r.i][v, u] * np.linalg.norm(d) / (depth[r.j][q, p] * np.linalg.norm(e))))
        q1, m2, q3 = np.percentile(lr, [25, 50, 75])
        assert r.n == len(lr) and (r.log_ratio, r.spread) == pytest.approx((m2, (q3 - q1) / 1.349), abs=1e-9)


def test_scales_agree_again(room, spark):
    pixels, photos, scales = room
    left, dropped = overlap.consistent(overlap.ratios(pixels, photos), writer(spark, "pairs"))
    assert dropped.collect() == []
    got = {r.photo: r.log_scale for r in dense.harmonise(left).collect()}
    want = np.log(scales[:3]) - np.mean(np.log(scales[:3]))
    assert [got[k] for k in range(3)] == pytest.approx((-want).tolist(), abs=0.02)


def plain(pairs, most=0.15):
    """One room, one pair at a time."""
    live, out = dict(pairs), []
    while any(s > most for s in live.values()):
        s, pair = max((s, p) for p, s in live.items())
        best = [min((t for p, t in live.items() if x in p and p != pair), default=9e9) for x in pair]
        if best[0] == best[1]:
            del live[pair]
        else:
            out.append(pair[0] if best[0] > best[1] else pair[1])
            live = {p: t for p, t in live.items() if out[-1] not in p}
    return live, out


def test_pictures_that_disagree_go(spark):
    """A picture turned wrongly among five, a bad pair alone, and rooms at random with ties."""
    rng = random.Random(6)
    rooms = {"wrong": {p: 0.3 if 3 in p else 0.05 + 0.01 * p[0] for p in itertools.combinations(range(5), 2)}, "lone": {(0, 1): 0.4}, "good": {(0, 1): 0.1, (1, 2): 0.15}}
    for k in range(20):
        rooms[f"x{k}"] = {p: round(rng.choice([0.05, 0.1, 0.2, rng.uniform(0, 0.4)]), 2) for p in itertools.combinations(range(rng.randint(2, 7)), 2) if rng.random() < 0.7}
    rows = [(r, i, j, s) for r, pairs in rooms.items() for (i, j), s in pairs.items()]
    left, dropped = overlap.consistent(spark.createDataFrame(rows, "room string, i int, j int, spread double"), writer(spark, "pairs"))
    live, gone = {}, {}
    for r in left.collect():
        live.setdefault(r.room, {})[r.i, r.j] = r.spread
    for r in sorted(dropped.collect(), key=lambda r: r.turn):
        gone.setdefault(r.room, []).append(r.photo)
    for name, pairs in rooms.items():
        want = plain(pairs)
        assert (live.get(name, {}), gone.get(name, [])) == want
    assert gone["wrong"] == [3] and "lone" not in gone and "lone" not in live

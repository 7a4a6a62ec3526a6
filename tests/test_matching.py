"""Matches, rotations and chains against planted truth."""

import itertools

import numpy as np
import pytest

from plumbline.functions.tables import writer
from plumbline.operators import matching

FEATURES = "room string, photo long, feature long, descriptor array<float>"
RAYS = "room string, i long, j long, ax double, ay double, az double, bx double, by double, bz double"


def test_matches_by_brute_force(spark):
    """Copies of descriptors with noise, equal descriptors, and a picture of two features."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 16)).astype(np.float32)
    rows, photos = [], {}
    for room, photo in itertools.product("ab", range(3)):
        keep = rng.permutation(80)[:50]
        v = (base[keep] + rng.normal(0, 0.25, (50, 16))).astype(np.float32)
        v[7] = v[8]  # ties
        photos[room, photo] = v
        rows += [(room, photo, k, x.tolist()) for k, x in enumerate(v)]
    rows += [("a", 9, k, base[k].tolist()) for k in range(2)] + [("a", 0, 99, None), ("a", 0, 98, [None] * 16)]
    for size in (1024, 7):
        got = {(r.room, r.i, r.j, r.a, r.b): r.distance for r in matching.match(spark.createDataFrame(rows, FEATURES), size=size).collect()}
        want = {}
        for room, (i, j) in itertools.product("ab", itertools.combinations(range(3), 2)):
            x, y = photos[room, i].astype(float), photos[room, j].astype(float)
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
            for a in range(len(x)):
                b, second = np.argsort(d[a], kind="stable")[:2]
                if d[a, b] < 0.8 * d[a, second] and np.argsort(d[:, b], kind="stable")[0] == a:
                    want[room, i, j, a, b] = d[a, b]
        assert got == pytest.approx(want) and len(want) > 60
    assert matching.match(spark.createDataFrame([], FEATURES)).collect() == []


def quaternion(rng, most=np.pi):
    axis = rng.normal(size=3)
    axis /= np.linalg.norm(axis)
    t = rng.uniform(0.1, most)
    return np.array([np.cos(t / 2), *(np.sin(t / 2) * axis)])


def angle(p, q):
    return np.degrees(2 * np.arccos(min(1, abs(float(np.dot(p, q))))))


def planted(rng, q, n, wrong, noise):
    """Rays of n matches turned by q, with noise in degrees, and ``wrong`` more that are not."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(n + wrong, 3)) * (0.5, 0.4, 0.1) + (0, 0, 1))
    b = a @ matching.matrix(q).T
    b[n:] = unit(rng.normal(size=(wrong, 3)) * (0.5, 0.4, 0.1) + (0, 0, 1)) @ matching.matrix(q).T
    return a, unit(b + np.radians(noise) * rng.normal(size=b.shape))


def test_rotations_with_half_of_the_matches_wrong(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for k in range(12):
        truth[k] = quaternion(rng)
        a, b = planted(rng, truth[k], 120, 120, 0.2)
        rows += [("r", 0, k, *map(float, (*x, *y))) for x, y in zip(a, b)]
    rows += [("r", 1, 2, *map(float, (*x, *y))) for x, y in zip(*planted(rng, truth[0], 0, 60, 0))]  # agree on nothing
    rows += [("r", 1, 3, *map(float, (*x, *y))) for x, y in zip(*planted(rng, truth[0], 15, 0, 0))]  # too few
    rows += [("r", 1, 4, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)] * 40 + [("r", 1, 5, None, 0.0, 1.0, 0.0, 0.0, 1.0)] * 40  # one ray only, nulls
    got = {(r.i, r.j): r for r in matching.rotations(spark.createDataFrame(rows, RAYS)).collect()}
    assert set(got) == {(0, k) for k in range(12)}
    for k, q in truth.items():
        r = got[0, k]
        assert angle((r.w, r.x, r.y, r.z), q) < 0.2 and 110 <= r.inliers <= 140


def links_of(world, pairs, inliers=lambda i, j: 100):
    """Measured rotations i to j of pictures whose rotation into the world is ``world[i]``."""
    rows = []
    for i, j in pairs:
        m = matching.matrix(world[j]).T @ matching.matrix(world[i])
        q = matching.rotation(np.eye(3), m.T)
        rows.append(("r", i, j, *map(float, q), inliers(i, j)))
    return rows


def test_chains_lead_to_the_root(spark):
    rng = np.random.default_rng(8)
    world = [quaternion(rng) for _ in range(9)]
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (7, 8)]
    rows = links_of(world, pairs, lambda i, j: 50 if (i, j) == (0, 5) else 100 + i)
    photos = spark.createDataFrame([("r", k) for k in range(9)] + [("s", 0)], "room string, photo long")
    out, flags = matching.register(spark.createDataFrame(rows, matching.LINKS), photos, writer(spark, "chain"))
    got = {r.photo: r.q for r in out.where("room = 'r'").collect()}
    root = next(k for k, q in got.items() if q is not None and abs(q.w) > 1 - 1e-12)
    for k in range(6):
        want = matching.matrix(world[root]).T @ matching.matrix(world[k])
        assert np.allclose(matching.matrix(np.array(got[k])), want, atol=1e-9)
    assert [got[k] for k in (6, 7, 8)] == [None] * 3
    f = {r.room: r for r in flags.collect()}
    assert f["r"].flags == ["image_unregistered:6", "image_unregistered:7", "image_unregistered:8"] and f["r"].worst < 1e-5
    assert f["s"].flags == ["image_unregistered:0", "insufficient_registration"] and f["s"].worst is None


def test_a_loop_that_does_not_close(spark):
    rng = np.random.default_rng(9)
    world = [quaternion(rng) for _ in range(4)]
    rows = links_of(world, [(0, 1), (1, 2), (2, 3)])
    m = matching.matrix(world[3]).T @ matching.matrix(world[0])
    a = np.radians(5)
    q = matching.rotation(np.eye(3), (np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ m).T)
    rows.append(("r", 0, 3, *map(float, q), 20))
    photos = spark.createDataFrame([("r", k) for k in range(4)], "room string, photo long")
    _, flags = matching.register(spark.createDataFrame(rows, matching.LINKS), photos, writer(spark, "chain"))
    (f,) = flags.collect()
    assert f.flags == ["pose_loop_inconsistent"] and f.worst == pytest.approx(5, abs=1e-6)


def test_rays_to_chain(spark):
    """From rays of every pair, half of them wrong, to rotations within 0.3 degrees of the truth."""
    rng = np.random.default_rng(10)
    world = [quaternion(rng, 0.8) for _ in range(4)]
    rows = []
    for i, j in itertools.combinations(range(4), 2):
        m = matching.matrix(world[j]).T @ matching.matrix(world[i])
        a, b = planted(rng, matching.rotation(np.eye(3), m.T), 100, 100, 0.1)
        rows += [("r", i, j, *map(float, (*x, *y))) for x, y in zip(a, b)]
    photos = spark.createDataFrame([("r", k) for k in range(4)], "room string, photo long")
    out, _ = matching.register(matching.rotations(spark.createDataFrame(rows, RAYS)), photos, writer(spark, "chain"))
    got = {r.photo: np.array(r.q) for r in out.collect()}
    root = next(k for k, q in got.items() if abs(q[0]) > 1 - 1e-12)
    for k in range(4):
        want = matching.rotation(np.eye(3), (matching.matrix(world[root]).T @ matching.matrix(world[k])).T)
        assert angle(got[k], want) < 0.3

"""Placed rooms settled jointly: doorways that face each other through a wall pull their rooms together.

Pairs of doorways come from one join by cells over all captures. A capture's rooms, tens of them,
then share one small system: a room's correction is a turn about the middle of its doorways and a
shift, doorways whose pair disagrees with all others lose their say step by step, and corrections
that no pair asks for stay zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import placing

# Metres between the centres, degrees between the normals.
MAX_APART = 0.15
MAX_TURN = 8.0


def corridors(doors: DataFrame, wall: float = placing.WALL, apart: float = MAX_APART, turn: float = MAX_TURN) -> DataFrame:
    """Pairs of doorways of two rooms of a capture that nearly agree: room, opening, qx, qy of both, with apart and degrees.

    A doorway is taken at the middle of its wall, half of ``wall`` behind the room's side. Pairs lie
    within ``apart`` and face each other within ``turn`` degrees. They meet by cells a little wider than
    ``apart``, as a distance just at the limit can be rounded, one side in nine of them. Nulls take no part.
    """
    back = lambda c, n: F.col(c) - F.col(n) * (wall / 2)
    d = doors.where("x IS NOT NULL AND y IS NOT NULL AND nx IS NOT NULL AND ny IS NOT NULL").select("capture", "room", "opening", back("x", "nx").alias("qx"), back("y", "ny").alias("qy"), "nx", "ny")
    wide = apart * (1 + 1e-6)
    cell = lambda c: F.floor(F.col(c) / wide).cast("long")
    ring = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    a = d.select("capture", *[F.col(c).alias(f"{c}_a") for c in d.columns[1:]], ring("qx").alias("cx"))
    a = a.withColumn("cy", F.explode(F.array(*[F.floor(F.col("qy_a") / wide).cast("long") + k for k in (-1, 0, 1)])))
    b = d.select("capture", *[F.col(c).alias(f"{c}_b") for c in d.columns[1:]], cell("qx").alias("cx"), cell("qy").alias("cy"))
    near = a.join(b, ["capture", "cx", "cy"]).where("room_a < room_b")
    dx, dy = F.col("qx_a") - F.col("qx_b"), F.col("qy_a") - F.col("qy_b")
    gap = F.sqrt(dx * dx + dy * dy)  # not hypot, whose last bit differs: doorways lie at the limit itself
    opposed = -(F.col("nx_a") * F.col("nx_b") + F.col("ny_a") * F.col("ny_b"))
    degrees = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), opposed))))
    pairs = near.withColumn("apart", gap).withColumn("degrees", degrees).where((F.col("apart") <= apart) & (F.col("degrees") <= turn))
    return pairs.select("capture", "room_a", "opening_a", "room_b", "opening_b", "qx_a", "qy_a", "qx_b", "qy_b", "apart", "degrees")


def _system(pairs: pd.DataFrame, rooms: dict, middle: dict, root) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (turn, shift) of all rooms but the root, by which ends of pairs move towards each other."""
    a, y = np.zeros((2 * len(pairs), 3 * len(rooms))), np.zeros(2 * len(pairs))
    for k, p in enumerate(pairs.itertuples()):
        for room, x, z, sign in ((p.room_a, p.qx_a, p.qy_a, 1.0), (p.room_b, p.qx_b, p.qy_b, -1.0)):
            if room != root:
                at = 3 * rooms[room]
                mx, mz = middle[room]
                a[2 * k, at : at + 3] = sign * np.array([-(z - mz), 1.0, 0.0])
                a[2 * k + 1, at : at + 3] = sign * np.array([x - mx, 0.0, 1.0])
        y[2 * k : 2 * k + 2] = p.qx_b - p.qx_a, p.qy_b - p.qy_a
    return a, y


def _determined(pairs: pd.DataFrame, root) -> set:
    """Rooms that pairs tie to the root, if these pairs ask for more than the rooms have to give; else none."""
    tied, grown = {root}, True
    while grown:
        linked = pairs[pairs.room_a.isin(tied) | pairs.room_b.isin(tied)]
        new = tied | set(linked.room_a) | set(linked.room_b)
        grown, tied = new != tied, new
    n = int((pairs.room_a.isin(tied)).sum())
    return tied if 2 * n >= 3 * (len(tied) - 1) + 2 else set()


SETTLED = "capture string, room string, turn double, dx double, dy double, pairs int, residual double"


def settle(pairs: DataFrame, roots: DataFrame, apart: float = MAX_APART, scales: tuple = (4.0, 2.0, 1.0, 0.5, 0.25)) -> DataFrame:
    """(capture, room, turn, dx, dy, pairs, residual): how far each room moves so that all its pairs agree at best.

    ``roots`` has capture and room, the room of a capture that stays. A point p of a room goes to
    turn * p + (dx, dy). A pair's say falls with its residual, against a scale that narrows from four
    times ``apart`` to a quarter; pairs still farther off than ``apart`` and than three medians then
    go altogether. Rooms that no pairs tie to the root, and captures
    whose pairs leave the rooms room to move, have no rows. Rows go to one task a capture: its
    doorways are some hundred.
    """

    def solve(key: tuple, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[c.split()[0] for c in SETTLED.split(", ")])
        if not len(p) or not len(r):
            return empty
        root = r.room.min()
        tied = _determined(p, root)
        p = p[p.room_a.isin(tied) & p.room_b.isin(tied)].sort_values(["room_a", "opening_a", "room_b", "opening_b"])
        if not len(p):
            return empty
        rooms = {m: k for k, m in enumerate(sorted(tied - {root}))}
        ends = pd.concat([p[["room_a", "qx_a", "qy_a"]].set_axis(list("rxy"), axis=1), p[["room_b", "qx_b", "qy_b"]].set_axis(list("rxy"), axis=1)])
        middle = {m: (g.x.mean(), g.y.mean()) for m, g in ends.groupby("r")}
        a, y = _system(p, rooms, middle, root)
        off = lambda x: np.hypot(*(a @ x - y).reshape(-1, 2).T)

        def weighed(x, scale, rows):
            for _ in range(10):
                s = scale * apart
                w = np.repeat(rows * s * s / (s * s + off(x) ** 2), 2)
                x = np.linalg.lstsq(a * w[:, None], y * w, rcond=1e-9)[0]
            return x

        x = np.zeros(a.shape[1])
        for scale in scales:
            x = weighed(x, scale, np.ones(len(p)))
        miss = off(x)
        keep = miss <= max(apart, 3 * float(np.median(miss)))
        left = _determined(p[keep], root)
        if not left >= tied:
            return empty
        x = weighed(x, scales[-1], keep)
        miss, out = off(x), []
        for m, k in rooms.items():
            turn, mx, my = x[3 * k], *middle[m]
            # about the middle, as a turn about the origin
            c, s = np.cos(turn), np.sin(turn)
            own = keep & ((p.room_a == m) | (p.room_b == m)).to_numpy()
            out.append((key[0], m, turn, mx - c * mx + s * my + x[3 * k + 1], my - s * mx - c * my + x[3 * k + 2], int(own.sum()), float(np.sqrt((miss[own] ** 2).mean())) if own.any() else None))
        return pd.DataFrame(out, columns=empty.columns)

    return pairs.groupBy("capture").cogroup(roots.groupBy("capture")).applyInPandas(solve, SETTLED)


def settled(placements: DataFrame, corrections: DataFrame) -> DataFrame:
    """``placements`` of ``placing.glue`` with the corrections on top; rooms without one stay."""
    d = placements.join(corrections.select("capture", "room", "turn", "dx", "dy"), ["capture", "room"], "left")
    c, s = F.cos("turn"), F.sin("turn")
    here = F.col("turn").isNotNull()
    new = {
        "angle": F.when(here, F.col("angle") + F.col("turn")).otherwise(F.col("angle")),
        "sx": F.when(here, c * F.col("sx") - s * F.col("sy") + F.col("dx")).otherwise(F.col("sx")),
        "sy": F.when(here, s * F.col("sx") + c * F.col("sy") + F.col("dy")).otherwise(F.col("sy")),
    }
    return d.withColumns(new).select(placements.columns)


def move_doors(doors: DataFrame, placements: DataFrame) -> DataFrame:
    """Doorways of placed rooms in the shared frame, with their normals if they have them."""
    d = doors.join(placements.where("placed").select("capture", "room", "angle", "sx", "sy"), ["capture", "room"])
    c, s = F.cos("angle"), F.sin("angle")
    new = {"x": c * F.col("x") - s * F.col("y") + F.col("sx"), "y": s * F.col("x") + c * F.col("y") + F.col("sy")}
    if "nx" in doors.columns:
        new |= {"nx": c * F.col("nx") - s * F.col("ny"), "ny": s * F.col("nx") + c * F.col("ny")}
    return d.withColumns(new).select(doors.columns)


def refine(edges: DataFrame, doors: DataFrame, placements: DataFrame, wall: float = placing.WALL, apart: float = MAX_APART) -> DataFrame:
    """``placements`` settled over all pairs of doorways at once; the room that no other hosts is the root.

    Edges and doors are in their rooms' own frames.
    """
    normals = move_doors(placing.facing(doors, edges), placements)
    roots = placements.where("placed AND host IS NULL").select("capture", "room")
    return settled(placements, settle(corridors(normals, wall, apart), roots, apart))

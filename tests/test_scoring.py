"""Pairs against all permutations, tape measures, point files and the command line."""

import itertools
import json
import random

import numpy as np
import pytest

from plumbline import __main__ as command
from plumbline.plans import contract, scoring
from plumbline.sources import ply


def test_pairs_against_all_permutations():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice([1.0, 2.0, 2.5, rng.uniform(0, 5)]) for _ in range(rng.randrange(0, 5))] for _ in "ab")
        got = scoring.pairs(a, b)
        assert len(got) == min(len(a), len(b)) == len({i for i, _ in got}) == len({j for _, j in got})
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        best = min((sum(abs(x - y) for x, y in zip(short, p)) for p in itertools.permutations(long, len(short))), default=0.0)
        assert sum(abs(a[i] - b[j]) for i, j in got) == pytest.approx(best)


def plan_of(spark, lengths):
    schema = contract.schema()
    m = lambda v: {"value": v, "lo": None, "hi": None, "unit": "m", "method": "x", "note": None}
    wall = lambda k, v: {"id": f"w{k}", "start": None, "end": None, "length": m(v), "evidence": "wall_points"}
    room = lambda k, area, walls: {"id": f"room_{k}", "floor_area": m(area), "ceiling_height": m(None), "walls": walls, "openings": [], "damage": [{"id": "d", "damage_class": "water_stain"}]}
    rows = [{"capture": c, "tier": "lidar", "rooms": [room(0, 2.0, [wall(0, 9.0)]), room(1, 8.0, [wall(k, v) for k, v in enumerate(walls)])]} for c, walls in lengths.items()]
    return spark.createDataFrame(rows, schema)


def test_tape(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"rooms": {"hall": {"width": 300, "length": 400, "ceiling_height": 279, "openings": [{"id": "o1", "type": "door", "width": 90}, {"id": "o2", "type": "window", "width": 50}]}, "odd": {"walls": [{"id": "a", "length": 120.5}], "ceiling_height": 250}}}))
    t = scoring.truth(spark, str(tmp_path / "t.json")).cache()
    got = {(r["room"], r["item"], r["id"]): r["value"] for r in t.collect()}
    assert got[("hall", "area", None)] == 12.0 and got[("hall", "wall", "length3")] == 400 and got[("hall", "door", "o1")] == 90 and got[("odd", "wall", "a")] == 120.5
    assert ("odd", "area", None) not in got and ("hall", "door", "o2") not in got
    plans = plan_of(spark, {"one": [3.02, 4.5, 2.99], "two": [3.0, 4.495]})
    rooms = scoring.largest_rooms(plans)
    assert {r.room.id for r in rooms.collect()} == {"room_1"}
    tape = t.where("room = 'hall'").withColumn("capture", scoring.F.lit("one"))
    rows = scoring.score_walls(tape, rooms).collect()
    assert len(rows) == 4 and sum(r.passed is None for r in rows) == 1 and sum(bool(r.passed) for r in rows) == 2
    tally = scoring.tally(scoring.score_walls(tape, rooms), ["capture"], "passed").first()
    assert (tally.passed, tally.total) == (2, 4)
    a, b = (rooms.where(f"capture = '{c}'").withColumn("capture", scoring.F.lit("x")) for c in ("one", "two"))
    pairs = scoring.repeatability(a, b).collect()
    assert {(r.i, r.j, r.passed) for r in pairs} == {(2, 0, True), (1, 1, True)} or len(pairs) == 2
    text = command.lines(plans)
    assert text[0] == "one (lidar): 2 room(s)" and "1 water stain" in text[1] and "ceiling not measured" in text[1]


def test_ply(spark, tmp_path):
    p = np.random.default_rng(1).normal(size=(500, 3)).astype(np.float32)
    d = spark.createDataFrame([(*map(float, r),) for r in p] + [(None, 1.0, 1.0)], "x double, y double, z double")
    assert ply.write(d, str(tmp_path / "all.ply")) == 500 and ply.write(d, str(tmp_path / "some.ply"), 100) == 100
    assert {tuple(r) for r in ply.read(str(tmp_path / "all.ply"))} == {tuple(r) for r in p}
    assert {tuple(r) for r in ply.read(str(tmp_path / "some.ply"))} < {tuple(r) for r in p}


def test_command(spark, capsys):
    assert command.main(["schema"], spark) == 0 and json.loads(capsys.readouterr().out)["type"] == "struct"
    with pytest.raises(SystemExit):
        command.main([], spark)

"""Rooms of known size, from pictures on disk to the document."""

import json

import numpy as np
import pytest

from plumbline.functions.tables import writer
from plumbline.plans import contract, lidar
from plumbline.sources import captures, png
from tests import rooms


@pytest.fixture(scope="module")
def plans(spark, tmp_path_factory):
    """Three captures that one plan takes: a rectangle, two rooms with a door, and a room without a ceiling."""
    base = tmp_path_factory.mktemp("captures")
    ring = [(2.5 + 1.2 * np.cos(a), 2 + 0.9 * np.sin(a)) for a in np.arange(16) * np.pi / 8]
    rooms.write(str(base / "rect"), rooms.loop([(0, 0), (5, 0), (5, 4), (0, 4)]), ring)
    rooms.write(str(base / "open"), rooms.loop([(0, 0), (5, 0), (5, 4), (0, 4)]), ring, height=None)
    two = rooms.loop([(0, 0), (7, 0), (7, 4), (0, 4)]) + [(4, 0, 4, 1.55), (4, 2.45, 4, 4)]
    rooms.write(str(base / "two"), two, [(1 + 0.34 * i, 2 + 0.5 * np.sin(i)) for i in range(16)])
    save = writer(spark, "lidar")
    d = save(lidar.run(spark, f"{base}/*", save, reps=6))
    return {r["capture"]: r for r in d.collect()}, d, str(base)


def test_rectangle(plans):
    (room,) = plans[0]["rect"]["rooms"]
    assert room["floor_area"]["value"] == pytest.approx(20, rel=0.01)
    assert sorted(w["length"]["value"] for w in room["walls"]) == pytest.approx([4, 4, 5, 5], abs=0.03)
    assert room["ceiling_height"]["value"] == pytest.approx(2.6, abs=0.015)
    assert all(w["length"]["lo"] <= w["length"]["value"] <= w["length"]["hi"] for w in room["walls"])
    assert room["floor_area"]["lo"] < 20 < room["floor_area"]["hi"] and room["openings"] == []


def test_unseen_ceiling_is_null_with_a_note(plans):
    (room,) = plans[0]["open"]["rooms"]
    assert room["ceiling_height"]["value"] is None and room["ceiling_height"]["note"] and "ceiling not observed" in room["flags"]
    assert room["floor_area"]["value"] == pytest.approx(20, rel=0.01)


def test_two_rooms_and_their_door(plans):
    found = plans[0]["two"]["rooms"]
    assert sorted(r["floor_area"]["value"] for r in found) == pytest.approx([12, 16], rel=0.02)
    doors = [o for r in found for o in r["openings"]]
    assert len(doors) == 2 and all(o["width"]["value"] == pytest.approx(0.9, abs=0.06) for o in doors)
    assert all(o["centre"]["x"] == pytest.approx(4, abs=0.05) and o["centre"]["y"] == pytest.approx(-2, abs=0.05) for o in doors)


def test_stitching(plans):
    s = plans[0]["two"]["stitching"]
    assert s["footprint"]["value"] == pytest.approx(28, rel=0.02) and s["footprint"]["lo"] < 28 < s["footprint"]["hi"]
    assert {(k["room"], k["other"], k["mutual"]) for k in s["links"]} == {("room_0", "room_1", True), ("room_1", "room_0", True)} and s["overlaps"] == []


def test_document_keeps_nulls_and_drawing(plans, tmp_path):
    contract.write(plans[1], str(tmp_path / "plan"))
    lines = [json.loads(line) for f in (tmp_path / "plan").glob("*.json") for line in f.read_text().splitlines()]
    assert {d["capture"] for d in lines} == {"rect", "open", "two"}
    assert all("note" in r["ceiling_height"] and r["damage"] == [] for d in lines for r in d["rooms"])
    svg = {r["capture"]: r["svg"] for r in contract.drawing(plans[1]).collect()}
    assert svg["rect"].count("<polygon") == 1 and svg["two"].count("orange") == 2
    assert {r["class"] for r in contract.summary(plans[1]).collect()} == {None}


def test_sources(spark, plans, tmp_path):
    assert captures.detect_tier(spark, f"{plans[2]}/rect") == "lidar"
    f = captures.frames(spark, f"{plans[2]}/rect")
    assert f.count() == 384 and f.where("fx IS NULL").count() == 0
    px = captures.depth_pixels(spark, f"{plans[2]}/rect", f.where("idx = 5"))
    want = png.decode(open(f"{plans[2]}/rect/depth/000005.png", "rb").read())
    got = px.orderBy("v", "u").toPandas()
    assert len(got) == want.size and (got["z"].fillna(0).to_numpy() * 1000).round().astype(int).tolist() == want.ravel().tolist()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "odometry.csv").write_text("timestamp, frame\n0, 1\n")
    with pytest.raises(ValueError, match="lacks x"):
        captures.frames(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="no capture"):
        captures.detect_tier(spark, str(tmp_path))


@pytest.mark.parametrize("shape", [(7, 5), (6, 4, 3)])
@pytest.mark.parametrize("kind", ["uint8", "uint16"])
def test_png_round_trip(shape, kind):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (png.decode(png.encode(a)) == a).all()


def test_png_filters():
    """Rows under each of the five filters, filtered here byte by byte."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    out = np.zeros((5, 13), np.uint8)
    for r in range(5):
        out[r, 0] = r
        for i in range(12):
            left, up, corner = int(a[r, i - 2]) if i > 1 else 0, int(a[r - 1, i]) if r else 0, int(a[r - 1, i - 2]) if r and i > 1 else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            out[r, i + 1] = (int(a[r, i]) - [0, left, up, (left + up) // 2, paeth][r]) % 256
    assert (png._unfilter(out, 2) == a).all()


def test_lens_facts():
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    name = b"com.apple.quicktime.camera.focal_length.35mm_equivalent"
    keys = box(b"keys", bytes(4) + (1).to_bytes(4, "big") + box(b"mdta", name))
    data = box(b"data", (1).to_bytes(4, "big") + bytes(4) + b"26")
    clip = box(b"ftyp", b"qt  ") + box(b"moov", box(b"meta", keys + box(b"ilst", box((1).to_bytes(4, "big"), data))))
    assert captures.lens_facts(clip) == {"focal_35mm": 26.0}
    assert captures.lens_facts(clip[:-9])["focal_35mm"] is None and captures.lens_facts(b"")["focal_35mm"] is None

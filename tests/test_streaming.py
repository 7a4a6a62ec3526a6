"""Streams give what tables give, and a late frame changes nothing."""

import datetime

import pytest

from plumbline.streaming import keyframes

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a query over batches of rows, each a file, and gives the rows that came out."""

    def run(batches, schema, query, mode):
        folder = tmp_path / "in"
        for k, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(folder))
            src = spark.readStream.schema(schema).parquet(str(folder))
            q = query(src).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
            out = []
            q = q.foreachBatch(lambda df, _, out=out: out.extend(df.collect())).trigger(availableNow=True).start()
            q.awaitTermination()
            yield out

    return run


FRAMES = "clip long, ts timestamp, frame long, sharpness double"


def test_sharpest_frames(spark, stream):
    a = [(1, at(0.0), 0, 1.0), (1, at(0.05), 1, 3.0), (1, at(0.1), 2, 3.0), (1, at(0.2), 3, 2.0), (2, at(0.1), 0, None)]
    b = [(1, at(200), 4, 1.0)]
    late = [(1, at(0.06), 5, 9.0), (1, at(500), 6, 1.0)]
    query = lambda d: keyframes.sharpest(d)
    out = [sorted((r["clip"], r["frame"]) for r in rows) for rows in stream([a, b, late], FRAMES, query, "append")]
    assert sorted(sum(out, [])) == [(1, 1), (1, 3), (1, 4)]
    table = keyframes.sharpest(spark.createDataFrame(a + b, FRAMES)).collect()
    assert sorted((r["clip"], r["frame"]) for r in table) == [(1, 1), (1, 3), (1, 4)]


def test_running_means(stream):
    a, b = [(1, 2.0, 1.0), (1, 4.0, 1.0), (2, 1.0, 0.0)], [(1, 6.0, 2.0), (1, None, 5.0)]
    out = list(stream([a, b], "k long, value double, weight double", lambda d: keyframes.running_means(d, ["k"]), "update"))
    assert [(r["k"], r["views"], r["mean"], r["var"]) for r in out[-1]] == [(1, 3, 4.5, pytest.approx(2.75))]


def test_track(spark, stream):
    schema = "clip long, ts timestamp, x double, y double, length double"
    a = [(1, at(1), 50.0, 50.0, 9.0), (1, at(1), 10.0, 10.0, 20.0), (1, at(2), 12.0, 10.0, 9.0), (1, at(2), 300.0, 10.0, 99.0)]
    b = [(1, at(3), None, None, None), (1, at(4), 14.0, 12.0, 5.0)] + [(1, at(t), 900.0, 0.0, 1.0) for t in range(5, 10)] + [(1, at(20), 14.0, 12.0, 5.0), (2, at(1), None, None, None)]
    want = [(1, at(1), 10.0, 10.0), (1, at(2), 12.0, 10.0), (1, at(4), 14.0, 12.0)]
    assert sorted(map(tuple, keyframes.track(spark.createDataFrame(a + b, schema)).collect())) == want
    out = list(stream([a, b], schema, keyframes.track, "append"))
    assert sorted(map(tuple, sum(out, []))) == want


def test_track_ends_with_its_time(spark, tmp_path):
    """Frames after the limit do not count, and the state of clips that are over is gone."""
    schema = "clip long, ts timestamp, x double, y double, length double, started timestamp"
    a = [(1, at(1), 10.0, 10.0, 20.0, at(0)), (1, at(2), 12.0, 10.0, 9.0, at(0)), (2, at(5), 7.0, 7.0, 3.0, at(4)), (3, at(3), 1.0, 1.0, 1.0, None)]
    b = [(1, at(9), 14.0, 10.0, 9.0, at(0)), (1, at(11), 14.0, 10.0, 9.0, at(0)), (2, at(13), 9.0, 7.0, 3.0, at(4)), (4, at(60), 5.0, 5.0, 5.0, at(55))]
    c = [(1, at(9.5), 15.0, 10.0, 9.0, at(0)), (1, at(70), 15.0, 10.0, 9.0, at(0)), (4, at(62), 6.0, 5.0, 5.0, at(55))]
    want = [(1, at(1), 10.0, 10.0), (1, at(2), 12.0, 10.0), (1, at(9), 14.0, 10.0), (2, at(5), 7.0, 7.0), (2, at(13), 9.0, 7.0), (4, at(60), 5.0, 5.0), (4, at(62), 6.0, 5.0)]
    table = keyframes.track(spark.createDataFrame(a + b + c[1:], schema), until=10.0)
    assert sorted(map(tuple, table.collect())) == want
    out, held = [], []
    for rows in (a, b, c):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = keyframes.track(src, until=10.0).writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        q = q.foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(map(tuple, out)) == want  # the frame at 9.5 came after its clip was over
    assert held == [2, 1, 1]

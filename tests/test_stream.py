"""The stream of frame pairs: state that goes away, late frames, frames older than the watermark."""

from datetime import datetime, timedelta

import pytest

from framelake.streaming import pairs

SCHEMA = "seq_id long, frame_no long, pos long, ts timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get(pairs.PROVIDER[0])
    spark.conf.set(*pairs.PROVIDER)
    yield
    spark.conf.set(pairs.PROVIDER[0], before)


def test_state_goes_and_late_frames_are_marked(spark, tmp_path, store):
    hours = lambda h: START + timedelta(hours=h)
    batches = [
        [(1, 0, 10, hours(0)), (1, 1, 11, hours(1)), (2, 0, 20, hours(1))],
        [(2, 2, 22, hours(3)), (2, 3, 23, hours(3))],
        [(2, 1, 21, hours(3))],  # after number 3: late
        [(3, 0, 30, hours(60))],  # the watermark goes far past sequences 1 and 2
        [(3, 1, 31, hours(61))],
        [(1, 2, 12, hours(62)), (2, 4, 24, hours(62))],  # forgotten: first frames again
    ]
    kept = []
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = (pairs.stream_frame_pairs(stream, ttl=24 * 3600, delay="2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination()
        kept.append(sum(r["numRowsTotal"] for p in query.recentProgress[-1:] for r in p["stateOperators"]))
    got = {(r.seq_id, r.frame_no): (r.prev_pos, r.is_first, r.late) for r in spark.read.schema(pairs.OUT).parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): (None, True, False), (1, 1): (10, False, False), (2, 0): (None, True, False), (2, 2): (20, False, False), (2, 3): (22, False, False),
                   (2, 1): (None, False, True), (3, 0): (None, True, False), (3, 1): (30, False, False), (1, 2): (None, True, False), (2, 4): (None, True, False)}
    assert kept[2] == 2 and kept[3] == 1


def test_a_table_gives_the_pairs_of_a_window(spark):
    rows = [(s, n, s * 100 + n, START + timedelta(minutes=n * 7 + s)) for s in range(6) for n in range(30)]
    got = sorted(map(tuple, pairs.pairs_of_table(spark, spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(s, n, s * 100 + n, s * 100 + n - 1 if n else None, n == 0, False) for s in range(6) for n in range(30)]
    assert pairs.pairs_of_table(spark, spark.createDataFrame([], SCHEMA)).count() == 0

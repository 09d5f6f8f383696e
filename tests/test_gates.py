"""The gates' figures, to the last digit, against SQL on small tables of ties."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framelake.operators import gates
from framelake.plans.queries import ORACLES, QUERIES


def events(folder, users):
    """events.parquet of users {user_id: [(value, lines)]}, an event a second."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, v, k) for u, frames in users.items() for v, k in frames]
    pq.write_table(pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([start + datetime.timedelta(seconds=i) for i in range(len(rows))], pa.timestamp("us")),
        "user_id": pa.array([u for u, _, _ in rows], pa.int64()), "event_type": ["view"] * len(rows), "value": pa.array([v for _, v, _ in rows], pa.float64()),
        "props": [f'{{"k": {k}}}' for _, _, k in rows]}), folder / "events.parquet")


def both(spark, folder, name):
    """(rows of Spark, rows of SQL), as they are."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = QUERIES[name](spark, str(folder))
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    return sorted(tuple(r) for r in df.collect()), sorted(tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall())


def test_figures_are_rounded_from_the_exact_value(spark):
    want = {47.03125: "47.0312", 47.09375: "47.0938", 40.38525: "40.3852", 37.66375: "37.6638", -0.00001: "-0.0000", 0.00005: "0.0001", -0.00005: "-0.0001", 1e6: "1000000.0000",
            float("nan"): "nan", float("inf"): "inf", float("-inf"): "-inf"}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert [r[0] for r in df.select(gates.figure(df.x)).collect()] == list(want.values())


def test_iou_gate_states_ties_as_sql_does(spark, tmp_path):
    events(tmp_path, {1: [(40.38525, 60)], 2: [(37.66375, 60)], 3: [(60.0, 47)] * 31 + [(60.0, 48)], 4: [(60.0, 47)] * 29 + [(60.0, 48)] * 3,
                      5: [(34.957187499999996, 60)]})
    got, want = both(spark, tmp_path, "seq_gate_iou")
    assert [r[-1] for r in got] == ["mean iou 40.3852 < 50", "mean iou 37.6638 < 50", "mean lines 47.0312 < 48", "mean lines 47.0938 < 48", "mean iou 34.9572 < 50"]
    assert got[4][3] == 34.957188
    assert got == want


def test_line_gate_states_ties_as_sql_does(spark, tmp_path):
    events(tmp_path, {1: [(50.0, 40)] * 31 + [(50.0, 41)], 2: [(50.0, 40)] * 29 + [(50.0, 41)] * 3, 3: [(42.816562499999996, 60)]})
    got, want = both(spark, tmp_path, "seq_gate_lines")
    assert [r[-1] for r in got] == ["mean lines 40.0312 < 48", "mean lines 40.0938 < 48", None] and got[2][3] == 42.816563
    assert got == want


def test_quality_gate_states_ties_as_sql_does(spark, tmp_path):
    events(tmp_path, {1: [(60.15625, 60)], 2: [(52.40615, 60)], 3: [(50.0, 45)] * 31 + [(50.0, 46)], 4: [(42.816562499999996, 60)]})
    got, want = both(spark, tmp_path, "seq_gate_quality")
    assert [r[-1] for r in got] == [f"mean chamfer {60.15625:.4f} > 52", f"mean chamfer {52.40615:.4f} > 52", "mean lines 45.0312 < 48", None]
    assert got == want

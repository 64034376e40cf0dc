"""Committed artifacts, late events in kept bars, keyed live books."""

import datetime as dt

import pytest

from pitfolio.operators import features
from pitfolio.sources import artifacts
from pitfolio.streaming import bars_stream
from pitfolio.streaming.ledger_stream import ledger_stream

EVENTS = "event_id long, ts timestamp, event_type string, value double"


def test_a_killed_run_is_in_no_catalogue(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, 2.0), ("t", 2, 3.0)], "strategy string, i int, v double")
    artifacts.write_artifacts("good", str(tmp_path), {"values": t}, created_at="2024-01-01 10:00:00")
    bad = t.selectExpr("strategy", "i", "raise_error('killed') v")
    for run in ("good", "lost"):
        with pytest.raises(Exception, match="killed"):
            artifacts.write_artifacts(run, str(tmp_path), {"values": t.where("false"), "board": bad}, created_at="2024-01-02 10:00:00")
    assert [r.run_id for r in artifacts.run_catalog(spark, str(tmp_path)).collect()] == ["good"]
    assert artifacts.read_artifact(spark, str(tmp_path), "good", "values").count() == 2
    artifacts.write_artifacts("good", str(tmp_path), {"values": t.limit(1)}, created_at="2024-01-03 10:00:00")
    assert artifacts.read_artifact(spark, str(tmp_path), "good", "values").count() == 1
    assert [(r.run_id, r.created_at.day) for r in artifacts.run_catalog(spark, str(tmp_path)).collect()] == [("good", 3)]
    with pytest.raises(ValueError, match="no committed run"):
        artifacts.artifact_path(spark, str(tmp_path), "lost", "values")


def test_late_and_reordered_events_give_the_bars_of_a_batch(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    batches = [
        [(5, at(2, 12), "x", 5.0), (6, at(3, 9), "x", 6.0)], [(1, at(2, 8), "x", 9.0), (7, at(9, 1), "y", 7.0), (8, at(9, 2), "y", None)], [(2, at(2, 20), "x", 1.0), (3, at(2, 20), "x", 2.0), (9, at(3, 1), "x", 4.0)],
    ]
    src, root = str(tmp_path / "in"), str(tmp_path / "bars")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
        q = bars_stream.keep_bars(bars_stream.read_event_stream(spark, src, EVENTS), root, str(tmp_path / "cp"))
        q.awaitTermination(120)
        if n == 1:
            bars_stream.compact_bars(spark, root)
    every = spark.createDataFrame([r for rows in batches for r in rows], EVENTS)
    want = sorted(map(tuple, bars_stream.event_bars(every).collect()))
    assert sorted(map(tuple, bars_stream.kept_bars(spark, root).collect())) == want and len(want) == 3
    bars_stream.compact_bars(spark, root)
    assert sorted(map(tuple, bars_stream.kept_bars(spark, root).collect())) == want
    # a batch that is run again replaces itself
    bars_stream.partial_bars(spark.createDataFrame(batches[2], EVENTS)).write.mode("overwrite").parquet(f"{root}/batch={2:012d}")
    assert sorted(map(tuple, bars_stream.kept_bars(spark, root).collect())) == want
    with pytest.raises(ValueError, match="no bars"):
        bars_stream.kept_bars(spark, str(tmp_path / "nowhere"))


def test_live_books_survive_a_restart_and_drop_dust(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "portfolio_id string, fill_id long, ticker string, shares double, cash_flow double"
    batches = [[("p", 1, "A", 2.0, -60.0), ("p", 2, "B", 1.0, -30.0)], [("p", 3, "A", -2.0, 70.0)], [("p", 4, "A", 1.0, -30.0), ("p", 5, "B", 1.0, -60.0), ("p", 6, "B", 1.0, -20.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = ledger_stream(spark.readStream.schema(schema).parquet(src), 100.0).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").start().awaitTermination(180)
    out = {r.fill_id: (r.position, r.cash, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: (2.0, 40.0, True), 2: (1.0, 10.0, True), 3: (0.0, 80.0, True), 4: (1.0, 50.0, True), 5: (1.0, 50.0, False), 6: (2.0, 30.0, True)}


def test_two_keyword_slots_a_ticker(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    series = spark.createDataFrame([(k, day(i), day(i), float(i + 1 + 100 * (k == "b"))) for k in "ab" for i in range(100)], "series string, date date, available_date date, value double")
    feats = features.level_change_features(series, spark.createDataFrame([(day(90),), (day(10),)], "date date"), (28, 84))
    bridge = spark.createDataFrame([("X", "a", "b"), ("Y", "b", "none"), ("Z", None, None)], "ticker string, kw1 string, kw2 string")
    got = {(r.ticker, r.date): r.asDict() for r in features.bridged_features(feats, bridge).collect()}
    assert len(got) == 6
    x = got["X", day(90)]
    assert x["kw1_level"] == 91.0 and x["kw2_level"] == 191.0 and x["kw1_change_28"] == pytest.approx(91 / 63 - 1) and x["kw2_change_84"] == pytest.approx(191 / 107 - 1)
    assert got["Y", day(90)]["kw1_level"] == 191.0 and got["Y", day(90)]["kw2_level"] == 0.0
    assert all(v == 0.0 for c, v in got["Z", day(10)].items() if c.startswith("kw")) and got["X", day(10)]["kw1_change_28"] == 0.0

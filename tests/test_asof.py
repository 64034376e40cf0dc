"""As-of joins and training windows against plain Python, with one key that holds most rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitfolio.operators import calendar, features, models

T0 = dt.datetime(2024, 1, 1)


def brute(left, right, default):
    out = []
    for i, k, t in left:
        seen = [(u, v) for kk, u, v in right if kk == k and u is not None and v is not None and t is not None and u <= t]
        out.append((i, max(seen)[1] if seen else default))
    return sorted(out)


@pytest.mark.parametrize("kind", ["int", "date", "timestamp"])
def test_hot_key_equals_brute_force_and_is_many_tasks(spark, kind):
    r = np.random.default_rng(11)
    when = {"int": int, "date": lambda x: (T0 + dt.timedelta(int(x))).date(), "timestamp": lambda x: T0 + dt.timedelta(seconds=int(x))}[kind]
    key = lambda: None if r.random() < 0.02 else "hot" if r.random() < 0.9 else f"k{r.integers(5)}"
    time = lambda: None if r.random() < 0.02 else when(r.integers(0, 300))
    left = [(i, key(), time()) for i in range(900)]
    right = [(key(), time(), None if r.random() < 0.1 else float(r.integers(0, 50))) for _ in range(400)]
    a, b = spark.createDataFrame(left, f"i int, k string, at {kind}"), spark.createDataFrame(right, f"k string, d {kind}, v double")
    for parts in (1, 2, 32):
        out = calendar.asof_join(a, b, ["k"], "at", "d", "v", -1.0, parts=parts)
        assert sorted((x.i, x.v) for x in out.collect()) == brute(left, right, -1.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = calendar.asof_join(a.where("k = 'hot'"), b, ["k"], "at", "d", "v").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks == 4  # all partitions of the session


def test_snapping_equals_brute_force(spark):
    r = np.random.default_rng(2)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(int(n))
    have = sorted({day(n) for n in r.integers(0, 400, 60)})
    ask = [day(n) for n in r.integers(-5, 410, 200)]
    t, a = spark.createDataFrame([(d,) for d in ask], "value date"), spark.createDataFrame([(d,) for d in have], "date date")
    for direction, best in (("forward", lambda d: min((x for x in have if x >= d), default=None)), ("backward", lambda d: max((x for x in have if x <= d), default=None))):
        got = sorted((x.value, str(x.snapped)) for x in calendar.snap_date(t, a, direction).collect())
        assert got == sorted((d, str(best(d))) for d in ask)


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "k", 5)], "i int, k string, at int"), spark.createDataFrame([], "k string, d int, v double")
    assert [x.v for x in calendar.asof_join(a, b, ["k"], "at", "d", "v").collect()] == [None]
    assert calendar.asof_join(a.where("false"), b, ["k"], "at", "d", "v").count() == 0


def test_window_sums_keep_ten_digits_over_a_long_history(spark):
    r = np.random.default_rng(4)
    x = r.normal(1e-2, 1.0, 4000) ** 2
    per = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(x) if i % 7], "decision_idx int, g double, n long")
    windows = spark.createDataFrame([(i, max(0, i - 60), i - 2) for i in range(4000)], "refit_idx int, lo int, hi int")
    for row in models.window_sums(per, windows, ["g", "n"]).collect():
        use = [j for j in range(max(0, row.refit_idx - 60), row.refit_idx - 1) if j % 7]
        assert row.n == len(use) and abs(row.g - x[use].sum()) <= 1e-10 * max(1.0, x[use].sum())


@pytest.mark.parametrize("days", [None, 50])
def test_training_windows_are_the_definition(spark, days):
    at = [dt.date(2024, 1, 3) + dt.timedelta(n // 2 * 7 + n % 2 * 2) for n in range(40)]
    rows = [(i, at[i], at[i + 1] + dt.timedelta(1) if i < 39 else None) for i in range(40)]
    s = spark.createDataFrame(rows, "decision_idx int, decision_date date, next_fill date")
    for embargo in (0, 1, 3):
        got = {(x.refit_idx, x.decision_idx) for x in models.training_sets(s, embargo, days).collect()}
        assert got == {(i, j) for i in range(40) for j in range(39) if j <= i - 1 - embargo and rows[j][2] < at[i] and (days is None or (at[i] - at[j]).days <= days)}


def test_sliding_drawdown_equals_a_scan(spark):
    from pyspark.sql import Window

    r = np.random.default_rng(6)
    rows = [(k, i, None if r.random() < 0.05 else float(np.exp(r.normal()))) for k in ("a", "b") for i in range(150)] + [("c", 0, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, i int, x double")
    w = Window.partitionBy("ticker").orderBy("i")
    for n in (1, 2, 7, 63):
        got = {(x.ticker, x.i): x.dd for x in features.sliding_drawdown(df, w, "x", n, "dd").collect()}
        for k, i, _ in rows:
            v = [x for kk, j, x in rows if kk == k and i - n < j <= i and x is not None]
            want = min((v[b] / max(v[: b + 1]) - 1 for b in range(len(v))), default=None)
            assert got[k, i] == want, (n, k, i)

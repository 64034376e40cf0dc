"""Hand-computed ledger and calendar cases, and the registered queries against DuckDB."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from pitfolio.operators import calendar, features, ledger, stats
from pitfolio.plans import portfolios, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


#: Queries whose operators others of the list run as well.
COVERED = {"expanded_features", "moving_averages", "interval_returns", "strategy_weights", "weight_paths", "rolling_board", "ranked_board", "performance", "equity_curves", "best_overall"}
QUERIES, SQL = queries.QUERIES | portfolios.QUERIES, queries.SQL | portfolios.SQL


@pytest.mark.parametrize("name", sorted(set(SQL) - COVERED))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    same = lambda d: d[cols].assign(**{c: d[c].map(lambda x: None if pd.isna(x) else str(pd.Timestamp(x).date())) for c in cols if c in ("at", "date", "start", "end") or c.endswith(("_date", "usable_start", "usable_end"))}).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(same(got), same(want), check_dtype=False, atol=2e-6)


def test_schedule_stops_at_the_first_decision_without_a_fill(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 4),), (dt.date(2024, 1, 5),)], "date date")
    got = [(r.decision_date.day, r.status) for r in calendar.build_schedule(days).orderBy("decision_date").collect()]
    assert got == [(3, "kept"), (5, "skipped")]


def test_asof_takes_the_last_published_value(spark):
    left = spark.createDataFrame([("m", dt.date(2024, 1, 10)), ("m", dt.date(2024, 2, 10)), ("m", dt.date(2024, 1, 1))], "k string, at date")
    right = spark.createDataFrame([("m", dt.date(2024, 1, 5), 1.0), ("m", dt.date(2024, 2, 5), 999.0)], "k string, d date, v double")
    got = {r["at"]: r.v for r in calendar.asof_join(left, right, ["k"], "at", "d", "v", 0.0).collect()}
    assert got == {dt.date(2024, 1, 10): 1.0, dt.date(2024, 2, 10): 999.0, dt.date(2024, 1, 1): 0.0}


def test_orders_and_fills(spark):
    prices = spark.createDataFrame([(0, "A", 100.0)], "decision_idx int, ticker string, price double")
    targets = spark.createDataFrame([(1, 0, "A", 1.0)], "portfolio_id int, decision_idx int, ticker string, weight double")
    none = spark.createDataFrame([], "portfolio_id int, decision_idx int, ticker string, shares double")
    totals = spark.createDataFrame([(1, 0, 1000.0)], "portfolio_id int, decision_idx int, total_value double")
    order = ledger.generate_orders(targets, none, prices, totals).collect()
    assert [round(o.shares, 9) for o in order] == [9.9]
    wish = spark.createDataFrame([(1, 0, "A", 10.0, 0)], "portfolio_id int, decision_idx int, ticker string, shares double, ord int")
    cash = spark.createDataFrame([(1, 0, 251.0)], "portfolio_id int, decision_idx int, cash double")
    fill = ledger.fill_orders(wish, prices, cash, slippage_bps=0.0, flat=1.0).first()
    assert round(fill.shares, 9) == 2.5 and round(fill.cash_flow, 9) == -251.0


def test_constant_growth_has_no_sharpe(spark):
    v = spark.createDataFrame([("s", dt.date(2024, 1, 1), 100.0), ("s", dt.date(2024, 7, 2), 110.0), ("s", dt.date(2025, 1, 1), 121.0)], "strategy string, date date, value double")
    m = stats.performance_metrics(v).first()
    assert round(m.total_return, 9) == 21.0 and m.sharpe == 0.0 and m.max_drawdown == 0.0
    assert m.cagr == pytest.approx((1.21 ** (365.25 / 366) - 1) * 100)


def test_features_ignore_the_future(spark):
    rows = [("S", dt.date(2023, 1, 1) + dt.timedelta(i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1e6 + i) for i in range(80)]
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"
    day = rows[70][1]
    a = features.base_features(spark.createDataFrame(rows, schema)).where(f"date <= date '{day}'").orderBy("date").collect()
    b = features.base_features(spark.createDataFrame(rows[:71] + [(*r[:5], 1e6, r[6]) for r in rows[71:]], schema)).where(f"date <= date '{day}'").orderBy("date").collect()
    assert a == b and len(a) == 7


def test_average_rank_percentile_on_ties(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0), (2, 5.0)], "d int, x double")
    got = sorted((r.d, r.x, r.p) for r in stats.avg_rank_percentile(d, "d", "x", "p").collect())
    assert [round(p, 9) for _, _, p in got] == [0.0, 0.5, 0.5, 1.0, 1.0]

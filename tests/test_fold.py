"""A thousand books fed with targets and needed marks only, against each book folded alone over every mark."""

import datetime as dt

import numpy as np
import pytest

from pitfolio.operators import book, calendar

TICKERS = [f"T{i}" for i in range(7)]
PARAMS = {"max_weight": 0.5, "turnover_cap": 0.4, "min_notional": 1.0, "buffer": 0.01, "slippage_bps": 5.0, "commission": 0.25, "fractional": True}


def market(seed=1, sessions=70):
    """Bars with gaps: a ticker does not trade every day, one starts late, some closes are not valid."""
    r, day, out = np.random.default_rng(seed), dt.date(2024, 1, 1), []
    price = dict.fromkeys(TICKERS, 50.0)
    for n in range(sessions):
        at = day + dt.timedelta(n // 5 * 7 + n % 5)
        for i, t in enumerate(TICKERS):
            price[t] *= float(np.exp(r.normal(0, 0.02)))
            if n == 0 and i < 6 or n > 4 * i and r.random() < 0.8:
                out.append((t, at, price[t] if r.random() < 0.95 or n == 0 else float("nan")))
    return out


def wanted(portfolios, decisions, seed=2):
    r, out = np.random.default_rng(seed), []
    for p in range(portfolios):
        mine = r.choice(TICKERS, int(r.integers(1, 4)), replace=False)
        for d in range(int(r.integers(0, 6)), decisions):
            if r.random() < 0.5:
                out += [(f"p{p}", d, str(t), float(r.random())) for t in mine if r.random() < 0.8]
    return out


@pytest.fixture(scope="module")
def inputs(spark):
    bars = spark.createDataFrame(market(), "ticker string, date date, close double")
    schedule = calendar.build_schedule(calendar.sessions(bars))
    targets = wanted(1000, schedule.where("status = 'kept'").count())
    return bars, schedule, targets, spark.createDataFrame(targets, "strategy string, decision_idx int, ticker string, weight double")


def alone(bars, schedule, targets):
    """Every book by itself, with all tickers marked at each decision."""
    rows, days = bars.collect(), sorted(schedule.where("status = 'kept'").collect(), key=lambda r: r.decision_idx)
    last = lambda t, at: max(((b.date, b.close) for b in rows if b.ticker == t and b.date <= at and b.close > 0), default=(None, None))[1]
    marks = {(d.decision_idx, t): (last(t, d.decision_date), last(t, d.fill_date)) for d in days for t in TICKERS}
    goal = {(p, d, t): w for p, d, t, w in targets}
    out = {}
    for p in {x[0] for x in targets}:
        held, cash = {}, 1000.0
        for d in days:
            k = d.decision_idx
            step = [{"ticker": t, "weight": goal.get((p, k, t)), "decision_price": marks[k, t][0], "fill_price": marks[k, t][1], "eligible": None} for t in TICKERS if marks[k, t][0] is not None]
            lines, held, cash = book._step(step, held, cash, PARAMS)
            out.update({(p, k, line[0]): line for line in lines})
    return out


def test_books_equal_books_folded_alone(spark, inputs):
    bars, schedule, targets, t = inputs
    want = alone(bars, schedule, targets)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows_a_batch in (before, "37"):  # batches that end within a decision
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        got = {(r.portfolio_id, r.decision_idx, r.ticker): r for r in book.rebalance_paths(book.fold_rows(t, schedule, bars, "close", "close"), initial=1000.0, **PARAMS).collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert set(got) == set(want) and len({k[0] for k in got}) > 950
        for k, line in want.items():
            mine = [got[k][c] for c in ("raw_weight", "target_weight", "order_shares", "shares", "position", "cash")]
            theirs = [line[1], line[2], line[3], line[4], line[10], line[14]]
            assert [x is None for x in mine] == [x is None for x in theirs], k
            assert all(x is None or abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(mine, theirs, strict=True)), k


def test_rows_of_a_book_are_those_it_may_need(inputs):
    bars, schedule, targets, t = inputs
    rows = book.fold_rows(t.where("strategy = 'p3'"), schedule, bars, "close", "close").collect()
    mine = {x[2] for x in targets if x[0] == "p3"}
    assert {r.ticker for r in rows} == mine | {"cash"}
    plan = book.fold_rows(t, schedule, bars, "close", "close")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_held_books_sell_leavers_only(spark):
    day = lambda n: dt.date(2024, 1, 3) + dt.timedelta(n)
    rows = [("h", i, day(7 * i), day(7 * i + 1), t, None, 0.5, 10.0 + i, 10.0 + i, not (t == "B" and i >= 2), True) for i in range(4) for t in "AB"]
    schema = "portfolio_id string, decision_idx int, decision_date date, fill_date date, ticker string, ord int, weight double, decision_price double, fill_price double, eligible boolean, hold boolean"
    out = {(r.decision_idx, r.ticker): r for r in book.rebalance_paths(spark.createDataFrame(rows, schema), initial=100.0, max_weight=1.0, turnover_cap=1.0, buffer=0.0, slippage_bps=0.0).collect()}
    assert [out[i, "A"].position for i in range(4)] == [5.0] * 4 and [out[i, "B"].position for i in range(4)] == [5.0, 5.0, 0.0, 0.0]
    assert out[2, "B"].shares == -5.0 and out[2, "B"].turnover_post == pytest.approx(0.5) and out[1, "A"].turnover_post == 0.0 and out[3, "A"].cash == pytest.approx(60.0)

"""Books, forecasts, selection, artifacts and streams by hand cases and plain Python."""

import datetime as dt

import numpy as np
import pytest

from pitfolio.functions import columns
from pitfolio.operators import boards, book, calendar, coverage, evaluation, features, labels, ledger, models, selection, stats, strategies
from pitfolio.sources import artifacts, bars
from pitfolio.streaming.ledger_stream import ledger_stream

DAY = dt.date(2024, 1, 3)


def day(n):
    return DAY + dt.timedelta(n)


def test_constraints_by_hand(spark):
    t = spark.createDataFrame([("p", 0, "A", 0.9), ("p", 0, "B", 0.3), ("p", 0, "C", -0.2)], "portfolio_id string, decision_idx int, ticker string, weight double")
    now = spark.createDataFrame([("p", 0, "D", 0.5)], t.schema)
    got = {r.ticker: r for r in ledger.apply_constraints(t, now, 0.35, 0.35).collect()}
    # 0.9 and 0.3 scale to 0.75 and 0.25, the cap leaves 0.35 and 0.25; against 0.5 of D and half cash: turnover (0.6 + 0.5 + 0.1) / 2
    scale = 0.35 / 0.6
    assert got["A"].turnover_pre == pytest.approx(0.6) and got["A"].turnover_post == pytest.approx(0.35)
    assert {k: pytest.approx(v) for k, v in {"A": 0.35 * scale, "B": 0.25 * scale, "C": 0.0, "D": 0.5 * (1 - scale)}.items()} == {k: r.weight for k, r in got.items()}
    assert got["A"].cash_weight == pytest.approx(1 - sum(r.weight for r in got.values()))


def random_decisions(seed, n=12, tickers=("A", "B", "C", "D")):
    r = np.random.default_rng(seed)
    price, out = {t: 50.0 + 10 * i for i, t in enumerate(tickers)}, []
    for i in range(n):
        price = {t: p * float(np.exp(r.normal(0, 0.05))) for t, p in price.items()}
        fill = {t: p * float(np.exp(r.normal(0, 0.01))) for t, p in price.items()}
        w = r.dirichlet(np.ones(len(tickers)))
        for k, t in enumerate(tickers):
            out.append((f"p{seed}", i, day(7 * i), day(7 * i + 1), t, k, None if r.random() < 0.3 else float(w[k]), price[t], fill[t]))
    return out


DECISIONS = "portfolio_id string, decision_idx int, decision_date date, fill_date date, ticker string, ord int, weight double, decision_price double, fill_price double"


def test_paths_equal_the_step_operators(spark):
    """The fold against the set-based operators, decision by decision, on the books that the fold reports."""
    rows = [x for s in range(3) for x in random_decisions(s)]
    d = spark.createDataFrame(rows, DECISIONS)
    paths = book.rebalance_paths(d, initial=1000.0, commission=0.5).cache()
    key = ["portfolio_id", "decision_idx"]
    after = paths.select("portfolio_id", (paths.decision_idx + 1).alias("decision_idx"), "ticker", paths.position.alias("shares"))
    cash = paths.select("portfolio_id", (paths.decision_idx + 1).alias("decision_idx"), "cash").distinct()
    cash = cash.unionByName(d.select("portfolio_id").distinct().selectExpr("portfolio_id", "0 decision_idx", "1000D cash"))
    for p in ("p0", "p1", "p2"):
        own = lambda df: df.where(df.portfolio_id == p)  # noqa: E731, B023
        prices, fills = own(d).select("decision_idx", "ticker", d.decision_price.alias("price")), own(d).select("decision_idx", "ticker", d.fill_price.alias("price"))
        positions, money = own(after).where("decision_idx < 12 and abs(shares) > 0"), own(cash).where("decision_idx < 12")
        now = book.current_weights(positions, money, prices).where("ticker <> 'cash'")
        goal = ledger.apply_constraints(own(d).where("weight is not null").select(*key, "ticker", "weight"), now)
        totals = book.mark_to_market(positions, money, prices)
        orders = ledger.generate_orders(goal, positions, prices, totals).join(own(d).select("decision_idx", "ticker", "ord", "weight"), ["decision_idx", "ticker"])
        # targets come first, in order, then what is only held
        orders = orders.selectExpr("portfolio_id", "decision_idx", "ticker", "shares", "case when weight is null then 100 + ord else ord end ord")
        got = {(r.decision_idx, r.ticker): r for r in ledger.fill_orders(orders, fills, money, 5.0, 0.5).collect()}
        mine = {(r.decision_idx, r.ticker): r for r in own(paths).where("abs(shares) > 1e-12").collect()}
        assert set(got) == set(mine) and len(got) > 15
        for k, r in got.items():
            assert r.shares == pytest.approx(mine[k].shares, rel=1e-7, abs=1e-9) and r.cash_flow == pytest.approx(mine[k].cash_flow, rel=1e-7, abs=1e-7)
            assert r.slippage_cost == pytest.approx(mine[k].slippage_cost, rel=1e-6, abs=1e-9)
    v = sorted(book.book_values(paths).where("portfolio_id = 'p1'").collect(), key=lambda r: r.decision_idx)
    assert v[0].gross is None and v[3].gross == pytest.approx(v[3].pre_trade_value / v[2].value_after - 1) and v[3].net == pytest.approx(v[3].value_after / v[2].value_after - 1)
    t = book.trades_view(paths)
    assert t.where("is_initialization and decision_idx > 0").count() == 0 and t.count() == paths.where("abs(shares) > 1e-12").count()
    left = ledger.cash_ledger(t, 1000.0, check=True).where("decision_idx = 11").collect()
    assert {r.portfolio_id: pytest.approx(r.cash) for r in left} == {r.portfolio_id: r.cash for r in paths.where("decision_idx = 11").select("portfolio_id", "cash").distinct().collect()}
    snap = {(r.portfolio_id, r.fill_date): r for r in book.holdings_snapshot(paths).collect()}
    assert len(snap) == 36 and all(abs(x) > 1e-12 for r in snap.values() for x in r.positions.values())
    log = book.decision_log(paths, spark.createDataFrame([("p0", 12, "no fill")], "portfolio_id string, decision_idx int, reason string"))
    assert log.count() == 37 and log.where("status = 'skipped'").first().reason == "no fill"


def test_round_trip_and_marks(spark):
    rows = [("p", 0, day(0), day(1), "A", 0, 1.0, 100.0, 100.0), ("p", 1, day(7), day(8), "A", 0, None, 100.0, 100.0)]
    got = {r.decision_idx: r for r in book.rebalance_paths(spark.createDataFrame(rows, DECISIONS), initial=2000.0, max_weight=1.0, turnover_cap=1.0, buffer=0.0, slippage_bps=100.0, commission=1.0).collect()}
    assert got[0].shares == pytest.approx(1999 / 101) and got[0].cash == pytest.approx(0) and got[1].position == 0 and got[1].cash == pytest.approx(1999 / 101 * 99 - 1)
    bad = [*rows[:1], ("p", 1, day(7), day(8), "A", 0, None, None, 100.0)]
    with pytest.raises(Exception, match="no decision price"):
        book.rebalance_paths(spark.createDataFrame(bad, DECISIONS), max_weight=1.0).collect()
    whole = book.rebalance_paths(spark.createDataFrame(rows[:1], DECISIONS), initial=1050.0, max_weight=1.0, turnover_cap=1.0, buffer=0.0, slippage_bps=0.0, fractional=False).first()
    assert whole.shares == 10.0
    start = spark.createDataFrame([("p", "A", 0.5)], "portfolio_id string, ticker string, weight double")
    first = book.rebase(spark.createDataFrame(rows, DECISIONS), start, initial=1000.0, max_weight=1.0, turnover_cap=1.0, buffer=0.0, slippage_bps=0.0).collect()
    assert [(r.decision_idx, r.shares) for r in first] == [(0, pytest.approx(5.0))]


def test_leavers_shares_and_overdraft(spark):
    pos = spark.createDataFrame([("p", 1, "A", 1.0), ("p", 1, "B", 1.0), ("q", 1, "B", 1e-14)], "portfolio_id string, decision_idx int, ticker string, shares double")
    ok = spark.createDataFrame([(1, "A")], "decision_idx int, ticker string")
    assert [tuple(r) for r in book.leaver_orders(pos, ok).collect()] == [("p", 1, "B", -1.0, 0.0)]
    prices = spark.createDataFrame([(1, "A", 120.0), (1, "B", 80.0)], "decision_idx int, ticker string, price double")
    none = spark.createDataFrame([("p", 1, 0.0)], "portfolio_id string, decision_idx int, cash double")
    got = {r.ticker: round(r.weight, 9) for r in book.current_weights(pos.where("portfolio_id = 'p'"), none, prices).collect()}
    assert got == {"A": 0.6, "B": 0.4, "cash": 0.0}
    broke = book.current_weights(pos.where("false"), none, prices).collect()
    assert [(r.ticker, r.weight) for r in broke] == [("cash", 1.0)]
    flows = spark.createDataFrame([("p", 0, -5.0), ("p", 1, -6.0)], "portfolio_id string, decision_idx int, cash_flow double")
    assert ledger.cash_ledger(flows, 11.0, check=True).count() == 2
    with pytest.raises(Exception, match="overdraft of portfolio p"):
        ledger.cash_ledger(flows, 10.0, check=True).collect()


def test_ridge_equals_a_direct_solve(spark):
    r = np.random.default_rng(7)
    names, rows = ["a", "b", "c"], []
    for i in range(60):
        for t in range(5):
            x = r.normal(size=3)
            rows.append((i, day(7 * i), f"t{t}", *map(float, x), float(0.5 + x @ [1, -2, 0.3] + r.normal(0, 0.1)) if t or i % 9 else None))
    df = spark.createDataFrame(rows, "decision_idx int, decision_date date, ticker string, a double, b double, c double, label double")
    sched = spark.createDataFrame([(i, day(7 * i), day(7 * i + 8) if i < 59 else None) for i in range(60)], "decision_idx int, decision_date date, next_fill date")
    sets = models.training_sets(sched, embargo=1, window_days=200)
    members = {}
    for s in sets.collect():
        members.setdefault(s.refit_idx, set()).add(s.decision_idx)
    for i in range(60):
        assert members.get(i, set()) == {j for j in range(59) if j <= i - 2 and 7 * j + 8 < 7 * i and 7 * (i - j) <= 200}
    got = {c.refit_idx: c for c in models.ridge_walkforward(df, models.training_windows(sched, embargo=1, window_days=200), names, alpha=2.0, min_rows=40, every=4).collect()}
    first = min(i for i, m in members.items() if sum(x[0] in m and x[6] is not None for x in rows) >= 40)
    assert sorted(got) == list(range(first, 60, 4))
    for i, c in got.items():
        use = [x for x in rows if x[0] in members[i] and x[6] is not None]
        x = np.array([[1, *u[3:6]] for u in use])
        want = np.linalg.solve(x.T @ x + 2.0 * np.diag([0, 1, 1, 1]), x.T @ np.array([u[6] for u in use]))
        assert c["rows"] == len(use) and np.abs(np.array(c.coefs) - want).max() < 1e-8
    p = {(x.decision_idx, x.ticker): x.predicted for x in models.predict(df, spark.createDataFrame([(c.refit_idx, c.coefs) for c in got.values()], "refit_idx int, coefs array<double>"), names).collect()}
    assert min(i for i, _ in p) == first and p[first + 1, "t1"] == pytest.approx(float(np.dot(got[first].coefs, [1, *next(x for x in rows if x[0] == first + 1 and x[2] == "t1")[3:6]])))


def test_boosted_trees_distributed(spark):
    rows = [(i, f"t{t}", float(i % 7), float(t), float((i % 7 > 3) * 2 + t)) for i in range(24) for t in range(3)]
    df = spark.createDataFrame(rows, "decision_idx int, ticker string, a double, b double, label double")
    sets = spark.range(24).selectExpr("cast(id as int) refit_idx").crossJoin(spark.range(24).selectExpr("cast(id as int) decision_idx")).where("decision_idx < refit_idx - 1")
    out = models.gbt_walkforward_distributed(df, sets, [10, 18], ["a", "b"], depth=2, rounds=4, rate=0.5).collect()
    assert len(out) == 14 * 3 and sum(abs(r.predicted - r.label) for r in out) / len(out) < 0.5


def test_scores_and_selection_by_hand(spark):
    f = spark.createDataFrame([(0, DAY, t, m) for t, m in (("A", 0.01), ("B", 0.02), ("C", 0.0004))], "decision_idx int, decision_date date, ticker string, predicted double")
    s = spark.createDataFrame([(0, DAY, "A", 0.1), (0, DAY, "B", 0.4), (0, DAY, "D", 0.0)], f.schema)
    top = {r.ticker: r for r in models.select_weights(models.score_forecasts("return", f), "return", 2, 0.0, "score_softmax").collect()}
    assert top["B"].weight == pytest.approx(1 / (1 + np.exp(-0.01))) and top["C"].weight is None and top["C"].net_edge == pytest.approx(-0.0001)
    assert all(r.weight is None for r in models.select_weights(models.score_forecasts("return", f), "return", 2, 0.03).collect())
    rar = {r.ticker: r for r in models.select_weights(models.score_forecasts("rar", f, s), "rar", 1).collect()}
    assert set(rar) == {"A", "B"} and rar["A"].selected and rar["A"].score == pytest.approx(0.095)
    vol = {r.ticker: r for r in models.select_weights(models.score_forecasts("vol", None, s), "vol", 2, 0.0, "inv_vol").collect()}
    assert vol["D"].score == pytest.approx(1e6) and vol["A"].weight == pytest.approx(10 / (10 + 1e6)) and not vol["B"].selected
    v = spark.createDataFrame([(0.02,), (-1.0,), (None,)], "v double").select(columns.vol_of_label(columns.log_vol_label(boards.F.col("v"))).alias("v")).collect()
    assert v[0].v == pytest.approx(0.02) and v[1].v == pytest.approx(0.0, abs=1e-12) and v[2].v is None


def test_selection_gates_and_fallback(spark):
    s = spark.createDataFrame([("a", 1.0, 5.0, -0.1, 0.2, 9), ("b", 2.0, 5.0, -0.5, 0.2, 9), ("c", 1.0, 6.0, -0.1, 0.2, 9), ("d", 3.0, 1.0, 0.0, 0.0, 1)], "strategy string, sharpe double, cagr double, max_drawdown double, turnover double, periods int")
    assert [r.strategy for r in selection.best_overall(s).orderBy("place").collect()] == ["c", "a"]
    assert [r.strategy for r in selection.best_overall(s, min_periods=99).orderBy("place").collect()] == ["d", "b", "c"]
    board = spark.createDataFrame([("UP", "a", 9, 0.0, 0.0, -0.1, 0.5), ("UP", "b", 1, 0.0, 0.0, 0.0, 0.1), ("DOWN", "b", 1, 0.0, 0.0, -0.3, 0.1), ("DOWN", "a", 1, 0.0, 0.0, -0.4, 0.1)], "market_regime string, strategy string, intervals int, sharpe double, cagr double, max_drawdown double, mean_turnover double")
    assert {r.market_regime: r.best_strategy for r in selection.best_per_regime(board).collect()} == {"UP": "a", "DOWN": "b"}
    v = spark.createDataFrame([("s", day(0), 1.0), ("s", day(1), 0.5), ("s", day(2), 2.0), ("t", day(0), 1.0)], "strategy string, date date, value double")
    assert {r.strategy: r.max_drawdown for r in selection.value_drawdown(v).collect()} == {"s": -0.5, "t": None}
    assert [r.normalised for r in selection.equity_curves(v).where("strategy = 's'").orderBy("date").collect()] == [1.0, 0.5, 2.0]
    log = spark.createDataFrame([("s", "executed"), ("s", "skipped")], "strategy string, status string")
    assert [tuple(r) for r in selection.decision_counts(log).collect()] == [("s", 1, 1)]
    assert selection.overview(s).count() == 4 * 5


def test_champions_of_many_runs_are_folded_apart(spark):
    r = np.random.default_rng(4)
    rows = [(run, i, day(i), s, True, float(r.random())) for run in "xy" for i in range(30) for s in "abc"]
    ranked = spark.createDataFrame(rows, "run_id string, decision_idx int, decision_date date, strategy string, eligible boolean, score double")
    w = boards.Window.partitionBy("run_id", "decision_idx").orderBy(boards.F.desc("score"))
    ranked = ranked.withColumn("rank", boards.F.row_number().over(w))
    both = boards.champion_path(ranked, "a", key="run_id")
    for run in "xy":
        one = boards.champion_path(ranked.where(ranked.run_id == run).drop("run_id"), "a")
        assert sorted(map(tuple, one.collect())) == sorted(tuple(x)[1:] for x in both.where(both.run_id == run).collect())
    audit = selection.decision_audit(str(day(9)), both, ranked, ranked.select("strategy", "decision_date"))
    assert {x.kind for x in audit.collect()} == {"meta", "leaderboard", "selected", "trade"}


def test_ensemble_targets_and_inverse_volatility(spark):
    c = spark.createDataFrame([(0, DAY, "A", 0, 0.1, 0.05), (0, DAY, "B", 1, 0.2, 0.1), (0, DAY, "C", 2, None, 0.2)], "decision_idx int, decision_date date, ticker string, universe_order int, vol_20 double, momentum double")
    w = {r.ticker: r.weight for r in strategies.cross_section_momentum(c, 3, weighting="inv_vol").collect()}
    assert w == {"A": pytest.approx(2 / 3), "B": pytest.approx(1 / 3)}
    one = spark.createDataFrame([(0, DAY, "A", 1.0)], "decision_idx int, decision_date date, ticker string, weight double")
    mix = {r.ticker: r.weight for r in strategies.ensemble_fixed([(strategies.equal_weight(c), 1.0), (one, 1.0)]).collect()}
    assert mix["A"] == pytest.approx(2 / 3) and sum(mix.values()) == pytest.approx(1)
    assert strategies.cash_only(c).count() == 0
    with pytest.raises(ValueError, match="more than 0"):
        strategies.ensemble_fixed([(one, 0.0)])
    grid = strategies.param_grid(spark, "m", {"k": [1, 2], "f": ["x"]})
    assert sorted(r.strategy for r in grid.collect()) == ["m_k=1_f=x", "m_k=2_f=x"]


def test_coverage_gates(spark, tmp_path):
    row = lambda t, n, c=1.0: (t, day(n), 1.0, 1.0, 1.0, c, 1.0)
    b = spark.createDataFrame([row("A", n) for n in range(6)] + [row("B", n) for n in (2, 3, 5)] + [("C", day(1), None, 1.0, 1.0, None, 1.0)], "ticker string, date date, open double, high double, low double, close double, volume double")
    cov = {r.ticker: r for r in coverage.ticker_coverage(b, calendar.sessions(b)).collect()}
    assert cov["B"].gap_count == 1 and cov["C"].missing_fields == ["open", "close"] and cov["C"].observations == 0 and cov["A"].missing_fields == []
    two = lambda **k: tuple(coverage.coverage_bounds(b, **k).first())
    assert two(proxy="B", minimum_observations=5) == (None, None) and two(proxy="zz", minimum_observations=3) == (day(4 - 2), day(5)) and two(policy="common") == (day(2), day(5))
    b.write.parquet(str(tmp_path / "bars"))
    (tmp_path / "bars" / "part-bad.parquet").write_text("no parquet")
    again, bounds = coverage.coverage_from_files(spark, str(tmp_path / "bars"), ["A", "B"], policy="common")
    assert {r.ticker: r.checksum for r in again.collect()} == {k: cov[k].checksum for k in "AB"} and bounds.first().usable_start == day(2)
    gate = coverage.coverage_gate(again, bounds, str(day(0)), str(day(4)), 3).first()
    assert not gate.accepted and gate.gaps == 1 and (gate.start, gate.end) == (day(2), day(4))
    assert coverage.coverage_gate(again.where("ticker = 'A'"), bounds, str(day(0)), str(day(9)), 3).first().accepted
    held = spark.createDataFrame([(day(2), "A", 1.0), (day(2), "Z", 1.0), (day(2), "Y", 0.0)], "date date, ticker string, shares double")
    assert [r.ticker for r in coverage.mark_check(held, b.withColumnRenamed("close", "price"), ["date", "ticker"]).collect()] == ["Z"]
    off = coverage.reconciliation(spark.createDataFrame([(day(2), 4.0, 5.0)], "date date, cash double, total double"), held, b.withColumnRenamed("close", "price"), ["date"]).first()
    assert off.residual == 0.0
    s = calendar.build_schedule(calendar.trading_calendar(spark, "2024-01-03", "2024-01-20"))
    kept = calendar.missing_price_stop(s, b).orderBy("decision_idx").collect()
    assert [r.status for r in kept][:3] == ["kept", "kept", "skipped"]  # the last bar is of the 8th
    snap = {r.value: r.snapped for r in calendar.snap_date(spark.createDataFrame([(day(4),), (day(-3),)], "value date"), b.where("ticker = 'B'").select("date")).collect()}
    assert snap == {day(4): day(5), day(-3): day(2)}
    fill = {(r.ticker, r.date): r.close for r in calendar.filled_bars(b).collect()}
    assert fill["B", day(4)] == 1.0 and ("B", day(1)) not in fill and fill["C", day(5)] is None


def test_series_are_known_when_published(spark):
    s = spark.createDataFrame([("m", day(i), day(i + 2), float(i + 1)) for i in range(5)] + [("m", day(0), day(1), 50.0)], "series string, date date, available_date date, value double")
    got = {r.date: r for r in features.level_change_features(s, spark.createDataFrame([(day(1),), (day(4),), (day(30),)], "date date"), (1, 2)).collect()}
    assert got[day(1)].level == 0.0 and got[day(4)].level == 3.0 and got[day(4)].change_1 == pytest.approx(0.5) and got[day(30)].change_2 == pytest.approx(5 / 3 - 1)
    one = s.where("available_date > date_add(date, 1)").select("date", "value")
    merged = features.merge_series({"x": one, "y": one.where("value > 3")}).orderBy("date").collect()
    assert [(r.x, r.y) for r in merged][2:4] == [(3.0, None), (4.0, 4.0)]


def test_evaluation_rows(spark):
    rows = [("m", day(i), t, 0.1 * (1 if t == "A" else -1), 0.2 * (1 if t == "A" else -1)) for i in range(4) for t in "AB"] + [("few", day(0), "A", 1.0, 1.0)]
    f = spark.createDataFrame(rows, "model string, date date, ticker string, predicted double, actual double")
    got = {(r.model, r.split, r.metric): r.value for r in evaluation.evaluate_forecasts(f, volatility=True).collect()}
    assert got["few", "all", "insufficient_data"] == 1 and got["m", "all", "hit"] == 1.0 and got["m", "all", "mae"] == pytest.approx(0.1)
    assert got["m", "all", "mean_rank_ic"] == pytest.approx(1.0) and got["m", "all", "ratio"] == pytest.approx(0.5) and got["m:persistence", "all", "rmse"] == pytest.approx(0.0)


def test_artifacts_and_catalogue(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, 2.0), ("t", 2, 3.0)], "strategy string, i int, v double")
    for k in range(3):
        artifacts.write_artifacts(f"run{k}", str(tmp_path), {"values": t, "board": t.orderBy("v")}, {"log": t}, csv=("board",), created_at=f"2024-01-0{k + 1} 10:00:00")
    runs = artifacts.run_catalog(spark, str(tmp_path), 2).collect()
    assert [r.run_id for r in runs] == ["run2", "run1"] and [x["rows"] for x in runs[0].tables] == [2, 2]
    sums = {r.name: r.checksum for r in artifacts.run_report(spark, str(tmp_path), "run1").collect()}
    assert sums["board"] == sums["values"] == artifacts.result_hash(t).first().checksum
    at = lambda name: artifacts.artifact_path(spark, str(tmp_path), "run0", name)
    assert spark.read.json(at("log")).count() == 2 and spark.read.option("header", True).csv(at("board_csv")).count() == 2


def test_price_files(spark, tmp_path):
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"
    for name, c in (("a", 1.0), ("b", 2.0)):
        spark.createDataFrame([("A", day(0), 1.0, 1.0, 1.0, c, 1.0), ("A", day(9), 1.0, 1.0, 1.0, c, 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = bars.read_bars(spark, str(tmp_path / "*.parquet"), ["A"], str(day(0)), str(day(5))).collect()
    assert [(r.date, r.close) for r in got] == [(day(0), 2.0)]
    with pytest.raises(ValueError, match="no bars"):
        bars.read_bars(spark, str(tmp_path / "*.parquet"), ["A", "B"], str(day(0)), str(day(5)))
    (tmp_path / "u.json").write_text('{"etfs": [{"ticker": "A", "name": "a", "inception_date": "2020-01-01"}, {"ticker": "B", "name": "b", "inception_date": "2024-01-05"}]}')
    u = bars.read_universe(spark, str(tmp_path / "u.json"))
    s = spark.createDataFrame([(0, day(0)), (1, day(7))], "decision_idx int, decision_date date")
    assert sorted((r.decision_idx, r.ticker) for r in calendar.eligible_asof(s, u).collect()) == [(0, "A"), (1, "A"), (1, "B")]
    (tmp_path / "v.json").write_text('{"etfs": [{"ticker": "A", "name": "a", "inception_date": "2020-01-01"}, {"ticker": "A", "name": "b", "inception_date": "2024-01-05"}]}')
    with pytest.raises(ValueError, match="duplicate"):
        bars.read_universe(spark, str(tmp_path / "v.json"))
    wide = spark.createDataFrame([(day(0), 1.0, 2.0, 3.0)], "date date, BRK_B_close double, BRK_B_open double, volume_SPY double")
    assert {(r.ticker, r.open, r.close, r.volume) for r in bars.normalize_bars(wide).collect()} == {("BRK_B", 2.0, 1.0, None), ("SPY", None, None, 3.0)}
    h = bars.boundary_hash(wide, "date").first().hash
    assert h == bars.boundary_hash(wide, "date").first().hash != bars.boundary_hash(wide.withColumn("volume_SPY", wide.volume_SPY + 1), "date").first().hash


def test_ledger_stream(spark, tmp_path):
    src, schema = tmp_path / "in", "portfolio_id string, fill_id long, ticker string, shares double, cash_flow double"
    batches = [[("p", 1, "A", 2.0, -60.0), ("p", 2, "B", 1.0, -50.0), ("q", 3, "A", 1.0, -100.0)], [("p", 4, "A", -2.0, 70.0), ("p", 5, "B", 1.0, -50.0)]]
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = ledger_stream(spark.readStream.schema(schema).parquet(str(src)), 100.0).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q = q.format("parquet").option("path", str(tmp_path / f"out{n}" if n < 0 else tmp_path / "out")).outputMode("append").start()
        q.awaitTermination(120)
    out = {r.fill_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [out[i].accepted for i in range(1, 6)] == [True, False, True, True, True]
    assert out[4].cash == pytest.approx(110.0) and out[4].position == 0.0 and out[5].cash == pytest.approx(60.0) and out[3].cash == pytest.approx(0.0)


def test_a_new_book_asks_the_store_once():
    import pandas as pd

    from pitfolio.streaming.ledger_stream import _Book

    class Store(dict):
        calls = 0

        def asked(self, x):
            Store.calls += 1
            return x

        get = lambda self: self.asked(dict.get(self, "v"))
        exists = lambda self: self.asked("v" in self)
        update = lambda self, v: self.__setitem__("v", v)
        containsKey = lambda self, k: self.asked(k in self)
        getValue = lambda self, k: self.asked(self[k])
        updateValue = dict.__setitem__
        removeKey = lambda self, k: self.pop(k)

    book = _Book(100.0)
    book.cash, book.held = Store(), Store()
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["portfolio_id", "fill_id", "ticker", "shares", "cash_flow"])])
    (out,) = book.handleInputRows(("p",), frame(("p", 2, "B", 1.0, -50.0), ("p", 1, "A", 2.0, -60.0), ("p", 3, "C", 1.0, -10.0)), None)
    assert Store.calls == 1
    assert out[["fill_id", "position", "cash", "accepted"]].values.tolist() == [[1, 2.0, 40.0, True], [2, 0.0, 40.0, False], [3, 1.0, 30.0, True]]
    (out,) = book.handleInputRows(("p",), frame(("p", 4, "A", -2.0, 70.0), ("p", 5, "B", 1.0, -50.0)), None)
    assert out["position"].tolist() == [0.0, 1.0] and out["cash"].tolist() == [100.0, 50.0]
    assert dict(book.held) == {("B",): (1.0,), ("C",): (1.0,)} and book.cash["v"] == (50.0,)


def test_interval_volatility_by_hand(spark):
    b = spark.createDataFrame([("AAA", dt.date(2024, 1, d), c) for d, c in ((2, 100.0), (3, 110.0), (5, 99.0), (8, 100.0))], "ticker string, date date, close double")
    s = spark.createDataFrame([(0, dt.date(2024, 1, 1), dt.date(2024, 1, 2), "kept"), (1, dt.date(2024, 1, 4), dt.date(2024, 1, 5), "kept"), (2, dt.date(2024, 1, 7), dt.date(2024, 1, 9), "kept")], "decision_idx int, decision_date date, fill_date date, status string")
    got = {r.decision_idx: r.vol for r in labels.interval_vol(s, b).collect()}
    assert got == {0: pytest.approx(np.sqrt(np.log(1.1) ** 2 + np.log(0.9) ** 2)), 1: pytest.approx(abs(np.log(100 / 99)))}


def test_values_are_cleaned(spark):
    v = spark.createDataFrame([("s", day(0), 1.0, 1), ("s", day(0), 3.0, 0), ("s", day(1), -1.0, 2), ("s", day(2), None, 3)], "strategy string, date date, value double, seq int")
    assert [(r.date, r.value) for r in stats.clean_values(v).collect()] == [(day(0), 1.0)]


def test_reconciliation_deals_rows_by_how_many_there_are(spark):
    from pitfolio.plans.portfolios import q_reconciliation

    few, many = q_reconciliation(spark, "/root/testdata/sf0.001"), q_reconciliation(spark, "/root/testdata/sf0.001", rows_a_task=500)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500 + 1
    assert f"{n}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert few.collect() == many.collect()

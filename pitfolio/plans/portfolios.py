"""Registered queries of books, forecasts, summaries and gates, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boards, book, calendar, coverage, evaluation, features, labels, ledger, models, selection, stats, strategies
from ..sources.settle import settled
from . import queries as base
from .queries import _PATHS, _TARGETS, _TYPE, _bars, _candidates, _frame, _market, _round, _rounded, _targets

CAPITAL, CASH = 100_000.0, 500.0
NAMES = ["ret_21", "vol_21"]


def q_buy_and_hold(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    return _rounded(strategies.buy_and_hold(_candidates(spark, b, s)).select("decision_idx", "ticker", "weight"))


def q_volatility_target(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    equal = strategies.equal_weight(_candidates(spark, b, s))
    return _rounded(strategies.volatility_target(equal, features.prepared(b).select("ticker", "date", "r1")).select("decision_idx", "ticker", "weight"))


def q_ensemble(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    t = _targets(spark, b, s)
    part = lambda n: t.where(F.col("strategy") == n).drop("strategy")
    return _rounded(strategies.ensemble_fixed([(part("inverse_volatility"), 1.0), (part("xs_momentum"), 3.0)]).select("decision_idx", "ticker", "weight"))


def q_momentum_grid(spark, sf_dir):
    """Cross-section momentum over a grid of parameters, all of its rows in one pass."""
    b, s = _market(spark, sf_dir)
    grid = strategies.param_grid(spark, "xs", {"top_k": [2, 4], "floor": [0.0, 0.02]})
    c = _candidates(spark, b, s).where("momentum is not null").select("decision_idx", "ticker", "momentum")
    day = Window.partitionBy("decision_idx")
    c = c.withColumn("k", F.row_number().over(day.orderBy(F.desc("momentum"), "ticker"))).withColumn("lead", F.max("momentum").over(day))
    picked = c.crossJoin(grid).where("lead > floor and k <= top_k")
    return _rounded(picked.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("strategy", "decision_idx"))).select("strategy", "decision_idx", "ticker", "weight"))


def _books(spark, sf_dir):
    """Targets by inverse volatility and what was bought in equal parts one decision before: (targets, positions, cash, prices)."""
    b, s = _market(spark, sf_dir)
    c = _candidates(spark, b, s)
    book_ = F.lit("p").alias("portfolio_id")
    targets = strategies.inverse_volatility(c).select(book_, "decision_idx", "ticker", "weight")
    held = strategies.equal_weight(c).join(c.select("decision_idx", "ticker", "close"), ["decision_idx", "ticker"])
    positions = held.select(book_, (F.col("decision_idx") + 1).alias("decision_idx"), "ticker", (CAPITAL * F.col("weight") / F.col("close")).alias("shares"), "weight")
    cash = c.select(book_, "decision_idx").distinct().withColumn("cash", F.lit(CASH))
    return targets, positions, cash, c.select("decision_idx", "ticker", F.col("close").alias("price"))


def q_constraints(spark, sf_dir):
    targets, positions, _, _ = _books(spark, sf_dir)
    return _rounded(ledger.apply_constraints(targets, positions, 0.05, 0.05).drop("portfolio_id"))


def q_current_weights(spark, sf_dir):
    _, positions, cash, prices = _books(spark, sf_dir)
    return _rounded(book.current_weights(positions, cash, prices).drop("portfolio_id"))


def _orders(spark, sf_dir):
    targets, positions, cash, prices = _books(spark, sf_dir)
    return ledger.generate_orders(targets, positions, prices, book.mark_to_market(positions, cash, prices)), cash, prices


def q_orders(spark, sf_dir):
    return _rounded(_orders(spark, sf_dir)[0].drop("portfolio_id"), 4)


def q_fills(spark, sf_dir):
    orders, cash, prices = _orders(spark, sf_dir)
    ordered = orders.withColumn("ord", F.row_number().over(Window.partitionBy("portfolio_id", "decision_idx").orderBy("ticker")))
    dear = prices.withColumn("price", F.col("price") * 1.01)  # prices rise before the fill, so that buys run short of cash
    return _rounded(ledger.fill_orders(ordered, dear, cash, 5.0, 1.0).drop("portfolio_id"), 4)


def _item_fills(spark, sf_dir):
    """Line items as fills of their supplier's book, by month; returned ones are sales."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return i.select(
        F.col("l_suppkey").alias("portfolio_id"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("ticker"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("decision_idx"),
        (side * F.col("l_quantity")).alias("shares"), (-side * F.col("l_extendedprice")).alias("cash_flow"), F.col("l_extendedprice").alias("gross_value"), (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"), (F.col("l_extendedprice") * F.col("l_discount")).alias("slippage_cost"),
    )


def q_position_ledger(spark, sf_dir):
    return _rounded(ledger.position_ledger(_item_fills(spark, sf_dir)), 4)


def q_cash_ledger(spark, sf_dir):
    return _rounded(ledger.cash_ledger(_item_fills(spark, sf_dir), 1e9), 2)


def q_cost_drag(spark, sf_dir):
    return _rounded(book.cost_drag(_item_fills(spark, sf_dir)))


def q_reconciliation(spark, sf_dir, rows_a_task=250_000):
    """Largest gap between a book's total and the sum of its parts, over all months."""
    fills = _item_fills(spark, sf_dir).select("portfolio_id", "decision_idx", "ticker", "shares", "cash_flow")
    on = ["portfolio_id", "decision_idx"]
    parts = fills.count() // rows_a_task + 1  # a task's rows, and with them its memory, stay the same however many there are
    held = fills.repartition(parts, *on, "ticker").groupBy(*on, "ticker").agg(F.sum("shares").alias("shares"))
    marks = held.select(*on, "ticker", F.lit(10.0).alias("price"))
    totals = fills.repartition(parts, *on).groupBy(*on).agg((F.sum("cash_flow") + 10.0 * F.sum("shares")).alias("total"), F.sum("cash_flow").alias("cash"))
    return coverage.reconciliation(totals, held, marks, on).agg(F.count("*").alias("books"), F.max(F.abs("residual") > 1e-6).alias("off"))


def q_mark_check(spark, sf_dir):
    """What was held at a decision without a bar to mark it by."""
    _, positions, _, prices = _books(spark, sf_dir)
    return coverage.mark_check(positions.select("decision_idx", "ticker", "shares"), prices, ["decision_idx", "ticker"]).select("decision_idx", "ticker")


def _paths(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    return book.rebalance_paths(book.fold_rows(_targets(spark, b, s), s, b, "close", "close"))


#: Sums of money are rounded to cents: two engines add them in different orders.
_MONEY = {"value_before": 2, "pre_trade_value": 2, "value_after": 2, "cash": 2, "gross_value": 2, "cash_flow": 2, "slippage_cost": 4, "net_cost": 4, "fill_price": 4}


def _booked(df):
    """Doubles rounded for books; adding 0 makes -0 a plain 0."""
    return df.select(*[(F.round(c, _MONEY.get(c, 6)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_rebalance_paths(spark, sf_dir):
    """Books of all strategies, step by step."""
    return _booked(book.book_values(_paths(spark, sf_dir)))


def q_trades(spark, sf_dir):
    return _booked(book.trades_view(_paths(spark, sf_dir)))


def q_meta_book(spark, sf_dir):
    """The meta portfolio with a book of its own: the champion's weights through limits, orders, fills and cash."""
    b, s = _market(spark, sf_dir)
    meta = selection.meta_targets(_champion(spark, sf_dir), _targets(spark, b, s))
    return _booked(book.book_values(book.rebalance_paths(book.fold_rows(meta, s, b, "close", "close"))))


def q_book_reconciliation(spark, sf_dir):
    """What the books report against ledgers rebuilt from their trades alone, marked at the fill prices."""
    b, s = _market(spark, sf_dir)
    paths = settled(_paths(spark, sf_dir))
    trades = book.trades_view(paths)
    kept = s.where("status = 'kept'").select("decision_idx")
    # Shares after a trade stay until the next one of the ticker; cash likewise.
    last = kept.agg(F.max("decision_idx").alias("n"))
    until = lambda *by: F.coalesce(F.lead("decision_idx").over(Window.partitionBy(*by).orderBy("decision_idx")) - 1, F.col("n"))
    spread = lambda df, *by: df.join(F.broadcast(last)).withColumn("until", until(*by)).withColumn("decision_idx", F.explode(F.sequence("decision_idx", "until"))).drop("until", "n")
    held = spread(ledger.position_ledger(trades), "portfolio_id", "ticker").where("shares <> 0")
    cash = spread(ledger.cash_ledger(trades, CAPITAL), "portfolio_id")
    marks = book.marks_at(b, s, "close", "fill_date")
    on = ["portfolio_id", "decision_idx"]
    totals = book.book_values(paths).select(*on, F.col("value_after").alias("total")).join(cash, on, "left").na.fill(CAPITAL, ["cash"])
    prices = held.select(*on, "ticker").join(marks, ["decision_idx", "ticker"]).select(*on, "ticker", "price")
    gaps = coverage.reconciliation(totals, held, prices, on).join(totals.select(*on, "total"), on)
    return gaps.groupBy("portfolio_id").agg(F.count("*").alias("books"), F.count_if(F.abs("residual") > 1e-6).alias("off"), F.round(F.max("total"), 2).alias("highest"))


def q_book_summary(spark, sf_dir):
    """Summaries of the books: values at the fills, turnover after limits, executed and skipped decisions, cost drag of the trades."""
    _, s = _market(spark, sf_dir)
    paths = settled(_paths(spark, sf_dir))
    v = book.book_values(paths).withColumnRenamed("portfolio_id", "strategy")
    status = s.select(F.col("status"))
    log = v.select("strategy").distinct().join(F.broadcast(status.groupBy("status").agg(F.count("*").alias("n")))).select("strategy", F.when(F.col("status") == "kept", "executed").otherwise("skipped").alias("status"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    costs = book.cost_drag(book.trades_view(paths)).withColumnRenamed("portfolio_id", "strategy")
    out = selection.portfolio_summary(v.select("strategy", F.col("fill_date").alias("date"), F.col("value_after").alias("value")), v.select("strategy", F.col("turnover_post").alias("turnover"), "gross"), log, costs)
    return _rounded(out.withColumn("final_value", F.round("final_value", 2)), 4).withColumn("cost_drag", F.round("cost_drag", 6))


def q_book_reliability(spark, sf_dir):
    """Reliability of the strategies by the rolling board of their books, with cash shares and cost drag."""
    paths = settled(_paths(spark, sf_dir))
    v = book.book_values(paths).withColumnRenamed("portfolio_id", "strategy")
    cash, costs = v.select("strategy", "cash_pct"), book.cost_drag(book.trades_view(paths)).withColumnRenamed("portfolio_id", "strategy")
    rolling = boards.rolling_board(_facts(spark, sf_dir))
    return _rounded(selection.reliability_report(rolling, boards.ranked_board(rolling), cash, costs).select("strategy", "cash_pct", "cost_drag", "top_rank_count", "most_reliable"))


def q_missing_price_stop(spark, sf_dir):
    """The schedule of all part types against the bars of one."""
    b, s = _market(spark, sf_dir)
    return calendar.missing_price_stop(s, b.join(b.agg(F.min("ticker").alias("ticker")), "ticker"))


def q_coverage_gate(spark, sf_dir):
    b = _bars(spark, sf_dir)
    c = coverage.ticker_coverage(b, calendar.sessions(b))
    return coverage.coverage_gate(c, coverage.coverage_bounds(b, "dynamic", "none", 10), "1993-01-01", "1997-01-01", 64)


def _facts(spark, sf_dir):
    return base._intervals(spark, sf_dir)


def _summary(spark, sf_dir):
    p = base._paths(spark, sf_dir)
    v = p.select("strategy", F.col("decision_date").alias("date"), "value")
    return selection.portfolio_summary(v, p.select("strategy", "turnover", "gross"), p.select("strategy", F.lit("executed").alias("status")))


def q_portfolio_summary(spark, sf_dir):
    return _rounded(_summary(spark, sf_dir), 4)


def q_best_overall(spark, sf_dir):
    return _rounded(selection.best_overall(_summary(spark, sf_dir)).select("place", "strategy", "eligible", "sharpe", "max_drawdown"), 4)


def q_best_per_regime(spark, sf_dir):
    return selection.best_per_regime(stats.regime_leaderboard(_facts(spark, sf_dir))).select("market_regime", "strategy", "best_strategy")


def q_reliability(spark, sf_dir):
    rolling = boards.rolling_board(_facts(spark, sf_dir))
    return _rounded(selection.reliability_report(rolling, boards.ranked_board(rolling)).drop("cash_pct", "cost_drag"))


def _champion(spark, sf_dir):
    return boards.champion_path(boards.ranked_board(boards.rolling_board(_facts(spark, sf_dir))))


def q_meta_path(spark, sf_dir):
    """The meta portfolio in the champion's weights, in the form without books."""
    b, s = _market(spark, sf_dir)
    meta = selection.meta_targets(_champion(spark, sf_dir), _targets(spark, b, s))
    return _rounded(ledger.weight_path_returns(meta, labels.interval_return(s, b, "close"), 5.0, labels.intervals_of(s).where("next_fill is not null")).select("strategy", "decision_idx", "gross", "turnover", "net"))


def q_champion_timeline(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    t = selection.champion_timeline(_champion(spark, sf_dir), _targets(spark, b, s))
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x)
    return _rounded(t.select("decision_idx", "incumbent", "selected", "switch_reason", F.size("weights").cast("long").alias("positions"), total.alias("invested")))


def q_equity_curves(spark, sf_dir):
    return _rounded(selection.equity_curves(base._paths(spark, sf_dir).select("strategy", F.col("decision_date").alias("date"), "value")))


def _labelled(spark, sf_dir):
    """(features at decisions, schedule with ends, interval returns, interval volatilities)."""
    b, s = _market(spark, sf_dir)
    kept = s.where("status = 'kept'").select("decision_idx", "decision_date")
    f = features.prepared(b).select("ticker", F.col("date").alias("decision_date"), features.ret(21).alias("ret_21"), features.vol(21).alias("vol_21"))
    return kept.join(f, "decision_date").dropna(), labels.intervals_of(s), labels.interval_return(s, b, "close"), labels.interval_vol(s, b)


def q_training_rows(spark, sf_dir):
    f, s, ret, _ = _labelled(spark, sf_dir)
    per = f.join(ret.select("decision_idx", "ticker", "ret"), ["decision_idx", "ticker"]).groupBy("decision_idx").agg(F.count("*").alias("rows"))
    return models.refit_flags(models.window_sums(per, models.training_windows(s), ["rows"]).where("rows > 0"), 200, 5)


def q_ridge_coefs(spark, sf_dir):
    f, s, ret, _ = _labelled(spark, sf_dir)
    rows = f.join(ret.select("decision_idx", "ticker", F.col("ret").alias("label")), ["decision_idx", "ticker"])
    c = models.ridge_walkforward(rows, models.training_windows(s), NAMES, every=5)
    return _rounded(c.select("refit_idx", "rows", *[F.col("coefs")[i].alias(f"c{i}") for i in range(3)]))


def q_ml_weights(spark, sf_dir):
    f, s, ret, _ = _labelled(spark, sf_dir)
    out = models.ml_strategy("return", f, s, ret, NAMES, weighting="score_softmax", every=5)
    return _rounded(out.where("selected").select("decision_idx", "ticker", "weight"), 5)


def q_ml_risk_adjusted(spark, sf_dir):
    """Two ridge models, returns and log volatilities; forecasts with what came."""
    f, s, ret, vol = _labelled(spark, sf_dir)
    out = models.attach_actuals(models.ml_strategy("rar", f, s, ret, NAMES, vols=vol, every=20), ret, vol)
    return _rounded(out.drop("expected_cost"))


def _scored(spark, sf_dir, kind):
    b, s = _market(spark, sf_dir)
    c = _candidates(spark, b, s)
    mu = c.select("decision_idx", "decision_date", "ticker", F.round(F.col("momentum") / 63, 9).alias("predicted")).dropna()
    sigma = c.select("decision_idx", "decision_date", "ticker", F.round("vol_20", 9).alias("predicted")).dropna()
    return models.score_forecasts(kind, mu, sigma)


def q_select_vol(spark, sf_dir):
    out = models.select_weights(_scored(spark, sf_dir, "vol"), "vol", 3, 0.0, "inv_vol")
    return _rounded(out.where("selected").select("decision_idx", "ticker", "weight"))


def q_select_rar(spark, sf_dir):
    out = models.select_weights(_scored(spark, sf_dir, "rar"), "rar", 2, 0.0, "score_softmax")
    return _rounded(out.where("selected").select("decision_idx", "ticker", "weight"))


def q_ml_evaluation(spark, sf_dir):
    return _rounded(evaluation.evaluate_forecasts(base._forecasts(spark, sf_dir)))


def q_gbt_walkforward(spark, sf_dir):
    """Forecasts of the next interval's return by boosted trees, refitted every 50 decisions."""
    f, s, ret, _ = _labelled(spark, sf_dir)
    rows = f.join(ret.select("decision_idx", "ticker", F.col("ret").alias("label")), ["decision_idx", "ticker"], "left")
    return _rounded(models.gbt_walkforward(rows, models.training_windows(s), NAMES, every=50, rounds=100), 5)


def q_ml_evaluation_full(spark, sf_dir):
    """Return, volatility and risk-adjusted forecasts of the ridge strategy, by split, beside naive ones."""
    f, s, ret, vol = _labelled(spark, sf_dir)
    out = models.attach_actuals(models.ml_strategy("rar", f, s, ret, NAMES, vols=vol, every=20), ret, vol)
    nine = [F.round(c, 9).alias(c) for c in ("mu", "sigma", "score", "actual_return", "actual_volatility", "actual_rar")]
    out = settled(out.select(F.lit("ridge_rar").alias("strategy"), F.lit("ridge").alias("model_family"), F.col("decision_date").alias("date"), "ticker", *nine))
    return _rounded(evaluation.evaluate_ml(out), 5)


#: Keyword slots of the test tickers: order priorities as searched words.
_WORDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BRIDGE = [(t, _WORDS[i % 5], _WORDS[(i + 2) % 5] if i < 5 else None) for i, (t, _) in enumerate(base.UNIVERSE)]


def q_keyword_features(spark, sf_dir):
    """Two keyword series a ticker with changes over 28 and 84 observations, as known at each decision."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").cast("double").alias("value")).withColumn("available_date", F.date_add("date", 1))
    days = _market(spark, sf_dir)[1].where("status = 'kept'").select(F.col("decision_date").alias("date"))
    bridge = spark.createDataFrame(BRIDGE, "ticker string, kw1 string, kw2 string")
    return _rounded(features.bridged_features(features.level_change_features(s, days, (28, 84)), bridge))


def q_calibration(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    v = labels.interval_vol(s, b).where("vol is not null").select("decision_idx", "ticker", F.col("vol").alias("actual"))
    c = _candidates(spark, b, s).select("decision_idx", "ticker", F.col("vol_20").alias("predicted"))
    return _rounded(evaluation.calibration_ratio(c.join(v, ["decision_idx", "ticker"]).withColumn("model", F.lit("vol_20"))))


def q_macro_features(spark, sf_dir):
    """Daily order totals of each priority as series, published the day after, at the decisions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value")).withColumn("available_date", F.date_add("date", 1))
    days = _market(spark, sf_dir)[1].where("status = 'kept'").select(F.col("decision_date").alias("date"))
    return _rounded(features.level_change_features(s, days), 4)


QUERIES = {
    "buy_and_hold": q_buy_and_hold, "volatility_target": q_volatility_target, "ensemble": q_ensemble, "momentum_grid": q_momentum_grid,
    "constraints": q_constraints, "current_weights": q_current_weights, "orders": q_orders, "fills": q_fills, "position_ledger": q_position_ledger, "cash_ledger": q_cash_ledger,
    "cost_drag": q_cost_drag, "reconciliation": q_reconciliation, "mark_check": q_mark_check, "rebalance_paths": q_rebalance_paths, "trades": q_trades,
    "meta_book": q_meta_book, "book_reconciliation": q_book_reconciliation, "book_summary": q_book_summary, "book_reliability": q_book_reliability,
    "missing_price_stop": q_missing_price_stop, "coverage_gate": q_coverage_gate, "portfolio_summary": q_portfolio_summary, "best_overall": q_best_overall,
    "best_per_regime": q_best_per_regime, "reliability": q_reliability, "meta_path": q_meta_path, "champion_timeline": q_champion_timeline, "equity_curves": q_equity_curves,
    "training_rows": q_training_rows, "ridge_coefs": q_ridge_coefs, "ml_weights": q_ml_weights, "ml_risk_adjusted": q_ml_risk_adjusted, "select_vol": q_select_vol, "select_rar": q_select_rar,
    "ml_evaluation": q_ml_evaluation, "calibration": q_calibration, "macro_features": q_macro_features,
    "gbt_walkforward": q_gbt_walkforward, "ml_evaluation_full": q_ml_evaluation_full, "keyword_features": q_keyword_features,
}

# DuckDB SQL from the same named steps.
_T = f"WITH {_TYPE}, {_TARGETS}"
_P = f"{_T}, {_PATHS}"
_HELD = f"""{_T}, cc AS (SELECT c.*, b.close FROM cand c JOIN bars b ON b.date = c.decision_date AND b.ticker = c.ticker),
tg AS (SELECT decision_idx, ticker, weight FROM targets WHERE strategy = 'inverse_volatility'),
pos AS (SELECT decision_idx + 1 AS decision_idx, ticker, 100000.0 * (1.0 / count(*) OVER (PARTITION BY decision_idx)) / close AS shares, 1.0 / count(*) OVER (PARTITION BY decision_idx) AS cur FROM cc),
kept AS (SELECT DISTINCT decision_idx FROM cc), pr AS (SELECT decision_idx, ticker, close AS price FROM cc)"""
_ORDERS = f"""{_HELD}, tot AS (SELECT k.decision_idx, 500.0 + coalesce(sum(shares * price), 0) AS total_value FROM kept k LEFT JOIN (pos JOIN pr USING (decision_idx, ticker)) USING (decision_idx) GROUP BY ALL),
oo AS (SELECT decision_idx, ticker, coalesce(weight, 0) AS target_weight, (coalesce(weight, 0) * total_value * 0.99 - coalesce(shares, 0) * price) / price AS shares, price
  FROM tg FULL JOIN pos USING (decision_idx, ticker) JOIN pr USING (decision_idx, ticker) JOIN tot USING (decision_idx)),
orders_ AS (SELECT * FROM oo WHERE abs(shares * price) >= 1.0)"""
_ITEMS = "WITH f AS (SELECT l_suppkey AS portfolio_id, l_linestatus || CAST(l_linenumber AS VARCHAR) AS ticker, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS decision_idx, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS side, l_quantity AS q, l_extendedprice AS v, l_tax AS t, l_discount AS d FROM lineitem)"
_SUMMARY = f"""{_P},
v AS (SELECT strategy, decision_date AS date, value, ln(value / lag(value) OVER w) AS r, CAST(decision_date - lag(decision_date) OVER w AS DOUBLE) AS days, max(value) OVER w AS peak FROM valued WINDOW w AS (PARTITION BY strategy ORDER BY decision_date)),
m AS (SELECT strategy, sum(r) / sum(days) AS mu FROM v GROUP BY strategy),
s AS (SELECT strategy, arg_min(value, date) AS i, arg_max(value, date) AS f, sum(days) AS n, min(value / peak - 1) AS dd, sum(pow(r - mu * days, 2)) / sum(days) AS var, any_value(mu) AS mu FROM v JOIN m USING (strategy) GROUP BY strategy),
tn AS (SELECT strategy, avg(turnover) AS turnover, count(gross) AS periods FROM valued GROUP BY strategy),
summary AS (SELECT strategy, (f / i - 1) * 100 AS total_return, (pow(f / i, 365.25 / n) - 1) * 100 AS cagr, mu * 365.25 / sqrt(var * 365.25) AS sharpe, sqrt(var * 365.25) AS volatility, dd * 100 AS max_drawdown_pct, n AS elapsed_days, dd AS max_drawdown, f AS final_value, turnover, periods, periods AS executed, 0 AS skipped, 0.0 AS cost_drag FROM s JOIN tn USING (strategy))"""
_FIT = f"""WITH {_TYPE}, ft AS (SELECT decision_idx, decision_date, f.ticker, ret_21 AS a, vol_21 AS b FROM (SELECT * FROM sched WHERE status = 'kept') s
  JOIN (SELECT ticker, date, close / lag(close, 21) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret_21, CASE WHEN count(r1) OVER {_frame(21)} = 21 THEN stddev_samp(r1) OVER {_frame(21)} END AS vol_21 FROM px) f ON f.date = decision_date
  WHERE ret_21 IS NOT NULL AND vol_21 IS NOT NULL),
sets AS (SELECT i.decision_idx AS refit_idx, j.decision_idx FROM iv i JOIN iv j ON j.next_fill IS NOT NULL AND j.decision_idx <= i.decision_idx - 2 AND j.next_fill < i.decision_date AND i.decision_date - j.decision_date <= 756),
rw AS (SELECT decision_idx, a, b, ret AS y FROM ft JOIN ret USING (decision_idx, ticker)),
gd AS (SELECT decision_idx, count(*) AS rows, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM rw GROUP BY ALL),
gr AS (SELECT refit_idx, sum(rows) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) + 1 AS aa, sum(ab) AS ab, sum(bb) + 1 AS bb, sum(ay) AS ay, sum(by_) AS by_ FROM sets JOIN gd USING (decision_idx) GROUP BY ALL),
fl AS (SELECT *, refit_idx - min(CASE WHEN n >= 200 THEN refit_idx END) OVER () AS since FROM gr)"""
_COEFS = f"""{_FIT}, dt AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM fl WHERE since >= 0 AND since % 5 = 0 AND n >= 200),
co AS (SELECT refit_idx, CAST(n AS BIGINT) AS rows,
  (y * (aa * bb - ab * ab) - a * (ay * bb - ab * by_) + b * (ay * ab - aa * by_)) / det AS c0,
  (n * (ay * bb - ab * by_) - y * (a * bb - ab * b) + b * (a * by_ - ay * b)) / det AS c1,
  (n * (aa * by_ - ay * ab) - a * (a * by_ - ay * b) + y * (a * ab - aa * b)) / det AS c2 FROM dt)"""
_SCORES = f"""{_T}, fc AS (SELECT decision_idx, ticker, round(momentum / 63, 9) AS mu, round(vol_20, 9) AS sigma FROM cand)"""


def _second(sql: str, prefix: str) -> str:
    """The path steps over a second table of targets, all names with a prefix."""
    for name in ("days", "held", "gross", "path0", "old", "moved", "path", "valued", "targets"):
        sql = re.sub(rf"(?<![\w.]){name}(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", prefix + name, sql)
    return sql


SQL = {
    "buy_and_hold": f"""{_HELD}, h AS (SELECT decision_idx, ticker, close / first(close) OVER w AS v, first(decision_idx) OVER w AS at_, min(decision_idx) OVER () AS f FROM cc WINDOW w AS (PARTITION BY ticker ORDER BY decision_idx))
SELECT decision_idx, ticker, round(v / sum(v) OVER (PARTITION BY decision_idx), 6) AS weight FROM h WHERE at_ = f""",
    "volatility_target": f"""{_T}, lr AS (SELECT ticker, date, list({{'d': date, 'r': r1}}) OVER {_frame(20)} AS l FROM px WHERE r1 IS NOT NULL),
eq AS (SELECT decision_idx, decision_date, ticker, 1.0 / count(*) OVER w AS w, count(*) OVER w AS n FROM cand WINDOW w AS (PARTITION BY decision_idx)),
d AS (SELECT decision_idx, n, w, unnest(l) AS x FROM eq JOIN lr ON lr.date = decision_date AND lr.ticker = eq.ticker),
dy AS (SELECT decision_idx, x.d AS day, sum(w * x.r) AS r FROM d GROUP BY decision_idx, x.d HAVING count(*) = max(n)),
sc AS (SELECT decision_idx, stddev_samp(r) * sqrt(252) AS vol FROM dy GROUP BY ALL)
SELECT decision_idx, ticker, round(w * least(1, 0.1 / vol), 6) AS weight FROM eq JOIN sc USING (decision_idx) WHERE vol > 0""",
    "ensemble": f"""{_T}, e AS (SELECT decision_idx, ticker, sum(weight * CASE WHEN strategy = 'xs_momentum' THEN 0.75 ELSE 0.25 END) AS w FROM targets WHERE strategy IN ('inverse_volatility', 'xs_momentum') GROUP BY ALL)
SELECT decision_idx, ticker, round(w / greatest(sum(w) OVER (PARTITION BY decision_idx), 1.0), 6) AS weight FROM e""",
    "momentum_grid": f"""{_T}, g AS (SELECT * FROM (VALUES (2), (4)) a(top_k), (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.02 AS DOUBLE))) b(floor_)),
p AS (SELECT 'xs_top_k=' || top_k || '_floor=' || CAST(floor_ AS VARCHAR) AS strategy, decision_idx, ticker FROM xs, g WHERE lead > floor_ AND k <= top_k)
SELECT strategy, decision_idx, ticker, round(1.0 / count(*) OVER (PARTITION BY strategy, decision_idx), 6) AS weight FROM p""",
    "constraints": f"""{_HELD}, a AS (SELECT *, weight / greatest(sum(weight) OVER (PARTITION BY decision_idx), 1.0) AS w1 FROM tg),
b AS (SELECT *, least(w1, 0.05) AS w2 FROM a), c AS (SELECT decision_idx, ticker, w2 / greatest(sum(w2) OVER (PARTITION BY decision_idx), 1.0) AS w FROM b),
j AS (SELECT decision_idx, ticker, coalesce(w, 0) AS w, coalesce(cur, 0) AS cur FROM c FULL JOIN pos USING (decision_idx, ticker)),
k AS (SELECT *, 0.5 * (sum(abs(w - cur)) OVER d + abs(sum(cur) OVER d - sum(w) OVER d)) AS turn FROM j WINDOW d AS (PARTITION BY decision_idx)),
l AS (SELECT *, CASE WHEN turn > 0.05 THEN 0.05 / turn ELSE 1.0 END AS scale FROM k), m AS (SELECT *, cur + scale * (w - cur) AS weight FROM l)
SELECT decision_idx, ticker, round(weight, 6) AS weight, round(1 - sum(weight) OVER (PARTITION BY decision_idx), 6) AS cash_weight, round(turn, 6) AS turnover_pre, round(turn * scale, 6) AS turnover_post, round(scale, 6) AS scale_factor FROM m""",
    "current_weights": f"""{_HELD}, v AS (SELECT decision_idx, ticker, shares * price AS v FROM pos JOIN pr USING (decision_idx, ticker) UNION ALL SELECT decision_idx, 'cash', 500.0 FROM kept)
SELECT decision_idx, ticker, round(v / sum(v) OVER (PARTITION BY decision_idx), 6) AS weight FROM v""",
    "orders": f"{_ORDERS} SELECT decision_idx, ticker, round(shares, 4) AS shares, round(target_weight, 4) AS target_weight FROM orders_",
    "fills": f"""{_ORDERS}, p AS (SELECT decision_idx, ticker, shares AS wish, price * 1.01 AS price, row_number() OVER (PARTITION BY decision_idx ORDER BY ticker) AS ord, CAST(shares > 0 AS INT) AS buy FROM orders_),
q AS (SELECT *, price * (1 + sign(wish) * 5.0 / 1e4) AS fill_price FROM p),
r AS (SELECT *, 500.0 + coalesce(sum(-wish * fill_price - 1.0) OVER (PARTITION BY decision_idx ORDER BY buy, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM q),
s AS (SELECT *, CASE WHEN buy = 1 THEN least(wish, greatest((room - 1.0) / fill_price, 0)) ELSE wish END AS shares FROM r)
SELECT decision_idx, ticker, round(shares, 4) AS shares, round(fill_price, 4) AS fill_price, 1.0 AS commission, round(abs(shares) * price * 5.0 / 1e4, 4) AS slippage_cost, round(abs(shares) * fill_price, 4) AS gross_value, round(-shares * fill_price - 1.0, 4) AS cash_flow FROM s WHERE abs(shares) > 1e-12""",
    "position_ledger": f"{_ITEMS}, g AS (SELECT portfolio_id, ticker, decision_idx, sum(side * q) AS s FROM f GROUP BY ALL), h AS (SELECT *, sum(s) OVER (PARTITION BY portfolio_id, ticker ORDER BY decision_idx) AS x FROM g) SELECT portfolio_id, decision_idx, ticker, round(CASE WHEN abs(x) < 1e-12 THEN 0.0 ELSE x END, 4) AS shares FROM h",
    "cash_ledger": f"{_ITEMS}, g AS (SELECT portfolio_id, decision_idx, sum(-side * v) AS s FROM f GROUP BY ALL) SELECT portfolio_id, decision_idx, round(1e9 + sum(s) OVER (PARTITION BY portfolio_id ORDER BY decision_idx), 2) AS cash FROM g",
    "cost_drag": f"{_ITEMS} SELECT portfolio_id, round(sum(v * t + v * d) / sum(v), 6) AS cost_drag FROM f GROUP BY ALL",
    "reconciliation": f"{_ITEMS} SELECT count(*) AS books, false AS off FROM (SELECT DISTINCT portfolio_id, decision_idx FROM f)",
    "mark_check": f"{_HELD} SELECT decision_idx, ticker FROM pos ANTI JOIN pr USING (decision_idx, ticker)",
    "missing_price_stop": f"""WITH {_TYPE}, one AS (SELECT DISTINCT date FROM bars WHERE ticker = (SELECT min(ticker) FROM bars)),
z AS (SELECT s.*, max(CASE WHEN d.date IS NULL OR f.date IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY decision_date) AS bad FROM sched s LEFT JOIN one d ON d.date = decision_date LEFT JOIN one f ON f.date = fill_date)
SELECT decision_date, fill_date, CASE WHEN bad = 1 THEN 'skipped' ELSE status END AS status, decision_idx FROM z""",
    "coverage_gate": f"""WITH {_TYPE}, c AS (SELECT ticker, max(place) - min(place) + 1 - count(DISTINCT b.date) AS gap, count(DISTINCT b.date) AS n FROM bars b JOIN cal USING (date) GROUP BY ticker),
s AS (SELECT ticker, min(CASE WHEN k = 10 THEN date END) AS a, max(date) AS z FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM bars) GROUP BY ticker),
u AS (SELECT CASE WHEN arg_min(a, ticker) IS NOT NULL THEN greatest(arg_min(a, ticker), min(a)) END AS a, min(z) AS z FROM s), w AS (SELECT CASE WHEN a <= z THEN a END AS a, CASE WHEN a <= z THEN z END AS z FROM u)
SELECT coalesce(a IS NOT NULL AND least_observations >= 64 AND gaps = 0 AND greatest(a, DATE '1993-01-01') <= least(z, DATE '1997-01-01'), false) AS accepted, CASE WHEN a IS NOT NULL THEN greatest(a, DATE '1993-01-01') END AS start, CASE WHEN z IS NOT NULL THEN least(z, DATE '1997-01-01') END AS "end", gaps, least_observations
FROM w, (SELECT CAST(sum(gap) AS BIGINT) AS gaps, min(n) AS least_observations FROM c)""",
    "portfolio_summary": f"{_SUMMARY} SELECT strategy, {_round(['total_return', 'cagr', 'sharpe', 'volatility', 'max_drawdown_pct', 'elapsed_days', 'max_drawdown', 'final_value', 'turnover'], 4)}, periods, executed, skipped, cost_drag FROM summary",
    "best_overall": f"""{_SUMMARY}, e AS (SELECT *, periods >= 4 AND max_drawdown >= -0.2 AND turnover <= 1.0 AS eligible FROM summary), o AS (SELECT *, CAST(row_number() OVER (ORDER BY sharpe DESC, cagr DESC, max_drawdown DESC, turnover, strategy) AS INT) AS place FROM e WHERE eligible OR NOT (SELECT max(eligible) FROM e))
SELECT place, strategy, eligible, round(sharpe, 4) AS sharpe, round(max_drawdown, 4) AS max_drawdown FROM o WHERE place <= 3""",
    "best_per_regime": f"""{base._FACTS}, c AS (SELECT *, exp(sum(ln(1 + gross)) OVER (PARTITION BY market_regime, strategy ORDER BY decision_idx)) AS level FROM facts),
p AS (SELECT *, greatest(max(level) OVER (PARTITION BY market_regime, strategy ORDER BY decision_idx), 1.0) AS peak FROM c),
r AS (SELECT market_regime, strategy, count(*) AS n, avg(turnover) AS t, min(least(level / peak - 1, 0.0)) AS dd FROM p GROUP BY ALL)
SELECT market_regime, strategy, first(strategy) OVER (PARTITION BY market_regime ORDER BY CASE WHEN n >= 4 AND dd >= -0.2 AND t <= 1.0 THEN 0 ELSE 1 END, dd DESC, t, strategy) AS best_strategy FROM r""",
    "reliability": f"""{base._RANKED}, f AS (SELECT strategy, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY ALL),
r AS (SELECT strategy, avg(sharpe) AS sharpe_mean, stddev_samp(sharpe) AS sharpe_std, min(sharpe) AS sharpe_min, max(sharpe) AS sharpe_max, min(drawdown) AS max_drawdown, avg(turnover) AS turnover_mean, max(turnover) AS turnover_max FROM board GROUP BY ALL)
SELECT strategy, {_round(['sharpe_mean', 'sharpe_std', 'sharpe_min', 'sharpe_max', 'max_drawdown', 'turnover_mean', 'turnover_max'])}, coalesce(n, 0) AS top_rank_count, row_number() OVER (ORDER BY coalesce(n, 0) DESC, CASE WHEN sharpe_std > 0 THEN sharpe_std END NULLS LAST, strategy) = 1 AS most_reliable FROM r LEFT JOIN f USING (strategy)""",
    "equity_curves": f"{_P} SELECT strategy, decision_date AS date, round(value, 6) AS value, round(value / first(value) OVER (PARTITION BY strategy ORDER BY decision_idx), 6) AS normalised FROM valued",
    "training_rows": f"{_FIT} SELECT refit_idx, CAST(n AS BIGINT) AS rows, coalesce(since >= 0 AND since % 5 = 0 AND n >= 200, false) AS refit FROM fl",
    "ridge_coefs": f"{_COEFS} SELECT refit_idx, rows, {_round(['c0', 'c1', 'c2'])} FROM co",
    "ml_weights": f"""{_COEFS}, p AS (SELECT f.decision_idx, f.ticker, c0 + c1 * a + c2 * b - 5.0 / 1e4 AS edge FROM ft f ASOF JOIN co ON f.decision_idx >= co.refit_idx),
k AS (SELECT *, row_number() OVER (PARTITION BY decision_idx ORDER BY edge DESC, ticker) AS k, max(edge) OVER (PARTITION BY decision_idx) AS top FROM p)
SELECT decision_idx, ticker, round(exp(edge - top) / sum(exp(edge - top)) OVER (PARTITION BY decision_idx), 5) AS weight FROM k WHERE top > 0 AND k <= 3""",
    "select_vol": f"""{_SCORES}, k AS (SELECT *, 1 / greatest(sigma, 1e-6) AS score, row_number() OVER (PARTITION BY decision_idx ORDER BY 1 / greatest(sigma, 1e-6) DESC, ticker) AS k FROM fc WHERE sigma IS NOT NULL)
SELECT decision_idx, ticker, round(score / sum(score) OVER (PARTITION BY decision_idx), 6) AS weight FROM k WHERE k <= 3""",
    "select_rar": f"""{_SCORES}, e AS (SELECT *, mu - 5.0 / 1e4 AS edge, (mu - 5.0 / 1e4) / greatest(sigma, 1e-6) AS score FROM fc WHERE mu IS NOT NULL AND sigma IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY decision_idx ORDER BY score DESC, ticker) AS k, max(edge) OVER (PARTITION BY decision_idx) AS top FROM e), s AS (SELECT *, max(score) OVER (PARTITION BY decision_idx) AS hi FROM k WHERE top > 0 AND k <= 2)
SELECT decision_idx, ticker, round(exp(score - hi) / sum(exp(score - hi)) OVER (PARTITION BY decision_idx), 6) AS weight FROM s""",
    "ml_evaluation": f"""SELECT model, split, unnest(['n', 'mae', 'rmse', 'hit']) AS metric, unnest([CAST(n AS DOUBLE), mae, rmse, hit]) AS value FROM ({base.SQL['forecast_errors']})
UNION ALL SELECT model, 'all', unnest(['mean_rank_ic', 'top_hit_rate', 'dates']), unnest([mean_rank_ic, top_hit_rate, CAST(dates AS DOUBLE)]) FROM ({base.SQL['rank_quality']})""",
    "calibration": f"""{_T}, st AS (SELECT decision_idx, ticker, pow(ln(close) - lag(ln(close)) OVER (PARTITION BY decision_idx, ticker ORDER BY date), 2) AS sq FROM iv JOIN bars ON date BETWEEN fill_date AND next_fill),
v AS (SELECT decision_idx, ticker, sqrt(sum(sq)) AS vol FROM st GROUP BY ALL HAVING sum(sq) IS NOT NULL)
SELECT 'vol_20' AS model, round(avg(vol_20) / avg(vol), 6) AS ratio FROM cand JOIN v USING (decision_idx, ticker) WHERE vol_20 IS NOT NULL""",
    "macro_features": f"""WITH {_TYPE}, s AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
c AS (SELECT series, d + 1 AS known, v, coalesce(v / lag(v, 21) OVER w - 1, 0) AS c21, coalesce(v / lag(v, 63) OVER w - 1, 0) AS c63 FROM s WINDOW w AS (PARTITION BY series ORDER BY d)),
q AS (SELECT decision_date AS date, series FROM sched, (SELECT DISTINCT series FROM s) WHERE status = 'kept')
SELECT q.series, q.date, round(coalesce(v, 0), 4) AS level, round(coalesce(c21, 0), 4) AS change_21, round(coalesce(c63, 0), 4) AS change_63 FROM q ASOF LEFT JOIN c ON q.series = c.series AND q.date >= c.known""",
}



def book_sql(goals: str) -> str:
    """Books by recursion, one decision a step, from a table (strategy, decision_idx, ticker, weight): CTEs mk, gl, book, paths.

    A row of ticker 'cash' carries each book from step to step.
    """
    fed = f"""mk AS MATERIALIZED (SELECT q.decision_idx, q.ticker, a.close AS price, b.close AS fill FROM (SELECT s.*, t.ticker FROM sched s, (SELECT DISTINCT ticker FROM bars) t WHERE status = 'kept') q
  ASOF JOIN bars a ON a.ticker = q.ticker AND q.decision_date >= a.date ASOF JOIN bars b ON b.ticker = q.ticker AND q.fill_date >= b.date
  UNION ALL SELECT decision_idx, 'cash', 1.0, 1.0 FROM sched WHERE status = 'kept'),
gl AS MATERIALIZED (SELECT strategy AS p, decision_idx, ticker, weight FROM {goals}),"""
    by, day = "PARTITION BY p", "WINDOW d AS (PARTITION BY p)"
    return f"""{fed}
book AS (
  SELECT strategy AS p, -1 AS k, 'cash' AS ticker, CAST(NULL AS DOUBLE) AS raw, CAST(NULL AS DOUBLE) AS goal, CAST(NULL AS DOUBLE) AS shares, CAST(NULL AS DOUBLE) AS fill, CAST(NULL AS DOUBLE) AS paid, CAST(0 AS DOUBLE) AS position,
    CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS pre, CAST(100000 AS DOUBLE) AS cash, CAST(NULL AS DOUBLE) AS turn, CAST(NULL AS DOUBLE) AS scale, CAST(NULL AS DOUBLE) AS value FROM (SELECT DISTINCT p AS strategy FROM gl)
  UNION ALL
  SELECT p, k, ticker, raw, CASE WHEN ticker <> 'cash' THEN goal END, done, CASE WHEN done IS NOT NULL THEN fill END, at_, position, before, pre, cash_after, turn, scale, cash_after + sum(position * fill) OVER ({by}) FROM (
    SELECT *, cash + coalesce(sum(-done * at_) OVER ({by}), 0) AS cash_after, CASE WHEN abs(held + coalesce(done, 0)) > 1e-12 THEN held + coalesce(done, 0) ELSE 0 END AS position FROM (
      SELECT *, CASE WHEN abs(got) > 1e-12 THEN got END AS done FROM (
        SELECT *, CASE WHEN wish > 0 THEN least(wish, greatest((sold + cash - coalesce(sum(CASE WHEN wish > 0 THEN wish * at_ END) OVER ({by} ORDER BY ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / at_, 0)) ELSE wish END AS got FROM (
          SELECT *, coalesce(sum(CASE WHEN wish < 0 THEN -wish * at_ END) OVER ({by}), 0) AS sold FROM (
            SELECT *, fill * (1 + CASE WHEN wish > 0 THEN 1 ELSE -1 END * 5.0 / 1e4) AS at_ FROM (
              SELECT *, CASE WHEN ticker <> 'cash' AND abs((goal * before * (1 - 0.01) - held * price) / price * price) >= 1.0 THEN (goal * before * (1 - 0.01) - held * price) / price END AS wish FROM (
                SELECT *, now_ + scale * (w - now_) AS goal FROM (
                  SELECT *, CASE WHEN turn > 0.35 THEN 0.35 / turn ELSE 1.0 END AS scale FROM (
                    SELECT *, 0.5 * (sum(abs(w - now_)) OVER d + abs((1 - sum(w) OVER d) - cash / before)) AS turn FROM (
                      SELECT *, w2 / greatest(sum(w2) OVER d, 1.0) AS w, held * price / before AS now_ FROM (
                        SELECT *, least(w1 / greatest(sum(w1) OVER d, 1.0), 0.35) AS w2 FROM (
                          SELECT *, cash + sum(held * price) OVER d AS before, cash + sum(held * fill) OVER d AS pre FROM (
                            SELECT n.p, n.k, n.cash, m.ticker, m.price, m.fill, coalesce(h.position, 0) AS held, greatest(g.weight, 0) AS raw, coalesce(greatest(g.weight, 0), 0) AS w1
                            FROM (SELECT p, k + 1 AS k, cash FROM book WHERE ticker = 'cash') n JOIN mk m ON m.decision_idx = n.k
                            LEFT JOIN book h ON h.p = n.p AND h.ticker = m.ticker LEFT JOIN gl g ON g.p = n.p AND g.decision_idx = n.k AND g.ticker = m.ticker
                            WHERE m.ticker = 'cash' OR g.weight IS NOT NULL OR coalesce(h.position, 0) <> 0) {day}) {day}) {day}) {day})))))))))),
paths AS MATERIALIZED (SELECT b.*, s.decision_date, s.fill_date FROM book b JOIN sched s ON s.decision_idx = k WHERE k >= 0)"""


_VALUES = """SELECT p AS portfolio_id, CAST(k AS INT) AS decision_idx, decision_date, fill_date, round(before, 2) + 0.0 AS value_before, round(pre, 2) + 0.0 AS pre_trade_value, round(value, 2) + 0.0 AS value_after, round(cash, 2) + 0.0 AS cash, round(turn, 6) + 0.0 AS turnover_pre,
  round(turn * scale, 6) + 0.0 AS turnover_post, round(scale, 6) + 0.0 AS scale_factor, round(pre / lag(value) OVER w - 1, 6) + 0.0 AS gross, round(value / lag(value) OVER w - 1, 6) + 0.0 AS net, round(cash / value, 6) + 0.0 AS cash_pct FROM paths WHERE ticker = 'cash' WINDOW w AS (PARTITION BY p ORDER BY k)"""
_RECURSIVE = _T.replace("WITH ", "WITH RECURSIVE ", 1)
SQL |= {
    "rebalance_paths": f"{_RECURSIVE}, {book_sql('targets')} {_VALUES}",
    "trades": f"""{_RECURSIVE}, {book_sql('targets')} SELECT p AS portfolio_id, CAST(k AS INT) AS decision_idx, decision_date, fill_date, ticker, CASE WHEN shares > 0 THEN 'buy' ELSE 'sell' END AS side, round(shares, 6) + 0.0 AS shares, round(paid, 4) + 0.0 AS fill_price, 0.0 AS commission,
  round(abs(shares) * abs(paid - fill), 4) + 0.0 AS slippage_cost, round(abs(shares) * abs(paid - fill), 4) + 0.0 AS net_cost, round(abs(shares) * paid, 2) + 0.0 AS gross_value, round(-shares * paid, 2) + 0.0 AS cash_flow, k = (SELECT min(decision_idx) FROM sched) AS is_initialization FROM paths WHERE shares IS NOT NULL""",
}

_RETURNS20 = _COEFS.replace("since % 5 = 0", "since % 20 = 0")
_VOLS = f"""st AS (SELECT decision_idx, ticker, pow(ln(close) - lag(ln(close)) OVER (PARTITION BY decision_idx, ticker ORDER BY date), 2) AS sq FROM iv JOIN bars ON date BETWEEN fill_date AND next_fill),
vo AS (SELECT decision_idx, ticker, sqrt(sum(sq)) AS vol FROM st GROUP BY ALL),
rwv AS (SELECT decision_idx, a, b, ln(greatest(vol, 0) + 1e-8) AS y FROM ft JOIN vo USING (decision_idx, ticker) WHERE vol IS NOT NULL)
{re.sub(r"\b(rw|gd|gr|fl|dt|co)\b", r"\1v", _RETURNS20[_RETURNS20.index(", gd AS") if ", gd AS" in _RETURNS20 else _RETURNS20.index(",\ngd AS"):])}"""
SQL["ml_risk_adjusted"] = f"""{_RETURNS20}, {_VOLS},
p AS (SELECT f.decision_idx, f.decision_date, f.ticker, m.c0 + m.c1 * a + m.c2 * b AS mu, greatest(exp(s.c0 + s.c1 * a + s.c2 * b) - 1e-8, 0) AS sigma FROM ft f ASOF JOIN co m ON f.decision_idx >= m.refit_idx ASOF JOIN cov s ON f.decision_idx >= s.refit_idx),
e AS (SELECT *, mu - 5.0 / 1e4 AS net_edge, (mu - 5.0 / 1e4) / greatest(sigma, 1e-6) AS score FROM p),
k AS (SELECT *, max(net_edge) OVER d > 0 AND row_number() OVER (PARTITION BY decision_idx ORDER BY score DESC, ticker) <= 3 AS selected FROM e WINDOW d AS (PARTITION BY decision_idx))
SELECT decision_idx, k.decision_date, ticker, {_round(["mu", "sigma", "net_edge", "score"])}, selected, round(CASE WHEN selected THEN 1.0 / count(*) FILTER (selected) OVER (PARTITION BY decision_idx) END, 6) AS weight,
round(ret, 6) AS actual_return, round(vol, 6) AS actual_volatility, round(CASE WHEN vol > 0 THEN (ret - 5.0 / 1e4) / vol END, 6) AS actual_rar
FROM k LEFT JOIN ret USING (decision_idx, ticker) LEFT JOIN vo USING (decision_idx, ticker)"""

# The champion's path by recursion, kept as a table, then the meta portfolio over its weights.
_WALK = base.SQL["champion_path"].rpartition("SELECT decision_idx")[0].rstrip()
SQL |= {
    "meta_path": f"""{_WALK}, mtargets AS (SELECT 'meta' AS strategy, w.decision_idx, w.decision_date, t.ticker, t.weight FROM walk w JOIN targets t ON t.strategy = w.selected AND t.decision_idx = w.decision_idx WHERE w.k > 0),
{_second(_PATHS, 'm')} SELECT strategy, decision_idx, {_round(['gross', 'turnover', 'net'])} FROM mpath""",
    "champion_timeline": f"""{_WALK}, tw AS (SELECT strategy, decision_idx, count(*) AS n, sum(weight) AS w FROM targets GROUP BY ALL)
SELECT a.decision_idx, lag(selected) OVER (ORDER BY a.decision_idx) AS incumbent, selected, switch_reason, coalesce(n, 0) AS positions, round(coalesce(w, 0), 6) AS invested FROM walk a LEFT JOIN tw ON tw.strategy = selected AND tw.decision_idx = a.decision_idx WHERE k > 0""",
}
SQL |= {
    "meta_book": f"""{_WALK}, mtargets AS (SELECT 'meta' AS strategy, w.decision_idx, t.ticker, t.weight FROM walk w JOIN targets t ON t.strategy = w.selected AND t.decision_idx = w.decision_idx WHERE w.k > 0), {book_sql('mtargets')} {_VALUES}""",
    "book_reconciliation": f"""{_RECURSIVE}, {book_sql('targets')}, tr AS (SELECT p, k, ticker, shares, -shares * paid AS flow FROM paths WHERE shares IS NOT NULL),
lg AS (SELECT a.p, a.k, 100000 + coalesce((SELECT sum(flow) FROM tr WHERE tr.p = a.p AND tr.k <= a.k), 0) + coalesce((SELECT sum(shares * m.fill) FROM tr JOIN mk m ON m.ticker = tr.ticker WHERE m.decision_idx = a.k AND tr.p = a.p AND tr.k <= a.k), 0) AS rebuilt, a.value FROM paths a WHERE a.ticker = 'cash')
SELECT p AS portfolio_id, count(*) AS books, count(*) FILTER (abs(rebuilt - value) > 1e-6) AS off, round(max(value), 2) AS highest FROM lg GROUP BY p""",
}
_BOOKED = f"""{_RECURSIVE}, {book_sql('targets')}, bv AS (SELECT p AS strategy, k, fill_date AS date, value, turn * scale AS turned, pre / lag(value) OVER w - 1 AS gross, cash / value AS cash_pct FROM paths WHERE ticker = 'cash' WINDOW w AS (PARTITION BY p ORDER BY k)),
cd AS (SELECT p AS strategy, sum(abs(shares) * abs(paid - fill)) / sum(abs(shares) * paid) AS cost_drag FROM paths WHERE shares IS NOT NULL GROUP BY p)"""
SQL["book_summary"] = f"""{_BOOKED}, v AS (SELECT strategy, date, value, ln(value / lag(value) OVER w) AS r, CAST(date - lag(date) OVER w AS DOUBLE) AS days, max(value) OVER w AS peak FROM bv WINDOW w AS (PARTITION BY strategy ORDER BY date)),
m AS (SELECT strategy, sum(r) / sum(days) AS mu FROM v GROUP BY strategy),
s AS (SELECT strategy, arg_min(value, date) AS i, arg_max(value, date) AS f, sum(days) AS n, min(value / peak - 1) AS dd, sum(pow(r - mu * days, 2)) / sum(days) AS var, any_value(mu) AS mu FROM v JOIN m USING (strategy) GROUP BY strategy),
tn AS (SELECT strategy, avg(turned) AS turnover, count(gross) AS periods FROM bv GROUP BY strategy)
SELECT strategy, round((f / i - 1) * 100, 4) AS total_return, round((pow(f / i, 365.25 / n) - 1) * 100, 4) AS cagr, round(mu * 365.25 / sqrt(var * 365.25), 4) AS sharpe, round(sqrt(var * 365.25), 4) AS volatility, round(dd * 100, 4) AS max_drawdown_pct, round(n, 4) AS elapsed_days, round(dd, 4) AS max_drawdown,
round(f, 2) AS final_value, round(turnover, 4) AS turnover, periods, (SELECT count(*) FROM sched WHERE status = 'kept') AS executed, (SELECT count(*) FROM sched WHERE status = 'skipped') AS skipped, round(cost_drag, 6) AS cost_drag FROM s JOIN tn USING (strategy) JOIN cd USING (strategy)"""
SQL["book_reliability"] = f"""{base._RANKED.replace("WITH ", "WITH RECURSIVE ", 1)}, {_BOOKED[_BOOKED.index("mk AS MATERIALIZED"):]}, fr AS (SELECT strategy, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY ALL),
rr AS (SELECT strategy, stddev_samp(sharpe) AS sd FROM board GROUP BY ALL), ca AS (SELECT strategy, avg(cash_pct) AS cash_pct FROM bv GROUP BY ALL)
SELECT strategy, round(cash_pct, 6) AS cash_pct, round(cost_drag, 6) AS cost_drag, coalesce(n, 0) AS top_rank_count, row_number() OVER (ORDER BY coalesce(n, 0) DESC, CASE WHEN sd > 0 THEN sd END NULLS LAST, strategy) = 1 AS most_reliable FROM rr JOIN ca USING (strategy) JOIN cd USING (strategy) LEFT JOIN fr USING (strategy)"""
_SLOT = "round(coalesce({s}.v, 0), 6) AS {s}_level, round(coalesce({s}.c28, 0), 6) AS {s}_change_28, round(coalesce({s}.c84, 0), 6) AS {s}_change_84"
SQL["keyword_features"] = f"""WITH {_TYPE}, s AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL),
c AS (SELECT series, d + 1 AS known, v, coalesce(v / lag(v, 28) OVER w - 1, 0) AS c28, coalesce(v / lag(v, 84) OVER w - 1, 0) AS c84 FROM s WINDOW w AS (PARTITION BY series ORDER BY d)),
b AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{a}', {repr(z) if z else 'NULL'})" for t, a, z in BRIDGE)}) v(ticker, kw1, kw2)), q AS (SELECT decision_date AS date, b.* FROM sched, b WHERE status = 'kept')
SELECT q.ticker, q.date, {_SLOT.format(s="x1")}, {_SLOT.format(s="x2")} FROM q ASOF LEFT JOIN c x1 ON q.kw1 = x1.series AND q.date >= x1.known ASOF LEFT JOIN c x2 ON q.kw2 = x2.series AND q.date >= x2.known""".replace("AS x1_", "AS kw1_").replace("AS x2_", "AS kw2_")
_AT = "greatest(1, floor(n * CAST(0.6 AS DOUBLE)))"
SQL["ml_evaluation_full"] = f"""{SQL["ml_risk_adjusted"][: SQL["ml_risk_adjusted"].index("k AS (SELECT *, max(net_edge)")]}
ff AS (SELECT e.decision_date AS date, ticker, round(mu, 9) AS mu, round(sigma, 9) AS sigma, round(score, 9) AS score, round(ret, 9) AS ar, round(vol, 9) AS av, round(CASE WHEN vol > 0 THEN (ret - 5.0 / 1e4) / vol END, 9) AS arr FROM e LEFT JOIN ret USING (decision_idx, ticker) LEFT JOIN vo USING (decision_idx, ticker)),
dk AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ff)),
sp AS (SELECT ff.*, CASE WHEN k <= {_AT} THEN 'train' WHEN k <= greatest({_AT} + 1, floor(n * CAST(0.8 AS DOUBLE))) THEN 'validation' ELSE 'holdout' END AS split FROM ff JOIN dk USING (date)),
tg AS (SELECT 'return' AS target, date, ticker, split, mu AS p, ar AS a FROM sp WHERE mu IS NOT NULL AND ar IS NOT NULL UNION ALL SELECT 'volatility', date, ticker, split, greatest(sigma, 0), greatest(av, 0) FROM sp WHERE sigma IS NOT NULL AND av IS NOT NULL
  UNION ALL SELECT 'rar', date, ticker, split, score, arr FROM sp WHERE score IS NOT NULL AND arr IS NOT NULL),
sr AS (SELECT 'walk_forward_model' AS series, * FROM tg UNION ALL SELECT 'naive_zero_baseline', target, date, ticker, split, 0.0, a FROM tg WHERE target = 'return'
  UNION ALL SELECT * FROM (SELECT 'naive_persistence_baseline' AS series, target, date, ticker, split, lag(a) OVER (PARTITION BY target, ticker ORDER BY date) AS p, a FROM tg WHERE target <> 'rar') WHERE p IS NOT NULL),
ev AS (SELECT target, series, unnest(CASE WHEN series = 'walk_forward_model' THEN ['all', split] ELSE ['all'] END) AS split, p, a FROM sr),
er AS (SELECT target, series, split, CAST(count(*) AS DOUBLE) AS observations, avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse, CASE WHEN target = 'return' THEN avg(CAST((p >= 0) = (a >= 0) AS INT)) END AS directional_accuracy,
  CASE WHEN target = 'volatility' AND series = 'walk_forward_model' AND split = 'all' AND avg(a) > 0 THEN avg(p) / avg(a) END AS calibration_ratio FROM ev GROUP BY target, series, split),
rq AS (SELECT *, rank() OVER (d ORDER BY p) + (count(*) OVER (PARTITION BY target, series, date, p) - 1) / 2.0 AS rp, rank() OVER (d ORDER BY a) + (count(*) OVER (PARTITION BY target, series, date, a) - 1) / 2.0 AS ra,
  row_number() OVER (d ORDER BY p DESC, ticker) AS kp, row_number() OVER (d ORDER BY a DESC, ticker) AS ka FROM sr WINDOW d AS (PARTITION BY target, series, date)),
dy AS (SELECT target, series, date, split, CASE WHEN count(*) >= 2 AND min(rp) < max(rp) AND min(ra) < max(ra) THEN corr(rp, ra) END AS ic, max(CAST(kp = 1 AND ka = 1 AS INT)) AS top FROM rq GROUP BY ALL),
dd AS (SELECT target, series, unnest(CASE WHEN series = 'walk_forward_model' THEN ['all', split] ELSE ['all'] END) AS split, ic, top FROM dy),
dg AS (SELECT target, series, split, avg(ic) AS mean_rank_correlation, CASE WHEN target = 'rar' AND series = 'walk_forward_model' AND split = 'all' THEN avg(top) END AS top_selection_hit_rate FROM dd GROUP BY target, series, split),
al AS (SELECT target, series, split, unnest(['observations', 'mae', 'rmse', 'directional_accuracy', 'calibration_ratio']) AS metric, unnest([observations, mae, rmse, directional_accuracy, calibration_ratio]) AS value FROM er
  UNION ALL SELECT target, series, split, unnest(['mean_rank_correlation', 'top_selection_hit_rate']), unnest([mean_rank_correlation, top_selection_hit_rate]) FROM dg)
SELECT 'ridge_rar' AS strategy, true AS ridge_reference, target, split, series, metric, round(value, 5) AS value FROM al WHERE value IS NOT NULL"""

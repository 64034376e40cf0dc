"""Registered queries of calendars, snapping, ledgers, records and streams, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import book, calendar, features, labels, models, selection, stats, strategies
from ..sources import bars as sources
from ..sources.settle import settled, shared_folder
from ..streaming import bars_stream
from ..streaming.ledger_stream import ledger_stream
from . import portfolios as base
from .portfolios import _RECURSIVE, _T, book_sql
from .queries import _RANKED, _TYPE, _bars, _candidates, _market, _rounded, _targets, universe


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.to_date("o_orderdate"))


def q_trading_calendar(spark, sf_dir):
    """Weekdays of two years without the days on which an order of over 480,000 came in."""
    holidays = _orders(spark, sf_dir).where("o_totalprice > 480000").select(F.col("o_orderdate").alias("date")).distinct()
    return calendar.trading_calendar(spark, "1995-01-01", "1996-12-31", holidays)


def q_next_session(spark, sf_dir):
    return calendar.next_session(sources.market_sessions(spark, sf_dir))


def q_snap_dates(spark, sf_dir):
    """Order dates snapped to decisions, forward and backward."""
    days = _market(spark, sf_dir)[1].select(F.col("decision_date").alias("date"))
    asked = _orders(spark, sf_dir).select(F.col("o_orderdate").alias("value")).distinct()
    fore = calendar.snap_date(asked, days, "forward").withColumnRenamed("snapped", "forward")
    return fore.join(calendar.snap_date(asked, days, "backward").withColumnRenamed("snapped", "backward"), "value")


def q_same_day_schedule(spark, sf_dir):
    """Monday decisions at the open, filled at the open of the same day, up to an end date."""
    return calendar.build_schedule(sources.market_sessions(spark, sf_dir), ("monday",), "open", "open", end="1997-06-30")


def q_valid_closes(spark, sf_dir):
    """The last close at or before each decision, whether or not the ticker traded then."""
    b, s = _market(spark, sf_dir)
    return _rounded(book.marks_at(b, s, "close", "decision_date").withColumn("price", F.col("price") + 1e-9), 4)


def q_merged_series(spark, sf_dir):
    """Daily order counts of three priorities side by side."""
    o = _orders(spark, sf_dir)
    part = lambda p: o.where(F.col("o_orderpriority") == p).groupBy(F.col("o_orderdate").alias("date")).agg(F.count("*").alias("value"))
    return features.merge_series({"urgent": part("1-URGENT"), "high": part("2-HIGH"), "low": part("5-LOW")})


def q_boundary_hash(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return sources.boundary_hash(c, "c_custkey")


def q_clean_values(spark, sf_dir):
    """Order totals as values of each priority: of one day's the last order counts."""
    o = _orders(spark, sf_dir)
    values = o.select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).otherwise(0.0).alias("value"), F.col("o_orderkey").alias("seq"))
    return _rounded(stats.clean_values(values), 2)


def q_cash_only(spark, sf_dir):
    """Value of a book without weights beside one in equal parts."""
    b, s = _market(spark, sf_dir)
    c = _candidates(spark, b, s)
    none = strategies.cash_only(c).groupBy().agg(F.count("*").alias("cash_rows"))
    return none.join(strategies.equal_weight(c).groupBy().agg(F.count("*").alias("equal_rows")))


def q_leaver_orders(spark, sf_dir):
    """Sales of what was held one decision before its ticker became eligible."""
    b, s = _market(spark, sf_dir)
    _, positions, _, _ = base._books(spark, sf_dir)
    ok = calendar.eligible_asof(s.where("status = 'kept'"), universe(spark))
    return _rounded(book.leaver_orders(positions, ok).drop("portfolio_id"))


def q_holdings(spark, sf_dir):
    """What each book holds after each fill."""
    snap = book.holdings_snapshot(base._paths(spark, sf_dir))
    return snap.select("portfolio_id", "fill_date", (F.round("cash", 2) + F.lit(0.0)).alias("cash"), F.explode_outer("positions").alias("ticker", "shares")).withColumn("shares", F.round("shares", 6))


def q_decision_log(spark, sf_dir):
    """The log of the books with the decisions that had no fill."""
    _, s = _market(spark, sf_dir)
    paths = settled(base._paths(spark, sf_dir))
    skipped = s.where("status = 'skipped'").select("decision_idx", "decision_date", F.lit("no fill").alias("reason"))
    skipped = skipped.join(F.broadcast(paths.select("portfolio_id").distinct()))  # one row a book
    log = book.decision_log(paths, skipped)
    total = lambda c: F.round(F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)
    return log.select("portfolio_id", "decision_idx", "decision_date", "status", "reason", total("raw_target_weights").alias("raw"), total("target_weights").alias("target"), (F.round("portfolio_value_after", 2) + F.lit(0.0)).alias("value_after"))


def q_rebase(spark, sf_dir):
    """Books that begin in the weights each strategy wanted at decision 100."""
    b, s = _market(spark, sf_dir)
    t = settled(_targets(spark, b, s))
    start = t.where("decision_idx = 100").select(F.col("strategy").alias("portfolio_id"), "ticker", "weight")
    everything = t.withColumn("decision_idx", F.lit(0))  # every ticker gets its marks from the first decision on
    rows = book.fold_rows(everything.select("strategy", "decision_idx", "ticker", "weight").distinct(), s, b, "close", "close").where("weight is null and decision_idx >= 50")
    paths = book.rebase(rows, start)
    return base._booked(paths.where("ticker <> 'cash'").select("portfolio_id", "decision_idx", "ticker", "target_weight", "position", "fill_price", "cash"))


def q_overview(spark, sf_dir):
    return _rounded(selection.overview(base._summary(spark, sf_dir)), 3)


def q_decision_audit(spark, sf_dir):
    """Who takes part in one decision: the choice, the board, the chosen row and the trades."""
    paths = base._paths(spark, sf_dir)
    from ..operators import boards

    ranked = settled(boards.ranked_board(boards.rolling_board(base._facts(spark, sf_dir))))
    audit = selection.decision_audit("1995-06-09", boards.champion_path(ranked), ranked, book.trades_view(paths))
    return audit.groupBy("kind", "strategy").agg(F.count("*").alias("rows"))


def q_hold_book(spark, sf_dir):
    """Buy and hold with a book: shares stay as bought, what leaves the eligible universe is sold, every other decision is a look."""
    b, s = _market(spark, sf_dir)
    c = _candidates(spark, b, s)
    targets = strategies.equal_weight(c).withColumn("strategy", F.lit("buy_and_hold")).select("strategy", "decision_idx", "ticker", "weight")
    kept = s.where("status = 'kept'").select("decision_idx", "decision_date")
    # A ticker leaves three years after its inception; the last one stays.
    tickers = universe(spark).withColumn("until", F.when(F.col("ticker") == "ECONOMY", F.to_date(F.lit("9999-01-01"))).otherwise(F.add_months("inception_date", 36)))
    eligible = kept.join(F.broadcast(tickers), F.col("decision_date") < F.col("until")).select("decision_idx", "ticker")
    rows = book.fold_rows(targets, s, b, "close", "close", holds=targets.select("strategy").distinct(), eligible=eligible)
    t = book.trades_view(book.rebalance_paths(rows, max_weight=1.0, turnover_cap=1.0))
    return base._booked(t.select("portfolio_id", "decision_idx", "ticker", "side", "shares", "fill_price", "cash_flow"))


def q_ml_grid(spark, sf_dir):
    """Ridge forecasts of a grid: training windows, rolling or expanding, and embargoes, every combination a strategy of its own."""
    f, s, ret, _ = base._labelled(spark, sf_dir)
    f, rows = settled(f), settled(f.join(ret.select("decision_idx", "ticker", F.col("ret").alias("label")), ["decision_idx", "ticker"]))
    out = None
    for spec in models.ml_grid("ml_ridge", [252, 756], expanding=True, embargo=[1, 4]):
        w = models.training_windows(s, spec["embargo_intervals"], None if spec["expanding"] else spec["train_window_days"])
        c = models.ridge_walkforward(rows, w, base.NAMES, every=50).select(F.lit(spec["name"]).alias("strategy"), "refit_idx", "rows", *[F.col("coefs")[i].alias(f"c{i}") for i in range(3)])
        out = c if out is None else out.unionByName(c)
    return _rounded(out, 5)


def q_ledger_stream(spark, sf_dir):
    """Line items as a stream of fills: live positions and cash after every fill, by keyed state."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    # Items of one order and line are one fill.
    fills = i.groupBy(F.col("l_suppkey").cast("string").alias("portfolio_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id")).agg(
        F.max(F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("ticker"), F.sum(side * F.col("l_quantity")).alias("shares"), F.sum(-side * F.col("l_extendedprice")).alias("cash_flow")
    )
    at = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    fills.write.parquet(f"{at}/in")
    live = ledger_stream(spark.readStream.schema(fills.schema).parquet(f"{at}/in"), 1e9)
    q = live.writeStream.option("checkpointLocation", f"{at}/cp").option("path", f"{at}/out").format("parquet").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select("portfolio_id", "fill_id", "ticker", "shares", F.round("position", 4).alias("position"), F.round("cash", 2).alias("cash"), "accepted")


def q_kept_event_bars(spark, sf_dir):
    """Daily bars of the events by type, kept from a stream batch by batch with late events merged in."""
    at = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    late = F.pmod(F.col("event_id") * 7919, F.lit(3))
    for k in range(3):  # three deliveries, none in order of time
        e.where(late == k).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    bars_stream.keep_bars(stream, f"{at}/bars", f"{at}/cp").awaitTermination()
    bars_stream.compact_bars(spark, f"{at}/bars")
    return bars_stream.kept_bars(spark, f"{at}/bars").withColumn("start", F.to_date("start"))


QUERIES = {
    "trading_calendar": q_trading_calendar, "next_session": q_next_session, "snap_dates": q_snap_dates, "same_day_schedule": q_same_day_schedule, "valid_closes": q_valid_closes, "merged_series": q_merged_series,
    "boundary_hash": q_boundary_hash, "clean_values": q_clean_values, "cash_only": q_cash_only, "leaver_orders": q_leaver_orders, "holdings": q_holdings, "decision_log": q_decision_log, "rebase": q_rebase,
    "overview": q_overview, "decision_audit": q_decision_audit, "hold_book": q_hold_book, "ml_grid": q_ml_grid, "ledger_stream": q_ledger_stream, "kept_event_bars": q_kept_event_bars,
}

_UNIVERSE = f"u AS (SELECT * FROM (VALUES {', '.join(f'({t!r}, DATE {d!r})' for t, d in base.base.UNIVERSE)}) v(ticker, inception_date))"
_HEAD = "c_custkey:bigint,c_name:string,c_nationkey:int,c_mktsegment:string"


def _grid_sql() -> str:
    """The coefficients of every strategy of the grid, each from its own training sets."""
    parts, ctes = [], []
    for n, spec in enumerate(models.ml_grid("ml_ridge", [252, 756], expanding=True, embargo=[1, 4])):
        sets = base._COEFS[base._COEFS.index("gd AS") :] if n == 0 else base._COEFS[base._COEFS.index("gr AS") :]
        near = "" if spec["expanding"] else f" AND i.decision_date - j.decision_date <= {spec['train_window_days']}"
        ctes.append(f"sets{n} AS (SELECT i.decision_idx AS refit_idx, j.decision_idx FROM iv i JOIN iv j ON j.next_fill IS NOT NULL AND j.decision_idx <= i.decision_idx - {1 + spec['embargo_intervals']} AND j.next_fill < i.decision_date{near})")
        body = sets.replace("since % 5 = 0", "since % 50 = 0").replace("FROM sets JOIN", f"FROM sets{n} JOIN")
        for name in ("gr", "fl", "dt", "co"):
            body = base.re.sub(rf"\b{name}\b", f"{name}{n}", body)
        ctes.append(body)
        parts.append(f"SELECT '{spec['name']}' AS strategy, refit_idx, rows, round(c0, 5) AS c0, round(c1, 5) AS c1, round(c2, 5) AS c2 FROM co{n}")
    start = base._FIT[: base._FIT.index("sets AS")]
    rw = base._FIT[base._FIT.index("rw AS") : base._FIT.index("gd AS")]
    return f"{start}{rw}{', '.join(ctes)} {' UNION ALL '.join(parts)}"


SQL = {
    "trading_calendar": "SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 480000)",
    "next_session": f"WITH {_TYPE} SELECT date, next_date FROM cal",
    "snap_dates": f"WITH {_TYPE}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS value FROM orders) SELECT q.value, a.decision_date AS forward, b.decision_date AS backward FROM q ASOF LEFT JOIN sched a ON q.value <= a.decision_date ASOF LEFT JOIN sched b ON q.value >= b.decision_date",
    "same_day_schedule": f"WITH {_TYPE} SELECT date AS decision_date, date AS fill_date, CASE WHEN date <= DATE '1997-06-30' THEN 'kept' ELSE 'skipped' END AS status, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS decision_idx FROM cal WHERE isodow(date) = 1",
    "valid_closes": f"WITH {_TYPE} SELECT q.decision_idx, q.ticker, round(close + 1e-9, 4) AS price FROM (SELECT s.*, t.ticker FROM sched s, (SELECT DISTINCT ticker FROM bars) t WHERE status = 'kept') q ASOF JOIN bars b ON b.ticker = q.ticker AND q.decision_date >= b.date",
    "merged_series": "SELECT CAST(o_orderdate AS DATE) AS date, nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent, nullif(count(*) FILTER (o_orderpriority = '2-HIGH'), 0) AS high, nullif(count(*) FILTER (o_orderpriority = '5-LOW'), 0) AS low FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1",
    "boundary_hash": f"SELECT md5(concat_ws('|', '{_HEAD}', arg_min(r, c_custkey), arg_max(r, c_custkey))) AS hash FROM (SELECT c_custkey, CAST(to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment}}) AS VARCHAR) AS r FROM customer)",
    "clean_values": "SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 10 <> 0 AND o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1",
    "cash_only": f"{_T} SELECT CAST(0 AS BIGINT) AS cash_rows, count(*) AS equal_rows FROM cand",
    "leaver_orders": f"{base._HELD}, {_UNIVERSE} SELECT decision_idx, ticker, round(-shares, 6) AS shares, 0.0 AS target_weight FROM pos WHERE NOT EXISTS (SELECT 1 FROM sched s JOIN u ON s.decision_date >= u.inception_date WHERE s.status = 'kept' AND s.decision_idx = pos.decision_idx AND u.ticker = pos.ticker)",
    "holdings": f"{_RECURSIVE}, {book_sql('targets')}, h AS (SELECT * FROM paths WHERE position <> 0) SELECT c.p AS portfolio_id, c.fill_date, round(c.cash, 2) + 0.0 AS cash, h.ticker, round(h.position, 6) AS shares FROM paths c LEFT JOIN h ON h.p = c.p AND h.k = c.k WHERE c.ticker = 'cash'",
    "decision_log": f"""{_RECURSIVE}, {book_sql('targets')} SELECT p AS portfolio_id, CAST(k AS INT) AS decision_idx, decision_date, 'executed' AS status, CAST(NULL AS VARCHAR) AS reason, round(coalesce(sum(raw), 0), 5) + 0.0 AS raw, round(coalesce(sum(goal), 0), 5) + 0.0 AS target, round(max(value), 2) + 0.0 AS value_after FROM paths GROUP BY p, k, decision_date
UNION ALL SELECT p, s.decision_idx, s.decision_date, 'skipped', 'no fill', NULL, NULL, NULL FROM sched s, (SELECT DISTINCT p FROM gl) WHERE status = 'skipped'""",
    "rebase": f"""{_RECURSIVE}, st AS (SELECT strategy, 0 AS decision_idx, ticker, weight FROM targets WHERE decision_idx = 100), sch AS (SELECT * FROM sched WHERE decision_idx = 50),
{book_sql('st').replace("FROM sched s, (SELECT DISTINCT", "FROM (SELECT * REPLACE (0 AS decision_idx) FROM sch) s, (SELECT DISTINCT").replace("'cash', 1.0, 1.0 FROM sched WHERE", "'cash', 1.0, 1.0 FROM (SELECT * REPLACE (0 AS decision_idx) FROM sch) WHERE").replace("JOIN sched s ON s.decision_idx = k", "JOIN sch s ON k = 0")}
SELECT p AS portfolio_id, 50 AS decision_idx, ticker, round(goal, 6) + 0.0 AS target_weight, round(position, 6) + 0.0 AS position, round(paid, 4) + 0.0 AS fill_price, round(cash, 2) + 0.0 AS cash FROM paths WHERE ticker <> 'cash'""",
    "overview": f"{base._SUMMARY}, w AS (SELECT strategy, total_return, cagr, max_drawdown_pct, sharpe, volatility, elapsed_days, max_drawdown, final_value, turnover, CAST(periods AS DOUBLE) AS periods, CAST(executed AS DOUBLE) AS executed, CAST(skipped AS DOUBLE) AS skipped, CAST(cost_drag AS DOUBLE) AS cost_drag FROM summary) SELECT strategy, metric, round(value, 3) AS value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE strategy) INTO NAME metric VALUE value)",
    "decision_audit": f"""{base._WALK}, {book_sql('targets')}, day AS (SELECT decision_idx FROM sched WHERE decision_date = DATE '1995-06-09'), ch AS (SELECT selected FROM walk WHERE decision_date = DATE '1995-06-09'), bo AS (SELECT strategy FROM ranked WHERE decision_idx IN (SELECT decision_idx FROM day))
SELECT 'meta' AS kind, selected AS strategy, count(*) AS rows FROM ch GROUP BY ALL UNION ALL SELECT 'leaderboard', strategy, count(*) FROM bo GROUP BY ALL UNION ALL SELECT 'selected', strategy, count(*) FROM bo JOIN ch ON selected = strategy GROUP BY ALL
UNION ALL SELECT 'trade', p, count(*) FROM paths WHERE shares IS NOT NULL AND k IN (SELECT decision_idx FROM day) GROUP BY ALL""",
    "hold_book": f"""{_T}, {_UNIVERSE}, f0 AS (SELECT min(decision_idx) AS k FROM cand), mk AS (SELECT q.decision_idx, q.ticker, q.decision_date, a.close AS price, b.close AS fill FROM (SELECT s.*, t.ticker FROM sched s, (SELECT DISTINCT ticker FROM bars) t WHERE status = 'kept') q
  ASOF JOIN bars a ON a.ticker = q.ticker AND q.decision_date >= a.date ASOF JOIN bars b ON b.ticker = q.ticker AND q.fill_date >= b.date),
fi AS (SELECT m.*, 1.0 / count(*) OVER () AS w FROM mk m JOIN f0 ON m.decision_idx = k JOIN cand c ON c.decision_idx = m.decision_idx AND c.ticker = m.ticker),
bo AS (SELECT decision_idx, ticker, (w * 100000 * 0.99) / price AS shares, fill * (1 + 5.0 / 1e4) AS paid FROM fi),
lv AS (SELECT b.ticker, min(m.decision_idx) AS k FROM bo b JOIN mk m ON m.ticker = b.ticker AND m.decision_idx > b.decision_idx JOIN u ON u.ticker = b.ticker WHERE m.decision_date >= u.inception_date + INTERVAL 36 MONTH AND u.ticker <> 'ECONOMY' GROUP BY b.ticker)
SELECT 'buy_and_hold' AS portfolio_id, decision_idx, ticker, 'buy' AS side, round(shares, 6) AS shares, round(paid, 4) AS fill_price, round(-shares * paid, 2) AS cash_flow FROM bo
UNION ALL SELECT 'buy_and_hold', lv.k, ticker, 'sell', round(-b.shares, 6), round(m.fill * (1 - 5.0 / 1e4), 4), round(b.shares * m.fill * (1 - 5.0 / 1e4), 2) FROM lv JOIN bo b USING (ticker) JOIN mk m ON m.ticker = lv.ticker AND m.decision_idx = lv.k""",
    "ml_grid": _grid_sql(),
    "ledger_stream": """WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS portfolio_id, l_orderkey * 10 + l_linenumber AS fill_id, max(l_linestatus || CAST(l_linenumber AS VARCHAR)) AS ticker, sum(CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END * l_quantity) AS shares, sum(-CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END * l_extendedprice) AS flow FROM lineitem GROUP BY 1, 2)
SELECT portfolio_id, fill_id, ticker, CAST(shares AS DOUBLE) AS shares, round(CAST(sum(shares) OVER (PARTITION BY portfolio_id, ticker ORDER BY fill_id) AS DOUBLE), 4) AS position, round(1e9 + sum(flow) OVER (PARTITION BY portfolio_id ORDER BY fill_id), 2) AS cash, true AS accepted FROM f""",
    "kept_event_bars": "SELECT event_type AS ticker, CAST(ts AS DATE) AS start, arg_min(value, {'t': ts, 'i': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'t': ts, 'i': event_id}) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY ALL",
}

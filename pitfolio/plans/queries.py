"""Registered queries over the test tables, each with the same query as DuckDB SQL.

Computed doubles are rounded on both sides: sums of partitions arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, calendar, coverage, evaluation, features, labels, ledger, stats, strategies
from ..sources import bars as sources

#: The universe of the test market: part types with an inception date of their own.
UNIVERSE = [("PROMO", "1995-01-01"), ("STANDARD", "1995-06-01"), ("SMALL", "1996-01-01"), ("MEDIUM", "1996-06-01"), ("LARGE", "1997-01-01"), ("ECONOMY", "1997-06-01")]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _bars(spark, sf_dir, key="p_type"):
    return sources.market(spark, sf_dir, key)


def _schedule(bars):
    return calendar.build_schedule(calendar.sessions(bars))


def _market(spark, sf_dir):
    """Bars and schedule of the part types; the schedule needs the dates alone."""
    return _bars(spark, sf_dir), calendar.build_schedule(sources.market_sessions(spark, sf_dir))


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, d, i) for i, (t, d) in enumerate(UNIVERSE)], "ticker string, inception_date string, universe_order int").withColumn("inception_date", F.to_date("inception_date"))


def _candidates(spark, bars, schedule):
    """Kept decisions and tickers with a bar on the decision date, in name order."""
    kept = schedule.where("status = 'kept'").select("decision_idx", "decision_date")
    p = features.prepared(bars)
    slow = features.moving_average(100)
    feats = p.select("ticker", F.col("date").alias("decision_date"), features.ret(63).alias("momentum"), features.vol(20).alias("vol_20"), "close", F.when(slow.isNotNull(), features.moving_average(20)).alias("fast_ma"), slow.alias("slow_ma"))
    return kept.join(feats, "decision_date").withColumn("universe_order", F.col("ticker"))


def q_bars(spark, sf_dir):
    # a nudge off exact halves, which the two engines round differently
    return _rounded(_bars(spark, sf_dir).select("ticker", "date", *[(F.col(c) + 1e-9).alias(c) for c in sources.FIELDS]), 4)


def q_schedule(spark, sf_dir):
    return _schedule(_bars(spark, sf_dir, "p_brand"))


def q_eligible(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    return calendar.eligible_asof(s.where("status = 'kept'"), universe(spark)).select("decision_idx", "decision_date", "ticker", "inception_date")


def q_coverage(spark, sf_dir):
    b = _bars(spark, sf_dir, "p_brand")
    return coverage.ticker_coverage(b, calendar.sessions(b)).select("ticker", "first_date", "last_date", "observations", "gap_count")


def q_bounds(spark, sf_dir):
    b = _bars(spark, sf_dir, "p_brand")
    return coverage.coverage_bounds(b, "common", minimum_observations=64)


def q_base_features(spark, sf_dir):
    return _rounded(features.base_features(_bars(spark, sf_dir)))


def q_expanded_features(spark, sf_dir):
    out = features.expanded_features(_bars(spark, sf_dir))
    return _rounded(out.select("ticker", "date", *features.EXPANDED))


def q_moving_averages(spark, sf_dir):
    return _rounded(features.moving_averages(_bars(spark, sf_dir)).select("ticker", "date", "fast_ma", "slow_ma"), 4)


def q_market_regime(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return _rounded(features.market_regime(b))


def q_interval_returns(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    return _rounded(labels.interval_return(s, b, "close"))


def q_interval_vol(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    return _rounded(labels.interval_vol(s, b).where("vol is not null"))


def q_customer_asof(spark, sf_dir):
    """Each late line item's order with the last order total of its customer before the ship date."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = o.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 30).alias("at"))
    right = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("last_total"))
    return _rounded(calendar.asof_join(left, right, ["k"], "at", "d", "last_total", 0.0), 2)


def _targets(spark, b, schedule):
    return strategies.rule_based(_candidates(spark, b, schedule))


def q_strategy_weights(spark, sf_dir):
    b, s = _market(spark, sf_dir)
    return _rounded(_targets(spark, b, s).select("strategy", "decision_idx", "ticker", "weight"))


def _paths(spark, sf_dir, cost_bps=5.0):
    b, s = _market(spark, sf_dir)
    return ledger.weight_path_returns(_targets(spark, b, s), labels.interval_return(s, b, "close"), cost_bps, labels.intervals_of(s).where("next_fill is not null"))


def q_weight_paths(spark, sf_dir):
    return _rounded(_paths(spark, sf_dir).select("strategy", "decision_idx", "gross", "turnover", "net"))


def q_performance(spark, sf_dir):
    v = _paths(spark, sf_dir).select("strategy", F.col("decision_date").alias("date"), "value")
    return _rounded(stats.performance_metrics(v), 4)


def _intervals(spark, sf_dir):
    """Interval facts with the regime of the first ticker on the decision date."""
    b = _bars(spark, sf_dir)
    regime = features.market_regime(b).select(F.col("date").alias("decision_date"), "market_regime")
    return _paths(spark, sf_dir).join(regime, "decision_date", "left").na.fill("UNKNOWN", ["market_regime"])


def q_rolling_board(spark, sf_dir):
    return _rounded(boards.rolling_board(_intervals(spark, sf_dir)))


def q_ranked_board(spark, sf_dir):
    ranked = boards.ranked_board(boards.rolling_board(_intervals(spark, sf_dir)))
    return _rounded(ranked.select("decision_idx", "strategy", "eligible", "global_percentile", "regime_percentile", "score", "rank"))


def q_champion_path(spark, sf_dir):
    ranked = boards.ranked_board(boards.rolling_board(_intervals(spark, sf_dir)))
    return _rounded(boards.champion_path(ranked, "equal_weight"))


def q_regime_leaderboard(spark, sf_dir):
    return _rounded(stats.regime_leaderboard(_intervals(spark, sf_dir)))


def _forecasts(spark, sf_dir):
    """Momentum a session as forecast of the next interval's return."""
    b, s = _market(spark, sf_dir)
    c = _candidates(spark, b, s).select("decision_idx", "ticker", F.round(F.col("momentum") / 63, 9).alias("predicted"))
    actual = labels.interval_return(s, b, "close").select("decision_idx", F.col("decision_date").alias("date"), "ticker", F.round("ret", 9).alias("actual"))
    return actual.join(c, ["decision_idx", "ticker"]).where("predicted is not null").select(F.lit("momentum").alias("model"), "date", "ticker", "predicted", "actual")


def q_forecast_errors(spark, sf_dir):
    return _rounded(evaluation.forecast_errors(evaluation.chrono_split(evaluation.naive_forecasts(_forecasts(spark, sf_dir)))))


def q_rank_quality(spark, sf_dir):
    return _rounded(evaluation.rank_quality(evaluation.naive_forecasts(_forecasts(spark, sf_dir))))


QUERIES = {
    "bars": q_bars,
    "schedule": q_schedule,
    "eligible": q_eligible,
    "coverage": q_coverage,
    "coverage_bounds": q_bounds,
    "base_features": q_base_features,
    "expanded_features": q_expanded_features,
    "moving_averages": q_moving_averages,
    "market_regime": q_market_regime,
    "interval_returns": q_interval_returns,
    "interval_vol": q_interval_vol,
    "asof_join": q_customer_asof,
    "strategy_weights": q_strategy_weights,
    "weight_paths": q_weight_paths,
    "performance": q_performance,
    "rolling_board": q_rolling_board,
    "ranked_board": q_ranked_board,
    "champion_path": q_champion_path,
    "regime_leaderboard": q_regime_leaderboard,
    "forecast_errors": q_forecast_errors,
    "rank_quality": q_rank_quality,
}


# DuckDB SQL, built from the same named steps.
def _cte(key: str) -> str:
    return f"""
t AS (SELECT {key} AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS p, l_quantity AS q
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
raw AS (SELECT ticker, date, first(p ORDER BY l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low, sum(q) AS volume, sum(p * q) AS notional FROM t GROUP BY ticker, date),
bars AS (SELECT ticker, date, open, high, low, volume,
      sum(notional) OVER w / sum(volume) OVER w AS close FROM raw WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)),
cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date, row_number() OVER (ORDER BY date) AS place FROM (SELECT DISTINCT date FROM bars)),
dec AS (SELECT date AS decision_date, next_date AS fill_date FROM cal WHERE isodow(date) IN (3, 5)),
sched AS (SELECT decision_date, fill_date, CASE WHEN max(CASE WHEN fill_date IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY decision_date) = 0 THEN 'kept' ELSE 'skipped' END AS status,
      CAST(row_number() OVER (ORDER BY decision_date) - 1 AS INT) AS decision_idx FROM dec),
iv AS (SELECT decision_idx, decision_date, fill_date, lead(fill_date) OVER (ORDER BY decision_idx) AS next_fill FROM sched WHERE status = 'kept'),
ret AS (SELECT decision_idx, decision_date, a.ticker, b.close / a.close - 1 AS ret FROM iv JOIN bars a ON a.date = fill_date JOIN bars b ON b.date = next_fill AND b.ticker = a.ticker),
px AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS d1, close / lag(close) OVER w - 1 AS r1 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


_F = "PARTITION BY ticker ORDER BY date"


def _frame(n: int) -> str:
    return f"({_F} ROWS {n - 1} PRECEDING)"


def _ret(n: int) -> str:
    return f"close / lag(close, {n}) OVER ({_F}) - 1 AS ret_{n}"


def _vol(n: int) -> str:
    return f"CASE WHEN count(r1) OVER {_frame(n)} = {n} THEN stddev_samp(r1) OVER {_frame(n)} END AS vol_{n}"


def _ma(n: int) -> str:
    return f"close / avg(close) OVER {_frame(n)} AS ma_ratio_{n}"


def _rsi(n: int) -> str:
    g, m = f"avg(greatest(d1, 0)) OVER {_frame(n)}", f"avg(greatest(-d1, 0)) OVER {_frame(n)}"
    return f"CASE WHEN count(d1) OVER {_frame(n)} = {n} THEN CASE WHEN {m} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {g} / {m}) END END AS rsi_{n}"


_BASE = ", ".join([_ret(5), _ret(10), _ret(21), _ret(63), _vol(21), _vol(63), f"close / max(close) OVER {_frame(63)} - 1 AS drawdown_63", _ma(21), _ma(63), f"avg(high - low) OVER {_frame(21)} / close AS atr_21", f"CASE WHEN stddev_samp(volume) OVER {_frame(63)} = 0 THEN 0 ELSE (volume - avg(volume) OVER {_frame(63)}) / stddev_samp(volume) OVER {_frame(63)} END AS volume_z_63"])
_MORE = ", ".join([_ret(126), _vol(126), _ma(126), _rsi(14), _rsi(63), f"regr_slope(ln(close), rn) OVER {_frame(63)} AS trend_slope_63"])
_BASE_NAMES = ["ret_5", "ret_10", "ret_21", "ret_63", "vol_21", "vol_63", "drawdown_63", "ma_ratio_21", "ma_ratio_63", "atr_21", "volume_z_63"]
_MORE_NAMES = ["ret_126", "vol_126", "ma_ratio_126", "rsi_14", "rsi_63", "trend_slope_63"]


def _round(names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_TYPE, _BRAND = _cte("p_type"), _cte("p_brand")
_TARGETS = f"""
cand AS (SELECT s.decision_idx, s.decision_date, f.* FROM (SELECT * FROM sched WHERE status = 'kept') s JOIN (
  SELECT ticker, date, close / lag(close, 63) OVER ({_F}) - 1 AS momentum, {_vol(20)},
    avg(close) OVER {_frame(20)} AS fast_ma, avg(close) OVER {_frame(100)} AS slow_ma, count(close) OVER {_frame(100)} AS n_slow FROM px) f ON f.date = s.decision_date),
xs AS (SELECT *, row_number() OVER (PARTITION BY decision_idx ORDER BY momentum DESC, ticker) AS k, max(momentum) OVER (PARTITION BY decision_idx) AS lead FROM cand WHERE momentum IS NOT NULL),
picked AS (
  SELECT 'equal_weight' AS strategy, decision_idx, decision_date, ticker, 1.0 AS raw FROM cand
  UNION ALL SELECT 'inverse_volatility', decision_idx, decision_date, ticker, 1 / greatest(vol_20, 1e-6) FROM cand WHERE vol_20 IS NOT NULL
  UNION ALL SELECT 'ts_momentum', decision_idx, decision_date, ticker, 1.0 FROM cand WHERE momentum > 0
  UNION ALL SELECT 'xs_momentum', decision_idx, decision_date, ticker, 1.0 FROM xs WHERE lead > 0 AND k <= 3
  UNION ALL SELECT 'ma_crossover', decision_idx, decision_date, ticker, 1.0 FROM cand WHERE n_slow = 100 AND fast_ma > slow_ma),
targets AS (SELECT strategy, decision_idx, decision_date, ticker, raw / sum(raw) OVER (PARTITION BY strategy, decision_idx) AS weight FROM picked)"""
_PATHS = """
days AS (SELECT decision_idx, decision_date FROM iv WHERE next_fill IS NOT NULL),
held AS (SELECT g.*, r.ret FROM targets g JOIN ret r USING (decision_idx, ticker)),
gross AS (SELECT strategy, decision_idx, sum(weight * ret) AS gross FROM held GROUP BY ALL),
path0 AS (SELECT strategy, decision_idx, d.decision_date, coalesce(gross, 0) AS gross, lead(decision_idx) OVER (PARTITION BY strategy ORDER BY decision_idx) AS next_idx
  FROM days d CROSS JOIN (SELECT DISTINCT strategy FROM targets) s LEFT JOIN gross USING (strategy, decision_idx)),
old AS (SELECT h.strategy, next_idx AS decision_idx, ticker, weight * (1 + ret) / (1 + p.gross) AS old FROM held h JOIN path0 p USING (strategy, decision_idx) WHERE next_idx IS NOT NULL),
moved AS (SELECT strategy, decision_idx, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS a, sum(coalesce(weight, 0) - coalesce(old, 0)) AS c
  FROM (SELECT strategy, decision_idx, ticker, weight FROM targets) g FULL JOIN old USING (strategy, decision_idx, ticker) GROUP BY ALL),
path AS (SELECT strategy, decision_idx, decision_date, gross, coalesce(0.5 * (a + abs(c)), 0) AS turnover, gross - coalesce(0.5 * (a + abs(c)), 0) * 5.0 / 1e4 AS net FROM path0 LEFT JOIN moved USING (strategy, decision_idx)),
valued AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy ORDER BY decision_idx)) AS value FROM path)"""

SQL = {
    "bars": f"WITH {_TYPE} SELECT ticker, date, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars",
    "schedule": f"WITH {_BRAND} SELECT decision_date, fill_date, status, decision_idx FROM sched",
    "eligible": f"WITH {_TYPE}, u AS (SELECT * FROM (VALUES {', '.join(f"('{t}', DATE '{d}')" for t, d in UNIVERSE)}) v(ticker, inception_date)) SELECT decision_idx, decision_date, ticker, inception_date FROM sched JOIN u ON decision_date >= inception_date WHERE status = 'kept'",
    "coverage": f"WITH {_BRAND} SELECT ticker, min(b.date) AS first_date, max(b.date) AS last_date, count(DISTINCT b.date) AS observations, max(place) - min(place) + 1 - count(DISTINCT b.date) AS gap_count FROM bars b JOIN cal USING (date) WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 GROUP BY ticker",
    "coverage_bounds": f"WITH {_BRAND}, s AS (SELECT ticker, min(CASE WHEN k = 64 THEN date END) AS a, max(date) AS z FROM (SELECT ticker, date, row_number() OVER ({_F}) AS k FROM bars) GROUP BY ticker), b AS (SELECT CASE WHEN count(a) = count(*) THEN max(a) END AS a, min(z) AS z FROM s) SELECT CASE WHEN a <= z THEN a END AS usable_start, CASE WHEN a <= z THEN z END AS usable_end FROM b",
    "base_features": f"WITH {_TYPE}, f AS (SELECT ticker, date, rn, {_BASE} FROM px) SELECT ticker, date, {_round(_BASE_NAMES)} FROM f WHERE rn >= 65",
    "expanded_features": f"WITH {_TYPE}, f AS (SELECT ticker, date, rn, {_MORE} FROM px) SELECT ticker, date, {_round(_MORE_NAMES)} FROM f WHERE rn >= 127",
    "moving_averages": f"WITH {_TYPE}, f AS (SELECT ticker, date, avg(close) OVER {_frame(20)} AS fast_ma, avg(close) OVER {_frame(100)} AS slow_ma, count(close) OVER {_frame(100)} AS n FROM bars) SELECT ticker, date, {_round(['fast_ma', 'slow_ma'], 4)} FROM f WHERE n = 100",
    "market_regime": f"""WITH {_TYPE}, o AS (SELECT * FROM px WHERE ticker = (SELECT min(ticker) FROM px)),
f AS (SELECT a.date, a.rn, close / lag(close, 63) OVER ({_F}) - 1 AS return_63, CASE WHEN count(r1) OVER {_frame(21)} = 21 THEN stddev_samp(r1) OVER {_frame(21)} END * sqrt(252) AS annual_vol_21 FROM o a),
m AS (SELECT y.rn AS yr, x.rn AS xr, x.close / max(z.close) - 1 AS dd FROM o y JOIN o x ON x.rn BETWEEN y.rn - 62 AND y.rn JOIN o z ON z.rn BETWEEN y.rn - 62 AND x.rn GROUP BY y.rn, x.rn, x.close),
g AS (SELECT yr AS rn, min(dd) AS drawdown_63 FROM m GROUP BY yr)
SELECT date, {_round(['return_63', 'annual_vol_21', 'drawdown_63'])}, CASE WHEN rn < 64 THEN 'UNKNOWN' ELSE (CASE WHEN return_63 > 0.03 THEN 'UP' WHEN return_63 < -0.03 THEN 'DOWN' ELSE 'SIDE' END) || '_' || (CASE WHEN annual_vol_21 < 0.18 THEN 'LOWVOL' ELSE 'HIGHVOL' END) || (CASE WHEN drawdown_63 <= -0.12 THEN '_STRESS' ELSE '' END) END AS market_regime FROM f JOIN g USING (rn)""",
    "interval_returns": f"WITH {_TYPE} SELECT decision_idx, decision_date, ticker, round(ret, 6) AS ret FROM ret",
    "interval_vol": f"WITH {_TYPE}, st AS (SELECT decision_idx, decision_date, ticker, pow(ln(close) - lag(ln(close)) OVER (PARTITION BY decision_idx, ticker ORDER BY date), 2) AS sq FROM iv JOIN bars ON date BETWEEN fill_date AND next_fill) SELECT decision_idx, decision_date, ticker, round(sqrt(sum(sq)), 6) AS vol FROM st GROUP BY ALL HAVING sum(sq) IS NOT NULL",
    "asof_join": "WITH l AS (SELECT o_orderkey AS orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) + 30 AS at_ FROM orders), r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS last_total FROM orders GROUP BY ALL) SELECT l.orderkey, l.k, l.at_ AS \"at\", round(coalesce(r.last_total, 0), 2) AS last_total FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.at_ >= r.d",
    "strategy_weights": f"WITH {_TYPE}, {_TARGETS} SELECT strategy, decision_idx, ticker, round(weight, 6) AS weight FROM targets",
    "weight_paths": f"WITH {_TYPE}, {_TARGETS}, {_PATHS} SELECT strategy, decision_idx, {_round(['gross', 'turnover', 'net'])} FROM path",
    "performance": f"""WITH {_TYPE}, {_TARGETS}, {_PATHS},
v AS (SELECT strategy, decision_date AS date, value, ln(value / lag(value) OVER w) AS r, CAST(decision_date - lag(decision_date) OVER w AS DOUBLE) AS days, max(value) OVER w AS peak FROM valued WINDOW w AS (PARTITION BY strategy ORDER BY decision_date)),
m AS (SELECT strategy, sum(r) / sum(days) AS mu FROM v GROUP BY strategy),
s AS (SELECT strategy, arg_min(value, date) AS i, arg_max(value, date) AS f, sum(days) AS n, min(value / peak - 1) AS dd, sum(pow(r - mu * days, 2)) / sum(days) AS var, any_value(mu) AS mu FROM v JOIN m USING (strategy) GROUP BY strategy)
SELECT strategy, round((f / i - 1) * 100, 4) AS total_return, round((pow(f / i, 365.25 / n) - 1) * 100, 4) AS cagr, round(mu * 365.25 / sqrt(var * 365.25), 4) AS sharpe, round(sqrt(var * 365.25), 4) AS volatility, round(dd * 100, 4) AS max_drawdown, round(n, 4) AS elapsed_days FROM s""",
}

_BY = "PARTITION BY strategy ORDER BY decision_idx"
_FACTS = f"""WITH {_TYPE}, {_TARGETS}, {_PATHS}, one AS MATERIALIZED (SELECT * FROM px WHERE ticker = (SELECT min(ticker) FROM bars)),
seen AS (SELECT date, rn, close / lag(close, 63) OVER ({_F}) - 1 AS up, CASE WHEN count(r1) OVER {_frame(21)} = 21 THEN stddev_samp(r1) OVER {_frame(21)} END * sqrt(252) AS shaky, list(close) OVER {_frame(63)} AS l FROM one),
deep AS (SELECT *, list_min(list_transform(range(1, len(l) + 1), lambda i: l[i] / list_max(l[1:i]) - 1)) AS low FROM seen),
regimes AS MATERIALIZED (SELECT date, CASE WHEN rn < 64 THEN 'UNKNOWN' ELSE (CASE WHEN up > 0.03 THEN 'UP' WHEN up < -0.03 THEN 'DOWN' ELSE 'SIDE' END) || '_' || (CASE WHEN shaky < 0.18 THEN 'LOWVOL' ELSE 'HIGHVOL' END) || (CASE WHEN low <= -0.12 THEN '_STRESS' ELSE '' END) END AS market_regime FROM deep),
facts AS (SELECT v.*, coalesce(market_regime, 'UNKNOWN') AS market_regime FROM valued v LEFT JOIN regimes ON date = decision_date)"""
_BOARD = f"""{_FACTS},
b0 AS (SELECT *, coalesce(lag(value) OVER ({_BY}), 1.0) AS start FROM facts),
b1 AS (SELECT *, ln(start / lag(start) OVER ({_BY})) AS r, CAST(decision_date - lag(decision_date) OVER ({_BY}) AS DOUBLE) AS d FROM b0),
b2 AS (SELECT *, count(r) OVER w AS n, sum(r) OVER w / sum(d) OVER w AS mu, sum(d) OVER w AS days, list(r) OVER w AS rs, list(d) OVER w AS ds,
  list(start) OVER ({_BY} ROWS 20 PRECEDING) AS lv, avg(turnover) OVER ({_BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mt,
  count(net) OVER p AS regime_count, avg(net) OVER p AS rm FROM b1
  WINDOW w AS ({_BY} ROWS 19 PRECEDING), p AS (PARTITION BY strategy, market_regime ORDER BY decision_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b3 AS (SELECT *, list_sum(list_transform(range(1, len(rs) + 1), lambda i: pow(rs[i] - mu * ds[i], 2))) / days AS var,
  list_min(list_transform(range(1, len(lv) + 1), lambda i: lv[i] / list_max(lv[1:i]) - 1)) AS dd FROM b2),
board AS (SELECT strategy, decision_idx, decision_date, round(CASE WHEN n >= 2 THEN CASE WHEN var > 0 THEN mu * 365.25 / sqrt(var * 365.25) ELSE 0 END END, 9) AS sharpe,
  round(CASE WHEN n > 0 THEN dd END, 9) AS drawdown, round(mt, 9) AS turnover, round(CASE WHEN regime_count >= 4 THEN rm END, 9) AS regime_score, regime_count FROM b3)"""
_RANKED = f"""{_BOARD},
k0 AS (SELECT *, coalesce(sharpe IS NOT NULL AND drawdown >= -0.2 AND turnover <= 1.0, false) AS eligible FROM board),
k1 AS (SELECT *, CASE WHEN eligible THEN sharpe END AS g, CASE WHEN eligible THEN regime_score END AS rg FROM k0),
k2 AS (SELECT *, count(g) OVER w AS ng, count(rg) OVER w AS nr,
  rank() OVER (PARTITION BY decision_idx ORDER BY g NULLS LAST) + (count(*) OVER (PARTITION BY decision_idx, g) - 1) / 2.0 AS kg,
  rank() OVER (PARTITION BY decision_idx ORDER BY rg NULLS LAST) + (count(*) OVER (PARTITION BY decision_idx, rg) - 1) / 2.0 AS kr FROM k1 WINDOW w AS (PARTITION BY decision_idx)),
k3 AS (SELECT *, CASE WHEN g IS NOT NULL THEN CASE WHEN ng = 1 THEN 1.0 ELSE CAST(kg - 1 AS DOUBLE) / (ng - 1) END END AS global_percentile,
  CASE WHEN rg IS NOT NULL THEN CASE WHEN nr = 1 THEN 1.0 ELSE CAST(kr - 1 AS DOUBLE) / (nr - 1) END END AS regime_percentile FROM k2),
k4 AS (SELECT *, round(CASE WHEN regime_percentile IS NOT NULL THEN CAST(0.6 AS DOUBLE) * global_percentile + CAST(0.4 AS DOUBLE) * regime_percentile ELSE global_percentile END, 9) AS score FROM k3),
ranked AS (SELECT *, CASE WHEN eligible THEN CAST(row_number() OVER (PARTITION BY decision_idx, eligible ORDER BY score DESC, drawdown DESC, turnover, strategy) AS INT) END AS rank FROM k4)"""
_FORECASTS = f"""WITH {_TYPE}, {_TARGETS},
f0 AS (SELECT r.decision_date AS date, r.ticker, round(c.momentum / 63, 9) AS predicted, round(r.ret, 9) AS actual FROM ret r JOIN cand c USING (decision_idx, ticker) WHERE c.momentum IS NOT NULL),
fc AS (SELECT 'momentum' AS model, * FROM f0 UNION ALL SELECT 'momentum:zero', date, ticker, 0.0, actual FROM f0
  UNION ALL SELECT 'momentum:persistence', * FROM (SELECT date, ticker, lag(actual) OVER (PARTITION BY ticker ORDER BY date) AS predicted, actual FROM f0) WHERE predicted IS NOT NULL)"""
SQL |= {
    "rolling_board": f"{_BOARD} SELECT strategy, decision_idx, decision_date, {_round(['sharpe', 'drawdown', 'turnover', 'regime_score'])}, regime_count FROM board",
    "ranked_board": f"{_RANKED} SELECT decision_idx, strategy, eligible, {_round(['global_percentile', 'regime_percentile', 'score'])}, rank FROM ranked",
    "champion_path": _RANKED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
days_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY decision_idx) AS k, decision_idx, any_value(decision_date) AS decision_date, max(CASE WHEN rank = 1 THEN strategy END) AS challenger, map_from_entries(list({'k': strategy, 'v': score}) FILTER (eligible)) AS scores FROM ranked GROUP BY decision_idx),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, -1 AS decision_idx, CAST(NULL AS DATE) AS decision_date, CAST(NULL AS VARCHAR) AS selected, CAST(NULL AS VARCHAR) AS challenger, CAST(NULL AS VARCHAR) AS switch_reason, CAST(NULL AS DOUBLE) AS score_margin, false AS switched
  UNION ALL
  SELECT k, decision_idx, decision_date, selected, challenger, reason, CASE WHEN reason IN ('challenger_exceeded_margin', 'challenger_below_margin') THEN lead_ END, coalesce(decision_idx >= 4 AND held <> selected, false) FROM (
    SELECT *, CASE WHEN reason IN ('initialization_baseline', 'no_eligible_candidate') THEN 'equal_weight' WHEN reason IN ('incumbent_ineligible', 'challenger_exceeded_margin') THEN challenger ELSE coalesce(held, 'equal_weight') END AS selected FROM (
      SELECT *, CASE WHEN decision_idx < 4 THEN 'initialization_baseline' WHEN dayofweek(decision_date) <> 5 THEN 'incumbent_held_until_selection_day' WHEN challenger IS NULL THEN 'no_eligible_candidate'
        WHEN own IS NULL THEN 'incumbent_ineligible' WHEN held = challenger THEN 'incumbent_ranked_first' WHEN lead_ >= 0.1 THEN 'challenger_exceeded_margin' ELSE 'challenger_below_margin' END AS reason FROM (
        SELECT d.*, w.selected AS held, d.scores[w.selected] AS own, d.scores[d.challenger] - d.scores[w.selected] AS lead_ FROM walk w JOIN days_ d ON d.k = w.k + 1))))
SELECT decision_idx, decision_date, selected, challenger, switch_reason, round(score_margin, 6) AS score_margin, switched FROM walk WHERE k > 0""",
    "regime_leaderboard": f"""{_FACTS}, c AS (SELECT *, exp(sum(ln(1 + gross)) OVER (PARTITION BY market_regime, strategy ORDER BY decision_idx)) AS level FROM facts),
p AS (SELECT *, greatest(max(level) OVER (PARTITION BY market_regime, strategy ORDER BY decision_idx), 1.0) AS peak FROM c)
SELECT market_regime, strategy, count(*) AS intervals, round(avg(CAST(gross > 0 AS INT)), 6) AS win_rate, round(avg(turnover), 6) AS mean_turnover, round(min(least(level / peak - 1, 0.0)), 6) AS max_drawdown, 0.0 AS sharpe, 0.0 AS cagr FROM p GROUP BY ALL""",
    "forecast_errors": f"""{_FORECASTS}, dk AS (SELECT model, date, row_number() OVER (PARTITION BY model ORDER BY date) AS k, count(*) OVER (PARTITION BY model) AS n FROM (SELECT DISTINCT model, date FROM fc)),
dc AS (SELECT *, greatest(1, floor(n * CAST(0.6 AS DOUBLE))) AS a, floor(n * CAST(0.8 AS DOUBLE)) AS b FROM dk),
sp AS (SELECT fc.*, CASE WHEN k <= a THEN 'train' WHEN k <= greatest(a + 1, b) THEN 'validation' ELSE 'holdout' END AS split FROM fc JOIN dc USING (model, date))
SELECT model, split, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse, round(avg(CAST((predicted >= 0) = (actual >= 0) AS INT)), 6) AS hit
FROM (SELECT * FROM sp UNION ALL SELECT * REPLACE ('all' AS split) FROM sp) GROUP BY ALL""",
    "rank_quality": f"""{_FORECASTS}, rk AS (SELECT *, rank() OVER (PARTITION BY model, date ORDER BY predicted) + (count(*) OVER (PARTITION BY model, date, predicted) - 1) / 2.0 AS p,
  rank() OVER (PARTITION BY model, date ORDER BY actual) + (count(*) OVER (PARTITION BY model, date, actual) - 1) / 2.0 AS a,
  row_number() OVER (PARTITION BY model, date ORDER BY predicted DESC, ticker) AS kp, row_number() OVER (PARTITION BY model, date ORDER BY actual DESC, ticker) AS ka FROM fc),
dy AS (SELECT model, date, CASE WHEN count(*) >= 2 AND min(p) < max(p) AND min(a) < max(a) THEN corr(p, a) END AS ic, max(CAST(kp = 1 AND ka = 1 AS INT)) AS hit FROM rk GROUP BY ALL)
SELECT model, round(avg(ic), 6) AS mean_rank_ic, round(avg(hit), 6) AS top_hit_rate, count(*) AS dates FROM dy GROUP BY model""",
}

"""Summaries of strategies, the choice among them, the meta portfolio and its timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import performance_metrics


def value_drawdown(values: DataFrame, by: str = "strategy") -> DataFrame:
    """by, max_drawdown: least of value / running maximum - 1; null for fewer than two values."""
    w = Window.partitionBy(by).orderBy("date")
    v = values.withColumn("_d", F.col("value") / F.max("value").over(w) - 1)
    return v.groupBy(by).agg(F.when(F.count("*") >= 2, F.min("_d")).alias("max_drawdown"))


def decision_counts(log: DataFrame, by: str = "strategy") -> DataFrame:
    """by, executed, skipped from a log with a status."""
    return log.groupBy(by).agg(F.count_if(F.col("status") != "skipped").alias("executed"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def portfolio_summary(values: DataFrame, intervals: DataFrame, log: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row a strategy: performance, drawdown as a fraction, mean turnover, periods, decisions and cost drag.

    values: strategy, date, value. intervals: strategy, turnover, gross (null: no interval yet).
    log: strategy, status. costs: strategy, cost_drag.
    """
    m = performance_metrics(values).withColumnRenamed("max_drawdown", "max_drawdown_pct").join(value_drawdown(values), "strategy")
    last = values.groupBy("strategy").agg(F.max_by("value", "date").alias("final_value"))
    t = intervals.groupBy("strategy").agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"), F.count("gross").alias("periods"))
    out = m.join(last, "strategy").join(t, "strategy").join(decision_counts(log), "strategy")
    out = out.join(costs, "strategy", "left") if costs is not None else out.withColumn("cost_drag", F.lit(0.0))
    return out.na.fill(0.0, ["max_drawdown", "cost_drag"])


def best_overall(summary: DataFrame, dd_limit: float = -0.2, turnover_limit: float = 1.0, min_periods: int = 4, k: int = 3) -> DataFrame:
    """The k best strategies with place and eligible; all compete if none passes the gate."""
    gate = F.coalesce((F.col("periods") >= min_periods) & (F.col("max_drawdown") >= dd_limit) & (F.col("turnover") <= turnover_limit), F.lit(False))
    s = summary.withColumn("eligible", gate).withColumn("_any", F.max("eligible").over(Window.partitionBy()))  # one row a strategy
    order = Window.orderBy(F.desc_nulls_last("sharpe"), F.desc_nulls_last("cagr"), F.desc_nulls_last("max_drawdown"), F.asc_nulls_last("turnover"), "strategy")
    return s.where("eligible or not _any").drop("_any").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def best_per_regime(board: DataFrame, dd_limit: float = -0.2, turnover_limit: float = 1.0, min_periods: int = 4) -> DataFrame:
    """board (market_regime, strategy, intervals, sharpe, cagr, max_drawdown, mean_turnover) with best_strategy of the regime."""
    gate = F.coalesce((F.col("intervals") >= min_periods) & (F.col("max_drawdown") >= dd_limit) & (F.col("mean_turnover") <= turnover_limit), F.lit(False))
    order = Window.partitionBy("market_regime").orderBy(gate.desc(), F.desc_nulls_last("sharpe"), F.desc_nulls_last("cagr"), F.desc_nulls_last("max_drawdown"), F.asc_nulls_last("mean_turnover"), "strategy")
    return board.withColumn("best_strategy", F.first("strategy").over(order))


def reliability_report(rolling: DataFrame, ranked: DataFrame, cash: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """One row a strategy: spread of its rolling Sharpe ratio, worst drawdown, turnover, cash, cost drag, times ranked first.

    ``most_reliable`` marks the strategy most often first, then of least deviation (none or 0
    comes last), then first by name.
    """
    r = rolling.groupBy("strategy").agg(
        F.avg("sharpe").alias("sharpe_mean"), F.stddev_samp("sharpe").alias("sharpe_std"), F.min("sharpe").alias("sharpe_min"), F.max("sharpe").alias("sharpe_max"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover_mean"), F.max("turnover").alias("turnover_max"),
    )
    first = ranked.where("rank = 1").groupBy("strategy").agg(F.count("*").alias("top_rank_count"))
    out = r.join(first, "strategy", "left").na.fill(0, ["top_rank_count"])
    out = out.join(cash.groupBy("strategy").agg(F.avg("cash_pct").alias("cash_pct")), "strategy", "left") if cash is not None else out.withColumn("cash_pct", F.lit(None).cast("double"))
    out = out.join(costs, "strategy", "left").na.fill(0.0, ["cost_drag"]) if costs is not None else out.withColumn("cost_drag", F.lit(0.0))
    order = Window.orderBy(F.desc("top_rank_count"), F.asc_nulls_last(F.when(F.col("sharpe_std") > 0, F.col("sharpe_std"))), "strategy")
    return out.withColumn("most_reliable", F.row_number().over(order) == 1)


def meta_targets(path: DataFrame, targets: DataFrame) -> DataFrame:
    """strategy ``meta`` with the champion's weights at each decision; a champion without rows is all cash."""
    t = targets.select(F.col("strategy").alias("selected"), "decision_idx", "ticker", "weight")
    return path.join(t, ["selected", "decision_idx"]).select(F.lit("meta").alias("strategy"), "decision_idx", "decision_date", "ticker", "weight")


def champion_timeline(path: DataFrame, targets: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """One row a decision: incumbent, challenger, selected, reason, margin, weights by ticker and, with a book, its values and costs."""
    before = F.lag("selected").over(Window.orderBy("decision_idx"))  # one row a decision of the run
    w = meta_targets(path, targets).groupBy("decision_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "weight")))).alias("weights"))
    out = path.withColumn("incumbent", before).join(w, "decision_idx", "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))
    return out if book is None else out.join(book, "decision_idx", "left")


def equity_curves(values: DataFrame) -> DataFrame:
    """strategy, date, value and value over the first one."""
    w = Window.partitionBy("strategy").orderBy("date")
    return values.select("strategy", "date", "value", (F.col("value") / F.first("value").over(w)).alias("normalised"))


def overview(summary: DataFrame) -> DataFrame:
    """(strategy, metric, value): the numbers of a summary as long rows."""
    cols = [c for c, t in summary.dtypes if t in ("double", "bigint", "int") and c != "strategy"]
    return summary.select("strategy", *[F.col(c).cast("double") for c in cols]).unpivot("strategy", cols, "metric", "value")


def decision_audit(date: str, path: DataFrame, ranked: DataFrame, trades: DataFrame) -> DataFrame:
    """(kind, strategy, detail) of one date: the choice, the board, the chosen strategy's row and the trades, as JSON."""
    day = lambda df: df.where(F.col("decision_date") == F.to_date(F.lit(date)))
    row = lambda df, kind, who: df.select(F.lit(kind).alias("kind"), F.col(who).alias("strategy"), F.to_json(F.struct(*[c for c in df.columns if c != who])).alias("detail"))
    choice, board = day(path), day(ranked)
    chosen = board.join(choice.select(F.col("selected").alias("strategy")), "strategy")
    return row(choice, "meta", "selected").unionByName(row(board, "leaderboard", "strategy")).unionByName(row(chosen, "selected", "strategy")).unionByName(row(day(trades), "trade", "portfolio_id" if "portfolio_id" in trades.columns else "strategy"))

"""Performance on irregular calendar time, rankings with average ties, and rolling boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 365.25


def clean_values(values: DataFrame) -> DataFrame:
    """(strategy, date, value): numbers above zero, of equal dates the larger ``seq`` (or value)."""
    order = F.desc("seq") if "seq" in values.columns else F.desc("value")
    w = Window.partitionBy("strategy", "date").orderBy(order)
    return values.where("value > 0").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("strategy", "date", "value")


def performance_metrics(values: DataFrame) -> DataFrame:
    """One row a strategy: total_return, cagr, max_drawdown in percent, sharpe, volatility, elapsed_days.

    Mean and variance of log returns per day, two passes: the squares are of deviations,
    so a constant growth has variance 0 but for rounding, and a Sharpe ratio of 0.
    """
    v = clean_values(values)
    w = Window.partitionBy("strategy").orderBy("date")
    v = v.withColumn("r", F.ln(F.col("value") / F.lag("value").over(w))).withColumn("days", F.datediff("date", F.lag("date").over(w)).cast("double"))
    v = v.withColumn("peak", F.max("value").over(w))
    all_ = Window.partitionBy("strategy")
    v = v.withColumn("mu", F.sum("r").over(all_) / F.sum("days").over(all_))
    m = v.groupBy("strategy").agg(
        F.min_by("value", "date").alias("initial"), F.max_by("value", "date").alias("final"), F.sum("days").alias("elapsed_days"),
        F.min(F.col("value") / F.col("peak") - 1).alias("dd"), F.count("*").alias("n"), F.first("mu").alias("mu"),
        (F.sum(F.pow(F.col("r") - F.col("mu") * F.col("days"), 2)) / F.sum("days")).alias("var"),
    )
    live = (F.col("n") >= 3) & (F.col("var") > 0)
    vol = F.when(live, F.sqrt(F.col("var") * YEAR)).otherwise(0.0)
    grown = F.col("final") / F.col("initial")
    return m.select(
        "strategy", ((grown - 1) * 100).alias("total_return"), F.when(F.col("elapsed_days") > 0, (F.pow(grown, YEAR / F.col("elapsed_days")) - 1) * 100).otherwise(0.0).alias("cagr"),
        F.when(live, F.col("mu") * YEAR / F.sqrt(F.col("var") * YEAR)).otherwise(0.0).alias("sharpe"), vol.alias("volatility"), (F.col("dd") * 100).alias("max_drawdown"), F.coalesce("elapsed_days", F.lit(0.0)).alias("elapsed_days"),
    )


def avg_rank_percentile(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """(average rank - 1) / (n - 1) of column within by; 1.0 for a single row; null stays null."""
    w = Window.partitionBy(by)
    rank = F.rank().over(w.orderBy(F.col(column).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(by, column)) - 1) / 2
    n = F.count(column).over(w)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.when(n == 1, 1.0).otherwise((rank - 1) / (n - 1))))


def regime_scores(intervals: DataFrame, min_periods: int = 4) -> DataFrame:
    """intervals (strategy, decision_idx, market_regime, net) with the mean net return of earlier
    intervals of the same regime, where there are at least min_periods of them."""
    w = Window.partitionBy("strategy", "market_regime").orderBy("decision_idx").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("regime_count", F.count("net").over(w)).withColumn("regime_score", F.when((F.col("regime_count") >= min_periods) & F.lit(min_periods > 0), F.avg("net").over(w)))


def regime_leaderboard(intervals: DataFrame) -> DataFrame:
    """market_regime, strategy: intervals, win_rate, mean_turnover, worst drawdown of compounded gross returns.

    sharpe and cagr are 0: intervals of one regime do not follow each other in time.
    """
    w = Window.partitionBy("market_regime", "strategy").orderBy("decision_idx")
    c = intervals.withColumn("level", F.exp(F.sum(F.log1p("gross")).over(w))).withColumn("peak", F.greatest(F.max("level").over(w), F.lit(1.0)))
    return c.groupBy("market_regime", "strategy").agg(F.count("*").alias("intervals"), F.avg((F.col("gross") > 0).cast("int")).alias("win_rate"), F.avg("turnover").alias("mean_turnover"), F.min(F.least(F.col("level") / F.col("peak") - 1, F.lit(0.0))).alias("max_drawdown"), F.lit(0.0).alias("sharpe"), F.lit(0.0).alias("cagr"))

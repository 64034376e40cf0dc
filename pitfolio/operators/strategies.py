"""Target weights of allocation strategies, for all decisions in one plan.

Each returns decision_idx, decision_date, ticker, weight. ``candidates`` are rows of
(decision_idx, decision_date, ticker, universe_order) with the features that a strategy
needs; what is not invested is cash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT = ("decision_idx", "decision_date", "ticker", "weight")


def _day():
    return Window.partitionBy("decision_idx")


def _weighted(picked: DataFrame, weighting: str, floor: float = 1e-6) -> DataFrame:
    """Equal shares, or shares by 1 / max(vol_20, floor) of the tickers that have one."""
    raw = F.lit(1.0) if weighting == "equal" else 1 / F.greatest("vol_20", F.lit(floor))
    if weighting != "equal":
        picked = picked.where("vol_20 is not null")
    return picked.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.sum("_w").over(_day())).select(*OUT)


def equal_weight(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("weight", 1 / F.count("*").over(_day())).select(*OUT)


def cash_only(candidates: DataFrame) -> DataFrame:
    return candidates.where("false").withColumn("weight", F.lit(0.0)).select(*OUT)


def inverse_volatility(candidates: DataFrame, floor: float = 1e-6, top_k: int | None = None) -> DataFrame:
    """Needs ``vol_20``: weights by 1 / max(vol, floor), of the top_k calmest if given."""
    c = candidates.where("vol_20 is not null").withColumn("inv_vol", 1 / F.greatest("vol_20", F.lit(floor)))
    if top_k:
        best = _day().orderBy(F.desc("inv_vol"), "universe_order")
        c = c.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= top_k)
    return _weighted(c, "inv_vol", floor)


def time_series_momentum(candidates: DataFrame, floor: float = 0.0, weighting: str = "equal") -> DataFrame:
    """Needs ``momentum``: own what has risen by more than floor."""
    return _weighted(candidates.where(F.col("momentum") > floor), weighting)


def cross_section_momentum(candidates: DataFrame, top_k: int = 3, floor: float = 0.0, weighting: str = "equal") -> DataFrame:
    """Needs ``momentum``: own the top_k; all cash if the leader is not above floor."""
    best = _day().orderBy(F.desc("momentum"), "universe_order")
    c = candidates.where("momentum is not null").withColumn("_k", F.row_number().over(best)).withColumn("_lead", F.max("momentum").over(_day()))
    return _weighted(c.where((F.col("_lead") > floor) & (F.col("_k") <= top_k)), weighting)


def ma_crossover(candidates: DataFrame, weighting: str = "equal") -> DataFrame:
    """Needs ``fast_ma`` and ``slow_ma``: own what trades above its slow mean."""
    return _weighted(candidates.where("fast_ma > slow_ma"), weighting)


def rule_based(candidates: DataFrame, top_k: int = 3, floor: float = 0.0, vol_floor: float = 1e-6) -> DataFrame:
    """strategy and weights of the five rule-based strategies from one pass over the candidates."""
    best = _day().orderBy(F.desc_nulls_last("momentum"), "universe_order")
    c = candidates.withColumn("_k", F.row_number().over(best)).withColumn("_lead", F.max("momentum").over(_day()))
    one = F.lit(1.0)
    raw = {
        "equal_weight": one, "inverse_volatility": 1 / F.greatest("vol_20", F.lit(vol_floor)), "ts_momentum": F.when(F.col("momentum") > floor, one),
        "xs_momentum": F.when((F.col("_lead") > floor) & (F.col("_k") <= top_k) & F.col("momentum").isNotNull(), one), "ma_crossover": F.when(F.col("fast_ma") > F.col("slow_ma"), one),
    }
    raw["inverse_volatility"] = F.when(F.col("vol_20").isNotNull(), raw["inverse_volatility"])
    picked = c.select(*OUT[:3], F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), w.alias("_w")) for n, w in raw.items()]))).where("_w is not null")
    return picked.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy("strategy", "decision_idx"))).select("strategy", *OUT)


def buy_and_hold(candidates: DataFrame) -> DataFrame:
    """Needs ``close``: equal weights at the first decision, then the value shares of what was bought.

    Tickers that are no candidate at a decision are left out of it; later entrants never enter.
    """
    run = Window.partitionBy("ticker").orderBy("decision_idx")
    first = F.min("decision_idx").over(Window.partitionBy())
    c = candidates.withColumn("_entry", F.first("close").over(run)).withColumn("_at", F.first("decision_idx").over(run)).withColumn("_first", first)
    c = c.where("_at = _first and close > 0").withColumn("_v", F.col("close") / F.col("_entry"))
    return c.withColumn("weight", F.col("_v") / F.sum("_v").over(_day())).select(*OUT)


def volatility_target(base: DataFrame, returns: DataFrame, lookback: int = 20, target: float = 0.10) -> DataFrame:
    """Base weights scaled to min(1, target / annual volatility) of the portfolio they make.

    returns: ticker, date, r1. The volatility is that of the weighted daily returns on the
    dates, among the last ``lookback`` of each ticker, that all tickers have. No volatility,
    or one date alone, gives no weights.
    """
    by = Window.partitionBy("ticker").orderBy("date")
    last = returns.where("r1 is not null").select("ticker", F.col("date").alias("decision_date"), F.collect_list(F.struct("date", "r1")).over(by.rowsBetween(1 - lookback, 0)).alias("last"))
    days = base.withColumn("n", F.count("*").over(_day())).join(last, ["ticker", "decision_date"]).select("decision_idx", "n", "weight", F.inline("last"))
    day = days.groupBy("decision_idx", "date").agg(F.sum(F.col("weight") * F.col("r1")).alias("r"), F.count("*").alias("k"), F.max("n").alias("n")).where("k = n")
    vol = day.groupBy("decision_idx").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"))
    scale = F.when(F.col("vol") > 0, F.least(F.lit(1.0), target / F.col("vol"))).otherwise(0.0)
    return base.join(vol, "decision_idx").withColumn("weight", F.col("weight") * scale).where("weight > 0").select(*OUT)


def ensemble_fixed(children: list[tuple[DataFrame, float]]) -> DataFrame:
    """Blend of children; blend weights are normalised, totals above 1 are scaled to 1."""
    total = sum(b for _, b in children)
    if total <= 0:
        raise ValueError("blend weights must sum to more than 0")
    parts = [w.withColumn("weight", F.col("weight") * F.lit(b / total)) for w, b in children]
    both = reduce(DataFrame.unionByName, parts).groupBy("decision_idx", "decision_date", "ticker").agg(F.sum("weight").alias("weight"))
    return both.withColumn("weight", F.col("weight") / F.greatest(F.sum("weight").over(_day()), F.lit(1.0))).select(*OUT)


def param_grid(spark: SparkSession, base: str, grid: dict[str, list]) -> DataFrame:
    """(strategy, parameters...): all combinations, named base_key=value_key2=value2."""
    out = spark.range(1).select(F.lit(base).alias("strategy"))
    for key, values in grid.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [key]))
        out = out.withColumn("strategy", F.concat_ws("_", "strategy", F.concat(F.lit(f"{key}="), F.col(key).cast("string"))))
    return out

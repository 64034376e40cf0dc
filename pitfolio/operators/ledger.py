"""Weight limits, orders, fills and ledgers as set operations over all portfolios at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import commission, fill_price, slippage

DUST = 1e-12


def apply_constraints(targets: DataFrame, current: DataFrame, max_weight: float = 0.35, turnover_cap: float = 0.35) -> DataFrame:
    """Cap weights, then blend towards current weights where turnover is over its cap.

    targets and current: (portfolio_id, decision_idx, ticker, weight). Returns one row a
    ticker with weight, cash_weight, turnover_pre, turnover_post, scale_factor.
    """
    key = ["portfolio_id", "decision_idx"]
    w = Window.partitionBy(*key)
    t = targets.withColumn("w", F.greatest("weight", F.lit(0.0)))
    for cap in (False, True):
        if cap:
            t = t.withColumn("w", F.least("w", F.lit(max_weight)))
        t = t.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(w), F.lit(1.0)))
    both = t.select(*key, "ticker", "w").join(current.select(*key, "ticker", F.col("weight").alias("cur")), [*key, "ticker"], "full").na.fill(0.0, ["w", "cur"])
    cash, cur_cash = 1 - F.sum("w").over(w), 1 - F.sum("cur").over(w)
    both = both.withColumn("turnover_pre", 0.5 * (F.sum(F.abs(F.col("w") - F.col("cur"))).over(w) + F.abs(cash - cur_cash)))
    both = both.withColumn("scale_factor", F.when(F.col("turnover_pre") > turnover_cap, turnover_cap / F.col("turnover_pre")).otherwise(1.0))
    both = both.withColumn("weight", F.col("cur") + F.col("scale_factor") * (F.col("w") - F.col("cur")))
    return both.select(*key, "ticker", "weight", (1 - F.sum("weight").over(w)).alias("cash_weight"), "turnover_pre", (F.col("turnover_pre") * F.col("scale_factor")).alias("turnover_post"), "scale_factor")


def generate_orders(targets: DataFrame, positions: DataFrame, prices: DataFrame, totals: DataFrame, min_notional: float = 1.0, buffer: float = 0.01, fractional: bool = True) -> DataFrame:
    """Orders for the union of targets and holdings: portfolio_id, decision_idx, ticker, shares."""
    key = ["portfolio_id", "decision_idx"]
    both = targets.select(*key, "ticker", "weight").join(positions.select(*key, "ticker", F.col("shares").alias("held")), [*key, "ticker"], "full").na.fill(0.0, ["weight", "held"])
    o = both.join(prices.select("decision_idx", "ticker", "price"), ["decision_idx", "ticker"]).join(totals.select(*key, "total_value"), key)
    shares = (F.col("weight") * F.col("total_value") * (1 - buffer) - F.col("held") * F.col("price")) / F.col("price")
    o = o.withColumn("shares", shares if fractional else F.signum(shares) * F.floor(F.abs(shares)))
    return o.where(F.abs(F.col("shares") * F.col("price")) >= min_notional).select(*key, "ticker", "shares", F.col("weight").alias("target_weight"))


def fill_orders(orders: DataFrame, prices: DataFrame, cash: DataFrame, slippage_bps: float = 5.0, flat: float = 0.0) -> DataFrame:
    """Fills: sells first, then buys in ``ord`` as far as the running cash goes.

    orders: portfolio_id, decision_idx, ticker, shares, ord. The cash a buy can use is the
    start plus the wished cash flows before it; once short, later buys find nothing left.
    """
    key = ["portfolio_id", "decision_idx"]
    f = orders.join(prices.select("decision_idx", "ticker", "price"), ["decision_idx", "ticker"]).join(cash.select(*key, "cash"), key)
    f = f.where("price > 0 and price < double('infinity')").withColumn("is_buy", (F.col("shares") > 0).cast("int"))
    f = f.withColumn("fill_price", fill_price(F.col("shares"), F.col("price"), slippage_bps))
    f = f.withColumn("wish", -F.col("shares") * F.col("fill_price") - flat)
    before = Window.partitionBy(*key).orderBy("is_buy", "ord", "ticker").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("available", F.col("cash") + F.coalesce(F.sum("wish").over(before), F.lit(0.0)))
    can = F.greatest((F.col("available") - flat) / F.col("fill_price"), F.lit(0.0))
    f = f.withColumn("shares", F.when(F.col("is_buy") == 1, F.least("shares", can)).otherwise(F.col("shares"))).where(F.abs("shares") > DUST)
    gross = F.abs(F.col("shares")) * F.col("fill_price")
    return f.select(*key, "ticker", "shares", "fill_price", commission(F.col("shares"), flat).alias("commission"), slippage(F.col("shares"), F.col("price"), slippage_bps).alias("slippage_cost"), gross.alias("gross_value"), (-F.col("shares") * F.col("fill_price") - commission(F.col("shares"), flat)).alias("cash_flow"))


def position_ledger(fills: DataFrame) -> DataFrame:
    """Shares held after the fills of a ticker in each decision; dust is nothing held."""
    fills = fills.groupBy("portfolio_id", "ticker", "decision_idx").agg(F.sum("shares").alias("shares"))
    w = Window.partitionBy("portfolio_id", "ticker").orderBy("decision_idx")
    held = F.sum("shares").over(w)
    return fills.select("portfolio_id", "decision_idx", "ticker", F.when(F.abs(held) < DUST, 0.0).otherwise(held).alias("shares"))


def cash_ledger(fills: DataFrame, initial: float, check: bool = False) -> DataFrame:
    """Cash after the fills of each decision; with ``check`` a book that overdraws is an error."""
    per = fills.groupBy("portfolio_id", "decision_idx").agg(F.sum("cash_flow").alias("flow"))
    cash = F.lit(float(initial)) + F.sum("flow").over(Window.partitionBy("portfolio_id").orderBy("decision_idx"))
    out = per.select("portfolio_id", "decision_idx", cash.alias("cash"))
    return out.withColumn("cash", F.when(F.col("cash") < -1e-9, F.raise_error(F.concat(F.lit("overdraft of portfolio "), F.col("portfolio_id").cast("string"))).cast("double")).otherwise(F.col("cash"))) if check else out


def weight_path_returns(targets: DataFrame, returns: DataFrame, cost_bps: float = 0.0, days: DataFrame | None = None) -> DataFrame:
    """strategy, decision_idx, decision_date, gross, turnover, net, value from weights and interval returns.

    The frictions-lite form: weights drift with returns until the next decision; turnover is
    half the absolute change against the drifted weights, cash included. Every decision of
    ``days`` (decision_idx, decision_date; those of ``returns`` if not given) is one interval,
    without weights all in cash.
    """
    days = (returns.select("decision_idx", "decision_date").distinct() if days is None else days.select("decision_idx", "decision_date")).withColumn("next_idx", F.lead("decision_idx").over(Window.orderBy("decision_idx")))
    grid = days.crossJoin(targets.select("strategy").distinct())
    held = targets.select("strategy", "decision_idx", "ticker", "weight").join(returns.select("decision_idx", "ticker", "ret"), ["decision_idx", "ticker"], "left").join(days, "decision_idx")
    held = held.withColumn("gross", F.sum(F.col("weight") * F.col("ret")).over(Window.partitionBy("strategy", "decision_idx")))
    # A holding is bought at its decision and, drifted, sold at the next; what is left of both is traded.
    old = -F.col("weight") * (1 + F.col("ret")) / (1 + F.col("gross"))
    legs = F.array(F.struct(F.col("decision_idx").alias("at"), F.col("weight").alias("move"), (F.col("weight") * F.col("ret")).alias("g")), F.struct(F.col("next_idx").alias("at"), old.alias("move"), F.lit(None).cast("double").alias("g")))
    moves = held.select("strategy", "ticker", F.inline(legs)).groupBy("strategy", "at", "ticker").agg(F.coalesce(F.sum("move"), F.lit(0.0)).alias("move"), F.sum("g").alias("g"))
    moved = moves.groupBy("strategy", F.col("at").alias("decision_idx")).agg(F.sum("g").alias("gross"), F.sum(F.abs("move")).alias("_a"), F.sum("move").alias("_c"))
    path = grid.join(moved, ["strategy", "decision_idx"], "left").na.fill(0.0, ["gross", "_a", "_c"]).withColumn("turnover", 0.5 * (F.col("_a") + F.abs("_c")))
    path = path.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)
    path = path.withColumn("value", F.exp(F.sum(F.log1p("net")).over(Window.partitionBy("strategy").orderBy("decision_idx"))))
    return path.select("strategy", "decision_idx", "decision_date", "gross", "turnover", "net", "value")

"""Books of portfolios: weights, marks, rebalancing steps and the views on their fills.

All portfolios go through one plan. What a book holds hangs on its earlier fills, so
``rebalance_paths`` folds the decisions of a portfolio in order: rows are dealt by portfolio
and sorted by decision, and one pass over the Arrow batches of a task carries the book from
decision to decision. A task holds one batch, one decision and one book at a time, however
long the history. The fold reads targets and marks of what a portfolio may hold, nothing else
(``fold_rows``); everything around it is joins, sums and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import valid_price
from .ledger import DUST

KEY = ["portfolio_id", "decision_idx"]
#: The cash leg among tickers; no security has this name.
CASH = "cash"
_BLOCK = 64
PATHS = (
    "portfolio_id string, decision_idx int, decision_date date, fill_date date, ticker string, raw_weight double, target_weight double, order_shares double, shares double, fill_price double, commission double, "
    "slippage_cost double, gross_value double, cash_flow double, position double, value_before double, pre_trade_value double, value_after double, cash double, turnover_pre double, turnover_post double, scale_factor double"
)


def current_weights(positions: DataFrame, cash: DataFrame, prices: DataFrame) -> DataFrame:
    """portfolio_id, decision_idx, ticker, weight: value shares, the cash leg as ticker ``cash``; all cash if the total is not above 0."""
    value = positions.join(prices.select("decision_idx", "ticker", "price"), ["decision_idx", "ticker"]).select(*KEY, "ticker", (F.col("shares") * F.col("price")).alias("v"))
    both = value.unionByName(cash.select(*KEY, F.lit(CASH).alias("ticker"), F.col("cash").alias("v")))
    total = F.sum("v").over(Window.partitionBy(*KEY))
    share = F.when(total > 0, F.col("v") / total).otherwise(F.when(F.col("ticker") == CASH, 1.0))
    return both.withColumn("weight", share).where("weight is not null").select(*KEY, "ticker", "weight")


def mark_to_market(positions: DataFrame, cash: DataFrame, prices: DataFrame) -> DataFrame:
    """portfolio_id, decision_idx, total_value: cash and shares at their prices."""
    value = positions.join(prices.select("decision_idx", "ticker", "price"), ["decision_idx", "ticker"]).select(*KEY, (F.col("shares") * F.col("price")).alias("v"))
    return value.unionByName(cash.select(*KEY, F.col("cash").alias("v"))).groupBy(*KEY).agg(F.sum("v").alias("total_value"))


def leaver_orders(positions: DataFrame, eligible: DataFrame) -> DataFrame:
    """Orders that sell what is held but no longer eligible. eligible: decision_idx, ticker."""
    out = positions.where(F.abs("shares") > DUST).join(eligible.select("decision_idx", "ticker").distinct(), ["decision_idx", "ticker"], "left_anti")
    return out.select(*KEY, "ticker", (-F.col("shares")).alias("shares"), F.lit(0.0).alias("target_weight"))


def interval_returns(values: DataFrame) -> DataFrame:
    """values (portfolio_id, decision_idx, pre_trade_value, value_after) with gross and net return since the last fill."""
    last = F.lag("value_after").over(Window.partitionBy("portfolio_id").orderBy("decision_idx"))
    grown = lambda c: F.when(last > 0, F.col(c) / last - 1)
    return values.withColumn("gross", grown("pre_trade_value")).withColumn("net", grown("value_after"))


def cost_drag(fills: DataFrame, by: str = "portfolio_id") -> DataFrame:
    """by, cost_drag: slippage and commissions over gross value, 0 without fills."""
    gross = F.sum("gross_value")
    return fills.groupBy(by).agg(F.when(gross > 0, F.sum(F.col("slippage_cost") + F.col("commission")) / gross).otherwise(0.0).alias("cost_drag"))


def cash_share(values: DataFrame) -> DataFrame:
    """values with cash_pct, 1 where the total is not above 0."""
    return values.withColumn("cash_pct", F.when(F.col("value_after") > 0, F.col("cash") / F.col("value_after")).otherwise(1.0))


def trades_view(paths: DataFrame) -> DataFrame:
    """The fills of paths with their decision; is_initialization marks a portfolio's first decision."""
    first = F.min("decision_idx").over(Window.partitionBy("portfolio_id"))
    t = paths.withColumn("is_initialization", F.col("decision_idx") == first).where(F.abs("shares") > DUST)
    side = F.when(F.col("shares") > 0, "buy").otherwise("sell")
    return t.select(*KEY, "decision_date", "fill_date", "ticker", side.alias("side"), "shares", "fill_price", "commission", "slippage_cost", (F.col("commission") + F.col("slippage_cost")).alias("net_cost"), "gross_value", "cash_flow", "is_initialization")


def book_values(paths: DataFrame) -> DataFrame:
    """One row a portfolio and decision: values, cash, turnover, returns and cash share."""
    cols = ("value_before", "pre_trade_value", "value_after", "cash", "turnover_pre", "turnover_post", "scale_factor")
    v = paths.groupBy(*KEY, "decision_date", "fill_date").agg(*[F.max(c).alias(c) for c in cols])
    return cash_share(interval_returns(v))


def holdings_snapshot(paths: DataFrame) -> DataFrame:
    """One row a portfolio and fill date: cash and the positions held, by ticker."""
    held = F.when(F.abs("position") > DUST, F.struct("ticker", "position"))
    return paths.groupBy("portfolio_id", "fill_date").agg(F.max("cash").alias("cash"), F.map_from_entries(F.array_sort(F.collect_list(held))).alias("positions"))


def decision_log(paths: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One nested record a portfolio and decision: weights by ticker, values, turnover; skipped decisions carry a reason."""
    by_ticker = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ticker", c)))))
    log = paths.groupBy(*KEY, "decision_date", "fill_date").agg(
        by_ticker("raw_weight").alias("raw_target_weights"), by_ticker("target_weight").alias("target_weights"), F.max("value_before").alias("portfolio_value_before"),
        F.max("pre_trade_value").alias("portfolio_value_pre_trade"), F.max("value_after").alias("portfolio_value_after"), F.max("turnover_pre").alias("turnover_pre"), F.max("turnover_post").alias("turnover_post"), F.max("scale_factor").alias("turnover_scale_factor"),
    ).withColumn("status", F.lit("executed")).withColumn("reason", F.lit(None).cast("string"))
    return log if skipped is None else log.unionByName(skipped.withColumn("status", F.lit("skipped")), allowMissingColumns=True)


def _step(rows, book, cash, p, hold=False):
    """One decision of one portfolio: orders from constrained weights, fills, the new book. rows: dicts in order, None for none.

    With ``hold`` a book that has positions keeps its shares and sells only what is no longer eligible.
    """
    held = {t: s for t, s in book.items() if s != 0}
    price, fill = ({r["ticker"]: r[c] for r in rows if r[c] is not None and 0 < r[c] < float("inf")} for c in ("decision_price", "fill_price"))
    for where, marks in (("decision", price), ("fill", fill)):
        if missing := [t for t in held if t not in marks]:
            raise ValueError(f"no {where} price for held {missing}")
    before = cash + sum(s * price[t] for t, s in held.items())
    raw = {r["ticker"]: max(r["weight"], 0.0) for r in rows if r["weight"] is not None and r["weight"] == r["weight"]}
    now = {t: s * price[t] / before for t, s in held.items()} if before > 0 else {}
    w = dict(raw)
    for cap in (None, p["max_weight"]):
        w = {t: x if cap is None else min(x, cap) for t, x in w.items()}
        total = max(sum(w.values()), 1.0)
        w = {t: x / total for t, x in w.items()}
    names = list(dict.fromkeys([*w, *held]))
    cash_now = cash / before if before > 0 else 1.0
    turn = 0.5 * (sum(abs(w.get(t, 0) - now.get(t, 0)) for t in names) + abs((1 - sum(w.values())) - cash_now))
    scale = p["turnover_cap"] / turn if turn > p["turnover_cap"] else 1.0
    turned = turn * scale
    goal = {t: now.get(t, 0.0) + scale * (w.get(t, 0.0) - now.get(t, 0.0)) for t in names if t in price}
    orders = {}
    if hold and held:
        gone = {r["ticker"] for r in rows if r["eligible"] is False}
        orders = {t: -s for t, s in held.items() if t in gone}
        turned = sum(abs(s * price[t]) / before for t, s in orders.items()) if before > 0 else 0.0
    else:
        for t in names:
            if t in price:
                shares = (goal[t] * before * (1 - p["buffer"]) - book.get(t, 0.0) * price[t]) / price[t]
                shares = shares if p["fractional"] else float(int(shares))
                if abs(shares * price[t]) >= p["min_notional"]:
                    orders[t] = shares
    pre, spend, done = cash + sum(s * fill[t] for t, s in held.items()), cash, {}
    for t in sorted(orders, key=lambda t: orders[t] > 0):  # sells first, else in order
        if t not in fill:
            continue
        shares, flat = orders[t], p["commission"]
        at = fill[t] * (1 + (1 if shares > 0 else -1) * p["slippage_bps"] / 1e4)
        if shares > 0:
            shares = min(shares, max(0.0, (spend - flat) / at))
        if abs(shares) > DUST:
            done[t] = (shares, at, flat, abs(shares) * abs(at - fill[t]), abs(shares) * at, -shares * at - flat)
            spend += done[t][5]
    after = {t: book.get(t, 0.0) + done.get(t, (0.0,))[0] for t in dict.fromkeys([*names, *done])}
    after = {t: s for t, s in after.items() if abs(s) > DUST}
    value = spend + sum(s * fill[t] for t, s in after.items())
    out = [
        (t, raw.get(t), goal.get(t), orders.get(t), *done.get(t, (None,) * 6), after.get(t, 0.0), before, pre, value, spend, turn, turned, scale)
        for t in names
    ] or [(CASH, None, None, None, *(None,) * 6, 0.0, before, pre, value, spend, turn, turned, scale)]
    return out, after, spend


class _Fold:
    """Books of the portfolios of one task, row after row in order of portfolio and decision."""

    def __init__(self, p: dict, initial: float):
        self.p, self.initial = p, initial
        self.at, self.rows, self.book, self.cash, self.lines = None, {}, {}, initial, []

    def row(self, r: dict) -> None:
        at = r["portfolio_id"], r["decision_idx"]
        if at != self.at:
            self.close()
            if self.at is None or at[0] != self.at[0]:
                self.book, self.cash = {}, self.initial
            self.at, self.days, self.hold = at, (None, None), False
        self.days = r["decision_date"] or self.days[0], r["fill_date"] or self.days[1]
        self.hold |= bool(r["hold"])
        have = self.rows.setdefault(r["ticker"], r)
        if have is not r:  # a target and a mark of one ticker may be two rows
            for c, v in r.items():
                if have[c] is None:
                    have[c] = v

    def close(self) -> None:
        """Take the decision whose rows are complete."""
        if self.rows:
            rows = [r for t, r in self.rows.items() if t != CASH and (r["decision_price"] is not None or r["fill_price"] is not None)]
            rows.sort(key=lambda r: (r["ord"] if r["ord"] is not None else 0, r["ticker"]))
            lines, self.book, self.cash = _step(rows, self.book, self.cash, self.p, self.hold)
            self.lines += [(*self.at, *self.days, *line) for line in lines]
            self.rows = {}


_FOLDED = ["portfolio_id", "decision_idx", "decision_date", "fill_date", "ticker", "ord", "weight", "decision_price", "fill_price", "eligible", "hold"]


def rebalance_paths(
    decisions: DataFrame, initial: float = 100_000.0, max_weight: float = 0.35, turnover_cap: float = 0.35, min_notional: float = 1.0, buffer: float = 0.01,
    slippage_bps: float = 5.0, commission: float = 0.0, fractional: bool = True,
) -> DataFrame:
    """One row a portfolio, decision and ticker it targets or holds; see PATHS.

    decisions: portfolio_id, decision_idx, decision_date, fill_date, ticker, ord, weight (null:
    no target), decision_price, fill_price, and if wanted eligible and hold (a book that keeps
    its shares and sells only what is no longer eligible). A decision has a row for every ticker
    held then, so that holdings can be marked; a target and a mark of one ticker may be two
    rows, and a row of ticker ``cash`` without a target stands for the decision alone. A
    portfolio starts with ``initial`` cash. A held ticker without a price at a decision or fill
    is an error. A decision without targets or holdings gives one row of ticker ``cash``.
    """
    p = {"max_weight": max_weight, "turnover_cap": turnover_cap, "min_notional": min_notional, "buffer": buffer, "slippage_bps": slippage_bps, "commission": commission, "fractional": fractional}

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "date": pa.date32(), "double": pa.float64()}
        schema, fold = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PATHS.split(", ")]), _Fold(p, initial)

        def out():
            cols = zip(*fold.lines, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            fold.lines = []
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                fold.row(r)
            if len(fold.lines) >= 10_000:
                yield out()
        fold.close()
        if fold.lines:
            yield out()

    none = F.lit(None).cast("boolean")
    d = decisions
    for c in ("eligible", "hold"):
        d = d if c in d.columns else d.withColumn(c, none)
    casts = {"portfolio_id": "string", "decision_idx": "int", "ord": "int", "weight": "double", "decision_price": "double", "fill_price": "double"}
    d = d.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in _FOLDED])
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that small books are not put into one task
    return d.repartition(tasks, "portfolio_id").sortWithinPartitions("portfolio_id", "decision_idx", "ord", "ticker").mapInArrow(run, PATHS)


def rebase(decisions: DataFrame, start: DataFrame, **params) -> DataFrame:
    """rebalance_paths of the first decision alone, from the start weights of each portfolio (portfolio_id, ticker, weight).

    Scored portfolios begin in what they would have held: the start weights go through the same
    limits, orders and fills as any targets.
    """
    first = decisions.withColumn("_first", F.min("decision_idx").over(Window.partitionBy("portfolio_id"))).where("decision_idx = _first").drop("_first", "weight")
    return rebalance_paths(first.join(start.select("portfolio_id", "ticker", "weight"), ["portfolio_id", "ticker"], "left"), **params)


def marks_at(bars: DataFrame, schedule: DataFrame, field: str, day: str) -> DataFrame:
    """decision_idx, ticker, price: the last valid price of each ticker at or before the ``day`` of each kept decision.

    A bar is in force for the decisions from its date to the next bar of the ticker: a range of
    decision numbers, which is exploded. There is no grid of sessions and tickers.
    """
    kept = schedule.where("status = 'kept'").select("decision_idx", F.col(day).alias("date"))
    good = valid_price(bars, field).select("ticker", "date", F.col(field).alias("price"))
    after = Window.orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # one row a date
    calendar = good.select("date").distinct().join(kept, "date", "full").select("date", F.first("decision_idx", ignorenulls=True).over(after).alias("k"), F.max("decision_idx").over(Window.partitionBy()).alias("n"))
    one = good.join(calendar, "date").withColumn("until", F.coalesce(F.lead("k").over(Window.partitionBy("ticker").orderBy("date")), F.col("n") + 1) - 1)
    return one.where("k <= until").select("ticker", "price", F.explode(F.sequence("k", "until")).alias("decision_idx"))


def fold_rows(targets: DataFrame, schedule: DataFrame, bars: DataFrame, decision_field: str = "close", fill_field: str = "open", holds: DataFrame | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """Rows for rebalance_paths from targets (strategy, decision_idx, ticker, weight): the targets, and marks of what may be held.

    A portfolio can hold a ticker from its first target on, so it gets that ticker's marks from
    then on and no others. Marks are joined by ticker and block of decisions: a ticker that
    all portfolios hold is many keys. One row of ticker ``cash`` a decision carries the dates.
    holds: strategy of books that keep their shares; eligible: decision_idx, ticker.
    """
    kept = schedule.where("status = 'kept'").select("decision_idx", "decision_date", "fill_date")
    marks = marks_at(bars, schedule, decision_field, "decision_date").withColumnRenamed("price", "decision_price")
    marks = marks.join(marks_at(bars, schedule, fill_field, "fill_date").withColumnRenamed("price", "fill_price"), ["decision_idx", "ticker"])
    if eligible is not None:
        marks = marks.join(eligible.select("decision_idx", "ticker", F.lit(True).alias("eligible")).distinct(), ["decision_idx", "ticker"], "left").na.fill(False, ["eligible"])
    marks = marks.unionByName(kept.withColumn("ticker", F.lit(CASH)), allowMissingColumns=True).withColumn("block", F.floor(F.col("decision_idx") / _BLOCK))
    t = targets.select(F.col("strategy").cast("string").alias("portfolio_id"), "decision_idx", "ticker", "weight")
    own = t.groupBy("portfolio_id", "ticker").agg(F.min("decision_idx").alias("since"))
    own = own.unionByName(own.select("portfolio_id", F.lit(CASH).alias("ticker"), F.lit(0).alias("since")).distinct())
    if holds is not None:
        own = own.join(holds.select(F.col("strategy").cast("string").alias("portfolio_id"), F.lit(True).alias("hold")).distinct(), "portfolio_id", "left")
    last = marks.groupBy("ticker").agg(F.max("block").alias("last"))
    blocks = own.join(last, "ticker").where(F.floor(F.col("since") / _BLOCK) <= F.col("last")).withColumn("block", F.explode(F.sequence(F.floor(F.col("since") / _BLOCK), "last"))).drop("last")
    may = blocks.join(marks, ["ticker", "block"]).where("decision_idx >= since").drop("block", "since")
    return may.unionByName(t, allowMissingColumns=True).withColumn("ord", F.lit(None).cast("int"))

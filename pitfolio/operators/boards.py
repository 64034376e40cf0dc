"""Boards known before each decision: rolling metrics, gates, scores, ranks and the champion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settle import settled
from .features import sliding_drawdown
from .stats import YEAR, avg_rank_percentile, regime_scores

#: Ties between doubles are ties of so many digits, so that any order of sums ranks alike.
DIGITS = 9


def rolling_board(intervals: DataFrame, window: int = 20, min_periods: int = 4) -> DataFrame:
    """strategy, decision_idx, decision_date, sharpe, drawdown, turnover, regime_score, regime_count.

    intervals: strategy, decision_idx, decision_date, market_regime, turnover, net, value (at the
    interval's end, from 1). Each row uses completed intervals only: the window + 1 values up to the decision and
    the window turnovers before it. The first decision has no past and only nulls; fewer
    than three values give no Sharpe ratio, values without variance 0. The drawdown is merged
    from segments (``sliding_drawdown``); the steps of a Sharpe ratio are at most ``window``.
    """
    by = Window.partitionBy("strategy").orderBy("decision_idx")
    v = intervals.withColumn("start", F.coalesce(F.lag("value").over(by), F.lit(1.0)))
    v = v.withColumn("r", F.ln(F.col("start") / F.lag("start").over(by))).withColumn("d", F.datediff("decision_date", F.lag("decision_date").over(by)).cast("double"))
    steps, before = by.rowsBetween(1 - window, 0), by.rowsBetween(-window, -1)
    v = v.withColumn("mu", F.sum("r").over(steps) / F.sum("d").over(steps)).withColumn("n", F.count("r").over(steps)).withColumn("days", F.sum("d").over(steps))
    v = v.withColumn("steps", F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "d"))).over(steps))
    v = v.withColumn("var", F.aggregate("steps", F.lit(0.0), lambda s, x: s + F.pow(x["r"] - F.col("mu") * x["d"], 2)) / F.col("days")).drop("steps")
    sharpe = F.when(F.col("n") >= 2, F.when(F.col("var") > 0, F.col("mu") * YEAR / F.sqrt(F.col("var") * YEAR)).otherwise(0.0))
    v = sliding_drawdown(v, by, "start", window + 1, "worst")
    v = v.withColumn("sharpe", sharpe).withColumn("drawdown", F.when(F.col("n") > 0, F.col("worst"))).withColumn("mean_turnover", F.avg("turnover").over(before))
    v = regime_scores(v, min_periods)
    return v.select("strategy", "decision_idx", "decision_date", *[F.round(c, DIGITS).alias(a) for c, a in (("sharpe", "sharpe"), ("drawdown", "drawdown"), ("mean_turnover", "turnover"), ("regime_score", "regime_score"))], "regime_count")


def ranked_board(board: DataFrame, dd_limit: float = -0.2, turnover_limit: float = 1.0, global_weight: float = 0.6, regime_weight: float = 0.4) -> DataFrame:
    """board with eligible, global_percentile, regime_percentile, score and rank (null where not eligible)."""
    gate = F.coalesce(F.col("sharpe").isNotNull() & (F.col("drawdown") >= dd_limit) & (F.col("turnover") <= turnover_limit), F.lit(False))
    b = board.withColumn("eligible", gate).withColumn("_g", F.when(F.col("eligible"), F.col("sharpe"))).withColumn("_r", F.when(F.col("eligible"), F.col("regime_score")))
    b = avg_rank_percentile(avg_rank_percentile(b, "decision_idx", "_g", "global_percentile"), "decision_idx", "_r", "regime_percentile")
    both = F.col("regime_percentile").isNotNull() & F.lit(regime_weight > 0)
    mixed = (global_weight * F.col("global_percentile") + regime_weight * F.col("regime_percentile")) / (global_weight + regime_weight)
    b = b.withColumn("score", F.round(F.when(both, mixed).otherwise(F.col("global_percentile")), DIGITS)).withColumn("score_source", F.when(F.col("eligible"), F.when(both, "global_and_regime").otherwise("global")))
    w = Window.partitionBy("decision_idx", "eligible").orderBy(F.desc("score"), F.desc("drawdown"), "turnover", "strategy")
    return b.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(w))).drop("_g", "_r")


#: Selection days folded in one row.
BLOCK = 256


def _chain(nodes: DataFrame, run: list[str], block: int) -> DataFrame:
    """(run, o): the nodes on the way from node 0 of each run.

    nodes: run, o (0, 1, .. without gaps), next (greater than o; beyond the last node: the end).
    A node's step is a map to a later node. Maps are composed inside blocks of so many nodes by
    pointer doubling, which gives each node its first successor outside; those are composed
    with themselves to 2, 4, .. blocks, and applied to the start from the longest down, so that
    the first node of every block on the way is known after as many joins as the number of
    blocks has binary digits. Last, every block is walked from its first node, all at once.
    """
    at = lambda c: F.col(c).cast("int")
    n = nodes.withColumn("block", F.floor(F.col("o") / block))
    rows = n.groupBy(*run, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "next"))), lambda x: x["next"]).alias("nexts"))
    base = F.col("block") * block
    inside = lambda x: (x - base < F.size("nexts")) & (x - base < block)
    rows = rows.withColumn("ptr", F.transform("nexts", lambda x, i: F.when(inside(x), (x - base).cast("int")).otherwise(i)))
    doubled = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (block - 1).bit_length()))), F.col("ptr"), lambda p, _: F.transform(p, lambda x: F.get(p, x)))
    rows = settled(rows.withColumn("out", F.transform(doubled, lambda x: F.get(F.col("nexts"), x))))
    blocks = rows.groupBy(*run).count().agg(F.max("count")).first()[0] or 0
    step = rows.select(*run, F.posexplode("out").alias("i", "to"), "block").select(*run, at("i").alias("i"), (base + F.col("i")).alias("o"), "to").drop("i")
    jumps = []
    for _ in range((blocks - 1).bit_length() if blocks > 1 else 0):
        jumps.append(settled(step))
        far = jumps[-1]
        step = far.join(far.select(*run, F.col("o").alias("to"), F.col("to").alias("then")), [*run, "to"], "left").select(*run, "o", "then").where("then is not null").withColumnRenamed("then", "to")
    first = rows.where("block = 0").select(*run, F.lit(0).cast("long").alias("o"))
    for jump in reversed(jumps):
        first = first.unionByName(first.join(jump, [*run, "o"]).select(*run, F.col("to").alias("o")))
    entry = first.withColumn("block", F.floor(F.col("o") / block)).groupBy(*run, "block").agg(F.min("o").alias("entry"))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.size("nexts") - 1), F.struct(F.col("entry").alias("cur"), F.array().cast("array<bigint>").alias("seen")),
        lambda s, i: F.when(base + i == s["cur"], F.struct(F.get(F.col("nexts"), i).alias("cur"), F.concat(s["seen"], F.array(s["cur"])).alias("seen"))).otherwise(s), lambda s: s["seen"],
    )
    return rows.join(entry, [*run, "block"]).select(*run, F.explode(walk).alias("o"))


def champion_path(ranked: DataFrame, baseline: str = "equal_weight", first: int = 4, weekday: int = 6, margin: float = 0.1, key: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key,) decision_idx, decision_date, selected, challenger, switch_reason, score_margin, switched.

    One row a decision: the baseline for the first decisions, then the incumbent until a
    weekday (1 is Sunday) on which a challenger leads by margin. With ``key`` each of its values
    is a run of its own.

    The choice depends on the one before it, but not on how that came about: a strategy chosen
    on one selection day stays until the first later one on which it loses, whoever it
    followed. For each strategy the selection days it would stay are islands of consecutive
    ones; the end of the island gives each day's choice its successor, and the run is the chain
    of successors from the baseline (see ``_chain``). No row holds more than ``block`` days.
    """
    run = [key] if key else ["_run"]
    cols = [] if key else [F.lit(0).alias("_run")]
    r = settled(ranked.select(*cols, *([key] if key else []), "decision_idx", "decision_date", "strategy", "eligible", "score", "rank"))
    order = Window.partitionBy(*run).orderBy("decision_idx")
    days = r.groupBy(*run, "decision_idx", "decision_date").agg(F.min_by("strategy", "rank").alias("challenger"), F.min_by("score", "rank").alias("top"))
    early, open_day = F.col("decision_idx") < first, (F.col("decision_idx") >= first) & (F.dayofweek("decision_date") == weekday)
    days = settled(days.withColumn("early", early).withColumn("open", open_day).withColumn("o", F.sum(F.col("open").cast("long")).over(order)).withColumn("place", F.row_number().over(order)))

    on = days.where("open").select(*run, "decision_idx", "o", "challenger", "top", "place")
    stays = r.where("eligible").join(on, [*run, "decision_idx"]).where((F.col("strategy") == F.col("challenger")) | (F.col("top") - F.col("score") < margin)).select(*run, "strategy", "o")
    of = Window.partitionBy(*run, "strategy").orderBy("o")
    island = stays.withColumn("i", F.col("o") - F.row_number().over(of))
    until = island.select(*run, "strategy", "o", F.max("o").over(Window.partitionBy(*run, "strategy", "i")).alias("last"))

    # Node 0 is the state before the first selection day: the baseline, or nobody if that is the first day of the run.
    start = days.groupBy(*run).agg(F.min(F.when(F.col("open"), F.col("place"))).alias("p")).select(*run, F.lit(0).cast("long").alias("o"), F.when(F.coalesce(F.col("p"), F.lit(0)) != 1, F.lit(baseline)).alias("chosen"))
    nodes = on.select(*run, "o", F.coalesce("challenger", F.lit(baseline)).alias("chosen")).unionByName(start)
    held = nodes.withColumn("after", F.col("o") + 1).join(until.select(*run, F.col("strategy").alias("chosen"), F.col("o").alias("after"), "last"), [*run, "chosen", "after"], "left")
    nodes = settled(held.select(*run, "o", "chosen", (F.coalesce("last", F.col("o")) + 1).alias("next")))
    switched = _chain(nodes, run, block).where("o > 0").join(nodes.select(*run, "o", "chosen"), [*run, "o"])

    d = days.join(switched.withColumn("open", F.lit(True)), [*run, "o", "open"], "left")
    d = d.withColumn("selected", F.when(F.col("early"), F.lit(baseline)).otherwise(F.coalesce(F.last("chosen", ignorenulls=True).over(order), F.lit(baseline)))).withColumn("held", F.lag("selected").over(order))
    d = d.join(r.where("eligible").select(*run, "decision_idx", F.col("strategy").alias("held"), F.col("score").alias("own"), F.lit(True).alias("there")), [*run, "decision_idx", "held"], "left")
    lead = F.col("top") - F.col("own")
    reason = (
        F.when(F.col("early"), "initialization_baseline").when(~F.col("open"), "incumbent_held_until_selection_day").when(F.col("challenger").isNull(), "no_eligible_candidate")
        .when(F.col("there").isNull(), "incumbent_ineligible").when(F.col("challenger") == F.col("held"), "incumbent_ranked_first").when(lead >= margin, "challenger_exceeded_margin").otherwise("challenger_below_margin")
    )
    d = d.withColumn("switch_reason", reason)
    return d.select(
        *([key] if key else []), "decision_idx", "decision_date", "selected", "challenger", "switch_reason", F.when(F.col("switch_reason").isin("challenger_exceeded_margin", "challenger_below_margin"), lead).alias("score_margin"),
        F.coalesce(~F.col("early") & (F.col("held") != F.col("selected")), F.lit(False)).alias("switched"),
    )

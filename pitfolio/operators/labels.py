"""Interval targets between fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals_of(schedule: DataFrame) -> DataFrame:
    """Kept decisions with the next kept fill as interval end."""
    kept = schedule.where("status = 'kept'")
    return kept.select("decision_idx", "decision_date", "fill_date", F.lead("fill_date").over(Window.orderBy("decision_idx")).alias("next_fill"))


def interval_return(schedule: DataFrame, bars: DataFrame, field: str = "open") -> DataFrame:
    """decision_idx, decision_date, ticker, ret: price at the next fill over price at this one, less 1."""
    s = intervals_of(schedule)
    at = s.join(bars.select("ticker", F.col("date").alias("fill_date"), F.col(field).alias("p0")), "fill_date")
    w = Window.partitionBy("ticker").orderBy("decision_idx")
    at = at.withColumn("p1", F.lead("p0").over(w)).withColumn("then", F.lead("fill_date").over(w))
    return at.where("then = next_fill and p0 is not null and p1 is not null").select("decision_idx", "decision_date", "ticker", (F.col("p1") / F.col("p0") - 1).alias("ret"))


def interval_vol(schedule: DataFrame, bars: DataFrame) -> DataFrame:
    """Root of the summed squared log changes of closes within [fill, next fill].

    Each date gets the interval it lies in from a running last over the calendar (a fill
    date ends one interval and begins the next), so bars meet intervals by an equal date.
    The first bar of an interval only opens it.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    steps = bars.where("close > 0").select("ticker", "date", F.pow(F.ln("close") - F.lag(F.ln("close")).over(w), 2).alias("sq"))
    s = intervals_of(schedule).where("next_fill is not null").select("decision_idx", "decision_date", "fill_date", "next_fill")
    days = steps.select("date").distinct().unionByName(s.select(F.col("fill_date").alias("date"))).distinct()
    fills = s.select(F.col("fill_date").alias("date"), F.struct("decision_idx", "decision_date", "next_fill").alias("i"))
    run = Window.orderBy("date")
    placed = days.join(fills, "date", "left").withColumn("now", F.last("i", ignorenulls=True).over(run)).withColumn("before", F.lag("now").over(run))
    ends = F.when(F.col("before.next_fill") == F.col("date"), F.col("before"))
    inside = F.when(F.col("date") <= F.col("now.next_fill"), F.col("now"))
    of = placed.select("date", F.inline(F.array_distinct(F.array_compact(F.array(inside, ends)))))
    own = Window.partitionBy("decision_idx", "ticker").orderBy("date")
    within = steps.join(of, "date").withColumn("k", F.row_number().over(own))
    return within.groupBy("decision_idx", "decision_date", "ticker").agg(F.sqrt(F.sum(F.when(F.col("k") > 1, F.col("sq")))).alias("vol"))

"""Trading calendars, decision schedules, point-in-time gates and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def trading_calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays of [start, end] that are no holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date")).where(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays, "date", "left_anti")


def sessions(bars: DataFrame) -> DataFrame:
    """The dates on which any ticker has a bar."""
    return bars.select("date").distinct()


def decision_calendar(calendar: DataFrame, days=("wednesday", "friday")) -> DataFrame:
    return calendar.where(F.weekday("date").isin([DAYS.index(d) for d in days]))


def next_session(calendar: DataFrame) -> DataFrame:
    """(date, next_date): null on the last session. One window over the calendar, a few thousand rows."""
    return calendar.select("date", F.lead("date").over(Window.orderBy("date")).alias("next_date"))


def build_schedule(calendar: DataFrame, days=("wednesday", "friday"), decision_time: str = "close", fill_time: str = "open", end: str | None = None) -> DataFrame:
    """(decision_idx, decision_date, fill_date, status): the first decision without a fill ends the run.

    Only a decision at the close filled at the open waits for the next session.
    """
    fill = F.col("next_date") if (decision_time, fill_time) == ("close", "open") else F.col("date")
    d = next_session(calendar).where(F.weekday("date").isin([DAYS.index(x) for x in days])).select(F.col("date").alias("decision_date"), fill.alias("fill_date"))
    bad = F.col("fill_date").isNull() | ((F.col("fill_date") > F.to_date(F.lit(end))) if end else F.lit(False))
    order = Window.orderBy("decision_date")
    stop = F.max(bad.cast("int")).over(order)
    return d.withColumn("status", F.when(stop == 0, "kept").otherwise("skipped")).withColumn("decision_idx", F.row_number().over(order) - 1)


def missing_price_stop(schedule: DataFrame, bars: DataFrame) -> DataFrame:
    """schedule whose run also ends at the first kept decision without a bar of any ticker on its decision or fill date."""
    days = bars.select("date").distinct()
    seen = schedule.join(days.select(F.col("date").alias("decision_date"), F.lit(1).alias("_d")), "decision_date", "left").join(days.select(F.col("date").alias("fill_date"), F.lit(1).alias("_f")), "fill_date", "left")
    bad = F.max((F.col("_d").isNull() | F.col("_f").isNull()).cast("int")).over(Window.orderBy("decision_date"))
    return seen.withColumn("status", F.when(bad == 1, "skipped").otherwise(F.col("status"))).select(*schedule.columns)


def eligible_asof(schedule: DataFrame, universe: DataFrame) -> DataFrame:
    """Tickers whose inception is not after the decision; the universe is a small dimension."""
    return schedule.join(universe, schedule["decision_date"] >= universe["inception_date"])


def valid_price(bars: DataFrame, field: str) -> DataFrame:
    c = F.col(field)
    return bars.where(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf")))


def filled_bars(bars: DataFrame) -> DataFrame:
    """(ticker, date, close) for every session from a ticker's first bar on, with its last valid close."""
    grid = sessions(bars).crossJoin(bars.groupBy("ticker").agg(F.min("date").alias("first"))).where("date >= first").drop("first")
    good = valid_price(bars, "close").select("ticker", "date", F.col("close").alias("_c"))
    last = F.last("_c", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date"))
    return grid.join(good, ["ticker", "date"], "left").select("ticker", "date", last.alias("close"))


def _as_number(c: Column, kind: str) -> Column:
    """Dates and times as numbers in their order."""
    return F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, value: str, default=None, parts: int = 32) -> DataFrame:
    """left with the last ``value`` of right at or before left_ts; of equal right timestamps the largest value counts.

    No theta join, and no key is one task: time is cut in ``parts`` ranges of about as many rows
    (percentiles of both sides, one row), and rows are dealt by key and range. The last value
    of a key in each range is summed up on the map side; from those few rows every range gets
    the value that was in force when it began, as a row before all others. With ``parts`` 1
    the key alone deals them. Rows of left without a time get the default, those of right serve none.
    """
    r = right.select(*on, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    lft = left.select(*on, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    both = r.where("_t is not null").unionByName(lft)
    kind = dict(both.dtypes)["_t"]
    if parts > 1:
        number = _as_number(F.col("_t"), kind)
        cuts = both.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
        later = [(number > x).cast("int") for x in sorted(set(cuts))]
        both = both.withColumn("_part", F.coalesce(sum(later, F.lit(0)), F.lit(-1)))
        ends = both.where("_side = 0 and _v is not null").groupBy(*on, "_part").agg(F.max(F.struct("_t", "_v")).alias("_end"))
        until = F.coalesce(F.lead("_part").over(Window.partitionBy(*on).orderBy("_part")), F.lit(len(later)))
        begin = ends.withColumn("_to", until).where("_to > _part").select(*on, F.explode(F.sequence(F.col("_part") + 1, "_to")).alias("_part"), F.col("_end._v").alias("_v"))
        both = both.unionByName(begin.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    w = Window.partitionBy(*on, *["_part"] * (parts > 1)).orderBy(F.col("_side") >= 0, "_t", "_side", F.col("_v").asc_nulls_first())
    got = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    out = F.col("_v") if default is None else F.coalesce("_v", F.lit(default))
    return got.select("_row.*", out.alias(value))


def snap_date(targets: DataFrame, available: DataFrame, direction: str = "forward", parts: int = 32) -> DataFrame:
    """(value, snapped): nearest available date not before (forward) or not after (backward); ranges of dates are tasks of their own."""
    if direction == "backward":
        return asof_join(targets.withColumn("_k", F.lit(1)), available.select(F.lit(1).alias("_k"), "date", F.col("date").alias("snapped")), ["_k"], "value", "date", "snapped", parts=parts).drop("_k")
    t = targets.select("value", (-F.unix_date("value")).alias("_n"), F.lit(1).alias("_k"))
    a = available.select(F.lit(1).alias("_k"), (-F.unix_date("date")).alias("_m"), F.col("date").alias("snapped"))
    return asof_join(t, a, ["_k"], "_n", "_m", "snapped", parts=parts).select("value", "snapped")

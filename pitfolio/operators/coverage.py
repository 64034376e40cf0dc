"""Coverage of bars: complete rows, spans, gaps and usable bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.bars import FIELDS


def complete_bars(bars: DataFrame) -> DataFrame:
    """Rows with all fields, prices above zero."""
    return bars.dropna(subset=list(FIELDS)).where("open > 0 and high > 0 and low > 0 and close > 0")


def ticker_coverage(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, first_date, last_date, observations, gap_count (sessions in the span without a bar), missing_fields, checksum.

    Spans count complete rows; a ticker without one has null dates and 0 observations. The
    checksum does not hang on the order of rows.
    """
    ok = F.lit(True)
    for f in FIELDS:
        ok = ok & F.col(f).isNotNull() & ((F.col(f) > 0) if f != "volume" else F.lit(True))
    day = F.when(ok, F.col("date"))
    missing = F.array_compact(F.array(*[F.when(F.count(f) == 0, F.lit(f)) for f in FIELDS]))
    span = bars.groupBy("ticker").agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.countDistinct(day).alias("observations"), missing.alias("missing_fields"), F.sum(F.xxhash64("date", *FIELDS).cast("decimal(38,0)")).cast("string").alias("checksum"))
    place = calendar.select(F.col("date").alias("_d"), F.row_number().over(Window.orderBy("date")).alias("_p"))
    lo, hi = place.select(F.col("_d").alias("first_date"), F.col("_p").alias("_lo")), place.select(F.col("_d").alias("last_date"), F.col("_p").alias("_hi"))
    gaps = F.col("_hi") - F.col("_lo") + 1 - F.col("observations")
    return span.join(lo, "first_date", "left").join(hi, "last_date", "left").select("ticker", "first_date", "last_date", "observations", gaps.alias("gap_count"), "missing_fields", "checksum")


def coverage_bounds(bars: DataFrame, policy: str = "dynamic", proxy: str = "SPY", minimum_observations: int = 1) -> DataFrame:
    """One row (usable_start, usable_end): dynamic from the proxy's and earliest start, common from the latest.

    The first ticker by name stands in for a proxy that is not there; a proxy that is there
    but has too few complete rows gives no bounds.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    valid = complete_bars(bars).select("ticker", "date").distinct().withColumn("k", F.row_number().over(w))
    per = valid.groupBy("ticker").agg(F.min(F.when(F.col("k") == minimum_observations, F.col("date"))).alias("start"), F.max("date").alias("end"))
    there = F.max((F.col("ticker") == proxy).cast("int")) == 1
    own = F.when(there, F.max(F.when(F.col("ticker") == proxy, F.col("start")))).otherwise(F.min_by("start", "ticker"))
    start = F.when(own.isNotNull(), F.greatest(own, F.min("start"))) if policy == "dynamic" else F.when(F.count("start") == F.count("*"), F.max("start"))
    out = per.agg(start.alias("usable_start"), F.min("end").alias("usable_end"))
    ok = F.col("usable_start") <= F.col("usable_end")
    return out.select(F.when(ok, F.col("usable_start")).alias("usable_start"), F.when(ok, F.col("usable_end")).alias("usable_end"))


def coverage_from_files(spark: SparkSession, path: str, tickers: list[str], **bounds) -> tuple[DataFrame, DataFrame]:
    """(ticker coverage, bounds) of cached files; unreadable files are passed over, of equal rows the last file counts."""
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"
    raw = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path).where(F.col("ticker").isin(tickers))
    last = Window.partitionBy("ticker", "date").orderBy(F.desc("_file"))
    bars = raw.withColumn("_file", F.col("_metadata.file_name")).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_file")
    return ticker_coverage(bars, bars.select("date").distinct()), coverage_bounds(bars, **bounds)


def coverage_gate(coverage: DataFrame, bounds: DataFrame, start: str, end: str, minimum: int = 64) -> DataFrame:
    """One row: accepted, start, end (clamped to the bounds), gaps, least_observations."""
    c = coverage.agg(F.coalesce(F.sum("gap_count"), F.lit(0)).alias("gaps"), F.min("observations").alias("least_observations"))
    both = bounds.crossJoin(c)  # one row each
    lo, hi = F.greatest("usable_start", F.to_date(F.lit(start))), F.least("usable_end", F.to_date(F.lit(end)))
    ok = F.col("usable_start").isNotNull() & (F.col("least_observations") >= minimum) & (F.col("gaps") == 0) & (lo <= hi)
    return both.select(F.coalesce(ok, F.lit(False)).alias("accepted"), F.when(F.col("usable_start").isNotNull(), lo).alias("start"), F.when(F.col("usable_end").isNotNull(), hi).alias("end"), "gaps", "least_observations")


def mark_check(positions: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    """Held positions without a valid mark: those rows of ``positions`` (.., shares) that no row of ``marks`` (.., price) serves."""
    good = marks.where("price > 0 and price < double('infinity')").select(*on).distinct()
    return positions.where("abs(shares) > 1e-12").join(good, on, "left_anti")


def reconciliation(totals: DataFrame, positions: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    """(on, residual): total less cash and marked shares. totals: on, cash, total; positions: on, ticker, shares; marks: on, ticker, price."""
    value = positions.join(marks, [*on, "ticker"]).groupBy(*on).agg(F.sum(F.col("shares") * F.col("price")).alias("marked"))
    return totals.join(value, on, "left").select(*on, (F.col("total") - F.col("cash") - F.coalesce("marked", F.lit(0.0))).alias("residual"))

"""Trailing features of price series, all over one sort by ticker and date.

A feature needs its whole window: rows with fewer observations are null, and
``base_features`` and ``expanded_features`` keep complete rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def series():
    return Window.partitionBy("ticker").orderBy("date")


def _over(n: int):
    return series().rowsBetween(-(n - 1), 0)


def _full(value: Column, of: str, n: int) -> Column:
    return F.when(F.count(of).over(_over(n)) == n, value)


def ret(n: int) -> Column:
    return F.col("close") / F.lag("close", n).over(series()) - 1


def vol(n: int) -> Column:
    return _full(F.stddev_samp("r1").over(_over(n)), "r1", n)


def drawdown(n: int) -> Column:
    return _full(F.col("close") / F.max("close").over(_over(n)) - 1, "close", n)


def ma_ratio(n: int) -> Column:
    mean = F.avg("close").over(_over(n))
    return _full(F.when(mean == 0, 0.0).otherwise(F.col("close") / mean), "close", n)


def atr_proxy(n: int) -> Column:
    return _full(F.avg(F.col("high") - F.col("low")).over(_over(n)) / F.col("close"), "close", n)


def volume_z(n: int) -> Column:
    sd = F.stddev_samp("volume").over(_over(n))
    return _full(F.when(sd == 0, 0.0).otherwise((F.col("volume") - F.avg("volume").over(_over(n))) / sd), "volume", n)


def rsi(n: int) -> Column:
    gain = F.avg(F.greatest("d1", F.lit(0.0))).over(_over(n))
    loss = F.avg(F.greatest(-F.col("d1"), F.lit(0.0))).over(_over(n))
    return _full(F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)), "d1", n)


def trend_slope(n: int) -> Column:
    """Slope of ln(close) on its place; null if a close in the window is not above zero."""
    good = F.when(F.col("close") > 0, F.ln("close"))
    return F.when(F.count(good).over(_over(n)) == n, F.regr_slope(good, F.col("rn").cast("double")).over(_over(n)))


def moving_average(n: int) -> Column:
    return _full(F.avg("close").over(_over(n)), "close", n)


def prepared(bars: DataFrame) -> DataFrame:
    """bars with daily return r1, daily change d1 and place rn."""
    return bars.withColumn("rn", F.row_number().over(series())).withColumn("d1", F.col("close") - F.lag("close", 1).over(series())).withColumn("r1", ret(1))


BASE = {
    "ret_5": lambda: ret(5), "ret_10": lambda: ret(10), "ret_21": lambda: ret(21), "ret_63": lambda: ret(63),
    "vol_21": lambda: vol(21), "vol_63": lambda: vol(63), "drawdown_63": lambda: drawdown(63),
    "ma_ratio_21": lambda: ma_ratio(21), "ma_ratio_63": lambda: ma_ratio(63), "atr_21": lambda: atr_proxy(21), "volume_z_63": lambda: volume_z(63),
}
EXPANDED = {
    "ret_126": lambda: ret(126), "vol_126": lambda: vol(126), "ma_ratio_126": lambda: ma_ratio(126),
    "rsi_14": lambda: rsi(14), "rsi_63": lambda: rsi(63), "trend_slope_63": lambda: trend_slope(63),
}


def base_features(bars: DataFrame) -> DataFrame:
    """ticker, date and the eleven base features where all of them exist (65 closes)."""
    out = prepared(bars).select("ticker", "date", "rn", *[f().alias(n) for n, f in BASE.items()])
    return out.where("rn >= 65").drop("rn").dropna()


def expanded_features(bars: DataFrame) -> DataFrame:
    """Base features and six more (127 closes)."""
    out = prepared(bars).select("ticker", "date", "rn", *[f().alias(n) for n, f in (BASE | EXPANDED).items()])
    return out.where("rn >= 127").drop("rn").dropna()


def moving_averages(bars: DataFrame, fast: int = 20, slow: int = 100) -> DataFrame:
    """ticker, date, fast_ma, slow_ma, signal where the slow window is full."""
    mean = lambda n: F.avg("close").over(_over(n))
    out = bars.select("ticker", "date", F.count("close").over(_over(slow)).alias("n"), mean(fast).alias("fast_ma"), mean(slow).alias("slow_ma"))
    return out.where(F.col("n") == slow).select("ticker", "date", "fast_ma", "slow_ma", (F.col("fast_ma") > F.col("slow_ma")).alias("signal"))


def _merged(a: Column, b: Column) -> Column:
    """The segment a and the later segment b as one: highest, lowest, worst fall from an earlier to a later value."""
    both = F.struct(F.greatest(a["high"], b["high"]).alias("high"), F.least(a["low"], b["low"]).alias("low"), F.least(a["fall"], b["fall"], b["low"] / a["high"] - 1).alias("fall"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def sliding_drawdown(df: DataFrame, over, value: str, n: int, name: str) -> DataFrame:
    """df with ``name``: the worst fall from an earlier to a later value within the last n rows (fewer at the start), at most 0.

    over: a window with an order. Segments of 1, 2, 4, .. rows that end at each row are merged
    from two of half the length; those whose lengths add up to n give the window, earliest
    first. All of it is lags over one sort: n log n for all rows, no arrays.
    """
    x = F.col(value).cast("double")
    df = df.withColumn("_s0", F.when(x.isNotNull(), F.struct(x.alias("high"), x.alias("low"), F.lit(0.0).alias("fall"))))
    for k in range(1, n.bit_length()):
        df = df.withColumn(f"_s{k}", _merged(F.lag(f"_s{k - 1}", 1 << (k - 1)).over(over), F.col(f"_s{k - 1}")))
    at, parts = 0, []
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            df = df.withColumn(f"_p{k}", F.lag(f"_s{k}", at).over(over) if at else F.col(f"_s{k}"))
            at += 1 << k
            parts.append(f"_p{k}")
    for later, earlier in zip(parts, parts[1:], strict=False):
        df = df.withColumn(earlier, _merged(F.col(earlier), F.col(later)))
    return df.withColumn(name, F.col(parts[-1])["fall"]).drop(*parts, *[f"_s{k}" for k in range(n.bit_length())])


def market_regime(bars: DataFrame, proxy: str | None = None, up: float = 0.03, calm: float = 0.18, stress: float = -0.12) -> DataFrame:
    """date, return_63, annual_vol_21, drawdown_63 (worst within the window), market_regime of one proxy (the first ticker if not given)."""
    one = bars.where(F.col("ticker") == proxy) if proxy else bars.join(bars.agg(F.min("ticker").alias("ticker")), "ticker")
    p = sliding_drawdown(prepared(one), series(), "close", 63, "drawdown_63")
    p = p.select("date", "rn", "drawdown_63", ret(63).alias("return_63"), (vol(21) * F.sqrt(F.lit(252.0))).alias("annual_vol_21"))
    trend = F.when(F.col("return_63") > up, "UP").when(F.col("return_63") < -up, "DOWN").otherwise("SIDE")
    level = F.when(F.col("annual_vol_21") < calm, "LOWVOL").otherwise("HIGHVOL")
    name = F.concat(trend, F.lit("_"), level, F.when(F.col("drawdown_63") <= stress, "_STRESS").otherwise(""))
    return p.select("date", "return_63", "annual_vol_21", "drawdown_63", F.when(F.col("rn") < 64, "UNKNOWN").otherwise(name).alias("market_regime"))


def level_change_features(series: DataFrame, dates: DataFrame, lags: tuple[int, int] = (21, 63)) -> DataFrame:
    """dates (date) x series: level and its change over two lags of observations, as known on the date; 0 where nothing is.

    series: series, date, available_date, value (of equal dates the last to be published counts).
    An observation is known from its available_date; changes count observations back in order of date.
    """
    from .calendar import asof_join

    one = Window.partitionBy("series", "date").orderBy(F.desc("available_date"), F.desc("value"))
    s = series.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    by = Window.partitionBy("series").orderBy("date")
    change = lambda n: F.col("value") / F.lag("value", n).over(by) - 1
    s = s.select("series", "available_date", F.struct(F.col("date").alias("d"), F.col("value").alias("level"), F.coalesce(change(lags[0]), F.lit(0.0)).alias("a"), F.coalesce(change(lags[1]), F.lit(0.0)).alias("b")).alias("f"))
    ask = dates.select("date").crossJoin(s.select("series").distinct())  # a handful of series
    got = asof_join(ask, s, ["series"], "date", "available_date", "f", parts=1)  # one row a decision and series
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0.0))
    return got.select("series", "date", zero("level").alias("level"), zero("a").alias(f"change_{lags[0]}"), zero("b").alias(f"change_{lags[1]}"))


def merge_series(parts: dict[str, DataFrame]) -> DataFrame:
    """One row a date with a column for each series (date, value), null where a series has none."""
    long = None
    for name, df in parts.items():
        one = df.select("date", F.lit(name).alias("series"), "value")
        long = one if long is None else long.unionByName(one)
    return long.groupBy("date").pivot("series", list(parts)).agg(F.max("value"))


def bridged_features(features: DataFrame, bridge: DataFrame, slots: tuple[str, ...] = ("kw1", "kw2")) -> DataFrame:
    """ticker, date and, for each slot, the features of the series that the ticker names there; 0 where it names none or none is known.

    features: series, date and numbers (``level_change_features``). bridge: ticker and a column
    with a series for each slot. The bridge is a small dimension: one row a ticker.
    """
    numbers = [c for c in features.columns if c not in ("series", "date")]
    wanted = bridge.select("ticker", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("series")) for s in slots])).alias("x")).select("ticker", "x.*")
    # Every ticker has rows on all dates, those without a known series as well.
    named = wanted.join(features, "series").groupBy("ticker", "date").agg(*[F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{s}_{c}") for s in slots for c in numbers])
    grid = features.select("date").distinct().crossJoin(bridge.select("ticker"))
    return grid.join(named, ["ticker", "date"], "left").na.fill(0.0)

"""Price bars from trades, price files, universes and checksums.

Bars are long: ticker, date, open, high, low, close, volume (one row a ticker and day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bars_from_trades(trades: DataFrame, key: str, ts: str, price: Column, quantity: Column, order: list[str]) -> DataFrame:
    """Trades to daily bars: first, highest, lowest, last price and summed quantity."""
    t = trades.select(F.col(key).alias("ticker"), F.to_date(ts).alias("date"), price.alias("p"), quantity.alias("q"), *order)
    at = F.struct(*order, "p")
    return t.groupBy("ticker", "date").agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.sum("q").alias("volume"), F.sum(F.col("p") * F.col("q")).alias("notional")
    )


def smooth_close(bars: DataFrame, rows: int = 60) -> DataFrame:
    """bars with close replaced by the trailing volume-weighted price."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(rows - 1), 0)
    return bars.withColumn("close", F.sum("notional").over(w) / F.sum("volume").over(w))


def market_trades(spark: SparkSession, sf_dir: str, key: str = "p_type") -> DataFrame:
    """Line items with a part attribute as trades of that ticker."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice").where("l_quantity > 0")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), key)
    return items.join(part, "l_partkey")


def market(spark: SparkSession, sf_dir: str, key: str = "p_type") -> DataFrame:
    """Bars of the line items by a part attribute, with the smoothed close."""
    return smooth_close(bars_from_trades(market_trades(spark, sf_dir, key), key, "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), ["l_orderkey", "l_linenumber"]))


def market_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of market's bars, straight from the trades."""
    return market_trades(spark, sf_dir).select(F.to_date("l_shipdate").alias("date")).distinct()


def read_bars(spark: SparkSession, path: str, tickers: list[str], start: str, end: str) -> DataFrame:
    """Bars from Parquet files, clipped to [start, end]; of equal (ticker, date) the last file by name counts."""
    raw = spark.read.parquet(path).where(F.col("ticker").isin(tickers)).where(F.col("date").between(start, end))
    last = Window.partitionBy("ticker", "date").orderBy(F.desc("_file"))
    out = raw.withColumn("_file", F.col("_metadata.file_name")).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_file")
    found = {r.ticker for r in out.select("ticker").distinct().collect()}  # at most the tickers asked for
    if set(tickers) - found:
        raise ValueError(f"no bars in range for {sorted(set(tickers) - found)}")
    return out


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name, inception_date, universe_order) from {"etfs": [...]}; duplicates are an error."""
    raw = spark.read.json(path, multiLine=True).select(F.posexplode("etfs").alias("universe_order", "e"))
    out = raw.select("e.ticker", "e.name", F.to_date("e.inception_date").alias("inception_date"), "universe_order")
    bad = out.where("ticker is null or name is null or inception_date is null").limit(1).count()
    twice = out.groupBy("ticker").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("universe has missing fields or duplicate tickers")
    return out


def normalize_bars(wide: DataFrame) -> DataFrame:
    """Wide columns named ticker_field or field_ticker, one row a date, to long bars."""
    found = []
    for c in wide.columns:  # a ticker may hold the separator itself
        for f in FIELDS:
            if c.lower().endswith(f"_{f}"):
                found.append((c, c[: -len(f) - 1], f))
            elif c.lower().startswith(f"{f}_"):
                found.append((c, c[len(f) + 1 :], f))
    long = wide.unpivot("date", [c for c, _, _ in found], "_c", "_v")
    names = F.create_map(*[F.lit(x) for c, t, f in found for x in (c, f"{t}\0{f}")])
    parts = F.split(names[F.col("_c")], "\0")
    return long.select("date", parts[0].alias("ticker"), parts[1].alias("_f"), "_v").groupBy("ticker", "date").pivot("_f", list(FIELDS)).agg(F.first("_v"))


def frame_checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: row count and an order-independent hash of the rows."""
    cols = columns or df.columns
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("checksum"))


def boundary_hash(df: DataFrame, order: str) -> DataFrame:
    """One row: hash of column names, types and the first and last row by ``order``."""
    row = F.to_json(F.struct(*df.columns))
    head = ",".join(f"{n}:{t}" for n, t in df.dtypes)
    return df.agg(F.md5(F.concat_ws("|", F.lit(head), F.min_by(row, order), F.max_by(row, order))).alias("hash"))

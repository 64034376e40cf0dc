"""Cached price files as a Spark data source: a partition a file, files pruned by ticker and dates.

Files are named ticker_start_end.parquet and hold one ticker's wide rows: a date (column or
stored index) and open, high, low, close, volume in any case. ``spark.dataSource.register``
makes the format ``price_files`` known; ``cached_bars`` reads it with the semantics of a cache.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bars import FIELDS

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double, file string"
#: The ticker may hold the separator itself; the two dates are what ends a name.
_NAME = re.compile(r"(?P<ticker>.+)_(?P<start>\d{4}-\d{2}-\d{2})_(?P<end>\d{4}-\d{2}-\d{2})\.parquet")


class PriceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "price_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    """tickers: those asked for (none: all); first, last: the dates asked for."""

    def __init__(self, path: str):
        self.path, self.tickers, self.first, self.last = path, None, dt.date.min, dt.date.max

    def _files(self):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return store, at

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ticker",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = asked if self.tickers is None else self.tickers & asked
                continue  # a file is one ticker's, so nothing is left to test
            if getattr(f, "attribute", None) == ("date",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last = min(self.last, f.value)
            yield f  # rows of a file are tested by Spark

    def partitions(self):
        from pyarrow import fs

        store, at = self._files()
        out = []
        for f in store.get_file_info(fs.FileSelector(at)):
            name = _NAME.fullmatch(f.base_name)
            if name and (self.tickers is None or name["ticker"] in self.tickers) and dt.date.fromisoformat(name["start"]) <= self.last and dt.date.fromisoformat(name["end"]) >= self.first:
                out.append(InputPartition((f.path, f.base_name, name["ticker"])))
        return out

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.parquet as pq

        if partition is None:
            return
        path, name, ticker = partition.value
        store, _ = self._files()
        for batch in pq.ParquetFile(store.open_input_file(path)).iter_batches():
            by = {c.lower(): batch.column(i) for i, c in enumerate(batch.schema.names)}
            date = by.get("date", by.get("__index_level_0__"))
            n = batch.num_rows
            cols = [pa.array([ticker] * n), date.cast(pa.timestamp("us") if pa.types.is_timestamp(date.type) else date.type, safe=False).cast(pa.date32(), safe=False)]
            cols += [by[c].cast(pa.float64()) if c in by else pa.nulls(n, pa.float64()) for c in FIELDS]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([name] * n)], names=["ticker", "date", *FIELDS, "file"])


def price_files(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the files under root, with the file's name; filters on ticker and date prune files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PriceFiles)
    return spark.read.format("price_files").load(root)


def cached_bars(spark: SparkSession, root: str, tickers: list[str], start: str, end: str) -> DataFrame:
    """Bars of the tickers within [start, end]; of equal dates the last file by name counts; a ticker without rows is an error."""
    rows = price_files(spark, root).where(F.col("ticker").isin(tickers) & (F.col("date") >= F.to_date(F.lit(start))) & (F.col("date") <= F.to_date(F.lit(end))))
    last = Window.partitionBy("ticker", "date").orderBy(F.desc("file"))
    out = rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "file")
    found = {r.ticker for r in out.select("ticker").distinct().collect()}  # at most the tickers asked for
    if set(tickers) - found:
        raise ValueError(f"no cached bars in range for {sorted(set(tickers) - found)}")
    return out

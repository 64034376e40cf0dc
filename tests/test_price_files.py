"""The price file source: pruned files, the last file's rows, missing tickers."""

import datetime as dt

import pandas as pd
import pytest

from pitfolio.sources import price_files

FIELDS = ["Open", "High", "Low", "Close", "Volume"]


def write(at, ticker, start, end, close, index=True):
    days = pd.bdate_range(start, end)
    t = pd.DataFrame({c: float(close) for c in FIELDS}, index=pd.DatetimeIndex(days, name="Date"))
    (t if index else t.reset_index()).to_parquet(at / f"{ticker}_{start}_{end}.parquet", index=index)


@pytest.fixture
def cache(tmp_path):
    write(tmp_path, "AAA", "2024-01-01", "2024-01-31", 1)
    write(tmp_path, "AAA", "2024-01-15", "2024-02-29", 2)
    write(tmp_path, "AAA", "2023-01-02", "2023-01-31", 3)
    write(tmp_path, "B_C", "2024-01-01", "2024-01-31", 4, index=False)
    (tmp_path / "ZZZ_2024-01-01_2024-01-31.parquet").write_bytes(b"not parquet")
    (tmp_path / "checksums.json").write_text("{}")
    return str(tmp_path)


def test_last_file_counts_and_only_needed_files_are_read(spark, cache):
    got = {(r.ticker, r.date): r.close for r in price_files.cached_bars(spark, cache, ["AAA", "B_C"], "2024-01-10", "2024-02-05").collect()}
    assert got["AAA", dt.date(2024, 1, 12)] == 1.0 and got["AAA", dt.date(2024, 1, 15)] == 2.0 and got["AAA", dt.date(2024, 2, 5)] == 2.0 and got["B_C", dt.date(2024, 1, 31)] == 4.0
    assert min(d for _, d in got) == dt.date(2024, 1, 10) and max(d for _, d in got) == dt.date(2024, 2, 5)
    one = price_files.price_files(spark, cache).where("ticker = 'AAA' and date >= date'2024-01-01'")
    assert one.rdd.getNumPartitions() == 2  # neither the broken file nor last year's is opened
    with pytest.raises(Exception, match="(?i)parquet"):
        price_files.price_files(spark, cache).count()


def test_missing_tickers_are_errors(spark, cache):
    for ticker, start in (("NONE", "2024-01-10"), ("B_C", "2025-01-01")):
        with pytest.raises(ValueError, match=ticker):
            price_files.cached_bars(spark, cache, ["AAA", ticker] if ticker == "NONE" else [ticker], start, "2025-02-01")

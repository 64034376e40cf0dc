"""Live books from a stream of fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

OUT = "portfolio_id string, fill_id long, ticker string, shares double, position double, cash double, accepted boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Book(StatefulProcessor):
    """A portfolio's cash as one value, its positions as a map by ticker: a batch reads and writes only the tickers it fills."""

    def __init__(self, initial: float):
        self.initial = initial

    def init(self, handle) -> None:
        self.cash = handle.getValueState("cash", "cash double")
        self.held = handle.getMapState("held", "ticker string", "shares double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        had = self.cash.get()
        cash = had[0] if had is not None else self.initial  # a book without cash is new: nothing is held, and nothing asked for
        fills = pd.concat(list(rows)).sort_values("fill_id")
        mine, positions, cashes, accepted = {}, [], [], []
        for ticker, shares, flow in zip(fills["ticker"].tolist(), fills["shares"].tolist(), fills["cash_flow"].tolist(), strict=True):
            if ticker not in mine:
                mine[ticker] = self.held.getValue((ticker,))[0] if had is not None and self.held.containsKey((ticker,)) else 0.0
            ok = shares <= 0 or cash + flow >= -1e-9
            if ok:
                cash += flow
                left = mine[ticker] + shares
                mine[ticker] = left if abs(left) >= 1e-12 else 0.0
            positions.append(mine[ticker])
            cashes.append(cash)
            accepted.append(bool(ok))
        for ticker, shares in mine.items():
            if shares:
                self.held.updateValue((ticker,), (float(shares),))
            elif had is not None and self.held.containsKey((ticker,)):
                self.held.removeKey((ticker,))
        self.cash.update((float(cash),))
        yield pd.DataFrame({"portfolio_id": key[0], "fill_id": fills["fill_id"].array, "ticker": fills["ticker"].array, "shares": fills["shares"].array, "position": positions, "cash": cashes, "accepted": accepted})

    def close(self) -> None:
        pass


def ledger_stream(fills: DataFrame, initial: float = 0.0) -> DataFrame:
    """fills (portfolio_id, fill_id, ticker, shares, cash_flow) as a stream to one row a fill: the position and cash after it.

    Fills of a portfolio in a batch are booked in order of fill_id. A buy that would leave
    the cash below -1e-9 is not booked and comes out with accepted false. State is keyed by
    portfolio and ticker: what a batch writes is in proportion to the tickers it fills, and
    a position that is dust leaves the state. Needs the RocksDB state store, which is set for
    the session if none is.
    """
    conf = fills.sparkSession.conf
    if "RocksDB" not in (conf.get(_PROVIDER, None) or ""):
        conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = fills.selectExpr("cast(portfolio_id as string) portfolio_id", "cast(fill_id as long) fill_id", "ticker", "cast(shares as double) shares", "cast(cash_flow as double) cash_flow")
    return rows.groupBy("portfolio_id").transformWithStateInPandas(_Book(initial), OUT, "Append", "None")

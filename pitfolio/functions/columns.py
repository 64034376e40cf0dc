"""Column functions of costs, labels and trees of sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slippage(shares: Column, price: Column, bps: float) -> Column:
    """Cost of trading shares at an adverse price."""
    return F.abs(shares) * price * bps / 1e4


def commission(shares: Column, flat: float) -> Column:
    """A flat fee for an order that trades at all."""
    return F.when(shares != 0, F.lit(float(flat))).otherwise(0.0)


def fill_price(shares: Column, price: Column, bps: float) -> Column:
    """Price of a fill: above for purchases, below for sales."""
    return price * (1 + F.signum(shares) * bps / 1e4)


def log_vol_label(vol: Column) -> Column:
    """Volatility as a label of regressions; null stays null (greatest alone would pass it over)."""
    return F.when(vol.isNotNull(), F.ln(F.greatest(vol, F.lit(0.0)) + 1e-8))


def vol_of_label(label: Column) -> Column:
    """The inverse, never below 0; null stays null."""
    return F.when(label.isNotNull(), F.greatest(F.exp(label) - 1e-8, F.lit(0.0)))

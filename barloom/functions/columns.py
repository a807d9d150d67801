"""Column functions shared by the operators. Times are epoch seconds or microseconds (long), free of any session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def seconds(ts: str) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def adverse_price(price: Column, side: Column, slip: float) -> Column:
    """A buy pays slip more, a sale gets slip less; null where slippage uses up a positive price. A price that is not positive by itself is for the validation of ticks to refuse."""
    worse = F.when(side == "buy", price * (1 + slip)).otherwise(price * (1 - slip))
    return F.when((worse > 0) | (price <= 0), worse)


def executable_price(side: Column, bid: Column, ask: Column, reference: Column, fallback: float, multiplier: float = 1.0) -> Column:
    """Quote midpoint and half the spread times multiplier; without a quote the reference and half the fallback spread."""
    half = F.coalesce((ask - bid) / 2 * multiplier, F.lit(fallback / 2))
    middle = F.coalesce((ask + bid) / 2, reference)
    return F.when(side == "buy", middle + half).otherwise(middle - half)


def commission(quantity: Column, price: Column, per_unit: float, rate: float, least: float) -> Column:
    return F.greatest(quantity * per_unit + quantity * price * rate, F.lit(least))


def session_open(t: Column) -> Column:
    """The forex week in UTC: closed from Friday 22:00 to Sunday 22:00. t: epoch seconds."""
    of_week = F.pmod(t - 259_200, F.lit(604_800))  # seconds since Sunday 00:00
    return (of_week >= 22 * 3600) & (of_week < 5 * 86_400 + 22 * 3600)


def rounded(c: Column) -> Column:
    return F.round(c, 6)

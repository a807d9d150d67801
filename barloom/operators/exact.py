"""Exact money: cash, average-cost positions and closed trades in decimals.

Cash is a running sum of exact products. An average cost is no sum: each addition rounds it, so it has to be walked. The walk
is cut where it starts anew: exact running sums of quantities tell where a position is opened from nothing or turned round,
and each stretch between such points (a run) is walked by itself, in order, with three numbers as its state. A task streams the sorted
fills of its runs and never holds a run, however long it is.

Quantities have 6 decimals, prices and fees 8; averages and shares of fees are rounded half to even to 12 decimals,
everything else is exact. Defined cases: a null quantity, price or fee fails the cast's check and raises in the walk;
fills of the same time are taken by fill_id; a quantity of 0 changes nothing and closes nothing.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OF = ["account", "symbol"]
QUANTITY, PRICE, FLOW = "decimal(16,6)", "decimal(18,8)", "decimal(38,14)"
STEPS = "account long, symbol string, fill_id long, opens boolean, size decimal(26,6), entry_price decimal(38,12), average_price decimal(38,12), gross decimal(36,18), entry_fees decimal(30,12), exit_fee decimal(30,12)"

NAMES = ["account", "symbol", "fill_id", "opens", "size", "entry_price", "average_price", "gross", "entry_fees", "exit_fee"]


def exact_fills(fills: DataFrame) -> DataFrame:
    """fills (fill_id, account, symbol, side, quantity, price, fee, t) as decimals."""
    return fills.withColumns({"quantity": F.col("quantity").cast(QUANTITY), "price": F.col("price").cast(PRICE), "fee": F.col("fee").cast(PRICE)})


def exact_cash(fills: DataFrame, start: DataFrame) -> DataFrame:
    """Cash before and after each fill of an account; start: account, cash (decimal)."""
    w = Window.partitionBy("account").orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    value = (F.col("quantity") * F.col("price")).cast(FLOW)
    flow = (F.when(F.col("side") == "buy", -value).otherwise(value) - F.col("fee").cast(FLOW)).cast(FLOW)
    rows = fills.join(start.select("account", F.col("cash").cast(FLOW).alias("cash")), "account").withColumn("flow", flow)
    rows = rows.withColumn("after", (F.col("cash") + F.sum("flow").over(w).cast(FLOW)).cast(FLOW)).withColumn("fees", F.sum("fee").over(w).cast(FLOW))
    return rows.select("account", "fill_id", (F.col("after") - F.col("flow")).cast(FLOW).alias("cash_before"), F.col("after").alias("cash_after"), "fees", (F.col("after") < 0).alias("insufficient"))


def pieces(fills: DataFrame) -> DataFrame:
    """The parts of fills by run: what a fill takes from the old position, and what it adds to or opens; one that turns a position round has both."""
    w = Window.partitionBy(*OF).orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    signed = F.when(c("side") == "buy", c("quantity")).otherwise(-c("quantity")).cast(QUANTITY)
    rows = fills.withColumn("signed", signed).withColumn("position", F.sum("signed").over(w).cast("decimal(26,6)"))
    rows = rows.withColumn("old", (c("position") - c("signed")).cast("decimal(26,6)"))
    opposite = lambda a, b: F.signum(c(a)) * F.signum(c(b)) < 0
    turned, closes = opposite("old", "position"), opposite("old", "signed")
    rows = rows.withColumn("run", F.sum((turned | (c("old") == 0)).cast("long")).over(w))
    size = lambda x: x.cast("decimal(26,6)").alias("size")
    closing = F.when(closes, F.struct((c("run") - turned.cast("long")).alias("run"), F.lit(False).alias("opens"), size(F.least(F.abs("old"), F.abs("signed")))))
    opening = F.when(~closes, F.struct(c("run").alias("run"), F.lit(True).alias("opens"), size(F.abs("signed")))).when(turned, F.struct(c("run").alias("run"), F.lit(True).alias("opens"), size(F.abs("position"))))
    each = rows.withColumn("piece", F.explode(F.array_compact(F.array(closing, opening))))
    return each.select(*OF, "piece.run", "t", "fill_id", "piece.opens", "piece.size", (c("old") > 0).alias("long"), "quantity", "price", "fee")


def halved(a: int, b: int) -> int:
    """a / b for b > 0, half to even."""
    q, r = divmod(a, b)
    return q + (2 * r > b or 2 * r == b and q % 2 == 1)


def walked(steps: DataFrame) -> DataFrame:
    """Each piece with the average after it and, where it closes, entry price, gross result and shares of fees."""

    def run(batches):
        at, held, average, fees = None, 0, 0, 0  # held in 10^-6, average and fees in 10^-12
        whole = lambda x, places: int(x.scaleb(places))
        money = lambda x, places=12: None if x is None else Decimal(x).scaleb(-places)
        types = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.decimal128(26, 6), *[pa.decimal128(38, 12)] * 2, pa.decimal128(36, 18), *[pa.decimal128(30, 12)] * 2]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (r["account"], r["symbol"], r["run"])
                if key != at:
                    at, held, average, fees = key, 0, 0, 0
                size, quantity, price = whole(r["size"], 6), whole(r["quantity"], 6), whole(r["price"], 12)
                share = halved(whole(r["fee"], 12) * size, quantity) if quantity else 0
                if r["opens"]:
                    if held + size:
                        average = halved(average * held + price * size, held + size)
                    held, fees = held + size, fees + share
                    told = (None, average, None, None, None)
                else:
                    paid = halved(fees * size, held)
                    gross = (price - average) * size * (1 if r["long"] else -1)
                    entry = average
                    held, fees = held - size, fees - paid
                    told = (entry, average if held else None, gross, paid, share)
                out.append((r["account"], r["symbol"], r["fill_id"], r["opens"], r["size"], money(told[0]), money(told[1]), money(told[2], 18), money(told[3]), money(told[4])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], NAMES)

    ordered = steps.repartition(*OF, "run").sortWithinPartitions(*OF, "run", "t", "fill_id")
    return ordered.mapInArrow(run, STEPS)


def exact_positions(fills: DataFrame) -> DataFrame:
    """Each fill with average_price after it (null when flat) and what it closes: closed_quantity, entry_price, gross, fees, net (null where nothing)."""
    c = F.col
    close, open_ = F.when(~c("opens"), True), F.when(c("opens"), True)
    rows = walked(pieces(fills)).groupBy(*OF, "fill_id").agg(
        F.coalesce(F.max(F.when(open_, c("average_price"))), F.max(F.when(close, c("average_price")))).alias("average_price"), F.max(F.when(close, c("size"))).alias("closed_quantity"),
        F.max("entry_price").alias("entry_price"), F.max("gross").alias("gross"), F.max(c("entry_fees") + c("exit_fee")).alias("fees"),
    )
    return rows.withColumn("net", c("gross") - c("fees").cast("decimal(36,18)"))


def exact_trades(positions: DataFrame) -> DataFrame:
    """The fills that close something, as trades."""
    return positions.where("closed_quantity is not null").select(*OF, "fill_id", F.col("closed_quantity").alias("quantity"), "entry_price", "gross", "fees", "net")

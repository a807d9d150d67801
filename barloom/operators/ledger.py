"""Average-cost positions, closed trades, marks and drawdowns, as windows over the fills of an account and symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import DAY, nearest, touches

OF = ["account", "symbol"]


#: A run is cut where what stays of an average has fallen by so many powers of e: what came before weighs nothing.
CUT = 300.0


def running_averages(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Averages of values a unit over a position, after each fill (columns old, position, signed, run, ordered by t, fill_id).

    An addition makes average' = r average + (1 - r) value with r = old / new, anything else keeps it; a run begins with
    its first value. With R the running product of r, average = R * sum((1 - r) value / R). The product would vanish in
    a run that never goes flat, so runs are cut into pieces by the running sum of ln r; a piece starts from the
    average at the end of the piece before, which its own product makes exact to far below a double's precision.
    """
    opens = (F.col("old") == 0) | (F.col("old") * F.col("position") < 0)
    adds = F.col("old") * F.col("signed") > 0
    run = Window.partitionBy(*OF, "run").orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    stays = F.when(opens, 0.0).when(adds, F.abs("old") / F.abs("position")).otherwise(F.lit(1.0))
    rows = rows.withColumn("_r", stays).withColumn("_piece", F.floor(-F.sum(F.when(F.col("_r") > 0, F.ln("_r")).otherwise(0.0)).over(run) / CUT))
    piece = Window.partitionBy(*OF, "run", "_piece").orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_whole", F.product(F.when(F.col("_r") > 0, F.col("_r")).otherwise(1.0)).over(piece))
    ends = Window.partitionBy(*OF, "run").orderBy("_piece")
    for name, value in values.items():
        rows = rows.withColumn(f"_{name}", F.col("_whole") * F.sum((1 - F.col("_r")) * value / F.col("_whole")).over(piece))
    last = rows.groupBy(*OF, "run", "_piece").agg(*[F.max_by(f"_{n}", F.struct("t", "fill_id")).alias(f"_end_{n}") for n in values])
    last = last.select(*OF, "run", "_piece", *[F.coalesce(F.lag(f"_end_{n}").over(ends), F.lit(0.0)).alias(f"_from_{n}") for n in values])
    rows = rows.join(last, [*OF, "run", "_piece"])
    rows = rows.withColumns({n: F.col(f"_{n}") + F.col("_whole") * F.col(f"_from_{n}") for n in values})
    return rows.drop("_r", "_whole", "_piece", *[f"_{n}" for n in values], *[f"_from_{n}" for n in values])


def position_ledger(fills: DataFrame) -> DataFrame:
    """Each fill with position, average_price after it and the trade that it closes (null where none), with its share of entry and exit fees.

    Quantities are running sums; averages of prices and of entry fees a unit are prefix scans, so no row waits for
    another row's average. A run starts when a position is opened from nothing or turned round."""
    w = Window.partitionBy(*OF).orderBy("t", "fill_id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    rows = fills.withColumn("signed", signed).withColumn("position", F.sum("signed").over(up)).withColumn("old", F.col("position") - F.col("signed"))
    opens = (F.col("old") == 0) | (F.col("old") * F.col("position") < 0)
    closes = F.col("old") * F.col("signed") < 0
    rows = rows.withColumn("run", F.sum(opens.cast("int")).over(up))
    rows = rows.withColumn("opened", F.min("t").over(Window.partitionBy(*OF, "run").orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)))
    rows = running_averages(rows, {"average": F.col("price"), "entry_fee": F.try_divide(F.col("fee"), F.col("quantity"))})
    rows = rows.withColumns({"entry": F.lag("average").over(w), "entered": F.lag("opened").over(w), "paid": F.lag("entry_fee").over(w)})
    size = F.when(closes, F.least(F.abs("old"), F.abs("signed")))
    return rows.select(
        *OF, "fill_id", "t", "position", F.when(F.col("position") != 0, F.col("average")).alias("average_price"), size.alias("closed_quantity"), F.when(closes, F.col("entry")).alias("entry_price"),
        F.when(closes, F.col("price")).alias("exit_price"), (size * (F.col("price") - F.col("entry")) * F.signum("old")).alias("realized"),
        F.when(closes, F.col("t") - F.col("entered")).alias("held"), F.when(closes, F.when(F.col("old") > 0, "buy").otherwise("sell")).alias("entry_side"),
        (size * F.col("paid")).alias("entry_fees"), F.coalesce(F.col("fee") * F.try_divide(size, F.col("quantity")), F.lit(0.0)).alias("exit_fee"),
    )


def closed_trades(ledger: DataFrame) -> DataFrame:
    """One row a fill that closes something, with gross and net result; fees are the shares of the entries' and of the closing fill's fees."""
    rows = ledger.where("closed_quantity is not null").withColumn("fees", F.col("entry_fees") + F.col("exit_fee"))
    return rows.select(*OF, "fill_id", F.col("entry_side").alias("side"), F.col("closed_quantity").alias("quantity"), "entry_price", "exit_price", F.col("realized").alias("gross_pnl"), "fees", (F.col("realized") - F.col("fees")).alias("net_pnl"), F.col("held").alias("held_seconds"))


def mark_to_market(ledger: DataFrame, closes: DataFrame) -> DataFrame:
    """Value and open result of each position after a fill at the newest close (symbol, t) of its day or of a day before; null before the first close."""
    rows = nearest(ledger.withColumn("day", F.floor(F.col("t") / DAY) * DAY), closes.select("symbol", F.col("t").alias("day"), F.col("close").alias("mark")), at="day", block=30 * DAY)
    mark = F.col("found.mark")
    open_ = F.when(F.col("position") == 0, 0.0).otherwise((mark - F.col("average_price")) * F.col("position"))
    return rows.select(*OF, "fill_id", (F.col("position") * mark).alias("market_value"), open_.alias("unrealized"))


def exposure_totals(marks: DataFrame, by: list[str]) -> DataFrame:
    v = F.col("market_value")
    return marks.groupBy(*by).agg(
        F.sum(F.abs(v)).alias("gross"), F.sum(v).alias("net"), F.sum(F.greatest(v, F.lit(0.0))).alias("long"), F.sum(F.greatest(-v, F.lit(0.0))).alias("short"), F.count_if(v != 0).alias("open_positions")
    )


def last_positions(marks: DataFrame, ledger: DataFrame) -> DataFrame:
    """The newest mark of each account and symbol."""
    at = ledger.select("fill_id", "t")
    return marks.join(at, "fill_id").groupBy(*OF).agg(F.max_by("market_value", F.struct("t", "fill_id")).alias("market_value"), F.max_by("unrealized", F.struct("t", "fill_id")).alias("unrealized"))


def drawdown_segments(equity: DataFrame) -> DataFrame:
    """Per series: largest fall below a running peak, longest time from peak to recovery (or the end) and time from the
    deepest trough to its recovery. An equal peak moves the peak's time."""
    w = Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("close").over(w)
    rows = equity.withColumn("peak", peak).withColumn("top", F.col("close") >= F.col("peak"))
    rows = rows.withColumn("seg", F.sum(F.col("top").cast("int")).over(w)).withColumn("end", F.max("bar").over(Window.partitionBy("symbol")))
    segs = rows.groupBy("symbol", "seg", "end").agg(
        F.min("bar").alias("peak_bar"), F.max("peak").alias("peak"), F.min("close").alias("trough"), F.min_by("bar", F.struct("close", "bar")).alias("trough_bar"), F.count("*").alias("n")
    )
    segs = segs.withColumn("recovery", F.lead("peak_bar").over(Window.partitionBy("symbol").orderBy("seg"))).where("n > 1")
    segs = segs.withColumn("fall", F.try_divide(F.col("trough"), F.col("peak")) - 1)
    found = segs.groupBy("symbol").agg(
        F.min("fall").alias("max_drawdown"), F.max(F.coalesce("recovery", "end") - F.col("peak_bar")).alias("longest_seconds"),
        F.min_by(F.struct((F.col("recovery") - F.col("trough_bar")).alias("x")), F.struct("fall", "seg")).alias("worst"),
    )
    whole = equity.select("symbol").distinct()
    return whole.join(found, "symbol", "left").select("symbol", F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), "longest_seconds", F.col("worst.x").alias("recovery_seconds"))


def risk_day(equity: DataFrame, limit: float, most_fall: float) -> DataFrame:
    """Per series and UTC day: first equity, result of the day, high-water mark, and whether the day's loss or the fall from the mark reaches its limit (both amounts)."""
    day = (F.floor(F.col("bar") / 86_400) * 86_400).alias("day")
    days = equity.groupBy("symbol", day).agg(F.min_by("close", "bar").alias("start"), F.max_by("close", "bar").alias("last"), F.max("close").alias("top"))
    high = F.max("top").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    rows = days.withColumn("high_water", high).withColumn("pnl", F.col("last") - F.col("start"))
    return rows.select("symbol", "day", "start", "pnl", "high_water", (-F.col("pnl") >= limit).alias("loss_lock"), (F.col("high_water") - F.col("last") >= most_fall).alias("drawdown_lock"))


def first_touch_fills(orders: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """First bar after t that touches each limit or stop order (id, symbol, t, side, kind, level), with no horizon; a fill is stamped at the bar's end and never worse than its limit."""
    falls = ((F.col("side") == "buy") & (F.col("kind") == "limit")) | ((F.col("side") == "sell") & (F.col("kind") == "stop"))
    hit = touches(orders.withColumn("falls", falls), bars)
    return hit.select("id", "fill_bar", (F.col("fill_bar") + width).alias("fill_time"), F.col("reference").alias("fill_price"))


def ambiguous_triggers(fills: DataFrame) -> DataFrame:
    """fills (id, symbol, fill_bar) with the number of triggers in the bar and whether the order is the kept one (smallest id)."""
    w = Window.partitionBy("symbol", "fill_bar")
    return fills.select("id", "symbol", "fill_bar", F.count("*").over(w).alias("n"), (F.min("id").over(w) == F.col("id")).alias("kept"))


def first_breaches(days: DataFrame) -> DataFrame:
    """First day of each lock of each series of risk days; null where it never locks."""
    at = lambda c: F.min(F.when(F.col(c), F.col("day")))
    return days.groupBy("symbol").agg(at("loss_lock").alias("first_loss_lock"), at("drawdown_lock").alias("first_drawdown_lock"))

"""Bars: aggregation, store operations, quality and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite, session_open

from .gates import blocked_lag
from .trading import rank_at, value_block, value_ranks

KEY = ["symbol", "bar"]


def series():
    return Window.partitionBy("symbol").orderBy("bar")


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks that have no finding: later than the tick before them in source order (valid or not), finite positive prices that don't cross, finite volumes of 0 or more."""
    price = [F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False)) for c in ("bid", "ask")]
    volume = [F.coalesce(finite(F.col(c).cast("double")) & (F.col(c) >= 0), F.lit(False)) for c in ("bid_volume", "ask_volume")]
    later = F.col("before").isNull() | (F.col("us") > F.col("before"))
    return blocked_lag(ticks, "us", "row_no").where(later & price[0] & price[1] & volume[0] & volume[1] & (F.col("bid") <= F.col("ask"))).drop("before")


def ticks_to_bars(ticks: DataFrame, width: int) -> DataFrame:
    """Bars of width seconds with bar start as bar, of ticks that are valid already; the bid side has the plain names, the ask side its own. Partial aggregation, one shuffle of the sums."""
    order = F.struct("us", "row_no")
    spread = F.col("ask") - F.col("bid")

    def side(c: str, prefix: str) -> list[Column]:
        return [F.min_by(c, order).alias(f"{prefix}open"), F.max(c).alias(f"{prefix}high"), F.min(c).alias(f"{prefix}low"), F.max_by(c, order).alias(f"{prefix}close"), F.sum(f"{c}_volume").alias(f"{prefix}volume")]

    return ticks.groupBy("symbol", (F.floor(F.col("us") / (width * 1_000_000)) * width).alias("bar")).agg(
        *side("bid", ""), *side("ask", "ask_"), F.count("*").alias("n"), F.avg(spread).alias("spread_mean"), F.min(spread).alias("spread_min"), F.max(spread).alias("spread_max"), F.max_by(spread, order).alias("spread_close"),
    )


def expected_bars(bars: DataFrame, width: int) -> DataFrame:
    """The calendar grid of each series from its first to its last bar, open sessions only. The grid starts at the series' first day, so that bars off the grid don't move it."""
    ends = bars.groupBy("symbol").agg((F.ceil(F.min("bar") / width) * width).alias("a"), F.max("bar").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bar")).where(session_open(F.col("bar")))


def missing_bars(bars: DataFrame, width: int) -> DataFrame:
    return expected_bars(bars, width).join(bars.select(*KEY), KEY, "left_anti")


def unexpected_bars(bars: DataFrame, width: int) -> DataFrame:
    """Bars that the calendar grid lacks: of a closed session, or off the grid that starts at midnight UTC."""
    return bars.select(*KEY).where(~session_open(F.col("bar")) | (F.col("bar") % width != 0))


def classify_gaps(bars: DataFrame, width: int) -> DataFrame:
    """Each absent grid point, as closure or data_gap."""
    ends = bars.groupBy("symbol").agg(F.min("bar").alias("a"), F.max("bar").alias("b"))
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bar"))
    return grid.join(bars.select(*KEY), KEY, "left_anti").withColumn("kind", F.when(session_open(F.col("bar")), "data_gap").otherwise("closure"))


def runs(df: DataFrame, same: Column, *by: str) -> DataFrame:
    """run: number of the run of rows that each continue the row before (same is true), in a series."""
    w = Window.partitionBy(*by).orderBy("bar")
    return df.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))


def gap_runs(bars: DataFrame, width: int) -> DataFrame:
    gaps = runs(missing_bars(bars, width), F.lag("bar").over(series()) + width == F.col("bar"), "symbol")
    return gaps.groupBy("symbol", "run").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.count("*").alias("length")).drop("run")


def stale_sequences(bars: DataFrame, least: int) -> DataFrame:
    """Runs of at least so many equal closes."""
    found = runs(bars, F.lag("close").over(series()) == F.col("close"), "symbol")
    return found.groupBy("symbol", "run").agg(F.min("bar").alias("first_bar"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def suspicious_jumps(bars: DataFrame, most: float) -> DataFrame:
    """Opens that differ from a positive close before them by more than that share."""
    before = F.lag("close").over(series())
    jump = F.when(before > 0, F.abs(F.col("open") - before) / before)
    return bars.select(*KEY, jump.alias("jump")).where(F.col("jump") > most)


def order_violations(ticks: DataFrame) -> DataFrame:
    """Ticks not later than the tick before them in source order."""
    code = F.when(F.col("us") == F.col("before"), "duplicate_timestamp").when(F.col("us") < F.col("before"), "non_monotonic")
    return blocked_lag(ticks.select("symbol", "row_no", "us"), "us", "row_no").select("symbol", "row_no", code.alias("code")).where("code is not null")


def spread_distribution(ticks: DataFrame) -> DataFrame:
    """Minimum, maximum, true median and floor-rank percentiles (index int((n - 1) p)) of the spread."""
    s = ticks.select("symbol", (F.col("ask") - F.col("bid")).alias("x"))
    rows = value_ranks(s, "symbol", "x", value_block())
    last = F.col("total") - 1
    at = lambda p: rank_at(F.floor(last * p))
    middle = (rank_at(F.floor(last / 2)) + rank_at(F.ceil(last / 2))) / 2
    return rows.groupBy("symbol").agg(F.min("value").alias("low"), F.max("value").alias("high"), middle.alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def freshness(bars: DataFrame, now: Column, most: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("bar").alias("latest")).withColumn("stale", now - F.col("latest") > most)


def latest_bar(bars: DataFrame) -> DataFrame:
    """The newest bar of each series, whole."""
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*rest), "bar").alias("x")).select("symbol", "x.*")


def query_bars(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open range; the filter reaches the scan of a stored table."""
    return bars.where((F.col("bar") >= start) & (F.col("bar") < end))


def dedupe_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All rows with kept: whether the row is the first of its key."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def upsert_bars(stored: DataFrame, batch: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the batch rows that are new, the others): new is the first of its key, if the key is not stored yet."""
    marked = dedupe_first(batch, KEY, order).join(stored.select(*KEY, F.lit(True).alias("stored")).distinct(), KEY, "left")
    new = F.col("kept") & F.col("stored").isNull()
    return marked.where(new).drop("kept", "stored"), marked.where(~new).drop("kept", "stored")


def compare_closes(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences of two sources (symbol, t, close) on shared times, for the wanted pairs (symbol_a, symbol_b; a small table)."""
    left = a.select(F.col("symbol").alias("symbol_a"), "t", F.col("close").alias("x")).join(F.broadcast(pairs), "symbol_a")
    both = left.join(b.select(F.col("symbol").alias("symbol_b"), "t", F.col("close").alias("y")), ["symbol_b", "t"])
    d = F.col("x") - F.col("y")
    return both.groupBy("symbol_a", "symbol_b").agg(F.count("*").alias("n"), F.avg(d).alias("mean_signed"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"))


CONTENT = ("open", "high", "low", "close", "volume", "ask_open", "ask_high", "ask_low", "ask_close", "ask_volume", "n", "spread_close")


def dataset_fingerprint(bars: DataFrame, columns: tuple[str, ...] = CONTENT, by: str = "symbol") -> DataFrame:
    """Order-independent content hash of each series (or other set of bars, named by a column) over all its columns: bars are hashed, a day hashes its bars' sorted hashes, a series its days' hashes in order. A null differs from every value."""
    values = [F.coalesce(F.format_string("%.8f", F.col(c).cast("double")), F.lit("null")) for c in columns]
    row = F.sha2(F.concat_ws("|", F.col("symbol"), F.col("bar").cast("string"), *values), 256)
    days = bars.groupBy(by, F.floor(F.col("bar") / 86_400).alias("day")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256).alias("h"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("day", "h"))), lambda x: x["h"])
    return days.groupBy(by).agg(F.sha2(F.array_join(line, ""), 256).alias("fingerprint"))

"""Row validation, one-tick repair, quality reports and admission rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite, session_open

from .gates import blocked_lag
from .trading import rank_at, value_block, value_ranks

PRICES = ("bid", "ask")
VOLUMES = ("bid_volume", "ask_volume")


def validate_ticks(ticks: DataFrame) -> DataFrame:
    """One row for each finding (symbol, row_no, code) of ticks in source order; a tick may have several."""
    # Codes of findings (fixed names).
    before = F.col("before")
    codes = [F.when(F.col("us") == before, "duplicate_timestamp").when(F.col("us") < before, "non_monotonic_timestamp")]
    for name in PRICES:
        c = F.col(name).cast("double")
        codes.append(F.when(c.isNull(), "missing_price").when(~finite(c), "nonfinite_price").when(c <= 0, "nonpositive_price"))
    bid, ask = (F.col(n).cast("double") for n in PRICES)
    codes.append(F.when(finite(bid) & finite(ask) & (bid > ask), "crossed_quote"))
    for name in VOLUMES:
        c = F.col(name).cast("double")
        codes.append(F.when(c.isNull(), "missing_volume").when(~finite(c) | (c < 0), "volume_anomaly"))
    found = blocked_lag(ticks, "us", "row_no").select("symbol", "row_no", F.array_compact(F.array(*codes)).alias("codes"))
    return found.select("symbol", "row_no", F.explode("codes").alias("code"))


def tick_validation_report(ticks: DataFrame) -> DataFrame:
    """Counts of each series; a duplicate time is non-monotonic as well."""
    rows = ticks.groupBy("symbol").agg(F.count("*").alias("row_count"))
    is_ = lambda *names: F.count_if(F.col("code").isin(*names))
    by_row = validate_ticks(ticks).groupBy("symbol", "row_no").agg(
        is_("duplicate_timestamp", "non_monotonic_timestamp").alias("order"), is_("duplicate_timestamp").alias("dup"), is_("nonfinite_price").alias("nonfinite"),
        is_("nonpositive_price").alias("nonpositive"), is_("crossed_quote").alias("crossed"), is_("missing_volume", "volume_anomaly").alias("volume"),
    )
    sums = by_row.groupBy("symbol").agg(
        F.count("*").alias("invalid_tick_count"), F.sum("order").alias("non_monotonic_timestamps"), F.sum("dup").alias("duplicate_timestamps"), F.sum("nonfinite").alias("nonfinite_price_count"),
        F.sum("nonpositive").alias("nonpositive_price_count"), F.sum("crossed").alias("crossed_quote_count"), F.sum("volume").alias("volume_anomaly_count"),
    )
    return rows.join(sums, "symbol", "left").na.fill(0)


def validate_bars(candidates: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """candidates with reject_code, null where the bar is accepted. Times outside [start, end) are out_of_range."""
    o, h, l, c = (F.col(n).cast("double") for n in ("open", "high", "low", "close"))
    bad_price = reduce(lambda a, b: a | b, [x.isNull() | ~finite(x) | (x <= 0) for x in (o, h, l, c)])
    code = F.when(F.col("volume") < 0, "negative_volume").when(bad_price, "invalid_price")
    code = code.when((h < F.greatest(o, c, l)) | (l > F.least(o, c, h)) | (F.col("bid") > F.col("ask")), "invalid_ohlc")
    code = code.when(F.col("quote_time") < F.col("bar"), "timezone_inconsistency")
    if start is not None and end is not None:
        code = code.when(~F.col("bar").between(start, end - 1), "out_of_range")
    return candidates.withColumn("reject_code", code)


def repair_one_tick(bars: DataFrame, tick: float, sides: tuple[str, ...] = PRICES) -> DataFrame:
    """Moves a high or low that lies at most one tick inside open and close, if exactly one side has exactly one such
    inversion and the other side is right; the raw values are kept in a map. All other rows stay as they are.
    Columns: <side>_open, _high, _low, _close; adds repaired (field or null) and raw_values."""
    high_off, low_off, wrong = {}, {}, {}
    for s in sides:
        o, h, l, c = (F.col(f"{s}_{n}") for n in ("open", "high", "low", "close"))
        up, down = F.greatest(o, c) - h, l - F.least(o, c)
        high_off[s], low_off[s] = (up > 0) & (up <= tick) & (down <= 0), (down > 0) & (down <= tick) & (up <= 0)
        wrong[s] = (up > 0) | (down > 0) | (h < l)
    usable = reduce(lambda a, b: a & b, [F.col(f"{s}_{n}") > 0 for s in sides for n in ("open", "high", "low", "close")])
    n_wrong = reduce(lambda a, b: a + b, [wrong[s].cast("int") for s in sides])
    field = F.coalesce(*[F.when(high_off[s], f"{s}_high").when(low_off[s], f"{s}_low") for s in sides])
    names = [f"{s}_{n}" for s in sides for n in ("open", "high", "low", "close")]
    out = bars.withColumn("repaired", F.when(usable & (n_wrong == 1), field))
    raw = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names]))
    out = out.withColumn("raw_values", F.when(F.col("repaired").isNotNull(), raw))
    fixes = {f"{s}_high": F.when(F.col("repaired") == f"{s}_high", F.greatest(f"{s}_open", f"{s}_close")).otherwise(F.col(f"{s}_high")) for s in sides}
    fixes |= {f"{s}_low": F.when(F.col("repaired") == f"{s}_low", F.least(f"{s}_open", f"{s}_close")).otherwise(F.col(f"{s}_low")) for s in sides}
    return out.withColumns(fixes)


def open_points(t: Column, width: int) -> Column:
    """How many grid points of open sessions there are up to t (inclusive) since an arbitrary week, in closed form; the width divides a week."""
    first, last = -(-79_200 // width), -(-511_200 // width) - 1
    inside = F.greatest(F.least(F.floor(F.pmod(t - 259_200, F.lit(604_800)) / width), F.lit(last)) - first + 1, F.lit(0))
    return F.floor((t - 259_200) / 604_800) * (last - first + 1) + inside


def gap_columns(bar: Column, last: Column, width: int) -> tuple[Column, Column, Column]:
    """(missing, closures, unexpected) grid points between a bar and the one before it: counted, never listed."""
    missing = F.coalesce(F.greatest(F.floor((bar - last) / width) - 1, F.lit(0)), F.lit(0))
    open_ = F.when(missing > 0, open_points(bar - width, width) - open_points(last, width)).otherwise(0)
    return missing, missing - open_, open_


def stale_count(rows: DataFrame, length: int, order: str) -> DataFrame:
    """rows with _stale: true on the first row of a run of at least so many equal closes (column c; null breaks a run)."""
    w = Window.partitionBy("symbol").orderBy(order)
    rows = rows.withColumn("_run", F.sum(F.when(F.lag("c").over(w) == F.col("c"), 0).otherwise(1)).over(w))
    size = F.count("*").over(Window.partitionBy("symbol", "_run"))
    first = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy(order)) == 1
    return rows.withColumn("_stale", first & (size >= length)).drop("_run")


def jumps(open_: Column, before: Column, most: float) -> Column:
    return F.coalesce((before > 0) & finite(before) & (F.abs(open_ - before) > most * before), F.lit(False))


def quality_report(bars: DataFrame, width: int, jump: float = 0.2, stale: int = 8) -> DataFrame:
    """Counters of each series of bars in time order: identity, prices, volumes, jumps, stale runs, gaps by session, zero and flat bars. It survives what it counts: nulls, zeros and non-finite numbers."""
    w = Window.partitionBy("symbol").orderBy("bar")
    o, h, l, c = (F.col(n).cast("double") for n in ("open", "high", "low", "close"))
    prices = [o, h, l, c]
    any_of = lambda f: reduce(lambda a, b: a | b, [F.coalesce(f(x), F.lit(False)) for x in prices])
    rows = bars.withColumns({"c": c, "before": F.lag(c).over(w), "last": F.lag("bar").over(w), "active": session_open(F.col("bar"))})
    missing, closures, unexpected = gap_columns(F.col("bar"), F.col("last"), width)
    rows = stale_count(rows, stale, "bar").withColumns({"missing": missing, "closures": closures, "unexpected": unexpected})
    usable = ~any_of(lambda x: x.isNull() | ~finite(x) | (x <= 0))
    zero = F.col("volume") == 0
    flat = (o == h) & (h == l) & (l == c)
    return rows.groupBy("symbol").agg(
        F.count("*").alias("row_count"), F.min("bar").alias("coverage_start"), (F.max("bar") + width).alias("coverage_end"), F.count_if(F.col("bar") == F.col("last")).alias("duplicate_count"),
        F.count_if(usable & ((h < F.greatest(*prices)) | (l > F.least(*prices)))).alias("invalid_ohlc_count"), F.count_if(any_of(lambda x: x.isNull())).alias("missing_price_count"),
        F.count_if(any_of(lambda x: ~finite(x))).alias("nonfinite_price_count"), F.count_if(any_of(lambda x: finite(x) & (x <= 0))).alias("nonpositive_price_count"),
        F.count_if(F.coalesce(F.col("volume") < 0, F.lit(True))).alias("volume_anomaly_count"), F.count_if(jumps(o, F.col("before"), jump)).alias("suspicious_jumps"), F.count_if("_stale").alias("stale_sequences"),
        F.sum("missing").alias("missing_intervals"), F.sum("closures").alias("expected_closures"), F.sum("unexpected").alias("unexpected_gaps"), F.count_if(zero).alias("zero_volume_bar_count"),
        F.count_if(zero & F.col("active")).alias("active_session_zero_volume"), F.count_if(zero & ~F.col("active")).alias("closed_session_zero_volume"), F.count_if(flat).alias("flat_bar_count"), F.count_if(flat & zero).alias("flat_zero_volume_count"),
        F.count_if(~F.col("active")).alias("closed_session_bar_count"),
    )


def quote_quality_report(quotes: DataFrame, width: int, jump: float = 0.2, stale: int = 8) -> DataFrame:
    """Counters of each series of two-sided bars in source order (symbol, bar, row_no, bid_* and ask_* prices and volumes, repaired, raw_values): the bid is the selected side.

    Prices count before and after repair: a value that was repaired is held in raw_values."""
    w = Window.partitionBy("symbol").orderBy("row_no")
    names = {s: [f"{s}_{n}" for n in ("open", "high", "low", "close")] for s in PRICES}
    value = lambda n: F.col(n).cast("double")
    raw = lambda n: F.coalesce(F.try_element_at("raw_values", F.lit(n)).try_cast("double"), value(n))
    some = lambda xs, f: reduce(lambda a, b: a | b, [F.coalesce(f(x), F.lit(False)) for x in xs])

    def wrong(xs: list[Column]) -> Column:
        there = reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
        good = ~some(xs, lambda x: ~finite(x) | (x <= 0)) & (xs[1] >= F.greatest(*xs)) & (xs[2] <= F.least(*xs))
        return (there & ~F.coalesce(good, F.lit(False))).cast("int")

    both = lambda f: reduce(lambda a, b: a + b, [f(s) for s in PRICES])
    content = F.struct(*[c for n in names.values() for c in n], *VOLUMES)
    first = F.first(content).over(Window.partitionBy("symbol", "bar").orderBy("row_no"))
    number = F.row_number().over(Window.partitionBy("symbol", "bar").orderBy("row_no"))
    rows = quotes.withColumns({
        "c": value("bid_close"), "before": F.lag(value("bid_close")).over(w), "last": F.lag("bar").over(w), "active": session_open(F.col("bar")), "again": number > 1, "conflict": ~content.eqNullSafe(first),
        "spread": F.when(finite(value("bid_close")) & finite(value("ask_close")), value("ask_close") - value("bid_close")),
    })
    rows = stale_count(rows, stale, "row_no")
    zero = F.col("bid_volume") == 0
    bid = [value(n) for n in names["bid"]]
    flat = (bid[0] == bid[1]) & (bid[1] == bid[2]) & (bid[2] == bid[3])
    crossed = reduce(lambda a, b: a + b, [F.coalesce((finite(value(x)) & finite(value(y)) & (value(x) > value(y))).cast("int"), F.lit(0)) for x, y in zip(names["bid"], names["ask"])])
    volumes = reduce(lambda a, b: a + b, [F.coalesce((~finite(value(v)) | (value(v) < 0)).cast("int"), F.lit(0)) for v in VOLUMES])
    sums = rows.groupBy("symbol").agg(
        F.count("*").alias("row_count"), F.min("bar").alias("coverage_start"), (F.max("bar") + width).alias("coverage_end"), F.count_if("again").alias("duplicate_count"), F.count_if(F.col("bar") <= F.col("last")).alias("non_monotonic_count"),
        F.count_if("conflict").alias("conflicting_overlap_count"), F.sum(both(lambda s: wrong([raw(n) for n in names[s]]))).alias("invalid_ohlc_before"), F.sum(both(lambda s: wrong([value(n) for n in names[s]]))).alias("invalid_ohlc_count"),
        F.count_if(F.col("repaired").isNotNull()).alias("quantization_adjustment_count"), F.sum(crossed).alias("crossed_bid_ask_count"), F.sum(both(lambda s: some([raw(n) for n in names[s]], lambda x: ~finite(x)).cast("int"))).alias("nonfinite_price_count"),
        F.sum(both(lambda s: some([raw(n) for n in names[s]], lambda x: finite(x) & (x <= 0)).cast("int"))).alias("nonpositive_price_count"), F.sum(volumes).alias("volume_anomaly_count"), F.count("spread").alias("quote_side_complete_count"),
        F.count_if(jumps(value("bid_open"), F.col("before"), jump)).alias("suspicious_jumps"), F.count_if("_stale").alias("stale_sequences"), F.count_if(zero).alias("zero_volume_bar_count"), F.count_if(zero & F.col("active")).alias("active_session_zero_volume"),
        F.count_if(zero & ~F.col("active")).alias("closed_session_zero_volume"), F.count_if(flat).alias("flat_bar_count"), F.count_if(flat & zero).alias("flat_zero_volume_count"), F.min("spread").alias("min_spread"), F.max("spread").alias("max_spread"),
    )
    spreads = value_ranks(rows.select("symbol", "spread"), "symbol", "spread", value_block())
    last = F.col("total") - 1
    told = spreads.groupBy("symbol").agg(
        ((rank_at(F.floor(last / 2)) + rank_at(F.ceil(last / 2))) / 2).alias("median_spread"), rank_at(F.floor(last * 0.95)).alias("p95_spread"), rank_at(F.floor(last * 0.99)).alias("p99_spread")
    )
    times = quotes.select("symbol", "bar").distinct().withColumn("last", F.lag("bar").over(Window.partitionBy("symbol").orderBy("bar")))
    missing, closures, unexpected = gap_columns(F.col("bar"), F.col("last"), width)
    gaps = times.groupBy("symbol").agg(F.sum(missing).alias("missing_intervals"), F.sum(closures).alias("expected_closures"), F.sum(unexpected).alias("unexpected_gaps"))
    return sums.join(told, "symbol", "left").join(gaps, "symbol")


def tick_quality_report(bars: DataFrame, validation: DataFrame, width: int, jump: float = 0.2, stale: int = 8) -> DataFrame:
    """Counters of each series of tick bars (both sides), joined with its tick validation report; the mean spread is weighted by ticks."""
    w = Window.partitionBy("symbol").orderBy("bar")
    rows = bars.withColumns({"c": F.col("close"), "before": F.lag("close").over(w), "last": F.lag("bar").over(w), "active": session_open(F.col("bar"))})
    missing, closures, unexpected = gap_columns(F.col("bar"), F.col("last"), width)
    rows = stale_count(rows, stale, "bar").withColumns({"missing": missing, "closures": closures, "unexpected": unexpected})
    zero = (F.col("volume") == 0) | (F.col("ask_volume") == 0)
    side = lambda p: ((F.col(f"{p}high") < F.greatest(*[f"{p}{n}" for n in ("open", "high", "low", "close")])) | (F.col(f"{p}low") > F.least(*[f"{p}{n}" for n in ("open", "high", "low", "close")]))).cast("int")
    sums = rows.groupBy("symbol").agg(
        F.count("*").alias("bar_count"), F.min("bar").alias("coverage_start"), (F.max("bar") + width).alias("coverage_end"), F.sum("missing").alias("missing_intervals"), F.sum("closures").alias("expected_closures"), F.sum("unexpected").alias("unexpected_gaps"),
        F.count_if(zero).alias("zero_volume_bars"), F.count_if(zero & F.col("active")).alias("active_session_zero_volume"), F.count_if(zero & ~F.col("active")).alias("closed_session_zero_volume"), F.sum(side("") + side("ask_")).alias("ohlc_violations"),
        F.count_if("_stale").alias("stale_sequences"), F.count_if(jumps(F.col("open"), F.col("before"), jump)).alias("suspicious_jumps"), F.sum("n").alias("spread_observation_count"), (F.sum(F.col("spread_mean") * F.col("n")) / F.sum("n")).alias("mean_spread"),
        F.min("spread_min").alias("minimum_spread"), F.max("spread_max").alias("maximum_spread"),
    )
    return validation.join(sums, "symbol", "left")


#: Counter of a report -> blocker when it is over its tolerance (fixed names).
BLOCKERS = {
    "duplicate_count": "duplicate_timestamps",
    "non_monotonic_count": "non_monotonic_timestamps",
    "invalid_ohlc_count": "material_ohlc_corruption",
    "crossed_bid_ask_count": "crossed_market_corruption",
    "nonpositive_price_count": "nonpositive_prices",
    "nonfinite_price_count": "nonfinite_prices",
    "volume_anomaly_count": "volume_anomalies",
    "active_session_zero_volume": "active_session_zero_volume",
    "unexpected_gaps": "unexpected_data_gaps",
    "schema_drift_count": "schema_drift",
    "suspicious_jumps": "suspicious_jumps",
    "conflicting_overlap_count": "conflicting_overlapping_records",
}


def admission_blockers(report: DataFrame, tolerances: dict[str, int], require_bid_ask: bool = True) -> DataFrame:
    """symbol, sorted distinct blockers, state, of quote quality reports with artifacts (number of files) and calendar_ok.

    A counter without a tolerance may be 0 at most, but for jumps, which then don't count."""
    c = F.col
    codes = [F.when(c(n) > tolerances.get(n, 0), name) for n, name in BLOCKERS.items() if n in tolerances or n != "suspicious_jumps"]
    codes.append(F.when(F.coalesce(c("row_count"), F.lit(0)) == 0, "coverage_missing"))
    codes.append(F.when(F.coalesce(c("artifacts"), F.lit(0)) == 0, "artifact_not_supplied"))
    codes.append(F.when(~F.coalesce(c("calendar_ok"), F.lit(False)), "unknown_or_incompatible_calendar"))
    if require_bid_ask:
        codes.append(F.when(c("quote_side_complete_count") != c("row_count"), "bid_ask_unavailable"))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*codes))))
    return report.select("symbol", F.array_join(found, ",").alias("blockers"), F.when(F.size(found) == 0, "admitted").otherwise("blocked").alias("state"))


def quality_events(findings: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """symbol, bar, code, severity rows of several checks, each (severity, rows with symbol and bar)."""
    each = [df.select("symbol", "bar", F.lit(code).alias("code"), F.lit(severity).alias("severity")) for code, (severity, df) in findings.items()]
    return reduce(DataFrame.unionByName, each)


def quality_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("code", "severity").agg(F.count("*").alias("n"))


def overlap_conflicts(rows: DataFrame, key: list[str], order: str, content: list[str]) -> DataFrame:
    """Rows whose content differs from the first row of the same key."""
    first = Window.partitionBy(*key).orderBy(order)
    of = F.struct(*content)
    told = rows.withColumn("first", F.first(of).over(first)).where(~of.eqNullSafe(F.col("first")))
    return told.select(*key, order)


def ingestion_summary(checked: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per series: received, accepted, rejected, duplicates and status of candidates with reject_code."""
    number = F.row_number().over(Window.partitionBy(*key, F.col("reject_code").isNull()).orderBy(order))
    rows = checked.withColumn("dup", F.col("reject_code").isNull() & (number > 1))
    sums = rows.groupBy("symbol").agg(
        F.count("*").alias("received"), F.count_if(F.col("reject_code").isNull() & ~F.col("dup")).alias("accepted"),
        F.count_if(F.col("reject_code").isNotNull()).alias("rejected"), F.count_if("dup").alias("duplicates"),
    )
    status = F.when(F.col("accepted") == 0, "failed").when(F.col("rejected") + F.col("duplicates") > 0, "partial").otherwise("complete")
    return sums.withColumn("status", status)


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """Missing bars by hour and by weekday (0 is Sunday) of each series, by grouping sets; key of the other set is null."""
    rows = gaps.select("symbol", F.floor(F.pmod(F.col("bar"), F.lit(86_400)) / 3600).alias("hour"), F.floor(F.pmod(F.col("bar") - 259_200, F.lit(604_800)) / 86_400).alias("weekday"))
    h, d = F.col("hour"), F.col("weekday")
    return rows.groupingSets([["symbol", "hour"], ["symbol", "weekday"]], "symbol", h, d).agg(F.count("*").alias("n"))

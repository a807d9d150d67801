"""Gates: input checks of series, feature sets, replays and datasets, and the operational gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import finite


def reasons(tests: list[tuple[str, Column]]) -> Column:
    """Array of the names whose test holds, in order; an unknown test holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in tests]))


def first_reason(tests: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in tests], F.lit(None).cast("string"))


def blocked_lag(rows: DataFrame, value: str, order: str, block: int = 1 << 16, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows (by, order, ...) with before: value of the row before in the order, windowed in blocks of it, so that no task sorts a whole series.

    The last values of blocks are carried over in blocks of blocks, so sparse numbers, of which each has a block of its own, don't meet in one task either."""
    keys = list(by)
    cut = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_far", F.floor(F.col("_block") / block))
    inside = cut.withColumn("_lag", F.lag(F.struct(value)).over(Window.partitionBy(*keys, "_block").orderBy(order)))
    ends = cut.groupBy(*keys, "_far", "_block").agg(F.max_by(F.struct(value), order).alias("_end"))
    near = ends.withColumn("_near", F.lag("_end").over(Window.partitionBy(*keys, "_far").orderBy("_block")))
    far = ends.groupBy(*keys, "_far").agg(F.max_by("_end", "_block").alias("_last"))
    far = far.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_far"))).drop("_last")
    carried = near.join(far, [*keys, "_far"]).select(*keys, "_block", F.coalesce("_near", "_before").alias("_carried"))
    return inside.join(carried, [*keys, "_block"]).withColumn("before", F.coalesce("_lag", "_carried")[value]).drop("_block", "_far", "_lag", "_carried")


def validate_bar_series(bars: DataFrame) -> DataFrame:
    """Per symbol of bars in source order (row_no): rows that don't rise in time, invalid rows, mixed scopes, and whether features may be computed."""
    c = {n: F.col(n).cast("double") for n in ("open", "high", "low", "close")}
    price = reduce(lambda a, b: a | b, [x.isNull() | ~finite(x) | (x <= 0) for x in c.values()])
    bad = price | (c["high"] < F.greatest(*c.values())) | (c["low"] > F.least(*c.values())) | (F.col("volume") < 0)
    sums = blocked_lag(bars, "bar", "row_no").groupBy("symbol").agg(
        F.count_if(F.col("bar") <= F.col("before")).alias("order_violations"), F.count_if(F.coalesce(bad, F.lit(True))).alias("invalid_rows"), F.count_if(F.col("scope") != F.col("series_scope")).alias("mixed_scope")
    )
    return sums.withColumn("valid", (F.col("order_violations") == 0) & (F.col("invalid_rows") == 0) & (F.col("mixed_scope") == 0))


def validate_feature_set(features: DataFrame, key: list[str]) -> DataFrame:
    """Findings (key, code) of a feature set: duplicate_key, nonfinite_value, value_without_status, status_without_value."""
    v = F.col("value")
    inside = features.select(*key, F.when(v.isNotNull() & ~finite(v), "nonfinite_value").when((F.col("status") == "value") & v.isNull(), "status_without_value").when((F.col("status") != "value") & v.isNotNull(), "value_without_status").alias("code"))
    twice = features.groupBy(*key).count().where("count > 1").select(*key, F.lit("duplicate_key").alias("code"))
    return inside.where("code is not null").unionByName(twice)


def backtest_input_gate(bars: DataFrame, universe: list[str], timeframe: str, policy: str, start: int, stop: int, open_: Column) -> DataFrame:
    """Violations (symbol, bar, code) of replay inputs: unknown_symbol, wrong_timeframe, wrong_policy, out_of_range, market_closed, duplicate_bar."""
    tests = [
        ("unknown_symbol", ~F.col("symbol").isin(*universe)), ("wrong_timeframe", F.col("timeframe") != timeframe), ("wrong_policy", F.col("adjustment_policy") != policy),
        ("out_of_range", ~((F.col("bar") >= start) & (F.col("bar") < stop))), ("market_closed", ~open_),
    ]
    found = bars.select("symbol", "bar", F.explode(reasons(tests)).alias("code"))
    twice = bars.groupBy("symbol", "bar").count().where("count > 1").select("symbol", "bar", F.lit("duplicate_bar").alias("code"))
    return found.unionByName(twice)


def dataset_manifest(bars: DataFrame) -> DataFrame:
    """One row a dataset (dataset, symbol, bar, timeframe, source, policy): symbols, period, and whether scope and identity are single."""
    keys = bars.groupBy("dataset", "symbol", "bar").agg(F.count("*").alias("n"), F.min("timeframe").alias("t0"), F.max("timeframe").alias("t1"), F.min("policy").alias("p0"), F.max("policy").alias("p1"))
    return keys.groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"), F.min("bar").alias("start"), F.max("bar").alias("end"), F.sum("n").alias("rows"),
        ((F.min("t0") == F.max("t1")) & (F.min("p0") == F.max("p1"))).alias("single_scope"), (F.max("n") == 1).alias("unique_identity"),
    )


def qualify_dataset(bars: DataFrame, missing: DataFrame, require_quotes: bool = True) -> DataFrame:
    """Per dataset of bars in source order (dataset, symbol, bar, row_no, bid, ask, equity_unresolved): counts, reasons and status."""
    rows = blocked_lag(bars, "bar", "row_no", by=("dataset", "symbol")).withColumn("back", F.coalesce((F.col("bar") <= F.col("before")).cast("int"), F.lit(0)))
    keys = rows.groupBy("dataset", "symbol", "bar").agg(
        F.count("*").alias("n"), F.count_if(F.col("bid").isNotNull() & F.col("ask").isNotNull()).alias("quoted"), F.sum("back").alias("back"), F.max("equity_unresolved").alias("unresolved")
    )
    sums = keys.groupBy("dataset").agg(F.sum("n").alias("bar_count"), F.sum(F.col("n") - 1).alias("duplicate_timestamps"), F.sum("back").alias("backward"), (F.sum("quoted") / F.sum("n")).alias("quote_coverage"), F.max("unresolved").alias("unresolved"))
    gaps = missing.groupBy("dataset").agg(F.count("*").alias("missing_bars"))
    rows = sums.join(gaps, "dataset", "left").withColumn("missing_bars", F.coalesce("missing_bars", F.lit(0)))
    why = reasons([
        ("duplicate timestamps", F.col("duplicate_timestamps") > 0), ("timestamps are not strictly monotonic", F.col("backward") > 0), ("bid/ask availability is incomplete", F.lit(require_quotes) & (F.col("quote_coverage") < 1)),
        ("equity survivorship or corporate-action lineage is unresolved", F.col("unresolved")),
    ])
    return rows.select("dataset", "bar_count", "duplicate_timestamps", "missing_bars", "quote_coverage", F.array_join(F.array_sort(why), ";").alias("reasons")).withColumn("status", F.when(F.col("reasons") == "", "qualified").otherwise("rejected"))


def empirical_eligibility(rows: DataFrame) -> DataFrame:
    """rows (fixture, status, source_version, calendar, equity_unresolved, convention) with blockers and eligibility."""
    why = reasons([
        ("dataset_qualification_failed", F.col("status") != "qualified"), ("source_version_missing", F.coalesce(F.col("source_version"), F.lit("")) == ""), ("calendar_identity_missing", F.coalesce(F.col("calendar"), F.lit("")) == ""),
        ("survivorship_or_corporate_action_integrity_unverified", F.col("equity_unresolved")), ("quote_or_price_convention_missing", F.col("convention").isNull()),
    ])
    blockers = F.when(F.col("fixture"), F.lit("")).otherwise(F.array_join(why, ";"))
    state = F.when(F.col("fixture"), "deterministic_test_fixture").when(F.size(why) > 0, "blocked").otherwise("empirically_qualified")
    return rows.withColumns({"blockers": blockers, "eligibility": state})


def dataset_preflight(rows: DataFrame, least_days: int, zero: list[str]) -> DataFrame:
    """rows of manifests joined with their reports: every blocker by name, among them short coverage and quality counters (zero) that are not zero."""
    c = F.col
    tests = [
        ("manifest_missing", c("symbols").isNull()), ("scope_not_single", ~c("single_scope")), ("identity_not_unique", ~c("unique_identity")), ("qualification_failed", c("status") != "qualified"),
        ("coverage_missing", c("start").isNull() | c("end").isNull()), ("coverage_too_short", (c("end") - c("start")) < least_days * 86_400),
        *[(f"{n}_not_zero", c(n) != 0) for n in zero],
    ]
    found = F.array_sort(reasons(tests))
    return rows.withColumns({"blockers": F.array_join(found, ","), "ready": F.size(found) == 0})


#: Counters of a quality report that must be zero, and checks of a qualification, blocked by blockers that hold their name (fixed names).
ZERO_COUNTERS = (
    "invalid_ticks",
    "duplicate_timestamps",
    "non_monotonic_timestamps",
    "crossed_quotes",
    "nonpositive_prices",
    "nonfinite_prices",
    "volume_anomalies",
    "ohlc_violations",
    "unexpected_gaps",
    "unknown_gaps",
    "active_session_zero_volume",
)
PREFLIGHT_CHECKS = (
    "raw_artifact_hashes",
    "normalized_content_hash",
    "quality_report_hash",
    "source_version",
    "license_reference",
    "calendar_coverage",
    "execution_quotes",
    "qualification_policy",
)
STAGES = {"record_status": "DATASET_RECORD", "raw_status": "RAW_ARTIFACT", "normalized_status": "NORMALIZED_CONTENT", "quality_report_status": "QUALITY_REPORT"}


def admission_preflight(rows: DataFrame, identity: str, source: str, instruments: list[str], timeframe: str, mode: str = "tick", least_days: int = 180) -> DataFrame:
    """Data sets against a declared protocol: rows with blockers and warnings (sorted arrays), verdict, eligibility and checks (name, state).

    rows: dataset, the four states of STAGES (null counts as missing), record (struct of manifest fields, null if there is none) and
    report (struct of ZERO_COUNTERS, calendar_id and missing_intervals, null if it could not be read). Without a record its report
    is not looked at. A counter that is null or negative is invalid; instrument is compared with the only declared one."""
    record, report = F.col("record"), F.col("report")
    has, read = record.isNotNull(), record.isNotNull() & report.isNotNull()
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    other = lambda n, value: ~record[n].eqNullSafe(F.lit(value))
    start, end = record["coverage_start"], record["coverage_end"]
    state = lambda n: F.coalesce(F.col(n), F.lit("missing"))
    wrong_scope = ~record["instrument"].isin(instruments) if len(instruments) == 1 else F.lit(True)
    named = [
        ("FIXTURE_DATASET_NOT_ALLOWED", record["classification"] == "test_fixture"), ("SOURCE_VERSION_MISSING", record["source_version"].isNull()), (f"SOURCE_NOT_PREDECLARED_{source.upper()}", other("source", source)),
        ("INSTRUMENT_SCOPE_MISMATCH", F.coalesce(wrong_scope, F.lit(True))), ("TIMEFRAME_SCOPE_MISMATCH", other("timeframe", timeframe)), (f"DATA_MODE_NOT_PREDECLARED_{mode.upper()}", other("source_mode", mode)),
        ("TIMESTAMP_SEMANTICS_UNSUPPORTED", other("timestamp_semantics", "bar_start")), ("CALENDAR_ID_MISSING", none(record["calendar_id"])), ("COVERAGE_MISSING", start.isNull() | end.isNull()),
        ("COVERAGE_SHORT_FOR_DECLARED_PROTOCOL", end - start < least_days * 86_400), ("LICENSE_REFERENCE_MISSING", none(record["license_reference"])), ("SOURCE_IDENTITY_INCOMPLETE", none(record["manifest_source_version"]) & none(record["source_version"])),
        ("QUALITY_REPORT_UNREADABLE", report.isNull()), ("QUALIFICATION_POLICY_IDENTITY_MISMATCH", report.isNotNull() & other("policy_identity", identity)), ("QUALITY_CALENDAR_IDENTITY_MISMATCH", report.isNotNull() & ~report["calendar_id"].eqNullSafe(record["calendar_id"])),
    ]
    codes = [F.when(state(n) != "verified", F.concat(F.lit(f"{p}_"), F.upper(state(n)))) for n, p in STAGES.items()]
    codes += [F.when(has & bad, name) for name, bad in named]
    for n in ZERO_COUNTERS:
        value = report[n]
        codes.append(F.when(read & (value.isNull() | (value < 0)), f"QUALITY_FIELD_INVALID_{n.upper()}").when(read & (value > 0), F.concat(F.lit(f"QUALITY_{n.upper()}_"), value.cast("string"))))
    missing = report["missing_intervals"]
    told = rows.withColumns({
        "blockers": F.array_sort(F.array_distinct(F.array_compact(F.array(*codes)))),
        "warnings": F.array_compact(F.array(F.when(read & (missing > 0), F.concat(F.lit("MISSING_INTERVALS_"), missing.cast("string"), F.lit("_INCLUDING_EXPECTED_CLOSURES"))))),
    })
    clean = F.size("blockers") == 0
    fixture = F.coalesce(record["classification"] == "test_fixture", F.lit(False))
    blocks = lambda n: F.exists("blockers", lambda b: F.contains(F.lower(b), F.lit(n)))
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.when(blocks(n), "blocked").otherwise("passed").alias("state")) for n in sorted(PREFLIGHT_CHECKS)])
    return told.withColumns({
        "verdict": F.when(clean, "qualified").otherwise("rejected"), "checks": checks,
        "eligibility": F.when(clean, "empirically_qualified_dataset").when(fixture, "deterministic_test_fixture").otherwise("blocked"),
    })


def admission_gate(rows: DataFrame, now: Column, most_age: int) -> DataFrame:
    """Candidate batches, one row each (rows, scopes, duplicates, incomplete, latest, bid, ask, quote_time), with the first reason that blocks them or null."""
    c = F.col
    return rows.withColumn("reason", first_reason([
        ("data_empty", c("rows") == 0), ("mixed_scope", c("scopes") > 1), ("duplicate_bars", c("duplicates") > 0), ("incomplete_bars", c("incomplete") > 0), ("data_stale", now - c("latest") > most_age),
        ("quote_missing", c("bid").isNull() | c("ask").isNull() | c("quote_time").isNull()), ("quote_in_future", c("quote_time") > now), ("quote_stale", now - c("quote_time") > most_age),
    ]))


def operational_gate(series: DataFrame, datasets: DataFrame, errors: DataFrame, qualified: DataFrame, now: Column, most_age: int) -> DataFrame:
    """Per (symbol, timeframe) of series (latest, bid, ask, quote_time): the first failing reason in order, or null where trading may go on."""
    key = ["symbol", "timeframe"]
    rows = series.join(datasets, key, "left").join(errors.groupBy("symbol").agg(F.count("*").alias("errors")), "symbol", "left").join(qualified.select(*key, "status"), key, "left")
    c = F.col
    return rows.withColumn("reason", first_reason([
        ("bar_missing", c("latest").isNull()), ("bar_in_future", c("latest") > now), ("bar_stale", now - c("latest") > most_age), ("quote_missing", c("bid").isNull() | c("ask").isNull()), ("quote_crossed", c("bid") > c("ask")),
        ("quote_in_future", c("quote_time") > now), ("quote_stale", now - c("quote_time") > most_age), ("dataset_missing", c("end").isNull()), ("dataset_not_covering", c("end") < c("latest")),
        ("dataset_hash_mismatch", ~c("hash").eqNullSafe(c("expected_hash"))), ("quality_errors", F.coalesce("errors", F.lit(0)) > 0), ("not_qualified", ~c("status").eqNullSafe(F.lit("qualified"))),
    ])).select(*key, "reason")


def visible_events(bars: DataFrame, events: DataFrame, lag: int) -> DataFrame:
    """Per bar (symbol, timeframe, source, bar), decided `lag` seconds after it: how many findings are known: occurred at or before the decision, about a bar at or before it; a null symbol, timeframe or source of a finding matches all.

    Findings are summed to running counts by occurrence for each of the eight wildcard patterns, so bars meet one row a pattern by an as-of search and not every finding."""
    from .asof import nearest

    out = bars
    names = ["symbol", "timeframe", "source"]
    total = F.lit(0)
    for k in range(8):
        held = [n for i, n in enumerate(names) if k >> i & 1]
        own = events
        for n in names:
            own = own.where(F.col(n).isNotNull() if n in held else F.col(n).isNull())
        # A finding counts from the later of both times on.
        known = own.withColumn("t", F.greatest(F.col("occurred") - lag, F.col("about")))
        line = known.groupBy(*held, "t").agg(F.count("*").alias("n"))
        over = Window.partitionBy(*held, F.lit(1)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        line = line.withColumn("upto", F.sum("n").over(over))
        if not held:
            line, out = line.withColumn("_one", F.lit(1)), out.withColumn("_one", F.lit(1))
        out = nearest(out.withColumn("t", F.col("bar")), line.select(*(held or ["_one"]), "t", "upto"), by=tuple(held or ["_one"]), found=f"_f{k}").drop("t")
        total = total + F.coalesce(F.col(f"_f{k}.upto"), F.lit(0))
    return out.withColumn("visible", total).drop("_one", *[f"_f{k}" for k in range(8)])

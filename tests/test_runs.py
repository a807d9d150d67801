"""Ingestion runs, inspections, preflights and scenario metrics by hand: mixed series, copies, nulls, empty tables."""

import hashlib
import json

import pytest

from barloom.operators import calendars as C
from barloom.operators import gates as G
from barloom.operators import runs as U
from barloom.operators import trading as T

REQUEST = "request string, symbol string, timeframe string, source string, policy string, configuration string, start long, stop long, error string"
CANDIDATE = "request string, row_no long, symbol string, timeframe string, policy string, bar long, open double, high double, low double, close double, volume long, bid double, ask double, quote_time long"
STORED = "symbol string, timeframe string, source string, policy string, bar long, open double, high double, low double, close double, volume long"
H = 3600


def asked(spark):
    rows = [("r1", "s", "1h", "feed", "raw", "c1", 0, 10 * H, None), ("r2", "s", "1h", "feed", "raw", "c1", 0, 10 * H, None), ("r3", "t", "1h", "feed", "raw", "c1", 0, 10 * H, "timeout"), ("r4", "u", "1h", "feed", "raw", "c1", 0, 10 * H, None)]
    return spark.createDataFrame(rows, REQUEST)


def row(request, n, bar, **other):
    base = {"symbol": "s", "timeframe": "1h", "policy": "raw", "bar": bar, "open": 10.0, "high": 11.0, "low": 9.0, "close": 10.0, "volume": 5, "bid": 9.0, "ask": 10.0, "quote_time": bar} | other
    return (request, n, *base.values())


def outcome(spark, rows, stored=()):
    told = U.checked(spark.createDataFrame(rows, CANDIDATE), asked(spark))
    kept = U.written(U.answers(told), spark.createDataFrame(list(stored), STORED))
    held = U.of_requests(U.store_after(kept, spark.createDataFrame(list(stored), STORED)), asked(spark))
    return told, kept, held


def test_codes_follow_the_scope_first(spark):
    rows = [row("r1", 1, 0), row("r1", 2, H, symbol="x", volume=-1), row("r1", 3, H, timeframe=None), row("r1", 4, H, policy="split"), row("r1", 5, None), row("r1", 6, H, volume=-1), row("r1", 7, 10 * H), row("r1", 8, -H), row("r3", 9, 0), row("none", 10, 0), row("r1", 11, H, close=None), row("r1", 12, H, volume=None)]
    got = {r.row_no: r.code for r in outcome(spark, rows)[0].collect()}
    assert got == {1: None, 2: "invalid_ohlc", 3: "invalid_ohlc", 4: "invalid_ohlc", 5: "timezone_inconsistency", 6: "negative_volume", 7: "provider_inconsistency", 8: "provider_inconsistency", 11: "invalid_price", 12: None}


def test_a_bar_is_written_once_and_runs_are_summed(spark):
    rows = [row("r1", 1, 0), row("r1", 2, 0, open=10.5), row("r1", 3, H), row("r2", 1, 0), row("r2", 2, 2 * H), row("r2", 3, 3 * H, volume=-1)]
    old = [("s", "1h", "feed", "raw", H, 10.0, 11.0, 9.0, 10.0, 5), ("s", "1h", "feed", "split", 4 * H, 10.0, 11.0, 9.0, 10.0, 5)]
    told, kept, held = outcome(spark, rows, old)
    assert {(r.request, r.bar): (r.new, r.copies, r.open) for r in kept.collect()} == {("r1", 0): (True, 2, 10.0), ("r1", H): (False, 1, 10.0), ("r2", 0): (False, 1, 10.0), ("r2", 2 * H): (True, 1, 10.0)}
    assert sorted((r.request, r.bar) for r in held.collect()) == [(q, b) for q in ("r1", "r2") for b in (0, H, 2 * H)]
    grid = spark.createDataFrame([(q, b * H) for q in ("r1", "r2", "r4") for b in range(3)], "request string, bar long")
    from pyspark.sql import functions as F

    events = U.run_events(told, kept, U.inspect(held.withColumn("row_no", F.lit(0)), grid))
    versions = U.dataset_version(asked(spark), held)
    got = {r.request: r for r in U.run_summary(asked(spark), told, kept, events, versions).collect()}
    assert (got["r1"].received, got["r1"].accepted, got["r1"].rejected, got["r1"].duplicates, got["r1"].warnings, got["r1"].errors, got["r1"].quality_status, got["r1"].status) == (3, 1, 0, 2, 1, 0, "warning", "partial")
    assert (got["r2"].accepted, got["r2"].rejected, got["r2"].duplicates, got["r2"].errors, got["r2"].quality_status) == (1, 1, 1, 1, "error")
    assert (got["r3"].status, got["r3"].quality_status, got["r3"].dataset_version, got["r3"].error_message) == ("failed", None, None, "timeout")
    assert (got["r4"].status, got["r4"].quality_status, got["r4"].received) == ("success", "clean", 0)
    payload = {"provider": "feed", "symbol": "u", "timeframe": "1h", "start": "1970-01-01T00:00:00+00:00", "end": "1970-01-01T10:00:00+00:00", "adjustment_policy": "raw", "configuration_version": "c1", "bar_fingerprint": hashlib.sha256(b"").hexdigest()}
    assert got["r4"].dataset_version == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    prints = {r.request: r.fingerprint for r in versions.collect()}
    assert prints["r1"] == prints["r2"] != prints["r4"] and got["r1"].dataset_version == got["r2"].dataset_version


def test_nothing_asked_and_nothing_answered(spark):
    told, kept, held = outcome(spark, [])
    assert told.count() == kept.count() == held.count() == 0
    empty = spark.createDataFrame([], "request string, symbol string, timeframe string, source string, policy string, bar long, row_no long, open double, close double")
    assert U.inspect(empty, spark.createDataFrame([("r", 0)], "request string, bar long")).count() == 0


def test_inspection_of_mixed_sets(spark):
    bars = [("d", "s", "1h", "feed", "raw", 0, 1, 10.0, 10.0), ("d", "s", "1h", "feed", "raw", 0, 2, 99.0, 99.0), ("d", "s", "1h", "feed", "raw", 0, 3, 98.0, 98.0), ("d", "s", "1h", None, "raw", H, 4, 10.0, 0.0), ("d", "s", "1h", "feed", "raw", 2 * H, 5, 50.0, 10.0), ("d", "s", "1h", "feed", "raw", 3 * H + 1, 6, 13.0, 13.0)]
    df = spark.createDataFrame(bars, "request string, symbol string, timeframe string, source string, policy string, bar long, row_no long, open double, close double")
    grid = spark.createDataFrame([("d", k * H) for k in range(4)] + [("other", 0)], "request string, bar long")
    got = {(r.bar, r.code): (r.severity, r.n) for r in U.inspect(df, grid).collect()}
    assert got == {(H, "provider_inconsistency"): ("error", 1), (0, "duplicate_bar"): ("warning", 2), (3 * H, "missing_bar"): ("error", 1), (3 * H + 1, "unexpected_frequency"): ("error", 1), (3 * H + 1, "suspicious_jump"): ("warning", 1)}


def test_preflight_without_record_or_report(spark):
    record = "classification string, source string, source_version string, instrument string, timeframe string, source_mode string, timestamp_semantics string, calendar_id string, coverage_start long, coverage_end long, license_reference string, manifest_source_version string, policy_identity string"
    report = ", ".join(f"{n} long" for n in G.ZERO_COUNTERS) + ", calendar_id string, missing_intervals long"
    schema = f"dataset int, record_status string, raw_status string, normalized_status string, quality_report_status string, record struct<{record.replace(' string', ': string').replace(' long', ': long')}>, report struct<{report.replace(' string', ': string').replace(' long', ': long')}>"
    good, ok = ("empirical", "feed", "v1", "a", "15m", "tick", "bar_start", "week", 0, 180 * 86_400, "terms", None, "p1"), ["verified"] * 4
    zero = (*[0] * 11, "week", 3)
    rows = [(1, *ok, good, zero), (2, None, *ok[1:], None, zero), (3, *ok, good, None), (4, *ok, (*good[:9], 180 * 86_400 - 1, *good[10:]), (None, -1, 2, *zero[3:])), (5, *ok, (None,) * 13, zero)]
    told = G.admission_preflight(spark.createDataFrame(rows, schema), "p1", "feed", ["a"], "15m")
    got = {r.dataset: r for r in told.collect()}
    assert (got[1].blockers, got[1].verdict, got[1].eligibility, got[1].warnings) == ([], "qualified", "empirically_qualified_dataset", ["MISSING_INTERVALS_3_INCLUDING_EXPECTED_CLOSURES"])
    assert (got[2].blockers, got[2].eligibility, got[2].warnings) == (["DATASET_RECORD_MISSING"], "blocked", [])
    assert got[3].blockers == ["QUALITY_REPORT_UNREADABLE"]
    assert got[4].blockers == ["COVERAGE_SHORT_FOR_DECLARED_PROTOCOL", "QUALITY_FIELD_INVALID_DUPLICATE_TIMESTAMPS", "QUALITY_FIELD_INVALID_INVALID_TICKS", "QUALITY_NON_MONOTONIC_TIMESTAMPS_2"]
    unknown = ["CALENDAR_ID_MISSING", "COVERAGE_MISSING", "DATA_MODE_NOT_PREDECLARED_TICK", "INSTRUMENT_SCOPE_MISMATCH", "LICENSE_REFERENCE_MISSING", "QUALIFICATION_POLICY_IDENTITY_MISMATCH", "QUALITY_CALENDAR_IDENTITY_MISMATCH"]
    unknown += ["SOURCE_IDENTITY_INCOMPLETE", "SOURCE_NOT_PREDECLARED_FEED", "SOURCE_VERSION_MISSING", "TIMEFRAME_SCOPE_MISMATCH", "TIMESTAMP_SEMANTICS_UNSUPPORTED"]
    assert got[5].blockers == unknown and {c.name for c in got[5].checks if c.state == "blocked"} == {"source_version", "license_reference", "qualification_policy"}


def test_zero_volume_ignores_null_volumes(spark):
    bars = spark.createDataFrame([("s", 4 * 86_400 + k * H, 1.0, 1.0 + (k == 2), 1.0, 1.0, v) for k, v in enumerate([0, 0, 0, None, 1, 0])] + [("s", 2 * 86_400, 1.0, 1.0, 1.0, 1.0, 0)], "symbol string, bar long, open double, high double, low double, close double, volume long")
    got = {(r.label, r.value): r.n for r in C.zero_volume_distribution(bars, C.sessions(spark, C.UTC_FOREX, 0, 30 * 86_400), "UTC", H).collect()}
    assert (got["session", "active"], got["session", "closed"], got["movement", "flat"], got["movement", "moving"], got["run_length", "3"], got["run_length", "1"]) == (4, 1, 3, 1, 1, 1)


def test_scenarios_of_one_group(spark):
    trades = spark.createDataFrame([(1, "a", 0, 100.0, 50.0, 1.0, 1.0, 0.0), (2, "a", 86_400, -100.0, -60.0, 1.0, 0.0, 1.0), (3, "a", 86_400, 100.0, 30.0, 1.0, 1.0, -5.0)], "id int, group string, t long, notional double, gross double, fee double, spread double, slippage double")
    got = {r.scenario: r for r in T.scenario_metrics(trades, 1000.0, {"one": 1.0, "ten": 10.0}, 252).collect()}
    assert got["one"].total_return == pytest.approx((50 - 2 - 60 - 2) / 1000) and got["ten"].total_return == pytest.approx((50 - 20 - 60 - 20) / 1000)
    assert (got["one"].trades, got["one"].turnover, got["ten"].total_fees, got["one"].win_rate) == (3, 0.3, 30.0, 0.5)
    assert got["one"].max_drawdown == pytest.approx(986 / 1048 - 1)

"""Ingestion runs: the candidates of many requests are checked against the scope of their request, written once, inspected
over the stored series, and each run gets its counts, its states and the version of its data set.

A series is (symbol, timeframe, source, policy). A request (request, symbol, timeframe, source, policy, configuration,
start, stop, error) asks a source for one of them over start <= bar < stop (epoch seconds); error is null unless the source
failed. Findings are rows (request, bar, code, severity, n), counted before any shuffle, so many copies of a bar are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import dataset_fingerprint
from .quality import validate_bars

SERIES = ("symbol", "timeframe", "source", "policy")
CONTENT = ("open", "high", "low", "close", "volume")
FOUND = ("request", "bar", "code", "severity", "n")


def checked(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """candidates (request, row_no, symbol, timeframe, policy, bar, prices, volume, bid, ask, quote_time) with code, null where the bar is accepted.

    A symbol, timeframe or policy that differs from the request's (null differs from every value) comes before the faults of the row,
    a time outside the request after them. A null time is a timezone_inconsistency. Candidates of failed or unknown requests go."""
    asked = requests.where("error is null").select("request", "source", "start", "stop", *[F.col(c).alias(f"asked_{c}") for c in ("symbol", "timeframe", "policy")])
    rows = validate_bars(candidates.drop("source")).join(asked, "request")
    other = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"asked_{c}")) for c in ("symbol", "timeframe", "policy")])
    inside = (F.col("bar") >= F.col("start")) & (F.col("bar") < F.col("stop"))
    code = F.when(other, "invalid_ohlc").when(F.col("bar").isNull(), "timezone_inconsistency").when(F.col("reject_code").isNotNull(), F.col("reject_code")).when(~inside, "provider_inconsistency")
    return rows.withColumn("code", code).drop("reject_code", "start", "stop", "asked_symbol", "asked_timeframe", "asked_policy")


def answers(told: DataFrame) -> DataFrame:
    """Accepted bars of checked candidates, once a request and time (the first row_no), with copies: how many rows the request had of them."""
    content = F.struct("row_no", *SERIES, *CONTENT)
    once = told.where("code is null").groupBy("request", "bar").agg(F.min_by(content, "row_no").alias("x"), F.count("*").alias("copies"))
    return once.select("request", "bar", "x.*", "copies")


def written(valid: DataFrame, stored: DataFrame) -> DataFrame:
    """answers with new: whether the store (SERIES, bar, CONTENT) lacked the bar and no earlier request of the job (by name) brought it."""
    key = [*SERIES, "bar"]
    first = valid.groupBy(*key).agg(F.min("request").alias("_first"))
    known = stored.select(*key, F.lit(True).alias("_known")).distinct()
    rows = valid.join(first, key).join(known, key, "left")
    return rows.withColumn("new", F.col("_known").isNull() & (F.col("_first") == F.col("request"))).drop("_first", "_known")


def store_after(rows: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select(*SERIES, "bar", *CONTENT).unionByName(rows.where("new").select(*SERIES, "bar", *CONTENT))


def of_requests(store: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored bars of each request that did not fail: its series and range."""
    asked = requests.where("error is null").select("request", *SERIES, "start", "stop")
    return store.join(asked, [*SERIES], "inner").where("bar >= start and bar < stop").select("request", *SERIES, "bar", *CONTENT)


def found(rows: DataFrame, code: str, severity: str, n: Column | None = None) -> DataFrame:
    return rows.select("request", "bar", F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def inspect(bars: DataFrame, grid: DataFrame, most_jump: float = 0.2) -> DataFrame:
    """Findings on sets of bars (request, SERIES, bar, row_no, open, close) against the times that a request should have (request, bar).

    provider_inconsistency: a bar of another series than the set's first one (by time, then row_no). duplicate_bar: further rows of
    a series and time; only the first row of each counts below. missing_bar and unexpected_frequency: times of the grid that no series
    of the set has, and the reverse; a set without bars misses none. suspicious_jump: an open that differs from the positive close of the
    row before it by more than that share. Times are windowed by set, so a set's bars (not its ticks) meet in one task."""
    of = F.struct(*SERIES)
    first = bars.groupBy("request").agg(F.min_by(of, F.struct("bar", "row_no")).alias("_of"))
    mixed = bars.join(first, "request").where(~of.eqNullSafe(F.col("_of"))).groupBy("request", "bar").agg(F.count("*").alias("n"))
    unique = bars.groupBy("request", *SERIES, "bar").agg(F.min_by(F.struct("row_no", "open", "close"), "row_no").alias("x"), F.count("*").alias("k"))
    again = unique.groupBy("request", "bar").agg(F.sum(F.col("k") - 1).alias("n")).where("n > 0")
    times = unique.select("request", "bar").distinct()
    missing = grid.join(first.select("request"), "request", "left_semi").join(times, ["request", "bar"], "left_anti")
    odd = times.join(grid, ["request", "bar"], "left_anti")
    before = F.lag("x.close").over(Window.partitionBy("request").orderBy("bar", "x.row_no"))
    jump = F.when(before > 0, F.abs(F.col("x.open") - before) / before)
    jumps = unique.select("request", "bar", jump.alias("jump")).where(F.col("jump") > most_jump).groupBy("request", "bar").agg(F.count("*").alias("n"))
    each = [
        found(mixed, "provider_inconsistency", "error", F.col("n")), found(again, "duplicate_bar", "warning", F.col("n")), found(missing, "missing_bar", "error"),
        found(odd, "unexpected_frequency", "error"), found(jumps, "suspicious_jump", "warning", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, each)


def run_events(told: DataFrame, rows: DataFrame, inspected: DataFrame) -> DataFrame:
    """All findings of the runs: rejected candidates (errors), copies in one answer (warnings), bars that were stored already (infos), and those of the inspection."""
    rejected = told.where("code is not null").groupBy("request", "bar", "code").agg(F.count("*").alias("n"))
    each = [
        rejected.select("request", "bar", "code", F.lit("error").alias("severity"), "n"), found(rows.where("copies > 1"), "duplicate_bar", "warning", F.col("copies") - 1),
        found(rows.where("not new"), "duplicate_bar", "info"), inspected.select(*FOUND),
    ]
    return reduce(DataFrame.unionByName, each)


def utc(seconds: Column) -> Column:
    """2024-01-31T05:00:00+00:00 of epoch seconds, in any session zone."""
    day, rest = F.floor(seconds / 86_400), F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("T%02d:%02d:%02d+00:00", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), clock)


def dataset_version(requests: DataFrame, held: DataFrame) -> DataFrame:
    """request, fingerprint, dataset_version: the content hash of a request's stored bars (see dataset_fingerprint; without bars the hash of nothing) and the SHA-256 of request, policy, configuration and fingerprint as JSON with sorted keys. Identities are expected to be ASCII."""
    prints = dataset_fingerprint(held, CONTENT, "request")
    rows = requests.join(prints, "request", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.sha2(F.lit(""), 256)))
    parts = {"adjustment_policy": F.col("policy"), "bar_fingerprint": F.col("fingerprint"), "configuration_version": F.col("configuration"), "end": utc(F.col("stop")), "provider": F.col("source"), "start": utc(F.col("start")), "symbol": F.col("symbol"), "timeframe": F.col("timeframe")}
    payload = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})
    return rows.select("request", "fingerprint", F.sha2(payload, 256).alias("dataset_version"))


def run_summary(requests: DataFrame, told: DataFrame, rows: DataFrame, events: DataFrame, versions: DataFrame) -> DataFrame:
    """One row a request: received, accepted (written), rejected, duplicates (in the answer and in the store), warnings, errors, quality_status, status and data-set version.

    status: failed where the source failed (no counts, no version), partial where rows were rejected, stood in the store or gave findings, else success."""
    seen = told.groupBy("request").agg(F.count("*").alias("received"), F.count("code").alias("rejected"))
    kept = rows.groupBy("request").agg(F.count_if("new").alias("accepted"), F.count_if(~F.col("new")).alias("stored"), F.sum(F.col("copies") - 1).alias("copies"))
    of = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0))
    sums = events.groupBy("request").agg(of("warning").alias("warnings"), of("error").alias("errors"), F.sum("n").alias("findings"))
    out = requests.select("request", "error").join(seen, "request", "left").join(kept, "request", "left").join(sums, "request", "left").join(versions.select("request", "dataset_version"), "request", "left")
    out = out.fillna(0, ["received", "rejected", "accepted", "stored", "copies", "warnings", "errors", "findings"])
    failed = F.col("error").isNotNull()
    quality = F.when(F.col("errors") > 0, "error").when(F.col("findings") > 0, "warning").otherwise("clean")
    partial = (F.col("rejected") > 0) | (F.col("stored") > 0) | (quality != "clean")
    return out.select(
        "request", "received", "accepted", "rejected", (F.col("stored") + F.col("copies")).alias("duplicates"), "warnings", "errors", F.when(~failed, quality).alias("quality_status"),
        F.when(failed, "failed").when(partial, "partial").otherwise("success").alias("status"), F.when(~failed, F.col("dataset_version")).alias("dataset_version"), F.col("error").alias("error_message"),
    )

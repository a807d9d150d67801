"""Registered queries of ingestion runs, inspections and admission preflights, with the DuckDB SQL that must give the same rows.

Requests ask for 29 days of each block of 30 days of an hourly series; the source of one series fails in every second block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import seconds
from barloom.operators import bars as B
from barloom.operators import calendars as C
from barloom.operators import gates as G
from barloom.operators import quality as K
from barloom.operators import runs as U
from barloom.operators import trading as T
from barloom.sources import tables as S

from .desk import candidates, tick_report_
from .queries import COSTS, HOUR, OPEN, SQL, bad_ticks, bars, bars_sql, query
from .sessions import TIMES, _local, tables, times, week_open

BLOCK = 30 * 86_400
_request = "concat(symbol, '/', cast(floor(bar / 2592000) as bigint))"
_odd = {"timeframe": "case when h % 19 = 0 then '4h' else '1h' end", "policy": "case when h % 23 = 0 then 'split' else 'raw' end"}


def requests(s: SparkSession, d: str) -> DataFrame:
    blocks = bars(s, d).select("symbol", F.floor(F.col("bar") / BLOCK).alias("k")).distinct()
    return blocks.selectExpr("concat(symbol, '/', k) as request", "symbol", "'1h' as timeframe", "'feed' as source", "'raw' as policy", "'c1' as configuration", "k * 2592000 as start", "k * 2592000 + 2505600 as stop", "case when symbol = 'error' and k % 2 = 0 then 'timeout' end as error")


def answered(s: SparkSession, d: str) -> DataFrame:
    """Candidates of every request: faulty prices, volumes and quotes by hour, other timeframes and policies, every fourth hour twice."""
    rows = candidates(s, d).withColumn("copy", F.explode(F.when(F.col("h") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.withColumns({"request": F.expr(_request), "row_no": F.col("h") * 2 + F.col("copy"), **{n: F.expr(e) for n, e in _odd.items()}})


def stored(s: SparkSession, d: str) -> DataFrame:
    """Every sixth hour is stored already; the store also has a series of another policy."""
    rows = bars(s, d).select("symbol", F.lit("1h").alias("timeframe"), F.lit("feed").alias("source"), "bar", *U.CONTENT)
    of = lambda k, policy: rows.where(F.floor(F.col("bar") / HOUR) % k == 0).withColumn("policy", F.lit(policy))
    return of(6, "raw").unionByName(of(10, "split"))


def grid(s: SparkSession, asked: DataFrame, lo: int, hi: int) -> DataFrame:
    spans = asked.select(F.col("request").alias("symbol"), F.col("start").alias("a"), F.col("stop").alias("b"))
    return C.expected(spans, C.sessions(s, C.UTC_FOREX, lo, hi), C.UTC_FOREX, HOUR).withColumnRenamed("symbol", "request")


#: The sessions cover 2000 to 2039.
SESSIONS = (946_684_800, 2_208_988_800)


def runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(findings, summaries) of all requests."""
    asked = requests(s, d)
    told = U.checked(answered(s, d), asked)
    rows = U.written(U.answers(told), stored(s, d))
    held = U.of_requests(U.store_after(rows, stored(s, d)), asked)
    events = U.run_events(told, rows, U.inspect(held.withColumn("row_no", F.lit(0)), grid(s, asked, *SESSIONS)))
    return events, U.run_summary(asked, told, rows, events, U.dataset_version(asked, held))


_values = ", ".join(U.CONTENT)
_hash = " || '|' || ".join(["symbol", "bar", *[f"printf('%.8f', {c}::double)" for c in U.CONTENT]])
RUNS = f"""{bars_sql(HOUR)}, rq as (select distinct symbol || '/' || bar // {BLOCK} as request, symbol, bar // {BLOCK} * {BLOCK} as start, bar // {BLOCK} * {BLOCK} + 2505600 as stop, symbol = 'error' and bar // {BLOCK} % 2 = 0 as failed from bars),
  ca as (select symbol, bar, bar // 3600 as h, open, low, case when bar // 3600 % 5 = 0 then low - 1 else high end as high, case when bar // 3600 % 7 = 0 then -close else close end as close, case when bar // 3600 % 11 = 0 then -1 else volume end as volume from bars),
  cc as (select *, unnest(case when h % 4 = 0 then [0, 1] else [0] end) as copy from ca),
  tl as (select request, bar, copy, cc.symbol, {_values}, case when h % 19 = 0 or h % 23 = 0 then 'invalid_ohlc' when volume < 0 then 'negative_volume' when least(open, high, low, close) <= 0 then 'invalid_price'
    when high < greatest(open, close, low) or low > least(open, close, high) or h % 13 = 0 then 'invalid_ohlc' when h % 17 = 0 then 'timezone_inconsistency' when bar >= stop then 'provider_inconsistency' end as code from cc join rq on cc.symbol = rq.symbol and cc.bar // {BLOCK} * {BLOCK} = start where not failed),
  va as (select request, symbol, bar, {", ".join(f"any_value({c}) as {c}" for c in U.CONTENT)}, count(*) as copies, any_value(bar // 3600 % 6 = 0) as old from tl where code is null group by 1, 2, 3),
  sa as (select symbol, bar, {_values} from bars where bar // 3600 % 6 = 0 union all select symbol, bar, {_values} from va where not old),
  he as (select request, sa.* from sa join rq on sa.symbol = rq.symbol and bar >= start and bar < stop where not failed),
  gr as (select request, unnest(range(start, stop, 3600)) as bar from rq where request in (select request from he)),
  ev as (select request, bar, code, 'error' as severity, count(*) as n from tl where code is not null group by 1, 2, 3 union all select request, bar, 'duplicate_bar', 'warning', copies - 1 from va where copies > 1
    union all select request, bar, 'duplicate_bar', 'info', 1 from va where old union all select request, bar, 'missing_bar', 'error', 1 from gr where {OPEN} and (request, bar) not in (select request, bar from he)
    union all select request, bar, 'unexpected_frequency', 'error', 1 from he where not {OPEN}
    union all select request, bar, 'suspicious_jump', 'warning', 1 from (select *, lag(close) over (partition by request order by bar) as p from he) where p > 0 and abs(open - p) / p > 0.2)"""
query("ingestion_events", f"with {RUNS} select * from ev")(lambda s, d: runs(s, d)[0])
_iso = lambda c: f"strftime(timezone('UTC', to_timestamp({c})), '%Y-%m-%dT%H:%M:%S+00:00')"
query(
    "ingestion_runs",
    f"""with {RUNS}, dh as (select request, bar // 86400 as day, sha256(string_agg(h, '' order by h)) as h from (select request, bar, sha256({_hash}) as h from he) group by 1, 2), fp as (select request, sha256(string_agg(h, '' order by day)) as f from dh group by 1),
    t as (select request, count(*) as received, count(code) as rejected from tl group by 1), v as (select request, count(*) filter (not old) as accepted, count(*) filter (old) as again, sum(copies - 1) as copies from va group by 1),
    e as (select request, sum(n) filter (severity = 'warning') as warnings, sum(n) filter (severity = 'error') as errors, sum(n) as n from ev group by 1),
    j as (select request, failed, symbol, start, stop, coalesce(received, 0) as received, coalesce(accepted, 0) as accepted, coalesce(rejected, 0) as rejected, coalesce(again, 0) as again, coalesce(copies, 0) as copies, coalesce(warnings, 0) as warnings, coalesce(errors, 0) as errors, coalesce(n, 0) as n, coalesce(f, sha256('')) as f
      from rq left join t using (request) left join v using (request) left join e using (request) left join fp using (request))
    select request, received, accepted, rejected, cast(again + copies as bigint) as duplicates, cast(warnings as bigint) as warnings, cast(errors as bigint) as errors, case when failed then null when errors > 0 then 'error' when n > 0 then 'warning' else 'clean' end as quality_status,
    case when failed then 'failed' when rejected + again + n > 0 then 'partial' else 'success' end as status, case when not failed then sha256('{{"adjustment_policy":"raw","bar_fingerprint":"' || f || '","configuration_version":"c1","end":"' || {_iso("stop")} || '","provider":"feed","start":"' || {_iso("start")} || '","symbol":"' || symbol || '","timeframe":"1h"}}') end as dataset_version,
    case when failed then 'timeout' end as error_message from j""",
)(lambda s, d: runs(s, d)[1])


def mixed_sets(s: SparkSession, d: str) -> DataFrame:
    """Sets of bars by symbol: some hours twice, some of another source, some with prices that jump."""
    rows = bars(s, d).withColumn("h", F.floor(F.col("bar") / HOUR))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("h") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        F.col("symbol").alias("request"), "symbol", F.lit("1h").alias("timeframe"), F.when(F.col("h") % 18 == 0, "feed").when(F.col("h") % 9 == 0, F.concat(F.lit("feed"), "copy")).otherwise("feed").alias("source"),
        F.lit("raw").alias("policy"), "bar", (F.col("h") * 2 + F.col("copy")).alias("row_no"), (F.col("open") * F.when(F.col("h") % 25 == 0, 3).otherwise(1)).alias("open"), "close",
    )


query(
    "inspect_series",
    f"""with {bars_sql(HOUR)}, c as (select symbol, bar, bar // 3600 as h, open, close, unnest(case when bar // 3600 % 9 = 0 then [0, 1] else [0] end) as copy from bars),
    b as (select symbol, bar, h * 2 + copy as row_no, case when h % 18 = 0 or h % 9 <> 0 then 'feed' else 'feed' || copy end as source, open * case when h % 25 = 0 then 3 else 1 end as open, close from c),
    f as (select symbol, arg_min(source, row_no) as first from b group by 1), u as (select symbol, source, bar, min(row_no) as row_no, arg_min(open, row_no) as open, arg_min(close, row_no) as close, count(*) as k from b group by 1, 2, 3), g as (select symbol, unnest(range(min(bar) // 3600 * 3600, max(bar) + 1, 3600)) as bar from b group by 1)
    select symbol as request, bar, 'provider_inconsistency' as code, 'error' as severity, count(*) as n from b join f using (symbol) where source <> first group by 1, 2
    union all select symbol, bar, 'duplicate_bar', 'warning', cast(sum(k - 1) as bigint) from u group by 1, 2 having sum(k - 1) > 0
    union all select symbol, bar, 'missing_bar', 'error', 1 from g where {OPEN} and (symbol, bar) not in (select symbol, bar from b) union all select distinct symbol, bar, 'unexpected_frequency', 'error', 1 from b where not {OPEN}
    union all select symbol, bar, 'suspicious_jump', 'warning', count(*) from (select *, lag(close) over (partition by symbol order by bar, row_no) as p from u) where p > 0 and abs(open - p) / p > 0.2 group by 1, 2""",
)(lambda s, d: (lambda b: U.inspect(b, grid(s, b.groupBy("request").agg(F.min("bar").alias("start"), (F.max("bar") + 1).alias("stop")), *SESSIONS)))(mixed_sets(s, d)))


# Admission preflights

#: Fields of manifests by key.
RECORD = {
    "classification": "case when k % 13 = 0 then 'test_fixture' else 'empirical' end",
    "source": "case when k % 11 = 0 then 'other' else 'feed' end",
    "source_version": "case when k % 7 = 0 then null when k % 9 = 0 then '' else 'v1' end",
    "instrument": "case when k % 24 = 0 then 'b' else 'a' end",
    "timeframe": "case when k % 10 = 0 then '1h' else '15m' end",
    "source_mode": "case when k % 14 = 0 then 'bar' when k % 15 = 0 then null else 'tick' end",
    "timestamp_semantics": "case when k % 16 = 0 then 'bar_end' else 'bar_start' end",
    "calendar_id": "case when k % 18 = 0 then '  ' else 'week' end",
    "coverage_start": "case when k % 21 = 0 then null else 1000000000 end",
    "coverage_end": "1000000000 + k % 400 * 86400 + 100 * 86400",
    "license_reference": "case when k % 22 = 0 then '' else 'terms' end",
    "manifest_source_version": "case when k % 12 = 0 then 'm1' end",
    "policy_identity": "case when k % 25 = 0 then 'old' else 'p1' end",
}
STATES = {
    "record_status": "case when k % 29 = 0 then 'missing' when k % 31 = 0 then 'hash_mismatch' else 'verified' end",
    "raw_status": "case when k % 23 = 0 then 'hash_mismatch' else 'verified' end",
    "normalized_status": "case when k % 19 = 0 then 'missing' else 'verified' end",
    "quality_report_status": "case when k % 17 = 0 then 'invalid_schema' else 'verified' end",
}
#: Counters of a preflight from those of a tick quality report; every second data set was cleaned.
COUNTERS = {
    "invalid_ticks": "invalid_tick_count", "duplicate_timestamps": "duplicate_timestamps", "non_monotonic_timestamps": "non_monotonic_timestamps", "crossed_quotes": "crossed_quote_count", "nonpositive_prices": "nonpositive_price_count",
    "nonfinite_prices": "nonfinite_price_count", "volume_anomalies": "volume_anomaly_count", "ohlc_violations": "case when k % 28 = 0 then -1 else ohlc_violations end", "unexpected_gaps": "unexpected_gaps",
    "unknown_gaps": "case when k % 27 = 0 then null else 0 end", "active_session_zero_volume": "active_session_zero_volume",
}
_counter = lambda e: e if e.startswith("case") else f"case when k % 2 = 0 then 0 else {e} end"


def manifests(s: SparkSession, d: str) -> DataFrame:
    """A data set of each part, with the tick quality report of one of the series; every sixth has no report."""
    report = tick_report_(s, d)
    symbols = bad_ticks(s, d).select("symbol").distinct()
    place = symbols.join(symbols.withColumnRenamed("symbol", "other"), F.col("other") < F.col("symbol"), "left").groupBy("symbol").agg(F.count("other").alias("i"))
    rows = S.table(s, d, "part").selectExpr("p_partkey as k", "p_partkey % 6 as i").join(report.join(place, "symbol"), "i", "left")
    record = ", ".join(f"{e} as {n}" for n, e in RECORD.items())
    counters = ", ".join(f"cast({_counter(e)} as bigint) as {n}" for n, e in COUNTERS.items())
    return rows.selectExpr(
        "k as dataset", *[f"{e} as {n}" for n, e in STATES.items()], f"case when k % 29 > 0 then struct({record}) end as record",
        f"case when symbol is not null then struct({counters}, case when k % 26 = 0 then 'other' else 'week' end as calendar_id, cast(missing_intervals as bigint) as missing_intervals) end as report",
    )


_blockers = [
    *[f"case when {n} <> 'verified' then '{p}_' || upper({n}) end" for n, p in (("record_status", "DATASET_RECORD"), ("raw_status", "RAW_ARTIFACT"), ("normalized_status", "NORMALIZED_CONTENT"), ("quality_report_status", "QUALITY_REPORT"))],
    *[f"case when has and {test} then '{name}' end" for name, test in {
        "QUALITY_REPORT_UNREADABLE": "not there", "FIXTURE_DATASET_NOT_ALLOWED": "classification = 'test_fixture'", "SOURCE_VERSION_MISSING": "source_version is null", "SOURCE_NOT_PREDECLARED_FEED": "source <> 'feed'",
        "INSTRUMENT_SCOPE_MISMATCH": "instrument <> 'a'", "TIMEFRAME_SCOPE_MISMATCH": "timeframe <> '15m'", "DATA_MODE_NOT_PREDECLARED_TICK": "source_mode is distinct from 'tick'", "TIMESTAMP_SEMANTICS_UNSUPPORTED": "timestamp_semantics <> 'bar_start'",
        "CALENDAR_ID_MISSING": "trim(calendar_id) = ''", "COVERAGE_MISSING": "coverage_start is null", "COVERAGE_SHORT_FOR_DECLARED_PROTOCOL": "coverage_end - coverage_start < 180 * 86400", "LICENSE_REFERENCE_MISSING": "license_reference = ''",
        "SOURCE_IDENTITY_INCOMPLETE": "manifest_source_version is null and coalesce(source_version, '') = ''", "QUALIFICATION_POLICY_IDENTITY_MISMATCH": "there and policy_identity <> 'p1'", "QUALITY_CALENDAR_IDENTITY_MISMATCH": "there and report_calendar <> calendar_id",
    }.items()],
    *[f"case when has and there then case when q_{n} is null or q_{n} < 0 then 'QUALITY_FIELD_INVALID_{n.upper()}' when q_{n} > 0 then 'QUALITY_{n.upper()}_' || q_{n} end end" for n in COUNTERS],
]
query(
    "admission_preflight",
    f"""with rp as (select *, row_number() over (order by symbol) - 1 as i from ({SQL["tick_quality_report"]})),
    mm as (select k, {", ".join(f"{e} as {n}" for n, e in (RECORD | STATES).items())}, k % 29 > 0 as has, symbol is not null as there, case when k % 26 = 0 then 'other' else 'week' end as report_calendar, missing_intervals, {", ".join(f"cast({_counter(e)} as bigint) as q_{n}" for n, e in COUNTERS.items())}
      from (select p_partkey as k from part) left join rp on i = k % 6),
    bb as (select *, list_sort(list_filter([{", ".join(_blockers)}], lambda x: x is not null)) as b from mm)
    select k as dataset, array_to_string(b, ',') as blockers, case when has and there and missing_intervals > 0 then 'MISSING_INTERVALS_' || cast(missing_intervals as bigint) || '_INCLUDING_EXPECTED_CLOSURES' else '' end as warnings, case when len(b) = 0 then 'qualified' else 'rejected' end as verdict,
    case when len(b) = 0 then 'empirically_qualified_dataset' when has and classification = 'test_fixture' then 'deterministic_test_fixture' else 'blocked' end as eligibility,
    array_to_string(list_filter({sorted(G.PREFLIGHT_CHECKS)}, lambda n: len(list_filter(b, lambda x: contains(lower(x), n))) > 0), ',') as blocked_checks from bb""",
)(
    lambda s, d: G.admission_preflight(manifests(s, d), "p1", "feed", ["a"], "15m").select(
        "dataset", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"), "verdict", "eligibility",
        F.array_join(F.transform(F.filter("checks", lambda x: x["state"] == "blocked"), lambda x: x["name"]), ",").alias("blocked_checks"),
    )
)


# Zero volume and cost scenarios


def order_hours(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars of order prices; hours whose order keys sum to a multiple of three have no volume."""
    rows = times(s, d).join(S.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    at = F.struct("t", "o_orderkey")
    return rows.groupBy("symbol", (F.floor(F.col("t") / HOUR) * HOUR).alias("bar")).agg(
        F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"), (F.sum("o_orderkey") % 3).alias("volume"),
    )


query(
    "zero_volume_distribution",
    f"""with {TIMES}, h as (select symbol, t // 3600 * 3600 as bar, min(o_totalprice) = max(o_totalprice) as flat from tm join orders using (o_orderkey) group by 1, 2 having sum(o_orderkey) % 3 = 0),
    z as (select *, {_local.format("bar")} as n, timezone('UTC', to_timestamp(bar)) as u from h), o as (select * from z where {week_open("n", 61200)}),
    l as (select symbol, unnest(['month', 'weekday', 'hour', 'dst', 'movement']) as label, unnest([date_part('month', n)::varchar, ((date_part('dow', n) + 6) % 7)::bigint::varchar, date_part('hour', n)::varchar, (n - u > interval '-5 hours')::varchar, case when flat then 'flat' else 'moving' end]) as value from o),
    r as (select symbol, bar - 3600 * row_number() over (partition by symbol order by bar) as run from o), q as (select symbol, run, count(*) as k from r group by 1, 2)
    select symbol, label, value, count(*) as n from l group by 1, 2, 3 union all select symbol, 'run_length', k::varchar, count(*) from q group by 1, 2, 3
    union all select symbol, 'session', case when {week_open("n", 61200)} then 'active' else 'closed' end, count(*) from z group by 1, 2, 3""",
)(lambda s, d: C.zero_volume_distribution(order_hours(s, d), tables(s)[C.NEW_YORK_FOREX.name], "America/New_York", HOUR))

START = 1e8


def sales(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("group"), seconds("l_shipdate").alias("t"), F.col("l_extendedprice").alias("notional"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("gross"),
        (F.col("l_quantity") * 0.5).alias("fee"), (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("spread"), (F.col("l_quantity") * 0.25).alias("slippage"), F.lit(60).alias("held"),
    )


query(
    "scenario_metrics",
    f"""with x as (select l_returnflag as g, cast(epoch(l_shipdate) as bigint) as t, l_extendedprice as notional, l_extendedprice * (l_discount - 0.05::double) as gross, l_quantity * 0.75 + l_extendedprice * l_tax / 100 as cost, l_quantity * 0.5 as fee from lineitem),
    y as (select *, unnest([1, 2, 3]) as m, unnest(['base', 'double', 'triple']) as scenario from x), dd as (select g, scenario, t, sum(gross - m * cost) as net from y group by 1, 2, 3), cu as (select g, scenario, t, {START} + sum(net) over (partition by g, scenario order by t) as e from dd),
    a as (select *, e / nullif(lag(e) over w, 0) - 1 as ret, e / max(e) over w - 1 as fall from cu window w as (partition by g, scenario order by t)),
    p as (select g, scenario, arg_max(e, t) as l, (max(t) - min(t)) / 86400.0::double / 365.2425::double as y, avg(ret) as m, stddev_pop(ret) as sd, sqrt(avg(case when ret is not null then power(least(ret, 0), 2) end)) as dn, min(fall) as low from a group by 1, 2),
    s as (select g, scenario, count(*) as trades, sum(notional) as notional, sum(m * fee) as fees, avg(case when gross - m * cost > 0 then 1.0 else 0.0 end) as wins, avg(gross - m * cost) as expectancy from y group by 1, 2)
    select g as "group", scenario, round(l / {START} - 1, 6) as total_return, round(power(l / {START}, 1 / y) - 1, 6) as cagr, round(sd * sqrt(252), 6) as volatility, round(m / nullif(sd, 0) * sqrt(252), 4) as sharpe, round(m / nullif(dn, 0) * sqrt(252), 4) as sortino, round(low, 6) as max_drawdown,
    round((power(l / {START}, 1 / y) - 1) / nullif(abs(low), 0), 4) as calmar, trades, round(notional / {START}, 6) as turnover, round(fees, 1) as total_fees, round(wins, 6) as win_rate, round(expectancy, 4) as expectancy from p join s using (g, scenario)""",
)(
    lambda s, d: T.scenario_metrics(sales(s, d), START, COSTS, 252).select(
        "group", "scenario", *[F.round(c, 6).alias(c) for c in ("total_return", "cagr", "volatility", "max_drawdown", "turnover", "win_rate")], *[F.round(c, 4).alias(c) for c in ("sharpe", "sortino", "calmar", "expectancy")], "trades", F.round("total_fees", 1).alias("total_fees")
    )
)

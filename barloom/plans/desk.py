"""Registered queries of validation, reports, ledgers, rules and research, with the DuckDB SQL that must give the same rows.

Malformed rows and rule inputs come from the given tables by key rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import ledger as L
from barloom.operators import quality as K
from barloom.sources import tables as S

from .queries import BAD_TICKS, DAYS, FILLS, GRID, HOUR, OPEN, TICKS, VALID_TICKS, bad_ticks, bars, bars_sql, query, r6

HB = f"with {bars_sql(HOUR)}"


def cents(df: DataFrame, *names: str) -> DataFrame:
    """Money to two places; a small shift keeps exact halves, of which averages of prices have many, away from the rounding edge."""
    return df.withColumns({n: F.round(F.col(n) + 0.00123, 2) for n in names})


def c2(expression: str) -> str:
    return f"round({expression} + 0.00123::double, 2)"


# Validation


FOUND = f"""{BAD_TICKS},
  found as (select symbol, row_no, case when us = p then 'duplicate_timestamp' else 'non_monotonic_timestamp' end as code from (select *, lag(us) over (partition by symbol order by row_no) as p from bt) where us <= p
  {" ".join(f"union all select symbol, row_no, case when {c} is null then 'missing_price' when not isfinite({c}) then 'nonfinite_price' when {c} <= 0 then 'nonpositive_price' end from bt" for c in ("bid", "ask"))}
  union all select symbol, row_no, 'crossed_quote' from bt where isfinite(bid) and isfinite(ask) and bid > ask
  {" ".join(f"union all select symbol, row_no, case when {c} is null then 'missing_volume' when not isfinite({c}) or {c} < 0 then 'volume_anomaly' end from bt" for c in ("bid_volume", "ask_volume"))})"""
query("validate_ticks", f"with {FOUND} select symbol, row_no, code from found where code is not null")(lambda s, d: K.validate_ticks(bad_ticks(s, d)))
_n = lambda *codes: f"count(*) filter (code in ({', '.join(repr(c) for c in codes)}))"
query(
    "tick_validation_report",
    f"""with {FOUND}, n as (select symbol, count(*) as row_count from bt group by 1),
    c as (select symbol, count(distinct row_no) as invalid_tick_count, {_n("duplicate_timestamp", "non_monotonic_timestamp")} as non_monotonic_timestamps, {_n("duplicate_timestamp")} as duplicate_timestamps,
    {_n("nonfinite_price")} as nonfinite_price_count, {_n("nonpositive_price")} as nonpositive_price_count, {_n("crossed_quote")} as crossed_quote_count, {_n("missing_volume", "volume_anomaly")} as volume_anomaly_count
    from found where code is not null group by 1) select * from n join c using (symbol)""",
)(lambda s, d: K.tick_validation_report(bad_ticks(s, d)))

RANGE = (1_704_153_600, 1_767_225_600)


def candidates(s: SparkSession, d: str) -> DataFrame:
    h = F.floor(F.col("bar") / HOUR)
    rows = bars(s, d).select("symbol", "bar", "open", "low", h.alias("h"), "high", "close", "volume")
    h = F.col("h")
    return rows.select(
        "symbol", "bar", "h", "open", "low", F.when(h % 5 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(h % 7 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(h % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("volume")).alias("volume"), F.lit(10.0).alias("bid"), F.when(h % 13 == 0, 9.0).otherwise(11.0).alias("ask"),
        (F.col("bar") + F.when(h % 17 == 0, -60).otherwise(60)).alias("quote_time"),
    )


CANDIDATES = f"""{bars_sql(HOUR)}, cd as (select symbol, bar, bar // 3600 as h, open, low, case when h % 5 = 0 then low - 1 else high end as hi, case when h % 7 = 0 then -close else close end as cl,
  case when h % 11 = 0 then -1 else volume end as volume, case when h % 13 = 0 then 9 else 11 end as ask, bar + case when h % 17 = 0 then -60 else 60 end as quote_time from bars),
  checked as (select symbol, bar, h, case when volume < 0 then 'negative_volume' when least(open, hi, low, cl) <= 0 then 'invalid_price' when hi < greatest(open, cl, low) or low > least(open, cl, hi) or 10 > ask then 'invalid_ohlc'
  when quote_time < bar then 'timezone_inconsistency' when bar < {RANGE[0]} or bar >= {RANGE[1]} then 'out_of_range' end as reject_code from cd)"""
query("validate_bars", f"with {CANDIDATES} select symbol, bar, reject_code from checked")(lambda s, d: K.validate_bars(candidates(s, d), *RANGE).select("symbol", "bar", "reject_code"))
query(
    "ingestion_run_summary",
    f"""with {CANDIDATES}, twice as (select * from checked union all select * from checked where h % 4 = 0), a as (select *, reject_code is null and row_number() over (partition by symbol, bar, reject_code is null) > 1 as dup from twice),
    b as (select symbol, count(*) as received, count(*) filter (reject_code is null and not dup) as accepted, count(*) filter (reject_code is not null) as rejected, count(*) filter (dup) as duplicates from a group by 1)
    select *, case when accepted = 0 then 'failed' when rejected + duplicates > 0 then 'partial' else 'complete' end as status from b""",
)(lambda s, d: (lambda c: K.ingestion_summary(c.unionByName(c.where("h % 4 = 0")), ["symbol", "bar"], "h"))(K.validate_bars(candidates(s, d), *RANGE)))


def quote_bars(s: SparkSession, d: str) -> DataFrame:
    """Two-sided bars in whole ticks, some with a high or low inside open and close."""
    h = F.floor(F.col("bar") / HOUR)
    t = {n: F.floor(F.col(n) * 100) for n in ("open", "high", "low", "close")}
    top, bottom = F.greatest(t["open"], t["close"]), F.least(t["open"], t["close"])
    return bars(s, d).select(
        "symbol", "bar", t["open"].alias("bid_open"), F.when(h % 7 == 0, top - 3).when(h % 3 == 0, top - 1).otherwise(t["high"]).alias("bid_high"), t["low"].alias("bid_low"), t["close"].alias("bid_close"),
        (t["open"] + 2).alias("ask_open"), (t["high"] + 2).alias("ask_high"), F.when(h % 5 == 0, bottom + 3).otherwise(t["low"] + 2).alias("ask_low"), (t["close"] + 2).alias("ask_close"),
    )


query(
    "repair_one_tick_ohlc",
    f"""{HB}, q0 as (select symbol, bar, bar // 3600 as h, cast(floor(open * 100) as bigint) as o, cast(floor(high * 100) as bigint) as hi, cast(floor(low * 100) as bigint) as lo, cast(floor(close * 100) as bigint) as c from bars),
    q as (select symbol, bar, o, c, lo, case when h % 7 = 0 then greatest(o, c) - 3 when h % 3 = 0 then greatest(o, c) - 1 else hi end as bh, hi + 2 as ah, case when h % 5 = 0 then least(o, c) + 3 else lo + 2 end as al from q0),
    k as (select *, greatest(o, c) - bh as bup, lo - least(o, c) as bdown, greatest(o, c) + 2 - ah as aup, al - least(o, c) - 2 as adown from q),
    m as (select *, bup > 0 or bdown > 0 or bh < lo as bw, aup > 0 or adown > 0 or ah < al as aw from k),
    f as (select *, case when least(o, bh, lo, c) > 0 and bw <> aw then case when bup = 1 and bdown <= 0 then 'bid_high' when bdown = 1 and bup <= 0 then 'bid_low' when aup = 1 and adown <= 0 then 'ask_high' when adown = 1 and aup <= 0 then 'ask_low' end end as repaired from m)
    select symbol, bar, repaired, case when repaired = 'bid_high' then greatest(o, c) else bh end as bid_high, case when repaired = 'bid_low' then least(o, c) else lo end as bid_low, case when repaired = 'ask_high' then greatest(o, c) + 2 else ah end as ask_high,
    case when repaired = 'ask_low' then least(o, c) + 2 else al end as ask_low, case when repaired is not null then bh::varchar end as raw_bid_high from f""",
)(
    lambda s, d: K.repair_one_tick(quote_bars(s, d), 1).select("symbol", "bar", "repaired", "bid_high", "bid_low", "ask_high", "ask_low", F.col("raw_values")["bid_high"].alias("raw_bid_high"))
)

# Reports

def odd_bars(s: SparkSession, d: str) -> DataFrame:
    """Bars with zero, missing and non-finite numbers by key rules."""
    h = F.floor(F.col("bar") / HOUR)
    return bars(s, d).withColumn("h", h).withColumns({
        "open": F.when(F.col("h") % 41 == 0, F.lit(float("nan"))).otherwise(F.col("open")), "high": F.when(F.col("h") % 31 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "close": F.when(F.col("h") % 29 == 0, 0.0).when(F.col("h") % 23 == 0, None).otherwise(F.floor(F.col("close") / 50) * 50), "volume": F.when(F.col("h") % 37 == 0, 0).when(F.col("h") % 43 == 0, None).otherwise(F.col("volume")),
    })


_bad = lambda t: " or ".join(f"coalesce({t.format(c)}, false)" for c in ("open", "high", "low", "close"))
_gaps = lambda t: f"""gp as (select symbol, unnest(range(min(bar), max(bar) + 1, {HOUR})) as bar from {t} group by 1), gaps as (select symbol, count(*) as missing_intervals, count(*) filter (not {OPEN}) as expected_closures, count(*) filter ({OPEN}) as unexpected_gaps
  from gp where (symbol, bar) not in (select symbol, bar from {t}) group by 1)"""  # noqa: E731
_stale = lambda t, order: f"""sr as (select *, sum(case when lag_c = c then 0 else 1 end) over (partition by symbol order by {order}) as run from (select *, lag(c) over (partition by symbol order by {order}) as lag_c from {t})),
  sl as (select *, count(*) over (partition by symbol, run) as len, row_number() over (partition by symbol, run order by {order}) as place from sr)"""  # noqa: E731
REPORT = f"""{bars_sql(HOUR)}, ob as (select symbol, bar, bar // 3600 as h, low, case when h % 41 = 0 then 'nan'::double else open end as open, case when h % 31 = 0 then low - 1 else high end as high,
  case when h % 29 = 0 then 0 when h % 23 = 0 then null else floor(close / 50) * 50 end as close, case when h % 37 = 0 then 0 when h % 43 = 0 then null else volume end as volume from bars),
  oc as (select *, close as c, lag(close) over (partition by symbol order by bar) as before, {OPEN} as active from ob), {_stale("oc", "bar")}, {_gaps("ob")},
  sums as (select symbol, count(*) as row_count, min(bar) as coverage_start, max(bar) + 3600 as coverage_end, 0 as duplicate_count,
  count(*) filter (not ({_bad("{0} is null or not isfinite({0}) or {0} <= 0")}) and (high < greatest(open, high, low, close) or low > least(open, high, low, close))) as invalid_ohlc_count, count(*) filter ({_bad("{0} is null")}) as missing_price_count,
  count(*) filter ({_bad("not isfinite({0})")}) as nonfinite_price_count, count(*) filter ({_bad("isfinite({0}) and {0} <= 0")}) as nonpositive_price_count, count(*) filter (coalesce(volume < 0, true)) as volume_anomaly_count,
  count(*) filter (before > 0 and abs(open - before) > 0.2 * before) as suspicious_jumps, count(*) filter (len >= 3 and place = 1) as stale_sequences, count(*) filter (volume = 0) as zero_volume_bar_count,
  count(*) filter (volume = 0 and active) as active_session_zero_volume, count(*) filter (volume = 0 and not active) as closed_session_zero_volume, count(*) filter (open = high and high = low and low = close) as flat_bar_count,
  count(*) filter (open = high and high = low and low = close and volume = 0) as flat_zero_volume_count, count(*) filter (not active) as closed_session_bar_count from sl group by 1)"""
query("ohlcv_quality_report", f"with {REPORT} select sums.*, coalesce(missing_intervals, 0) as missing_intervals, coalesce(expected_closures, 0) as expected_closures, coalesce(unexpected_gaps, 0) as unexpected_gaps from sums left join gaps using (symbol)")(
    lambda s, d: K.quality_report(odd_bars(s, d), HOUR, stale=3)
)


def odd_quotes(s: SparkSession, d: str) -> DataFrame:
    """Repaired two-sided bars in source order, some twice, some out of order, some crossed or without an ask, with volumes."""
    rows = K.repair_one_tick(quote_bars(s, d), 1).withColumn("h", F.floor(F.col("bar") / HOUR))
    rows = rows.withColumns({
        "ask_close": F.when(F.col("h") % 19 == 0, None).when(F.col("h") % 17 == 0, F.col("bid_close") - 1).otherwise(F.col("ask_close")), "bid_volume": F.when(F.col("h") % 13 == 0, 0.0).when(F.col("h") % 59 == 0, -1.0).otherwise(5.0), "ask_volume": F.lit(6.0),
    })
    # Every eleventh hour comes again with another volume, three rows later.
    twice = rows.withColumn("copy", F.explode(F.when(F.col("h") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumns({"row_no": F.col("h") * 2 + F.col("copy") * 7, "ask_volume": F.col("ask_volume") + F.col("copy")})


_side = lambda p, f: [f(f"{p}_{n}") for n in ("open", "high", "low", "close")]
_raw = lambda n: f"coalesce(raw_{n}, {n})"
_some = lambda xs, t: "(" + " or ".join(f"coalesce({t.format(x)}, false)" for x in xs) + ")"
_wrong = lambda xs: f"({' and '.join(f'{x} is not null' for x in xs)} and ({_some(xs, 'not isfinite({0}) or {0} <= 0')} or {xs[1]} < greatest({', '.join(xs)}) or {xs[2]} > least({', '.join(xs)})))::int"
_same = lambda n: n
QUOTES = f"""{bars_sql(HOUR)}, q0 as (select symbol, bar, bar // 3600 as h, floor(open * 100) as o, floor(high * 100) as hi, floor(low * 100) as lo, floor(close * 100) as c from bars),
  q1 as (select symbol, bar, h, o as bid_open, case when h % 7 = 0 then greatest(o, c) - 3 when h % 3 = 0 then greatest(o, c) - 1 else hi end as bh, lo as bl, c as bid_close, o + 2 as ask_open, hi + 2 as ah, case when h % 5 = 0 then least(o, c) + 3 else lo + 2 end as al, c + 2 as ac from q0),
  q2 as (select *, greatest(bid_open, bid_close) - bh as bup, bl - least(bid_open, bid_close) as bdown, greatest(ask_open, ac) - ah as aup, al - least(ask_open, ac) as adown from q1),
  q3 as (select *, bup > 0 or bdown > 0 or bh < bl as bw, aup > 0 or adown > 0 or ah < al as aw from q2),
  q4 as (select *, case when least(bid_open, bh, bl, bid_close) > 0 and bw <> aw then case when bup = 1 and bdown <= 0 then 'bid_high' when bdown = 1 and bup <= 0 then 'bid_low' when aup = 1 and adown <= 0 then 'ask_high' when adown = 1 and aup <= 0 then 'ask_low' end end as repaired from q3),
  q5 as (select symbol, bar, h, repaired, bid_open, bid_close, ask_open, case when repaired = 'bid_high' then greatest(bid_open, bid_close) else bh end as bid_high, case when repaired = 'bid_low' then least(bid_open, bid_close) else bl end as bid_low,
  case when repaired = 'ask_high' then greatest(ask_open, ac) else ah end as ask_high, case when repaired = 'ask_low' then least(ask_open, ac) else al end as ask_low,
  {", ".join(f"case when repaired is not null then {v} end as raw_{n}" for n, v in (("bid_open", "bid_open"), ("bid_high", "bh"), ("bid_low", "bl"), ("bid_close", "bid_close"), ("ask_open", "ask_open"), ("ask_high", "ah"), ("ask_low", "al"), ("ask_close", "ac")))},
  case when h % 19 = 0 then null when h % 17 = 0 then bid_close - 1 else ac end as ask_close, case when h % 13 = 0 then 0.0::double when h % 59 = 0 then -1.0 else 5.0 end as bid_volume from q4),
  qq as (select *, h * 2 + copy * 7 as row_no, 6.0::double + copy as ask_volume from (select *, unnest(case when h % 11 = 0 then [0, 1] else [0] end) as copy from q5)),
  qc as (select *, bid_close as c, lag(bid_close) over s as before, lag(bar) over s as last, {OPEN} as active, row_number() over b > 1 as again, ask_volume is distinct from first_value(ask_volume) over b as conflict,
  case when isfinite(bid_close) and isfinite(ask_close) then ask_close - bid_close end as spread from qq window s as (partition by symbol order by row_no), b as (partition by symbol, bar order by row_no)), {_stale("qc", "row_no")}, {_gaps("qq")},
  sp as (select symbol, spread, row_number() over (partition by symbol order by spread) as r, count(*) over (partition by symbol) as m from qc where spread is not null),
  sq as (select symbol, median(spread) as median_spread, max(case when r = floor((m - 1) * 0.95::double) + 1 then spread end) as p95_spread, max(case when r = floor((m - 1) * 0.99::double) + 1 then spread end) as p99_spread from sp group by 1),
  sums as (select symbol, count(*) as row_count, min(bar) as coverage_start, max(bar) + 3600 as coverage_end, count(*) filter (again) as duplicate_count, count(*) filter (bar <= last) as non_monotonic_count, count(*) filter (conflict) as conflicting_overlap_count,
  cast(sum({_wrong(_side("bid", _raw))} + {_wrong(_side("ask", _raw))}) as bigint) as invalid_ohlc_before, cast(sum({_wrong(_side("bid", _same))} + {_wrong(_side("ask", _same))}) as bigint) as invalid_ohlc_count, count(repaired) as quantization_adjustment_count,
  sum({" + ".join(f"coalesce(bid_{n} > ask_{n}, false)::int" for n in ("open", "high", "low", "close"))})::bigint as crossed_bid_ask_count, 0 as nonfinite_price_count, sum({" + ".join(f"{_some(_side(p, _raw), '{0} <= 0')}::int" for p in ("bid", "ask"))})::bigint as nonpositive_price_count,
  count(*) filter (bid_volume < 0) as volume_anomaly_count, count(spread) as quote_side_complete_count, count(*) filter (before > 0 and abs(bid_open - before) > 0.2 * before) as suspicious_jumps, count(*) filter (len >= 3 and place = 1) as stale_sequences,
  count(*) filter (bid_volume = 0) as zero_volume_bar_count, count(*) filter (bid_volume = 0 and active) as active_session_zero_volume, count(*) filter (bid_volume = 0 and not active) as closed_session_zero_volume,
  count(*) filter (bid_open = bid_high and bid_high = bid_low and bid_low = bid_close) as flat_bar_count, count(*) filter (bid_open = bid_high and bid_high = bid_low and bid_low = bid_close and bid_volume = 0) as flat_zero_volume_count, min(spread) as min_spread, max(spread) as max_spread from sl group by 1),
  report as (select sums.*, median_spread, p95_spread, p99_spread, coalesce(missing_intervals, 0) as missing_intervals, coalesce(expected_closures, 0) as expected_closures, coalesce(unexpected_gaps, 0) as unexpected_gaps from sums left join sq using (symbol) left join gaps using (symbol))"""
_spreads = ("min_spread", "max_spread", "median_spread", "p95_spread", "p99_spread")


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def quote_report_(s: SparkSession, d: str) -> DataFrame:
    return K.quote_quality_report(odd_quotes(s, d), HOUR, stale=3)


query("quote_quality_report", f"with {QUOTES} select * replace ({', '.join(f'{n}::double as {n}' for n in _spreads)}) from report")(lambda s, d: doubles(quote_report_(s, d), *_spreads))
TOLERANCES = {"suspicious_jumps": 50, "unexpected_gaps": 1_000, "active_session_zero_volume": 2, "volume_anomaly_count": 20, "invalid_ohlc_count": 130, "nonpositive_price_count": 100_000}
_over = ", ".join(f"case when {c} > {TOLERANCES.get(c, 0)} then {name!r} end" for c, name in K.BLOCKERS.items() if c != "schema_drift_count")
query(
    "admission_blockers",
    f"""with {QUOTES}, b as (select symbol, array_to_string(list_sort(list_filter([{_over}, case when quote_side_complete_count <> row_count then 'bid_ask_unavailable' end, case when symbol = 'click' then 'artifact_not_supplied' end,
    case when symbol >= 's' then 'unknown_or_incompatible_calendar' end], lambda x: x is not null)), ',') as blockers from report) select *, case when blockers = '' then 'admitted' else 'blocked' end as state from b""",
)(
    lambda s, d: K.admission_blockers(
        quote_report_(s, d).withColumns({"schema_drift_count": F.lit(0), "artifacts": F.when(F.col("symbol") == "click", 0).otherwise(1), "calendar_ok": F.col("symbol") < "s"}), TOLERANCES
    )
)
GAPS = ("missing_intervals", "expected_closures", "unexpected_gaps")
FINDINGS = ("non_monotonic_timestamps", "duplicate_timestamps", "nonfinite_price_count", "nonpositive_price_count", "crossed_quote_count", "volume_anomaly_count", "invalid_tick_count")


def tick_report_(s: SparkSession, d: str) -> DataFrame:
    """The tick quality report as the SQL has it: counters of gaps or findings are null, not 0, in a series without any."""
    ticks = bad_ticks(s, d)
    report = K.tick_quality_report(B.ticks_to_bars(B.valid_ticks(ticks), 900), K.tick_validation_report(ticks), 900)
    return report.withColumns({n: F.when(F.col(c) > 0, F.col(n)) for c, names in (("missing_intervals", GAPS), ("invalid_tick_count", FINDINGS)) for n in names})


query(
    "tick_quality_report",
    f"""with {FOUND}, n as (select symbol, count(*) as row_count from bt group by 1), fc as (select symbol, count(distinct row_no) as invalid_tick_count, {_n("duplicate_timestamp", "non_monotonic_timestamp")} as non_monotonic_timestamps, {_n("duplicate_timestamp")} as duplicate_timestamps,
    {_n("nonfinite_price")} as nonfinite_price_count, {_n("nonpositive_price")} as nonpositive_price_count, {_n("crossed_quote")} as crossed_quote_count, {_n("missing_volume", "volume_anomaly")} as volume_anomaly_count from found where code is not null group by 1),
    {bars_sql(900, VALID_TICKS, "vt").replace(BAD_TICKS + ", ", "")}, tb as (select *, close as c, lag(close) over (partition by symbol order by bar) as before, {OPEN} as active from bars), {_stale("tb", "bar")}, {_gaps("bars").replace(str(HOUR), "900")},
    sums as (select symbol, count(*) as bar_count, min(bar) as coverage_start, max(bar) + 900 as coverage_end, count(*) filter (volume = 0 or ask_volume = 0) as zero_volume_bars, count(*) filter ((volume = 0 or ask_volume = 0) and active) as active_session_zero_volume,
    count(*) filter ((volume = 0 or ask_volume = 0) and not active) as closed_session_zero_volume, 0 as ohlc_violations, count(*) filter (len >= 8 and place = 1) as stale_sequences, count(*) filter (before > 0 and abs(open - before) > 0.2 * before) as suspicious_jumps,
    cast(sum(n) as bigint) as spread_observation_count, round(sum(spread_mean * n) / sum(n), 6) as mean_spread, round(min(spread_min), 6) as minimum_spread, round(max(spread_max), 6) as maximum_spread from sl group by 1)
    select * from n left join fc using (symbol) left join sums using (symbol) left join gaps using (symbol)""",
)(lambda s, d: r6(tick_report_(s, d), "mean_spread", "minimum_spread", "maximum_spread"))


def events_(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    return K.quality_events({"missing_bar": ("warning", B.missing_bars(b, HOUR)), "unexpected_bar": ("error", B.unexpected_bars(b, HOUR)), "suspicious_jump": ("warning", B.suspicious_jumps(b, 0.2))})


QUALITY = f"""{bars_sql(HOUR)}, {GRID}, qe as (select symbol, bar, 'missing_bar' as code, 'warning' as severity from grid where {OPEN} and (symbol, bar) not in (select symbol, bar from bars)
  union all select symbol, bar, 'unexpected_bar', 'error' from bars where not {OPEN}
  union all select symbol, bar, 'suspicious_jump', 'warning' from (select symbol, bar, abs(open - lag(close) over w) / lag(close) over w as jump from bars window w as (partition by symbol order by bar)) where jump > 0.2)"""
query("quality_events", f"with {QUALITY} select symbol, bar, code, severity from qe")(events_)
query("quality_counts", f"with {QUALITY} select code, severity, count(*) as n from qe group by 1, 2")(lambda s, d: K.quality_counts(events_(s, d)))
query(
    "gap_distribution",
    f"""with {bars_sql(HOUR)}, {GRID}, g as (select symbol, bar // 3600 % 24 as hour, (bar - 259200) % 604800 // 86400 as weekday from grid where {OPEN} and (symbol, bar) not in (select symbol, bar from bars))
    select symbol, hour, weekday, count(*) as n from g group by grouping sets ((symbol, hour), (symbol, weekday))""",
)(lambda s, d: K.gap_distribution(B.missing_bars(bars(s, d), HOUR)))
query(
    "overlap_conflicts",
    f"with {TICKS}, a as (select symbol, us // 60000000 as minute, row_no, bid_volume, first_value(bid_volume) over (partition by symbol, us // 60000000 order by row_no) as f from ticks) select symbol, minute, row_no from a where bid_volume is distinct from f",
)(lambda s, d: K.overlap_conflicts(S.ticks(s, d).withColumn("minute", F.floor(F.col("us") / 60_000_000)), ["symbol", "minute"], "row_no", ["bid_volume"]))

# Ledgers

LEDGER = f"""{FILLS}, f as (select *, case when side = 'buy' then quantity else -quantity end as s, row_number() over (partition by account, symbol order by t, fill_id) as r from fills),
  led as (select account, symbol, fill_id, t, r, quantity, price, fee, s, cast(0 as bigint) as old, cast(s as bigint) as pos, price as avg, fee as ef, t as opened, null::double as entry, null::bigint as entered, null::double as paid from f where r = 1
  union all select f.account, f.symbol, f.fill_id, f.t, f.r, f.quantity, f.price, f.fee, f.s, l.pos, cast(l.pos + f.s as bigint), case when l.pos = 0 or l.pos * (l.pos + f.s) < 0 then f.price
  when l.pos * f.s > 0 then (l.avg * abs(l.pos) + f.price * abs(f.s)) / (abs(l.pos) + abs(f.s)) when l.pos + f.s = 0 then 0 else l.avg end, case when l.pos = 0 then f.fee when l.pos * f.s > 0 then l.ef + f.fee when l.pos + f.s = 0 then 0 when l.pos * (l.pos + f.s) > 0 then l.ef * abs(l.pos + f.s) / abs(l.pos) else f.fee * abs(l.pos + f.s) / f.quantity end,
  case when l.pos = 0 or l.pos * (l.pos + f.s) < 0 then f.t else l.opened end, l.avg, l.opened, l.ef / nullif(abs(l.pos), 0)
  from f join led l on f.account = l.account and f.symbol = l.symbol and f.r = l.r + 1),
  ledger as (select *, old * s < 0 as closes, least(abs(old), abs(s)) as size from led)"""
query(
    "position_ledger",
    f"""with recursive {LEDGER} select account, symbol, fill_id, pos as position, case when pos <> 0 then {c2('avg')} end as average_price, case when closes then size end as closed_quantity,
    case when closes then {c2('size * (price - entry) * sign(old)')} end as realized, case when closes then t - entered end as held from ledger""",
)(lambda s, d: cents(L.position_ledger(S.fills(s, d)).select("account", "symbol", "fill_id", "position", "average_price", "closed_quantity", "realized", "held"), "average_price", "realized"))
query(
    "closed_trades",
    f"""with recursive {LEDGER} select account, symbol, fill_id, case when old > 0 then 'buy' else 'sell' end as side, size as quantity, {c2('entry')} as entry_price, price as exit_price, {c2('size * (price - entry) * sign(old)')} as gross_pnl, {c2('size * paid + fee * size / quantity')} as fees,
    {c2('size * (price - entry) * sign(old) - size * paid - fee * size / quantity')} as net_pnl, t - entered as held_seconds from ledger where closes""",
)(lambda s, d: cents(L.closed_trades(L.position_ledger(S.fills(s, d))), "entry_price", "gross_pnl", "fees", "net_pnl"))
MARKS = f"""{LEDGER}, {DAYS}, marks as (select account, ledger.symbol, fill_id, ledger.t, pos * close as market_value, case when pos = 0 then 0 else (close - avg) * pos end as unrealized from ledger asof left join days on days.symbol = ledger.symbol and days.t <= ledger.t // 86400 * 86400),
  newest as (select account, symbol, arg_max(market_value, (t, fill_id)) as v from marks group by 1, 2)"""
query("mark_to_market", f"with recursive {MARKS} select account, symbol, fill_id, {c2('market_value')} as market_value, {c2('unrealized')} as unrealized from marks")(
    lambda s, d: cents(L.mark_to_market(L.position_ledger(S.fills(s, d)), S.day_closes(s, d)), "market_value", "unrealized")
)


def newest_(s: SparkSession, d: str) -> DataFrame:
    led = L.position_ledger(S.fills(s, d))
    return L.last_positions(L.mark_to_market(led, S.day_closes(s, d)), led)


query(
    "exposure_totals",
    f"""with recursive {MARKS} select account, {c2('sum(abs(v))')} as gross, {c2('sum(v)')} as net, {c2('sum(greatest(v, 0))')} as long, {c2('sum(greatest(-v, 0))')} as short, count(*) filter (v <> 0) as open_positions from newest group by 1""",
)(lambda s, d: cents(L.exposure_totals(newest_(s, d), ["account"]), "gross", "net", "long", "short"))
query(
    "drawdown_segments",
    f"""{HB}, a as (select symbol, bar, close, max(close) over w as peak, max(bar) over (partition by symbol) as fin from bars window w as (partition by symbol order by bar)),
    b as (select *, sum(case when close >= peak then 1 else 0 end) over (partition by symbol order by bar) as seg from a),
    c as (select symbol, seg, fin, min(bar) as pb, max(peak) as peak, min(close) as tr, arg_min(bar, (close, bar)) as tb, count(*) as n from b group by 1, 2, 3),
    d as (select *, lead(pb) over (partition by symbol order by seg) as rec from c), e as (select *, tr / peak - 1 as fall from d where n > 1),
    f as (select symbol, min(fall) as fall, max(coalesce(rec, fin) - pb) as longest from e group by 1), g as (select *, row_number() over (partition by symbol order by fall, seg) as k from e)
    select s.symbol, coalesce(round(f.fall, 6), 0) as max_drawdown, f.longest as longest_seconds, g.rec - g.tb as recovery_seconds from (select distinct symbol from bars) s left join f using (symbol) left join g on g.symbol = s.symbol and g.k = 1""",
)(lambda s, d: r6(L.drawdown_segments(bars(s, d)), "max_drawdown"))
query(
    "risk_day_pnl",
    f"""{HB}, a as (select symbol, bar // 86400 * 86400 as day, arg_min(close, bar) as start, arg_max(close, bar) as last, max(close) as top from bars group by 1, 2), b as (select *, max(top) over (partition by symbol order by day) as high_water from a)
    select symbol, day, round(start, 6) as start, round(last - start, 6) as pnl, round(high_water, 6) as high_water, start - last >= 100 as loss_lock, high_water - last >= 50 as drawdown_lock from b""",
)(lambda s, d: r6(L.risk_day(bars(s, d), 100.0, 50.0), "start", "pnl", "high_water"))
query(
    "loss_locks",
    f"""{HB}, a as (select symbol, bar // 86400 * 86400 as day, arg_min(close, bar) as start, arg_max(close, bar) as last, max(close) as top from bars group by 1, 2), b as (select *, max(top) over (partition by symbol order by day) as high_water from a)
    select symbol, min(day) filter (start - last >= 100) as first_loss_lock, min(day) filter (high_water - last >= 50) as first_drawdown_lock from b group by 1""",
)(lambda s, d: L.first_breaches(L.risk_day(bars(s, d), 100.0, 50.0)))

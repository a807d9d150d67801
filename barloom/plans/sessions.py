"""Registered queries of market calendars, with DuckDB SQL that works by clock rules and not by session tables.

Times come from orders, spread over the hours of a week, so that they lie in seven years of clock changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import seconds
from barloom.operators import calendars as C
from barloom.sources import tables as S

from .queries import query

HOUR, DAY = 3600, 86_400
FROM, TO = 788_918_400, 997_920_000  # 1995 to August 2001
_t = "o_orderdate_s + o_orderkey * 37 % 168 * 3600 + o_orderkey % 2 * 1800"
#: Holidays and early closes by rule: New Year, 4 July, Christmas, and the Fridays of 23 to 29 November until 13:00.
_holiday = "(month(day) = 1 and day(day) = 1 or month(day) = 7 and day(day) = 4 or month(day) = 12 and day(day) = 25)"
_early = "(month(day) = 11 and day(day) between 23 and 29)"


def times(s: SparkSession, d: str) -> DataFrame:
    rows = S.table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), seconds("o_orderdate").alias("o_orderdate_s"))
    return rows.select("o_orderkey", "symbol", F.expr(_t).alias("t"))


def special_days(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    days = s.range(FROM // DAY, TO // DAY).select(F.date_from_unix_date(F.col("id").cast("int")).alias("day"))
    return days.where(_holiday), days.where(f"{_early} and weekday(day) = 4").select("day", F.lit(13 * HOUR).alias("closes"))


def tables(s: SparkSession) -> dict[str, DataFrame]:
    holidays, early = special_days(s)
    out = {c.name: C.sessions(s, c, FROM, TO) for c in (C.UTC_FOREX, C.NEW_YORK_FOREX)}
    return out | {C.US_EQUITY.name: C.sessions(s, C.US_EQUITY, FROM, TO, holidays, early)}


TIMES = f"""tm as (select o_orderkey, symbol, {_t} as t from (select *, o_orderpriority as symbol, cast(epoch(o_orderdate) as bigint) as o_orderdate_s from orders))"""
_local = "timezone('America/New_York', to_timestamp({}))"
_clock = "date_part('hour', {0}) * 3600 + date_part('minute', {0}) * 60 + date_part('second', {0})"


def week_open(ts: str, at: int) -> str:
    return f"(case date_part('dow', {ts}) when 6 then false when 0 then {_clock.format(ts)} >= {at} when 5 then {_clock.format(ts)} < {at} else true end)"


def equity_open(ts: str) -> str:
    return f"(date_part('dow', {ts}) between 1 and 5 and not {_holiday.replace('day)', f'{ts})')} and {_clock.format(ts)} >= 34200 and {_clock.format(ts)} < case when {_early.replace('day)', f'{ts})')} and date_part('dow', {ts}) = 5 then 46800 else 57600 end)"


OPENS = f"utc as (select *, timezone('UTC', to_timestamp(t)) as u, {_local.format('t')} as n from tm)"


def opened(s: SparkSession, d: str) -> DataFrame:
    rows = times(s, d)
    for short, table in zip(("utc_week", "new_york_week", "us_equity"), tables(s).values()):
        rows = C.with_session(rows, "t", table).withColumn(short, F.col("found").isNotNull()).drop("found")
    return rows.select("o_orderkey", "utc_week", "new_york_week", "us_equity")


query("session_open", f"with {TIMES}, {OPENS} select o_orderkey, {week_open('u', 79200)} as utc_week, {week_open('n', 61200)} as new_york_week, {equity_open('n')} as us_equity from utc")(opened)

#: Session days of the equity calendar by rule.
DAYS_SQL = f"""sd as (select day from (select unnest(generate_series(date '1994-12-20', date '2001-08-20', interval 1 day))::date as day) where date_part('dow', day) between 1 and 5 and not {_holiday}),
  se as (select cast(epoch(timezone('America/New_York', day + interval 34200 second)) as bigint) as start, cast(epoch(timezone('America/New_York', day + to_seconds(case when {_early} and date_part('dow', day) = 5 then 46800 else 57600 end))) as bigint) as stop from sd)"""
EQUITY_RANGES = "rg as (select symbol, min(t) as a, max(t) + 1 as b from tm group by 1)"


def ranges(s: SparkSession, d: str) -> DataFrame:
    return C.spans(times(s, d).withColumnRenamed("t", "bar"), HOUR)


for _name, _width, _bars in (("expected_session_bars", HOUR, "unnest(range(start, stop, 3600))"), ("expected_session_days", DAY, "start")):
    query(_name, f"with {TIMES}, {EQUITY_RANGES}, {DAYS_SQL}, g as (select {_bars} as bar from se) select symbol, bar from rg join g on bar >= a and bar < b")(
        lambda s, d, w=_width: C.expected(ranges(s, d), tables(s)[C.US_EQUITY.name], C.US_EQUITY, w)
    )
query(
    "expected_week_bars",
    f"""with {TIMES}, rg as (select symbol, min(t) // 3600 * 3600 as a, max(t) as b from tm group by 1), g as (select symbol, unnest(range(a, b, 3600)) as bar from rg), w as (select *, {_local.format('bar')} as n from g) select symbol, bar from w where {week_open('n', 61200)}""",
)(lambda s, d: C.expected(ranges(s, d).select("symbol", (F.floor(F.col("a") / HOUR) * HOUR).alias("a"), (F.col("b") - 1).alias("b")), tables(s)[C.NEW_YORK_FOREX.name], C.NEW_YORK_FOREX, HOUR))


def session_bars(s: SparkSession, d: str) -> DataFrame:
    """A bar of each different order time."""
    return times(s, d).select("symbol", F.col("t").alias("bar")).distinct()


BARS_SQL = "sb as (select distinct symbol, t as bar from tm)"
query("missing_session_bars", f"with {TIMES}, {EQUITY_RANGES}, {BARS_SQL}, {DAYS_SQL}, g as (select unnest(range(start, stop, 3600)) as bar from se) select symbol, bar from rg join g on bar >= a and bar < b where (symbol, bar) not in (select symbol, bar from sb)")(
    lambda s, d: C.missing(session_bars(s, d), tables(s)[C.US_EQUITY.name], C.US_EQUITY, HOUR)
)
query(
    "unexpected_session_bars",
    f"""with {TIMES}, {BARS_SQL}, n as (select *, {_local.format('bar')} as n from sb), c as (select symbol, bar, case when not {equity_open('n')} then 'closed' when ({_clock.format('n')} - 34200) % 3600 <> 0 then 'off_grid' end as code from n) select * from c where code is not null""",
)(lambda s, d: C.unexpected(session_bars(s, d), tables(s)[C.US_EQUITY.name], C.US_EQUITY, HOUR))


def on_grid(s: SparkSession, d: str) -> DataFrame:
    """The order times that are bars of the equity session."""
    rows = C.with_session(session_bars(s, d), "bar", tables(s)[C.US_EQUITY.name])
    return rows.where("found is not null and (bar - found.start) % 3600 = 0").select("symbol", "bar")


ON_GRID = f"{BARS_SQL}, og as (select symbol, bar from (select *, {_local.format('bar')} as n from sb) where {equity_open('n')} and ({_clock.format('n')} - 34200) % 3600 = 0)"
query(
    "session_gap_counts",
    f"""with {TIMES}, {ON_GRID}, {DAYS_SQL}, g as (select unnest(range(start, stop, 3600)) as bar from se), k as (select bar, row_number() over (order by bar) as k from g), p as (select symbol, bar, k, lag(bar) over w as previous, k - lag(k) over w - 1 as absent from og join k using (bar) window w as (partition by symbol order by bar))
    select symbol, bar, previous, absent from p where previous is not null""",
)(lambda s, d: C.gap_counts(on_grid(s, d), tables(s)[C.US_EQUITY.name], HOUR))


def week_gaps(s: SparkSession, d: str) -> DataFrame:
    """Hours of 1995 and 1996 in which the New York week is open and a series has no order."""
    had = times(s, d).select("symbol", (F.floor(F.col("t") / HOUR) * HOUR).alias("bar")).where("bar < 851990400").distinct()
    return C.missing(had, tables(s)[C.NEW_YORK_FOREX.name], C.NEW_YORK_FOREX, HOUR)


query(
    "gap_labels",
    f"""with {TIMES}, h as (select distinct symbol, t // 3600 * 3600 as bar from tm where t < 851990400), g as (select symbol, unnest(range(min(bar), max(bar) + 1, 3600)) as bar from h group by 1),
    m as (select *, {_local.format('bar')} as n, timezone('UTC', to_timestamp(bar)) as u from g where (symbol, bar) not in (select symbol, bar from h)), o as (select * from m where {week_open('n', 61200)}),
    l as (select symbol, unnest(['month', 'weekday', 'hour', 'dst']) as label, unnest([date_part('month', n)::varchar, ((date_part('dow', n) + 6) % 7)::bigint::varchar, date_part('hour', n)::varchar, (n - u > interval '-5 hours')::varchar]) as value from o),
    r as (select symbol, bar - 3600 * row_number() over (partition by symbol order by bar) as run from o), q as (select symbol, run, count(*) as k from r group by 1, 2)
    select symbol, label, value, count(*) as n from l group by 1, 2, 3 union all select symbol, 'run_length', k::varchar, count(*) from q group by 1, 2, 3""",
)(lambda s, d: C.gap_distribution(week_gaps(s, d), "America/New_York", HOUR))

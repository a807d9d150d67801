"""Registered queries of time parsing, store operations, point-in-time joins, gates and account books, with the DuckDB SQL that must give the same rows.

Columns that the given tables lack are made from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import times as M
from barloom.functions.columns import session_open
from barloom.operators import asof as A
from barloom.operators import bars as B
from barloom.operators import books as K
from barloom.operators import features as X
from barloom.operators import gates as G
from barloom.operators import ledger as L
from barloom.operators import store as W
from barloom.operators import trading as T
from barloom.sources import tables as S

from .desk import HB, LEDGER, QUOTES, c2, cents, odd_quotes
from .queries import DAY, DAYS, FEATURE_BASE, FILLS, GRID, HOUR, OPEN, TICKS, bars, bars_sql, feature_bars, feature_sql, query, r6

# Times

_clock = "case when row_no % 2 = 0 then 1710034200 else 1730593800 end + row_no * 7 % 10800"
query(
    "normalize_timestamp",
    f"""with {TICKS}, a as (select row_no, make_timestamp(({_clock}) * 1000000) as c from ticks), b as (select row_no, c, c at time zone 'America/New_York' as u from a),
    d as (select row_no, u, case when u at time zone 'America/New_York' <> c then 'nonexistent' when (u + interval 1 hour) at time zone 'America/New_York' = c or (u - interval 1 hour) at time zone 'America/New_York' = c then 'ambiguous' end as code from b)
    select row_no, case when code is null then epoch_us(u) end as us, code from d""",
)(lambda s, d: (lambda x: S.ticks(s, d).select("row_no", x[0].alias("us"), x[1].alias("code")))(M.wall_clock(F.expr(f"({_clock}) * 1000000"), "America/New_York")))
_millis = "case row_no % 7 when 0 then 'x' || us when 1 then (us // 1000) || '.5' when 2 then '+' || (us // 1000) when 3 then ' ' || (us // 1000) else '' || (us // 1000) end"
query("parse_epoch_millis", f"with {TICKS}, a as (select row_no, {_millis} as t from ticks) select row_no, case when regexp_full_match(trim(t), '[+-]?[0-9]+') then cast(trim(t) as bigint) end as ms from a")(
    lambda s, d: S.ticks(s, d).select("row_no", M.epoch_millis(F.expr(_millis.replace("us // 1000", "us div 1000"))).alias("ms"))
)
_iso = "case row_no % 6 when 0 then 'Z' when 1 then '+00:00' when 2 then '+02:00' when 3 then '' when 4 then '-00:00' else '.5Z' end"
query(
    "parse_iso_utc",
    f"""with {TICKS}, a as (select row_no, us // 1000000 as t, case when row_no % 11 = 0 then strftime(make_timestamp(us // 1000000 * 1000000), '%Y-13-%dT%H:%M:%S') else strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') end || {_iso} as x from ticks)
    select row_no, case when row_no % 6 in (0, 1, 4, 5) and row_no % 11 <> 0 then t * 1000000 + case when row_no % 6 = 5 then 500000 else 0 end end as us from a""",
)(
    lambda s, d: S.ticks(s, d).select(
        "row_no", M.iso_utc(F.concat(F.when(F.col("row_no") % 11 == 0, F.date_format(F.timestamp_micros("us"), "yyyy-'13'-dd'T'HH:mm:ss")).otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss")), F.expr(_iso))).alias("us")
    )
)
query("bar_end_to_start", f"{HB} select symbol, bar, bar - 3600 as start from bars")(lambda s, d: bars(s, d).select("symbol", "bar", M.bar_start(F.col("bar"), HOUR, True).alias("start")))
query("availability_timestamps", f"{HB} select symbol, bar, bar + 3660 as available, bar + 3690 as decision from bars")(
    lambda s, d: (lambda x: bars(s, d).select("symbol", "bar", x[0].alias("available"), x[1].alias("decision")))(M.available_at(F.col("bar"), HOUR, 60, 30))
)
query("net_after_costs", f"with {FILLS} select fill_id, case when fee - 50 >= 0 then price - (fee - 50) end as net from fills")(lambda s, d: S.fills(s, d).select("fill_id", T.net_after_costs(F.col("price"), F.col("fee") - 50).alias("net")))

# Scopes and stores

_class = "case p_size % 4 when 0 then 'forex' when 1 then 'equity' when 2 then 'etf' else 'bond' end"
_frame = "case p_partkey % 5 when 0 then '15m' when 1 then '1h' when 2 then '4h' when 3 then '1d' else '5m' end"
query("supported_timeframe", f"select p_partkey, coalesce({_class} = 'forex' and {_frame} <> '5m' or {_class} in ('equity', 'etf') and {_frame} in ('1h', '1d'), false) as ok from part")(
    lambda s, d: S.table(s, d, "part").select("p_partkey", W.supported_timeframe(F.expr(_class), F.expr(_frame)).alias("ok"))
)


def instruments(s: SparkSession, d: str) -> DataFrame:
    """The traded symbols and their names at two providers, one of which lacks some."""
    names = S.ticks(s, d).select("symbol").distinct()
    both = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.upper("symbol"), F.concat(F.lit("X:"), F.col("symbol"))))
    one = F.map_from_arrays(F.array(F.lit("b")), F.array(F.concat(F.lit("X:"), F.col("symbol"))))
    return names.select("symbol", F.when(F.col("symbol") < "s", both).otherwise(one).alias("provider_symbols"))


query("map_provider_symbol", f"{HB} select symbol, bar, case when symbol < 's' then upper(symbol) end as provider_symbol from bars")(
    lambda s, d: W.map_provider_symbol(bars(s, d).select("symbol", "bar"), instruments(s, d), "a")
)
query("has_bar", f"with {bars_sql(HOUR)}, {GRID} select symbol, bar, (symbol, bar) in (select symbol, bar from bars) as present from grid where {OPEN}")(
    lambda s, d: W.has_bar(B.expected_bars(bars(s, d), HOUR), bars(s, d), ["symbol", "bar"])
)
query(
    "market_bars_from_sides",
    f"with {QUOTES} select symbol, bar, ask_open::double as open, ask_high::double as high, ask_low::double as low, ask_close::double as close, ask_volume as volume, bid_close::double as bid, ask_close::double as ask, (ask_close - bid_close)::double as spread, bar + 3600 as quote_time from qq",
)(lambda s, d: (lambda x: x.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "bid", "ask", "spread")}))(W.market_bars(odd_quotes(s, d), HOUR, "ask")))


def stored_features(s: SparkSession, d: str) -> DataFrame:
    rows = X.compute_feature_set(feature_bars(s, d), [("sma", 20), ("atr", 14)])
    return r6(rows, "value").withColumns({"version": F.when(F.col("feature") == "sma", 2).otherwise(1), "dataset": F.when(F.col("bar") % 7200 == 0, "a").otherwise("b")})


STORED = f"""{FEATURE_BASE}, st as (select *, case when feature = 'sma' then 2 else 1 end as version, case when bar % 7200 = 0 then 'a' else 'b' end as dataset from (
  {" union all ".join(f"select symbol, bar, '{n}' as feature, 'window={w}' as parameters, value, status from ({feature_sql(n)})" for n, w in (("sma", 20), ("atr", 14)))}))"""


def feature_batch(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = stored_features(s, d)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("value", F.col("value") + F.col("copy"))
    return rows.where("bar % 10800 = 0"), twice.where("bar % 14400 = 0")


query("upsert_features", f"{STORED} select symbol, bar, feature, version, parameters, dataset, case when bar % 14400 = 0 then round(value + 1, 6) else value end as value, status from st where bar % 10800 = 0 or bar % 14400 = 0")(
    lambda s, d: r6(W.upsert_features(*feature_batch(s, d), "copy")[0], "value")
)
query("new_features", f"{STORED} select symbol, bar, feature, version, parameters, dataset from st where bar % 14400 = 0 and bar % 10800 <> 0")(lambda s, d: W.upsert_features(*feature_batch(s, d), "copy")[1])
query("query_features", f"{STORED} select symbol, bar, feature, version, parameters, dataset, value, status from st where dataset = 'a' and bar between 1704153600 and 1706745600 and feature = 'sma'")(
    lambda s, d: W.query_features(stored_features(s, d), "a", 1_704_153_600, 1_706_745_600, [("sma", 2), ("atr", 9)])
)
query("latest_feature", f"{STORED} select symbol, feature, version, parameters, dataset, bar, value, status from st qualify row_number() over (partition by symbol, feature, dataset order by bar desc) = 1")(
    lambda s, d: W.latest_feature(stored_features(s, d))
)
query("append_audit_tables", f"with {FILLS} select account, arg_max(fill_id, (t, fill_id)) as fill_id, arg_max(price, (t, fill_id)) as price from fills group by 1")(
    lambda s, d: W.latest_by_id(S.fills(s, d).select("account", "fill_id", "price", "t"), "account", ["t", "fill_id"]).drop("t")
)
query("order_events", f"with {TICKS} select row_no, row_number() over (order by us, symbol, row_no) - 1 as event_no from ticks")(lambda s, d: W.order_events(S.ticks(s, d).select("us", "symbol", "row_no"), ["us", "symbol", "row_no"]).select("row_no", "event_no"))
query(
    "bounded_history",
    f"""with {FILLS}, a as (select account, fill_id, row_number() over (partition by account order by t desc, fill_id desc) as r, count(*) over (partition by account) as n from fills) select account, fill_id, least(n, 3) - r as place, n > 3 as truncated from a where r <= 3""",
)(lambda s, d: W.bounded_history(S.fills(s, d).select("account", "fill_id", "t"), "account", ["t", "fill_id"], 3).drop("t"))
query(
    "subset_checks",
    "select o_custkey, array_to_string(list_sort(list_distinct(list_filter(array_agg(o_orderpriority), lambda x: x not in ('1-URGENT', '2-HIGH', '5-LOW')))), ',') as missing, bool_and(o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')) as covered from orders group by 1",
)(
    lambda s, d: W.subset_checks(
        S.table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("declared")).withColumn("supplied", F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "5-LOW"]))), "declared", "supplied"
    ).select("o_custkey", F.array_join("missing", ",").alias("missing"), "covered")
)
PERIODS = [("first", 1_704_067_200, 1_704_326_400, 1_705_276_800), ("second", 1_705_276_800, 1_705_363_200, 1_706_745_600)]
query(
    "slice_by_period",
    f"""{HB}, pr(name, warm, start, stop) as (values {", ".join(map(str, PERIODS))}), x as (select name, symbol, bar, bar // 86400 as day, bar >= start as live, sha256(symbol || '|' || bar || '|' || printf('%.6f', close)) as h from bars join pr on bar >= warm and bar < stop),
    dd as (select name, symbol, day, count(*) filter (not live) as w, count(*) filter (live) as l, sha256(coalesce(string_agg(h, '' order by h) filter (live), '')) as h from x group by 1, 2, 3)
    select name, symbol, cast(sum(w) as bigint) as warm_rows, cast(sum(l) as bigint) as rows, sha256(coalesce(string_agg(h, '' order by day) filter (l > 0), '')) as slice_hash from dd group by 1, 2""",
)(lambda s, d: W.slice_by_period(bars(s, d).select("symbol", "bar", "close"), s.createDataFrame(PERIODS, "name string, warm long, start long, stop long")))
query(
    "split_scope",
    f"with {FILLS} select fill_id, t as start, t + quantity * 864000 as stop, case when t + quantity * 864000 <= 850000000 then 'development' when t >= 860000000 and t + quantity * 864000 <= 900000000 then 'locked_oos' else 'crosses' end as scope from fills",
)(lambda s, d: W.split_scope(S.fills(s, d).select("fill_id", F.col("t").alias("start"), (F.col("t") + F.col("quantity") * 864_000).alias("stop")), 850_000_000, 860_000_000, 900_000_000))

# Gaps and quotes


def windows(s: SparkSession, d: str) -> DataFrame:
    """All absent hours of each series, closed ones too."""
    return B.classify_gaps(bars(s, d), HOUR).select("symbol", F.col("bar").alias("start"), (F.col("bar") + HOUR).alias("stop"))


GAPS = f"""{bars_sql(HOUR)}, {GRID}, wn as (select symbol, bar as start, bar + 3600 as stop, cast((bar + 3600) * 1000000 as bigint) as stop_us, cast(bar * 1000000 as bigint) as start_us, {OPEN} as active from grid where (symbol, bar) not in (select symbol, bar from bars))"""
#: Raw ticks of the diagnosis: every tick of an even minute again half a day later.
RAW = "rw as (select symbol, us, row_no from ticks union all select symbol, us + 43200000000, row_no + 1000000 from ticks where us // 60000000 % 2 = 0)"


def raw_ticks(s: SparkSession, d: str) -> DataFrame:
    t = S.ticks(s, d).select("symbol", "us", "row_no")
    return t.unionByName(t.where("us div 60000000 % 2 = 0").select("symbol", (F.col("us") + 43_200_000_000).alias("us"), (F.col("row_no") + 1_000_000).alias("row_no")))


query(
    "gap_neighbours",
    f"""with {GAPS}, {RAW}, i as (select wn.symbol, start, count(*) as ticks_inside, arg_min(row_no, (us, row_no)) as first_inside, arg_max(row_no, (us, row_no)) as last_inside from wn join rw on rw.symbol = wn.symbol and us >= start_us and us < stop_us group by 1, 2),
    p as (select wn.symbol, start, row_no as previous_row from wn asof left join rw on wn.symbol = rw.symbol and wn.start_us > rw.us), n as (select wn.symbol, start, row_no as next_row from wn asof left join rw on wn.symbol = rw.symbol and wn.stop_us <= rw.us)
    select wn.symbol, wn.start, stop, previous_row, next_row, coalesce(ticks_inside, 0) as ticks_inside, first_inside, last_inside from wn left join p using (symbol, start) left join n using (symbol, start) left join i using (symbol, start)""",
)(lambda s, d: A.gap_neighbours(windows(s, d), raw_ticks(s, d)))
OTHER = "ot as (select symbol, bar + 86400 as bar from bars where bar // 3600 % 3 <> 0)"


def other_bars(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d).where("bar div 3600 % 3 <> 0").select("symbol", (F.col("bar") + DAY).alias("bar"))


CROSS = f"""{OTHER}, oe as (select symbol, min(bar) as a, max(bar) as z from ot group by 1), cs as (select wn.symbol, start as bar, active, start >= a and start <= z as in_coverage, case when start >= a and start <= z then ot.bar is not null end as present from wn left join oe using (symbol) left join ot on ot.symbol = wn.symbol and ot.bar = start)"""
query("cross_source_gap_check", f"with {GAPS}, {CROSS} select symbol, bar, in_coverage, present from cs")(lambda s, d: A.cross_source_check(windows(s, d).select("symbol", F.col("start").alias("bar")), other_bars(s, d)))


def diagnosed(s: SparkSession, d: str) -> DataFrame:
    near = A.gap_neighbours(windows(s, d), raw_ticks(s, d)).select("symbol", F.col("start").alias("bar"), "ticks_inside")
    seen = A.cross_source_check(near.select("symbol", "bar"), other_bars(s, d))
    return A.diagnose_gaps(near.join(seen, ["symbol", "bar"]).withColumn("active", session_open(F.col("bar")))).select("symbol", "bar", "diagnosis")


query(
    "diagnose_gaps",
    f"""with {GAPS}, {RAW}, {CROSS}, i as (select wn.symbol, start, count(*) as k from wn join rw on rw.symbol = wn.symbol and us >= start_us and us < stop_us group by 1, 2)
    select cs.symbol, bar, case when not active then 'EXPECTED_MARKET_CLOSURE' when k > 0 then 'PARSER_NORMALIZATION_AGGREGATION_DEFECT' when present then 'ACQUISITION_EXPORT_OMISSION_LIKELY' else 'UNRESOLVED' end as diagnosis from cs left join i on i.symbol = cs.symbol and i.start = bar""",
)(diagnosed)
_orders = "case when row_no % 2 = 0 then 'buy' else 'sell' end as side, case row_no % 3 when 0 then 'market' when 1 then 'limit' else 'stop' end as kind, bid * case row_no % 4 when 0 then 0.5 when 1 then 1.5 when 2 then 0.9 else 1.1 end as level, case when row_no % 5 = 0 then us + 86400000000 end as expires"
query(
    "quote_fills",
    f"""with {TICKS}, qo as (select row_no as id, symbol, us as t, {_orders.replace("0.5 ", "0.5::double ").replace("1.5 ", "1.5::double ").replace("0.9 ", "0.9::double ").replace("1.1 ", "1.1::double ")} from ticks),
    h as (select id, min(q.us) as fill_us from qo join ticks q on q.symbol = qo.symbol and q.us > qo.t and case when kind = 'market' then true when (side = 'buy') = (kind = 'limit') then case when side = 'buy' then ask else bid end <= level else case when side = 'buy' then ask else bid end >= level end group by 1),
    f as (select qo.*, fill_us, case when side = 'buy' then ask else bid end as quote from h join qo using (id) join ticks q on q.symbol = qo.symbol and q.us = fill_us), p as (select *, quote + case when kind = 'limit' then 0 when side = 'buy' then 0.5 else -0.5 end as price from f)
    select id, fill_us, round(quote, 6) as quote, round(price, 6) as price from p where price > 0 and (expires is null or fill_us < expires)""",
)(lambda s, d: r6(A.quote_fills(S.ticks(s, d).select(F.col("row_no").alias("id"), "symbol", F.col("us").alias("t"), *[F.expr(x) for x in _orders.split(", ")]), S.ticks(s, d), 0.5), "quote", "price"))
query("quote_safe", f"with {TICKS} select row_no, case when row_no % 4 < 3 and row_no % 3 > 0 then bid end as bid, case when row_no % 4 < 3 and row_no % 3 > 0 then ask end as ask from ticks")(
    lambda s, d: A.quote_safe(
        S.ticks(s, d).select("row_no", F.when(F.col("row_no") % 3 > 0, F.col("bid")).alias("bid"), "ask", (F.col("us") + F.when(F.col("row_no") % 4 < 3, -1).otherwise(1)).alias("quote_time"), F.col("us").alias("fill_time"))
    ).select("row_no", "bid", "ask")
)
query(
    "features_exact",
    f"{FEATURE_BASE}, x as ({feature_sql('sma')}) select symbol, bar, value from bars join x using (symbol, bar) where bar // 3600 % 2 = 0",
)(lambda s, d: r6(A.features_exact(bars(s, d).where("bar div 3600 % 2 = 0").select("symbol", "bar"), X.compute(bars(s, d), "sma"))[0], "value"))

#: Features of the hourly bars: every seventh hour comes six hours late, every fifth is restated ten hours after, every eleventh is still warming up.
REQUIRED = [("close", 1), ("range", 2), ("volume", 1)]
_feature = "case when bar // 3600 % 11 = 0 then 'warmup' else 'value' end as status, bar + 3600 + case when bar // 3600 % 7 = 0 then 21600 else 0 end + copy * 36000 as available"
FEATURES_AT = f"""ft as (select symbol, bar as observed, unnest(['close', 'range', 'spread']) as feature, unnest([1, 2, 1]) as version, unnest([close, high - low, spread_close]) + copy as value, {_feature}
  from (select *, unnest(case when bar // 3600 % 5 = 0 then [0, 1] else [0] end) as copy from bars))"""


def restated(s: SparkSession, d: str) -> DataFrame:
    rows = bars(s, d).withColumn("copy", F.explode(F.when(F.col("bar") / HOUR % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("version"), (F.expr(x) + F.col("copy")).alias("value")) for n, v, x in (("close", 1, "close"), ("range", 2, "high - low"), ("spread", 1, "spread_close"))])
    rows = rows.withColumns({"f": F.explode(each), **{x.split(" as ")[1]: F.expr(x.split(" as ")[0].replace("//", "div")) for x in _feature.split(", ")}})
    return rows.select("symbol", F.col("bar").alias("observed"), "f.*", "status", "available")


query(
    "features_asof_required",
    f"""with {bars_sql(HOUR)}, {FEATURES_AT}, rq(feature, version) as (values {", ".join(map(str, REQUIRED))}), ev as (select row_no as id, symbol, us // 1000000 as bar, us // 1000000 + row_no % 4 * 3000 as event_time from ticks),
    h as (select id, ev.symbol, rq.feature, rq.version, arg_max(observed, (observed, available)) as observed, arg_max({{'v': case when status = 'value' then value end}}, (observed, available)).v as value from ev cross join rq left join ft on ft.symbol = ev.symbol and ft.feature = rq.feature and ft.version = rq.version and observed <= bar and available <= event_time group by 1, 2, 3, 4)
    select id, symbol, feature, version, observed, round(value, 6) as value from h""",
)(
    lambda s, d: r6(
        A.required_features(S.ticks(s, d).select(F.col("row_no").alias("id"), "symbol", F.expr("us div 1000000").alias("bar"), F.expr("us div 1000000 + row_no % 4 * 3000").alias("event_time")), restated(s, d), REQUIRED), "value"
    )
)

# Gates


def series_rows(s: SparkSession, d: str) -> DataFrame:
    return odd_quotes(s, d).select(
        "symbol", "bar", "row_no", F.col("bid_open").alias("open"), F.col("bid_high").alias("high"), F.col("bid_low").alias("low"), F.col("bid_close").alias("close"), F.col("bid_volume").alias("volume"),
        F.when(F.col("h") % 101 == 0, "4h").otherwise("1h").alias("scope"), F.lit("1h").alias("series_scope"),
    )


query(
    "validate_bar_series",
    f"""with {QUOTES}, p as (select *, lag(bar) over (partition by symbol order by row_no) as before, coalesce(least(bid_open, bid_high, bid_low, bid_close) <= 0 or bid_high < greatest(bid_open, bid_high, bid_low, bid_close) or bid_low > least(bid_open, bid_high, bid_low, bid_close) or bid_volume < 0, true) as bad from qq),
    c as (select symbol, count(*) filter (bar <= before) as order_violations, count(*) filter (bad) as invalid_rows, count(*) filter (h % 101 = 0) as mixed_scope from p group by 1) select *, order_violations + invalid_rows + mixed_scope = 0 as valid from c""",
)(lambda s, d: G.validate_bar_series(series_rows(s, d)))
_odd = "case when bar // 3600 % 17 = 0 then 'nan'::double when bar // 3600 % 19 = 0 then null else value end as value, case when bar // 3600 % 13 = 0 then 'warmup' else status end as status"


def odd_features(s: SparkSession, d: str) -> DataFrame:
    h = F.col("bar") / HOUR
    rows = stored_features(s, d).withColumns({"value": F.when(h % 17 == 0, F.lit(float("nan"))).when(h % 19 == 0, None).otherwise(F.col("value")), "status": F.when(h % 13 == 0, "warmup").otherwise(F.col("status"))})
    return rows.withColumn("copy", F.explode(F.when(h % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


query(
    "validate_feature_set",
    f"""{STORED}, o as (select symbol, bar, feature, {_odd}, unnest(case when bar // 3600 % 23 = 0 then [0, 1] else [0] end) as copy from st)
    select symbol, bar, feature, case when not isfinite(value) then 'nonfinite_value' when status = 'value' and value is null then 'status_without_value' when status <> 'value' and value is not null then 'value_without_status' end as code from o where code is not null
    union all select symbol, bar, feature, 'duplicate_key' from o group by 1, 2, 3 having count(*) > 1""",
)(lambda s, d: G.validate_feature_set(odd_features(s, d), ["symbol", "bar", "feature"]))
query(
    "backtest_input_gate",
    f"""with {QUOTES}, x as (select symbol, bar, unnest([case when symbol not in ('click', 'view', 'error') then 'unknown_symbol' end, case when h % 101 = 0 then 'wrong_timeframe' end, case when h % 7 = 0 then 'wrong_policy' end,
    case when not (bar >= 1704153600 and bar < 1706313600) then 'out_of_range' end, case when not {OPEN} then 'market_closed' end]) as code from qq)
    select * from x where code is not null union all select symbol, bar, 'duplicate_bar' from qq group by 1, 2 having count(*) > 1""",
)(
    lambda s, d: G.backtest_input_gate(
        odd_quotes(s, d).withColumns({"timeframe": F.when(F.col("h") % 101 == 0, "4h").otherwise("1h"), "adjustment_policy": F.when(F.col("h") % 7 == 0, "split").otherwise("raw")}), ["click", "view", "error"], "1h", "raw", 1_704_153_600, 1_706_313_600, session_open(F.col("bar"))
    )
)


def dataset_rows(s: SparkSession, d: str) -> DataFrame:
    """A dataset of each weekday of the bars, in source order."""
    rows = odd_quotes(s, d)
    return rows.select(
        F.concat(F.lit("d"), F.floor(F.col("bar") / DAY) % 7).alias("dataset"), "symbol", "bar", "row_no", F.col("bid_close").alias("bid"), F.col("ask_close").alias("ask"), F.when(F.col("h") % 301 == 0, "4h").otherwise("1h").alias("timeframe"), F.lit("raw").alias("policy"),
        (F.floor(F.col("bar") / DAY) % 7 == 2).alias("equity_unresolved"),
    )


DATASETS = f"""{QUOTES}, ds as (select 'd' || bar // 86400 % 7 as dataset, symbol, bar, row_no, bid_close as bid, ask_close as ask, case when h % 301 = 0 then '4h' else '1h' end as timeframe, bar // 86400 % 7 = 2 as equity_unresolved from qq),
  mf as (select dataset, string_agg(distinct symbol, ',' order by symbol) as symbols, min(bar) as start, max(bar) as "end", count(*) as rows, min(timeframe) = max(timeframe) as single_scope, count(*) = count(distinct symbol || '|' || bar) as unique_identity from ds group by 1),
  ms as (select 'd' || bar // 86400 % 7 as dataset, count(*) as missing_bars from gp where {OPEN} and (symbol, bar) not in (select symbol, bar from qq) group by 1),
  ql as (select dataset, count(*) as bar_count, count(*) - count(distinct symbol || '|' || bar) as duplicate_timestamps, count(*) filter (bar <= p) as back, count(bid + ask) / count(*)::double as quote_coverage, bool_or(equity_unresolved) as unresolved
    from (select *, lag(bar) over (partition by dataset, symbol order by row_no) as p from ds) group by 1),
  qd as (select dataset, bar_count, duplicate_timestamps, coalesce(missing_bars, 0) as missing_bars, round(quote_coverage, 6) as quote_coverage, concat_ws(';', case when quote_coverage < 1 then 'bid/ask availability is incomplete' end, case when duplicate_timestamps > 0 then 'duplicate timestamps' end,
    case when unresolved then 'equity survivorship or corporate-action lineage is unresolved' end, case when back > 0 then 'timestamps are not strictly monotonic' end) as reasons from ql left join ms using (dataset)), qs as (select *, case when reasons = '' then 'qualified' else 'rejected' end as status from qd)"""
query("dataset_manifest", f"with {DATASETS} select * from mf")(lambda s, d: G.dataset_manifest(dataset_rows(s, d)))


def missing_of(s: SparkSession, d: str) -> DataFrame:
    return B.missing_bars(bars(s, d), HOUR).select(F.concat(F.lit("d"), F.floor(F.col("bar") / DAY) % 7).alias("dataset"))


query("qualify_dataset", f"with {DATASETS} select * from qs")(lambda s, d: r6(G.qualify_dataset(dataset_rows(s, d), missing_of(s, d)), "quote_coverage"))
ELIGIBLE = {"fixture": "k % 11 = 0", "status": "case when k % 3 = 0 then 'rejected' else 'qualified' end", "source_version": "case when k % 4 > 0 then 'v1' when k % 8 = 0 then '' end", "calendar": "case when k % 5 > 0 then 'c' end", "equity_unresolved": "k % 6 = 0", "convention": "case when k % 7 > 0 then 'bid' end"}
query(
    "empirical_eligibility",
    f"""with e as (select k, {", ".join(f"{e} as {n}" for n, e in ELIGIBLE.items())} from (select p_partkey as k from part)), b as (select k, fixture, case when fixture then '' else concat_ws(';', case when status <> 'qualified' then 'dataset_qualification_failed' end, case when coalesce(source_version, '') = '' then 'source_version_missing' end,
    case when coalesce(calendar, '') = '' then 'calendar_identity_missing' end, case when equity_unresolved then 'survivorship_or_corporate_action_integrity_unverified' end, case when convention is null then 'quote_or_price_convention_missing' end) end as blockers from e)
    select k, blockers, case when fixture then 'deterministic_test_fixture' when blockers <> '' then 'blocked' else 'empirically_qualified' end as eligibility from b""",
)(lambda s, d: G.empirical_eligibility(S.table(s, d, "part").selectExpr("p_partkey as k").selectExpr("k", *[f"{e} as {n}" for n, e in ELIGIBLE.items()])).select("k", "blockers", "eligibility"))
query(
    "dataset_preflight",
    f"""with {DATASETS}, b as (select dataset, concat_ws(',', case when "end" - start < 29 * 86400 then 'coverage_too_short' end, case when duplicate_timestamps <> 0 then 'duplicate_timestamps_not_zero' end, case when not unique_identity then 'identity_not_unique' end,
    case when missing_bars <> 0 then 'missing_bars_not_zero' end, case when status <> 'qualified' then 'qualification_failed' end, case when not single_scope then 'scope_not_single' end) as blockers from mf join qs using (dataset)) select *, blockers = '' as ready from b""",
)(lambda s, d: G.dataset_preflight(G.dataset_manifest(dataset_rows(s, d)).join(G.qualify_dataset(dataset_rows(s, d), missing_of(s, d)), "dataset"), 29, ["duplicate_timestamps", "missing_bars"]).select("dataset", "blockers", "ready"))
GATE = {"rows": "k % 9", "scopes": "1 + (k % 8 = 0)::int", "duplicates": "(k % 7 = 0)::int", "incomplete": "(k % 11 = 0)::int", "latest": "1000000 - k % 13 * 1000", "bid": "case when k % 10 > 0 then 1.0 end", "ask": "1.1", "quote_time": "1000000 + case when k % 12 = 0 then 5 when k % 5 = 0 then -9000 else 0 end"}
_gate = lambda e: e.replace("(k % 8 = 0)::int", "int(k % 8 = 0)").replace("(k % 7 = 0)::int", "int(k % 7 = 0)").replace("(k % 11 = 0)::int", "int(k % 11 = 0)")
query(
    "admission_gate",
    f"""with g as (select k, {", ".join(f"{e} as {n}" for n, e in GATE.items())} from (select p_partkey as k from part)) select k, case when rows = 0 then 'data_empty' when scopes > 1 then 'mixed_scope' when duplicates > 0 then 'duplicate_bars' when incomplete > 0 then 'incomplete_bars'
    when 1000000 - latest > 7200 then 'data_stale' when bid is null then 'quote_missing' when quote_time > 1000000 then 'quote_in_future' when 1000000 - quote_time > 7200 then 'quote_stale' end as reason from g""",
)(lambda s, d: G.admission_gate(S.table(s, d, "part").selectExpr("p_partkey as k").selectExpr("k", *[f"{_gate(e)} as {n}" for n, e in GATE.items()]), F.lit(1_000_000), 7200).select("k", "reason"))
query(
    "operational_data_gate",
    f"""with {bars_sql(HOUR)}, l as (select symbol, max(bar) as latest, arg_max(close, bar) as bid, arg_max(close, bar) + case when symbol = 'view' then -1 else 1 end as ask, max(bar) + 3600 as quote_time from bars group by 1), m as (select max(latest) + 7200 as now from l),
    e as (select symbol, count(*) as errors from bars where low <= 1.2 and symbol = 'error' group by 1)
    select l.symbol, '1h' as timeframe, case when now - latest > 10800 then 'bar_stale' when bid > ask then 'quote_crossed' when now - quote_time > 10800 then 'quote_stale' when l.symbol = 'signup' then 'dataset_missing' when l.symbol = 'click' then 'dataset_hash_mismatch'
    when coalesce(errors, 0) > 0 then 'quality_errors' when l.symbol = 'purchase' then null else 'not_qualified' end as reason from l left join e using (symbol), m""",
)(lambda s, d: _operational(s, d))


def _operational(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    last = b.groupBy("symbol").agg(F.max("bar").alias("latest"), F.max_by("close", "bar").alias("bid")).withColumn("timeframe", F.lit("1h"))
    last = last.withColumns({"ask": F.col("bid") + F.when(F.col("symbol") == "view", -1).otherwise(1), "quote_time": F.col("latest") + HOUR})
    sets = last.where("symbol <> 'signup'").select("symbol", "timeframe", (F.col("latest") + HOUR).alias("end"), F.sha2("symbol", 256).alias("hash"), F.sha2(F.when(F.col("symbol") == "click", "x").otherwise(F.col("symbol")), 256).alias("expected_hash"))
    errors = b.where("low <= 1.2 and symbol = 'error'").select("symbol")
    good = last.where("symbol = 'purchase'").select("symbol", "timeframe", F.lit("qualified").alias("status"))
    return G.operational_gate(last, sets, errors, good, last.agg(F.max("latest") + 7200).scalar(), 10_800)


_found = "us // 1000000 as occurred, us // 3600000000 * 3600 as about, case when row_no % 3 > 0 then symbol end as symbol, case when row_no % 5 = 0 then case when row_no % 10 = 0 then '1h' else '4h' end end as timeframe, case when row_no % 7 = 0 then 's1' end as source"
query(
    "visible_quality_events",
    f"""with {bars_sql(HOUR)}, ev as (select {_found} from ticks where row_no % 3 = 0 or bid < 20) select b.symbol, b.bar, count(ev.occurred) as visible from bars b left join ev on ev.occurred <= b.bar + 3600 and ev.about <= b.bar and coalesce(ev.symbol, b.symbol) = b.symbol and coalesce(ev.timeframe, '1h') = '1h' and coalesce(ev.source, 's1') = 's1' group by 1, 2""",
)(
    lambda s, d: G.visible_events(
        bars(s, d).select("symbol", "bar", F.lit("1h").alias("timeframe"), F.lit("s1").alias("source")), S.ticks(s, d).where("row_no % 3 = 0 or bid < 20").selectExpr(*[x for x in _found.replace("//", "div").split(", ")]), HOUR
    ).select("symbol", "bar", "visible")
)

# Books

RATES = [("USD", "EUR", 0.9), ("GBP", "USD", 1.25), ("JPY", "USD", 0.0)]
_money = "case o_custkey % 5 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' when 3 then 'JPY' else 'CHF' end as base, case when o_orderkey % 3 = 0 then 'EUR' else 'USD' end as quote"
query(
    "convert_currency",
    f"""with r(base, quote, rate) as (values {", ".join(map(str, RATES))}), a as (select o_orderkey as id, o_totalprice as amount, {_money} from orders)
    select id, amount, a.base, a.quote, round(amount * case when a.base = a.quote then 1 else coalesce(x.rate, 1 / nullif(y.rate, 0)) end, 4) as converted from a left join r x on x.base = a.base and x.quote = a.quote left join r y on y.base = a.quote and y.quote = a.base""",
)(lambda s, d: K.convert_currency(S.table(s, d, "orders").selectExpr("o_orderkey as id", "o_totalprice as amount", *_money.split(", ")), s.createDataFrame(RATES, "base string, quote string, rate double")).withColumn("converted", F.round("converted", 4)))


def initial(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "customer").select(F.col("c_custkey").alias("account"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("none").alias("symbol"), (F.col("c_custkey") % 5 - 2).alias("quantity"))


def opens(s: SparkSession, d: str) -> DataFrame:
    return S.day_closes(s, d).select("symbol", F.col("t").alias("bar"), F.col("close").alias("open"))


def accounts(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))


query(
    "seed_positions",
    f"""with {DAYS}, f as (select symbol, arg_min(close, t) as price, min(t) as t from days group by 1), i as (select c_custkey as account, case when c_custkey % 2 = 0 then '1-URGENT' else 'none' end as symbol, c_custkey % 5 - 2 as quantity from customer)
    select account, symbol, quantity, price, t, round(quantity * price, 2) as cost from i join f using (symbol) where quantity <> 0""",
)(lambda s, d: K.seed_positions(initial(s, d), opens(s, d), accounts(s, d))[0].withColumn("cost", F.round("cost", 2)))
query(
    "seeded_cash",
    f"""with {DAYS}, f as (select arg_min(close, t) as price from days where symbol = '1-URGENT') select c_custkey as account, round(c_acctbal - case when c_custkey % 2 = 0 then (c_custkey % 5 - 2) * price else 0 end, 2) as cash from customer, f""",
)(lambda s, d: K.seed_positions(initial(s, d), opens(s, d), accounts(s, d))[1].withColumn("cash", F.round("cash", 2)))


def held(s: SparkSession, d: str) -> DataFrame:
    """The last position of each account and symbol with its average, marked at the symbol's last close."""
    led = L.position_ledger(S.fills(s, d)).groupBy("account", "symbol").agg(F.max_by(F.struct(F.col("position").alias("quantity"), F.col("average_price").alias("average"), F.col("t").alias("marked_at")), F.struct("t", "fill_id")).alias("x"))
    last = S.day_closes(s, d).groupBy("symbol").agg(F.max_by("close", "t").alias("price"))
    return led.select("account", "symbol", "x.*").join(last, "symbol")


HELD = f"""{LEDGER}, {DAYS}, hp as (select account, symbol, arg_max(pos, (t, fill_id)) as quantity, arg_max(case when pos <> 0 then avg else 0 end, (t, fill_id)) as average, max(t) as marked_at from ledger group by 1, 2), lc as (select symbol, arg_max(close, t) as price from days group by 1), held as (select * from hp join lc using (symbol))"""
query(
    "equity_snapshot",
    f"""with recursive {HELD}, p as (select account, sum(abs(quantity * price)) as gross, sum(quantity * price) as net, sum((price - average) * quantity) as unrealized, count(*) as open_positions from held where quantity <> 0 group by 1)
    select c_custkey as account, 1::bigint as t, c_acctbal as cash, {c2("coalesce(gross, 0)")} as gross, {c2("coalesce(net, 0)")} as net, {c2("coalesce(unrealized, 0)")} as unrealized, coalesce(open_positions, 0) as open_positions, {c2("c_acctbal + coalesce(net, 0)")} as equity from customer left join p on account = c_custkey""",
)(lambda s, d: cents(K.equity_snapshot(accounts(s, d).withColumn("t", F.lit(1).cast("long")), held(s, d).withColumn("t", F.lit(1).cast("long"))), "gross", "net", "unrealized", "equity"))
_locks = "account, case when account % 4 = 0 then 'drawdown' else 'daily_loss' end as lock, account % 3 = 0 as active"
query(
    "account_risk_snapshot",
    f"""with recursive {HELD}, p as (select account, sum(abs(quantity * price)) as gross, sum(quantity * price) as net, sum(greatest(quantity * price, 0)) as long, sum(greatest(-quantity * price, 0)) as short, sum((price - average) * quantity) as unrealized, min(marked_at) as mark_time from held where quantity <> 0 group by 1),
    o as (select o_custkey as account, count(*) as pending_orders from orders where o_orderstatus <> 'F' group by 1)
    select c_custkey as account, {c2("c_acctbal + coalesce(net, 0)")} as equity, {c2("greatest(c_acctbal + coalesce(net, 0), 0)")} as available_margin, {", ".join(f"{c2(f'coalesce({n}, 0)')} as {n}" for n in ("gross", "net", "long", "short", "unrealized"))},
    {c2("c_acctbal + coalesce(net, 0) - 1000")} as daily_pnl, {c2("greatest(5000 - c_acctbal - coalesce(net, 0), 0)")} as drawdown, coalesce(pending_orders, 0) as pending_orders, mark_time, case when c_custkey % 3 = 0 then case when c_custkey % 4 = 0 then 'drawdown' else 'daily_loss' end else '' end as locks
    from customer left join p on p.account = c_custkey left join o on o.account = c_custkey""",
)(
    lambda s, d: cents(
        K.account_risk_snapshot(
            accounts(s, d).withColumns({"day_start": F.lit(1000.0), "high_water": F.lit(5000.0)}), held(s, d), S.table(s, d, "orders").select(F.col("o_custkey").alias("account"), F.when(F.col("o_orderstatus") == "F", "filled").otherwise("accepted").alias("status")),
            accounts(s, d).selectExpr(*_locks.split(", ")),
        ), "equity", "available_margin", "gross", "net", "long", "short", "unrealized", "daily_pnl", "drawdown",
    )
)
_open = "o_orderkey as order_id, o_custkey as account, case o_orderkey % 3 when 0 then 'view' when 1 then 'click' else 'none' end as symbol, case when o_orderstatus = 'F' then 'sell' else 'buy' end as side, o_orderkey % 9 + 1 as quantity, o_orderkey % 11 as filled"
query(
    "open_order_exposure",
    f"""with {TICKS}, o as (select {_open} from orders), q as (select symbol, arg_max(bid, (us, row_no)) as bid, arg_max(ask, (us, row_no)) as ask from ticks group by 1), v as (select account, case when side = 'buy' then (quantity - filled) * ask else -(quantity - filled) * bid end as v from o join q using (symbol) where quantity > filled)
    select account, round(sum(v), 4) as net_reserved, round(sum(abs(v)), 4) as reserved, count(*) as open_orders from v group by 1""",
)(lambda s, d: K.open_order_exposure(S.table(s, d, "orders").selectExpr(*_open.split(", ")), S.ticks(s, d)).withColumns({c: F.round(c, 4) for c in ("net_reserved", "reserved")}))
query("buy_hold_curve", f"{HB}, f as (select symbol, arg_min(open, bar) as o from bars group by 1) select symbol, bar, round(10000 / o * close, 4) as equity from bars join f using (symbol)")(
    lambda s, d: K.buy_hold_curve(bars(s, d), 10_000.0).withColumn("equity", F.round("equity", 4))
)


def held_now(s: SparkSession, d: str) -> DataFrame:
    """A position (quantity) at each tick's time plus a second, to be marked."""
    return S.ticks(s, d).select("symbol", F.col("row_no").alias("id"), (F.col("us") + 1_000_000).alias("t"), (F.col("row_no") % 7 - 3).alias("quantity"))


query(
    "quote_mid_marks",
    f"""with {TICKS}, p as (select symbol, row_no as id, us + 1000000 as t, row_no % 7 - 3 as quantity from ticks)
    select p.symbol, id, t, quantity, round((bid + ask) / 2, 6) as mark, q.us as mark_time, round(quantity * ((bid + ask) / 2), 6) as value from p asof left join ticks q on p.symbol = q.symbol and p.t >= q.us""",
)(lambda s, d: r6(A.quote_marks(held_now(s, d), S.ticks(s, d).select("symbol", F.col("us").alias("t"), "bid", "ask", "row_no")), "mark", "value"))
query(
    "running_equity",
    f"""with {FILLS}, a as (select account, t, sum(case when side = 'buy' then -1 else 1 end * quantity * price - fee) as x from fills group by 1, 2), b as (select account, t, sum(x) over (partition by account order by t) as equity from a)
    select account, t, round(equity, 1) as equity, round(max(equity) over (partition by account order by t), 1) as high_water from b""",
)(
    lambda s, d: K.running_equity(S.fills(s, d).select("account", "symbol", "t", (F.when(F.col("side") == "buy", -1).otherwise(1) * F.col("quantity") * F.col("price") - F.col("fee")).alias("delta"))).withColumns({c: F.round(c, 1) for c in ("equity", "high_water")})
)


def ledger_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders, their fills, reservations, positions and accounts, with defects by key rules."""
    f = S.fills(s, d)
    k = F.col("fill_id")
    orders = f.where(k % 101 != 0).select(
        k.alias("order_id"), "account", F.when(k % 103 == 0, "x").otherwise(F.col("symbol")).alias("symbol"), "side", "quantity", F.when(k % 97 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("filled"), F.when(k % 5 == 0, "accepted").otherwise("filled").alias("status"),
        F.when(k % 107 == 0, F.col("t")).otherwise(F.col("t") - 1).alias("t"), k.cast("string").alias("intent"),
    )
    fills = f.select("fill_id", k.alias("order_id"), "account", "symbol", "side", F.when(k % 109 == 0, 0).otherwise(F.col("quantity")).alias("quantity"), "price", "fee", "t")
    held_back = orders.where("status = 'accepted' and order_id % 35 <> 0 or order_id % 113 = 0").select("order_id", "account", F.when(F.col("order_id") % 25 == 0, "other").otherwise(F.col("intent")).alias("intent"), F.lit(10.0).alias("amount"))
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    positions = fills.groupBy("account", "symbol").agg(F.sum(signed).alias("quantity"), F.sum("fee").alias("fees")).withColumn("quantity", F.col("quantity") + F.when(F.col("account") % 31 == 0, 1).otherwise(0))
    spent = fills.groupBy("account").agg(F.sum(-signed * F.col("price") - F.col("fee")).alias("flow"), F.sum("fee").alias("fees"))
    kept = held_back.groupBy("account").agg(F.sum("amount").alias("reserved"))
    acc = accounts(s, d).withColumnRenamed("cash", "starting_cash").join(spent, "account", "left").join(kept, "account", "left").na.fill(0.0, ["flow", "fees", "reserved"])
    acc = acc.select("account", "starting_cash", (F.col("starting_cash") + F.col("flow") + F.when(F.col("account") % 37 == 0, 5).otherwise(0)).alias("cash"), (F.col("fees") + F.when(F.col("account") % 41 == 0, 5).otherwise(0)).alias("fees"), (F.col("reserved") + F.when(F.col("account") % 43 == 0, 5).otherwise(0)).alias("reserved"))
    return orders, fills, held_back, positions, acc


_acc = lambda m, code: f"select c_custkey as account, '{code}' as code, c_custkey::varchar as key from customer where c_custkey % {m} = 0"
query(
    "reconcile_ledger",
    f"""with {FILLS}, o as (select fill_id as k, *, case when fill_id % 5 = 0 then 'accepted' else 'filled' end as status, quantity + (fill_id % 97 = 0)::int as filled, case when fill_id % 109 = 0 then 0 else quantity end as got from fills),
    kn as (select * from o where k % 101 <> 0)
    select account, 'nonpositive_fill' as code, k::varchar as key from o where got = 0 union all select account, 'order_quantity_not_conserved', k::varchar from kn where filled > quantity union all select account, 'order_filled_differs_from_fills', k::varchar from kn where filled <> got
    union all select account, 'filled_order_retains_quantity', k::varchar from kn where status = 'filled' and filled <> quantity union all select account, 'open_order_without_reservation', k::varchar from kn where status = 'accepted' and not (k % 35 <> 0 or k % 113 = 0)
    union all select account, 'reservation_without_open_order', k::varchar from kn where status = 'filled' and k % 113 = 0 union all select account, 'reservation_authorization_differs', k::varchar from kn where status = 'accepted' and (k % 35 <> 0 or k % 113 = 0) and k % 25 = 0
    union all select account, 'fill_of_unknown_order', k::varchar from o where k % 101 = 0 union all select account, 'fill_differs_from_order', k::varchar from kn where k % 103 = 0 union all select account, 'fill_before_submission', k::varchar from kn where k % 107 = 0
    union all select distinct account, 'position_differs_from_fills', symbol from o where account % 31 = 0
    union all {_acc(37, "cash_differs_from_fills")} union all {_acc(41, "fees_differ_from_fills")} union all {_acc(43, "reserved_risk_differs")}""",
)(lambda s, d: K.reconcile_ledger(*ledger_tables(s, d)))

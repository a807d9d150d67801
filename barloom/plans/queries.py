"""The registered market queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import columns as fn
from barloom.operators import asof as A
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import ledger as L
from barloom.operators import trading as T
from barloom.sources import tables as S


HOUR, DAY = 3600, 86_400
Q: dict = {}
SQL: dict[str, str] = {}

TICKS = """ticks as (select event_type as symbol, epoch_us(ts) as us, event_id as row_no, value as bid,
  value + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) / 10000.0::double as ask, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as bid_volume, bid_volume + 1 as ask_volume from events)"""
#: Malformed ticks by key rules: times rounded to the hour repeat and go back, prices and volumes are missing, not finite, negative or crossed.
BAD_TICKS = f"""{TICKS}, bt as (select symbol, row_no, case when row_no % 3 = 0 then us // 3600000000 * 3600000000 else us end as us, case when row_no % 97 = 0 then null when row_no % 89 = 0 then 'nan'::double when row_no % 83 = 0 then -bid else bid end as bid,
  case when row_no % 79 = 0 then bid - 1 else ask end as ask, case when row_no % 73 = 0 then null when row_no % 71 = 0 then -1.0::double else bid_volume::double end as bid_volume, ask_volume::double as ask_volume from ticks)"""
VALID_TICKS = f"""{BAD_TICKS}, vt as (select * from (select *, lag(us) over (partition by symbol order by row_no) as p from bt) where (p is null or us > p) and isfinite(bid) and isfinite(ask) and bid > 0 and ask > 0 and bid <= ask and bid_volume >= 0 and ask_volume >= 0)"""


def bad_ticks(s: SparkSession, d: str) -> DataFrame:
    r = F.col("row_no")
    return S.ticks(s, d).select(
        "symbol", "row_no", F.when(r % 3 == 0, F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000).otherwise(F.col("us")).alias("us"),
        F.when(r % 97 == 0, None).when(r % 89 == 0, F.lit(float("nan"))).when(r % 83 == 0, -F.col("bid")).otherwise(F.col("bid")).alias("bid"), F.when(r % 79 == 0, F.col("bid") - 1).otherwise(F.col("ask")).alias("ask"),
        F.when(r % 73 == 0, None).when(r % 71 == 0, F.lit(-1.0)).otherwise(F.col("bid_volume").cast("double")).alias("bid_volume"), F.col("ask_volume").cast("double").alias("ask_volume"),
    )


def bars_sql(width: int, ticks: str = TICKS, of: str = "ticks") -> str:
    total = lambda c: f"cast(sum({c}_volume) as bigint)" if of == "ticks" else f"sum({c}_volume)"
    side = lambda c, p: f"arg_min({c}, (us, row_no)) as {p}open, max({c}) as {p}high, min({c}) as {p}low, arg_max({c}, (us, row_no)) as {p}close, {total(c)} as {p}volume"
    return f"""{ticks}, bars as (select symbol, cast(us // {width * 1_000_000} * {width} as bigint) as bar, {side("bid", "")}, {side("ask", "ask_")}, count(*) as n, avg(ask - bid) as spread_mean,
      min(ask - bid) as spread_min, max(ask - bid) as spread_max, arg_max(ask - bid, (us, row_no)) as spread_close from {of} group by 1, 2)"""


DAYS = """days as (select o_orderpriority as symbol, cast(epoch(o_orderdate) // 86400 * 86400 as bigint) as t, arg_max(o_totalprice, o_orderkey) as close from orders group by 1, 2)"""
FILLS = """fills as (select o_orderkey as fill_id, o_custkey as account, o_orderpriority as symbol, case when o_orderstatus = 'F' then 'sell' else 'buy' end as side,
  o_orderkey % 9 + 1 as quantity, o_totalprice as price, o_totalprice / 1000 as fee, cast(floor(epoch(o_orderdate)) as bigint) as t from orders)"""
OPEN = "((bar - 259200) % 604800 >= 79200 and (bar - 259200) % 604800 < 511200)"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def bars(spark: SparkSession, sf_dir: str, width: int = HOUR) -> DataFrame:
    return B.ticks_to_bars(S.ticks(spark, sf_dir), width)


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


SPREADS = ["ask_open", "ask_high", "ask_low", "ask_close", "spread_mean", "spread_min", "spread_max", "spread_close"]
BAR = ["symbol", "bar", "open", "high", "low", "close", "volume", "ask_volume", "n"]
ROUND = lambda names: ", ".join(f"round({n}, 6) as {n}" for n in names)


for _name, _width in (("ticks_to_bars", HOUR), ("ticks_to_bars_15m", 900)):
    query(_name, f"with {bars_sql(_width, VALID_TICKS, 'vt')} select {', '.join(BAR)}, {ROUND(SPREADS)} from bars")(
        lambda s, d, w=_width: r6(B.ticks_to_bars(B.valid_ticks(bad_ticks(s, d)), w), *SPREADS).select(*BAR, *SPREADS)
    )

#: Feature -> (SQL value, rows of warm-up, inputs); w is the series window, r the row number. Windows are the registry's defaults.
_BACK = "over (w rows between {} preceding and {})"
_now = lambda n: _BACK.format(n, "current row")
_prev = lambda n: _BACK.format(n, "1 preceding")
_sd = lambda c, n: f"case when count({c}) {_now(n - 1)} = {n} then stddev_pop({c}) {_now(n - 1)} end"
_equity = lambda x: f"case when asset_class <> 'forex' then {x} end"
FEATURES = {
    "simple_return": ("ret", 1, "close"),
    "log_return": ("lret", 1, "close"),
    "rolling_return": ("close / lag(close, 20) over w - 1", 20, "close"),
    "rate_of_change": ("close / lag(close, 20) over w - 1", 20, "close"),
    "sma": (f"case when r >= 20 then avg(close) {_now(19)} end", 19, "close"),
    "moving_average_distance": (f"case when r >= 20 then close / (avg(close) {_now(19)}) - 1 end", 19, "close"),
    "rolling_volatility": (_sd("ret", 20), 20, "close"),
    "realized_volatility": (_sd("lret", 20), 20, "close"),
    "true_range": ("tr", 0, "close"),
    "atr": (f"case when r >= 14 then avg(tr) {_now(13)} end", 13, "close"),
    "rolling_high": (f"case when r >= 20 then max(high) {_now(19)} end", 19, "high"),
    "rolling_low": (f"case when r >= 20 then min(low) {_now(19)} end", 19, "low"),
    "range_position": (f"case when r >= 20 then (close - (min(low) {_now(19)})) / nullif((max(high) {_now(19)}) - (min(low) {_now(19)}), 0) end", 19, "close"),
    "distance_to_previous_high": (f"case when r >= 21 then close / (max(high) {_prev(20)}) - 1 end", 20, "close"),
    "distance_to_previous_low": (f"case when r >= 21 then close / (min(low) {_prev(20)}) - 1 end", 20, "close"),
    "breakout_state": (f"case when r >= 21 then case when close > (max(high) {_prev(20)}) then 1.0 when close < (min(low) {_prev(20)}) then -1.0 else 0.0 end end", 20, "close"),
    "volatility_ratio": (f"({_sd('ret', 10)}) / nullif({_sd('ret', 30)}, 0)", 30, "close"),
    "equity_volume": (_equity("volume"), 0, "volume"),
    "dollar_volume": (_equity("volume * close"), 0, "volume"),
}
#: Every other series is an equity, and every seventh hour has no volume.
FEATURE_BASE = f"""with {bars_sql(HOUR)}, fb as (select * exclude (volume), case when bar // 3600 % 7 = 0 then null else volume end as volume, case when symbol < 'p' then 'equity' else 'forex' end as asset_class from bars),
  a as (select *, close / nullif(lag(close) over w, 0) - 1 as ret, ln(close / lag(close) over w) as lret, row_number() over w as r,
  greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr0, lag(close) over w as before from fb window w as (partition by symbol order by bar)),
  b as (select *, case when before is null then high - low else tr0 end as tr from a)"""


def feature_bars(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d).withColumns({"volume": F.when(F.floor(F.col("bar") / HOUR) % 7 != 0, F.col("volume")), "asset_class": F.when(F.col("symbol") < "p", "equity").otherwise("forex")})


def feature_sql(name: str) -> str:
    value, warm, inputs = FEATURES[name]
    return f"""select symbol, bar, round(v, 6) as value, case when v is not null then 'value' when r <= {warm} then 'warmup' when {inputs} is not null then 'undefined' else 'missing_input' end as status
      from (select symbol, bar, r, {inputs}, cast({value} as double) as v from b window w as (partition by symbol order by bar))"""


for _name in FEATURES:
    query(_name, f"{FEATURE_BASE} {feature_sql(_name)}")(lambda s, d, n=_name: r6(X.compute(feature_bars(s, d), n), "value"))

SET = [("sma", 20), ("atr", 14), ("breakout_state", 20), ("dollar_volume", 1), ("volatility_ratio", 10), ("equity_volume", 1)]
_set = " union all ".join(f"select symbol, bar, '{n}' as feature, 'window={w}' as parameters, value, status from ({feature_sql(n)})" for n, w in SET)
query("compute_feature_set", f"{FEATURE_BASE} {_set}")(lambda s, d: r6(X.compute_feature_set(feature_bars(s, d), SET), "value"))
query(
    "features_wide",
    f"{FEATURE_BASE}, l as ({_set}) select symbol, bar, max(value) filter (feature = 'sma') as sma_window20, max(value) filter (feature = 'atr') as atr_window14, max(value) filter (feature = 'breakout_state') as breakout_state_window20 from l group by 1, 2",
)(lambda s, d: r6(X.features_wide(X.compute_feature_set(feature_bars(s, d), SET), [(n, f"window={w}") for n, w in SET[:3]]), "sma_window20", "atr_window14", "breakout_state_window20"))

PERCENTILE = """rt as (select symbol, bar, row_number() over w as r, close / lag(close) over w - 1 as ret from bars window w as (partition by symbol order by bar)),
  vl as (select symbol, bar, r, case when r >= {n} + 1 then stddev_pop(ret) over (partition by symbol order by bar rows between {n} - 1 preceding and current row) end as vol from rt),
  pc as (select x.symbol, x.bar, count(*) / {n}.0::double as percentile from vl x join vl y on x.symbol = y.symbol and y.r between x.r - {n} + 1 and x.r and y.vol <= x.vol where x.r >= 2 * {n} group by 1, 2)"""
query("volatility_percentile", f"with {bars_sql(HOUR)}, {PERCENTILE.format(n=20)} select bars.symbol, bars.bar, round(percentile, 6) as value from bars left join pc using (symbol, bar)")(lambda s, d: r6(X.volatility_percentile(bars(s, d)), "value"))
query(
    "ema",
    f"""with recursive {bars_sql(HOUR)}, a as materialized (select symbol, bar, close, row_number() over w as r, avg(close) over (w rows between 9 preceding and current row) as m from bars window w as (partition by symbol order by bar)),
    e as (select symbol, r, m as v from a where r = 10 union all select a.symbol, a.r, 2.0 / 11 * a.close + 9.0 / 11 * e.v from e join a on a.symbol = e.symbol and a.r = e.r + 1)
    select a.symbol, a.bar, round(e.v, 6) as value from a left join e on a.symbol = e.symbol and a.r = e.r""",
)(lambda s, d: r6(X.ema(bars(s, d), 10), "value"))
query(
    "rsi",
    f"""with recursive {bars_sql(HOUR)}, d as (select symbol, bar, close - lag(close) over w as x, row_number() over w as r from bars window w as (partition by symbol order by bar)),
    a as materialized (select symbol, bar, r, greatest(x, 0) as u, greatest(-x, 0) as l, avg(greatest(x, 0)) over w as mu, avg(greatest(-x, 0)) over w as ml from d window w as (partition by symbol order by bar rows between 13 preceding and current row)),
    e as (select symbol, r, mu, ml from a where r = 15 union all select a.symbol, a.r, (e.mu * 13 + a.u) / 14, (e.ml * 13 + a.l) / 14 from e join a on a.symbol = e.symbol and a.r = e.r + 1)
    select a.symbol, a.bar, round(case when e.ml = 0 then case when e.mu = 0 then 50 else 100 end else 100 - 100 / (1 + e.mu / e.ml) end, 6) as value from a left join e on a.symbol = e.symbol and a.r = e.r""",
)(lambda s, d: r6(X.rsi(bars(s, d)), "value"))

GRID = f"""grid as (select symbol, unnest(range(a, b + 1, {HOUR})) as bar from (select symbol, min(bar) as a, max(bar) as b from bars group by symbol))"""
query("expected_bars", f"with {bars_sql(HOUR)}, {GRID} select symbol, bar from grid where {OPEN}")(lambda s, d: B.expected_bars(bars(s, d), HOUR))
query("missing_bars", f"with {bars_sql(HOUR)}, {GRID} select symbol, bar from grid where {OPEN} and (symbol, bar) not in (select symbol, bar from bars)")(lambda s, d: B.missing_bars(bars(s, d), HOUR))
query("unexpected_bars", f"with {bars_sql(HOUR)}, o as (select symbol, case when bar // 3600 % 10 = 0 then bar + 60 else bar end as bar from bars) select symbol, bar from o where not {OPEN} or bar % 3600 <> 0")(
    lambda s, d: B.unexpected_bars(bars(s, d).withColumn("bar", F.when(F.floor(F.col("bar") / HOUR) % 10 == 0, F.col("bar") + 60).otherwise(F.col("bar"))), HOUR)
)
query(
    "classify_gaps",
    f"with {bars_sql(HOUR)}, {GRID} select symbol, bar, case when {OPEN} then 'data_gap' else 'closure' end as kind from grid where (symbol, bar) not in (select symbol, bar from bars)",
)(lambda s, d: B.classify_gaps(bars(s, d), HOUR))
query(
    "gap_runs",
    f"""with {bars_sql(HOUR)}, {GRID}, m as (select symbol, bar, bar - {HOUR} * row_number() over (partition by symbol order by bar) as run from grid where {OPEN} and (symbol, bar) not in (select symbol, bar from bars))
    select symbol, min(bar) as first_bar, max(bar) as last_bar, count(*) as length from m group by symbol, run""",
)(lambda s, d: B.gap_runs(bars(s, d), HOUR))
query(
    "suspicious_jumps",
    f"with {bars_sql(HOUR)}, a as (select symbol, bar, abs(open - lag(close) over w) / lag(close) over w as jump from bars window w as (partition by symbol order by bar)) select symbol, bar, round(jump, 6) as jump from a where jump > 0.2",
)(lambda s, d: r6(B.suspicious_jumps(bars(s, d), 0.2), "jump"))
query(
    "stale_sequences",
    f"""with {bars_sql(HOUR)}, z as (select symbol, bar, floor(close / 50) as close from bars), a as (select symbol, bar, case when close = lag(close) over w then 0 else 1 end as b from z window w as (partition by symbol order by bar)),
    c as (select symbol, bar, sum(b) over (partition by symbol order by bar) as run from a) select symbol, min(bar) as first_bar, count(*) as length from c group by symbol, run having count(*) >= 3""",
)(lambda s, d: B.stale_sequences(bars(s, d).withColumn("close", F.floor(F.col("close") / 50)), 3))
query(
    "order_violations",
    f"""with {BAD_TICKS}, a as (select symbol, row_no, us, lag(us) over (partition by symbol order by row_no) as p from bt)
    select symbol, row_no, case when us = p then 'duplicate_timestamp' else 'non_monotonic' end as code from a where us <= p""",
)(lambda s, d: B.order_violations(bad_ticks(s, d)))
query(
    "spread_distribution",
    f"""with {TICKS}, a as (select symbol, ask - bid as x, row_number() over (partition by symbol order by ask - bid) as r, count(*) over (partition by symbol) as n from ticks)
    select symbol, round(min(x), 6) as low, round(max(x), 6) as high, round(median(x), 6) as median, {", ".join(f"round(max(case when r = floor((n - 1) * {p}::double) + 1 then x end), 6) as {n}" for n, p in (("p95", 0.95), ("p99", 0.99)))} from a group by symbol""",
)(lambda s, d: r6(B.spread_distribution(S.ticks(s, d)), "low", "high", "median", "p95", "p99"))
query("latest_bar", f"with {bars_sql(HOUR)} select {', '.join(BAR)}, {ROUND(SPREADS)} from bars qualify row_number() over (partition by symbol order by bar desc) = 1")(lambda s, d: r6(B.latest_bar(bars(s, d)), *SPREADS).select(*BAR, *SPREADS))
query("freshness", f"with {bars_sql(HOUR)} select symbol, max(bar) as latest, (select max(us) // 1000000 from ticks) - max(bar) > 86400 as stale from bars group by symbol")(
    lambda s, d: B.freshness(bars(s, d), S.ticks(s, d).agg(F.floor(F.max("us") / 1_000_000)).scalar(), DAY)
)
query("query_bars", f"with {bars_sql(HOUR)} select symbol, bar, close from bars where bar >= 1704153600 and bar < 1706745600")(lambda s, d: B.query_bars(bars(s, d), 1_704_153_600, 1_706_745_600).select("symbol", "bar", "close"))
query(
    "dedupe_first",
    f"with {TICKS} select symbol, row_no, row_number() over (partition by symbol, us // 60000000 order by us, row_no) = 1 as kept from ticks",
)(lambda s, d: B.dedupe_first(S.ticks(s, d).withColumn("minute", F.floor(F.col("us") / 60_000_000)), ["symbol", "minute"], ["us", "row_no"]).select("symbol", "row_no", "kept"))
query(
    "upsert_bars",
    f"""with {bars_sql(HOUR)}, twice as (select symbol, bar, close, unnest([0, 1]) as copy from bars) select symbol, bar, close, copy, bar // 3600 % 2 = 1 and copy = 0 as accepted from twice""",
)(
    lambda s, d: (lambda x: x[0].withColumn("accepted", F.lit(True)).unionByName(x[1].withColumn("accepted", F.lit(False))))(
        B.upsert_bars(bars(s, d).where("floor(bar / 3600) % 2 = 0"), bars(s, d).select("symbol", "bar", "close", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")), ["copy"])
    )
)
PAIRS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("1-URGENT", "5-LOW"), ("5-LOW", "3-MEDIUM")]
query(
    "compare_closes",
    f"""with {DAYS}, pr(pa, pb) as (values {", ".join(map(str, PAIRS))}) select a.symbol as symbol_a, b.symbol as symbol_b, count(*) as n, round(avg(a.close - b.close), 6) as mean_signed, round(avg(abs(a.close - b.close)), 6) as mean_abs,
    round(max(abs(a.close - b.close)), 6) as max_abs from pr join days a on a.symbol = pa join days b on b.symbol = pb and a.t = b.t group by 1, 2""",
)(lambda s, d: r6(B.compare_closes(S.day_closes(s, d), S.day_closes(s, d), s.createDataFrame(PAIRS, "symbol_a string, symbol_b string")), "mean_signed", "mean_abs", "max_abs"))
_row = " || '|' || ".join(["symbol", "bar", *[f"printf('%.8f', {c}::double)" for c in B.CONTENT]])
query(
    "dataset_fingerprint",
    f"""with {bars_sql(HOUR)}, h as (select symbol, bar // 86400 as day, sha256({_row}) as h from bars), g as (select symbol, day, sha256(string_agg(h, '' order by h)) as h from h group by 1, 2)
    select symbol, sha256(string_agg(h, '' order by day)) as fingerprint from g group by 1""",
)(lambda s, d: B.dataset_fingerprint(bars(s, d)))

SIGNALS = f"""{bars_sql(HOUR)}, sg as (select symbol, bar, row_number() over w as r,
  case when close > max(high) over (w rows between 5 preceding and 1 preceding) then 'long' when close < min(low) over (w rows between 5 preceding and 1 preceding) then 'short' else 'flat' end as breakout,
  case when close / lag(close, 10) over w - 1 > 0 then 'long' else 'flat' end as momentum,
  case when avg(close) over (w rows between 2 preceding and current row) > avg(close) over (w rows between 9 preceding and current row) then 'long' else 'short' end as trend
  from bars window w as (partition by symbol order by bar)),
  signals as (select symbol, bar, unnest(['breakout', 'momentum', 'trend']) as strategy, unnest([breakout, momentum, trend]) as direction from sg where r > 10),
  votes as (select symbol, bar, count(*) filter (direction = 'long') as n_long, count(*) filter (direction = 'short') as n_short, count(*) filter (direction = 'flat') as n_flat from signals group by 1, 2)"""
query("strategy_signals", f"with {SIGNALS} select symbol, bar, strategy, direction from signals")(lambda s, d: T.signals(bars(s, d)))
query("vote_counts", f"with {SIGNALS} select *, 0 as n_hold from votes")(lambda s, d: T.vote_counts(T.signals(bars(s, d))))


def orders_(s: SparkSession, d: str) -> DataFrame:
    """An order of every tick."""
    return S.ticks(s, d).select("symbol", F.floor(F.col("us") / 1_000_000).alias("t"), F.col("row_no").alias("id"))


def level_orders(s: SparkSession, d: str) -> DataFrame:
    """A limit or stop order of every tick, a twentieth beside its price."""
    r = F.col("row_no")
    return S.ticks(s, d).select(
        r.alias("id"), "symbol", F.floor(F.col("us") / 1_000_000).alias("t"), F.when(r % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(r % 3 == 0, "stop").otherwise("limit").alias("kind"),
        F.when((r % 2 == 0) == (r % 3 == 0), F.col("bid") * 1.5).otherwise(F.col("bid") * 0.5).alias("level"),
    )


ORDERS = "od as (select symbol, us // 1000000 as t, row_no as id from ticks)"
query(
    "next_bar_fills",
    f"with {bars_sql(HOUR)}, {ORDERS} select id, od.symbol, t, bar as fill_bar, open as fill_price from od asof join bars on od.symbol = bars.symbol and od.t < bars.bar",
)(lambda s, d: A.next_bar_fills(orders_(s, d), bars(s, d)))
TOUCHES = f"""{bars_sql(HOUR)}, lo as (select row_no as id, symbol, us // 1000000 as t, (row_no % 2 = 0) <> (row_no % 3 = 0) as falls, bid * case when (row_no % 2 = 0) = (row_no % 3 = 0) then 1.5::double else 0.5::double end as level from ticks),
  touch as (select id, lo.symbol, min(bar) as fill_bar, arg_min(case when falls then least(open, level) else greatest(open, level) end, bar) as fill_price from lo join bars on lo.symbol = bars.symbol and bar > t and case when falls then low <= level else high >= level end group by 1, 2)"""
query("first_touch_fills", f"with {TOUCHES} select id, fill_bar, fill_bar + 3600 as fill_time, round(fill_price, 6) as fill_price from touch")(lambda s, d: r6(L.first_touch_fills(level_orders(s, d), bars(s, d), HOUR), "fill_price"))
query("ambiguous_triggers", f"with {TOUCHES} select id, symbol, fill_bar, count(*) over w as n, min(id) over w = id as kept from touch window w as (partition by symbol, fill_bar)")(
    lambda s, d: L.ambiguous_triggers(L.first_touch_fills(level_orders(s, d), bars(s, d), HOUR).join(level_orders(s, d).select("id", "symbol"), "id"))
)
query(
    "features_asof",
    f"with {bars_sql(HOUR)}, {ORDERS} select od.symbol, t, id, close as value from od asof left join bars on od.symbol = bars.symbol and od.t >= bars.bar + 3600",
)(lambda s, d: A.asof(orders_(s, d), bars(s, d).select("symbol", (F.col("bar") + HOUR).alias("t"), F.col("close").alias("value"))))
query(
    "cash_ledger",
    f"""with {FILLS}, a as (select f.*, c_acctbal as cash, case when side = 'buy' then -1 else 1 end * quantity * price - fee as flow from fills f join customer on account = c_custkey),
    b as (select account, fill_id, flow, cash + sum(flow) over w as after, sum(fee) over w as fees from a window w as (partition by account order by t, fill_id rows unbounded preceding))
    select account, fill_id, round(after - flow, 0) as cash_before, round(after, 0) as cash_after, round(fees, 1) as fees, after < 0 as insufficient from b""",
)(
    lambda s, d: T.cash_ledger(S.fills(s, d), S.table(s, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))).withColumns(
        {"cash_before": F.round("cash_before", 0), "cash_after": F.round("cash_after", 0), "fees": F.round("fees", 1)}
    )
)
query(
    "position_quantities",
    f"with {FILLS} select account, symbol, fill_id, cast(sum(case when side = 'buy' then quantity else -quantity end) over (partition by account, symbol order by t, fill_id rows unbounded preceding) as bigint) as position from fills",
)(lambda s, d: T.position_quantities(S.fills(s, d)))
query("turnover_and_fees", f"with {FILLS} select account, round(sum(abs(quantity * price)), 2) as turnover, round(sum(fee), 1) as fees, count(*) as n from fills group by account")(
    lambda s, d: T.turnover_and_fees(S.fills(s, d)).withColumns({"turnover": F.round("turnover", 2), "fees": F.round("fees", 1)})
)
query(
    "drawdown",
    f"with {bars_sql(HOUR)}, a as (select symbol, bar, close / max(close) over (partition by symbol order by bar) - 1 as fall from bars) select symbol, round(min(fall), 6) as max_drawdown, arg_min(bar, (fall, bar)) as trough from a group by symbol",
)(lambda s, d: r6(T.drawdown(bars(s, d)), "max_drawdown"))
query(
    "performance_metrics",
    f"""with {DAYS}, z as (select symbol, t, case when t // 86400 % 50 = 0 then 0 else close end as close from days), a as (select symbol, t, close, close / nullif(lag(close) over w, 0) - 1 as ret, close / max(close) over w - 1 as fall from z window w as (partition by symbol order by t)),
    b as (select symbol, arg_min(close, t) as f, arg_max(close, t) as l, (max(t) - min(t)) / 86400.0::double / 365.2425::double as y, avg(ret) - 0.02::double / 252 as m, stddev_pop(ret) as sd, sqrt(avg(case when ret is not null then power(least(ret - 0.02::double / 252, 0), 2) end)) as dn, min(fall) as dd from a group by symbol)
    select symbol, round(l / nullif(f, 0) - 1, 6) as total_return, round(case when l > 0 and f > 0 and y > 0 then power(l / f, 1 / y) - 1 end, 6) as cagr, round(sd * sqrt(252), 6) as volatility, round(m / nullif(sd, 0) * sqrt(252), 6) as sharpe,
    round(m / nullif(dn, 0) * sqrt(252), 6) as sortino, round(dd, 6) as max_drawdown, round(case when l > 0 and f > 0 and y > 0 then power(l / f, 1 / y) - 1 end / nullif(abs(dd), 0), 6) as calmar from b""",
)(
    lambda s, d: (lambda x: r6(x, *x.columns[1:]))(
        T.performance_metrics(S.day_closes(s, d).select("symbol", F.col("t").alias("bar"), F.when(F.floor(F.col("t") / DAY) % 50 == 0, 0.0).otherwise(F.col("close")).alias("close")), annualization=252, risk_free=0.02)
    )
)


def trades_(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("group"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 1000 * 60).alias("held"), "l_tax", "l_quantity"
    )


TRADES = "tr as (select l_returnflag as g, l_extendedprice * (l_discount - 0.05::double) as pnl, l_orderkey * 10 + l_linenumber as id, l_orderkey % 1000 * 60 as held, l_tax, l_quantity from lineitem)"
query(
    "trade_statistics",
    f"""with {TRADES} select g as "group", count(*) as n, count(*) filter (pnl > 0) as wins, count(*) filter (pnl < 0) as losses, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 4) as win_rate, round(avg(pnl) filter (pnl > 0), 4) as average_win, round(avg(pnl) filter (pnl < 0), 4) as average_loss,
    round(sum(pnl) filter (pnl > 0) / -(sum(pnl) filter (pnl < 0)), 4) as profit_factor, round(avg(pnl), 4) as expectancy, round(max(pnl), 4) as best, round(min(pnl), 4) as worst, round(avg(held), 4) as mean_held from tr group by g""",
)(lambda s, d: (lambda x: x.withColumns({c: F.round(c, 4) for c in x.columns if c not in ("group", "n", "wins", "losses")}))(T.trade_statistics(trades_(s, d))))
query(
    "outlier_dependence",
    f"""with {TRADES}, a as (select *, row_number() over (partition by g order by pnl desc, id) as r from tr)
    select g as "group", round(sum(pnl), 2) as total, {", ".join(f"round(sum(pnl) filter (r <= {k}), 2) as top_{k}, round(sum(pnl) - sum(pnl) filter (r <= {k}), 2) as without_{k}" for k in (1, 5, 10))} from a group by g""",
)(lambda s, d: (lambda x: x.withColumns({c: F.round(c, 2) for c in x.columns if c != "group"}))(T.outlier_dependence(trades_(s, d))))
COSTS = {"base": 1.0, "double": 2.0, "triple": 3.0}
query(
    "cost_sensitivity",
    f"""with {TRADES}, c as (select g, pnl - unnest([1, 2, 3]) * (l_quantity * 0.5 + abs(pnl) * l_tax + l_quantity * 0.25) as net, unnest(['base', 'double', 'triple']) as scenario from tr)
    select g as "group", scenario, count(*) as n, round(sum(net), 1) as net, round(avg(net), 4) as expectancy, round(avg(case when net > 0 then 1.0 else 0.0 end), 6) as win_rate from c group by 1, 2""",
)(
    lambda s, d: T.cost_sensitivity(
        trades_(s, d).select("id", "group", F.col("pnl").alias("gross"), (F.col("l_quantity") * 0.5).alias("fee"), (F.abs("pnl") * F.col("l_tax")).alias("spread"), (F.col("l_quantity") * 0.25).alias("slippage")), COSTS
    ).withColumns({"net": F.round("net", 1), "expectancy": F.round("expectancy", 4), "win_rate": F.round("win_rate", 6)})
)
for _name, _by in (("bh_adjust", False), ("by_adjust", True)):
    query(
        _name,
        f"""with t as (select p_partkey % 5 as family, p_partkey as test_id, (p_partkey * 7919 % 1000 + 1) / 1001.0::double as p from part),
        a as (select *, row_number() over (partition by family order by p, test_id) as r, count(*) over (partition by family) as m from t),
        b as (select *, p * m / r{" * sum(1.0::double / r) over (partition by family)" if _by else ""} as raw from a)
        select family, test_id, round(least(min(raw) over (partition by family order by p, test_id rows between current row and unbounded following), 1.0), 6) as adjusted from b""",
    )(
        lambda s, d, by=_by: r6(
            T.bh_adjust(S.table(s, d, "part").select((F.col("p_partkey") % 5).alias("family"), F.col("p_partkey").alias("test_id"), ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001.0).alias("p")), by), "adjusted"
        )
    )
query(
    "nearest_rank_quantile",
    f"with {TRADES}, a as (select *, row_number() over (partition by g order by pnl) as r, count(*) over (partition by g) as n from tr) select g as \"group\", round(pnl, 4) as quantile from a where r = greatest(ceil(n * 0.95::double), 1)",
)(lambda s, d: T.nearest_rank_quantile(trades_(s, d), "group", "pnl", 0.95).withColumn("quantile", F.round("quantile", 4)))
query(
    "cost_scenarios",
    f"""with {FILLS} select fill_id as id, unnest(['base', 'double', 'triple']) as scenario, round(fee * unnest([1.0, 2.0, 3.0]), 6) as fee, round(price / 5000 * unnest([1.0, 2.0, 3.0]), 6) as spread, quantity * unnest([1.0::double, 2.0, 3.0]) as slippage from fills""",
)(lambda s, d: r6(T.cost_scenarios(S.fills(s, d).select(F.col("fill_id").alias("id"), "fee", (F.col("price") / 5000).alias("spread"), F.col("quantity").cast("double").alias("slippage")), COSTS), "fee", "spread"))
query(
    "execution_costs",
    f"""with {TICKS}, a as (select row_no, case when row_no % 2 = 0 then 'buy' else 'sell' end as side, bid, ask from ticks)
    select row_no, side, round(bid * case when side = 'buy' then 1.001 else 0.999 end, 6) as adverse, round(case when side = 'buy' then ask else bid end, 6) as executable, round(greatest(10 * 0.01 + 10 * bid * 0.0005, 1.0), 6) as commission from a""",
)(
    lambda s, d: S.ticks(s, d).withColumn("side", F.when(F.col("row_no") % 2 == 0, "buy").otherwise("sell")).select(
        "row_no", "side", F.round(fn.adverse_price(F.col("bid"), F.col("side"), 0.001), 6).alias("adverse"),
        F.round(fn.executable_price(F.col("side"), F.col("bid"), F.col("ask"), F.col("bid"), 0.0), 6).alias("executable"), F.round(fn.commission(F.lit(10), F.col("bid"), 0.01, 0.0005, 1.0), 6).alias("commission"),
    )
)
query(
    "lineage_edges",
    """with e as (select distinct * from (select 'order' as kind, 'L' || l_orderkey as source, 'O' || l_orderkey as target from lineitem union all select 'customer', 'O' || o_orderkey, 'C' || o_custkey from orders
    union all select 'nation', 'C' || c_custkey, 'N' || c_nationkey from customer)) select *, sha256(kind || '|' || source || '|' || target) as edge_id from e""",
)(
    lambda s, d: T.lineage_edges(
        S.table(s, d, "lineitem").selectExpr("'order' as kind", "concat('L', l_orderkey) as source", "concat('O', l_orderkey) as target")
        .union(S.table(s, d, "orders").selectExpr("'customer'", "concat('O', o_orderkey)", "concat('C', o_custkey)"))
        .union(S.table(s, d, "customer").selectExpr("'nation'", "concat('C', c_custkey)", "concat('N', c_nationkey)"))
    )
)



def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hourly bars to the signals of three strategies and their votes."""
    return T.vote_counts(T.signals(bars(spark, sf_dir)))

"""Registered queries of rules, allocation and research, with the DuckDB SQL that must give the same rows.

Rule inputs that the given tables lack are made from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators import research as R
from barloom.operators import rules as U
from barloom.operators import trading as T
from barloom.sources import tables as S

from .desk import HB
from .queries import DAYS, FILLS, HOUR, OPEN, SIGNALS, bars, bars_sql, query, r6

# Regimes and signals


def averaged(s: SparkSession, d: str) -> DataFrame:
    """symbol, bar, close, spread, fast and slow EMA, volatility percentile, bad."""
    b = bars(s, d)
    on = ["symbol", "bar"]
    out = b.select(*on, "close", F.col("spread_close").alias("spread"), (F.floor(F.col("bar") / HOUR) % 50 == 0).alias("bad"))
    for name, n in (("fast", 10), ("slow", 30)):
        out = out.join(r6(X.ema(b, n), "value").withColumnRenamed("value", name), on)
    return out.join(X.volatility_percentile(b, 10).withColumnRenamed("value", "percentile"), on)


def ema_sql(name: str, n: int) -> str:
    return f"""a{n} as materialized (select symbol, bar, close, row_number() over w as r, avg(close) over (w rows between {n - 1} preceding and current row) as m from bars window w as (partition by symbol order by bar)),
    e{n} as (select symbol, r, m as v from a{n} where r = {n} union all select a{n}.symbol, a{n}.r, 2.0 / {n + 1} * a{n}.close + {n - 1}.0 / {n + 1} * e{n}.v from e{n} join a{n} on a{n}.symbol = e{n}.symbol and a{n}.r = e{n}.r + 1),
    {name} as (select a{n}.symbol, a{n}.bar, round(e{n}.v, 6) as {name} from a{n} left join e{n} on a{n}.symbol = e{n}.symbol and a{n}.r = e{n}.r)"""


AVERAGED = f"""with recursive {bars_sql(HOUR)}, {ema_sql("fast", 10)}, {ema_sql("slow", 30)},
  rt as (select symbol, bar, row_number() over w as r, close / lag(close) over w - 1 as ret from bars window w as (partition by symbol order by bar)),
  vl as (select symbol, bar, r, case when r >= 11 then stddev_pop(ret) over (partition by symbol order by bar rows between 9 preceding and current row) end as vol from rt),
  pc as (select x.symbol, x.bar, count(*) / 10.0::double as percentile from vl x join vl y on x.symbol = y.symbol and y.r between x.r - 9 and x.r and y.vol <= x.vol where x.r >= 20 group by 1, 2),
  av as (select bars.symbol, bars.bar, close, spread_close as spread, bars.bar // 3600 % 50 = 0 as bad, fast, slow, percentile from bars join fast using (symbol, bar) join slow using (symbol, bar) left join pc using (symbol, bar)),
  ss as (select *, case when not {OPEN} then 'inactive' when bad then 'data_unavailable' when fast is null or slow is null or percentile is null then 'warmup' else 'active' end as data_session, (fast - slow) / abs(slow) as st from av),
  states as (select symbol, bar, data_session, case when data_session <> 'active' then 'unavailable' when st > 0.001 then 'trending_up' when st < -0.001 then 'trending_down' else 'neutral' end as trend,
  case when data_session <> 'active' then 'unavailable' when percentile < 0.25 then 'low' when percentile > 0.75 then 'high' else 'normal' end as volatility,
  case when data_session <> 'active' then 'unknown' when spread / close > 0.002 then 'stressed' else 'normal' end as liquidity from ss),
  dims as (select symbol, bar, unnest(['data_session', 'trend', 'volatility', 'liquidity']) as dimension, unnest([data_session, trend, volatility, liquidity]) as state from states),
  flips as (select *, lag(state) over (partition by symbol, dimension order by bar) as before from dims)"""
query("regime_states", f"{AVERAGED} select * from states")(lambda s, d: U.regime_states(averaged(s, d)))
query(
    "regime_runs",
    f"""{AVERAGED}, r as (select *, sum(case when before = state then 0 else 1 end) over (partition by symbol, dimension order by bar) as run from flips)
    select symbol, dimension, state, min(bar) as start, max(bar) as "end", count(*) as n, max(bar) - min(bar) + 3600 as seconds from r group by symbol, dimension, state, run""",
)(lambda s, d: U.regime_runs(U.regime_states(averaged(s, d)), HOUR))
query(
    "regime_shares",
    f"""{AVERAGED}, t as (select symbol, dimension, count(*) as m, count(*) filter (before <> state) as f from flips group by 1, 2)
    select symbol, dimension, state, count(*) as n, round(count(*) / any_value(m)::double, 6) as share, round(any_value(f) / nullif(any_value(m) - 1, 0)::double, 6) as transition_frequency from flips join t using (symbol, dimension) group by 1, 2, 3""",
)(lambda s, d: r6(U.regime_shares(U.regime_states(averaged(s, d))), "share", "transition_frequency"))
TREND = f"""{AVERAGED}, sg as (select symbol, bar, (fast - slow) / abs(slow) as score, case when fast is null or slow is null then 'hold' when abs((fast - slow) / abs(slow)) < 0.01 then 'flat' when fast > slow then 'long' else 'short' end as direction from av)"""
query("signal_trend", f"{TREND} select symbol, bar, direction, case direction when 'hold' then 'warmup' when 'flat' then 'trend_below_threshold' when 'long' then 'fast_ema_above_slow_ema' else 'fast_ema_below_slow_ema' end as reason, round(score, 6) as score from sg")(
    lambda s, d: r6(U.signal_trend(averaged(s, d), 0.01), "score")
)
query(
    "target_position_delta",
    f"""{TREND}, a as (select symbol, bar, case direction when 'long' then 100.0::double when 'short' then -100 when 'flat' then 0 end as aim from sg),
    b as (select symbol, bar, coalesce(last_value(aim ignore nulls) over (partition by symbol order by bar), 0) as target from a), c as (select *, target - coalesce(lag(target) over (partition by symbol order by bar), 0) as delta from b)
    select symbol, bar, case when delta > 0 then 'buy' else 'sell' end as side, abs(delta) as quantity from c where delta <> 0""",
)(lambda s, d: U.target_position_delta(U.signal_trend(averaged(s, d), 0.01), 100.0))

# Evidence and promotion

EVIDENCE = {
    "data_available": "k % 31 <> 0", "data_integrity": "k % 37 <> 0", "locked_oos_pristine": "k % 41 <> 0", "sample_adequate": "k % 9 <> 0",
    "net_expectancy": "case when k % 11 <> 0 then k % 17 - 1 end", "net_oos_return": "case when k % 19 <> 0 then k % 23 - 1 end", "benchmark_excess_return": "k % 13 - 1",
    "cost_survives": "case when k % 29 <> 0 then k % 10 <> 0 end", "slippage_survives": "k % 12 <> 0", "parameter_robust": "case when k % 7 <> 0 then true end", "walk_forward_consistent": "k % 14 <> 0",
    "multiple_testing_supported": "k % 15 <> 0", "regime_concentrated": "k % 16 = 0", "outlier_dependent": "case when k % 18 <> 0 then k % 21 = 0 end",
}
_evidence = lambda cast: ", ".join(f"cast({e} as {cast if n in U.NUMBERS else 'boolean'}) as {n}" for n, e in EVIDENCE.items())
EVIDENCE_SQL = f"with ev as (select p_partkey as k, {_evidence('double')} from (select p_partkey, p_partkey as k from part))"


def evidence(s: SparkSession, d: str) -> DataFrame:
    rows = S.table(s, d, "part").selectExpr("p_partkey as k")
    return rows.selectExpr("k", *_evidence("double").replace(", cast(", "\n cast(").split("\n "))


query(
    "classify_evidence",
    f"""{EVIDENCE_SQL} select k, case when not (data_available and data_integrity and locked_oos_pristine) then 'invalid' when not sample_adequate then 'conditional'
    when (net_expectancy is not null and net_oos_return is not null and benchmark_excess_return is not null and least(net_expectancy, net_oos_return, benchmark_excess_return) <= 0) or cost_survives is false or slippage_survives is false then 'kill'
    when net_expectancy > 0 and net_oos_return > 0 and benchmark_excess_return > 0 and cost_survives and slippage_survives and parameter_robust and walk_forward_consistent and multiple_testing_supported and not regime_concentrated and not outlier_dependent then 'pass'
    else 'conditional' end as decision from ev""",
)(lambda s, d: U.classify_evidence(evidence(s, d)).select("k", "decision"))
_fields = [*U.NUMBERS, *U.GOOD, *U.BAD, "sample_adequate"]
query(
    "decision_matrix",
    f"""{EVIDENCE_SQL} select k, unnest([{", ".join(repr(f) for f in [*_fields, "integrity"])}]) as field, unnest([{", ".join(f"coalesce({f}::varchar, 'UNAVAILABLE')" for f in _fields)}, (data_integrity and locked_oos_pristine)::varchar]) as value from ev""",
)(lambda s, d: U.decision_matrix(evidence(s, d), "k"))
PROMOTION = {
    "dataset_qualified": "k % 31 <> 0", "oos_pristine": "k % 37 <> 0", "risk_compatible": "k % 29 <> 0", "trades": "k % 60", "walk_forward_positive": "case when k % 7 <> 0 then k % 11 <> 0 end", "oos_positive": "k % 13 <> 0",
    "robust": "k % 17 <> 0", "parameter_stable": "case when k % 19 <> 0 then true end", "regime_stable": "k % 23 <> 0", "adjusted_p": "case when k % 5 <> 0 then (k % 10) / 100.0 end",
}
query(
    "evaluate_promotion",
    f"""with pr as (select k, {", ".join(f"{e} as {n}" for n, e in PROMOTION.items())} from (select p_partkey as k from part)) select k, case when not (dataset_qualified and oos_pristine and risk_compatible) or k % 26 = 0 then 'reject' when trades < 10 then 'hold'
    when walk_forward_positive is false or oos_positive is false or robust is false or parameter_stable is false or regime_stable is false then 'reject' when walk_forward_positive is null or parameter_stable is null then 'hold'
    when adjusted_p is null then 'hold' when adjusted_p > 0.055 then 'reject' else 'promotion_review' end as promotion from pr""",
)(
    lambda s, d: U.evaluate_promotion(
        S.table(s, d, "part").selectExpr("p_partkey as k").selectExpr("k", *[f"{e} as {n}" for n, e in PROMOTION.items()], "if(k % 26 = 0, array('leak', 'thin'), array('thin')) as warnings"), 10, 0.055, ["leak"]
    ).select("k", "promotion")
)

# Risk, sizing and allocation

LIMITS = {
    "health_age": 60, "market_age": 30, "snapshot_age": 90, "spread": 0.01, "cash": 500.0, "margin": 300.0, "leverage": 2.0, "daily_loss": 650.0, "drawdown": 2400.0, "positions": 10, "pending": 8,
    "gross": 12_000.0, "net": 3_500.0, "long": 8_000.0, "short": 8_000.0, "instrument": 2_500.0, "asset_class": 7_000.0, "trade": 1_500.0,
}
#: Inputs of the checks by key rules: column -> expression (both dialects).
INTENTS = {
    "now": "864000", "intent_time": "864000 + case when k % 31 = 0 then 5 when k % 37 = 0 then -5 else 0 end", "direction": "case k % 9 when 0 then 'hold' when 1 then 'short' when 2 then 'short' when 3 then 'short' else 'long' end",
    "status": "case when k % 9 = 0 then 'no_consensus' else 'directional' end", "duplicate": "k % 41 = 0", "health": "case when k % 43 = 0 then 'degraded' when k % 47 <> 0 then 'healthy' end", "health_time": "864000 - k % 67",
    "market_time": "case when k % 53 <> 0 then 864000 - k % 33 end", "same_symbol": "k % 59 <> 0", "market_status": "case k % 61 when 0 then 'stale' when 1 then 'invalid' when 2 then 'unavailable' else 'valid' end",
    "bid": "case when k % 71 = 0 then null when k % 73 = 0 then cast(0.0 as double) else cast(100.0 as double) end", "ask": "cast(100.0 + (k % 12) * 0.1 - case when k % 79 = 0 then 5 else 0 end as double)",
    "regime_time": "864000 + case when k % 83 = 0 then 1 when k % 89 = 0 then -1 else 0 end", "session": "case when k % 97 = 0 then null when k % 13 = 0 then 'inactive' else 'active' end", "trend": "case when k % 17 = 0 then 'unavailable' else 'neutral' end",
    "volatility": "'normal'", "liquidity": "case k % 19 when 0 then 'unknown' when 1 then 'stressed' else 'normal' end", "portfolio_time": "case when k % 101 <> 0 then 864000 - k % 95 end", "mark_time": "case when k % 23 <> 0 then 864000 - k % 95 - k % 2 end", "held": "k % 3",
    "equity": "cast(case when k % 103 = 0 then 0 else e end as double)", "cash": "cast((k % 11) * 300 as double)", "margin": "cast((k % 7) * 150 as double)", "daily_pnl": "cast(((k % 17) - 8) * 100 as double)", "high_water": "cast(e + (k % 6) * 500 as double)",
    "locks": "case when k % 107 = 0 then 'drawdown' when k % 109 = 0 then 'daily_loss' else '' end", "risk_day": "case when k % 29 = 0 then 9 else 10 end", "open_positions": "k % 12", "pending": "k % 10", "gross": "cast((k % 14) * 1000 as double)", "net": "cast(((k % 9) - 4) * 1000 as double)",
    "long": "cast((k % 10) * 1000 as double)", "short": "cast((k % 11) * 900 as double)", "instrument": "cast(((k % 7) - 3) * 1000 as double)", "asset_class": "cast((k % 8) * 1100 as double)",
}
_FROM = "(select o_orderkey as k, cast(o_totalprice / 10 + 1000 as double) as e from orders)"


def intents(s: SparkSession, d: str) -> DataFrame:
    return S.table(s, d, "orders").selectExpr("o_orderkey as k", "cast(o_totalprice / 10 + 1000 as double) as e").selectExpr("k", *[f"{e} as {n}" for n, e in INTENTS.items()])


_age = lambda t, most, stale: f"case when {t} is null or {t} > now then 'FUTURE_DATED_INPUT' when now - {t} > {most} then '{stale}' end"
_no = lambda ok, why: f"case when not coalesce({ok}, false) then '{why}' end"
_priced = "market_time is not null and coalesce(bid > 0 and ask > 0, false)"
_book, _full = "portfolio_time is not null", "portfolio_time is not null and equity > 0"
_grows = f"{_full} and not reduces"
_left = {
    "gross_exposure": ("12000 - gross", "'MAX_GROSS_EXPOSURE_EXCEEDED'"), "net_exposure": ("case when up then 3500 - net else 3500 + net end", "'MAX_NET_EXPOSURE_EXCEEDED'"),
    "directional_exposure": ("case when up then 8000 - long else 8000 - short end", "case when up then 'MAX_LONG_EXPOSURE_EXCEEDED' else 'MAX_SHORT_EXPOSURE_EXCEEDED' end"), "instrument_exposure": ("2500 - abs(instrument)", "'MAX_INSTRUMENT_EXPOSURE_EXCEEDED'"),
    "asset_class_exposure": ("7000 - asset_class", "'MAX_ASSET_CLASS_EXPOSURE_EXCEEDED'"), "leverage_headroom": ("2 * equity - gross", "'MAX_LEVERAGE_EXCEEDED'"),
}
_checks = [
    ("intent_timestamp", "true", "case when intent_time > now then 'FUTURE_DATED_INPUT' when intent_time <> now then 'INTENT_NOT_ACTIONABLE' end"), ("intent", "true", _no("direction in ('long', 'short') and status = 'directional'", "INTENT_NOT_ACTIONABLE")),
    ("system_health_freshness", "health is not null", _age("health_time", 60, "SYSTEM_HEALTH_STALE")), ("system_health", "true", _no("health = 'healthy'", "SYSTEM_UNHEALTHY")), ("market_data", "true", _no("market_time is not null", "DATA_UNAVAILABLE")),
    ("market_scope", "market_time is not null", _no("same_symbol", "DATA_INVALID")), ("market_freshness", "market_time is not null", _age("market_time", 30, "DATA_STALE")),
    ("market_data_status", "market_time is not null", "case market_status when 'stale' then 'DATA_STALE' when 'unavailable' then 'DATA_UNAVAILABLE' when 'invalid' then 'DATA_INVALID' end"), ("market_price", "market_time is not null", _no("bid > 0 and ask > 0", "PRICE_INVALID")),
    ("market_crossed", _priced, _no("bid <= ask", "CROSSED_MARKET")), ("spread", f"{_priced} and bid <= ask", _no("ask - bid <= 0.01::double * ((bid + ask) / 2)", "SPREAD_TOO_WIDE")),
    ("regime", "true", "case when session is null then 'REGIME_UNAVAILABLE' when regime_time > now then 'FUTURE_DATED_INPUT' when regime_time <> now then 'REGIME_UNAVAILABLE' when session <> 'active' then 'MARKET_INACTIVE' when trend = 'unavailable' or liquidity = 'unknown' then 'REGIME_UNAVAILABLE' when liquidity = 'stressed' then 'LIQUIDITY_STRESSED' end"),
    ("portfolio", "true", _no(_book, "PORTFOLIO_INVALID")), ("portfolio_freshness", _book, _age("portfolio_time", 90, "STALE_RISK_SNAPSHOT")), ("position_mark_freshness", _book, _no("held = 0 or (mark_time <= portfolio_time and now - mark_time <= 90)", "STALE_RISK_SNAPSHOT")),
    ("portfolio_numeric", _book, _no("equity > 0", "PORTFOLIO_INVALID")), ("duplicate_intent", _full, _no("not duplicate", "DUPLICATE_INTENT")), ("risk_locks", _full, "case when locks = 'drawdown' then 'DRAWDOWN_LOCKED' when locks <> '' then 'RISK_LOCK_ACTIVE' end"),
    ("risk_day", _full, _no("risk_day = now // 86400", "RISK_DAY_MISMATCH")), ("capital", _full, _no("cash >= 500", "INSUFFICIENT_CAPITAL")), ("margin", _full, _no("margin >= 300", "INSUFFICIENT_MARGIN")), ("leverage", _full, _no("gross <= 2 * equity", "MAX_LEVERAGE_EXCEEDED")),
    ("daily_loss", _full, _no("daily_pnl > -650", "DAILY_LOSS_LIMIT")), ("drawdown", _full, _no("high_water - equity < 2400", "DRAWDOWN_LIMIT")), ("position_count", _grows, _no("open_positions < 10", "MAX_POSITIONS_EXCEEDED")), ("pending_intents", _grows, _no("pending < 8", "MAX_PENDING_INTENTS_EXCEEDED")),
    *[(n, _grows, f"case when {v} <= 0 then {why} end") for n, (v, why) in _left.items()],
]
RISK = f"""with i as (select k, {", ".join(f"{e} as {n}" for n, e in INTENTS.items())} from {_FROM}), g as (select *, direction = 'long' as up, case when direction = 'long' then instrument < 0 else instrument > 0 end as reduces from i),
  f as (select *, concat_ws(',', {", ".join(f"case when {a} and ({r}) is not null then '{n}:' || ({r}) end" for n, a, r in _checks)}) as failed from g),
  rd as (select k, failed, failed = '' as approved, case when reduces then 'reduction_only' else 'new_or_increase' end as action, case when failed = '' and not reduces then least(1500, {", ".join(v for v, _ in _left.values())}) else 0 end::double as max_new, case when failed = '' and reduces then abs(instrument) else 0 end::double as max_reduction from f)"""
_told = ["k", "approved", "action", "max_new", "max_reduction"]


def risk_(s: SparkSession, d: str) -> DataFrame:
    return U.risk_checks(intents(s, d), LIMITS).select(*_told, F.array_join("failed", ",").alias("failed"))


query("risk_checks", f"{RISK} select * from rd")(risk_)
query(
    "bound_authorization",
    f"{RISK} select k as id, case when action = 'new_or_increase' then least(max_new, case when k % 4 > 0 then (k % 6 - 1) * 400 else 0 end) else 0 end::double as max_new0, case when action = 'new_or_increase' then 0 else least(max_reduction, greatest(case when k % 4 > 0 then (k % 6 - 1) * 400 else 0 end, 0)) end::double as max_reduction from rd".replace(
        "least(max_new, case when k % 4 > 0 then (k % 6 - 1) * 400 else 0 end)", "least(max_new, greatest(case when k % 4 > 0 then (k % 6 - 1) * 400 else 0 end, 0))").replace("max_new0", "max_new"),
)(lambda s, d: U.bound_authorization(risk_(s, d).select(F.col("k").alias("id"), "action", "max_new", "max_reduction"), S.table(s, d, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 6 - 1) * 400.0).alias("amount"))).select("id", "max_new", "max_reduction"))

# Fusion

RULES = [("trend", "long", "trending_up", None, None), ("trend", "short", None, "high", None), ("breakout", None, None, None, "normal")]


def fusion_signals(s: SparkSession, d: str) -> DataFrame:
    """Three strategies' signals; some are unavailable, some share a source, some hold."""
    h = F.floor(F.col("bar") / HOUR)
    direction = F.when((h % 11 == 0) & (F.col("strategy") == "momentum"), "unavailable").when((h % 13 == 0) & (F.col("strategy") == "trend"), "hold").otherwise(F.col("direction"))
    source = F.when(h % 7 == 0, F.lit("shared")).otherwise(F.col("strategy"))
    return T.signals(bars(s, d)).select("symbol", "bar", "strategy", source.alias("source_id"), direction.alias("direction"))


query(
    "fuse_signals",
    f"""{AVERAGED.rstrip()}, {SIGNALS.replace(bars_sql(HOUR) + ", ", "")}, fs as (select symbol, bar, strategy, case when bar // 3600 % 7 = 0 then 'shared' else strategy end as source_id, case when bar // 3600 % 11 = 0 and strategy = 'momentum' then 'unavailable' when bar // 3600 % 13 = 0 and strategy = 'trend' then 'hold' else direction end as direction from signals),
    fj as (select fs.*, states.trend, states.volatility, states.liquidity, coalesce(data_session = 'active' and states.trend <> 'unavailable' and liquidity <> 'unknown', false) as usable, row_number() over (partition by fs.symbol, fs.bar, source_id order by strategy, direction) > 1 as twice from fs left join states on states.symbol = fs.symbol and states.bar = fs.bar),
    ft as (select *, case when not usable then 'regime_unavailable' when twice then 'duplicate' when direction = 'unavailable' then 'unavailable' when strategy = 'trend' and not (direction = 'long' and trend = 'trending_up' or direction = 'short' and volatility = 'high') or strategy = 'breakout' and liquidity <> 'normal' then 'regime_incompatible' else 'eligible' end as state from fj),
    fc as (select symbol, bar, {", ".join(f"count(*) filter (state = 'eligible' and direction = '{x}') as n_{x}" for x in ("long", "short", "flat", "hold"))}, count(*) filter (state = 'eligible') as n, bool_or(usable) as usable, string_agg(strategy || ':' || direction || ':' || state, ',' order by strategy || ':' || direction || ':' || state) as signals from ft group by 1, 2),
    fw as (select *, n_long >= 2 and n_long - n_short >= 1 as up, n_short >= 2 and n_short - n_long >= 1 as down from fc)
    select symbol, bar, case when not usable or n = 0 then 'unavailable' when up then 'long' when down then 'short' else 'hold' end as direction, case when not usable then 'regime_unavailable' when n = 0 then 'all_signals_unavailable' when n_long + n_short = 0 then 'no_directional_signal' when up or down then 'directional' else 'no_consensus' end as status,
    n_long, n_short, n_flat, n_hold, signals from fw""",
)(lambda s, d: U.fuse_signals(fusion_signals(s, d), U.regime_states(averaged(s, d)), s.createDataFrame(RULES, "strategy string, direction string, trend string, volatility string, liquidity string")))
for _name, _equity in (("signal_forex_breakout", False), ("signal_equity_breakout", True)):
    query(
        _name,
        f"""{HB}, x as (select symbol, bar, close, case when row_number() over (partition by symbol order by bar) > 20 then max(high) over w end as hi, case when row_number() over (partition by symbol order by bar) > 20 then min(low) over w end as lo from bars window w as (partition by symbol order by bar rows between 20 preceding and 1 preceding))
        select symbol, bar, case when hi is null then 'hold' when close > hi then 'long' when close < lo then '{"flat" if _equity else "short"}' else '{"hold" if _equity else "flat"}' end as direction, case when hi is null then 'warmup' when close > hi then 'close_above_previous_high' when close < lo then 'close_below_previous_low' else 'inside_previous_range' end as reason,
        round(case when hi is not null then case when close > hi then close / hi - 1 when close < lo then close / lo - 1 else 0 end end, 6) as score from x""",
    )(lambda s, d, e=_equity: r6(U.signal_breakout(before_extremes(s, d), e), "score"))


def before_extremes(s: SparkSession, d: str) -> DataFrame:
    rows = X.prepared(bars(s, d))
    return rows.select("symbol", "bar", "close", X.full(F.max("high").over(X.back(20, -1)), 21).alias("high_before"), X.full(F.min("low").over(X.back(20, -1)), 21).alias("low_before"))


query(
    "signal_momentum",
    f"""{HB}, x as (select symbol, bar, close / lag(close, 20) over (partition by symbol order by bar) - 1 as ret from bars) select symbol, bar, case when ret is null then 'hold' when ret > 0.02 then 'long' else 'flat' end as direction,
    case when ret is null then 'warmup' when ret > 0.02 then 'momentum_above_threshold' else 'momentum_not_above_threshold' end as reason, round(ret, 6) as score from x""",
)(lambda s, d: r6(U.signal_momentum(X.compute(bars(s, d), "rolling_return").select("symbol", "bar", F.col("value").alias("ret")), 0.02), "score"))
query(
    "allocation_requests",
    f"""with {SIGNALS} select symbol || strategy as id, symbol, bar, direction, round((bar // 3600 % 5 + 1) * case when direction = 'long' then ask_close else close end, 4) as requested from signals join bars using (symbol, bar) where direction = 'long' and bar // 3600 % 3 > 0 or direction = 'short' and bar // 3600 % 3 = 0""",
)(
    lambda s, d: U.allocation_requests(
        T.signals(bars(s, d)).select(F.concat("symbol", "strategy").alias("id"), "symbol", "bar", "direction", F.when(F.col("bar") / HOUR % 3 > 0, "buy").otherwise("sell").alias("side"), (F.col("bar") / HOUR % 5 + 1).alias("quantity")),
        bars(s, d).select("symbol", "bar", F.col("close").alias("bid"), F.col("ask_close").alias("ask")),
    ).withColumn("requested", F.round("requested", 4))
)
query(
    "size_orders",
    """with o as (select o_orderkey as k, o_totalprice / 1000 + 5 as price, (o_orderkey % 20) * 500.0::double as authorized, (o_orderkey % 15) * 700.0::double as available from orders),
    s as (select k, price, authorized, available, unnest(range(0, cast(floor(least(authorized, available) / price + 1e-9) as bigint) + 1)) as q from o),
    b as (select k, any_value(price) as price, max(q) as q from s where q = 0 or q * price + greatest(q * 0.02 + q * price * 0.001, 5) <= authorized group by k)
    select k, case when q >= 2 then q::double end as quantity, case when q >= 2 then round(q * price + greatest(q * 0.02 + q * price * 0.001, 5) + 0.0012345678::double, 2) end as all_in from b""",
)(
    lambda s, d: U.size_orders(
        S.table(s, d, "orders").selectExpr("o_orderkey as k", "o_totalprice / 1000 + 5 as price", "double(o_orderkey % 20) * 500 as authorized", "double(o_orderkey % 15) * 700 as available"), 1.0, 2.0, 0.02, 0.001, 5.0
    ).select("k", "quantity", F.round(F.col("all_in") + 0.0012345678, 2).alias("all_in"))
)
query(
    "collapse_signals",
    f"""with {FILLS}, a as (select account, symbol, coalesce(max(price) filter (side = 'buy'), 0) as up, coalesce(max(price) filter (side = 'sell'), 0) as down from fills group by 1, 2) select account, symbol, round(up - down, 2) as requested, up > 0 and down > 0 as conflict from a""",
)(
    lambda s, d: U.collapse_signals(S.fills(s, d).select("account", "symbol", F.when(F.col("side") == "buy", "long").otherwise("short").alias("direction"), F.col("price").alias("notional")), ["account", "symbol"]).withColumn("requested", F.round("requested", 2))
)
BUDGETS = {"strategy": 3000.0, "family": 5000.0, "instrument": 4000.0, "gross": 9000.0, "net": 5000.0, "incremental": 7000.0, "turnover": 8000.0}
REQUESTS = "o_custkey as decision, o_orderkey as strategy, o_orderpriority as family, o_orderstatus as symbol, cast((o_orderkey % 9) - 4 as double) * 1000 as requested, cast((o_custkey % 7) - 3 as double) * 500 as base"
_cut = lambda v, f: f"case when {f} < 1 then sign({v} * {f}) * floor(abs({v} * {f}) / 100 + 1e-9) * 100 else {v} end"
_room = lambda used, room: f"case when {used} > 0 and {used} > greatest({room}, 0) then greatest({room}, 0) / {used} else 1 end"
_risk = "abs(dl) - case when dl * base < 0 then least(abs(dl), abs(base)) else 0 end"
query(
    "allocate",
    f"""with a as (select {REQUESTS} from orders), b as (select *, case when abs(requested) > 3000 then sign(requested) * 3000 else requested end as v from a), b1 as (select *, sum(abs(v)) over (partition by decision, family) as tot from b),
    b2 as (select *, case when tot > 5000 then 5000 / tot else 1 end as f from b1), c as (select * exclude (v, f, tot), {_cut("v", "f")} as v from b2), c1 as (select *, sum(v) over (partition by decision, symbol) as dl from c),
    c2 as (select *, {_risk} as rk from c1), c3 as (select *, case when rk > greatest(4000 - abs(base), 0) then greatest(4000 - abs(base), 0) / rk else 1 end as f from c2), e as (select * exclude (v, f, dl, rk), {_cut("v", "f")} as v from c3),
    e1 as (select decision, symbol, base, sum(v) as dl, sum(abs(v)) as tv from e group by 1, 2, 3), e2 as (select decision, sum({_risk}) as nw, sum(abs(base)) as gr, sum(base) as nt, sum(dl) as d, sum(tv) as tv from e1 group by 1),
    e3 as (select *, greatest(abs(nt + d) - abs(nt), 0) as grow from e2), g as (select decision, least({_room("nw", "9000 - gr")}, {_room("grow", "5000 - abs(nt)")}, {_room("nw", "7000")}, {_room("tv", "8000")}) as f from e3),
    h as (select decision, strategy, symbol, requested, {_cut("v", "f")} as proposed from e join g using (decision)), t as (select decision, sum(abs(requested)) as asked, sum(abs(proposed)) as given from h group by 1)
    select decision, strategy, symbol, requested, proposed + 0 as proposed, case when given = asked and given > 0 then 'approved' when given > 0 then 'reduced' else 'rejected' end as status from h join t using (decision)""",
)(lambda s, d: U.allocate(S.table(s, d, "orders").selectExpr(*REQUESTS.split(", ")), BUDGETS, 100.0).withColumn("proposed", F.col("proposed") + 0))

_of = "case when o_orderpriority < '3' then 'forex' when o_orderpriority < '5' then 'equity' else 'other' end as asset_class"
ASKED = f"o_custkey % 700 as decision, 's' || o_orderkey as strategy, 'f' || o_orderkey % 4 as family, o_orderpriority as symbol, {_of}, ((o_orderkey * 7919) % 61 - 30) * 100.0 as requested"
KEPT = f"o_custkey % 700 as decision, o_orderpriority as symbol, {_of}, ((o_orderkey * 31) % 21 - 10) * 40.0 as value"
PORTFOLIO, CLASSES = {"strategy": 2000.0, "family": 9000.0, "instrument": 4500.0, "gross": 16_000.0, "net": 4000.0, "incremental": 12_000.0, "turnover": 13_000.0}, {"forex": 6000.0, "equity": 7000.0}


def portfolio(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = S.table(s, d, "orders")
    asked = rows.where("o_orderkey % 2 = 0").selectExpr(*ASKED.split(", "))
    kept = [rows.where(f"o_orderkey % 2 = 1 and o_orderstatus {x} 'F'").selectExpr(*KEPT.split(", ")) for x in ("=", "<>")]
    cast = lambda df, n: df.withColumn(n, F.col(n).cast("double"))
    held = cast(kept[0], "value").groupBy("decision", "symbol", "asset_class").agg(F.sum("value").alias("value"))  # one position a symbol
    return U.allocate_portfolio(cast(asked, "requested"), held, cast(kept[1], "value"), PORTFOLIO, CLASSES, 100.0)


_new = "abs(ch) - case when ch * base < 0 then least(abs(ch), abs(base)) else 0 end"
_fit = lambda used, left: f"case when {used} > greatest({left}, 0) then greatest({left}, 0) / {used} else 1 end"
_step = lambda src, dst, f, code: f"{dst} as (select * exclude (v, why, f), case when f < 1 then sign(v * f) * floor(abs(v * f) / 100 + 1e-9::double) * 100 else v end as v, case when f < 1 then list_append(why, '{code}') else why end as why from (select *, {f} as f from {src}))"
_lead = "case when row_number() over (partition by decision, symbol order by strategy) = 1 then rk else 0 end"
_risky = lambda src, dst: f"{dst}0 as (select *, sum(v) over (partition by decision, symbol) as ch from {src}), {dst} as (select *, {_new} as rk from {dst}0)"
ALLOCATED = f"""aq as (select {ASKED}::double as requested_, * from orders where o_orderkey % 2 = 0),
  ap as (select decision, symbol, asset_class, sum(value::double) as value, 'p' as kind from (select {KEPT} from orders where o_orderkey % 2 = 1 and o_orderstatus = 'F') group by 1, 2, 3), ar as (select decision, symbol, asset_class, value::double as value, 'r' as kind from (select {KEPT} from orders where o_orderkey % 2 = 1 and o_orderstatus <> 'F')),
  ah as (select decision, symbol, asset_class, coalesce(sum(value) filter (kind = 'p'), 0) as position, coalesce(sum(value) filter (kind = 'r'), 0) as reserved, abs(coalesce(sum(value) filter (kind = 'p'), 0)) + coalesce(sum(abs(value)) filter (kind = 'r'), 0) as base_gross from (select * from ap union all select * from ar) group by 1, 2, 3),
  aw as (select decision, sum(base_gross) as gross, sum(position + reserved) as net from ah group by 1), ac as (select decision, asset_class, sum(base_gross) as class_gross from ah group by 1, 2),
  a0 as (select aq.decision, strategy, family, aq.symbol, aq.asset_class, requested::double as requested, coalesce(position, 0) as position, coalesce(reserved, 0) as reserved, coalesce(position + reserved, 0) as base, coalesce(base_gross, 0) as base_gross, coalesce(class_gross, 0) as class_gross, coalesce(gross, 0) as gross, coalesce(net, 0) as net, requested::double as v, []::varchar[] as why
    from aq left join ah on ah.decision = aq.decision and ah.symbol = aq.symbol left join ac on ac.decision = aq.decision and ac.asset_class = aq.asset_class left join aw on aw.decision = aq.decision),
  a1 as (select * exclude (v, why), case when abs(v) > 2000 then sign(v) * 2000 else v end as v, case when abs(v) > 2000 then list_append(why, 'STRATEGY_BUDGET_REDUCED') else why end as why from a0),
  a2 as (select *, sum(abs(v)) over (partition by decision, family) as fam from a1), {_step("a2", "a3", _fit("fam", "9000"), "FAMILY_BUDGET_REDUCED")}, {_risky("a3", "a4")},
  {_step("a4", "a5", _fit("rk", "4500 - base_gross"), "INSTRUMENT_BUDGET_REDUCED").replace("exclude (", "exclude (ch, rk, ")}, {_risky("a5", "a6")}, a7 as (select *, {_lead} as lr from a6), a8 as (select *, sum(lr) over (partition by decision, asset_class) as used from a7),
  {_step("a8", "a9", _fit("used", "case asset_class when 'forex' then 6000 when 'equity' then 7000 else 0 end - class_gross"), "ASSET_CLASS_BUDGET_REDUCED").replace("exclude (", "exclude (ch, rk, lr, used, ")}, {_risky("a9", "b0_")}, b1 as (select *, {_lead} as lr from b0_),
  b2 as (select *, sum(lr) over w as nw, sum(v) over w as dl, sum(abs(v)) over w as tv from b1 window w as (partition by decision)), b3 as (select *, greatest(abs(net + dl) - abs(net), 0) as grow from b2),
  b4 as (select *, {_fit("nw", "16000 - gross")} as f1, {_fit("grow", "4000 - abs(net)")} as f2, {_fit("nw", "12000")} as f3, {_fit("tv", "13000")} as f4 from b3),
  b5 as (select * exclude (why, ch, rk), list_concat(why, list_filter([case when f1 < 1 then 'GROSS_BUDGET_REDUCED' end, case when f2 < 1 then 'NET_BUDGET_REDUCED' end, case when f3 < 1 then 'INCREMENTAL_BUDGET_REDUCED' end, case when f4 < 1 then 'TURNOVER_BUDGET_REDUCED' end], lambda x: x is not null)) as why from b4),
  {_step("b5", "b6", "least(f1, f2, f3, f4)", "PORTFOLIO_BUDGET_REDUCED")}, {_risky("b6", "b7")},
  b8 as (select *, case when sum(abs(v)) over w = sum(abs(requested)) over w and sum(abs(v)) over w > 0 then 'approved' when sum(abs(v)) over w > 0 then 'reduced' else 'rejected' end as status, case when v * base < 0 then least(abs(v), abs(base)) else 0 end as cutback from b7 window w as (partition by decision))"""
ALLOCATED = ALLOCATED.replace(f"select {ASKED}::double as requested_, * from orders", f"select {ASKED} from orders")
query("allocate_portfolio", f"with {ALLOCATED} select decision, strategy, symbol, requested, v + 0 as proposed, cutback::double as reduction, (abs(v) - cutback)::double as new_risk, array_to_string(list_sort(list_distinct(why)), ',') as reasons, status from b8")(
    lambda s, d: portfolio(s, d)[0].withColumns({"proposed": F.col("proposed") + 0, "reasons": F.array_join("reasons", ",")})
)
query(
    "allocation_targets",
    f"""with {ALLOCATED} select decision, symbol, any_value(position) as position, any_value(reserved) as reserved, any_value(base) + any_value(ch) as target, any_value(ch) + 0 as delta, any_value(rk)::double as new_risk, any_value(abs(ch) - rk)::double as reduction,
    array_to_string(list_sort(list_distinct(list_concat(flatten(list(why)), case when any_value(base_gross) > 4500 then ['EXISTING_EXPOSURE_OVER_BUDGET'] else [] end))), ',') as reasons, any_value(status) as status from b8 group by decision, symbol""",
)(lambda s, d: portfolio(s, d)[1].withColumns({"delta": F.col("delta") + 0, "reasons": F.array_join("reasons", ",")}))

# Research


def day_returns(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("t")
    rows = S.day_closes(s, d).select("symbol", (F.log("close") - F.log(F.lag("close").over(w))).alias("ret"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    return rows.where("i > 0").select("symbol", "i", (F.tanh("ret") / 10).alias("ret"))


REPS, BLOCK, SEED = 200, 5, 17
TAIL = (1 - 0.95) / 2  # in doubles a little over 0.025, which moves the rank by one
_draw = lambda x, k: x if k == 0 else f"(({_draw(x, k - 1)}) * {R.LEHMER} % {R.PRIME})"
SAMPLED = f"""with {DAYS}, ls as (select symbol, tanh(ln(close) - ln(lag(close) over w)) / 10 as ret, row_number() over w - 1 as i from days window w as (partition by symbol order by t)), sr as (select symbol, i, ret from ls where i > 0),
  nn as (select symbol, count(*) as n, avg(ret) as m from sr group by 1), rp as (select symbol, n, unnest(range(0, {REPS})) as rep from nn where n >= {BLOCK}), sl as (select symbol, n, rep, unnest(range(0, cast(ceil(n / {BLOCK}.0) as bigint))) as slot from rp),
  st as (select *, {_draw(f"((rep * 1000003 + slot * 7919 + {SEED}) % {R.PRIME})", 3)} % (n - {BLOCK} + 1) as a from sl), ob as (select symbol, n, rep, a + 1 + unnest(range(0, least({BLOCK}, n - slot * {BLOCK}))) as i from st)"""
query(
    "block_bootstrap_mean",
    f"""{SAMPLED}, mn as (select symbol, rep, avg(ret) as v from ob join sr using (symbol, i) group by 1, 2), rk as (select *, row_number() over (partition by symbol order by v) as r from mn),
    q as (select symbol, max(case when r = ceil({REPS} * {TAIL!r}::double) then v end) as lower, max(case when r = ceil({REPS} * {1 - TAIL!r}::double) then v end) as upper, avg(case when v <= 0 then 1.0 else 0.0 end) as p_nonpositive from rk group by 1)
    select symbol, n as observations, round(m, 8) as mean, round(lower, 8) as lower, round(upper, 8) as upper, round(p_nonpositive, 6) as p_nonpositive from nn left join q using (symbol)""",
)(lambda s, d: R.block_bootstrap_mean(day_returns(s, d), REPS, BLOCK, SEED).withColumns({c: F.round(c, 8) for c in ("mean", "lower", "upper", "p_nonpositive")}))
query(
    "block_bootstrap_paths",
    f"""{SAMPLED}, mn as (select symbol, rep, exp(sum(ln(1 + ret))) - 1 as v from ob join sr using (symbol, i) group by 1, 2), rk as (select *, row_number() over (partition by symbol order by v) as r from mn)
    select symbol, {", ".join(f"round(max(case when r = ceil({REPS} * {p}) then v end), 6) as {n}" for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)))}, round(avg(case when v <= 0 then 1.0 else 0.0 end), 6) as p_loss from rk group by 1""",
)(lambda s, d: r6(R.block_bootstrap_paths(day_returns(s, d), REPS, BLOCK, SEED), "p05", "p50", "p95", "p_loss"))
DAY = 86_400


PLAN = {"train": 7 * DAY, "forward": 3 * DAY, "folds": 5, "rolling": 7 * DAY, "validation": DAY, "purge": 7200, "embargo": 3600}


def schedules(s: SparkSession, d: str) -> DataFrame:
    ends = bars(s, d).groupBy("symbol").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    # One series has a locked period that its plan would enter: the plan is refused.
    return ends.select("symbol", R.fold_schedule(F.col("a"), oos=F.when(F.col("symbol") == "view", F.col("a") + 20 * DAY).otherwise(F.col("z") - DAY), **PLAN).alias("folds"))


FOLDS = f"""{HB}, ends as (select symbol, min(bar) as a, max(bar) as z from bars group by 1), fx as (select symbol, a, case when symbol = 'view' then a + {20 * DAY} else z - {DAY} end as oos, unnest(range(0, 5)) as fold from ends),
  folds as (select symbol, fold, a + fold * {3 * DAY + 3600} as train_start, a + {7 * DAY} + fold * {3 * DAY + 3600} as train_end, a + {8 * DAY} + fold * {3 * DAY + 3600} as validation_end, a + {8 * DAY + 7200} + fold * {3 * DAY + 3600} as test_start, a + {11 * DAY + 7200} + fold * {3 * DAY + 3600} as test_end
    from fx where a + {11 * DAY + 7200} + 4 * {3 * DAY + 3600} <= oos)"""
query("fold_schedule", f"{FOLDS} select * from folds")(lambda s, d: schedules(s, d).select("symbol", F.inline("folds")))
query(
    "fold_findings",
    f"""{FOLDS}, o as (select symbol, fold, test_start - case when fold = 2 then 400000 when fold = 3 then 90000 else 0 end as test_start, test_end, a as period_start, z as period_end from folds join ends using (symbol)),
    l as (select *, lag(test_end) over w as b, lag(test_start) over w as e from o window w as (partition by symbol order by fold)), c as (select symbol, fold, case when test_start < e then 'out_of_order' when test_start < b then 'overlaps' when test_start < period_start or test_end > period_end - 1400000 then 'outside_period' end as code from l) select * from c where code is not null""".replace("a as period_start, z as period_end", "a as period_start, z as period_end"),
)(
    lambda s, d: R.fold_findings(
        schedules(s, d).select("symbol", F.inline("folds")).withColumn("test_start", F.col("test_start") - F.when(F.col("fold") == 2, 400_000).when(F.col("fold") == 3, 90_000).otherwise(0)).join(
            bars(s, d).groupBy("symbol").agg(F.min("bar").alias("period_start"), (F.max("bar") - 1_400_000).alias("period_end")), "symbol"
        )
    )
)
ASSIGNED = f"{FOLDS}, asg as (select symbol, bar, close, fold, case when bar < train_end then 'train' when bar < validation_end then 'validation' else 'test' end as role from bars join folds using (symbol) where bar >= train_start and bar < test_end and not (bar >= validation_end and bar < test_start))"
query("assign_folds", f"{ASSIGNED} select symbol, bar, fold, role from asg")(lambda s, d: R.assign_folds(bars(s, d), schedules(s, d)))
query(
    "walk_forward_summary",
    f"""{ASSIGNED}, t as (select symbol, fold, arg_max(close, bar) / arg_min(close, bar) - 1 as ret from asg where role = 'test' group by 1, 2)
    select symbol, count(*) as folds, round(avg(ret), 6) as mean_return, round(min(ret), 6) as worst_return, count(*) filter (ret <= 0) as losing from t group by 1""",
)(
    lambda s, d: r6(
        R.walk_forward_summary(
            R.assign_folds(bars(s, d), schedules(s, d)).where("role = 'test'").join(bars(s, d).select("symbol", "bar", "close"), ["symbol", "bar"]).groupBy("symbol", "fold").agg(F.min_by("close", "bar").alias("first_close"), F.max_by("close", "bar").alias("last_close"))
        ), "mean_return", "worst_return",
    )
)
query(
    "lineage_nodes",
    "select 'O' || l_orderkey as node_id, case min(case l_linestatus when 'F' then 1 else 2 end) when 1 then 'F' else 'O' end as status, count(distinct l_returnflag) > 1 as conflict from lineitem group by 1",
)(lambda s, d: R.lineage_nodes(S.table(s, d, "lineitem").selectExpr("concat('O', l_orderkey) as node_id", "l_linestatus as status", "l_returnflag as hash"), ["F", "O"]))
query(
    "order_lifecycle_audit",
    """with a as (select l_orderkey as id, l_linenumber as seq, l_returnflag as status, lag(l_returnflag) over w as before, l_linenumber - coalesce(lag(l_linenumber) over w, 0) <> 1 as gap from lineitem window w as (partition by l_orderkey order by l_linenumber, l_returnflag)),
    b as (select id, seq, before, status, case when gap then 'revision_gap' when before is null and status <> 'N' then 'bad_start' when before || status not in ('NN', 'NA', 'AR') then 'bad_transition' end as code from a) select * from b where code is not null""",
)(lambda s, d: R.lifecycle_audit(S.table(s, d, "lineitem").selectExpr("l_orderkey as id", "l_linenumber as seq", "l_returnflag as status"), [("N", "N"), ("N", "A"), ("A", "R")], "N"))
query(
    "revocation_as_of",
    f"""with {FILLS}, rv as (select c_custkey as target, 757382400 + c_custkey * 100000 as revoked_at from customer where c_custkey % 3 = 0)
    select fill_id as id, account as target, revoked_at is not null as revoked_now, coalesce(revoked_at <= t, false) as revoked_then from fills left join rv on account = target""",
)(lambda s, d: R.revocation_as_of(S.fills(s, d).selectExpr("fill_id as id", "account as target", "t as at"), S.table(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey as target", "757382400 + c_custkey * 100000 as revoked_at")))
query(
    "verify_artifacts",
    """select coalesce(m.k, f.k) as artifact, case when m.k is null then 'unlisted' when f.k is null then 'missing' when f.k % 11 = 0 then 'size_mismatch' when f.k % 13 = 0 then 'hash_mismatch' else 'verified' end as status
    from (select p_partkey as k from part where p_partkey % 7 <> 0) m full join (select p_partkey as k from part where p_partkey % 5 <> 0) f on m.k = f.k where m.k is not null or f.k is not null""",
)(
    lambda s, d: R.verify_artifacts(
        S.table(s, d, "part").where("p_partkey % 7 <> 0").selectExpr("p_partkey as artifact", "sha2(string(p_partkey), 256) as sha256", "length(string(p_partkey)) as byte_size"),
        S.table(s, d, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey as artifact", "sha2(if(p_partkey % 13 = 0, 'x', string(p_partkey)), 256) as sha256", "length(string(p_partkey)) + if(p_partkey % 11 = 0, 1, 0) as byte_size"),
    )
)
query("registry_conflicts", "select o_custkey as id, count(distinct o_orderpriority) as versions, count(*) as n from orders group by 1 having count(distinct o_orderpriority) > 1")(
    lambda s, d: R.registry_conflicts(S.table(s, d, "orders").selectExpr("o_custkey as id", "o_orderpriority as hash"))
)

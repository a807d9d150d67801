"""Rule operators over decision tables: regimes, strategy signals, evidence, promotion, risk, sizing and allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import commission, finite, session_open


def regime_states(rows: DataFrame, separation: float = 0.001, low: float = 0.25, high: float = 0.75, most_spread: float = 0.002) -> DataFrame:
    """symbol, bar, data_session, trend, volatility, liquidity of rows (symbol, bar, close, spread, fast, slow, percentile, bad; asset_class and volume if equities are among them, which need a volume).

    bad: an error is known for the bar. A null feature is warm-up; a closed session, an error or an unusable feature
    makes trend and volatility unavailable and liquidity unknown.
    """
    fast, slow, pct = (F.col(c) for c in ("fast", "slow", "percentile"))
    warm = fast.isNull() | slow.isNull() | pct.isNull()
    unusable = F.isnan(fast) | F.isnan(slow) | (slow == 0) | ~pct.between(0, 1)
    session = F.when(~session_open(F.col("bar")), "inactive").when(F.col("bad"), "data_unavailable").when(warm, "warmup").when(unusable, "data_unavailable").otherwise("active")
    strength = (fast - slow) / F.abs(slow)
    trend = F.when(strength > separation, "trending_up").when(strength < -separation, "trending_down").otherwise("neutral")
    vol = F.when(pct < low, "low").when(pct > high, "high").otherwise("normal")
    lacks = (F.col("asset_class") != "forex") & ~F.coalesce(F.col("volume") > 0, F.lit(False)) if "asset_class" in rows.columns else F.lit(False)
    liquidity = F.when(F.col("spread").isNull() | (F.col("close") <= 0) | lacks, "unknown").when(F.col("spread") / F.col("close") > most_spread, "stressed").otherwise("normal")
    active = F.col("data_session") == "active"
    return rows.withColumn("data_session", session).select(
        "symbol", "bar", "data_session", F.when(active, trend).otherwise("unavailable").alias("trend"), F.when(active, vol).otherwise("unavailable").alias("volatility"),
        F.when(active, liquidity).otherwise("unknown").alias("liquidity"),
    )


DIMENSIONS = ["data_session", "trend", "volatility", "liquidity"]


def by_dimension(states: DataFrame) -> DataFrame:
    return states.unpivot(["symbol", "bar"], DIMENSIONS, "dimension", "state")


def regime_runs(states: DataFrame, width: int) -> DataFrame:
    """Runs of equal states: start, end, observations and seconds (one bar more than end - start)."""
    w = Window.partitionBy("symbol", "dimension").orderBy("bar")
    change = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    runs = by_dimension(states).withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return runs.groupBy("symbol", "dimension", "run", "state").agg(
        F.min("bar").alias("start"), F.max("bar").alias("end"), F.count("*").alias("n"), (F.max("bar") - F.min("bar") + width).alias("seconds")
    ).drop("run")


def regime_shares(states: DataFrame) -> DataFrame:
    """Share of each state, and transitions of its dimension a step."""
    w = Window.partitionBy("symbol", "dimension")
    flip = F.lag("state").over(w.orderBy("bar")) != F.col("state")
    rows = by_dimension(states).withColumn("flip", F.coalesce(flip.cast("int"), F.lit(0)))
    sums = rows.groupBy("symbol", "dimension", "state").agg(F.count("*").alias("n"), F.sum("flip").alias("flips"))
    total, flips = F.sum("n").over(w), F.sum("flips").over(w)
    return sums.select("symbol", "dimension", "state", "n", (F.col("n") / total).alias("share"), F.when(total > 1, flips / (total - 1)).otherwise(0.0).alias("transition_frequency"))


def signal_trend(rows: DataFrame, threshold: float) -> DataFrame:
    """Direction and reason from a fast and a slow average (null while warming up)."""
    fast, slow = F.col("fast"), F.col("slow")
    strength = F.when(slow == 0, 0.0).otherwise((fast - slow) / F.abs(slow))
    weak = F.abs(strength) < threshold
    direction = F.when(fast.isNull() | slow.isNull(), "hold").when(weak, "flat").when(fast > slow, "long").when(fast < slow, "short").otherwise("flat")
    reason = F.when(fast.isNull() | slow.isNull(), "warmup").when(weak, "trend_below_threshold").when(fast > slow, "fast_ema_above_slow_ema").when(fast < slow, "fast_ema_below_slow_ema").otherwise("ema_neutral")
    return rows.select("symbol", "bar", direction.alias("direction"), reason.alias("reason"), strength.alias("score"))


def target_position_delta(signals: DataFrame, size: float) -> DataFrame:
    """Orders of one strategy (symbol, bar, direction): long and short aim at +size and -size, flat at 0, hold keeps."""
    w = Window.partitionBy("symbol").orderBy("bar")
    aim = F.when(F.col("direction") == "long", size).when(F.col("direction") == "short", -size).when(F.col("direction") == "flat", 0.0)
    rows = signals.withColumn("aim", aim)
    now = F.coalesce(F.last("aim", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    rows = rows.withColumn("target", now).withColumn("delta", F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0.0)))
    return rows.where("delta <> 0").select("symbol", "bar", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("quantity"))


NUMBERS = ("net_expectancy", "net_oos_return", "benchmark_excess_return")
GOOD = ("cost_survives", "slippage_survives", "parameter_robust", "walk_forward_consistent", "multiple_testing_supported")
BAD = ("regime_concentrated", "outlier_dependent")


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])


def classify_evidence(rows: DataFrame) -> DataFrame:
    """Adds decision: invalid, conditional, kill or pass. A missing number or flag never passes and never kills."""
    c = F.col
    known = all_of([c(n).isNotNull() for n in NUMBERS])
    loses = reduce(lambda a, b: a | b, [c(n) <= 0 for n in NUMBERS])
    fragile = ~F.coalesce(c("cost_survives"), F.lit(True)) | ~F.coalesce(c("slippage_survives"), F.lit(True))
    passes = all_of([c(n) > 0 for n in NUMBERS] + [c(n) for n in GOOD] + [~c(n) for n in BAD])
    valid = all_of([c("data_available"), c("data_integrity"), c("locked_oos_pristine")])
    decision = F.when(~valid, "invalid").when(~c("sample_adequate"), "conditional").when((known & loses) | fragile, "kill").when(passes, "pass").otherwise("conditional")
    return rows.withColumn("decision", decision)


def decision_matrix(rows: DataFrame, key: str) -> DataFrame:
    """Long form of the evidence: one row a field, null as UNAVAILABLE."""
    fields = [*NUMBERS, *GOOD, *BAD, "sample_adequate"]
    wide = rows.select(key, *[F.coalesce(F.col(f).cast("string"), F.lit("UNAVAILABLE")).alias(f) for f in fields], (F.col("data_integrity") & F.col("locked_oos_pristine")).cast("string").alias("integrity"))
    return wide.unpivot([key], [*fields, "integrity"], "field", "value")


def evaluate_promotion(rows: DataFrame, least_trades: int, most_p: float | None, severe: list[str]) -> DataFrame:
    """Adds promotion: reject, hold or promotion_review. Columns: dataset_qualified, oos_pristine, risk_compatible, warnings
    (array), trades, five nullable tests, adjusted_p."""
    tests = [F.col(n) for n in ("walk_forward_positive", "oos_positive", "robust", "parameter_stable", "regime_stable")]
    no = reduce(lambda a, b: a | b, [F.coalesce(~t, F.lit(False)) for t in tests])
    unknown = reduce(lambda a, b: a | b, [t.isNull() for t in tests])
    bad = ~F.col("dataset_qualified") | ~F.col("oos_pristine") | ~F.col("risk_compatible") | F.arrays_overlap("warnings", F.array(*map(F.lit, severe)).cast("array<string>"))
    told = F.when(bad, "reject").when(F.col("trades") < least_trades, "hold").when(no, "reject").when(unknown, "hold")
    if most_p is not None:
        told = told.when(F.col("adjusted_p").isNull(), "hold").when(F.col("adjusted_p") > most_p, "reject")
    return rows.withColumn("promotion", told.otherwise("promotion_review"))


def temporal(time: Column, now: Column, age: int, stale: str) -> Column:
    """Reason why an input's time is not usable, or null."""
    return F.when(time.isNull() | (time > now), "FUTURE_DATED_INPUT").when(now - time > age, stale)


def risk_checks(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds failed (array of "check:REASON" in order), approved, action and the authorized new and reduction notional.

    Columns: now, intent_time, direction, status, duplicate; health, health_time; market_time, same_symbol, market_status,
    bid, ask; regime_time, session, trend, volatility, liquidity; portfolio_time, mark_time, held, equity, cash, margin,
    daily_pnl, high_water, locks, risk_day, open_positions, pending, gross, net, long, short, instrument, asset_class.
    A null market_time, session, portfolio_time or health is a missing input: its further checks are left out."""
    c, lit = F.col, F.lit
    now, up = c("now"), c("direction") == "long"
    yes = lit(True)
    # Names of checks and reasons (fixed values), in the order in which they are made.
    tests: list[tuple[str, Column, Column]] = []  # (check, applies, reason or null)

    def add(check: str, applies: Column, reason: Column) -> None:
        tests.append((check, applies, reason))

    def unless(ok: Column, reason: str) -> Column:
        return F.when(~F.coalesce(ok, lit(False)), reason)

    add("kill_switch", yes, unless(lit(not limits.get("kill_switch", 0)), "KILL_SWITCH_ACTIVE"))
    add("intent_timestamp", yes, F.when(c("intent_time") > now, "FUTURE_DATED_INPUT").when(c("intent_time") != now, "INTENT_NOT_ACTIONABLE"))
    add("intent", yes, unless(c("direction").isin("long", "short") & (c("status") == "directional"), "INTENT_NOT_ACTIONABLE"))
    health = c("health").isNotNull()
    add("system_health_freshness", health, temporal(c("health_time"), now, limits["health_age"], "SYSTEM_HEALTH_STALE"))
    add("system_health", yes, unless(c("health") == "healthy", "SYSTEM_UNHEALTHY"))
    market = c("market_time").isNotNull()
    add("market_data", yes, unless(market, "DATA_UNAVAILABLE"))
    add("market_scope", market, unless(c("same_symbol"), "DATA_INVALID"))
    add("market_freshness", market, temporal(c("market_time"), now, limits["market_age"], "DATA_STALE"))
    status = c("market_status")
    add("market_data_status", market, F.when(status == "stale", "DATA_STALE").when(status == "unavailable", "DATA_UNAVAILABLE").when(status != "valid", "DATA_INVALID"))
    priced = F.coalesce(finite(c("bid")) & finite(c("ask")) & (c("bid") > 0) & (c("ask") > 0), lit(False))
    add("market_price", market, unless(priced, "PRICE_INVALID"))
    add("market_crossed", market & priced, unless(c("bid") <= c("ask"), "CROSSED_MARKET"))
    middle = (c("bid") + c("ask")) / 2
    add("spread", market & priced & (c("bid") <= c("ask")), unless(c("ask") - c("bid") <= limits["spread"] * middle, "SPREAD_TOO_WIDE"))
    regime = F.when(c("session").isNull(), "REGIME_UNAVAILABLE").when(c("regime_time") > now, "FUTURE_DATED_INPUT").when(c("regime_time") != now, "REGIME_UNAVAILABLE").when(c("session") != "active", "MARKET_INACTIVE")
    regime = regime.when((c("trend") == "unavailable") | (c("volatility") == "unavailable") | (c("liquidity") == "unknown"), "REGIME_UNAVAILABLE").when(c("liquidity") == "stressed", "LIQUIDITY_STRESSED")
    add("regime", yes, regime)
    book = c("portfolio_time").isNotNull()
    add("portfolio", yes, unless(book, "PORTFOLIO_INVALID"))
    add("portfolio_freshness", book, temporal(c("portfolio_time"), now, limits["snapshot_age"], "STALE_RISK_SNAPSHOT"))
    add("position_mark_freshness", book, unless((c("held") == 0) | ((c("mark_time") <= c("portfolio_time")) & (now - c("mark_time") <= limits["snapshot_age"])), "STALE_RISK_SNAPSHOT"))
    numbers = F.coalesce(reduce(lambda a, b: a & b, [finite(c(n)) for n in ("equity", "cash", "margin", "daily_pnl", "high_water")]) & (c("equity") > 0), lit(False))
    add("portfolio_numeric", book, unless(numbers, "PORTFOLIO_INVALID"))
    full = book & numbers
    add("duplicate_intent", full, unless(~c("duplicate"), "DUPLICATE_INTENT"))
    add("risk_locks", full, F.when(c("locks").contains("drawdown"), "DRAWDOWN_LOCKED").when(c("locks") != "", "RISK_LOCK_ACTIVE"))
    add("risk_day", full, unless(c("risk_day") == F.floor(now / 86_400), "RISK_DAY_MISMATCH"))
    add("capital", full, unless(c("cash") >= limits["cash"], "INSUFFICIENT_CAPITAL"))
    add("margin", full, unless(c("margin") >= limits["margin"], "INSUFFICIENT_MARGIN"))
    add("leverage", full, unless(c("gross") <= limits["leverage"] * c("equity"), "MAX_LEVERAGE_EXCEEDED"))
    add("daily_loss", full, unless(c("daily_pnl") > -limits["daily_loss"], "DAILY_LOSS_LIMIT"))
    add("drawdown", full, unless(c("high_water") - c("equity") < limits["drawdown"], "DRAWDOWN_LIMIT"))
    reduces = F.when(up, c("instrument") < 0).otherwise(c("instrument") > 0)
    grows = full & ~reduces
    add("position_count", grows, unless(c("open_positions") < limits["positions"], "MAX_POSITIONS_EXCEEDED"))
    add("pending_intents", grows, unless(c("pending") < limits["pending"], "MAX_PENDING_INTENTS_EXCEEDED"))
    left = {
        "gross_exposure": (limits["gross"] - c("gross"), lit("MAX_GROSS_EXPOSURE_EXCEEDED")),
        "net_exposure": (F.when(up, limits["net"] - c("net")).otherwise(limits["net"] + c("net")), lit("MAX_NET_EXPOSURE_EXCEEDED")),
        "directional_exposure": (F.when(up, limits["long"] - c("long")).otherwise(limits["short"] - c("short")), F.when(up, "MAX_LONG_EXPOSURE_EXCEEDED").otherwise("MAX_SHORT_EXPOSURE_EXCEEDED")),
        "instrument_exposure": (limits["instrument"] - F.abs(c("instrument")), lit("MAX_INSTRUMENT_EXPOSURE_EXCEEDED")),
        "asset_class_exposure": (limits["asset_class"] - c("asset_class"), lit("MAX_ASSET_CLASS_EXPOSURE_EXCEEDED")),
        "leverage_headroom": (limits["leverage"] * c("equity") - c("gross"), lit("MAX_LEVERAGE_EXCEEDED")),
    }
    for check, (remaining, reason) in left.items():
        add(check, grows, F.when(~F.coalesce(remaining > 0, lit(False)), reason))
    add("reduction_scope", full & reduces, unless(F.abs(c("instrument")) > 0, "INTENT_NOT_ACTIONABLE"))
    each = F.array(*[F.when(F.coalesce(applies, lit(False)) & reason.isNotNull(), F.concat(lit(f"{check}:"), reason)) for check, applies, reason in tests])
    rows = rows.withColumn("failed", F.array_compact(each)).withColumn("approved", F.size("failed") == 0)
    new = F.least(lit(limits["trade"]), *[v for v, _ in left.values()])
    return rows.withColumns({
        "action": F.when(reduces, "reduction_only").otherwise("new_or_increase"), "max_new": F.when(c("approved") & ~reduces, new).otherwise(0.0), "max_reduction": F.when(c("approved") & reduces, F.abs(c("instrument"))).otherwise(0.0),
    })


def fuse_signals(signals: DataFrame, states: DataFrame, rules: DataFrame, votes: int = 2, margin: int = 1) -> DataFrame:
    """One intent a decision (symbol, bar) of signals (symbol, bar, strategy, source_id, direction): direction, status, votes, and each signal's eligibility as "strategy:state".

    A decision needs a usable regime state. A source twice is a duplicate (the first strategy in order stays), an
    unavailable direction is left out, and a strategy with rules (strategy, direction, trend, volatility, liquidity; null is
    any) needs one that fits its direction and the regime. Then the majority of long and short decides, with least votes and margin.
    Rules are a small table."""
    c = F.col
    s = states.withColumn("usable", (c("data_session") == "active") & (c("trend") != "unavailable") & (c("volatility") != "unavailable") & (c("liquidity") != "unknown"))
    rows = signals.join(s, ["symbol", "bar"], "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    w = Window.partitionBy("symbol", "bar", "source_id").orderBy("strategy", "direction")
    rows = rows.withColumn("twice", F.row_number().over(w) > 1)
    r = F.broadcast(rules.groupBy("strategy").agg(F.collect_list(F.struct("direction", "trend", "volatility", "liquidity")).alias("rules")))
    fits = lambda x, n: x[n].isNull() | (x[n] == c(n))
    allowed = c("rules").isNull() | F.exists("rules", lambda x: fits(x, "direction") & fits(x, "trend") & fits(x, "volatility") & fits(x, "liquidity"))
    state = F.when(~c("usable"), "regime_unavailable").when(c("twice"), "duplicate").when(c("direction") == "unavailable", "unavailable").when(~allowed, "regime_incompatible").otherwise("eligible")
    rows = rows.join(r, "strategy", "left").withColumn("state", state)
    n = {d: F.count_if((c("state") == "eligible") & (c("direction") == d)).alias(f"n_{d}") for d in ("long", "short", "flat", "hold")}
    told = rows.groupBy("symbol", "bar").agg(
        *n.values(), F.max("usable").alias("usable"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "strategy", "direction", "state"))), ",").alias("signals")
    )
    eligible = c("n_long") + c("n_short") + c("n_flat") + c("n_hold")
    won = lambda a, b: (c(a) >= votes) & (c(a) - c(b) >= margin)
    direction = F.when(~c("usable") | (eligible == 0), "unavailable").when(won("n_long", "n_short"), "long").when(won("n_short", "n_long"), "short").otherwise("hold")
    status = F.when(~c("usable"), "regime_unavailable").when(eligible == 0, "all_signals_unavailable").when(c("n_long") + c("n_short") == 0, "no_directional_signal")
    status = status.when(won("n_long", "n_short") | won("n_short", "n_long"), "directional").otherwise("no_consensus")
    return told.select("symbol", "bar", direction.alias("direction"), status.alias("status"), "n_long", "n_short", "n_flat", "n_hold", "signals")


def signal_breakout(rows: DataFrame, equity: bool) -> DataFrame:
    """Direction, reason and score of a close against the extremes of the bars before it (high_before, low_before; null while warming up). Equities are long only."""
    high, low, close = F.col("high_before"), F.col("low_before"), F.col("close")
    warm = high.isNull() | low.isNull()
    below = F.lit("flat" if equity else "short")
    direction = F.when(warm, "hold").when(close > high, "long").when(close < low, below).otherwise("hold" if equity else "flat")
    reason = F.when(warm, "warmup").when(close > high, "close_above_previous_high").when(close < low, "close_below_previous_low").otherwise("inside_previous_range")
    score = F.when(close > high, F.try_divide(close, high) - 1).when(close < low, F.try_divide(close, low) - 1).otherwise(0.0)
    return rows.select("symbol", "bar", direction.alias("direction"), reason.alias("reason"), F.when(~warm, score).alias("score"))


def signal_momentum(rows: DataFrame, least: float) -> DataFrame:
    """Long while the rolling return (ret; null while warming up) is over least, else flat."""
    ret = F.col("ret")
    direction = F.when(ret.isNull(), "hold").when(ret > least, "long").otherwise("flat")
    reason = F.when(ret.isNull(), "warmup").when(ret > least, "momentum_above_threshold").otherwise("momentum_not_above_threshold")
    return rows.select("symbol", "bar", direction.alias("direction"), reason.alias("reason"), ret.alias("score"))


def allocation_requests(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """signals (id, symbol, bar, direction, side, quantity) whose side fits the direction, with requested notional at the bar's ask (long) or bid (short)."""
    fits = ((F.col("direction") == "long") & (F.col("side") == "buy")) | ((F.col("direction") == "short") & (F.col("side") == "sell"))
    rows = signals.where(fits).join(bars.select("symbol", "bar", "bid", "ask"), ["symbol", "bar"])
    return rows.select("id", "symbol", "bar", "direction", (F.col("quantity") * F.when(F.col("direction") == "long", F.col("ask")).otherwise(F.col("bid"))).alias("requested"))


def bound_authorization(decisions: DataFrame, allocated: DataFrame) -> DataFrame:
    """decisions (id, action, max_new, max_reduction) with the side of their action capped by the allocation (id, amount); none means nothing."""
    rows = decisions.join(allocated, "id", "left")
    amount = F.greatest(F.coalesce("amount", F.lit(0.0)), F.lit(0.0))
    grows = F.col("action") == "new_or_increase"
    return rows.withColumns({"max_new": F.when(grows, F.least("max_new", amount)).otherwise(F.lit(0.0)), "max_reduction": F.when(grows, F.lit(0.0)).otherwise(F.least("max_reduction", amount))}).drop("amount")


def size_orders(rows: DataFrame, increment: float, least: float, per_unit: float, rate: float, floor: float) -> DataFrame:
    """Adds quantity: the largest number of increments whose all-in cost stays within authorized and whose notional stays
    within available (both columns) at price; null below the least quantity. The cost is monotonic, so the bound for each
    branch of the commission is exact and the smaller one holds."""
    c = F.col
    steps = lambda q: F.floor(q / increment + 1e-9)
    cash = steps(F.least("authorized", "available") / c("price"))
    with_rate = steps(c("authorized") / (c("price") * (1 + rate) + per_unit))
    with_floor = steps((c("authorized") - floor) / c("price"))
    n = F.greatest(F.least(cash, with_rate, with_floor), F.lit(0))
    quantity = n * F.lit(increment)
    rows = rows.withColumn("quantity", F.when(quantity >= least, quantity))
    return rows.withColumn("all_in", c("quantity") * c("price") + commission(c("quantity"), c("price"), per_unit, rate, floor))


def collapse_signals(signals: DataFrame, key: list[str]) -> DataFrame:
    """One request for each key: largest long less largest short notional; conflict where both occur."""
    most = lambda d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("notional"))), F.lit(0.0))
    rows = signals.groupBy(*key).agg(most("long").alias("up"), most("short").alias("down"))
    return rows.select(*key, (F.col("up") - F.col("down")).alias("requested"), ((F.col("up") > 0) & (F.col("down") > 0)).alias("conflict"))


def bounded(value: Column, increment: float) -> Column:
    """Rounded to the increment towards zero."""
    return F.signum(value) * F.floor(F.abs(value) / increment + 1e-9) * increment


def allocate(requests: DataFrame, budgets: dict[str, float], increment: float) -> DataFrame:
    """Requests (decision, strategy, family, symbol, requested, base) cut to budgets in order: strategy, family (pro rata),
    instrument (new risk beyond the base exposure), then one factor for gross, net, new risk and turnover of the decision."""
    zero = F.lit(0.0)

    def new_risk(base: Column, delta: Column) -> Column:
        return F.abs(delta) - F.when(delta * base < 0, F.least(F.abs(delta), F.abs(base))).otherwise(0.0)

    def scaled(df: DataFrame, factor: Column) -> DataFrame:
        return df.withColumn("factor", factor).withColumn("value", F.when(F.col("factor") < 1, bounded(F.col("value") * F.col("factor"), increment)).otherwise(F.col("value")))

    rows = requests.withColumn("value", F.when(F.abs("requested") > budgets["strategy"], bounded(F.signum("requested") * budgets["strategy"], increment)).otherwise(F.col("requested")))
    total = F.sum(F.abs("value")).over(Window.partitionBy("decision", "family"))
    rows = scaled(rows, F.when(total > budgets["family"], F.lit(budgets["family"]) / total).otherwise(1.0))
    wi = Window.partitionBy("decision", "symbol")
    rows = rows.withColumn("risk", new_risk(F.col("base"), F.sum("value").over(wi)))
    room = F.greatest(F.lit(budgets["instrument"]) - F.abs("base"), zero)
    rows = scaled(rows, F.when(F.col("risk") > room, room / F.col("risk")).otherwise(1.0))
    # One line a symbol carries its base and new risk into the decision's sums.
    rows = rows.withColumn("risk", new_risk(F.col("base"), F.sum("value").over(wi))).withColumn("lead", F.row_number().over(wi.orderBy("strategy")) == 1)
    wd = Window.partitionBy("decision")
    once = lambda x: F.sum(F.when(F.col("lead"), x).otherwise(0.0)).over(wd)
    rows = rows.withColumns({"new": once(F.col("risk")), "gross": once(F.abs("base")), "net": once(F.col("base")), "delta": F.sum("value").over(wd), "turnover": F.sum(F.abs("value")).over(wd)})
    grow = F.greatest(F.abs(F.col("net") + F.col("delta")) - F.abs("net"), zero)

    def part(used: Column, room: Column) -> Column:
        return F.when((used > 0) & (used > F.greatest(room, zero)), F.greatest(room, zero) / used).otherwise(1.0)

    factor = F.least(
        part(F.col("new"), F.lit(budgets["gross"]) - F.col("gross")), part(grow, F.lit(budgets["net"]) - F.abs("net")),
        part(F.col("new"), F.lit(budgets["incremental"])), part(F.col("turnover"), F.lit(budgets["turnover"])),
    )
    rows = scaled(rows, factor)
    asked, given = F.sum(F.abs("requested")).over(wd), F.sum(F.abs("value")).over(wd)
    status = F.when((given == asked) & (given > 0), "approved").when(given > 0, "reduced").otherwise("rejected")
    return rows.select("decision", "strategy", "symbol", "requested", F.col("value").alias("proposed"), status.alias("status"))


def allocate_portfolio(requests: DataFrame, positions: DataFrame, reservations: DataFrame, budgets: dict[str, float], classes: dict[str, float], increment: float) -> tuple[DataFrame, DataFrame]:
    """(contributions, targets) of requests (decision, strategy, family, symbol, asset_class, requested; one row a decision, strategy and symbol) against signed positions and reservations (decision, symbol, asset_class, value).

    Requests are cut in order: each strategy's, families pro rata, instruments by what of their budget positions and
    reservations leave, asset classes by what all positions and reservations of the class leave, also those of symbols without
    a request, then one factor for gross, net, new and turnover of the decision. A reservation counts gross beside
    the position. Each step's reason is kept. budgets: strategy, family, instrument, gross, net, incremental, turnover; classes: a
    budget each, one that lacks has none (0). Names of reasons are fixed values. Windows hold a decision each."""
    c, lit, zero = F.col, F.lit, F.lit(0.0)
    both = positions.withColumn("kind", lit("p")).unionByName(reservations.withColumn("kind", lit("r")))
    amount = lambda k, x: F.coalesce(F.sum(F.when(c("kind") == k, x)), zero)
    held = both.groupBy("decision", "symbol", "asset_class").agg(amount("p", c("value")).alias("position"), amount("r", c("value")).alias("reserved"), (F.abs(amount("p", c("value"))) + amount("r", F.abs("value"))).alias("base_gross"))
    whole = held.groupBy("decision").agg(F.sum("base_gross").alias("gross"), F.sum(c("position") + c("reserved")).alias("net"))
    of_class = held.groupBy("decision", "asset_class").agg(F.sum("base_gross").alias("class_gross"))
    rows = requests.join(held.drop("asset_class"), ["decision", "symbol"], "left").join(of_class, ["decision", "asset_class"], "left").join(whole, "decision", "left")
    rows = rows.na.fill(0.0, ["position", "reserved", "base_gross", "class_gross", "gross", "net"]).withColumns({"base": c("position") + c("reserved"), "value": c("requested"), "why": F.array().cast("array<string>")})
    limit = F.coalesce(*[F.when(c("asset_class") == n, lit(float(b))) for n, b in classes.items()], zero)
    wi, wc, wd = (Window.partitionBy("decision", x) for x in ("symbol", "asset_class", F.lit(1)))

    def cut(df: DataFrame, factor: Column, reason: str) -> DataFrame:
        df = df.withColumn("factor", factor)
        less = c("factor") < 1
        return df.withColumns({"value": F.when(less, bounded(c("value") * c("factor"), increment)).otherwise(c("value")), "why": F.when(less, F.array_append("why", reason)).otherwise(c("why"))})

    def room(used: Column, left: Column) -> Column:
        return F.when(used > F.greatest(left, zero), F.greatest(left, zero) / used).otherwise(1.0)

    def with_risk(df: DataFrame) -> DataFrame:
        """risk: new risk of the symbol's whole change; lead: one row of each symbol, which stands for it in sums."""
        df = df.withColumn("change", F.sum("value").over(wi)).withColumn("lead", F.row_number().over(wi.orderBy("strategy")) == 1)
        return df.withColumn("risk", F.abs("change") - F.when(c("change") * c("base") < 0, F.least(F.abs("change"), F.abs("base"))).otherwise(0.0))

    over = F.abs("value") > budgets["strategy"]
    rows = rows.withColumns({"value": F.when(over, bounded(F.signum("value") * budgets["strategy"], increment)).otherwise(c("value")), "why": F.when(over, F.array_append("why", "STRATEGY_BUDGET_REDUCED")).otherwise(c("why"))})
    rows = cut(rows, room(F.sum(F.abs("value")).over(Window.partitionBy("decision", "family")), lit(budgets["family"])), "FAMILY_BUDGET_REDUCED")
    rows = with_risk(rows)
    rows = cut(rows, room(c("risk"), lit(budgets["instrument"]) - c("base_gross")), "INSTRUMENT_BUDGET_REDUCED")
    once = lambda w: F.sum(F.when(c("lead"), c("risk")).otherwise(0.0)).over(w)
    rows = with_risk(rows)
    rows = cut(rows.withColumn("used", once(wc)), room(c("used"), limit - c("class_gross")), "ASSET_CLASS_BUDGET_REDUCED")
    rows = with_risk(rows)
    rows = rows.withColumns({"new": once(wd), "delta": F.sum("value").over(wd), "turnover": F.sum(F.abs("value")).over(wd)})
    grow = F.greatest(F.abs(c("net") + c("delta")) - F.abs("net"), zero)
    factors = {
        "GROSS_BUDGET_REDUCED": room(c("new"), lit(budgets["gross"]) - c("gross")), "NET_BUDGET_REDUCED": room(grow, lit(budgets["net"]) - F.abs("net")),
        "INCREMENTAL_BUDGET_REDUCED": room(c("new"), lit(budgets["incremental"])), "TURNOVER_BUDGET_REDUCED": room(c("turnover"), lit(budgets["turnover"])),
    }
    rows = rows.withColumns({n: f for n, f in factors.items()})
    rows = rows.withColumn("why", F.concat("why", F.array_compact(F.array(*[F.when(c(n) < 1, lit(n)) for n in factors]))))
    rows = with_risk(cut(rows, F.least(*[c(n) for n in factors]), "PORTFOLIO_BUDGET_REDUCED"))
    asked, given = F.sum(F.abs("requested")).over(wd), F.sum(F.abs("value")).over(wd)
    status = F.when((given == asked) & (given > 0), "approved").when(given > 0, "reduced").otherwise("rejected")
    less = F.when(c("value") * c("base") < 0, F.least(F.abs("value"), F.abs("base"))).otherwise(0.0)
    rows = rows.withColumns({"status": status, "reasons": F.array_sort(F.array_distinct("why"))})
    shares = rows.select("decision", "strategy", "symbol", "requested", c("value").alias("proposed"), less.alias("reduction"), (F.abs("value") - less).alias("new_risk"), "reasons", "status")
    targets = rows.groupBy("decision", "symbol", "status").agg(
        *[F.first(n).alias(n) for n in ("position", "reserved", "base", "base_gross", "risk")], F.first("change").alias("delta"), F.flatten(F.collect_list("reasons")).alias("all")
    )
    full = F.when(c("base_gross") > budgets["instrument"], F.array(lit("EXISTING_EXPOSURE_OVER_BUDGET"))).otherwise(F.array().cast("array<string>"))
    targets = targets.select("decision", "symbol", "position", "reserved", (c("base") + c("delta")).alias("target"), "delta", c("risk").alias("new_risk"), (F.abs("delta") - c("risk")).alias("reduction"), F.array_sort(F.array_distinct(F.concat("all", full))).alias("reasons"), "status")
    return shares, targets

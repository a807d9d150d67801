"""Signals, fills, ledgers and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signals(bars: DataFrame, least: float = 0.0) -> DataFrame:
    """One row a strategy and bar: breakout and momentum (rolling return over 10 bars), direction long, short or flat."""
    w = Window.partitionBy("symbol").orderBy("bar")
    high, low = F.max("high").over(w.rowsBetween(-5, -1)), F.min("low").over(w.rowsBetween(-5, -1))
    out = F.when(F.col("close") > high, "long").when(F.col("close") < low, "short").otherwise("flat")
    momentum = F.when(F.try_divide(F.col("close"), F.lag("close", 10).over(w)) - 1 > least, "long").otherwise("flat")
    mean = F.when(F.avg("close").over(w.rowsBetween(-2, 0)) > F.avg("close").over(w.rowsBetween(-9, 0)), "long").otherwise("short")
    rows = bars.select("symbol", "bar", F.row_number().over(w).alias("r"), out.alias("breakout"), momentum.alias("momentum"), mean.alias("trend"))
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("direction")) for n in ("breakout", "momentum", "trend")])
    rows = rows.select("symbol", "bar", "r", F.explode(each).alias("s"))
    return rows.where("r > 10").select("symbol", "bar", "s.strategy", "s.direction")


def vote_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("symbol", "bar").agg(*[F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in ("long", "short", "flat", "hold")])


def cash_ledger(fills: DataFrame, start: DataFrame) -> DataFrame:
    """Cash before and after each fill of an account; start: account, cash."""
    w = Window.partitionBy("account").orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    flow = F.when(F.col("side") == "buy", -1).otherwise(1) * F.col("quantity") * F.col("price") - F.col("fee")
    rows = fills.join(start, "account").withColumn("flow", flow).withColumn("after", F.col("cash") + F.sum("flow").over(w)).withColumn("fees", F.sum("fee").over(w))
    return rows.select("account", "fill_id", (F.col("after") - F.col("flow")).alias("cash_before"), F.col("after").alias("cash_after"), "fees", (F.col("after") < 0).alias("insufficient"))


def position_quantities(fills: DataFrame) -> DataFrame:
    w = Window.partitionBy("account", "symbol").orderBy("t", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    return fills.select("account", "symbol", "fill_id", F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))).over(w).alias("position"))


def turnover_and_fees(fills: DataFrame) -> DataFrame:
    return fills.groupBy("account").agg(F.sum(F.abs(F.col("quantity") * F.col("price"))).alias("turnover"), F.sum("fee").alias("fees"), F.count("*").alias("n"))


def drawdown(equity: DataFrame) -> DataFrame:
    """Largest fall below the running peak of each series (symbol, bar, close)."""
    w = Window.partitionBy("symbol").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.withColumn("fall", F.try_divide(F.col("close"), F.max("close").over(w)) - 1)
    return rows.groupBy("symbol").agg(F.min("fall").alias("max_drawdown"), F.min_by("bar", F.struct("fall", "bar")).alias("trough"))


YEAR_DAYS = 365.2425


def performance_metrics(equity: DataFrame, starting: float | None = None, annualization: float | None = None, risk_free: float = 0.0) -> DataFrame:
    """Per series of equity (symbol, bar, close): total return, CAGR, annualised volatility, Sharpe, Sortino and Calmar ratios, largest drawdown.

    Returns need a previous value that is not zero; undefined numbers are null, and without an annualisation factor so are
    volatility and ratios. starting is the equity before the first row (its own value by default)."""
    w = Window.partitionBy("symbol").orderBy("bar")
    before = F.lag("close").over(w)
    rate = risk_free / annualization if annualization else 0.0
    rows = equity.select("symbol", "bar", "close", (F.try_divide(F.col("close"), before) - 1).alias("ret"), F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))
    sums = rows.groupBy("symbol").agg(
        F.min_by("close", "bar").alias("first"), F.max_by("close", "bar").alias("last"), F.min("bar").alias("a"), F.max("bar").alias("z"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"),
        F.sqrt(F.avg(F.pow(F.least(F.col("ret") - rate, F.lit(0.0)), 2) * F.when(F.col("ret").isNotNull(), 1.0))).alias("down"), F.min(F.try_divide(F.col("close"), F.col("peak")) - 1).alias("max_drawdown"),
    )
    start = F.col("first") if starting is None else F.lit(starting)
    total = F.try_divide(F.col("last"), start) - 1
    years = (F.col("z") - F.col("a")) / 86_400 / YEAR_DAYS
    cagr = F.when((F.col("last") > 0) & (start > 0) & (years > 0), F.pow(F.col("last") / start, 1 / years) - 1)
    scale = F.lit(annualization ** 0.5 if annualization else None).cast("double")
    excess = F.col("mean") - rate
    return sums.select(
        "symbol", total.alias("total_return"), cagr.alias("cagr"), (F.col("sd") * scale).alias("volatility"), (F.try_divide(excess, F.when(F.col("sd") != 0, F.col("sd"))) * scale).alias("sharpe"),
        (F.try_divide(excess, F.when(F.col("down") != 0, F.col("down"))) * scale).alias("sortino"), "max_drawdown", F.try_divide(cagr, F.when(F.col("max_drawdown") != 0, F.abs("max_drawdown"))).alias("calmar"),
    )


def trade_statistics(trades: DataFrame) -> DataFrame:
    """trades: group, pnl, held (seconds, may be null). Shares without a base are null."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    return trades.groupBy("group").agg(
        F.count("*").alias("n"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"),
        F.try_divide(F.coalesce(F.sum(win), F.lit(0.0)), -F.sum(loss)).alias("profit_factor"), F.avg("pnl").alias("expectancy"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.avg("held").alias("mean_held"),
    )


def outlier_dependence(trades: DataFrame, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """What the best trades contribute to each group's total: top_k and without_k. Only the largest k of each task and group are sorted (rank limits push down)."""
    most = max(tops)
    ranked = trades.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("pnl"), "id"))).where(F.col("rank") <= most)
    best = ranked.groupBy("group").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("pnl"))).alias(f"top_{k}") for k in tops])
    total = trades.groupBy("group").agg(F.sum("pnl").alias("total"))
    return total.join(best, "group").select("group", "total", *[F.col(f"top_{k}") for k in tops], *[(F.col("total") - F.col(f"top_{k}")).alias(f"without_{k}") for k in tops])


def bh_adjust(tests: DataFrame, by: bool = False) -> DataFrame:
    """FDR-adjusted p-values of each family (family, test_id, p); by: times the harmonic number."""
    w = Window.partitionBy("family")
    up = w.orderBy("p", "test_id")
    rows = tests.withColumn("rank", F.row_number().over(up)).join(tests.groupBy("family").agg(F.count("*").alias("m")), "family")
    scale = F.lit(1.0)
    if by:  # the harmonic number by a sum over ranks, once a family
        harmonic = rows.groupBy("family").agg(F.sum(1 / F.col("rank")).alias("scale"))
        rows, scale = rows.join(harmonic, "family"), F.col("scale")
    rows = rows.withColumn("raw", F.col("p") * F.col("m") / F.col("rank") * scale)
    # The running minimum from the largest rank: descending order, so that the frame grows and is not summed anew.
    low = F.min("raw").over(w.orderBy(F.desc("p"), F.desc("test_id")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("family", "test_id", F.least(low, F.lit(1.0)).alias("adjusted"))


def value_ranks(df: DataFrame, by: str, value: str, block: Column) -> DataFrame:
    """(by, value, n, below, total) of the different values: counted first, then summed in blocks of the value, so that no task sorts a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("value")).agg(F.count("*").alias("n")).withColumn("_b", block)
    inside = counts.withColumn("_in", F.sum("n").over(Window.partitionBy(by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    sums = counts.groupBy(by, "_b").agg(F.sum("n").alias("_n"))
    over = Window.partitionBy(by).orderBy("_b")
    sums = sums.select(by, "_b", (F.sum("_n").over(over) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy(by)).alias("total"))
    return inside.join(sums, [by, "_b"]).select(by, "value", "n", (F.col("_in") + F.col("_base")).alias("below"), "total")


def value_block(value: str = "value") -> Column:
    """Blocks that keep the order of doubles: the rounded signed logarithm, finely. NaN is above all other values, as in Spark's order; it and both infinities have blocks of their own."""
    x = F.col(value).cast("double")
    far = F.lit(1 << 40)
    odd = F.when(F.isnan(x), far + 1).when(x == float("inf"), far).when(x == float("-inf"), -far).when(x == 0, F.lit(0))
    plain = F.when(odd.isNull(), x).otherwise(1.0)
    return F.coalesce(odd, F.signum(plain).cast("long") * (F.floor(F.ln(F.abs(plain)) * 64) + 50_000))


def rank_at(rank: Column) -> Column:
    """The value of that rank (from 0) of `value_ranks` rows."""
    return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("value")))


def nearest_rank_quantile(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """Value of rank ceil(p n), 1 at least."""
    rows = value_ranks(df, by, value, value_block())
    return rows.groupBy(by).agg(rank_at(F.greatest(F.ceil(F.col("total") * p), F.lit(1)) - 1).alias("quantile"))


COSTS = ("fee", "spread", "slippage")


def scaled(rows: DataFrame, multipliers: dict[str, float], parameters: tuple[str, ...]) -> DataFrame:
    """rows once for each scenario, with their cost parameters times its multiplier."""
    each = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("m")) for n, m in multipliers.items()])
    rows = rows.withColumn("_s", F.explode(each))
    return rows.withColumns({"scenario": F.col("_s.scenario"), **{c: F.col(c) * F.col("_s.m") for c in parameters}}).drop("_s")


def cost_scenarios(costs: DataFrame, multipliers: dict[str, float], parameters: tuple[str, ...] = COSTS) -> DataFrame:
    """Each row (id and cost parameters) under each multiplier."""
    return scaled(costs, multipliers, parameters).select("id", "scenario", *parameters)


def cost_sensitivity(trades: DataFrame, multipliers: dict[str, float]) -> DataFrame:
    """Net result of trades (group, gross, fee, spread, slippage) under each cost multiplier: trades, net, expectancy and the share that wins."""
    rows = scaled(trades, multipliers, COSTS).withColumn("net", net_after_costs(F.col("gross"), F.col("fee") + F.col("spread") + F.col("slippage")))
    return rows.groupBy("group", "scenario").agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.avg("net").alias("expectancy"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


def scenario_metrics(trades: DataFrame, starting: float, multipliers: dict[str, float], annualization: float | None = None, risk_free: float = 0.0) -> DataFrame:
    """performance_metrics of each group under each cost multiplier, with turnover (notional over the starting equity), total_fees and trade figures.

    trades: id, group, t, gross, notional, fee, spread, slippage, held. The equity curve has a point for each time with trades,
    summed before it is ordered; a trade with a negative cost has no net result and moves nothing."""
    cost = F.col("fee") + F.col("spread") + F.col("slippage")
    rows = scaled(trades, multipliers, COSTS).withColumn("net", net_after_costs(F.col("gross"), cost))
    key = ["group", "scenario"]
    w = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    points = rows.groupBy(*key, "t").agg(F.coalesce(F.sum("net"), F.lit(0.0)).alias("net"))
    curve = points.select(F.struct(*key).alias("symbol"), F.col("t").alias("bar"), (F.lit(starting) + F.sum("net").over(w)).alias("close"))
    told = performance_metrics(curve, starting, annualization, risk_free).select("symbol.*", "*").drop("symbol")
    sums = rows.groupBy(*key).agg(
        F.count("*").alias("trades"), F.try_divide(F.sum(F.abs("notional")), F.lit(starting)).alias("turnover"), F.sum("fee").alias("total_fees"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg("net").alias("expectancy"),
    )
    return told.join(sums, key)


def net_after_costs(gross: Column, cost: Column) -> Column:
    """Gross less cost; null where the cost is negative."""
    return F.when(cost >= 0, gross - cost)


def lineage_edges(edges: DataFrame) -> DataFrame:
    """Edges (kind, source, target) once each, with a content id."""
    return edges.distinct().withColumn("edge_id", F.sha2(F.concat_ws("|", "kind", "source", "target"), 256))


def convert(amount: Column, direct: Column, inverse: Column) -> Column:
    """Direct rate, else one over the inverse rate, else null."""
    return amount * F.coalesce(direct, 1 / inverse)

"""Account books: snapshots of equity and risk, exposure of open orders, marks, seeds, conversion and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def convert_currency(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts (id, amount, base, quote) with converted: by the direct rate (base, quote, rate), else by one over the inverse rate; the amount itself in its own currency, null without a rate. Rates are a small table."""
    r = F.broadcast(rates.select("base", "quote", F.col("rate").alias("direct")))
    i = F.broadcast(rates.select(F.col("quote").alias("base"), F.col("base").alias("quote"), F.col("rate").alias("inverse")))
    rows = amounts.join(r, ["base", "quote"], "left").join(i, ["base", "quote"], "left")
    factor = F.when(F.col("base") == F.col("quote"), 1.0).otherwise(F.coalesce("direct", F.try_divide(F.lit(1.0), F.col("inverse"))))
    return rows.withColumn("converted", F.col("amount") * factor).drop("direct", "inverse")


def seed_positions(initial: DataFrame, bars: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fills, accounts) of initial quantities (account, symbol, quantity) priced at the first open of their symbol; cash is lowered by what they cost. Symbols without a bar seed nothing."""
    first = bars.groupBy("symbol").agg(F.min_by("open", "bar").alias("price"), F.min("bar").alias("t"))
    fills = initial.where("quantity <> 0").join(first, "symbol").select("account", "symbol", "quantity", "price", "t", (F.col("quantity") * F.col("price")).alias("cost"))
    spent = fills.groupBy("account").agg(F.sum("cost").alias("cost"))
    return fills, accounts.join(spent, "account", "left").withColumn("cash", F.col("cash") - F.coalesce("cost", F.lit(0.0))).drop("cost")


def equity_snapshot(cash: DataFrame, positions: DataFrame) -> DataFrame:
    """Per (account, t) of cash (account, t, cash, realized, fees): gross and net value, equity, unrealized, of the positions (account, t, symbol, quantity, price, average) marked then; accounts without positions have zeros."""
    value = F.col("quantity") * F.col("price")
    sums = positions.where("quantity <> 0").groupBy("account", "t").agg(
        F.sum(F.abs(value)).alias("gross"), F.sum(value).alias("net"), F.sum((F.col("price") - F.col("average")) * F.col("quantity")).alias("unrealized"), F.count("*").alias("open_positions")
    )
    rows = cash.join(sums, ["account", "t"], "left").na.fill(0, ["gross", "net", "unrealized", "open_positions"])
    return rows.withColumn("equity", F.col("cash") + F.col("net"))


def account_risk_snapshot(accounts: DataFrame, positions: DataFrame, orders: DataFrame, locks: DataFrame) -> DataFrame:
    """Per account (account, cash, day_start, high_water): equity, gross, net, long, short, unrealized, daily result, drawdown, pending orders, oldest mark and active locks."""
    value = F.col("quantity") * F.col("price")
    held = positions.where("quantity <> 0").groupBy("account").agg(
        F.sum(F.abs(value)).alias("gross"), F.sum(value).alias("net"), F.sum(F.greatest(value, F.lit(0.0))).alias("long"), F.sum(F.greatest(-value, F.lit(0.0))).alias("short"),
        F.sum((F.col("price") - F.col("average")) * F.col("quantity")).alias("unrealized"), F.min("marked_at").alias("mark_time"),
    )
    pending = orders.where(F.col("status").isin("accepted", "partially_filled", "cancel_requested")).groupBy("account").agg(F.count("*").alias("pending_orders"))
    active = locks.where("active").groupBy("account").agg(F.array_join(F.array_sort(F.collect_set("lock")), ",").alias("locks"))
    rows = accounts.join(held, "account", "left").join(pending, "account", "left").join(active, "account", "left").na.fill(0, ["gross", "net", "long", "short", "unrealized", "pending_orders"]).na.fill("", ["locks"])
    equity = F.col("cash") + F.col("net")
    return rows.select(
        "account", equity.alias("equity"), F.greatest(equity, F.lit(0.0)).alias("available_margin"), "gross", "net", "long", "short", "unrealized", (equity - F.col("day_start")).alias("daily_pnl"),
        F.greatest(F.col("high_water") - equity, F.lit(0.0)).alias("drawdown"), "pending_orders", "mark_time", "locks",
    )


def open_order_exposure(orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """Reserved exposure of open orders (account, symbol, side, quantity, filled): what remains, at the ask of the symbol's newest quote for buys and at the bid for sales, signed and absolute."""
    last = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid", "ask"), F.struct("us", "row_no")).alias("q"))
    left = F.col("quantity") - F.col("filled")
    rows = orders.where(left > 0).join(last, "symbol")
    value = F.when(F.col("side") == "buy", left * F.col("q.ask")).otherwise(-left * F.col("q.bid"))
    return rows.groupBy("account").agg(F.sum(value).alias("net_reserved"), F.sum(F.abs(value)).alias("reserved"), F.count("*").alias("open_orders"))


def running_equity(marks: DataFrame) -> DataFrame:
    """account, t, equity, high_water of marks (account, symbol, t, delta: change of cash and marked value at t): the sum so far and its running peak."""
    steps = marks.groupBy("account", "t").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy("account").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumn("equity", F.sum("delta").over(w))
    return rows.select("account", "t", "equity", F.max("equity").over(w).alias("high_water"))


def buy_hold_curve(bars: DataFrame, cash: float) -> DataFrame:
    """symbol, bar, equity of cash put in at the first open of each series."""
    first = bars.groupBy("symbol").agg(F.min_by("open", "bar").alias("first_open"))
    return bars.join(first, "symbol").select("symbol", "bar", (F.try_divide(F.lit(cash), F.col("first_open")) * F.col("close")).alias("equity"))


def differs(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Unequal, null-safe, with a tolerance for sums of doubles."""
    return F.coalesce(F.abs(a - b) > tolerance, ~a.eqNullSafe(b))


def reconcile_ledger(orders: DataFrame, fills: DataFrame, reservations: DataFrame, positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Violations (account, code, key) of conservation between fills, orders, reservations, positions and accounts.

    orders: order_id, account, symbol, side, quantity, filled, status, t, intent. fills: fill_id, order_id, account, symbol,
    side, quantity, price, fee, t. reservations: order_id, account, intent, amount. positions: account, symbol, quantity,
    fees. accounts: account, starting_cash, cash, fees, reserved."""
    c = F.col
    open_ = c("status").isin("accepted", "partially_filled", "cancel_requested")
    by_order = fills.groupBy("order_id").agg(F.sum("quantity").alias("got"))
    o = orders.join(by_order, "order_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    r = reservations.select("order_id", c("account").alias("r_account"), c("intent").alias("r_intent"))
    bound = orders.where(open_).select("order_id", "account", "intent").join(r, "order_id", "full_outer")
    f = fills.join(orders.select("order_id", c("symbol").alias("o_symbol"), c("side").alias("o_side"), c("t").alias("o_t")), "order_id", "left")
    signed = F.when(c("side") == "buy", c("quantity")).otherwise(-c("quantity"))
    held = fills.groupBy("account", "symbol").agg(F.sum(signed).alias("f_quantity"), F.sum("fee").alias("f_fees"))
    p = positions.join(held, ["account", "symbol"], "full_outer")
    spent = fills.groupBy("account").agg(F.sum(-signed * c("price") - c("fee")).alias("flow"), F.sum("fee").alias("f_fees"))
    kept = reservations.groupBy("account").agg(F.sum("amount").alias("amount"))
    a = accounts.join(spent, "account", "left").join(kept, "account", "left").na.fill(0.0, ["flow", "f_fees", "amount"])

    def found(rows: DataFrame, code: str, bad: Column, account: Column, key: Column) -> DataFrame:
        return rows.where(F.coalesce(bad, F.lit(False))).select(account.alias("account"), F.lit(code).alias("code"), key.cast("string").alias("key"))

    checks = [
        found(fills, "nonpositive_fill", c("quantity") <= 0, c("account"), c("fill_id")),
        found(o, "order_quantity_not_conserved", (c("filled") < 0) | (c("filled") > c("quantity")), c("account"), c("order_id")),
        found(o, "order_filled_differs_from_fills", c("filled") != c("got"), c("account"), c("order_id")),
        found(o, "filled_order_retains_quantity", (c("status") == "filled") & (c("filled") != c("quantity")), c("account"), c("order_id")),
        found(bound, "open_order_without_reservation", c("r_account").isNull(), c("account"), c("order_id")),
        found(bound, "reservation_without_open_order", c("account").isNull(), c("r_account"), c("order_id")),
        found(bound, "reservation_authorization_differs", c("account").isNotNull() & c("r_account").isNotNull() & ~c("intent").eqNullSafe(c("r_intent")), c("account"), c("order_id")),
        found(f, "fill_of_unknown_order", c("o_t").isNull(), c("account"), c("fill_id")),
        found(f, "fill_differs_from_order", c("o_t").isNotNull() & ((c("symbol") != c("o_symbol")) | (c("side") != c("o_side"))), c("account"), c("fill_id")),
        found(f, "fill_before_submission", c("t") <= c("o_t"), c("account"), c("fill_id")),
        found(p, "position_differs_from_fills", differs(c("quantity"), c("f_quantity")), c("account"), c("symbol")),
        found(p, "position_fees_differ", differs(c("fees"), c("f_fees")), c("account"), c("symbol")),
        found(a, "cash_differs_from_fills", differs(c("cash"), c("starting_cash") + c("flow"), 1e-4), c("account"), c("account")),
        found(a, "fees_differ_from_fills", differs(c("fees"), c("f_fees"), 1e-4), c("account"), c("account")),
        found(a, "reserved_risk_differs", differs(c("reserved"), c("amount"), 1e-4), c("account"), c("account")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out

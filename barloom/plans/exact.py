"""Registered queries of exact money. The SQL walks 128-bit whole numbers; results are compared as texts, to the last digit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import exact as E
from barloom.sources import tables as S

from .queries import query


def fills(s: SparkSession, d: str) -> DataFrame:
    """Fills of a few accounts, so that positions grow, shrink and turn: prices in cents, fees in thousandths of them."""
    rows = S.fills(s, d).withColumns({"account": F.col("account") % 40, "side": F.when(F.col("fill_id") * 7919 % 13 < 6, "sell").otherwise("buy"), "price": F.round("price", 2).cast("decimal(18,2)")})
    return E.exact_fills(rows.withColumn("fee", (F.col("price") / 1000).cast("decimal(18,5)")))


def text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


#: p: price in 10^-12, q: quantity in 10^-6, f: fee in 10^-12.
EXACT = """xf as (select o_orderkey as fill_id, o_custkey % 40 as account, o_orderpriority as symbol, o_orderkey * 7919 % 13 < 6 as sells, (o_orderkey % 9 + 1)::hugeint * 1000000 as q, round(o_totalprice * 100)::hugeint * 10000000000 as p, round(o_totalprice * 100)::hugeint * 10000000 as f, cast(floor(epoch(o_orderdate)) as bigint) as t from orders)"""
_even = lambda a, b: f"(({a}) // ({b}) + case when 2 * (({a}) % ({b})) > ({b}) or 2 * (({a}) % ({b})) = ({b}) and (({a}) // ({b})) % 2 = 1 then 1 else 0 end)"
_said = lambda x, n: f"case when {x} < 0 then '-' else '' end || (abs({x}) // 1{'0' * n}::hugeint)::varchar || '.' || lpad((abs({x}) % 1{'0' * n}::hugeint)::varchar, {n}, '0')"
#: old: position before the fill; s: signed quantity. A state after each fill: pos, avg, fees; what it closed: c, e, g, w.
_c = "case when sign(st.pos) * sign(nx.s) < 0 then least(abs(st.pos), abs(nx.s)) else 0 end"
_next = f"""select nx.account, nx.symbol, nx.r, nx.fill_id, st.pos + nx.s as pos,
    case when st.pos = 0 or sign(st.pos) * sign(st.pos + nx.s) < 0 then nx.p when sign(st.pos) * sign(nx.s) > 0 then {_even("st.avg * abs(st.pos) + nx.p * abs(nx.s)", "abs(st.pos) + abs(nx.s)")} else st.avg end as avg,
    case when st.pos = 0 then nx.f when sign(st.pos) * sign(st.pos + nx.s) < 0 then {_even("nx.f * abs(st.pos + nx.s)", "nx.q")} when sign(st.pos) * sign(nx.s) > 0 then st.fees + nx.f else st.fees - {_even(f"st.fees * {_c}", "abs(st.pos)")} end as fees,
    {_c} as c, st.avg as e, case when st.pos = 0 then 0::hugeint else (nx.p - st.avg) * {_c} * sign(st.pos) end as g, case when st.pos = 0 then 0::hugeint else {_even(f"st.fees * {_c}", "abs(st.pos)")} + {_even(f"nx.f * {_c}", "nx.q")} end as w
    from st join nx on nx.account = st.account and nx.symbol = st.symbol and nx.r = st.r + 1"""
WALK = f"""{EXACT}, nx as (select *, case when sells then -q else q end as s, row_number() over (partition by account, symbol order by t, fill_id) as r from xf),
  st as (select account, symbol, 0::bigint as r, 0::bigint as fill_id, 0::hugeint as pos, 0::hugeint as avg, 0::hugeint as fees, 0::hugeint as c, 0::hugeint as e, 0::hugeint as g, 0::hugeint as w from (select distinct account, symbol from nx) union all {_next}), wk as (select * from st where r > 0)"""
query(
    "exact_cash_ledger",
    f"""with {EXACT}, k as (select c_custkey as account, round(c_acctbal * 100)::hugeint * 1000000000000 as cash from customer where c_custkey < 40), a as (select account, fill_id, t, cash, case when sells then 1 else -1 end * q * (p // 10000) - f * 100 as flow, f * 100 as fee from xf join k using (account)),
    b as (select account, fill_id, flow, cash + sum(flow) over w as after, sum(fee) over w as fees from a window w as (partition by account order by t, fill_id rows unbounded preceding)), h as (select account, fill_id, flow::hugeint as flow, after::hugeint as after, fees::hugeint as fees from b)
    select account, fill_id, {_said("(after - flow)", 14)} as cash_before, {_said("after", 14)} as cash_after, {_said("fees", 14)} as fees, after < 0 as insufficient from h""",
)(lambda s, d: text(E.exact_cash(fills(s, d), S.table(s, d, "customer").where("c_custkey < 40").select(F.col("c_custkey").alias("account"), F.round("c_acctbal", 2).cast("decimal(18,2)").alias("cash"))), "cash_before", "cash_after", "fees"))
_closed = f"case when c > 0 then {_said('c', 6)} end as {{}}, case when c > 0 then {_said('e', 12)} end as entry_price, case when c > 0 then {_said('g', 18)} end as gross, case when c > 0 then {_said('w', 12)} end as fees, case when c > 0 then {_said('(g - w * 1000000)', 18)} end as net"
query("exact_position_ledger", f"with recursive {WALK} select account, symbol, fill_id, case when pos <> 0 then {_said('avg', 12)} end as average_price, {_closed.format('closed_quantity')} from wk")(
    lambda s, d: text(E.exact_positions(fills(s, d)), "average_price", "closed_quantity", "entry_price", "gross", "fees", "net")
)
query("exact_closed_trades", f"with recursive {WALK} select account, symbol, fill_id, {_closed.format('quantity')} from wk where c > 0")(
    lambda s, d: text(E.exact_trades(E.exact_positions(fills(s, d))), "quantity", "entry_price", "gross", "fees", "net")
)

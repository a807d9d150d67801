"""Registered queries of lineage, experiments, strategy governance and streams, with the DuckDB SQL that must give the same rows.

Columns that the given tables lack are made from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import governance as G
from barloom.sources import tables as S
from barloom.streaming import bars as B

from .decisions import RISK, intents, risk_
from .queries import DAYS, FILLS, HOUR, OPEN, TICKS, VALID_TICKS, bars, bars_sql, query

# Content ids

_id = "'run-' || sha256(coalesce(k::varchar, '\\N') || '|' || coalesce(a, '\\N') || '|' || coalesce(b::varchar, '\\N'))"
_stored = "case when k % 17 = 0 then 'run-x' else"


def identified(s: SparkSession, d: str) -> DataFrame:
    rows = S.table(s, d, "part").selectExpr("p_partkey as k", "case when p_partkey % 5 > 0 then p_brand end as a", "p_size as b")
    return rows.withColumn("id", F.when(F.col("k") % 17 == 0, "run-x").otherwise(G.stable_id("run", F.col("k"), F.col("a"), F.col("b"))))


query(
    "verify_stable_ids",
    f"with p as (select p_partkey as k, case when p_partkey % 5 > 0 then p_brand end as a, p_size as b from part) select k, 'run-x' as id, {_id} as expected_id from p where k % 17 = 0",
)(lambda s, d: G.verify_stable_ids(identified(s, d), "run", "id", ["k", "a", "b"]).select("k", "id", "expected_id"))
_doc = "case when k % 7 = 0 then '{\"id\": ' || k when k % 11 = 0 then '{\"id\": ' || k || '}' else '{\"id\": ' || k || ', \"name\": \"' || n || '\"}' end"


def payloads(s: SparkSession, d: str) -> DataFrame:
    rows = S.table(s, d, "customer").selectExpr("c_custkey as k", "c_name as n").selectExpr("k", f"{_doc} as payload", "if(k % 13 = 0, k + 1, k) as id")
    return rows.withColumn("stored_hash", F.when(F.col("k") % 5 == 0, "x").otherwise(F.sha2("payload", 256)))


query(
    "verify_governance_rows",
    "select c_custkey as k, case when c_custkey % 7 = 0 or c_custkey % 11 = 0 then 'invalid_schema' when c_custkey % 5 = 0 then 'hash_mismatch' when c_custkey % 13 = 0 then 'key_mismatch' else 'verified' end as integrity from customer",
)(lambda s, d: G.verify_governance_rows(payloads(s, d), "id long, name string", ["id", "name"], ["id"]).select("k", "integrity"))

# Lineage


def lineage(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders of customers of nations of regions, as strategies, experiments, datasets and sources; one source refers back to some orders."""
    o = S.table(s, d, "orders").selectExpr("o_orderkey as id", "sha2(string(o_totalprice), 256) as h", "if(o_orderkey % 9 > 0, o_custkey, null) as ref")
    c = S.table(s, d, "customer").selectExpr("c_custkey as id", "c_nationkey as ref")
    n = S.table(s, d, "nation").selectExpr("n_nationkey as id", "n_regionkey as ref")
    r = S.table(s, d, "region").selectExpr("r_regionkey as id")
    back = S.table(s, d, "orders").where("o_orderkey % 50 = 0").selectExpr("0 as id", "o_orderkey as ref")
    nodes, edges = G.lineage_build([
        ("strategy", o, "id", "h", {"ref": ("tested_by", "experiment")}), ("experiment", c, "id", None, {"ref": ("uses", "dataset")}), ("dataset", n, "id", None, {"ref": ("from", "source")}), ("source", r, "id", None, {}), ("source", back, "id", None, {"ref": ("feeds", "strategy")}),
    ])
    return nodes, edges


LINEAGE = """le as (select 'tested_by' as kind, 'strategy:' || o_orderkey as source, 'experiment:' || o_custkey as target from orders where o_orderkey % 9 > 0 union select 'uses', 'experiment:' || c_custkey, 'dataset:' || c_nationkey from customer
  union select 'from', 'dataset:' || n_nationkey, 'source:' || n_regionkey from nation union select 'feeds', 'source:0', 'strategy:' || o_orderkey from orders where o_orderkey % 50 = 0)"""
query(
    "lineage_build",
    f"""with {LINEAGE}, ln as (select 'strategy:' || o_orderkey as source, 'strategy' as kind, sha256(o_totalprice::varchar) as h from orders) select 'edge' as what, source, target, kind from le
    union all select 'node', 'strategy:' || o_orderkey, null, 'strategy' from orders union all select 'node', 'experiment:' || c_custkey, null, 'experiment' from customer union all select 'node', 'dataset:' || n_nationkey, null, 'dataset' from nation union all select 'node', 'source:' || r_regionkey, null, 'source' from region""",
)(
    lambda s, d: (lambda x: x[1].select(F.lit("edge").alias("what"), "source", "target", "kind").unionByName(x[0].select(F.lit("node").alias("what"), F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target"), "kind")))(lineage(s, d))
)
_loop = "select o_orderkey, o_custkey, c_nationkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 0 and o_orderkey % 50 = 0 and o_orderkey % 9 > 0"
query(
    "lineage_cycles",
    f"with l as ({_loop}), n as (select 'strategy:' || o_orderkey as node from l union select 'experiment:' || o_custkey from l union select 'dataset:' || c_nationkey from l union select 'source:0' from l) select node, (select max(node) from n) as cycle from n",
)(lambda s, d: G.lineage_cycles(lineage(s, d)[1]))
_walk = lambda start, depth, a, b: f"""with recursive {LINEAGE}, w as (select node, 0 as steps from ({start}) union select {b}, steps + 1 from w join le on {a} = w.node where steps < {depth}) select node, min(steps) as steps from w group by 1"""
query("lineage_for_strategy", _walk("select 'strategy:' || o_orderkey as node from orders where o_orderkey % 50 = 1", 3, "le.source", "le.target"))(
    lambda s, d: G.lineage_for("strategy", lineage(s, d)[1], S.table(s, d, "orders").where("o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("id")), 3, 1_000_000)[0]
)
query("lineage_for_experiment", _walk("select 'experiment:' || c_custkey as node from customer where c_acctbal < 0", 2, "le.target", "le.source"))(
    lambda s, d: G.lineage_for("experiment", lineage(s, d)[1], S.table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), 2, 1_000_000, False)[0]
)
query("lineage_for_dataset", _walk("select 'dataset:' || n_nationkey as node from nation where n_regionkey = 0", 2, "le.source", "le.target"))(
    lambda s, d: G.lineage_for("dataset", lineage(s, d)[1], S.table(s, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("id")), 2, 1_000_000)[0]
)

# Experiments

EXPERIMENTS = {
    "dataset": "case when k % 6 > 0 then k % 40 end", "dataset_hash": "case when k % 7 = 0 then 'old' else 'h' || (k % 40) end", "slice": "k % 30", "slice_hash": "case when k % 8 = 0 then 'old' else 's' || (k % 30) end", "qualification": "k % 50", "contaminated": "k % 9 = 0",
}
query(
    "experiment_data_eligibility",
    f"""with e as (select k as experiment, {", ".join(f"{x} as {n}" for n, x in EXPERIMENTS.items())} from (select p_partkey as k from part)), j as (select *, dataset < 35 as has_d, slice < 25 as has_s, qualification < 45 as has_q, qualification % 40 as q_dataset, case when qualification % 3 = 0 then 'rejected' else 'qualified' end as verdict from e),
    t as (select experiment, contaminated, case when dataset is null then 'legacy_unbound' else 'bound' end as binding_status, case when dataset is not null then case when not has_d then 'missing' when dataset_hash = 'h' || dataset then 'verified' else 'hash_mismatch' end end as dataset_status,
    case when dataset is not null then case when not has_s then 'missing' when slice_hash = 's' || slice then 'verified' else 'hash_mismatch' end end as slice_status, case when dataset is not null then case when not has_q then 'missing' when q_dataset <> dataset then 'scope_mismatch' else verdict end end as qualification_status from j),
    u as (select *, concat_ws(',', case when binding_status <> 'bound' then 'EXPERIMENT_INPUT_BINDING_MISSING' end, case when dataset_status <> 'verified' then 'DATASET_NOT_VERIFIED' end, case when slice_status <> 'verified' then 'SLICE_NOT_VERIFIED' end, case when qualification_status <> 'qualified' then 'DATASET_NOT_QUALIFIED' end, case when contaminated then 'CONTAMINATED_OOS' end) as reasons from t)
    select experiment, binding_status, dataset_status, slice_status, qualification_status, case when contaminated then 'contaminated' else 'pristine' end as oos_status, reasons, reasons = '' as eligible from u""",
)(
    lambda s, d: G.experiment_data_eligibility(
        S.table(s, d, "part").selectExpr("p_partkey as k").selectExpr("k as experiment", *[f"{x} as {n}" for n, x in EXPERIMENTS.items()]), s.range(35).selectExpr("id as dataset", "'h' || id as hash"), s.range(25).selectExpr("id as slice", "'s' || id as hash"),
        s.range(45).selectExpr("id as qualification", "id % 40 as dataset", "if(id % 3 = 0, 'rejected', 'qualified') as verdict"),
    )
)
query(
    "experiment_registry_check",
    """with r as (select o_custkey as id, o_orderpriority as h, o_custkey % 4 > 0 as frozen from orders), a as (select c_custkey as id, c_custkey + 7 as parent from customer), p as (select id as parent, bool_or(frozen) as f from r group by 1)
    select id, 'conflicting_content' as code from r group by 1 having count(distinct h) > 1 union all select id, case when f is null then 'missing_parent' else 'parent_not_frozen' end from a left join p using (parent) where f is null or not f""",
)(
    lambda s, d: G.experiment_registry_check(
        S.table(s, d, "orders").selectExpr("o_custkey as id", "o_orderpriority as hash", "o_custkey % 4 > 0 as frozen"), S.table(s, d, "customer").selectExpr("c_custkey as id", "c_custkey + 7 as parent")
    )
)
query(
    "oos_contamination",
    """with r as (select p_partkey as id, p_partkey % 3 > 0 as touched, p_partkey % 4 = 0 as influenced, p_partkey % 5 > 0 as selectable, case when p_partkey % 7 = 0 then 'invalid' else 'pass' end as decision from part),
    c as (select id, case when influenced and not touched then 'influence_without_access' when influenced and decision <> 'invalid' then 'contaminated_not_invalid' when influenced then 'contaminated' when touched and selectable then 'selection_eligible_oos' end as code from r) select * from c where code is not null""",
)(lambda s, d: G.oos_contamination(S.table(s, d, "part").selectExpr("p_partkey as id", "p_partkey % 3 > 0 as touched", "p_partkey % 4 = 0 as influenced", "p_partkey % 5 > 0 as selectable", "if(p_partkey % 7 = 0, 'invalid', 'pass') as decision")))
_spec = "p_partkey as id, p_brand as strategy, p_size as period, p_type as dataset, p_partkey % 6 = 0 as locked, case when p_partkey % 12 = 0 then p_partkey - 1 else p_partkey + 100000 end as parent"
query(
    "experiment_lineage_check",
    f"""with s as (select {_spec} from part), r as (select id, case when id % 8 = 0 then 'x' else strategy end as strategy, case when id % 10 = 0 then null else period end as period, dataset from s union all select -1, 'a', 1, 'b'),
    a as (select r.id, case when s.id is null then 'missing' else concat_ws(',', case when r.dataset is distinct from s.dataset then 'dataset' end, case when r.period is distinct from s.period then 'period' end, case when r.strategy is distinct from s.strategy then 'strategy' end) end as fields from r left join s using (id)),
    b as (select s.id, case when p.id is null then 'missing' else concat_ws(',', case when s.dataset <> p.dataset then 'dataset' end, case when s.strategy <> p.strategy then 'strategy' end) end as fields from s left join s p on s.parent = p.id where s.locked)
    select id, 'run_differs_from_spec' as code, fields from a where fields <> '' union all select id, 'locked_differs_from_parent', fields from b where fields <> ''""",
)(
    lambda s, d: (lambda spec: G.experiment_lineage_check(
        spec.selectExpr("id", "if(id % 8 = 0, 'x', strategy) as strategy", "if(id % 10 = 0, null, period) as period", "dataset").unionByName(s.sql("select -1L as id, 'a' as strategy, 1L as period, 'b' as dataset")), spec, ["strategy", "period", "dataset"], ["strategy", "dataset"]
    ))(S.table(s, d, "part").selectExpr(*_spec.split(", ")))
)

# Strategies

STATES = {"stage": "case k % 5 when 0 then 'candidate' when 1 then 'shadow' else 'paper' end", "health": "case when k % 31 = 0 then 'failed' else 'ok' end", "disabled": "k % 29 = 0"}
EVIDENCE = {"evidence": "k + 10000", "e_artifact": "case when k % 23 = 0 then -1 else k end", "oos": "case when k % 19 = 0 then 'contaminated' when k % 17 > 0 then 'pristine' end", "fixture": "k % 37 = 0", "empirical": "k % 41 > 0", "validation": "case when k % 13 = 0 then null when k % 11 = 0 then 'kill' when k % 7 = 0 then 'conditional' else 'pass' end"}
APPROVALS = {"approval": "k + 20000", "a_artifact": "k", "a_evidence": "case when k % 43 = 0 then 0 else k + 10000 end", "target": "case when k % 3 = 0 then 'shadow' else 'paper' end"}
_of = lambda d: ", ".join(f"{e} as {n}" for n, e in d.items())
query(
    "eligibility_audit",
    f"""with p as (select p_partkey as k from part), st as (select k, {_of(STATES)} from p), ev as (select k, {_of(EVIDENCE)} from p where k % 8 > 0), ap as (select k, {_of(APPROVALS)} from p where k % 9 > 0), rv as (select k + 10000 as t from p where k % 47 = 0 union select k + 20000 from p where k % 53 = 0),
    j as (select st.*, ev.* exclude (k), ap.* exclude (k), evidence in (select t from rv) as er, approval in (select t from rv) as ar from st left join ev using (k) left join ap using (k)),
    v as (select k, case when coalesce(er, false) then 'reject|EVIDENCE_REVOKED' when coalesce(ar, false) then 'reject|APPROVAL_REVOKED' when health = 'failed' then 'reject|STRATEGY_HEALTH_FAILED' when disabled then 'hold|STRATEGY_DISABLED' when stage = 'candidate' then 'hold|NOT_OPERATIONAL_STAGE' when evidence is null then 'hold|MISSING_EVIDENCE'
    when e_artifact <> k then 'reject|EVIDENCE_ARTIFACT_MISMATCH' when oos = 'contaminated' then 'reject|CONTAMINATED_OOS' when oos is null then 'hold|OOS_STATUS_REQUIRED' when fixture or not empirical then 'reject|FIXTURE_OR_EMPIRICAL_ELIGIBILITY_REQUIRED' when validation in ('kill', 'invalid') then 'reject|VALIDATION_REJECTED'
    when validation is null then 'hold|VALIDATION_VERDICT_UNAVAILABLE' when validation <> 'pass' then 'hold|VALIDATION_NOT_PASSED' when approval is null then 'hold|APPROVAL_REQUIRED' when a_artifact <> k or a_evidence <> evidence or target <> stage then 'reject|APPROVAL_SCOPE_MISMATCH' end as x from j)
    select k as strategy, coalesce(split_part(x, '|', 1), 'allow') as verdict, split_part(x, '|', 2) as reason from v""",
)(lambda s, d: _eligibility(s, d))


def _eligibility(s: SparkSession, d: str) -> DataFrame:
    p = S.table(s, d, "part").selectExpr("p_partkey as k")
    of = lambda x: [f"{e} as {n}" for n, e in x.items()]
    gone = p.where("k % 47 = 0").selectExpr("k + 10000 as target_id").union(p.where("k % 53 = 0").selectExpr("k + 20000"))
    return G.eligibility_audit(
        p.selectExpr("k as strategy", *of(STATES)), p.selectExpr("k as strategy", "k as artifact"), p.where("k % 8 > 0").selectExpr("k as strategy", *of(EVIDENCE)), p.where("k % 9 > 0").selectExpr("k as strategy", *of(APPROVALS)), gone
    )


def lifecycle(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three events a customer and the state that they give, with defects by key rules."""
    c = S.table(s, d, "customer").selectExpr("c_custkey as k")
    e = c.selectExpr("k as strategy", "explode(sequence(1, 3)) as i").selectExpr(
        "strategy", "strategy * 10 + i as event", "if(strategy % 11 = 0 and i = 2, 'x', 'a') as artifact", "i - 1 - int(strategy % 13 = 0 and i = 3) as expected", "i as resulting", "element_at(array('candidate', 'shadow', 'paper'), i) as from_stage",
        "if(strategy % 17 = 0 and i = 1, 'retired', element_at(array('shadow', 'paper', 'retired'), i)) as to_stage",
    )
    return e, c.where("k % 19 > 0").selectExpr("k as strategy", "'a' as artifact", "if(k % 7 = 0, 2, 3) as revision", "'retired' as stage", "k * 10 + 3 as last_event")


query(
    "lifecycle_replay_audit",
    """select k as strategy, 'missing_state' as code from (select c_custkey as k from customer) where k % 19 = 0 union all select k, 'artifact_differs' from (select c_custkey as k from customer) where k % 19 > 0 and k % 11 = 0 union all select k, 'revision_gap' from (select c_custkey as k from customer) where k % 19 > 0 and k % 13 = 0
    union all select k, 'stage_gap' from (select c_custkey as k from customer) where k % 19 > 0 and k % 17 = 0 and k % 11 > 0 union all select k, 'projection_differs' from (select c_custkey as k from customer) where k % 19 > 0 and k % 7 = 0""",
)(lambda s, d: G.lifecycle_replay_audit(*lifecycle(s, d)))
_trace = lambda concat: f"""case when row_no % 13 = 0 then 'not json' else '[' || '{{"stage": "strategy_decision", "metadata": {{"strategy_id": "' || case when row_no % 17 = 0 then ' ' else 's' || (row_no % 3) end || '", "strategy_version": "1", "direction": "' || case row_no % 5 when 0 then 'long' when 1 then 'short' when 2 then 'flat' when 3 then 'hold' else 'up' end || '", "intent_count": "' || case when row_no % 7 = 0 then 'many' else '' || (row_no % 4 - 1) end || '"}}}}, {{"stage": "other", "metadata": {{}}}}]' end"""
query(
    "strategy_health",
    f"""with {TICKS}, n as (select symbol, row_no, row_number() over (partition by symbol order by us desc, row_no desc) as r from ticks), e as (select symbol, row_no, row_no % 17 > 0 and row_no % 5 < 4 and row_no % 7 > 0 and row_no % 4 > 0 as good from n where r <= 500 and row_no % 6 > 0 and row_no % 13 > 0),
    m as (select symbol, case when good then 's' || (row_no % 3) end as strategy_id, case when good then '1' end as strategy_version, case when good then row_no % 5 end as x, case when good then row_no % 4 - 1 end as i from e)
    select symbol as workload, strategy_id, strategy_version, count(*) as decisions, {", ".join(f"count(*) filter (x = {i}) as n_{n}" for i, n in enumerate(("long", "short", "flat", "hold")))}, cast(coalesce(sum(i), 0) as bigint) as intents, count(*) filter (i > 0) as with_intent from m group by 1, 2, 3""",
)(
    lambda s, d: G.strategy_health(S.ticks(s, d).select(F.col("symbol").alias("workload"), F.col("row_no").alias("cycle"), F.col("us").alias("completed"), (F.col("row_no") % 6 == 0).alias("replayed"), F.expr(_trace(None)).alias("trace")), 500)
)
query(
    "decision_funnel",
    f"""{RISK}, t as (select rd.k, i.direction, i.status, approved, failed, k2 from rd join i using (k) left join (select k as k2 from i where k % 3 > 0) on k2 = rd.k),
    st as (select *, case when direction not in ('long', 'short') then 'FUSION_REJECTED' when not approved then 'RISK_REJECTED' when k2 is null then 'SIZING_REJECTED' else 'ORDER_CREATED' end as state from t),
    rs as (select state, case state when 'FUSION_REJECTED' then status when 'RISK_REJECTED' then split_part(failed, ',', 1) when 'SIZING_REJECTED' then 'missing' else 'created' end as reason from st) select state, reason, count(*) as n from rs group by rollup (state, reason)""",
)(
    lambda s, d: G.decision_funnel(
        intents(s, d).select(F.col("k").alias("id"), "direction", "status"), risk_(s, d).select(F.col("k").alias("id"), "approved", F.split("failed", ",")[0].alias("reason")), intents(s, d).where("k % 3 > 0").select(F.col("k").alias("id"), F.lit(1.0).alias("quantity"), F.lit(None).cast("string").alias("reason"))
    )
)
query(
    "risk_context",
    f"""with {bars_sql(HOUR)}, {DAYS}, it as (select row_no as id, symbol, (us // 3600000000) * 3600 as t, row_no % 50 as account from ticks), rg as (select symbol, bar as t, case when {OPEN} then 'active' else 'inactive' end as session from bars),
    mk as (select symbol, us // 1000000 as t, arg_max(bid, row_no) as bid from ticks group by 1, 2), bk as (select fill_id % 50 as account, (t - 757382400) // 86400 * 10 + 1704067200 as t, max(price) as equity from (select o_orderkey as fill_id, cast(floor(epoch(o_orderdate)) as bigint) as t, o_totalprice as price from orders) group by 1, 2),
    a as (select it.*, rg.session from it left join rg using (symbol, t)), b as (select a.*, mk.bid from a asof left join mk on a.symbol = mk.symbol and a.t >= mk.t) select b.id, session, bid, bk.equity from b asof left join bk on b.account = bk.account and b.t >= bk.t""",
)(lambda s, d: _context(s, d))


def _context(s: SparkSession, d: str) -> DataFrame:
    t = S.ticks(s, d)
    asked = t.select(F.col("row_no").alias("id"), "symbol", (F.floor(F.col("us") / 3_600_000_000) * 3600).alias("t"), (F.col("row_no") % 50).alias("account"))
    from barloom.functions.columns import session_open

    regimes = bars(s, d).select("symbol", "bar", F.when(session_open(F.col("bar")), "active").otherwise("inactive").alias("data_session"), *[F.lit("x").alias(c) for c in ("trend", "volatility", "liquidity")])
    quotes = t.groupBy("symbol", F.floor(F.col("us") / 1_000_000).alias("t")).agg(F.max_by("bid", "row_no").alias("bid"), F.max_by("ask", "row_no").alias("ask"))
    books = S.fills(s, d).groupBy((F.col("fill_id") % 50).alias("account"), (F.floor((F.col("t") - 757_382_400) / 86_400) * 10 + 1_704_067_200).alias("t")).agg(F.max("price").alias("equity"))
    health = t.groupBy(F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.lit("system").alias("node"), F.lit("ok").alias("state")).select("node", (F.col("day") * 86_400).alias("t"), "state")
    out = G.risk_context(asked, regimes, quotes, books, health)
    return out.select("id", F.col("regime.data_session").alias("session"), F.col("market.bid").alias("bid"), F.col("book.equity").alias("equity"))


# Streams

query("stream_ticks_to_bars", f"with {bars_sql(HOUR)} select symbol, bar, open, high, low, close, n from bars")(lambda s, d: B.replayed(s, d).withColumn("bar", F.unix_seconds("bar")))


def stream_ticks(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of ticks whose times go back by an hour in every ninth row."""
    from barloom.functions.columns import micros

    rows = B.events(s, d).select(F.col("event_type").alias("symbol"), micros("ts").alias("us"), F.col("event_id").alias("row_no"), F.col("value").alias("bid"))
    return rows.withColumn("us", F.col("us") - F.when(F.col("row_no") % 9 == 0, 3_600_000_000).otherwise(0))


query(
    "stream_late_ticks",
    f"""with {TICKS}, a as (select symbol, us - case when row_no % 9 = 0 then 3600000000 else 0 end as us, row_no, bid from ticks) select symbol, us, row_no, bid, coalesce(us <= max(us) over (partition by symbol order by row_no rows between unbounded preceding and 1 preceding), false) as late from a""",
)(lambda s, d: B.drained(B.stream_late_ticks(stream_ticks(s, d)), s))
query("stream_dedupe_bars", f"with {TICKS} select distinct symbol, us // 3600000000 * 3600 as bar from ticks")(
    lambda s, d: B.drained(B.stream_dedupe_bars(stream_ticks(s, d).select("symbol", F.timestamp_seconds(F.floor((F.col("us") + F.when(F.col("row_no") % 9 == 0, 3_600_000_000).otherwise(0)) / 3_600_000_000) * 3600).alias("bar")), "60 days"), s).select("symbol", F.unix_seconds("bar").alias("bar"))
)


def upserted(s: SparkSession, d: str, run) -> DataFrame:
    """Two cycles of the same stream into one table: the second adds nothing."""
    out = B.shared_path(s, "upsert")
    for cycle in (1, 2):
        run(out, f"{out}-state-{cycle}", cycle).awaitTermination()
    return s.read.parquet(out)


query("stream_upsert_bars", f"with {TICKS} select symbol, us // 3600000000 * 3600 as bar, min(row_no) as row_no from ticks group by 1, 2")(
    lambda s, d: upserted(s, d, lambda out, state, cycle: B.stream_upsert(B.micro_ticks(s, d).select("symbol", (F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("bar"), "row_no"), out, state, ["symbol", "bar"], "row_no"))
)
query("stream_decisions_once", f"with {TICKS} select distinct symbol, us // 86400000000 * 86400 as bar, case when row_no % 2 = 0 then 'a' else 'b' end as strategy, 1 as cycle from ticks")(
    lambda s, d: upserted(s, d, lambda out, state, cycle: B.stream_decisions_once(B.micro_ticks(s, d).select("symbol", (F.floor(F.unix_seconds("ts") / 86_400) * 86_400).alias("bar"), F.when(F.col("row_no") % 2 == 0, "a").otherwise("b").alias("strategy"), F.lit(cycle).alias("cycle")), out, state))
)
query(
    "stream_admission_gate",
    f"with {TICKS} select row_no, case when row_no % 10 = 0 then 'data_empty' when row_no % 8 = 0 then 'duplicate_bars' when row_no % 7 = 0 then 'data_stale' when row_no % 6 = 0 then 'quote_missing' end as reason from ticks",
)(
    lambda s, d: B.drained(
        B.stream_admission_gate(
            B.micro_ticks(s, d).select(
                "row_no", F.when(F.col("row_no") % 10 == 0, 0).otherwise(1).alias("rows"), F.lit(1).alias("scopes"), F.when(F.col("row_no") % 8 == 0, 1).otherwise(0).alias("duplicates"), F.lit(0).alias("incomplete"), F.when(F.col("row_no") % 7 == 0, 0).otherwise(1000).alias("latest"),
                F.when(F.col("row_no") % 6 > 0, F.col("bid")).alias("bid"), F.col("bid").alias("ask"), F.lit(1000).alias("quote_time"),
            ), F.lit(1000), 100,
        ).select("row_no", "reason"), s,
    )
)


def equity_changes(s: SparkSession, d: str) -> DataFrame:
    return B.events(s, d, "orders", by="o_orderdate").select(F.col("o_custkey").alias("account"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("delta"))


query(
    "stream_last_equity",
    f"""with {FILLS}, a as (select account, t, fill_id as seq, sum(case when side = 'sell' then price else -price end) over (partition by account order by t, fill_id) as equity from fills) select account, t, seq, round(equity, 2) as equity, round(max(equity) over (partition by account order by t, seq), 2) as high_water from a""",
)(lambda s, d: B.drained(B.stream_last_equity(equity_changes(s, d)), s).withColumns({c: F.round(c, 2) for c in ("equity", "high_water")}))


def bad_stream(s: SparkSession, d: str) -> DataFrame:
    """The two-sided stream with the malformed values of `bad_ticks`."""
    r = F.col("row_no")
    return B.two_sided(s, d).select(
        "symbol", "row_no", F.when(r % 3 == 0, F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000).otherwise(F.col("us")).alias("us"), F.when(r % 97 == 0, None).when(r % 89 == 0, F.lit(float("nan"))).when(r % 83 == 0, -F.col("bid")).otherwise(F.col("bid")).alias("bid"),
        F.when(r % 79 == 0, F.col("bid") - 1).otherwise(F.col("ask")).alias("ask"), F.when(r % 73 == 0, None).when(r % 71 == 0, F.lit(-1.0)).otherwise(F.col("bid_volume").cast("double")).alias("bid_volume"), F.col("ask_volume").cast("double").alias("ask_volume"),
    )


query("stream_valid_ticks", f"with {VALID_TICKS} select symbol, us, row_no, round(bid, 6) as bid, round(ask, 6) as ask, bid_volume, ask_volume from vt")(lambda s, d: B.drained(B.stream_valid_ticks(bad_stream(s, d)), s).withColumns({c: F.round(c, 6) for c in ("bid", "ask")}))
#: A batch drops what the watermark of the batch before it has passed: an hour behind the newest tick of the batches before that.
LATE = f"""{TICKS}, pt as (select *, floor((row_no - (select min(row_no) from ticks)) * 4 / (select max(row_no) - min(row_no) + 1 from ticks))::bigint + (row_no % 9 = 0)::int as k from ticks), mx as (select k, max(us) as top from pt group by 1),
  wm as (select a.k, max(b.top) - 3600000000 as mark from mx a left join mx b on b.k <= a.k - 2 group by 1), kp as (select pt.*, mark is null or (us // 3600000000 + 1) * 3600000000 > mark // 1000 * 1000 as kept from pt join wm using (k))"""
SIDES = ["open", "high", "low", "close", "volume", "ask_open", "ask_high", "ask_low", "ask_close", "ask_volume", "n", "spread_min", "spread_max"]


def delayed_bars(s: SparkSession, d: str) -> DataFrame:
    return B.drained(B.stream_quotes_to_bars(B.two_sided(s, d, delayed=9, closed=True)), s).where(F.col("symbol") != B.END)


query(
    "stream_quotes_to_bars",
    f"with {bars_sql(HOUR, LATE, 'kp').replace('from kp group by', 'from kp where kept group by')} select symbol, bar, {', '.join(f'round({c}, 6) as {c}' if c[:3] in ('ask', 'spr') and 'volume' not in c else f'cast({c} as bigint) as {c}' if 'volume' in c else c for c in SIDES)} from bars",
)(lambda s, d: delayed_bars(s, d).withColumns({c: F.round(c, 6) for c in SIDES if c[:3] in ("ask", "spr") and "volume" not in c}).select("symbol", "bar", *SIDES))
query("stream_late_counts", f"with {LATE} select symbol, count(*) as sent, count(*) filter (kept) as used, count(*) filter (not kept) as late from kp group by 1")(
    lambda s, d: S.ticks(s, d).groupBy("symbol").agg(F.count("*").alias("sent")).join(delayed_bars(s, d).groupBy("symbol").agg(F.sum("n").alias("used")), "symbol").withColumn("late", F.col("sent") - F.col("used"))
)

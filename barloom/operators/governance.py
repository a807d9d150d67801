"""Governance: content ids, lineage graphs, experiment audits, strategy eligibility, lifecycle replay, health and decision funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import discard, settled

from .gates import first_reason, reasons

# Content ids


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the hash of the parts in order; a null part differs from every text."""
    return F.concat(F.lit(f"{prefix}-"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]), 256))


def verify_stable_ids(rows: DataFrame, prefix: str, id_col: str, parts: list[str]) -> DataFrame:
    """Rows whose stored id is not the one that their content gives, with the expected id."""
    want = stable_id(prefix, *[F.col(p) for p in parts])
    return rows.withColumn("expected_id", want).where(~F.col(id_col).eqNullSafe(F.col("expected_id")))


def verify_governance_rows(rows: DataFrame, schema: str, required: list[str], keys: list[str]) -> DataFrame:
    """rows (payload JSON, stored_hash and key columns) with integrity: invalid_schema, hash_mismatch, key_mismatch or verified."""
    doc = F.from_json("payload", schema)
    rows = rows.withColumn("_doc", doc)
    lacks = reduce(lambda a, b: a | b, [F.col(f"_doc.{n}").isNull() for n in required])
    differs = reduce(lambda a, b: a | b, [~F.col(f"_doc.{n}").cast("string").eqNullSafe(F.col(n).cast("string")) for n in keys])
    told = F.when(F.col("_doc").isNull() | lacks, "invalid_schema").when(F.sha2("payload", 256) != F.col("stored_hash"), "hash_mismatch").when(differs, "key_mismatch").otherwise("verified")
    return rows.withColumn("integrity", told).drop("_doc")


# Lineage graphs


def lineage_build(entities: list[tuple[str, DataFrame, str, str | None, dict[str, tuple[str, str]]]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of entity tables, each (kind, table, id column, hash column or none, reference column -> (edge kind, kind of the target)).

    Node ids are kind:id; an edge goes from the row to what it refers to, and null references give none."""
    nodes, edges = [], []
    for kind, table, key, content, references in entities:
        name = F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
        nodes.append(table.select(name.alias("node_id"), F.lit(kind).alias("kind"), (F.col(content) if content else F.lit(None)).cast("string").alias("hash")))
        for column, (edge, target) in references.items():
            edges.append(table.where(F.col(column).isNotNull()).select(F.lit(edge).alias("kind"), name.alias("source"), F.concat(F.lit(f"{target}:"), F.col(column).cast("string")).alias("target")))
    return reduce(DataFrame.unionByName, nodes).distinct(), reduce(DataFrame.unionByName, edges).distinct()


def coloured(edges: DataFrame) -> DataFrame:
    """node, colour and dead of all nodes of edges (source, target). colour: of the node itself and all that reach it, the one with the highest rank (a hash); dead: a node without an edge in reaches it by the only way there is, so it lies on no cycle.

    Each round a node takes the best of its predecessors, of its colour so far and of one far ancestor, whose distance
    doubles: so a path or cycle of n nodes settles in about log2 n rounds, and paths with branches fast as a rule, as the colour
    itself is a shortcut to a far ancestor. Each round is a written table, and the one before it is removed."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("name"))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    before = edges.groupBy(F.col("target").alias("node")).agg(F.max(rank("source")).alias("p"), F.count("*").alias("n"))
    # sure: all nodes from here to the far ancestor have one edge in; ended: that ancestor has none.
    state = nodes.join(before, "node", "left").select("node", rank("node").alias("v"), F.coalesce("p.name", "node").alias("far"), (F.coalesce("n", F.lit(0)) < 2).alias("sure"), F.col("n").isNull().alias("ended"))
    state = settled(state, "colour")
    while True:
        come = edges.join(state.select(F.col("node").alias("source"), "v"), "source").groupBy(F.col("target").alias("node")).agg(F.max("v").alias("came"))
        far = state.select(F.col("node").alias("far"), F.col("v").alias("far_v"), F.col("far").alias("further"), F.col("sure").alias("far_sure"), F.col("ended").alias("far_ended"))
        top = state.select(F.col("node").alias("top"), F.col("v").alias("top_v"))
        met = state.withColumn("top", F.col("v.name")).join(far, "far").join(top, "top").join(come, "node", "left")
        new = settled(met.select("node", F.greatest("v", "far_v", "top_v", "came").alias("v"), F.col("further").alias("far"), F.expr("sure and far_sure").alias("sure"), F.col("far_ended").alias("ended"), F.col("v").alias("old")), "colour")
        discard(state)
        state = new
        if not new.where("v <> old").limit(1).count():
            return state.select("node", F.col("v.name").alias("colour"), F.expr("sure and ended").alias("dead"))


def lineage_cycles(edges: DataFrame) -> DataFrame:
    """node and cycle (the largest node of its component) of all nodes that lie on a directed cycle.

    Strongly connected components by colours: nodes of a component are reached by the same nodes, so they share a colour, and
    among the nodes of a colour, those that reach the colour's own node are its component. They are told by a colouring against
    the edges, whose colours cut what is left once more. A cycle of n nodes takes about 2 log2 n rounds, with the paths and trees
    that lead to or from it; what branches and joins again without a cycle is cut by random ranks, over several colourings."""
    left = settled(edges.select("source", "target").where("source <> target").distinct(), "edges")
    parts: list[DataFrame] = []
    while left.limit(1).count():
        # Nodes without an edge in or out lie on no cycle.
        both = left.select("source").intersect(left.select(F.col("target").alias("source")))
        kept = settled(left.join(both, "source", "left_semi").join(both.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target"), "edges")
        ends = lambda e, c: e.join(c.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(c.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target").where("a = b")
        inside = settled(ends(kept, coloured(kept).where("not dead")).select("source", "target", F.col("a").alias("of")), "inside")
        back = coloured(inside.select(F.col("target").alias("source"), F.col("source").alias("target")))
        nodes = inside.select(F.col("source").alias("node"), "of").union(inside.select("target", "of")).distinct()
        parts.append(settled(nodes.join(back, "node").where("of = colour").select("node", F.col("of").alias("cycle")), "part"))
        rest = settled(ends(inside, back.where("not dead")).where("a <> of").select("source", "target"), "edges")
        discard(left, kept, inside)
        left = rest
    # A component of one node is a cycle only by an edge to itself.
    loops = edges.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("cycle"))
    found = reduce(DataFrame.unionByName, parts, loops.limit(0))
    sized = found.groupBy("cycle").agg(F.count("*").alias("n"), F.max("node").alias("largest")).where("n > 1")
    return found.join(sized, "cycle").select("node", F.col("largest").alias("cycle")).union(loops).groupBy("node").agg(F.max("cycle").alias("cycle"))


def lineage_scope(edges: DataFrame, starts: DataFrame, depth: int, most: int, towards: bool = True) -> tuple[DataFrame, bool]:
    """(nodes (node, steps) within depth of the starts (node), nearest first, truncated): along edges, or against them. At most `most` nodes: the limit is the feature."""
    e = edges.select("source", "target") if towards else edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    seen = settled(starts.select("node").distinct().withColumn("steps", F.lit(0)), "scope")
    front = seen
    for step in range(1, depth + 1):
        front = settled(e.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("steps", F.lit(step)), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    kept = seen.orderBy("steps", "node").limit(most + 1)
    return kept.limit(most), kept.count() > most


def lineage_for(kind: str, edges: DataFrame, ids: DataFrame, depth: int = 10, most: int = 10_000, towards: bool = True) -> tuple[DataFrame, bool]:
    """Scope of the entities of a kind (strategy, experiment, dataset, ...) with these ids (id)."""
    return lineage_scope(edges, ids.select(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("node")), depth, most, towards)


# Experiments


def experiment_data_eligibility(experiments: DataFrame, datasets: DataFrame, slices: DataFrame, qualifications: DataFrame) -> DataFrame:
    """Per experiment (experiment, dataset, dataset_hash, slice, slice_hash, qualification, contaminated; null dataset is unbound): statuses of binding, dataset, slice and qualification, and the reasons that speak against it."""
    rows = experiments.join(datasets.select("dataset", F.col("hash").alias("d_hash")), "dataset", "left").join(slices.select("slice", F.col("hash").alias("s_hash")), "slice", "left")
    rows = rows.join(qualifications.select("qualification", F.col("dataset").alias("q_dataset"), "verdict"), "qualification", "left")
    c = F.col
    bound = c("dataset").isNotNull()
    same = lambda a, b: F.when(c(b).isNull(), "missing").when(c(a).eqNullSafe(c(b)), "verified").otherwise("hash_mismatch")
    rows = rows.withColumns({
        "binding_status": F.when(bound, "bound").otherwise("legacy_unbound"), "dataset_status": F.when(bound, same("dataset_hash", "d_hash")), "slice_status": F.when(bound, same("slice_hash", "s_hash")),
        "qualification_status": F.when(bound, F.when(c("verdict").isNull(), "missing").when(c("q_dataset") != c("dataset"), "scope_mismatch").otherwise(c("verdict"))), "oos_status": F.when(c("contaminated"), "contaminated").otherwise("pristine"),
    })
    why = reasons([
        ("EXPERIMENT_INPUT_BINDING_MISSING", ~bound), ("DATASET_NOT_VERIFIED", bound & (c("dataset_status") != "verified")), ("SLICE_NOT_VERIFIED", bound & (c("slice_status") != "verified")), ("DATASET_NOT_QUALIFIED", bound & (c("qualification_status") != "qualified")),
        ("CONTAMINATED_OOS", c("contaminated")),
    ])
    return rows.select("experiment", "binding_status", "dataset_status", "slice_status", "qualification_status", "oos_status", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("eligible"))


def experiment_registry_check(records: DataFrame, access: DataFrame) -> DataFrame:
    """Findings (id, code) of a registry: an id with different contents, and an access to the locked period whose parent is missing or not frozen."""
    conflicts = records.groupBy("id").agg(F.countDistinct("hash").alias("n")).where("n > 1").select("id", F.lit("conflicting_content").alias("code"))
    parents = records.groupBy(F.col("id").alias("parent")).agg(F.max("frozen").alias("frozen"))
    rows = access.join(parents, "parent", "left")
    code = F.when(F.col("frozen").isNull(), "missing_parent").when(~F.col("frozen"), "parent_not_frozen")
    return conflicts.unionByName(rows.select("id", code.alias("code")).where("code is not null"))


def oos_contamination(results: DataFrame) -> DataFrame:
    """Results (id, touched, influenced, selectable, decision) that are contaminated by the locked period, or whose flags contradict each other."""
    c = F.col
    code = F.when(c("influenced") & ~c("touched"), "influence_without_access").when(c("influenced") & (c("decision") != "invalid"), "contaminated_not_invalid").when(c("influenced"), "contaminated").when(c("touched") & c("selectable"), "selection_eligible_oos")
    return results.select("id", code.alias("code")).where("code is not null")


def experiment_lineage_check(runs: DataFrame, specs: DataFrame, fields: list[str], frozen: list[str]) -> DataFrame:
    """Runs (id and fields) that differ from their registered spec, and locked specs that differ from their frozen parent in any of the fields: id, code, sorted names of what differs."""
    def differing(rows: DataFrame, names: list[str], code: str, there: str) -> DataFrame:
        wrong = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"_{n}")), F.lit(n)) for n in names])))
        told = F.when(F.col(there).isNull(), F.array(F.lit("missing"))).otherwise(wrong)
        return rows.select("id", F.lit(code).alias("code"), F.array_join(told, ",").alias("fields")).where("fields <> ''")

    registered = specs.select(F.col("id").alias("_id"), *[F.col(n).alias(f"_{n}") for n in fields])
    one = differing(runs.join(registered, runs["id"] == F.col("_id"), "left"), fields, "run_differs_from_spec", "_id")
    parents = specs.select(F.col("id").alias("_id"), *[F.col(n).alias(f"_{n}") for n in frozen])
    locked = specs.where("locked").join(parents, specs["parent"] == F.col("_id"), "left")
    return one.unionByName(differing(locked, frozen, "locked_differs_from_parent", "_id"))


# Strategies


def eligibility_audit(states: DataFrame, artifacts: DataFrame, evidence: DataFrame, approvals: DataFrame, revocations: DataFrame) -> DataFrame:
    """Per strategy version (strategy): verdict and reason by sixteen ordered rules.

    states: strategy, stage, health, disabled. artifacts: strategy, artifact. evidence: strategy, evidence, e_artifact, oos,
    fixture, empirical, validation. approvals: strategy, approval, a_artifact, a_evidence, target. revocations: target_id."""
    gone = revocations.select("target_id").distinct()
    rows = states.join(artifacts, "strategy", "left").join(evidence, "strategy", "left").join(approvals, "strategy", "left")
    for name in ("evidence", "approval"):
        rows = rows.join(gone.select(F.col("target_id").alias(name), F.lit(True).alias(f"{name}_revoked")), name, "left")
    c = F.col
    has, told = c("evidence").isNotNull(), c("approval").isNotNull()
    # Reasons in order (fixed values); each is (verdict, reason, when).
    rules = [
        ("reject", "EVIDENCE_REVOKED", has & c("evidence_revoked").isNotNull()), ("reject", "APPROVAL_REVOKED", told & c("approval_revoked").isNotNull()), ("reject", "STRATEGY_HEALTH_FAILED", c("health") == "failed"), ("hold", "STRATEGY_DISABLED", c("disabled")),
        ("hold", "NOT_OPERATIONAL_STAGE", ~c("stage").isin("shadow", "paper")), ("hold", "MISSING_EVIDENCE", ~has), ("reject", "EVIDENCE_ARTIFACT_MISMATCH", ~c("e_artifact").eqNullSafe(c("artifact"))), ("reject", "CONTAMINATED_OOS", c("oos").eqNullSafe(F.lit("contaminated"))),
        ("hold", "OOS_STATUS_REQUIRED", ~c("oos").eqNullSafe(F.lit("pristine"))), ("reject", "FIXTURE_OR_EMPIRICAL_ELIGIBILITY_REQUIRED", c("fixture") | ~c("empirical")), ("reject", "VALIDATION_REJECTED", F.coalesce(c("validation").isin("kill", "invalid"), F.lit(False))),
        ("hold", "VALIDATION_VERDICT_UNAVAILABLE", c("validation").isNull()), ("hold", "VALIDATION_NOT_PASSED", c("validation") != "pass"), ("hold", "APPROVAL_REQUIRED", ~told),
        ("reject", "APPROVAL_SCOPE_MISMATCH", ~c("a_artifact").eqNullSafe(c("artifact")) | ~c("a_evidence").eqNullSafe(c("evidence"))), ("reject", "APPROVAL_SCOPE_MISMATCH", c("target") != c("stage")),
    ]
    verdict = first_reason([(f"{v}|{r}", when) for v, r, when in rules])
    return rows.select("strategy", F.coalesce(F.split(verdict, "[|]")[0], F.lit("allow")).alias("verdict"), F.split(verdict, "[|]")[1].alias("reason"))


def lifecycle_replay_audit(events: DataFrame, states: DataFrame) -> DataFrame:
    """Findings (strategy, code) of append-only events (strategy, event, artifact, expected, resulting, from_stage, to_stage) against the projected states (strategy, artifact, revision, stage, last_event).

    Revisions run from 0 by ones, each stage continues the one before (candidate first), and the last event gives the state."""
    w = Window.partitionBy("strategy").orderBy("resulting", "event")
    rows = events.join(states.select("strategy", F.col("artifact").alias("s_artifact")), "strategy", "left")
    before, stage = F.coalesce(F.lag("resulting").over(w), F.lit(0)), F.coalesce(F.lag("to_stage").over(w), F.lit("candidate"))
    rows = rows.withColumns({"before": before, "stage_before": stage})
    code = F.when(F.col("s_artifact").isNull(), "missing_state").when(F.col("artifact") != F.col("s_artifact"), "artifact_differs").when((F.col("expected") != F.col("before")) | (F.col("resulting") != F.col("before") + 1), "revision_gap").when(F.col("from_stage") != F.col("stage_before"), "stage_gap")
    steps = rows.select("strategy", code.alias("code")).where("code is not null").distinct()
    last = events.groupBy("strategy").agg(F.max_by(F.struct("event", "resulting", "to_stage"), F.struct("resulting", "event")).alias("x"))
    both = states.join(last, "strategy", "left")
    same = F.col("revision").eqNullSafe(F.coalesce("x.resulting", F.lit(0))) & F.col("stage").eqNullSafe(F.coalesce("x.to_stage", F.lit("candidate"))) & F.col("last_event").eqNullSafe(F.col("x.event"))
    return steps.unionByName(both.where(~same).select("strategy", F.lit("projection_differs").alias("code")))


TRACE = "array<struct<stage: string, metadata: struct<strategy_id: string, strategy_version: string, direction: string, intent_count: string>>>"


def strategy_health(cycles: DataFrame, most: int) -> DataFrame:
    """Signal counters per workload, strategy and version of the newest `most` cycles (workload, cycle, completed, replayed, trace JSON) of each workload: the bound is the feature. Replayed cycles fill the window but are not counted; malformed decisions are counted under a null strategy."""
    w = Window.partitionBy("workload").orderBy(F.desc("completed"), F.desc("cycle"))
    near = cycles.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= most) & ~F.col("replayed"))
    rows = near.select("workload", F.explode(F.from_json("trace", TRACE)).alias("e")).where("e.stage = 'strategy_decision'").select("workload", "e.metadata.*")
    n = F.expr("try_cast(intent_count as int)")
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    good = text("strategy_id") & text("strategy_version") & F.coalesce(F.col("direction").isin("long", "short", "flat", "hold"), F.lit(False)) & F.coalesce(n >= 0, F.lit(False))
    rows = rows.select("workload", *[F.when(good, F.col(c)).alias(c) for c in ("strategy_id", "strategy_version", "direction")], F.when(good, n).alias("intents"))
    return rows.groupBy("workload", "strategy_id", "strategy_version").agg(
        F.count("*").alias("decisions"), *[F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in ("long", "short", "flat", "hold")], F.coalesce(F.sum("intents"), F.lit(0)).alias("intents"), F.count_if(F.col("intents") > 0).alias("with_intent")
    )


def decision_funnel(fused: DataFrame, risk: DataFrame, sized: DataFrame) -> DataFrame:
    """Counts of decisions by terminal state and reason, with totals (null reason, null state): fused (id, direction, status), risk (id, approved, reason), sized (id, quantity, reason)."""
    rows = fused.join(risk.select("id", "approved", F.col("reason").alias("risk_reason")), "id", "left").join(sized.select("id", "quantity", F.col("reason").alias("size_reason")), "id", "left")
    c = F.col
    acts = c("direction").isin("long", "short")
    state = F.when(~acts, "FUSION_REJECTED").when(~F.coalesce("approved", F.lit(False)), "RISK_REJECTED").when(c("quantity").isNull(), "SIZING_REJECTED").otherwise("ORDER_CREATED")
    rows = rows.withColumn("state", state)
    reason = F.when(c("state") == "FUSION_REJECTED", c("status")).when(c("state") == "RISK_REJECTED", F.coalesce("risk_reason", F.lit("missing"))).when(c("state") == "SIZING_REJECTED", F.coalesce("size_reason", F.lit("missing"))).otherwise("created")
    return rows.withColumn("reason", reason).rollup("state", "reason").agg(F.count("*").alias("n"))


def risk_context(intents: DataFrame, regimes: DataFrame, quotes: DataFrame, books: DataFrame, health: DataFrame) -> DataFrame:
    """intents (id, symbol, account, t) with what was known then: the regime of exactly t, and the newest quote (symbol, t), book (account, t) and health (t, node) at or before t, as structs."""
    from .asof import nearest

    rows = intents.join(regimes.select("symbol", F.col("bar").alias("t"), F.struct("data_session", "trend", "volatility", "liquidity").alias("regime")), ["symbol", "t"], "left")
    rows = nearest(rows, quotes.select("symbol", "t", "bid", "ask"), found="market")
    rows = nearest(rows, books.select("account", "t", "equity"), by=("account",), found="book")
    return nearest(rows.withColumn("node", F.lit("system")), health.select("node", "t", "state"), by=("node",), found="health").drop("node")

"""Research operators: block bootstrap, walk-forward folds, period slices and audits of logs and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier and modulus of the generator that draws block starts (fixed values of a well-known Lehmer generator).
LEHMER, PRIME = 48271, 2147483647


def drawn(replication: Column, block: Column, seed: int) -> Column:
    """A reproducible draw below PRIME for each replication and block."""
    x = (replication * 1000003 + block * 7919 + seed) % PRIME
    for _ in range(3):
        x = x * LEHMER % PRIME
    return x


def sampled_blocks(series: DataFrame, value: Column, replications: int, block: int, seed: int) -> DataFrame:
    """(symbol, n, rep, total): the sum of value over each replication's blocks, by differences of running sums, so a
    replication has one row for each block and not for each observation. series: symbol, i (from 1), ret."""
    w = Window.partitionBy("symbol")
    sums = series.select("symbol", "i", F.sum(value).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    sums = sums.unionByName(series.select("symbol").distinct().select("symbol", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("upto")))
    sizes = series.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, block))
    reps = sizes.select("symbol", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replications - 1).cast("long"))).alias("rep"))
    slots = reps.select("symbol", "n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("slot"))
    slots = slots.withColumn("a", drawn(F.col("rep"), F.col("slot"), seed) % (F.col("n") - block + 1))
    slots = slots.withColumn("z", F.col("a") + F.least(F.lit(block).cast("long"), F.col("n") - F.col("slot") * block))
    ends = slots.join(sums.select("symbol", F.col("i").alias("z"), F.col("upto").alias("hi")), ["symbol", "z"]).join(sums.select("symbol", F.col("i").alias("a"), F.col("upto").alias("lo")), ["symbol", "a"])
    return ends.groupBy("symbol", "n", "rep").agg(F.sum(F.col("hi") - F.col("lo")).alias("total"))


def rank_value(value: str, p: float) -> Column:
    """Value of rank ceil(p n), one at least, of rows with rank r of m."""
    return F.max(F.when(F.col("r") == F.greatest(F.ceil(F.col("m") * p), F.lit(1)), F.col(value)))


def block_bootstrap_mean(series: DataFrame, replications: int, block: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Mean, interval and share of replications whose mean is not positive; series that are too short have nulls."""
    w = Window.partitionBy("symbol")
    means = sampled_blocks(series, F.col("ret"), replications, block, seed).select("symbol", (F.col("total") / F.col("n")).alias("m1"))
    ranked = means.withColumn("r", F.row_number().over(w.orderBy("m1"))).withColumn("m", F.count("*").over(w))
    tail = (1 - confidence) / 2
    told = ranked.groupBy("symbol").agg(rank_value("m1", tail).alias("lower"), rank_value("m1", 1 - tail).alias("upper"), F.avg((F.col("m1") <= 0).cast("double")).alias("p_nonpositive"))
    whole = series.groupBy("symbol").agg(F.count("*").alias("observations"), F.avg("ret").alias("avg"))
    return whole.join(told, "symbol", "left").select("symbol", "observations", F.when(F.col("lower").isNotNull(), F.col("avg")).alias("mean"), "lower", "upper", "p_nonpositive")


def block_bootstrap_paths(returns: DataFrame, replications: int, block: int, seed: int) -> DataFrame:
    """5th, 50th and 95th percentile of compounded returns and the share that loses; returns are above -1."""
    w = Window.partitionBy("symbol")
    ends = sampled_blocks(returns, F.log1p("ret"), replications, block, seed).select("symbol", F.expm1("total").alias("v"))
    ranked = ends.withColumn("r", F.row_number().over(w.orderBy("v"))).withColumn("m", F.count("*").over(w))
    return ranked.groupBy("symbol").agg(*[rank_value("v", p).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], F.avg((F.col("v") <= 0).cast("double")).alias("p_loss"))


def fold_schedule(start: Column, train: int, forward: int, folds: int, oos: Column, rolling: int | None = None, validation: int = 0, purge: int = 0, embargo: int = 0) -> Column:
    """Array of folds (fold, train_start, train_end, validation_end, test_start, test_end) of one plan; a plan whose last test would enter the locked period is refused: null.

    Each training is followed by a validation of that length, a purge and the test; the next fold begins an embargo later."""

    def one(i: Column) -> Column:
        end = start + train + i * (forward + embargo)
        first = start if rolling is None else end - rolling
        test = end + validation + purge
        return F.struct(i.alias("fold"), first.alias("train_start"), end.alias("train_end"), (end + validation).alias("validation_end"), test.alias("test_start"), (test + forward).alias("test_end"))

    made = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), one)
    fits = (start + train < oos) & (start + train + (folds - 1) * (forward + embargo) + validation + purge + forward <= oos)
    return F.when(fits, made)


def assign_folds(rows: DataFrame, schedules: DataFrame) -> DataFrame:
    """Role of each row (symbol, bar) in each fold of its symbol: train, validation or test; rows outside (purged ones too) are left out. A symbol has few folds."""
    both = rows.select("symbol", "bar").join(schedules, "symbol").select("symbol", "bar", F.explode("folds").alias("f"))
    inside = lambda a, z: (F.col("bar") >= F.col(f"f.{a}")) & (F.col("bar") < F.col(f"f.{z}"))
    role = F.when(inside("train_start", "train_end"), "train").when(inside("train_end", "validation_end"), "validation").when(inside("test_start", "test_end"), "test")
    return both.select("symbol", "bar", F.col("f.fold").alias("fold"), role.alias("role")).where("role is not null")


def fold_findings(folds: DataFrame) -> DataFrame:
    """Folds (symbol, fold, test_start, test_end) that are out of order or overlap the fold before them, or run outside the period (period_start, period_end)."""
    w = Window.partitionBy("symbol").orderBy("fold")
    rows = folds.withColumn("before", F.lag("test_end").over(w)).withColumn("earlier", F.lag("test_start").over(w))
    code = F.when(F.col("test_start") < F.col("earlier"), "out_of_order").when(F.col("test_start") < F.col("before"), "overlaps").when((F.col("test_start") < F.col("period_start")) | (F.col("test_end") > F.col("period_end")), "outside_period")
    return rows.select("symbol", "fold", code.alias("code")).where("code is not null")


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    """folds: symbol, fold, first_close, last_close of the test part. Mean and worst return, and how many folds lose."""
    ret = F.try_divide(F.col("last_close"), F.col("first_close")) - 1
    return folds.groupBy("symbol").agg(F.count("*").alias("folds"), F.avg(ret).alias("mean_return"), F.min(ret).alias("worst_return"), F.count_if(ret <= 0).alias("losing"))


def lineage_nodes(nodes: DataFrame, worst_first: list[str]) -> DataFrame:
    """One row a node_id: its worst status and whether its hashes differ."""
    rank = F.array_position(F.array(*map(F.lit, worst_first)), F.col("status"))
    return nodes.groupBy("node_id").agg(F.min_by("status", rank).alias("status"), (F.countDistinct("hash") > 1).alias("conflict"))


def lifecycle_audit(events: DataFrame, allowed: list[tuple[str, str]], first: str) -> DataFrame:
    """Events (id, seq, status, at) whose step from the status before is not allowed, or that do not begin with first."""
    w = Window.partitionBy("id").orderBy("seq", "status")
    rows = events.withColumn("before", F.lag("status").over(w)).withColumn("gap", F.col("seq") - F.coalesce(F.lag("seq").over(w), F.lit(0)) != 1)
    good = F.lit(False)
    for a, b in allowed:
        good = good | ((F.col("before") == a) & (F.col("status") == b))
    code = F.when(F.col("gap"), "revision_gap").when(F.col("before").isNull() & (F.col("status") != first), "bad_start").when(F.col("before").isNotNull() & ~good, "bad_transition")
    return rows.select("id", "seq", "before", "status", code.alias("code")).where("code is not null")


def revocation_as_of(events: DataFrame, revocations: DataFrame) -> DataFrame:
    """events (id, target, at) with whether the target is revoked at all and was revoked at the event's time."""
    first = revocations.groupBy("target").agg(F.min("revoked_at").alias("revoked_at"))
    return events.join(first, "target", "left").select("id", "target", F.col("revoked_at").isNotNull().alias("revoked_now"), F.coalesce(F.col("revoked_at") <= F.col("at"), F.lit(False)).alias("revoked_then"))


def verify_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Status of each artifact of a manifest (artifact, sha256, byte_size) against the files of the same columns, nothing left out on either side."""
    f = files.select("artifact", F.col("sha256").alias("got"), F.col("byte_size").alias("size"))
    both = manifest.join(f, "artifact", "full_outer")
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("got").isNull(), "missing").when(F.col("size") != F.col("byte_size"), "size_mismatch").when(F.col("got") != F.col("sha256"), "hash_mismatch").otherwise("verified")
    return both.select("artifact", status.alias("status"))


def registry_conflicts(rows: DataFrame) -> DataFrame:
    """Ids that were registered with different content."""
    return rows.groupBy("id").agg(F.countDistinct("hash").alias("versions"), F.count("*").alias("n")).where("versions > 1")

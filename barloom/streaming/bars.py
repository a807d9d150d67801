"""Stream operators: bars, late ticks, store writes by micro-batch, decisions once, admission and running equity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.columns import micros
from barloom.operators.gates import admission_gate
from barloom.sources.shared import shared_path


def stream_ticks_to_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of a streaming (or batch) frame symbol, ts, row_no, bid. A watermark drops ticks that come later than `late`; in append mode a bar comes out once the watermark has passed it."""
    order = F.struct("ts", "row_no")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    return grouped.agg(F.min_by("bid", order).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", order).alias("close"), F.count("*").alias("n")).select(
        "symbol", F.col("w.start").alias("bar"), "open", "high", "low", "close", "n"
    )


def stream_late_ticks(ticks: DataFrame) -> DataFrame:
    """Every tick (symbol, us, row_no, bid) with late: whether it is not later than one of its symbol that came before it. The state is the newest time of a symbol; a batch is read in source order."""
    schema = "symbol string, us long, row_no long, bid double, late boolean"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("row_no")
        newest = state.get[0] if state.exists else None
        before = rows.us.cummax().shift()
        if newest is not None:
            before = before.fillna(newest).clip(lower=newest)
        state.update((int(max(rows.us.max(), newest if newest is not None else rows.us.max())),))
        yield rows.assign(late=(rows.us <= before).fillna(False))[["symbol", "us", "row_no", "bid", "late"]]

    return ticks.groupBy("symbol").applyInPandasWithState(run, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def stream_dedupe_bars(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Bars (symbol, bar timestamp, ...) once a logical key, as long as the watermark remembers it."""
    return bars.withWatermark("bar", late).dropDuplicatesWithinWatermark(["symbol", "bar"])


def stream_upsert(rows: DataFrame, path: str, state: str, key: list[str], order: str) -> StreamingQuery:
    """Appends the rows of each micro-batch whose key the table at path lacks, the first by order of each key. A batch that is tried again finds its rows there."""

    def put(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), order).alias("x")).select("x.*")
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            first = first.join(spark.read.schema(batch.schema).parquet(path).select(*key), key, "left_anti")
        first.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def stream_decisions_once(decisions: DataFrame, path: str, state: str) -> StreamingQuery:
    """Records each decision key (symbol, bar, strategy) once, however often a cycle brings it."""
    return stream_upsert(decisions, path, state, ["symbol", "bar", "strategy"], "cycle")


def stream_admission_gate(batches: DataFrame, now: F.Column, most_age: int) -> DataFrame:
    """Candidate batches of a stream with the first reason that blocks them: rows are judged one by one, so no state is kept."""
    return admission_gate(batches, now, most_age)


#: So many neighbouring accounts are one group of the state; a power of two.
ACCOUNTS = 1024
LINE = np.dtype([("account", np.int64), ("equity", np.float64), ("peak", np.float64)])


def stream_last_equity(changes: DataFrame) -> DataFrame:
    """account, t, equity, high_water after each change (account, t, seq, delta) of a stream.

    The state of an account is its equity and peak. Neighbouring accounts, at most ACCOUNTS of them, are one group whose
    state is a sorted table: a call of Python for each account would cost more than the sums."""
    schema = "account long, t long, seq long, equity double, high_water double"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        rows = rows.assign(of=rows.account.fillna(0).astype("int64")).sort_values(["of", "t", "seq"], ignore_index=True)  # a missing account is a group of its own
        known = np.frombuffer(state.get[0], LINE) if state.exists else np.zeros(0, LINE)
        old = pd.DataFrame({"equity": known["equity"], "peak": known["peak"]}, index=known["account"])
        line = rows.groupby("of").delta.cumsum() + rows.of.map(old.equity).fillna(0.0)
        rows = rows.assign(equity=line, high_water=np.maximum(line.groupby(rows.of).cummax(), rows.of.map(old.peak).fillna(float("-inf"))))
        last = rows.drop_duplicates("of", keep="last").set_index("of")
        new = pd.DataFrame({"equity": last.equity, "peak": last.high_water}).combine_first(old).sort_index()
        table = np.zeros(len(new), LINE)
        table["account"], table["equity"], table["peak"] = new.index, new.equity, new.peak
        state.update((table.tobytes(),))
        yield rows[["account", "t", "seq", "equity", "high_water"]]

    grouped = changes.withColumn("accounts", F.shiftright("account", ACCOUNTS.bit_length() - 1)).groupBy("accounts")
    return grouped.applyInPandasWithState(run, schema, "lines binary", "append", GroupStateTimeout.NoTimeout)


def stream_valid_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks (symbol, us, row_no, bid, ask, bid_volume, ask_volume) of a stream that have no finding, as `valid_ticks` says. The state of a symbol is the time of its last tick in source order, valid or not, so the order is judged over micro-batches; a batch is read in source order."""
    names = ["symbol", "us", "row_no", "bid", "ask", "bid_volume", "ask_volume"]
    schema = "symbol string, us long, row_no long, bid double, ask double, bid_volume double, ask_volume double"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("row_no")
        before = rows.us.shift()
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((int(rows.us.iloc[-1]),))
        number = rows[names[3:]].astype(float)
        good = np.isfinite(number).all(axis=1) & (number.bid > 0) & (number.ask > 0) & (number.bid <= number.ask) & (number.bid_volume >= 0) & (number.ask_volume >= 0)
        yield rows[good & (before.isna() | (rows.us > before))][names]

    return ticks.select(names).groupBy("symbol").applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def stream_quotes_to_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Two-sided bars of a stream symbol, ts, row_no, bid, ask, bid_volume, ask_volume of valid ticks. Ticks whose bar the watermark has passed are dropped; n counts those that went in, so what a source sent less the sum of n was late."""
    order, spread = F.struct("ts", "row_no"), F.col("ask") - F.col("bid")

    def side(c: str, prefix: str) -> list[F.Column]:
        return [F.min_by(c, order).alias(f"{prefix}open"), F.max(c).alias(f"{prefix}high"), F.min(c).alias(f"{prefix}low"), F.max_by(c, order).alias(f"{prefix}close"), F.sum(f"{c}_volume").alias(f"{prefix}volume")]

    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    sides = [*side("bid", ""), *side("ask", "ask_"), F.count("*").alias("n"), F.min(spread).alias("spread_min"), F.max(spread).alias("spread_max")]
    rows = grouped.agg(*sides)
    return rows.select("symbol", F.unix_seconds("w.start").alias("bar"), *rows.columns[2:])


def drained(df: DataFrame, spark: SparkSession) -> DataFrame:
    """What a finite stream gives until it is drained, as a table in the shared folder."""
    out = shared_path(spark, "stream")
    df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


FILES = 4  # files of a micro-batch
END = "~"  # event type of the rows that close a source


def part_of(by: F.Column, first: int, last: int, parts: int) -> F.Column:
    """Which of so many equally wide ranges a number lies in."""
    return F.floor((by - first) * parts / (last - first + 1)).cast("int")


def batched(rows: DataFrame, part: F.Column, parts: int, tail: list[DataFrame] | None = None) -> DataFrame:
    """rows read as a stream of one micro-batch for each part (0 to parts - 1), in order; tail: further batches of FILES partitions each."""
    spark, out = rows.sparkSession, shared_path(rows.sparkSession, "source")
    marked = rows.withColumn("_part", part)
    for k in range(parts):
        marked.where(F.col("_part") == k).drop("_part").repartition(FILES).write.mode("append").parquet(out)
    for more in tail or []:
        more.write.mode("append").parquet(out)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(out)


def events(spark: SparkSession, sf_dir: str, name: str = "events", by: str = "event_id", parts: int = 4, delayed: int = 0, closed: bool = False) -> DataFrame:
    """A given table read as a stream of several micro-batches by ranges of a column. delayed: rows whose number it divides come a batch later. closed: two batches of END rows far in the future follow, so that the watermark passes all bars."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    number = F.col(by) if dict(rows.dtypes)[by] in ("int", "bigint") else F.unix_seconds(F.col(by).cast("timestamp"))
    first, last = rows.agg(F.min(number), F.max(number)).first()
    part = part_of(number, first, last, parts)
    if delayed:
        part = part + (number % delayed == 0).cast("int")
    value = {"event_type": F.lit(END), "event_id": F.col("id")}
    tail = [spark.range(0, FILES, 1, FILES).select(*[value.get(f.name, F.lit(f"2100-01-0{k} 00:00:00") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]) for k in (1, 3)] if closed else []
    return batched(rows, part, parts + bool(delayed), tail)


def micro_ticks(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return events(spark, sf_dir, **more).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("row_no"), F.col("value").alias("bid"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events drained as a stream of several micro-batches into bars, all of which the watermark passes."""
    return drained(stream_ticks_to_bars(micro_ticks(spark, sf_dir, closed=True)), spark).where(F.col("symbol") != END)


def two_sided(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = events(spark, sf_dir, **more)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("us"), F.col("event_id").alias("row_no"), F.col("value").alias("bid"), (F.col("value") + k / 10000).alias("ask"), k.alias("bid_volume"), (k + 1).alias("ask_volume"))

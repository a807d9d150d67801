"""Store operations on bars, features and audit tables, scopes and bounded listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import settled

#: Which timeframes an asset class may have (fixed values).
TIMEFRAMES = {"forex": ("15m", "1h", "4h", "1d"), "equity": ("1h", "1d"), "etf": ("1h", "1d")}


def supported_timeframe(asset_class: Column, timeframe: Column) -> Column:
    tests = [(asset_class == a) & timeframe.isin(*t) for a, t in TIMEFRAMES.items()]
    return F.coalesce(tests[0] | tests[1] | tests[2], F.lit(False))


def map_provider_symbol(rows: DataFrame, instruments: DataFrame, provider: str) -> DataFrame:
    """rows with provider_symbol of the instruments' map (symbol, provider_symbols); null where the provider has none. Instruments are a small dimension."""
    names = instruments.select("symbol", F.try_element_at("provider_symbols", F.lit(provider)).alias("provider_symbol"))
    return rows.join(F.broadcast(names), "symbol", "left")


def has_bar(keys: DataFrame, bars: DataFrame, key: list[str]) -> DataFrame:
    """keys with present: whether the store has a bar of that logical key."""
    return keys.join(bars.select(*key, F.lit(True).alias("present")).distinct(), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def market_bars(quotes: DataFrame, width: int, side: str) -> DataFrame:
    """Canonical bars of one side of two-sided bars: its OHLC and volume, the closing quotes, and the time from which these are known."""
    ohlc = [F.col(f"{side}_{n}").alias(n) for n in ("open", "high", "low", "close", "volume")]
    bid, ask = F.col("bid_close"), F.col("ask_close")
    return quotes.select("symbol", "bar", *ohlc, bid.alias("bid"), ask.alias("ask"), (ask - bid).alias("spread"), (F.col("bar") + width).alias("quote_time"))


FEATURE_KEY = ["symbol", "bar", "feature", "version", "parameters", "dataset"]


def upsert_features(stored: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(the store after a last-write-wins batch, the keys that are new). Of equal keys in the batch the last one by order stays."""
    last = batch.groupBy(*FEATURE_KEY).agg(F.max_by(F.struct("value", "status"), order).alias("x")).select(*FEATURE_KEY, "x.value", "x.status")
    kept = stored.select(*FEATURE_KEY, "value", "status").join(last.select(*FEATURE_KEY), FEATURE_KEY, "left_anti")
    return kept.unionByName(last), last.join(stored.select(*FEATURE_KEY), FEATURE_KEY, "left_anti").select(*FEATURE_KEY)


def query_features(features: DataFrame, dataset: str, start: int, stop: int, wanted: list[tuple[str, int]] | None = None) -> DataFrame:
    """Features of a dataset version with start <= bar <= stop (both inclusive), of the wanted names and versions if given."""
    rows = features.where((F.col("dataset") == dataset) & F.col("bar").between(start, stop))
    if wanted is not None:
        asked = features.sparkSession.createDataFrame(wanted, "feature string, version int")
        rows = rows.join(F.broadcast(asked), ["feature", "version"], "left_semi")
    return rows


def latest_feature(features: DataFrame) -> DataFrame:
    key = [c for c in FEATURE_KEY if c != "bar"]
    return features.groupBy(*key).agg(F.max_by(F.struct("bar", "value", "status"), "bar").alias("x")).select(*key, "x.*")


def latest_by_id(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write of each id, as audit tables are read back."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select(key, "x.*")


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends to an audit table; readers take the last write of an id with `latest_by_id`."""
    rows.write.mode("append").parquet(path)


def order_events(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with event_no, their place from 0 in a global order, in parallel: ranges are sorted apart and counted up.

    The order must be total, else ties are numbered as they come."""
    # Written first: two uses of one exchange may be coalesced differently, and then its partitions' numbers don't agree.
    ranged = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = sums.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    return inside.join(F.broadcast(base), "_part").withColumn("event_no", F.col("_i") + F.col("_base")).drop("_part", "_i", "_base")


def bounded_history(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The newest `most` rows of each key, numbered from 0 oldest first, and truncated: whether there are more. The limit is the feature."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    near = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most + 1)
    sizes = near.groupBy(by).agg(F.count("*").alias("_n"))
    rows = near.join(sizes, by).where(F.col("_r") <= most)
    return rows.withColumns({"place": F.least("_n", F.lit(most)) - F.col("_r"), "truncated": F.col("_n") > most}).drop("_r", "_n")


def subset_checks(rows: DataFrame, declared: str, supplied: str) -> DataFrame:
    """rows with missing (sorted names that are declared but not supplied) and covered."""
    left = F.array_sort(F.array_except(declared, supplied))
    return rows.withColumns({"missing": left, "covered": F.size(left) == 0})


def slice_by_period(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period (name, warm, start, stop; half-open) of a small table and symbol: how many rows are warm-up, how many are evaluated, and a hash of the evaluated ones.

    The hash is taken over hashes of days, so that no row holds a whole series."""
    p = F.broadcast(periods)
    both = rows.join(p, (rows["bar"] >= p["warm"]) & (rows["bar"] < p["stop"]))
    day = F.floor(F.col("bar") / 86_400).alias("day")
    row = F.sha2(F.concat_ws("|", "symbol", "bar", F.format_string("%.6f", "close")), 256)
    live = F.col("bar") >= F.col("start")
    days = both.groupBy("name", "symbol", day).agg(
        F.count_if(~live).alias("warm"), F.count_if(live).alias("live"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.when(live, row))), ""), 256).alias("hash")
    )
    found = F.array_sort(F.collect_list(F.when(F.col("live") > 0, F.struct("day", "hash"))))
    return days.groupBy("name", "symbol").agg(F.sum("warm").alias("warm_rows"), F.sum("live").alias("rows"), F.sha2(F.array_join(F.transform(found, lambda x: x["hash"]), ""), 256).alias("slice_hash"))


def split_scope(rows: DataFrame, development_end: int, locked_start: int, locked_end: int) -> DataFrame:
    """rows (start, stop) with scope: development, locked_oos, or crosses where a period reaches over the boundary or outside."""
    scope = F.when(F.col("stop") <= development_end, "development").when((F.col("start") >= locked_start) & (F.col("stop") <= locked_end), "locked_oos").otherwise("crosses")
    return rows.withColumn("scope", scope)

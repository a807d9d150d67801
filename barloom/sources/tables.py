"""Domain tables: how ticks, bars, fills and rule inputs come from parquet."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import micros, seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, us, row_no, bid, ask, bid_volume, ask_volume."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), micros("ts").alias("us"), F.col("event_id").alias("row_no"), F.col("value").alias("bid"), (F.col("value") + k / 10000).alias("ask"), k.alias("bid_volume"), (k + 1).alias("ask_volume")
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill_id, account, symbol, side, quantity, price, fee, t."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fill_id"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), (F.col("o_orderkey") % 9 + 1).alias("quantity"),
        F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 1000).alias("fee"), seconds("o_orderdate").alias("t"),
    )


def day_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, t, close: the last price of each day by order key."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.floor(seconds("o_orderdate") / 86_400) * 86_400).alias("t"), "o_orderkey", "o_totalprice")
    return rows.groupBy(F.col("o_orderpriority").alias("symbol"), "t").agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


def read_tick_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of CSV files with exactly the header timestamp,askPrice,bidPrice,askVolume,bidVolume; empty fields are null, extra or missing fields and other headers fail the read. Keeps the file name."""
    names = ["timestamp", "askPrice", "bidPrice", "askVolume", "bidVolume"]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path).withColumn("artifact", F.col("_metadata.file_path"))


def write_canonical_jsonl(df: DataFrame, path: str) -> None:
    """One JSON document a row with keys in order and decimals as text."""
    columns = [F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in sorted(df.dtypes)]
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.text(path)


def read_canonical_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Suffixes of files that text readers would decompress.
PACKED = r"[.](gz|bz2|deflate|snappy|lz4|zst|xz|lzo|Z)$"
BOM = b"\xef\xbb\xbf"


def preserve_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """artifact, sha256, byte_size of each file.

    Files are read as lines by splits, sorted by place and hashed as a stream, so memory holds a batch of lines and never a
    whole file. Line readers leave out line ends and a byte order mark; the file's size tells whether it has them. A
    compressed file is hashed as it is, which takes it into one row, as does a file without line ends: at most 2 GB of those.
    A file that changes while it is read fails the job. Spark lists no files of zero bytes, so they have no row."""
    meta = F.col("_metadata.file_path").alias("file")
    listed = spark.read.format("binaryFile").load(path)
    sizes = listed.select(meta, F.col("path").alias("artifact"), F.col("length").alias("byte_size"))
    packed = listed.select(meta, F.sha2("content", 256).alias("sha256")).where(F.col("file").rlike(PACKED))
    lines = spark.read.format("text").option("lineSep", "\n").load(path).select(
        meta, F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")
    ).where(~F.col("file").rlike(PACKED))

    def run(batches):
        file = None

        def told():
            left = size - total
            if left not in (0, 1, 3, 4):
                raise ValueError(f"{file} has {size} bytes, {total} were read")
            h = marked if left > 1 else plain
            h.update(b"\n" * (left % 3))
            return pa.RecordBatch.from_pydict({"file": [file], "sha256": [h.hexdigest()]})

        for batch in batches:
            files, sizes_, data = batch.column("file"), batch.column("size"), batch.column("line")
            ends = [*pa.compute.indices_nonzero(pa.compute.not_equal(files[1:], files[:-1])).to_pylist(), batch.num_rows - 1] if batch.num_rows else []
            at = 0
            for end in ends:
                name, body = files[end].as_py(), b"\n".join(data[at : end + 1].to_pylist())
                if name != file:
                    if file is not None:
                        yield told()
                    file, size, total, plain, marked = name, sizes_[end].as_py(), 0, hashlib.sha256(), hashlib.sha256(BOM)
                else:
                    body = b"\n" + body
                plain.update(body)
                marked.update(body)
                total, at = total + len(body), end + 1
        if file is not None:
            yield told()

    streamed = lines.repartition("file").sortWithinPartitions("file", "start", "n").select("file", "size", "line").mapInArrow(run, "file string, sha256 string")
    mark = F.sha2(F.lit(BOM), 256)  # a file of nothing else has no lines
    return sizes.join(streamed.unionByName(packed), "file", "left").select("artifact", F.coalesce("sha256", mark).alias("sha256"), "byte_size")

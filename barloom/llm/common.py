"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower case.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many ids are broadcast at most.
SMALL_IDS = 2_000_000
#: Most bytes of a batch that goes to a Python worker; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of lower-cased text in which every separator is a blank; bytes.split() then gives the words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder path below spark.checkpoint.dir. Where that is unset, a local folder serves a local master only: executors of a cluster would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/barloom-shared"
    return f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors. made: gets the table's path, for `sweep`."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def sweep(spark: SparkSession, made: list[str], *keep: DataFrame) -> None:
    """Deletes the tables of made but for keep: what is built on them has been written itself by now."""
    kept = {t._written_at for t in keep}
    for path in [p for p in made if p not in kept]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # each table has a folder of its own
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        made.remove(path)


def bounded_batches(df: DataFrame) -> None:
    """Batches of a few MB for Python workers: ten thousand whole documents a batch would fill the memory beside the heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What operators remember in a worker between their tasks: (owner, how to forget it).
HELD: list[tuple[str, Callable[[], None]]] = []


def give_back() -> None:
    """Gives memory that Arrow and the C library hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def begin(owner: str = "") -> None:
    """Called when a task begins: workers are used again by the next stage, which needs nothing of what another operator remembered."""
    for name, forget in [h for h in HELD if h[0] != owner]:
        forget()
        HELD.remove((name, forget))


def in_batches(df: DataFrame, run, schema, owner: str = "") -> DataFrame:
    """df.mapInArrow with bounded batches; workers give unused memory back at the end of each task, and forget what operators other than the owner remembered."""
    bounded_batches(df)

    def task(batches):
        begin(owner)
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def only(df: DataFrame, ids: DataFrame, how: str, small: int = SMALL_IDS, on: str = "id") -> DataFrame:
    """df semi- or anti-joined with ids, which are broadcast while they are few (counted first), else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= small else ids, on, how)


def with_groups(rows: DataFrame, key: str, *aggregates: F.Column, made: list[str] | None = None, groups_of: str = "n > 1", rows_of: str = "true") -> DataFrame:
    """rows with n and other aggregates of the rows of the same key; keys of a single row go.

    groups_of, rows_of: of which keys, by the aggregates, and which rows are wanted; all rows count in the aggregates.

    A key that holds over a thousandth of all grouped rows is joined by broadcast (there are a thousand of them at
    most), so that no task holds a hot key's rows; the others are joined by shuffle.
    """
    groups = written(rows.groupBy(key).agg(F.count("*").alias("n"), *aggregates).where("n > 1").where(groups_of), "groups", made)
    most = (groups.agg(F.sum("n")).first()[0] or 0) // 1000
    rows = rows.where(rows_of)
    hot, cold = groups.where(F.col("n") > most), groups.where(F.col("n") <= most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def lowered(text) -> F.Column:
    """A-Z lower-cased, all else kept; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_array(text) -> F.Column:
    """The words of lower-cased text as an array, on the JVM."""
    return F.filter(F.split(lowered(text), NON_WORD), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """The same words as bytes, in a task."""
    return (text or "").encode().translate(WORD_BYTES).split()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if len(column) else pa.array([], pa.large_string())
    column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches, most: int = 4 << 20, at: int = 1):
    """Slices of record batches of about most bytes of text (column number at), one row at least; memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
            give_back()

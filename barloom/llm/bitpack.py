"""Token ids in fixed-width bit-packed files (operator 9).

A file is a Parquet part that Spark writes, so that commits, retries and remote stores are Spark's business. Each of
its rows is one block: `payload` holds the ids of whole documents at the fewest bits that the vocabulary needs, bit
0 first; `doc_ids` and `offsets` (little-endian 64-bit, one offset more than documents) say where each document's ids
begin, so that any document, or any id, can be read without the ones before it; `least_id` and `largest_id` let readers
skip blocks by the files' statistics; `part` and `part_start` place the
block in the whole sequence, which is in ascending order of the document id. `bits` and `n_ids` make the block
self-describing.

Defined cases: null text is empty and holds only the end id; rows that share an id are all written, one after the
other; a null id comes first; other columns are ignored; a text of any length lies whole in one block.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import expand
from .common import HELD, chunks, in_batches, utf8
from .pretoken import classes, pieces
from .token_counts import byte_letters

MOST_PIECES = 300_000
SCHEMA = "part int, block int, part_start long, bits int, n_docs int, n_ids long, least_id long, largest_id long, doc_ids binary, null_ids binary, offsets binary, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop, without touching what lies before."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    at = np.arange(start, stop, dtype=np.int64) * bits
    first = int(at[0] >> 3) if stop > start else 0
    raw = np.frombuffer(payload[first : (stop * bits + 7) // 8] + bytes(8), np.uint8)
    byte = (at >> 3) - first
    value = np.zeros(stop - start, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class LibraryEncoder:
    """The tokenizers library, asked once for each different pre-token and directly for texts with special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = [byte_letters()[b] for b in range(256)]
        self.known: dict[str, tuple[int, ...]] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[int, ...]]:
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        known, model, letters = self.known, self.tokenizer.model, self.letters
        for t in texts:
            if t not in known:  # a pre-token goes straight to the library's merges
                known[t] = tuple([x.id for x in model.tokenize("".join([letters[b] for b in t.encode()]))])
        return [known[t] for t in texts]

    def chunk(self, column: pa.Array, table: np.ndarray) -> list[np.ndarray]:
        found, starts = pieces(*utf8(column), words=False, table=table)
        ids, edges = expand(found, self.encode(found.dictionary.to_pylist()))
        at = edges[starts]
        out = [ids[a:b] for a, b in zip(at, at[1:])]
        for s in self.specials:
            for i in np.flatnonzero(pc.match_substring(column.fill_null(""), s).to_numpy(zero_copy_only=False)):
                out[i] = np.array(self.whole(column[i].as_py()), np.uint32)
        return out


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    HELD.append(("token files", encoder.cache_clear))
    return LibraryEncoder(path)


def write_ids(df: DataFrame, out: str, path: str, vocabulary: int, end_id: int = 0, block_ids: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends end_id and writes the blocks to the folder out in ascending order of id_col."""
    bits = max(1, (vocabulary - 1).bit_length())
    table = df.sparkSession.sparkContext.broadcast(classes("tokenizers"))

    def run(batches):
        part, block, done = TaskContext.get().partitionId(), 0, 0
        docs, ids = [], []

        def row():
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            edges = np.concatenate([[0], np.cumsum(size)]).astype("<i8")
            named = np.array([d or 0 for d in docs], "<i8").tobytes()
            nulls = np.packbits([d is None for d in docs]).tobytes()
            known = [d for d in docs if d is not None]
            values = [part, block, done, bits, len(docs), int(edges[-1]), min(known, default=None), max(known, default=None), named, nulls, edges.tobytes(), pack(np.concatenate(ids), bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        i32, i64, raw = pa.int32(), pa.int64(), pa.binary()
        types = [i32, i32, i64, i32, i32, i64, i64, i64, raw, raw, raw, raw]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held = 0
        for chunk in chunks(batches):
            for doc, got in zip(chunk.column(0).to_pylist(), encoder(path).chunk(chunk.column(1), table.value)):
                docs.append(doc)
                ids.append(np.append(got, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= block_ids:
                    yield row()
                    block, done, docs, ids, held = block + 1, done + held, [], [], 0
        if docs:
            yield row()

    # The text's hash is part of the range, so that an id that many rows share is spread; a number beside it splits equal rows.
    ordered = df.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col).alias("_h"), F.monotonically_increasing_id().alias("_r"))
    ordered = ordered.repartitionByRange(F.col(id_col).asc(), "_h", "_r").sortWithinPartitions(id_col, "_h", "_r").select(id_col, text_col)
    in_batches(ordered, run, SCHEMA, "token files").write.parquet(out)


def read_documents(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                edges = np.frombuffer(r["offsets"], "<i8")
                ids = unpack(r["payload"], r["bits"], 0, r["n_ids"]).astype("<u4")
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8))[: r["n_docs"]].astype(bool)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null), pa.array([r["part"]] * r["n_docs"], pa.int32()),
                     pa.array(edges[:-1] + r["part_start"]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())],
                    [id_col, "part", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.parquet(out)
    # One row for each written partition, so its size is bounded by their number and not by the documents.
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.coalesce(F.sum("n").over(_before()), F.lit(0))).alias("base"))
    docs = in_batches(blocks, run, f"`{id_col}` long, part int, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select(id_col, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def _before():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def read_one(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of each document with this id. The files' statistics skip blocks that can't hold it, and only the slices asked for are unpacked, in the tasks."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                docs, edges = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["offsets"], "<i8")
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8))[: r["n_docs"]].astype(bool)
                for i in np.flatnonzero((docs == doc_id) & ~null):
                    ids = unpack(r["payload"], r["bits"], int(edges[i]), int(edges[i + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["ids"])

    blocks = spark.read.parquet(out).where((F.col("least_id") <= doc_id) & (F.col("largest_id") >= doc_id))
    return [np.frombuffer(r.ids, "<u4") for r in in_batches(blocks, run, "ids binary").collect()]

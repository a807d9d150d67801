"""Repeated byte strings by a depth-limited radix sort of suffixes (operator 11).

Every suffix is looked at through its first `length` bytes only, its window. Windows are sorted by most significant
digits, and a group that can't hold a repeat leaves after each pass. The first digit of a window is its anchor, the
32-byte string in it with the least hash; as neighbouring windows mostly have the same anchor, a run of them (a stretch)
travels as one record: anchor, digest of all its bytes, smallest document.

* Pass 1 groups stretches by anchor, then by digest. Equal stretches have the same windows, so of each only the smallest
  document's stays in the sort; a stretch alone with its anchor holds no repeat and leaves.
* Pass 2 sorts the windows of what is left by the digest of all their bytes. Equal groups are the repeated windows.

Documents are kept in chunks of a few MB, one row each. A chunk asks with its distinct keys, packed by range of the key,
and gets one byte for each of them back, so a string that stands in every document sends one record a chunk. An anchor
with many different stretches is dealt out by anchor and digest, and all its windows go to pass 2, where no key is hot.

Keys have 80 bits beside the range they lie in; equality of strings rests on these.

Defined cases: null text is empty and has nothing to remove; ids must be integers (what casts to long), a null id is
smaller than all others, rows that share an id remove nothing from each other; texts shorter than length stay whole;
other columns are ignored; a text of any length is one row of one chunk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_batches, shared_dir, utf8

GRAM = 32  # bytes of an anchor
PART = 64  # most windows of a stretch
STEP = 1 << 17  # windows that are hashed at a time
CHUNK_BYTES = 4 << 20
RANGE_KEYS = 400_000  # keys of a range, about
#: An anchor is hot with so many different stretches of a chunk, as a share of all of the chunk's, and overall.
HOT = 1 / 1000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
OWN, GONE, SORT = 0, 1, 2  # answers: nothing before it, all of it stands in a smaller document, go on sorting


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    x, n = raw.astype(np.uint64), 1
    while n < 8:  # eight bytes are one number
        x = x[:-n] << np.uint64(8 * n) | x[n:]
        n *= 2
    m = len(raw) - GRAM + 1
    return mixed(mixed(x[:m] + M3) + M2 * x[8 : 8 + m] + mixed((x[16 : 16 + m] ^ M1) * M3 + x[24 : 24 + m]))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours."""
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def digest(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of size bytes from each start on, put together from hashes of their grams."""
    last, out = start + size - GRAM, mixed(size.astype(np.uint64))
    for k in range(-(-int(size.max(initial=GRAM)) // GRAM)):
        out = mixed(out * M1 + hashes[np.minimum(start + GRAM * k, last)])
    return out


class Chunk:
    """The stretches of some documents that lie one after the other."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, raw: np.ndarray, length: int):
        self.ids, self.offs, self.raw, self.length = ids, offs, raw, length
        found = [x for at in range(0, len(raw) - length + 1, STEP) if len((x := self.stretches(at))[0])]
        self.start, self.windows, self.anchor, self.region = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
        self.doc = ids[np.searchsorted(offs, self.start, "right") - 1]

    def slice(self, at: int) -> np.ndarray:
        return grams(self.raw[at : at + STEP + self.length - 1])

    def stretches(self, at: int) -> tuple[np.ndarray, ...]:
        hashes = self.slice(at)
        low = least(hashes, self.length - GRAM + 1)
        inside = np.zeros(len(low) + 1, np.int32)  # windows that lie in one document
        a = np.clip(self.offs[:-1] - at, 0, len(low))
        b = np.maximum(a, np.clip(self.offs[1:] - self.length + 1 - at, 0, len(low)))
        np.add.at(inside, a, 1)
        np.add.at(inside, b, -1)
        inside = np.cumsum(inside[:-1]) > 0
        begins = inside.copy()
        begins[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
        start = np.flatnonzero(begins)
        stop = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True)) + 1
        n = -(-(stop - start) // PART)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(start, n) + PART * part
        windows = np.minimum(np.repeat(stop, n) - start, PART)
        return start + at, windows, mixed(low[start]), digest(hashes, start, windows + self.length - 1)

    def window_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digest of each window of these stretches (in order), and the stretch's place in which."""
        owner = np.repeat(np.arange(len(which)), self.windows[which])
        before = np.cumsum(self.windows[which]) - self.windows[which]
        at = self.start[which][owner] + np.arange(len(owner)) - before[owner]
        keys, order = np.zeros(len(at), np.uint64), np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(0, len(self.raw) + STEP, STEP))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                keys[order[a:b]] = digest(self.slice(k * STEP), at[order[a:b]] - k * STEP, np.full(b - a, self.length))
        return keys, owner


class Kinds:
    """Equal keys (a, then b) of a chunk, in order, each with its smallest document."""

    def __init__(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray):
        b = b >> np.uint64(16)  # what is sent of it
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        self.a, self.b, self.doc, self.first = a[new], b[new], doc[new], order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def packed(self, chunk: int, ranges: int):
        """A row for each range of a: its number, the chunk, and keys and documents at few bytes each."""
        where = (self.a >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        edges = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else []
        for s, e in zip(edges, np.append(edges[1:], len(where)) if len(where) else []):
            base = int(self.doc[s:e].min())
            doc = (self.doc[s:e].view(np.uint64) - np.uint64(base % (1 << 64))).astype("<u8")
            width = next(w for w in (1, 2, 4, 8) if w == 8 or int(doc.max()) < 1 << 8 * w)
            low = (self.a[s:e] & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield int(where[s]), chunk, base, width, low.tobytes(), self.b[s:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), doc.astype(f"<u{width}").tobytes()


ASK = "range int, chunk long, base long, width int, a binary, b binary, docs binary"


def answers(table: pa.Table) -> pa.Table:
    """One range: for each key sent GONE if a smaller document has it, else SORT if others of its a differ from it, else OWN."""
    rows = table.to_pylist()
    size = [len(r["a"]) // 4 for r in rows]
    a = np.concatenate([np.frombuffer(r["a"], "<u4") for r in rows])
    b = np.zeros((len(a), 8), np.uint8)
    b[:, :6] = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8).reshape(-1, 6)
    b = b.view("<u8").reshape(-1)
    doc = np.concatenate([(np.frombuffer(r["docs"], f"<u{r['width']}").astype(np.uint64) + np.uint64(r["base"] % (1 << 64))).view(np.int64) for r in rows])
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new_a = np.append(True, a[1:] != a[:-1])
    new = new_a | np.append(True, b[1:] != b[:-1])
    kind, group = np.cumsum(new) - 1, np.cumsum(new_a) - 1
    kinds = np.bincount(group[new])
    told = np.where(doc > doc[new][kind], GONE, np.where(kinds[group] > 1, SORT, OWN)).astype(np.uint8)
    out = np.empty_like(told)
    out[order] = told
    parts = np.split(out, np.cumsum(size)[:-1])
    return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "range": pa.array([r["range"] for r in rows], pa.int32()), "told": pa.array([p.tobytes() for p in parts], pa.binary())})


def asked(df: DataFrame, run, ranges: int, name: str) -> DataFrame:
    """The answers to what run sends, one row a chunk: all of its answers in the order of its keys."""
    told = in_batches(df, run, ASK, "suffixes").groupBy("range").applyInArrow(answers, "chunk long, range int, told binary")
    path = f"{shared_dir(df.sparkSession)}/{name}"
    told.write.parquet(path)
    told = df.sparkSession.read.schema("chunk long, range int, told binary").parquet(path)
    # A chunk has at most as many answers as stretches or windows of its own few MB.
    return told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("range", "told"))).alias("said")).select("chunk", F.col("said.told").alias(name)).hint("shuffle_hash")


def rows_of(batch: pa.RecordBatch, length: int):
    for r in batch.to_pylist():
        ids, size = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8")
        offs = np.concatenate([[0], np.cumsum(size)])
        yield r, Chunk(ids, offs, np.frombuffer(r["raw"], np.uint8), length)


def said(r: dict, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] or []), np.uint8)


def chunked(df: DataFrame, length: int, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Documents as chunks, a row each, written in buckets of the chunk's number so that later joins by it move no text."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in chunks(batches, CHUNK_BYTES):
            raw, offs = utf8(b.column(1))
            ids = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            c = Chunk(ids, offs, raw, length)
            kinds = Kinds(c.anchor, c.region, c.doc)
            anchor, many = np.unique(kinds.a, return_counts=True)
            hot = many >= max(8, HOT * len(kinds.a))
            values = [part << 33 | n, ids.astype("<i8").tobytes(), np.packbits(np.asarray(b.column(0).is_null())).tobytes(), np.diff(offs).astype("<i8").tobytes(), raw.tobytes(), len(kinds.a), anchor[hot].view(np.int64).tolist(), many[hot].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)
            n += 1

    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["chunk", "ids", "null_ids", "sizes", "raw", "kinds", "hot", "many"]
    made = in_batches(df.select(F.col(id_col).cast("long"), text_col), run, "chunk long, ids binary, null_ids binary, sizes binary, raw binary, kinds long, hot array<long>, many array<long>", "suffixes")
    name = f"barloom_chunks_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets, "chunk").option("path", f"{shared_dir(df.sparkSession)}/chunks").option("compression", "zstd").saveAsTable(name)
    table = df.sparkSession.table(name)
    table.schema  # resolved: the plan reads the files, the name is no longer needed
    df.sparkSession.sql(f"DROP TABLE {name}")
    return table


def repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, spans (array of start, stop: maximal runs of bytes covered by windows that also start in a document with a smaller id), kept (the other bytes)."""
    if length < GRAM:
        raise ValueError(f"windows have {GRAM} bytes at least")
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # Fewer buckets than shuffle partitions would make Spark deal the chunks out anew in each join.
    table = chunked(df, length, id_col, text_col, buckets=max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 26))
    sums = table.agg(F.sum("kinds")).first()[0] or 0
    # An anchor with a share of HOT overall has half of that in some chunks at least; 2 / HOT of them at most.
    hot = table.select(F.explode(F.arrays_zip("hot", "many")).alias("x")).groupBy("x.hot").agg(F.sum("x.many").alias("n")).where(F.col("n") >= max(64, HOT * sums / 2)).select("hot")
    hot = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot.collect()], np.int64).view(np.uint64)))
    ranges = int(max(64, sums // RANGE_KEYS))

    def first(c: Chunk) -> tuple[Kinds, np.ndarray]:
        """Keys of pass 1, and which of them have a hot anchor: these are dealt out by anchor and digest."""
        is_hot = np.isin(c.anchor, hot.value)
        kinds = Kinds(np.where(is_hot, mixed(c.anchor + c.region), c.anchor), c.region, c.doc)
        return kinds, is_hot[kinds.first]

    def second(c: Chunk, told: np.ndarray) -> tuple[Kinds, np.ndarray, Kinds, np.ndarray]:
        """Of pass 1 the keys and which go on; of pass 2 the keys, and the place in `which` of each window's stretch."""
        kinds, is_hot = first(c)
        which = kinds.first[(told == SORT) | is_hot & (told == OWN)]
        keys, owner = c.window_keys(which)
        return kinds, which, Kinds(keys, mixed(keys ^ c.anchor[which][owner]), c.doc[which][owner]), owner

    def ask(make):
        def run(batches):
            for batch in batches:
                for r, c in rows_of(batch, length):
                    rows = list(make(r, c).packed(r["chunk"], ranges))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

        types, names = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], [x.split()[0] for x in ASK.split(", ")]
        return run

    base = table.select("chunk", "ids", "sizes", "raw")
    one = asked(base, ask(lambda r, c: first(c)[0]), ranges, "one")
    two = asked(base.join(one, "chunk", "left"), ask(lambda r, c: second(c, said(r, "one"))[2]), ranges, "two")

    def run(batches):
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for batch in batches:
            for r, c in rows_of(batch, length):
                told = said(r, "one")
                kinds, which, windows, owner = second(c, told)
                whole = (told[kinds.of] == GONE) | (c.doc > kinds.doc[kinds.of])
                cover = np.zeros(len(c.raw) + 1, np.int32)
                np.add.at(cover, c.start[whole], 1)
                np.add.at(cover, (c.start + c.windows + length - 1)[whole], -1)
                # The smallest document's stretch may stand in it several times: all of them lose the same windows.
                gone = (said(r, "two")[windows.of] == GONE) | (c.doc[which][owner] > windows.doc[windows.of])
                if gone.any():
                    at = np.full(len(kinds.first), -1)
                    at[kinds.of[which]] = np.cumsum(c.windows[which]) - c.windows[which]
                    rest = np.flatnonzero(~whole & (at[kinds.of] >= 0))
                    n = c.windows[rest]
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hit = gone[np.repeat(at[kinds.of[rest]], n) + k]
                    start = (np.repeat(c.start[rest], n) + k)[hit]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length, -1)
                out = np.cumsum(cover[:-1]) > 0
                new = out.copy()  # where a span begins: spans end with their document
                new[1:] &= ~out[:-1]
                edge = c.offs[:-1][np.diff(c.offs) > 0]
                new[edge] = out[edge]
                stops = out.copy()
                stops[:-1] &= ~out[1:] | new[1:]
                begin, end = np.flatnonzero(new), np.flatnonzero(stops) + 1
                owners = np.searchsorted(begin, c.offs)
                doc = np.searchsorted(c.offs, begin, "right") - 1
                spans = pa.ListArray.from_arrays(pa.array(owners, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - c.offs[doc]), pa.array(end - c.offs[doc])], fields=list(span)))
                left = np.concatenate([[0], np.cumsum(~out)])[c.offs]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(c.ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(c.raw[~out].tobytes())]).cast(pa.binary())
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8))[: len(c.ids)].astype(bool)
                done = pa.RecordBatch.from_arrays([pa.array(c.ids, mask=null), pa.array(np.diff(c.offs)), spans, kept], [id_col, "n_bytes", "spans", "kept"])
                yield done

    joined = table.select("chunk", "ids", "null_ids", "sizes", "raw").join(one, "chunk", "left").join(two, "chunk", "left")
    return in_batches(joined, run, f"`{id_col}` long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary", "suffixes")


def oracle(table: str = "documents", length: int = 50) -> str:
    """DuckDB SQL: every window of every text, cut from blocks of the text's hex digits."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM {table}),
b AS (SELECT doc_id, g AS block, substr(h, (2 * g + 1)::BIGINT, {2 * (2000 + length - 1)}) AS x FROM t, LATERAL (SELECT unnest(generate_series(0, length(h) // 2 - 1, 2000)) AS g)),
w AS (SELECT doc_id, block + g AS pos, substr(x, (2 * g + 1)::BIGINT, {2 * length}) AS win FROM b, LATERAL (SELECT unnest(generate_series(0, least(1999, length(x) // 2 - {length}), 1)) AS g)),
f AS (SELECT win, min(doc_id) AS first_doc FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, pos FROM w JOIN f USING (win) WHERE first_doc < doc_id),
n AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {length} THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM n),
s AS (SELECT doc_id, k, min(pos) AS a, max(pos) + {length} AS z FROM i GROUP BY doc_id, k),
c AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
d AS (SELECT t.doc_id, sum(z - a) AS gone, count(*) AS n, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(z) + 1)::BIGINT) AS left_ FROM c JOIN t USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256 FROM t LEFT JOIN d USING (doc_id)"""

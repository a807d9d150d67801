"""Which tokens of two tokenizers cover the same bytes (operator 13).

Tokens are compared by where they end. At the current shift between the two arrays of ends, stretches in which tokens
match one to one are jumped over by probes of doubling length; where a probe fails, the two arrays are stepped to their
next common end, which closes an irregular group, and the shift becomes what it is there (`aligned_ends`).

Both tokenizers end a token before a blank that follows a character other than white space: the byte-level pattern
begins a new piece there, and no piece of the other vocabulary has a blank behind another character (checked when it is
loaded). Texts are cut into units at these places, and each worker encodes and aligns the units that it has not met lately,
laid end to end as one pair of arrays. A text's groups are those of its units one after the other.

How often each pair of ids is linked in the corpus is added up over all texts from the pairs that each text has. The
counts of all pairs (at most the product of the vocabularies) are broadcast while they are few, else joined.

Defined cases: null or empty texts, and texts that one of the tokenizers does not give back byte for byte, have no
tokens; repeated rows each count and each give a row; other columns are ignored; a text of any length is aligned whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitpack import LibraryEncoder
from .common import HELD, chunks, in_batches, utf8, written
from .pretoken import SPACE, classes, code_points
from .token_counts import byte_letters

#: Units that a worker remembers, and the longest of them in bytes.
MOST_UNITS, LONG_UNIT = 200_000, 128
#: So many pairs with their counts are broadcast at most (17 bytes each).
FEW_PAIRS = 4_000_000
#: So many different pairs a task adds up before it sends them on.
HELD_PAIRS = 2_000_000
BLANK = "▁"  # how pieces write a blank


def aligned_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For two ascending lists with the same last entry: how many entries of each lie up to each entry they share."""
    i = j = 0
    to_a: list[int] = []
    to_b: list[int] = []
    while i < len(a):
        begin, step, growing = i, 1, True
        shift = j - i
        while step:
            if a[i : i + step] == b[i + shift : i + shift + step] and i + step <= len(a):
                i += step
                step = step * 2 if growing else step // 2
            else:
                growing = False
                step //= 2
        if i > begin:
            to_a += range(begin + 1, i + 1)
            to_b += range(begin + shift + 1, i + shift + 1)
        j = i + shift
        if i < len(a) and a[i] != b[j]:  # an irregular group, up to the next common end
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
            to_a.append(i)
            to_b.append(j)
    return to_a, to_b


class PlainEncoder(LibraryEncoder):
    """Special strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.specials = []


class Aligner:
    """Two tokenizers, and what was found for units lately."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = PlainEncoder(path_a)
        byte = {c: b for b, c in byte_letters().items()}
        self.bytes_a = [b""] * self.a.tokenizer.get_vocab_size()
        for token, i in self.a.tokenizer.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("a piece has a blank behind another character: texts can't be cut into units")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(BLANK)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        #: Unit -> tokens of a and of b, groups, whether both give it back, its groups spelled out, its pairs as bytes.
        self.known: dict[str, tuple] = {}

    @property
    def pair_type(self) -> str:
        return "<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<u8"

    def learn(self, units: list[str], table: np.ndarray) -> list[tuple]:
        """Units, each a blank and what follows, laid end to end."""
        a = self.a.chunk(pa.array(units, pa.large_string()), table)
        b = [x or [self.blank] for x in self.b.encode([u[1:] for u in units], num_threads=1)]
        n_a, n_b = [len(x) for x in a], [len(x) for x in b]
        ids_a, ids_b = np.concatenate(a).astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, sum(n_b))
        raw = [u.encode() for u in units]
        said = b"".join(raw)
        good = [True] * len(units)
        if not said == b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())):
            good = [b"".join([self.bytes_a[i] for i in x]) == r == b"".join([self.bytes_b[i] for i in y]) for x, y, r in zip(a, b, raw)]
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        to_a, to_b = aligned_ends(ends_a.tolist(), ends_b.tolist())
        marks = np.union1d(ends_a, ends_b)  # between two of these one token of each covers the bytes: a link
        pairs = (ids_a[np.searchsorted(ends_a, marks)] * len(self.bytes_b) + ids_b[np.searchsorted(ends_b, marks)]).astype(self.pair_type)
        stops = np.cumsum([len(r) for r, g in zip(raw, good) if g])
        group = np.searchsorted(ends_a[np.array(to_a, np.int64) - 1], stops, "right").tolist() if len(stops) else []
        link = np.searchsorted(marks, stops, "right").tolist()
        said_a, said_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        spelled = [f"{said_a[p]}|{said_b[q]}" if i - p == j - q == 1 else ",".join(said_a[p:i]) + "|" + ",".join(said_b[q:j]) for p, i, q, j in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        pairs = pairs.tobytes()
        wide = np.dtype(self.pair_type).itemsize
        out, k, g0, l0 = [], 0, 0, 0
        for x, y, ok in zip(n_a, n_b, good):
            if not ok:
                out.append((0, 0, 0, False, b"", b""))
                continue
            g, l = group[k], link[k] * wide
            out.append((x, y, g - g0, True, ";".join(spelled[g0:g]).encode(), pairs[l0:l]))
            g0, l0, k = g, l, k + 1
        return out

    def units(self, units: list[str], table: np.ndarray) -> list[tuple]:
        new = [u for u in units if u not in self.known]
        fresh = dict(zip(new, self.learn(new, table))) if new else {}
        found = [fresh[u] if u in fresh else self.known[u] for u in units]
        if len(self.known) + len(fresh) > MOST_UNITS:
            self.known.clear()
        self.known.update((u, x) for u, x in fresh.items() if len(u) <= LONG_UNIT)
        return found


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    HELD.append(("alignment", aligner.cache_clear))
    return Aligner(path_a, path_b)


def units_of(column: pa.Array, table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of each text with a blank before it; where each text's units start (one more than texts)."""
    text = column.cast(pa.large_string()).fill_null("")
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
    raw, offs = utf8(pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", pa.large_string()), led))
    at, cp = code_points(raw)
    cls = table[cp]
    begins = cp == 32
    begins[1:] &= cls[:-1] != SPACE
    begins[np.searchsorted(at, offs[:-1][offs[:-1] < len(raw)])] = True
    begin = at[begins]
    edges = np.append(begin, len(raw)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
    return found.dictionary_encode(), np.searchsorted(begin, offs)


def smallest(values: np.ndarray) -> bytes:
    """One byte that says how wide the numbers are, then the numbers."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or values.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def align(df: DataFrame, path_a: str, path_b: str, spell: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (different links, sorted) and times (how often each). spell: groups as text too."""
    table = df.sparkSession.sparkContext.broadcast(classes("tokenizers"))
    kinds = [("row", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("groups", pa.string())]
    kinds = kinds if spell else kinds[:-1]

    def run(batches):
        known, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for part in chunks(batches):
            found, starts = units_of(part.column(1), table.value)
            each = known.units(found.dictionary.to_pylist(), table.value)
            n_a, n_b, n_groups, good, spelled, pairs = zip(*each) if each else [()] * 6
            which = found.indices.to_numpy()
            code = np.frombuffer(b"".join(pairs), known.pair_type)
            size = np.array([len(p) // np.dtype(known.pair_type).itemsize for p in pairs], np.int64)
            at = np.cumsum(size) - size
            bad = np.concatenate([[0], np.cumsum(~np.array(good, bool)[which])])[starts]
            counts = [np.concatenate([[0], np.cumsum(np.array(v, np.int64)[which])])[starts] for v in (n_a, n_b, n_groups, size)]
            rows = []
            for k, doc in enumerate(part.column(0).to_pylist()):
                mine = which[starts[k] : starts[k + 1]]
                if not len(mine) or bad[k + 1] > bad[k]:
                    rows.append((number, doc, 0, 0, 0, 0, "", b"", b"\1", "")[: len(kinds)])
                else:
                    n = size[mine]
                    flat = code[np.repeat(at[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    pair, times = np.unique(flat, return_counts=True)
                    told = b";".join([spelled[i] for i in mine.tolist()])
                    rows.append((number, doc, *(int(c[k + 1] - c[k]) for c in counts), hashlib.sha256(told).hexdigest(), pair.tobytes(), smallest(times), *([told.decode()] if spell else [])))
                number += 1
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])

    schema = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string" * spell
    return in_batches(df.select(F.col(id_col).cast("long").alias("id"), text_col), run, schema, "alignment")


def link_counts(aligned: DataFrame, pair_type: str, width_b: int) -> DataFrame:
    """Per pair: pair (a's id times width_b, and b's), n (links that hold it), best (whether no pair of the same b has more)."""

    def run(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(keys, sums):
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(sums[k : k + 100_000])], ["pair", "n"])

        for batch in batches:
            pair = np.frombuffer(b"".join(batch.column(0).to_pylist()), pair_type).astype(np.int64)
            times = np.concatenate([widened(t) for t in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros(0, np.int64)
            keys, place = np.unique(np.concatenate([keys, pair]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([sums, times])).astype(np.int64) if len(keys) else sums
            if len(keys) > HELD_PAIRS:
                yield from rows(keys, sums)
                keys, sums = keys[:0], sums[:0]
        yield from rows(keys, sums)

    sums = in_batches(aligned.select("pairs", "times"), run, "pair long, n long", "alignment").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = written(sums.withColumn("b", F.col("pair") % width_b), "counts")
    most = sums.groupBy("b").agg(F.max("n").alias("most"))  # at most a row for each id of b
    return sums.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", few: int = FEW_PAIRS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their b), count_sum (over links), groups_sha256."""
    both = aligner(path_a, path_b)
    pair_type, width_b = both.pair_type, len(both.bytes_b)
    aligned = written(align(df, path_a, path_b, id_col=id_col, text_col=text_col), "aligned")
    counts = written(link_counts(aligned, pair_type, width_b), "links")
    plain = ["id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() <= few:
        table = counts.toPandas().sort_values("pair")
        sent = df.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

        def run(batches):
            keys, n, best = sent.value
            for batch in batches:
                pairs = batch.column("pairs").to_pylist()
                at = np.searchsorted(keys, np.frombuffer(b"".join(pairs), pair_type).astype(np.int64))
                times = np.concatenate([widened(t) for t in batch.column("times").to_pylist()]) if pairs else np.zeros(0, np.int64)
                edge = np.concatenate([[0], np.cumsum([len(p) // np.dtype(pair_type).itemsize for p in pairs])]).astype(np.int64)
                sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[edge]) for v in (times * best[at], times * n[at])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), batch.column("groups_sha256")], names)

        names = [*plain, "n_best", "count_sum", "groups_sha256"]
        out = in_batches(aligned.drop("row"), run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names), "alignment")
    else:

        def opened(batches):
            for batch in batches:
                pairs = batch.column("pairs").to_pylist()
                flat = np.frombuffer(b"".join(pairs), pair_type).astype(np.int64)
                row = np.repeat(batch.column("row").to_numpy(), [len(p) // np.dtype(pair_type).itemsize for p in pairs])
                times = np.concatenate([widened(t) for t in batch.column("times").to_pylist()]) if pairs else np.zeros(0, np.int64)
                for k in range(0, len(flat), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 100_000]) for v in (row, flat, times)], ["row", "pair", "times"])

        flat = in_batches(aligned.select("row", "pairs", "times"), opened, "row long, pair long, times long", "alignment")
        sums = flat.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        none = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_best", "count_sum")}
        out = aligned.drop("pairs", "times").join(sums, "row", "left").withColumns(none).select(*plain, "n_best", "count_sum", "groups_sha256")
    return out.withColumnRenamed("id", id_col)

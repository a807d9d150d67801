"""Language identification by prediction by partial matching (operator 3).

Each language has a variable-order context tree over bytes: counts of the byte after contexts of 0 to 3 bytes. An
unseen byte escapes to the next shorter context with probability d / (n + d) (n bytes, d different ones seen), seen
bytes being excluded there, and from order 0 to order -1, where all symbols are equally likely; so the probabilities
of a context add up to one. The counts are frozen after training; a text's score under a language is its exact code
length in bits.

All contexts that the sample has are kept. A byte that a language has not seen after a context costs the escapes down
to the context that has it and the code length there, so the frozen trees are two tables: code lengths of the
(context, symbol) pairs that some language has seen, and summed escapes of a context down to a shorter one. Scoring
is a few gathers a byte, whatever the number of contexts.

Texts are read in lower case, with every ASCII byte that is no letter as a blank: 155 symbols. Training takes at most
`per_language` whole documents of each language, those with the smallest hash of the id: a bounded, documented sample.

Defined cases: null text, or text without a letter, is `und` with score 0, and so is all text where nothing could be
learned; equal code lengths give the first language in order; rows without a language are never trained on; other
columns are ignored or kept as they are; repeated rows each give a row, null ids too; texts of any length are scored
whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, bounded_batches, chunks, give_back, in_batches, utf8

ORDER = 3
#: So many languages' sizes are broadcast at most.
SMALL = 10_000
#: What `plain` leaves of bytes: a blank, a-z, and what is not ASCII.
SYMBOLS = [32, *range(97, 123), *range(128, 256)]
SIZE = len(SYMBOLS)
SYMBOL = np.zeros(256, np.int32)
SYMBOL[SYMBOLS] = np.arange(SIZE)


@dataclass
class Model:
    languages: list[str]
    page: np.ndarray  # the two symbols before -> row of pages
    pages: np.ndarray  # (row, third symbol before) -> longest known context
    row: np.ndarray  # (context, symbol) -> row of bits
    level: np.ndarray  # (context, symbol) -> order at which that row stands, plus one
    bits: np.ndarray  # (row, language) -> code length
    escapes: np.ndarray  # (context, level) -> bits of the escapes down to the level, by language


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with blanks for ASCII bytes that are no letters, and offsets."""
    raw, offs = utf8(pc.utf8_lower(column))
    keep = np.arange(256)
    keep[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]
    return keep.astype(np.uint8)[raw], offs


def before(symbols: np.ndarray, offs: np.ndarray, blank: int) -> list[np.ndarray]:
    """The one, two and three symbols before each place; before a document stand blanks."""
    first = offs[:-1][np.diff(offs) > 0]
    out, now = [], symbols
    for _ in range(ORDER):
        moved = np.empty_like(now)
        moved[:1], moved[1:] = blank, now[:-1]
        moved[first] = blank
        out.append(moved)
        now = moved
    return out


def counts(df: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): how often each context and byte occur in the sample; a gram is its order and its bytes."""
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "id")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    # Three times the wanted share by hash comes first, so that a language's window sees about 3 * per_language rows at any size.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    near = rows.withColumn("h", F.xxhash64("id")).join(sizes, "lang").where(F.pmod("h", F.lit(1 << 40)).cast("double") * F.col("size") < float(3 * per_language << 40))
    sample = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)

    def run(batches):
        for part in chunks(batches, 1 << 20):
            raw, offs = plain(part.column(1))
            prev, langs = before(raw, offs, 32), np.array(part.column(0).to_pylist(), object)
            owner = np.repeat(np.arange(len(langs)), np.diff(offs))
            gram = raw.astype(np.int64)
            for k in range(ORDER + 1):
                if k:
                    gram = gram | prev[k - 1].astype(np.int64) << 8 * k
                for lang in sorted(set(langs)):
                    key, n = np.unique(gram[langs[owner] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key | k << 40), pa.array(n)], ["lang", "gram", "n"])

    return in_batches(sample.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Counts of one language: context (order, bytes) -> byte -> count."""

    def __init__(self):
        self.seen: dict[tuple[int, int], dict[int, int]] = {}
        self.lost: dict[tuple[int, int], float] = {}

    def escape(self, k: int, context: int) -> float:
        """Factor between the probabilities of unseen bytes after a context and after the next shorter one."""
        at = self.seen.get((k, context))
        if at is None:
            return 1.0
        if (k, context) not in self.lost:
            n, kinds = sum(at.values()), len(at)
            rest = 1 - sum(self.probability(k - 1, shorter(k, context), b) for b in at)
            self.lost[k, context] = kinds / (n + kinds) / rest if kinds < SIZE else 0.0
        return self.lost[k, context]

    def probability(self, k: int, context: int, byte: int) -> float:
        """Of a byte after a context of k bytes; k = -1: any symbol."""
        if k < 0:
            return 1 / SIZE
        at = self.seen.get((k, context))
        if at is None or byte not in at:
            return self.escape(k, context) * self.probability(k - 1, shorter(k, context), byte)
        return at[byte] / (sum(at.values()) + (len(at) if len(at) < SIZE else 0))


def shorter(k: int, context: int) -> int:
    """The context without its oldest byte."""
    return context & (1 << 8 * (k - 1)) - 1 if k > 0 else 0


def trees(rows) -> dict[str, Tree]:
    out: dict[str, Tree] = {}
    for lang, gram, n in zip(rows["lang"], rows["gram"].tolist(), rows["n"].tolist()):
        k, gram = gram >> 40, gram & (1 << 40) - 1
        out.setdefault(lang, Tree()).seen.setdefault((k, gram >> 8), {})[gram & 255] = n
    return dict(sorted(out.items()))


def build(rows) -> Model:
    found = trees(rows)
    forest = list(found.values())
    names = sorted({c for t in forest for c in t.seen})
    number = {c: i for i, c in enumerate(names)}
    bits: list[list[float]] = [[np.log2(SIZE)] * len(forest)]
    row, level = np.zeros((len(names), SIZE), np.int32), np.zeros((len(names), SIZE), np.uint8)
    escapes = np.zeros((len(names), ORDER + 2, len(forest)))
    pages2 = np.zeros((SIZE, SIZE), np.int64)  # longest known context of two symbols at most
    for i, (k, c) in enumerate(names):
        if k:
            j = number[k - 1, shorter(k, c)]
            row[i], level[i], escapes[i] = row[j], level[j], escapes[j]
        lost = np.array([t.escape(k, c) for t in forest])
        escapes[i, : k + 1] -= np.log2(np.where(lost > 0, lost, 1.0))
        escapes[i, k + 1 :] = 0
        for byte in sorted({b for t in forest for b in t.seen.get((k, c), ())}):
            row[i, SYMBOL[byte]], level[i, SYMBOL[byte]] = len(bits), k + 1
            bits.append([-np.log2(t.probability(k, c, byte)) for t in forest])
        a, b = SYMBOL[c & 255], SYMBOL[c >> 8 & 255]
        if k == 1:
            pages2[:, a] = i
        elif k == 2:
            pages2[b, a] = i
    third = [(c, i) for c, i in number.items() if c[0] == ORDER]
    heads = sorted({shorter(ORDER, c) for (_, c), _ in third})
    page = np.zeros((SIZE, SIZE), np.int32)
    plain_pages = np.unique(pages2)  # a page for each shorter context that stands alone, then one for each with longer ones
    page[:] = np.searchsorted(plain_pages, pages2)
    pages = [np.full(SIZE, i) for i in plain_pages]
    for c in heads:
        a, b = SYMBOL[c & 255], SYMBOL[c >> 8]
        pages.append(np.full(SIZE, pages2[b, a]))
        page[b, a] = len(pages) - 1
    for (_, c), i in third:
        pages[page[SYMBOL[c >> 8 & 255], SYMBOL[c & 255]]][SYMBOL[c >> 16]] = i
    flat = lambda x: x.reshape(-1, len(forest)).astype(np.float32)
    return Model(list(found), page.reshape(-1), np.array(pages, np.int32).reshape(-1), row.reshape(-1), level.reshape(-1), flat(np.array(bits)), flat(escapes))


def train(df: DataFrame, per_language: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The frozen trees, or None if no row has text and a language."""
    rows = counts(df, per_language, id_col, text_col, lang_col).toPandas()
    return build(rows) if len(rows) else None


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """Bits of each text under each language."""
    raw, offs = plain(column)
    sym = SYMBOL[raw]
    p1, p2, p3 = before(sym, offs, 0)
    context = model.pages[model.page[p2 * SIZE + p1] * SIZE + p3]
    at = context * SIZE + sym
    row, escaped = model.row[at], context * (ORDER + 2) + model.level[at]
    out = np.empty((len(column), len(model.languages)))
    ends = np.zeros(len(raw) + 1)
    for k in range(len(model.languages)):
        np.cumsum(model.bits[row, k] + model.escapes[escaped, k], dtype=np.float64, out=ends[1:])
        out[:, k] = ends[offs[1:]] - ends[offs[:-1]]
    return out


def parts(column: pa.Array, most: int):
    """Slices of about so many text bytes, one row at least."""
    _, offs = utf8(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
        yield column.slice(start, stop - start)
        start = stop


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns of keep, lang_pred, score (probability of the best language under equal priors).

    Only the text goes to the workers; the other columns stay on the JVM."""
    frozen = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def told(texts: pa.Array, known: pa.Array) -> pa.Array:
        begin("language")
        model, names, scores = frozen.value, [], []
        for part in parts(texts, 1 << 20):
            first = len(names)
            ok = known.slice(first, len(part)).to_numpy(zero_copy_only=False)
            if model is None:
                names += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            bits = code_lengths(model, part)
            best = bits.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            names += [model.languages[b] if k else "und" for b, k in zip(best, ok)]
            scores += np.where(ok, score, 0.0).tolist()
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    bounded_batches(df)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # Not deterministic for the optimizer only: a filter on the result would work it out twice.
    got = df.select(id_col, *keep, told.asNondeterministic()(F.col(text_col), letters).alias("_told"))
    return got.select(id_col, *keep, "_told.lang_pred", "_told.score")

"""Substring dedup with compact windows (operator 5).

Tokens are 5-word shingles. Two ranges of at least `words` words with similarity (shared tokens over all tokens of both)
of at least `similar` share an unbroken run of `seed_length` tokens (21 for 50 words and 0.8): each break between runs costs
8 tokens at least. Tokens have hash values; a compact window (l, c, r) stands for all token ranges that lie in l..r, contain c
and so have their smallest value at c. They are the nodes of the Cartesian tree over the values, found by splitting at
the minimum; windows of at least `seed_length` tokens are kept. Texts that share a run have windows around its minimum,
and as the run reaches 10 tokens to the left or to the right of it, they agree in the 11 tokens of that side: the keys.

First step: the smallest document of a key is the source of the others. Pairs are verified exactly: tokens that agree on a
diagonal of a shared run, or near it, are chained, and the longest ranges that are long and similar enough are passages.
Second step: a smaller document that has only a part of a passage may have taken the key of two larger ones. Where such a
key's run is left uncovered by passages, all unbroken runs of 46, 33 and 21 tokens around it are keys themselves, with
the smallest document that has the run as source. A run of 46 tokens is a passage of 50 words, so exact repeats are all
found; if its source is new to one document, all others of the run meet it as well, so that one source holds them all.
Third step: each of the runs of a similar passage may stand in smaller documents that do not share it. So all documents of
a key that no common source holds together (each has a passage with it over the key) are compared with one another, if the
tokens around the key allow a passage over it: they agree in a run of 21 tokens around the key, and of the 102 tokens before
it and behind it so many stand in the other document as well, at most 22 places further, that a range around the key can be
long and similar enough (an upper bound, so exact). This is told for blocks of places of a key at once, and only what passes
becomes a row. Places of a key that follow one another (a word repeated many times) are one place; their surroundings are
compared as sets, and a passage has to begin and end with a token that both have.
So two documents with a passage are a row, or both have a passage over the same key with one source, which stands for both.

Texts that are equal as a whole are looked at once; each copy is a passage of its first document. Passages inside one
document are left alone. Ids of documents are broadcast only up to `small` of them (counted first), else joined by
shuffle.

Result: one row for each passage of a later document: id, first_word, last_word, source id, source_first, similarity.

Defined cases: null, empty and short texts have no passage; rows without an id are left alone; rows that share an id
and a text are one document; rows that share only an id are taken as copies of the id and matched with one another;
other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, chunks, in_batches, only, sweep, with_groups, words_of, written

SHINGLE = 5
#: Odd multipliers of a 64-bit mixer, and of the positions in a shingle (fixed values).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Places of a key are compared in blocks of about so many.
BLOCK = 256
#: From so many tokens on the windows come from one pass with a stack, whose time does not depend on the values.
LONG = 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[0])
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX[1])
    return x ^ x >> np.uint64(31)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles."""
    words = words_of(text)
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = mixed(out * np.uint64(STEP) + h[k : k + n])
    return out


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the Cartesian tree's nodes that span at least so many tokens; of equal minima the first is the root."""
    out = []
    if len(values) < LONG:
        todo = [(0, len(values))]
        while todo:
            l, r = todo.pop()
            if r - l >= least:
                c = l + int(values[l:r].argmin())
                out.append((l, c, r - 1))
                todo.append((l, c))
                todo.append((c + 1, r))
        return out
    stack, left = [], np.zeros(len(values), np.int64)
    line = values.tolist()
    for i, v in enumerate([*line, -1]):
        while stack and line[stack[-1]] > v:
            c = stack.pop()
            if i - left[c] >= least:
                out.append((int(left[c]), c, i - 1))
        if i < len(line):
            left[i] = stack[-1] + 1 if stack else 0
            stack.append(i)
    return out


def seed_length(least: int, similar: float) -> int:
    """Tokens of the longest unbroken run that two similar ranges of at least so many tokens share at least."""
    shared = math.ceil(least * 2 * similar / (1 + similar) - 1e-9)
    breaks = 1
    best = shared
    while similar < 1 and breaks <= least:
        best = min(best, math.ceil(max(shared, 2 * (SHINGLE - 1) * breaks * similar / (1 - similar)) / (breaks + 1) - 1e-9))
        breaks += 1
    return max(1, best)


def runs(tokens_: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ranges of so many tokens, by ranges of doubling length, of which the last two may overlap."""
    out, size = mixed(tokens_ ^ np.uint64(length)), 1
    while size < length and len(tokens_) >= length:
        step = min(size, length - size)
        out = mixed(out[:-step] * np.uint64(STEP) + out[step:])
        size += step
    return out[: max(0, len(tokens_) - length + 1)]


def windows(docs: DataFrame, seed: int) -> DataFrame:
    """(key, id, at, upto, lo, hi) of all texts (id, text): a key of each side of each window, the `half` + 1 tokens from at on; lo..hi has the window's runs around c.

    Of equal tokens each place in turn has the same key: at..upto are such places, one after the other."""
    half = half_length(seed)

    def run(batches):
        for part in chunks(batches, 1 << 20):
            out = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                base = tokens(text)
                if len(base) < seed:
                    continue
                l, c, r = np.array(compact_windows(mixed(base ^ np.uint64(MIX[0])), seed), np.int64).T
                side = runs(base, half + 1)
                lo, hi = np.maximum(l, c - seed + 1), np.minimum(r, c + seed - 1)
                for first, salt in ((c - half, 0), (c, MIX[1])):
                    ok = (first >= l) & (first + half <= r)
                    if not ok.any():
                        continue
                    by = first[ok].argsort()
                    at = first[ok][by]
                    key = (side[at] ^ np.uint64(salt)).view(np.int64)
                    begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]))
                    ends = np.append(begins[1:], len(at)) - 1
                    out.append((key[begins], np.full(len(begins), doc), at[begins], at[ends], np.minimum.reduceat(lo[ok][by], begins), np.maximum.reduceat(hi[ok][by], begins)))
            if out:
                key, doc, at, upto, lo, hi = (np.concatenate(x) for x in zip(*out))
                cols = [pa.array(key), pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (at, upto, lo, hi))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "id", "at", "upto", "lo", "hi"])

    return in_batches(docs.select("id", "text"), run, "key long, id long, at int, upto int, lo int, hi int")


def half_length(seed: int) -> int:
    """One side of a window's minimum has so many more tokens at least."""
    return (seed - 1) // 2 if seed % 2 else seed // 2 - 1


def open_runs(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, id, open) of the different runs of each length that touch the spans of documents (id, text, spans, covered); open is 2 if they have a token of a span that no passage covers, else 1 for runs of the first length, which are passages, and 0 for others."""

    def run(batches):
        for part in chunks(batches, 1 << 20):
            out = []
            for doc, text, spans, covered in zip(*(c.to_pylist() for c in part.columns)):
                base = tokens(text)
                n = len(base)
                here = np.zeros(n + 1, np.int64)
                for x in spans:
                    if x["hi"] < n:  # another text of this id may be longer
                        here[x["lo"]] += 1
                        here[x["hi"] + 1] -= 1
                here = here.cumsum()[:n] > 0
                bare = here.copy()
                for x in covered or ():
                    bare[x["first_word"] : max(0, x["last_word"] - SHINGLE + 2)] = False
                touched, unsettled = (np.concatenate([[0], x.cumsum()]) for x in (here, bare))
                for length in lengths:
                    if n >= length:
                        some = touched[length:] > touched[:-length]
                        keys, number = np.unique(runs(base, length)[some], return_inverse=True)
                        free = np.full(len(keys), int(length == lengths[0]), np.int8)
                        free[number[(unsettled[length:] > unsettled[:-length])[some]]] = 2
                        out.append((keys.view(np.int64), np.full(len(keys), doc), free))
            if out:
                key, doc, free = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc, pa.int64()), pa.array(free, pa.int8())], ["key", "id", "open"])

    return in_batches(docs.select("id", "text", "spans", "covered"), run, "key long, id long, open byte")


def surroundings(docs: DataFrame, reach: int, side: int) -> DataFrame:
    """(key, id, n, by, core, again, before, behind) of the places of keys of documents (id, text, keys: key, n, by, at, upto): the `reach` tokens before a place, the nearest first, and behind it, in 31 bits each; core has the number of tokens in between, and again the token if all are equal (else -1)."""

    def run(batches):
        for part in chunks(batches, 1 << 20):
            out, size = [], 0
            for doc, text, keys in zip(*(c.to_pylist() for c in part.columns)):
                short = (tokens(text) >> np.uint64(33)).astype(np.int32)
                for x in keys:
                    at, stop = x["at"], x["upto"] + side
                    out.append((x["key"], doc, x["n"], x["by"], stop - at, int(short[at]) if x["upto"] > at and at < len(short) else -1, short[max(0, at - reach) : at][::-1], short[stop : stop + reach]))
                    size += 1
                    if size >= 1 << 11:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out):
        key, doc, n, by, core, again, *near = zip(*out)
        cols = [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(by, pa.list_(pa.int64())), pa.array(core, pa.int32()), pa.array(again, pa.int32())]
        for lists in near:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32())))
        return pa.RecordBatch.from_arrays(cols, ["key", "id", "n", "by", "core", "again", "before", "behind"])

    return in_batches(docs.select("id", "text", "keys"), run, "key long, id long, n long, by array<long>, core int, again int, before array<int>, behind array<int>")


def gains(x: np.ndarray, y: np.ndarray, drift: int, worth: float) -> np.ndarray:
    """Upper bounds of what a passage gains that ends 0, 1, 2... tokens of x (a row for each pair) away from the key: tokens of both sides, less `worth` for each that the other side lacks.

    A token may stand in the other side up to `drift` places nearer or further."""
    reach = x.shape[1]
    shifts = [(slice(max(0, -d), reach - max(0, d)), slice(max(0, d), reach - max(0, -d))) for d in range(-min(drift, reach), min(drift, reach) + 1)]
    equal = [x[:, a] == y[:, b] for a, b in shifts]
    in_x, in_y = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for (a, b), same in zip(shifts, equal):
        in_x[:, a] |= same
        in_y[:, b] |= same
    steps = np.arange(1, reach + 1)
    of_y = (steps - worth * (~in_y).cumsum(1)).astype(np.float32)
    best = np.full(x.shape, -np.inf, np.float32)
    for (a, b), same in zip(shifts, equal):
        np.maximum(best[:, a], of_y[:, b], out=best[:, a], where=same)
    return np.concatenate([np.zeros((len(x), 1), np.float32), steps - worth * (~in_x).cumsum(1) + best], 1)


class Lines:
    """The tokens before, at and behind places of a key that is one word repeated, and which of them stand anywhere around another place."""

    def __init__(self, before: np.ndarray, behind: np.ndarray, core: np.ndarray, word: int):
        reach = before.shape[1]
        inside = np.minimum(core, 2 * reach)  # of more equal tokens than a passage has, those at either end say all
        parts = (before >= 0).sum(1), inside, (behind >= 0).sum(1)
        self.start, self.stop = parts[0], parts[0] + inside - 1
        line = np.full((len(core), int(sum(parts).max(initial=0))), -1, np.int32)
        for k, (left, n, right) in enumerate(zip(*parts)):
            line[k, : left + n + right] = np.concatenate([before[k, :left][::-1], np.full(n, word, np.int32), behind[k, :right]])
        self.names, at = np.unique(line, return_inverse=True)
        self.line = at.reshape(line.shape).astype(np.int32)
        self.has = np.zeros((len(core), len(self.names)), bool)
        self.has[np.arange(len(core))[:, None], self.line] = True
        self.has[:, self.names < 0] = False
        self.word = int(np.searchsorted(self.names, word))

    def common(self, width: int = 1 << 11) -> np.ndarray:
        """How many of the tokens around each place (a row) stand around each other place (a column); its own place of the word not counted."""
        out = np.zeros((len(self.line), len(self.line)), np.float32)
        of_several = np.flatnonzero(self.has.sum(0) > 1)
        column = np.full(len(self.names), -1)
        column[of_several] = np.arange(len(of_several))
        row, number = np.repeat(np.arange(len(self.line)), self.line.shape[1]), column[self.line.ravel()]
        for first in range(0, len(of_several), width):
            on = (number >= first) & (number < first + width)
            counts = np.bincount(row[on] * width + number[on] - first, minlength=len(out) * width).reshape(-1, width)[:, : len(of_several) - first]
            out += counts.astype(np.float32) @ self.has[:, of_several[first : first + width]].T.astype(np.float32)
        return out - (self.stop - self.start + 1)[:, None]

    def dense(self, x: np.ndarray, y: np.ndarray, least: int, similar: float) -> np.ndarray:
        """Whether a range of so many tokens or more around place x has so many tokens that stand anywhere around y; it begins and ends with such a token."""
        width = self.line.shape[1]
        if width < least:
            return np.zeros(len(x), bool)
        stands = self.has[y[:, None], self.line[x]]
        sums = np.zeros((len(x), width + 1), np.float32)
        np.cumsum(stands - np.float32(similar), 1, out=sums[:, 1:])
        lowest = np.full(sums.shape, np.inf, np.float32)
        lowest[:, :-1][stands] = sums[:, :-1][stands]
        np.minimum.accumulate(lowest, 1, out=lowest)
        end = np.arange(least, width + 1)
        begin = np.minimum(end - least, self.stop[x][:, None])
        fits = sums[:, least:] >= np.take_along_axis(lowest, begin, 1) - 1e-3
        return (fits & stands[:, least - 1 :] & (end > self.start[x][:, None])).any(1)


def allowed(before: np.ndarray, behind: np.ndarray, core: np.ndarray, again: np.ndarray, x: np.ndarray, y: np.ndarray, least: int, similar: float, most: int = 1 << 11) -> np.ndarray:
    """Which pairs (x, y) of places may have a passage over their key, by the tokens before and behind it (-1: none).

    A passage without a shorter one inside has at most 2 * least - 1 shared tokens: were there more, one of its halves would
    be long and similar enough. So it has at most (2 * least - 1) / similar tokens, and all of them are near its keys.
    Where equal tokens follow one another it is not known which of them meet: there tokens may stand anywhere in the other side."""
    seed, reach = seed_length(least, similar), before.shape[1]
    word = int(again.max(initial=-1))  # equal tokens of a key are the same at all of its places
    lines = Lines(before, behind, core, word) if word >= 0 else None
    common = lines.common() if lines else None
    fewest = math.ceil(least * 2 * similar / (1 + similar) - 1e-9)
    drift = int((2 * least - 1) * (1 / similar - 1) + 1e-9)
    worth = (1 + similar) / (1 - similar) if similar < 1 else 1e6
    out = np.zeros(len(x), bool)
    for start in range(0, len(x), most):
        i, j = x[start : start + most], y[start : start + most]
        both = np.minimum(core[i], core[j])
        run = both.copy()  # tokens of the unbroken run around the key
        for side in (before, behind):
            near = side[:, :seed]
            run += ((near[i] == near[j]) & (near[i] >= 0)).cumprod(1).sum(1)
        on = np.flatnonzero(run >= seed)
        if not len(on):
            continue
        vague = (again[i[on]] >= 0) | (again[j[on]] >= 0)
        if vague.any():
            some = on[vague]
            a, b = i[some], j[some]
            ok = np.ones(len(some), bool)
            for c, d in ((a, b), (b, a)):  # enough tokens in common; a whole passage of the word, or more than the word
                more = common[c, d]
                ok &= (core[c] + more >= fewest) & ((more > 0) | (core[c] >= least))
            some, a, b = some[ok], a[ok], b[ok]
            whole = np.minimum(core[a], core[b]) >= least
            out[start + some[whole]] = True
            some, a, b = some[~whole], a[~whole], b[~whole]
            ok = lines.dense(a, b, least, similar) if len(a) else np.zeros(0, bool)
            some, a, b = some[ok], a[ok], b[ok]
            if len(a):
                out[start + some] = lines.dense(b, a, least, similar)
        on = on[~vague]
        if not len(on):
            continue
        i, j, both = i[on], j[on], both[on]
        left, right = (gains(side[i], np.where(side[j] < 0, -2, side[j]), drift, worth) for side in (before, behind))
        right = np.maximum.accumulate(right[:, ::-1], 1)[:, ::-1]  # of so many tokens or more
        lack = np.maximum(0, least - both[:, None] - np.arange(reach + 1))
        far = np.take_along_axis(right, np.minimum(lack, reach), 1)
        out[start + on] = ((left + far + 2 * both[:, None] >= -0.01) & (lack <= reach)).any(1)
    return out


def unheld_pairs(blocks: DataFrame, reach: int, least: int, similar: float) -> DataFrame:
    """(id, source) of the places of blocks (first, places: mine, id, by, core, again, before, behind) that no common source holds and that may have a passage over their key. Blocks of a pair: mine with the others; first: also among mine."""

    def padded(column) -> np.ndarray:
        lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(lists.offsets.to_numpy())
        out = np.full((len(lists), reach), -1, np.int32)
        out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)] = lists.flatten().to_numpy()
        return out

    def run(batches):
        for batch in batches:
            found = set()
            for k in range(batch.num_rows):
                places = batch.column(1)[k].values
                mine, ids, core, again = (places.field(n).to_numpy(zero_copy_only=False) for n in ("mine", "id", "core", "again"))
                before, behind = (padded(places.field(n)) for n in ("before", "behind"))
                number: dict[int, int] = {}
                held = [[number.setdefault(s, len(number)) for s in by] for by in places.field("by").to_pylist()]
                holds = np.zeros((len(held), len(number)), np.float32)
                for row, by in zip(holds, held):
                    row[by] = 1
                x, y = np.nonzero((holds @ holds.T == 0) & (ids[:, None] > ids[None, :]) & (np.array([batch.column(0)[k].as_py()]) | (mine[:, None] != mine[None, :])))
                ok = allowed(before, behind, core, again, x, y, least, similar)
                found.update(zip(ids[x[ok]].tolist(), ids[y[ok]].tolist()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found))], ["id", "source"])

    return in_batches(blocks.select("first", "places"), run, "id long, source long")


def ranges(i: np.ndarray, j: np.ndarray, least: int, similar: float) -> list[tuple[int, int, int, float]]:
    """(start, stop, source start, similarity) of the longest long and similar ranges of chained places (i of the text, j of the source)."""
    out, todo = [], [(0, len(i))]
    gain = (1 + similar) * np.arange(len(i)) - similar * (i + j)
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 1 or i[hi - 1] - i[lo] + 1 < least:
            continue
        g = gain[lo:hi]
        # From p to q is similar if g[q] >= g[p] - (1 - similar); the q of the longest only moves right.
        top = np.maximum.accumulate(g[::-1])[::-1]
        last = np.searchsorted(-top, -(g - (1 - similar) - 1e-9), "right") - 1
        size = np.minimum(i[lo + last] - i[lo:hi], j[lo + last] - j[lo:hi]) + 1
        size[last < np.arange(hi - lo)] = 0
        p = int(size.argmax())
        if size[p] < least:
            continue
        q, p = lo + int(last[p]), lo + p
        m, both = q - p + 1, int(i[q] - i[p] + j[q] - j[p] + 2)
        out.append((int(i[p]), int(i[q]) + 1, int(j[p]), m / (both - m)))
        todo += [(lo, p), (q + 1, hi)]
    return out


def from_ends(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens told apart by their distance from the start, and from the end, of the run of equal tokens they stand in.

    A word repeated a hundred times in two texts would agree on two hundred diagonals; so it agrees on two."""
    first = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    size = np.diff(starts, append=len(t))
    if len(starts) == len(t):
        return t, t
    after = np.arange(len(t)) - np.repeat(starts, size)
    before = np.repeat(size, size) - 1 - after
    return t ^ mixed(after.astype(np.uint64)), t ^ mixed(before.astype(np.uint64))


def equal_places(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All (i, j) with a[i] = b[j]. None if more than `most`."""
    order = b.argsort(kind="stable")
    y = b[order]
    first = np.searchsorted(y, a, "left")
    n = np.searchsorted(y, a, "right") - first
    if n.sum() > most:
        return None
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)]


def long_runs(i: np.ndarray, seed: int) -> np.ndarray:
    """Where in i a run of so many consecutive numbers begins."""
    return np.flatnonzero(i[seed - 1 :] - i[: max(0, len(i) - seed + 1)] == seed - 1)


def chain(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most places of which j rises as well; i rises."""
    if len(j) < 2 or (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    at: list[int] = []
    before = []
    for k, v in enumerate(j.tolist()):
        n = bisect_left(tails, v)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1], at[n : n + 1] = [v], [k]
    path = [at[-1]]
    while before[path[-1]] >= 0:
        path.append(before[path[-1]])
    return i[path[::-1]], j[path[::-1]]


def dense(places: np.ndarray, fewest: int, similar: float) -> bool:
    """Whether so many of the sorted places may lie in one passage: m shared tokens lie in m / similar tokens at most.

    A longer passage has a part of at most fewest / similar tokens (and a few for rounding) with as many."""
    reach = fewest - 2
    return len(places) >= fewest and bool((places[reach - 1 :] - places[: len(places) - reach + 1] <= fewest / similar + 2).any())


def shared_ranges(a: np.ndarray, b: np.ndarray, least: int, similar: float, most: int = 1 << 20) -> set[tuple[int, int, int, float]]:
    """Passages of two texts: along each diagonal with a shared run, the fullest first, then, for what is left, chained with the diagonals at most `least` beside it.

    Texts with more than `most` equal places (long and repetitive) are compared diagonal by diagonal instead of all at once.
    """
    out: set[tuple[int, int, int, float]] = set()
    seed = seed_length(least, similar)
    fewest = math.ceil(least * 2 * similar / (1 + similar) - 1e-9)
    (a1, a2), (b1, b2) = from_ends(a), from_ends(b)
    got = equal_places(a1, b1, most)
    if got is not None and (a1 is not a2 or b1 is not b2):
        back = equal_places(a2, b2, most)
        got = None if back is None else tuple(np.concatenate(x) for x in zip(got, back))
    if got is not None:
        i, shift = got[0], got[0] - got[1]
        by = np.lexsort((i, shift))
        i, shift = i[by], shift[by]
        once = np.concatenate([[True], (i[1:] != i[:-1]) | (shift[1:] != shift[:-1])]) if len(i) else np.zeros(0, bool)
        i, shift = i[once], shift[once]
        if not dense(np.unique(i), fewest, similar) or not dense(np.unique(i - shift), fewest, similar):
            return out
        step = len(a) + len(b) + 1
        begins = long_runs(shift * step + i, seed)
        starts, at, n = np.unique(shift[begins], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(shift, starts, "left"), np.searchsorted(shift, starts, "right")
        full = np.argsort(lo - hi, kind="stable")
        # Per diagonal: where its long runs begin.
        starts = [(int(starts[k]), i[begins[at[k] : at[k] + n[k]]]) for k in full]

        def places(lo, hi):
            x, y = np.searchsorted(shift, lo, "left"), np.searchsorted(shift, hi, "right")
            return i[x:y], shift[x:y]
    else:

        def places(lo, hi):
            parts = []
            for d in range(max(lo, 1 - len(b)), min(hi, len(a) - 1) + 1):
                x, y = max(0, d), min(len(a), len(b) + d)
                parts.append(np.flatnonzero((a1[x:y] == b1[x - d : y - d]) | (a2[x:y] == b2[x - d : y - d])) + x)
            return np.concatenate(parts), np.repeat(np.arange(max(lo, 1 - len(b)), min(hi, len(a) - 1) + 1), [len(x) for x in parts])

        starts = []
        for d in range(1 - len(b), len(a)):
            on, _ = places(d, d)
            if len(begins := long_runs(on, seed)):
                starts.append((len(on), d, on[begins]))
        starts = [(d, on) for _, d, on in sorted(starts, key=lambda x: -x[0])]
    covered = np.zeros(len(a), bool)

    def settled(on: np.ndarray) -> bool:
        """Repeated words agree on many diagonals, each a little beyond the other: a few places more are no new passage."""
        new = np.count_nonzero(~covered[on]) + np.count_nonzero(~covered[on + seed - 1])
        return new == 0 or (new < seed and bool(covered[on].any()))

    def put(found) -> None:
        for s, e, at, like in found:
            out.add((s, e, at, like))
            covered[s:e] = True

    for d, on in starts:
        i_, _ = places(d, d)
        if not settled(on) and dense(i_, fewest, similar):
            put(ranges(i_, i_ - d, least, similar))
    tried = set()
    for d, on in starts:
        i_, of = places(d - least, d + least)
        left = np.unique(i_[~covered[i_]])
        if not len(left) or (name := (d // least, left.tobytes())) in tried:
            continue
        tried.add(name)
        if (of == d).all() or not dense(np.unique(i_), fewest, similar) or not dense(np.unique(i_ - of), fewest, similar):
            continue
        by = np.lexsort((abs(of - d), i_))  # the nearest diagonal of each place
        i_, of = i_[by], of[by]
        first = np.flatnonzero(np.diff(i_, prepend=-1))
        put(ranges(*chain(i_[first], i_[first] - of[first]), least, similar))
    # What lies inside a longer one says nothing more.
    kept, end = set(), -1
    for s, e, at, like in sorted(out, key=lambda x: (x[0], -x[1], -x[3], x[2])):
        if e > end:
            kept.add((s, e, at, like))
            end = e
    return kept


def verified(pairs: DataFrame, least: int, similar: float) -> DataFrame:
    """Passages of candidate pairs (id, source, text, source_text)."""

    def run(batches):
        known = lru_cache(maxsize=32)(lambda doc, text: tokens(text))
        for part in chunks(batches, 1 << 20, at=2):
            out = []
            for doc, source, text, other in zip(*(c.to_pylist() for c in part.columns)):
                for s, e, at, got in shared_ranges(known(doc, text), known(source, other), least, similar):
                    out.append((doc, s, e + SHINGLE - 2, source, at, got))
            types = [pa.int64()] * 5 + [pa.float64()]
            cols = [pa.array(v, t) for v, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(cols, ["id", "first_word", "last_word", "source", "source_first", "similarity"])

    schema = "id long, first_word long, last_word long, source long, source_first long, similarity double"
    return in_batches(pairs.select("id", "source", "text", "source_text"), run, schema)


def unheld(shared: DataFrame, found: DataFrame, docs: DataFrame, least: int, similar: float, small: int, made: list[str]) -> DataFrame:
    """Pairs (id, source) of documents of one key (key, id, source, at, upto) that have no found passage with one source over the key, and may have one with each other over it."""
    side = half_length(seed_length(least, similar)) + 1
    reach = int((2 * least - 1) / similar) - side
    held = found.groupBy("id").agg(F.collect_set(F.struct("first_word", "last_word", "source")).alias("held"))  # of one document
    over = F.filter("held", lambda x: F.least(F.col("upto"), x["last_word"] - (SHINGLE - 1) - (side - 1)) >= F.greatest(F.col("at"), x["first_word"]))
    by = F.array_union(F.array(F.col("id")), F.coalesce(F.transform(over, lambda x: x["source"]), F.array().cast("array<bigint>")))
    # The key's source was compared with all.
    entries = written(shared.where("id <> source").join(held, "id", "left").select("key", "id", "at", "upto", by.alias("by")), "entries", made)
    # Keys of which one source holds all places are settled.
    n = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    most = entries.select("key", F.explode("by").alias("s")).groupBy("key", "s").count().groupBy("key").agg(F.max("count").alias("most"))
    unsettled = n.join(most, "key").where("most < n").select("key", "n")
    keys = entries.join(unsettled, "key").groupBy("id").agg(F.collect_list(F.struct("key", "n", "by", "at", "upto")).alias("keys"))  # of one document
    keys = written(keys, "keys", made)
    near = surroundings(only(docs, keys.select("id"), "left_semi", small).join(keys, "id"), reach, side)
    # Each block of a key's places meets itself and every other block.
    parts = F.ceil(F.col("n") / BLOCK)
    near = near.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    place = F.struct((F.col("part") <= F.col("other")).alias("mine"), "id", "by", "core", "again", "before", "behind")
    blocks = near.groupBy("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).agg(F.collect_list(place).alias("places"))
    return unheld_pairs(blocks.select((F.col("a") == F.col("b")).alias("first"), "places"), reach, least, similar).distinct()


def passages(
    df: DataFrame, words: int = 50, similar: float = 0.8, small: int = SMALL_IDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    least = words - SHINGLE + 1
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    same = F.sha2("text", 256)
    n_words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " "))
    made: list[str] = []
    spark = df.sparkSession
    hashed = written(docs.select("id", same.alias("h")), "hashes", made)
    copies = with_groups(hashed, "h", F.min("id").alias("source"), made=made).where("id <> source")
    copies = written(copies.select("id", "source").distinct(), "copies", made)
    sweep(spark, made, copies)
    rest = only(docs, copies.select("id").distinct(), "left_anti", small)
    seed = seed_length(least, similar)

    def matched(pairs: DataFrame) -> DataFrame:
        needed = pairs.select("id").union(pairs.select(F.col("source").alias("id"))).distinct()
        texts = only(docs, needed, "left_semi", small)
        # So many tasks as the pairs need: by bytes Spark would put thousands of pairs into one; a merge join keeps them.
        tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 1000)
        both = pairs.join(texts.select(F.col("id").alias("source"), F.col("text").alias("source_text")), "source").repartition(tasks, "id").join(texts.hint("merge"), "id")
        return written(verified(both, least, similar).distinct(), "passages", made)

    found = written(windows(rest, seed), "windows", made)
    shared = with_groups(found, "key", F.min("id").alias("source"), F.max("id").alias("top"), made=made).where("source < top")
    shared = written(shared.select("key", "id", "source", "at", "upto", "lo", "hi"), "shared", made)
    sweep(spark, made, copies, shared)
    tested = written(shared.where("id <> source").select("id", "source").distinct(), "pairs", made)
    near_ = matched(tested)
    # Keys whose run no passage covers in some document: all runs around them are keys of the second step.
    covered = near_.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("first_word", "last_word"))).alias("covered"))  # of one document
    last = lambda x: x["last_word"] - (SHINGLE - 1) - half_length(seed)  # noqa: E731  (the last place of a key inside)
    reached = F.aggregate("covered", F.col("at").cast("long"), lambda at, x: F.when((x["first_word"] <= at) & (last(x) >= at), last(x) + 1).otherwise(at))
    settled = reached > F.col("upto")
    open_ = shared.where("id <> source").join(covered, "id", "left").where(~F.coalesce(settled, F.lit(False))).select("key").distinct()
    spans = shared.join(written(open_, "open", made), "key", "left_semi").groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    lengths = sorted({least, (least + seed) // 2, seed}, reverse=True)
    spans = written(spans.join(covered, "id", "left"), "spans", made)
    near_runs = written(open_runs(only(rest, spans.select("id"), "left_semi", small).join(spans, "id"), lengths), "runs", made)
    sweep(spark, made, copies, shared, tested, near_, near_runs)
    # Where an open place meets the source of a run that is a passage, the other documents of the run do as well: so one source holds them all.
    met = with_groups(near_runs, "key", F.min("id").alias("source"), F.max("open").alias("top"), made=made, groups_of="top = 2", rows_of="open > 0").where("id > source")
    pairs = written(met.select("id", "source").distinct().join(tested, ["id", "source"], "left_anti"), "pairs", made)
    sweep(spark, made, copies, shared, tested, near_, pairs)
    more = matched(pairs)
    pairs = written(unheld(shared, near_.unionByName(more), rest, least, similar, small, made).join(tested.unionByName(pairs), ["id", "source"], "left_anti"), "pairs", made)
    sweep(spark, made, copies, near_, more, pairs)
    near_ = near_.unionByName(more).unionByName(matched(pairs))
    # All copies of a text have the words of their source, which are counted once.
    counted = only(docs, copies.select(F.col("source").alias("id")).distinct(), "left_semi", small).select(F.col("id").alias("source"), n_words.alias("n_words")).groupBy("source").agg(F.max("n_words").alias("n_words"))
    whole = copies.join(counted.where(F.col("n_words") >= words), "source")
    whole = whole.select("id", F.lit(0).cast("long").alias("first_word"), (F.col("n_words") - 1).cast("long").alias("last_word"), "source", F.lit(0).cast("long").alias("source_first"), F.lit(1.0).alias("similarity"))
    return near_.unionByName(whole).distinct().select(
        F.col("id").alias(id_col), "first_word", "last_word", F.col("source").alias(f"source_{id_col}"), "source_first", "similarity"
    )


def cut(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the passages of found taken out of the texts; other columns and all rows stay."""
    spans = found.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(F.struct("first_word", "last_word")).alias("_spans"))  # of one document
    at = df.columns.index(text_col)
    joined = df.join(spans, df[id_col].cast("long") == spans["_id"], "left").drop("_id")

    def run(batches):
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if gone and text is not None:
                    places, keep, end = [m.span() for m in WORD.finditer(text)], [], 0
                    for a, b in sorted((s["first_word"], s["last_word"]) for s in gone):
                        keep.append(text[end : max(end, places[a][0])])
                        end = max(end, places[b][1])
                    text = "".join([*keep, text[end:]])
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return in_batches(joined, run, df.schema)

"""Token counts with a whole-token shortcut (operator 10).

The vocabulary is worked through once on the driver, before any text is read: a string that ends a word is *proven* when
the merges turn it alone into one token. The proven strings are sent to the tasks (at most the vocabulary). Pre-tokens
that are proven strings count one each and are found by one vectorised membership test; only the rest is merged, each
different pre-token once. A text that holds a special string is counted by the library itself. Classes of characters
and the normal form of texts beyond U+02FF come from the library, whose Unicode tables are newer than Python's.

Defined cases: null text is empty and has 0 bytes and 0 tokens; repeated rows each give a row; other columns are
ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import HELD, chunks, in_batches, utf8
from .pretoken import classes, pieces

END = "</w>"
MOST_PIECES = 300_000


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


class WordMerges:
    """Merges of a vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.vocabulary = model["vocab"]
        self.known: dict[str, int] = {}

    def proven(self) -> list[str]:
        """Texts that the merges turn into one token."""
        letter_bytes = {c: b for b, c in self.letters.items()}
        out = []
        for token in self.vocabulary:
            if not token.endswith(END) or not all(c in letter_bytes for c in token[: -len(END)]):
                continue
            try:
                text = bytes(letter_bytes[c] for c in token[: -len(END)]).decode()
            except UnicodeDecodeError:  # no pre-token is part of a character
                continue
            if text and self.merge(text) == 1:
                out.append(text)
        return out

    def merge(self, text: str) -> int:
        """How many tokens the merges leave of a pre-token: pairs by rank, then from the left, over a linked list, so a word of any length takes n log n steps."""
        parts: list[str | None] = [self.letters[b] for b in text.encode()]
        parts[-1] += END
        rank, left = self.rank, len(parts)
        before, behind = list(range(-1, left - 1)), list(range(1, left + 1))
        heap = [(r, i) for i in range(left - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        n = left
        while heap:
            r, i = heappop(heap)
            j = behind[i]
            if parts[i] is None or j >= n or rank.get((parts[i], parts[j])) != r:
                continue  # one of the two was merged with something else meanwhile
            parts[i], parts[j] = parts[i] + parts[j], None
            behind[i] = k = behind[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))
        return left

    def count(self, text: str) -> int:
        n = self.known.get(text)
        if n is None:
            if len(self.known) >= MOST_PIECES:
                self.known.clear()
            n = self.known[text] = self.merge(text)
        return n


@functools.cache
def merges(path: str) -> WordMerges:
    HELD.append(("token counts", merges.cache_clear))
    return WordMerges(path)


@functools.cache
def proof(path: str) -> list[str]:
    return merges(path).proven()


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]


def normal(column: pa.Array, path: str) -> pa.Array:
    """The library's normal form; up to U+02FF it is each character in lower case."""
    raw, offs = utf8(column)
    if not len(raw) or raw.max() < 0x80:
        low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(low))
    told = library(path)[0].normalizer.normalize_str
    return pa.array([t.lower() if t.isascii() or max(t) <= "\u02ff" else told(t) for t in column.fill_null("").to_pylist()], pa.large_string())


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    sent = df.sparkSession.sparkContext.broadcast((proof(path), classes("tokenizers")))

    def run(batches):
        model, (strings, table) = merges(path), sent.value
        proven = pa.array(strings, pa.string())
        tokenizer, specials = library(path)
        for part in chunks(batches):
            found, starts = pieces(*utf8(normal(part.column(1), path)), words=True, table=table)
            one = pc.is_in(found.dictionary, value_set=proven).to_numpy(zero_copy_only=False)
            each = np.ones(len(one), np.int64)
            rest = np.flatnonzero(~one)
            each[rest] = [model.count(t) for t in found.dictionary.take(pa.array(rest)).to_pylist()]
            edges = np.concatenate([[0], np.cumsum(each[found.indices.to_numpy()])])
            n = np.diff(edges[starts])
            special = np.zeros(len(n), bool)
            for s in specials:
                special |= pc.match_substring(part.column(1).fill_null(""), s).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(special):
                n[i] = len(tokenizer.encode(part.column(1)[i].as_py(), add_special_tokens=False).ids)
            size = np.diff(utf8(part.column(1))[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return in_batches(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", "token counts")

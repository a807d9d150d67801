"""Pre-tokens of two public tokenizer patterns, found for a whole chunk of texts at once.

The patterns only look at the class of a character (letter, number, white space, other), at single blanks
before a run and at seven contractions, so the cuts can be computed with numpy over the UTF-8 bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: What an apostrophe makes one token with (fixed values).
SHORT, LONG = "stmd", ("re", "ve", "ll")


def everything() -> str:
    """All code points that text can hold, in order."""
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@functools.cache
def classes(library: str) -> np.ndarray:
    """Class of every code point as the library's own patterns see it (their Unicode tables are of different age).

    Asked once on the driver and sent to the tasks: a megabyte, whatever the data."""
    table = np.zeros(0x110000, np.uint8)
    text = everything()
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        if library == "tiktoken":
            import tiktoken

            # What no pattern matches is left out of the encoding, so that the matches come back.
            probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            table[[ord(c) for c in probe.decode(probe.encode_ordinary(text))]] = kind
        else:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            for _, (start, stop) in Split(Regex(pattern + "+"), behavior="removed", invert=True).pre_tokenize_str(text):
                table[points[start:stop]] = kind
    return table


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters start, and their code points."""
    if not len(raw) or raw.max() < 0x80:
        return np.arange(len(raw)), raw.astype(np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.uint32)
    cp, wide = lead.copy(), np.flatnonzero(lead >= 0x80)
    n = 1 + (lead[wide] >= 0xE0) + (lead[wide] >= 0xF0)  # continuation bytes
    value = lead[wide] & (np.uint32(0x3F) >> n.astype(np.uint32))
    for k in (1, 2, 3):
        more = n >= k
        value[more] = value[more] << 6 | raw[at[wide[more]] + k] & 0x3F
    cp[wide] = value
    return at, cp


def cuts(raw: np.ndarray, offs: np.ndarray, words: bool, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of pre-tokens, and which of them are kept.

    words False: the byte-level pattern, where all is kept and a blank joins the run after it.
    words True: the pattern with word ends, where white space is dropped and each number stands alone.
    """
    at, cp = code_points(raw)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    cls = table[cp]
    first = np.zeros(n, bool)  # first character of a document
    first[np.searchsorted(at, offs[:-1][offs[:-1] < len(raw)])] = True
    prev = np.empty_like(cls)
    prev[0], prev[1:] = 255, cls[:-1]
    prev[first] = 255
    start = cls != prev
    last = np.empty(n, bool)  # last character of a document
    last[-1], last[:-1] = True, first[1:]
    if words:
        start |= cls == NUMBER
        joined = np.zeros(n, bool)
    else:
        nxt = np.empty_like(cls)
        nxt[-1], nxt[:-1] = SPACE, cls[1:]
        nxt[last] = SPACE
        ends = (cls == SPACE) & (nxt != SPACE)  # last white space before a run
        start |= ends
        joined = ends & (cp == 32)
        start[1:] &= ~joined[:-1]
    for i in np.flatnonzero((cp == 39) & (prev != OTHER)):
        if i and not first[i] and joined[i - 1]:
            continue
        tail = "".join(map(chr, cp[i + 1 : i + 3]))
        if tail[:1] and not last[i] and tail[0] in SHORT:
            size = 2
        elif len(tail) == 2 and not last[i] and not last[i + 1] and tail in LONG:
            size = 3
        else:
            continue
        start[i], start[i + 1 : i + size] = True, False
        if i + size < n:
            start[i + size] = True
    begin = np.flatnonzero(start)
    return at[begin], cls[begin] != SPACE if words else np.ones(len(begin), bool)


def pieces(raw: np.ndarray, offs: np.ndarray, words: bool, table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """table: class of each code point. The kept pre-tokens of a chunk, dictionary-encoded, and for each document where its pre-tokens start (one more than documents)."""
    begin, keep = cuts(raw, offs, words, table)
    edges = np.append(begin, len(raw)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
    if words:
        found, begin = found.filter(pa.array(keep)), begin[keep]
    return found.dictionary_encode(), np.searchsorted(begin, offs)

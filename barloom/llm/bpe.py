"""Byte-level BPE as a finite-state transducer, and its streaming decoder (operator 2).

Encoding. Let last(i) be the last token of the encoding of a pre-token's first i bytes. A token t that ends at i and
starts at p is last(i) exactly when t can follow last(p), that is, when the merges turn their joined bytes back into
those two tokens. So it is enough to remember, for each start p from which a longer token may still grow, where it
stands in the vocabulary's trie and the tokens chosen up to p. That is the state; there are finitely many, and they and
their byte transitions are made when first met. Tokens on which all remembered starts agree are emitted: lookahead is
bounded by the longest token. Tests hold it against the tiktoken library.

Decoding. Token bytes pass through a UTF-8 machine whose state is the unfinished sequence (three bytes at most), so a
stream of ids can be decoded in blocks that split characters.

Defined cases: null text is empty and gives no ids; repeated rows each give a row; columns other than the id and the
text are ignored, so clashing names do no harm; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, chunks, in_batches, utf8
from .pretoken import classes, pieces

#: Bounds of what a worker remembers; each entry takes 100 to 400 bytes.
MOST_STATES = 150_000
MOST_PIECES = 100_000
MOST_PAIRS = 200_000


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Recent(dict):
    """A bounded memory: what was not asked for since the last time it filled up is forgotten."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Transducer:
    """Turns the bytes of one pre-token into ids. Its memory is bounded: states and pieces are forgotten when there are too many.

    A state is a flat tuple: what was emitted last (-1: nothing that matters), then for each remembered start its trie
    node, how many tokens were chosen up to it, and these tokens.
    """

    def __init__(self, vocabulary: dict[bytes, int]):
        self.ids = vocabulary
        self.names = {i: b for b, i in vocabulary.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token: list[int | None] = [None]
        self.grows: list[bool] = [False]
        for name, i in vocabulary.items():
            node = 0
            for byte in name:
                self.grows[node] = True
                if (node << 8 | byte) not in self.child:
                    self.child[node << 8 | byte] = len(self.token)
                    self.token.append(None)
                    self.grows.append(False)
                node = self.child[node << 8 | byte]
            self.token[node] = i
        self.follows = Recent(MOST_PAIRS)  # before << 32 | token -> 1 or 2 (no or yes)
        #: What makes a token, by its id: -2 not looked at yet, -1 nothing (a byte or an odd string).
        self.left, self.right = (array("i", [-2]) * (max(self.names) + 1) for _ in range(2))
        #: Strings that the merges alone never make; they only stand as whole pre-tokens.
        self.odd = {i for i, name in self.names.items() if len(name) > 1 and self.halves(i) is None}
        self.known = Recent(MOST_PIECES)
        self.forget()

    def rest(self) -> None:
        """Called at the end of a task: an idle worker keeps only what was used lately."""
        self.known.old = {}

    def forget(self) -> None:
        start = (-1, 0, 0)
        self.number, self.states = {start: 0}, [start]
        self.arcs: dict[int, int | tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte -> next state, or (next state, emitted)

    def merged(self, data: bytes, below: int = 1 << 40) -> list[int]:
        """The plain merges of ranks under a limit; only used on single vocabulary strings, to find what they are made of."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ids.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if self.left[token] == -2:
            name = self.names[token]
            parts = self.merged(name, below=token) if len(name) > 1 else []
            self.left[token], self.right[token] = parts if len(parts) == 2 else (-1, -1)
        return None if self.left[token] < 0 else (self.left[token], self.right[token])

    def edge(self, token: int, side: int):
        """The tokens that stand at one end of a token while it is being merged, each with the rank that ends it."""
        until = 1 << 40
        while True:
            yield token, until
            if (both := self.halves(token)) is None:
                return
            until, token = token, both[side]

    def crossed(self, before: int, token: int) -> bool:
        """Whether some merge joins an end piece of before with an end piece of token."""
        names, ids, rights = self.names, self.ids, list(self.edge(token, 0))
        for left, left_ends in self.edge(before, 1):
            name = names[left]
            for right, right_ends in rights:
                rank = ids.get(name + names[right])
                # Of equal ranks the leftmost merge comes first.
                if rank is not None and left < rank < left_ends and right < rank <= right_ends:
                    return True
        return False

    def may_follow(self, before: int, token: int) -> bool:
        """Whether no merge crosses from before (-1: nothing) to token: it would need both end pieces to stand there at its rank."""
        if token in self.odd:
            return False
        if before < 0:
            return True
        key = before << 32 | token
        return (self.follows[key] or self.follows.keep(key, 1 if self.crossed(before, token) else 2)) == 2

    def arc(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """The state after byte, with what is emitted if anything is."""
        flat = self.states[state]
        before, here, path, at = flat[0], [], None, 1
        while at < len(flat):  # earliest start first
            node, n = self.child.get(flat[at] << 8 | byte), flat[at + 1]
            tokens = flat[at + 2 : at + 2 + n]
            at += 2 + n
            if node is None:
                continue
            token = self.token[node]
            if path is None and token is not None and self.may_follow(tokens[-1] if tokens else before, token):
                path = (*tokens, token)
            if self.grows[node]:
                here.append((node, tokens))
        here.append((0, path))
        shared, least = 0, min(len(tokens) for _, tokens in here)
        while shared < least and all(tokens[shared] == path[shared] for _, tokens in here):
            shared += 1
        out = path[:shared]
        # What was emitted last only matters to starts that lie right behind it.
        last = (out[-1] if out else before) if any(len(tokens) == shared for _, tokens in here) else -1
        after = (last, *(x for node, tokens in here for x in (node, len(tokens) - shared, *tokens[shared:])))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        found = self.arcs[state << 8 | byte] = (number, out) if out else number
        return found

    def run(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ids.get(data)) is not None:
            return (whole,)
        state, out, arcs = 0, [], self.arcs
        for byte in data:
            found = arcs.get(state << 8 | byte)
            if found is None:
                if len(self.states) > MOST_STATES:  # only the state that we stand in is carried over
                    flat = self.states[state]
                    self.forget()
                    arcs = self.arcs
                    state = self.number.setdefault(flat, len(self.states))
                    if state == len(self.states):
                        self.states.append(flat)
                found = self.arc(state, byte)
            if type(found) is int:
                state = found
            else:
                state = found[0]
                out += found[1]
        flat = self.states[state]
        at = 1
        while at + 2 + flat[at + 1] < len(flat):
            at += 2 + flat[at + 1]
        return (*out, *flat[at + 2 :])

    def encode(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens; those met before are looked up."""
        known, run = self.known, self.run
        return [known[t] or known.keep(t, run(t.encode())) for t in texts]


def utf8_classes() -> tuple[list[int], list[list[int]]]:
    """Class of each byte, and per state the next state of each class. States: 0 whole, 1 to 3 so many continuation bytes
    wanted, 4 to 7 the bounded second bytes after E0, ED, F0 and F4, 8 wrong."""
    of = [0 if b < 0x80 else 1 if b < 0x90 else 2 if b < 0xA0 else 3 if b < 0xC0 else 12 for b in range(256)]
    for first, stop, kind in ((0xC2, 0xE0, 4), (0xE1, 0xF0, 5), (0xF1, 0xF4, 6), (0xE0, 0xE1, 7), (0xED, 0xEE, 8), (0xF0, 0xF1, 9), (0xF4, 0xF5, 10)):
        of[first:stop] = [kind] * (stop - first)
    wrong = 8
    start = [0, wrong, wrong, wrong, 1, 2, 3, 4, 5, 6, 7, wrong, wrong]
    then = {1: (0, 0, 0), 2: (1, 1, 1), 3: (2, 2, 2), 4: (wrong, wrong, 1), 5: (1, 1, wrong), 6: (wrong, 2, 2), 7: (2, wrong, wrong)}
    return of, [start] + [[wrong, *then[s], *[wrong] * 9] for s in range(1, 8)]


class Utf8Machine:
    """An incremental decoder: a state machine over byte classes whose memory is one state and at most three bytes.

    Blocks that are whole characters from the start state go through the codec at once; only what is around a split or
    wrong character is stepped byte by byte. Wrong bytes become U+FFFD, one for each longest wrong prefix.
    """

    OF, NEXT = utf8_classes()

    def __init__(self):
        self.state, self.held = 0, b""

    def stepped(self, block: bytes) -> str:
        out, of, table = [], self.OF, self.NEXT
        for byte in block:
            after = table[self.state][of[byte]]
            if after == 8 and self.state:  # what is held never becomes a character; the byte begins anew
                out.append("\ufffd")
                self.state, self.held = 0, b""
                after = table[0][of[byte]]
            if after == 8:
                out.append("\ufffd")
                continue
            self.state, self.held = after, self.held + bytes((byte,))
            if after == 0:
                out.append(self.held.decode())
                self.held = b""
        return "".join(out)

    def feed(self, block: bytes, last: bool = False) -> str:
        out, n = [], 0
        while n < len(block):
            if self.state:
                out.append(self.stepped(block[n : n + 1]))
                n += 1
                continue
            piece = block[n : n + 4096]
            try:
                out.append(piece.decode())
                n += len(piece)
            except UnicodeDecodeError as wrong:  # a split or wrong character begins there
                out.append(piece[: wrong.start].decode())
                out.append(self.stepped(piece[wrong.start : wrong.start + 1]))
                n += wrong.start + 1
        if last and self.state:
            out.append("\ufffd")
            self.state, self.held = 0, b""
        return "".join(out)


def expand(found: pa.DictionaryArray, lists: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens one after the other, and where each pre-token's ids start (one more than pre-tokens)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
    at = np.cumsum(size) - size
    which = found.indices.to_numpy()
    n = size[which]
    edges = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(at[which] - edges[:-1], n) + np.arange(edges[-1])], edges


@functools.cache
def transducer(path: str) -> Transducer:
    HELD.append(("bpe", transducer.cache_clear))
    return Transducer(ranks(path))


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    by_id = {i: b for b, i in ranks(path).items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def encode_chunk(column: pa.Array, path: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, and where each text's ids start (one more than texts)."""
    found, starts = pieces(*utf8(column), words=False, table=table)
    ids, edges = expand(found, transducer(path).encode(found.dictionary.to_pylist()))
    return ids, edges[starts]


def decode_blocks(blocks, names: list[bytes]):
    """Text of a stream of id blocks, block by block."""
    machine = Utf8Machine()
    for ids in blocks:
        yield machine.feed(b"".join([names[i] for i in ids]))
    yield machine.feed(b"", last=True)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary): the ids of each text as little-endian unsigned 32-bit integers."""
    table = df.sparkSession.sparkContext.broadcast(classes("tiktoken"))

    def run(batches):
        for part in chunks(batches, 1 << 20):
            ids, at = encode_chunk(part.column(1), path, table.value)
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], [id_col, "ids"]
            )
        transducer(path).rest()

    return in_batches(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids binary", "bpe")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", block: int = 1 << 16) -> DataFrame:
    """(id_col, text) from (id_col, ids binary): the ids pass the decoder in blocks."""

    def run(batches):
        names = token_bytes(path)
        for batch in batches:
            texts = []
            for packed in batch.column(1).to_pylist():
                ids = np.frombuffer(packed or b"", "<u4")
                texts.append("".join(decode_blocks((ids[i : i + block].tolist() for i in range(0, len(ids), block)), names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return in_batches(df.select(id_col, "ids"), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string", "bpe")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded bytes), all computed where the text lies."""
    table = df.sparkSession.sparkContext.broadcast(classes("tiktoken"))

    def run(batches):
        names = token_bytes(path)
        for part in chunks(batches, 1 << 20):
            ids, at = encode_chunk(part.column(1), path, table.value)
            ids, hashes, back = ids.astype("<u4"), [], []
            for a, b in zip(at, at[1:]):
                hashes.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                sha = hashlib.sha256()
                for text in decode_blocks((ids[i : min(b, i + 65536)].tolist() for i in range(a, b, 65536)), names):
                    sha.update(text.encode())
                back.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(at)), pa.array(hashes, pa.string()), pa.array(back, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        transducer(path).rest()

    return in_batches(df.select(F.col(id_col), F.col(text_col)),
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe"
    )

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import bitpack, bpe, token_counts
from barloom.llm.common import shared_dir

RNG = random.Random(5)
TEXTS = [None, "", " ", "Hello world, it's 3 o'clock!\n\n  x", "日本語 naïve ÉÀ ΣΑΣ é 😀😀", "<|endoftext|> a <|startoftext|>b", "abc" * 3000] + [
    "".join(RNG.choices(["ing", "th", "er", " ", "é", "ción", "'s", "\n", "Qz", "0", "!!", "aaa", "ß", "日"], k=RNG.randrange(60))) for _ in range(300)
]


def frame(spark, n=3):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").repartition(n)


def test_transducer_equals_the_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark), path).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark), path), path, block=3)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(frame(spark).limit(0), path).count() == 0


def test_utf8_machine_waits_and_replaces():
    for text in ("aé日\U0001f600", "x"):
        for size in (1, 2, 3):
            machine, raw = bpe.Utf8Machine(), text.encode()
            assert "".join([machine.feed(raw[i : i + size]) for i in range(0, len(raw), size)] + [machine.feed(b"", True)]) == text
    machine = bpe.Utf8Machine()
    assert machine.feed(b"a\xe6\x97") + machine.feed(b"", True) == "a�"


def test_packing_any_width():
    for bits in (1, 5, 8, 13, 15, 16, 17, 31, 32):
        ids = np.array([RNG.randrange(1 << bits) for _ in range(501)], np.uint32)
        packed = bitpack.pack(ids, bits)
        assert len(packed) == (501 * bits + 7) // 8
        for a, b in ((0, 501), (3, 3), (77, 300), (500, 501)):
            assert (bitpack.unpack(packed, bits, a, b) == ids[a:b]).all()


def test_token_files_equal_the_library(spark):
    path, out = P.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/ids"
    library = Tokenizer.from_file(path)
    bitpack.write_ids(frame(spark), out, path, 50257, block_ids=500)
    got = {r.doc_id: r for r in bitpack.read_documents(spark, out).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert bitpack.read_one(spark, out, 3)[0].tolist() == [*library.encode(TEXTS[3], add_special_tokens=False).ids, 0]


def test_token_counts_equal_the_library(spark):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark), path, limit=10).collect()}
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 10), text


#: Every code point, behind a letter, a digit and a blank, and between them.
POINTS = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
EVERY = ["".join(f"a{c}1{c} {c}{c}b" for c in POINTS[i : i + 4096]) for i in range(0, len(POINTS), 4096)]


def pieces_frame(spark):
    return spark.createDataFrame(list(enumerate(EVERY)), "doc_id long, text string").repartition(8)


def test_every_code_point_is_counted_and_encoded_as_the_libraries_do(spark):
    counting, encoding = Tokenizer.from_file(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(pieces_frame(spark), P.path("word_bpe_49k.json")).collect()}
    assert [counted[i] for i in range(len(EVERY))] == [len(e.ids) for e in counting.encode_batch(EVERY, add_special_tokens=False)]
    out = f"{shared_dir(spark)}/points"
    bitpack.write_ids(pieces_frame(spark), out, P.path("byte_bpe_50k.json"), 50257)
    packed = {r.doc_id: r.ids_crc32 for r in bitpack.read_documents(spark, out).collect()}
    wanted = [zlib.crc32(np.array([*e.ids, 0], "<u4").tobytes()) for e in encoding.encode_batch(EVERY, add_special_tokens=False)]
    assert [packed[i] for i in range(len(EVERY))] == wanted
    ranks = bpe.ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(pieces_frame(spark), P.path("byte_bpe_50k.tiktoken")).collect()}
    assert [got[i] for i in range(len(EVERY))] == [hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in EVERY]


def test_odd_rows_of_token_operators(spark):
    """Null ids, repeated rows, an id of several texts, a text of two million characters, no rows, clashing columns."""
    long = "word Ünd 12 " * 170_000
    rows = [(None, "a b", 1), (None, "a b", 1), (7, "x", 2), (7, "x", 2), (7, "other text", 2), (8, None, 3), (9, long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(2)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows}
    wanted = sorted((d if d is not None else -1, size[t]) for d, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken")).collect()) == wanted
    out = f"{shared_dir(spark)}/odd"
    bitpack.write_ids(df, out, P.path("byte_bpe_50k.json"), 50257)
    got = bitpack.read_documents(spark, out).orderBy("start").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens - 1) for r in got) == wanted
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))] and [r.doc_id for r in got[:2]] == [None, None]
    assert len(bitpack.read_one(spark, out, 7)) == 3 and bitpack.read_one(spark, out, 1) == []
    counted = token_counts.token_counts(df, P.path("word_bpe_49k.json")).collect()
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in counted) == sorted((d if d is not None else -1, len(words.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    none = df.limit(0)
    bitpack.write_ids(none, f"{out}-none", P.path("byte_bpe_50k.json"), 50257)
    assert bitpack.read_documents(spark, f"{out}-none").count() == 0 == token_counts.token_counts(none, P.path("word_bpe_49k.json")).count()


def test_words_of_any_length_merge_as_the_library_does():
    import random

    from barloom.llm import token_counts

    path = P.path("word_bpe_49k.json")
    model, library = token_counts.merges(path), Tokenizer.from_file(path)
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdetaoinshr") for _ in range(n)) for n in (1, 2, 3, 8, 40, 200, 2000, 60_000)] + ["a" * 5000, "ab" * 3000, "thethe" * 700]
    for w in words:
        assert model.merge(w) == len(library.encode(w, add_special_tokens=False).ids)

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import alignment
from barloom.llm.token_counts import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_ends_equal_sets():
    draw = random.Random(1)
    for _ in range(3000):
        n = draw.randint(1, 60)
        dense = draw.random()
        a, b = (sorted({n, *(x for x in range(1, n) if draw.random() < dense)}) for _ in range(2))
        to_a, to_b = alignment.aligned_ends(a, b)
        both = sorted({*a} & {*b})
        assert [a[i - 1] for i in to_a] == both == [b[j - 1] for j in to_b]
    assert alignment.aligned_ends([], []) == ([], [])


def brute(texts):
    """Whole texts through both libraries, byte by byte."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in byte_letters().items()}
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text, num_threads=1)
        bytes_a = [bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
            found.append(None)
            continue
        of_a = [k for k, x in enumerate(bytes_a) for _ in x]
        of_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(of_a, of_b)))]
        cut = [k for k in range(1, len(of_a) + 1) if k == len(of_a) or (of_a[k] != of_a[k - 1] and of_b[k] != of_b[k - 1])]
        groups = []
        for s, e in zip([0, *cut], cut):
            groups.append(",".join(str(a[i]) for i in sorted(set(of_a[s:e]))) + "|" + ",".join(str(b[j]) for j in sorted(set(of_b[s:e]))))
        found.append((a, b, groups, links))
        counts.update(links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else (len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in found
    ]


def corpus():
    draw = random.Random(4)
    odd = ["", None, " ", "  ", "a ", " a", "a  b", "\n", "x\n y", "\t\t z ", "don 't", "it's <|endoftext|> <s> </s>", "▁", "a▁ b", "é à ü", "  x", "日本語の 文章", "👩‍👩‍👧 ok", "　 y", "x\x00y", "\x85 q", "\x1c w", "ﬁ Å", "a" * 3000, "ab" * 700 + " " + "z" * 400, "0123456789 12 3 456", "…—“quoted”", "á e"]
    letters = "abcdeéñ .,'\n\t 019日▁"
    return odd + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 300))) for _ in range(60)] + ["the quick brown fox jumps over the lazy dog. " * 9] * 3


def rows_of(df, **more):
    out = alignment.link_statistics(df, A, B, **more).collect()
    return [tuple(r[1:]) for r in sorted(out, key=lambda r: r.doc_id)]


def test_every_row_equals_the_libraries(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumns({"id": F.lit("x"), "row": F.lit(2), "pairs": F.lit(0)})
    expected = brute(texts)
    assert rows_of(df) == expected
    assert rows_of(df, few=10) == expected  # counts too many to broadcast


def test_spelled_groups(spark):
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (None, None)], "doc_id int, text string")
    got = alignment.align(df, A, B, spell=True).collect()
    assert [hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.n_a] == [True, True]
    assert len({r.row for r in got}) == 3
    assert rows_of(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("first", ["a", " ", "\n", "é", "."])
def test_every_character_before_a_blank(spark, first):
    points = [*range(1, 0x3000, 7), *range(0x3000, 0x10000, 997), 0x85, 0xA0, 0x1680, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x1C, 0x1F]
    texts = [f"{first}{chr(p)} b {chr(p)}" for p in points if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    assert rows_of(df) == brute(texts)

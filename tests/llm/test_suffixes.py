import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import suffixes


def brute(rows, length=50):
    """By every window of every text."""
    first = {}
    for i, t in rows:
        raw, key = (t or "").encode(), float("-inf") if i is None else i
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, float("inf")), key)
    out = []
    for i, t in rows:
        raw, key = (t or "").encode(), float("-inf") if i is None else i
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < key:
                gone[p : p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(raw):
            if gone[p]:
                a = p
                while p < len(raw) and gone[p]:
                    p += 1
                spans.append((a, p))
            else:
                p += 1
        out.append((i, len(raw), tuple(spans), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def told(df, **more):
    return [(r[0], r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in suffixes.repeats(df, **more).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    lines = [" ".join(draw.choices(words, k=12)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [draw.choice(lines) if draw.random() < 0.4 else " ".join(draw.choices(words, k=draw.randint(1, 25))) for _ in range(draw.randint(0, 6))]
        rows.append((i * 3 % 101 + 5, "\n".join(parts)))
    rows += [(None, lines[0]), (None, lines[0]), (7, rows[3][1]), (900, None), (901, ""), (902, "x" * 49), (903, "x" * 50), (904, "x" * 700), (905, "x" * 60 + lines[1] * 3)]
    rows += [(950 + k, rows[2][1] + " " + lines[2]) for k in range(5)] + [(960, rows[2][1][:-1])] * 2
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed, 120)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(7).withColumns({"chunk": F.lit("x"), "one": F.lit(1), "said": F.lit(2)})
    assert order(told(df)) == order(brute(rows))


def test_a_hot_anchor_goes_by_windows(spark):
    """One line in every document with other words around it: more stretches than any chunk bears for one anchor."""
    draw = random.Random(5)
    line = "all rights reserved, see terms of use at this place"
    rows = [(i, "".join(draw.choices("qwrtz", k=30)) + line + "".join(draw.choices("qwrtz", k=30))) for i in range(400)]
    got = told(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert order(got) == order(brute(rows))
    assert sum(bool(r[2]) for r in got) == 399


def test_other_lengths_and_names(spark):
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, "id long, body string")
    for length in (48, 130):
        assert order(told(df, length=length, id_col="id", text_col="body")) == order(brute(rows, length))
    with pytest.raises(ValueError):
        suffixes.repeats(df, length=20, id_col="id", text_col="body")


def test_a_long_text_over_many_slices(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, long), (2, long[131_000:131_140] + "!" + long[300_000:300_049] + "?" + "z" * 200_000)]
    got = dict((r[0], r) for r in told(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1][2] == () and got[2][2] == ((0, 140),)
    assert hashlib.sha256(got[2][3]).hexdigest() == hashlib.sha256(rows[1][1][140:].encode()).hexdigest()


def test_no_rows(spark):
    assert told(spark.createDataFrame([], "doc_id long, text string")) == []

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import regex

from barloom.llm.common import utf8
from barloom.llm.pretoken import classes, pieces

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def test_cuts_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["'", "'", "s", "t", "re", "ve", "ll", "d", " ", " ", "  ", "\n", "\t", "a", "Zß", "é", "1", "²3", "!", "…", "日本", " ", "😀", "\x1c", ""]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(4000)] + ["", "'", "a'", "'r", "'re", "x're", " 's", "\n's"]
    for words, pattern in ((False, P.PATTERN), (True, WORDS)):
        found, starts = pieces(*utf8(pa.array(texts)), words, classes("tokenizers" if words else "tiktoken"))
        all_pieces = np.array(found.to_pylist(), object)
        for text, a, b in zip(texts, starts, starts[1:]):
            assert list(all_pieces[a:b]) == regex.findall(pattern, text), repr(text)

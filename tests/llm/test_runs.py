"""Pieces are given to the library many at a time, and get the ids that they have on their own."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm.records import RUN, Encoder

ALPHABET = "abestnoABÿþé0 7.,'\"-$\nñß\t"


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def texts():
    draw = random.Random(7)
    made = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 60))) for _ in range(600)]
    return [*made, "", " ", "ÿþÿ þ", "it's we'll 'tis don't. \"so\"", "日本 naïve ÿ語", "a" * 3000 + " " + "b." * 900, None]


def test_ids_are_those_of_the_library(raw):
    encode = Encoder(raw)
    assert encode.borders is not None
    got = encode(pa.array(texts(), pa.string()))
    wanted = [encode.library.encode(t or "", add_special_tokens=False).ids for t in texts()]
    assert [np.frombuffer(x, encode.kind).tolist() for x in got] == wanted


def test_few_calls(raw):
    encode = Encoder(raw)
    calls, spell = [], encode.spell
    encode.spell = lambda word: calls.append(word) or spell(word)
    words = ["".join(random.Random(i).choices("abest", k=12)) for i in range(5 * RUN)]
    encode(pa.array([" ".join(words)], pa.string()))
    assert len(calls) <= 1  # the text's first piece; before, one for each piece


def test_vocabulary_that_merges_a_border(raw):
    spec = json.loads(raw)
    spec["model"]["vocab"]["ÿa"] = max(spec["model"]["vocab"].values()) + 2
    spec["model"]["merges"].append(["ÿ", "a"])
    encode = Encoder(json.dumps(spec))
    assert encode.borders is None
    got = encode(pa.array(texts(), pa.string()))
    wanted = [encode.library.encode(t or "", add_special_tokens=False).ids for t in texts()]
    assert [np.frombuffer(x, encode.kind).tolist() for x in got] == wanted

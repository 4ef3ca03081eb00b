"""Words with marks behind them are taken apart without the pattern, with the library's ids."""

import public_tokenizers
import pytest

from tidemark.llm import records

WORDS = ["word", "Straße", "naïve", "ÿ", "ªº", "don't", "it's", "a'", "x'S", "he'll'", "5", "x5", "_x", "x_", "(", "(word", "a-b", "", "ﬁ", "слово"]
TAILS = ["", ",", ".", "...", "'", "'s", "\"),", "!?'", "_", "-", "~" * 60, "§"]


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return records.Encoder(f.read())


def test_ids_are_the_librarys(encoder):
    for text in [f"{space}{w}{t}" for space in ("", " ") for w in WORDS for t in TAILS]:
        if text and max(text) < records.SETTLED:
            assert encoder.spelled(text) == encoder.whole(text), text


def test_marks_need_no_pattern(encoder, monkeypatch):
    class Pattern:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(records, "PRETOKEN", Pattern())
    assert encoder.spelled(" Größen,") == encoder.whole(" Größen,")
    assert encoder.spelled(" words?!") == encoder.whole(" words?!")

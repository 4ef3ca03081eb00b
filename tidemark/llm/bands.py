"""Quality by compression: text that compresses too well repeats itself, text that hardly
compresses is noise.

Ratio: compressed bytes by bytes, with zstandard, for the whole text and for each chunk of
fixed size. Short texts carry the format's overhead and have little to refer back to, so
limits depend on the length. A text is rejected if its whole ratio leaves the band of
its length, or if more than a stated share of its chunks leaves the band of a chunk. Every byte is in some chunk: the
rest behind the last full one is judged by the band of its own length.

The base figures of a text are counted beside: words, their characters, symbols, lines that repeat
an earlier line, words inside repeated runs of five words.

Defined results: a null or empty text has zero everywhere and fails the base rule; it has no ratio (null).
A text shorter than a chunk is its own only chunk. Rows are independent, so ties and repeated
rows are judged alike; other columns are carried along whatever their names."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import ship_code

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
RUN = 5
LEVEL = 3
CHUNK = 8192
#: A last chunk shorter than this reaches back into the one before, as the format's overhead would decide alone.
SHORTEST = 128
#: (bytes up to which the band holds, lowest ratio, highest ratio); the last one has no end.
BANDS = ((128, 0.30, 1.25), (512, 0.35, 0.98), (2048, 0.25, 0.85), (16384, 0.18, 0.75), (float("inf"), 0.12, 0.72))
#: Share of chunks outside their band above which a text is rejected.
BAD_CHUNKS = 0.25

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "ratio", "n_chunks", "n_low_chunks", "n_high_chunks"]
FIELDS = T.StructType([T.StructField(n, T.DoubleType() if n == "ratio" else T.LongType()) for n in NAMES])


def repeated_words(words: list[str]) -> int:
    """Words that lie in a run of five words found twice or more, the first one included."""
    number = len(words) - RUN + 1
    if number < 2:
        return 0
    # runs of equal words get equal numbers: first of two words, then of four, then of five
    one = pd.factorize(np.array(words, object))[0].astype(np.int64)
    two = pair(one[:-1], one[1:])
    four = pair(two[:-2], two[2:])
    five = pair(four[:-1], one[RUN - 1 :])
    again = np.bincount(five)[five] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(again)[0]
    edges[at] += 1
    np.subtract.at(edges, at + RUN, 1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return pd.factorize(left * (int(right.max()) + 1) + right)[0]


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def band(size: int) -> tuple[float, float]:
    return next((low, high) for end, low, high in BANDS if size <= end)


def figures(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    """Base figures and ratios of one text, in the order of ``FIELDS``."""
    if not text:
        return (0, 0, 0, 0, 0, 0, None, 0, 0, 0)
    words, raw = WORD.findall(text), text.encode()
    ratio = len(press.compress(raw)) / len(raw)
    low = high = chunks = 0
    for at in range(0, len(raw), CHUNK):
        part = raw[min(at, max(0, len(raw) - SHORTEST)) : at + CHUNK]
        least, most = band(len(part))
        of_part = len(press.compress(part)) / len(part) if len(raw) > CHUNK else ratio
        chunks, low, high = chunks + 1, low + (of_part < least), high + (of_part > most)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words),
        len(raw), ratio, chunks, low, high)


def measured(texts: Iterable[str | None]) -> list[tuple]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    return [figures(t, press) for t in texts]


@F.arrow_udf(FIELDS)
def _figures(text: pa.Array) -> pa.Array:
    columns = list(zip(*measured(t.as_py() for t in text))) or [()] * len(NAMES)
    kinds = [pa.float64() if n == "ratio" else pa.int64() for n in NAMES]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


def text_figures(text: str | Column) -> Column:
    """Struct of ``FIELDS``; marked as not deterministic so that it is worked out once."""
    return _figures.asNondeterministic()(text)


def base_failed(of: Column) -> Column:
    return (of["n_words"] < 10) | (100 * of["n_repeat_words"] > 20 * of["n_words"])


def in_band(of: Column) -> Column:
    """The method's verdict on a struct of figures."""
    outside = F.lit(False)
    start = 0
    for end, low, high in BANDS:
        here = (of["n_bytes"] > start) & (of["n_bytes"] <= F.lit(end))
        outside = outside | (here & ((of["ratio"] < low) | (of["ratio"] > high)))
        start = end
    bad = of["n_low_chunks"] + of["n_high_chunks"]
    return F.coalesce(~outside & (bad <= BAD_CHUNKS * of["n_chunks"]), F.lit(False))


def judged(docs: DataFrame, *, text_col: str = "text", into: str = "quality") -> DataFrame:
    """All columns and a struct ``into``: ``FIELDS``, ``base_failed`` and ``kept``."""
    ship_code(docs.sparkSession)
    of = F.col(f"`{into}`")
    return docs.withColumn(into, text_figures(F.col(text_col))).withColumn(
        into, of.withField("base_failed", base_failed(of)).withField("kept", ~base_failed(of) & in_band(of)))

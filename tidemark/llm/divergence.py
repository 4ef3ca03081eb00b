"""How far the sources of a language differ in their words.

Terms are runs of letters and of all code points above ASCII, A-Z lower-cased. A language keeps the terms
that at least ``DOCUMENTS`` of its documents hold. Every source (and the language as a whole) gives each kept term the
smoothed share p = 1 + floor(``SCALE`` * (count + ``PRIOR``) / (N + ``PRIOR`` * V)): N counts over kept terms, V kept
terms. Two parts come out: for each pair of sources the sum of abs(p - q) over all kept terms, and for each source
the terms it uses more than its language does, by how much.

Counting. A task takes a few MB of text at once, its documents sorted by source. Terms are found as changes of a byte
mask, and packed by length: up to eight bytes are one big-endian uint64, up to sixteen are two, sorted by radix passes over
16-bit digits; longer ones lie in buckets of equal length, sorted as bytes. All sorts are stable, so within a term
documents stay in order, and one look at the runs gives occurrences and documents by source.
Spark then adds up rows (language, source, term), never occurrences.

Sums over all kept terms are worked out from terms present only: terms of neither source give the same difference
each, terms of one source are counted by their p, and only terms of both are joined. A term has one row per source, so no
join key is hot, whatever one source or term holds.

Defined results: null language, source and text are ''. Every row is a document, repeated or not, whatever its id.
An empty table gives no rows; a language without kept terms gives pairs with value 0. Texts have no length limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, in_arrow, stored

DOCUMENTS, PRIOR, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of text that are counted together.
PART = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[97:123] = True
_IS_TERM[128:] = True


def radix_order(words: np.ndarray) -> np.ndarray:
    """Stable order of unsigned 64-bit integers, by 16 bits a pass from the lowest; digits that are
    the same everywhere cost no pass."""
    order = np.arange(len(words))
    for shift in (0, 16, 32, 48):
        digit = (words >> np.uint64(shift)).astype(np.uint16)
        if digit.min() != digit.max():
            # numpy sorts 16-bit integers by radix when asked for a stable order
            step = np.argsort(digit, kind="stable")
            order, words = order[step], words[step]
    return order


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of all terms in lower-cased bytes; none reaches over a document's start."""
    inside = _IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1 : len(data)]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1 : len(data)]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1 - first


def runs(order: np.ndarray, changes: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of terms in sorted order, with a mark where the term changes: where each (term, group)
    begins in that order, its occurrences and its documents."""
    group, doc = group[order], doc[order]
    changes[1:] |= group[1:] != group[:-1]
    fresh = changes.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(changes)
    return first, np.diff(np.append(first, len(order))), np.add.reduceat(fresh, first, dtype=np.int64)


def counted(texts: pa.Array, groups: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of binary texts, whose groups ascend."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(np.append(0, lengths))
    data = _LOWER[np.frombuffer(b"".join(texts.to_pylist()) + bytes(16), np.uint8)]
    begin, size = terms_of(data[: starts[-1]], starts[:-1][lengths > 0])
    doc = np.searchsorted(starts, begin, side="right") - 1
    windows = np.lib.stride_tricks.sliding_window_view(data, 16)

    for low, high in ((0, 4), (4, 8), (8, 16)):
        at = np.flatnonzero((size > low) & (size <= high))
        if not len(at):
            continue
        width = 2 if high == 16 else 1
        words = windows[begin[at]].view(">u8").astype(np.uint64)[:, :width]
        spare = (64 * width - 8 * size[at]).astype(np.uint64)  # bits behind the term
        words[:, -1] = words[:, -1] >> spare << spare
        order = radix_order(words[:, -1])
        if width == 2:
            order = order[radix_order(words[order, 0])]
        words = words[order]
        first, n, d = runs(order, np.append(True, (words[1:] != words[:-1]).any(axis=1)), groups[doc[at]], doc[at])
        yield groups[doc[at[order[first]]]], pa.array(words[first].astype(">u8").view(f"S{8 * width}").ravel(), pa.binary()), n, d

    for length in np.unique(size[size > 16]).tolist():
        at = np.flatnonzero(size == length)
        rows = np.lib.stride_tricks.sliding_window_view(data, length)[begin[at]].view(f"S{length}").ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first, n, d = runs(order, np.append(True, rows[1:] != rows[:-1]), groups[doc[at]], doc[at])
        yield groups[doc[at[order[first]]]], pa.array(rows[first], pa.binary()), n, d


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, d) of documents (lang, source, text): occurrences
    and documents, one row for each term and source of a part of a task."""
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 2, PART):
                names = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["lang", "source"])
                told = [(x["lang"], x["source"]) for x in names.to_pylist()]
                number = {pair: i for i, pair in enumerate(dict.fromkeys(told))}
                groups = np.array([number[pair] for pair in told], np.int64)
                order = np.argsort(groups, kind="stable")
                langs, sources = (pa.array([pair[i] for pair in number], pa.string()) for i in (0, 1))
                for group, term, n, d in counted(part.column(2).take(pa.array(order)), groups[order]):
                    group = pa.array(group)
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(group), sources.take(group), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                        ["lang", "source", "term", "n", "d"])

    return in_arrow(rows, run, "lang string, source string, term string, n bigint, d bigint")


def share(count: str | F.Column, total: str | F.Column, kept: str | F.Column, prior: int, scale: int) -> F.Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), in whole numbers of 38 digits."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    above = F.lit(scale).cast("decimal(10,0)") * (count + prior).cast("decimal(20,0)")
    below = (total + F.lit(prior) * kept).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *,
    documents: int = DOCUMENTS, prior: int = PRIOR, scale: int = SCALE, ranks: int = RANKS,
) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item`` (the other source, or the term), ``value`` and
    ``rank`` of all sources of all languages; of terms the first ``ranks``."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stored(term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "audit-counts")
    kept = stored(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("d")).where(F.col("d") >= documents).drop("d"), "audit-kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    there = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = there.groupBy("lang", "source").agg(F.sum("n").alias("total"))

    groups = stored(
        rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
        .na.fill(0, ["kept", "total_lang", "total"])
        .withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), "total", "kept", prior, scale)).otherwise(F.lit(0))), "audit-groups")
    terms = stored(
        there.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", share("n", "total", "kept", prior, scale).alias("p"), "base",
            share("n_lang", "total_lang", "kept", prior, scale).alias("q")), "audit-terms")

    # terms of one source against the other's share of terms it lacks; equal shares are counted together
    levels = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    one = groups.select("lang", F.col("source").alias("one"), F.col("base").alias("base_one"), "kept")
    other = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("base_other"))
    pairs = one.join(other, "lang").where("one <> other").withColumn("apart", F.abs(F.col("base_one") - F.col("base_other")))
    lone = (
        levels.withColumnRenamed("source", "one").join(pairs, ["lang", "one"])
        .groupBy("lang", "one", "other").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("base_other")) - F.col("apart"))).alias("f")))
    left = terms.select("lang", "term", F.col("source").alias("one"), F.col("p").alias("p_one"), F.col("base").alias("base_one"))
    right = terms.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p_other"), F.col("base").alias("base_other"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    common = left.join(right, ["lang", "term"]).where("one < other").groupBy("lang", "one", "other").agg(
        F.sum(gap("p_one", "p_other") - gap("p_one", "base_other") - gap("base_one", "p_other") + gap("base_one", "base_other")).alias("f"))
    turned = lambda df: df.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "f")
    parts = [pairs.select("lang", "one", "other", (F.col("kept") * F.col("apart")).alias("f")), lone, turned(lone), common, turned(common)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    by_pair = whole.groupBy("lang", F.col("one").alias("source"), F.col("other").alias("item")).agg(F.sum("f").alias("value"))
    by_term = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    placed = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.withColumn("rank", placed).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    # the limit on the rank reaches the tasks before the exchange, so no group is moved whole
    return ranked(by_pair, "pair").unionByName(ranked(by_term, "term").where(F.col("rank") <= ranks))

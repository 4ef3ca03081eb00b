"""Spelling variants: words one edit apart, each led to the commoner form it is a variant of.

Words come from runs of Latin letters (A-Z lower-cased) of whole texts. One run in ``EVERY`` of those a document
holds, chosen by its CRC-32 with the document's id, is read with a letter left out, so that the table has known misspellings.

Trie-node pairs. The words are sorted and dealt to parts by range, and the nodes of the trie of their prefixes are numbered
by one scan of each part: a word shares the nodes of the prefix it has in common with the word before it and
numbers the others anew. Prefixes of a part's first word may go on in other parts; they get their numbers from
the small trie of all first words, which every task works out alike. Any other prefix lies in one part. The trie of reversed
words is numbered likewise. A word cut at place i is then a pair of integers (node of the prefix, node of the suffix):

* cut with nothing left out, the pair names the word itself;
* with the letter at i left out, the pair names every word that has some letter at i, and the one that has none.

Two words are one replacement apart if they share a pair with a letter left out at the same place, and one insertion or
deletion apart if such a pair of the longer is a plain pair of the shorter. That is an exact join of integers: no
bounds, no verification, and memory in proportion to the letters of the words. A pair has at most one word for each
letter of the alphabet (90), so no key of the join is hot, however common a word is in the texts.

Defined results: a null text has no words; a null id counts as an empty one in the checksum. Repeated rows count. Words are
compared by code points. An empty table gives no rows."""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.golay import blocks
from tidemark.llm.shared import by_size, in_arrow, stored

RUN = re.compile("[a-zÀ-ÿ]+")
EVERY, LETTERS, TIMES, RATIO = 199, 6, 5, 5
#: Words that a task counts before it hands counts on, and trie nodes in a batch it returns.
HELD, NODES = 200_000, 1 << 20


def words_of(text: bytes, name: str) -> Counter[str]:
    """The words of a text with their occurrences; ``name`` is the document's id as text."""
    found: Counter[str] = Counter()
    for block in blocks(text.lower()):
        found.update(run for run in RUN.findall(block.decode()) if len(run) >= LETTERS)
    start, out = zlib.crc32(f"{name}:".encode()), Counter()
    for run, n in found.items():
        mark = zlib.crc32(run.encode(), start)
        if mark % EVERY == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LETTERS:
            out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words with ``TIMES`` occurrences or more."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def counts(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in by_size(batch, 1):
                for name, text in zip(part.column(0), part.column(1)):
                    held.update(words_of(text.as_py(), name.as_py()))
                    if len(held) > HELD:
                        yield counts(held)
                        held.clear()
        yield counts(held)

    return in_arrow(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def with_nodes(words: Iterator[tuple[int, str]], firsts: list[str]) -> Iterator[tuple[int, str, list[int]]]:
    """Number of the word and its prefixes' nodes, of sorted words with their part. ``firsts`` are the
    first words of all parts in order; their prefixes have the same (negative) nodes everywhere."""
    shared: list[list[int]] = []
    fresh = -1
    for i, word in enumerate(firsts):
        keep = common(firsts[i - 1], word) if i else -1
        nodes = shared[-1][: keep + 1] if i else []
        shared.append(nodes + list(range(fresh, fresh - (len(word) - keep), -1)))
        fresh -= len(word) - keep
    part, before, nodes, number, fresh = -1, "", [], 0, 0
    for of, word in words:
        if of != part:
            part, before, nodes, number, fresh = of, "", [], 0, of << 40
        at = bisect.bisect_right(firsts, word)
        near = max(range(max(0, at - 1), min(len(firsts), at + 1)), key=lambda i: common(firsts[i], word))
        known, keep = common(firsts[near], word), common(before, word) if nodes else -1
        nodes = nodes[: keep + 1] if keep > known else shared[near][: known + 1]
        grown = len(word) + 1 - len(nodes)
        nodes = nodes + list(range(fresh, fresh + grown))
        yield (part << 40) + number, word, nodes
        before, number, fresh = word, number + 1, fresh + grown


def trie(words: DataFrame, parts: int, name: str) -> DataFrame:
    """``word``, ``number`` (in word order) and ``nodes`` (of its prefixes, the empty one first) of different words."""
    dealt = stored(words.select("word").repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), name)
    # one word for each part; the number of parts is a setting
    firsts = sorted(r.word for r in dealt.groupBy("part").agg(F.min("word").alias("word")).collect())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, list[int]]] = []
        size = 0
        for row in with_nodes(told(batches), firsts):
            held.append(row)
            size += len(row[2])
            if size > NODES:
                yield batch_of(held)
                held, size = [], 0
        yield batch_of(held)

    def batch_of(held: list[tuple[int, str, list[int]]]) -> pa.RecordBatch:
        number, word, nodes = zip(*held) if held else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(number, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], ["word", "number", "nodes"])

    ordered = dealt.select("part", "word").repartition(parts, "part").sortWithinPartitions("part", "word")
    return in_arrow(ordered, run, "word string, number bigint, nodes array<bigint>")


def neighbours(words: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """The words with their number, and all pairs (a, b, n_b) of numbers of words one edit apart, both ways round."""
    forward = trie(words, parts, "variants-forward")
    backward = trie(words.select(F.reverse("word").alias("word")), parts, "variants-backward")
    both = forward.select("word", "number", "nodes").join(backward.select(F.reverse("word").alias("word"), F.col("nodes").alias("ends")), "word").join(words, "word")
    numbered = stored(both.withColumn("size", F.size("nodes") - 1), "variants-numbered")

    def cut(skipped: int) -> F.Column:
        places = F.sequence(F.lit(0), F.col("size") - skipped)
        return F.explode(F.transform(places, lambda i: F.struct(
            F.get("nodes", i).alias("head"), F.get("ends", F.col("size") - skipped - i).alias("tail"))))

    plain = numbered.select("number", "n", cut(0).alias("c")).select("number", "n", "c.*")
    left_out = stored(numbered.select("number", "n", cut(1).alias("c")).select("number", "n", "c.*"), "variants-left-out")
    a = left_out.select("head", "tail", F.col("number").alias("a"), F.col("n").alias("n_a"))
    b = left_out.select("head", "tail", F.col("number").alias("b"), F.col("n").alias("n_b"))
    replaced = a.join(b, ["head", "tail"]).where("a <> b").select("a", "b", "n_b")
    # equal letters in a row give the same shorter word for each of them
    shorter = a.join(plain.select("head", "tail", F.col("number").alias("b"), F.col("n").alias("n_b")), ["head", "tail"]).select("a", "n_a", "b", "n_b").distinct()
    edits = shorter.select(F.explode(F.array(
        F.struct("a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))).alias("e")).select("e.*")
    return numbered.select("number", "word", "n"), replaced.unionByName(edits)


def roots(forms: DataFrame) -> DataFrame:
    """``number`` and ``root``, the end of the chain, of links (number, root). A form has at least ``RATIO``
    times the occurrences, so chains are short and end; each round doubles the distance covered."""
    turn = 0
    while True:
        ahead = forms.select(F.col("number").alias("root"), F.col("root").alias("next"))
        further = stored(forms.join(ahead, "root", "left").select("number", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"variants-roots-{turn}")
        forms, turn = further.select("number", "root"), turn + 1
        if further.where("moved").isEmpty():
            return forms


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of all words of the texts."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = stored(word_counts(docs, id_col, text_col), "variants-words")
    numbered, near = neighbours(words, parts)
    # numbers are in word order, so the smallest of equally common neighbours has the smallest one
    best = stored(
        near.groupBy(F.col("a").alias("number")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("m"))
        .join(numbered.select("number", "n"), "number")
        .select("number", "n_near", F.when(-F.col("m.less") >= RATIO * F.col("n"), F.col("m.b")).alias("form")), "variants-near")
    ends = roots(best.where("form is not null").select("number", F.col("form").alias("root")))
    named = lambda number, word, n: numbered.select(F.col("number").alias(number), F.col("word").alias(word), F.col("n").alias(n))
    return (
        numbered.join(best.withColumnRenamed("form", "form_number"), "number", "left").join(ends.withColumnRenamed("root", "root_number"), "number", "left")
        .join(named("form_number", "form", "form_n"), "form_number", "left")
        .join(named("root_number", "root", "root_n"), "root_number", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"))

"""Benchmark passages in documents, by a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` consecutive words (an item with fewer words
is one window). A window is a set of shingles; a document contains it where all its shingles
stand in order. For full containment the necessary prefix is one shingle: put in order of rarity, the
first one must be in the document. So

1. one pass over all documents counts how often each benchmark shingle occurs,
2. each window picks its rarest shingle; windows with a shingle that no document has are out,
3. a second pass emits the places of picked shingles with the words around them,
4. a join on the shingle pairs places with windows; length and positional bounds drop windows
   that would start before or end after the text, and the words are compared exactly.

Both passes test shingles against a bit table of fixed size (a filter without false
negatives), so what is sent to tasks does not grow with the benchmark; a larger benchmark only lets
more places through. The windows' side of the join is repeated over a few salts, so
a passage that very many documents share is dealt over as many tasks.

Defined results: a null text has no words and no hits; items without words, and null items'
texts, have no windows; an item id may occur in several rows, its windows count together, and
null item ids are left out of the list of ids. Rows with equal ids are judged one by one,
equal rows get equal results. An empty benchmark or table is fine."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, in_arrow, stored

#: Fixed value: what separates words (after lower-casing A-Z, in UTF-8).
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SIZE, SHINGLE = 10, 5
#: Bits of the filter: 2 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 24
SALTS = 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def shingle_keys(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit key of each run of ``width`` words; a shorter text has none."""
    number = len(words) - width + 1
    if number <= 0:
        return np.empty(0, np.uint64)
    single = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    out = np.zeros(number, np.uint64)
    for i in range(width):
        out = (out ^ single[i : i + number]) * FACTOR
        out ^= out >> np.uint64(29)
    return out


def windows(benchmark: DataFrame, id_col: str, text_col: str, size: int, shingle: int) -> DataFrame:
    """Distinct (item, words, n, width) with the window's shingles: keys, each at its place."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    kind = "item string, words string, n int, width int, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                found = []
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    part = words[at : at + size]
                    width = min(shingle, len(part))
                    keys = shingle_keys(part, width).view(np.int64).tolist()
                    found.append((item.as_py(), b" ".join(part).decode(), len(part), width, keys))
                columns = list(zip(*found)) or [()] * 5
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "words", "n", "width", "keys"])

    return in_arrow(rows, run, kind).distinct()


def bit_table(keys: DataFrame) -> np.ndarray:
    """The filter of a column ``key``: at most ``FILTER_BITS`` / 64 numbers reach the driver."""
    bits = keys.select(F.pmod("key", F.lit(FILTER_BITS)).alias("bit")).distinct()
    cells = bits.groupBy(F.floor(F.col("bit") / 64).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for row in cells.collect():
        table[row["cell"]] = row["bits"]
    return table.view(np.uint8)


def passing(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    bit = keys % np.uint64(FILTER_BITS)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def occurrences(docs: DataFrame, text_col: str, table, widths: list[int]) -> DataFrame:
    """How often each shingle that passes the filter occurs: ``key``, ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 0):
                found = []
                for text in part.column(0):
                    words = words_of(text.as_py())
                    for width in widths:
                        keys = shingle_keys(words, width)
                        found.append(keys[passing(table.value, keys)])
                keys, times = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], ["key", "times"])

    part = in_arrow(docs.select(F.col(text_col).cast("binary").alias("text")), run, "key bigint, times bigint")
    return part.groupBy("key").agg(F.sum("times").alias("times"))


def places(docs: DataFrame, id_col: str, text_col: str, table, widths: list[int], size: int) -> DataFrame:
    """Per row: id, row (a digest of id and text), n_words, and the places of shingles that pass
    the filter, with the words that any window around them can take."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    spot = pa.struct([("key", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.string())])
    kind = f"id {rows.schema['id'].dataType.simpleString()}, row binary, n_words bigint, spots array<struct<key:bigint,at:bigint,first:bigint,words:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                digests, numbers, spots = [], [], []
                for i, text in zip(part.column(0), part.column(1)):
                    raw = text.as_py() or b""
                    words, found = words_of(raw), []
                    for width in widths:
                        keys = shingle_keys(words, width)
                        for at in np.nonzero(passing(table.value, keys))[0].tolist():
                            first = max(0, at + width - size)
                            found.append({"key": int(keys[at].view(np.int64)), "at": at, "first": first, "words": b" ".join(words[first : at + size]).decode()})
                    digests.append(xxhash.xxh3_128_digest(repr(i.as_py()).encode() + b"\0" + raw))
                    numbers.append(len(words))
                    spots.append(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array(numbers, pa.int64()), pa.array(spots, pa.list_(spot))],
                    ["id", "row", "n_words", "spots"])

    return in_arrow(rows, run, kind)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = SIZE, shingle: int = SHINGLE,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words in occurrences of windows),
    ``items`` (ids of items with occurring windows, as sorted strings)."""
    spark = docs.sparkSession
    cut = stored(windows(benchmark, item_col, item_text_col, size, shingle), "bench-windows")
    widths = sorted(r["width"] for r in cut.select("width").distinct().collect())  # at most ``shingle`` numbers
    each = cut.select("words", "n", "width", F.posexplode("keys").alias("offset", "key")).distinct()

    table = spark.sparkContext.broadcast(bit_table(each.select("key")))
    seen = stored(occurrences(docs, text_col, table, widths), "bench-seen")
    rarity = each.join(seen, "key", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    picked = stored(
        rarity.groupBy("words", "n", "width").agg(F.min(F.struct("times", "key", "offset")).alias("rare"))
        .where("rare.times > 0").select("words", "n", "rare.key", F.col("rare.offset").cast("bigint").alias("offset")),
        "bench-picked")

    chosen = spark.sparkContext.broadcast(bit_table(picked.select("key")))
    marked = stored(places(docs, id_col, text_col, chosen, widths, size), "bench-places")
    spots = marked.select("row", "n_words", F.explode("spots").alias("s")).select("row", "n_words", "s.*").withColumn(
        "salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)))
    salted = picked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    start = F.col("at") - F.col("offset")
    hits = (
        spots.join(salted.withColumnRenamed("words", "window"), ["key", "salt"])
        .where((start >= F.col("first")) & (start + F.col("n") <= F.col("n_words")))
        .where(F.slice(F.split("words", " "), (start - F.col("first") + 1).cast("int"), F.col("n")) == F.split("window", " "))
        .select("row", start.alias("start"), (start + F.col("n")).alias("end"), "window")
    )
    hits = stored(hits.distinct(), "bench-hits")

    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0)))
    covered = (
        hits.select("row", "start", "end").distinct().withColumn("new", F.greatest(F.col("end") - reach, F.lit(0)))
        .groupBy("row").agg(F.sum("new").alias("n_hit")))
    named = (
        hits.select("row", "window").distinct().join(cut.select("item", F.col("words").alias("window")).distinct(), "window")
        .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    found = covered.join(named, "row", "left")
    return marked.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))

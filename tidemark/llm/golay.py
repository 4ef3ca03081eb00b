"""Near-duplicate texts by SimHash, with Golay-code keys for the candidate search.

Fingerprint. Lower-cased words make shingles; bit i of the 64-bit fingerprint is set if it is
set in over half of the shingles' XXH64 hashes. Fingerprints link when they differ in at most
three bits; a component is what links connect.

Candidates. The fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code
is perfect: each 23-bit word lies within three bits of exactly one codeword, its own. A word
that differs from it in one bit lies within four bits of that codeword. So if ``near(x)`` are
the codewords within four bits of x (one, or six), then for words that differ in at most one
bit ``own(x)`` is in ``near(y)`` and the other way round. Of three differing bits

* some segment has none, and then one of the other two has one at most: keys hold one segment
  as it is and a codeword of another, ``own`` on one side and ``near`` on the other;
* or each segment has exactly one: keys hold a codeword of each segment, ``near`` for the
  first and ``own`` for the others on one side, the other way round on the other side.

Every linked pair therefore meets under some key, whose 30 to 36 bits keep chance meetings
rare. Pairs that meet are verified.

Large groups. Equal fingerprints are one node whatever their number of texts. Under each key
all fingerprints are first checked against the smallest only, and components of these links
are formed; pairs are then checked only between fingerprints that are still in different
components and under keys that still hold several. A dense group is connected by
its stars and never expanded into pairs, and no link between components is lost.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links
like any other; fewer words than a shingle make one shingle. Rows with equal ids are kept, each with its
own fingerprint; null ids are kept, and count for ``component_id`` only in the sense that a
component of null ids alone has a null one. An empty table gives an empty result."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import by_size, in_arrow, stored

WORD = re.compile(rb"[^ \t-\r]+")
SPACE = re.compile(rb"[ \t-\r]")
SEED = 42
#: Bytes of text whose shingles are hashed together.
BLOCK = 1 << 20
DISTANCE = 3

#: Length and generator polynomial of the binary Golay code, segments of a fingerprint.
GOLAY_BITS, GENERATOR = 23, 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))

INDEX, PROBE = 1, 2


def blocks(text: bytes) -> Iterator[bytes]:
    """Pieces of a text, cut at white space after ``BLOCK`` bytes each."""
    at = 0
    while len(text) - at > BLOCK:
        cut = SPACE.search(text, at + BLOCK)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit integer."""
    counts, total, held = np.zeros(64, np.int64), 0, []
    for block in blocks((text or b"").lower()):
        words = held + WORD.findall(block)
        if len(words) >= width:
            hashes = shingle_hashes(words, width)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            held = words[len(words) - width + 1 :]
        else:
            held = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, each counted once; zero for the empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed 64-bit integer) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                found = np.array([fingerprint(t.as_py(), width) for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def remainder(word: int) -> int:
    """Remainder of a 23-bit word by the generator polynomial."""
    for bit in range(GOLAY_BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, ...]:
    """Remainders of the three bytes of a word, and for each remainder the error patterns of
    up to four bits that have it (the first has at most three) with their number."""
    by_byte = [np.array([remainder(b << shift & 0x7FFFFF) for b in range(256)], np.uint32) for shift in (0, 8, 16)]
    single = [remainder(1 << bit) for bit in range(GOLAY_BITS)]
    errors = np.zeros((2048, 6), np.uint32)
    number = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(GOLAY_BITS), weight):
            left = functools.reduce(lambda a, b: a ^ single[b], bits, 0)
            errors[left, number[left]] = sum(1 << b for b in bits)
            number[left] += 1
    return *by_byte, errors, number


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word the indices of the codewords within four bits, its own first, as a
    table of six columns, and how many there are. The index is a codeword's upper 12 bits."""
    low, middle, high, errors, number = golay_tables()
    left = low[words & 255] ^ middle[words >> 8 & 255] ^ high[words >> 16]
    return (words[:, None] ^ errors[left]) >> 11, number[left]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints: (position in ``fps``, key, role)."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    coded = [near(p) for p in parts]
    columns = np.arange(6)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind, (same, other) in enumerate(itertools.permutations(range(3), 2)):
        indices, number = coded[other]
        row, column = np.nonzero(columns < number[:, None])
        key = (kind << 35) | (parts[same][row].astype(np.int64) << 12) | indices[row, column].astype(np.int64)
        out.append((row, key, np.where(column == 0, INDEX | PROBE, PROBE)))
    first, second, third = coded
    for spread, role in (((True, False, False), INDEX), ((False, True, True), PROBE)):
        sizes = [c[1] if wide else np.ones_like(c[1]) for c, wide in zip(coded, spread)]
        grid = (columns[:, None, None] < sizes[0][:, None, None, None]) & (columns[:, None] < sizes[1][:, None, None, None]) & (columns < sizes[2][:, None, None, None])
        row, a, b, c = np.nonzero(grid)
        key = (6 << 36) | (first[0][row, a].astype(np.int64) << 24) | (second[0][row, b].astype(np.int64) << 12) | third[0][row, c].astype(np.int64)
        out.append((row, key, np.full(len(row), role)))
    return tuple(np.concatenate(x) for x in zip(*out))


def keyed(nodes: DataFrame) -> DataFrame:
    """Rows (key, fp, role) of distinct fingerprints ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                row, key, role = keys(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row]), pa.array(role.astype(np.int8))], ["key", "fp", "role"])

    return in_arrow(nodes.select("fp"), run, "key bigint, fp bigint, role tinyint")


def close(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def roots(nodes: DataFrame) -> DataFrame:
    """``fp`` and ``root`` of all distinct fingerprints that link to another."""
    under = Window.partitionBy("key")
    met = stored(
        keyed(nodes).withColumns({"low": F.min("fp").over(under), "high": F.max("fp").over(under)})
        .where("low < high").select("key", "fp", "role", "low"),
        "simhash-met")
    stars = met.where((F.col("fp") != F.col("low")) & close("fp", "low")).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    first = components(stars, "simhash-stars")  # node, root

    placed = met.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_keys = stored(
        placed.withColumns({"least": F.min("root").over(under), "most": F.max("root").over(under)})
        .where("least < most").select("key", "fp", "role", "root"),
        "simhash-open")
    index = open_keys.where(F.col("role").bitwiseAND(INDEX) != 0).select("key", F.col("fp").alias("x"), F.col("root").alias("a"))
    probe = open_keys.where(F.col("role").bitwiseAND(PROBE) != 0).select("key", F.col("fp").alias("y"), F.col("root").alias("b"))
    rest = index.join(probe, "key").where((F.col("a") != F.col("b")) & close("x", "y")).select("a", "b").distinct()
    second = components(rest, "simhash-rest")

    whole = first.select(F.col("node").alias("fp"), F.col("root").alias("middle")).unionByName(
        # fingerprints that no star reached are their own first root
        second.join(first, "node", "left_anti").select(F.col("node").alias("fp"), F.col("node").alias("middle")))
    last = second.select(F.col("node").alias("middle"), F.col("root").alias("end"))
    return whole.join(last, "middle", "left").select("fp", F.coalesce("end", "middle").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id reachable over links) per row."""
    marked = stored(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    linked = stored(roots(nodes), "simhash-roots")
    member = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    ends = member.join(smallest, "root").select("fp", "component_id")
    # a fingerprint of very many texts is one row on the right; its rows on the left are split by AQE
    return marked.join(ends, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Token sequences as length-delimited binary records, with an offset index.

Format. A file ("shard") is a run of records. One record is

    length      8 bytes   little-endian, bytes of the payload
    check       4 bytes   masked checksum of the length field
    payload     length    document id (8 bytes, signed), 1 byte that says whether there is one,
                          1 byte width of an id (2 or 4), then the ids, little-endian
    check       4 bytes   masked checksum of the payload
    end         1 byte    a line feed

A checksum is CRC-32, rotated right by 15 bits, plus a constant (the masking keeps a
checksum stored inside checked data from weakening the check). The line feed is the record
separator of Spark's own text writer, which writes the bytes as they are: so files are
committed as any Spark output and can lie in any store.

Shards hold consecutive document ids in ascending order. The index is a table with a row per
record: shard, offset, length, document id, first token's place in the whole run of tokens,
number of tokens. A reader that shuffles takes rows of the index in any order and reads one
record at each.

Defined results: a null text gives a record with the end id alone; a null document id comes first;
rows with equal ids stand next to each other, ordered by their tokens. An empty table gives
no records and an empty index."""

from __future__ import annotations

import array
import functools
import json
import os
import struct
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import OTHER_SPACE, PRETOKEN, REMEMBERED, SETTLED, byte_letters
from tidemark.llm.shared import by_size, in_arrow

#: Fixed value: what is added to a rotated checksum.
MASK = 0xA282EAD8
HEAD, PAYLOAD_HEAD = struct.Struct("<QI"), struct.Struct("<qBB")
#: Pieces a task remembers in each of two generations.
MEMORY = 400_000
#: Bytes of text that are encoded together; each different piece of them is looked up once.
PART = 4 << 20
#: ASCII marks, neither letters nor digits. A run of them behind a word is a word of its own.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Runs of marks that a task remembers.
TAILS = 10_000
#: Pieces that are given to the library in one call, and how many of them make one run of letters.
TOGETHER, RUN = 4096, 64
#: Escapes of two bytes that no text has: what stands between two words of a piece, and between two pieces.
NEXT_WORD, NEXT_PIECE = "\udcfe", "\udcff"
INDEX = "id bigint, offset bigint, length bigint, n_tokens bigint, ids_crc32 bigint"


class DamagedRecord(ValueError):
    """A length or checksum does not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its line feed; ids are packed in ``width`` bytes each."""
    payload = PAYLOAD_HEAD.pack(doc_id or 0, doc_id is not None, width) + ids
    size = len(payload).to_bytes(8, "little")
    return size + masked(size).to_bytes(4, "little") + payload + masked(payload).to_bytes(4, "little")


def read_record(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document id and ids of the record at an offset, and where the next one starts."""
    if at + HEAD.size > len(data):
        raise DamagedRecord(f"a record is cut off at {at}")
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise DamagedRecord(f"wrong checksum of the length at {at}")
    start, end = at + HEAD.size, at + HEAD.size + size
    if end + 5 > len(data) or data[end + 4] != 10:
        raise DamagedRecord(f"a record is cut off at {at}")
    payload = data[start:end]
    if masked(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise DamagedRecord(f"wrong checksum of the payload at {at}")
    doc_id, known, width = PAYLOAD_HEAD.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload[PAYLOAD_HEAD.size :], f"<u{width}"), end + 5


class Encoder:
    """The ``tokenizers`` library over whole texts; pieces that recur are remembered.

    The library's byte-level pattern cuts a text into words that are encoded one by one, so
    cutting the text at such places before does not change the ids. Pieces of letters that all
    versions of Unicode class alike are cut here and given to the library's model word by word; it spends most
    of its time on what surrounds the model. Other pieces are given to the library as they are."""

    def __init__(self, raw: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only wait for each other
        self.library = Tokenizer.from_str(raw)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pre = json.loads(raw)["pre_tokenizer"] or {}
        self.cut_safely = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self.library.normalizer is None
        self.spell, self.letters, self.code = self.library.model.tokenize, byte_letters(), {2: "H", 4: "I"}[self.width]
        self.known: dict[str, bytes] = {}  # by piece, without the space before it
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.words = Tokenizer(self.library.model)  # cuts nothing
        self.borders = self._borders(json.loads(raw)["model"])
        self.byte_letter = np.array([ord(self.letters[b]) for b in range(256)], "<u4")

    def _borders(self, model: dict) -> tuple[int, int] | None:
        """Ids of the two bytes that no text has, if the model merges neither with anything: what stands
        on both sides of one is then encoded as it is on its own."""
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        letters = [self.letters[b] for b in (0xFE, 0xFF)]
        if any(c not in model["vocab"] for c in self.letters.values()) or any(c in entry for entry in model["vocab"] if len(entry) > 1 for c in letters):
            return None
        return model["vocab"][letters[0]], model["vocab"][letters[1]]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def missing(self, pieces: Collection[str]) -> list[str]:
        """Those that are in neither generation; those of the older one are taken over."""
        out = [p for p in pieces if p not in self.known]
        if self.older:
            self.known.update((p, self.older[p]) for p in out if p in self.older)
            out = [p for p in out if p not in self.known]
        return out

    def spelled(self, text: str) -> bytes:
        """Ids of a text of settled letters without added tokens."""
        core = text.rstrip(MARKS)
        word = core[1:]
        if core[:1] == " " and word.isalpha():  # one word, and the marks behind it
            ids = self.known.get(word)
            if ids is None:
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = self.packed(self.letters[32] + letters)
            return ids if len(core) == len(text) else ids + self.tail(text[len(core) :])
        words = (word.encode().decode("latin-1").translate(self.letters) for word in PRETOKEN.findall(text))
        return array.array(self.code, [t.id for word in words for t in self.spell(word)]).tobytes()

    def spelled_together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of settled letters, each with the space before it, from one call of the library."""
        cut = []
        for p in pieces:
            core = p.rstrip(MARKS)
            if not core.isalpha():
                cut.append(NEXT_WORD.join(PRETOKEN.findall(f" {p}")))
            elif len(core) == len(p):
                cut.append(f" {p}")
            else:  # one word, and the marks behind it
                cut.append(f" {core}{NEXT_WORD}{p[len(core):]}")
        runs = (NEXT_PIECE.join(cut[at : at + RUN]) + NEXT_PIECE for at in range(0, len(cut), RUN))
        data = (np.frombuffer(run.encode("utf-8", "surrogateescape"), np.uint8) for run in runs)
        letters = [self.byte_letter[d].tobytes().decode("utf-32-le") for d in data]
        ids = np.array([i for e in self.words.encode_batch_fast(letters, add_special_tokens=False) for i in e.ids], self.kind)
        word, piece = self.borders
        ids = ids[ids != word]
        ends = np.flatnonzero(ids == piece) * self.width
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *(ends + self.width).tolist()], ends.tolist())]

    def packed(self, word: str) -> bytes:
        """Ids of one word, given in byte letters."""
        return array.array(self.code, [t.id for t in self.spell(word)]).tobytes()

    def tail(self, marks: str) -> bytes:
        """Ids of a run of marks, which stand for themselves."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self.packed(marks)
            if len(marks) <= REMEMBERED and len(self.tails) < TAILS:
                self.tails[marks] = ids
        return ids

    def learn(self, pieces: Collection[str]) -> None:
        """Ids of new pieces, each with the space before it. Of those that aren't settled the library takes
        lists, cuts and encodes each by itself, and says which ids are whose."""
        odd, settled = [], []
        for p in self.missing(pieces):
            (settled if p.isascii() or max(p) < SETTLED else odd).append(p)
        if self.borders is None:
            for p in settled:
                self.known[p] = self.spelled(f" {p}")
        else:
            for at in range(0, len(settled), TOGETHER):
                group = settled[at : at + TOGETHER]
                self.known.update(zip(group, self.spelled_together(group)))
        for at in range(0, len(odd), 1024):
            group = odd[at : at + 1024]
            got = self.library.encode([f" {p}" for p in group], is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(got.ids, self.kind).tobytes(), np.array(got.word_ids)
            ends = (np.searchsorted(of, np.arange(len(group)), "right") * self.width).tolist()
            for p, start, end in zip(group, [0, *ends], ends):
                self.known[p] = ids[start:end]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        given = texts.to_pylist()
        simple = [bool(t) and self.cut_safely and not OTHER_SPACE.search(t) and not any(s in t for s in self.specials) for t in given]
        out = [b"" if not t or s else self.whole(t) for t, s in zip(given, simple)]
        # simple texts are cut at single spaces, each different piece is looked up once
        lists = pc.split_pattern(texts.filter(pa.array(simple, pa.bool_())), " ")
        offsets = lists.offsets.to_numpy()
        if len(lists) == 0:
            return out
        coded = lists.flatten().dictionary_encode()
        # by way of NumPy, which makes strings several times as fast as a list of scalars
        pieces, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        offsets = offsets - offsets[0]
        self.learn(pieces)
        begun = [pieces[k] for k in at[offsets[:-1]]]
        firsts = [b"" if not p else self.whole(p) if max(p) >= SETTLED else self.spelled(p) for p in begun]
        at[offsets[:-1]] = np.arange(len(pieces), len(pieces) + len(firsts))
        values = [*map(self.known.__getitem__, pieces), *firsts]
        size = np.fromiter(map(len, values), np.int32, len(values)) // self.width
        start = np.cumsum(size, dtype=np.int32) - size
        ids = np.frombuffer(b"".join(values), self.kind)
        sizes = size[at]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)]).astype(np.int32)  # a batch is below 2 GB
        run = ids[np.repeat(start[at] - ends[:-1], sizes) + np.arange(ends[-1], dtype=np.int32)]
        bounds = ends[offsets].tolist()
        made = (run[a:b].tobytes() for a, b in zip(bounds, bounds[1:]))
        out = [next(made) if s else o for s, o in zip(simple, out)]
        for p in pieces:
            if len(p) > REMEMBERED:
                self.known.pop(p, None)
        return out


@functools.lru_cache(maxsize=2)
def encoder(raw: str) -> Encoder:
    return Encoder(raw)


def shard_bounds(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> np.ndarray:
    """Ids at equal shares of the rows, one less than there are shards; an id that stands for
    many rows comes several times. Bounded by the number of files that will be written."""
    total = docs.select(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    shards = -(-total // shard_bytes) or 1
    shares = [i / shards for i in range(1, shards)]
    if not shares:
        return np.empty(0, np.int64)
    found = docs.select(F.percentile_approx(id_col, F.array(*map(F.lit, shares)), F.lit(10 * shards)).alias("p")).first()
    return np.sort(np.array(found["p"] or [], np.int64))


def write_records(docs: DataFrame, vocabulary: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 16 << 20) -> None:
    """Tokenize every text and write the shards below ``folder`` in ascending order of ids.

    Texts are tokenized where they are read; only packed ids are moved. A shard holds the ids
    of about ``shard_bytes`` of text. Rows with one id that fill several shares are dealt
    in turn over as many shards."""
    with open(vocabulary, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bounds = shard_bounds(rows, "id", "text", shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw.value)
        end, turn = end_id.to_bytes(encode.width, "little"), 0
        for batch in batches:
            for part in by_size(batch, 1, PART):
                ids = part.column(0)
                records = [frame(i, tokens + end, encode.width) for i, tokens in zip(ids.to_pylist(), encode(part.column(1)))]
                keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
                shard = low + (turn + np.arange(len(keys))) % (high - low + 1)
                shard[ids.is_null().to_numpy(zero_copy_only=False)] = 0
                turn += len(keys)
                yield pa.RecordBatch.from_arrays([ids, pa.array(shard, pa.int32()), pa.array(records, pa.binary())], ["id", "shard", "record"])
                del records
                pa.default_memory_pool().release_unused()

    (
        in_arrow(rows, run, "id bigint, shard int, record binary")
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions(F.asc_nulls_first("id"), "record")
        .select(F.expr("cast(record as string)").alias("value"))
        .write.option("lineSep", "\n").option("compression", "none").text(folder)
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all shards: ``shard`` (its place in the order of files), offset, length, id,
    n_tokens and the CRC-32 of the ids as unsigned 32-bit integers."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data, at, rows = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    doc_id, ids, following = read_record(data, at)
                    rows.append((path.as_py(), doc_id, at, following - at, len(ids), zlib.crc32(ids.astype("<u4"))))
                    at = following
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "id", "offset", "length", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return in_arrow(files.select("path", "content"), walk, f"file string, {INDEX}")


def offset_index(records: DataFrame) -> DataFrame:
    """The index: records with ``start``, the number of tokens in all records before.

    Shard totals (one row per file) are put in order; inside a file a running sum does."""
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    local = records.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(bases, "file").withColumn("start", F.col("base") + F.col("local")).drop("base", "local")


def read_at(spark: SparkSession, index: DataFrame, file: str, offset: int) -> tuple[int | None, list[int]]:
    """One record by its place, as a shuffled reader takes it (for single look-ups)."""
    length = index.where((F.col("file") == file) & (F.col("offset") == offset)).first()["length"]
    content = spark.read.format("binaryFile").load(file).select(F.substring("content", offset + 1, length)).first()[0]
    doc_id, ids, _ = read_record(memoryview(content), 0)
    return doc_id, ids.tolist()

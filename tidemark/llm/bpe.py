"""Byte-pair encoding and decoding with a given vocabulary file.

Encoding. A text is cut at added tokens, then by the library's byte-level pattern into pre-tokens. One
Aho-Corasick pass over a pre-token finds the longest vocabulary entry starting at each
place. Entries are laid from the left; an entry may follow another only if the pair is
compatible, that is if merging their joined bytes by rank gives back just these two. Where
nothing fits, shorter prefixes are tried and then the last entry is taken back. Places
proven to be dead ends are remembered, so the time is linear in the length, and the result
is exactly that of merging by rank. Equal pieces of text are looked up in a bounded memory
of the task.

Decoding. All entries' bytes lie in one buffer; a table of offsets gives each id's bytes.

Defined results: a null text is encoded like an empty one (no ids); null ids decode to an
empty text; an id outside the vocabulary raises an error; ids that do not form valid UTF-8 decode with
replacement characters. Rows are independent: ties and repeated rows are encoded alike."""

from __future__ import annotations

import array
import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm.shared import by_size, in_arrow

#: A space before a character that is no white space always starts a pre-token.
CUT = regex.compile(r" (?=[^\s\x1c-\x1f\x85])")
OTHER_SPACE = re.compile(r" (?=[\s\x1c-\x1f\x85]|\Z)")
#: Fixed value: the pattern that cuts text before byte-level merges.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this letter all versions of Unicode class characters alike.
SETTLED = "\u0250"
#: Results that a task remembers, in each of two generations, and the longest piece
#: (characters) that is remembered. A new word costs most, so most room is for words.
WORDS, PIECES, PAIRS, REMEMBERED = 250_000, 120_000, 150_000, 48
#: Bytes of a column that are worked on together.
PART = 4 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file (the JSON of the ``tokenizers`` library)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.ids: dict[str, int] = model["vocab"]
        byte_of = {c: b for b, c in byte_letters().items()}
        self.size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        pieces = [b""] * self.size
        for text, i in self.ids.items():
            pieces[i] = bytes(byte_of[c] for c in text)
        self.added = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError(f"added token {t['content']!r}: only plain matches are known")
            self.added[t["content"]] = t["id"]
            pieces[t["id"]] = t["content"].encode()
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in self.ids.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = self.ids[left + right]
            if whole in self.parts:
                raise ValueError(f"two merges give {left + right!r}")
            self.merge[self.ids[left], self.ids[right]] = rank
            self.parts[whole], self.rank[whole] = (self.ids[left], self.ids[right]), rank
        self.length = {i: len(text) for text, i in self.ids.items()}
        self.shorter = {i: self._prefix(text) for text, i in self.ids.items()}
        self.search = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.search.add_word(text, (i, len(text) - 1))
        self.search.make_automaton()
        # decoding: bytes of id i are data[at[i]:at[i + 1]]
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.letters = byte_letters()
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._pairs = Memory(lambda pair: self._merges_to(pair >> 32, pair & 0xFFFFFFFF), PAIRS)
        self._pieces = Memory(lambda piece: self._chunk(" " + piece), PIECES)
        self._words = Memory(lambda word: self.packed("".join(map(self.letters.__getitem__, word.encode()))), WORDS)

    def _prefix(self, text: str) -> int | None:
        return next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), None)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two entries by rank gives these two entries."""
        return self._pairs[left << 32 | right]

    def _merges_to(self, left: int, right: int) -> bool:
        """Going back through the merges that made both sides, from the latest, the neighbours
        at the border change one at a time; a merge across the border happens if it ranks
        before the next merge that would change one of the two neighbours. Equal merges run
        from the left, so on a tie the side right of the border waits."""
        upcoming = (float("inf"), 1)
        while True:
            across = self.merge.get((left, right))
            if across is not None and (across, 0.5) < upcoming:
                return False
            upcoming = max((self.rank[left], 0), (self.rank[right], 1))
            if upcoming[0] < 0:
                return True
            if upcoming[1] == 0:
                left = self.parts[left][1]
            else:
                right = self.parts[right][0]

    def encode_word(self, text: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        size = len(text)
        longest: list[int | None] = [None] * (size + 1)
        for end, (token, reach) in self.search.iter(text):
            longest[end - reach] = token  # later ends are longer
        out: list[int] = []
        dead = bytearray(size + 1)
        length, shorter, pairs = self.length, self.shorter, self._pairs
        place, token = 0, longest[0]
        while place < size:
            if token is None:  # nothing fits here: take the last entry back and shorten it
                dead[place] = 1
                if not out:
                    raise ValueError("the vocabulary does not cover all bytes")
                taken = out.pop()
                place -= length[taken]
                token = shorter[taken]
                continue
            end = place + length[token]
            if dead[end] or out and not pairs[out[-1] << 32 | token]:
                token = shorter[token]
                continue
            out.append(token)
            place = end
            token = longest[place]
        return out

    def packed(self, text: str) -> bytes:
        return array.array("I", self.encode_word(text)).tobytes()

    def _chunk(self, text: str) -> bytes:
        if not text:
            return b""
        if max(text) < SETTLED:
            return b"".join(map(self._words.__getitem__, PRETOKEN.findall(text)))
        # other letters are classed by the library itself, which gives words in byte letters
        return b"".join([self.packed(word) for word, _ in self.split(text)])

    def _plain(self, text: str) -> bytes:
        first, *rest = cut(text)
        return self._chunk(first) + b"".join(map(self._pieces.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added_pattern is None:
            return self._plain(text)
        out, place = [], 0
        for m in self.added_pattern.finditer(text):
            if m.start() > place:
                out.append(self._plain(text[place : m.start()]))
            out.append(self.added[m[0]].to_bytes(4, "little"))
            place = m.end()
        if place < len(text):
            out.append(self._plain(text[place:]))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Text of ids packed as by ``encode``."""
        given = np.frombuffer(ids or b"", "<u4").astype(np.int64)
        if given.size and given.max() >= self.size:
            raise ValueError(f"id {given.max()} is not in the vocabulary")
        start, sizes = self.at[given], self.at[given + 1] - self.at[given]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if given.size else 0) + np.repeat(start - (ends - sizes), sizes)
        return self.data[where].tobytes().decode("utf-8", "replace")


class Memory(dict):
    """Results by key. When too many are kept they become the older generation, from which
    those still in use are taken over, and the generation before is forgotten."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if isinstance(key, str) and len(key) > REMEMBERED:
                return got
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


def cut(text: str) -> list[str]:
    """Pieces of a text; all but the first had a space before them."""
    return CUT.split(text) if OTHER_SPACE.search(text) else text.split(" ")


@functools.lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def _shipped(df: DataFrame, path: str):
    """The vocabulary file (a few MB, bounded by its fixed number of entries) for every task."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``ids``, packed little-endian unsigned 32-bit."""
    file = _shipped(df, path)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            for part in by_size(batch, 1, PART):
                ids = [words.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id column, the packed ids and their ``text``."""
    file = _shipped(df, path)
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            for part in by_size(batch, 1, PART):
                text = [words.decode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["id", "ids", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, ids binary, text string").withColumnsRenamed({"id": id_col, "ids": ids_col})


def recode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: the id column, ``ids`` and the ``text`` that they decode to. A worker
    holds one vocabulary, where a chain of the two would start two workers with one each."""
    file = _shipped(df, path)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            for part in by_size(batch, 1, PART):
                ids = [words.encode(t.as_py()) for t in part.column(1)]
                text = [words.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], ["id", "ids", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)


def token_count(ids: str | Column) -> Column:
    """Number of packed ids."""
    return (F.octet_length(ids) / 4).cast("bigint")

"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def words(**times):
    return " ".join(w for w, n in times.items() for _ in range(n))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbours_equal_all_pairs(docs, parts):
    """Chains of forms, ties, repeated letters, prefixes of others, accents, words shared over all parts."""
    text = words(balloon=130, baloon=20, ballon=20, balloons=6, baloons=5, ballonn=5, ballooon=5, haloon=5, abcdef=25, abcdeg=25, abcdex=5, abcdefg=5)
    text += " " + words(façade=30, facade=6, FACADE=3, fáçade=5, aaaaaa=5, aaaaaaa=40, aaaaaaaa=200, ÉCOLES=5, écoles=9, École=50, naïveté=7)
    text += " " + words(unrelated=5, misspell=30, mispell=6, misspel=6, mispel=5) + " x×y÷zzz" * 5 + " " + ("q" * 3000 + " ") * 7 + ("q" * 2999 + " ") * 1400
    rows = [(i, text) for i in range(3)] + [(7, None), (None, text), (7, ""), (8, "balloon-balloon,balloon_balloon4balloon"), (8, "balloon")]
    assert result(variants.spelling_variants(docs(*rows), parts=parts)) == plain(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(variants.spelling_variants(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_no_words(docs):
    assert variants.spelling_variants(docs()).count() == 0
    assert variants.spelling_variants(docs((1, None), (2, "short ones"))).count() == 0


def test_nodes_are_the_same_in_all_parts():
    """Equal prefixes have equal nodes and others other ones, however words are dealt."""
    listed = sorted({"".join(c) for c in zip("abcabcbcacab" * 9, "aabbccabcabc" * 9, "aaaabbbbcccc" * 9)} | {"ab", "abc", "a", "caab", "cabbbb", "bca"})
    for cuts in ([0], [0, 1, 2, 3], [0, len(listed) // 2], list(range(len(listed)))):
        firsts = [listed[i] for i in cuts]
        part = [sum(1 for f in firsts if f <= w) - 1 for w in listed]
        seen, numbers = {}, []
        for number, word, nodes in variants.with_nodes(zip(part, listed), firsts):
            assert len(nodes) == len(word) + 1
            numbers.append(number)
            for i, node in enumerate(nodes):
                assert seen.setdefault(word[:i], node) == node
        assert len(set(seen.values())) == len(seen)
        assert numbers == sorted(set(numbers))

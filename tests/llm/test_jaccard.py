"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import golay, jaccard, sigtree


def plain_sets(texts, width=3):
    words = [golay.WORD.findall((t or "").encode().lower()) for t in texts]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]


def plain_components(sets, least=(9, 10)):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            common = len(a & sets[k])
            if a and least[1] * common >= least[0] * (len(a) + len(sets[k]) - common):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(pick, words, changes):
    copy = list(words)
    for at in pick.sample(range(len(copy)), changes):
        copy[at] = f"x{pick.random()}"
    return copy


def family(pick, size, number, most):
    base = [f"w{pick.randint(0, 100_000)}" for _ in range(size)]
    return [" ".join(edited(pick, base, pick.randint(0, most))) for _ in range(number)]


@pytest.mark.parametrize(("unit", "block"), [(128, 256), (8, 8)])
def test_families_of_all_densities(docs, monkeypatch, unit, block):
    """Dense and loose families, chains of small changes, sizes across a band's edge, copies and odd rows;
    with small units all three rounds have work."""
    monkeypatch.setattr(sigtree, "UNIT", unit)
    monkeypatch.setattr(sigtree, "BLOCK", block)
    pick = random.Random(3)
    texts = family(pick, 300, 60, 3) + family(pick, 300, 60, 12) + family(pick, 40, 30, 2) + family(pick, 12, 20, 1)
    chain = [f"c{i}" for i in range(200)]
    for _ in range(30):
        chain = edited(pick, chain, 2) + [f"t{pick.random()}"]
        texts.append(" ".join(chain))
    texts += [" ".join(f"g{i}" for i in range(n)) for n in range(8, 130)]  # each begins the next
    texts += [texts[0]] * 5 + [texts[0].upper(), None, "", " \t", "one", "One", "one two", "a b c", "a b c d"]
    pick.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_join(docs(*enumerate(texts))).collect()}
    sets = plain_sets(texts)
    assert [got[i] for i in range(len(texts))] == list(zip(map(len, sets), plain_components(sets)))


def test_rows_with_equal_and_null_ids(docs):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, "other words here"), (None, text), (3, text + " end"), (3, text + " end"), (None, None)]
    found = jaccard.similarity_join(docs(*rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == sorted(
        [(5, 48, 3), (5, 1, 5), (None, 48, 3), (3, 49, 3), (3, 49, 3), (None, 0, None)], key=str)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.similarity_join(docs()).count() == 0


@pytest.mark.parametrize("least", [(9, 10), (4, 5), (7, 10)])
def test_linked_sets_share_a_key(least):
    """Pairs exactly at the limit, of all sizes, also where many classes are empty."""
    pick = np.random.default_rng(1)
    num, den = least
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        drawn = pick.integers(0, 1 << 63, 3 * size, np.uint64)
        for other in range(size, size * den // num + 1):
            common = -(-num * (size + other) // (num + den))
            if common <= size and other < 200 or other == size:
                a, b = np.sort(drawn[:size]), np.sort(np.append(drawn[:common], drawn[size : size + other - common]))
                keys = [jaccard.candidate_keys(s, least) for s in (a, b)]
                assert np.array_equal(a, b) or np.intersect1d(*keys).size, (size, other)


def test_few_classes_empty_or_not(monkeypatch):
    """With hardly any class filled the other hashes' keys are needed, and found."""
    monkeypatch.setattr(jaccard, "space", lambda number, least: (1 if number == 0 else 10**9, 500, 3))
    drawn = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 60, np.uint64))
    keys = [jaccard.candidate_keys(s) for s in (drawn, drawn[3:])]
    assert np.intersect1d(*keys).size


def test_units_equal_all_pairs():
    pick = random.Random(8)
    for num, den in ((9, 10), (4, 5)):
        for two_sides in (False, True):
            base = [pick.getrandbits(60) for _ in range(150)]
            sets = [sorted({t if pick.random() > share else pick.getrandbits(60) for t in base}) for share in [0.02] * 40 + [0.06] * 40 + [0.3] * 10]
            part = np.arange(len(sets))
            part[10:20] = 10
            side = np.array([i % 2 if two_sides else 0 for i in range(len(sets))])
            starts = np.cumsum([0, *map(len, sets)])
            links = sigtree.unit_links(np.concatenate([np.array(s, np.uint64) for s in sets]), starts, part, side, num, den)

            def joined(edges):
                names = part.copy()
                for a, b in edges:
                    names[names == max(names[a], names[b])] = min(names[a], names[b])
                return names.tolist()

            alike = lambda a, b: den * len(set(a) & set(b)) >= num * len(set(a) | set(b))
            wanted = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b]) and (not two_sides or side[a] != side[b])]
            assert set(map(frozenset, links)) <= set(map(frozenset, wanted))
            assert joined(links) == joined(wanted)


def test_bound_holds():
    """No pair is dropped by the bitmaps of nodes that holds more tokens in common than they allow."""
    pick = np.random.default_rng(4)
    sets = [np.sort(pick.choice(4000, pick.integers(20, 60), replace=False).astype(np.uint64)) for _ in range(64)]
    starts, tokens = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
    bits = sigtree.bitmaps(tokens, starts, 256)
    size = np.diff(starts)
    spare = size - np.bitwise_count(bits).sum(axis=1)
    low = sigtree.Level(bits, size, size, spare, np.arange(64), np.zeros(64, int))
    top = low.above()
    for a in range(16):
        for b in range(a, 16):
            bound = np.bitwise_count(top.bits[a] & top.bits[b]).sum() + min(top.spare[a], top.spare[b])
            assert bound >= max(len(np.intersect1d(sets[x], sets[y])) for x in range(4 * a, 4 * a + 4) for y in range(4 * b, 4 * b + 4))

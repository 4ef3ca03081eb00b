"""Divergence of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, documents=30, ranks=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate(lower) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= documents]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        v = len(kept)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 5) // (total + 5 * v) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                placed = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, f, i + 1) for i, (f, item) in enumerate(placed)}
    return out


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string")


def test_equals_the_plain_version(spark, monkeypatch):
    """Terms of all lengths, nulls, empty groups, a source with most rows, more terms than ranks, small parts."""
    monkeypatch.setattr(divergence, "PART", 500)
    pick = random.Random(6)
    letters = ["a", "b", "Z", "é", "ß", "字", "𝒳"]
    terms = ["".join(pick.choice(letters) for _ in range(pick.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 30, 200]))) for _ in range(150)]
    rows = []
    for _ in range(900):
        lang, source = pick.choice(["en", "en", "de", None, ""]), pick.choice(["hot"] * 5 + ["a", "b", None, ""])
        text = pick.choice([" ", ",", "\x00", "7", "\n"]).join(pick.choice(terms) for _ in range(pick.randint(1, 30)))
        rows.append((lang, source, pick.choice([text] * 9 + [None])))
    rows += [("en", "silent", None), ("xx", "one", "rare words"), ("xx", "two", ""), ("yy", "alone", "x")] + [rows[0]] * 5
    assert result(divergence.audit(frame(spark, rows))) == plain(rows)
    assert result(divergence.audit(frame(spark, rows), documents=5, ranks=3)) == plain(rows, 5, 3)


def test_no_documents(spark):
    assert divergence.audit(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("count", [0, 4, 9_007_199_254_740_993, 2_000_000_000_000_000_000])
def test_shares_are_exact(spark, count):
    total, kept = 3 * count + 7, 11
    row = spark.range(1).select(divergence.share(divergence.F.lit(count), divergence.F.lit(total), divergence.F.lit(kept), 5, 1_000_000_000).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (count + 5) // (total + 5 * kept)


def test_radix_order_is_stable():
    words = np.random.default_rng(0).integers(0, 1 << 63, 5000, np.uint64) & np.uint64(0xFF00FF00FF00FF)
    words[2500:] = words[:2500]
    assert divergence.radix_order(words).tolist() == np.argsort(words, kind="stable").tolist()

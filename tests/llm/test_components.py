"""Components against plain union of sets, and how many edges rounds handle."""

import random

from tidemark.llm import components as operator


def plain(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


def found(spark, edges):
    rows = operator.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


def test_paths_stars_loops_and_chance(spark):
    pick = random.Random(3)
    names = pick.sample(range(-500, 500), 200)
    path = list(zip(names[:40], names[1:41]))
    star = [(10_000, n) for n in range(2000, 2030)] + [(2000, 1), (2029, 5000)]
    chance = [(3000 + pick.randint(0, 150), 3000 + pick.randint(0, 150)) for _ in range(110)]
    edges = [*path, *star, *chance, (7777, 7777), *path[:5], *[(b, a) for a, b in star]]
    assert found(spark, edges) == plain(edges)
    assert found(spark, []) == {}


def test_dense_groups_are_gone_after_a_round(spark, monkeypatch):
    kept, stored = {}, operator.stored

    def counted(df, name):
        out = stored(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(operator, "stored", counted)
    edges = [(a, b) for a in range(60) for b in range(60) if a != b]
    assert set(found(spark, edges).values()) == {0}
    assert sum(n for name, n in kept.items() if name.endswith("edges")) == 60 * 59 // 2

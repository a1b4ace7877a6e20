"""Reach, paths and cycles against plain walks on random graphs, and their rounds on long chains."""

import random
from contextlib import contextmanager

import pytest

from quillon.operators import lineage

KINDS = {"sparse": (40, 36), "dense": (14, 60), "forest": (60, 40), "hub": (50, 70)}


def random_edges(kind, seed):
    r = random.Random(seed)
    n, m = KINDS[kind]
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
    if kind == "hub":
        pairs |= {(i, 0) for i in range(1, 25)} | {(0, i) for i in range(25, 50)} | {(49, 3)}
    if kind == "forest":  # long chains, some of them closed
        pairs |= {(100 + i, 101 + i) for i in range(30)} | {(130, 100)} | {(200 + i, 201 + i) for i in range(30)} | {(230, r.randrange(n)), (5, 200)}
    return sorted(pairs)


def frame(spark, pairs):
    return spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in pairs], "source string, target string")


def depths(pairs, root):
    """Least steps to every node that is reached, the root included only through a cycle."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out, level, depth = {}, {root}, 0
    while level:
        depth += 1
        level = {b for a in level for b in after.get(a, ())} - set(out)
        out |= dict.fromkeys(level, depth)
    return out


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_reach_and_cycles(spark, kind):
    for seed in range(2):
        pairs = random_edges(kind, seed)
        edges, nodes = frame(spark, pairs), sorted({x for p in pairs for x in p})
        below = {a: depths(pairs, a) for a in nodes}
        roots = nodes[:: max(1, len(nodes) // 6)]
        start = spark.createDataFrame([(f"{a:04d}",) for a in roots], "node string")
        for limit in (None, 3, 20):
            got = {(r["root"], r["node"], r["depth"]) for r in lineage.reach(edges, start, max_depth=limit).collect()}
            assert got == {(f"{a:04d}", f"{b:04d}", d) for a in roots for b, d in below[a].items() if limit is None or d <= limit}
        cyclic = {a for a in nodes if a in below[a]}
        leads = {f"{a:04d}" for a in nodes if a in cyclic or cyclic & set(below[a])}
        assert {r["node"] for r in lineage.circular_assets(edges).collect()} == leads


def test_shortest_paths_are_the_smallest_of_equals(spark):
    pairs = random_edges("dense", 5) + random_edges("forest", 5)
    edges = frame(spark, pairs)
    for a, b in [(0, 9), (5, 230), (3, 3), (9, 4)]:
        level, best = [[a]], None
        for _ in range(60):
            ends = [p for p in level if p[-1] == b]
            if ends:
                best = min(ends)
                break
            longer = {}
            for p in level:
                for x, y in pairs:
                    if x == p[-1] and y not in p:
                        longer[y] = min(longer.get(y, [*p, y]), [*p, y])
            level = list(longer.values())
        found = lineage.shortest_path(edges, f"{a:04d}", f"{b:04d}").first()
        assert (found and found["path"]) == (best and [f"{x:04d}" for x in best])


@contextmanager
def counted(monkeypatch, tables):
    own = lineage.scratch

    @contextmanager
    def counting(spark, purpose):
        with own(spark, purpose) as keep:
            yield lambda df: (tables.append(purpose), keep(df))[1]

    monkeypatch.setattr(lineage, "scratch", counting)
    yield
    monkeypatch.setattr(lineage, "scratch", own)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n = 2000
    chain = spark.range(n).selectExpr("format_string('%06d', id) AS source", "format_string('%06d', id + 1) AS target")
    tables = []
    with counted(monkeypatch, tables):
        got = lineage.reach(chain, spark.createDataFrame([("000000",)], "node string"))
    assert got.count() == n and got.agg({"depth": "max"}).first()[0] == n
    assert len(tables) <= 3 + 2 * 12  # a level and a doubled stride each round
    tables.clear()
    long = spark.range(20_000).selectExpr("format_string('%06d', id) AS source", "format_string('%06d', id + 1) AS target")
    with counted(monkeypatch, tables):
        assert lineage.circular_assets(long).count() == 0 and len(tables) < 40
        tables.clear()
        ring = long.unionAll(spark.createDataFrame([("020000", "000000")], long.schema))
        assert lineage.circular_assets(ring).count() == 20_001 and len(tables) < 60


def test_a_hub_keeps_the_stride(spark):
    """Doubling through a hub would pair all that enter with all that leave."""
    pairs = [(i, 1000) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(2000, 3000), (3000, 3001), (3001, 3002)]
    links = lineage._links(frame(spark, pairs), "downstream")
    assert lineage._doubled(links, len(pairs), lambda df: df) is None
    got = lineage.reach(frame(spark, pairs), spark.createDataFrame([("0000",)], "node string"))
    assert got.count() == 1 + 300 + 3


def test_graphs_without_links(spark):
    edges = spark.createDataFrame([], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert lineage.reach(edges, start).count() == 0 and lineage.circular_assets(edges).count() == 0
    assert lineage.shortest_path(edges, "a", "b").count() == 0

"""Traversals against brute force on random graphs, and long chains."""

import random

import numpy as np
import pytest

from lodestone.functions import predicates, text
from lodestone.operators import graph


def reached(links):
    """For each id all that a walk of one step or more from it meets."""
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for start in {x for e in links for x in e}:
        seen, todo = set(), [start]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[start] = seen
    return out


def plain_components(links):
    ahead = reached(links)
    return {a: min([a, *(b for b in ahead[a] if a in ahead[b])]) for a in ahead if a in ahead[a]}


@pytest.mark.parametrize("seed,n,m,small", [(1, 40, 50, 10**6), (2, 60, 70, 10**6), (3, 30, 80, 10**6), (4, 14, 18, -1)])
def test_cyclic_parts_and_callers(spark, monkeypatch, seed, n, m, small):
    """In one task, and with every turn in Spark."""
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(seed)
    links = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)}
    links = sorted((a, b) for a, b in links if a != b)
    df = spark.createDataFrame(links, "source string, target string")
    assert {r["id"]: r["component"] for r in graph.cyclic(df).collect()} == plain_components(links)
    ahead = reached(links)
    nodes = spark.createDataFrame([(x,) for x in [*ahead, "alone"]], "id string")
    from pyspark.sql import functions as F

    got = {r["id"]: r["callers"] for r in graph.blast_radius(df.withColumn("kind", F.lit("calls")), nodes).collect()}
    assert got == {x: sum(1 for a in ahead if a != x and x in ahead[a]) for x in ahead} | {"alone": 0}


def test_components_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(rng.integers(1, 12)), int(rng.integers(0, 25))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        reach = np.eye(n, dtype=bool)
        reach[a, b] = True
        for k in range(n):
            reach |= reach[:, k : k + 1] & reach[k : k + 1]
        part = graph._strong(a, b, n)
        assert ((part[:, None] == part[None, :]) == (reach & reach.T)).all()


def test_a_long_chain_and_a_long_ring(spark):
    order = list(range(1000))
    random.Random(4).shuffle(order)
    chain = [(f"c{a:04}", f"c{b:04}") for a, b in zip(order, order[1:])]
    ring = [(f"r{k:04}", f"r{(k + 1) % 1000:04}") for k in range(1000)]
    got = {r["id"]: r["component"] for r in graph.cyclic(spark.createDataFrame(chain + ring, "source string, target string")).collect()}
    assert got == {f"r{k:04}": "r0000" for k in range(1000)}


def test_a_path_of_many_steps(spark):
    calls = [(f"p{k:03}", f"p{k + 1:03}", "calls") for k in range(12)] + [("p000", "q", "calls"), ("q", "p002", "calls"), ("a", "p001", "calls")]
    edges = spark.createDataFrame(calls, "source string, target string, kind string")
    assert [r["path"] for r in graph.shortest_path(edges, "p000", "p012").collect()] == [[f"p{k:03}" for k in range(13)]]
    assert graph.shortest_path(edges, "p012", "p000").isEmpty()
    assert [r["path"] for r in graph.shortest_path(edges, "p000", "p002").collect()] == [["p000", "p001", "p002"]]


def test_roots_kept_apart(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("x", "c", "calls"), ("c", "c", "calls")], "source string, target string, kind string")
    seeds = spark.createDataFrame([("1", "a"), ("2", "x")], "root string, id string")
    got = {(r["root"], r["id"], r["depth"]) for r in graph.reach(edges, seeds, "down").collect()}
    assert got == {("1", "a", 0), ("1", "b", 1), ("1", "c", 2), ("2", "x", 0), ("2", "c", 1)}


def test_terms_are_cut_as_the_index_is(spark):
    nodes = spark.createDataFrame([("1", "my_func", ""), ("2", "Éclair", ""), ("3", "func my", ""), ("4", "ǅabČ_ét", "")], "id string, name string, qualified_name string")
    index = text.tokens(nodes, ("name", "qualified_name"))
    found = lambda *terms: {r["node_id"] for r in text.match(index, list(terms)).collect()}
    assert found("my_func") == {"1"} and found("MY func") == {"1"} and found("Éclair") == found("eclair") == {"2"}
    assert found("my") == {"1", "3"} and found("abc_et".replace("abc", "ǆabč")) == {"4"} and found("?!") == set()
    with pytest.raises(ValueError):
        text.match(index, ["a NEAR b"])


def test_paths_are_cleaned_as_by_the_filter(spark):
    from lodestone.functions.globs import normalize

    paths = ["./a/b", "/a//b/", "a/../b", "../a", "a/../../b", "a/b/..", "..", "", "/", "a\\b\\..\\c", " x/./y ", "a/..//", "../../x/../y/"]
    got = [r[0] for r in spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k long, p string").orderBy("k").select(predicates.clean_path("p")).collect()]
    assert got == [normalize(p) for p in paths]


def test_the_hash_wraps_at_64_bits(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) % 2**64
        h -= 2**64 * (h >= 2**63)
        return abs(h) % 1000

    texts = ["", "a", "some/long/path/to/a/file.go", "é" * 40, "x" * 500, "pkg/日本/テスト.go"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k").select(predicates.short_hash("t")).collect()]
    assert got == [plain(t) for t in texts]


def test_what_leads_to_a_cycle_does_not_keep_it_open(spark, monkeypatch):
    """Before, the least id of all reached the ring, so that it was searched twice, and links were shuffled for every mark again."""
    monkeypatch.setattr(graph, "SMALL", 0)
    spread, turns = graph._spread, []
    monkeypatch.setattr(graph, "_spread", lambda *a: turns.append(a[2]) or spread(*a))
    links = [("a", "r0"), ("r3", "z"), *((f"r{k}", f"r{(k + 1) % 6}") for k in range(6))]
    got = {r["id"]: r["component"] for r in graph.cyclic(spark.createDataFrame(links, "source string, target string")).collect()}
    assert got == {f"r{k}": "r0" for k in range(6)} and turns == ["down-0", "up-0"]

import random

import pytest

from quarrylib.operators import graph
from quarrylib.operators.components import connected_components


def reach(edges):
    out = {}
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            for x, y in edges:
                if x == todo[0] and y not in seen:
                    seen.add(y)
                    todo.append(y)
            todo.pop(0)
        out[a] = seen
    return out


def brute(nodes, edges):
    """Component of each node on a cycle, and layers."""
    r = reach(edges)
    part = {n: min([n, *(m for m in r.get(n, ()) if n in r.get(m, ()))]) for n in nodes}
    cyclic = {n: part[n] for n in nodes if n in r.get(n, ())}
    memo = {}

    def level(p):
        if p not in memo:
            memo[p] = max((1 + level(part[b]) for a, b in edges if part[a] == p and part[b] != p), default=0)
        return memo[p]

    return cyclic, {n: level(part[n]) for n in nodes}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["local", "rounds"])
def way(request, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 100_000 if request.param == "local" else 0)


GRAPHS = [
    [], [(1, 1)], [(1, 2), (2, 1), (3, 1)], [(1, 2), (2, 3), (3, 4), (1, 4)],
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 5), (6, 6)],
]


def check(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    df = spark.createDataFrame(edges, "src long, dst long")
    cyclic, levels = brute(range(n), set(edges))
    assert dict(rows(graph.strong_components(df).select("node", "component"))) == cyclic
    assert dict(rows(graph.layers(nodes, df))) == levels


@pytest.mark.parametrize("edges", GRAPHS)
def test_small_graphs(spark, way, edges):
    check(spark, 8, edges)


def test_random_graphs(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        check(spark, 14, [(rnd.randrange(14), rnd.randrange(14)) for _ in range(rnd.choice((8, 16, 30)))])


def test_random_graph_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    rnd = random.Random(3)
    check(spark, 14, [(rnd.randrange(14), rnd.randrange(14)) for _ in range(16)])


def test_walks(spark, way):
    edges = [("api", "domain"), ("ui", "domain"), ("api", "core"), ("domain", "utils"), ("utils", "core"), ("tests", "api")]
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e} | {"alone"}], "node string")
    layered = graph.layers(nodes, df)
    assert rows(graph.critical_path(layered, df)) == [(0, "core"), (1, "utils"), (2, "domain"), (3, "api"), (4, "tests")]
    assert [tuple(r) for r in graph.waves(layered).orderBy("wave").collect()][0] == (0, 2, ["alone", "core"])
    none = df.limit(0)
    assert rows(graph.critical_path(graph.layers(nodes.limit(0), none), none)) == []


def test_neighbourhood_does_not_walk_up_from_what_it_found_below(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 1)], "src long, dst long")
    at = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.neighbourhood(df, at, up=0, down=1)) == [(1,), (2,)]
    assert rows(graph.neighbourhood(df, at, up=2, down=1)) == [(1,), (2,), (4,)]
    assert rows(graph.induced(df, at)) == []


def test_closure_and_dependents(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 3)]
    df = spark.createDataFrame(edges + edges[:1], "src long, dst long")
    assert set(rows(graph.closure(df))) == {(a, b) for a, s in reach(edges).items() for b in s}
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    assert [r for r in rows(graph.dependents(nodes, df)) if r[0] in (3, 5)] == [(3, 1), (3, 2), (3, 3), (3, 4), (5, 5)]
    assert rows(graph.degrees(nodes, df))[:3] == [(0, 0, 0), (1, 1, 2), (2, 2, 1)]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(200 + i, 201 + i) for i in range(30)] + [(7, 7), (None, 3)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: top(x) for x in root}
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []

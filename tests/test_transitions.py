"""The part-transition graph's queries over a whole small table, by brute force."""

import random
from collections import defaultdict

import pytest

from lodestone.operators import graph, strong
from lodestone.plans import bindings
from test_operators import closure

N = 30


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Orders 1 to 39, none of them divisible by 40, and the distinct transitions."""
    rng = random.Random(5)
    rows = [(o, line, rng.randrange(N)) for o in range(1, 40) for line in range(1, 1 + rng.randint(1, 3))]
    path = tmp_path_factory.mktemp("transitions")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, "STANDARD") for k in range(N)], "p_partkey long, p_type string").write.parquet(f"{path}/part.parquet")
    return str(path), sorted({(a[2], b[2]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0]})


def depths(edges, start, most):
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    found, front = {start: 0}, {start}
    for d in range(1, most + 1):
        front = {y for x in front for y in to[x]} - set(found)
        found |= dict.fromkeys(front, d)
    return {v: d for v, d in found.items() if d}


@pytest.mark.parametrize("small_edges", [graph.SMALL_EDGES, 0])
def test_components_of_all_orders(spark, made, monkeypatch, small_edges):
    path, edges = made
    reach = closure(N, edges)
    used = {x for e in edges for x in e}
    of = {v: min(w for w in used if reach[v][w] and reach[w][v]) for v in used}
    whole = graph.strong_components
    monkeypatch.setattr(graph, "strong_components", lambda e: whole(e, small_edges))
    assert {r.vertex: r.component for r in bindings.QUERIES["scc"](spark, path).collect()} == of
    sizes = {c: sum(x == c for x in of.values()) for c in of.values()}
    cyclic = {c: n for c, n in sizes.items() if n > 1 or (c, c) in edges}
    assert cyclic and {r.component: r["size"] for r in bindings.QUERIES["cycles"](spark, path).collect()} == cyclic


def test_impact_of_all_orders(spark, made):
    path, edges = made
    back = [(b, a) for a, b in edges]
    for name, e in (("impact_down", edges), ("impact_up", back)):
        assert {r.vertex: r.depth for r in bindings.QUERIES[name](spark, path).collect()} == depths(e, min(a for a, _ in e), 3)
    got = bindings.QUERIES["impact_budgeted"](spark, path).collect()
    assert {r.value: r.depth for r in got if r.what == "reached"} == depths(edges, min(a for a, _ in edges), 16)


def test_impact_by_levels_and_in_one_task(spark):
    rng = random.Random(9)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(k, k + 1) for k in range(100, 160)})
    rows = spark.createDataFrame([*edges, *edges[:5], (None, 1), (1, None)], "a long, b long")
    seeds = spark.createDataFrame([(0,), (100,), (999,), (None,)], "vertex long")
    for most in (3, 200):
        want = depths(edges, 0, most) | depths(edges, 100, most)
        assert {r.vertex: r.depth for r in graph.impact(rows, seeds, most).collect()} == want
    few = rows.filter("a < 100 OR a > 157")
    assert {r.vertex: r.depth for r in graph.impact(few, seeds, 3, small_edges=0).collect()} == depths([e for e in edges if e[0] < 100], 0, 3)
    assert graph.impact(rows.limit(0), seeds, 3).collect() == [] and graph.strong_components(rows.limit(0)).collect() == []


def test_components_of_many_arcs_by_their_outline(spark, monkeypatch):
    rng = random.Random(3)
    edges = {(x, y) for lo in (0, 15) for x in range(lo, lo + 15) for y in range(lo, lo + 15) if rng.random() < 0.6} | {(3, 20), (4, 21), (28, 28), (40, 40)}
    edges |= {(50 + x, 50 + y) for x in range(15) for y in range(x)}  # no ring in these
    dealt, whole = [], strong.edge_blocks
    monkeypatch.setattr(strong, "edge_blocks", lambda arcs, n: dealt.append(arcs.count()) or whole(arcs, n))
    reach = closure(65, edges)
    used = {x for e in edges for x in e}
    want = {v: min((w for w in used if reach[v][w] and reach[w][v]), default=v) for v in used}
    rows = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {r.vertex: r.component for r in graph.strong_components(rows, small_edges=0).collect()} == want
    assert dealt and max(dealt) <= 4 * 45 < len(edges)


def test_cycles_take_transitions_once(spark, made):
    plan = bindings.QUERIES["cycles"](spark, made[0])._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "Window" not in plan

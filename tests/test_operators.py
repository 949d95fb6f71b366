"""Operators against small fixtures and independent oracles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, ignore_rules, inventory, limits, resolution, store, waves


def random_graph(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    return n, [(a, b) for a in range(n) for b in range(n) if rng.random() < 0.2]


def closure(n, edges):
    reach = [[a == b for b in range(n)] for a in range(n)]
    for a, b in edges:
        reach[a][b] = True
    for k in range(n):
        for a in range(n):
            for b in range(n):
                reach[a][b] = reach[a][b] or (reach[a][k] and reach[k][b])
    return reach


def test_components_of_100_random_graphs_in_one_task(spark):
    rows, expected = [], {}
    for seed in range(100):
        n, edges = random_graph(seed)
        reach = closure(n, edges)
        rows += [(seed * 100 + a, seed * 100 + b) for a, b in edges]
        for v in {x for e in edges for x in e}:
            expected[seed * 100 + v] = seed * 100 + min(w for w in range(n) if reach[v][w] and reach[w][v])
    edges = spark.createDataFrame(rows, "a long, b long")
    got = {r.vertex: r.component for r in graph.strong_components(edges).collect()}
    assert got == expected


@pytest.mark.parametrize("block_edges", [5, 1000])
def test_components_by_contraction_and_colours(spark, block_edges):
    rows, expected = [], {}
    for seed in range(40):
        n, edges = random_graph(seed)
        reach = closure(n, edges)
        rows += [(seed * 100 + a, seed * 100 + b) for a, b in edges]
        for v in {x for e in edges for x in e}:
            expected[seed * 100 + v] = seed * 100 + min(w for w in range(n) if reach[v][w] and reach[w][v])
    edges = spark.createDataFrame(rows, "a long, b long").repartition(3)
    assert {r.vertex: r.component for r in graph.strong_components(edges, small_edges=0, block_edges=block_edges).collect()} == expected


def brute_components(edges):
    names = sorted({x for e in edges for x in e})
    place = {v: k for k, v in enumerate(names)}
    reach = closure(len(names), [(place[a], place[b]) for a, b in edges])
    return {v: names[min(w for w in range(len(names)) if reach[k][w] and reach[w][k])] for v, k in place.items()}


def test_components_of_rings_trees_and_chains(spark):
    rng = random.Random(3)
    name = list(range(1000))
    rng.shuffle(name)
    ring = [(k, (k + 1) % 12) for k in range(12)]  # with trees below and above it
    edges = ring + [(k % 12, 12 + k) for k in range(10)] + [(12 + k, 30 + k) for k in range(10)] + [(50 + k, k) for k in range(5)]
    edges += [(100 + k, 101 + k) for k in range(30)] + [(130, 115)] + [(200 + k, 201 + k) for k in range(9)] + [(209, 200), (205, 100)]
    edges += [(300 + k, 300 + (k + d) % 40) for k in range(40) for d in (1, 2)] + [(310, 400), (400, 401), (401, 320), (320, 500)]
    edges = [(name[a], name[b]) for a, b in edges]
    df = spark.createDataFrame([*edges, (999, 999), (None, 1)], "a long, b long").repartition(3)
    want = brute_components([*edges, (999, 999)])
    for small in (0, 60):
        assert {r.vertex: r.component for r in graph.strong_components(df, small_edges=small, block_edges=25).collect()} == want


def test_labels_settle_in_blocks(spark):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(150)} | {(k, k + 1) for k in range(100, 400)})
    df = spark.createDataFrame(edges, "a long, b long")
    begin = spark.createDataFrame([(0, 0), (1, 2), (100, 0), (999, 5)], "vertex long, label long")
    want = {0: 0, 1: 2, 100: 0, 999: 5}
    for _ in range(500):
        for a, b in edges:
            if a in want and want[a] + 1 <= 250:
                want[b] = min(want.get(b, 1 << 60), want[a] + 1)
    for size in (20, 1000):
        assert {r.vertex: r.label for r in waves.spread(waves.edge_blocks(df, size), begin, 1, 250).collect()} == want


def test_nodes_that_disagree(spark):
    rows = spark.createDataFrame([("a", "x", k) for k in (3, 1, 2, 1)] + [("b", "y", 5)], "id string, name string, line int")
    assert sorted(tuple(r) for r in graph.merged_nodes(rows, ["id"], ["name"], "line", 2).select("id", "name", "evidence", "omitted_evidence").collect()) == [("a", "x", [1, 2], 1), ("b", "y", [5], 0)]
    with pytest.raises(graph.Conflicting):
        graph.merged_nodes(rows.union(spark.createDataFrame([("b", "z", 5)])), ["id"], ["name"], "line", 2)


def test_components_of_no_edges(spark):
    assert graph.strong_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.strong_components(spark.createDataFrame([(3, 3)], "a long, b long"), small_edges=0).collect() == [(3, 3)]


def test_impact_and_its_budgets(spark):
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0)]
    df = spark.createDataFrame([(a, b, f"e{a}{b}", True) for a, b in edges], "a long, b long, edge_id string, eligible boolean")
    seeds = spark.createDataFrame([(0,)], "vertex long")
    assert {tuple(r) for r in graph.impact(df, seeds, 2).collect()} == {(1, 1), (2, 1), (3, 2)}
    assert {tuple(r) for r in graph.impact(df, seeds, 9, outward=False).collect()} == {(4, 1), (3, 2), (1, 3), (2, 3)}
    full = graph.budgeted_impact(df, [0], 64, 100, 100)
    assert full.reached == [(1, 1), (2, 1), (3, 2), (4, 3)] and not full.reasons and full.scanned == 6
    short = graph.budgeted_impact(df, [0], 64, 2, 100)
    assert short.reasons == ["node_limit"] and short.scanned == 2 and short.edge_ids == ["e01"]
    assert graph.budgeted_impact(df, [0], 64, 100, 1).reasons == ["edge_limit"]
    assert graph.budgeted_impact(df, [0], 1, 100, 100).reasons == ["depth_limit"]


def test_boundary_is_promoted_by_a_sure_edge(spark):
    df = spark.createDataFrame([(0, 1, "a", True), (0, 2, "b", False), (1, 2, "c", True), (1, 3, "d", False)], "a long, b long, edge_id string, eligible boolean")
    found = graph.budgeted_impact(df, [0], 64, 100, 100)
    assert found.reached == [(1, 1), (2, 2)] and found.boundary == [3]


def test_edge_evidence_is_distinct_capped_and_counted(spark):
    rows = [(1, 2, "x"), (1, 2, "x"), (1, 2, "y")]
    df = spark.createDataFrame(rows, "a long, b long, source string")
    expected = [(1, 2, 3, ["x"], 1)]
    for n in (1, 3):  # the order of rows does not matter
        assert [tuple(r) for r in graph.aggregate_edges(df.repartition(n), ["a", "b"], "source", 1).collect()] == expected


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a/b.py", True), ("/x", "a/x", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("?.c", "x/b.c", True), ("?.c", "ab.c", False), ("?.c", "d/.c", False), ("a.b", "axb", False)])
def test_globs(glob, path, hit):
    rule = ignore_rules.compile_rule(0, glob)
    assert bool(re.search(rule.regex.replace(r"\z", r"\Z"), path)) == hit


def test_character_classes_are_refused():
    with pytest.raises(ValueError, match="character classes"):
        ignore_rules.compile_rule(0, "[ab]")


def test_last_rule_wins_and_directories_cover_what_is_below(spark):
    entries = inventory.with_directories(spark.createDataFrame([("build/a.o",), ("build/keep.txt",), ("src/a.o",), ("x\n.o",)], "path string"))
    rules = ignore_rules.rules_table(spark, [("", "build/"), ("", "!keep.txt"), ("src", "*.o"), ("", "# no"), ("", "")])
    got = {r.path: r.ignored for r in ignore_rules.decide(entries, rules).collect()}
    assert got == {"build": True, "build/a.o": True, "build/keep.txt": False, "src": False, "src/a.o": True, "x\n.o": False}


def test_truncation_counts_what_it_leaves_out(spark):
    rows = spark.createDataFrame([(g, k) for g in "ab" for k in range(5)], "g string, k int")
    kept, tally = limits.top_per_group(rows, ["g"], [F.col("k")], 3)
    assert kept.count() == 6 and tuple(tally.first()) == (6, 4)
    limited = limits.global_limit(rows, [F.col("g"), F.col("k")], 4).collect()
    assert [(r.g, r.k, r.omitted) for r in sorted(limited)] == [("a", 0, 7), ("a", 1, 7), ("a", 2, 7)]
    assert {r.omitted for r in limits.global_limit(rows, [F.col("k")], 10).collect()} == {0}


def test_keyset_pages_cover_everything_once(spark):
    rows = spark.createDataFrame([(f"k{i:02}",) for i in range(7)], "k string")
    seen, last, more = [], None, True
    while more:
        page = sorted(limits.keyset_page(rows, "k", last, 3).collect())
        seen += [r.k for r in page]
        last, more = page[-1].k, page[-1].has_more
    assert seen == [f"k{i:02}" for i in range(7)]


def test_unanimity(spark):
    proofs = [(1, "resolved", "x"), (1, "resolved", "x"), (2, "resolved", "x"), (2, "resolved", "y"), (3, "external", None), (4, "stale", None), (4, "ambiguous", None), (5, "resolved", "x"), (5, "external", None)]
    got = {r.g: (r.state, r.target) for r in resolution.unanimous(spark.createDataFrame(proofs, "g int, s string, t string"), ["g"], "s", "t").collect()}
    assert got == {1: ("resolved", "x"), 2: ("ambiguous", None), 3: ("external", None), 4: ("unresolved", None), 5: ("unresolved", None)}


def test_import_decision_table(spark):
    names = ["id", "stale", "binding", "has_target", "proofs", "proof_missing", "proofs_disagree", "omitted", "targets_stale", "targets_unverified", "all_external", "all_standard"]
    base = {"stale": False, "binding": None, "has_target": False, "proofs": 1, "proof_missing": False, "proofs_disagree": False, "omitted": False, "targets_stale": False, "targets_unverified": False, "all_external": True, "all_standard": False}
    cases = [
        ({"stale": True}, "stale"), ({}, "unresolved"), ({"binding": "resolved", "proof_missing": True, "omitted": True}, "unresolved"),
        ({"binding": "resolved", "proofs_disagree": True}, "error"), ({"binding": "resolved", "targets_stale": True}, "stale"),
        ({"binding": "resolved", "targets_unverified": True}, "unresolved"), ({"binding": "resolved"}, "resolved_local"), ({"binding": "ambiguous", "has_target": True}, "error"),
        ({"binding": "ambiguous"}, "ambiguous"), ({"binding": "external", "proofs": 0, "omitted": True}, "unresolved"), ({"binding": "external", "proofs": 0}, "error"),
        ({"binding": "external", "all_external": False}, "error"), ({"binding": "external", "all_standard": True}, "standard_library"), ({"binding": "external"}, "external"),
    ]
    rows = [tuple(({"id": k} | base | c)[n] for n in names) for k, (c, _) in enumerate(cases)]
    kinds = "id int, stale boolean, binding string, has_target boolean, proofs int, proof_missing boolean, proofs_disagree boolean, omitted boolean, targets_stale boolean, targets_unverified boolean, all_external boolean, all_standard boolean"
    got = {r.id: r.state for r in resolution.import_state(spark.createDataFrame(rows, kinds)).collect()}
    assert [got[k] for k in range(len(cases))] == [x for _, x in cases]


def test_payloads_survive_chunking(spark):
    rows = spark.createDataFrame([("abc" * 1000,), ("é" * 700,), ("abc" * 1000,), (None,)], "t string")
    stored = store.payloads(rows, "t")
    again = store.reassemble(store.chunks(stored, 512)).collect()
    assert stored.count() == 2 and all(r.verified for r in again) and sorted(r["size"] for r in again) == [1400, 3000]
    assert store.stage(stored, stored).count() == 0


def test_lifecycle(spark):
    steps = spark.createDataFrame([(1, 1, "new"), (1, 2, "run"), (1, 3, "new"), (2, 1, "run")], "k int, t int, s string")
    allowed = spark.createDataFrame([("new", "run")], "previous string, next string")
    assert [(r.k, r.t) for r in store.violations(steps, "k", ["t"], "s", allowed).collect()] == [(1, 3)]


def test_rule_lines_come_by_depth_and_path(spark):
    files = spark.createDataFrame([("b/.gitignore", "*.x\n\n!keep.x"), (".gitignore", "*.log"), ("a/c/.gitignore", "deep"), ("a/.gitignore", "z")], "path string, content string")
    lines = ignore_rules.rule_lines(files, ["last"])
    assert lines == [("", "*.log"), ("a", "z"), ("b", "*.x"), ("b", "!keep.x"), ("a/c", "deep"), ("", "last")]
    entries = spark.createDataFrame([("b/q.x", False), ("b/keep.x", False), ("q.x", False), ("a/z", True), ("a/z/in", False), ("z", False), ("last", False)], "path string, is_dir boolean")
    got = {r.path: r.ignored for r in ignore_rules.decide(entries, ignore_rules.rules_table(spark, lines)).collect()}
    assert got == {"b/q.x": True, "b/keep.x": False, "q.x": False, "a/z": True, "a/z/in": True, "z": False, "last": True}


def test_few_levels_of_a_large_graph_are_joined(spark):
    rows = [(a, (a * a + k) % 50) for a in range(50) for k in range(2)] + [(None, 1), (3, None)]
    edges, after = spark.createDataFrame(rows, "a long, b long"), {}
    for a, b in rows[:-2]:
        after.setdefault(a, set()).add(b)
    for depth in (0, 1, 3, 8):
        seen, front = {7: 0, 900: 0}, {7}
        for level in range(1, depth + 1):
            front = {b for a in front for b in after.get(a, ())} - set(seen)
            seen |= dict.fromkeys(front, level)
        found = graph.impact(edges, spark.createDataFrame([(7,), (900,), (None,)], "vertex long"), depth, small_edges=0)
        assert "MapInArrow" not in found._jdf.queryExecution().toString()
        assert {r.vertex: r.depth for r in found.collect()} == {v: d for v, d in seen.items() if d}

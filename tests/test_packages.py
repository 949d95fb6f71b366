"""Package proofs and the dependency graph on small checkouts."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dependency_graph, packages, semantics, validity
from lodestone.plans import facts


def proofs(spark, imports, modules=(), declared=(), required=(), replacements=(), kind="module"):
    found = packages.package_proofs(
        spark.createDataFrame(imports, "module string, import_path string"),
        spark.createDataFrame([("c", kind, ["app", "lib"])], "context string, kind string, members array<string>"),
        spark.createDataFrame(list(modules), "context string, module_path string, target string"),
        spark.createDataFrame(list(declared), "import_path string, module_path string, version string"),
        spark.createDataFrame(list(required), "module string, module_path string, version string"),
        spark.createDataFrame(list(replacements), "owner string, old_path string, old_version string, target string, filesystem boolean"),
    )
    return {(r.module, r.import_path): (r.kind, r.status, r.target) for r in found.collect()}


def test_longest_module_wins(spark):
    got = proofs(spark, [("app", "ex.org/lib/sub/x"), ("app", "ex.org/lib2"), ("app", "ex.org/two"), (None, "ex.org/lib")], [("c", "ex.org/lib", "a"), ("c", "ex.org/lib/sub", "b"), ("c", "ex.org/two", "d"), ("c", "ex.org/two", "e")])
    assert got["app", "ex.org/lib/sub/x"] == ("same_module", "resolved", "b")
    assert got["app", "ex.org/lib2"] == (None, "external", None)
    assert got["app", "ex.org/two"] == ("same_module", "ambiguous", None)
    assert got[None, "ex.org/lib"] == (None, "unresolved", None)


def test_replacements(spark):
    required = [("app", "dep", "v1"), ("app", "dep/deep", "v2"), ("app", "far", "v1")]
    rules = [("app", "dep", None, "any", True), ("app", "dep", "v1", "exact", True), ("app", "dep", "v9", "no", True), ("app", "dep/deep", None, "deep", True), ("app", "far", None, "m@v2", False), ("app", "unasked", None, "u", True), ("c", "far", None, "near", True)]
    asked = [("app", x) for x in ("dep/a", "dep/deep/b", "far/x", "unasked/y", "depth")]
    own = proofs(spark, asked, required=required, replacements=rules)
    assert own["app", "dep/a"] == ("local_replace", "resolved", "exact") and own["app", "dep/deep/b"] == ("local_replace", "resolved", "deep")
    assert own["app", "far/x"] == own["app", "unasked/y"] == own["app", "depth"] == (None, "external", None)
    work = proofs(spark, asked, required=required, replacements=rules, kind="workspace")
    assert work["app", "far/x"] == ("local_replace", "resolved", "near") and work["app", "dep/a"] == own["app", "dep/a"]


def test_vendored(spark):
    declared = [("dep/a", "dep", "v1"), ("dep/b", "dep", "v2"), ("odd/c", "dep", "v1"), ("dep/d", "dep", "v1"), ("dep/d", "dep", "v1")]
    got = proofs(spark, [("app", x) for x in ("dep/a", "dep/b", "odd/c", "dep/d", "none")], declared=declared, required=[("app", "dep", "v1")], kind="module_vendor")
    assert [got["app", x][:2] for x in ("dep/a", "dep/b", "odd/c", "dep/d", "none")] == [("vendor", "resolved"), ("vendor", "unresolved"), ("vendor", "unresolved"), ("vendor", "ambiguous"), ("vendor", "external")]


def test_versions(spark):
    values = [("1.18", True), ("1.17.9", False), ("2.0", True), ("1.21rc2", True), ("1", False), ("x.18", False), ("", False), (None, False), (" 1.18 ", True), ("1.x", False)]
    rows = spark.createDataFrame([(v,) for v, _ in values], "v string").select("v", packages.version_at_least(F.col("v"), 1, 18).alias("ok")).collect()
    assert [(r.v, r.ok) for r in rows] == values


@pytest.fixture
def candidates(spark):
    modules = spark.createDataFrame([("m", "ex.org/m", ""), ("n", "ex.org/n", "n")], "module string, module_path string, root string")
    owned = spark.createDataFrame([("p", ""), ("q", "n/q"), ("r", "nn")], "package string, directory string")
    files = spark.createDataFrame([("f", "a.go", "p"), ("g", "n/q/b.go", "q"), ("h", "nn/c.go", "r"), ("x", "loose.go", None)], "file string, path string, package string")
    imports = spark.createDataFrame([("f", "ex.org/n/q", "c", "resolved_local", "q"), ("f", "ex.org/m/nn", "c", "resolved_local", "r"), ("f", "fmt", "c", "external", None), ("g", "fmt", "c", "external", None), ("x", "lost", "c", "resolved_local", "no-such")], "file string, import_path string, context string, resolution string, target string")
    references = spark.createDataFrame([(1, "f", "g"), (2, "f", "f"), (3, "g", None)], "reference long, file string, target_file string")
    return dependency_graph.translated(modules, owned, files, imports, references)


def test_three_graphs(spark, candidates):
    nodes, edges, contained, diagnostics = candidates
    g, _, lost = dependency_graph.normalised(nodes.union(nodes), edges, contained, 100, 1)
    dependency_graph.checked(g)
    named = {r.id: f"{r.kind}:{r.name if r.kind in ('module', 'package', 'file') else r.resolution}" for r in g.nodes.collect()}
    got = sorted((r.graph, r.kind, named[r.from_id], named[r.to_id], r.occurrences) for r in g.edges.collect())
    assert got == [
        ("file", "imports", "file:f", "external_package:external", 1), ("file", "imports", "file:f", "package:q", 1), ("file", "imports", "file:f", "package:r", 1), ("file", "imports", "file:g", "external_package:external", 1), ("file", "imports", "file:x", "unresolved:resolved_local", 1),
        ("file", "references", "file:f", "file:g", 1),
        ("module", "imports", "module:ex.org/m", "module:ex.org/n", 1),
        ("package", "imports", "package:p", "external_package:external", 1), ("package", "imports", "package:p", "package:q", 1), ("package", "imports", "package:p", "package:r", 1), ("package", "imports", "package:q", "external_package:external", 1),
    ]
    assert sorted((named[r.parent_id], named[r.child_id]) for r in g.containment.collect()) == [("module:ex.org/m", "package:p"), ("module:ex.org/m", "package:r"), ("module:ex.org/n", "package:q"), ("package:p", "file:f"), ("package:q", "file:g"), ("package:r", "file:h")]
    assert sorted((r.code, r.path) for r in diagnostics.collect()) == [("go_import_external", "a.go"), ("go_import_external", "n/q/b.go"), ("go_reference_unresolved", "n/q/b.go")]
    s = {r.graph: r for r in dependency_graph.summaries(g).collect()}
    assert (s["file"].eligible_nodes, s["file"].eligible_edges, s["file"].boundary_edges, s["file"].reasons) == (4, 1, 5, ["boundary_edges"])
    assert (s["module"].eligible_edges, s["module"].topology_limited, s["module"].reasons) == (1, False, [])
    assert lost.first().omitted_edges == 0 and dependency_graph.normalised(nodes, edges, contained, 4, 1)[2].first().omitted_edges == 7


def test_broken_graphs_raise(candidates):
    nodes, edges, contained, _ = candidates
    g, _, _ = dependency_graph.normalised(nodes, edges, contained, 100, 8)
    for bad in (dependency_graph.Graph(g.nodes.filter("kind <> 'package'"), g.edges, g.containment), dependency_graph.Graph(g.nodes, g.edges.withColumn("kind", F.lit("other")), g.containment), dependency_graph.Graph(g.nodes.unionAll(g.nodes), g.edges, g.containment)):
        with pytest.raises(validity.Invalid):
            dependency_graph.checked(bad)
    conflicting = g.nodes.withColumn("source", F.lit("a")).union(g.nodes.filter("kind = 'file'").withColumn("source", F.lit("b")))
    assert dependency_graph.conflicting_nodes(conflicting, ["source"]).count() == 4


def test_scopes_and_method_sets(spark):
    references = spark.createDataFrame([(1, "f/g/h", "x"), (2, "f/g", "y"), (3, "f", "z")], "reference long, scope string, name string")
    declared = spark.createDataFrame([("f", "x", 10), ("f/g", "x", 11), ("f", "y", 12), ("f", "y", 13), ("f/g", "z", 14)], "scope string, name string, target long")
    assert {r.reference: (r.scope_found, r.outcome, r.target) for r in semantics.in_scope_of(references, declared).collect()} == {1: ("f/g", "resolved", 11), 2: ("f", "ambiguous", None), 3: (None, "unresolved", None)}
    pairs = spark.createDataFrame([("T", "I"), ("U", "I"), ("T", "Empty")], "type string, interface string")
    have = spark.createDataFrame([("T", "A()"), ("T", "B()"), ("U", "A()")], "type string, method string")
    need = spark.createDataFrame([("I", "A()"), ("I", "B()")], "interface string, method string")
    assert {(r.type, r.interface): r.satisfied for r in semantics.satisfaction(pairs, have, need).collect()} == {("T", "I"): True, ("U", "I"): False, ("T", "Empty"): True}
    assert [tuple(r) for r in semantics.missing(pairs, have, need).collect()] == [("U", "I", 1, "B()")]


def test_kept_edges_meet_their_ids(spark):
    """Ends given by key are ordered by id; unknown ones are no edges; only kept edges prove."""
    frame = spark.createDataFrame
    ends = frame([(k, f"id{9 - k}") for k in range(6)], "key long, id string")
    rows = [("file", "next", a, b, r, f"{a}{b}{n}") for a in range(7) for b in range(5) for r in ("external", None) for n in range(1 + (a + b) % 3)]
    edges = frame(rows, "graph string, kind string, from_id long, to_id long, resolution string, evidence string")
    none = frame([], "kind string, parent_id string, child_id string")
    nodes = frame([], "id string, kind string")
    whole = sorted({(f"id{9 - a}", f"id{9 - b}", r) for _, _, a, b, r, _ in rows if a < 6}, key=lambda x: (*x[:2], x[2] or ""))
    times = {x: sum((f"id{9 - a}", f"id{9 - b}", r) == x for _, _, a, b, r, _ in rows) for x in whole}
    for most in (7, 1000):
        g, proof, lost = dependency_graph.normalised(nodes, edges, none, most, 1, ends)
        assert {(r.from_id, r.to_id, r.resolution): r.occurrences for r in g.edges.collect()} == {x: times[x] for x in whole[:most]}
        assert sorted(r.omitted for r in proof.collect()) == sorted(times[x] - 1 for x in whole[:most])
        assert lost.first().omitted_edges == max(0, len(whole) - most)


def test_ids_are_not_sent_to_all_tasks(spark, sf_dir):
    """The tables of ids that edges meet, small as they are here, are merged; edges do not move again for their place among a vertex's."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    g = facts.part_graph(read)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for found in (dependency_graph.with_eligible(g), g.edges):
        assert "Broadcast" not in plan(found)
    again = dependency_graph.adjacency(g.edges, outward=False, by="b")
    assert plan(again).count("Exchange") == plan(g.edges).count("Exchange") and "Window" in plan(again)

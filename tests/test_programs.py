"""Types, scopes and method sets against what the language says."""

import pytest

from lodestone.operators import method_sets, scopes
from lodestone.operators.type_expressions import expression_relations, relations

EXPRESSIONS = {
    "int": [("uses", None, "int", False, [])],
    "( * pkg . T )": [("uses", None, "pkg.T", False, [])],
    "[N * 2] map[[3]K] <-chan V": [("uses", None, "K", False, []), ("uses", None, "V", False, [])],
    "Pair[A, map[B]C]": [("instantiates", None, "Pair", False, ["A", "map[B]C"]), *[("uses", None, x, False, []) for x in ("Pair", "A", "B", "C")]],
    "*lib.Box[T]": [("instantiates", None, "lib.Box", False, ["T"]), ("uses", None, "lib.Box", False, []), ("uses", None, "T", False, [])],
    "func(a, b A, c ...*B) (n C, err error)": [("uses", None, x, False, []) for x in ("A", "B", "C", "error")],
    "func(A, []B) C": [("uses", None, x, False, []) for x in ("A", "B", "C")],
    "func()": [], "struct{}": [], "interface { }": [],
    "struct { a , b A ; _ B ; * pkg . E ; G [ int ] `tag` ; h [ N ] H ; f func ( x X ) }": [
        ("uses", "a", "A", False, []), ("uses", "b", "A", False, []), ("uses", "E", "pkg.E", False, []), ("embeds", None, "pkg.E", False, []),
        ("instantiates", "G", "G", False, ["int"]), ("uses", "G", "G", False, []), ("uses", "G", "int", False, []), ("embeds", None, "G", False, ["int"]), ("uses", "h", "H", False, []), ("uses", "f", "X", False, []),
    ],
    "interface {\n E\n io.Reader\n M(a A) B\n comparable\n ~int | *T\n}": [
        ("embeds", None, "E", False, []), ("uses", None, "E", False, []), ("embeds", None, "io.Reader", False, []), ("uses", None, "io.Reader", False, []), ("uses", "M", "A", False, []), ("uses", "M", "B", False, []),
        ("constrains", None, "comparable", False, []), ("uses", None, "comparable", False, []), ("constrains", None, "type:~int | *T", True, []), ("uses", None, "int", False, []), ("uses", None, "T", False, []),
    ],
    "[]struct{ x struct{ y *Y }; interface{ Z } }": [("uses", None, "Y", False, []), ("uses", None, "Z", False, [])],
    "": [], "]broken[": [], "map[": [],
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_relations(text):
    assert list(relations(text, False)) == EXPRESSIONS[text]


def test_relations_of_aliases_and_depth(spark):
    assert list(relations("map[string]int", True))[0] == ("alias_of", None, "type:map[string]int", True, [])
    assert list(relations("*other.T", True)) == [("alias_of", None, "other.T", False, []), ("uses", None, "other.T", False, [])]
    deep = "[]*(" * 20_000 + "T" + ")" * 20_000
    assert list(relations(deep, False)) == [("uses", None, "T", False, [])]
    types = spark.createDataFrame([("a", False, "*T"), ("b", None, None), (None, True, "U")], "owner string, alias boolean, expression string")
    assert sorted(((r.owner, r.ordinal, r.kind, r.target) for r in expression_relations(types).collect()), key=repr) == sorted([("a", 0, "uses", "T"), (None, 0, "alias_of", "U"), (None, 1, "uses", "U")], key=repr)
    assert expression_relations(types.filter("false")).collect() == []


def test_scopes_of_any_depth(spark):
    tree = [(0, None), *((k, k - 1) for k in range(1, 200)), (500, 100), (600, None)]
    known = [(0, "x", "outer"), (100, "x", "inner"), (100, "y", "one"), (100, "y", "two"), (199, "_", "none"), (199, "", "none"), (0, "z", "same"), (0, "z", "same"), (700, "w", "elsewhere")]
    asked = [(1, 199, "x"), (2, 99, "x"), (3, 500, "y"), (4, 199, "_"), (5, 150, "z"), (6, 600, "x"), (7, 0, "x"), (8, 199, "x"), (9, 199, "w"), (10, 800, "x")]
    frame = spark.createDataFrame
    got = scopes.looked_up(frame(asked, "reference int, scope int, name string"), frame(tree, "scope int, parent int"), frame(known, "scope int, name string, target string"))
    assert sorted((r.reference, r.scope_found, r.outcome, r.target) for r in got.collect()) == [
        (1, 100, "resolved", "inner"), (2, 0, "resolved", "outer"), (3, 100, "ambiguous", None), (4, None, "unresolved", None), (5, 0, "resolved", "same"), (6, None, "unresolved", None),
        (7, 0, "resolved", "outer"), (8, 100, "resolved", "inner"), (9, None, "unresolved", None), (10, None, "unresolved", None),
    ]
    ring = frame([(1, 2), (2, 3), (3, 1)], "scope int, parent int")
    with pytest.raises(ValueError):
        scopes.enclosing(ring, ring.select("scope")).collect()
    assert scopes.enclosing(ring.filter("false"), frame([(1,)], "scope int")).collect() == [(1, 1, 0)]


def test_method_sets_and_judgements(spark):
    embeds = [
        ("Outer", "Value", False), ("Outer", "Held", True), ("Held", "Deep", False), ("Twice", "A", False), ("Twice", "B", False), ("A", "Deep", False), ("B", "Deep", False), ("Shadow", "Value", False), ("Hidden", "Value", False),
        ("Ring", "Other", True), ("Other", "Ring", True), ("Strange", "unheard", False), ("Under", "Strange", False), ("Wide", "Small", False), ("Has", "Small", False), ("Loose", "unheard", False),
    ]
    members = [
        ("Value", "Get", "()", False), ("Value", "Set", "(int)", True), ("Deep", "Low", "()", True), ("Shadow", "Get", "(string)", False), ("Hidden", "Get", None, False), ("Other", "Turn", "()", False),
        ("Small", "Get", "()", False), ("Wide", "Set", "(int)", False), ("Low", "Low", "()", False), ("Turner", "Turn", "()", False), ("Plain", "Get", "()", False), ("Plain", "Get", "()", False),
    ]
    names = [*"A B".split(), "Outer", "Value", "Held", "Deep", "Twice", "Shadow", "Hidden", "Ring", "Other", "Strange", "Under", "Small", "Wide", "Has", "Loose", "Low", "Turner", "Empty", "Plain"]
    asked = [
        ("Value", "Small", False), ("Value", "Small", False), ("Value", "Wide", False), ("Value", "Wide", True), ("Outer", "Wide", False), ("Outer", "Wide", True), ("Outer", "Low", False), ("Held", "Low", False), ("Held", "Low", True),
        ("Twice", "Low", True), ("Shadow", "Small", False), ("Hidden", "Small", False), ("Ring", "Turner", False), ("Under", "Small", False), ("Has", "Small", False), ("Has", "Wide", True), ("Value", "Loose", False), ("Value", "Empty", False), ("Plain", "Small", False),
    ]
    frame = spark.createDataFrame
    known, arcs = frame([(x,) for x in names], "type string"), frame(embeds, "type string, target string, pointer boolean")
    found = method_sets.judged(frame(asked, "type string, interface string, pointer boolean"), known, frame(members, "type string, name string, signature string, pointer boolean"), arcs)
    got = {(r.type, r.interface, r.pointer): (r.status, r.pointer_required, r.missing) for r in found.collect()}
    assert got == {
        ("Value", "Small", False): ("proven", False, []), ("Value", "Wide", False): ("disproven", True, ["Set"]), ("Value", "Wide", True): ("proven", True, []),
        ("Outer", "Wide", False): ("disproven", True, ["Set"]), ("Outer", "Wide", True): ("proven", True, []), ("Outer", "Low", False): ("proven", False, []), ("Held", "Low", False): ("disproven", True, ["Low"]), ("Held", "Low", True): ("proven", True, []),
        ("Twice", "Low", True): ("disproven", False, ["Low"]), ("Shadow", "Small", False): ("disproven", False, ["Get"]), ("Hidden", "Small", False): ("disproven", False, ["Get"]), ("Ring", "Turner", False): ("proven", False, []),
        ("Under", "Small", False): ("unknown", False, []), ("Has", "Small", False): ("proven", False, []), ("Has", "Wide", True): ("disproven", False, ["Set"]), ("Value", "Loose", False): ("unknown", False, []), ("Value", "Empty", False): ("proven", False, []),
        ("Plain", "Small", False): ("disproven", False, ["Get"]),
    }


def test_methods_rise_without_all_parts(spark, monkeypatch):
    """In a lattice of 12 layers whose lowest alone has few methods, no table holds a row for each type and each of its parts."""
    layers = [[f"t{k}_{j}" for j in range(20)] for k in range(12)]
    arcs = [(a, b, False) for up, down in zip(layers, layers[1:], strict=False) for n, a in enumerate(up) for b in (down if n else down[:1])]
    names = [x for layer in layers for x in layer]
    sizes, write = [], method_sets.written

    def counted(df):
        sizes.append((out := write(df)).count())
        return out

    monkeypatch.setattr(method_sets, "written", counted)
    frame = spark.createDataFrame
    members = [(x, "M", "()", False) for x in names[:20]] + [("I", "M", "()", False)]
    asked = [(x, "I", False) for x in names]
    found = method_sets.judged(frame(asked, "type string, interface string, pointer boolean"), frame([(x,) for x in [*names, "I"]], "type string"), frame(members, "type string, name string, signature string, pointer boolean"), frame(arcs, "type string, target string, pointer boolean"))
    assert {r.type for r in found.collect() if r.status == "proven"} == set(names[:20])
    assert max(sizes) <= len(arcs)

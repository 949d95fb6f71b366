"""Go manifests and sources, refs and the catalog."""

from collections import Counter

from pyspark.sql import functions as F

from lodestone.sources import go_syntax, repository

MOD = 'module ex.org/app // own\n\ngo 1.21\ntoolchain go1.22.0\n\nrequire single.org/x v1.0.0\nrequire (\n\ta.org/b v0.1.0 // indirect\n\t"q.org/c" v2.0.0\n)\n\nreplace a.org/b => ../b\nreplace (\n\tq.org/c v2.0.0 => fork.org/c v2.0.1\n)\nexclude z.org/z v1.0.0\n'
WORK = "go 1.21\n\nuse ./one\nuse (\n\t./two\n)\nreplace w.org/w v1 => ./w\n"
VENDOR = "# a.org/b v0.1.0\n## explicit; go 1.20\na.org/b\na.org/b/sub\n# odd line\nlost/package\n# q.org/c v2.0.0 => fork.org/c v2.0.1\nq.org/c\n"


def test_manifest_rows(spark):
    files = spark.createDataFrame([("go.mod", MOD), ("w/go.work", WORK), ("vendor/modules.txt", VENDOR), ("other/modules.txt", VENDOR)], "path string, content string")
    got = [tuple(r) for r in repository.go_manifests(files).select("path", "line", "directive", "module", "version", "target", "target_version").orderBy("path", "line").collect()]
    assert got == [
        ("go.mod", 1, "module", "ex.org/app", None, None, None), ("go.mod", 3, "go", None, "1.21", None, None), ("go.mod", 4, "toolchain", None, "go1.22.0", None, None), ("go.mod", 6, "require", "single.org/x", "v1.0.0", None, None),
        ("go.mod", 8, "require", "a.org/b", "v0.1.0", None, None), ("go.mod", 9, "require", "q.org/c", "v2.0.0", None, None), ("go.mod", 12, "replace", "a.org/b", None, "../b", None), ("go.mod", 14, "replace", "q.org/c", "v2.0.0", "fork.org/c", "v2.0.1"),
        ("vendor/modules.txt", 1, "vendor_module", "a.org/b", "v0.1.0", None, None), ("vendor/modules.txt", 3, "vendor_package", "a.org/b", "v0.1.0", "a.org/b", None), ("vendor/modules.txt", 4, "vendor_package", "a.org/b", "v0.1.0", "a.org/b/sub", None),
        ("vendor/modules.txt", 7, "vendor_module", "q.org/c", "v2.0.0", None, None), ("vendor/modules.txt", 8, "vendor_package", "q.org/c", "v2.0.0", "q.org/c", None),
        ("w/go.work", 1, "go", None, "1.21", None, None), ("w/go.work", 3, "use", "./one", None, None, None), ("w/go.work", 5, "use", "./two", None, None, None), ("w/go.work", 7, "replace", "w.org/w", "v1", "./w", None),
    ]
    targets = spark.createDataFrame([("../b",), ("./w",), ("/abs",), ("C:\\x",), ("fork.org/c",), ("..b",)], "t string")
    assert [r[0] for r in targets.select(repository.filesystem_target(targets.t)).collect()] == [True, True, True, True, False, False]


SOURCE = '''package app // import "none"

import "fmt"
import (
	_ "blank.org/x"
	. "dot.org/y"
	name "named.org/z"

	"plain.org/w" // why
)

/* type Hidden struct {
} */
const Answer, Other = 42, 1

const (
	First = iota
	Second
	text = "func Fake() {}"
)

var single int
var (
	a, b string
	f = func() {
		inner := 1
		_ = inner
	}
)

type Thing struct {
	field int
}

type (
	Reader interface {
		Read() int
	}
	Alias = string
	Box[T any] struct{ v T }
)

func Plain(x int) int { return x }

func Generic[T any](x T) {
	type local struct{}
}

func (t *Thing) Pointer() {}
func (Thing) Value() {}
func (b *Box[T]) Boxed(f func(int)) {}
func (t (*Thing)) Wrapped() { fmt.Println("// no comment", `raw
type Raw struct {`) }
'''


def test_imports_and_symbols(spark):
    files = spark.createDataFrame([("a.go", SOURCE), ("empty.go", "")], "path string, content string")
    got = sorted((r.import_path, r.alias, r.alias_kind) for r in go_syntax.go_imports(files).collect())
    assert got == [("blank.org/x", "_", "blank"), ("dot.org/y", ".", "dot"), ("fmt", "", "default"), ("named.org/z", "name", "named"), ("plain.org/w", "", "default")]
    symbols = sorted((r.kind, r.name) for r in go_syntax.go_symbols(files).collect())
    assert symbols == sorted([("constant", x) for x in ("Answer", "Other", "First", "Second", "text")] + [("variable", x) for x in ("single", "a", "b", "f")] + [("struct", "Thing"), ("struct", "Box"), ("interface", "Reader"), ("function", "Plain"), ("function", "Generic")] + [("method", x) for x in ("Pointer", "Value", "Boxed", "Wrapped")])
    of = {r.name: (r.receiver_base, r.pointer, r.generic) for r in go_syntax.go_symbols(files).filter("kind = 'method'").collect()}
    assert of == {"Pointer": ("Thing", True, False), "Value": ("Thing", False, False), "Boxed": ("Box", True, True), "Wrapped": ("Thing", True, False)}


AWKWARD = """/* licence
 of three lines
*/
// Package doc
package main

import "fmt"; import x `raw.org/y`

var doc = `func ghost() {
import "none"
type Ghost struct {
`

func real(x int) int { return x }
type A = struct{}; type B [4]struct{}
type C[T any, U interface{ M() }] interface { M() }
type N [Len]struct{ x int }
type (
	D struct { a, b int }; E int
	F map[string]interface{}
)
func (
	r *D,
) spread(
	a int,
) (int, error) {
	var inner int
	return 1, nil
}
const x, y = '{', "/*"
func (E[int]) é() {}
func ([]E) odd() {}
"""


def test_layout_comments_and_literals(spark):
    broken = {"open.go": "package x\nfunc f() {", "quote.go": 'package x\nvar a = "open\n', "close.go": "package x\nvar a = 1)\n", "comment.go": "package x\n/* open\n", "none.go": "func f() {}\n", "raw.go": "package x\nvar a = `open", "empty.go": "", "null.go": None}
    files = spark.createDataFrame([("a.go", AWKWARD), ("b.go", "package b\r\n\r\nvar v int\r\n"), *broken.items()], "path string, content string")
    assert {r.path: (r.package, r.status) for r in go_syntax.go_files(files).collect()} == {"a.go": ("main", "parsed"), "b.go": ("b", "parsed"), **{k: (None, "failed") for k in broken}}
    assert sorted((r.line, r.import_path, r.alias_kind) for r in go_syntax.go_imports(files).collect()) == [(7, "fmt", "default"), (7, "raw.org/y", "named")]
    got = sorted((r.path, r.line, r.kind, r.name, r.receiver_base, r.pointer, r.generic) for r in go_syntax.go_symbols(files).collect())
    plain = [(9, "variable", "doc"), (14, "function", "real"), (15, "struct", "A"), (16, "interface", "C"), (19, "struct", "D"), (30, "constant", "x"), (30, "constant", "y")]
    methods = [(22, "method", "spread", "D", True, False), (31, "method", "é", "E", False, True), (32, "method", "odd", "", False, False)]
    assert got == sorted([("a.go", *x, "", False, False) for x in plain] + [("a.go", *x) for x in methods] + [("b.go", 3, "variable", "v", "", False, False)])
    offsets = {r.name: r.offset for r in go_syntax.go_symbols(files.filter("path = 'a.go'")).collect()}
    assert all(AWKWARD.encode()[at:].startswith(b"func" if n in ("real", "spread", "odd", "é") else n.encode()) for n, at in offsets.items())


def test_declarations_and_symbols(spark):
    files = spark.createDataFrame([("d/a.go", AWKWARD), ("b.go", "package b\nfunc init() {}\nfunc main() {}\n")], "path string, content string")
    declared = go_syntax.go_declarations(files)
    got = {(r.name, r.kind, r.syntax, r.scope) for r in declared.collect()}
    p = "package:d:main"
    assert got == {
        ("doc", "variable", "variable", p), ("real", "function", "function", p), ("A", "type_alias", "struct", p), ("B", "defined_type", None, p), ("C", "interface", "interface", p), ("N", "defined_type", None, p), ("D", "struct", "struct", p),
        ("E", "defined_type", None, p), ("F", "defined_type", None, p), ("x", "constant", "constant", p), ("y", "constant", "constant", p), ("spread", "method", "method", "file:d/a.go"), ("é", "method", "method", "file:d/a.go"),
        ("odd", "method", "method", "file:d/a.go"), ("init", "function", "function", "file:b.go"), ("main", "function", "function", "package:.:b"),
    }
    symbols = go_syntax.go_symbols(files).select("path", "kind", "name", "offset")
    assert go_syntax.reconciled(declared, symbols)[1].collect() == [] and {r.status for r in go_syntax.reconciled(declared, symbols)[0].collect()} == {"resolved"}
    other = symbols.filter("name NOT IN ('real', 'D')").union(symbols.filter("name IN ('D', 'main')")).union(symbols.filter("name IN ('D', 'x')")).union(spark.createDataFrame([("b.go", "struct", "Gone", 7)], "path string, kind string, name string, offset long"))
    found, told = go_syntax.reconciled(declared, other.withColumn("offset", F.when(F.col("name") == "y", 0).otherwise(F.col("offset"))))
    assert {r.name: r.status for r in found.filter("status <> 'resolved'").collect()} == {"real": "partial", "D": "ambiguous", "main": "ambiguous", "x": "ambiguous", "y": "partial"}
    assert Counter((r.code.removeprefix("semantic_"), r.name) for r in told.collect()) == Counter({
        ("declaration_unmatched", "real"): 1, ("declaration_unmatched", "y"): 1, **{("declaration_ambiguous", x): 1 for x in ("D", "main", "x")}, **{("syntax_symbol_unmatched", x): 2 for x in ("D", "main", "x")},
        ("syntax_symbol_unmatched", "y"): 1, ("syntax_symbol_unmatched", "Gone"): 1,
    })


def test_long_tokens(spark):
    text = "package x\n/*" + "*" * 100_000 + "/\nvar a = `" + "\n" * 50_000 + "`\nvar b = \"" + "\\n" * 50_000 + "\"\n"
    assert sorted((r.line, r.name) for r in go_syntax.go_symbols(spark.createDataFrame([("a.go", text)], "path string, content string")).collect()) == [(3, "a"), (50_004, "b")]


def test_tokens_stay_in_their_task(spark):
    """Each reading of files is one pass without a shuffle, and odd letters, blanks and receivers are what the language says."""
    text = "package x\nvar \u00e9t\u00e9, \u4e00\u0663 = 1, 2\n\tvar a\u00b2 int\r\nfunc () none() {}\nfunc (t *T,) last() {}\nfunc (x) (y) { f() }\ntype ()\n"
    files = spark.createDataFrame([("a.go", text), ("b.go", "package b"), ("c.go", "package c; var z int")], "path string, content string")
    for read in (go_syntax.go_files, go_syntax.go_imports, go_syntax.go_symbols, go_syntax.go_types, go_syntax.go_declarations):
        plan = read(files)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    got = sorted((r.path, r.line, r.offset, r.kind, r.name, r.receiver_base, r.pointer) for r in go_syntax.go_symbols(files).collect())
    data = text.encode()
    assert got == [
        ("a.go", 2, data.index("\u00e9t".encode()), "variable", "\u00e9t\u00e9", "", False), ("a.go", 2, data.index("\u4e00".encode()), "variable", "\u4e00\u0663", "", False), ("a.go", 3, data.index(b"a\xc2\xb2"), "variable", "a", "", False),
        ("a.go", 4, data.index(b"func ()"), "method", "none", "", False), ("a.go", 5, data.index(b"func (t"), "method", "last", "T", True), ("c.go", 1, 15, "variable", "z", "", False),
    ]


def test_refs_and_catalog(spark, tmp_path):
    git = tmp_path / ".git" / "refs" / "remotes" / "origin"
    git.mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/feature/x\nmore\n")
    (git / "HEAD").write_text("ref: refs/remotes/origin/main\n")
    assert tuple(repository.refs(spark, f"file://{tmp_path}").first()) == ("feature/x", "main")
    (tmp_path / ".git" / "HEAD").write_text("0123abcd\n")
    assert repository.refs(spark, f"file://{tmp_path}").first().branch is None
    spark.createDataFrame([(1, "x")], "k long, v string").createOrReplaceTempView("known_table")
    present = repository.catalog_columns(spark, "known_.*")
    assert sorted((r.column, r.type) for r in present.collect()) == [("k", "bigint"), ("v", "string")]
    assert [r.column for r in repository.missing_columns(present, [("known_table", "k", "bigint"), ("known_table", "v", "int")]).collect()] == ["v"]
    rows = spark.createDataFrame([("s", 1), ("t", 2), ("s", 3)], "security_scope_id string, id long")
    rows.write.parquet(str(tmp_path / "rows"))
    assert [r.id for r in repository.stored_rows(spark, str(tmp_path / "rows"), "s", {"id": 3}).collect()] == [3]

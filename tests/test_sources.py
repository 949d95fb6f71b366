"""Manifests and file listings."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, manifests

FILES = {
    "go.mod": "module example.com/app // x\ngo 1.22\ntoolchain go1.22.1\nrequire github.com/gin-gonic/gin v1.9.0\n// github.com/go-chi/chi\n",
    "go.work": 'go 1.22\nuse (\n\t./b\n\t"./a"\n)\nuse ./c // last\n',
    "web/package.json": '{"packageManager": "pnpm@9.1", "engines": {"node": ">=20"}, "workspaces": {"packages": ["z/*", "a"]}, "dependencies": {"React": "1"}, "devDependencies": {"@reduxjs/toolkit": "1"}}',
    "web/package-lock.json": "{}", "web/pnpm-lock.yaml": "", "ui/package.json": '{"workspaces": ["x"], "packageManager": "odd@1"}', "broken/package.json": "{",
    "pom.xml": '<project xmlns="http://maven.apache.org/POM/4.0.0"><modules><module> core </module><module>api</module></modules><dependencies><dependency><groupId>org.springframework</groupId><artifactId>spring-boot-x</artifactId></dependency></dependencies></project>',
    "py/pyproject.toml": '[build-system]\nbuild-backend = "hatchling.build" # note\n[project]\nrequires-python = ">=3.11"\n[tool.uv]\n',
    "rs/Cargo.toml": '[package]\nrust-version = "1.70"\n[workspace]\nmembers = [\n  "b", "a"\n]\n[dependencies]\naxum = "0.7"\n[dependencies.rocket]\n',
    "composer.json": '{"require": {"php": "^8.2", "laravel/framework": "11"}}', "py/requirements.txt": "Flask>=2 # web\nnot-django\n",
    "settings.gradle.kts": 'include(":app", ":lib")\n', "pnpm-workspace.yaml": "packages:\n  - 'pkg/*'\n  - other\nelse: 1\n  - no\n",
}


def table(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


def test_build_findings(spark):
    rows = manifests.build_findings(table(spark)).collect()
    found = {(r.path, r.kind, r.id, r.name, r.constraint, tuple(r.members)) for r in rows}
    for expected in [
        ("go.mod", "package_manager", "go-modules", "Go Modules", None, ()), ("go.mod", "toolchain", None, "Go", "go1.22.1", ()), ("go.work", "workspace", "go-workspace", "Go Workspace", None, ("./a", "./b", "./c")),
        ("web/package.json", "package_manager", "pnpm", "pnpm", None, ()), ("web/package.json", "toolchain", None, "pnpm", "9.1", ()), ("web/package.json", "toolchain", None, "Node.js", ">=20", ()),
        ("web/package.json", "workspace", "node-workspace", "Node Workspace", None, ("a", "z/*")), ("ui/package.json", "workspace", "node-workspace", "Node Workspace", None, ("x",)),
        ("pom.xml", "workspace", "maven-multi-module", "Maven Multi-module", None, ("api", "core")), ("py/pyproject.toml", "build_system", "hatchling", "hatchling.build", None, ()),
        ("py/pyproject.toml", "toolchain", None, "Python", ">=3.11", ()), ("py/pyproject.toml", "package_manager", "uv", "uv", None, ()), ("rs/Cargo.toml", "toolchain", None, "Rust", "1.70", ()),
        ("rs/Cargo.toml", "workspace", "cargo-workspace", "Cargo Workspace", None, ("a", "b")), ("composer.json", "toolchain", None, "PHP", "^8.2", ()), ("web/package-lock.json", "lock_file", "npm", "npm", None, ()),
        ("settings.gradle.kts", "workspace", "gradle-multi-project", "Gradle Multi-project", None, (":app", ":lib")), ("pnpm-workspace.yaml", "workspace", "pnpm-workspace", "pnpm Workspace", None, ("other", "pkg/*")),
    ]:
        assert expected in found, expected
    assert not [r for r in rows if r.path == "broken/package.json"]
    assert [(r.location, r.managers) for r in manifests.manager_conflicts(manifests.build_findings(table(spark))).collect()] == [("web", ["npm", "pnpm"])]


def test_frameworks(spark):
    got = {(r.name, r.ecosystem): [(e.file, e.value) for e in r.evidence] for r in manifests.frameworks(table(spark)).collect()}
    assert got == {
        ("Gin", "Go"): [("go.mod", "github.com/gin-gonic/gin")], ("React", "Node.js"): [("web/package.json", "react")], ("Redux", "Node.js"): [("web/package.json", "@reduxjs/toolkit")],
        ("Laravel", "PHP"): [("composer.json", "laravel/framework")], ("Axum", "Rust"): [("rs/Cargo.toml", "axum")], ("Rocket", "Rust"): [("rs/Cargo.toml", "rocket")],
        ("Flask", "Python"): [("py/requirements.txt", "flask")], ("Spring Boot", "Java"): [("pom.xml", "org.springframework:spring-boot-x")],
    }


def test_reading_a_checkout(spark, tmp_path):
    for name, text in (("a/b.go", "package b"), (".git/HEAD", "ref"), ("big.txt", "x" * 100)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    small, large = files.read_files(spark, f"file://{tmp_path}", 50)
    assert [tuple(r) for r in small.collect()] == [("a/b.go", "package b")] and [tuple(r) for r in large.collect()] == [("big.txt", "too_large")]
    assert {(r.path, r.is_dir) for r in files.entries(small).collect()} == {("a", True), ("a/b.go", False)}
    assert spark.range(1).select(files.trimmed(F.lit("\t a b \n"))).first()[0] == "a b"


def test_walk(spark, tmp_path, monkeypatch):
    root = tmp_path / "the repo%20"
    for folder in ("empty", "a/b/c", "a/.git/objects", "sub module", ".git/refs"):
        (root / folder).mkdir(parents=True)
    for file in ("a/x.go", "a/b/c/é y.txt", ".git/HEAD", "a/.git/objects/1", "sub module/.git", "z"):
        (root / file).write_text("x")
    (root / "link").symlink_to(root / "a")
    want = {("empty", True), ("a", True), ("a/b", True), ("a/b/c", True), ("sub module", True), ("a/x.go", False), ("a/b/c/é y.txt", False), ("z", False), ("link", False)}
    for top in (str(root), root.as_uri(), f"{root}/"):
        found, report = files.walk(spark, top)
        assert {tuple(r) for r in found.collect()} == want and (report["git"], report["files"], report["folders"]) == (True, 4, 5)
    every, report = files.walk(spark, str(root), with_git=True)
    assert {r.path for r in every.collect()} - {p for p, _ in want} == {".git", ".git/refs", ".git/HEAD", "a/.git", "a/.git/objects", "a/.git/objects/1", "sub module/.git"} and report["git"]
    assert files.walk(spark, str(root / "empty"))[1] == {"name": "empty", "root": str(root / "empty"), "git": False, "files": 0, "folders": 0}
    for bad in (root / "none", root / "z"):
        with pytest.raises(files.WalkError):
            files.walk(spark, str(bad))

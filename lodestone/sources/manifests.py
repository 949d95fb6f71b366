"""Build manifests and lock files as findings, by DataFrame code over (path, content).

A finding is (path, location, kind, id, name, constraint, members, rule, value);
kind is package_manager, build_system, toolchain, workspace or lock_file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import base_name, directory, slug
from lodestone.sources.files import lines, named

# Names of files, tools and frameworks.
PRESENT = [
    ("go.mod", "package_manager", "go-modules", "Go Modules"), ("go.mod", "build_system", "go-toolchain", "Go Toolchain"),
    ("pom.xml", "package_manager", "maven", "Maven"), ("pom.xml", "build_system", "maven", "Maven"),
    ("requirements.txt", "package_manager", "pip", "pip"),
    ("Cargo.toml", "package_manager", "cargo", "Cargo"), ("Cargo.toml", "build_system", "cargo", "Cargo"),
    ("composer.json", "package_manager", "composer", "Composer"),
    ("pnpm-workspace.yaml", "package_manager", "pnpm", "pnpm"),
]
LOCKS = [
    ("package-lock.json", "npm", "npm"), ("npm-shrinkwrap.json", "npm", "npm"), ("pnpm-lock.yaml", "pnpm", "pnpm"), ("yarn.lock", "yarn", "Yarn"), ("bun.lock", "bun", "Bun"),
    ("bun.lockb", "bun", "Bun"), ("Cargo.lock", "cargo", "Cargo"), ("poetry.lock", "poetry", "Poetry"), ("uv.lock", "uv", "uv"), ("composer.lock", "composer", "Composer"),
]
MANAGERS = [("npm", "npm"), ("pnpm", "pnpm"), ("yarn", "Yarn"), ("bun", "Bun")]
TOOLCHAINS = [("node", "Node.js"), ("nodejs", "Node.js"), ("python", "Python"), ("go", "Go"), ("rust", "Rust"), ("php", "PHP")]
FRAMEWORKS = [
    ("package.json", "react", "React", "Node.js"), ("package.json", "redux", "Redux", "Node.js"), ("package.json", "@reduxjs/toolkit", "Redux", "Node.js"), ("package.json", "next", "Next.js", "Node.js"),
    ("package.json", "vue", "Vue", "Node.js"), ("package.json", "@angular/core", "Angular", "Node.js"), ("package.json", "express", "Express", "Node.js"), ("package.json", "@nestjs/core", "NestJS", "Node.js"),
    ("package.json", "svelte", "Svelte", "Node.js"), ("composer.json", "laravel/framework", "Laravel", "PHP"), ("composer.json", "symfony/framework-bundle", "Symfony", "PHP"),
    ("cargo.toml", "actix-web", "Actix Web", "Rust"), ("cargo.toml", "axum", "Axum", "Rust"), ("cargo.toml", "rocket", "Rocket", "Rust"),
    ("requirements.txt", "django", "Django", "Python"), ("requirements.txt", "flask", "Flask", "Python"), ("requirements.txt", "fastapi", "FastAPI", "Python"),
]
GO_FRAMEWORKS = [("github.com/gin-gonic/gin", "Gin"), ("github.com/labstack/echo", "Echo"), ("github.com/gofiber/fiber", "Fiber"), ("github.com/go-chi/chi", "Chi")]

NO_MEMBERS = "array<string>"


def _names(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def finding(rows: DataFrame, kind: Column | str, id_: Column | str, name: Column | str, rule: str, value: Column | str, constraint: Column | None = None, members: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "path", directory(F.col("path")).alias("location"), lit(kind).alias("kind"), lit(id_).alias("id"), lit(name).alias("name"),
        (F.lit(None).cast("string") if constraint is None else constraint).alias("constraint"), (F.array().cast(NO_MEMBERS) if members is None else F.array_sort(F.array_distinct(members))).alias("members"),
        F.lit(rule).alias("rule"), lit(value).alias("value"),
    )


def present(files: DataFrame) -> DataFrame:
    """Findings of manifests and lock files that are simply there."""
    spark = files.sparkSession
    at = files.withColumn("base", base_name(F.col("path")))
    rules = spark.createDataFrame(PRESENT, "base string, kind string, id string, name string")
    there = at.join(F.broadcast(rules), "base")
    locks = at.join(F.broadcast(spark.createDataFrame(LOCKS, "base string, id string, name string")), "base")
    manifests = finding(there, F.col("kind"), F.col("id"), F.col("name"), "manifest.presence", F.col("base"))
    both = [finding(locks, k, F.col("id"), F.col("name"), "lockfile.presence", F.col("base")) for k in ("package_manager", "lock_file")]
    return reduce(DataFrame.union, both, manifests)


def go_files(files: DataFrame) -> DataFrame:
    """Toolchain versions of go.mod and go.work, and the members of go.work."""
    rows = lines(named(files, ["go.mod", "go.work"]), "//")
    fields = F.split("text", r"\s+")
    version = rows.filter((F.size(fields) == 2) & fields[0].isin("go", "toolchain"))
    out = [finding(version.filter(fields[0] == x), "toolchain", F.lit(None).cast("string"), "Go", f"go.{x}", fields[1], fields[1]) for x in ("go", "toolchain")]
    work = named(files, ["go.work"])
    # A block opens with use ( and ends with a parenthesis; the last mark above a line tells whether it is inside.
    mark = F.when(F.col("text") == "use (", True).when(F.col("text") == ")", False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    marked = lines(work, "//").withColumn("inside", inside)
    single = F.col("text").startswith("use ") & (F.col("text") != "use (")
    member = F.when(single, F.substring("text", 5, 10_000)).when(F.col("inside") & (F.col("text") != "use (") & (F.col("text") != ""), F.col("text"))
    members = marked.groupBy("path").agg(F.collect_list(F.regexp_replace(F.trim(member), '^"+|"+$', "")).alias("m"))
    out.append(finding(members, "workspace", "go-workspace", "Go Workspace", "workspace.declaration", "go.work", members=F.col("m")))
    return reduce(DataFrame.union, out)


def json_fields(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of JSON texts as columns; null where a text is no JSON or lacks the field."""
    return rows.select(F.from_json(column, schema).alias("j")).select("j.*")


def node_packages(files: DataFrame) -> DataFrame:
    """Package manager, engines and workspaces (an array, or an object that holds one) of package.json."""
    rows = named(files, ["package.json"]).withColumn("j", F.from_json("content", "packageManager string, engines map<string,string>, workspaces string"))
    manager, constraint = F.substring_index("j.packageManager", "@", 1), F.when(F.col("j.packageManager").contains("@"), F.regexp_extract("j.packageManager", "@(.*)", 1))
    name = _names(MANAGERS)[F.lower(manager)]
    known = rows.filter(name.isNotNull())
    out = [finding(known, "package_manager", manager, name, "package_json.package_manager", F.col("j.packageManager")), finding(known.filter(F.length(constraint) > 0), "toolchain", F.lit(None).cast("string"), name, "package_json.package_manager", F.col("j.packageManager"), constraint)]
    engines = rows.select("path", F.explode("j.engines").alias("k", "v"))
    out.append(finding(engines, "toolchain", F.lit(None).cast("string"), F.coalesce(_names(TOOLCHAINS)[F.lower("k")], F.col("k")), "package_json.engines", F.concat("k", F.lit("="), "v"), F.col("v")))
    members = F.coalesce(F.from_json("j.workspaces", NO_MEMBERS), F.from_json("j.workspaces", "packages array<string>")["packages"])
    spaces = rows.withColumn("m", members).filter(F.size("m") > 0)
    out.append(finding(spaces, "workspace", "node-workspace", "Node Workspace", "package_json.workspaces", "workspaces", members=F.col("m")))
    return reduce(DataFrame.union, out)


def maven(files: DataFrame) -> DataFrame:
    """Modules of pom.xml."""
    text = F.regexp_replace("content", r'\sxmlns(:\w+)?="[^"]*"', "")
    rows = named(files, ["pom.xml"]).withColumn("m", F.transform(F.xpath(text, F.lit("/project/modules/module/text()")), lambda x: F.trim(x))).filter(F.size("m") > 0)
    return finding(rows, "workspace", "maven-multi-module", "Maven Multi-module", "maven.modules", "modules", members=F.col("m"))


def sections(files: DataFrame) -> DataFrame:
    """(path, line, section, key, value) of assignments in sectioned files; the section above carries forward."""
    rows = lines(files, "#").withColumn("head", F.when(F.col("text").rlike(r"^\[.*\]\z"), F.regexp_replace("text", r"^\[+|\]+\z", "")))
    section = F.last("head", ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    pair = rows.withColumn("section", F.coalesce(section, F.lit(""))).filter(F.col("head").isNull() & F.col("text").contains("="))
    unquoted = F.regexp_replace(F.trim(F.regexp_extract("text", r"(?s)=(.*)\z", 1)), "^['\"]+|['\"]+\\z", "")
    return pair.select("path", "line", "section", F.trim(F.substring_index("text", "=", 1)).alias("key"), unquoted.alias("value"))


def sectioned_projects(files: DataFrame) -> DataFrame:
    """pyproject.toml and Cargo.toml: build backend, versions, tools and workspace members."""
    none = F.lit(None).cast("string")
    py, cargo = named(files, ["pyproject.toml"]), named(files, ["Cargo.toml"])
    rows, crate = sections(py), sections(cargo)
    backend = rows.filter("section = 'build-system' AND key = 'build-backend'")
    out = [finding(backend, "build_system", slug(F.substring_index("value", ".", 1)), F.col("value"), "pyproject.build_backend", F.col("value"))]
    wanted = [(rows, "project", "requires-python", "Python", "pyproject.requires_python"), (crate, "package", "rust-version", "Rust", "cargo.rust_version")]
    for source, section, key, name, rule in wanted:
        out.append(finding(source.filter((F.col("section") == section) & (F.col("key") == key)), "toolchain", none, name, rule, F.col("value"), F.col("value")))
    for tool, name in (("poetry", "Poetry"), ("uv", "uv")):
        out.append(finding(py.filter(F.contains("content", F.lit(f"[tool.{tool}]"))), "package_manager", tool, name, "pyproject.tool", tool))
    body = F.regexp_extract("content", r"(?s)\[workspace\](?:(?!\n\[).)*?\bmembers\s*=\s*\[([^\]]*)\]", 1)
    members = F.transform(F.regexp_extract_all(body, F.lit("[\"']([^\"']*)[\"']"), F.lit(1)), lambda x: F.trim(x))
    spaces = cargo.filter(F.contains("content", F.lit("[workspace]"))).withColumn("m", members)
    out.append(finding(spaces, "workspace", "cargo-workspace", "Cargo Workspace", "cargo.workspace", "workspace", members=F.col("m")))
    return reduce(DataFrame.union, out)


def composer(files: DataFrame) -> DataFrame:
    """PHP version that composer.json requires."""
    rows = named(files, ["composer.json"]).withColumn("php", F.from_json("content", "require map<string,string>")["require"]["php"]).filter(F.length("php") > 0)
    return finding(rows, "toolchain", F.lit(None).cast("string"), "PHP", "composer.require_php", F.col("php"), F.col("php"))


def gradle(files: DataFrame) -> DataFrame:
    """Build files, and the members that settings include."""
    scripts = named(files, ["build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"])
    out = [finding(scripts, "build_system", "gradle", "Gradle", "manifest.presence", base_name(F.col("path")))]
    rows = lines(named(files, ["settings.gradle", "settings.gradle.kts"]), "//").filter(F.col("text").startswith("include"))
    rest = F.regexp_replace(F.trim(F.substring("text", 8, 100_000)), r"^[()]+|[()]+\z", "")
    each = rows.select("path", F.explode(F.split(rest, ",")).alias("m")).groupBy("path").agg(F.collect_list(F.regexp_replace(F.trim("m"), "^['\"]+|['\"]+\\z", "")).alias("m"))
    out.append(finding(each, "workspace", "gradle-multi-project", "Gradle Multi-project", "gradle.include", "include", members=F.col("m")))
    return reduce(DataFrame.union, out)


def pnpm_workspaces(files: DataFrame) -> DataFrame:
    """Members listed below packages: in pnpm-workspace.yaml."""
    rows = lines(named(files, ["pnpm-workspace.yaml"]), "#").filter(F.col("text") != "")
    mark = F.when(F.col("text") == "packages:", True).when(~F.col("text").startswith("-"), False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    member = F.when(inside & F.col("text").startswith("-"), F.regexp_replace(F.trim(F.substring("text", 2, 10_000)), "^['\"]+|['\"]+\\z", ""))
    found = rows.withColumn("member", member).groupBy("path").agg(F.collect_list("member").alias("m"))
    return finding(found, "workspace", "pnpm-workspace", "pnpm Workspace", "workspace.declaration", "pnpm-workspace.yaml", members=F.col("m"))


def build_findings(files: DataFrame) -> DataFrame:
    """All findings of all detectors."""
    return reduce(DataFrame.union, (f(files) for f in (present, go_files, node_packages, maven, sectioned_projects, composer, gradle, pnpm_workspaces)))


def frameworks(files: DataFrame) -> DataFrame:
    """(name, ecosystem, evidence): frameworks that manifests depend on."""
    spark = files.sparkSession
    maps = [f"{x} map<string,string>" for x in ("dependencies", "devDependencies", "peerDependencies", "require")] + ["`require-dev` map<string,string>"]
    json_rows = named(files, ["package.json", "composer.json"], any_case=True).withColumn("j", F.from_json("content", ", ".join(maps)))
    groups = F.array(*(F.map_keys(F.col("j")[x]) for x in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev")))
    names = json_rows.select("path", F.explode(F.array_distinct(F.flatten(F.filter(groups, lambda x: x.isNotNull())))).alias("token"))
    rust = lines(named(files, ["cargo.toml"], any_case=True), "#")
    table = F.regexp_extract("text", r"^\[dependencies\.(.*)\]\z", 1)
    crate = F.when(table != "", table).when(F.locate("=", F.col("text")) > 1, F.regexp_replace(F.trim(F.substring_index("text", "=", 1)), "^['\"]+|['\"]+\\z", ""))
    names = names.union(rust.select("path", crate.alias("token")))
    py = lines(named(files, ["requirements.txt"], any_case=True), "#")
    names = names.union(py.select("path", F.regexp_extract(F.lower("text"), r"^[^<>=!~\[ ;]*", 0)))
    keyed = names.select("path", F.lower("token").alias("token"), F.lower(base_name(F.col("path"))).alias("manifest")).distinct()
    rules = spark.createDataFrame(FRAMEWORKS, "manifest string, token string, name string, ecosystem string")
    met = keyed.join(F.broadcast(rules), ["manifest", "token"]).select("name", "ecosystem", "path", "token")
    go = named(files, ["go.mod"], any_case=True).withColumn("text", F.regexp_replace("content", "//[^\n]*", "")).join(F.broadcast(spark.createDataFrame(GO_FRAMEWORKS, "token string, name string")), F.contains("text", F.col("token")))
    pom = named(files, ["pom.xml"], any_case=True).withColumn("text", F.regexp_replace("content", r'\sxmlns(:\w+)?="[^"]*"', ""))
    of = lambda tag: F.xpath("text", F.lit(f"/project/dependencies/dependency/{tag}/text()"))
    each = pom.select("path", F.explode(F.arrays_zip(of("groupId").alias("g"), of("artifactId").alias("a"))).alias("d")).select("path", F.trim("d.g").alias("g"), F.trim("d.a").alias("a"))
    boot = (F.col("g") == "org.springframework.boot") | F.col("a").startswith("spring-boot-")
    spring = each.withColumn("name", F.when(boot, "Spring Boot").when(F.col("g").startswith("org.springframework"), "Spring Framework")).filter("name IS NOT NULL")
    met = met.union(go.select("name", F.lit("Go"), "path", "token")).union(spring.select("name", F.lit("Java"), "path", F.concat("g", F.lit(":"), "a")))
    return met.groupBy("name", "ecosystem").agg(F.array_sort(F.collect_set(F.struct(F.col("path").alias("file"), F.col("token").alias("value")))).alias("evidence"))


def manager_conflicts(findings: DataFrame) -> DataFrame:
    """(location, managers): places with several Node package managers."""
    node = findings.filter((F.col("kind") == "package_manager") & F.col("id").isin(*(x for x, _ in MANAGERS)))
    return node.groupBy("location").agg(F.array_sort(F.collect_set("id")).alias("managers")).filter(F.size("managers") > 1)

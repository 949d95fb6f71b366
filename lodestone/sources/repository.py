"""Repository facts beside file lists: refs, confined reads, Go manifests, stored rows and the catalog; Go sources are read by go_syntax."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import base_name, directory, normalized
from lodestone.sources.files import trimmed

#: A ref file is read no further.
REF_BYTES = 4096


def refs(spark: SparkSession, root: str) -> DataFrame:
    """One row (branch, default_branch): what HEAD and the remote's HEAD point to; null where they name no branch.

    Only the first line of the first 4,096 bytes counts.
    """
    files = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/.git/{{HEAD,refs/remotes/origin/HEAD}}"])
    line = F.trim(F.substring_index(F.decode(F.substring("content", 1, REF_BYTES), "UTF-8"), "\n", 1))
    named = files.select(F.col("path").endswith("/refs/remotes/origin/HEAD").alias("remote"), line.alias("line"))
    found = lambda remote, prefix: F.max(F.when((F.col("remote") == remote) & F.startswith("line", F.lit(prefix)), F.substring(F.col("line"), len(prefix) + 1, REF_BYTES)))
    return named.agg(found(F.lit(False), "ref: refs/heads/").alias("branch"), found(F.lit(True), "ref: refs/remotes/origin/").alias("default_branch"))


def confined(asked: DataFrame, files: DataFrame, most_bytes: int) -> DataFrame:
    """asked (path) with status and content: what a reader that never leaves the root would give.

    files: (path, length, content) below the root. outside_root for absolute
    paths and those that climb out, missing, oversized, or read. Links are
    resolved by the listing, which holds no file outside the root.
    """
    clean = asked.select("path", normalized(F.col("path")).alias("_clean"))
    known = files.select(F.col("path").alias("_clean"), "length", "content")
    status = F.when(F.col("_clean").isNull(), "outside_root").when(F.col("length").isNull(), "missing").when(F.col("length") > most_bytes, "oversized").otherwise("read")
    met = clean.join(known, "_clean", "left").withColumn("status", status)
    return met.select("path", "status", F.when(F.col("status") == "read", F.col("content")).alias("content"))


def go_manifests(files: DataFrame) -> DataFrame:
    """(path, digest, line, directive, module, version, target, target_version): what go.mod, go.work and vendor/modules.txt say.

    files: (path, content). Directives are module, go, toolchain, require, use,
    replace, and of vendored modules vendor_module and vendor_package. Blocks in
    parentheses carry their directive forward; comments behind // go.
    """
    base = base_name(F.col("path"))
    mods = files.filter(base.isin("go.mod", "go.work"))
    vendor = files.filter((base == "modules.txt") & (base_name(directory(F.col("path"))) == "vendor"))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)

    def numbered(rows: DataFrame) -> DataFrame:
        each = rows.select("path", F.sha2("content", 256).alias("digest"), F.posexplode(F.split("content", "\n")).alias("at", "raw"))
        return each.select("path", "digest", (F.col("at") + 1).alias("line"), trimmed("raw").alias("raw"))

    rows = numbered(mods).withColumn("text", trimmed(F.regexp_replace("raw", r"(^|\s)//.*$", "")))
    opened = F.regexp_extract("text", r"^([a-z]+)\s*\($", 1)
    mark = F.when(opened != "", opened).when(F.col("text") == ")", "")
    rows = rows.withColumn("block", F.coalesce(F.last(mark, ignorenulls=True).over(order), F.lit(""))).filter((opened == "") & ~F.col("text").isin("", ")"))
    whole = F.when(F.col("block") != "", F.concat("block", F.lit(" "), "text")).otherwise(F.col("text"))
    words = F.transform(F.split(whole, r"\s+"), lambda x: F.regexp_replace(x, '^["`]|["`]$', ""))
    rows = rows.withColumn("w", words).withColumn("arrow", F.array_position("w", "=>").cast("int"))
    of = lambda k: F.get("w", F.lit(k))
    after = lambda k: F.get("w", F.col("arrow") + k)
    is_replace = (of(0) == "replace") & (F.col("arrow") > 0)
    version = F.when(of(0).isin("go", "toolchain"), of(1)).when(~is_replace | (F.col("arrow") == 4), of(2))
    module = F.when(~of(0).isin("go", "toolchain"), of(1))
    known = rows.filter(of(0).isin("module", "go", "toolchain", "require", "use") | is_replace)
    out = known.select("path", "digest", "line", of(0).alias("directive"), module.alias("module"), version.alias("version"), F.when(is_replace, after(0)).alias("target"), F.when(is_replace, after(1)).alias("target_version"))
    lines = numbered(vendor).withColumn("w", F.split("raw", r"\s+"))
    is_module = F.col("raw").rlike(r"^# \S+ v\S+")
    head = F.struct(F.when(is_module, of(1)).alias("p"), F.when(is_module, of(2)).alias("v"))
    lines = lines.withColumn("m", F.last(F.when(F.startswith("raw", F.lit("# ")), head), ignorenulls=True).over(order))
    none = F.lit(None).cast("string")
    modules = lines.filter(is_module).select("path", "digest", "line", F.lit("vendor_module").alias("directive"), of(1).alias("module"), of(2).alias("version"), none.alias("target"), none.alias("target_version"))
    package = lines.filter(~F.startswith("raw", F.lit("#")) & (F.col("raw") != "") & F.col("m.p").isNotNull())
    packages = package.select("path", "digest", "line", F.lit("vendor_package").alias("directive"), F.col("m.p"), F.col("m.v"), F.col("raw"), none)
    return out.union(modules).union(packages)


def filesystem_target(target: Column) -> Column:
    """Does a replacement name a folder instead of a module?"""
    return target.rlike(r"^\.{1,2}(/|$)|^/|^[A-Za-z]:[\\/]")


def stored_rows(spark: SparkSession, source: str | dict, scope: str, key: dict[str, str] | None = None) -> DataFrame:
    """Rows of one security scope from a Parquet folder or a JDBC source, filtered where they are stored.

    source: a path, or the options of a JDBC read. key: further columns and
    their values, so that one row comes back.
    """
    rows = spark.read.format("jdbc").options(**source).load() if isinstance(source, dict) else spark.read.parquet(source)
    rows = rows.filter(F.col("security_scope_id") == scope)
    for column, value in (key or {}).items():
        rows = rows.filter(F.col(column) == value)
    return rows


def catalog_columns(spark: SparkSession, pattern: str = ".*") -> DataFrame:
    """(database, name, column, type, nullable) of the tables and views of the current database whose name matches."""
    rows = []
    for table in spark.catalog.listTables():
        if re.fullmatch(pattern, table.name):
            rows += [(".".join(table.namespace or []), table.name, c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table.name)]
    return spark.createDataFrame(rows, "database string, name string, column string, type string, nullable boolean")


def missing_columns(present: DataFrame, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """(name, column, type) that the catalog should have and has not, or has with another type."""
    asked = present.sparkSession.createDataFrame(wanted, "name string, column string, type string")
    return asked.join(present.select("name", "column", "type"), ["name", "column", "type"], "left_anti")

"""Inventories: keyed aggregations over listings, manifests and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators.limits import capped_groups


def with_directories(files: DataFrame) -> DataFrame:
    """(path, is_dir): the files and every directory above them."""
    dirs = files.select(F.explode(paths.ancestors(F.col("path"), itself=False)).alias("path")).distinct()
    return files.select("path").distinct().join(dirs, "path", "left_anti").select("path", F.lit(False).alias("is_dir")).union(dirs.select("path", F.lit(True)))


def language_share(items: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """(language, n, percentage) of items whose key the mapping (key, language) knows.

    The denominator counts known items only; percentages have two decimals,
    halves rounded up.
    """
    known = items.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(mapping, key).groupBy("language").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return known.select("language", "n", (F.floor(F.col("n") / total * 10000 + 0.5) / 100).alias("percentage"))


#: Rules that a pass over texts may carry.
MOST_RULES = 10_000


def token_evidence(texts: DataFrame, rules: DataFrame, file_col: str, text_col: str, most: int = 1000) -> DataFrame:
    """(name, ecosystem, files, evidence): files whose text holds a rule's token; evidence is the first so many, in order.

    One pass tries all rules (name, ecosystem, token) on each text; ValueError
    beyond MOST_RULES rules.
    """
    known = [tuple(r) for r in rules.select("token", "name", "ecosystem").distinct().limit(MOST_RULES + 1).collect()]
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    every = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(n).alias("name"), F.lit(e).alias("ecosystem")) for t, n, e in known)) if known else F.array().cast("array<struct<token:string,name:string,ecosystem:string>>")
    met = texts.select(F.col(file_col).alias("file"), F.explode(F.filter(every, lambda r: F.contains(F.col(text_col), r["token"]))).alias("r")).select("file", "r.*")
    found = capped_groups(met.withColumn("_e", F.struct("file", "token")), ["name", "ecosystem"], "_e", most)
    return found.select("name", "ecosystem", (F.size("values") + F.col("omitted")).alias("files"), F.col("values").alias("evidence"))


def keyed_merge(findings: DataFrame, keys: list[str], evidence: list[str]) -> DataFrame:
    """One row a key with its distinct evidence, sorted, and the number of findings."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set(F.struct(*evidence))).alias("evidence"))


def conflicts(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with at least so many distinct values, and these in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).filter(F.size("values") >= least)


def flag_counts(rows: DataFrame, total: str, **flags: Column) -> DataFrame:
    """One row: how many rows there are, and for how many each flag holds."""
    return rows.agg(F.count(F.lit(1)).alias(total), *(F.count_if(v).alias(k) for k, v in flags.items()))


def layout(entries: DataFrame) -> DataFrame:
    """One row: greatest depth, and numbers of distinct top-level directories and files."""
    d, top = paths.depth(F.col("path")), paths.top_segment(F.col("path"))
    is_top_file = (d == 1) & ~F.col("is_dir")
    return entries.agg(
        F.coalesce(F.max(d), F.lit(0)).alias("max_depth"),
        F.count_distinct(F.when(~is_top_file, top)).alias("top_directories"),
        F.count_distinct(F.when(is_top_file, top)).alias("top_files"),
    )


def monorepo(projects: DataFrame, workspace: Column, location: Column, member: Column, least: int = 2) -> DataFrame:
    """A row for each workspace: distinct locations and members, and whether either makes it a monorepo."""
    found = projects.groupBy(workspace.alias("workspace")).agg(F.count_distinct(location).alias("locations"), F.count_distinct(member).alias("members"))
    return found.withColumn("monorepo", (F.col("locations") >= least) | (F.col("members") >= least))


def evidence_cap(evidence: Column, most: int) -> tuple[Column, Column]:
    """The first so many of a sorted set of evidence, and the number left out."""
    whole = F.array_sort(F.array_distinct(evidence))
    return F.slice(whole, 1, most), F.greatest(F.size(whole) - most, F.lit(0))

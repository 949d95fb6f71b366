"""Resolving names and paths, with explicit ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import ancestors


def nearest_root(items: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """items with the deepest root that holds their path (null: none).

    The prefixes of each path meet the roots in an equi join, instead of every
    path meeting every root.
    """
    each = items.select(path).distinct().withColumn("_prefix", F.explode(ancestors(F.col(path))))
    found = each.join(roots.select(F.col(root).alias("_prefix")).distinct(), "_prefix").groupBy(path).agg(F.max_by("_prefix", F.length("_prefix")).alias(root))
    return items.join(found, path, "left")


def longest_matches(items: DataFrame, path: str, roots: DataFrame, root: str, payload: str) -> DataFrame:
    """(path, root, candidates, outcome): all owners of the longest root, which may tie."""
    each = items.select(path).distinct().withColumn("_prefix", F.explode(ancestors(F.col(path))))
    met = each.join(roots.select(F.col(root).alias("_prefix"), payload), "_prefix")
    best = met.withColumn("_rank", F.rank().over(Window.partitionBy(path).orderBy(F.length("_prefix").desc()))).filter("_rank = 1")
    owners = best.groupBy(path).agg(F.first("_prefix").alias(root), F.array_sort(F.collect_set(payload)).alias("candidates"))
    out = items.select(path).distinct().join(owners, path, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.withColumn("outcome", outcome(F.size("candidates")))


def outcome(candidates: Column) -> Column:
    """unresolved, resolved or ambiguous, by the number of candidates."""
    return F.when(candidates == 0, "unresolved").when(candidates == 1, "resolved").otherwise("ambiguous")


def lookup(references: DataFrame, key: str, declarations: DataFrame, name: str, target: str) -> DataFrame:
    """references with candidates, outcome and the target where there is exactly one."""
    known = declarations.groupBy(F.col(name).alias(key)).agg(F.array_sort(F.collect_set(target)).alias("candidates"))
    met = references.join(known, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(known.schema["candidates"].dataType)))
    return met.withColumn("outcome", outcome(F.size("candidates"))).withColumn("target", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)))


def cascade(references: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first tier that knows the key decides: tier, candidates and outcome.

    Each tier is a DataFrame (key, target); one left join a tier.
    """
    out = references
    for k, (_, tier) in enumerate(tiers):
        known = tier.groupBy(F.col("key").alias(key)).agg(F.count_distinct("target").alias(f"_n{k}"), F.min("target").alias(f"_t{k}"))
        out = out.join(known, key, "left")
    name = F.coalesce(*(F.when(F.col(f"_n{k}") > 0, F.lit(n)) for k, (n, _) in enumerate(tiers)), F.lit("none"))
    count = F.coalesce(*(F.col(f"_n{k}") for k in range(len(tiers))), F.lit(0))
    target = F.coalesce(*(F.when(F.col(f"_n{k}") > 0, F.struct(F.when(F.col(f"_n{k}") == 1, F.col(f"_t{k}")).alias("t"))) for k in range(len(tiers))))["t"]
    return out.select(*references.columns, name.alias("tier"), count.alias("candidates"), outcome(count).alias("outcome"), target.alias("target"))


def poisoned_aliases(imports: DataFrame, group: list[str], target: str) -> DataFrame:
    """Groups with their target, cleared where they have several."""
    return imports.groupBy(*group).agg(F.count_distinct(target).alias("n"), F.min(target).alias("t")).select(*group, outcome(F.col("n")).alias("outcome"), F.when(F.col("n") == 1, F.col("t")).alias("target"))


def unanimous(proofs: DataFrame, group: list[str], status: str, target: str) -> DataFrame:
    """Combine proofs: stale > ambiguous > resolved by all to one target > external by all > unresolved."""
    s = F.col(status)
    found = proofs.groupBy(*group).agg(
        F.bool_or(s == "stale").alias("stale"), F.bool_or(s == "ambiguous").alias("ambiguous"), F.bool_and(s == "resolved").alias("resolved"),
        F.bool_and(s == "external").alias("external"), F.count_distinct(F.when(s == "resolved", F.col(target))).alias("targets"), F.min(F.when(s == "resolved", F.col(target))).alias("target"),
    )
    state = (
        F.when(F.col("stale"), "unresolved")
        .when(F.col("ambiguous") | (F.col("targets") > 1), "ambiguous")
        .when(F.col("resolved") & (F.col("targets") == 1), "resolved")
        .when(F.col("external"), "external")
        .otherwise("unresolved")
    )
    return found.select(*group, state.alias("state"), F.when(state == "resolved", F.col("target")).alias("target"))


def import_state(rows: DataFrame) -> DataFrame:
    """The decision table of an import, over one row an import.

    Columns: stale, binding (resolved, ambiguous, external or null), has_target,
    proofs (number), proof_missing, proofs_disagree, omitted, targets_stale
    (first bad target file is stale), targets_unverified, all_external,
    all_standard (booleans). Adds state; `error` marks contradictions.
    """
    c = F.col
    state = (
        F.when(c("stale"), "stale")
        .when(c("binding").isNull(), "unresolved")
        .when((c("binding") == "resolved") & c("proof_missing") & c("omitted"), "unresolved")
        .when((c("binding") == "resolved") & (c("proof_missing") | c("proofs_disagree")), "error")
        .when((c("binding") == "resolved") & c("targets_stale"), "stale")
        .when((c("binding") == "resolved") & c("targets_unverified"), "unresolved")
        .when(c("binding") == "resolved", "resolved_local")
        .when(c("has_target"), "error")
        .when(c("binding") == "ambiguous", "ambiguous")
        .when((c("binding") == "external") & (c("proofs") == 0) & c("omitted"), "unresolved")
        .when((c("binding") == "external") & ((c("proofs") == 0) | ~c("all_external")), "error")
        .when((c("binding") == "external") & c("all_standard"), "standard_library")
        .when(c("binding") == "external", "external")
        .otherwise("unresolved")
    )
    return rows.withColumn("state", state)


def reconcile(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, outcome): matched, ambiguous (many on the right), left_only or right_only."""
    a = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_r"))
    state = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").when(F.col("_r") > 1, "ambiguous").otherwise("matched")
    return a.join(b, key, "full_outer").select(*key, state.alias("outcome"))


def containing_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points with the half-open interval of their key that holds them; intervals of a key do not overlap.

    Intervals and points of a key are sorted together once; the last interval
    that begins at or before a point is the only one that may hold it. Empty
    intervals, and those without an end, hold nothing.
    """
    real = intervals.filter(F.col(start) < F.col(end))
    own, asked = [c for c in real.columns if c != key], [c for c in points.columns if c != key]
    left = real.select(key, F.col(start).alias("_at"), F.lit(0).alias("_turn"), F.struct(*own).alias("_i"))
    both = left.unionByName(points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.struct(*asked).alias("_p")), allowMissingColumns=True)
    last = F.last("_i", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_i", last).filter("_turn = 1").filter(F.col("_at") < F.col("_i")[end])
    return met.select(key, *(F.col("_p")[c].alias(c) for c in asked), *(F.col("_i")[c].alias(c) for c in own if c not in asked))


def missing_methods(required: Column, have: Column) -> Column:
    """Required members that are not there, in order."""
    return F.array_sort(F.array_except(required, have))

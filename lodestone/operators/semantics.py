"""Program facts: scopes, type relations, interface satisfaction and their counters, over tables of extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import ancestors
from lodestone.operators.resolution import outcome


def in_scope_of(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """references (reference, scope, name) with scope_found, candidates, outcome and target: the innermost scope that declares the name decides.

    Scopes are paths; an inner scope's path begins with the outer one's.
    declarations: (scope, name, target).
    """
    each = references.select("reference", "name", F.explode(ancestors(F.col("scope"))).alias("scope_found"))
    met = each.join(declarations.withColumnRenamed("scope", "scope_found"), ["scope_found", "name"])
    best = met.withColumn("_k", F.rank().over(Window.partitionBy("reference").orderBy(F.length("scope_found").desc()))).filter("_k = 1")
    found = best.groupBy("reference").agg(F.first("scope_found").alias("scope_found"), F.count_distinct("target").alias("candidates"), F.min("target").alias("target"))
    out = references.join(found, "reference", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("outcome", outcome(F.col("candidates"))).withColumn("target", F.when(F.col("candidates") == 1, F.col("target")))


#: Names that every Go scope knows. Fixed values.
BUILTIN_TYPES = (
    "any", "bool", "byte", "comparable", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64",
    "rune", "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr",
)


def type_relations(candidates: DataFrame, local: DataFrame, imported: DataFrame) -> DataFrame:
    """candidates (relation, package, qualifier or null, name or null) with kind, outcome and target.

    A type without a name is structural. A name without a qualifier is looked up
    in its package and is else a builtin; a qualified one through the import that
    the qualifier means. local: (package, name, target); imported: (package,
    qualifier, name, target). Of several targets the outcome is ambiguous.
    """
    own = local.groupBy("package", "name").agg(F.count_distinct("target").alias("_ln"), F.min("target").alias("_lt"))
    far = imported.groupBy("package", "qualifier", "name").agg(F.count_distinct("target").alias("_in"), F.min("target").alias("_it"))
    met = candidates.join(own, ["package", "name"], "left").join(far, ["package", "qualifier", "name"], "left")
    plain, named = F.col("qualifier").isNull(), F.col("name").isNotNull()
    kind = F.when(~named, "structural").when(~plain, "imported").when(F.col("_ln").isNotNull(), "local").when(F.col("name").isin(*BUILTIN_TYPES), "builtin").otherwise("local")
    n = F.when(plain, F.col("_ln")).otherwise(F.col("_in"))
    state = F.when(kind.isin("structural", "builtin"), "resolved").when(~plain & n.isNull(), "external").otherwise(outcome(F.coalesce(n, F.lit(0))))
    target = F.when(n == 1, F.when(plain, F.col("_lt")).otherwise(F.col("_it")))
    return met.select(*candidates.columns, kind.alias("kind"), state.alias("outcome"), F.when(named, target).alias("target"))


def satisfaction(candidates: DataFrame, have: DataFrame, required: DataFrame) -> DataFrame:
    """(type, interface, required, missing_count, satisfied) of candidate pairs (type, interface).

    have: (type, method); required: (interface, method). A method counts by its
    whole signature. Candidates come from uses; types never meet all interfaces.
    """
    pairs = candidates.select("type", "interface").distinct()
    asked = pairs.join(required.distinct(), "interface", "left")
    met = asked.join(have.distinct().withColumn("_has", F.lit(1)), ["type", "method"], "left")
    counts = met.groupBy("type", "interface").agg(F.count("method").alias("required"), F.count_if(F.col("method").isNotNull() & F.col("_has").isNull()).alias("missing_count"))
    return counts.withColumn("satisfied", F.col("missing_count") == 0)


def missing(candidates: DataFrame, have: DataFrame, required: DataFrame) -> DataFrame:
    """(type, interface, ordinal, method): what each candidate lacks, in order, one a row."""
    pairs = candidates.select("type", "interface").distinct()
    lost = pairs.join(required.distinct(), "interface").join(have.distinct(), ["type", "method"], "left_anti")
    return lost.select("type", "interface", F.row_number().over(Window.partitionBy("type", "interface").orderBy("method")).alias("ordinal"), "method")


def merged_evidence(rows: DataFrame, key: list[str], evidence: str, most: int) -> DataFrame:
    """(key, total, evidence, omitted): rows of one key as one, with the first distinct pieces of evidence in order.

    No more than most pieces of a key come together.
    """
    once = rows.select(*key, evidence).distinct()
    ranked = once.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(evidence)))
    kept = ranked.groupBy(*key).agg(F.count(evidence).alias("total"), F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(evidence)))).alias("evidence"))
    return kept.withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0)))


def with_counters(files: DataFrame, references: DataFrame) -> DataFrame:
    """files (file, ...) with references and unresolved, the counts of their references (file, outcome)."""
    counts = references.groupBy("file").agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("outcome") != "resolved").alias("unresolved"))
    return files.join(counts, "file", "left").fillna(0, ["references", "unresolved"])


def within_limits(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """(package, files, bytes, code): each package's size, and a diagnostic where it is too large to analyse."""
    sizes = files.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return sizes.withColumn("code", F.when(F.col("files") > most_files, "package_file_limit").when(F.col("bytes") > most_bytes, "package_byte_limit"))


def staleness(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): recorded digests against current ones: fresh, stale, or missing where the file is gone."""
    now = current.select(key, F.col(digest).alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col(digest), "fresh").otherwise("stale")
    return recorded.join(now, key, "left").select(key, state.alias("state"))


def gauges(snapshot: DataFrame, labels: list[str], values: list[str]) -> DataFrame:
    """(labels..., metric, value): each number of a snapshot as a sample of its own; nulls are no samples."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values)))
    return snapshot.select(*labels, each.alias("x")).select(*labels, "x.metric", "x.value").filter("value IS NOT NULL")


def renamed(rows: DataFrame, names: dict[str, str], **constants: Column) -> DataFrame:
    """The columns of names under their new names, and constant columns."""
    return rows.select(*(F.col(a).alias(b) for a, b in names.items()), *(c.alias(k) for k, c in constants.items()))

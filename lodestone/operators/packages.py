"""Package identity: which package an import means, in each context that applies.

An import (module, import path) is answered by the first rule that has anything
to say: the longest module paths of the context, in vendor contexts the vendored
packages, the replacements of the workspace, those of the importing module; what
is left is external. A package outside any module is unmanaged and stays
unresolved. All rules are equi joins: an import path meets module paths through
its own prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.identity import length_tagged
from lodestone.functions.paths import ancestors
from lodestone.operators.resolution import outcome


def version_at_least(value: Column, major: int, minor: int) -> Column:
    """Is a version at least major.minor? What follows the minor's digits is ignored; false without two numbers."""
    parts = F.split(F.trim(value), r"\.")
    first, second = F.get(parts, F.lit(0)), F.regexp_extract(F.get(parts, F.lit(1)), "^[0-9]*", 0)
    a, b = F.when(first.rlike(r"^[+-]?[0-9]{1,9}\z"), first.cast("int")), F.when(second.rlike(r"^[0-9]{1,9}\z"), second.cast("int"))
    return F.coalesce((a > major) | ((a == major) & (b >= minor)), F.lit(False)) & b.isNotNull()


def importable(packages: DataFrame, files: DataFrame) -> DataFrame:
    """packages (package) with importable: has any file that is parsed and no test?"""
    flags = files.groupBy("package").agg(F.bool_or((F.col("status") == "parsed") & ~F.col("is_test")).alias("importable"))
    return packages.join(flags, "package", "left").withColumn("importable", F.coalesce("importable", F.lit(False)))


def members(files: DataFrame) -> DataFrame:
    """(directory, name, ordinal, file): the files of each package in order, one a row."""
    one = Window.partitionBy("directory", "name").orderBy("file")
    return files.select("directory", "name", "file").distinct().select("directory", "name", F.row_number().over(one).alias("ordinal"), "file")


def name_conflicts(files: DataFrame) -> DataFrame:
    """(directory, names): directories whose files name several packages, names of external tests not counted."""
    real = files.filter(~F.col("name").endswith("_test")).groupBy("directory").agg(F.count_distinct("name").alias("names"))
    return real.filter("names > 1")


def in_contexts(imports: DataFrame, contexts: DataFrame) -> DataFrame:
    """imports (module, ...), once each, in every context (context, kind, members) whose members hold their module."""
    each = contexts.select("context", "kind", F.explode(F.array_distinct("members")).alias("module"))
    return imports.distinct().join(each, "module")


def longest_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(context, import_path, target): modules of a context (context, module_path, target) with the longest path that holds the import."""
    each = imports.select("context", "import_path").distinct().withColumn("module_path", F.explode(ancestors(F.col("import_path"))))
    met = each.join(modules, ["context", "module_path"])
    best = met.withColumn("_k", F.rank().over(Window.partitionBy("context", "import_path").orderBy(F.length("module_path").desc())))
    return best.filter("_k = 1").select("context", "import_path", "module_path", "target")


def vendored(imports: DataFrame, declared: DataFrame, required: DataFrame) -> DataFrame:
    """(module, import_path, declarations, valid, outcome) of imports against vendored packages.

    declared: (import_path, module_path, version). required: (module,
    module_path, version). A declaration is valid if the importing module
    requires its module in that version. None declared: external; none valid:
    unresolved; one: resolved; several: ambiguous.
    """
    asked = imports.select("module", "import_path").distinct()
    met = asked.join(declared, "import_path", "left").join(required.withColumnRenamed("version", "_v"), ["module", "module_path"], "left")
    inside = (F.col("import_path") == F.col("module_path")) | F.startswith("import_path", F.concat("module_path", F.lit("/")))
    ok = F.coalesce((F.col("version") == F.col("_v")) & inside, F.lit(False))
    counts = met.groupBy("module", "import_path").agg(F.count("module_path").alias("declarations"), F.count_if(ok).alias("valid"))
    return counts.withColumn("outcome", F.when(F.col("declarations") == 0, "external").otherwise(outcome(F.col("valid"))))


def replaced(imports: DataFrame, replacements: DataFrame, required: DataFrame, group: tuple[str, ...] = ("module", "import_path"), owner: str | None = None) -> DataFrame:
    """(group..., old_path, specific, filesystem, targets): the replacement rules that decide an import.

    replacements: (old_path, old_version or null, target, filesystem, and owner,
    where the name of a column of group is given that must be the rule's owner).
    required: (module, module_path, version). A rule applies if the importing
    module requires the old path, in the old version where one is named, and the
    import lies below it. The longest old path wins; among these, rules with a
    version win over rules without.
    """
    prefixes = imports.select(*group).distinct().withColumn("old_path", F.explode(ancestors(F.col("import_path"))))
    rules = replacements.withColumnRenamed("owner", owner) if owner else replacements
    met = prefixes.join(required.withColumnRenamed("module_path", "old_path"), ["module", "old_path"]).join(rules, [*([owner] if owner else []), "old_path"])
    fits = met.filter(F.col("old_version").isNull() | (F.col("old_version") == F.col("version")))
    one = Window.partitionBy(*group).orderBy(F.length("old_path").desc(), F.col("old_version").isNull())
    best = fits.withColumn("_k", F.dense_rank().over(one)).filter("_k = 1")
    return best.groupBy(*group).agg(
        F.first("old_path").alias("old_path"), F.first(F.col("old_version").isNotNull()).alias("specific"),
        F.bool_or("filesystem").alias("filesystem"), F.array_sort(F.collect_set("target")).alias("targets"),
    )


def package_proofs(imports: DataFrame, contexts: DataFrame, modules: DataFrame, declared: DataFrame, required: DataFrame, replacements: DataFrame) -> DataFrame:
    """(context, module, import_path, kind, status, target): how each import is proved in each context.

    imports: (module, import_path); module is null outside any module. contexts:
    (context, kind, members), kind module, workspace, module_vendor or
    workspace_vendor. modules: (context, module_path, target) of the packages in
    reach. replacements carry owner: the context's or the module's name; those of
    the context come first. Statuses are resolved, ambiguous, unresolved and
    external; target is null unless resolved.
    """
    asked = in_contexts(imports.filter("module IS NOT NULL"), contexts)
    own = longest_modules(asked, modules).groupBy("context", "import_path").agg(F.count_distinct("target").alias("_n"), F.min("target").alias("_t"))
    vendor_kind = F.col("kind").endswith("vendor")
    vendor = vendored(asked.filter(vendor_kind), declared, required).select("module", "import_path", F.col("outcome").alias("_vendor"))
    rules = []
    for name, owner in (("_workspace", "context"), ("_own", "module")):
        found = replaced(asked, replacements, required, ("context", "module", "import_path"), owner)
        rules.append(found.select("context", "module", "import_path", F.struct("filesystem", F.size("targets").alias("n"), F.get("targets", F.lit(0)).alias("t")).alias(name)))
    met = asked.join(own, ["context", "import_path"], "left").join(vendor, ["module", "import_path"], "left")
    for rule in rules:
        met = met.join(rule, ["context", "module", "import_path"], "left")
    workspace = F.col("kind").startswith("workspace")
    rule = F.coalesce(F.when(workspace, F.col("_workspace")), F.col("_own"))
    known = F.col("_n").isNotNull()
    status = F.when(known, outcome(F.col("_n"))).when(vendor_kind, F.coalesce("_vendor", F.lit("external"))).when(rule.isNull() | ~rule["filesystem"], "external").otherwise(outcome(rule["n"]))
    kind = F.when(known, F.when(workspace, "workspace_module").otherwise("same_module")).when(vendor_kind, "vendor").when(rule["filesystem"], "local_replace")
    target = F.when(known & (F.col("_n") == 1), F.col("_t")).when(~known & ~vendor_kind & rule["filesystem"] & (rule["n"] == 1), rule["t"])
    none = F.lit(None).cast("string")
    unmanaged = imports.filter("module IS NULL").distinct().select(none.alias("context"), "module", "import_path", none.alias("kind"), F.lit("unresolved").alias("status"), none.alias("target"))
    return met.select("context", "module", "import_path", kind.alias("kind"), status.alias("status"), target.cast("string").alias("target")).union(unmanaged)


def bound_imports(imports: DataFrame, bindings: DataFrame, key: list[str]) -> DataFrame:
    """imports with the binding of their whole key (file, path, alias, place); bound says whether there is one.

    Of several bindings of one key the last by binding is taken.
    """
    last = bindings.groupBy(*key).agg(F.max("binding").alias("binding"))
    return imports.join(last, key, "left").withColumn("bound", F.col("binding").isNotNull())


def proof_id(context: Column, package: Column, path: Column, kinds: Column) -> Column:
    """Names a proof by its parts behind their lengths."""
    return F.concat(length_tagged(context, package, path), F.lit("|"), F.array_join(F.array_sort(F.array_distinct(kinds)), ","))


def boundary_name(package: Column, context: Column, path: Column) -> Column:
    """A name for what lies outside the graph: stable for an import of a package in a context."""
    return F.sha2(F.encode(length_tagged(F.lit("boundary/v1"), package, context, path), "UTF-8"), 256)

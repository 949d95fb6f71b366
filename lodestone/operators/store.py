"""Content-addressed payloads, lifecycles, retention and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.identity import segment


def payloads(rows: DataFrame, content: str) -> DataFrame:
    """(digest, size, content): one row for each different content."""
    data = F.encode(content, "UTF-8")
    keyed = rows.filter(F.col(content).isNotNull()).select(F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"), data.alias("content"))
    return keyed.dropDuplicates(["digest"])


def stage(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The payloads that the store lacks."""
    return new.join(existing.select("digest"), "digest", "left_anti")


def chunks(stored: DataFrame, size: int) -> DataFrame:
    """(digest, ordinal, bytes): pieces of at most so many bytes; an empty payload has none."""
    number = F.ceil(F.octet_length("content") / size).cast("int")
    each = stored.filter(F.octet_length("content") > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(0), number - 1)))
    return each.select("digest", "ordinal", F.substring("content", F.col("ordinal") * size + 1, F.lit(size)).alias("bytes"))


def reassemble(pieces: DataFrame) -> DataFrame:
    """(digest, size, verified): join pieces in order and recompute their digest."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "bytes"))), lambda x: F.hex(x["bytes"]))
    whole = pieces.groupBy("digest").agg(F.unhex(F.array_join(ordered, "")).alias("content"))
    return whole.select("digest", F.octet_length("content").cast("long").alias("size"), (F.sha2("content", 256) == F.col("digest")).alias("verified"))


def unreferenced(stored: DataFrame, references: DataFrame, key: str, created: str, cutoff: Column) -> DataFrame:
    """Stored rows without a reference, made before the cutoff."""
    return stored.join(references.select(key).distinct(), key, "left_anti").filter(F.col(created) < cutoff)


def purge_batch(parents: DataFrame, key: str, order: list[Column], size: int, children: DataFrame, child_key: str) -> DataFrame:
    """One row: the oldest parents of a batch, their children, and whether none is left."""
    batch = parents.orderBy(*order).limit(size)
    of_batch = children.join(F.broadcast(batch.select(F.col(key).alias(child_key))), child_key, "left_semi").agg(F.count(F.lit(1)).alias("children"))
    total = parents.agg(F.count(F.lit(1)).alias("_total"))
    return batch.agg(F.count(F.lit(1)).alias("purged")).crossJoin(of_batch).crossJoin(total).select("purged", "children", (F.col("_total") <= size).alias("complete"))


def current(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))).filter("_n = 1").drop("_n")


def violations(history: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Steps (key, previous, state, ...) that no row (previous, next) of allowed permits; first states are free."""
    step = history.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).filter("previous IS NOT NULL")
    ok = allowed.select(F.col("previous"), F.col("next").alias(state))
    return step.join(ok, ["previous", state], "left_anti")


def transition(rows: DataFrame, state: str, moves: dict[str, str]) -> DataFrame:
    """rows in their next state, with changed; states that moves lacks stay."""
    table = F.create_map(*(F.lit(x) for pair in moves.items() for x in pair))
    return rows.withColumn("changed", table[F.col(state)].isNotNull()).withColumn(state, F.coalesce(table[F.col(state)], F.col(state)))


def guarded(rows: DataFrame, requests: DataFrame, key: str, state: str, allowed: dict[str, str]) -> DataFrame:
    """(key, to, state, outcome) of requests (key, to), at most one a key: the state afterwards, and what the request came to.

    allowed: the one state from which each may be entered. changed; replayed where
    the row is there already; conflict from any other state, or if no row may go
    there; missing where there is no row.
    """
    table = F.create_map(*(F.lit(x) for pair in allowed.items() for x in pair))
    met = requests.select(key, "to").join(rows.select(key, F.col(state).alias("_state")), key, "left")
    outcome = F.when(F.col("_state").isNull(), "missing").when(F.col("_state") == F.col("to"), "replayed").when(F.col("_state").eqNullSafe(table[F.col("to")]), "changed").otherwise("conflict")
    return met.withColumn("outcome", outcome).select(key, "to", F.when(F.col("outcome") == "changed", F.col("to")).otherwise(F.col("_state")).alias("state"), "outcome")


def register(existing: DataFrame, requests: DataFrame, key: str, digest: str) -> DataFrame:
    """requests with outcome: created, replayed (same digest) or conflict."""
    known = existing.select(F.col(key), F.col(digest).alias("_known"))
    out = F.when(F.col("_known").isNull(), "created").when(F.col("_known") == F.col(digest), "replayed").otherwise("conflict")
    return requests.join(known, key, "left").withColumn("outcome", out).drop("_known")


def typed_statistics(rows: DataFrame, names: dict[str, Column]) -> DataFrame:
    """(name, kind, integer_value, decimal_value, boolean_value, text_value): named values as typed attribute rows, one value each.

    A value's kind is that of its column: integer, decimal (also floating), boolean or text.
    """
    kinds = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "double": "decimal", "float": "decimal", "boolean": "boolean"}
    known = rows.select(*(v.alias(k) for k, v in names.items()))
    out = []
    for name, kind in known.dtypes:
        own = "decimal" if kind.startswith("decimal") else kinds.get(kind, "text")
        value = lambda k, to, name=name, own=own: (F.col(name) if own == k else F.lit(None)).cast(to).alias(f"{k}_value")
        out.append(F.struct(F.lit(name).alias("name"), F.lit(own).alias("kind"), value("integer", "long"), value("decimal", "decimal(38,6)"), value("boolean", "boolean"), value("text", "string")))
    return known.select(F.explode(F.array(*out)).alias("s")).select("s.*")


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(relation, key): references without a target."""
    lost = rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return lost.select(F.lit(name).alias("relation"), F.col(key).cast("string").alias("key"))


def manifest_digest(rows: DataFrame, group: str, order: Column, parts: list[Column]) -> DataFrame:
    """(group, artifacts, digest): SHA-256 over length-prefixed parts of the group's rows, in order."""
    body = F.concat(*(segment(p) for p in parts))
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.hex(body).alias("b"))))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("artifacts"), F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["b"]), "")), 256).alias("digest"))


def layered(layers: DataFrame, key: str, value: str, layer: str, priority: str) -> DataFrame:
    """(key, value, layer) of the layer of highest priority that sets a value."""
    best = F.max_by(F.struct(F.col(value).alias(value), F.col(layer).alias(layer)), F.col(priority))
    return layers.filter(F.col(value).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, f"b.{value}", f"b.{layer}")


def profile_completeness(profile: DataFrame, produced: DataFrame, name: str) -> DataFrame:
    """Each artifact of the profile with state: available, optional or missing."""
    there = produced.select(name).distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("_there"), "available").when(F.col("required"), "missing").otherwise("optional")
    return profile.join(there, name, "left").select(name, state.alias("state"))


def delete_using(rows: DataFrame, victims: DataFrame, key: list[str]) -> DataFrame:
    """What is left of rows without those whose key stands among the victims; files are rewritten, not changed."""
    return rows.join(victims.select(*key).distinct(), key, "left_anti")


def with_each(rows: DataFrame, name: str, values: list) -> DataFrame:
    """Every row with every value of a short list."""
    return rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))

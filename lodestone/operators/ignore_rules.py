"""Ordered ignore rules over a file listing: the last rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import ancestors


@dataclass(frozen=True)
class Rule:
    """One compiled rule; regex is searched in the path below base."""

    ordinal: int
    regex: str
    base: str
    negated: bool
    directories_only: bool


def glob_regex(glob: str, anchored: bool) -> str:
    """A Java regex for a glob of *, ** and ?; character classes are refused."""
    if "[" in glob:
        raise ValueError(f"character classes are not supported: {glob}")
    pieces = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: pieces.get(m[0]) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", m[0]), glob)
    return ("^" if anchored or "/" in glob else "(?:^|/)") + body + r"\z"


def compile_rule(ordinal: int, line: str, base: str = "") -> Rule | None:
    """A rule from a line of an ignore file; None for blanks and comments."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated or text[:2] in (r"\#", r"\!") else text
    text = text.replace("\\", "/")
    only = text.endswith("/")
    text = text[:-1] if only else text
    anchored = text.startswith("/")
    text = text[1:] if anchored else text
    return Rule(ordinal, glob_regex(text, anchored), base, negated, only) if text else None


def rules_table(spark, lines: list[tuple[str, str]]) -> DataFrame:
    """Rules from (base, line), in order; ignore files come by depth and path, configured lines last. At most MOST_RULES, as they go to all tasks."""
    if len(lines) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rules = [r for k, (base, line) in enumerate(lines) if (r := compile_rule(k, line, base))]
    return spark.createDataFrame([(r.ordinal, r.regex, r.base, r.negated, r.directories_only) for r in rules], "ordinal int, regex string, base string, negated boolean, directories_only boolean")


#: Rules that a run may have; each is tried on every part of every path.
MOST_RULES = 10_000


def rule_lines(files: DataFrame, config: list[str] = ()) -> list[tuple[str, str]]:
    """(base, line) of ignore files (path, content), by depth, path and line, and of configured lines behind them; ValueError beyond MOST_RULES lines."""
    p = F.col("path")
    base = F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*\z", "")).otherwise("")
    each = files.select("path", base.alias("base"), F.size(F.split("path", "/")).alias("depth"), F.posexplode(F.split("content", "\n")).alias("at", "line"))
    rows = each.filter(F.trim("line") != "").orderBy("depth", "path", "at").limit(MOST_RULES + 1).collect()
    found = [(r["base"], r["line"]) for r in rows] + [("", line) for line in config]
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return found


def decide(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """entries (path, is_dir) with ignored and the deciding rule's ordinal (null: none matched).

    A rule matches an entry if it matches the entry or any directory above it;
    rules are a small table, one broadcast theta join.
    """
    each = entries.select("path", "is_dir", F.explode(ancestors(F.col("path"))).alias("part"))
    below = F.when(F.col("base") == "", F.col("part")).when(F.col("part").startswith(F.concat("base", F.lit("/"))), F.expr("substring(part, length(base) + 2)"))
    dir_ok = ~F.col("directories_only") | F.col("is_dir") | (F.col("part") != F.col("path"))
    met = each.join(F.broadcast(rules), dir_ok & F.expr("rlike(CASE WHEN base = '' THEN part WHEN startswith(part, concat(base, '/')) THEN substring(part, length(base) + 2) END, regex)"))
    last = met.withColumn("below", below).groupBy("path", "is_dir").agg(F.max("ordinal").alias("rule"), F.max_by(~F.col("negated"), "ordinal").alias("ignored"))
    return entries.join(last, ["path", "is_dir"], "left").select("path", "is_dir", F.coalesce("ignored", F.lit(False)).alias("ignored"), "rule")

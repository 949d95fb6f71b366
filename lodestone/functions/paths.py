"""Slash paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Lower-case text from the last dot of the last segment on; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; a dot at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def top_segment(path: Column) -> Column:
    return F.split(path, "/")[0]


def ancestors(path: Column, itself: bool = True) -> Column:
    """All prefixes of a path that end before a slash, shortest first, and the path itself."""
    parts = F.split(path, "/")
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def normalized(path: Column) -> Column:
    """A clean relative path; null where it is absolute, names a drive, holds NUL or leaves the root."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    kept = F.filter(F.split(slashes, "/"), lambda x: (x != "") & (x != "."))
    # Fold the segments: .. takes the last one back, and marks the path where there is none.
    folded = F.aggregate(kept, F.array().cast("array<string>"), lambda a, x: F.when(x != "..", F.array_append(a, x)).when((F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, x)))
    out = F.when(F.size(folded) == 0, F.lit(".")).otherwise(F.array_join(folded, "/"))
    bad = slashes.startswith("/") | slashes.contains(":") | slashes.contains("\0") | (out == "..") | out.startswith("../")
    return F.when(~bad, out)


def within(path: Column, root: Column) -> Column:
    """Is the path the root or below it, by whole segments?"""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def has_hidden_segment(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def slug(text: Column) -> Column:
    """Lower case, one dash for each other character, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", "-"), r"^-+|-+\z", "")

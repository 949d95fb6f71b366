"""Files of a checkout as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote, urlsplit
from urllib.request import url2pathname

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import base_name
from lodestone.operators.inventory import with_directories
from lodestone.tables import written


def read_files(spark: SparkSession, root: str, most_bytes: int = 5 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(path, content) of all files below a root, and (path, code) of those that are too large.

    Version-control data is left out. Sizes are known before contents are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.split("://")[-1].rstrip("/") + "/"
    rows = found.select(F.substring_index("path", top, -1).alias("path"), "length", "content")
    rows = rows.filter(~F.col("path").rlike(r"(^|/)\.git/"))
    small = rows.filter(F.col("length") <= most_bytes).select("path", F.decode("content", "UTF-8").alias("content"))
    return small, rows.filter(F.col("length") > most_bytes).select("path", F.lit("too_large").alias("code"))


class WalkError(OSError):
    """A folder or an entry could not be read; the walk gives nothing."""


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def _listed(folder: str) -> list[tuple[str, bool]]:
    """Names in a folder, and which are folders themselves; links are none."""
    if not is_uri(folder) or folder.startswith("file:"):
        with os.scandir(url2pathname(urlsplit(folder).path) if is_uri(folder) else folder) as found:
            return [(x.name, x.is_dir(follow_symlinks=False)) for x in found]
    store, path = pa_fs.FileSystem.from_uri(folder)
    return [(x.base_name, x.type == pa_fs.FileType.Directory) for x in store.get_file_info(pa_fs.FileSelector(path))]


def walk(spark: SparkSession, root: str, with_git: bool = False) -> tuple[DataFrame, dict]:
    """(path, is_dir) of all that is below a root, empty folders too, and a report: name, root, git, files and folders.

    Folders of a level are listed by tasks, which must reach the root: a shared
    folder or a store. Links are entries and are not followed. Whatever is called
    .git sets git and, unless with_git, is left out with all that it holds. A folder
    that cannot be read, and a root that is none, raise WalkError.
    """
    top = root.rstrip("/")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    folder = f"{top}/{quote(path) if is_uri(top) else path}" if path else top
                    rows += [(f"{path}/{name}" if path else name, is_dir, None) for name, is_dir in _listed(folder)]
                except OSError as e:
                    rows.append((path, True, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "error"])

    level, found, git = spark.createDataFrame([("",)], "path string"), None, False
    while not level.isEmpty():
        rows = written(level.repartition("path").mapInPandas(listed, "path string, is_dir boolean, error string"))
        if lost := rows.filter("error IS NOT NULL").orderBy("path").first():
            raise WalkError(f"walk {lost['path'] or top}: {lost['error']}")
        marked = rows.select("path", "is_dir", (base_name(F.col("path")) == ".git").alias("_git"))
        git = git or not marked.filter("_git").isEmpty()
        kept = marked.filter(F.lit(with_git) | ~F.col("_git")).select("path", "is_dir")
        found = kept if found is None else found.union(kept)
        level = kept.filter("is_dir").select("path")
    counts = found.agg(F.count_if(~F.col("is_dir")), F.count_if(F.col("is_dir"))).first()
    return found, {"name": top.rpartition("/")[2], "root": top, "git": git, "files": counts[0], "folders": counts[1]}


def entries(files: DataFrame) -> DataFrame:
    """(path, is_dir) of files and the directories above them."""
    return with_directories(files)


def lines(files: DataFrame, comment: str | None = None) -> DataFrame:
    """(path, line, text): trimmed lines without what follows the comment mark."""
    each = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "raw"))
    text = F.substring_index("raw", comment, 1) if comment else F.col("raw")
    return each.select("path", "line", trimmed(text).alias("text"))


def trimmed(text: Column) -> Column:
    """Text without white space at its ends; all of it, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def named(files: DataFrame, names: list[str], any_case: bool = False) -> DataFrame:
    """Files with one of these base names; decided before their content is read."""
    base = base_name(F.col("path"))
    return files.filter((F.lower(base) if any_case else base).isin(*names))

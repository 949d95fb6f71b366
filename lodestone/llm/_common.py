"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Blank bytes of the contracts: space and U+0009 to U+000D.
BLANK = b" \t\n\x0b\x0c\r"
#: Stands for a null id inside an operator: after all other ids.
NULL_ID = (1 << 63) - 1


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


_BLANKS = re.compile(rb"[ \t-\r]")
PIECE = 1 << 20


def pieces(text: str | None) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text between blanks, lower-cased in A-Z, in pieces of about PIECE bytes, and whether a piece is the last."""
    data, at = (text or "").encode().lower(), 0
    while len(data) - at > PIECE and (m := _BLANKS.search(data, at + PIECE)):
        yield data[at : m.start()].split(), False
        at = m.start()
    yield data[at:].split(), True


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session; where it is unset, as in tests, a
    temporary folder of this machine is taken and remembered in the session, in
    local mode only.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


#: Lets Spark delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str = "table", compression: str = "snappy", batch: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage and survives lost executors.

    Once the table is there its shuffle files serve nothing and go at once.
    batch: rows that go to a Python worker at once, where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    if batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables written since each of the self_cleaning functions that now run began.
_scopes: list[list[DataFrame]] = []


def self_cleaning(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Make a function write what it returns and delete all other tables that it has written."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        own: list[DataFrame] = []
        _scopes.append(own)
        try:
            out = written(f(*args, **kwargs), f.__name__)
        finally:
            _scopes.pop()
        for df in own:
            if df is not out:
                forget(df)
        if _scopes:
            _scopes[-1].append(out)
        return out

    return run


def ordered_ids(docs: DataFrame, id_col: str) -> tuple[Column, int]:
    """Ids as longs in their order, null as NULL_ID after all others, and what was taken off each: 1 if the table itself holds NULL_ID, else 0."""
    doc = F.col(id_col).cast("long")
    low, high = docs.agg(F.min(doc), F.max(doc)).first()
    if high != NULL_ID:
        return F.coalesce(doc, F.lit(NULL_ID)), 0
    if low == -NULL_ID - 1:
        raise ValueError("ids take up all 64-bit numbers from the least to the greatest, which leaves none for null")
    return F.coalesce(doc - 1, F.lit(NULL_ID)), 1


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later result reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        with contextlib.suppress(Exception):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Write rows with consecutive numbers from 1 by distinct keys: ordered by range, then counted by partition."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = written(sorted_.select("*", F.shiftright("_at", 33).alias("_part")), "sorted")
    base, bases = 0, []
    for part, n in sorted(tuple(r) for r in table.groupBy("_part").count().collect()):  # a row a partition
        bases.append((part, base))
        base += n
    small = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))
    number = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return table.join(small, "_part").withColumn(name, number).drop("_part", "_at", "_base")


def sized(small: DataFrame, most: int) -> DataFrame:
    """Hint a broadcast if the (already written) table has at most so many rows; else leave the choice to Spark."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


#: What Python workers keep between tasks, by name; lean() empties what its task has no use for.
KEPT: dict[str, Callable[[], None]] = {}


def empty_caches(keep: tuple[str, ...]) -> None:
    """Empty this process's caches but those to keep; a function of its own, as a pickled task would bring a copy of KEPT."""
    for name, clear in KEPT.items():
        if name not in keep:
            clear()


def lean(task: Callable[..., Iterator], keep: tuple[str, ...] = ()) -> Callable[..., Iterator]:
    """A mapInArrow function whose idle worker holds little: other tasks' caches go before it, free memory after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches(keep)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every libc can
        ctypes.CDLL(None).malloc_trim(0)


def power_of_two(n: int, least: int, most: int) -> int:
    """The smallest power of two that is at least n, kept within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def id_sql(column: str) -> str:
    """DuckDB and Spark SQL for crc32 residues are not shared; this names the id's text form."""
    return f"CAST({column} AS STRING)"


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus

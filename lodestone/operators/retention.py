"""Tables that lose rows: buckets that are rewritten, versions that are never replaced, and leases on batches of work.

A kept table is a folder of data and a log of versions, of which each names the
folder of every bucket. Rows are dealt into buckets by a hash of their key, so that
deleting some rewrites their buckets only. A version is made by one writer alone; who
comes late reads the new version and begins again, so no deletion is lost and none
brings rows back. Readers hold a version, and its files stay until they are cleared.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.publication import Conflict, _Folder
from lodestone.tables import written


@dataclass(frozen=True)
class Kept:
    """A table in a folder, in so many buckets by the hash of a key."""

    spark: SparkSession
    folder: str
    name: str
    key: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket; the folders of the buckets that have any."""
        data = f"{self.folder.rstrip('/')}/data/{self.name}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(data)
        found = [x for x in _Folder(self.spark, data).names("") if x.startswith("_bucket=")]
        return {x.partition("=")[2]: f"{data}/{x}" for x in found}

    def create(self, rows: DataFrame) -> None:
        """Make the table of rows; Conflict where there is one."""
        body = json.dumps({"schema": rows.schema.json(), "buckets": self._write(rows)}, sort_keys=True)
        if not _Folder(self.spark, self.folder).append(f"tables/{self.name}", body, 0):
            raise Conflict(f"there is a table {self.name}")

    def _version(self) -> tuple[int, dict]:
        number, text = _Folder(self.spark, self.folder).latest(f"tables/{self.name}")
        if text is None:
            raise Conflict(f"there is no table {self.name}")
        return number, json.loads(text)

    def _rows(self, version: dict, only: set[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(version["schema"]))
        paths = [path for k, path in version["buckets"].items() if only is None or k in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The table's rows as they are now."""
        return self._rows(self._version()[1])

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows whose key is in keys (a column of the key's name); how many they were.

        Rewrites the buckets that hold such rows, at most as many as there are.
        """
        gone = written(keys.select(self.key).distinct())
        touched = {str(r[0]) for r in gone.select(self._bucket()).distinct().collect()}
        while True:
            number, version = self._version()
            old = {k: v for k, v in version["buckets"].items() if k in touched}
            if not old:
                return 0
            rows = self._rows(version, set(old))
            n = rows.join(gone, self.key, "left_semi").count()
            if not n:
                return 0
            new = self._write(rows.join(gone, self.key, "left_anti"))
            kept = {k: v for k, v in version["buckets"].items() if k not in old}
            if _Folder(self.spark, self.folder).append(f"tables/{self.name}", json.dumps(version | {"buckets": kept | new}, sort_keys=True), number):
                return n

    def clear(self, keep: int = 1) -> int:
        """Delete the data that none of the last versions names; how many folders went. Older versions can then not be read."""
        at = _Folder(self.spark, self.folder)
        last = at.versions(f"tables/{self.name}")[-keep:]
        named = {path for v in last for path in json.loads(at.read(f"tables/{self.name}/{v}"))["buckets"].values()}
        gone = 0
        for data in at.names("data"):
            if data.rpartition("-")[0] == self.name:
                for bucket in at.names(f"data/{data}"):
                    if bucket.startswith("_bucket=") and f"{self.folder.rstrip('/')}/data/{data}/{bucket}" not in named:
                        gone += at.fs.delete(at._path(f"data/{data}/{bucket}"), True)
        return gone


@dataclass
class Lease:
    """The right to a piece of work until some time, held by one owner at once: the last version of a log says who holds it."""

    spark: SparkSession
    folder: str
    name: str
    clock: Callable[[], float] = time.time
    number: int = field(default=0, init=False)

    def take(self, owner: str, seconds: float) -> bool:
        """Take or prolong the lease; false while another holds it, or where another was faster."""
        at = _Folder(self.spark, self.folder)
        number, text = at.latest(f"leases/{self.name}")
        held = json.loads(text) if text else None
        if held and held["owner"] != owner and held["until"] > self.clock():
            return False
        if not at.append(f"leases/{self.name}", json.dumps({"owner": owner, "until": self.clock() + seconds}), number):
            return False
        self.number = number + 1
        return True

    def holds(self, owner: str) -> bool:
        """Does an owner's lease still run, and has no other been taken since?"""
        number, text = _Folder(self.spark, self.folder).latest(f"leases/{self.name}")
        held = json.loads(text) if text else None
        return bool(held) and number == self.number and held["owner"] == owner and held["until"] > self.clock()

    def release(self, owner: str) -> None:
        """Give the lease back, if it is still the owner's."""
        at = _Folder(self.spark, self.folder)
        number, text = at.latest(f"leases/{self.name}")
        if text and json.loads(text)["owner"] == owner:
            at.append(f"leases/{self.name}", json.dumps({"owner": owner, "until": 0}), number)


@dataclass(frozen=True)
class Purged:
    """What a batch took: rows by table in the order of deletion, and whether nothing is left to purge."""

    rows: dict[str, int]
    complete: bool


def purge(parent: Kept, order: list[Column], due: Column, most: int, children: list[Kept], owner: str, seconds: float = 3600.0) -> Purged | None:
    """Delete the first so many due parents in order, children first; None while another owner holds the purge.

    children: tables with the parent's key, in the order in which they go. If the
    lease runs out on the way, the batch stops before the next table: its parents
    are still there, and the next batch begins with them.
    """
    lease = Lease(parent.spark, parent.folder, f"purge-{parent.name}")
    if not lease.take(owner, seconds):
        return None
    try:
        waiting = parent.rows().filter(due)
        batch = written(waiting.orderBy(*order, parent.key).select(parent.key).limit(most))
        complete = waiting.limit(most + 1).count() <= most
        rows: dict[str, int] = {}
        for table in [*children, parent]:
            if not lease.holds(owner):
                return Purged(rows, False)
            rows[table.name] = table.delete(batch.withColumnRenamed(parent.key, table.key))
        return Purged(rows, complete)
    finally:
        lease.release(owner)


def collect_garbage(stored: Kept, references: list[DataFrame], size: Column, due: Column, most: int, owner: str, seconds: float = 3600.0) -> tuple[int, int] | None:
    """Delete due rows that none of the references (tables with the key) names, at most so many; their number and the sum of their sizes. None while another owner does so."""
    lease = Lease(stored.spark, stored.folder, f"garbage-{stored.name}")
    if not lease.take(owner, seconds):
        return None
    try:
        loose = stored.rows().filter(due)
        for used in references:
            loose = loose.join(used.select(stored.key).distinct(), stored.key, "left_anti")
        batch = written(loose.orderBy(stored.key).limit(most).select(stored.key, size.cast("long").alias("_size")))
        total = batch.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
        return (stored.delete(batch.select(stored.key)), total) if lease.holds(owner) else (0, 0)
    finally:
        lease.release(owner)

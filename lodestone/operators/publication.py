"""Publications: several tables made visible at once, and what may happen to a scan.

A publication writes its tables to a folder of its own and then one manifest
beside it. Nothing reads tables but through a manifest, and a manifest appears
whole or not at all, and the first to create the name wins. So a lost driver leaves
files that nothing names, and publishing again with the same content is a replay.
What a name shows now is the last version of a log, of which each version is created
once and none is ever replaced: a reader finds the old one or the new one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.identity import segment


#: The name of a log's version.
VERSION = re.compile(r"[0-9]{12}\.json")


class Conflict(ValueError):
    """The name is taken by something else."""


class _Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.jvm, self.top = spark, spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole, unless there is one; true if it was written, which one of several writers is told.

        The file is written aside and then linked (a local folder) or renamed
        without overwriting, which the name node of a distributed file system does
        for one caller only. Stores of objects, which rename by copying, give no
        such promise.
        """
        to = self._path(name)
        aside = self._path(f"_{name.replace('/', '-')}-{uuid.uuid4().hex}")
        self._write(aside.getName(), text)
        self.fs.mkdirs(to.getParent())
        try:
            if self.fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), to.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context = self.jvm.org.apache.hadoop.fs.FileContext
                context.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(self.fs.makeQualified(aside), self.fs.makeQualified(to), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self.fs.delete(aside, False)

    def versions(self, name: str) -> list[str]:
        """The versions of a log, in order."""
        return [x for x in self.names(name) if VERSION.fullmatch(x)]

    def latest(self, name: str) -> tuple[int, str | None]:
        """The number and text of a log's last version; (0, None) where there is none."""
        found = self.versions(name)
        return (int(found[-1].partition(".")[0]), self.read(f"{name}/{found[-1]}")) if found else (0, None)

    def append(self, name: str, text: str, after: int) -> bool:
        """Make the version that follows a log's version after; false if another has made it."""
        return self.create(f"{name}/{after + 1:012d}.json", text)

    def point(self, name: str, text: str) -> None:
        """Let a log's last version be this text, whoever else writes to it."""
        while True:
            number, now = self.latest(name)
            if now == text or self.append(name, text, number):
                return

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self._path(name)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name)))


def table_digest(table: DataFrame) -> tuple[int, str]:
    """Rows and a digest of a table that depends on its rows only, not on their order: sums of the rows' hashes."""
    body = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    row = table.select(body.alias("_h")).agg(F.count(F.lit(1)).alias("n"), *(part(k).alias(f"s{k}") for k in range(4))).first()
    return row["n"], hashlib.sha256("|".join(str(row[k]) for k in ("n", "s0", "s1", "s2", "s3")).encode()).hexdigest()


@dataclass(frozen=True)
class Receipt:
    """What a publication holds, and whether it was published now or before."""

    scan: str
    digest: str
    tables: dict[str, tuple[int, str]]
    outcome: str


def publish(spark: SparkSession, folder: str, scan: str, tables: dict[str, DataFrame], current: str | None = None) -> Receipt:
    """Write tables and then their manifest; current: a name whose pointer shall show this scan.

    Published before with the same content: replayed; with other content: Conflict.
    """
    at = _Folder(spark, folder)
    made = {name: table_digest(table) for name, table in sorted(tables.items())}
    digest = hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()
    known = at.read(f"manifests/{scan}.json")
    if known is None:
        data = f"{folder.rstrip('/')}/data/{scan}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{data}/{name}")
        if at.create(f"manifests/{scan}.json", json.dumps({"scan": scan, "digest": digest, "tables": made, "data": data}, sort_keys=True)):
            if current:
                at.point(f"current/{current}", scan)
            return Receipt(scan, digest, made, "published")
        known = at.read(f"manifests/{scan}.json")
    if json.loads(known)["digest"] != digest:
        raise Conflict(f"{scan} is published with other content")
    if current:
        at.point(f"current/{current}", scan)
    return Receipt(scan, digest, made, "replayed")


def published(spark: SparkSession, folder: str, scan: str | None = None, current: str | None = None) -> dict[str, DataFrame] | None:
    """The tables of a scan, or of the one that a current pointer shows; None where nothing is published."""
    at = _Folder(spark, folder)
    scan = scan or at.latest(f"current/{current}")[1]
    text = at.read(f"manifests/{scan}.json") if scan else None
    if text is None:
        return None
    manifest = json.loads(text)
    return {name: spark.read.parquet(f"{manifest['data']}/{name}") for name in manifest["tables"]}


#: States of a scan, and where each may go.
MOVES = {None: ("running",), "running": ("succeeded", "failed", "canceled")}


@dataclass
class Scans:
    """The states of scans in a folder: one file a scan and state, written once, so that the first move wins."""

    spark: SparkSession
    folder: str

    def state(self, scan: str) -> dict | None:
        """The last state that a scan has reached."""
        at = _Folder(self.spark, self.folder)
        for name in ("end", "begin"):
            if text := at.read(f"scans/{scan}.{name}.json"):
                return json.loads(text)
        return None

    def begin(self, scan: str, request: dict, active: bool = True) -> str:
        """created; replayed where it was begun by the same request; Conflict otherwise, or if the repository is not active."""
        if not active:
            raise Conflict("the repository is not active")
        at = _Folder(self.spark, self.folder)
        body = json.dumps({"scan": scan, "state": "running", "request": request}, sort_keys=True)
        if at.create(f"scans/{scan}.begin.json", body):
            return "created"
        if at.read(f"scans/{scan}.begin.json") != body:
            raise Conflict(f"{scan} was begun by another request")
        return "replayed"

    def end(self, scan: str, state: str, detail: str = "") -> str:
        """Move a running scan to its last state: changed, or replayed where it is there; Conflict from any other."""
        if state not in MOVES["running"]:
            raise ValueError(f"no such state: {state}")
        now = self.state(scan)
        if now is None:
            raise Conflict(f"{scan} was not begun")
        body = json.dumps({"scan": scan, "state": state, "detail": detail}, sort_keys=True)
        if _Folder(self.spark, self.folder).create(f"scans/{scan}.end.json", body):
            return "changed"
        if self.state(scan)["state"] != state:
            raise Conflict(f"{scan} has ended otherwise")
        return "replayed"


def execute_scan(spark: SparkSession, folder: str, scan: str, request: dict, analyse: Callable[[], dict[str, DataFrame]], current: str | None = None) -> Receipt:
    """Begin, analyse, publish and end a scan; a scan that is published is returned as it is, whatever ends in between.

    Two callers may begin the same scan; both analyse, and the first manifest counts.
    """
    scans = Scans(spark, folder)
    scans.begin(scan, request)
    if known := _Folder(spark, folder).read(f"manifests/{scan}.json"):
        manifest = json.loads(known)
        scans.end(scan, "succeeded")
        return Receipt(scan, manifest["digest"], {k: tuple(v) for k, v in manifest["tables"].items()}, "reconciled")
    if (now := scans.state(scan)) and now["state"] != "running":
        raise Conflict(f"{scan} is {now['state']}")
    try:
        receipt = publish(spark, folder, scan, analyse(), current)
    except Exception as e:
        if _Folder(spark, folder).read(f"manifests/{scan}.json") is None:
            scans.end(scan, "failed", type(e).__name__)
        raise
    scans.end(scan, "succeeded")
    return receipt


def reconciliation(expected: DataFrame, scans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(scan, state): what became of publications whose outcome was not seen.

    expected: (scan, revision, digest); scans: (scan, revision, state);
    artifacts: (scan, digest). missing_unknown, running_unknown, failed,
    canceled, published_exact, or integrity where they contradict each other.
    """
    met = expected.join(scans.withColumnRenamed("revision", "_revision"), "scan", "left").join(artifacts.withColumnRenamed("digest", "_digest"), "scan", "left")
    state = (
        F.when(F.col("state").isNull(), "missing_unknown")
        .when(~F.col("revision").eqNullSafe(F.col("_revision")), "integrity")
        .when(F.col("state").isin("requested", "running"), "running_unknown")
        .when(F.col("state").isin("failed", "canceled"), F.col("state"))
        .when((F.col("state") == "succeeded") & F.col("digest").eqNullSafe(F.col("_digest")), "published_exact")
        .otherwise("integrity")
    )
    return met.select("scan", state.alias("state"))


def audit_rows(changes: DataFrame, action: str, actor: Column, target: Column, at: Column) -> DataFrame:
    """(audit_id, action, actor, target, at): one row a change, named by its content, so that appending again can be seen."""
    rows = changes.select(F.lit(action).alias("action"), actor.cast("string").alias("actor"), target.cast("string").alias("target"), at.cast("timestamp").alias("at"))
    body = F.concat(*(segment(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("action", "actor", "target", "at")))
    return rows.select(F.sha2(body, 256).alias("audit_id"), "*")


def append_audit(rows: DataFrame, folder: str) -> None:
    """Append audit rows to the log of a folder; nothing in it is ever changed."""
    rows.write.mode("append").parquet(f"{folder.rstrip('/')}/audit")


def profile_definitions(artifacts: DataFrame) -> DataFrame:
    """(profile, artifacts, digest) of named artifact lists (profile, ordinal, name, version, required); order counts."""
    body = F.concat(*(segment(F.col(c).cast("string")) for c in ("ordinal", "name", "version", "required")))
    lists = artifacts.groupBy("profile").agg(F.count(F.lit(1)).alias("artifacts"), F.array_sort(F.collect_list(F.struct("ordinal", F.hex(body).alias("b")))).alias("_l"))
    joined = F.unhex(F.array_join(F.transform("_l", lambda x: x["b"]), ""))
    return lists.select("profile", "artifacts", F.sha2(F.concat(segment(F.col("profile")), joined), 256).alias("digest"))


def lineage(artifacts: DataFrame) -> DataFrame:
    """(consumer, ordinal, source): each artifact's sources (name, sources) in order, one a row."""
    return artifacts.select(F.col("name").alias("consumer"), F.posexplode("sources").alias("ordinal", "source"))


@dataclass
class ArtifactStore:
    """Named tables of one run: each is put once."""

    _tables: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)

    def put(self, name: str, version: str, table: DataFrame) -> None:
        if name in self._tables:
            raise Conflict(f"{name} is there")
        self._tables[name] = (version, table)

    def get(self, name: str, version: str | None = None) -> DataFrame:
        if name not in self._tables:
            raise KeyError(name)
        own, table = self._tables[name]
        if version is not None and own != version:
            raise Conflict(f"{name} has version {own}, not {version}")
        return table

    def names(self) -> list[tuple[str, str]]:
        return [(name, version) for name, (version, _) in self._tables.items()]

    def reset(self) -> None:
        self._tables.clear()


@dataclass(frozen=True)
class Engine:
    """A step of a run: what it needs, by name and version, what it makes, with the columns of each, and how."""

    name: str
    needs: tuple[tuple[str, str], ...]
    makes: tuple[tuple[str, str, tuple[str, ...]], ...]
    run: Callable[[ArtifactStore], dict[str, DataFrame]]


class Pipeline:
    """Engines in order; names are unique, and the first failure ends the run."""

    def __init__(self, engines: list[Engine]) -> None:
        if len({e.name for e in engines}) < len(engines):
            raise Conflict("an engine's name is taken")
        made = [name for e in engines for name, *_ in e.makes]
        if len(set(made)) < len(made):
            raise Conflict("two engines make the same artifact")
        self.engines = engines

    def execute(self, store: ArtifactStore) -> list[tuple[str, str, str, str]]:
        """Run all; returns provenance rows (artifact, version, source, source version)."""
        provenance = []
        for engine in self.engines:
            for name, version in engine.needs:
                store.get(name, version)
            if taken := {x for x, _ in store.names()} & {x for x, *_ in engine.makes}:
                raise Conflict(f"{engine.name} would make {sorted(taken)} again")
            out = engine.run(store)
            if set(out) != {x for x, *_ in engine.makes}:
                raise Conflict(f"{engine.name} makes other artifacts than it says")
            for name, version, columns in engine.makes:
                if tuple(out[name].columns) != columns:
                    raise Conflict(f"{name} has other columns than {engine.name} says")
            for name, version, _ in engine.makes:
                store.put(name, version, out[name])
                provenance += [(name, version, *x) for x in engine.needs]
        return provenance


def capabilities(spark: SparkSession, known: list[tuple[str, bool, str]]) -> DataFrame:
    """(name, available, reason): what a report can and cannot say; names are unique."""
    if len({x for x, *_ in known}) < len(known):
        raise Conflict("a capability is listed twice")
    return spark.createDataFrame(known, "name string, available boolean, reason string")

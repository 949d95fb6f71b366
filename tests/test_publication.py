"""Publications, scans, documents, pages and composition."""

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodestone.operators import limits, publication, validity
from lodestone.operators.publication import ArtifactStore, Conflict, Engine, Pipeline, Scans, execute_scan, publish, published
from lodestone.sinks import documents


def test_publish_and_replay(spark, tmp_path):
    folder = f"file://{tmp_path}"
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    first = publish(spark, folder, "s1", {"a": a, "b": a.limit(0)}, current="main")
    assert first.outcome == "published" and first.tables["a"][0] == 2
    assert publish(spark, folder, "s1", {"b": a.limit(0), "a": a.orderBy(F.desc("k"))}, current="main").outcome == "replayed"
    with pytest.raises(Conflict):
        publish(spark, folder, "s1", {"a": a.union(a), "b": a.limit(0)})
    assert published(spark, folder, current="main")["a"].count() == 2 and published(spark, folder, "s2") is None
    publish(spark, folder, "s2", {"a": a.limit(1)}, current="main")
    assert published(spark, folder, current="main")["a"].count() == 1 and published(spark, folder, "s1")["a"].count() == 2


class Crash(Exception):
    pass


def test_a_crash_between_any_two_steps_leaves_a_readable_state(spark, tmp_path, monkeypatch):
    one, two = spark.range(3).select(F.col("id").alias("k")), spark.range(5).select(F.col("id").alias("k"))
    steps = ["_write", "create", "append", "point"]
    whole = {name: getattr(publication._Folder, name) for name in steps}
    done = False
    for crash in range(40):
        folder, count = f"file://{tmp_path}/{crash}", [0]
        publish(spark, folder, "s1", {"t": one}, current="main")

        def step(name, count=count, crash=crash):
            def run(self, *args):
                for after in (False, True):  # before the step and after it
                    if after:
                        out = whole[name](self, *args)
                    count[0] += 1
                    if count[0] > crash:
                        raise Crash
                return out

            return run

        with monkeypatch.context() as m:
            for name in steps:
                m.setattr(publication._Folder, name, step(name))
            try:
                publish(spark, folder, "s2", {"t": two}, current="main")
                done = True
            except Crash:
                pass
        assert published(spark, folder, current="main")["t"].count() in (3, 5) and published(spark, folder, "s1")["t"].count() == 3
        assert publish(spark, folder, "s2", {"t": two}, current="main").outcome in ("published", "replayed") and published(spark, folder, current="main")["t"].count() == 5
        if done:
            break
    assert done and crash > 5


def test_one_of_many_creates(spark, tmp_path):
    at = publication._Folder(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: at.create("a/b.json", f"text {k}"), range(24)))
        versions = list(pool.map(lambda k: at.append("log", f"v{k}", 0), range(24)))
        list(pool.map(lambda k: at.point("many", f"p{k}"), range(12)))
    assert sum(won) == 1 and at.read("a/b.json") == f"text {won.index(True)}" and sum(versions) == 1
    assert at.latest("log") == (1, f"v{versions.index(True)}") and at.latest("many")[0] == 12 and at.latest("none") == (0, None)


def test_scans(spark, tmp_path):
    folder = f"file://{tmp_path}"
    scans, rows = Scans(spark, folder), spark.range(3)
    assert scans.begin("x", {"r": 1}) == "created" and scans.begin("x", {"r": 1}) == "replayed"
    for call in (lambda: scans.begin("x", {"r": 2}), lambda: scans.begin("y", {}, active=False), lambda: scans.end("never", "failed")):
        with pytest.raises(Conflict):
            call()
    assert scans.end("x", "canceled") == "changed" and scans.end("x", "canceled") == "replayed"
    with pytest.raises(Conflict):
        scans.end("x", "succeeded")
    with pytest.raises(Conflict):
        execute_scan(spark, folder, "x", {"r": 1}, lambda: {"t": rows})
    assert execute_scan(spark, folder, "z", {}, lambda: {"t": rows}).outcome == "published"
    assert execute_scan(spark, folder, "z", {}, lambda: pytest.fail("is there")).outcome == "reconciled"
    with pytest.raises(ZeroDivisionError):
        execute_scan(spark, folder, "bad", {}, lambda: {"t": 1 / 0})
    assert scans.state("bad")["state"] == "failed" and scans.state("bad")["detail"] == "ZeroDivisionError"
    publication.append_audit(publication.audit_rows(rows, "a", F.lit("me"), F.col("id"), F.lit("2020-01-01")), folder)
    assert spark.read.parquet(f"{folder}/audit").count() == 3


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([(2, "<b>"), (1, "é")], "k long, v string")
    sections = [documents.Section("artifact", spark.createDataFrame([("n", 1)], "name string, version int"), single=True), documents.Section("rows", rows, ("k",)), documents.Section("none", rows.limit(0))]
    out = bytearray()
    receipt = documents.encode(sections, out.extend, 1000)
    want = '{"artifact":{"name":"n","version":1},"rows":[{"k":1,"v":"é"},{"k":2,"v":"\\u003cb\\u003e"}],"none":[]}\n'.encode()
    assert bytes(out) == want and receipt == documents.Receipt(len(want), hashlib.sha256(want).hexdigest())
    written = bytearray()
    with pytest.raises(documents.TooLarge):
        documents.encode(sections, written.extend, len(want) - 1)
    assert len(written) < len(want)
    path = f"file://{tmp_path}/d.json"
    (tmp_path / "d.json").write_text("old")
    for bad, error in (([*sections, sections[0]], ValueError), ([documents.Section("x", rows, single=True)], ValueError), ([documents.Section("x", rows.limit(0), single=True)], ValueError)):
        with pytest.raises(error):
            documents.publish_document(bad, path, 1000)
    with pytest.raises(documents.TooLarge):
        documents.publish_document(sections, path, len(want) - 1)
    many = documents.Section("many", spark.range(5000).repartition(7).selectExpr("id", "'é,' || id AS v"), ("id",))
    whole = bytearray()
    assert documents.encode([many, *sections], whole.extend, 1 << 20) == documents.publish_document([many, *sections], f"{path}.many", 1 << 20) and (tmp_path / "d.json.many").read_bytes() == bytes(whole)
    assert (tmp_path / "d.json").read_text() == "old"
    assert documents.publish_document(sections, path, 1000) == receipt and (tmp_path / "d.json").read_bytes() == want
    with pytest.raises(documents.TooLarge):
        documents.publish_document(sections, path, 20)
    assert (tmp_path / "d.json").read_bytes() == want
    assert documents.report(rows.limit(1)) == '{"k":2,"v":"<b>"}' and json.loads(documents.report(rows.limit(1), pretty=True)) == {"k": 2, "v": "<b>"}


def test_bound_pages(spark):
    rows = spark.createDataFrame([(f"k{n:02}",) for n in range(11)], "key string")
    page = lambda cursor, root="r": limits.bound_pages(rows, "key", 4, "digest", "g", "out", root, cursor)
    assert [r.key for r in limits.drained(page, 100)] == [f"k{n:02}" for n in range(11)]
    with pytest.raises(ValueError):
        page(page(None)[1], "other")
    with pytest.raises(ValueError):
        list(limits.drained(page, 10))
    got, following = limits.offset_page(rows, [F.col("key")], 5, 5)
    assert got.count() == 5 and following == 10 and limits.offset_page(rows, [F.col("key")], 5, 10)[1] is None


def test_composition(spark):
    one = Engine("one", (), (("a", "1", ("k",)),), lambda s: {"a": spark.createDataFrame([(1,)], "k long")})
    two = Engine("two", (("a", "1"),), (("b", "2", ("k",)),), lambda s: {"b": s.get("a", "1")})
    store = ArtifactStore()
    assert Pipeline([one, two]).execute(store) == [("b", "2", "a", "1")] and store.names() == [("a", "1"), ("b", "2")]
    with pytest.raises(Conflict):
        Pipeline([one, two]).execute(store)
    for wrong in (lambda: Pipeline([one, one]), lambda: store.get("a", "9"), lambda: store.put("a", "1", None), lambda: publication.capabilities(spark, [("x", True, ""), ("x", False, "")])):
        with pytest.raises(Conflict):
            wrong()
    with pytest.raises(KeyError):
        Pipeline([Engine("three", (("z", "1"),), (), lambda s: {})]).execute(store)
    store.reset()
    assert store.names() == []


def test_validity(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad\x01"), (3, None)], "k long, v string")
    rules = {"text": validity.safe_text(F.col("v")), "key": F.col("k") > 0}
    with pytest.raises(validity.Invalid) as e:
        validity.require(rows, rules)
    assert e.value.found == [("text", 2)] and validity.require(rows.filter("k = 1"), rules).count() == 1
    assert validity.variants("C:\\a") == ["C:/a", "C:\\\\a", "C:\\a"]
    chunks = spark.createDataFrame([("d", 0, "abcdse"), ("d", 1, "cretxx"), ("e", 0, "secr")], "doc string, at int, t string")
    assert [tuple(r) for r in validity.leaks(chunks, "doc", "at", "t", ["secret", "no"]).collect()] == [("d", "secret")]

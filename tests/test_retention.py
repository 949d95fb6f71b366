"""Kept tables, leases and purges: nothing is taken twice, children go first, crashes leave tables whole."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retention
from lodestone.operators.publication import Conflict, _Folder
from lodestone.operators.retention import Kept, Lease, collect_garbage, purge


@pytest.fixture
def tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    scans, facts = Kept(spark, folder, "scans", "scan", 8), Kept(spark, folder, "facts", "of", 8)
    scans.create(spark.range(40).select(F.col("id").alias("scan"), (F.col("id") % 4 != 0).alias("old"), (100 - F.col("id")).alias("begun")))
    facts.create(spark.range(200).select((F.col("id") % 40).alias("of"), F.col("id").alias("fact")))
    return scans, facts


def ids(table):
    return sorted(r[0] for r in table.rows().select(table.key).collect())


def test_purge_in_batches(spark, tables):
    scans, facts = tables
    args = (scans, [F.col("begun")], F.col("old"), 12, [facts], "me")
    due = sorted((k for k in range(40) if k % 4), key=lambda k: 100 - k)
    first, rest = purge(*args), [purge(*args), purge(*args), purge(*args)]
    assert first.rows == {"facts": 60, "scans": 12} and not first.complete
    assert [x.rows.get("scans") for x in rest] == [12, 6, 0] and [x.complete for x in rest] == [False, True, True]
    assert ids(scans) == [k for k in range(40) if k % 4 == 0] and set(ids(facts)) == set(ids(scans)) and due
    assert scans.clear() > 0 and len(ids(scans)) == 10
    with pytest.raises(Conflict):
        scans.create(spark.range(1).withColumnRenamed("id", "scan"))
    with pytest.raises(Conflict):
        Kept(spark, scans.folder, "none", "k").rows()


def test_two_deletions_at_once_lose_nothing(spark, tables, monkeypatch):
    scans, _ = tables
    whole, other = Kept._write, []

    def late(self, rows):
        made = whole(self, rows)
        if not other:  # someone else deletes between this one's reading and its version
            other.append(1)
            assert scans.delete(spark.range(20, 25).withColumnRenamed("id", "scan")) == 5
        return made

    monkeypatch.setattr(Kept, "_write", late)
    assert scans.delete(spark.range(18, 22).withColumnRenamed("id", "scan")) == 2
    assert ids(scans) == [k for k in range(40) if not 18 <= k < 25]


def test_a_crash_leaves_children_gone_and_parents_there(spark, tables, monkeypatch):
    scans, facts = tables
    whole = Kept.delete

    def crash(self, keys):
        if self.name == "scans":
            raise RuntimeError
        return whole(self, keys)

    args = (scans, [F.col("begun")], F.col("old"), 5, [facts], "me")
    with monkeypatch.context() as m:
        m.setattr(Kept, "delete", crash)
        with pytest.raises(RuntimeError):
            purge(*args)
    assert len(ids(scans)) == 40 and len(ids(facts)) == 175
    assert purge(*args).rows == {"facts": 0, "scans": 5} and len(ids(scans)) == 35


def test_leases(spark, tmp_path, tables, monkeypatch):
    now = [0.0]
    lease = lambda: Lease(spark, f"file://{tmp_path}", "x", lambda: now[0])
    a, b = lease(), lease()
    assert a.take("a", 10) and not b.take("b", 10) and a.holds("a") and not b.holds("b")
    now[0] = 11
    assert not a.holds("a") and b.take("b", 10) and not a.take("a", 10) and b.holds("b")
    a.release("a")
    assert b.holds("b") and b.take("b", 10) and b.holds("b")
    b.release("b")
    assert a.take("a", 10) and a.holds("a")
    scans, facts = tables
    assert Lease(spark, scans.folder, "purge-scans").take("other", 1000)
    args = (scans, [F.col("begun")], F.col("old"), 5, [facts])
    assert purge(*args, "me") is None and purge(*args, "other").rows["scans"] == 5
    monkeypatch.setattr(Lease, "holds", lambda self, owner: False)
    assert purge(*args, "me") == retention.Purged({}, False) and len(ids(scans)) == 35


def test_garbage(spark, tables):
    scans, facts = tables
    facts.delete(spark.range(10, 20).withColumnRenamed("id", "of"))
    args = (scans, [facts.rows().withColumnRenamed("of", "scan")], F.col("begun"), F.col("begun") <= 88, 5)
    assert collect_garbage(*args, "me") == (5, 88 + 87 + 86 + 85 + 84) and collect_garbage(*args, "me") == (3, 83 + 82 + 81) and collect_garbage(*args, "me") == (0, 0)
    assert ids(scans) == [k for k in range(40) if not 12 <= k < 20]
    assert _Folder(spark, scans.folder).names("leases") == ["garbage-scans"]

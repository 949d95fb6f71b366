"""Identities against the published vectors; paths."""

import hashlib
import time

from pyspark.sql import functions as F

from lodestone.functions import identity, paths


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_published_vectors(spark):
    path = paths.normalized(F.lit("src\\pkg"))
    node = identity.node_id(F.lit("package"), F.lit("Go"), F.lit("example.com/π/pkg"), path, F.lit("resolved_local"))
    edge = identity.edge_id(F.lit("package"), F.lit("imports"), node, F.lit("dependency-node-id/v1:sha256:target"), F.lit("resolved_local"))
    inside = identity.containment_id(F.lit("module_contains_package"), F.lit("dependency-node-id/v1:sha256:parent"), F.lit("dependency-node-id/v1:sha256:child"))
    scc = identity.stable_id_of_members(identity.SCC, F.lit("package"), F.array(F.lit("β"), F.lit("a")))
    cycle = identity.stable_id(identity.CYCLE, F.lit("package"), scc)
    assert [x.rsplit(":", 1)[1] for x in one(spark, node, edge, inside, scc, cycle)] == [
        "16c0f7392130f9bad33f66087e9c0b46c1f2823ba8cf7ea491187b35494c8a64",
        "bf8b464f5cbb5551b28068da1445e8e45359e2586f860ede189d9ac68b4c8ad1",
        "3b47d635724cdb8ab06ff0319c2ded1e67d1289fc6a92df92a02a0c29f0c4334",
        "360e477842ffa8936cb211fa0ef8e621043e3f06105f680537a5d478d7f0a2f8",
        "455fdfe1396a0c675860713ff4be826465b6eb83982e3bd7ecce66734c42eb8c",
    ]


def test_uuid_has_version_and_variant(spark):
    (value,) = one(spark, identity.uuid_v8(identity.compact_identity(F.lit("a"), F.lit("b"))))
    assert len(value) == 36 and value[14] == "8" and value[19] in "89ab"


def test_length_tags_tell_parts_apart(spark):
    a, b = one(spark, identity.length_tagged(F.lit("ab"), F.lit("c")), identity.length_tagged(F.lit("a"), F.lit("bc")))
    assert a != b and a == "2:ab|1:c"


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/.Go",), (".gitignore",), ("x",), ("a/../b//c.TXT",), ("../x",), ("/abs",), ("c:/x",), ("a/..",)], "p string")
    p = F.col("p")
    got = {r[0]: tuple(r)[1:] for r in rows.select(p, paths.extension(p), paths.base_name(p), paths.directory(p), paths.normalized(p), paths.has_hidden_segment(p)).collect()}
    assert got["a/b/.Go"] == (".go", ".Go", "a/b", "a/b/.Go", True)
    assert got[".gitignore"][:3] == (".gitignore", ".gitignore", ".")
    assert got["a/../b//c.TXT"][3] == "b/c.TXT"
    assert got["a/.."][3] == "."
    assert [got[k][3] for k in ("../x", "/abs", "c:/x")] == [None] * 3


def test_slug_keeps_one_dash_a_character(spark):
    assert one(spark, paths.slug(F.lit("--A  b_c!"))) == ("a--b-c",)


def test_ids_of_many_members_take_linear_time(spark):
    """300,000 members: copied for each member, their text would be some 600 GB."""
    names = sorted(str(k) for k in range(300_000))
    part = lambda x: len(x).to_bytes(8, "big") + x
    body = b"".join(part(x.encode()) for x in (identity.SCC, "g", *names))
    began = time.time()
    row = spark.range(300_000).agg(F.collect_list(F.col("id").cast("string")).alias("m")).select(identity.stable_id_of_members(identity.SCC, F.lit("g"), F.col("m")).alias("x")).first()
    assert row.x == f"{identity.SCC}:sha256:{hashlib.sha256(body).hexdigest()}" and time.time() - began < 60

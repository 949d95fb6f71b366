"""Canonical JSON and cursors."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import encoding


def test_canonical_json(spark):
    row = spark.range(1).select(encoding.canonical_json(F.struct(F.lit("a<b>&é").alias("x"), F.lit(None).cast("string").alias("y"), F.lit(1).alias("z"))), encoding.base64url(F.lit(b"\xfb\xff\xfe"))).first()
    assert tuple(row) == ('{"x":"a\\u003cb\\u003e\\u0026é","z":1}', "-__-")


def test_cursor_is_bound_to_its_query():
    cursor = encoding.page_cursor("d", "package", "out", "root", 10, "né")
    assert encoding.cursor_last(cursor, "d", "package", "out", "root", 10) == "né"
    for wrong in ("d2", "d"):
        with pytest.raises(ValueError):
            encoding.cursor_last(cursor if wrong == "d2" else cursor[:-2], wrong, "package", "out", "root", 10)

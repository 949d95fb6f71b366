"""Null ids beside the greatest id, which stand apart in every operator."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm._common import ordered_ids
from lodestone.llm.decontamination import op1_decontamination
from lodestone.llm.line_dedup import deduplicate_lines
from lodestone.llm.repeats import remove_repeats
from lodestone.llm.simhash import drop_near_duplicates, near_duplicates

MOST = (1 << 63) - 1
LINE = "a line of some length that two documents hold, long enough for a window"


def test_null_and_greatest_ids(spark, docs_of, tmp_path):
    docs = docs_of([(MOST, LINE), (None, LINE), (None, LINE), (3, "other words"), (-5, "x")])
    lines = sorted((repr(r.doc_id), r.n_dropped) for r in deduplicate_lines(docs).collect())
    assert lines == sorted([(repr(MOST), 0), ("None", 1), ("None", 1), ("3", 0), ("-5", 0)])
    lost = sorted((repr(r.doc_id), r.n_removed) for r in remove_repeats(docs).collect())
    assert lost == sorted([(repr(MOST), 0), ("None", len(LINE)), ("None", len(LINE)), ("3", 0), ("-5", 0)])
    found = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == {(MOST, MOST), (None, MOST), (3, 3), (-5, -5)}
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [-5, 3, MOST]
    alone = docs.filter("doc_id IS NULL OR doc_id = 3")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(alone).collect()} == {(None, None), (3, 3)}
    assert sorted(repr(r.doc_id) for r in drop_near_duplicates(alone).collect()) == ["3", "None"]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, LINE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    hit = sorted((repr(r.doc_id), r.contaminated) for r in op1_decontamination(spark, str(tmp_path)).collect())
    assert hit == sorted([(repr(MOST), True), ("None", True), ("None", True), ("3", False), ("-5", False)])


def test_ids_that_leave_no_room(spark):
    every = spark.createDataFrame([(MOST,), (-MOST - 1,), (None,)], "i long")
    with pytest.raises(ValueError):
        ordered_ids(every, "i")
    ids, less = ordered_ids(every.filter(F.col("i") >= 0), "i")
    assert less == 1 and every.filter(F.col("i") >= 0).select(ids).first()[0] == MOST - 1

"""The query over whole tables, with all outcomes."""

from lodestone.plans import bindings


def test_reconcile_of_all_ids(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(7)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k,) for k in range(2, 10) if k != 3], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.outcome for r in bindings.QUERIES["reconcile"](spark, str(tmp_path)).collect()}
    assert got == {0: "left_only", 1: "left_only", 2: "matched", 3: "left_only", 4: "matched", 5: "matched", 6: "matched", 7: "right_only", 8: "right_only", 9: "right_only"}

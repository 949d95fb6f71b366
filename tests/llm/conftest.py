"""Fixtures that hold the awkward rows every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, items string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang), with columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "own", "own", "own") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    """The smallest documents table, as a DataFrame and as a list of (id, text)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

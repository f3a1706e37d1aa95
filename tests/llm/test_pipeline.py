"""The pipeline's stages and the registered queries."""

import corpus_pipeline
import __spark_entry__ as entry
from check import compare, connect
from conftest import SMALL


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), "stage")
        assert docs.columns == names
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


def test_search_and_substrings_against_sql(spark):
    con = connect(SMALL)
    for name in ("op1_search", "op2_substrings", "op12_negatives", "op13_divergence"):
        assert compare(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) == ""

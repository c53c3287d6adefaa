"""The registered queries, and the pipeline stage by stage."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry
import corpus_pipeline
from check import connect, differences

SF_DIR = os.environ.get("LEAFSCAN_TEST_DIR", "/root/testdata/sf0.001")
NAMES = ["op1_token_output", "op2_license_scan", "op3_language_id", "op4_exact_dedup", "op5_secret_scan", "op6_pii_surrogates", "op7_quality", "op8_decontaminate",
         "op9_mixing", "op10_jaccard_join", "op11_byte_bpe", "op12_spelling_variants", "op13_fill_middle"]
BY_DOCUMENT = [n for n in NAMES if n not in entry.oracle_sql()]


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert differences(got, connect(SF_DIR).sql(entry.oracle_sql()[name]).df()) == []


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_query_covers_every_document(spark, name):
    got = entry.queries()[name](spark, SF_DIR).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR).persist()
        assert out.columns == columns, name
        kept = {r[0] for r in out.select("doc_id").collect()}
        if name == "decontaminate":
            dirty = entry.queries()["op8_decontaminate"](spark, SF_DIR).filter("contaminated")
            assert kept == ids - {r[0] for r in dirty.collect()}
        if name == "jaccard_join":
            firsts = {r[0] for r in entry.queries()["op10_jaccard_join"](spark, SF_DIR).filter("doc_id = component_id").collect()}
            assert kept == firsts & ids
        if name == "mixing":
            assert kept == ids and out.groupBy("doc_id").count().filter("count > 2").count() == 0
        docs, ids = out, kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, long texts, clashing names; and no rows at all."""
    long_text = " ".join(f"word{i % 977} and then" for i in range(9_000))
    rows = [(i, f"the green house number {i} stands near the water and the old bridge of town {i}", "en", "a") for i in range(40)]
    rows += [(100 + i, f"das grüne haus nummer {i} steht am wasser und an der alten brücke {i}", "de", "b") for i in range(40)]
    rows += [(200, None, None, None), (None, "the green house by the water", None, "a"), (201, "", "en", None), (202, "12 !!", "de", "b"), (203, long_text, "en", "a")]
    rows += [(204, "the same text twice in the house by the water", "en", "a")] * 2
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([("i1", "no such passage as this one here at all in any of the texts"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema).selectExpr("*", "length(text) n_chars", "1 key", "2 label", "3 row", "4 score", "5 tokens", "6 src")
        columns, ids = docs.columns, {r[0] for r in own}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path)).persist()
            kept = out.select("doc_id").collect()
            assert out.columns == columns and {r[0] for r in kept} <= ids, name
            if own:
                assert {0, 39, 100, 139, 203, 204} <= {r[0] for r in kept} or name != "language_id"
                assert sum(r[0] == 204 for r in kept) == (2 if name == "language_id" else 1) or name == "mixing"
            else:
                assert not kept
            docs, ids = out, {r[0] for r in kept}
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()

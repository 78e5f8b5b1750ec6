"""Every stage of the pipeline against its own brute force, on its own input."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frostline.llm import importance, mixing, quality_rules
from frostline.llm.common import materialize
from test_jaccard import brute
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (input rows, output rows)"""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        got = materialize(f(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.schema.names == docs.schema.names
        out[name] = (docs, got)
        docs = got
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]


def test_classifier_stage(spark, stages):
    docs, kept = stages["quality_classifier"]
    marked = importance.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept) == ids(marked.filter("kept"))
    rows = marked.collect()
    k = sum(r.kept for r in rows)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in sorted(rows, key=lambda r: (-r.key, r.doc_id))[:k]}


def test_rules_stage(stages):
    docs, kept = stages["quality_rules"]
    assert ids(kept) == Counter(r.doc_id for r in docs.collect() if quality_rules.judge_text(r.text)[-1])


def test_join_stage(stages):
    docs, kept = stages["ngram_jaccard_join"]
    assert ids(kept) == Counter({c for _, _, c, _ in brute([(r.doc_id, r.text) for r in docs.collect()])})


def test_mix_stage(stages):
    docs, mixed = stages["mix_sources"]
    assert ids(mixed) == Counter({r.doc_id: r.epochs for r in mixing.mix(docs).collect() if r.epochs})


def test_packing_stage(stages):
    docs, packed = stages["best_fit_packing"]
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_run(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = Counter(map(tuple, stages["best_fit_packing"][1].select(cols).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select(cols).collect())) == want


def test_nothing_in(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0


def test_queries_read_the_whole_table(spark):
    from frostline.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("op5_quality_rules", "op6_jaccard_join", "op8_token_counts", "op9_mix_sources"):
        assert ids(QUERIES[name](spark, SF)) == ids(docs)
    pages = QUERIES["op1_url_filter"](spark, SF)
    assert pages.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert pages.filter(F.col("verdict").isin("allow", "block")).count() == pages.count()

"""A corpus pipeline of training-data operators: raw documents in, packed
training sequences out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on (the last one: packed pieces).  Each result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frostline.llm import importance, jaccard, mixing, packing, quality_rules
from frostline.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels"))


def line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", line_rules),
          ("ngram_jaccard_join", ngram_jaccard_join), ("mix_sources", mix), ("best_fit_packing", pack)]

# sampling by hash, tokenizer ids and best-fit are beyond SQL; tests/llm/test_pipeline.py checks every stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

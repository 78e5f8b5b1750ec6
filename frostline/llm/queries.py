"""Registered queries of the training-data operators: each applies its operator
to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.llm import (
    ann, chat, codes, importance, jaccard, licenses, mixing, packing, quality_rules, token_count, token_files, url_filter,
    whitening,
)
from frostline.llm.common import materialize, table
from frostline.session import scratch_path


def op1_url_filter(spark, sf_dir):
    return url_filter.apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the extra conversation of the contract: texts that look like control strings
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = materialize(chat.format_conversations(rows.unionByName(probe)), "chat-turns")
    path = scratch_path(spark, "chat-examples")
    examples = chat.expand(formatted)
    # a context begins as the one before it does: zstd's window sees that
    examples.write.option("compression", "zstd").parquet(path)
    return chat.example_digests(spark.read.schema(examples.schema).parquet(path))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_quality_classifier(spark, sf_dir):
    return importance.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.digests(token_files.read_documents(spark, folder))


def op11_embedding_whitening(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), scale=256.0, components=4)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_vector_codes(spark, sf_dir):
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024.0)
    return codes.with_label_errors(coded).select(
        "vec_id", "code", F.col("error").cast("long"), F.col("label_error").cast("long"),
        F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def op13_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_license_scan": op13_license_scan,
}

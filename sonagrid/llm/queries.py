"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.llm import align, bpe, chat, decontaminate, html_text, licenses, media, merkle, near, pii, quality, token_ids, toxicity
from sonagrid.llm.store import Scratch

#: Vocabulary files; their place is a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE_A = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), thorough=True)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        folder = f"{scratch.path}/ids"
        token_ids.write(_table(spark, sf_dir, "documents"), folder, WORD_BPE)
        return token_ids.read(spark, folder).checkpoint()


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(spark, _table(spark, sf_dir, "documents"))


def op12_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tables:
        found = align.align(tables, _table(spark, sf_dir, "documents"), BYTE_BPE_A, PIECE_BPE)
        return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups").checkpoint()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_licenses, op3_token_ids, op4_byte_bpe, op5_html_text, op6_quality, op7_chat, op8_toxicity, op9_media, op10_ngram_jaccard, op11_merkle, op12_private, op13_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.oracle(), "op7_chat": chat.oracle(), "op11_merkle": merkle.oracle()}

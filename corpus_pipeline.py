"""A corpus pipeline of five stages; each stage's rows are written and reread as the
next one's documents. It belongs to the training-data operators in ``sonagrid.llm``.

In every stage: a decision is made for each row, from its text alone but for the near
duplicates, so that rows without an id or of one id are judged apart; an empty table stays
empty; columns beyond those of documents are dropped, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.llm import bpe, decontaminate, near, quality, toxicity
from sonagrid.llm.store import Scratch
from sonagrid.session import share_code

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier accepts. A null or empty text has the score of
    the mean difference; repeated rows are all kept or all dropped."""
    model = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep(docs.select(*COLUMNS), model)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the subword model does not call toxic. A null or empty text is not toxic;
    repeated rows are all kept or all dropped."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.keep(docs.select(*COLUMNS), model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (null ids come
    last), then the smallest text hash. Of repeated rows one stays. A text without words is
    like no other: one row of each id stays, and every row without an id."""
    return near.keep_one(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage. Texts are named by their hash, since ids
    may be null or repeated. A null or empty text holds none; repeated rows are all kept or
    all dropped."""
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    found = decontaminate.leaks(named, _table(spark, sf_dir, "benchmark"), key="_text", thorough=True).select(F.col("doc_id").alias("_text")).distinct()
    return named.join(found, "_text", "left_anti").drop("_text")  # the hash of a null text is a number


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every row, and digest of the decoded bytes. A
    null or empty text has no ids; repeated rows and null ids stay."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE encoding and decoding", encoded),
]

#: The stages train models, join by similarity and encode, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the table of documents."""
    share_code(spark)
    tables = Scratch(spark)  # not closed: the last table is the result
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.table(stage(spark, docs, sf_dir), str(k))
        if k:
            tables.drop(str(k - 1))
    return docs

"""A training-data pipeline over documents: language ID, line dedup, near-dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the docs of the
next. All but the last return the columns of documents, with n_chars that of the text as it is then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import encode_documents
from tessera.llm.common import checkpoint_folder
from tessera.llm.language_id import fit_languages, identify_languages
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix_sources
from tessera.llm.simhash import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject; a missing lang becomes the predicted one. Null texts and such without a letter are rejected;
    repeated rows share one fate; an empty table stays empty."""
    named = identify_languages(docs, fit_languages(docs)).filter(~F.col("rejected"))
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; a document of which no line stays goes. Null and empty texts stay as
    they are; rows equal in id and text are one document and stay as many as they are; an empty table stays empty."""
    cut = dedup_lines(docs)
    left = cut.filter((F.col("removed_lines") == 0) | (F.trim(F.col("text"), F.lit(" \n\t\r")) != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts alike in 0.8 or more of their five-word shingles: that of the least id, nulls last, and one of
    repeated rows. Null and empty texts are one class; an empty table stays empty."""
    return near_dedup(docs).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as come in, in expectation, of all sources alike; null is a source of its own. Repeated rows are repeated alike; an empty
    table stays empty."""
    return mix_sources(docs).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number and digest, and the digest of the decoded bytes, for every row that comes in. A null text counts as
    empty, which has no ids; an empty table stays empty."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(docs.select("doc_id", "text"), vocabulary=vocabulary, pattern=public_tokenizers.PATTERN, drop_text=True, digests=True)
    return encoded.withColumnRenamed("ids", "token_ids")


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage), ("source_mix", mix_stage), ("byte_bpe", token_stage)]
#: Language ID and near-dedup have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder and reread."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

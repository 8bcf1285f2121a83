"""Reading and writing corpora, golden sets, logs and query results."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rules import WRITE_WORDS
from tessera.functions.text import text_hash

GOLDEN = "question string, expected_answer string, relevant_chunk_texts array<string>, should_refuse boolean, metadata map<string,string>"
LOG = "ts timestamp, level string, logger string, message string, tenant string, fields map<string,string>, exception string"
_WRITES = re.compile(rf"\b({'|'.join(WRITE_WORDS)})\b", re.IGNORECASE)


#: Bytes of a text that is still packed (a string of the JVM holds 2 GB at most), of a packed file, and of a row group, which is what one task reads at least.
MOST_BYTES, PACKED_FILE, PACKED_GROUP = 1 << 30, 512 << 20, 32 << 20


def load_corpus(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id, source, text, content_hash): a document per file, named by it; an empty file is none."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return _corpus(files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")))


def load_packed(spark: SparkSession, path: str) -> DataFrame:
    """The same of a packed corpus; a file of it is read in as many splits as it has row groups."""
    return _corpus(spark.read.schema("source string, text string").parquet(path))


def _corpus(named: DataFrame) -> DataFrame:
    hashed = named.select("source", "text", text_hash(F.col("text")).alias("content_hash"))
    return hashed.select(F.substring("content_hash", 1, 16).alias("doc_id"), "source", "text", "content_hash")


def pack_corpus(docs: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Writes documents (source, text) as a packed corpus: many to a file, in row groups whose offsets each file's footer holds. Null texts are left out. Fails at a
    text of more than most_bytes, naming its source, before anything of its task is committed."""
    size = F.octet_length("text")
    message = F.concat(F.lit("too large to pack: "), F.coalesce(F.col("source").cast("string"), F.lit("no source")), F.lit(f", over {most_bytes} bytes: "), size.cast("string"))
    checked = F.when(F.assert_true(size <= most_bytes, message).isNull(), F.col("text"))
    docs.filter("text is not null").select(F.col("source").cast("string").alias("source"), checked.alias("text")).write\
        .option("parquet.block.size", PACKED_GROUP).option("parquet.page.size.row.check.min", 1).parquet(path)  # sizes are looked at from the first text on


def pack_folder(spark: SparkSession, path: str, to: str, pattern: str = "*.md", most_bytes: int = MOST_BYTES) -> None:
    """Packs a folder of files, one document each, without a shuffle: a task reads the files of one or more splits and writes them as one. Files of more than
    most_bytes are refused by their listed size, before any is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    total = listed.agg(F.sum("length").alias("bytes"), F.max_by("path", "length").alias("path"), F.max("length").alias("most")).first()
    if (total["most"] or 0) > most_bytes:
        raise ValueError(f"too large to pack: {total['path']}, over {most_bytes} bytes: {total['most']}")
    files = max(spark.sparkContext.defaultParallelism, math.ceil((total["bytes"] or 0) / PACKED_FILE))
    pack_corpus(load_corpus(spark, path, pattern).coalesce(files), to, most_bytes)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden examples of JSON arrays or of one object per line; lists that lack are empty, flags false."""
    read = spark.read.schema(GOLDEN).json(path, multiLine=True)
    return read.withColumns({"relevant_chunk_texts": F.coalesce("relevant_chunk_texts", F.array().cast("array<string>")), "should_refuse": F.coalesce("should_refuse", F.lit(False)), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


def save_golden(golden: DataFrame, path: str) -> None:
    """Each partition as a file with an array of objects (a file is one JSON value), empty ones left out."""
    rows = golden.select(F.to_json(F.struct(*(c.split()[0] for c in GOLDEN.split(", ")))).alias("row")).withColumn("part", F.spark_partition_id())
    # a file is an array, so its rows come together; sets that people write are small
    arrays = rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def log_lines(logs: DataFrame) -> DataFrame:
    """(value): one JSON object per row of a log (see LOG), nulls left out."""
    return logs.select(F.to_json(F.struct(*(c.split()[0] for c in LOG.split(", ")))).alias("value"))


def write_log(logs: DataFrame, path: str) -> None:
    log_lines(logs).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def tenant_filter(store: DataFrame, tenant: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a tenant; a plain equality, which prunes partitions of a table written by tenant."""
    kept = store if tenant is None else store.filter(F.col("tenant") == tenant)
    return kept if where is None else kept.filter(where)


def readonly_sql(spark: SparkSession, query: str, limit: int = 50) -> DataFrame:
    """The first `limit` rows of one SELECT or WITH over registered tables; anything else is refused."""
    statement = query.strip().rstrip(";").strip()
    if ";" in statement:
        raise ValueError("one statement only")
    if not re.match(r"(select|with)\b", statement, re.IGNORECASE):
        raise ValueError("only SELECT is allowed")
    if _WRITES.search(statement):
        raise ValueError("writing is not allowed")
    return spark.sql(statement).limit(limit)

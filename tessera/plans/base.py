"""Tables that queries share, and the SQL of the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk_fixed

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries of a module and their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt to all cores if its files make fewer splits than there are cores: a small table only, as a large one has splits for all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fixed(documents(spark, sf_dir), 1200, 150)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("tenant"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the vector searches, which grows with the table: every id divisible by 50."""
    return vectors(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "tenant", "vector")


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k, the number in their properties."""
    return read(spark, sf_dir, "events").withColumn("k", k_of(F.col("props")))


MODELS = ("fake-1", "gpt-4o", "gpt-4o-mini", "o3-mini", "unheard-of")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, seq, tenant, model, input_tokens, output_tokens) from events."""
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("k") % len(MODELS) + 1).cast("int"))
    return events(spark, sf_dir).select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("tenant"), model.alias("model"), (F.col("k") * 10 + 5).alias("input_tokens"), (F.col("k") * 3).alias("output_tokens"))


CHUNKS_SQL = """
windows AS (SELECT doc_id, source, text, unnest(range(0, length(text), {step})) AS start FROM documents),
pieces AS (SELECT doc_id, source, start, substring(text, start + 1, {size}) AS raw FROM windows
  WHERE NOT (start > 0 AND start + {step} >= length(text) AND length(text) <= start - {step} + {size})),
stripped AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM pieces),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, raw) - 1 AS ordinal FROM stripped WHERE text <> ''),
chunks AS (SELECT substr(sha256(doc_id || ':' || ordinal || ':' || substring(text, 1, 64)), 1, 16) AS chunk_id, doc_id, source, ordinal, start,
  start + length(raw) AS "end", text, '' AS heading_path, 'fixed' AS chunker FROM numbered)
"""


def chunks_sql(size: int = 1200, overlap: int = 150) -> str:
    return CHUNKS_SQL.format(size=size, step=size - overlap).strip()


USAGE_SQL = f"""
u AS (SELECT ts, event_id AS seq, user_id AS tenant, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
usage AS (SELECT ts, seq, tenant, ({list(MODELS)!r})[k % {len(MODELS)} + 1] AS model, k * 10 + 5 AS input_tokens, k * 3 AS output_tokens FROM u)
""".strip()

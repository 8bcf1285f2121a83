"""Queries that run the streaming jobs over tables dealt into files, and read what they wrote."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk_fixed
from tessera.plans import service
from tessera.plans.base import Plans, chunks_sql, documents, events, read
from tessera.plans.conversations import leaky
from tessera.sources.scratch import fresh_path
from tessera.streaming import jobs

plans = Plans()
add = plans.add
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def as_stream(df: DataFrame, parts: int = 4, order: tuple[str, ...] = ()) -> DataFrame:
    """The table as a stream of files, which so many micro-batches read; order: the columns by which the files follow each other in time. A micro-batch
    has as many files as the table has splits (fewer, if rows are few), so what one task writes or reads doesn't grow with the table."""
    spark = df.sparkSession
    path, n = fresh_path(spark, "stream"), parts * df.rdd.getNumPartitions()
    (df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df.repartition(n)).write.parquet(path)
    each = -(-in_turn(spark, path) // parts)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max(1, each)).parquet(path)


def in_turn(spark: SparkSession, path: str) -> int:
    """Gives the files of a folder times in the order of their names: a stream reads the older ones first. How many there are."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    start = int(time.time() * 1000) - 1000 * (len(names) + 1)
    for i, name in enumerate(names):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), start + 1000 * i, -1)
    return len(names)


def finished(result: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, run through the job, and read back. In update mode rows have the number of the batch that wrote them."""
    spark = result.sparkSession
    out, notes = fresh_path(spark, "out"), fresh_path(spark, "notes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        if mode == "append":
            job = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", notes).outputMode("append")
        else:
            write = lambda part, i: part.withColumn("batch", F.lit(i)).write.mode("overwrite" if mode == "complete" else "append").parquet(out)
            job = result.writeStream.foreachBatch(write).option("checkpointLocation", notes).outputMode(mode)
        job.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    read_back = spark.read.parquet(out)
    return read_back.drop("batch") if mode == "complete" else read_back


def last_of(updates: DataFrame, *keys: str) -> DataFrame:
    """Of rows written in update mode, the last of each key."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), "batch").alias("r")).select("r.*").drop("batch")


def timed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


@add(
    """WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
walk AS (SELECT key, nth, seq, ts AS at, true AS allowed, 1.0::DOUBLE AS tokens FROM c WHERE nth = 1
  UNION ALL SELECT key, nth, seq, ts, held >= 1, CASE WHEN held >= 1 THEN held - 1 ELSE held END
  FROM (SELECT c.*, least(2.0::DOUBLE, w.tokens + epoch(c.ts - w.at) * (1.0::DOUBLE / 7200)) AS held FROM walk w JOIN c ON c.key = w.key AND c.nth = w.nth + 1))
SELECT key, seq, allowed, round(tokens, 3) AS remaining, CASE WHEN allowed THEN 0.0::DOUBLE ELSE round((1 - tokens) / (1.0::DOUBLE / 7200), 6) END AS retry_after FROM walk"""
)
def stream_rate_limit(spark, d):
    asked = timed(spark, d).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"))
    return finished(jobs.stream_rate_limit(as_stream(asked, order=("ts", "seq")), 2, 1 / 7200, "1 hour"))\
        .select("key", "seq", "allowed", F.round("remaining", 3).alias("remaining"), F.round("retry_after", 6).alias("retry_after"))


@add(f"SELECT CAST(tenant AS VARCHAR) AS tenant, seq, amount, admitted, spent FROM ({service.plans.sql['quota_admission']})")
def stream_quota(spark, d):
    calls = timed(spark, d).select(F.col("user_id").cast("string").alias("tenant"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("amount"))
    return finished(jobs.stream_quota(as_stream(calls, order=("ts", "seq")), 100.0, 86400.0, "1 hour")).select("tenant", "seq", "amount", "admitted", "spent")


@add(
    """WITH e AS (SELECT user_id AS conv_id, ts, event_id AS seq, event_type AS entry, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400 AS restarts FROM events),
r AS (SELECT *, sum(CAST(coalesce(restarts, false) AS INT)) OVER (PARTITION BY conv_id ORDER BY ts, seq) AS run FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, seq DESC) AS nth, max(run) OVER (PARTITION BY conv_id) AS last FROM r)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, count(*) AS size, string_agg(entry, ',' ORDER BY ts, seq) AS entries FROM n WHERE run = last AND nth <= 40 GROUP BY conv_id"""
)
def stream_history(spark, d):
    entries = timed(spark, d).select(F.col("user_id").cast("string").alias("conv_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("entry"))
    updates = finished(jobs.stream_history(as_stream(entries, order=("ts", "seq")), expire=False), "update")
    return last_of(updates, "conv_id").select("conv_id", "size", F.array_join("entries", ",").alias("entries"))


@add("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, user_id % 5 AS tenant, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS amount FROM events GROUP BY ALL")
def stream_metrics(spark, d):
    asked = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("tenant"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("amount"))
    out = last_of(finished(jobs.stream_metrics(as_stream(asked, order=("ts",))), "update"), "window_start", "tenant")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@add()
def stream_redact(spark, d):
    lines = leaky(spark, d).select("doc_id", F.col("text").alias("value"))
    return finished(jobs.stream_redact(as_stream(lines))).select("doc_id", F.md5("value").alias("safe_md5"))


@add(
    """WITH w AS (SELECT conv_id || '/' || turn AS stream_id, text, role FROM conversations)
SELECT stream_id, text, role <> 'user' AS done, role = 'system' AS failed, CAST(length(text) // 4 AS BIGINT) AS output_tokens FROM w"""
)
def stream_reassemble(spark, d):
    """Words of each message as deltas; what the user says has no end, and system messages fail."""
    said = read(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"), "role", "text")
    words = said.select("stream_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)\S*\s*"), F.lit(0))).alias("position", "delta"), F.lit("delta").alias("event"))
    ends = said.filter("role <> 'user'").select("stream_id", F.lit(-1).alias("position"), F.lit("").alias("delta"), F.lit("done").alias("event"))
    bad = said.filter("role = 'system'").select("stream_id", F.lit(-2).alias("position"), F.lit("").alias("delta"), F.lit("error").alias("event"))
    return finished(jobs.stream_reassemble(as_stream(words.unionByName(ends).unionByName(bad))), "complete")


@add(f"WITH {chunks_sql().replace('FROM documents', 'FROM newest')} SELECT chunk_id, doc_id, CAST(ordinal AS BIGINT) AS ordinal, start, \"end\" FROM chunks".replace("WITH ", "WITH newest AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'Changed. ' || text ELSE text END AS text FROM documents), ", 1))
def stream_ingest(spark, d):
    """Documents as a stream of two versions, the second of which changes every fifth; the chunks of the last one."""
    docs = documents(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), "doc_id", "text", F.lit(1).alias("ts"))
    changed = docs.filter("doc_id % 5 = 0").withColumns({"text": F.concat(F.lit("Changed. "), "text"), "ts": F.lit(2)})
    path, notes = fresh_path(spark, "ingested"), fresh_path(spark, "notes")
    both = as_stream(docs.unionByName(changed), 4, ("ts", "source"))
    jobs.stream_ingest(both, lambda x: chunk_fixed(x, 1200, 150), path, notes).awaitTermination()
    return jobs.ingested(spark, path)[0].select("chunk_id", "doc_id", "ordinal", "start", "end")

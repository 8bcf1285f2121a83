"""Keyed, time-driven computations as Structured Streaming jobs. Each function takes a streaming (or, where said, a batch) DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.rag import ingest
from tessera.operators.safety import log_redact

RATE = "key string, ts timestamp, seq long, allowed boolean, remaining double, retry_after double"
QUOTA = "tenant string, ts timestamp, seq long, amount double, admitted boolean, spent double"
HISTORY = "conv_id string, size long, entries array<string>"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a key in a micro-batch by time; what came late within it is put in place."""
    return pd.concat([*rows]).sort_values(["ts", "seq"], kind="stable")


class Expiring(StatefulProcessor):
    """State of a key that ends at a time from which on it says no more than no state would. Timers go by the rows' time, behind the watermark; without
    one (expire False) state stays."""

    expire = False

    def keep_until(self, micros: float) -> None:
        if self.expire:
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(micros // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class TokenBucket(Expiring):
    """A bucket starts full, refills with time (never backwards) up to its capacity, and gives one token to a request if it holds one. Its state ends when it is full."""

    def __init__(self, capacity: float, per_second: float, expire: bool):
        self.capacity, self.per_second, self.expire = capacity, per_second, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("bucket", "tokens double, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, at = self.state.get() if self.state.exists() else (self.capacity, None)
        out = []
        for r in _ordered(rows).itertuples():
            now = r.ts.value // 1000  # whole microseconds: no digit is lost in differences
            at = now if at is None else at
            tokens = min(self.capacity, tokens + max(0, now - at) / 1e6 * self.per_second)
            at = max(at, now)
            allowed = tokens >= 1
            tokens -= allowed
            out.append((key[0], r.ts, r.seq, bool(allowed), float(tokens), 0.0 if allowed else (1 - tokens) / self.per_second))
        self.state.update((float(tokens), int(at)))
        self.keep_until(at + (self.capacity - tokens) / self.per_second * 1e6)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RATE.split(", ")])


class PeriodQuota(Expiring):
    """A period restarts at the first use after it ran out; a call is admitted if it fits, and only admitted calls spend. Its state ends when it runs out."""

    def __init__(self, limit: float, seconds: float, expire: bool):
        self.limit, self.micros, self.expire = limit, round(seconds * 1e6), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("period", "spent double, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spent, since = self.state.get() if self.state.exists() else (0.0, None)
        out = []
        for r in _ordered(rows).itertuples():
            now = r.ts.value // 1000
            if since is None or now - since >= self.micros:
                spent, since = 0.0, now
            fits = spent + r.amount <= self.limit
            spent += r.amount if fits else 0.0
            out.append((key[0], r.ts, r.seq, float(r.amount), bool(fits), round(spent, 6)))
        self.state.update((float(spent), int(since)))
        self.keep_until(since + self.micros)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in QUOTA.split(", ")])


class NewestEntries(StatefulProcessor):
    """The newest entries of a conversation; all go when it was not written to for so long, by the entries' times, and where state expires by the clock too."""

    def __init__(self, keep: int, hours: float, expire: bool):
        self.keep, self.seconds, self.expire = keep, hours * 3600, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "ts timestamp, seq long, entry string", ttlDurationMs=int(self.seconds * 1000) if self.expire else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [*self.entries.get()] if self.entries.exists() else []
        held += [(r.ts.to_pydatetime(), int(r.seq), r.entry) for r in _ordered(rows).itertuples()]
        live: list[tuple] = []
        for x in sorted(held, key=lambda x: x[:2]):
            if live and (x[0] - live[-1][0]).total_seconds() > self.seconds:
                live = []
            live.append(x)
        live = live[-self.keep :]
        self.entries.put(live)
        yield pd.DataFrame({"conv_id": [key[0]], "size": [len(live)], "entries": [[x[2] for x in live]]})

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, late: str | None) -> DataFrame:
    return rows if late is None else rows.withWatermark("ts", late)


def stream_rate_limit(requests: DataFrame, capacity: float = 10, per_second: float = 1.0, late: str | None = None) -> DataFrame:
    """requests (key string, ts, seq) with allowed, remaining and retry_after, not rounded. late: how far behind the newest a request may come (later ones are dropped); full
    buckets that far behind leave the state. Without it all buckets stay."""
    bucket = TokenBucket(capacity, per_second, late is not None)
    return _timed(requests, late).groupBy("key").transformWithStateInPandas(bucket, RATE, "append", "none" if late is None else "eventTime")


def stream_quota(calls: DataFrame, limit: float, seconds: float, late: str | None = None) -> DataFrame:
    """calls (tenant string, ts, seq, amount) with admitted and spent. late: as in stream_rate_limit, for periods that ran out."""
    quota = PeriodQuota(limit, seconds, late is not None)
    return _timed(calls, late).groupBy("tenant").transformWithStateInPandas(quota, QUOTA, "append", "none" if late is None else "eventTime")


def stream_history(entries: DataFrame, keep: int = 40, hours: float = 24, expire: bool = True) -> DataFrame:
    """entries (conv_id string, ts, seq, entry): each conversation's newest entries after every micro-batch that writes to it. expire: drop the state of silent conversations
    by the clock; a job that replays old entries goes without."""
    return entries.groupBy("conv_id").transformWithStateInPandas(NewestEntries(keep, hours, expire), HISTORY, "update", "processingTime" if expire else "none")


def stream_metrics(requests: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests, errors and amounts by tenant and tumbling window; rows later than `late` are dropped. Streams and tables."""
    held = requests.withWatermark("ts", late) if requests.isStreaming else requests
    counted = held.groupBy(F.window("ts", window).alias("w"), "tenant").agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"), F.round(F.sum("amount"), 4).alias("amount"))
    return counted.select(F.col("w.start").alias("window_start"), "tenant", "requests", "errors", "amount")


def stream_redact(lines: DataFrame) -> DataFrame:
    """Log lines (value, ...) with secrets and personal data masked. Streams and tables."""
    return lines.withColumn("value", log_redact(F.col("value")))


def stream_reassemble(deltas: DataFrame) -> DataFrame:
    """deltas (stream_id, position, delta, event) as (stream_id, text, done, failed, output_tokens): texts by position, repeated positions once. Streams (complete mode) and tables."""
    part = F.struct("position", "delta")
    held = deltas.groupBy("stream_id").agg(F.array_sort(F.collect_set(F.when(F.col("event") == "delta", part))).alias("parts"), F.max(F.col("event") == "done").alias("done"), F.max(F.col("event") == "error").alias("failed"))
    text = F.array_join(F.transform("parts", lambda p: p["delta"]), "")
    return held.select("stream_id", text.alias("text"), "done", "failed", F.floor(F.length(text) / 4).alias("output_tokens"))


#: So many versions of ingested documents are merged into one, so many of these into one again, and so on.
MERGED = 8
STATE = "source string, content_hash string, v long"


def stream_ingest(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a job that chunks new and changed documents of a stream (source, text, ts, ...) into tables under `path`; see `ingest_batch` and `ingested`."""
    return docs.writeStream.foreachBatch(lambda part, n: ingest_batch(part, n, chunk, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batch(part: DataFrame, batch_id: int, chunk: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Adds a version of its own, chunks and (source, content_hash, v), of the sources that changed in a batch, and leaves older ones as they are; a batch that runs
    again writes the same version. A source's chunks are those of its last version.

    What the sources were before is looked up in at most MERGED - 1 folders for each power of MERGED up to the number of batches: versions
    before the batch are merged first, newest ones kept, whenever a power of MERGED is full.
    """
    spark = part.sparkSession
    merge_versions(spark, path, batch_id)
    newest = part.groupBy("source").agg(F.max_by(F.struct(*part.columns), "ts").alias("r")).select("r.*").persist()
    try:
        held = _states(spark, path, _versions(spark, path, batch_id)).join(newest.select("source"), "source", "left_semi")
        known = _newest(held).drop("v")
        chunks, state, _ = ingest(newest, known, chunk)
        name = _name(batch_id, batch_id)
        chunks.withColumn("v", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/chunks/{name}")
        changed = state.join(known, ["source", "content_hash"], "left_anti").select("source", "content_hash", F.lit(batch_id).cast("long").alias("v"))
        changed.write.mode("overwrite").parquet(f"{path}/state/{name}")
    finally:
        newest.unpersist()


def merge_versions(spark, path: str, before: int) -> None:
    """Merges the versions of the largest power of MERGED that ends before a batch, if one does. Versions of the batch itself are never touched and folders never
    changed, so the batch may run again and readers find either the merged folder, once it is whole, or those it was made of."""
    width = MERGED
    while before % (width * MERGED) == 0 and before > 0:
        width *= MERGED
    if before == 0 or before % width:
        return
    first, last = before - width, before - 1
    some = [x for x in _versions(spark, path, before) if x[0] >= first]
    if len(some) < 2:
        return
    state = _newest(_states(spark, path, some))
    name = _name(first, last)
    chunks = spark.read.parquet(*(f"{path}/chunks/{_name(*x)}" for x in some))
    chunks.join(state.select("source", "v"), ["source", "v"], "left_semi").select(*chunks.columns).write.mode("overwrite").parquet(f"{path}/chunks/{name}")
    state.write.mode("overwrite").parquet(f"{path}/state/{name}")  # last: a whole state says that the chunks are whole


def ingested(spark, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(chunks, state) of the sources as `stream_ingest` knows them last."""
    versions = _versions(spark, path, None)
    if not versions:
        return None
    state = _newest(_states(spark, path, versions))
    chunks = spark.read.parquet(*(f"{path}/chunks/{_name(*x)}" for x in versions))
    return chunks.join(state.select("source", "v"), ["source", "v"], "left_semi").drop("v"), state.drop("v")


def _name(first: int, last: int) -> str:
    return f"{first:012d}-{last:012d}"


def _versions(spark, path: str, before: int | None) -> list[tuple[int, int]]:
    """(first, last) of the fewest whole folders that hold all versions, of those before a batch if named."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    found = sorted((tuple(map(int, n.split("-"))) for n in names), key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for first, last in found:
        new = (before is None or last < before) and (not out or first > out[-1][1])
        if new and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/state/{_name(first, last)}/_SUCCESS")):
            out.append((first, last))
    return out


def _states(spark, path: str, versions: list[tuple[int, int]]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*(f"{path}/state/{_name(*x)}" for x in versions))


def _newest(states: DataFrame) -> DataFrame:
    """(source, content_hash, v) of the last version of each source."""
    return states.groupBy("source").agg(F.max(F.struct("v", "content_hash")).alias("x")).select("source", "x.content_hash", "x.v")

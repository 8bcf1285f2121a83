"""Rules that depend on order, at keys of any size, against a plain walk."""

import datetime
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import folds, metrics, periods, scans, usage
from tessera.streaming import jobs

START = datetime.datetime(2024, 3, 1)


def calls(spark, n, keys, seed, most_seconds):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), START + datetime.timedelta(seconds=rng.choice([rng.randrange(most_seconds), rng.random() * most_seconds])), i, float(rng.randrange(1, 9))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "tenant string, ts timestamp, seq long, amount double").repartition(3)


def walk(rows, limit, seconds):
    held, out = {}, {}
    for tenant, ts, seq, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        since, spent = held.get(tenant, (None, 0.0))
        if since is None or ts - since >= datetime.timedelta(seconds=seconds):
            since, spent = ts, 0.0
        fits = spent + amount <= limit
        held[tenant] = since, spent + amount if fits else spent
        out[seq] = (since, fits, held[tenant][1])
    return out


def test_periods_of_hot_keys(spark):
    for seed, seconds, span in ((0, 10, 600), (1, 7.5, 5000), (2, 600, 100), (3, 0.5, 900), (4, 60, 61)):
        rows, table = calls(spark, 400, ["a", "a", "a", None, "b"], seed, span)
        want = walk(rows, 20.0, seconds)
        found = periods.with_periods(table, "tenant", seconds).withColumn("s", F.timestamp_micros("since")).collect()
        assert {r["seq"]: r["s"] for r in found} == {seq: x[0] for seq, x in want.items()}


def test_quota_of_hot_and_other_tenants(spark):
    rows, table = calls(spark, 300, ["hot"] * 6 + ["b", None], 5, 2000)
    want = {seq: x[1:] for seq, x in walk(rows, 20.0, 30).items()}
    for most in (100, 1_000_000, 1):
        found = usage.quota_admission(table, 20.0, 30.0, hot_rows=most)
        assert found.columns == ["tenant", "ts", "seq", "amount", "admitted", "spent"]
        assert {r["seq"]: (r["admitted"], r["spent"]) for r in found.collect()} == want


def test_hot_quota_fills_many_tasks(spark):
    table = spark.range(3000).select(F.lit("hot").alias("tenant"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"), F.lit(1.0).alias("amount"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = usage.quota_admission(table, 5.0, 10.0, hot_rows=10).withColumn("task", F.spark_partition_id())
        assert found.filter("admitted").count() == 1500
        assert found.select("task").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cache_labels_of_hot_keys(spark):
    rows, table = calls(spark, 300, ["hot"] * 5 + ["b", None], 6, 500)
    asked = table.select(F.col("tenant").alias("cache_key"), "ts", "seq", F.col("amount").alias("tokens"))
    begins, of = {}, walk(rows, 1.0, 25)
    for tenant, ts, seq, _ in rows:
        if ts == of[seq][0]:
            begins[tenant, ts] = min(seq, begins.get((tenant, ts), seq))
    want = {seq: begins.get((tenant, ts)) != seq for tenant, ts, seq, _ in rows}
    for most in (50, 1_000_000):
        found = metrics.cache_labels(asked, 25.0, hot_rows=most).collect()
        assert {r["seq"]: r["hit"] for r in found} == want
        assert all(r["billed_tokens"] == (0 if r["hit"] else r["tokens"]) for r in found)


def test_periods_of_no_rows(spark):
    empty = spark.createDataFrame([], "tenant string, ts timestamp, seq long, amount double")
    assert periods.with_periods(empty, "tenant", 10).count() == 0
    assert usage.quota_admission(empty, 1.0, 1.0).count() == 0


def outcomes(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["p", "p", "q", None]), START + datetime.timedelta(seconds=rng.choice([60, 7200]) * rng.random() * 20), i, rng.choice(["failure", "failure", "failure", "success", "client_error"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "provider string, ts timestamp, seq long, outcome string").repartition(3)


def test_scans_over_blocks(spark):
    rows, table = outcomes(spark, 500, 1)
    streaks, rates = [], {}
    for p in ("p", "q", None):
        own = sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2]))
        run = []
        for r in [*own, (p, None, None, "success")]:
            if r[3] == "failure":
                run.append(r[1])
            elif r[3] == "success":
                if len(run) >= 3:
                    streaks.append((p, run[0], run[-1], len(run)))
                run = []
        for i, r in enumerate(own):
            last = own[max(0, i - 6) : i + 1]
            rates[r[2]] = round(sum(x[3] == "failure" for x in last) / len(last), 6) if len(last) >= 4 else None
    for block in ("minute", "hour", "year"):
        found = metrics.failure_streaks(table, 3, block).select("provider", "first_ts", "last_ts", "failures").collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, streaks))
    for size in (7, 50):
        found = metrics.sliding_failure_rate(table, 7, 4, 0.6, "hour", size).collect()
        assert {r["seq"]: r["rate"] for r in found} == rates and len(found) == len(rows)
        assert all(r["alert"] == (r["rate"] is not None and r["rate"] >= 0.6) for r in found)


def test_running_sum_has_no_window_over_a_key(spark):
    plan = scans.running_sum(outcomes(spark, 50, 2)[1], "provider", F.lit(1), "nth")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "windowspecdefinition(provider#" in plan
    assert all("__time#" in line for line in plan.split("\n") if "Window" in line and "windowspecdefinition(provider#" in line)


def drained(spark, tmp_path, name, rows, job):
    """What a job writes over rows that come a file at a time, and the state rows that are left."""
    source, out, notes = (f"{tmp_path}/{name}-{x}" for x in ("in", "out", "notes"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in rows:
            part.coalesce(1).write.mode("append").parquet(source)
            query = job(spark.readStream.schema(part.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", notes).trigger(availableNow=True).start()
            query.awaitTermination()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(out), left


def test_quota_state_ends_when_periods_run_out(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    schema = "tenant string, ts timestamp, seq long, amount double"
    rows = [[(f"t{i}", at(i), i, 3.0) for i in range(20)], [("t0", at(15), 30, 9.0), ("t1", at(40), 31, 9.0)], [("late", at(500), 32, 1.0)], [("late", at(501), 33, 1.0)]]
    parts = [spark.createDataFrame(part, schema) for part in rows]
    found, left = drained(spark, tmp_path, "ends", parts, lambda s: jobs.stream_quota(s, 10.0, 20.0, "10 seconds"))
    _, stays = drained(spark, tmp_path, "stays", parts, lambda s: jobs.stream_quota(s, 10.0, 20.0))
    want = {seq: x[1:] for seq, x in walk([r for part in rows for r in part], 10.0, 20).items()}
    assert {r["seq"]: (r["admitted"], r["spent"]) for r in found.collect()} == want
    assert left < stays and stays >= 21


def test_a_join_s_skew_does_not_split_a_fold(spark):
    """One key from eight files, behind a join that Spark takes for skewed: its rows stay in one fold."""
    kept = {"skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1", "advisoryPartitionSizeInBytes": "1k", "autoBroadcastJoinThreshold": "-1"}
    small = {f"spark.sql.adaptive.{k}": v for k, v in kept.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") < 0, 1).otherwise(0).cast("long").alias("period"), F.col("id").alias("seq"), F.lit(1.0).alias("amount"))
    joined = rows.join(spark.range(1).select(F.col("id").alias("period"), F.lit(0.0).alias("start")), "period", "left")

    def step(n, amount):
        return (n or 0.0) + amount, ((n or 0.0) + amount,)

    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        found = folds.fold_in_order(joined, "period", ["seq"], ["amount"], step, {"n": T.DoubleType()}).collect()
    finally:
        for name in small:
            spark.conf.unset(name)
    assert [r["n"] for r in sorted(found, key=lambda r: r["seq"])] == [i + 1.0 for i in range(20_000)]

"""Service metrics of request logs: requests (ts, seq, route, status, latency, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import stepped_percentile_rank
from tessera.operators.folds import fold_in_order
from tessera.operators.periods import HOT_ROWS, split_hot, with_periods
from tessera.operators.scans import running_sum

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def request_counts(requests: DataFrame) -> DataFrame:
    """(route, status, requests, errors): errors are statuses from 500 on."""
    return requests.groupBy("route", "status").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))


def latency_percentiles(requests: DataFrame, by: str = "route", last: int = 1000) -> DataFrame:
    """p50, p95 and p99 of the last observations of each group, at rank min(n, floor(q n) + 1)."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("seq")))
    recent = requests.withColumn("age", newest).filter(F.col("age") <= last)
    ranked = recent.withColumns({"nth": F.row_number().over(Window.partitionBy(by).orderBy("latency", "seq")), "of": F.count("*").over(Window.partitionBy(by))})
    picks = [F.max(F.when(F.col("nth") == stepped_percentile_rank(F.col("of"), q), F.col("latency"))).alias(name) for name, q in QUANTILES.items()]
    return ranked.groupBy(by).agg(F.max("of").alias("observations"), *picks)


def latency_percentiles_approx(requests: DataFrame, by: str = "route", accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles over all observations, without ordering them."""
    return requests.groupBy(by).agg(*(F.percentile_approx("latency", q, accuracy).alias(name) for name, q in QUANTILES.items()))


def metrics_snapshot(requests: DataFrame) -> DataFrame:
    """One row of counts, tokens, cost, cache hit rate and refusals by rate limits (status 429). requests also have input_tokens, output_tokens, cost_usd, cache_hit."""
    return requests.agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.avg(F.col("cache_hit").cast("int")), 6).alias("cache_hit_rate"), F.count_if(F.col("status") == 429).alias("rate_limited"),
    )


def cache_labels(requests: DataFrame, ttl_seconds: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """requests (cache_key, ts, seq, tokens) with hit and billed_tokens: a request hits if it comes before the last miss's ttl ran out; hits don't extend it and cost nothing.

    A miss and its hits are a period. Of keys of more than hot_rows requests the periods are found by doubled successors, and a period's first request is its
    miss; the others are folded in order while they stream by.
    """
    length = round(ttl_seconds * 1e6)

    def step(missed, now, tokens):
        hit = missed is not None and now - missed < length
        return missed if hit else now, (hit, 0 if hit else tokens)

    asked = requests.select("cache_key", "ts", "seq", F.col("tokens").cast("long").alias("tokens"), F.unix_micros("ts").alias("micros"))
    few, hot = split_hot(asked, "cache_key", hot_rows)
    shown = ["cache_key", "ts", "seq", "hit", "billed_tokens", "tokens"]
    labelled = fold_in_order(few, "cache_key", ["ts", "seq"], ["micros", "tokens"], step, {"hit": T.BooleanType(), "billed_tokens": T.LongType()}).select(*shown)
    if hot is None:
        return labelled
    periods = with_periods(hot, "cache_key", ttl_seconds)
    at_begin = F.col("micros") == F.col("since")  # the miss is among these; all of them come at one time
    first = F.row_number().over(Window.partitionBy("cache_key", "since").orderBy("seq")) == 1
    begins = periods.filter(at_begin).withColumn("hit", ~first)
    told = begins.unionByName(periods.filter(~at_begin).withColumn("hit", F.lit(True)))
    return labelled.unionByName(told.withColumn("billed_tokens", F.when(F.col("hit"), F.lit(0)).otherwise(F.col("tokens")).cast("long")).select(*shown))


def cache_report(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.round(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)), 6).alias("hit_rate"), F.sum(F.col("tokens") - F.col("billed_tokens")).alias("tokens_saved"))


def failure_streaks(calls: DataFrame, least: int = 5, block: str = "hour") -> DataFrame:
    """Runs of `least` or more failures in a row of calls (provider, ts, seq, outcome): a success ends a run, a client error is passed over.

    A run is named by the successes before it, which are counted by block of time and within the block: no window holds more than a block's calls,
    or a row for each block. Runs are then sums over any number of blocks.
    """
    counted = running_sum(calls.filter("outcome <> 'client_error'"), "provider", (F.col("outcome") == "success").cast("int"), "run", block)
    runs = counted.filter("outcome = 'failure'").groupBy("provider", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("failures"))
    return runs.filter(F.col("failures") >= least).drop("run")


def sliding_failure_rate(calls: DataFrame, size: int = 20, least: int = 10, alert: float = 0.5, block: str = "hour", rows: int = 10_000) -> DataFrame:
    """calls with the failure rate of a provider's last `size` calls, null before `least` of them, and whether it reaches `alert`.

    Calls are numbered by block of time and dealt by number into blocks of `rows`; the last size - 1 of each are carried into the next.
    """
    rows = max(rows, size)
    numbered = running_sum(calls, "provider", F.lit(1), "__nth", block).withColumn("__failed", (F.col("outcome") == "failure").cast("int"))
    own = F.floor((F.col("__nth") - 1) / rows)
    carried = F.pmod(F.col("__nth") - 1, F.lit(rows)) >= rows - (size - 1)
    dealt = numbered.withColumn("__own", own).withColumn("__block", F.explode(F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("provider", "__block").orderBy("__nth").rowsBetween(-(size - 1), 0)
    rate = F.when(F.least(F.col("__nth"), F.lit(size)) >= least, F.round(F.avg("__failed").over(last), 6))
    rated = dealt.withColumn("rate", rate).filter("__block = __own").select(*calls.columns, "rate")
    return rated.withColumn("alert", F.coalesce(F.col("rate") >= alert, F.lit(False)))


def job_latest(statuses: DataFrame) -> DataFrame:
    """(job_id, status, ts): the last status of each job."""
    last = F.max(F.struct("ts", "seq", "status")).alias("x")
    return statuses.groupBy("job_id").agg(last).select("job_id", "x.status", "x.ts")


def metrics_exposition(counts: DataFrame, gauges: DataFrame) -> DataFrame:
    """(position, line) in the text format of metrics: counts (route, status, requests), gauges (name, kind, help, label, value text)."""
    head = F.array(F.struct(F.lit("").alias("k"), F.lit("# HELP http_requests_total Total HTTP requests").alias("line")), F.struct(F.lit("").alias("k"), F.lit("# TYPE http_requests_total counter").alias("line")))
    first = counts.sparkSession.range(1).select(F.lit(0).alias("block"), F.lit("http_requests_total").alias("name"), F.posexplode(head).alias("at", "x")).select("block", "name", "at", "x.*")
    series = counts.select(F.lit(0).alias("block"), F.lit("http_requests_total").alias("name"), F.lit(2).alias("at"), F.format_string("%s|%09d", "route", F.col("status").cast("long")).alias("k"), F.format_string('http_requests_total{route="%s",status="%d"} %d', "route", F.col("status").cast("long"), "requests").alias("line"))
    label = F.coalesce("label", F.lit(""))
    lines = F.array(F.format_string("# HELP %s %s", "name", "help"), F.format_string("# TYPE %s %s", "name", "kind"), F.concat_ws(" ", F.concat("name", label), "value"))
    rest = gauges.select(F.lit(1).alias("block"), "name", F.posexplode(lines).alias("at", "line"), label.alias("k")).filter("at = 2 or k = ''").select("block", "name", "at", "k", "line")
    every = first.unionByName(series).unionByName(rest)
    return every.select(F.row_number().over(Window.orderBy("block", "name", "at", "k")).cast("long").alias("position"), "line")  # a row per series

"""Queries of usage, service metrics, agent runs, inference and the SQL surface, over events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rules import ALLOWED_MODELS, PRICES
from tessera.operators import inference, metrics, traces, usage, validation
from tessera.plans.base import MODELS, USAGE_SQL, Plans, events, messages, read
from tessera.plans.base import usage as usage_log
from tessera.sources import files
from tessera.sources.scratch import checkpoint, fresh_path, stored

plans = Plans()
add = plans.add

PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in PRICES.items()) + ") p(model, input_usd, output_usd))"
COST_SQL = f"""{PRICES_SQL}, {USAGE_SQL},
costs AS (SELECT u.*, round(coalesce(input_tokens / 1e6 * input_usd + output_tokens / 1e6 * output_usd, 0), 8) AS cost_usd, p.model IS NULL AS unknown_model FROM usage u LEFT JOIN prices p USING (model))"""


def costs(spark, d):
    return usage.usage_cost(usage_log(spark, d), usage.price_table(spark))


@add(f"WITH {PRICES_SQL}, m AS (SELECT DISTINCT json_extract_string(props, '$.k')::BIGINT % {len(MODELS)} AS i FROM events) SELECT model, input_usd, output_usd FROM prices WHERE model IN (SELECT ({list(MODELS)!r})[i + 1] FROM m)")
def price_table(spark, d):
    """Prices of the models that the log has."""
    return usage.price_table(spark).join(usage_log(spark, d).select("model").distinct(), "model", "left_semi")


@add(f"WITH {COST_SQL} SELECT seq, tenant, model, cost_usd, unknown_model FROM costs")
def usage_cost(spark, d):
    return costs(spark, d).select("seq", "tenant", "model", "cost_usd", "unknown_model")


@add(f"WITH {PRICES_SQL}, t AS (SELECT conv_id AS request_id, ({list(MODELS)!r})[conv_id % 5 + 1] AS model, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END + 4) AS BIGINT) AS input_tokens FROM conversations GROUP BY conv_id) SELECT request_id, model, input_tokens, round(coalesce(input_tokens / 1e6 * input_usd + 500 / 1e6 * output_usd, 0), 8) AS projected_usd FROM t LEFT JOIN prices USING (model)")
def request_projection(spark, d):
    from tessera.operators.history import message_tokens

    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 5 + 1).cast("int"))
    asked = message_tokens(messages(spark, d)).select(F.col("conv_id").alias("request_id"), model.alias("model"), F.col("tokens").alias("input_tokens"))
    return usage.request_projection(asked, usage.price_table(spark))


@add(f"WITH {COST_SQL} SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(tenant) = 0 THEN 'tenant' ELSE 'total' END AS level, coalesce(model, CAST(tenant AS VARCHAR), 'all') AS name, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM costs GROUP BY GROUPING SETS ((model), (tenant), ())")
def spend_rollup(spark, d):
    return usage.spend_rollup(costs(spark, d).withColumn("tenant", F.col("tenant").cast("string")))


@add(
    f"""WITH {COST_SQL}, calls AS (SELECT *, round(coalesce(input_tokens / 1e6 * input_usd + 500 / 1e6 * output_usd, 0), 8) AS projected FROM costs LEFT JOIN prices USING (model)),
l AS (SELECT *, round(round(coalesce(sum(cost_usd) OVER (PARTITION BY tenant ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) + projected, 6) > 0.05 AS over FROM calls)
SELECT tenant, round(sum(cost_usd), 6) AS spent_usd, round(greatest(0, 0.05 - sum(cost_usd)), 6) AS remaining_usd, count(*) FILTER (over) AS over_calls FROM l GROUP BY tenant"""
)
def budget_headroom(spark, d):
    """Calls are projected at 500 tokens of output."""
    spent, prices = costs(spark, d), usage.price_table(spark)
    projected = usage.request_projection(spent.withColumn("request_id", F.col("seq")), prices).select(F.col("request_id").alias("seq"), "projected_usd")
    return usage.budget_headroom(spent.join(projected, "seq"), 0.05)


def calls(spark, d):
    return events(spark, d).select(F.col("user_id").alias("tenant"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("amount"))


@add(
    """WITH RECURSIVE c AS (SELECT user_id AS tenant, ts, event_id AS seq, value AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
walk AS (SELECT tenant, nth, seq, amount, ts AS since, amount <= 100.0 AS admitted, CASE WHEN amount <= 100.0 THEN amount ELSE 0.0 END AS spent FROM c WHERE nth = 1
  UNION ALL SELECT tenant, nth, seq, amount, CASE WHEN fresh THEN ts ELSE since END, carried + amount <= 100.0, CASE WHEN carried + amount <= 100.0 THEN carried + amount ELSE carried END
  FROM (SELECT c.*, w.since, epoch(c.ts - w.since) >= 86400 AS fresh, CASE WHEN epoch(c.ts - w.since) >= 86400 THEN 0.0 ELSE w.spent END AS carried FROM walk w JOIN c ON c.tenant = w.tenant AND c.nth = w.nth + 1))
SELECT tenant, seq, amount, admitted, round(spent, 6) AS spent FROM walk"""
)
def quota_admission(spark, d):
    return usage.quota_admission(calls(spark, d), 100.0, 86400.0).drop("ts")


@add(
    """WITH RECURSIVE c AS (SELECT event_id AS seq, value::DOUBLE AS amount, date_trunc('day', ts) AS period, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS nth FROM events),
walk AS (SELECT period, nth, seq, amount, 0.0::DOUBLE AS spent_before, amount <= 2000 AS admitted FROM c WHERE nth = 1
  UNION ALL SELECT period, nth, seq, amount, carried, round(carried + amount, 6) <= 2000
  FROM (SELECT c.*, round(w.spent_before + CASE WHEN w.admitted THEN w.amount ELSE 0 END, 6) AS carried FROM walk w JOIN c ON c.period = w.period AND c.nth = w.nth + 1))
SELECT seq, amount, round(spent_before, 4) AS spent_before, admitted FROM walk"""
)
def global_cutoff(spark, d):
    found = usage.global_cutoff(read(spark, d, "events").select("ts", F.col("event_id").alias("seq"), F.col("value").alias("amount")), 2000.0)
    return found.select("seq", "amount", F.round("spent_before", 4).alias("spent_before"), "admitted")


def requests(spark, d):
    """Events as requests: the type is the route; errors fail with 500 or, for every fifth k, 429; the value is the latency."""
    status = F.when(F.col("event_type") != "error", 200).when(F.col("k") % 5 == 0, 429).otherwise(500)
    return events(spark, d).select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("route"), status.alias("status"), F.col("value").alias("latency"), "k", "user_id")


REQUESTS_SQL = "requests AS (SELECT ts, event_id AS seq, event_type AS route, k, user_id, CASE WHEN event_type <> 'error' THEN 200 WHEN k % 5 = 0 THEN 429 ELSE 500 END AS status, value AS latency FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"


@add(f"WITH {REQUESTS_SQL} SELECT route, status, count(*) AS requests, count(*) FILTER (status >= 500) AS errors FROM requests GROUP BY ALL")
def request_counts(spark, d):
    return metrics.request_counts(requests(spark, d))


@add(
    f"""WITH {REQUESTS_SQL}, recent AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY route ORDER BY ts DESC, seq DESC) <= 1000),
r AS (SELECT route, latency, row_number() OVER (PARTITION BY route ORDER BY latency, seq) AS nth, count(*) OVER (PARTITION BY route) AS n FROM recent)
SELECT route, max(n) AS observations, max(latency) FILTER (nth = least(n, CAST(floor(n * 0.5) AS BIGINT) + 1)) AS p50, max(latency) FILTER (nth = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)) AS p95, max(latency) FILTER (nth = least(n, CAST(floor(n * 0.99) AS BIGINT) + 1)) AS p99 FROM r GROUP BY route"""
)
def latency_percentiles(spark, d):
    return metrics.latency_percentiles(requests(spark, d))


def priced_requests(spark, d):
    spent = costs(spark, d).select("seq", "input_tokens", "output_tokens", "cost_usd")
    return requests(spark, d).join(spent, "seq").withColumn("cache_hit", F.col("k") % 3 == 0)


@add(f"WITH {COST_SQL}, {REQUESTS_SQL} SELECT count(*) AS requests, count(*) FILTER (status >= 500) AS errors, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd, round(avg(CAST(k % 3 = 0 AS INT)), 6) AS cache_hit_rate, count(*) FILTER (status = 429) AS rate_limited FROM requests JOIN costs USING (seq)")
def metrics_snapshot(spark, d):
    return metrics.metrics_snapshot(priced_requests(spark, d))


@add(
    f"""WITH RECURSIVE {REQUESTS_SQL}, c AS (SELECT route || ':' || (k % 20) AS cache_key, ts, seq, k AS tokens, row_number() OVER (PARTITION BY route, k % 20 ORDER BY ts, seq) AS nth FROM requests),
walk AS (SELECT cache_key, nth, seq, tokens, ts AS missed, false AS hit FROM c WHERE nth = 1
  UNION ALL SELECT c.cache_key, c.nth, c.seq, c.tokens, CASE WHEN epoch(c.ts - w.missed) < 3600 THEN w.missed ELSE c.ts END, epoch(c.ts - w.missed) < 3600 FROM walk w JOIN c ON c.cache_key = w.cache_key AND c.nth = w.nth + 1)
SELECT cache_key, seq, hit, CASE WHEN hit THEN 0 ELSE tokens END AS billed_tokens, tokens FROM walk"""
)
def cache_labels(spark, d):
    asked = requests(spark, d).select(F.concat_ws(":", "route", (F.col("k") % 20).cast("string")).alias("cache_key"), F.col("ts").cast("timestamp").alias("ts"), "seq", F.col("k").alias("tokens"))
    return metrics.cache_labels(asked, 3600.0).drop("ts")


def outcomes(spark, d):
    outcome = F.when(F.col("k") % 10 == 0, "client_error").when((F.col("k") % 10 < 6), "failure").otherwise("success")
    return requests(spark, d).select((F.col("user_id") % 5).alias("provider"), "ts", "seq", outcome.alias("outcome"))


OUTCOMES_SQL = f"{REQUESTS_SQL}, calls AS (SELECT user_id % 5 AS provider, ts, seq, CASE WHEN k % 10 = 0 THEN 'client_error' WHEN k % 10 < 6 THEN 'failure' ELSE 'success' END AS outcome FROM requests)"


@add(f"WITH {OUTCOMES_SQL}, r AS (SELECT *, sum(CAST(outcome = 'success' AS INT)) OVER (PARTITION BY provider ORDER BY ts, seq) AS run FROM calls WHERE outcome <> 'client_error') SELECT provider, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS failures FROM r WHERE outcome = 'failure' GROUP BY provider, run HAVING count(*) >= 5")
def failure_streaks(spark, d):
    return metrics.failure_streaks(outcomes(spark, d))


@add(f"WITH {OUTCOMES_SQL}, r AS (SELECT provider, seq, count(*) OVER w AS n, round(avg(CAST(outcome = 'failure' AS INT)) OVER w, 6) AS rate FROM calls WINDOW w AS (PARTITION BY provider ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT provider, seq, CASE WHEN n >= 10 THEN rate END AS rate, coalesce(n >= 10 AND rate >= 0.5, false) AS alert FROM r")
def sliding_failure_rate(spark, d):
    return metrics.sliding_failure_rate(outcomes(spark, d)).select("provider", "seq", "rate", "alert")


@add("SELECT user_id AS job_id, (['queued', 'running', 'succeeded', 'failed'])[json_extract_string(props, '$.k')::BIGINT % 4 + 1] AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_latest(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed"))), (F.col("k") % 4 + 1).cast("int"))
    log = events(spark, d).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"))
    return metrics.job_latest(log).select("job_id", "status")


def gauges(spark, d):
    snapshot = metrics.metrics_snapshot(priced_requests(spark, d))
    one = lambda name, kind, text, value: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(text).alias("help"), F.lit(None).cast("string").alias("label"), value.alias("value"))
    rows = F.array(one("llm_input_tokens_total", "counter", "Prompt tokens", F.col("input_tokens").cast("string")), one("llm_cache_hit_rate", "gauge", "Cache hit ratio", F.format_string("%.3f", "cache_hit_rate")))
    return snapshot.select(F.explode(rows).alias("g")).select("g.*")


@add(
    f"""WITH {COST_SQL}, {REQUESTS_SQL}, l AS (
SELECT 0 AS block, 'http_requests_total' AS name, 0 AS "at", '' AS k, '# HELP http_requests_total Total HTTP requests' AS line UNION ALL SELECT 0, 'http_requests_total', 1, '', '# TYPE http_requests_total counter'
UNION ALL SELECT 0, 'http_requests_total', 2, printf('%s|%09d', route, status), printf('http_requests_total{{route="%s",status="%d"}} %d', route, status, count(*)) FROM requests GROUP BY route, status
UNION ALL SELECT 1, 'llm_input_tokens_total', unnest([0, 1, 2]), '', unnest(['# HELP llm_input_tokens_total Prompt tokens', '# TYPE llm_input_tokens_total counter', 'llm_input_tokens_total ' || CAST(sum(input_tokens) AS BIGINT)]) FROM costs
UNION ALL SELECT 1, 'llm_cache_hit_rate', unnest([0, 1, 2]), '', unnest(['# HELP llm_cache_hit_rate Cache hit ratio', '# TYPE llm_cache_hit_rate gauge', 'llm_cache_hit_rate ' || printf('%.3f', avg(CAST(k % 3 = 0 AS INT)))]) FROM requests)
SELECT row_number() OVER (ORDER BY block, name, "at", k) AS "position", line FROM l"""
)
def metrics_exposition(spark, d):
    return metrics.metrics_exposition(metrics.request_counts(requests(spark, d)), gauges(spark, d))


@add()
def structured_log(spark, d):
    """Events written as JSON lines and read back typed."""
    path = fresh_path(spark, "log")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    nothing = F.lit(None).cast("string")
    logs = events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), level.alias("level"), F.lit("service").alias("logger"), "event_type", F.col("user_id").cast("string").alias("tenant"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("fields"))
    files.write_log(logs.select("ts", "level", "logger", F.col("event_type").alias("message"), "tenant", "fields", nothing.alias("exception")), path)
    return files.read_log(spark, path).groupBy("level", "message").agg(F.count("*").alias("lines"), F.count("exception").alias("exceptions"), F.count_distinct("tenant").alias("tenants"))


def steps(spark, d):
    """Events as agent steps: a user is a run, the type the tool."""
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    signature = traces.call_signature(F.col("event_type"), F.to_json(F.struct((F.col("k") % 2).alias("k"))))
    return events(spark, d).select(
        F.col("user_id").alias("run_id"), idx.alias("idx"), F.col("event_type").alias("tool"), "k", (F.col("event_type") != "error").alias("ok"), (F.col("k") % 13 != 0).alias("parse_ok"), (F.col("k") == 77).alias("final"),
        F.col("k").alias("tokens"), F.round(F.col("value") / 20, 6).alias("seconds"), signature.alias("signature"), F.concat(F.lit("saw "), "props").alias("content"),
    )


STEPS_SQL = """steps AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS tool, k, event_type <> 'error' AS ok, k % 13 <> 0 AS parse_ok, k = 77 AS final,
  k AS tokens, round(value / 20, 6) AS seconds, event_type || '({"k":' || (k % 2) || '})' AS signature, 'saw ' || props AS content FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""
LOOP_SQL = "looped AS (SELECT *, len(list_filter(array_agg(signature) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda s: s = signature)) >= 2 AS loop FROM {})"


@add(f"WITH {STEPS_SQL} SELECT run_id, idx, signature FROM steps")
def call_signature(spark, d):
    return steps(spark, d).select("run_id", "idx", "signature")


@add(
    f"""WITH {STEPS_SQL}, w AS (SELECT *, lag(signature, 1) OVER o AS a, lag(signature, 2) OVER o AS b, lag(signature, 3) OVER o AS c FROM steps WINDOW o AS (PARTITION BY run_id ORDER BY idx))
SELECT run_id, idx, coalesce(CAST(a = signature AS INT), 0) + coalesce(CAST(b = signature AS INT), 0) + coalesce(CAST(c = signature AS INT), 0) >= 2 AS loop FROM w"""
)
def loop_detect(spark, d):
    return traces.loop_detect(steps(spark, d)).select("run_id", "idx", "loop")


NO_PROGRESS_SQL = "island AS (SELECT *, sum(CAST({ok} AS INT)) OVER (PARTITION BY run_id ORDER BY idx) AS island FROM {source}), errors AS (SELECT *, sum(CAST(NOT {ok} AS INT)) OVER (PARTITION BY run_id, island ORDER BY idx) AS errors FROM island)"


@add(f"WITH {STEPS_SQL}, {NO_PROGRESS_SQL.format(ok='ok', source='steps')} SELECT run_id, idx, CAST(errors AS BIGINT) AS errors, NOT ok AND errors >= 3 AS stuck FROM errors")
def no_progress(spark, d):
    return traces.no_progress(steps(spark, d)).select("run_id", "idx", "errors", "stuck")


_OUTCOME = f"""{STEPS_SQL}, fine_steps AS (SELECT *, ok AND parse_ok AS fine FROM steps), {NO_PROGRESS_SQL.format(ok='fine', source='fine_steps')},
executed AS (SELECT run_id, idx, coalesce(CAST(lag(signature, 1) OVER o = signature AS INT), 0) + coalesce(CAST(lag(signature, 2) OVER o = signature AS INT), 0) + coalesce(CAST(lag(signature, 3) OVER o = signature AS INT), 0) >= 2 AS loop
  FROM steps WHERE parse_ok WINDOW o AS (PARTITION BY run_id ORDER BY idx)),
flagged AS (SELECT *, idx + 1 AS nth, coalesce(sum(tokens) OVER b, 0) / 1000 * 0.0006 AS spent, coalesce(sum(seconds) OVER b, 0) AS elapsed, NOT fine AND errors >= 3 AS stuck,
  coalesce(loop, false) AS loop
  FROM errors LEFT JOIN executed USING (run_id, idx) WINDOW b AS (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reasons AS (SELECT run_id, idx, CASE WHEN nth > 10 THEN 'max_iterations' WHEN elapsed > 60 THEN 'deadline_exceeded' WHEN spent > 1 THEN 'budget_exceeded' WHEN final THEN 'final_answer'
  WHEN NOT parse_ok AND stuck THEN 'no_progress' WHEN parse_ok AND loop THEN 'loop_detected' WHEN stuck THEN 'no_progress' END AS reason FROM flagged),
outcomes AS (SELECT run_id, coalesce(arg_min(reason, idx) FILTER (reason IS NOT NULL), 'max_iterations') AS stop_reason, coalesce(min(idx) FILTER (reason IS NOT NULL), max(idx)) AS stop_idx FROM reasons GROUP BY run_id)"""


@add(f"WITH {_OUTCOME} SELECT run_id, stop_reason, stop_idx FROM outcomes")
def run_outcome(spark, d):
    return traces.run_outcome(steps(spark, d))


@add(
    f"""WITH {_OUTCOME} SELECT run_id, stop_reason, count(*) AS steps, string_agg(tool, ',' ORDER BY idx) AS tools, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / 1000 * 0.0006, 8) AS cost_usd, round(sum(seconds), 6) AS seconds,
stop_reason = 'final_answer' AS succeeded, substring(arg_max(content, idx) FILTER (ok), 1, 500) AS fallback FROM steps JOIN outcomes USING (run_id) WHERE idx <= stop_idx GROUP BY run_id, stop_reason"""
)
def run_summary(spark, d):
    found = steps(spark, d)
    return traces.run_summary(found, traces.run_outcome(found))


@add()
def trace_parse(spark, d):
    """Replies around the events' properties: fenced, with a trailing comma, in single quotes, without input, final."""
    start = F.concat(F.lit("Thought: look at it\nAction: "), "tool", F.lit("\n"))
    json = F.format_string('{"k": %d}', "k")
    text = (
        F.when(F.col("k") % 6 == 0, F.concat(start, F.lit("Action Input: ```json\n"), json, F.lit("\n```"))).when(F.col("k") % 6 == 1, F.concat(start, F.format_string("Action Input: {'k': %d,}", "k")))
        .when(F.col("k") % 6 == 2, start).when(F.col("k") % 6 == 3, F.concat(F.lit("Thought: done\nFinal Answer: "), F.col("k").cast("string"))).when(F.col("k") % 6 == 4, F.concat(start, F.lit("Action Input: [1]"))).otherwise(F.lit("no idea"))
    )
    return traces.trace_parse(steps(spark, d).select("run_id", "idx", text.alias("text")))


@add()
def tool_args_check(spark, d):
    schema = spark.createDataFrame([(t, "k", "integer", None, True) for t in ("click", "view", "purchase")] + [("purchase", "currency", "string", ["EUR", "USD"], True), ("error", "code", "number", None, False)], "tool string, param string, type string, enum array<string>, required boolean")
    args = F.when(F.col("k") % 4 == 0, F.lit('{"k": "text"}')).when(F.col("k") % 4 == 1, F.lit('{"currency": "GBP", "k": 1}')).otherwise(F.format_string('{"k": %d}', "k"))
    return traces.tool_args_check(events(spark, d).select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), args.alias("args")), schema)


def tool_calls(spark, d):
    return steps(spark, d).select("run_id", F.col("idx").alias("seq"), "tool", (F.col("k") % 2 == 0).alias("approved"), F.create_map(F.lit("note"), F.concat(F.lit("mail bob"), F.col("k").cast("string"), F.lit("@example.com"))).alias("arguments"))


def decisions(spark, d):
    return traces.policy_decisions(tool_calls(spark, d), ["click", "view", "purchase", "error"], ["error"], ["purchase"], 20)


DECISIONS_SQL = f"""{STEPS_SQL}, p AS (SELECT run_id, idx AS seq, tool, k % 2 = 0 AS approved, tool IN ('error', 'signup') AS shut FROM steps),
b AS (SELECT *, coalesce(sum(CAST(NOT shut AND (tool <> 'purchase' OR approved) AS INT)) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
decisions AS (SELECT run_id, seq, CASE WHEN before >= 20 OR shut THEN 'blocked' WHEN tool = 'purchase' AND approved THEN 'approved' WHEN tool = 'purchase' THEN 'denied' ELSE 'allowed' END AS decision,
  CASE WHEN before >= 20 THEN 'call limit reached' WHEN tool = 'error' THEN 'denylisted' WHEN shut THEN 'not allowlisted' WHEN tool = 'purchase' THEN 'human-in-the-loop' ELSE '' END AS reason FROM b)"""


@add(f"WITH {DECISIONS_SQL} SELECT run_id, seq, decision, reason FROM decisions")
def policy_decisions(spark, d):
    return decisions(spark, d).select("run_id", "seq", "decision", "reason")


@add(f"WITH {DECISIONS_SQL} SELECT run_id, seq, decision, reason, '{{\"note\":\"mail [EMAIL]\"}}' AS arguments FROM decisions")
def audit_log(spark, d):
    return traces.audit_log(decisions(spark, d)).select("run_id", "seq", "decision", "reason", F.to_json("arguments").alias("arguments"))


@add(f"WITH {DECISIONS_SQL} SELECT count(*) AS events, count(*) FILTER (decision IN ('allowed', 'approved')) AS allowed, count(*) FILTER (decision IN ('blocked', 'denied')) AS blocked, count(*) FILTER (starts_with(reason, 'injection in output')) AS injections FROM decisions")
def audit_report(spark, d):
    return traces.audit_report(decisions(spark, d))


def chat_requests(spark, d):
    """Conversations as requests, some with broken rules."""
    n = F.col("conv_id")
    held = messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    model = F.element_at(F.array(*map(F.lit, (*ALLOWED_MODELS, "unheard-of"))), (n % 6 + 1).cast("int"))
    return held.select(n.alias("request_id"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), model.alias("model"), (n % 5 / 2).alias("temperature"), F.when(n % 7 == 0, F.lit(9000)).otherwise(F.lit(100)).cast("long").alias("max_tokens"), F.repeat(F.lit("x"), (n % 150).cast("int")).alias("conversation_id"), F.when(n % 3 == 0, F.format_string('{"top": %d, "seed": 1}', n % 2)).alias("extra"))


@add(
    f"""WITH c AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last, bool_or(role NOT IN ('system', 'user', 'assistant')) AS bad_role, bool_or(NOT length(text) BETWEEN 1 AND 32000) AS bad_content FROM conversations GROUP BY conv_id)
SELECT conv_id AS request_id, array_to_string(list_filter([CASE WHEN n > 100 THEN 'messages' END, CASE WHEN bad_role THEN 'role' END, CASE WHEN bad_content THEN 'content' END, CASE WHEN last = 'assistant' THEN 'last_message' END,
  CASE WHEN conv_id % 6 = {len(ALLOWED_MODELS)} THEN 'model' END, CASE WHEN conv_id % 5 / 2 > 2 THEN 'temperature' END, CASE WHEN conv_id % 7 = 0 THEN 'max_tokens' END, CASE WHEN conv_id % 150 > 128 THEN 'conversation_id' END], lambda x: x IS NOT NULL), ',') AS violations FROM c"""
)
def request_validation(spark, d):
    good, bad = validation.request_validation(chat_requests(spark, d))
    return good.select("request_id", F.lit("").alias("violations")).unionByName(bad.select("request_id", F.array_join("violations", ",").alias("violations")))


@add(
    f"""WITH m AS (SELECT conv_id, '[' || string_agg('[' || to_json(role) || ',' || to_json(text) || ']', ',' ORDER BY turn, role, text) || ']' AS messages FROM conversations GROUP BY conv_id),
r AS (SELECT sha256('{{"extra":"' || CASE WHEN conv_id % 3 = 0 THEN '{{\\"seed\\":1,\\"top\\":' || (conv_id % 2) || '}}' ELSE '{{}}' END || '","max_tokens":' || CASE WHEN conv_id % 7 = 0 THEN 9000 ELSE 100 END || ',"messages":' || messages || ',"model":"' || ({[*ALLOWED_MODELS, 'unheard-of']!r})[conv_id % 6 + 1] || '","temperature":0.0}}') AS fingerprint FROM m WHERE conv_id % 5 = 0)
SELECT fingerprint, count(*) AS requests FROM r GROUP BY fingerprint"""
)
def request_fingerprint(spark, d):
    return validation.request_fingerprint(chat_requests(spark, d))


@add(
    """SELECT event_id, CASE WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 403) THEN 'auth' WHEN status >= 500 THEN 'transient' WHEN status IN (400, 422) AND body = 'Maximum context passed' THEN 'context_length'
WHEN status IN (400, 422) AND body = 'content_filter' THEN 'content_filter' WHEN status IN (400, 422) THEN 'invalid_request' ELSE 'unknown' END AS error, status = 429 OR status >= 500 AS retryable
FROM (SELECT event_id, ([200, 400, 401, 403, 422, 429, 500, 503])[k % 8 + 1] AS status, (['', 'Maximum context passed', 'content_filter'])[k % 3 + 1] AS body FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""
)
def error_taxonomy(spark, d):
    status = F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 422, 429, 500, 503))), (F.col("k") % 8 + 1).cast("int"))
    body = F.element_at(F.array(*map(F.lit, ("", "Maximum context passed", "content_filter"))), (F.col("k") % 3 + 1).cast("int"))
    return events(spark, d).select("event_id", validation.error_taxonomy(status, body).alias("e")).select("event_id", "e.error", "e.retryable")


@add("SELECT c_name || '@' || lower(c_mktsegment) || '.example' AS email FROM customer WHERE c_acctbal > 0 ORDER BY email")
def active_emails(spark, d):
    users = read(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("active"), F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"))
    return validation.active_emails(users)


@add("SELECT lower(c_mktsegment) || '.example' AS domain, arg_min(c_name, c_custkey) || '@' || lower(c_mktsegment) || '.example' AS email FROM customer GROUP BY c_mktsegment")
def group_by_domain(spark, d):
    emails = read(spark, d, "customer").select(F.col("c_custkey").alias("position"), F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"))
    return validation.group_by_domain(emails)


READONLY = "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority"


@add(READONLY)
def readonly_sql(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("orders")
    return files.readonly_sql(spark, READONLY)


def echo(prompts: list[str]) -> list[str | Exception]:
    """An offline model for tests: repeats the first words; refuses prompts of an even length."""
    return [ValueError("even") if len(p) % 2 == 0 else "echo: " + p[:30] for p in prompts]


def asked(spark, d):
    return read(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), F.col("text").alias("prompt"))


@add()
def batch_complete(spark, d):
    return inference.batch_complete(asked(spark, d), echo, "fake-1", usage.price_table(spark))


@add()
def fallback_fill(spark, d):
    return inference.fallback_fill(asked(spark, d), [("fake-1", echo), ("gpt-4o-mini", lambda p: ["fallback"] * len(p))], usage.price_table(spark), checkpoint)


def wrapped_replies(spark, d):
    """The events' properties in four kinds of reply."""
    k = F.col("k")
    text = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, F.concat(F.lit("Sure!\n```json\n"), "props", F.lit("\n```"))).when(k % 4 == 2, F.format_string("{'k': %d,}", k)).otherwise(F.concat(F.lit("It is "), "props", F.lit(" then.")))
    finish = F.when(k % 11 == 0, "length").otherwise("stop")
    return events(spark, d).select(F.col("event_id").alias("reply_id"), text.alias("text"), finish.alias("finish_reason"))


@add()
def reply_json(spark, d):
    return inference.reply_json(wrapped_replies(spark, d))


@add()
def structured_table(spark, d):
    """Every seventh prompt is answered without JSON at first."""
    replies = stored(wrapped_replies(spark, d), "replies")

    def ask(prompts):
        first = ~F.contains("prompt", F.lit("refused")) & (F.col("reply_id") % 7 == 0)
        return prompts.join(replies, "reply_id").select("reply_id", F.when(first, F.lit("not now")).otherwise(F.col("text")).alias("text"), "finish_reason")

    good, bad = inference.structured_table(replies.select("reply_id", F.lit("Give k.").alias("prompt")), ask, "k bigint", lambda df: stored(df, "checked"))
    return good.select("reply_id", "k", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("reply_id", F.lit(None).cast("bigint").alias("k"), "reason"))


@add()
def golden_roundtrip(spark, d):
    """The benchmark as a golden set, saved and loaded."""
    path = fresh_path(spark, "golden")
    items = read(spark, d, "benchmark").select(F.col("text").alias("question"), F.col("text").alias("expected_answer"), F.array(F.substring("text", 1, 40)).alias("relevant_chunk_texts"), (F.col("item_id") % 2 == 1).alias("should_refuse"), F.create_map(F.lit("item"), F.col("item_id").cast("string")).alias("metadata"))
    files.save_golden(items, path)
    back = files.load_golden(spark, path)
    return back.select(F.md5("question").alias("question_md5"), F.get("relevant_chunk_texts", 0).alias("marker"), "should_refuse", F.col("metadata")["item"].alias("item"))

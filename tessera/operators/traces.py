"""Agent run logs: steps (run_id, idx, ...), tool calls, policy and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import ACTION, ACTION_INPUT, FENCE, FINAL_ANSWER, THOUGHT
from tessera.functions.text import strip
from tessera.operators.safety import pii_redact

COST_PER_1000 = 0.0006


def run_order():
    return Window.partitionBy("run_id").orderBy("idx")


def repair_json(raw: Column) -> Column:
    """Trailing commas go; single quotes become double ones where there are no double ones."""
    bare = F.regexp_replace(raw, r",(\s*[}\]])", "$1")
    return F.when(F.contains(bare, F.lit("'")) & ~F.contains(bare, F.lit('"')), F.replace(bare, F.lit("'"), F.lit('"'))).otherwise(bare)


def trace_parse(turns: DataFrame) -> DataFrame:
    """turns (run_id, idx, text) with thought, action, action_input (JSON text), final_answer and parse_error; a final answer wins."""
    got = lambda p: strip(F.regexp_extract("text", p, 1))
    has = lambda p: F.col("text").rlike(p)
    raw = strip(F.regexp_replace(got(ACTION_INPUT), FENCE, ""))
    act = F.regexp_replace(got(ACTION), "^[`\"']+|[`\"']+$", "")
    parsed = turns.select("run_id", "idx", got(THOUGHT).alias("thought"), F.when(has(FINAL_ANSWER), got(FINAL_ANSWER)).alias("final_answer"), has(ACTION).alias("acts"), act.alias("act"), has(ACTION_INPUT).alias("gives"), raw.alias("raw"))
    parsed = parsed.withColumn("fixed", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise(repair_json(F.col("raw"))))
    tree = F.try_parse_json("fixed")
    kind = F.schema_of_variant(tree)
    error = (
        F.when(F.col("final_answer").isNotNull(), F.lit(None).cast("string"))
        .when(~F.col("acts"), "no Action or Final Answer found")
        .when(~F.col("gives"), F.lit(None).cast("string"))
        .when(tree.isNull(), F.concat(F.lit("Action Input was not valid JSON: "), F.substring("raw", 1, 120)))
        .when(~F.startswith(kind, F.lit("OBJECT")), "Action Input must be a JSON object")
    )
    shown = parsed.withColumn("parse_error", error)
    open_one = F.col("final_answer").isNull() & F.col("acts")
    given_value = F.when(~F.col("gives"), F.lit("{}")).when(F.col("parse_error").isNull(), F.to_json(F.try_parse_json("fixed")))
    return shown.select("run_id", "idx", "thought", F.when(open_one, F.col("act")).alias("action"), F.when(open_one, given_value).alias("action_input"), "final_answer", "parse_error")


def call_signature(tool: Column, arguments: Column) -> Column:
    """tool(arguments) with the arguments as JSON, the keys of every object in order and values as they are written: "1" isn't 1."""
    return F.concat(tool, F.lit("("), F.coalesce(F.to_json(F.try_parse_json(arguments)), F.lit("{}")), F.lit(")"))


def loop_detect(steps: DataFrame, back: int = 3, times: int = 2) -> DataFrame:
    """steps (run_id, idx, signature) with loop: the signature occurs `times` or more among the `back` executed steps before it. A step without a
    signature, one that could not be parsed, wasn't executed: it doesn't count and has no loop."""
    executed = F.sum(F.col("signature").isNotNull().cast("int")).over(run_order().rowsBetween(Window.unboundedPreceding, -1))
    numbered = steps.withColumn("nth_executed", F.coalesce(executed, F.lit(0)))
    recent = Window.partitionBy("run_id").orderBy("nth_executed").rangeBetween(-back, -1)  # a failed step shares the number of the next executed one
    held = numbered.withColumn("recent", F.collect_list("signature").over(recent))
    loop = F.size(F.filter("recent", lambda s: s == F.col("signature"))) >= times
    return held.withColumn("loop", F.col("signature").isNotNull() & loop).drop("recent", "nth_executed")


def no_progress(steps: DataFrame, least: int = 3) -> DataFrame:
    """steps (run_id, idx, ok) with errors, the length of the run of failures that the step ends, and stuck, from `least` on."""
    group = steps.withColumn("island", F.sum(F.col("ok").cast("int")).over(run_order()))
    run = Window.partitionBy("run_id", "island").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    counted = group.withColumn("errors", F.sum((~F.col("ok")).cast("int")).over(run))
    return counted.withColumn("stuck", F.coalesce(F.col("errors") >= least, F.lit(False)) & ~F.col("ok")).drop("island")


def step_cost(tokens: Column) -> Column:
    return tokens / 1000 * COST_PER_1000


def run_outcome(steps: DataFrame, max_iterations: int = 10, max_cost: float = 1.0, deadline: float = 60.0) -> DataFrame:
    """(run_id, stop_reason, stop_idx): the first stop in turn order of steps (run_id, idx, tokens, seconds, final, parse_ok, ok, signature).
    Deadline and budget are checked before a step, strictly; max_iterations where nothing stops the run, or more steps follow."""
    before = run_order().rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    elapsed = F.coalesce(F.sum("seconds").over(before), F.lit(0.0))
    executed = steps.withColumns({"ok": F.col("ok") & F.col("parse_ok"), "signature": F.when(F.col("parse_ok"), F.col("signature"))})
    flagged = loop_detect(no_progress(executed)).withColumns({"spent": step_cost(spent), "elapsed": elapsed, "nth": F.row_number().over(run_order())})
    reason = (
        F.when(F.col("nth") > max_iterations, "max_iterations").when(F.col("elapsed") > deadline, "deadline_exceeded").when(F.col("spent") > max_cost, "budget_exceeded").when(F.col("final"), "final_answer")
        .when(~F.col("parse_ok") & F.col("stuck"), "no_progress").when(F.col("parse_ok") & F.col("loop"), "loop_detected").when(F.col("stuck"), "no_progress")
    )
    stops = flagged.withColumn("reason", reason).groupBy("run_id").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("idx", "reason"))).alias("stop"), F.max("idx").alias("last"))
    return stops.select("run_id", F.coalesce("stop.reason", F.lit("max_iterations")).alias("stop_reason"), F.coalesce("stop.idx", "last").alias("stop_idx"))


def run_summary(steps: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per run up to its stop: steps, tools in order of use, tokens, cost, seconds, success, and the last good observation, cut to 500 characters."""
    used = steps.join(outcomes, "run_id").filter(F.col("idx") <= F.col("stop_idx"))
    last = F.max(F.when(F.col("ok"), F.struct("idx", F.substring("content", 1, 500).alias("text")))).alias("best")
    held = used.groupBy("run_id", "stop_reason").agg(F.count("*").alias("steps"), F.array_sort(F.collect_list(F.struct("idx", "tool"))).alias("tools"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), last)
    return held.select("run_id", "stop_reason", "steps", F.array_join(F.transform("tools", lambda t: t["tool"]), ",").alias("tools"), "tokens", F.round(step_cost(F.col("tokens")), 8).alias("cost_usd"), F.round("seconds", 6).alias("seconds"), (F.col("stop_reason") == "final_answer").alias("succeeded"), F.col("best.text").alias("fallback"))


def tool_args_check(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """(call_id, error): the first fault of a call's arguments (call_id, tool, args JSON) against schema (tool, param, type, enum array, required), or null."""
    given = calls.select("call_id", "tool", F.explode_outer(F.from_json("args", "map<string,string>")).alias("param", "value"))
    typed = calls.select("call_id", F.try_parse_json("args").alias("tree"))
    named = given.filter("param is not null").join(typed, "call_id").withColumn("kind", F.schema_of_variant(F.try_variant_get("tree", F.concat(F.lit("$['"), "param", F.lit("']")), "variant")))
    wanted = F.broadcast(schema)
    missing = calls.select("call_id", "tool").join(wanted.filter("required"), "tool").join(given.select("call_id", "param"), ["call_id", "param"], "left_anti").groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_list("param")), ", ").alias("names"))
    unknown = named.join(schema, ["tool", "param"], "left_anti").groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_list("param")), ", ").alias("names"))
    fits = (
        F.when(F.col("type") == "integer", F.col("kind") == "BIGINT").when(F.col("type") == "number", F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE)"))
        .when(F.col("type") == "boolean", F.col("kind") == "BOOLEAN").when(F.col("type") == "string", F.col("kind") == "STRING").when(F.col("type") == "array", F.startswith("kind", F.lit("ARRAY"))).otherwise(F.lit(True))
    )
    checked = named.join(wanted, ["tool", "param"])
    fault = F.when(F.col("enum").isNotNull() & ~F.array_contains("enum", F.col("value")), F.concat("param", F.lit(" must be one of "), F.array_join("enum", ", "))).when(~fits, F.concat("param", F.lit(" must be of type "), "type"))
    wrong = checked.withColumn("fault", fault).filter("fault is not null").groupBy("call_id").agg(F.min(F.struct("param", "fault")).alias("f"))
    out = calls.select("call_id").join(missing.withColumnRenamed("names", "missing"), "call_id", "left").join(unknown.withColumnRenamed("names", "unknown"), "call_id", "left").join(wrong, "call_id", "left")
    return out.select("call_id", F.coalesce(F.concat(F.lit("missing required argument(s): "), "missing"), F.concat(F.lit("unknown argument(s): "), "unknown"), F.col("f.fault")).alias("error"))


def policy_decisions(calls: DataFrame, allowed: list[str] | None = None, denied: list[str] = (), dangerous: list[str] = (), max_calls: int = 50) -> DataFrame:
    """calls (run_id, seq, tool, approved) with decision and reason, in order: over the call limit, denied, not allowed, dangerous (approved or denied, by default denied), allowed.
    Refused calls don't count, so the limit is a count of those that would pass before."""
    tool = F.col("tool")
    shut = tool.isin(list(denied)) | (~tool.isin(list(allowed)) if allowed is not None else F.lit(False))
    agreed = F.coalesce("approved", F.lit(False))
    passes = ~shut & (~tool.isin(list(dangerous)) | agreed)
    before = F.coalesce(F.sum(passes.cast("int")).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    case = F.when(F.col("before") >= max_calls, F.struct(F.lit("blocked").alias("decision"), F.lit("call limit reached").alias("reason")))
    for when, decision, reason in ((tool.isin(list(denied)), "blocked", "denylisted"), (shut, "blocked", "not allowlisted"), (tool.isin(list(dangerous)) & agreed, "approved", "human-in-the-loop"), (tool.isin(list(dangerous)), "denied", "human-in-the-loop")):
        case = case.when(when, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason")))
    case = case.otherwise(F.struct(F.lit("allowed").alias("decision"), F.lit("").alias("reason")))
    return calls.withColumn("before", before).withColumn("d", case).select(*calls.columns, "d.decision", "d.reason")


def audit_log(decisions: DataFrame) -> DataFrame:
    """decisions (run_id, seq, ...) with the texts among their arguments (map<string,string>) masked like other personal data: card numbers
    only if they pass the Luhn check."""
    texts = decisions.select(F.struct("run_id", "seq").alias("call"), F.explode("arguments").alias("name", "value"))
    masked = pii_redact(texts.filter("value is not null").select(F.struct("call", "name").alias("at"), F.col("value").alias("text")), "at")
    named = masked.select("at.call", F.struct("at.name", "text").alias("entry")).groupBy("call").agg(F.map_from_entries(F.collect_list("entry")).alias("shown"))
    joined = decisions.join(named, F.struct("run_id", "seq") == F.col("call"), "left")
    shown = F.transform_values("arguments", lambda k, v: F.coalesce(F.try_element_at(F.col("shown"), k), v))
    return joined.withColumn("arguments", shown).select(*decisions.columns)


def audit_report(decisions: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row: events, allowed (approved too), blocked (denied too), injections. findings: audit rows of scanned outputs."""
    rows = decisions.select("decision", "reason")
    rows = rows if findings is None else rows.unionByName(findings.select("decision", "reason"))
    return rows.agg(F.count("*").alias("events"), F.count_if(F.col("decision").isin("allowed", "approved")).alias("allowed"), F.count_if(F.col("decision").isin("blocked", "denied")).alias("blocked"), F.count_if(F.startswith("reason", F.lit("injection in output"))).alias("injections"))

"""Prices, budgets and quotas of usage logs: usage (ts, tenant, model, input_tokens, output_tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rules import PRICES
from tessera.operators.folds import fold_in_order
from tessera.operators.periods import HOT_ROWS, split_hot, with_periods


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(model, input_usd, output_usd) per million tokens."""
    rows = [(m, float(i), float(o)) for m, (i, o) in (PRICES if prices is None else prices).items()]
    return spark.createDataFrame(rows, "model string, input_usd double, output_usd double")


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    spent = input_tokens / 1e6 * F.col("input_usd") + output_tokens / 1e6 * F.col("output_usd")
    return F.round(F.coalesce(spent, F.lit(0.0)), 8)


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost_usd and unknown_model; an unknown model costs nothing. The price table is small by nature: a row per model."""
    priced = usage.join(F.broadcast(prices), "model", "left")
    return priced.withColumns({"cost_usd": cost(F.col("input_tokens"), F.col("output_tokens")), "unknown_model": F.col("input_usd").isNull()}).drop("input_usd", "output_usd")


def request_projection(requests: DataFrame, prices: DataFrame, expected_output: int = 500) -> DataFrame:
    """(request_id, model, input_tokens, projected_usd) of requests (request_id, model, input_tokens[, max_tokens]): with max_tokens, or expected_output where there is none."""
    out = F.coalesce("max_tokens", F.lit(expected_output)) if "max_tokens" in requests.columns else F.lit(expected_output)
    return requests.join(F.broadcast(prices), "model", "left").select("request_id", "model", "input_tokens", cost(F.col("input_tokens"), out).alias("projected_usd"))


def spend_rollup(costs: DataFrame) -> DataFrame:
    """(level, name, requests, input_tokens, output_tokens, cost_usd) in total, by model and by tenant, in one pass."""
    name = F.coalesce("model", "tenant", F.lit("all"))
    level = F.when(F.grouping("model") == 0, "model").when(F.grouping("tenant") == 0, "tenant").otherwise("total")
    sets = costs.groupingSets([["model"], ["tenant"], []], "model", "tenant")
    return sets.agg(level.alias("level"), name.alias("name"), F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")).drop("model", "tenant")


def micro(usd: Column) -> Column:
    """Rounded to six digits as the nearest count of millionths. Costs have eight digits, so sums often lie halfway, and round() of the sum as it
    prints takes the other side there than a database that rounds the scaled number."""
    return F.round(usd * 1e6) / 1e6


def budget_preflight(calls: DataFrame, limit: float) -> DataFrame:
    """calls (tenant, ts, seq, projected_usd, cost_usd) with spent_before, what the tenant spent up to the call before, and over: whether the projected cost would
    pass the limit. A label only: all calls spend."""
    before = Window.partitionBy("tenant").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = calls.withColumn("spent_before", micro(F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0))))
    return spent.withColumn("over", micro(F.col("spent_before") + F.col("projected_usd")) > limit)


def budget_headroom(calls: DataFrame, limit: float) -> DataFrame:
    """Per tenant, of calls as in budget_preflight: spent, what remains of the limit, and the calls that would have passed it. What was spent is summed in the calls'
    order, as the last digit of a sum follows from it."""
    upto = Window.partitionBy("tenant").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = budget_preflight(calls, limit).withColumn("upto", F.sum("cost_usd").over(upto))
    labelled = summed.groupBy("tenant").agg(F.max_by("upto", F.struct("ts", "seq")).alias("s"), F.count_if("over").alias("over_calls"))
    return labelled.select("tenant", micro(F.col("s")).alias("spent_usd"), micro(F.greatest(F.lit(0.0), F.lit(limit) - F.col("s"))).alias("remaining_usd"), "over_calls")


def quota_admission(calls: DataFrame, limit: float, period_seconds: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """calls (tenant, ts, seq, amount) with admitted and spent: a tenant's period restarts at its first use after it ran out; a call is admitted if it fits, and only
    admitted calls spend.

    A tenant's calls are folded in order while they stream by. Of tenants of more than hot_rows calls the periods are found first, by
    doubled successors, and each period is folded by itself, so that such a tenant fills many tasks.
    """
    length = round(period_seconds * 1e6)

    def step(state, now, amount):
        since, spent = state or (None, 0.0)
        if since is None or now - since >= length:
            since, spent = now, 0.0
        fits = spent + amount <= limit
        spent += amount if fits else 0.0
        return (since, spent), (fits, round(spent, 6))

    timed = calls.select("tenant", "ts", F.col("seq").cast("long").alias("seq"), F.col("amount").cast("double").alias("amount"), F.unix_micros("ts").alias("micros"))
    made = {"admitted": T.BooleanType(), "spent": T.DoubleType()}
    few, hot = split_hot(timed, "tenant", hot_rows)
    folded = fold_in_order(few, "tenant", ["ts", "seq"], ["micros", "amount"], step, made)
    if hot is not None:
        own = with_periods(hot, "tenant", period_seconds).withColumn("period", F.struct("tenant", "since"))
        folded = folded.unionByName(fold_in_order(own, "period", ["ts", "seq"], ["micros", "amount"], step, made).select(*folded.columns))
    return folded.drop("micros")


def global_cutoff(calls: DataFrame, limit: float, period: str = "day") -> DataFrame:
    """calls (ts, seq, amount) with spent_before and admitted: within a period a call is admitted if it still fits, and only admitted calls spend.

    Up to a period's first refusal all calls are admitted, so sums say which: minutes first (a row per minute), then the calls of a
    minute. After it only calls up to what was left can be admitted: they alone are folded in order.
    """
    timed = calls.select("*", F.date_trunc("minute", "ts").alias("minute"), F.date_trunc(period, "ts").alias("period"))
    minutes = timed.groupBy("period", "minute").agg(F.sum("amount").alias("total"))
    earlier = Window.partitionBy("period").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = minutes.select("period", "minute", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("offset"))
    inside = Window.partitionBy("period", "minute").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = timed.join(offsets, ["period", "minute"]).withColumn("upto", F.round(F.col("offset") + F.sum("amount").over(inside), 6))
    first = summed.filter(F.col("upto") > limit).groupBy("period").agg(F.min(F.struct("ts", "seq", F.round(F.col("upto") - F.col("amount"), 6).alias("spent"))).alias("f"))
    placed = summed.join(first, "period", "left")
    open_still = F.col("f").isNull() | (F.struct("ts", "seq") < F.struct("f.ts", "f.seq"))
    before = placed.filter(open_still).select("ts", "seq", "amount", F.round(F.col("upto") - F.col("amount"), 6).alias("spent_before"), F.lit(True).alias("admitted"))
    after = placed.filter(~open_still).select("period", "ts", "seq", "amount", F.col("f.spent").alias("start"))

    def step(spent, start, amount):
        spent = start if spent is None else spent
        fits = round(spent + amount, 6) <= limit
        return round(spent + amount, 6) if fits else spent, (spent, fits)

    fit = F.round(F.col("start") + F.col("amount"), 6) <= limit
    folded = fold_in_order(after.filter(fit), "period", ["ts", "seq"], ["start", "amount"], step, {"spent_before": T.DoubleType(), "admitted": T.BooleanType()})
    shown = ["ts", "seq", "amount", "spent_before", "admitted"]
    # a call that never fits sees what the last admitted one before it left
    marks = folded.filter("admitted").select("period", "ts", "seq", F.round(F.col("spent_before") + F.col("amount"), 6).alias("left"), F.lit(None).cast("double").alias("amount"), "start")
    misfits = after.filter(~fit).select("period", "ts", "seq", F.lit(None).cast("double").alias("left"), "amount", "start").unionByName(marks)
    last = F.last("left", ignorenulls=True).over(Window.partitionBy("period").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    refused = misfits.withColumn("spent_before", F.coalesce(last, "start")).filter("amount is not null").select("ts", "seq", "amount", "spent_before", F.lit(False).alias("admitted"))
    return before.unionByName(folded.select(*shown)).unionByName(refused)

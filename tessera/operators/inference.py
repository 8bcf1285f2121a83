"""Batch inference through a caller's model, and typed rows from replies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import token_estimate
from tessera.operators.usage import usage_cost

FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"
ROUNDS = 3


def batch_complete(prompts: DataFrame, complete: Callable[[list[str]], list[str | Exception]], model: str, prices: DataFrame, concurrency: int = 8) -> DataFrame:
    """prompts (prompt_id, prompt) with reply, error, model, tokens and cost, `concurrency` partitions at a time. A prompt whose completion is an exception, or whose batch
    raises, stays as a row with the error."""
    kind = prompts.schema["prompt_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                said = complete(part["prompt"].tolist())
            except Exception as e:  # a failed batch is data, not the end of the job
                said = [e] * len(part)
            replies = [None if isinstance(x, Exception) else x for x in said]
            errors = [f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in said]
            yield pd.DataFrame({"prompt_id": part["prompt_id"], "prompt": part["prompt"], "reply": replies, "error": errors})

    done = prompts.select("prompt_id", "prompt").repartition(concurrency).mapInPandas(run, f"prompt_id {kind}, prompt string, reply string, error string")
    counted = done.withColumns({"model": F.lit(model), "input_tokens": token_estimate(F.col("prompt")), "output_tokens": F.coalesce(token_estimate(F.col("reply")), F.lit(0).cast("long"))})
    return usage_cost(counted, prices)


def fallback_fill(prompts: DataFrame, models: list[tuple[str, Callable[[list[str]], list[str | Exception]]]], prices: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Rows of the first model of the list that answers, with its name; those that none answers keep the last error. keep: stores a model's rows, so that it isn't asked twice."""
    done, left = None, prompts
    for i, (name, complete) in enumerate(models):
        tried = keep(batch_complete(left, complete, name, prices))
        settled = tried if i == len(models) - 1 else tried.filter("error is null")
        done = settled if done is None else done.unionByName(settled)
        left = tried.filter("error is not null").select("prompt_id", "prompt")
    return done


def _balanced(text: str | None) -> str | None:
    """The first balanced {...}, else [...], of a text; braces within strings don't count."""
    for pair in ("{}", "[]"):
        start = (text or "").find(pair[0])
        depth, at = 0, start
        while 0 <= at < len(text or ""):
            if text[at] == '"':
                closing = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL).match(text, at + 1)
                if not closing:
                    break
                at = closing.end()
                continue
            depth += (text[at] == pair[0]) - (text[at] == pair[1])
            at += 1
            if depth == 0:
                return text[start:at]
    return None


@F.pandas_udf(T.StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    return text.map(_balanced)


def repair_reply(text: Column) -> Column:
    """Python's literals, single quotes (where no double ones are) and trailing commas as JSON has them."""
    for word, json in (("True", "true"), ("False", "false"), ("None", "null")):
        text = F.regexp_replace(text, rf"\b{word}\b", json)
    quoted = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.replace(text, F.lit("'"), F.lit('"'))).otherwise(text)
    return F.regexp_replace(quoted, r",(\s*[}\]])", "$1")


def reply_json(replies: DataFrame) -> DataFrame:
    """replies (reply_id, text, ...) with json: the fenced block or first balanced value, as it is or repaired; null if it doesn't parse. Only replies without a fence are scanned in Python."""
    staged = replies.withColumn("fenced", F.nullif(F.trim(F.regexp_extract("text", FENCE, 1)), F.lit("")))
    scanned = balanced_json(F.when(F.col("fenced").isNull(), F.col("text")))
    both = staged.withColumn("candidate", F.coalesce("fenced", scanned, F.trim("text")))
    fixed = repair_reply(F.col("candidate"))
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return both.withColumn("json", F.when(valid(F.col("candidate")), F.col("candidate")).when(valid(fixed), fixed)).drop("fenced", "candidate")


def checked_replies(replies: DataFrame, schema: str) -> DataFrame:
    """(reply_id, row, reason): the typed row, or why there is none: truncated, no JSON, a field missing or of another type."""
    fields = T.StructType.fromDDL(schema).fields
    parsed = reply_json(replies).withColumn("row", F.from_json("json", schema))
    lacking = F.array_compact(F.array(*(F.when(F.col(f"row.`{f.name}`").isNull(), F.lit(f.name)) for f in fields)))
    reason = F.when(F.col("finish_reason") == "length", "truncated").when(F.col("json").isNull(), "no JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing or of another type: "), F.array_join(lacking, ", ")))
    return parsed.select("reply_id", "row", reason.alias("reason"))


def typed_replies(replies: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows (reply_id, columns of the schema) and bad ones (reply_id, reason)."""
    checked = checked_replies(replies, schema)
    return checked.filter("reason is null").select("reply_id", "row.*"), checked.filter("reason is not null").select("reply_id", "reason")


def structured_table(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], schema: str, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame]:
    """Typed rows and quarantine of prompts (reply_id, prompt): failed ones are asked again, up to three times in all, with the reason in the prompt; truncated ones fail at once.
    ask: from (reply_id, prompt) to (reply_id, text, finish_reason). keep: stores what a round's replies give, (reply_id, row, reason), so that they are asked for and parsed once."""
    good, bad, left = None, None, prompts
    for attempt in range(ROUNDS):
        checked = keep(checked_replies(ask(left), schema))
        fine, failed = checked.filter("reason is null").select("reply_id", "row.*"), checked.filter("reason is not null").select("reply_id", "reason")
        good = fine if good is None else good.unionByName(fine)
        ended = failed if attempt == ROUNDS - 1 else failed.filter("reason = 'truncated'")
        bad = ended if bad is None else bad.unionByName(ended)
        again = failed.filter("reason <> 'truncated'")
        left = left.join(again, "reply_id").select("reply_id", F.concat("prompt", F.lit("\nThe last reply was refused: "), "reason").alias("prompt"))
    return good, bad

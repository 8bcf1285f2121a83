"""Conversation history: messages (conv_id, turn, role, text)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import SUMMARY_PREFIX, TRUNCATED
from tessera.functions.text import CHARS_PER_TOKEN, token_estimate
from tessera.operators.embedding import memory_embed

def is_system() -> Column:
    return F.col("role") == "system"


def message_cost(text: Column) -> Column:
    """A quarter of the characters, and four tokens around the message."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN) + 4


def message_tokens(messages: DataFrame) -> DataFrame:
    """(conv_id, tokens, plain_tokens): estimates of at least one token a message, and without that floor, each with four more."""
    return messages.groupBy("conv_id").agg(F.sum(token_estimate(F.col("text")) + 4).alias("tokens"), F.sum(message_cost(F.col("text"))).alias("plain_tokens"))


def history_buffer(messages: DataFrame) -> DataFrame:
    """All messages with the tokens up to each."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("conv_id", "turn", "role", "text", F.sum(message_cost(F.col("text"))).over(upto).alias("tokens_upto"))


def _placed(kept: DataFrame) -> DataFrame:
    """Positions: system messages first, then by turn."""
    order = Window.partitionBy("conv_id").orderBy((~is_system()).cast("int"), "turn")
    return kept.select("conv_id", (F.row_number().over(order)).cast("long").alias("position"), "turn", "role", "text")


def history_window(messages: DataFrame, k: int = 10) -> DataFrame:
    """System messages and the last k others."""
    newest = F.row_number().over(Window.partitionBy("conv_id", is_system()).orderBy(F.desc("turn")))
    return _placed(messages.withColumn("nth", newest).filter(is_system() | (F.col("nth") <= k)).drop("nth"))


def history_token_window(messages: DataFrame, budget: int = 4000) -> DataFrame:
    """System messages and the newest others that fit into what those leave of the budget, up to the first that doesn't.
    Costs are positive, so the running sum tells the same."""
    cost = message_cost(F.col("text"))
    pinned = F.coalesce(F.sum(F.when(is_system(), cost)).over(Window.partitionBy("conv_id")), F.lit(0))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(is_system(), F.lit(0)).otherwise(cost)).over(newest)
    return _placed(messages.withColumns({"pinned": pinned, "used": used}).filter(is_system() | (F.col("used") <= budget - F.col("pinned"))).drop("pinned", "used"))


def history_budget(messages: DataFrame, budget: int = 8000, message_budget: int = 2000) -> DataFrame:
    """Long messages cut to message_budget tokens, then the token window."""
    limit = message_budget * CHARS_PER_TOKEN
    cut = F.when(F.length("text") > limit, F.concat(F.substring("text", 1, limit), F.lit(TRUNCATED))).otherwise(F.col("text"))
    return history_token_window(messages.withColumn("text", cut), budget)


def history_summarize(messages: DataFrame, summarize: Callable[[list[tuple[str, str]]], str], threshold: int = 2000, keep: int = 4) -> DataFrame:
    """What each conversation holds at its end, if after each message all but the last `keep` are folded into a summary once the tokens
    without system messages pass the threshold: (conv_id, position, role, text, summaries). Folds a conversation's messages in order."""
    kind = messages.schema["conv_id"].dataType.simpleString()

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("turn")
        pinned: list[tuple[str, str]] = []
        rest: list[tuple[str, str]] = []
        summary, times, size = "", 0, 0
        for role, text in zip(part["role"], part["text"], strict=True):
            text = text or ""
            if role == "system":
                pinned.append((role, text))
                older: list[tuple[str, str]] = []
            else:
                rest.append((role, text))
                size += len(text) // CHARS_PER_TOKEN + 4
            if size > threshold and len(rest) > keep:
                older, rest = rest[:-keep], rest[-keep:]
                summary = summarize([("assistant", SUMMARY_PREFIX + summary)] * bool(summary) + older)
                times += 1
                size = sum(len(t) // CHARS_PER_TOKEN + 4 for _, t in rest)
        shown = pinned + [("assistant", SUMMARY_PREFIX + summary)] * bool(summary) + rest
        rows = [(part["conv_id"].iloc[0], i, role, text, times) for i, (role, text) in enumerate(shown, 1)]
        return pd.DataFrame(rows, columns=["conv_id", "position", "role", "text", "summaries"])

    return messages.groupBy("conv_id").applyInPandas(fold, f"conv_id {kind}, position long, role string, text string, summaries long")


def history_recall(messages: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """(conv_id, turn, role, text) in order of time: the k other-than-system messages of a conversation nearest to its query (conv_id, text), of a score
    above 0; ties to the later message. System messages come with them."""
    said = messages.filter(~is_system()).select(F.struct("conv_id", "turn").alias("chunk_id"), "text")
    near = memory_embed(said, "chunk_id").withColumn("conv_id", F.col("chunk_id.conv_id"))
    asked = memory_embed(queries.select(F.col("conv_id").alias("query_id"), "text"), "query_id")
    met = near.join(asked.withColumnRenamed("weight", "q"), (near["conv_id"] == asked["query_id"]) & (near["bucket"] == asked["bucket"]))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score")).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_id.turn"))
    best = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select(F.col("query_id").alias("conv_id"), F.col("chunk_id.turn").alias("turn"))
    recalled = messages.join(best, ["conv_id", "turn"], "left_semi")
    pinned = messages.filter(is_system()).join(queries.select("conv_id").distinct(), "conv_id", "left_semi")
    return _placed(recalled.unionByName(pinned))


def split_system(messages: DataFrame) -> DataFrame:
    """Messages without a leading system message, which becomes the column `system` of its conversation."""
    conv = Window.partitionBy("conv_id")
    first = F.row_number().over(conv.orderBy("turn")) == 1
    marked = messages.withColumn("leads", first & is_system())
    return marked.withColumn("system", F.max(F.when(F.col("leads"), F.col("text"))).over(conv)).filter(~F.col("leads")).drop("leads")


def append_entries(entries: DataFrame, path: str) -> None:
    """Adds entries (tenant, conv_id, ts, seq, entry json) to the store under `path`, a folder of files for each tenant."""
    entries.select("tenant", "conv_id", "ts", "seq", "entry", F.lit(False).alias("cleared")).write.mode("append").partitionBy("tenant").parquet(path)


def clear_conversations(which: DataFrame, path: str) -> None:
    """Clears conversations (tenant, conv_id, ts, seq): what was said up to then is gone. A mark is appended; nothing is rewritten."""
    which.select("tenant", "conv_id", "ts", "seq", F.lit(None).cast("string").alias("entry"), F.lit(True).alias("cleared")).write.mode("append").partitionBy("tenant").parquet(path)


def history_store(entries: DataFrame, now: Column | None = None, keep: int = 40, hours: int = 24) -> DataFrame:
    """The newest `keep` entries (tenant, conv_id, ts, seq, entry json[, cleared]) of each conversation written to within `hours` before now (by default the last
    write of all). Entries that aren't objects with a role and content are skipped, and so are those not after the last mark that clears a conversation."""
    if "cleared" in entries.columns:
        last_clear = F.max(F.when(F.col("cleared"), F.struct("ts", "seq"))).over(Window.partitionBy("tenant", "conv_id"))
        marked = entries.withColumn("gone", last_clear)
        entries = marked.filter(~F.col("cleared") & (F.col("gone").isNull() | (F.struct("ts", "seq") > F.col("gone")))).drop("gone", "cleared")
    parsed = entries.withColumn("e", F.from_json("entry", "role string, content string", {"mode": "PERMISSIVE"})).filter(F.col("e.role").isNotNull() & F.col("e.content").isNotNull())
    by = Window.partitionBy("tenant", "conv_id")
    clock = parsed.agg(F.max("ts").alias("now")) if now is None else parsed.limit(1).select(now.alias("now"))
    newest = parsed.withColumns({"last": F.max("ts").over(by), "nth": F.row_number().over(by.orderBy(F.desc("ts"), F.desc("seq")))}).filter(F.col("nth") <= keep)
    live = newest.crossJoin(F.broadcast(clock)).filter(F.col("last") >= F.col("now") - F.expr(f"interval {hours} hours"))
    return live.select("tenant", "conv_id", "ts", "seq", F.col("e.role").alias("role"), F.col("e.content").alias("content"))

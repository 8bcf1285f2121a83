"""Retrieval and answer metrics per question, scorecards and comparisons.

golden: (query_id, question, expected_answer, markers array<string>, should_refuse); hits: (query_id, rank, text). A hit is relevant if
it contains a marker, whatever the case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import long_words, stepped_percentile_rank, tokens
from tessera.operators.search import first_number


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def judged_hits(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per question: markers, n hits, their relevances in rank order and the markers found."""
    text = F.lower("text")
    seen = hits.join(golden.select("query_id", "markers"), "query_id").select("query_id", "rank", F.filter("markers", lambda m: F.contains(text, F.lower(m))).alias("found"))
    held = seen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", (F.size("found") > 0).alias("rel")))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    every = golden.select("query_id", "markers").join(held, "query_id", "left")
    empty = F.array().cast("array<string>")
    rel = F.coalesce(F.transform("hits", lambda h: h["rel"].cast("int")), F.array().cast("array<int>"))
    return every.select("query_id", F.coalesce("markers", empty).alias("markers"), rel.alias("rel"), F.coalesce("found", empty).alias("found"))


def hit_rate() -> Column:
    return F.when(F.size("markers") == 0, 1.0).otherwise(F.when(F.array_contains("rel", 1), 1.0).otherwise(0.0))


def precision_at_k() -> Column:
    return _ratio(F.size(F.filter("rel", lambda r: r == 1)), F.size("rel"))


def recall_at_k() -> Column:
    return F.when(F.size("markers") == 0, 1.0).otherwise(_ratio(F.size(F.filter("markers", lambda m: F.array_contains("found", m))), F.size("markers")))


def mrr() -> Column:
    return _ratio(F.lit(1.0), F.nullif(F.array_position("rel", 1), F.lit(0)))


def ndcg_at_k() -> Column:
    gain = lambda rel: F.aggregate(F.transform(rel, lambda r, i: r / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    ideal = F.transform(F.slice("rel", 1, F.least(F.size("markers"), F.size("rel"))), lambda _: F.lit(1))
    return F.when((F.size("markers") == 0) | (F.size("rel") == 0), 0.0).otherwise(_ratio(gain(F.col("rel")), gain(ideal)))


RETRIEVAL: dict[str, Callable[[], Column]] = {"hit_rate": hit_rate, "precision_at_k": precision_at_k, "recall_at_k": recall_at_k, "mrr": mrr, "ndcg_at_k": ndcg_at_k}


def retrieval_metrics(golden: DataFrame, hits: DataFrame) -> DataFrame:
    return judged_hits(golden, hits).select("query_id", *(F.round(f(), 6).alias(name) for name, f in RETRIEVAL.items()))


def faithfulness(answers: DataFrame, contexts: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, faithfulness): the share of the answer's sentences of which half the longer words are in the context; no context: 0, but 1 without an answer."""
    known = contexts.select("query_id", F.array_distinct(tokens(F.col("context"))).alias("known"))
    claims = F.filter(F.split("answer", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    held = answers.join(known, "query_id", "left").withColumn("claims", F.transform(claims, long_words))
    backed = lambda words: (F.size(words) == 0) | (F.size(F.filter(words, lambda w: F.array_contains("known", w))) / F.size(words) >= least)
    share = F.when(F.size("claims") == 0, 1.0).otherwise(F.size(F.filter("claims", backed)) / F.greatest(F.size("claims"), F.lit(1)))
    blank = F.when(F.trim("answer") == "", 1.0).otherwise(0.0)
    return held.select("query_id", F.round(F.when(F.col("known").isNull(), blank).otherwise(share), 6).alias("faithfulness"))


def answer_relevance(question: Column, said: Column) -> Column:
    asked = F.array_distinct(long_words(question))
    return F.when(F.size(asked) == 0, 1.0).otherwise(_ratio(F.size(F.array_intersect(asked, tokens(said))), F.size(asked)))


def answer_correctness(expected: Column, said: Column) -> Column:
    """F1 of the sets of tokens."""
    a, b = F.array_distinct(tokens(said)), F.array_distinct(tokens(expected))
    return F.when(F.coalesce(expected, F.lit("")) == "", 1.0).otherwise(_ratio(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)))


def judge_faithfulness(answers: DataFrame, contexts: DataFrame, judge: Callable[[list[str], list[str]], list[str]]) -> DataFrame:
    """A tenth of the first number of a judge's reply on (context, answer), 1 at most, 0 without one."""

    @F.pandas_udf("string")
    def reply(context: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series(judge(context.tolist(), said.tolist()))

    score = F.least(F.lit(1.0), F.coalesce(first_number(reply("context", "answer")), F.lit(0.0)) / 10)
    return answers.join(contexts, "query_id").select("query_id", F.round(score, 6).alias("faithfulness"))


def evaluate(golden: DataFrame, hits: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """All metrics per question. answers: (query_id, answer, refused)."""
    joined = golden.join(retrieval_metrics(golden, hits), "query_id", "left").join(answers, "query_id", "left").join(faithfulness(answers, contexts), "query_id", "left")
    said, refused = F.coalesce("answer", F.lit("")), F.coalesce("refused", F.lit(True))
    return joined.select(
        "query_id", *RETRIEVAL, F.coalesce("faithfulness", F.lit(1.0)).alias("faithfulness"), F.round(answer_relevance(F.col("question"), said), 6).alias("answer_relevance"),
        F.round(answer_correctness(F.col("expected_answer"), said), 6).alias("answer_correctness"), refused.alias("refused"), (refused == F.col("should_refuse")).alias("refusal_correct"),
    )


def scorecard(results: DataFrame, metrics: list[str], by: str = "config", latency: str | None = None) -> DataFrame:
    """Per config: n, means of the metrics, share of refusals that are right, and the p50 latency, at rank floor(n / 2) + 1."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    right = [F.round(F.avg(F.col("refusal_correct").cast("int")), 6).alias("refusal_accuracy")] if "refusal_correct" in results.columns else []
    card = results.groupBy(by).agg(F.count("*").alias("n"), *means, *right)
    if latency is None:
        return card
    n = F.count("*").over(Window.partitionBy(by))
    ranked = results.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(latency))).withColumn("of", n)
    p50 = ranked.filter(F.col("nth") == stepped_percentile_rank(F.col("of"), 0.5)).select(by, F.col(latency).alias("p50_latency"))
    return card.join(p50, by)


def failures(results: DataFrame, metric: str, threshold: float) -> DataFrame:
    return results.filter(F.col(metric) < threshold)


def compare_configs(results: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """(metric, one column per config): means."""
    every = None
    for name, r in results.items():
        part = r.select(F.lit(name).alias("config"), *metrics)
        every = part if every is None else every.unionByName(part)
    long = every.unpivot("config", metrics, "metric", "value")
    return long.groupBy("metric").pivot("config", [*results]).agg(F.round(F.avg("value"), 6))


#: Markers looked for at once, and their characters: an automaton takes about 50 bytes for each.
MARKERS, MARKER_CHARS = 100_000, 1 << 22


def _held_in(columns: Iterator[pa.Array], markers: Iterable[str]) -> set[str]:
    """The markers that some text of the columns holds. One text at a time is a Python string."""
    import ahocorasick

    search = ahocorasick.Automaton()
    for marker in markers:
        search.add_word(marker, marker)
    search.make_automaton()
    seen = {m for m in markers if not m}
    for column in columns:
        for text in column if len(search) else ():
            seen.update(m for _, m in search.iter(text.as_py()))
    return seen


def markers_found(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """The query_ids of markers (query_id, marker) that occur in some text (text), in any case. A task looks for all markers in one pass of each of
    its texts; more than MARKERS of them, or MARKER_CHARS of their characters, are looked for in turns."""
    kind = markers.schema["query_id"].dataType.simpleString()
    low = texts.select(F.lower("text").alias("low")).filter("low is not null")
    n, chars = markers.agg(F.count("*"), F.coalesce(F.sum(F.length("marker")), F.lit(0))).first()
    turns = max(1, math.ceil(n / MARKERS), math.ceil(chars / MARKER_CHARS))
    out = None
    for turn in range(turns):
        some = markers if turns == 1 else markers.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        held: dict[str, list] = {}
        for r in some.select("query_id", F.lower("marker").alias("marker")).toLocalIterator():
            held.setdefault(r["marker"], []).append(r["query_id"])
        wanted = texts.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            left = wanted.value
            ids = [q for m in _held_in((batch.column(0) for batch in batches), left) for q in left[m]]
            yield pa.RecordBatch.from_pydict({"query_id": ids}, schema=pa.schema([pa.field("query_id", ARROW.get(kind, pa.string()))]))

        found = low.mapInArrow(run, f"query_id {kind}")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

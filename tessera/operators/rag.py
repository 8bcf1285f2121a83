"""The retrieval pipeline over tables of questions: ingest, gate, budget, context, answers and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import NO_ANSWER
from tessera.functions.text import CHARS_PER_TOKEN, dot, strip, text_hash, unit
from tessera.operators.search import hybrid_topk


def ingest(docs: DataFrame, known: DataFrame, chunk: Callable[[DataFrame], DataFrame], old_chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of new or changed documents with those of unchanged ones, the new (source, content_hash) table, and one row of counts.
    known: (source, content_hash) so far. Chunks of a changed document replace its old ones."""
    hashed = docs.withColumn("content_hash", text_hash(F.col("text")))
    old = known.select("source", F.col("content_hash").alias("old_hash"))
    seen = hashed.join(old, "source", "left").withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("old_hash")))
    fresh = chunk(seen.filter("changed").drop("content_hash", "old_hash", "changed"))
    kept = fresh if old_chunks is None else old_chunks.join(seen.filter("changed").select("source").distinct(), "source", "left_anti").unionByName(fresh)
    stats = seen.agg(F.count_if("changed").alias("documents"), F.count_if(~F.col("changed")).alias("skipped")).crossJoin(fresh.agg(F.count("*").alias("chunks")))
    state = seen.select("source", "content_hash").unionByName(known.join(seen.select("source"), "source", "left_anti").select("source", "content_hash"))
    return kept, state, stats.select("documents", "chunks", "skipped")


def retrieve(questions: DataFrame, dense: Callable[[DataFrame, int], DataFrame], bm25: Callable[[DataFrame, int], DataFrame] | None = None, rerank: Callable[[DataFrame, int], DataFrame] | None = None, k: int = 3, fetch: int = 20) -> DataFrame:
    """k hits of each question by vectors alone, or fused with BM25 where it is given, each `fetch` deep. With a reranker `fetch` hits are taken, of which
    it keeps k. dense, bm25: from questions (query_id, text) and a number to hits; rerank: from hits and a number to hits."""
    wide = k if rerank is None else fetch
    found = dense(questions, wide) if bm25 is None else hybrid_topk(dense(questions, fetch), bm25(questions, fetch), wide)
    return found if rerank is None else rerank(found, k)


def relevance_gate(questions: DataFrame, hits: DataFrame, query_vectors: DataFrame, vectors: DataFrame, least: float = 0.05) -> DataFrame:
    """(query_id, relevance, refused): the best cosine of a question to its retrieved chunks, not below 0; refused without chunks or below `least`."""
    asked = query_vectors.select("query_id", unit(F.col("vector")).alias("q"))
    met = hits.join(vectors.select("chunk_id", unit(F.col("vector")).alias("v")), "chunk_id").join(asked, "query_id")
    best = met.groupBy("query_id").agg(F.round(F.greatest(F.max(dot(F.col("v"), F.col("q"))), F.lit(0.0)), 6).alias("relevance"))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("relevance", F.lit(0.0)).alias("relevance"), (F.coalesce("relevance", F.lit(0.0)) < least).alias("refused"))


def fit_to_budget(hits: DataFrame, chunks: DataFrame, budget: int, least: int = 50) -> DataFrame:
    """Hits taken in rank order while they fit into `budget` tokens; one that doesn't is passed over while `least` tokens remain, else it ends the list.
    A fold over each query's ranked hits."""
    cost = F.greatest(F.lit(1), (F.length("text") / CHARS_PER_TOKEN).cast("int"))
    listed = hits.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", cost.alias("cost"), "score"))).alias("hits"))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("ended"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, h: Column) -> Column:
        fits = ~acc["ended"] & (acc["used"] + h["cost"] <= budget)
        ends = acc["ended"] | (~fits & (F.lit(budget) - acc["used"] < least))
        return F.struct(F.when(fits, acc["used"] + h["cost"]).otherwise(acc["used"]).alias("used"), ends.alias("ended"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    folded = listed.withColumn("taken", F.aggregate("hits", start, step)["taken"])
    kept = folded.select("query_id", F.explode(F.filter(F.zip_with("hits", "taken", lambda h, t: F.when(t, h)), lambda h: h.isNotNull())).alias("h"))
    return kept.select("query_id", "h.chunk_id", F.col("h.rank").alias("rank"), "h.score", F.col("h.cost").cast("long").alias("tokens"))


def format_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): blocks `[i] (heading path or source)`, the text below, a blank line between."""
    label = F.coalesce(F.nullif("heading_path", F.lit("")), "source")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    numbered = hits.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "text", label.alias("label")), "chunk_id").withColumn("i", place)
    block = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] ("), "label", F.lit(")\n"), "text")
    blocks = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", block.alias("block")))).alias("blocks"))
    return blocks.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("context"))


def prompt_tokens(questions: DataFrame, hits: DataFrame, chunks: DataFrame, system_prompt: str) -> DataFrame:
    """(query_id, tokens): a token for every four characters of chunks, question and system prompt together."""
    chars = hits.join(chunks.select("chunk_id", F.length("text").alias("n")), "chunk_id").groupBy("query_id").agg(F.sum("n").alias("n"))
    total = F.coalesce("n", F.lit(0)) + F.length("text") + len(system_prompt)
    return questions.select("query_id", "text").join(chars, "query_id", "left").select("query_id", F.floor(total / CHARS_PER_TOKEN).alias("tokens"))


def answer(questions: DataFrame, gate: DataFrame, contexts: DataFrame, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """(query_id, answer, refused): a caller's model on the prompts of questions that aren't refused."""
    open_ones = questions.join(gate.filter("not refused").select("query_id"), "query_id").join(contexts, "query_id")
    prompts = open_ones.select("query_id", F.concat(F.lit("Sources:\n"), "context", F.lit("\n\nQuestion: "), "text").alias("prompt"))
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"query_id": part["query_id"], "answer": complete(part["prompt"].tolist()), "refused": False})

    said = prompts.mapInPandas(run, f"query_id {kind}, answer string, refused boolean")
    silent = questions.select("query_id").join(said.select("query_id"), "query_id", "left_anti").select("query_id", F.lit(NO_ANSWER).alias("answer"), F.lit(True).alias("refused"))
    return said.unionByName(silent)


def grounded_answer(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, answer): the source sentence that shares most words of over three letters with the question, the earliest of equals, with its citation."""
    long_words = lambda words: F.filter(words, lambda w: F.length(w) > 3)
    asked = questions.select("query_id", F.array_distinct(long_words(F.split(F.replace(F.lower(strip(F.substring_index("text", "\n", 1))), F.lit("?"), F.lit("")), r"\s+"))).alias("asked"))
    ranked = hits.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", F.col("rank"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")).alias("place", "sentence"))
    bare = F.transform(F.filter(F.split("sentence", r"\s+"), lambda w: F.length(w) > 3), lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", ""))
    scored = ranked.join(asked, "query_id").withColumn("overlap", F.size(F.array_intersect("asked", bare)))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "place"))
    best = scored.withColumn("nth", first).filter("nth = 1 and overlap > 0")
    said = best.select("query_id", F.concat(strip(F.col("sentence")), F.lit(". ["), F.col("rank").cast("string"), F.lit("]")).alias("answer"))
    return questions.select("query_id").join(said, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"))


def citation_check(answers: DataFrame) -> DataFrame:
    """Of (query_id, answer, n_sources): cited, dangling and uncited numbers, whether all cited exist and whether any is cited."""
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))))
    available = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_sources").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    found = answers.select("query_id", cited.alias("cited"), available.alias("available"))
    return found.select("query_id", "cited", F.array_except("cited", "available").alias("dangling"), F.array_except("available", "cited").alias("uncited"), (F.size(F.array_except("cited", "available")) == 0).alias("valid"), (F.size("cited") > 0).alias("has_citations"))


def ordered_sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, sources): each source once, in order of its first rank."""
    first = hits.join(chunks.select("chunk_id", "source"), "chunk_id").groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    held = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("held"))
    return held.select("query_id", F.transform("held", lambda x: x["source"]).alias("sources"))


def corpus_stats(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, embedder: str, dims: int, hit_rate: float = 0.0) -> DataFrame:
    counts = docs.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(vectors.agg(F.count_distinct("chunk_id").alias("vectors")))
    return counts.select("documents", "chunks", "vectors", F.lit(embedder).alias("embedder"), F.lit(dims).cast("long").alias("dims"), F.lit(hit_rate).alias("cache_hit_rate"))

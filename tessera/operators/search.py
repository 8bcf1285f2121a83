"""Search: BM25, exact and clustered vector search, fusion, diversity, reranking and small-to-big.

Hits are rows (query_id, chunk_id, rank, score); ties go to the smaller chunk_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.counting import counted_terms
from tessera.functions.rules import BULLETS, NUMBER
from tessera.functions.text import strip, tokens, unit
from tessera.sources.scratch import stored
from tessera.sources.store import append_rows

K1, B = 1.5, 0.75
RRF_CONSTANT = 60
#: Queries that are broadcast to the vectors at once.
BROADCAST_QUERIES = 5_000
#: Vectors of a block that meets a block of queries, and cells of a score matrix made at once.
BLOCK_VECTORS, CELLS = 32_768, 1 << 21
#: Chunks whose terms are looked up at once.
SCORED_ROWS = 1024
#: Pages whose counts are scored at once; terms of up to so many letters are counted one by one.
SCORED_PAGES, SHORT_TERM = 512, 2
#: Terms asked for, up to which they are broadcast to the postings.
BROADCAST_TERMS = 200_000


def top_k(scored: DataFrame, k: int, *ties: Column) -> DataFrame:
    order = [F.desc("score"), *(ties or (F.col("chunk_id"),))]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


@dataclass
class Bm25Index:
    """postings (chunk_id, term, tf, dl), terms (term, df), stats (n, avgdl: one row) and, where chunks are at hand as they were counted, those: (chunk_id, dl, terms)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    counted: DataFrame | None = None


def bm25_index(chunks: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> Bm25Index:
    """A chunk's terms are counted in its row, so only the terms' document frequencies are shuffled. keep: writes the counted chunks
    somewhere and returns them, so that they aren't made again for each part of the index."""
    counted = chunks.select("chunk_id", counted_terms(F.col("text")).alias("counted")).select("chunk_id", "counted.dl", "counted.terms")
    counted = counted if keep is None else keep(counted)
    postings = counted.select("chunk_id", "dl", F.explode("terms").alias("p")).select("chunk_id", "p.term", "p.tf", "dl")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))  # a term has one posting per chunk
    return Bm25Index(postings, terms, counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), counted)


def bm25_idf(index, asked: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) of the index's terms, or of those asked for, unseen ones included. index: with terms and stats."""
    terms = index.terms if asked is None else asked.select("term").distinct().join(index.terms, "term", "left").fillna(0, ["df"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.crossJoin(F.broadcast(index.stats)).select("term", "df", idf.alias("idf"))


def bm25_topk(queries: DataFrame, index: Bm25Index, k: int = 5, among: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each query (query_id, text) of a score above 0; a repeated query term counts again; `among` (chunk_id) restricts first.

    Up to BROADCAST_TERMS terms asked for are broadcast with their weights. Chunks at hand as counted are scored where they stand, and a task keeps its k best of each
    query, so that only these are shuffled; postings alone, or met by more terms, are joined and summed. So frequent terms are no hot keys."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if few and index.counted is not None:
        counted = index.counted if among is None else index.counted.join(among, "chunk_id", "left_semi")
        return top_k(_bm25_in_place(asked, index, counted, k), k).select("query_id", "chunk_id", "rank", "score")
    small = F.broadcast if few else (lambda df: df)
    postings = index.postings if among is None else index.postings.join(among, "chunk_id", "left_semi")
    weighed = small(asked.select("term").distinct()).join(bm25_idf(index, asked), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    length = 1 - B + B * F.coalesce(F.try_divide(F.col("dl"), F.col("avgdl")), F.lit(1.0))
    weight = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * length)
    scaled = postings.join(small(weighed.select("term", "idf", "avgdl")), "term").select("chunk_id", "term", weight.alias("w"))
    scored = scaled.join(small(asked), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("times")), 6).alias("score"))
    return top_k(scored.filter("score > 0"), k).select("query_id", "chunk_id", "rank", "score")


class AskedTerms:
    """Terms with the queries (numbers below `queries`) that ask for them, each with a weight; scores of rows of counted terms."""

    def __init__(self, terms: pa.Array, query: np.ndarray, weight: np.ndarray, queries: int):
        coded = terms.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        self.terms, self.query, self.weight, self.queries = coded.dictionary, query[order], weight[order], queries
        self.times = np.bincount(number, minlength=len(self.terms))
        self.first = np.cumsum(self.times) - self.times

    def scores(self, dl: np.ndarray, terms: pa.ListArray, avgdl: float) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores [row, query]) of blocks of rows: a block has up to CELLS scores, and products, unless one row has more."""
        flat, sizes = terms.flatten(), terms.value_lengths().to_numpy(zero_copy_only=False)
        found = pc.index_in(flat.field(0), value_set=self.terms)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        row, term, tf = np.repeat(np.arange(len(sizes)), sizes)[at], found.to_numpy(zero_copy_only=False)[at].astype(int), flat.field(1).to_numpy(zero_copy_only=False)[at]
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)[row])
        products = np.concatenate([[0], np.cumsum(np.bincount(row, self.times[term], len(sizes)).astype(int))])  # before each row
        ends, a, step = np.searchsorted(row, np.arange(len(sizes) + 1)), 0, max(1, CELLS // self.queries)
        while a < len(sizes):
            b = max(a + 1, min(a + step, int(np.searchsorted(products, products[a] + CELLS, "right")) - 1))
            p = slice(ends[a], ends[b])
            n = self.times[term[p]]
            each = np.repeat(self.first[term[p]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cells = np.repeat(row[p] - a, n) * self.queries + self.query[each]
            yield a, np.bincount(cells, np.repeat(impact[p], n) * self.weight[each], (b - a) * self.queries).reshape(b - a, self.queries)
            a = b


def _bm25_in_place(asked: DataFrame, index: Bm25Index, counted: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): of each task the k best chunks of each query of asked (query_id, term, times), of BROADCAST_TERMS rows at most."""
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", counted.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    wanted = F.broadcast(asked.select("term").distinct())  # document frequencies of these alone
    found = Bm25Index(index.postings, index.postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), index.stats)
    weighed = asked.join(bm25_idf(found, asked), "term").select("query_id", F.struct("term", (F.col("times") * F.col("idf")).alias("weight")).alias("w"))
    table = weighed.groupBy("query_id").agg(F.collect_list("w").alias("w")).toArrow()
    if not table.num_rows:
        return counted.sparkSession.createDataFrame([], schema)
    held, avgdl = counted.sparkSession.sparkContext.broadcast(table), index.stats.first()["avgdl"] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, best, ids_of = held.value.column("w").combine_chunks(), None, None
        n, flat = len(lists), lists.flatten()
        query = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        terms = AskedTerms(flat.field(0), query, flat.field(1).to_numpy(zero_copy_only=False), n)
        for batch in (whole.slice(a, SCORED_ROWS) for whole in batches for a in range(0, whole.num_rows, SCORED_ROWS)):
            best = best or Best(np.zeros((n, 0)), None, k, False, 0.0)
            ids, ids_of = batch.column(0).to_pylist(), batch.column(0).type
            for a, raw in terms.scores(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2), avgdl):
                best.keep(ids, np.arange(a, a + len(raw)), np.arange(n), raw, np.round(raw, 6))
        if best is not None:
            at, ids, scores = best.columns()
            asking = held.value.column("query_id").combine_chunks().take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([asking, pa.array(ids, ids_of), pa.array(scores, pa.float64())], names=schema.names)

    return counted.select("chunk_id", "dl", "terms").mapInArrow(run, schema)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of lists of numbers, or of lists of (bucket, weight); nulls and what is missing are 0."""
    sizes = np.nan_to_num(np.array(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
    rows, out, flat = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(sizes), dims)), column.flatten()
    if pa.types.is_struct(flat.type):
        out[rows, flat.field(0).to_numpy(zero_copy_only=False).astype(int)] = flat.field(1).to_numpy(zero_copy_only=False)
    else:
        places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = places < dims
        out[rows[inside], places[inside]] = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float))[inside]
    return out


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class Best:
    """The k best of what each query has met so far. Queries: [query, dimension]; on: a value that a vector must share."""

    def __init__(self, queries: np.ndarray, on: np.ndarray | None, k: int, positive: bool, least: float | None):
        self.queries, self.k, self.positive, self.least = queries, k, positive, least
        everyone = np.arange(len(queries))
        self.groups = {None: everyone} if on is None else {x: everyone[on == x] for x in set(on.tolist())}
        self.scores: list[list[float]] = [[] for _ in everyone]
        self.ids: list[list] = [[] for _ in everyone]

    def add(self, ids: list, vectors: np.ndarray, on: np.ndarray | None) -> None:
        step = max(1, CELLS // max(1, len(self.queries)))
        for x in [None] if on is None else set(on.tolist()):
            asking = self.groups.get(x)
            rows = np.arange(len(ids)) if on is None else np.flatnonzero(on == x)
            for a in range(0, len(rows) if asking is not None else 0, step):
                some = rows[a : a + step]
                raw = vectors[some] @ self.queries[asking].T
                self.keep(ids, some, asking, raw, np.round(raw, 6) + 0.0)

    def keep(self, ids: list, rows: np.ndarray, asking: np.ndarray, raw: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(raw > 0, scores, -np.inf) if self.positive else scores
        scores = scores if self.least is None else np.where(scores > self.least, scores, -np.inf)
        floor = np.partition(scores, -self.k, axis=0)[-self.k] if len(rows) > self.k else np.full(len(asking), -np.inf)
        for j, q in enumerate(asking.tolist()):
            near = np.flatnonzero((scores[:, j] >= max(floor[j], self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf)) & (scores[:, j] > -np.inf))
            if len(near):
                both = sorted(zip((-scores[near, j]).tolist() + [-s for s in self.scores[q]], [ids[i] for i in rows[near].tolist()] + self.ids[q], strict=True))[: self.k]
                self.scores[q], self.ids[q] = [-s for s, _ in both], [i for _, i in both]

    def columns(self) -> tuple[list[int], list, list[float]]:
        return [q for q, s in enumerate(self.scores) for _ in s], [i for x in self.ids for i in x], [s for x in self.scores for s in x]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, dims: int, on: str | None = None, cosine: bool = True, positive: bool = False, least: float | None = None) -> DataFrame:
    """Top k by inner product of queries (query_id, q) over vectors (chunk_id, v), both lists of numbers or of (bucket, weight), by matrix products on
    Arrow batches: cosine scales both to unit length first. A query is sent the vectors that share its `on`; positive: only products above 0 count.

    Up to BROADCAST_QUERIES queries are broadcast and each task keeps its k best of each. More go in rounds of so many, each of which reads the vectors once and
    shuffles only the best; with `on` the rows of a value meet in blocks of vectors and queries, so a vector is copied once for each block of queries of its own value.
    """
    keys = [on] if on else []
    scale = _unit_rows if cosine else (lambda m: m)
    kinds = {c: (vectors if c == "chunk_id" else queries).schema[c].dataType for c in ("query_id", "chunk_id", *keys)}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in ("query_id", "chunk_id", *keys)), T.StructField("score", T.DoubleType())])
    asked, there = queries.select("query_id", "q", *keys), vectors.select("chunk_id", "v", *keys)

    def values(table, c: str) -> np.ndarray | None:
        return np.array(table.column(c).to_pylist(), object) if keys else None

    def found(best: Best, asking: pa.Table, ids_of: pa.DataType) -> pa.RecordBatch:
        at, ids, scores = best.columns()
        own = [asking.column(c).combine_chunks().take(pa.array(at, pa.int64())) for c in ("query_id", *keys)]
        return pa.RecordBatch.from_arrays([own[0], pa.array(ids, ids_of), *own[1:], pa.array(scores, pa.float64())], names=schema.names)

    def by_broadcast(some: DataFrame) -> DataFrame:
        table = queries.sparkSession.sparkContext.broadcast(some.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking, best, ids_of = table.value, None, None
            for batch in batches:
                if best is None:
                    best, ids_of = Best(scale(_matrix(asking.column("q").combine_chunks(), dims)), values(asking, on), k, positive, least), batch.column(0).type
                best.add(batch.column(0).to_pylist(), scale(_matrix(batch.column(1), dims)), values(batch, on))
            if best is not None:
                yield found(best, asking, ids_of)

        return there.mapInArrow(run, schema)

    n = asked.limit(BROADCAST_QUERIES + 1).count()
    if not n:
        scored = there.sparkSession.createDataFrame([], schema)
    elif n <= BROADCAST_QUERIES:
        scored = by_broadcast(asked)
    elif not on:
        rounds = math.ceil(asked.count() / BROADCAST_QUERIES)
        asked = stored(asked.withColumn("round", F.pmod(F.xxhash64("query_id"), F.lit(rounds))), "queries")
        best = [stored(top_k(by_broadcast(asked.filter(F.col("round") == r).drop("round")), k), "best") for r in range(rounds)]
        scored = reduce(DataFrame.union, best)
    else:
        sizes = lambda df, most, name: df.groupBy(F.col(on).alias("__on")).agg(F.ceil(F.count("*") / most).cast("long").alias(name))
        blocks = stored(sizes(there, BLOCK_VECTORS, "vectors").join(sizes(asked, BROADCAST_QUERIES, "queries"), "__on"), "blocks")  # a row for each value
        deal = lambda c, count: F.pmod(F.xxhash64(c), F.col(count))
        copies = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
        dealt = lambda df: df.join(blocks, F.col(on) == F.col("__on"))
        left = dealt(there).withColumns({"gb": F.xxhash64(on), "vb": deal("chunk_id", "vectors")}).withColumn("qb", copies("queries"))
        right = dealt(asked).withColumns({"gb": F.xxhash64(on), "qb": deal("query_id", "queries")}).withColumn("vb", copies("vectors"))

        def meet(near: pa.Table, asking: pa.Table) -> pa.Table:
            best = Best(scale(_matrix(asking.column("q").combine_chunks(), dims)) if asking.num_rows else np.zeros((0, dims)), values(asking, on), k, positive, least)
            if near.num_rows and asking.num_rows:
                best.add(near.column("chunk_id").to_pylist(), scale(_matrix(near.column("v").combine_chunks(), dims)), values(near, on))
            return pa.Table.from_batches([found(best, asking, near.column("chunk_id").type)])

        own = lambda df, *made: df.select(*(F.col(c).alias(c) for c in (*made, *keys, "gb", "vb", "qb"))).groupBy("gb", "vb", "qb")
        scored = own(left, "chunk_id", "v").cogroup(own(right, "query_id", "q")).applyInArrow(meet, schema)
    return top_k(scored, k).select("query_id", "chunk_id", *keys, "rank", "score")


def sparse_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, least: float | None = None, dims: int = 256) -> DataFrame:
    """Top k by dot product of queries (query_id, entries) and vectors (chunk_id, entries) of `dims` buckets, of pairs that share a bucket."""
    return nearest(queries.withColumnRenamed("entries", "q"), vectors.withColumnRenamed("entries", "v"), k, dims=dims, cosine=False, positive=True, least=least)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, where: Column | None = None, on: str | None = None) -> DataFrame:
    """Exact top k by cosine of queries (query_id, vector) over vectors (chunk_id, vector). `where` filters vectors before they are ranked; `on`,
    a column of both such as a tenant, has to be shared, so that no other value's rows can appear."""
    wanted = vectors if where is None else vectors.filter(where)
    dims = queries.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    return nearest(queries.withColumnRenamed("vector", "q"), wanted.withColumnRenamed("vector", "v"), k, dims=max(1, dims), on=on)


def rrf_fuse(rankings: list[DataFrame], constant: int = RRF_CONSTANT) -> DataFrame:
    """Hits of all rankings by the sum of 1 / (constant + rank); ties by the first list and rank they were seen at."""
    listed = [r.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    both = listed[0]
    for r in listed[1:]:
        both = both.unionByName(r)
    first = F.min(F.struct("list", "rank"))
    fused = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.col("rank") + constant)), 9).alias("score"), first.alias("first"))
    return top_k(fused, 2**31 - 1, F.col("first"), F.col("chunk_id")).select("query_id", "chunk_id", "rank", "score")


def hybrid_topk(dense_hits: DataFrame, bm25_hits: DataFrame, k: int = 5) -> DataFrame:
    """Fused dense and BM25 hits, each of which its caller fetched deep enough, cut to k."""
    return rrf_fuse([dense_hits, bm25_hits]).filter(F.col("rank") <= k)


def mmr(hits: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 5, balance: float = 0.5) -> DataFrame:
    """k hits of each query, greedily by balance * relevance - (1 - balance) * similarity to those chosen; the score is the relevance.
    A query's candidates are the short list it comes with."""
    short = hits.join(vectors.select("chunk_id", F.col("vector").alias("v")), "chunk_id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id").select("query_id", "chunk_id", "rank", "v", "q")
    kind = ", ".join(f"{c} {hits.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "chunk_id"])
        v, q = np.stack(part["v"].to_numpy()).astype(float), np.asarray(part["q"].iloc[0], float)
        relevance, alike = v @ q, v @ v.T
        chosen = [int(relevance.argmax())]
        while len(chosen) < min(k, len(part)):
            gain = balance * relevance - (1 - balance) * alike[:, chosen].max(1)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        out = part.iloc[chosen][["query_id", "chunk_id"]]
        return out.assign(rank=np.arange(1, len(chosen) + 1), score=np.round(relevance[chosen], 6))

    return short.groupBy("query_id").applyInPandas(choose, f"{kind}, rank long, score double")


def first_number(reply: Column) -> Column:
    """The first number in a text, or null."""
    return F.nullif(F.regexp_extract(reply, NUMBER, 1), F.lit("")).try_cast("double")


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, judge: Callable[[list[str], list[str]], list[str]], k: int = 5) -> DataFrame:
    """Hits by the first number of a judge's reply on (query, first 1500 characters of the chunk), 0 without one; ties keep their order."""
    pairs = hits.join(chunks.select("chunk_id", F.substring("text", 1, 1500).alias("passage")), "chunk_id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")

    @F.pandas_udf("string")
    def reply(question: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(judge(question.tolist(), passage.tolist()))

    scored = pairs.withColumn("score", F.coalesce(first_number(reply("question", "passage")), F.lit(0.0))).withColumnRenamed("rank", "before")
    return top_k(scored, k, F.col("before")).select("query_id", "chunk_id", "rank", "score")


def multi_query(queries: DataFrame, rewrite: Callable[[list[str]], list[str]], retrieve: Callable[[DataFrame], DataFrame], n: int = 3) -> DataFrame:
    """Fused hits of each query and up to n variants: lines of the rewriter's reply, bullets and blanks at their ends stripped, blank ones dropped. retrieve: from (query_id, text) to hits."""

    @F.pandas_udf("string")
    def reply(text: pd.Series) -> pd.Series:
        return pd.Series(rewrite(text.tolist()))

    line = F.transform(F.split(reply("text"), "\n"), lambda x: strip(F.regexp_replace(x, BULLETS, "")))
    variants = F.slice(F.filter(line, lambda x: x != ""), 1, n)
    every = queries.select("query_id", F.posexplode(F.concat(F.array("text"), variants)).alias("variant", "text"))
    found = retrieve(every.select(F.struct("query_id", "variant").alias("query_id"), "text"))
    listed = found.select("query_id.query_id", "chunk_id", "rank", F.col("query_id.variant").alias("list"))
    fused = listed.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.col("rank") + RRF_CONSTANT)), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return top_k(fused, 2**31 - 1, F.col("first"), F.col("chunk_id")).select("query_id", "chunk_id", "rank", "score")


def hyde(queries: DataFrame, write: Callable[[list[str]], list[str]], retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hits of a hypothetical passage written in place of each question."""

    @F.pandas_udf("string")
    def passage(text: pd.Series) -> pd.Series:
        return pd.Series(write(text.tolist()))

    return retrieve(queries.select("query_id", passage("text").alias("text")))


def parent_child(child_hits: DataFrame, children: DataFrame, parents: DataFrame, k: int = 5) -> DataFrame:
    """Parents of child hits, each with the score of its best child; a child without a parent id stands for itself, and one whose parent is missing too."""
    owned = child_hits.join(children.select("chunk_id", "parent_id"), "chunk_id", "left").withColumn("parent_id", F.coalesce("parent_id", "chunk_id"))
    first = Window.partitionBy("query_id", "parent_id").orderBy("rank", "chunk_id")
    best = owned.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    named = best.join(parents.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("found")), "parent_id", "left")
    shown = named.select("query_id", F.when(F.col("found"), F.col("parent_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "score", F.col("rank").alias("before"))
    return top_k(shown, k, F.col("before")).select("query_id", "chunk_id", "rank", "score")


def term_count_search(queries: DataFrame, pages: DataFrame, limit: int = 3) -> DataFrame:
    """Pages (page_id, title, body) by the occurrences of the query's terms (with their repetitions) as substrings; ties by title, then body, falling.

    Up to BROADCAST_TERMS terms are broadcast; a task looks for all of them in one pass of each of its pages and keeps the `limit` best pages of each
    query. More terms than that are dealt to blocks, each of which all pages meet. Texts leave the pages only once they are found.
    """
    asked = queries.select("query_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    hay = pages.select("page_id", "title", "body", F.lower(F.concat_ws(" ", "title", "body")).alias("hay"))
    n_terms = asked.count()
    blocks = max(1, math.ceil(n_terms / BROADCAST_TERMS))
    kinds = {"query_id": queries.schema["query_id"].dataType, "page_id": pages.schema["page_id"].dataType, "title": pages.schema["title"].dataType, "body": pages.schema["body"].dataType}
    schema = T.StructType([*(T.StructField(c, t) for c, t in kinds.items()), T.StructField("score", T.LongType())])
    out = None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held: dict[str, list[tuple]] = {}
        for query_id, term, times in some.select("query_id", "term", "times").toLocalIterator():
            held.setdefault(term, []).append((query_id, times))
        found = hay.mapInPandas(_count_terms(pages.sparkSession.sparkContext.broadcast(held), limit, list(schema.names)), schema) if held else hay.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out, limit, F.desc("title"), F.desc("body"), F.col("page_id")).select("query_id", "page_id", "title", "body", "rank", "score")


class PageTerms:
    """Terms that are looked for in pages at once: short ones, which occur everywhere, by counting each, the others in one pass of a page."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms = terms
        self.short = [(i, term) for i, term in enumerate(terms) if len(term) <= SHORT_TERM]
        self.search = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            if len(term) > SHORT_TERM:
                self.search.add_word(term, (i, len(term)))
        self.search.make_automaton()

    def counts(self, hay: str) -> dict[int, int]:
        """Occurrences that don't overlap of each term that occurs."""
        found = {i: n for i, term in self.short if (n := hay.count(term))}
        free: dict[int, int] = {}  # where a term may occur next
        for end, (i, length) in self.search.iter(hay) if len(self.search) else ():
            if end - length >= free.get(i, -1):
                free[i] = end
                found[i] = found.get(i, 0) + 1
        return found


def _count_terms(asked, limit: int, names: list[str]):
    """asked: term to (query_id, times). The counts of SCORED_PAGES pages meet the queries in one product of matrices; whole numbers below 2^53 are exact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = sorted({q for wanted in asked.value.values() for q, _ in wanted}, key=str)
        number, known, best = {q: i for i, q in enumerate(queries)}, PageTerms([*asked.value]), [[] for _ in queries]
        term, query, times = (np.array(x) for x in zip(*((t, number[q], n) for t, wanted in enumerate(asked.value.values()) for q, n in wanted), strict=True))
        order = np.lexsort((query, term))
        term, query, times = term[order], query[order], times[order].astype(float)
        first = np.searchsorted(term, np.arange(len(known.terms) + 1))
        most = max(1, min(SCORED_PAGES, CELLS // len(queries)))
        for part in (whole.iloc[a : a + most] for whole in batches for a in range(0, len(whole), most)):
            counted = [known.counts(hay) for hay in part["hay"]]
            at, of = (np.fromiter(x, int) for x in ((t for c in counted for t in c), (i for i, c in enumerate(counted) for _ in c)))
            n = np.fromiter((x for c in counted for x in c.values()), float)
            scores, by_term = np.zeros((len(part), len(queries))), np.argsort(at, kind="stable")
            met, begins = np.unique(at[by_term], return_index=True)
            for t, rows in zip(met, np.split(by_term, begins[1:]), strict=True) if len(met) else ():
                asking = slice(first[t], first[t + 1])
                scores[np.ix_(of[rows], query[asking])] += np.outer(n[rows], times[asking])
            shown = [*part[["page_id", "title", "body"]].itertuples(index=False, name=None)]
            for q in np.flatnonzero(scores.any(axis=0)):
                each, kept = scores[:, q], best[q]
                least = max(1.0, np.partition(each, -limit)[-limit] if len(each) > limit else 1.0, kept[limit - 1][0] if len(kept) >= limit else 1.0)
                near = np.flatnonzero(each >= least)
                if len(near):
                    kept += [(int(each[i]), *shown[i]) for i in near]
                    kept.sort(key=lambda x: (x[1] is not None, x[1]))
                    kept.sort(key=lambda x: (x[0], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""), reverse=True)  # equal ones stay in the order of their ids
                    del kept[limit:]
        rows = [(q, page_id, title, body, score) for q, kept in zip(queries, best, strict=True) for score, page_id, title, body in kept]
        yield pd.DataFrame(rows, columns=names)

    return run


@dataclass
class IvfIndex:
    """centroids [list, dimension] (a bounded matrix) and vectors (chunk_id, vector of unit length, list_id), read from files by list."""

    centroids: np.ndarray
    vectors: DataFrame


def _nearest_lists(centroids: np.ndarray, n: int):
    """A column function: the n lists nearest to a unit vector, by falling cosine; batches of vectors meet the bounded matrix of centroids."""

    @F.pandas_udf("array<int>")
    def lists(v: pd.Series) -> pd.Series:
        cosines = np.round(np.stack(v.to_numpy()).astype(float) @ centroids.T, 9) if len(v) else np.zeros((0, len(centroids)))
        return pd.Series([*np.argsort(-cosines, axis=1, kind="stable")[:, :n].astype("int32")])

    return lists


def ivf_build(vectors: DataFrame, path: str, n_lists: int = 16, rounds: int = 10, fit_rows: int = 100_000) -> IvfIndex:
    """A clustered index under `path`: a folder of files for each list, that is each centroid's vectors.

    Spherical k-means on a sample of about fit_rows vectors (all, if there are fewer), by a hash of the id: at most `rounds` rounds, an empty list
    keeps its centroid, stops when centroids stay. Only centroids reach the driver. Every vector is then put into the list of its nearest one.
    """
    spark, total = vectors.sparkSession, vectors.count()
    place = F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.filter(place < fit_rows / max(total, 1)).select("chunk_id", unit(F.col("vector")).alias("vector")).persist()
    try:
        seeds = sample.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n_lists).collect()
        centroids = np.array([r["vector"] for r in seeds])
        for _ in range(rounds if len(seeds) else 0):
            moved = _mean_of_lists(sample, centroids)
            still, centroids = np.allclose(moved, centroids, atol=1e-9), moved
            if still:
                break
    finally:
        sample.unpersist()
    first = F.get(_nearest_lists(centroids, 1)(F.col("vector")), 0) if len(centroids) else F.lit(0)
    listed = vectors.withColumn("vector", unit(F.col("vector"))).withColumn("list_id", first)
    listed.repartition("list_id", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, total // (n_lists * BLOCK_VECTORS))))).write.partitionBy("list_id").parquet(f"{path}/vectors")
    listing = spark.createDataFrame([(i, [*map(float, c)]) for i, c in enumerate(centroids)], "list_id int, centroid array<double>")
    listing.write.parquet(f"{path}/centroids")
    return ivf_open(spark, path)


def ivf_open(spark: SparkSession, path: str) -> IvfIndex:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list_id"])
    return IvfIndex(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/vectors"))


def _mean_of_lists(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The unit means of the vectors nearest to each centroid; sums are made in the tasks, a row per list and task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            m = _matrix(batch.column(0), centroids.shape[1])
            own = np.round(m @ centroids.T, 9).argmax(1)
            np.add.at(total, own, m)
            n += np.bincount(own, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array([*total], pa.list_(pa.float64())), pa.array(n)], names=["list_id", "total", "n"])

    moved = np.zeros_like(centroids)
    for r in sample.select("vector").mapInArrow(sums, "list_id int, total array<double>, n long").collect():  # lists x tasks rows
        moved[r["list_id"]] += np.array(r["total"])
    length = np.linalg.norm(moved, axis=1, keepdims=True)
    return np.where(length > 1e-12, moved / np.maximum(length, 1e-12), centroids)


def ivf_probes(queries: DataFrame, index: IvfIndex, n_probe: int) -> DataFrame:
    """(query_id, list_id, q): the n_probe lists nearest to each query."""
    asked = queries.select("query_id", unit(F.col("vector")).alias("q"))
    return asked.withColumn("list_id", F.explode(_nearest_lists(index.centroids, n_probe)(F.col("q"))))


def ivf_search(queries: DataFrame, index: IvfIndex, k: int = 10, n_probe: int = 3, where: Column | None = None) -> DataFrame:
    """Top k within the n_probe lists nearest to each query. Only lists that some query probes are read, and a query meets only the vectors of its own."""
    if not len(index.centroids):
        return queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("score")).filter("false")
    probes = ivf_probes(queries, index, n_probe)
    wanted = [r["list_id"] for r in probes.select("list_id").distinct().collect()]  # at most all lists
    vectors = index.vectors.filter(F.col("list_id").isin(wanted))
    vectors = vectors if where is None else vectors.filter(where)
    found = nearest(probes, vectors.withColumnRenamed("vector", "v"), k, dims=index.centroids.shape[1], on="list_id", cosine=False)
    return top_k(found.select("query_id", "chunk_id", "score"), k).select("query_id", "chunk_id", "rank", "score")


def ivf_recalls(queries: DataFrame, index: IvfIndex, k: int = 10) -> DataFrame:
    """(n_probe, recall) for every number of probes, by one exact search: a hit is found by as many probes as its list's place among those nearest to the query."""
    n_lists = len(index.centroids)
    exact = vector_topk(queries, index.vectors.select("chunk_id", "vector"), k).select("query_id", "chunk_id")
    weighed = exact.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("query_id")))
    places = queries.select("query_id", F.posexplode(_nearest_lists(index.centroids, n_lists)(unit(F.col("vector")))).alias("place", "list_id"))
    placed = weighed.join(index.vectors.select("chunk_id", "list_id"), "chunk_id").join(places, ["query_id", "list_id"])
    sums = placed.groupBy("place").agg(F.sum("weight").alias("weight"))
    all_places = queries.sparkSession.range(n_lists).select(F.col("id").cast("int").alias("place")).join(sums, "place", "left")  # a row for each list
    upto, whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = F.coalesce(F.sum("weight").over(upto), F.lit(0.0)) / F.sum("weight").over(whole)
    return all_places.select((F.col("place") + 1).alias("n_probe"), F.round(F.coalesce(part, F.lit(1.0)), 6).alias("recall"))


def ivf_calibrate(index: IvfIndex, path: str, k: int = 10, recall: float = 0.93, rows: int = 1000) -> int:
    """The least number of probes that finds `recall` of the exact hits of a sample of about `rows` vectors, kept in the index's folder `path`."""
    total = index.vectors.count()
    place = F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = stored(index.vectors.filter(place < rows / max(total, 1)).select(F.col("chunk_id").alias("query_id"), "vector"), "sample")
    measured = stored(ivf_recalls(sample, index, k), "recalls")
    measured.write.mode("overwrite").parquet(f"{path}/recalls")
    enough = measured.filter(F.col("recall") >= recall).agg(F.min("n_probe")).first()[0]
    return enough or max(1, len(index.centroids))


def ivf_scanned(queries: DataFrame, index: IvfIndex, n_probe: int) -> DataFrame:
    """One row: the share of all vectors that a query meets, on average."""
    sizes = index.vectors.groupBy("list_id").agg(F.count("*").alias("n"))
    met = ivf_probes(queries, index, n_probe).join(F.broadcast(sizes), "list_id", "left").groupBy("query_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return met.agg(F.avg("n").alias("n")).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("of")))).select(F.round(F.try_divide("n", "of"), 6).alias("scanned"))


def ann_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the mean over queries of the share of exact hits found; 1 if there are none."""
    found = exact.join(approximate.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    each = found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return each.agg(F.round(F.coalesce(F.avg("recall"), F.lit(1.0)), 6).alias("recall"), F.count("*").alias("queries"))


def index_size(vectors: DataFrame) -> DataFrame:
    """One row: vectors, dims and the size of float32 vectors in a unit by steps of 1024, with one decimal."""
    n = vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("long").alias("dims")).withColumn("bytes", F.col("vectors") * F.col("dims") * 4)
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    shown = F.lit(None).cast("string")
    for i, name in reversed([*enumerate(units)]):
        at = F.format_string(f"%.1f {name}", F.col("bytes") / float(1024**i))
        shown = F.when(F.col("bytes") < 1024 ** (i + 1), at).otherwise(shown) if i < len(units) - 1 else at
    return n.withColumn("size", shown)


def rank_compare(rankings: dict[str, DataFrame], chunks: DataFrame, markers: DataFrame) -> DataFrame:
    """Per retriever: queries whose marker (query_id, marker) occurs in a hit, those with it at rank 1, and the mean reciprocal rank."""
    shown = [hits.select("query_id", "chunk_id", "rank", F.lit(name).alias("retriever")) for name, hits in rankings.items()]
    every = shown[0]
    for s in shown[1:]:
        every = every.unionByName(s)
    marked = every.join(chunks.select("chunk_id", "text"), "chunk_id").join(markers, "query_id").filter(F.contains(F.lower("text"), F.lower("marker")))
    first = marked.groupBy("retriever", "query_id").agg(F.min("rank").alias("rank"))
    names = F.explode(F.array(*map(F.lit, rankings))).alias("retriever")
    grid = markers.select("query_id").distinct().select("query_id", names).join(first, ["retriever", "query_id"], "left")
    return grid.groupBy("retriever").agg(
        F.count("*").alias("queries"), F.count("rank").alias("found"), F.count_if(F.col("rank") == 1).alias("first"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    )


def checked_vectors(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """chunks with their vectors; fails where a chunk has no vector, a vector no chunk, or another dimension."""
    both = chunks.join(vectors.select("chunk_id", "vector"), "chunk_id", "full")
    whole = F.assert_true(F.coalesce(F.size("vector") == dims, F.lit(False)) & F.col("text").isNotNull(), F.concat(F.lit("no text, or no vector of the right dimension: "), F.col("chunk_id").cast("string")))
    return both.filter(whole.isNull())


def vector_append(chunks: DataFrame, vectors: DataFrame, dims: int, path: str, by: str = "tenant") -> None:
    """Adds chunks with their vectors to the store under `path` (see tessera.sources.store), a folder of files for each `by`. Readers see all of them or none;
    nothing is committed if the check fails. Rows are deleted by `delete_rows` of the store."""
    append_rows(checked_vectors(chunks, vectors, dims), path, by)


def vector_lookup(store: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("chunk_id").join(store.select("chunk_id", "vector"), "chunk_id")

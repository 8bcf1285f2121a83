"""Exact top-k inner products by norm buckets.

Vectors are grouped by length; a query's least score to beat, first taken from the longest vectors, gives each bucket a local
cosine threshold: the score over the product of the query's length and the bucket's longest. Above 1 the bucket is skipped. High
thresholds prune by coordinates (a unit vector so near the query's must be near it in each coordinate), low ones by length (shorter
vectors can't reach the score); what is left is verified by exact products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read

#: Vectors of one block of candidates, at least and at most, and of one block of queries. Larger blocks are fewer copies of both sides.
CANDIDATES, MOST_CANDIDATES, QUERIES = 8192, 65_536, 65_536
#: Longest vectors that give every query its first score to beat; they reach the driver.
SEEDS = 1024
#: Local threshold from which coordinates prune, and coordinates looked at.
STEEP, FOCUS = 0.6, 4
#: Cells of a score matrix made at once.
CELLS = 1 << 21


def _matrix(rows: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers: by floating-point numbers where every sum is below 2**53, else by 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width and len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * width >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Bucket:
    """Candidates by falling length, with the order of each coordinate of their directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.linalg.norm(vectors, axis=1)
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self.unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Candidates whose direction may have that cosine: the smallest of the feasible ranges of the focus coordinates, cut by the others."""
        found = None
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            if f >= self.unit.shape[1]:
                continue
            if f not in self.by_coordinate:
                order = np.argsort(self.unit[:, f], kind="stable")
                self.by_coordinate[f] = order, self.unit[order, f]
            order, values = self.by_coordinate[f]
            middle, reach = direction[f] * cosine, math.sqrt(max(0, (1 - cosine**2) * (1 - direction[f] ** 2)))
            low = middle - reach - 1e-9 if direction[f] - 1e-9 > -cosine or reach else -1.0
            high = middle + reach + 1e-9
            if direction[f] >= cosine:
                high = 1.0 + 1e-9
            if direction[f] <= -cosine:
                low = -1.0 - 1e-9
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if found is None or b - a < found[1] - found[0]:
                found = a, b, order
        return np.arange(len(self.ids)) if found is None else np.sort(found[2][found[0] : found[1]])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, vector, score) of each query's k best here that reach its floor."""
        out: list[tuple[int, int, int]] = []
        lengths = np.linalg.norm(queries, axis=1)
        longest = self.lengths[0] if len(self.lengths) else 0.0
        product = lengths * longest
        threshold = np.where(product > 0, floor / np.maximum(product, 1e-300), np.where(floor > 0, np.inf, -np.inf))
        steep = (threshold >= STEEP) & (threshold <= 1 + 1e-9)
        for i in np.flatnonzero(steep):
            rows = self.near(queries[i] / lengths[i], min(1.0, threshold[i]))
            rows = rows[(self.lengths[rows] * lengths[i] >= floor[i] - 1e-6 * abs(floor[i])) & (self.ids[rows] != query_ids[i])]
            scores = _exact(queries[i : i + 1], self.vectors[rows])[0]
            reach = scores >= floor[i]
            rows, scores = rows[reach], scores[reach]
            out += [(int(query_ids[i]), int(self.ids[rows[j]]), int(scores[j])) for j in _best(scores, self.ids[rows], k)]
        flat = np.flatnonzero(threshold < STEEP)
        step = max(1, CELLS // max(1, len(self.ids)))
        for a in range(0, len(flat), step):
            some = flat[a : a + step]
            # the prefix of vectors long enough for the least demanding of these queries
            need = np.where(lengths[some] > 0, floor[some] / np.maximum(lengths[some], 1e-300), -np.inf).min()
            prefix = int(np.searchsorted(-self.lengths, -(need - 1e-6 * abs(need)), "right")) if need > 0 else len(self.ids)
            scores = _exact(queries[some], self.vectors[:prefix])
            for row, i in zip(scores, some, strict=True):
                keep = np.flatnonzero((row >= floor[i]) & (self.ids[:prefix] != query_ids[i]))
                if len(keep) > 4 * k:
                    least = np.partition(row[keep], -k)[-k]
                    keep = keep[row[keep] >= least]
                out += [(int(query_ids[i]), int(self.ids[keep[j]]), int(row[keep[j]])) for j in _best(row[keep], self.ids[keep], k)]
        return out


def one_per_id(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the least of the vectors of an id. Vectors move only if an id is repeated."""
    repeated = checkpoint(vectors.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if not repeated.limit(1).count():
        return vectors.select("vec_id", "v")
    once = vectors.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return vectors.join(repeated, "vec_id", "left_anti").select("vec_id", "v").unionByName(once)


def top_k_products(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products of each query, ties to the smaller vec_id.

    Both tables have vec_id long and v array<double> of whole numbers below 2**53; a row is no candidate of its own id. An id counts
    once on either side: of repeated rows one, of different vectors of an id the least, compared number by number. Vectors of different
    lengths meet in the coordinates both have. Queries with fewer than k candidates get them all; no rows, no result. Fails with
    ValueError where the longest vectors could give a score beyond 64 bits. Queries are matched with all candidates, block by
    block: each block of one norm bucket meets each block of queries that may still find a score in it.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sized = checkpoint(one_per_id(vectors).select("vec_id", "v", norm.alias("norm")))
    # Buckets: lengths within a quarter of a power of two, dealt to blocks by the id.
    bucket = F.when(F.col("norm") > 0, F.floor(4 * F.log2("norm"))).otherwise(-1).cast("int")
    counts = sized.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    if not counts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = checkpoint(one_per_id(queries).select("vec_id", "v", norm.alias("norm")))
    if max(r["longest"] for r in counts) * (asked.agg(F.max("norm")).first()[0] or 0.0) >= float(1 << 63):
        raise ValueError("scores of these vectors don't fit into 64 bits")
    block = sum(r["n"] for r in counts) // (4 * vectors.sparkSession.sparkContext.defaultParallelism)
    block = min(MOST_CANDIDATES, max(CANDIDATES, block))  # fewer copies of the queries, while all cores have work
    counts = sorted((r["bucket"], max(1, math.ceil(r["n"] / block)), r["longest"]) for r in counts)  # at most one row per bucket: a few thousand
    seeds = [(r["vec_id"], r["v"]) for r in sized.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()]
    seed_ids, seed_vectors = np.array([i for i, _ in seeds]), _matrix(pd.Series([v for _, v in seeds]))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = np.full(len(part), -np.inf)
            q = _matrix(part["v"])
            for a in range(0, len(part), 1024):
                scores = _exact(q[a : a + 1024], seed_vectors).astype(float)
                scores[part["vec_id"].to_numpy()[a : a + 1024, None] == seed_ids[None]] = -np.inf
                if scores.shape[1] >= k:
                    out[a : a + 1024] = np.partition(scores, -k, axis=1)[:, -k]
            yield part.assign(floor=out)

    asked = checkpoint(asked.mapInPandas(floors, "vec_id long, v array<double>, norm double, floor double"))
    query_blocks = max(1, math.ceil(asked.count() / QUERIES))
    blocks = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("blocks"), F.lit(float(longest)).alias("longest")) for b, n, longest in counts))
    open_to = F.filter(blocks, lambda b: F.col("floor") <= F.col("norm") * b["longest"] * (1 + 1e-9))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    sent = asked.withColumn("qb", deal(F.lit(query_blocks), 1)).withColumn("b", F.explode(open_to)).select("vec_id", "v", "floor", "qb", F.col("b.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("cb"))
    blocks_of = F.try_element_at(F.create_map(*(x for b, n, _ in counts for x in (F.lit(b), F.lit(n)))), F.col("bucket"))
    there = sized.withColumn("bucket", bucket).withColumn("cb", deal(blocks_of, 2)).select("vec_id", "v", "bucket", "cb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def meet(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(asking):
            found = Bucket(candidates["vec_id"].to_numpy(), _matrix(candidates["v"])).search(asking["vec_id"].to_numpy(), _matrix(asking["v"]), asking["floor"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    by = ["bucket", "cb", "qb"]
    found = there.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 * x) of each component as a double; vectors that are null or hold a null or non-finite component are left out."""
    x = embeddings.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.col("vec_id").isNotNull()).select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("double")).alias("v"))


def op8_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"))
    return top_k_products(vectors, vectors.filter("vec_id % 50 = 0"))


OP8_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

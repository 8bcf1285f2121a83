"""Queries of search, the retrieval pipeline and its evaluation: the benchmark's texts asked over the chunked documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import embedding, evaluation, postings, rag, search
from tessera.operators.chunking import chunk_fixed
from tessera.plans.base import Plans, chunks_sql, documents, query_vectors, questions, read, vectors
from tessera.sources.scratch import fresh_path, stored
from tessera.sources.store import delete_rows, read_store

plans = Plans()
add = plans.add

BM25_OF_SQL = """
words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {source}),
postings AS (SELECT chunk_id, len(w) AS dl, t AS term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS t FROM words) GROUP BY chunk_id, len(w), t),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark) GROUP BY ALL),
bm25_scored AS (SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN terms USING (term) CROSS JOIN stats GROUP BY ALL),
bm25_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25_scored WHERE score > 0)""".strip()
BM25_SQL = f"{chunks_sql()},\n{BM25_OF_SQL.format(source='chunks')}"
KIDS_SQL = chunks_sql(300, 0).replace("SELECT doc_id, source, text, unnest", "SELECT chunk_id AS doc_id, source, text, unnest").replace("FROM documents", "FROM chunks").replace("chunks AS (", "kids AS (")
for _step in ("windows", "pieces", "stripped", "numbered"):
    KIDS_SQL = KIDS_SQL.replace(_step, f"kid_{_step}")
PARENT_SQL = f"""{chunks_sql(1200, 0)}, {KIDS_SQL}, {BM25_OF_SQL.format(source="kids")},
owned AS (SELECT r.query_id, k.doc_id AS chunk_id, r.score, r.rank AS before FROM bm25_ranked r JOIN kids k USING (chunk_id) WHERE r.rank <= 9 QUALIFY row_number() OVER (PARTITION BY r.query_id, k.doc_id ORDER BY r.rank) = 1)"""
EMBED = """{name}_ones AS (SELECT id, unnest(w) AS t, 1.0 AS n FROM ({source}) UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 0.5 FROM ({source}) WHERE len(w) > 1),
{name}_weights AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 256 AS bucket, 1 + ln(CAST(sum(n) AS DOUBLE)) AS weight FROM {name}_ones GROUP BY id, bucket),
{name}_vectors AS (SELECT id, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS weight FROM {name}_weights)"""
DENSE_SQL = f"""{EMBED.format(name="c", source="SELECT chunk_id AS id, w FROM words")},
{EMBED.format(name="q", source="SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark")},
dense_scored AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.weight * c.weight), 6) AS score FROM q_vectors q JOIN c_vectors c USING (bucket) GROUP BY ALL),
dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_scored)"""
FUSED_SQL = """listed AS (SELECT query_id, chunk_id, rank, 0 AS list FROM dense_ranked WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm25_ranked WHERE rank <= 20),
fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM listed GROUP BY ALL),
fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fused)"""
HYBRID_SQL = f"{BM25_SQL}, {DENSE_SQL}, {FUSED_SQL}"
HITS_SQL = f"{BM25_SQL}, hits AS (SELECT query_id, chunk_id, rank, score FROM bm25_ranked WHERE rank <= 5)"
#: The golden set: items that no document has are to be refused, and have no markers.
GOLDEN_SQL = """present AS (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
golden AS (SELECT b.item_id AS query_id, b.text AS question, b.text AS expected_answer, CASE WHEN p.item_id IS NULL THEN [] ELSE [b.text] END AS markers, p.item_id IS NULL AS should_refuse
  FROM benchmark b LEFT JOIN present p USING (item_id))"""
JUDGED_SQL = f"""{HITS_SQL}, {GOLDEN_SQL},
rel AS (SELECT g.query_id, g.markers, h.rank, len(list_filter(g.markers, lambda m: contains(lower(c.text), lower(m)))) > 0 AS rel FROM golden g LEFT JOIN hits h USING (query_id) LEFT JOIN chunks c USING (chunk_id)),
judged AS (SELECT query_id, any_value(len(markers)) AS m, count(rank) AS k, coalesce(sum(CAST(rel AS INT)), 0) AS good, min(rank) FILTER (rel) AS first, coalesce(sum(CAST(rel AS INT) / log2(rank + 1)), 0) AS dcg FROM rel GROUP BY query_id),
metrics AS (SELECT query_id, CASE WHEN m = 0 OR good > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, CASE WHEN k = 0 THEN 0.0 ELSE round(good / k, 6) END AS precision_at_k,
  CASE WHEN m = 0 OR good > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_at_k, round(coalesce(1.0 / first, 0), 6) AS mrr, CASE WHEN m = 0 OR k = 0 THEN 0.0 ELSE round(dcg, 6) END AS ndcg_at_k FROM judged)"""


class Corpus:
    """The documents in chunks, and what searches need of them, each written once, where a query first asks for it."""

    def __init__(self, spark: SparkSession, d: str, size: int = 1200, overlap: int = 150) -> None:
        self.spark, self.d, self.size, self.overlap = spark, d, size, overlap

    @cached_property
    def chunks(self) -> DataFrame:
        return stored(chunk_fixed(documents(self.spark, self.d), self.size, self.overlap), "chunks")

    @cached_property
    def index(self) -> search.Bm25Index:
        return search.bm25_index(self.chunks, lambda df: stored(df, "terms"))

    @cached_property
    def vectors(self) -> DataFrame:
        return stored(embedding.hash_vectors(self.chunks, "chunk_id"), "vectors")

    @cached_property
    def questions(self) -> DataFrame:
        return questions(self.spark, self.d)

    def bm25(self, k: int = 5, asked: DataFrame | None = None) -> DataFrame:
        return search.bm25_topk(self.questions if asked is None else asked, self.index, k)

    def dense(self, k: int = 20, asked: DataFrame | None = None) -> DataFrame:
        return search.sparse_topk(embedding.hash_vectors(self.questions if asked is None else asked, "query_id"), self.vectors, k)

    @cached_property
    def hits(self) -> DataFrame:
        return stored(self.bm25(), "hits")

    def shown_hits(self) -> DataFrame:
        return self.hits.join(self.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "text")

    def contexts(self) -> DataFrame:
        return rag.format_context(self.hits, self.chunks)

    def grounded(self) -> DataFrame:
        return rag.grounded_answer(self.questions, self.hits, self.chunks)

    def cited_answers(self) -> DataFrame:
        """Grounded answers; every seventh cites a source that isn't there."""
        return self.grounded().withColumn("answer", F.when(F.col("query_id") % 7 == 0, F.concat("answer", F.lit(" [9]"))).otherwise(F.col("answer")))

    @cached_property
    def golden(self) -> DataFrame:
        """Questions with markers, of those items that some document has."""
        items = self.questions.withColumn("marker", F.col("text"))
        present = evaluation.markers_found(documents(self.spark, self.d), items).withColumn("present", F.lit(True))
        known = stored(items.join(present, "query_id", "left"), "golden")
        markers = F.when(F.col("present"), F.array("marker")).otherwise(F.array().cast("array<string>"))
        return known.select("query_id", F.col("text").alias("question"), F.col("text").alias("expected_answer"), markers.alias("markers"), F.col("present").isNull().alias("should_refuse"))

    def gate(self) -> DataFrame:
        return self.golden.select("query_id", F.col("should_refuse").alias("refused"))

    def metrics(self) -> DataFrame:
        return evaluation.retrieval_metrics(self.golden, self.shown_hits())


@add(f"WITH {BM25_SQL} SELECT term, df FROM terms")
def bm25_index(spark, d):
    return Corpus(spark, d).index.terms


@add(f"WITH {BM25_SQL}, t AS (SELECT DISTINCT term FROM asked) SELECT term, coalesce(df, 0) AS df, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6) AS idf FROM t LEFT JOIN terms USING (term) CROSS JOIN stats")
def bm25_idf(spark, d):
    asked = questions(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return search.bm25_idf(Corpus(spark, d).index, asked).withColumn("idf", F.round("idf", 6))


@add(f"WITH {HITS_SQL} SELECT query_id, chunk_id, rank, score FROM hits")
def bm25_topk(spark, d):
    return Corpus(spark, d).bm25()


@add(f"WITH {HITS_SQL} SELECT query_id, chunk_id, rank, score FROM hits")
def bm25_block_topk(spark, d):
    """The same from an index that is kept as files, without the blocks of postings that can't matter."""
    path = fresh_path(spark, "bm25")
    postings.write_bm25_index(search.bm25_index(chunk_fixed(documents(spark, d), 1200, 150)), path)
    return postings.bm25_block_topk(questions(spark, d), postings.read_bm25_index(spark, path))


@add(f"WITH {BM25_SQL}, {DENSE_SQL} SELECT query_id, chunk_id, rank, score FROM dense_ranked WHERE rank <= 5")
def sparse_topk(spark, d):
    return Corpus(spark, d).dense(5)


VECTORS_SQL = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e)"""


@add(f"WITH {VECTORS_SQL}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.v, c.v), 6) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.label <> 3) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM s QUALIFY rank <= 10")
def vector_topk(spark, d):
    return search.vector_topk(query_vectors(spark, d).drop("tenant"), vectors(spark, d), 10, F.col("tenant") != 3)


@add(f"WITH {VECTORS_SQL}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS tenant, round(list_inner_product(q.v, c.v), 6) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.label = q.label) SELECT query_id, chunk_id, tenant, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM s QUALIFY rank <= 10")
def vector_topk_tenant(spark, d):
    return search.vector_topk(query_vectors(spark, d), vectors(spark, d), 10, on="tenant")


def ivf(spark, d):
    """The index, and the probes that find 0.93 of a sample's exact hits, kept with it."""
    path = fresh_path(spark, "lists")
    index = search.ivf_build(vectors(spark, d).drop("tenant"), path)
    return index, path


@add()
def ivf_build(spark, d):
    return ivf(spark, d)[0].vectors.groupBy("list_id").agg(F.count("*").alias("vectors"))


@add()
def ivf_search(spark, d):
    """With the calibrated number of probes; nothing is searched exactly but a sample, when the index is made."""
    index, path = ivf(spark, d)
    return search.ivf_search(query_vectors(spark, d).drop("tenant"), index, 10, search.ivf_calibrate(index, path))


@add()
def ann_recall(spark, d):
    """Recall, and the share of the lists and of the vectors that a query meets, for 1, 3, 8 and all 16 probes, over the whole query set."""
    index, _ = ivf(spark, d)
    asked, lists = stored(query_vectors(spark, d).drop("tenant"), "asked"), max(1, len(index.centroids))
    out = None
    for r in search.ivf_recalls(asked, index, 10).filter(F.col("n_probe").isin(1, 3, 8, 16)).collect():  # four rows
        met = search.ivf_scanned(asked, index, r["n_probe"])
        row = met.select(F.lit(r["n_probe"]).alias("n_probe"), F.lit(r["recall"]).alias("recall"), F.lit(min(1.0, r["n_probe"] / lists)).alias("scanned_lists"), F.col("scanned").alias("scanned_vectors"))
        out = row if out is None else out.unionByName(row)
    return out


@add("SELECT count(*) AS vectors, max(len(embedding)) AS dims, count(*) * max(len(embedding)) * 4 AS bytes, CASE WHEN count(*) * max(len(embedding)) * 4 < 1024 * 1024 THEN printf('%.1f KB', count(*) * max(len(embedding)) * 4 / 1024.0) ELSE printf('%.1f MB', count(*) * max(len(embedding)) * 4 / 1024.0 / 1024.0) END AS size FROM embeddings")
def index_size(spark, d):
    return search.index_size(vectors(spark, d))


@add("SELECT vec_id AS chunk_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 7 = 0")
def vector_lookup(spark, d):
    ids = vectors(spark, d).filter("chunk_id % 7 = 0").select("chunk_id")
    return search.vector_lookup(vectors(spark, d), ids).select("chunk_id", F.round(F.get("vector", 0).cast("double"), 6).alias("first"))


def vector_store(spark, d) -> str:
    """Chunks of one character each with the vectors of the table, appended in two goes."""
    known, path = vectors(spark, d), fresh_path(spark, "store")
    texts = known.select("chunk_id", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("text"), "tenant")
    for part in (0, 1):
        some = lambda df: df.filter(F.col("chunk_id") % 2 == part)  # noqa: B023, E731
        search.vector_append(some(texts), some(known), 64, path)
    return path


@add("SELECT vec_id AS chunk_id, CAST(label AS INTEGER) AS tenant, 'chunk ' || vec_id AS text FROM embeddings WHERE label <> 4")
def delete_where(spark, d):
    """A tenant's vectors deleted from a store: its folders leave the manifest, and nothing is rewritten."""
    path = vector_store(spark, d)
    delete_rows(spark, path, F.col("tenant") == 4)
    return read_store(spark, path).select("chunk_id", "tenant", "text")


@add("SELECT CAST(label AS INTEGER) AS tenant, count(*) AS vectors, min(vec_id) AS first_id, CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings GROUP BY label")
def vector_append(spark, d):
    kept = read_store(spark, vector_store(spark, d))
    return kept.groupBy("tenant").agg(F.count("*").alias("vectors"), F.min("chunk_id").alias("first_id"), F.sum(F.size("vector")).alias("numbers"))


@add(
    """WITH q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
h AS (SELECT page_id, url AS title, html AS body, lower(url || ' ' || html) AS hay FROM pages),
s AS (SELECT query_id, page_id, title, body, CAST(sum(times * (length(hay) - length(replace(hay, term, ''))) / length(term)) AS BIGINT) AS score FROM q JOIN h ON contains(hay, term) GROUP BY ALL)
SELECT query_id, page_id, title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title DESC, body DESC, page_id) AS rank, score FROM s QUALIFY rank <= 3"""
)
def term_count_search(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("body"))
    return search.term_count_search(questions(spark, d), pages, 3).drop("body")


@add(f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, rank, score FROM fused_ranked")
def rrf_fuse(spark, d):
    c = Corpus(spark, d)
    return search.rrf_fuse([c.dense(), c.bm25(20)])


@add(f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, rank, score FROM fused_ranked WHERE rank <= 5")
def hybrid_topk(spark, d):
    c = Corpus(spark, d)
    return search.hybrid_topk(c.dense(), c.bm25(20), 5)


@add(
    f"""WITH {HYBRID_SQL}, fetched AS (SELECT 'hybrid' AS mode, query_id, chunk_id, rank FROM fused_ranked WHERE rank <= 20),
judged AS (SELECT query_id, chunk_id, rank AS before, len(list_intersect(list_distinct(string_split_regex(lower(b.text), '\\s+')), list_distinct(string_split_regex(lower(substring(c.text, 1, 1500)), '\\s+')))) AS score
  FROM fetched JOIN benchmark b ON item_id = query_id JOIN chunks c USING (chunk_id)),
reranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM judged)
SELECT 'hybrid' AS mode, query_id, chunk_id, rank FROM fused_ranked WHERE rank <= 3 UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM dense_ranked WHERE rank <= 3
UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM reranked WHERE rank <= 3"""
)
def retrieve(spark, d):
    """By vectors, fused, and fused with a reranker that is given twenty hits to choose from. Both searches are made once, twenty deep, and cut for each way."""
    c, fetch = Corpus(spark, d), 20
    cut = lambda hits: lambda _, k: hits.filter(F.col("rank") <= k)
    dense, bm25 = cut(stored(c.dense(fetch), "dense")), cut(stored(c.bm25(fetch), "bm25"))
    rerank = lambda hits, k: search.rerank(hits, c.questions, c.chunks, shared_words, k)
    ways = {"vector": (None, None), "hybrid": (bm25, None), "reranked": (bm25, rerank)}
    out = None
    for mode, (other, last) in ways.items():
        hits = rag.retrieve(c.questions, dense, other, last, 3, fetch).select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


@add()
def mmr(spark, d):
    wide = search.vector_topk(query_vectors(spark, d).drop("tenant"), vectors(spark, d).drop("tenant"), 20)
    return search.mmr(wide, query_vectors(spark, d), vectors(spark, d), 5)


def shared_words(questions: list[str], passages: list[str]) -> list[str]:
    """A judge for tests: the number of words both have."""
    return [f"Score: {len(set(q.lower().split()) & set(p.lower().split()))}" for q, p in zip(questions, passages, strict=True)]


@add()
def rerank(spark, d):
    c = Corpus(spark, d)
    return search.rerank(c.bm25(20), c.questions, c.chunks, shared_words, 5)


def halves(texts: list[str]) -> list[str]:
    """A rewriter for tests: the first and second half of the words, as a list."""
    return ["\n".join(("- " + " ".join(t.split()[: len(t.split()) // 2]), "", "• " + " ".join(t.split()[len(t.split()) // 2 :]))) for t in texts]


@add()
def multi_query(spark, d):
    c = Corpus(spark, d)
    return search.multi_query(c.questions, halves, lambda q: c.bm25(5, q))


@add()
def hyde(spark, d):
    c = Corpus(spark, d)
    return search.hyde(c.questions, lambda texts: [t.split(".")[0] for t in texts], lambda q: c.dense(5, q))


@add(f"WITH {PARENT_SQL} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank, score FROM owned QUALIFY rank <= 3")
def parent_child(spark, d):
    parents = Corpus(spark, d, 1200, 0).chunks
    kids = stored(chunk_fixed(parents.select(F.col("chunk_id").alias("doc_id"), "source", "text"), 300, 0), "kids")
    found = search.bm25_topk(questions(spark, d), search.bm25_index(kids, lambda df: stored(df, "terms")), 9)
    return search.parent_child(found, kids.select("chunk_id", F.col("doc_id").alias("parent_id")), parents, 3)


@add(f"""WITH {BM25_SQL}, {DENSE_SQL}, every AS (SELECT 'bm25' AS retriever, query_id, chunk_id, rank FROM bm25_ranked WHERE rank <= 5 UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM dense_ranked WHERE rank <= 5),
first AS (SELECT retriever, query_id, min(rank) AS rank FROM every JOIN chunks USING (chunk_id) JOIN benchmark ON item_id = query_id WHERE contains(lower(chunks.text), lower(benchmark.text)) GROUP BY ALL),
grid AS (SELECT retriever, item_id AS query_id FROM benchmark CROSS JOIN (VALUES ('bm25'), ('vector')) r(retriever))
SELECT retriever, count(*) AS queries, count(rank) AS found, count(*) FILTER (rank = 1) AS first, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM grid LEFT JOIN first USING (retriever, query_id) GROUP BY retriever""")
def rank_compare(spark, d):
    markers = questions(spark, d).select("query_id", F.col("text").alias("marker"))
    c = Corpus(spark, d)
    return search.rank_compare({"bm25": c.hits, "vector": stored(c.dense(5), "dense")}, c.chunks, markers)


def one_per_source(spark, d):
    return documents(spark, d).groupBy("doc_id").agg(F.first("text").alias("text")).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), "text")


@add(f"WITH {chunks_sql()}, c AS (SELECT count(*) AS n FROM chunks WHERE doc_id % 4 <> 0 OR doc_id % 8 = 0) SELECT count(*) FILTER (doc_id % 4 <> 0 OR doc_id % 8 = 0) AS documents, (SELECT n FROM c) AS chunks, count(*) FILTER (NOT (doc_id % 4 <> 0 OR doc_id % 8 = 0)) AS skipped FROM documents")
def ingest(spark, d):
    """Every fourth document is known, every eighth with an old text."""
    docs = one_per_source(spark, d)
    old = F.when(F.col("doc_id") % 8 == 0, F.lit("old")).otherwise(F.col("text"))
    known = docs.filter("doc_id % 4 = 0").select("source", X.text_hash(old).alias("content_hash"))
    return rag.ingest(docs, known, lambda x: chunk_fixed(x, 1200, 150))[2]


@add(f"WITH {BM25_SQL}, {DENSE_SQL}, r AS (SELECT query_id, greatest(max(score), 0) AS relevance FROM dense_ranked WHERE rank <= 5 GROUP BY query_id) SELECT item_id AS query_id, coalesce(relevance, 0) AS relevance, coalesce(relevance, 0) < 0.3 AS refused FROM benchmark LEFT JOIN r ON query_id = item_id")
def relevance_gate(spark, d):
    c = Corpus(spark, d)
    hits = stored(c.dense(5), "hits")
    asked = embedding.dense(embedding.hash_vectors(c.questions, "query_id"), "query_id", 256)
    near = embedding.dense(c.vectors.join(hits.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", 256)
    return rag.relevance_gate(c.questions, hits, asked, near, 0.3)


@add(
    f"""WITH RECURSIVE {HITS_SQL}, h AS (SELECT query_id, chunk_id, rank, score, CAST(greatest(1, length(text) // 4) AS BIGINT) AS cost FROM hits JOIN chunks USING (chunk_id)),
walk AS (SELECT query_id, chunk_id, rank, score, cost, cost <= 700 AS fits, CASE WHEN cost <= 700 THEN cost ELSE 0 END AS used, false AS ended FROM h WHERE rank = 1
  UNION ALL SELECT h.query_id, h.chunk_id, h.rank, h.score, h.cost, NOT w.ended AND w.used + h.cost <= 700, CASE WHEN NOT w.ended AND w.used + h.cost <= 700 THEN w.used + h.cost ELSE w.used END,
    w.ended OR (w.used + h.cost > 700 AND 700 - w.used < 50) FROM walk w JOIN h ON h.query_id = w.query_id AND h.rank = w.rank + 1)
SELECT query_id, chunk_id, rank, score, cost AS tokens FROM walk WHERE fits"""
)
def fit_to_budget(spark, d):
    c = Corpus(spark, d)
    return rag.fit_to_budget(c.hits, c.chunks, 700)


@add(f"WITH {HITS_SQL} SELECT query_id, string_agg('[' || rank || '] (' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id")
def format_context(spark, d):
    return Corpus(spark, d).contexts()


SYSTEM_PROMPT = "Answer from the sources, and cite them."


@add(f"WITH {HITS_SQL}, n AS (SELECT query_id, sum(length(text)) AS n FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id) SELECT item_id AS query_id, CAST((coalesce(n, 0) + length(text) + {len(SYSTEM_PROMPT)}) // 4 AS BIGINT) AS tokens FROM benchmark LEFT JOIN n ON query_id = item_id")
def prompt_tokens(spark, d):
    c = Corpus(spark, d)
    return rag.prompt_tokens(c.questions, c.hits, c.chunks, SYSTEM_PROMPT)


@add()
def answer(spark, d):
    c = Corpus(spark, d)
    return rag.answer(c.questions, c.gate(), c.contexts(), lambda prompts: [p.split("\n")[2][:80] + " [1]" for p in prompts])


_ASKED = r"list_distinct(list_filter(string_split_regex(replace(lower(regexp_replace(split_part(b.text, chr(10), 1), '^\s+|\s+$', '', 'g')), '?', ''), '\s+'), lambda w: length(w) > 3))"
GROUNDED_SQL = rf"""{HITS_SQL},
q AS (SELECT item_id AS query_id, {_ASKED} AS asked FROM benchmark b),
parts AS (SELECT query_id, rank, string_split(replace(text, chr(10), ' '), '. ') AS s FROM hits JOIN chunks USING (chunk_id)),
said AS (SELECT query_id, rank, unnest(range(0, len(s))) AS place, unnest(s) AS sentence FROM parts),
scored AS (SELECT said.*, len(list_intersect(asked, list_transform(list_filter(string_split_regex(sentence, '\s+'), lambda w: length(w) > 3), lambda w: regexp_replace(lower(w), '^[.,]+|[.,]+$', '', 'g')))) AS overlap FROM said JOIN q USING (query_id)),
best AS (SELECT * FROM scored WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, place) = 1),
grounded AS (SELECT item_id AS query_id, coalesce(regexp_replace(sentence, '^\s+|\s+$', '', 'g') || '. [' || rank || ']', 'I don''t know based on the provided sources.') AS answer FROM benchmark LEFT JOIN best ON query_id = item_id)"""


@add(f"WITH {GROUNDED_SQL} SELECT query_id, answer FROM grounded")
def grounded_answer(spark, d):
    return Corpus(spark, d).grounded()


@add(
    rf"""WITH {GROUNDED_SQL}, a AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN answer || ' [9]' ELSE answer END AS answer FROM grounded),
c AS (SELECT query_id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::BIGINT))) AS cited FROM a)
SELECT query_id, array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda x: x > 5), ',') AS dangling, len(list_filter(cited, lambda x: x > 5)) = 0 AS valid, len(cited) > 0 AS has_citations FROM c"""
)
def citation_check(spark, d):
    checked = rag.citation_check(Corpus(spark, d).cited_answers().withColumn("n_sources", F.lit(5)))
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return checked.select("query_id", shown("cited"), shown("dangling"), "valid", "has_citations")


@add(f"WITH {HITS_SQL}, f AS (SELECT query_id, source, min(rank) AS rank FROM hits JOIN chunks USING (chunk_id) GROUP BY ALL) SELECT query_id, string_agg(source, ',' ORDER BY rank) AS sources FROM f GROUP BY query_id")
def ordered_sources(spark, d):
    c = Corpus(spark, d)
    return rag.ordered_sources(c.hits, c.chunks).select("query_id", F.array_join("sources", ",").alias("sources"))


@add(f"WITH {chunks_sql()} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(DISTINCT chunk_id) FILTER (len(regexp_extract_all(lower(text), '[a-z0-9'']+')) > 0) AS vectors, 'hash' AS embedder, 256::BIGINT AS dims, 0.0::DOUBLE AS cache_hit_rate FROM chunks")
def corpus_stats(spark, d):
    c = Corpus(spark, d)
    return rag.corpus_stats(documents(spark, d), c.chunks, c.vectors.filter("size(entries) > 0"), "hash", 256)


def metric(name: str):
    @add(f"WITH {JUDGED_SQL} SELECT query_id, {name} FROM metrics")
    def run(spark, d):
        return Corpus(spark, d).metrics().select("query_id", name)

    plans.queries[name], plans.sql[name] = run, plans.sql.pop("run")
    del plans.queries["run"]


for _name in evaluation.RETRIEVAL:
    metric(_name)


@add(
    rf"""WITH {{GROUNDED_SQL}}, a AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN answer || ' [9]' ELSE answer END AS answer FROM grounded),
ctx AS (SELECT query_id, list_distinct(regexp_extract_all(lower(string_agg('[' || rank || '] (' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)), '[a-z0-9'']+')) AS known FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id),
claim AS (SELECT query_id, unnest(list_filter(string_split_regex(regexp_replace(answer, '([.!?])\s+', '' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')) AS said FROM a),
claim_words AS (SELECT query_id, list_filter(regexp_extract_all(lower(said), '[a-z0-9'']+'), lambda w: length(w) > 3) AS w FROM claim),
backed AS (SELECT query_id, avg(CAST(len(w) = 0 OR len(list_filter(w, lambda x: list_contains(known, x))) / len(w) >= 0.5 AS INT)) AS share FROM claim_words JOIN ctx USING (query_id) GROUP BY query_id)
SELECT a.query_id, round(CASE WHEN known IS NULL THEN CASE WHEN trim(answer, ' ') = '' THEN 1.0 ELSE 0.0 END ELSE coalesce(share, 1.0) END, 6) AS faithfulness FROM a LEFT JOIN ctx USING (query_id) LEFT JOIN backed USING (query_id)""".replace("{GROUNDED_SQL}", GROUNDED_SQL)
)
def faithfulness(spark, d):
    c = Corpus(spark, d)
    return evaluation.faithfulness(c.cited_answers(), c.contexts())


WORDS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
_LONG = f"list_distinct(list_filter({WORDS.format('b.text')}, lambda w: length(w) > 3))"


@add(f"WITH {GROUNDED_SQL} SELECT query_id, CASE WHEN len({_LONG}) = 0 THEN 1.0 ELSE round(len(list_intersect({_LONG}, {WORDS.format('answer')})) / len({_LONG}), 6) END AS answer_relevance FROM grounded JOIN benchmark b ON item_id = query_id")
def answer_relevance(spark, d):
    said = questions(spark, d).join(Corpus(spark, d).grounded(), "query_id")
    return said.select("query_id", F.round(evaluation.answer_relevance(F.col("text"), F.col("answer")), 6).alias("answer_relevance"))


_A, _B = (f"list_distinct({WORDS.format(x)})" for x in ("answer", "b.text"))


@add(f"WITH {GROUNDED_SQL} SELECT query_id, coalesce(round(2.0 * len(list_intersect({_A}, {_B})) / nullif(len({_A}) + len({_B}), 0), 6), 0) AS answer_correctness FROM grounded JOIN benchmark b ON item_id = query_id")
def answer_correctness(spark, d):
    said = questions(spark, d).join(Corpus(spark, d).grounded(), "query_id")
    return said.select("query_id", F.round(evaluation.answer_correctness(F.col("text"), F.col("answer")), 6).alias("answer_correctness"))


@add()
def judge_faithfulness(spark, d):
    def judge(held, said):
        return [f"{10 * sum(w in c for w in a.split()) // max(1, len(a.split()))}" for c, a in zip(held, said, strict=True)]

    c = Corpus(spark, d)
    return evaluation.judge_faithfulness(c.cited_answers(), c.contexts(), judge)


@add()
def evaluate(spark, d):
    c = Corpus(spark, d)
    said = c.cited_answers().join(c.gate(), "query_id")
    return evaluation.evaluate(c.golden, c.shown_hits(), said, c.contexts())


MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluation.RETRIEVAL)


@add(
    f"""WITH {JUDGED_SQL}, said AS (SELECT g.query_id, length(question) AS latency, (coalesce((SELECT max(score) FROM hits h WHERE h.query_id = g.query_id), 0) < 20) = should_refuse AS right FROM golden g),
r AS (SELECT *, row_number() OVER (ORDER BY latency) AS nth, count(*) OVER () AS of FROM metrics JOIN said USING (query_id))
SELECT 'bm25' AS config, count(*) AS n, {MEANS}, round(avg(CAST("right" AS INT)), 6) AS refusal_accuracy, max(latency) FILTER (nth = least(of, of // 2 + 1)) AS p50_latency FROM r"""
)
def scorecard(spark, d):
    """Questions without a hit of score 20 are refused; the length of a question stands for its latency."""
    c = Corpus(spark, d)
    best = c.hits.groupBy("query_id").agg(F.max("score").alias("best"))
    said = c.golden.join(best, "query_id", "left").select("query_id", F.length("question").cast("long").alias("latency"), ((F.coalesce("best", F.lit(0.0)) < 20) == F.col("should_refuse")).alias("refusal_correct"))
    return evaluation.scorecard(c.metrics().join(said, "query_id").withColumn("config", F.lit("bm25")), [*evaluation.RETRIEVAL], latency="latency")


@add(f"WITH {JUDGED_SQL} SELECT query_id, mrr FROM metrics WHERE mrr < 0.6")
def failures(spark, d):
    return evaluation.failures(Corpus(spark, d).metrics(), "mrr", 0.6).select("query_id", "mrr")


#: Sizes and overlaps of fixed windows that are compared.
SWEEP = {"fixed_1200": (1200, 150), "fixed_300": (300, 30), "whole_6000": (6000, 0)}
_CARDS = [f"SELECT * FROM (WITH {JUDGED_SQL.replace(chunks_sql(), chunks_sql(*sizes))} SELECT '{name}' AS config, {MEANS} FROM metrics)" for name, sizes in SWEEP.items()]
_LONG_CARDS = " UNION ALL ".join(f"SELECT '{m}' AS metric, config, {m} AS value FROM cards" for m in evaluation.RETRIEVAL)
_WIDE = ", ".join(f"max(value) FILTER (config = '{name}') AS {name}" for name in SWEEP)


@add(f"WITH cards AS ({' UNION ALL '.join(_CARDS)}), l AS ({_LONG_CARDS}) SELECT metric, {_WIDE} FROM l GROUP BY metric")
def compare_configs(spark, d):
    """The same questions over windows of three sizes."""
    first = Corpus(spark, d, *SWEEP["fixed_1200"])
    found = {"fixed_1200": first.metrics()}
    for name, sizes in SWEEP.items():
        if name not in found:
            found[name] = evaluation.retrieval_metrics(first.golden, Corpus(spark, d, *sizes).shown_hits())
    card = evaluation.compare_configs({name: found[name] for name in SWEEP}, [*evaluation.RETRIEVAL])
    return card.select("metric", *SWEEP)

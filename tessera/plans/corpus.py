"""Queries over documents: identity, tokens, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.counting import hashed_matrix
from tessera.operators import chunking, embedding, validation
from tessera.plans.base import Plans, chunks, chunks_sql, documents, read
from tessera.sources import files
from tessera.sources.scratch import fresh_path

plans = Plans()
add = plans.add


def seeded(spark, d):
    """Markdown made of the table's columns, as it has none of its own."""
    made = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), "text")
    return read(spark, d, "documents").select("doc_id", "source", made.alias("text"))


@add("SELECT substr(sha256(text), 1, 16) AS doc_id, source, sha256(text) AS content_hash FROM documents")
def document_identity(spark, d):
    return embedding.document_identity(documents(spark, d).withColumn("doc_id", F.lit(""))).select("doc_id", "source", "content_hash")


@add(f"WITH {chunks_sql()} SELECT chunk_id, doc_id, source, CAST(ordinal AS BIGINT) AS ordinal, start, \"end\", text, heading_path, chunker FROM chunks")
def chunk_fixed(spark, d):
    return chunks(spark, d)


@add(f"WITH {chunks_sql(400, 250)} SELECT chunk_id, doc_id, CAST(ordinal AS BIGINT) AS ordinal, start, \"end\", md5(text) AS text_md5 FROM chunks")
def chunk_finalize(spark, d):
    pieces = chunking.fixed_pieces(documents(spark, d), 400, 250)
    return chunking.chunk_finalize(pieces, "fixed").select("chunk_id", "doc_id", "ordinal", "start", "end", F.md5("text").alias("text_md5"))


@add()
def chunk_recursive(spark, d):
    return chunking.chunk_recursive(documents(spark, d), 800, 100)


@add()
def chunk_markdown(spark, d):
    return chunking.chunk_markdown(seeded(spark, d), 800, 100)


@add()
def chunk_semantic(spark, d):
    return chunking.chunk_semantic_in_place(documents(spark, d), lambda sentences: hashed_matrix(sentences, 64), 1200)


@add(
    r"""WITH s AS (SELECT doc_id, source, regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+$') AS parts FROM documents),
p AS (SELECT doc_id, source, unnest(range(0, len(parts))) AS position, unnest(parts) AS sentence FROM s),
q AS (SELECT *, CAST(coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
SELECT doc_id, source, position, start, sentence FROM q WHERE regexp_replace(sentence, '^\s+|\s+$', '', 'g') <> ''"""
)
def split_sentences(spark, d):
    return chunking.split_sentences(documents(spark, d))


@add(
    f"""WITH {chunks_sql()}, c AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS of FROM chunks)
SELECT count(*) AS count, round(sum(n) / count(*), 6) AS mean_chars, min(n) AS min_chars, max(n) AS max_chars, max(n) FILTER (r = least(of, of // 2 + 1)) AS p50_chars,
CAST(sum(n) // 4 AS BIGINT) AS est_tokens FROM c"""
)
def chunk_stats(spark, d):
    return chunking.chunk_stats(chunks(spark, d))


@add("SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents)")
def tokenize(spark, d):
    t = documents(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@add("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_estimate(spark, d):
    return documents(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@add("SELECT doc_id, length(text) >= 200 AND len(w) >= 200 AND len(list_distinct(w)) <= greatest(2, len(w) // 100) AS repetitive FROM (SELECT doc_id, text, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents)")
def repetition_check(spark, d):
    return documents(spark, d).select("doc_id", validation.repetition_check(F.col("text")).alias("repetitive"))


EMBED_SQL = """
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
ones AS (SELECT doc_id, unnest(w) AS t, {unigram} AS n FROM words {bigrams}),
counted AS (SELECT doc_id, CAST(('0x' || substr(md5({token}), 1, 8)) AS BIGINT) % {dims} AS bucket, sum(n) AS n FROM ones GROUP BY ALL),
weights AS (SELECT doc_id, bucket, {weight} AS weight FROM counted)
SELECT doc_id, bucket, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM weights
"""
BIGRAMS = "UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 0.5 FROM words WHERE len(w) > 1"


@add("WITH " + EMBED_SQL.format(unigram="1.0", bigrams=BIGRAMS, token="t", dims=256, weight="1 + ln(CAST(n AS DOUBLE))"))
def hash_embed(spark, d):
    return embedding.hash_embed(documents(spark, d), "doc_id").withColumn("weight", F.round("weight", 6))


@add("WITH " + EMBED_SQL.format(unigram="1.0", bigrams="", token="t", dims=128, weight="CAST(n AS DOUBLE)"))
def memory_embed(spark, d):
    return embedding.memory_embed(documents(spark, d), "doc_id").withColumn("weight", F.round("weight", 6))


_ID = f"regexp_matches(t, '{embedding.IDENTIFIER}')"
_SYNONYM = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in embedding.SYNONYMS.items()) + "}"
_STUB = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t FROM documents),
named AS (SELECT doc_id, CASE WHEN {_ID} THEN '{embedding.IDENTIFIER_WORD}' ELSE coalesce(({_SYNONYM})[t], t) END AS t, CASE WHEN {_ID} THEN 0.05 ELSE 1.0 END AS n FROM words),
counted AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 256 AS bucket, CAST(sum(n) AS DOUBLE) AS weight FROM named GROUP BY ALL)"""


@add(f"WITH {_STUB} SELECT doc_id, bucket, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM counted")
def stub_embed(spark, d):
    return embedding.stub_embed(documents(spark, d), "doc_id").withColumn("weight", F.round("weight", 6))


@add("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3))) / 9, 5) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def normalize(spark, d):
    tripled = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    made = tripled.select("vec_id", X.unit(F.col("v")).alias("u"), F.round(X.dot(F.col("v"), F.col("v")) / 9, 5).alias("length"))
    return made.select("vec_id", "length", F.round(F.get("u", 0), 6).alias("first"))


@add("SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    e = read(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(other, "vec_id").select("vec_id", "other", F.round(X.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@add(
    """WITH k AS (SELECT doc_id, sha256('hash-256:' || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
SELECT count(*) AS requests, count(c.key) AS hits, count(*) - count(c.key) AS misses, round(count(c.key) / count(*), 6) AS hit_rate FROM k LEFT JOIN c USING (key)"""
)
def embed_incremental(spark, d):
    docs = documents(spark, d)

    def embed(t):
        return embedding.dense(embedding.hash_vectors(t, "cache_key"), "cache_key", 256)

    old = docs.filter("doc_id % 3 = 0").select(embedding.cache_key("hash-256", F.col("text")).alias("cache_key"), "text").dropDuplicates(["cache_key"])
    return embedding.embed_incremental(docs, embed(old), "hash-256", embed)[1]


def letter_model(texts: list[str]) -> list[list[float]]:
    """A caller's model for tests: the share of each vowel."""
    return [[t.count(v) / max(1, len(t)) for v in "aeiou"] for t in texts]


@add()
def embed_batched(spark, d):
    return embedding.embed_batched(documents(spark, d), "doc_id", letter_model)


@add("SELECT substr(sha256(text), 1, 16) AS doc_id, sha256(text) AS content_hash, count(*) AS files, length(text) AS chars FROM documents WHERE text IS NOT NULL GROUP BY text")
def load_corpus(spark, d):
    """The documents packed, many to a file, and read back as a corpus. Texts are told by their hashes."""
    path = fresh_path(spark, "corpus")
    files.pack_corpus(documents(spark, d), path)
    found = files.load_packed(spark, path).groupBy("doc_id", "content_hash")
    return found.agg(F.count("*").alias("files"), F.max(F.length("text")).cast("long").alias("chars"))


@add("SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE source = 'src3'")
def tenant_filter(spark, d):
    return files.tenant_filter(documents(spark, d).withColumn("tenant", F.col("source")), "src3").select("doc_id", "source", F.md5("text").alias("text_md5"))

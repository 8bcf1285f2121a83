"""Hash embeddings as entries and in long form (id, bucket, weight), dense vectors, incremental and batched embedding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.counting import hashed, weighed
from tessera.functions.rules import IDENTIFIER, IDENTIFIER_WEIGHT, IDENTIFIER_WORD, SYNONYMS
from tessera.functions.text import let, text_hash


def long_form(vectors: DataFrame, key: str) -> DataFrame:
    """(key, bucket, weight) of entries."""
    return vectors.select(key, F.explode("entries").alias("e")).select(key, "e.bucket", "e.weight")


def hash_vectors(texts: DataFrame, key: str, dims: int = 256, bigrams: bool = True, logarithmic: bool = True) -> DataFrame:
    """(key, entries array<struct<bucket, weight>>) of texts (key, text), of unit length: a bucket counts 1 for each of its tokens and 0.5 for each bigram,
    and weighs 1 + ln(count), or the count. A text without tokens, or null, has no entries: the zero vector."""
    return texts.select(key, hashed(F.col("text"), dims, bigrams, logarithmic).alias("entries"))


def hash_embed(texts: DataFrame, key: str, dims: int = 256, bigrams: bool = True, logarithmic: bool = True) -> DataFrame:
    """hash_vectors in long form, (key, bucket, weight): a text without tokens has no rows."""
    return long_form(hash_vectors(texts, key, dims, bigrams, logarithmic), key)


def canonical(token: str) -> str:
    """The word whose bucket a token shares."""
    return IDENTIFIER_WORD if is_identifier(token) else SYNONYMS.get(token, token)


def is_identifier(token: str) -> bool:
    return re.search(IDENTIFIER, token) is not None


def stub_embed(texts: DataFrame, key: str, dims: int = 256) -> DataFrame:
    """hash_embed with synonyms in one bucket and identifiers in another one, of little weight; linear counts."""
    entries = weighed(F.col("text"), dims, canonical, lambda t: IDENTIFIER_WEIGHT if is_identifier(t) else 1.0)
    return long_form(texts.select(key, entries.alias("entries")), key)


def memory_embed(texts: DataFrame, key: str) -> DataFrame:
    """128 buckets of linear token counts."""
    return hash_embed(texts, key, dims=128, bigrams=False, logarithmic=False)


def dense(vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, vector array<double>) of entries; the zero vector where there are none."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long"))
    spread = lambda at: F.transform(places, lambda b: F.coalesce(F.try_element_at(at, b), F.lit(0.0)))
    return vectors.select(key, let(F.map_from_entries("entries"), spread).alias("vector"))


def embed_batched(texts: DataFrame, key: str, model: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """(key, vector) by a caller's model, `batch` texts at a time."""
    kind = texts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch]
                yield pd.DataFrame({key: some[key], "vector": [list(map(float, v)) for v in model(some["text"].tolist())]})

    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, vector array<double>")


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), text), 256)


def embed_incremental(texts: DataFrame, cached: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The grown cache (cache_key, vector) and one row of requests, hits, misses and hit rate. Texts that miss are embedded once each;
    embed: from (cache_key, text) to (cache_key, vector)."""
    asked = texts.select(cache_key(model, F.col("text")).alias("cache_key"), "text")
    misses = asked.dropDuplicates(["cache_key"]).join(cached, "cache_key", "left_anti")
    grown = cached.select("cache_key", "vector").unionByName(embed(misses).select("cache_key", "vector"))
    seen = asked.join(cached.select("cache_key", F.lit(1).alias("hit")).distinct(), "cache_key", "left")
    stats = seen.agg(F.count("*").alias("requests"), F.count("hit").alias("hits")).withColumn("misses", F.col("requests") - F.col("hits"))
    return grown, stats.withColumn("hit_rate", F.round(F.coalesce(F.try_divide("hits", "requests"), F.lit(0.0)), 6))


def document_identity(docs: DataFrame) -> DataFrame:
    """content_hash of the text; doc_id, where empty, is its first 16 digits."""
    hashed = docs.withColumn("content_hash", text_hash(F.col("text")))
    given = F.nullif(F.col("doc_id").cast("string"), F.lit(""))
    return hashed.withColumn("doc_id", F.coalesce(given, F.substring("content_hash", 1, 16)))

"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's target rate; the number is the inverse
distribution function at a hash of the id, so that a rerun, or a lost executor, gives the same copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, set_aside, unit_interval

#: Distribution functions of up to this many numbers in all (and one more a source) are broadcast; larger ones are joined by source.
BROADCAST_NUMBERS = 1 << 20


def poisson_distributions(rates: DataFrame) -> DataFrame:
    """__source, __low and __cdf, the distribution function at __low, __low + 1, ..., of rates (__source, __rate).

    Only a window of 12 deviations about the mean is made: what lies outside weighs less than 1e-15. Within it the weights follow each
    other by the ratio rate / k, from 1 on, and are divided by their sum, so that no rate underflows. Rates of zero or less give no row.
    """
    k, own = F.col("__k"), Window.partitionBy("__source").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("__source")
    steps = rates.filter("__rate > 0").select("__source", "__rate", low("__rate").alias("__low"), F.explode(F.sequence(low("__rate"), high("__rate"))).alias("__k"))
    ratio = F.when(k > F.col("__low"), F.log(F.col("__rate") / k)).otherwise(0.0)
    weighed = steps.withColumn("__w", F.exp(F.sum(ratio).over(own)))
    summed = weighed.select("__source", "__low", (F.sum("__w").over(own) / F.sum("__w").over(whole)).alias("__p"))
    return summed.groupBy("__source").agg(F.min("__low").alias("__low"), F.sort_array(F.collect_list("__p")).alias("__cdf"))


def low(rate: str):
    return F.greatest(F.lit(0), F.floor(F.col(rate) - 12 * F.sqrt(rate) - 24)).cast("long")


def high(rate: str):
    return F.ceil(F.col(rate) + 12 * F.sqrt(rate) + 24).cast("long")


def mix_sources(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", weights: dict[str, float] | None = None, rows: int | None = None, seed: int = 7) -> DataFrame:
    """Rows of `docs` repeated so that a source's expected share is its weight, in a global shuffle.

    `weights` are relative; sources not named get none, and by default all sources weigh the same. The expected number
    of rows is `rows`, by default the input's. Adds copy (from 0) and mix_key, the order of the shuffle: within a
    partition rows are sorted by it, and partitions are dealt by it. Null is a source of its own (named by a weight
    under None). A repeated id repeats alike, also in repeated rows; a null id counts as the text 'null'. Texts of any length, null and
    empty ones too, are carried as they are. Empty tables stay empty. Input columns named copy or mix_key are replaced, all others stay.
    """
    docs, back = set_aside(docs.drop("copy", "mix_key"))
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("__rows"))
    if weights is None:
        weighted = counts.withColumn("__weight", F.lit(1.0))
    else:
        named = F.lit(float(weights.get(None, 0.0)))
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        look = F.try_element_at(F.create_map(*pairs), F.col("__source")) if pairs else F.lit(None)
        weighted = counts.withColumn("__weight", F.when(F.col("__source").isNull(), named).otherwise(F.coalesce(look, F.lit(0.0))))
    # one row of totals, so a broadcast of fixed size
    totals = weighted.agg(F.sum("__weight").alias("__weights"), F.sum("__rows").alias("__all"))
    wanted = F.col("__all").cast("double") if rows is None else F.lit(float(rows))
    rate = F.coalesce(F.try_divide(F.col("__weight") * wanted, F.col("__weights") * F.col("__rows")), F.lit(0.0))
    rates = weighted.crossJoin(F.broadcast(totals)).select("__source", rate.alias("__rate"))
    numbers = rates.filter("__rate > 0").agg(F.coalesce(F.sum(high("__rate") - low("__rate") + 2), F.lit(0))).first()[0]
    cdf = poisson_distributions(rates)
    joined = docs.join(F.broadcast(cdf) if numbers <= BROADCAST_NUMBERS else cdf, docs[source].eqNullSafe(F.col("__source")))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    u = unit_interval(F.lit(f"{seed}"), key)
    n = (F.col("__low") + F.size(F.filter("__cdf", lambda c: c <= u))).cast("int")
    copies = joined.withColumn("__n", n).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "__cdf", "__low", "__source")
    mixed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}"), key, F.col("copy").cast("string")).cast("binary")))
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key").withColumnsRenamed(back)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "copy", "mix_key")


OP10_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, CAST((SELECT sum(n) FROM counts) AS DOUBLE) / ((SELECT count(*) FROM counts) * n) AS rate FROM counts),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM rates),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM steps),
drawn AS (SELECT d.*, CAST(('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT d.doc_id, count(*) AS n FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.p <= d.u GROUP BY d.doc_id),
copies AS (SELECT doc_id, unnest(range(0, n)) AS copy FROM counted)
SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, CAST(c.copy AS INTEGER) AS copy,
       md5('7:' || CAST(d.doc_id AS VARCHAR) || ':' || CAST(c.copy AS VARCHAR)) AS mix_key
FROM documents d JOIN copies c ON c.doc_id = d.doc_id
"""

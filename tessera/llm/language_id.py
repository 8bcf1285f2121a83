"""Language identification by nearest centroid.

A text is a TF-IDF vector of its hashed letter n-grams (one to three bytes of lower-cased UTF-8, other characters as a blank),
normalised. Each language has several centroids, clustered by cosine; a text gets the language of the nearest one, and is
rejected where it is farther from it than nearly all fitted texts of the language are when cut to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, held_out, others, read

DIMS = 1 << 12
#: Bytes of a text counted together.
BLOCK_BYTES = 1 << 20
#: Texts turned to vectors together.
BLOCK_TEXTS = 256
UNKNOWN = "und"
#: Fitted texts are cut to these lengths, in characters, to learn how far short texts lie; bands of lengths are by the power of two of their n-grams.
CUTS = (12, 25, 50, 100, 200, 400, 800, 1600, 3200)
BANDS = 15
#: Share, and number, of fitted texts of a band that may lie beyond its limit, as stray ones; and texts that a band needs for a limit of its own.
BEYOND, STRAY, BAND_TEXTS = 0.01, 2, 20
#: A cluster of a smaller share of its language's texts is dropped: it would stand for stray texts.
LEAST_CLUSTER = 0.05

_BLANK = 0x20
_LETTERS = np.full(256, _BLANK, np.uint32)
for _b in (*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)):
    _LETTERS[_b] = _b


def _bucket(grams: np.ndarray) -> np.ndarray:
    return grams * np.uint32(2654435761) >> np.uint32(20)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the n-grams by bucket; runs of blanks alone don't count."""
    counts = np.zeros(DIMS, np.float32)
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(data), BLOCK_BYTES):
        one = _LETTERS[data[at : at + BLOCK_BYTES + 2]]
        two = one[:-1] << np.uint32(8) | one[1:]
        three = two[:-1] << np.uint32(8) | one[2:]
        last = at + BLOCK_BYTES >= len(data)
        for grams, blank in ((one, _BLANK), (two, 0x2020), (three, 0x202020)):
            grams = grams if last else grams[:BLOCK_BYTES]
            counts += np.bincount(_bucket(grams[grams != blank]), minlength=DIMS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray  # [centroid, dimension], of unit length
    languages: list[str]  # of each centroid
    limits: np.ndarray  # [centroid, band]: the cosine that few fitted texts of its language stay below

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None], slack: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine) and rejection of each text."""
        langs, scores, rejected = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for a in range(0, len(texts), BLOCK_TEXTS):
            block = texts[a : a + BLOCK_TEXTS]
            counts = np.stack([gram_counts(t) for t in block])
            cosines = self.vectors(counts) @ self.centroids.T
            best = cosines.argmax(1)
            score = np.clip(cosines[np.arange(len(block)), best], 0, 1)
            known = np.array([has_letter(t) for t in block])
            reach = slack * self.limits[best, band(counts)]
            langs += [self.languages[c] if k else UNKNOWN for c, k in zip(best, known, strict=True)]
            scores[a : a + len(block)] = np.where(known, score, 0)
            rejected[a : a + len(block)] = ~known | (score < reach)
        return langs, scores, rejected


def band(counts: np.ndarray) -> np.ndarray:
    """Band of each text's number of n-grams."""
    return np.clip(np.log2(np.maximum(counts.sum(1), 1)).astype(int), 0, BANDS - 1)


def _clustered(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of a spherical k-means. Starts with rows far from each other; clusters too small to stand for more than stray rows are dropped."""
    chosen = [0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centroids = x[chosen]
    for turn in range(2 * rounds):
        own = (x @ centroids.T).argmax(1)
        if turn == rounds:
            sizes = np.bincount(own, minlength=len(centroids))
            centroids = centroids[sizes >= min(LEAST_CLUSTER * len(x), sizes.max())]
            if sizes.max() > 2 * LEAST_CLUSTER * len(x) * k and len(centroids) < min(k, len(x)):  # halves of the largest stand in for the dropped ones
                centroids = _split(x, centroids, min(k, len(x)))
            own = (x @ centroids.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _split(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """k centroids: the largest cluster is halved along its first principal direction until there are as many."""
    while len(centroids) < k:
        own = (x @ centroids.T).argmax(1)
        largest = int(np.bincount(own, minlength=len(centroids)).argmax())
        rows = x[own == largest] - centroids[largest]
        direction = np.random.default_rng(0).normal(size=x.shape[1]).astype(x.dtype)
        for _ in range(8):
            direction = rows.T @ (rows @ direction)
            direction /= max(float(np.linalg.norm(direction)), 1e-12)
        spread = direction * max(float(np.std(rows @ direction)), 1e-6)
        halves = np.stack([centroids[largest] + spread, centroids[largest] - spread])
        halves /= np.maximum(np.linalg.norm(halves, axis=1, keepdims=True), 1e-12)
        centroids = np.concatenate([np.delete(centroids, largest, 0), halves])
    return centroids


def _limits(bands: np.ndarray, cosines: np.ndarray, instead: np.ndarray | None = None) -> np.ndarray:
    """The low quantile of the cosines of each band; a band of few texts has the limit `instead` or, without one, that of the nearest shorter band,
    the shortest ones none."""
    out, last = np.zeros(BANDS), 0.0
    for b in range(BANDS):
        own = cosines[bands == b]
        if len(own) >= BAND_TEXTS:
            last = float(np.quantile(own, max(BEYOND, STRAY / len(own))))
            out[b] = last
        else:
            out[b] = last if instead is None else instead[b]
    return out


def fit_languages(labelled: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = 2000, centroids: int = 4, most_languages: int = 1000) -> LanguageModel | None:
    """Fits on rows with a language: document frequencies over all of them; centroids on a sample of about fit_rows rows in
    all, as many of each language as it has up to its equal share, by a hash of id and text; repeated rows count once in the sample.
    Every label is learned, however few rows have it; a table of more than most_languages labels is refused, as a model holds all of them.
    Null and empty texts teach nothing; long ones are counted whole. None if there is no row with a language."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = rows.groupBy("lang").count()
    total = rows.count()
    sizes = {r["lang"]: r["count"] for r in counted.limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages, or clean the labels")
    if not sizes:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += gram_counts(t.as_py()) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS)), pa.array(total)], names=["bucket", "n"])

    seen = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS)
    for r in seen:
        df[r["bucket"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    share = max(1, fit_rows // len(sizes))
    place = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(share / v)))), F.col("lang")), F.lit(0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(a, BLOCK_TEXTS)
                made = pa.array([gram_counts(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["id", "lang", "counts"])

    drawn = checkpoint(rows.filter(place < rate).dropDuplicates(["id", "lang", "text"]).repartition("id", "text"))
    sample = drawn.mapInArrow(features, "id string, lang string, counts binary")
    fitted = sorted((r["lang"], r["id"] or "", bytes(r["counts"])) for r in sample.collect())
    none = np.zeros((0, DIMS), np.float32)
    model = LanguageModel(idf, none, [], np.zeros((0, BANDS)))
    means: dict[str, np.ndarray] = {}
    for language in sorted({r[0] for r in fitted}):
        counts = np.stack([np.frombuffer(r[2], np.float32) for r in fitted if r[0] == language])
        if counts.any():
            means[language] = _clustered(model.vectors(counts[counts.any(axis=1)]), centroids)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if language in means and text:
                    counts = np.stack([gram_counts(t) for t in (text, *(text[:n] for n in CUTS if n < len(text)))])
                    near = (model.vectors(counts) @ means[language].T).max(1)
                    out += [(language, int(b), float(c)) for b, c in zip(band(counts), near, strict=True)]
            langs, bands, cosines = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bands, pa.int32()), pa.array(cosines, pa.float64())], names=["lang", "band", "cosine"])

    far: dict[str, list[tuple[int, float]]] = {}
    for r in drawn.select("lang", "text").mapInArrow(distances, "lang string, band int, cosine double").collect():
        far.setdefault(r["lang"], []).append((r["band"], r["cosine"]))
    arrays = {language: tuple(np.array(x) for x in zip(*pairs, strict=True)) for language, pairs in far.items()}
    general = _limits(*(np.concatenate(x) for x in zip(*arrays.values(), strict=True))) if arrays else None
    for language, own in means.items():
        limits = np.tile(_limits(*arrays[language], general), (len(own), 1))
        model = LanguageModel(idf, np.concatenate([model.centroids, own]), model.languages + [language] * len(own), np.concatenate([model.limits, limits]))
    return model if model.languages else None


def identify_languages(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", slack: float = 0.6) -> DataFrame:
    """All rows and columns, and lang_pred, score (0 to 1) and rejected.

    A text that is null or has no letter is `und`, of score 0, and rejected; others get the language of the nearest centroid (of equally
    near ones the first, in order of languages), and are rejected if its cosine is below the centroid's limit for texts of that length.
    A text of any length is read whole. Without a model all are `und`. Rows are independent, so repeated ones get the same; an empty table
    stays empty. Input columns of those names are replaced.
    """
    kept = others(docs, "lang_pred", "score", "rejected")
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(a, BLOCK_TEXTS)
                n, texts = part.num_rows, part.column(kept.index(text)).to_pylist()
                langs, scores, rejected = model.predict(texts, slack) if model else ([UNKNOWN] * n, np.zeros(n), np.ones(n, bool))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores.astype(float)), pa.array(rejected)], names=[*kept, "lang_pred", "score", "rejected"])

    return docs.select(*kept).mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

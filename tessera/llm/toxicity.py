"""Toxicity by weak supervision.

Many voters look at a text: a word of a lexicon each, and patterns. A generative label model gives each voter a rate of
voting on toxic and on clean texts, found by expectation maximisation on the votes; voters that agree more than these rates
explain are correlated, and share their weight. A linear classifier on word and pattern features learns the model's posterior labels, and its
scores are calibrated on labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, held_out, others, read

#: Insults and abuse of English, German, French and Spanish.
LEXICON = (
    "idiot idiots idiotic moron morons moronic imbecile stupid dumb fool fools dimwit halfwit trash garbage scum filth vermin "
    "pathetic worthless useless loser losers disgusting repulsive vile clown clowns freak creep pig pigs bastard bastards bitch "
    "asshole assholes jerk shit bullshit crap fuck fucking fucker damn slut whore cunt retard retarded "
    "dummkopf trottel depp abschaum versager wertlos arschloch scheisse scheiße ekelhaft hurensohn idioten "
    "imbécile connard connasse salaud ordure crétin débile merde minable nul putain abruti dégueulasse "
    "idiota idiotas imbécil estúpido estúpida basura escoria inútil perdedor asqueroso payaso mierda puta cabrón pendejo"
).split()
#: Threats and dismissals, as phrases.
PHRASES = (
    "shut up", "go to hell", "kill yourself", "i will kill", "hope you die", "drop dead", "you people", "get lost", "hate you",
    "halt die klappe", "geh zur hölle", "ferme la", "va te faire", "cállate", "vete al infierno",
)
TERMS = (*LEXICON, *PHRASES)
#: Texts scored together.
BLOCK_TEXTS = 256
#: Patterns, voters too, of the hits of all terms that tell something.
PATTERNS = ("two hits", "four hits", "two different terms", "a hit in a hundred words", "a hit in twenty words", "shouting", "exclamations", "no hit")
WORD = re.compile(r"[^\W\d_]+")
#: A voter's weight in log odds is below this.
MOST_LOG_ODDS = 8.0
#: Learned stems: beginnings of words, of so many letters, in this share of the toxic texts at least and so much likelier there.
STEM_LETTERS, STEM_SHARE, STEM_LOG_ODDS = range(4, 8), 0.03, 3.5


@lru_cache(maxsize=4)
def _automaton(stems: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, term in enumerate((*TERMS, *(x for x, _ in stems))):
        same = found.get(term, ())
        found.add_word(term, (*same, (k, len(term), k >= len(TERMS))))
    found.make_automaton()
    return found


def features(text: str | None, stems: tuple[tuple[str, int], ...] = ()) -> np.ndarray:
    """Counts of the terms as whole words and of the stems as beginnings of words (0 if they occur too seldom to tell); then the number of words, shouting, exclamations."""
    n = len(TERMS) + len(stems)
    out = np.zeros(n + 3, np.float32)
    text = text or ""
    lower = text.lower()
    for end, hits in _automaton(stems).iter(lower):
        for k, size, stem in hits:
            before = lower[end - size] if end >= size else ""
            if not before.isalnum() and (stem or not lower[end + 1 : end + 2].isalnum()):
                out[k] += 1
    for k, (_, least) in enumerate(stems, len(TERMS)):
        out[k] *= out[k] >= least
    words = lower.count(" ") + lower.count("\n") + 1
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    capitals, smalls = np.count_nonzero((data >= 65) & (data <= 90)), np.count_nonzero((data >= 97) & (data <= 122))
    out[n:] = (words, capitals > smalls, text.count("!") * 10 >= words)
    return out


def shaped(x: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Features of rows: logarithmic counts of the telling terms and stems, then the patterns as 0 or 1."""
    counts, (words, shouting, exclaiming) = x[:, :-3] * telling, x[:, -3:].T
    hits = counts.sum(1)
    patterns = (hits >= 2, hits >= 4, (counts > 0).sum(1) >= 2, (hits > 0) & (hits * 100 >= words), (hits > 0) & (hits * 20 >= words), shouting > 0, exclaiming > 0, hits == 0)
    return np.column_stack([np.log1p(counts), *patterns]).astype(float)


@dataclass
class LabelModel:
    """Rates of a vote on toxic and clean texts, the share of toxic texts, correlations and each voter's share of its weight."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    correlation: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.where(votes, np.log(self.on_toxic / self.on_clean), np.log((1 - self.on_toxic) / (1 - self.on_clean)))
        total = np.log(self.prior / (1 - self.prior)) + np.clip(odds, -MOST_LOG_ODDS, MOST_LOG_ODDS) @ self.share
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_label_model(votes: np.ndarray, known: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """votes [row, voter] 0 or 1; known: 1, 0, or -1 where there is no label. Labelled rows hold the posteriors of the others in place."""
    model = LabelModel(prior, *(np.full(votes.shape[1], 0.5),) * 2, np.eye(votes.shape[1]), np.ones(votes.shape[1]))
    held = np.where(known > 0, 0.95, 0.02)
    q = np.where(known >= 0, held, np.where(votes[:, : -len(PATTERNS)].sum(1) >= 2, 0.8, 0.02))
    for _ in range(rounds):
        toxic, clean = q.sum(), (1 - q).sum()
        model.on_toxic = (q @ votes + 0.1) / (toxic + 0.2)
        model.on_clean = ((1 - q) @ votes + 0.1) / (clean + 0.2)
        # what voters agree on beyond these rates: correlation of the residuals
        left = votes - (q[:, None] * model.on_toxic + (1 - q)[:, None] * model.on_clean)
        scale = np.sqrt((left**2).mean(0)) + 1e-9
        model.correlation = left.T @ left / len(votes) / scale / scale[:, None]
        np.fill_diagonal(model.correlation, 1.0)
        model.share = 1 / np.maximum(1, (np.where(model.correlation > 0.1, model.correlation, 0) ** 2).sum(1))
        model.prior = float(np.clip(0.5 * prior + 0.5 * q.mean(), 1e-4, 0.9))
        q = np.where(known >= 0, held, model.posterior(votes))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, the last one the constant's, unpenalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    labels: LabelModel
    stems: tuple[tuple[str, int], ...]
    telling: np.ndarray  # which terms and stems count
    weights: np.ndarray
    scale: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = shaped(np.stack([features(t, self.stems) for t in texts]), self.telling) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.offset, -30, 30)))


def learn_stems(labelled: DataFrame) -> tuple[tuple[str, int], ...]:
    """(beginning of a word, least occurrences) that tell toxic texts, of labelled rows (text, toxic). Copies of a text, which share the
    least hash of their words, count once; so one copied text can't make its words telling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stem, family, once, twice = [], [], [], []
            clean: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(w for w in WORD.findall((text or "").lower()) if len(w) >= STEM_LETTERS[0])
                stems: Counter[str] = Counter()
                for w, n in words.items():
                    for k in STEM_LETTERS[: len(w) - STEM_LETTERS[0] + 1]:
                        stems[w[:k]] += n
                if toxic:
                    least = min((zlib.crc32(w.encode()) for w in words), default=0)
                    stem += stems
                    family += [least] * len(stems)
                    once += [1] * len(stems)
                    twice += [int(n > 1) for n in stems.values()]
                else:
                    for x, n in stems.items():
                        c = clean.setdefault(x, [0, 0])
                        c[0] += 1
                        c[1] += n > 1
            stem += clean
            family += [None] * len(clean)
            once += [c[0] for c in clean.values()]
            twice += [c[1] for c in clean.values()]
            yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(family, pa.int64()), pa.array(once, pa.int64()), pa.array(twice, pa.int64())], names=["stem", "family", "once", "twice"])

    rows = checkpoint(labelled.filter("toxic is not null").select("text", "toxic").mapInArrow(run, "stem string, family long, once long, twice long"))
    families = rows.agg(F.count_distinct("family")).first()[0]
    least = max(4, math.ceil(STEM_SHARE * families))
    toxic = rows.filter("family is not null").groupBy("stem", "family").agg(F.max("twice").alias("twice"))
    common = toxic.groupBy("stem").agg(F.count("*").alias("t1"), F.sum("twice").alias("t2")).filter(F.col("t1") >= least)
    clean = rows.filter("family is null").groupBy("stem").agg(F.sum("once").alias("c1"), F.sum("twice").alias("c2"))
    seen = common.join(clean, "stem", "left").collect()  # at most the stems of 1 / STEM_SHARE texts
    n_clean = labelled.filter("toxic = 0").count()
    found = []
    for r in seen:
        for n in (1, 2):
            t, c = r[f"t{n}"], r[f"c{n}"] or 0
            odds = math.log((t + 0.5) / (families + 1)) - math.log((c + 0.5) / (n_clean + 1))
            if t >= least and odds >= STEM_LOG_ODDS:
                found.append((-t * odds, n, r["stem"]))
    chosen: list[tuple[str, int]] = []
    for _, n, stem in sorted(found):
        if not any(stem.startswith(x) or x.startswith(stem) for x, _ in chosen):
            chosen.append((stem, n))
    return tuple(chosen)


def draw_sample(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, fit_rows: int, seed: int) -> DataFrame:
    """(id, text, toxic) of about fit_rows rows, by hashes: up to three quarters of them labelled (all labelled ids if there are fewer), the others
    of all rows without a label in that part. Rows equal in id and text count once, the largest label of an id counts."""
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")).filter("id is not null and toxic is not null")
    place = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    labelled = 3 * fit_rows // 4
    chosen = checkpoint(known.filter(place(F.col("id").cast("string")) < labelled / max(known.count(), 1)))  # about 3/4 fit_rows ids, so small enough to broadcast
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    with_label = checkpoint(rows.join(F.broadcast(chosen), "id").dropDuplicates(["id", "text"]))
    n, total = with_label.count(), rows.count()
    rest = rows.filter(place(F.col("id").cast("string"), "text") < (fit_rows - min(n, labelled)) / max(total, 1))
    rest = rest.join(F.broadcast(chosen), "id", "left_anti").dropDuplicates(["id", "text"]).join(F.broadcast(chosen).select("id", "toxic"), "id", "left")
    return checkpoint(with_label.select("id", "text", "toxic").unionByName(rest.select("id", "text", "toxic")).repartition("id", "text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", fit_rows: int = 20_000, seed: int = 5) -> ToxicityModel | None:
    """Fits on a sample of about fit_rows rows of docs, three quarters of them labelled if there are as many; labels (doc_id, toxic) give stems,
    hold the label model in place and calibrate the scores. Null and empty texts are texts without a hit; long texts count whole;
    ties between voters go to the first. None if the sample is empty."""
    sample = draw_sample(docs, labels, text=text, doc_id=doc_id, fit_rows=fit_rows, seed=seed)
    stems = learn_stems(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([features(t, stems).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2)], names=["id", "x", "toxic"])

    schema = T.StructType([sample.schema["id"], T.StructField("x", T.BinaryType()), sample.schema["toxic"]])
    rows = sorted(((r["id"], r["x"], r["toxic"]) for r in sample.select("id", "text", "toxic").mapInArrow(run, schema).collect()), key=lambda r: (str(r[0]), r[1]))
    if not rows:
        return None
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows])
    y = np.array([-1 if r[2] is None else r[2] for r in rows])
    share = (np.count_nonzero(y == 1) + 1) / (np.count_nonzero(y >= 0) + 10)
    telling = np.ones(x.shape[1] - 3)
    for _ in range(2):  # again without the terms that say nothing
        made = shaped(x, telling)
        votes = (made > 0).astype(float)
        model = fit_label_model(votes, y, share)
        telling = telling * (model.on_toxic > 4 * model.on_clean)[: len(telling)]
    made = shaped(x, telling)
    votes = (made > 0).astype(float)
    model = fit_label_model(votes, y, share)
    weights = _logistic(made, model.posterior(votes), 1.0)
    scale, offset = 1.0, 0.0
    if 0 < np.count_nonzero(y == 1) < np.count_nonzero(y >= 0):
        raw = made[y >= 0] @ weights[:-1] + weights[-1]
        scale, offset = _logistic(raw[:, None], y[y >= 0], 0.01)
    return ToxicityModel(model, stems, telling, weights, max(float(scale), 0.05), float(offset))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text") -> DataFrame:
    """All rows and columns, and toxicity, a double from 0 to 1.

    Null and empty texts are scored as texts without a hit, long ones whole; without a model all score 0. Rows are independent, so
    repeated ones score alike; an empty table stays empty; an input column named toxicity is replaced.
    """
    kept = others(docs, "toxicity")
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(a, BLOCK_TEXTS)
                scores = model.scores(part.column(kept.index(text)).to_pylist()) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*kept, "toxicity"])

    return docs.select(*kept).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"))
    model = fit_toxicity(docs.filter(~out), read(spark, sf_dir, "labels").filter(~out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))

"""Repeated rows, large numbers, ids and rates, clashing names, and brute force for language ID, sharding and toxicity."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat_format, language_id, line_dedup, media, mixing, sharding, simhash, top_k, toxicity
from tests.helpers import SF

POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 10


# 1


def test_language_id_equals_brute_force(spark):
    """Counts, TF-IDF, cosines and limits anew, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit_languages(docs)
    rows = language_id.identify_languages(docs.filter("doc_id < 40"), model).collect()
    df, n = Counter(), 0

    def grams(text):
        data = text.lower().encode()
        shown = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in data)
        found = Counter()
        for size in (1, 2, 3):
            for i in range(len(shown) - size + 1):
                g = shown[i : i + size]
                if g != b" " * size:
                    found[int.from_bytes(g, "big") * 2654435761 % 2**32 >> 20] += 1
        return found

    for r in docs.filter("lang is not null").collect():
        n += 1
        df.update(grams(r["text"] or "").keys())
    idf = [math.log((1 + n) / (1 + df[b])) + 1 for b in range(language_id.DIMS)]
    for r in rows:
        found = grams(r["text"] or "")
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        v = {b: math.log1p(c) * idf[b] for b, c in found.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(m[b]) for b, x in v.items()) / length for m in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r["lang_pred"] == model.languages[best] and math.isclose(r["score"], cosines[best], abs_tol=1e-4)
        limit = 0.6 * model.limits[best][min(language_id.BANDS - 1, int(math.log2(sum(found.values()))))]
        assert r["rejected"] == (cosines[best] < limit) or abs(cosines[best] - limit) < 1e-4


def test_language_id_rejects_short_and_long_texts_of_unseen_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_languages(docs.filter("doc_id % 2 = 0"))
    rng = np.random.default_rng(0)
    strange = ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz    "], n)) for n in (60, 200, 1000, 5000)]
    strange += [POLISH[:n] for n in (60, 200, 1000)] + ["漢字仮名交じり文は日本語の文章である。" * n for n in (2, 50)]
    assert model.predict(strange, 0.6)[2].all()
    clean = [r["text"] for r in docs.filter("doc_id % 2 = 1 and lang is not null").collect()]
    assert model.predict(clean, 0.6)[2].mean() < 0.01
    assert model.predict([t[:60] for t in clean], 0.6)[2].mean() < 0.02


def test_language_id_learns_rare_labels_and_refuses_too_many(spark):
    rows = [(i, f"the quick brown fox number {i}", "en") for i in range(300)] + [(1000 + i, f"ganz andere worte {i}", f"rare{i}") for i in range(3)]
    rows += [(7, "the same row again", "en")] * 200
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(table, fit_rows=50)
    assert set(model.languages) == {"en", "rare0", "rare1", "rare2"}
    with pytest.raises(ValueError):
        language_id.fit_languages(table, most_languages=3)


# 2


def test_shards_cut_repeated_rows(spark):
    same = spark.range(1000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("all the same").alias("text"))
    rows = sharding.shard_documents(same, shards=16).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 1000 and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 4
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == [*range(sizes[s])]


def test_splitters_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(-(2**63), 2**63)), int(rng.integers(-(2**63), 2**63)), int(rng.integers(1, 500))) for _ in range(500)] + [(77, int(g), 3) for g in rng.integers(-(2**63), 2**63, 400)]
    slim = spark.createDataFrame(rows, "__h long, __g long, __size long")
    found = sharding.find_splitters(slim, 8, 0.0)
    ordered = sorted(rows)
    total, upto, want = sum(r[2] for r in rows), 0, []
    borders = [0]
    for r in ordered:
        upto += r[2]
        borders.append(upto)
    for i in range(1, 8):
        target = total * i // 8
        want.append(min(abs(b - target) for b in borders))
    for s, i, least in zip(found, range(1, 8), want, strict=True):
        below = sum(r[2] for r in rows if (r[0], r[1]) < (s.text_hash, s.id_hash))
        assert below == s.bytes_below and abs(below - total * i // 8) == least


# 3


def test_component_ids_of_large_negative_and_missing_ids(spark):
    ids = [2**62 + 1, 2**63 - 1, -5, None]
    rows = [(i, f"a text of its own {i} with words") for i in ids] + [(2**62 + 9, f"a text of its own {2**62 + 1} with words")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2**62 + 9] == got[2**62 + 1] == 2**62 + 1 and got[2**63 - 1] == 2**63 - 1 and got[-5] == -5 and got[None] is None


@pytest.mark.parametrize("many", [(0, 10**9), (0, 0)])
def test_more_parts_key_the_same_links(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many[0])
    monkeypatch.setattr(simhash, "VERY_MANY", many[1])
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 20)
    fps = []
    for b in base:
        for _ in range(5):
            x = int(b)
            for bit in rng.integers(0, 63, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x,) for x in fps], "__node long")
    edges = simhash.link_buckets(nodes, simhash.exact_keys(10**7, 3), 3)
    got = {x: x for x in fps} | {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    want = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3 and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert got == want


def test_near_dedup_joins_where_rows_are_too_many_to_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice([*"abcdefgh"], 5)) for _ in range(900)]
    rows = []
    for i in range(30):
        w = [str(x) for x in rng.choice(words, 80)]
        rows += [(3 * i + k, " ".join([*w[: 80 - 3 * k], *(["x"] * k)])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit("mine")).withColumn("__Key", F.lit(1))
    wide = sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect())
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash, "REMEMBERED", 50)
    again = simhash.near_dedup(docs)
    assert sorted(r["doc_id"] for r in again.collect()) == wide and 30 <= len(wide) < 90
    assert again.columns == ["doc_id", "text", "__row", "__Key"] and again.first()["__row"] == "mine"


def test_spanning_links_are_links(spark):
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 256, (200, 8), dtype=np.uint8)
    fps[50:] = fps[rng.integers(0, 50, 150)]
    fps[100:, 3] ^= rng.integers(0, 4, 100).astype(np.uint8)
    label, i, j = simhash.spanning_links(fps, np.zeros(200, np.int64), np.zeros(200, np.uint8), 2)
    bits = np.unpackbits(fps, axis=1)
    assert ((bits[i] != bits[j]).sum(1) <= 2).all() and len(i) == 200 - len(set(label))
    assert (simhash.merge_labels(np.arange(200), i, j) == label).all()


# 4


def test_long_media_are_decoded_in_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(0).integers(32, 127, 12_000_000, dtype=np.uint8).tobytes()
    files = media.encode_payloads([text])
    tracemalloc.start()
    images = media.decode_thumbnails(files)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(t.tobytes() for _, t in images)[: len(text)] == text
    assert peak < 12 * len(text) + 250_000_000


# 5


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    stems = [s for s, _ in model.stems]
    for r in toxicity.score_toxicity(docs.filter("doc_id < 120"), model).select("text", "toxicity").collect():
        text = r["text"] or ""
        lower = text.lower()

        def times(term, stem):
            n, at = 0, lower.find(term)
            while at >= 0:
                after = lower[at + len(term) : at + len(term) + 1]
                n += not (at and lower[at - 1].isalnum()) and (stem or not after.isalnum())
                at = lower.find(term, at + 1)
            return n

        counts = [times(t, False) for t in toxicity.TERMS] + [n if (n := times(s, True)) >= least else 0 for s, least in model.stems]
        counts = [c * t for c, t in zip(counts, model.telling, strict=True)]
        hits, words = sum(counts), lower.count(" ") + lower.count("\n") + 1
        capitals, smalls = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
        shown = [math.log1p(c) for c in counts] + [hits >= 2, hits >= 4, sum(c > 0 for c in counts) >= 2, hits > 0 and hits * 100 >= words, hits > 0 and hits * 20 >= words, capitals > smalls, text.count("!") * 10 >= words, hits == 0]
        raw = sum(w * float(x) for w, x in zip(model.weights, [*shown, 1.0], strict=True))
        assert math.isclose(r["toxicity"], 1 / (1 + math.exp(-max(-30, min(30, model.scale * raw + model.offset)))), abs_tol=1e-6)
    assert stems == [s for s, _ in model.stems]


def test_sample_takes_labelled_rows_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(60).select((F.col("id") * 50).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    draw = lambda l, n: toxicity.draw_sample(docs.union(docs.filter("doc_id < 50")), l, text="text", doc_id="doc_id", fit_rows=n, seed=5).collect()
    rows = draw(labels, 400)
    assert sum(r["toxic"] is not None for r in rows) == 60 and 250 < len(rows) < 450 and len({r["id"] for r in rows}) == len(rows)
    rows = draw(labels, 40)
    assert 10 < sum(r["toxic"] is not None for r in rows) < 50


# 6


def test_tied_turns_are_ordered_by_their_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", t) for t in ("zz", "<|a", "~b", "{c")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns).select(chat_format.parse_formatted(F.col("formatted")).alias("t")).first()["t"]
    assert [x["text"] for x in out] == sorted(["zz", "<|a", "~b", "{c"])


# 7


def test_bpe_of_another_pattern_and_bounded_memory(monkeypatch):
    import public_tokenizers
    import tiktoken

    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert public_tokenizers.PATTERN == byte_bpe.SPACED_PATTERN
    pattern = r"[A-Za-z]{1,3}|\s+|[^\sA-Za-z]+"
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = byte_bpe.Codec(byte_bpe.serialise_model(tokens), pattern)
    for text in ("abc defg  hi", "longer words than three, and 123 numbers", ""):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == theirs.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "CACHE_CHARS", 1000)
    codec = byte_bpe.Codec(codec.model.serialized_model_proto(), byte_bpe.SPACED_PATTERN)
    for i in range(30):
        codec.encode([" ".join(f"{'x' * 50}{i}{j}" for j in range(10))])
        assert codec.chars <= 1000 + 600


# 8


def test_repeated_vectors_count_once_and_large_ones_are_refused(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    schema = "vec_id long, v array<double>"
    once = spark.createDataFrame(rows, schema)
    several = spark.createDataFrame(rows + [rows[0]] * 3 + [rows[1]] * 5 + [(2, [50.0, 50.0])], schema)
    ask = lambda v: sorted(map(tuple, top_k.top_k_products(v, v.filter("vec_id % 50 = 0")).collect()))
    assert ask(once) == ask(several)
    large = spark.createDataFrame([(0, [2.0**31 - 1] * 4), (50, [2.0**31 - 1] * 4)], schema)
    with pytest.raises(ValueError, match="64 bits"):
        top_k.top_k_products(large, large)


# 9, 10 and names


@pytest.mark.parametrize("rate", [0.4, 3.0, 700.0, 1e5, 1e6])
def test_poisson_distribution_of_any_rate(spark, rate):
    rates = spark.createDataFrame([("a", rate), ("none", 0.0), (None, 1.0)], "__source string, __rate double")
    got = {r["__source"]: r for r in mixing.poisson_distributions(rates).collect()}
    assert set(got) == {"a", None}
    low, cdf = got["a"]["__low"], got["a"]["__cdf"]
    weight, upto, want = Fraction(1), Fraction(0), []
    exact = rate <= 1000
    if exact:
        r = Fraction(rate)
        for k in range(low + len(cdf)):
            weight = weight * r / k if k else Fraction(1)
            upto += weight
            want.append(upto)
        want = [float(w / upto) for w in want[low:]]
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(cdf, want, strict=True))
    else:
        # sums of logarithms from the mode outwards
        mode = int(rate)
        logs = {mode: 0.0}
        for k in range(mode + 1, low + len(cdf)):
            logs[k] = logs[k - 1] + math.log(rate / k)
        for k in range(mode, low, -1):
            logs[k - 1] = logs[k] - math.log(rate / k)
        total = math.fsum(math.exp(v) for v in logs.values())
        upto = 0.0
        for k, p in enumerate(cdf, low):
            upto += math.exp(logs[k]) / total
            assert math.isclose(p, upto, abs_tol=1e-9)
        assert abs(next(k for k, p in enumerate(cdf, low) if p >= 0.5) - rate) < 2


def test_mix_of_a_rare_source(spark):
    docs = spark.range(200_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("common").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(docs).groupBy("source").count().collect()}
    assert abs(counts["rare"] - 100_000) < 2000 and abs(counts["common"] - 100_000) < 2000


def test_columns_named_as_the_operators_own_stay(spark):
    docs = spark.createDataFrame([(i, f"one\ntwo\nthree\n{i % 3}", "s") for i in range(12)], "doc_id long, text string, source string")
    mine = docs.withColumns({c: F.lit(f"my {c}") for c in ("__h", "__g", "__n", "__th", "__id", "__own", "__source", "__cdf", "__text", "__fp", "__row", "__cell", "__unit", "__low", "Score", "LANG_PRED", "IDS", "Toxicity")})
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = [c for c in mine.columns if c.startswith("__")]
    for out in (
        sharding.shard_documents(mine, shards=2), line_dedup.dedup_lines(mine), mixing.mix_sources(mine), simhash.near_dedup(mine),
        byte_bpe.encode_documents(mine, vocabulary=vocabulary, pattern=public_tokenizers.PATTERN), language_id.identify_languages(mine, None), toxicity.score_toxicity(mine, None),
    ):
        r = out.first()
        assert all(r[c] == f"my {c}" for c in kept)


def test_near_dedup_where_a_hash_has_many_labels(spark, monkeypatch):
    """Texts that all share some shingles, and pairs of them that are alike, by both ways of meeting."""
    from tests.llm.test_operators import kept_by_brute_force

    rng = np.random.default_rng(12)
    words = ["".join(rng.choice([*"abcdefgh"], 5)) for _ in range(2000)]
    base, rows = [str(x) for x in rng.choice(words, 60)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.integers(1, 4)):  # each run changes five shingles and more
            at = int(rng.integers(0, 55))
            w[at : at + 2] = [str(x) for x in rng.choice(words, rng.integers(0, 4))]
        rows.append((i, " ".join(w)))
    want = kept_by_brute_force(rows)
    assert 3 < len(want) < 58
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most, lanes in ((64, 4), (1, 4), (1, 1)):
        monkeypatch.setattr(simhash, "FEW_LABELS", most)
        monkeypatch.setattr(simhash, "RADIUS_SLACK", 0.02 if lanes == 4 else -0.15)  # without links by fingerprints
        assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == want

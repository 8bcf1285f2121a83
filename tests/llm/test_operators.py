"""The training-data operators: SQL twins, brute force, exact round trips, held-out accuracy and odd inputs."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat_format, language_id, line_dedup, media, mixing, sharding, simhash, top_k, toxicity
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import SF, spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "one\ntwo\nthree\nfour", "en", "a", 18), (1, "one\ntwo\nthree\nfour", "en", "a", 18), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "Über\nalles\nund\nnichts <|end|> ~1", "de", "b", 3),
    (4, "x " * 60_000, "en", "a", 5), (5, "one\ntwo\nthree\nfive", "en", "b", 18), (6, "🎉 123", None, "c", 5), (7, "\n\n\n", "fr", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    clashing = "size shard slot copy mix_key n_lines removed_lines lang_pred score rejected toxicity ids media payload feature n_bytes".split()
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in clashing})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = spark_rows(QUERIES[name](spark, SF)), sql_rows(ORACLE_SQL[name])
    assert ours == theirs and theirs[1]


def table(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 1


def test_language_id_learns_and_rejects(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    model = language_id.fit_languages(docs)
    strange = spark.createDataFrame([(1, "漢字仮名交じり文は日本語の文章である。" * 20), (2, "12345 678"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(strange, model).collect()}
    assert all(got[i]["rejected"] for i in (1, 2, 3)) and got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[3]["score"] == 0
    assert language_id.identify_languages(odd, model).count() == len(ODD)
    assert language_id.identify_languages(empty, model).count() == 0
    assert language_id.fit_languages(empty) is None and language_id.identify_languages(odd, None).filter("lang_pred <> 'und'").count() == 0


# 2


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    rows = QUERIES["op2_histogram_shards"](spark, SF).collect()
    texts = table(spark)
    assert len(rows) == len(texts)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(16):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == [*range(len(own))]
        assert abs(sum(r["size"] for r in own) - total / 16) <= most + 2


def test_shards_split_one_hot_text(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("copy of a text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["bytes"] for r in sharding.shard_documents(hot, shards=4).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 0.02 * sum(sizes)


def test_shards_of_odd_and_empty_tables(odd, empty):
    rows = sharding.shard_documents(odd, shards=3).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r["text"] is None} == {1}
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == [*range(sum(r["shard"] == s for r in rows))]
    assert sharding.shard_documents(empty).count() == 0


# 3


def fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(fps: dict, radius: int) -> dict:
    label = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def test_simhash_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_simhash_components"](spark, SF).collect()}
    fps = {i: fingerprint(t) for i, t in table(spark).items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == brute_components(fps, 3)


@pytest.mark.parametrize("split", [False, True])
def test_bit_sliced_links_equal_brute_force(split):
    rng = np.random.default_rng(3)
    for radius in (0, 1, 3, 9):
        base = rng.integers(0, 256, (12, 8), dtype=np.uint8)
        fps = base[rng.integers(0, 12, 300)]
        flips = rng.integers(0, 64, (300, 6))
        bits = np.unpackbits(fps, axis=1)
        for i, f in enumerate(flips):
            bits[i, f[: rng.integers(0, 6)]] ^= 1
        fps = np.packbits(bits, axis=1)
        groups = np.sort(rng.integers(0, 4, 300))
        side = rng.integers(0, 2, 300).astype(np.uint8) if split else np.zeros(300, np.uint8)
        label = simhash.link_groups(fps, groups, side, radius)
        distance = (bits[:, None] != bits[None]).sum(2)
        linked = (distance <= radius) & (groups[:, None] == groups[None]) & ((side[:, None] != side[None]) if split else True)
        want = np.arange(300)
        for i, j in zip(*np.nonzero(linked), strict=True):
            want = simhash.merge_labels(want, np.array([i]), np.array([j]))
        assert (label == want).all()


def test_simhash_hot_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rows = QUERIES["op3_simhash_components"](spark, SF).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(fps, 3)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_simhash_of_odd_and_empty_tables(odd, empty):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD) and all(r["fingerprint"] == "0" * 16 and r["component_id"] == 2 for r in rows if r["doc_id"] in (2, 3, 7))
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.simhash_components(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.near_dedup(odd).collect()]
    assert Counter(kept)[1] == 1 and 2 in kept and 3 not in kept and None in kept
    assert simhash.near_dedup(empty).count() == 0


def test_near_dedup_finds_near_copies_and_keeps_the_rest(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice([*"abcdefgh"], 6)) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(20):  # two words changed of 200: 0.9 of the shingles are alike
        w = texts[i].split()
        w[50], w[150] = "changed", "words"
        rows.append((100 + i, " ".join(w)))
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [*range(40)]


def kept_by_brute_force(rows):
    """Least ids of the components of all pairs at 0.8 or more."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return sorted(set(label.values()))


def test_near_dedup_keeps_the_exact_classes_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in docs.collect()]
    want = kept_by_brute_force(rows)
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == want and len(want) == 922


def kept_by_near_dedup(spark, rows):
    return sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_near_dedup_links_at_the_threshold_on_both_sides(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice([*"abcdefgh"], 6)) for _ in range(5000)]
    rows, gone = [], set()
    for i in range(40):
        w = [str(x) for x in rng.choice(words, 200)]
        changed = 17 if i < 20 else 18  # words in a row: 175 and 174 of 196 shingles stay, a similarity of 0.806 and 0.798
        rows += [(i, " ".join(w)), (100 + i, " ".join(w[:90] + [f"new{j}" for j in range(changed)] + w[90 + changed :]))]
        s = [str(x) for x in rng.choice(words, 9)]
        short = s if i < 20 else s[:8]  # 4 of 5 shingles stay, and 3 of 4
        rows += [(200 + i, " ".join(short[:-1])), (300 + i, " ".join(short))]
        gone |= {100 + i, 300 + i} if i < 20 else set()
    assert kept_by_near_dedup(spark, rows) == kept_by_brute_force(rows) == sorted({i for i, _ in rows} - gone)


@pytest.mark.parametrize("common", [2, 10**6])
def test_near_dedup_equals_brute_force_on_chains(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common, raising=False)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice([*"abcdefgh"], 5)) for _ in range(400)]
    rows = []
    for base in range(12):  # each text is cut from an earlier one of its family, by up to a third
        family = [[str(x) for x in rng.choice(words, rng.integers(10, 80))]]
        while len(family) < 14:
            w = list(family[rng.integers(len(family))])
            at, n = rng.integers(len(w)), rng.integers(1, 4)
            w[at : at + n] = [str(x) for x in rng.choice(words, rng.integers(0, 4))]
            family.append(w or ["one"])
        rows += [(1000 * base + i, " ".join(w) + " and so say all of us") for i, w in enumerate(family)]
    want = kept_by_brute_force(rows)
    assert 12 < len(want) < len(rows)
    assert kept_by_near_dedup(spark, rows) == want


# 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=5))
def test_media_round_trip(payloads):
    back = media.decode_thumbnails(media.encode_payloads(payloads))
    for p, images in zip(payloads, back, strict=True):
        assert b"".join(t.tobytes() for _, t in images) == p + bytes(max(64, -(-len(p) // 64) * 64) - len(p))


def test_media_of_long_payloads_is_several_images():
    p = np.random.default_rng(0).integers(0, 256, 1_200_000, dtype=np.uint8).tobytes()
    images = media.decode_thumbnails(media.encode_payloads([p]))[0]
    assert len(images) == 3 and b"".join(t.tobytes() for _, t in images)[: len(p)] == p


def test_decoder_skips_ac_and_other_components():
    """A 16 x 16 picture of three components, 2 x 2 luminance, with AC coefficients, without restarts."""
    dc = {s: (c, n) for s, c, n in media._codes(media.DC_COUNTS, media.DC_SYMBOLS)}
    ac_counts, ac_symbols = bytes([0, 3] + [0] * 14), bytes([0x00, 0x02, 0xF0])
    ac = {s: (c, n) for s, c, n in media._codes(ac_counts, ac_symbols)}
    bits, before = "", {1: 0, 2: 0, 3: 0}
    blocks = [(1, 10), (1, -20), (1, 300), (1, 7), (2, 5), (3, -5)]
    for component, value in blocks:
        d, before[component] = value - before[component], value
        category = abs(d).bit_length()
        code, n = dc[category]
        bits += f"{code:0{n}b}" + (f"{d if d >= 0 else d + (1 << category) - 1:0{category}b}" if category else "")
        for s, extra in ((0x02, "10"), (0xF0, ""), (0x02, "01"), (0x00, "")):
            bits += f"{ac[s][0]:0{ac[s][1]}b}" + extra
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    segment = media._segment
    sof = struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    sos = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    file = b"\xff\xd8" + segment(0xDB, b"\x00" + bytes([4] * 64)) + segment(0xC0, sof) + segment(0xC4, b"\x00" + media.DC_COUNTS + media.DC_SYMBOLS) + segment(0xC4, b"\x10" + ac_counts + ac_symbols) + segment(0xDA, sos) + scan + b"\xff\xd9"
    frame, thumb = media.decode_thumbnails([file])[0][0]
    assert (frame.width, frame.height) == (16, 16)
    assert thumb.tolist() == [[max(0, min(255, (v * 4 + 4 >> 3) + 128)) for v in row] for row in ((10, -20), (300, 7))]


def test_media_query_equals_brute_force(spark, odd, empty):
    for r in QUERIES["op4_jpeg_media"](spark, SF).collect():
        x = table_text(spark, r["doc_id"])
        p = x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    back = media.read_media(media.store_media(odd)).collect()
    assert sorted(bytes(r["payload"])[: r["n_bytes"]] for r in back) == sorted((t[1] or "").encode() for t in ODD)
    assert media.read_media(media.store_media(empty)).count() == 0


_TEXTS: dict = {}


def table_text(spark, doc_id):
    if not _TEXTS:
        _TEXTS.update(table(spark))
    return _TEXTS[doc_id].encode()


# 5


def test_toxicity_on_held_out_labels(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    caught = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(caught) / len(caught) > 0.7 and sum(wrong) <= 0.02 * len(wrong)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(empty, none) is None
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, none)).count() == len(ODD)
    assert toxicity.score_toxicity(empty, None).count() == 0


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    votes = np.zeros((4000, len(toxicity.PATTERNS) + 5))
    for j, (hit, miss) in enumerate(((0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.3, 0.3))):
        votes[:, j] = rng.random(4000) < np.where(truth, hit, miss)
    votes[:, 4] = votes[:, 0]  # a copy of the first
    known = np.where(rng.random(4000) < 0.1, truth, -1).astype(int)
    model = toxicity.fit_label_model(votes, known, 0.2)
    assert model.on_toxic[0] / model.on_clean[0] > 10 and model.on_toxic[3] / model.on_clean[3] < 2
    assert model.correlation[0, 4] > 0.9 and model.share[0] < 0.6 < model.share[1]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


# 6


def test_chat_reads_back(spark):
    said = [(1, 0, "user", "a<|end|>~1~"), (1, 1, "user", "b"), (1, 2, "assistant", "c<"), (1, 3, "assistant", None), (1, 3, "assistant", "é🎉<|turn|>"), (2, 0, None, ""), (None, 5, "assistant", "| x"), (None, None, "we<|ird", "y")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_conversations(turns)
    rows = out.withColumns({"back": chat_format.parse_formatted(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    got = {r["conv_id"]: r for r in rows}
    for c in (1, 2, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in said if i == c), key=lambda v: v)
        assert [(b["role"], b["text"]) for b in got[c]["back"]] == [v[1:] for v in own]
        assert got[c]["loss"] == "".join(x for _, r, x in own if r == "assistant")
        for s in got[c]["loss_spans"]:
            assert len(got[c]["formatted"].encode()[s["byte_start"] : s["byte_start"] + s["byte_length"]].decode()) == s["length"]
            assert got[c]["formatted"].encode()[s["byte_start"] : s["byte_start"] + s["byte_length"]].decode() == got[c]["formatted"][s["start"] : s["start"] + s["length"]]
    assert got[1]["n_blocks"] == 2
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_running_sums_pass_block_borders(spark):
    n = 2 * chat_format.BLOCK + 7
    got = spark.range(1).select(chat_format._running(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("x")).first()["x"]
    assert got == [i * (i + 1) // 2 for i in range(n)]


# 7


def reference_encoding():
    import public_tokenizers
    import tiktoken

    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tokens, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


CODEC: list = []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 'sé1.,"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_equals_reference_on_any_text(text):
    import public_tokenizers

    if not CODEC:
        tokens, encoding = reference_encoding()
        CODEC.extend([byte_bpe.Codec(byte_bpe.serialise_model(tokens), public_tokenizers.PATTERN), encoding, byte_bpe.piece_bytes])
    codec, encoding, pieces = CODEC
    ids = np.frombuffer(codec.encode([text])[0], "<u4")
    assert ids.tolist() == encoding.encode_ordinary(text)
    assert byte_bpe.decode(pieces(codec.model), ids) == text.encode()


def test_bpe_query_equals_reference(spark, odd, empty):
    import public_tokenizers

    _, encoding = reference_encoding()
    texts = table(spark)
    for r in QUERIES["op7_byte_bpe"](spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, vocabulary=path, pattern=public_tokenizers.PATTERN), vocabulary=path).collect()
        assert len(back) == n and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)


# 8


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["ties", "lengths", "near", "few", "large"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n = 4 if kind == "few" else 300
    if kind == "ties":
        m = rng.integers(-2, 3, (n, 3))
    elif kind == "lengths":
        m = (rng.normal(size=(n, 6)) * rng.lognormal(3, 2, (n, 1))).astype(int)
    elif kind == "near":
        m = (100 * rng.normal(size=(6, 8))[rng.integers(0, 6, n)] + rng.integers(-3, 4, (n, 8))).astype(int)
    elif kind == "large":
        m = rng.integers(-(2**30), 2**30, (n, 5))
    else:
        m = rng.integers(-50, 50, (n, 4))
    m[0] = 0
    rows = [(i, [*map(int, v)]) for i, v in enumerate(m)]
    v = spark.createDataFrame([(i, [*map(float, x)]) for i, x in rows], "vec_id long, v array<double>")
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in top_k.top_k_products(v, v.filter("vec_id % 50 = 0"), k=5).collect())
    assert got == brute_top(rows, 5)


def test_top_k_leaves_out_broken_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (50, []), (6, [1.0])]
    v = top_k.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in top_k.top_k_products(v, v.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 5, 256 * 128 + 512 * 128), (0, 6, 65536), (0, 50, 0), (50, 0, 0), (50, 5, 0), (50, 6, 0)]
    assert top_k.top_k_products(v.limit(0), v.limit(0)).count() == 0


# 9


def brute_lines(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(docs.items()):
        lines, covered = text.split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple("" if not x.strip(" ") else x for x in lines[i : i + 3])
            if any(window):
                if window in seen:
                    covered |= {i, i + 1, i + 2}
                seen.add(window)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in covered)
    return out


def test_lines_equal_brute_force_and_keep_every_line_somewhere(spark):
    rng = np.random.default_rng(11)
    docs = {i: "\n".join(rng.choice(["a", "b", "c", " ", "long line"], rng.integers(1, 15))) for i in range(120)}
    rows = line_dedup.dedup_lines(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute_lines(docs)
    left = {x for r in rows for x in r["text"].split("\n")}
    assert {x for t in docs.values() for x in t.split("\n") if x.strip()} <= left


def test_lines_of_odd_and_empty_tables(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (1,)}
    assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] == 1] == ["one\ntwo\nthree\nfour"] * 2
    assert by[5]["text"] == "five" and by[5]["removed_lines"] == 3 and by[2]["text"] is None and by[2]["n_lines"] == 0 and by[3]["text"] == ""
    assert by[7]["text"] == "\n\n\n"
    assert line_dedup.dedup_lines(empty).count() == 0


# 10


def test_mix_follows_weights_and_is_repeatable(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 10 == 1, "small").otherwise("other").alias("source"))
    mixed = mixing.mix_sources(docs, weights={"big": 1, "small": 1})
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"big", "small"} and all(abs(n - 10_000) < 500 for n in counts.values())
    assert spark_rows(mixed) == spark_rows(mixing.mix_sources(docs.repartition(7), weights={"big": 1, "small": 1}))


def test_poisson_distribution_function(spark):
    for rate in (0.01, 1.0, 30.0, 900.0):
        r = mixing.poisson_distributions(spark.createDataFrame([("a", rate)], "__source string, __rate double")).first()
        cdf, k = [0.0] * r["__low"] + r["__cdf"], int(rate)
        want = sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1))
        assert math.isclose(cdf[k], want, rel_tol=1e-9) and cdf[-1] > 1 - 1e-9


def test_mix_of_odd_and_empty_tables(odd, empty):
    rows = mixing.mix_sources(odd, weights={None: 1, "a": 1}, rows=200).collect()
    assert {r["source"] for r in rows} == {None, "a"} and all(r["mix_key"] != "clash" for r in rows)
    assert mixing.mix_sources(empty).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs, held = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs.collect())
        if name != "byte_bpe":
            assert docs.columns == [*pipeline.COLUMNS]
    language, lines, near, mixed, tokens = held
    texts = table(spark)
    assert {r["doc_id"] for r in language} == {i for i, t in texts.items() if any(map(str.isalpha, t))}
    want = brute_lines({r["doc_id"]: r["text"] for r in language})
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in want.items() if t.strip(" \n\t\r") or t == texts[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    kept = {r["doc_id"] for r in near}
    assert sorted(kept) == kept_by_brute_force([(r["doc_id"], r["text"].lower()) for r in lines])
    assert {r["doc_id"] for r in mixed} <= kept and 0.7 < len(mixed) / len(near) < 1.3
    encoding = reference_encoding()[1]
    by = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed) and all(r["token_ids"] == encoding.encode_ordinary(by[r["doc_id"]]) for r in tokens)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, SF).count() > 50


def test_odd_rows_through_the_stages(spark, odd):
    """Each stage does to odd rows what its docstring says."""
    import corpus_pipeline as pipeline

    seen = [odd.select(*pipeline.COLUMNS)]
    for _, stage in pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    start, named, cut, near, mixed, tokens = ([*df.collect()] for df in seen)
    assert named and all(any(c.isalpha() for c in r["text"] or "") and r["lang"] is not None for r in named)
    assert Counter((r["doc_id"], r["text"]) for r in named) <= Counter((r["doc_id"], r["text"]) for r in start)
    fate = {(r["doc_id"], r["text"]) for r in named}
    assert all(n == Counter((r["doc_id"], r["text"]) for r in named)[k] for k, n in Counter((r["doc_id"], r["text"]) for r in start).items() if k in fate)  # repeated rows share one fate
    assert all(r["n_chars"] == len(r["text"]) for r in cut) and {r["doc_id"] for r in cut} <= {r["doc_id"] for r in named}
    assert len({(r["doc_id"], r["text"]) for r in near}) == len(near) and len({r["text"] for r in near}) == len(near)
    assert {(r["doc_id"], r["text"]) for r in near} <= {(r["doc_id"], r["text"]) for r in cut}
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in near}
    encoding = reference_encoding()[1]
    assert Counter((r["doc_id"], *r["token_ids"]) for r in tokens) == Counter((r["doc_id"], *encoding.encode_ordinary(r["text"])) for r in mixed)
    assert all(df.columns == [*pipeline.COLUMNS] for df in seen[1:-1])

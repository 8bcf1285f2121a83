"""Search, retrieval pipeline and evaluation on a six-line corpus."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import counting
from tessera.plans import retrieval
from tessera.operators import embedding, evaluation, postings, rag, search
from tessera.sources.scratch import stored
from tests.helpers import SF, spark_rows

LINES = ["Annual leave is 25 days", "Error SKU-4471 means out of stock", "Refunds take five days", "Passwords expire yearly", "Error PAY-1180 means declined", "Leave requests need approval"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"c{i}", t, f"s{i % 2}") for i, t in enumerate(LINES)], "chunk_id string, text string, source string")


def test_bm25_ranks_the_identifier_first_and_filters_before(spark, chunks):
    q = spark.createDataFrame([(1, "error sku 4471"), (2, "nothing matches")], "query_id long, text string")
    index = search.bm25_index(chunks)
    hits = search.bm25_topk(q, index, 3).orderBy("rank").collect()
    assert [(h["query_id"], h["chunk_id"]) for h in hits][:2] == [(1, "c1"), (1, "c4")]
    some = search.bm25_topk(q, index, 3, chunks.filter("chunk_id <> 'c1'")).collect()
    assert [h["chunk_id"] for h in some] == ["c4"]


def test_bm25_score_by_hand(spark):
    c = spark.createDataFrame([("a", "x x y"), ("b", "y z z")], "chunk_id string, text string")
    hit = search.bm25_topk(spark.createDataFrame([(1, "x")], "query_id long, text string"), search.bm25_index(c)).first()
    assert math.isclose(hit["score"], math.log(1 + 1.5 / 1.5) * 2 * 2.5 / (2 + 1.5), abs_tol=1e-6)


def test_vector_topk_prefilters_and_keeps_tenants_apart(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(40)]
    v = spark.createDataFrame(rows, "chunk_id long, tenant long, vector array<double>")
    q = v.filter("chunk_id < 4").select(F.col("chunk_id").alias("query_id"), "tenant", "vector")
    found = search.vector_topk(q, v, 5, on="tenant").collect()
    assert len(found) == 20 and all(r["chunk_id"] % 2 == r["tenant"] for r in found)
    assert search.vector_topk(q.drop("tenant"), v, 5, F.col("tenant") == 1).filter("chunk_id % 2 = 0").count() == 0
    m = np.array([r[2] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    exact = np.argsort(-(m[0] @ m.T), kind="stable")[:5].tolist()
    assert [r["chunk_id"] for r in search.vector_topk(q.drop("tenant"), v, 5).filter("query_id = 0").orderBy("rank").collect()] == exact


def test_clustered_search_is_exact_at_full_probe(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(120)], "chunk_id long, vector array<double>")
    q = v.filter("chunk_id < 10").withColumnRenamed("chunk_id", "query_id")
    index, exact = search.ivf_build(v, str(tmp_path / "lists"), 8, 4), search.vector_topk(q, v, 10)
    recalls = [search.ann_recall(search.ivf_search(q, index, 10, p), exact).first()["recall"] for p in (1, 4, 8)]
    assert recalls[0] <= recalls[1] <= recalls[2] == 1.0
    again = search.ivf_open(spark, str(tmp_path / "lists"))
    assert spark_rows(search.ivf_search(q, again, 10, 8)) == spark_rows(exact)
    assert search.ivf_scanned(q, again, 8).first()["scanned"] == 1.0 > search.ivf_scanned(q, again, 1).first()["scanned"] > 0


def test_recall_of_all_probes_by_one_search_is_that_of_searches(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(150)], "chunk_id long, vector array<double>")
    q = v.filter("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    index, exact = search.ivf_build(v, str(tmp_path / "lists"), 6, 4), search.vector_topk(q, v, 10)
    told = {r["n_probe"]: r["recall"] for r in search.ivf_recalls(q, index, 10).collect()}
    assert sorted(told) == [1, 2, 3, 4, 5, 6]
    for p in (1, 3, 6):
        assert abs(told[p] - search.ann_recall(search.ivf_search(q, index, 10, p), exact).first()["recall"]) < 1e-6
    n = search.ivf_calibrate(index, str(tmp_path / "lists"), recall=0.8)
    kept = {r["n_probe"]: r["recall"] for r in spark.read.parquet(str(tmp_path / "lists" / "recalls")).collect()}
    assert kept[n] >= 0.8 and all(kept[p] < 0.8 for p in range(1, n))
    assert search.ivf_calibrate(index, str(tmp_path / "lists"), recall=1.1) == 6


def test_clustered_query_reaches_its_recall(spark):
    found, asked = catalog.QUERIES["ivf_search"](spark, SF), retrieval.query_vectors(spark, SF).drop("tenant")
    exact = search.vector_topk(asked, retrieval.vectors(spark, SF).drop("tenant"), 10)
    assert search.ann_recall(found, exact).first()["recall"] >= 0.9


def test_vectors_meet_only_queries_of_their_own_value(spark, monkeypatch):
    """Beyond what is broadcast a vector is copied once for each block of queries of its own value."""
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 10)
    v = spark.range(300).select(F.col("id").alias("chunk_id"), (F.col("id") % 30).alias("tenant"), F.array(F.lit(1.0), F.rand(1)).alias("vector"))
    q = v.filter("chunk_id < 60").select(F.col("chunk_id").alias("query_id"), "tenant", "vector")
    seen = []
    copied = search.top_k
    monkeypatch.setattr(search, "top_k", lambda scored, k: seen.append(scored) or copied(scored, k))
    search.vector_topk(q, v, 5, on="tenant").collect()
    assert seen[-1].count() == 60 * 5  # each value is one block of each side


def test_clustered_search_reads_only_the_lists_it_probes(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "chunk_id long, vector array<double>")
    index = search.ivf_build(v, str(tmp_path / "lists"), 8, 4)
    index.vectors.filter("list_id in (1, 2)").explain("formatted")
    assert "PartitionFilters: [list_id" in capsys.readouterr().out


def test_recall_by_probes_meets_the_published_curve(spark, tmp_path):
    """300 texts of six of seven words, 128 dimensions, 16 lists: 0.55, 0.85 and 0.99 at 1, 3 and 8 probes."""
    rng = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(300)], "chunk_id long, text string")
    v = embedding.dense(embedding.hash_vectors(texts, "chunk_id", 128), "chunk_id", 128)
    q = v.filter("chunk_id % 15 = 0").withColumnRenamed("chunk_id", "query_id")
    index, exact = search.ivf_build(v, str(tmp_path / "lists"), 16), search.vector_topk(q, v, 10)
    recalls = {p: search.ann_recall(search.ivf_search(q, index, 10, p), exact).first()["recall"] for p in (1, 3, 8, 16)}
    assert recalls[1] >= 0.5 and recalls[3] >= 0.8 and recalls[8] >= 0.95 and recalls[16] == 1.0


def test_more_queries_than_fit_meet_the_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, i % 3, rng.normal(size=5).tolist()) for i in range(150)], "chunk_id long, tenant long, vector array<double>")
    q = v.filter("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "tenant", "vector")
    for on in (None, "tenant"):
        asked, there = (q, v) if on else (q.drop("tenant"), v.drop("tenant"))
        one = spark_rows(search.vector_topk(asked, there, 4, on=on))
        monkeypatch.setattr(search, "BROADCAST_QUERIES", 7)
        monkeypatch.setattr(search, "BLOCK_VECTORS", 40)
        assert spark_rows(search.vector_topk(asked, there, 4, on=on)) == one
        monkeypatch.undo()


def test_bm25_index_on_disk(spark, chunks, tmp_path):
    q = spark.createDataFrame([(1, "error sku 4471"), (2, "leave days days")], "query_id long, text string")
    postings.write_bm25_index(search.bm25_index(chunks), str(tmp_path / "i"))
    kept, fresh = postings.read_bm25_index(spark, str(tmp_path / "i")), search.bm25_index(chunks)
    assert spark_rows(postings.bm25_block_topk(q, kept, 3)) == spark_rows(search.bm25_topk(q, fresh, 3))
    some = chunks.filter("chunk_id <> 'c1'")
    assert spark_rows(postings.bm25_block_topk(q, kept, 3, some)) == spark_rows(search.bm25_topk(q, fresh, 3, some))
    assert sorted((r["term"], r["df"]) for r in kept.terms.collect()) == sorted((r["term"], r["df"]) for r in fresh.terms.collect())


def test_bm25_blocks_are_skipped_and_nothing_is_missed(spark, tmp_path, monkeypatch):
    """A word of every chunk, words of some and of few; ties, repeated terms, unseen terms, queries of frequent words alone, and more hits asked for than there are."""
    rng = np.random.default_rng(5)
    texts = [" ".join(["the"] * int(rng.integers(1, 3)) + rng.choice(["of", "and", "in"], size=3).tolist() + [f"w{int(rng.zipf(1.4)) % 900}" for _ in range(int(rng.integers(2, 30)))]) for _ in range(1500)]
    c = spark.createDataFrame([*enumerate([*texts, texts[0], texts[0], None, ""])], "chunk_id long, text string").repartition(3)
    asked = ["the w700 w701", "the of", "the", "w1 w2 the the w650", "unseen", "unseen the w333", "", "w899 w898 w897", "of and in the w5"]
    q = spark.createDataFrame([*enumerate(asked)], "n long, text string").select(F.struct("n").alias("query_id"), "text")
    index = search.bm25_index(c, lambda df: stored(df, "counted"))
    postings.write_bm25_index(index, str(tmp_path / "i"), 8)
    kept = postings.read_bm25_index(spark, str(tmp_path / "i"))
    for k, first in ((5, 8), (3, 1), (2000, 2)):
        want = spark_rows(search.bm25_topk(q, index, k))
        assert spark_rows(postings.bm25_block_topk(q, kept, k, first=first)) == want and want[1]
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert spark_rows(postings.bm25_block_topk(q, kept, 5)) == spark_rows(search.bm25_topk(q, index, 5))
    rare = postings.bm25_block_share(spark.createDataFrame([(0, asked[0]), (1, asked[7])], "query_id long, text string"), kept, 3)
    shares = {r["term"]: r["share"] for r in rare.collect()}
    assert shares["the"] < 0.2 and max(shares.values()) <= 1


def test_bm25_blocks_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    postings.write_bm25_index(search.bm25_index(empty), str(tmp_path / "i"))
    kept = postings.read_bm25_index(spark, str(tmp_path / "i"))
    assert postings.bm25_block_topk(q, kept).count() == postings.bm25_block_topk(q.filter("false"), kept).count() == 0


def test_bm25_with_more_terms_than_are_broadcast(spark, chunks, monkeypatch):
    q = spark.createDataFrame([(1, "error sku 4471"), (2, "leave days days")], "query_id long, text string")
    one = spark_rows(search.bm25_topk(q, search.bm25_index(chunks), 3))
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert spark_rows(search.bm25_topk(q, search.bm25_index(chunks), 3)) == one


def test_bm25_in_small_blocks_equals_the_join(spark, monkeypatch):
    """Scores in place, over blocks of few cells, against postings joined and summed; null and empty texts, repeated terms and ids that are structs."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([*"abcdefgh"], size=rng.integers(0, 30)).tolist()) for _ in range(60)]
    c = spark.createDataFrame([*enumerate([*texts, None, ""])], "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(rng.choice([*"abcdefxyz"], size=4).tolist())) for i in range(9)], "n long, text string").select(F.struct("n").alias("query_id"), "text")
    index = search.bm25_index(c)
    joined = search.bm25_topk(q, search.Bm25Index(index.postings, index.terms, index.stats), 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "CELLS", 20)
    assert search.bm25_topk(q, index, 4).orderBy("query_id", "rank").collect() == joined
    assert len(joined) == 36
    assert search.bm25_topk(q, search.bm25_index(c.filter("false")), 4).count() == search.bm25_topk(q.filter("false"), index, 4).count() == 0


def test_equal_pages_stay_apart(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "t", "cat cat"), (2, "t", "cat cat"), (3, "u", "cat dog"), (4, None, "cat")], "page_id long, title string, body string")
    q = spark.createDataFrame([(1, "cat"), (2, "dog dog"), (3, "none")], "query_id long, text string")
    want = [(1, 1, 1, 2), (1, 2, 2, 2), (1, 3, 3, 1), (2, 3, 1, 2)]
    found = lambda: sorted((r["query_id"], r["page_id"], r["rank"], r["score"]) for r in search.term_count_search(q, pages, 3).collect())
    assert found() == want
    monkeypatch.setattr(search, "BROADCAST_TERMS", 1)
    assert found() == want


def test_terms_inside_each_other_are_counted_as_by_themselves(spark):
    words = ["aa", "aaa", "a", "banana", "ana", "nan", "x9"]
    bodies = ["aaaa a banana", "bananana aaaaa", "x9x9 anana", "", None]
    pages = spark.createDataFrame([(i, "", b) for i, b in enumerate(bodies)], "page_id long, title string, body string")
    q = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, "aa ana aa")], "query_id long, text string")
    found = {(r["query_id"], r["page_id"]): r["score"] for r in search.term_count_search(q, pages, 5).collect()}
    plain = {(i, p): (b or "").count(w) for i, w in enumerate(words) for p, b in enumerate(bodies)}
    plain |= {(99, p): 2 * (b or "").count("aa") + (b or "").count("ana") for p, b in enumerate(bodies)}
    assert found == {k: n for k, n in plain.items() if n}


def test_variants_lose_bullets_but_no_digits(spark):
    q = spark.createDataFrame([(1, "pension")], "query_id long, text string")
    asked = []

    def retrieve(variants):
        asked.extend(r["text"] for r in variants.orderBy("query_id").collect())
        return variants.select("query_id", F.lit("c").alias("chunk_id"), F.lit(1).cast("long").alias("rank"))

    search.multi_query(q, lambda t: ["- 401k limits\n\n• 2024 rules -\nplain"] * len(t), retrieve).collect()
    assert asked == ["pension", "401k limits", "2024 rules", "plain"]


def test_retrieval_by_vectors_fused_and_reranked(spark):
    rows = lambda ids: spark.createDataFrame([(1, c, i, 1.0 / i) for i, c in enumerate(ids, 1)], "query_id long, chunk_id string, rank long, score double")
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    depths = []
    dense = lambda _, k: depths.append(k) or rows("abcd"[:k])
    bm25 = lambda _, k: rows("bcde"[:k])
    backwards = lambda hits, k: rows([r["chunk_id"] for r in hits.orderBy(F.desc("rank")).limit(k).collect()])
    ids = lambda df: [r["chunk_id"] for r in df.orderBy("rank").collect()]
    assert ids(rag.retrieve(q, dense, k=2, fetch=4)) == ["a", "b"] and depths == [2]
    assert ids(rag.retrieve(q, dense, bm25, k=2, fetch=4)) == ["b", "c"] and depths == [2, 4]
    assert ids(rag.retrieve(q, dense, bm25, backwards, k=2, fetch=4)) == ["a", "d"]


def test_markers_in_turns(spark, monkeypatch):
    texts = spark.createDataFrame([("One TWO three",), (None,), ("four",)], "text string")
    markers = spark.createDataFrame([(1, "two T"), (2, "five"), (3, "FOUR"), (4, "two t")], "query_id long, marker string")
    found = lambda: sorted(r["query_id"] for r in evaluation.markers_found(texts, markers).collect())
    assert found() == [1, 3, 4]
    monkeypatch.setattr(evaluation, "MARKERS", 1)
    assert found() == [1, 3, 4]


def test_markers_in_turns_by_their_characters(spark, monkeypatch):
    texts = spark.createDataFrame([(f"a {i} b {'x' * i}",) for i in range(40)], "text string")
    markers = spark.createDataFrame([(i, f"A {i} B") for i in range(80)] + [(80, "")], "query_id long, marker string")
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(sum(map(len, value))) or send(self, value))
    found = lambda: sorted(r["query_id"] for r in evaluation.markers_found(texts, markers).collect())
    assert found() == [*range(40), 80] and len(sent) == 1
    monkeypatch.setattr(evaluation, "MARKER_CHARS", sent[0] // 4)
    assert found() == [*range(40), 80] and max(sent[1:]) < sent[0] / 2


def test_texts_with_markers_are_python_strings_one_at_a_time():
    columns = [pa.array([f"{i} " * 2000 for i in range(1000, 2000)]), pa.array([], pa.string())]  # 10 MB
    tracemalloc.start()
    try:
        assert evaluation._held_in(iter(columns), ["1999 1999", "999 999", ""]) == {"1999 1999", ""}
        assert tracemalloc.get_traced_memory()[1] < 1e6
    finally:
        tracemalloc.stop()


def test_rerank_hyde_and_judges_by_hand(spark, chunks):
    hits = spark.createDataFrame([(1, f"c{i}", i + 1, 1.0) for i in range(4)], "query_id long, chunk_id string, rank long, score double")
    q = spark.createDataFrame([(1, "which error")], "query_id long, text string")
    judge = lambda questions, passages: ["none" if "leave" in p.lower() else f"score {p.count('e')}.5 of 10" for p in passages]
    got = [(r["chunk_id"], r["score"]) for r in search.rerank(hits, q, chunks, judge, 3).orderBy("rank").collect()]
    assert got == [("c2", 4.5), ("c3", 2.5), ("c1", 2.5)] or got[0] == ("c2", max(s for _, s in got))
    asked = []
    search.hyde(q, lambda t: ["Error SKU-4471"] * len(t), lambda x: asked.extend(r["text"] for r in x.collect()) or hits)
    assert asked == ["Error SKU-4471"]
    answers, contexts = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, answer string"), spark.createDataFrame([(1, "7 good"), (2, "silent")], "query_id long, context string")
    got = {r["query_id"]: r["faithfulness"] for r in evaluation.judge_faithfulness(answers, contexts, lambda c, a: [*c]).collect()}
    assert got == {1: 0.7, 2: 0.0}


def test_answers_only_of_open_questions(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    gate = spark.createDataFrame([(1, False), (2, True)], "query_id long, refused boolean")
    contexts = spark.createDataFrame([(1, "[1] (s)\ntext")], "query_id long, context string")
    rows = {r["query_id"]: (r["answer"], r["refused"]) for r in rag.answer(q, gate, contexts, lambda prompts: [p.replace("\n", "|") for p in prompts]).collect()}
    assert rows == {1: ("Sources:|[1] (s)|text||Question: one", False), 2: ("I don't know based on the provided sources.", True)}


def test_fusion_by_rank(spark):
    one = spark.createDataFrame([(1, "a", 1, 9.0), (1, "b", 2, 8.0)], "query_id long, chunk_id string, rank long, score double")
    two = spark.createDataFrame([(1, "b", 1, 0.9)], "query_id long, chunk_id string, rank long, score double")
    fused = search.rrf_fuse([one, two]).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in fused] == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9))]


def test_mmr_prefers_what_is_new(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.14]), ("c", [0.6, 0.8])], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<double>")
    hits = spark.createDataFrame([(1, c, i, 0.0) for i, c in enumerate("abc", 1)], "query_id long, chunk_id string, rank long, score double")
    assert [r["chunk_id"] for r in search.mmr(hits, q, v, 2, 0.3).orderBy("rank").collect()] == ["b", "c"]


def test_parents_take_the_best_child(spark):
    hits = spark.createDataFrame([(1, "x1", 1, 3.0), (1, "x2", 2, 2.0), (1, "y", 3, 1.0), (1, "z1", 4, 0.5)], "query_id long, chunk_id string, rank long, score double")
    kids = spark.createDataFrame([("x1", "X"), ("x2", "X"), ("y", None), ("z1", "Z")], "chunk_id string, parent_id string")
    parents = spark.createDataFrame([("X",)], "chunk_id string")
    found = search.parent_child(hits, kids, parents, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in found] == [("X", 3.0), ("y", 1.0), ("z1", 0.5)]


def test_appending_checks_dimensions(spark):
    c = spark.createDataFrame([("a", "t")], "chunk_id string, text string")
    assert search.checked_vectors(c, spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, vector array<double>"), 2).count() == 1
    with pytest.raises(Exception, match="right dimension"):
        search.checked_vectors(c, spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<double>"), 2).collect()


def test_budget_skips_what_does_not_fit_and_ends(spark):
    c = spark.createDataFrame([(str(i), "x" * n) for i, n in enumerate([400, 800, 160, 40])], "chunk_id string, text string")
    hits = spark.createDataFrame([(1, str(i), i + 1, 1.0) for i in range(4)], "query_id long, chunk_id string, rank long, score double")
    taken = lambda budget: [r["chunk_id"] for r in rag.fit_to_budget(hits, c, budget).orderBy("rank").collect()]
    assert taken(1000) == ["0", "1", "2", "3"]
    assert taken(160) == ["0", "2", "3"]  # 60 left: skip the second, take the third
    assert taken(140) == ["0"]  # 40 left, less than 50: ends at the second


def test_citations(spark):
    a = spark.createDataFrame([(1, "yes [1] and [3][9]", 3), (2, "no", 0)], "query_id long, answer string, n_sources int")
    rows = {r["query_id"]: r for r in rag.citation_check(a).collect()}
    assert (rows[1]["cited"], rows[1]["dangling"], rows[1]["uncited"], rows[1]["valid"]) == ([1, 3, 9], [9], [2], False)
    assert rows[2]["valid"] and not rows[2]["has_citations"]


def test_metrics_by_hand(spark):
    golden = spark.createDataFrame([(1, "q", "e", ["yes", "also"], False), (2, "q", "e", [], True)], "query_id long, question string, expected_answer string, markers array<string>, should_refuse boolean")
    hits = spark.createDataFrame([(1, 1, "nope"), (1, 2, "YES here"), (1, 3, "yes again")], "query_id long, rank long, text string")
    m = {r["query_id"]: r for r in evaluation.retrieval_metrics(golden, hits).collect()}
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert (m[1]["hit_rate"], m[1]["recall_at_k"], m[1]["mrr"]) == (1.0, 0.5, 0.5)
    assert m[1]["precision_at_k"] == round(2 / 3, 6) and m[1]["ndcg_at_k"] == round(dcg / ideal, 6)
    assert (m[2]["hit_rate"], m[2]["precision_at_k"], m[2]["recall_at_k"], m[2]["mrr"], m[2]["ndcg_at_k"]) == (1.0, 0.0, 1.0, 0.0, 0.0)


def test_faithfulness_and_f1(spark):
    answers = spark.createDataFrame([(1, "Leave lasts twenty days. Purple elephants dance."), (2, "Yes.")], "query_id long, answer string")
    contexts = spark.createDataFrame([(1, "annual leave lasts twenty five days")], "query_id long, context string")
    got = {r["query_id"]: r["faithfulness"] for r in evaluation.faithfulness(answers, contexts).collect()}
    assert got == {1: 0.5, 2: 0.0}
    row = spark.createDataFrame([("25 days", "Employees get 25 days")], "said string, expected string").select(evaluation.answer_correctness(F.col("expected"), F.col("said")).alias("f")).first()
    assert math.isclose(row["f"], 2 * 2 / (2 + 4))


def test_ingest_replaces_changed_documents(spark):
    docs = spark.createDataFrame([(1, "a", "new"), (2, "b", "same")], "doc_id long, source string, text string")
    cut = lambda d: d.select(F.col("text").alias("chunk_id"), "source")
    state0 = rag.ingest(docs, spark.createDataFrame([], "source string, content_hash string"), cut)[1]
    changed = docs.withColumn("text", F.when(F.col("source") == "a", F.lit("newer")).otherwise(F.col("text")))
    kept, _, stats = rag.ingest(changed, state0, cut, cut(docs))
    assert sorted(r["chunk_id"] for r in kept.collect()) == ["newer", "same"]
    assert stats.first().asDict() == {"documents": 1, "chunks": 1, "skipped": 1}


@pytest.mark.parametrize("name", ["ivf_search", "mmr", "multi_query"])
def test_searches_ask_their_whole_query_set(spark, name):
    asked = {r["query_id"] for r in catalog.QUERIES[name](spark, SF).select("query_id").distinct().collect()}
    table, key, step = ("benchmark", "item_id", 1) if name == "multi_query" else ("embeddings", "vec_id", 50)
    ids = {r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert asked == {i for i in ids if i % step == 0}


def test_blocks_are_made_where_their_chunks_were_counted(spark, tmp_path):
    """No row of postings is shuffled: blocks hold chunks that follow each other in a task, each chunk in one block."""
    chunks = spark.range(0, 100, 1, 2).select(F.format_string("c%03d", "id").alias("chunk_id"), F.concat(F.lit("same w"), F.col("id") % 7).alias("text"))
    postings.write_bm25_index(search.bm25_index(chunks), str(tmp_path / "i"), 8)
    index = postings.read_bm25_index(spark, str(tmp_path / "i"))
    held = {r["block"]: sorted(p["chunk_id"] for p in r["postings"]) for r in index.blocks.filter("term = 'same'").collect()}
    ids = [f"c{i:03d}" for i in range(100)]
    assert sorted(held.values()) == [half[a : a + 8] for half in (ids[:50], ids[50:]) for a in range(0, 50, 8)]
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"same": 100} | {f"w{i}": len(range(i, 100, 7)) for i in range(7)}


def test_frequencies_of_terms_that_nobody_asks_for_are_not_counted(spark, chunks):
    q = spark.createDataFrame([(1, "error sku 4471"), (2, "leave days days unseen")], "query_id long, text string")
    index = search.bm25_index(chunks)
    want = spark_rows(search.bm25_topk(q, index, 3))
    index.terms = index.terms.select(F.raise_error(F.lit("all terms are counted")).cast("string").alias("term"), "df")
    assert spark_rows(search.bm25_topk(q, index, 3)) == want and want[1]


def test_ways_of_retrieval_share_their_searches(spark, monkeypatch):
    made = []
    for name in ("sparse_topk", "bm25_topk"):
        monkeypatch.setattr(search, name, lambda *a, f=getattr(search, name), n=name, **b: made.append(n) or f(*a, **b))
    retrieval.plans.queries["retrieve"](spark, SF)
    assert sorted(made) == ["bm25_topk", "sparse_topk"]


def test_compared_hits_are_found_before_they_meet_chunks(spark):
    """So that their number is known when they are joined, and the chunks stay where they are."""
    plan = retrieval.plans.queries["rank_compare"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_terms_are_counted_in_slices_of_a_batch(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["it's", "B", "é", "4", "a_b", "zz", "ǅx"], size=int(rng.integers(0, 9))).tolist()) for _ in range(60)] + [None, "", "..."]
    d = spark.createDataFrame([*enumerate(texts)], "id long, text string").coalesce(1)
    monkeypatch.setattr(counting, "CUT_CHARS", 25)
    for r in d.select("text", counting.counted_terms(F.col("text")).alias("c"), counting.hashed(F.col("text"), 64, True, False).alias("e")).collect():
        w = counting.words(r["text"])
        assert r["c"]["dl"] == len(w) and [tuple(t) for t in r["c"]["terms"]] == sorted((x, w.count(x)) for x in set(w))
        assert math.isclose(sum(e["weight"] ** 2 for e in r["e"]), 1 if w else 0)


def test_pages_scored_in_blocks_keep_the_smallest_ids_of_equal_ones(spark, monkeypatch):
    """Short and long terms, blocks of few pages, more equal pages than are kept, in falling order of their ids, and missing titles behind empty ones."""
    rng = np.random.default_rng(4)
    words = ["a", "an", "ana", "banana", "x", "xx", "the", "then"]
    bodies = [" ".join(rng.choice(words, size=int(rng.integers(0, 12))).tolist()) for _ in range(90)]
    pages = [(i, None if i % 5 == 0 else "", b) for i, b in enumerate([*bodies, *bodies[:9] * 9])]
    asked = [(i, " ".join(rng.choice(words, size=int(rng.integers(0, 5))).tolist())) for i in range(20)]
    monkeypatch.setattr(search, "SCORED_PAGES", 7)
    d = spark.createDataFrame(pages[::-1], "page_id long, title string, body string").coalesce(2)
    found = sorted((r["query_id"], r["rank"], r["page_id"], r["score"]) for r in search.term_count_search(spark.createDataFrame(asked, "query_id long, text string"), d, 4).collect())
    want = []
    for q, text in asked:
        scored = sorted((i, t, b, n) for i, t, b in pages if (n := sum(b.count(w) for w in text.split())))
        scored.sort(key=lambda x: (x[3], x[1] is not None, x[2]), reverse=True)
        want += [(q, rank, i, n) for rank, (i, _, _, n) in enumerate(scored[:4], 1)]
    assert found == want and len(want) > 40

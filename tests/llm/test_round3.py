"""Filter audit, Merkle manifest and substring dedup, against plain versions and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, merkle, simhash, substring_dedup
from tests.helpers import SF, spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name, query, sql", [("op11", filter_audit.op11_filter_audit, filter_audit.OP11_SQL), ("op12", merkle.op12_merkle_manifest, merkle.OP12_SQL), ("op13", substring_dedup.op13_substring_dedup, substring_dedup.OP13_SQL)])
def test_query_equals_sql(spark, name, query, sql):
    assert spark_rows(query(spark, SF)) == sql_rows(sql)


# Filter audit


def test_adjacent_swaps_reach_all_orders():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for k in filter_audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_a_swap_keeps_every_mask():
    rng = random.Random(1)
    weights = {m: (rng.randrange(5),) for m in range(16)}
    diagram = filter_audit.Diagram("ABCD", weights, 1)

    def told():
        found = {}

        def walk(i, mask):
            if diagram.nodes[i][0] == "leaf":
                found[mask] = diagram.sums[i]
                return
            variable, passed, failed = diagram.nodes[i]
            walk(passed, mask)
            walk(failed, mask | 1 << variable)

        walk(diagram.root, 0)
        return found

    for k in filter_audit.adjacent_swaps(4):
        diagram.swap(k)
        assert told() == weights


def plain_audit(docs, labels):
    """By the definition, one document and one order at a time."""
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        smaller = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        quality, toxic = labels.get(i, (0, 0)) if i is not None else (0, 0)
        fails.append((source or "", {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": smaller}, quality == 1, toxic == 1))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                gone, own = [f for f in left if f[1][x]], [f for f in fails if f[0] == part and f[1][x]]
                left = [f for f in left if not f[1][x]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(own) - len(gone), sum(sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_by_definition(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "UPPER CASE", "a | b", " ".join(f"w{i}" for i in range(60)), "same " * 60, "x" * 20_000, "é" * 100 + " A" * 10, " ".join(f"V{i}" for i in range(70)) + " $"]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "a", "bé"])) for _ in range(80)]
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 12, 2)}
    table = documents(spark, docs).withColumn("mask", F.lit("clash")).withColumn("h", F.lit(1))
    marks = spark.createDataFrame([(i, *x) for i, x in labels.items()] + [(None, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(filter_audit.document_masks(table, marks), "ABCDE", lost=("good_lost", "toxic_lost"))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()} == plain_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    assert filter_audit.audit_filters(filter_audit.document_masks(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")), "ABCDE", lost=("good_lost", "toxic_lost")).count() == 0
    rows = spark.createDataFrame([(None, 0, 2), ("p", 1, 3)], "part string, mask int, n long")
    assert sorted((r["part"] or "-", r["kept"], r["removed"]) for r in filter_audit.audit_filters(rows, "X").collect()) == [("-", 2, 0), ("p", 0, 3)]
    with pytest.raises(ValueError):
        filter_audit.audit_filters(rows, "AA")


# Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(level):
    """The root, and for each leaf its siblings level by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, i in enumerate(at):
            run = runs[i // 16]
            paths[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[leaf] = i // 16
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


@pytest.mark.parametrize("digits", [1, 2])
def test_merkle_proofs_by_definition(spark, digits, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    sizes = {None: 1, "": 16, "a": 17, "b": 300, "é": 2, "z": 257}
    rows = [(k, i, sha(f"{k}{i}")) for k, n in sizes.items() for i in range(n)]
    rows[40:40] = [("b", 3, sha("b3")), ("b", None, sha("null id"))]  # a repeated row, a null id
    tree = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for k in sizes}
    sub = {k: plain_tree([r[2] for r in members]) for k, members in tree.items()}
    keys = sorted(sizes, key=lambda k: (k is not None, (k or "").encode()))
    root, tops = plain_tree([sub[k][0] for k in keys])
    expected = sorted(str((k, r[1], r[2], sub[k][0], root, sub[k][1][i] + tops[keys.index(k)])) for k, members in tree.items() for i, r in enumerate(members))
    random.Random(2).shuffle(rows)
    leaves = spark.createDataFrame([(*r, "kept") for r in rows], "source string, doc_id long, leaf string, __rank string")
    found = merkle.merkle_proofs(leaves).withColumn("fold", merkle.fold_path(F.col("leaf"), F.col("path"))).collect()
    assert sorted(str((r["source"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]])) for r in found) == expected
    assert all(r["fold"] == root and r["__rank"] == "kept" for r in found)


def test_merkle_of_one_and_of_none(spark):
    assert merkle.merkle_proofs(spark.createDataFrame([], "source string, doc_id long, leaf string")).count() == 0
    row = merkle.merkle_proofs(spark.createDataFrame([("s", 1, sha("x"))], "source string, doc_id long, leaf string")).withColumn("proof", merkle.proof_digest(F.col("path"))).first()
    assert (row["root"], row["subroot"], row["path"], row["proof"]) == (sha("x"), sha("x"), [], sha(""))


def test_merkle_manifest_finds_what_was_touched(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else ("Text" if i % 2 else "text") + "é" * i, f"s{i % 3}") for i in range(60)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    touched = {i for i, text, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0 and text and text.startswith("T")}
    assert {i for i, r in found.items() if not r["verified"]} == touched and touched
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in found.values())
    i, text, source = rows[1]
    fields = [str(i), source, "en", str(len(text)), text]
    assert found[1]["leaf"] == sha("".join(f"{len(x.encode())}:{x}" for x in fields))


# Substring dedup


def plain_substrings(rows, length):
    """Kept words by (id, text), rows in order of id, nulls first."""
    seen, out = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - length + 1):
            first = seen.setdefault(tuple(words[i : i + length]), (key, i))
            if first != (key, i):
                gone.update(range(i, i + length))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, length, start, stretch", [(0, 20, 10, 64), (1, 20, 5, 4), (2, 7, 2, 3), (3, 6, 6, 8), (4, 12, 3, 2), (5, 3, 1, 5)])
def test_substring_dedup_by_definition(spark, seed, length, start, stretch):
    rng = random.Random(seed)
    pieces = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 3 * length))] for _ in range(12)]
    texts = ["", None, " \n\t", "word", "same " * (3 * length), " ".join(["x", "y"] * length)]
    for _ in range(60):
        words = [w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(pieces) if rng.random() < 0.8 else [str(rng.random())])]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += texts[:20]
    rows = list(zip([None, *range(1, len(texts))], texts, strict=True))
    table = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, __ref string, n_words int").repartition(3)
    found = substring_dedup.dedup_substrings(table, length=length, start=start, stretch=stretch)
    assert found.columns == ["doc_id", "text", "__ref", "kept_text", "n_words", "n_removed"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()), key=str) == plain_substrings(rows, length)


def test_substring_dedup_of_repeated_rows_and_ids(spark):
    passage, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, passage), (1, passage), (1, other), (2, f"{other} new")]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in found) == sorted([(1, passage), (1, passage), (1, other), (2, "new")])
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    text = spark.createDataFrame([("a", passage), ("b", "0 " + passage)], "name string, body string")
    assert [(r["name"], r["kept_text"]) for r in substring_dedup.dedup_substrings(text, doc_id="name", text="body").orderBy("name").collect()] == [("a", passage), ("b", "0")]


def test_substring_dedup_of_a_very_long_text(spark):
    rng = random.Random(4)
    words = [str(rng.randrange(10**9)) for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["before", *words[50_000:50_040], "after"]))]
    found = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_removed"], found[2]["kept_text"]) == (0, "before after")


# Near-dedup


def test_near_dedup_of_long_texts_that_share_paragraphs(spark):
    rng = random.Random(9)
    paragraphs = [" ".join(f"{p}x{rng.randrange(10**6)}" for _ in range(100)) for p in range(60)]
    rows = [(i, "\n".join(rng.sample(paragraphs, 30))) for i in range(150)]
    near = [(1000 + i, rows[i][1] + " and a few words more") for i in range(5)]
    left = simhash.near_dedup(spark.createDataFrame(rows + near, "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [i for i, _ in rows]


def test_bitmaps_of_different_sizes_never_rule_out_wrongly():
    rng = random.Random(1)
    for n, m in ((10, 10), (500, 3000), (3000, 40_000), (1, 5000)):
        x = {rng.getrandbits(64) for _ in range(n)}
        y = {*rng.sample(sorted(x), n // 2), *(rng.getrandbits(64) for _ in range(m - n // 2))}
        a, b = (simhash._bitmap(np.array(sorted(v), np.uint64)) for v in (x, y))
        mine, theirs = simhash._alone(a, b)
        assert mine <= len(x - y) and theirs <= len(y - x) and simhash._alone(b, a) == (theirs, mine)
        assert simhash._alone(a, a) == (0, 0)

"""The store under a log of manifests: what readers see, and which files changes touch."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources import store

SCHEMA = "chunk_id long, text string, tenant string"


def rows(spark, ids, tenants=3):
    return spark.createDataFrame([(i, f"t{i}", f"{i % tenants}/a b%") for i in ids], SCHEMA)


def ids(df):
    return sorted(r["chunk_id"] for r in df.collect())


def on_disk(path):
    """Files of rows, with the times of their last changes."""
    found = [os.path.join(d, f) for d, _, files in os.walk(f"{path}/data") for f in files if f.endswith(".parquet")]
    return {f: os.stat(f).st_mtime_ns for f in found}


def test_rows_are_appended_deleted_and_merged(spark, tmp_path):
    path = str(tmp_path)
    assert [store.append_rows(rows(spark, range(a, a + 10)), path, "tenant") for a in (0, 10, 20)] == [0, 1, 2]
    assert ids(store.read_store(spark, path)) == [*range(30)]
    before = on_disk(path)
    # null keeps a row, and what is gone isn't counted again
    odd = F.when(F.col("chunk_id") == 7, F.lit(None)).otherwise(F.col("chunk_id").isin(1, 7, 12, 29))
    assert [store.delete_rows(spark, path, odd) for _ in range(2)] == [3, 0]
    left = [i for i in range(30) if i not in (1, 12, 29)]
    assert ids(store.read_store(spark, path)) == left and on_disk(path) == before
    assert ids(store.read_store(spark, path, 2)) == [*range(30)]  # an older version
    old = store.merge_store(spark, path)
    assert len(old) == 3 and not store.manifest(spark, path)["marks"]
    after = on_disk(path)
    assert {f: after[f] for f in before} == before  # a merge adds files of what it touched
    assert {f.split("/data/")[1].split("/")[1] for f in set(after) - set(before)} == {f.split("/")[1] for f in old}
    assert ids(store.read_store(spark, path)) == left
    assert {r["tenant"] for r in store.read_store(spark, path).collect()} == {f"{i}/a b%" for i in range(3)}
    assert store.merge_store(spark, path) == []


def test_deleting_a_tenant_rewrites_no_file_and_makes_no_marks(spark, tmp_path):
    path = str(tmp_path)
    for a in (0, 10):
        store.append_rows(rows(spark, range(a, a + 10)), path, "tenant")
    before = on_disk(path)
    assert store.delete_rows(spark, path, F.col("tenant") == "1/a b%") == 7
    held = store.manifest(spark, path)
    assert len(held["folders"]) == 4 and not held["marks"] and on_disk(path) == before
    assert ids(store.read_store(spark, path)) == [i for i in range(20) if i % 3 != 1]
    assert store.delete_rows(spark, path, F.lit(True)) == 13
    assert store.read_store(spark, path).columns == ["chunk_id", "text", "tenant"] and ids(store.read_store(spark, path)) == []
    store.append_rows(rows(spark, [5]), path, "tenant")
    assert ids(store.read_store(spark, path)) == [5]


def test_failed_append_stays_invisible(spark, tmp_path):
    path = str(tmp_path)
    store.append_rows(rows(spark, range(6)), path, "tenant")
    breaks = rows(spark, range(6, 60)).withColumn("text", F.when(F.col("chunk_id") == 59, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        store.append_rows(breaks.repartition(8), path, "tenant")
    assert ids(store.read_store(spark, path)) == [*range(6)] and store.manifest(spark, path)["version"] == 0
    with pytest.raises(ValueError, match="the store has"):
        store.append_rows(rows(spark, [9]).withColumn("more", F.lit(1)), path, "tenant")


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    """Each change finds, just before its commit, that another one was faster."""
    path = str(tmp_path)
    store.append_rows(rows(spark, range(12)), path, "tenant")
    real = store._commit

    def meeting(other):
        def commit(*x):
            monkeypatch.setattr(store, "_commit", real)
            other()
            return real(*x)

        monkeypatch.setattr(store, "_commit", commit)

    meeting(lambda: store.append_rows(rows(spark, [12]), path, "tenant"))
    store.append_rows(rows(spark, [13]), path, "tenant")
    assert ids(store.read_store(spark, path)) == [*range(14)]
    meeting(lambda: store.append_rows(rows(spark, [14]), path, "tenant"))
    assert store.delete_rows(spark, path, F.col("chunk_id").isin(0, 14)) == 1  # as of what it read
    meeting(lambda: store.merge_store(spark, path))
    assert store.delete_rows(spark, path, F.col("chunk_id") == 3) == 1  # found again where the merge put it
    assert ids(store.read_store(spark, path)) == [1, 2, *range(4, 15)]
    meeting(lambda: store.delete_rows(spark, path, F.col("chunk_id") == 6))
    store.merge_store(spark, path)  # leaves out what went meanwhile
    assert ids(store.read_store(spark, path)) == [1, 2, 4, 5, *range(7, 15)]


def test_values_with_many_folders_are_merged(spark, tmp_path):
    path = str(tmp_path)
    for i in range(5):
        store.append_rows(rows(spark, [i, i + 5], tenants=5), path, "tenant")  # one value a part
    store.append_rows(rows(spark, [15], tenants=5), path, "tenant")
    assert len(store.merge_store(spark, path, 1)) == 2
    assert len(store.manifest(spark, path)["folders"]) == 5
    assert ids(store.read_store(spark, path)) == [*range(10), 15]


def test_null_tenants_and_values_are_kept(spark, tmp_path):
    path = str(tmp_path)
    store.append_rows(spark.createDataFrame([(1, None, None), (2, "", "01"), (2, "", "01"), (None, "x", "1")], SCHEMA), path, "tenant")
    assert sorted(map(str, store.read_store(spark, path).collect())) == sorted(map(str, spark.createDataFrame([(1, None, None), (2, "", "01"), (2, "", "01"), (None, "x", "1")], SCHEMA).collect()))
    assert store.delete_rows(spark, path, F.col("tenant").isNull()) == 1
    assert store.delete_rows(spark, path, F.col("tenant") == "1") == 1
    assert store.delete_rows(spark, path, F.col("chunk_id") == 2) == 2  # repeated rows go together


def test_vectors_are_checked_before_they_are_committed(spark, tmp_path):
    path = str(tmp_path)
    chunks = rows(spark, range(4))
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("vector"))
    search.vector_append(chunks, vectors, 2, path)
    with pytest.raises(Exception, match="right dimension"):
        search.vector_append(rows(spark, [9]), vectors.limit(1), 2, path)
    assert ids(store.read_store(spark, path)) == [0, 1, 2, 3]


def test_a_tenants_delete_reads_only_its_folders(spark, tmp_path):
    path = str(tmp_path)
    store.append_rows(rows(spark, range(9)), path, "tenant")
    held = store.manifest(spark, path)
    plan = store._rows(spark, path, held, held["folders"], places=True).filter(F.col("tenant") == "1/a b%")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan

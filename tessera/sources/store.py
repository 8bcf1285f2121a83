"""A table of Parquet folders under a log of manifests: readers see what was committed, deletes add marks, merges rewrite only the folders they touch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A value's folders from which on a merge makes them one.
MOST_FOLDERS = 8
#: What a manifest says: folders of rows (part=…/by=…), folders of marks with the folders they concern, and how many deletes and merges came before.
EMPTY = {"version": -1, "schema": None, "by": None, "folders": [], "marks": {}, "deletes": 0, "merges": 0}
MARK = "file string, row long"


def _files(spark: SparkSession, path: str):
    """(file system, a function that makes its paths, JVM) of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The last manifest of the store, or a named version; of a store nobody wrote to, an empty one."""
    fs, at, jvm = _files(spark, path)
    if not fs.exists(at(f"{path}/log")):
        return EMPTY
    versions = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(at(f"{path}/log")) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(".")]
    if not versions:
        return EMPTY
    stream = fs.open(at(f"{path}/log/{max(versions) if version is None else version:012d}.json"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, new: dict) -> bool:
    """Writes the next manifest; false if another writer was first. Renaming without overwriting decides it, which file systems do at once and many object
    stores don't: there, one writer at a time."""
    fs, at, jvm = _files(spark, path)
    started, named = at(f"{path}/log/.{uuid.uuid4().hex}"), at(f"{path}/log/{new['version']:012d}.json")
    out = fs.create(started)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(named.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(started, named, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Exception:
        if fs.exists(named):
            fs.delete(started, False)
            return False
        raise


def _rows(spark: SparkSession, path: str, held: dict, folders: list[str], places: bool = False) -> DataFrame:
    """Live rows of some folders; places: with __file and __row, where each one stands. Only folders that have marks are joined with them."""
    schema = T.StructType.fromJson(json.loads(held["schema"]))

    def part(some: list[str], placed: bool) -> DataFrame:
        read = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in some))
        where = [F.substring_index("_metadata.file_path", "/", -3).alias("__file"), F.col("_metadata.row_index").alias("__row")]
        return read.select(*schema.names, *(where if placed else []))  # `part`, the first level of folders, isn't a column of the store

    marks = {m: {*of} & {*folders} for m, of in held["marks"].items()}
    touched = {f for of in marks.values() for f in of}
    clean = [f for f in folders if f not in touched]
    out = part(clean, places) if clean else None
    if touched:
        read = spark.read.schema(MARK).parquet(*(f"{path}/marks/{m}" for m, of in marks.items() if of))
        left = part(sorted(touched), True).join(read.select(F.col("file").alias("__file"), F.col("row").alias("__row")), ["__file", "__row"], "left_anti")
        left = left.select(*schema.names, "__file", "__row") if places else left.select(*schema.names)
        out = left if out is None else out.unionByName(left)
    return out


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows as last committed, or as of a version. The plan is bound to that version: appends, deletes and merges under way don't change it."""
    held = manifest(spark, path, version)
    if held["schema"] is None:
        raise ValueError(f"nothing was committed to {path}")
    if not held["folders"]:
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(held["schema"])))
    return _rows(spark, path, held, held["folders"])


def _written(rows: DataFrame, path: str, by: str) -> list[str]:
    """Rows as a part of their own, a folder for each value of `by`; the names of these. Nobody sees them before a manifest names them. Rows of a value come
    together, in files of the advised size; a large value is split."""
    part = f"part={uuid.uuid4().hex}"
    rows.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(f"{path}/data/{part}")
    fs, at, _ = _files(rows.sparkSession, path)
    return [f"{part}/{s.getPath().getName()}" for s in fs.listStatus(at(f"{path}/data/{part}")) if s.isDirectory()]


def append_rows(rows: DataFrame, path: str, by: str) -> int:
    """Adds rows, all of them or none, and returns the version that holds them. `by` and the columns stay as the first append had them."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != by]
    rows = rows.select(*names, by)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])  # all nullable, as files read back are

    def fits(held: dict) -> None:
        known = held["schema"] and T.StructType.fromJson(json.loads(held["schema"]))
        if known and ({f.name: f.dataType for f in known} != {f.name: f.dataType for f in schema} or held["by"] != by):
            raise ValueError(f"the store has {known.simpleString()} by {held['by']}, the rows have {schema.simpleString()} by {by}")

    fits(manifest(spark, path))
    added = _written(rows, path, by)
    while True:
        held = manifest(spark, path)
        fits(held)
        new = {**held, "version": held["version"] + 1, "schema": held["schema"] or schema.json(), "by": by, "folders": held["folders"] + added}
        if _commit(spark, path, new):
            return new["version"]


def _retried(spark: SparkSession, path: str, stale: Callable[[dict, dict], bool], prepare: Callable[[dict], tuple], apply: Callable[[dict, tuple], dict]) -> tuple:
    """Prepares a change on what is committed and commits it on what is committed by then; prepares it anew if that makes it stale."""
    while True:
        seen = manifest(spark, path)
        change = prepare(seen)
        held = manifest(spark, path)
        while not stale(seen, held):
            if change[0] is None or _commit(spark, path, {**apply(held, change), "version": held["version"] + 1}):
                return change
            held = manifest(spark, path)


def delete_rows(spark: SparkSession, path: str, predicate: Column) -> int:
    """Deletes the rows of the predicate and returns their number; where it is null a row stays. No row is rewritten: folders of which nothing stays leave the
    manifest, places of other rows are written as marks. A predicate on the store's `by` reads only folders of its values."""

    def prepare(held: dict) -> tuple:
        if not held["folders"]:
            return None, {}, 0
        rows = _rows(spark, path, held, held["folders"], places=True).withColumn("__folder", F.substring_index("__file", "/", 2))
        gone = rows.filter(predicate).groupBy("__folder").agg(F.count("*").alias("n"))
        gone = {unquote(r["__folder"]): r["n"] for r in gone.collect()}  # a row for each folder
        if not gone:
            return None, {}, 0
        some = _rows(spark, path, held, [f for f in held["folders"] if f in gone], places=True).withColumn("__folder", F.substring_index("__file", "/", 2))
        sizes = {unquote(r["__folder"]): r["n"] for r in some.groupBy("__folder").agg(F.count("*").alias("n")).collect()}
        whole = {f for f, n in gone.items() if n == sizes[f]}
        partly = [f for f in held["folders"] if f in gone and f not in whole]
        marks = {}
        if partly:
            name = uuid.uuid4().hex
            _rows(spark, path, held, partly, places=True).filter(predicate).select(F.col("__file").alias("file"), F.col("__row").alias("row")).write.parquet(f"{path}/marks/{name}")
            marks[name] = partly
        return whole, marks, sum(gone.values())

    def apply(held: dict, change: tuple) -> dict:
        whole, marks, _ = change
        left = {m: [f for f in of if f not in whole] for m, of in held["marks"].items()}
        return {**held, "folders": [f for f in held["folders"] if f not in whole], "marks": {**{m: of for m, of in left.items() if of}, **marks}, "deletes": held["deletes"] + 1}

    return _retried(spark, path, lambda seen, held: seen["merges"] != held["merges"], prepare, apply)[2]


def merge_store(spark: SparkSession, path: str, most_folders: int = MOST_FOLDERS) -> list[str]:
    """Writes folders with marks, and values with more than so many folders, anew, and returns the folders that were left behind. All others stay as they are. Old
    folders stay on disk for readers of older versions."""

    def prepare(held: dict) -> tuple:
        values: dict[str, list[str]] = {}
        for f in held["folders"]:
            values.setdefault(f.split("/")[1], []).append(f)
        marked = {f for of in held["marks"].values() for f in of}
        old = [f for f in held["folders"] if f in marked or len(values[f.split("/")[1]]) > most_folders]
        if not old:
            return None, []
        return old, _written(_rows(spark, path, held, old), path, held["by"])

    def apply(held: dict, change: tuple) -> dict:
        old, new = {*change[0]}, change[1]
        left = {m: [f for f in of if f not in old] for m, of in held["marks"].items()}
        return {**held, "folders": [f for f in held["folders"] if f not in old] + new, "marks": {m: of for m, of in left.items() if of}, "merges": held["merges"] + 1}

    changed = lambda seen, held: (seen["merges"], seen["deletes"]) != (held["merges"], held["deletes"])
    return _retried(spark, path, changed, prepare, apply)[0] or []

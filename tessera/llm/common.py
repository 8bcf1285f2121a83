"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; where it is unset
    (a local session, as in tests) set a folder of our own, and refuse on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpoint_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read from there: made once, however often it is used, and read by column."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, to be broadcast where it has up to `most` rows. df: checkpointed or stored, a few numbers a row."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns that begin with `__`, as the operators' own do, renamed for the time being; and the names that give them back."""
    renamed = {c: f"input {c}" for c in docs.columns if c.startswith("__")}
    return docs.withColumnsRenamed(renamed), {new: old for old, new in renamed.items()}


def others(docs: DataFrame, *made: str) -> list[str]:
    """The columns of docs but those that get replaced; Spark doesn't tell names by case."""
    gone = {c.lower() for c in made}
    return [c for c in docs.columns if c.lower() not in gone]


def utf8_size(text: Column) -> Column:
    """Bytes of the UTF-8 form; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit_interval(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 13 hex digits of an md5 of the parts joined by ':'."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))

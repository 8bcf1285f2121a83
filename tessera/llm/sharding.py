"""Histogram-sort sharding: shards of near equal bytes, cut by exactly counted splitters.

Rows are ordered by (hash of the text, hash of the id). Each round counts the exact bytes in the cells
of the key intervals that still hold a wanted splitter, and refines only those cells, until every
splitter is within tolerance. Only histograms of bounded size reach the driver. Then the rows are
exchanged once, by units of a shard that fit in memory, and numbered.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read, set_aside, utf8_size

CELL_BITS = 10
#: Repeated keys up to this many are broadcast to the rows; more are joined. Copies of a row are made so many at a time.
BROADCAST_KEYS, COPIES = 500_000, 1 << 16
MIN_KEY, NO_KEY = -(1 << 63), 1 << 63


@dataclass(frozen=True)
class Splitter:
    """First key (hash of text, hash of id) of a shard, and the exact bytes below it."""

    text_hash: int
    id_hash: int
    bytes_below: int


def _size(text: str) -> Column:
    return utf8_size(F.col(text)) + 1


def _keys(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.col(doc_id).cast("string"), F.lit(1))


def _cell(level: int, depth: int) -> list[Column]:
    """The cell of a key at a depth in bits: of the text's hash (level 0), or of the id's among rows of one text hash (level 1)."""
    h, g = F.col("__h"), F.col("__g")
    if level == 0:
        return [F.shiftright(h, 64 - depth) if depth else F.lit(0).cast("long"), F.lit(0).cast("long")]
    return [h, F.shiftright(g, 64 - depth) if depth else F.lit(0).cast("long")]


def _first_key(level: int, depth: int, cell: tuple[int, int]) -> tuple[int, int]:
    """The first key of a cell; past the last key of a level it is that of the next."""
    h, g = cell
    if level == 0:
        return h << (64 - depth), MIN_KEY
    g <<= 64 - depth
    return (h, g) if g < NO_KEY else (h + 1, MIN_KEY)


def find_splitters(slim: DataFrame, shards: int, tolerance: float, probe_bits: int = 12) -> list[Splitter]:
    """Splitters over the columns __h, __g, __size. A round probes 2**probe_bits boundaries in each cell that holds a
    splitter; at most (shards - 1) * 2**probe_bits counts reach the driver. Rows that are equal in both hashes can't be cut."""
    total = slim.agg(F.sum("__size")).first()[0] or 0
    allowed = total / shards * tolerance
    found: dict[int, Splitter] = {}
    wanted = {total * i // shards: ((0, 0), 0) for i in range(1, shards)}  # target: its cell so far, the bytes below that
    depths = [0, *range(probe_bits, 64, probe_bits), 64]
    for level in (0, 1):
        for parent_depth, depth in zip(depths, depths[1:], strict=False):
            if not wanted:
                break
            (ph, pg), (h, g) = _cell(level, parent_depth), _cell(level, depth)
            inside = reduce(or_, ((F.col("ph") == a) & (F.col("pg") == b) for a, b in {cell for cell, _ in wanted.values()}))
            probed = slim.select(ph.alias("ph"), pg.alias("pg"), h.alias("h"), g.alias("g"), "__size").filter(inside)
            cells = defaultdict(list)
            for r in probed.groupBy("ph", "pg", "h", "g").agg(F.sum("__size").alias("bytes")).collect():
                cells[r["ph"], r["pg"]].append(((r["h"], r["g"]), r["bytes"]))
            left = {}
            for target, (parent, below) in wanted.items():
                for (a, b), size in sorted(cells[parent]):
                    if below + size <= target:
                        below += size
                        continue
                    short, over = target - below, below + size - target
                    if min(short, over) > allowed and (level, depth) != (1, 64):
                        left[target] = ((a, b), below)
                    elif short <= over:
                        found[target] = Splitter(*_first_key(level, depth, (a, b)), below)
                    else:
                        after = (a, b + 1) if level else (a + 1, b)
                        found[target] = Splitter(*_first_key(level, depth, after), below + size)
                    break
                else:  # an empty table
                    found[target] = Splitter(NO_KEY, MIN_KEY, below)
            wanted = left
    return [found[t] for t in sorted(found)]


def _at_or_above(s: Splitter) -> Column:
    if s.text_hash >= NO_KEY:
        return F.lit(0)
    h, g = F.lit(s.text_hash).cast("long"), F.lit(s.id_hash).cast("long")
    return ((F.col("__h") > h) | ((F.col("__h") == h) & (F.col("__g") >= g))).cast("int")


def _told_apart(keyed: DataFrame) -> DataFrame:
    """keyed (columns __h and __g) with another __g for rows that share both: by their other columns and, if those are equal too, by a number.

    Rows that are wholly equal are counted and made again from one of them, so that any number of them is told apart without being gathered.
    """
    repeated = checkpoint(keyed.groupBy("__h", "__g").count().filter("count > 1").select("__h", "__g"))
    n = repeated.limit(BROADCAST_KEYS + 1).count()
    if not n:
        return keyed
    known = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    counted = keyed.join(known, ["__h", "__g"], "left_semi").select(*keyed.columns).groupBy(*keyed.columns).agg(F.count("*").alias("__n"))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__n") - 1), F.lit(COPIES).cast("long")))
    dealt = counted.withColumn("__lot", lots).repartition("__h", "__g", "__lot")
    each = dealt.withColumn("__k", F.explode(F.sequence(F.col("__lot"), F.least(F.col("__n"), F.col("__lot") + COPIES) - 1)))
    apart = each.withColumn("__g", F.xxhash64("__g", *(c for c in keyed.columns if c not in ("__h", "__g")), "__k")).select(*keyed.columns)
    return keyed.join(known, ["__h", "__g"], "left_anti").select(*keyed.columns).unionByName(apart)


def shard_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 16, tolerance: float = 0.001, unit_bytes: int = 32 << 20, unit_rows: int = 1024) -> DataFrame:
    """All rows and columns, plus size, shard (0 to shards - 1) and slot (gapless from 0 within a shard).

    The size of a row is the UTF-8 bytes of its text plus 1; a null text has none, so 1; a text of any length is one row. Shards
    differ from the mean by at most `tolerance` of it at each cut, or by one row. Copies of a text share a cell of the key space, so
    stay in one shard unless a cut falls among them; slots follow cells, then units of about unit_bytes and unit_rows. Repeated rows, equal
    in text and id, are told apart by their other columns and by number, so they are cut like others (this needs columns that can be
    compared: no maps). Null ids count as equal. An empty table gives an empty result. Input columns named size, shard or slot are
    replaced, all others stay.
    """
    docs, back = set_aside(docs.drop("size", "shard", "slot"))
    h, g = _keys(doc_id, text)
    docs = _told_apart(docs.withColumns({"__h": h, "__g": g}))
    slim = checkpoint(docs.select("__h", "__g", _size(text).alias("__size")))
    splitters = find_splitters(slim, shards, tolerance)
    shard = sum((_at_or_above(s) for s in splitters), F.lit(0))
    cell = F.shiftright(F.col("__h"), 64 - CELL_BITS)
    # A cell of the key space holds many units at scale: its rows are dealt to them by the id's hash. At most 2**CELL_BITS rows.
    cells = slim.groupBy(cell.alias("__cell")).agg(F.greatest(F.lit(1), F.ceil(F.sum("__size") / unit_bytes), F.ceil(F.count("*") / unit_rows)).alias("__units"))
    unit = F.shiftright(F.shiftrightunsigned(F.col("__g"), 33) * F.col("__units"), 31)
    place = lambda df: df.withColumn("__cell", cell).join(F.broadcast(cells), "__cell").withColumns({"__shard": shard.cast("int"), "__unit": unit})
    by = ["__shard", "__cell", "__unit"]
    counted = place(slim).groupBy(*by).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__cell", "__unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rows = place(docs).join(starts, by)
    slot = F.col("__start") + F.row_number().over(Window.partitionBy(*by).orderBy("__h", "__g")) - 1
    return rows.withColumns({"size": _size(text), "shard": F.col("__shard"), "slot": slot.cast("long")}).drop("__h", "__g", "__cell", "__units", "__start", *by).withColumnsRenamed(back)


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(read(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

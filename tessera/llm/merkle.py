"""A manifest of a dataset as a Merkle tree: digests of rows, of runs of sixteen, and so on to one root, with a proof for each row.

The rows of a group get gapless ranks. Of a rank's digits to base 16 the last DIGITS are grouped away one after another, each step nesting the structs
of the one before, so that a block of 16 ** DIGITS rows becomes one row that holds its whole tree. The blocks' digests are the rows of the next round,
until a group is one block. Then the way leads down again: each block's tree meets what its root's proof needs, in one more grouping, and a transform and
an explode turn it into one proof for each row. Nothing is joined to get there, and no row holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, read

BASE, DIGITS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex of the sha256 of strings joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value such that no two sequences of fields read alike: `-` for null, else bytes, colon, value."""
    as_text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(field, values))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with __rank, their place from 0 among those of their group. Rows are sorted by range, so a group may fill many tasks; each task counts on from
    what lies before it, of which it needs one number: that of the group it begins with, so as many numbers as there are tasks. Equal rows are told
    apart by chance, so that they fill many tasks too. A null group is a group; nulls come first."""
    fields = [group, *order]
    drawn = checkpoint(rows.withColumn("__chance", F.rand()))
    ranges = drawn.repartitionByRange(*fields, "__chance").sortWithinPartitions(*fields, "__chance").drop("__chance")
    at = ranges.columns.index(group)
    schema = T.StructType([*ranges.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__nth", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(at)
            codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
            lengths = np.diff(np.append(starts, n))
            nth = np.arange(n) - np.repeat(starts, lengths)
            if last is not None and values[0].as_py() == last[0]:
                nth[: lengths[0]] += count
            last, count = (values[n - 1].as_py(),), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(nth)], names=schema.names)

    placed = checkpoint(ranges.mapInArrow(run, schema))
    counted = placed.groupBy("__task", F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__g").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    going_on = counted.withColumn("__before", F.sum("__n").over(earlier)).filter("__before > 0").select(F.col("__task").alias("__t"), "__g", "__before")
    met = placed.join(F.broadcast(going_on), (F.col("__task") == F.col("__t")) & F.col(group).eqNullSafe(F.col("__g")), "left")  # at most a row a task
    return met.withColumn("__rank", F.col("__nth") + F.coalesce("__before", F.lit(0))).drop("__task", "__nth", "__t", "__g", "__before")


def _hashes(kids: Column) -> Column:
    return F.transform(kids, lambda k: k["hash"])


def _alone(first: Column, kids: Column) -> Column:
    """Whether a run is its level's only node, which stays as it is: the first run of a level has one member only then."""
    return first & (F.size(kids) == 1)


def roll_up(nodes: DataFrame) -> DataFrame:
    """(group, block, kids, hash) of nodes (group, rank, hash, payload): each block's digest and its tree, structs of children in structs."""
    digits = [F.pmod(F.floor(F.col("rank") / BASE**i), F.lit(BASE)).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    level = nodes.select("group", F.floor(F.col("rank") / BASE**DIGITS).alias("block"), *digits, "hash", F.col("payload").alias("kids"))
    level = level.repartition("group", "block")  # one exchange for all digits
    for i in range(DIGITS):
        left = [f"d{j}" for j in range(i + 1, DIGITS)]
        level = level.groupBy("group", "block", *left).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "hash", "kids"))).alias("kids"))
        first = F.col("block") == 0
        for d in left:
            first = first & (F.col(d) == 0)
        kids = F.col("kids")
        level = level.withColumn("hash", F.when(_alone(first, kids), kids[0]["hash"]).otherwise(digest(F.array_join(_hashes(kids), ""))))
    return level.select("group", "block", "kids", "hash")


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and (group, hash) of each group's root. nodes: (group, rank, hash, payload), ranks gapless from 0."""
    rounds = [checkpoint(roll_up(nodes))]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        rounds.append(checkpoint(roll_up(rounds[-1].select("group", F.col("block").alias("rank"), "hash", F.lit(True).alias("payload")))))
    return rounds, rounds[-1].select("group", "hash")


def _siblings(kids: Column, i: Column) -> Column:
    """The digests on both sides of child i, joined."""
    hashes = _hashes(kids)
    return F.struct(F.array_join(F.slice(hashes, 1, i), "").alias("before"), F.array_join(F.slice(hashes, i + 2, BASE), "").alias("after"))


def unroll(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(group, rank, hash, payload, told) of the nodes in blocks, told with the path from the node on. above: (group, block, told) of the blocks' roots."""
    kids_type, told_type = blocks.schema["kids"].dataType, above.schema["told"].dataType
    both = blocks.select("group", "block", "kids", F.lit(None).cast(told_type).alias("told")).union(above.select("group", "block", F.lit(None).cast(kids_type), "told"))
    met = both.groupBy("group", "block").agg(F.first("kids", True).alias("kids"), F.first("told", True).alias("told")).filter("kids is not null")

    def nodes_below(kids: Column, depth: int, first: Column, path: Column, base: Column) -> Column:
        """All nodes under kids, an array at any depth. base: rank of the first."""
        own = lambda i: F.when(_alone(first, kids), path).otherwise(F.concat(F.array(_siblings(kids, i)), path))
        if depth == 1:
            return F.transform(kids, lambda k, i: F.struct((base + i).alias("rank"), k["hash"].alias("hash"), k["kids"].alias("payload"), own(i).alias("path")))
        return F.flatten(F.transform(kids, lambda k, i: nodes_below(k["kids"], depth - 1, first & (i == 0), own(i), base + i * BASE ** (depth - 1))))

    start = (F.col("block") * BASE**DIGITS).cast("long")
    each = F.explode(nodes_below(F.col("kids"), DIGITS, F.col("block") == 0, F.col("told.path"), start)).alias("x")
    flat = met.select("group", "told", each)
    return flat.select("group", "x.rank", "x.hash", "x.payload", F.col("told").withField("path", F.col("x.path")).alias("told"))


def merkle_proofs(leaves: DataFrame, *, group: str = "source", order: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """leaves with subroot (root of the row's group), root (of the groups' roots, in order of the group) and path: for each level from the leaf up the
    digests before and after the row's own, joined; fold_path of a leaf and its path is the root.

    A group's leaves are in order of (order, leaf), nulls first; a run of up to sixteen becomes one digest while a level has more than
    one node, so a lone leaf is its group's root and has no path of its own. Null groups are one group, the first. Repeated rows are leaves each. An empty
    table has no root and gives no rows. Columns of clashing names (subroot, root, path) are replaced, all others stay. Groups may be of any size and number.
    """
    rows = leaves.drop("subroot", "root", "path")
    kept = rows.columns
    placed = ranked(rows.select(F.col(group).alias("__group"), F.col(order).alias("__order"), F.col(leaf).alias("__leaf"), F.struct(*kept).alias("__row")), "__group", ["__order", "__leaf"])
    rounds, subroots = build(placed.select(F.col("__group").alias("group"), F.col("__rank").alias("rank"), F.col("__leaf").alias("hash"), F.col("__row").alias("payload")))
    groups = ranked(subroots.select(F.lit(0).alias("__all"), "group", "hash"), "__all", ["group"])
    top_rounds, root = build(groups.select(F.col("__all").alias("group"), F.col("__rank").alias("rank"), "hash", F.struct(F.col("group").alias("group")).alias("payload")))
    above = root.select("group", F.lit(0).cast("long").alias("block"), F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"), F.array().cast(PATH).alias("path")).alias("told"))
    for blocks in reversed(top_rounds):
        nodes = unroll(blocks, above)
        above = nodes.select("group", F.col("rank").alias("block"), "told")
    above = nodes.select(F.col("payload.group").alias("group"), F.lit(0).cast("long").alias("block"), F.col("told").withField("subroot", F.col("hash")).alias("told"))
    for blocks in reversed(rounds):
        nodes = unroll(blocks, above)
        above = nodes.select("group", F.col("rank").alias("block"), "told")
    return nodes.select("payload.*", "told.subroot", "told.root", "told.path")


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["before"], h, p["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids aren't tampered with."""
    docs = read(spark, sf_dir, "documents")
    *facts, text = (F.col(c) for c in FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(touched, leaf_digest(*facts, F.translate(text, CAPITALS, SMALL)))
    proofs = merkle_proofs(docs.select("doc_id", "source", leaf_digest(*facts, text).alias("leaf"), tampered.alias("tampered")))
    folded = fold_path(F.coalesce("tampered", "leaf"), F.col("path"))
    told = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, key: str, first: str, levels: int) -> str:
    """Relations {name}0 .. of (key, idx, h), and {name}p0 .. of (key, idx, l, r, more) with each node's siblings. Up to 16 ** levels nodes a key."""
    out = [f"{name}0 AS ({first})"]
    for i in range(levels):
        out.append(f"""{name}p{i} AS (SELECT {key}, idx, h, count(*) OVER (PARTITION BY {key}) > 1 AS more,
  coalesce(string_agg(h, '') OVER (PARTITION BY {key}, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY {key}, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})""")
        out.append(f"{name}{i + 1} AS (SELECT {key}, idx // 16 AS idx, CASE WHEN bool_or(more) THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE max(h) END AS h FROM {name}p{i} GROUP BY {key}, idx // 16)")
    return ",\n".join(out)


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


#: Levels that the SQL holds: 16 ** 5 documents a source, 256 sources.
LEAF_LEVELS, TOP_LEVELS = 5, 2
_SAME = "l0.source IS NOT DISTINCT FROM {0}.source AND {0}.idx = l0.idx // {1}"
_PATH = [f"u{i}" for i in range(LEAF_LEVELS)] + [f"t{i}" for i in range(TOP_LEVELS)]


def _fold_sql() -> str:
    """folded0 .. : the leaf, or what it has been made, folded with its siblings step by step."""
    out, last = [], "chosen"
    for i, p in enumerate(_PATH):
        out.append(f"folded{i} AS (SELECT * EXCLUDE (cur), CASE WHEN {p}more THEN sha256({p}l || cur || {p}r) ELSE cur END AS cur FROM {last})")
        last = f"folded{i}"
    return ",\n".join(out)


def _sides(p: str) -> str:
    return f"{p}.l AS {p}l, {p}.r AS {p}r, {p}.more AS {p}more"


_FACTS = " || ".join(map(_field_sql, FIELDS[:-1]))
_LOWERED = "translate(text, '" + CAPITALS + "', '" + SMALL + "')"
#: crc32 by its definition, as SQL has none: bit by bit over the bytes of the decimal id.
_CRC = """
crc AS (WITH RECURSIVE step AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(substr(s, k // 9 + 1, 1)) AS BIGINT)) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END
  FROM step WHERE k < 9 * length(s))
  SELECT DISTINCT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM step WHERE k = 9 * length(s))
"""
OP12_SQL = f"""WITH {_CRC.strip()},
leaf AS (SELECT doc_id, source, sha256({_FACTS} || {_field_sql('text')}) AS leaf, sha256({_FACTS} || {_field_sql(_LOWERED)}) AS lowered FROM documents),
{_levels_sql('l', 'source', 'SELECT source, doc_id, leaf AS h, lowered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf', LEAF_LEVELS)},
{_levels_sql('s', 'one', f'SELECT 1 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM l{LEAF_LEVELS}', TOP_LEVELS)},
chosen AS (SELECT l0.doc_id, l0.h AS leaf, s0.h AS subroot, s{TOP_LEVELS}.h AS root, CASE WHEN crc % 5 = 0 THEN lowered ELSE l0.h END AS cur, {', '.join(map(_sides, _PATH))}
  FROM l0 LEFT JOIN crc ON crc.doc_id = l0.doc_id {' '.join(f'JOIN lp{i} u{i} ON ' + _SAME.format(f'u{i}', 16**i) for i in range(LEAF_LEVELS))}
  JOIN s0 ON s0.source IS NOT DISTINCT FROM l0.source {' '.join(f'JOIN sp{i} t{i} ON t{i}.idx = s0.idx // {16**i}' for i in range(TOP_LEVELS))} CROSS JOIN s{TOP_LEVELS}),
{_fold_sql()}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f"CASE WHEN {p}more THEN {p}l || {p}r ELSE '' END" for p in _PATH)}) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM folded{len(_PATH) - 1}
"""

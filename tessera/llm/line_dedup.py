"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines with a non-blank one among them. A window that occurs more than once in the table
keeps its first occurrence, in order of (doc_id, text hash, position); all later ones cover their three lines, and covered lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read, set_aside

WINDOW = 3


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """All rows and columns, the text without its covered lines, plus n_lines and removed_lines.

    Every removed line has an equal line earlier in the order that stays. Documents of fewer than three lines, null and
    empty texts stay as they are (null: no lines). Rows equal in id and text are one document and treated alike; ids may
    be null. A text whose lines all go becomes empty. A text of any length is one row, and its windows are rows. Input columns named n_lines or
    removed_lines are replaced, all others stay.
    """
    docs, back = set_aside(docs.drop("n_lines", "removed_lines"))
    lines = F.split(F.col(text), "\n", -1)
    text_hash = F.xxhash64(F.col(text))
    hashed = docs.select(F.col(doc_id).alias("__id"), text_hash.alias("__th"), F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("__h"))
    long_enough = hashed.filter(F.size("__h") >= WINDOW)
    positions = long_enough.select("__id", "__th", "__h", F.explode(F.sequence(F.lit(0), F.size("__h") - WINDOW)).alias("__pos"))
    h = [F.get(F.col("__h"), F.col("__pos") + i) for i in range(WINDOW)]
    # Three 64-bit hashes name a window. The slim table is read twice; it is cut from the texts here.
    windows = checkpoint(positions.select("__id", "__th", "__pos", *(x.alias(f"__h{i}") for i, x in enumerate(h))).filter("__h0 <> 0 or __h1 <> 0 or __h2 <> 0"))
    key = ["__h0", "__h1", "__h2"]
    place = F.struct("__id", "__th", "__pos")
    repeated = windows.groupBy(*key).agg(F.min(place).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    salted = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    later = windows.withColumn("__salt", F.pmod(F.xxhash64("__id", "__pos"), F.lit(salts)).cast("int")).join(salted, [*key, "__salt"]).filter(~place.eqNullSafe(F.col("__first")))
    covered = later.groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__starts"))
    covered = covered.select("__id", "__th", F.array_distinct(F.flatten(F.transform("__starts", lambda p: F.array(*(p + i for i in range(WINDOW)))))).alias("__covered"))
    joined = docs.withColumn("__own", text_hash).join(covered, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__covered"))
    shorter = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    removed = F.coalesce(F.size("__covered"), F.lit(0))
    removed = F.when(F.col("__covered").isNull(), 0).otherwise(removed)
    out = joined.withColumns({"n_lines": n_lines, "removed_lines": removed})
    return out.withColumn(text, F.when(F.col("__covered").isNotNull(), shorter).otherwise(F.col(text))).drop("__own", "__id", "__th", "__covered").withColumnsRenamed(back)


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines")


#: Rows of dedup over a relation documents(doc_id, text) with distinct ids.
LINES_SQL = """
split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs}),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM split),
shown AS (SELECT doc_id, pos, CASE WHEN trim(line, ' ') = '' THEN '' ELSE line END AS line FROM line),
wide AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM shown WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
win AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM wide WHERE c IS NOT NULL AND NOT (a = '' AND b = '' AND c = '')),
covered AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM win WHERE nth > 1),
rest AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS kept FROM line l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
"""
OP9_SQL = "WITH " + LINES_SQL.format(docs="documents") + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, CAST(coalesce(len(s.lines), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(s.lines), 0) - coalesce(r.kept, 0) AS INTEGER) AS removed_lines
FROM documents d JOIN split s ON s.doc_id = d.doc_id LEFT JOIN rest r ON r.doc_id = d.doc_id
"""

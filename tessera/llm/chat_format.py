"""Chat formatting with Spark expressions only.

A conversation becomes one string of blocks, `<|start|>role<|text|>text(<|turn|>text)*<|end|>`. Adjacent turns of a role are
merged into one block, with a mark between them. Inside roles and texts `~` is written `~0` and `<|` is written `~1`, so that no
text can hold a control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>"
#: Prefix sums run in blocks of this many turns, so that their cost stays near linear in the turns of a conversation.
BLOCK = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _running(values: Column) -> Column:
    """Sums of an array<long> before each of its elements."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")

    def before(x: Column) -> Column:
        start = F.struct(zero.alias("sum"), empty.alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))["out"]

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda i: F.slice(values, i, BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, v: acc + v))
    return F.flatten(F.zip_with(blocks, before(sums), lambda b, base: F.transform(before(b), lambda v: v + base)))


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_blocks and loss_spans.

    loss_spans has one entry per turn of `loss_role`, in order: start and length of its escaped text in code points of
    `formatted`, and byte_start and byte_length in its UTF-8 form. Turns are ordered by (turn, role, text), texts as they are and not as escaped, nulls first;
    null roles and texts count as empty, a null conv_id is a conversation of its own, repeated rows are repeated turns,
    other columns are ignored. No rows, no conversations. A conversation has to fit into one row.
    """
    said = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"))
    escaped = lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))
    sorted_turns = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("said")), escaped).alias("turns"))
    n = F.size("turns")
    opens = lambda i: (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != F.get(F.col("turns"), i)["role"])
    starts = sorted_turns.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), opens))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(n))
    runs = F.zip_with("starts", ends, lambda a, b: F.struct(F.get(F.col("turns"), a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda t: t["text"]).alias("texts")))
    merged = starts.select("conv_id", "turns", runs.alias("runs"))
    block = lambda r: F.concat(F.lit(START), escape(r["role"]), F.lit(TEXT), F.array_join(r["texts"], TURN), F.lit(END))

    def lead(measure) -> Column:
        """Length of the marks before each turn's text."""
        first = lambda r: F.lit(len(START) + len(TEXT)) + measure(escape(r["role"]))
        return F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda _, i: F.when(i == 0, first(r)).otherwise(len(TURN)).cast("long"))))

    closes = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda _, i: F.when(i == F.size(r["texts"]) - 1, len(END)).otherwise(0).cast("long"))))
    shaped = merged.select("conv_id", "turns", F.size("runs").alias("n_blocks"), F.array_join(F.transform("runs", block), "").alias("formatted"), lead(F.length).alias("lead"), lead(F.octet_length).alias("byte_lead"), closes.alias("close"))
    chars = F.transform("turns", lambda t: F.length(t["text"]).cast("long"))
    octets = F.transform("turns", lambda t: F.octet_length(t["text"]).cast("long"))
    measured = shaped.withColumns({"chars": chars, "octets": octets})
    whole = lambda a, b: F.zip_with(F.zip_with(a, b, lambda x, y: x + y), "close", lambda x, y: x + y)
    placed = measured.withColumns({"at": _running(whole("lead", "chars")), "byte_at": _running(whole("byte_lead", "octets"))})
    span = lambda t, i: F.struct(
        (t["role"] == loss_role).alias("loss"),
        (F.get(F.col("at"), i) + F.get(F.col("lead"), i)).alias("start"), F.get(F.col("chars"), i).alias("length"),
        (F.get(F.col("byte_at"), i) + F.get(F.col("byte_lead"), i)).alias("byte_start"), F.get(F.col("octets"), i).alias("byte_length"),
    )
    spans = F.filter(F.transform("turns", span), lambda s: s["loss"])
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), s["byte_start"].alias("byte_start"), s["byte_length"].alias("byte_length")))
    return placed.select("conv_id", "formatted", "n_blocks", spans.alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation."""
    blocks = F.split(formatted, "<\\|end\\|>", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(START) + 1)), TEXT, 1)
        body = F.substr(block, F.lit(len(START) + len(TEXT) + 1) + F.length(role))
        return F.transform(F.split(body, "<\\|turn\\|>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    octets = formatted.cast("binary")
    part = lambda s: F.decode(F.substr(octets, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "UTF-8")
    return F.array_join(F.transform(spans, lambda s: unescape(part(s))), "")


def op6_chat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_conversations(turns.unionByName(extra))
    read_back = out.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(text, '~', '~0'), '<|', '~1') AS shown, replace(replace(role, '~', '~0'), '<|', '~1') AS name,
         lag(role) OVER w IS DISTINCT FROM role AS opens FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown) + CASE WHEN opens THEN length(name) + 24 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

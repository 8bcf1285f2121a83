"""Audit of how filters interact, by decision diagrams of their failure masks.

Each text fails some of the filters: a mask of bits. The rows of a part are counted by mask, and the counts become a
decision diagram: a level for each filter, in the order in which filters are applied; at a node the rows that got there part into those
that pass and those that fail; nodes of equal content are one. Swapping two adjacent levels rewrites only these two, so one diagram visits all orders, one
swap each. Along the path of passes from the root lies what each step keeps and removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Weight = tuple[int, ...]


class Diagram:
    """A decision diagram of weights by mask. A node is (level's variable, node of those that pass, node of those that fail), a leaf its weight; all are shared."""

    def __init__(self, names: str, weights: dict[int, Weight], width: int):
        self.order = list(range(len(names)))
        self.names, self.nothing = names, (0,) * width
        self.ids: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.sums: list[Weight] = []
        self.root = self._build(0, 0, weights)

    def _leaf(self, weight: Weight) -> int:
        return self._keep(("leaf", weight), weight)

    def _node(self, variable: int, passed: int, failed: int) -> int:
        return self._keep((variable, passed, failed), tuple(a + b for a, b in zip(self.sums[passed], self.sums[failed], strict=True)))

    def _keep(self, node: tuple, weight: Weight) -> int:
        if node not in self.ids:
            self.ids[node] = len(self.nodes)
            self.nodes.append(node)
            self.sums.append(weight)
        return self.ids[node]

    def _build(self, level: int, mask: int, weights: dict[int, Weight]) -> int:
        if level == len(self.order):
            return self._leaf(weights.get(mask, self.nothing))
        return self._node(level, self._build(level + 1, mask, weights), self._build(level + 1, mask | 1 << level, weights))

    def swap(self, level: int) -> None:
        """Exchange the filters at level and level + 1; what lies below stays as it is, what lies above is rewired."""
        upper, lower = self.order[level], self.order[level + 1]
        self.order[level], self.order[level + 1] = lower, upper
        done: dict[int, int] = {}

        def rewire(i: int, depth: int) -> int:
            if i not in done:
                variable, passed, failed = self.nodes[i]
                if depth < level:
                    done[i] = self._node(variable, rewire(passed, depth + 1), rewire(failed, depth + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = self.nodes[passed], self.nodes[failed]
                    done[i] = self._node(lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
            return done[i]

        self.root = rewire(self.root, 0)

    def passes(self) -> list[tuple[int, Weight, Weight]]:
        """(filter, weight kept, weight removed) of each step along the path of passes."""
        at, found = self.root, []
        for _ in self.order:
            variable, at, failed = self.nodes[at]
            found.append((variable, self.sums[at], self.sums[failed]))
        return found


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after another, lead through all orders of n filters, each once (the plain changes of bell ringers)."""
    if n < 2:
        return
    down, inner = list(range(n - 2, -1, -1)), adjacent_swaps(n - 1)
    sweeps = 0
    while True:
        yield from down if sweeps % 2 == 0 else reversed(down)
        sweeps += 1
        between = next(inner, None)
        if between is None:
            return
        yield between + (sweeps % 2)  # after a sweep down the moving filter is first, and the others' levels begin one lower


def audit_part(names: str, weights: dict[int, Weight]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique fails, lost weights .., shapley) of every order and step. A weight is (rows, further counts ..)."""
    width = len(next(iter(weights.values())))
    diagram = Diagram(names, weights, width)
    walks = [diagram.passes()]
    for level in adjacent_swaps(len(names)):
        diagram.swap(level)
        walks.append(diagram.passes())
    failing, unique, total = [0] * len(names), [0] * len(names), [0] * len(names)
    for walk in walks:
        first, last = walk[0], walk[-1]
        failing[first[0]], unique[last[0]] = first[2][0], last[2][0]
        for variable, _, removed in walk:
            total[variable] += removed[0]
    rows = []
    for walk in walks:
        order = "".join(names[v] for v, _, _ in walk)
        for step, (v, kept, removed) in enumerate(walk, 1):
            rows.append((order, step, kept[0], removed[0], failing[v] - removed[0], unique[v], *removed[1:], total[v]))
    return rows


def audit_filters(rows: DataFrame, names: str, *, part: str = "part", mask: str = "mask", count: str = "n", lost: tuple[str, ...] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, the columns of lost (what each step removes of them) and shapley (what the filter
    removes, summed over all orders), for all orders of the filters and each step.

    rows: any number of (part, mask, count, lost ..) rows, counts not null; bit i of a mask is set where names[i] fails. A part's rows are summed by mask
    before they meet, so a task holds 2**len(names) sums of a part, however many rows it has; parts are spread over the tasks. A null part is
    a part like others. No rows give no rows. Orders are len(names)!, so more than 7 filters are refused.
    """
    if not 0 < len(names) < 8 or len(set(names)) < len(names):
        raise ValueError("give one to seven filters, each a letter of its own")
    sums = rows.groupBy(F.col(part).alias("part"), F.col(mask).alias("mask")).agg(*(F.sum(c).cast("long").alias(f"w{i}") for i, c in enumerate((count, *lost))))
    held = sums.groupBy("part").agg(F.collect_list(F.struct("mask", F.array(*(f"w{i}" for i in range(1 + len(lost))))).cast("struct<m:int,w:array<bigint>>")).alias("masks"))
    longs = ("kept", "removed", "redundant", "unique_fails", *lost, "shapley")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, masks in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                found = audit_part(names, {x["m"]: tuple(x["w"]) for x in masks})
                orders, steps, *counts = zip(*found, strict=True)
                columns = [pa.array([name] * len(found), pa.string()), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(np.array(c, np.int64)) for c in counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *longs])

    return held.select(F.col("part").cast("string"), "masks").mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def text_masks(text: Column, *, least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5, symbols: str = "#$%&*|") -> Column:
    """Bits 0 to 3: too few words, too few of a hundred distinct, too many of a hundred characters A-Z, any of the symbols. Null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    facts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    judged = F.transform(F.array(facts), lambda f: (f["n"] < least_words).cast("int") + 2 * (100 * f["distinct"] < least_distinct * f["n"]).cast("int"))[0]  # words are split once
    capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return judged + 4 * (100 * capitals > most_capitals * F.length(whole)).cast("int") + 8 * whole.rlike(f"[{symbols}]").cast("int")


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good_lost, toxic_lost): documents counted by source and failed filters A to E, with those of quality 1 and of toxic 1.

    E: the text is that of a smaller doc_id, anywhere in the table. Null source counts as empty, a null text as an empty one; a null
    doc_id is smaller than none and has none smaller, and no label. Of repeated labels of an id one that says 1 is enough. Repeated rows count each; rows
    of the least id of a text don't fail E. Other columns are ignored.

    Texts stay where they are read: only digests, ids and masks are shuffled. Rows are first counted by all that tells them apart, so copies meet as
    one row for each id, and a text's rows need not meet: those of its least id are found by one row a text and id.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    digest = [F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole, F.length(whole)).alias("h2")]
    slim = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), *digest, text_masks(F.col("text")).alias("mask"))
    by_id = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = slim.groupBy("doc_id", "part", "h", "h2", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(c, F.lit(0))
    rows = checkpoint(counted.join(by_id, "doc_id", "left").withColumns({"good": one("good"), "toxic": one("toxic")}))
    least = rows.groupBy("h", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows"))
    copied = rows.join(least.filter("rows > 1 and least < most"), ["h", "h2"], "left")
    mask = F.col("mask") + F.lit(16) * one((F.col("doc_id") > F.col("least")).cast("int"))
    return copied.select("part", mask.alias("mask"), "n", (F.col("n") * F.col("good")).alias("good_lost"), (F.col("n") * F.col("toxic")).alias("toxic_lost"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = document_masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return audit_filters(masks, "ABCDE", lost=("good_lost", "toxic_lost"))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [CASE WHEN len(words) < 50 THEN 1 ELSE 0 END, CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 1 ELSE 0 END,
   CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 1 ELSE 0 END,
   CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END, CASE WHEN s.doc_id > least THEN 1 ELSE 0 END] AS f FROM split s LEFT JOIN label l ON l.doc_id = s.doc_id),
mask AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letter AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
told AS (SELECT m.part, o, step, o[step] AS own, list_sum(list_transform(o[1:step], lambda j: f[j])) = 0 AS kept, coalesce(list_sum(list_transform(o[1:step - 1], lambda j: f[j])), 0) > 0 AS before,
  f[o[step]] = 1 AS fails, list_sum(f) = 1 AS alone, n, good, toxic FROM steps, mask m),
step_rows AS (SELECT part, o, step, own, sum(CASE WHEN kept THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM told GROUP BY part, o, step, own)
SELECT part, list_aggregate(list_transform(o, lambda j: substr('ABCDE', j, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM step_rows
"""

"""Substring dedup by windows of words, level by level.

A long window can repeat only if each window inside it does. So windows of START words come first; those that occur once end there, those repeated
are extended to twice the length, again and again, until the asked length is reached or no candidate is left. At the first level a long window is
stood for by one short window inside it: the one of least hash, which is the same wherever the long window occurs, so that a fifth or less of the
positions is enough and no repeat is missed.

Before that whole stretches between places that the text itself chooses are compared: a stretch seen earlier is settled with one row, and the levels
look only for windows that different stretches share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, read, set_aside, small, stored

#: Short enough to stand for few windows each, and long enough to repeat seldom by chance, which windows of five words do in a large corpus.
LENGTH, START = 20, 10
#: Windows of a stretch, in the mean.
STRETCH = 64
SEED = 42
#: Hashes of repeated windows, a number each, that are broadcast; more are joined.
NUMBERS = 2_000_000
#: Rows made at once.
BLOCK = 100_000


class Words:
    """The words of a text and the hashes of their runs, by XXH3 of the words joined by spaces."""

    def __init__(self, text: bytes | None):
        self.parts = (text or b"").split()
        self.n = len(self.parts)
        self.joined = b" ".join(self.parts)
        lengths = np.fromiter(map(len, self.parts), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def hashes(self, length: int) -> np.ndarray:
        """64 bits of each run of `length` words."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        made, joined = xxhash.xxh3_64_intdigest, self.joined
        pairs = zip(self.starts[: self.n - length + 1].tolist(), self.ends[length - 1 :].tolist(), strict=True)
        return np.fromiter((made(joined[a:b], SEED) for a, b in pairs), np.uint64, self.n - length + 1)

    def wide(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """128 bits, as two signed longs, of the runs that begin at starts."""
        made, joined = xxhash.xxh3_128_digest, self.joined
        pairs = zip(self.starts[starts].tolist(), self.ends[starts + lengths - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([made(joined[a:b], SEED) for a, b in pairs]), ">i8").astype(np.int64).reshape(-1, 2)


def anchors(short: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` consecutive hashes the place of the least, the leftmost of equal ones."""
    if len(short) < width:
        return np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(short, width)
    return np.concatenate([seen[i : i + BLOCK].argmin(1) + np.arange(i, min(i + BLOCK, len(seen))) for i in range(0, len(seen), BLOCK)])


def cuts_of(short: np.ndarray, stretch: int) -> np.ndarray:
    """Where stretches begin: at the first word, and where a short window's hash is one of every `stretch`-th."""
    return np.unique(np.append(np.flatnonzero(short % np.uint64(stretch) == 0), 0))


class Anchored:
    """A text's windows of `length` words: the short window that stands for each, and the stretch that each begins in."""

    def __init__(self, words: Words, length: int, start: int, stretch: int):
        self.windows = max(words.n - length + 1, 0)
        self.first = self.sizes = self.key = self.stands = self.own = np.zeros(0, np.int64)
        if not self.windows:
            return
        short = words.hashes(start)
        cuts = cuts_of(short, stretch)
        self.stands = anchors(short, length - start + 1)
        passed = np.zeros(len(short), np.int64)
        passed[cuts] = 1
        passed = np.cumsum(passed) - 1
        self.own = passed[: self.windows]
        # Cuts between a window's begin and its anchor lie in the window, so they are the same wherever it occurs, and tell windows of an anchor in two stretches apart.
        between = (passed[self.stands] - self.own).astype(np.uint64)
        self.key = (short[self.stands] + between * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        self.first = cuts[cuts < self.windows]
        self.sizes = np.diff(np.append(self.first, self.windows))


def _flushed(batches: Iterator[pa.RecordBatch], names: list[str], each: Callable[..., Iterator[tuple[object, tuple[np.ndarray, ...]]]]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK rows of what each(batch) yields: an id and its columns of numbers. The id comes last."""
    for batch in batches:
        ids, made, held = [], [], 0

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]
            own = pa.array(ids, batch.column(0).type).take(pa.array(np.repeat(np.arange(len(ids)), [len(m[0]) for m in made])))  # noqa: B023
            return pa.RecordBatch.from_arrays([*columns, own], names=names)

        for doc_id, columns in each(batch):
            if len(columns[0]):
                ids.append(doc_id)
                made.append(columns)
                held += len(columns[0])
            if held > BLOCK:
                yield batch_of()
                ids, made, held = [], [], 0
        if ids:
            yield batch_of()


def _texts(batch: pa.RecordBatch, text: int) -> Iterator[tuple]:
    """The values before the text's column, and the words."""
    before = [batch.column(i).to_pylist() for i in range(text)]
    for *values, x in zip(*before, batch.column(text).cast(pa.binary()), strict=True):
        yield *values, Words(x.as_py())


def anchor_rows(docs: DataFrame, length: int, start: int, stretch: int) -> DataFrame:
    """(key, stretch, ref) of each short window that stands for some long one in a stretch, with the stretch's hash and the document; a stretch's first row also
    has the rest of its hash, b, its place, at, its number of windows, n, and the id. A short window that comes again in a stretch gets another
    number for it, as the two are to be told apart. docs: __id, __version, __ref, __text."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, version, ref, words in _texts(batch, 3):
            a = Anchored(words, length, start, stretch)
            if not a.windows:
                continue
            where = np.flatnonzero((np.diff(a.stands, prepend=-1) != 0) | (np.diff(a.own, prepend=-1) != 0))
            key, own = a.key[where], a.own[where]
            wide = words.wide(a.first, a.sizes + length - 1)
            told = wide[own, 0]
            order = np.lexsort((own, key))
            again = order[1:][(key[order[1:]] == key[order[:-1]]) & (own[order[1:]] == own[order[:-1]])]
            told[again] += a.stands[where][again] + 1
            begins = np.diff(own, prepend=-1) != 0
            filled = np.zeros((4, len(where)), np.int64)
            filled[:, begins] = wide[:, 0], wide[:, 1], version + a.first, a.sizes
            yield doc_id, (key, told, np.full(len(where), ref), *filled)

    longs = ["key", "stretch", "ref", "a", "b", "at", "n"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in longs), T.StructField("id", docs.schema["__id"].dataType)])
    rows = docs.select("__id", "__version", "__ref", "__text").mapInArrow(lambda batches: _flushed(batches, schema.names, each), schema)
    only = [F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("a", "b", "at", "n", "id")]
    return rows.select("key", "stretch", "ref", *only)


def window_rows(docs: DataFrame, lengths: list[int], stretch: int) -> DataFrame:
    """(a, b, at, h.., t.., id): the candidates among the windows of the last of lengths: hash, place, and for each length between the hash and place of the
    window inside that holds the anchor. docs: __id, __version, __text, keys (of repeated short windows) and settled (stretches: at, n)."""
    start, between, length = lengths[0], lengths[1:-1], lengths[-1]

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        listed = zip(_texts(batch, 2), batch.column(3), batch.column(4), strict=True)
        for (doc_id, version, words), keys, settled in listed:
            a = Anchored(words, length, start, stretch)
            known = np.unique(np.array(keys.as_py() or (), np.int64))
            if not a.windows or not len(known):
                continue
            candidate = known[np.minimum(np.searchsorted(known, a.key), len(known) - 1)] == a.key
            for x in settled.as_py() or ():
                if x["at"] >= version and x["at"] - version + x["n"] <= a.windows:
                    candidate[x["at"] - version : x["at"] - version + x["n"]] = False
            at = np.flatnonzero(candidate)
            wide = words.wide(at, np.full(len(at), length))
            inside = []
            for middle in between:
                begins = np.minimum(a.stands[at], at + length - middle)  # with the anchor, if it still ends inside
                distinct, back = np.unique(begins, return_inverse=True)
                inside += [words.wide(distinct, np.full(len(distinct), middle))[back, 0], version + begins]
            yield doc_id, (wide[:, 0], wide[:, 1], version + at, *inside)

    longs = ["a", "b", "at", *(f"{c}{i}" for i in range(len(between)) for c in "ht")]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in longs), T.StructField("id", docs.schema["__id"].dataType)])
    return docs.select("__id", "__version", "__text", "keys", "settled").mapInArrow(lambda batches: _flushed(batches, schema.names, each), schema)


def least_places(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys and first, the least place (id, at), of those of several rows. Minima are made before the shuffle, so a hot key is a row a task."""
    return rows.groupBy(*keys).agg(F.min(F.struct("id", at)).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select(*keys, "first")


def later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are found at an earlier place, too."""
    return rows.join(least_places(rows, keys, "at"), keys).filter(F.struct("id", "at") > F.col("first")).drop("first")


def doubled(start: int, length: int) -> list[int]:
    """start, twice that, and so on up to length."""
    lengths = [min(start, length)]
    while lengths[-1] < length:
        lengths.append(min(2 * lengths[-1], length))
    return lengths


def repeated_windows(docs: DataFrame, length: int, start: int, stretch: int) -> DataFrame:
    """(id, at, n): at the place `at` and the next n - 1 windows of `length` words begin that each begin earlier, too; all such windows are in some row. A
    place is the number of the id's version in the upper half, the window's in the lower. docs: __id, __version, __ref, __text."""
    lengths = doubled(start, length)
    rows = stored(anchor_rows(docs, length, lengths[0], stretch), "anchors")
    settled = stored(later(rows.filter("n > 0").select("a", "b", "at", "n", "id", "ref"), ["a", "b"]), "stretches")
    shared = rows.groupBy("key").agg(F.min("stretch").alias("least"), F.max("stretch").alias("most")).filter("least < most").select("key")
    kept = rows.select("key", "ref").join(small(stored(shared, "repeated"), NUMBERS), "key", "left_semi")
    told = kept.select("ref", "key", F.lit(None).cast("struct<at:bigint,n:bigint>").alias("s")).union(settled.select("ref", F.lit(None).cast("long"), F.struct("at", "n")))
    held = told.groupBy("ref").agg(F.collect_set("key").alias("keys"), F.collect_list("s").alias("settled")).filter(F.size("keys") > 0)
    windows = window_rows(docs.join(held, F.col("__ref") == F.col("ref")), lengths, stretch)
    levels = [(f"h{i}", f"t{i}") for i in range(len(lengths) - 2)] + [("a", "at")]
    for length, (h, at) in zip(lengths[1:] or lengths, levels, strict=True):  # those repeated at one length alone go on to the next
        windows = stored(windows, f"windows-{length}")
        place = F.xxhash64("id", at)
        several = windows.groupBy(h).agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least < most").select(h)
        windows = windows.join(small(stored(several, "repeated"), NUMBERS), h, "left_semi").drop(*{h, at} - {"a", "at"})
    windows = stored(windows.withColumn("n", F.lit(1).cast("long")), "windows-left")
    return settled.select("id", "at", "n").union(later(windows, ["a", "b"]).select("id", "at", "n"))


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, start: int = START, stretch: int = STRETCH) -> DataFrame:
    """All rows and columns, with kept_text, the words that stay joined by one space, n_words and n_removed.

    A window is `length` consecutive words of one row's text; a word goes if a window over it, as the text is before anything goes, also begins
    earlier: in a row of smaller id (null is the smallest) or earlier in the same text. Rows of one id with different texts are in order of a hash of
    the text; rows equal in id and text are one document and treated alike. A null or empty text has no words, and kept_text is then empty; a text of
    fewer words than a window stays whole; texts count whole, however long. An empty table stays empty. Columns named kept_text, n_words or n_removed
    are replaced. start: the length of the first level; stretch: the mean number of
    windows that are compared as one before the levels, of which the result doesn't depend.
    """
    if not 0 < start <= length:
        raise ValueError("windows begin with one word or more, and not with more than they end with")
    docs, back = set_aside(docs.select(*others(docs, "kept_text", "n_words", "n_removed")))
    version = F.shiftleft(F.xxhash64(F.lit("version"), F.col(text)).bitwiseAND(F.lit((1 << 31) - 1)), 32)
    slim = docs.select(F.col(doc_id).alias("__id"), version.alias("__version"), F.xxhash64(F.col(doc_id), F.col(text)).alias("__ref"), F.col(text).alias("__text"))
    found = repeated_windows(slim, length, start, stretch)
    ranges = found.groupBy("id", F.shiftleft(F.shiftright("at", 32), 32).alias("v")).agg(F.collect_list(F.struct((F.col("at").bitwiseAND(F.lit((1 << 32) - 1))).alias("at"), "n")).alias("__ranges"))
    met = docs.withColumn("__version", version).join(ranges, F.col(doc_id).eqNullSafe(F.col("id")) & (F.col("__version") == F.col("v")), "left").select(*(docs[c] for c in docs.columns), "__ranges")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    at_text = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x, ranges in zip(batch.column(at_text).cast(pa.binary()), batch.column(len(names)), strict=True):
                words = (x.as_py() or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if ranges.is_valid:
                    first, n = (ranges.values.field(i).to_numpy() for i in range(2))
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + n + length - 1, -1)
                kept = words if not ranges.is_valid else [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]  # noqa: B905
                made.append((b" ".join(kept).decode("utf-8", "replace"), len(words), len(words) - len(kept)))
            texts, n, removed = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return met.mapInArrow(run, schema).withColumnsRenamed(back)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM split)),
nth AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM nth WHERE nth > 1),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM word w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""

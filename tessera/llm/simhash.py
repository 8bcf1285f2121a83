"""SimHash components with bit-sliced comparison, and near-dedup whose links are confirmed by Jaccard similarity.

Texts become fingerprints of 64-bit lanes; bit planes of a bucket's fingerprints are stored vertically, 64 fingerprints to a
word, and the distances of a query to all of them are counted at once by carry-save counters that start so high that a carry
out of the top means "beyond the radius". A word whose 64 distances are all beyond is abandoned.

simhash_components is exact: of radius + m disjoint parts of two fingerprints within the radius, m are equal, so each choice of m
parts keys a bucket. Buckets of over TILE fingerprints are compared tile by tile, so that no task holds more than two tiles of one.

near_dedup finds its first links by wider fingerprints. At a similarity such as 0.8 fingerprints neither find all pairs nor only
them, so each link is confirmed by the shingle sets, and pairs still apart are found by the sets' prefixes, which miss none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, read, set_aside

SEED = 42
TILE = 8192
#: Hot buckets up to this many are broadcast; more are joined by key.
BROADCAST_BUCKETS = 100_000
#: Rows of numbers up to this many are broadcast to the texts; more are joined.
BROADCAST_ROWS = 500_000
#: Least bits of a set's bitmap, which rules out most pairs before their texts meet.
BITMAP = 2048
#: Labels at a hash up to which all sets of different labels meet there; beyond it sets meet at the first hash they share.
FEW_LABELS = 64
#: Hashes before a frequent one that go with it.
RECENT = 8
#: Hashes of sets that a task remembers while it compares texts.
REMEMBERED = 2_000_000
#: Shingles that this many texts of a sample of SAMPLE have come last in prefixes, up to MOST_COMMON of them.
COMMON, SAMPLE, MOST_COMMON = 4, 8000, 500_000
#: Texts hashed together, in bytes, and (query, word) pairs compared together.
BLOCK_BYTES, BLOCK_PAIRS, BLOCK_ROWS = 1_000_000, 1 << 16, 4096
#: Near-dedup's fingerprints: lanes of 64 bits, bits of a band that keys a bucket, and the radius as a share of the bits beyond that expected at the similarity.
LANES, BAND_BITS, RADIUS_SLACK = 4, 24, 0.02
#: Fingerprints from which m = 2 and m = 3 parts key a bucket of the exact search.
MANY, VERY_MANY = 1 << 22, 1 << 29

_SPREAD = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, words: int) -> bytes:
    """XXH64 (big-endian) of each shingle of the lower-cased (A-Z) text; fewer words: of the whole sequence; none: nothing."""
    parts = text.lower().split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_digest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of another lane: the SplitMix64 finaliser."""
    if not lane:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(hashes: list[np.ndarray], lanes: int = 1) -> np.ndarray:
    """[text, 8 * lanes] bytes, most significant bit first; a bit is 1 if set in over half of a text's hashes."""
    out = np.zeros((len(hashes), 8 * lanes), np.uint8)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    sizes = np.array([len(hashes[i]) for i in full])
    h = np.concatenate([hashes[i] for i in full]).astype(np.uint64)
    runs = -(-sizes // 255)  # sums of up to 255 bits fit a byte
    first_run = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * within
    for lane in range(lanes):
        octets = np.ascontiguousarray(_mixed(h, lane).view(np.uint8).reshape(-1, 8).T)  # least significant first
        counts = np.empty((len(full), 8, 8), np.int64)
        for k in range(8):
            sums = np.add.reduceat(_SPREAD[octets[k]], starts).view(np.uint8).reshape(-1, 8)
            counts[:, k] = np.add.reduceat(sums.astype(np.int64), first_run, axis=0)
        bits = counts * 2 > sizes[:, None, None]
        out[full, 8 * lane : 8 * lane + 8] = np.packbits(bits[:, ::-1, ::-1].reshape(len(full), 64), axis=1)
    return out


def fingerprint_documents(docs: DataFrame, *, text: str, words: int) -> DataFrame:
    """The other columns of docs and __fp, the 64-bit fingerprint as a signed long. Repeated shingles count each time."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("__fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, pending, size = [], [], 0
            for text_bytes in batch.column(len(kept)).cast(pa.binary()):
                raw = text_bytes.as_py() or b""
                pending.append(np.frombuffer(shingle_hashes(raw, words), ">u8").astype(np.uint64))
                size += len(raw)
                if size > BLOCK_BYTES:
                    made.append(fingerprints(pending))
                    pending, size = [], 0
            made.append(fingerprints(pending))
            column = pa.array(np.concatenate(made).view(">i8").ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], column], names=[*kept, "__fp"])

    return docs.select(*kept, text).mapInArrow(run, schema)


class CarrySave:
    """Bit-sliced counters that start at 2**k - 1 - radius; `over` gets the lanes whose count passed the radius."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.k = max(1, radius.bit_length())
        start = (1 << self.k) - 1 - radius
        self.sums = [np.full(shape, (1 << 64) - 1 if start >> i & 1 else 0, np.uint64) for i in range(self.k)]
        self.pending: list[np.ndarray | None] = [None] * self.k
        self.over = np.zeros(shape, np.uint64)

    def add(self, plane: np.ndarray) -> None:
        for i in range(self.k):
            if self.pending[i] is None:
                self.pending[i] = plane
                return
            a, b = self.sums[i], self.pending[i]
            half = a ^ b
            self.sums[i], plane, self.pending[i] = half ^ plane, a & b | half & plane, None
        self.over |= plane

    def flush(self) -> None:
        for i in range(self.k):
            plane, self.pending[i] = self.pending[i], None
            for j in range(i, self.k):
                if plane is None:
                    break
                carry = self.sums[j] & plane
                self.sums[j] ^= plane
                plane = carry
            if plane is not None:
                self.over |= plane

    def keep(self, which: np.ndarray) -> None:
        self.sums = [x[which] for x in self.sums]
        self.pending = [None if x is None else x[which] for x in self.pending]
        self.over = self.over[which]


def compare(planes: np.ndarray, queries: np.ndarray, qi: np.ndarray, wi: np.ndarray, beyond: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, links) of the pairs (qi, wi) that have lanes within the radius.

    planes [bit, word]: fingerprints of 64 candidates to a word; queries [bit, query]: all ones or zeros. beyond: lanes of each pair that don't count.
    """
    counter = CarrySave(qi.shape, radius)
    counter.over |= beyond
    for b in range(len(planes)):
        counter.add(planes[b][wi] ^ queries[b][qi])
        if b % 8 == 7 and b > radius:
            alive = counter.over != np.uint64((1 << 64) - 1)
            n = np.count_nonzero(alive)
            if n < 0.75 * len(alive):
                counter.keep(alive)
                qi, wi = qi[alive], wi[alive]
                if not n:
                    break
    counter.flush()
    links = ~counter.over
    hit = links != 0
    return qi[hit], wi[hit], links[hit]


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least labels of components after linking i and j, and the numbers of the links that joined two of them: a spanning forest."""
    used, at = [], np.arange(len(i))
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label, np.concatenate([np.zeros(0, np.int64), *used])
        i, j, at = i[apart], j[apart], at[apart]
        high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        order = np.lexsort((low, high))
        best = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
        label[high[best]] = low[best]
        used.append(at[best])
        while (label[label] != label).any():
            label = label[label]


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least labels of components after linking i and j."""
    return hook(label, i, j)[0]


def link_groups(fps: np.ndarray, groups: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Row numbers of each row's least linked row, in its group."""
    return spanning_links(fps, groups, side, radius)[0]


def spanning_links(fps: np.ndarray, groups: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's least row of what links connect in its group, and links (i, j) that span it: fingerprints [row, bytes], groups ascending.
    In a group that has rows of side 1, only rows of different sides are compared: the others meet in a group of their own."""
    n = len(fps)
    first = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    sizes = np.diff(np.append(first, n))
    words = -(-sizes // 64)
    word_base = np.cumsum(words) - words
    group_of = np.repeat(np.arange(len(first)), sizes)
    lane = np.arange(n) - first[group_of] + 64 * word_base[group_of]  # every group begins a word
    total = int(words.sum())
    bits = np.unpackbits(fps, axis=1)
    spread = np.zeros((bits.shape[1], 64 * total), np.uint8)
    spread[:, lane] = bits.T
    planes = np.packbits(spread, axis=1, bitorder="little").view(np.uint64)
    row_of = np.zeros(64 * total, np.int64)
    row_of[lane] = np.arange(n)
    present, second = np.zeros(64 * total, np.uint8), np.zeros(64 * total, np.uint8)
    present[lane], second[lane] = 1, side
    absent, second = (np.packbits(x, bitorder="little").view(np.uint64) for x in (1 - present, second))
    split = np.maximum.reduceat(side, first) > 0
    label, ones_of, others_of = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start, one, ones = 0, np.uint64(1), np.uint64((1 << 64) - 1)
    work = np.cumsum((word_base + words)[group_of] - lane // 64)
    while start < n:
        end = min(n, max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + BLOCK_PAIRS)), start + 1))
        end = min(end, start + BLOCK_ROWS)
        rows = np.arange(start, end)
        g, own = group_of[rows], lane[rows]
        todo = (word_base + words)[g] - own // 64
        qi = np.repeat(np.arange(len(rows)), todo)
        wi = np.arange(len(qi)) - np.repeat(np.cumsum(todo) - todo, todo) + (own // 64)[qi]
        beyond = absent[wi]
        at_own = wi == (own // 64)[qi]
        low = (own % 64).astype(np.uint64)[qi]
        beyond = np.where(at_own, beyond | (one << low) - one | one << low, beyond)
        if split.any():
            same = np.where(side[rows][qi] > 0, second[wi], ~second[wi])
            beyond = np.where(split[g][qi], beyond | same, beyond)
        masks = np.where(bits[rows].T > 0, ones, np.uint64(0))
        q, w, links = compare(planes, masks, qi, wi, beyond, radius)
        if len(q):
            k, j = np.nonzero(np.unpackbits(links.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = rows[q[k]], row_of[64 * w[k] + j]
            label, used = hook(label, a, b)
            ones_of.append(a[used])
            others_of.append(b[used])
        start = end
    return label, np.concatenate(ones_of), np.concatenate(others_of)


def _group_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, side, node, fingerprint) arrays that hold whole groups, of sorted rows of columns (2 * group + side, node[, fp]); without fp the node is it."""
    carried: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        packed, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys = packed >> 1
        fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8) if batch.num_columns > 2 else node.astype(">i8").view(np.uint8)
        carried.append((keys, packed & 1, node, fps.reshape(len(keys), -1)))
        if carried[0][0][0] == keys[-1]:
            continue  # still one group
        whole = [np.concatenate(x) for x in zip(*carried, strict=True)]
        last = int(np.flatnonzero(whole[0][1:] != whole[0][:-1])[-1]) + 1
        yield tuple(x[:last] for x in whole)
        carried = [tuple(x[last:] for x in whole)]
    if carried:
        yield tuple(np.concatenate(x) for x in zip(*carried, strict=True))


def _whole_groups(group: np.ndarray, most: int) -> Iterator[slice]:
    """Rows of whole groups, about `most` at a time, or of one larger group."""
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    at = 0
    while at < len(group):
        k = max(int(np.searchsorted(ends, at + most, "right")) - 1, int(np.searchsorted(ends, at, "right")))
        yield slice(at, int(ends[k]))
        at = int(ends[k])


def link_buckets(nodes: DataFrame, keys: list[Column], radius: int, direct: bool = False) -> DataFrame:
    """Edges (a, b), a < b, that span the links within each bucket. nodes: __node long and __fp binary, or __node alone, itself the
    fingerprint; distinct nodes. direct: the edges are links themselves, else of what links connect."""
    held = [c for c in ("__node", "__fp") if c in nodes.columns]
    keyed = nodes.select(*held, F.explode(F.array(*keys)).alias("__key"))
    hot = keyed.groupBy("__key").count().filter(F.col("count") > TILE).select("__key", F.ceil(F.col("count") / TILE).cast("int").alias("__tiles"))
    n_hot = hot.limit(BROADCAST_BUCKETS + 1).count()
    if n_hot:
        tiled = keyed.join(F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot, "__key", "left")
        own = F.pmod(F.xxhash64("__node"), F.coalesce("__tiles", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("__tiles", F.lit(1)) - 1))
        met = tiled.withColumn("__own", own).withColumn("__other", other)
        pair = F.shiftleft(F.xxhash64("__key", F.least("__own", "__other"), F.greatest("__own", "__other")), 1)
        grouped = met.select((pair + (F.col("__own") > F.col("__other")).cast("int")).alias("__key"), *held)
    else:
        grouped = keyed.select(F.shiftleft("__key", 1).alias("__key"), *held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, node, fp in _group_runs(batches):
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            for part in _whole_groups(group, BLOCK_ROWS):  # some groups at a time, to bound the bit planes
                label, i, j = spanning_links(fp[part], group[part], side[part].astype(np.uint8), radius)
                if not direct:
                    i = np.flatnonzero(label != np.arange(len(label)))
                    j = label[i]
                if len(i):
                    a, b = node[part][i], node[part][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    # The last bit of the key is a row's side in a meeting of two tiles; tiles that share a hash are compared too, which adds no false link.
    return grouped.repartition(F.shiftright("__key", 1)).sortWithinPartitions("__key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the least node reachable. Alternates large-star and small-star
    steps, each a minimum per node and a join, until the edges stay; every round is checkpointed."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u")))
        return out.filter("a <> b").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = checkpoint(edges)
    before = mark(edges)
    while before[0]:
        edges = checkpoint(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))


def exact_keys(n: int, radius: int) -> list[Column]:
    """Bucket keys of 64-bit fingerprints __node: the bits of each choice of m of radius + m parts, as m parts of two fingerprints within
    the radius are equal. m grows with their number n, for buckets of longer keys; so do the bits used of each part."""
    m = 1 + (n > MANY) + (n > VERY_MANY)
    borders = [64 * i // (radius + m) for i in range(radius + m + 1)]
    enough = max(4, math.ceil(math.log2(max(n, 1) / 4096) / m) if n > 4096 else 0)
    keys = []
    for k, chosen in enumerate(combinations(range(radius + m), m)):
        widths = [min(enough, borders[p + 1] - borders[p]) for p in chosen]
        parts = [F.shiftrightunsigned("__node", 64 - borders[p] - w).bitwiseAND(F.lit((1 << w) - 1)) for p, w in zip(chosen, widths, strict=True)]
        shifts = [sum(widths[i + 1 :]) for i in range(m)]
        keys.append(reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(x, s) for x, s in zip(parts, shifts, strict=True)], F.lit(k << 44).cast("long")))
    return keys


def simhash_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id reachable by links of `radius` or fewer differing bits.

    Null and empty texts have no shingles, so the fingerprint zero. A row of null id is in the class of its
    fingerprint; component_id is null if no row of the class has an id, whatever the ids are otherwise. Repeated rows are repeated in
    the result, other columns are ignored; an empty table gives an empty result. All links count: buckets are exact.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    slim = checkpoint(fingerprint_documents(named, text="__text", words=words))
    nodes = checkpoint(slim.groupBy(F.col("__fp").alias("__node")).agg(F.min("doc_id").alias("__least")))
    labels = components(link_buckets(nodes.select("__node"), exact_keys(nodes.count(), radius), radius))
    labelled = nodes.join(labels, nodes["__node"] == labels["node"], "left").select("__node", "__least", F.coalesce("label", "__node").alias("__label"))
    least = labelled.groupBy("__label").agg(F.min("__least").alias("component_id"))
    found = slim.join(labelled.select("__node", "__label").join(least, "__label"), F.col("__fp") == F.col("__node"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def _set_of(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.frombuffer(shingle_hashes(text or b"", words), ">u8").astype(np.uint64))


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) that at least COMMON texts of a sample have, up to MOST_COMMON, and how many. docs: __th, __text."""
    n = docs.count()
    few = docs if n <= SAMPLE else docs.filter(F.pmod(F.xxhash64("__th"), F.lit(1 << 20)) < F.lit((SAMPLE << 20) // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(_set_of(text.as_py(), words).view(np.int64))], names=["h"])

    counts = checkpoint(few.select("__text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= COMMON))
    least, total = COMMON, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("shingles")).orderBy(F.desc("c")).collect():
        total += r["shingles"]
        if total > MOST_COMMON:
            least = r["c"] + 1
            break
    found = counts.filter(F.col("c") >= least).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def set_prefixes(docs: DataFrame, words: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """__id, __th, __set (hash of the shingle set), __n (its size), __fp (its wide fingerprint), __bits (its bitmap) and __prefix: its first
    n - ceil(n * num / den) + 1 hashes, the common ones last. Of two sets of Jaccard similarity num / den or more the prefixes share a
    hash, whatever the order."""
    added = [*(T.StructField(c, T.LongType()) for c in ("__set", "__n")), T.StructField("__fp", T.BinaryType()), T.StructField("__bits", T.BinaryType()), T.StructField("__prefix", T.ArrayType(T.LongType()))]
    schema = T.StructType([*docs.select("__id", "__th").schema.fields, *added])
    heavy, times = common

    def prefix(h: np.ndarray) -> np.ndarray:
        keep = len(h) - -(-len(h) * num // den) + 1 if len(h) else 0
        if not len(heavy):
            return h[:keep]
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        known = heavy[at] == h
        rare = h[~known]
        if len(rare) < keep:
            rest = h[known]
            rare = np.concatenate([rare, rest[np.lexsort((rest, times[at[known]]))]])
        return rare[:keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sets, held = 0, [], 0
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                sets.append(_set_of(text.as_py(), words))
                held += len(sets[-1])
                if held > BLOCK_BYTES // 8 or i == batch.num_rows - 1:
                    part, firsts = batch.slice(start, len(sets)), [prefix(h) for h in sets]
                    names = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
                    ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                    wide = pa.array([x.tobytes() for x in fingerprints(sets, LANES)], pa.binary())
                    bits = pa.array([_bitmap(h) for h in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array([*map(len, sets)], pa.int64()), wide, bits, listed], names=schema.names)
                    start, sets, held = i + 1, [], 0

    return docs.select("__id", "__th", "__text").mapInArrow(run, schema)


def _bitmap(h: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes by a power of two, BITMAP or, for larger sets, at least twice their size."""
    size = max(BITMAP, 1 << max(2 * len(h) - 1, 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(h % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _alone(x: bytes, y: bytes) -> tuple[int, int]:
    """Bits that each of two bitmaps has alone; the larger is folded to the other's size."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, size)) if len(v) > size else v for v in (a, b))
    return int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())


def not_ruled_out(pairs: DataFrame, slim: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rows of slim whose bitmaps don't rule the similarity out: each bit that one has alone is a hash that the other lacks."""
    side = lambda k: slim.select(F.col("__row").alias(k), F.col("__n").alias(f"n{k}"), F.col("__bits").alias(f"bits{k}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            alone = np.array([_alone(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)])
            most = np.minimum(n - alone[:, 0], m - alone[:, 1])
            yield batch.select([0, 1]).filter(pa.array(most * (num + den) >= (n + m) * num))

    return met.mapInArrow(run, "a long, b long")


def _share(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two ascending sets is num / den or more."""
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    few, many = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = np.count_nonzero(many[at] == few) if len(many) else 0
    return both * den >= num * (len(x) + len(y) - both)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it has up to BROADCAST_ROWS rows. df: checkpointed, a few numbers a row."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def confirmed(pairs: DataFrame, docs: DataFrame, slim: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rows of slim whose shingle sets have a Jaccard similarity of num / den or more. docs: __th, __text; pairs: checkpointed.

    The sets are made again from the texts, of which those that pairs ask for are taken and joined to the pairs, first by a, then by b.
    """
    asked = pairs.select(F.col("a").alias("__row")).union(pairs.select("b")).distinct()
    texts_of = checkpoint(slim.join(asked, "__row", "left_semi").select("__row", "__th"))
    texts = docs.select("__th", "__text").join(_small(texts_of), "__th").select("__row", "__text").dropDuplicates(["__row"])
    met = pairs.join(texts.select(F.col("__row").alias("a"), F.col("__text").alias("ta")), "a").join(texts.select(F.col("__row").alias("b"), F.col("__text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            good, names = [], [batch.column(k).to_pylist() for k in (0, 1)]
            for i, ends in enumerate(zip(*names, strict=True)):
                for k, name in enumerate(ends):
                    if name not in made:
                        made[name] = _set_of(batch.column(2 + k)[i].cast(pa.binary()).as_py(), words)
                        held += len(made[name])
                good.append(_share(made[ends[0]], made[ends[1]], num, den))
                if held > REMEMBERED:
                    made, held = {}, 0
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return checkpoint(met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def band_keys() -> list[Column]:
    """Bucket keys of wide fingerprints: whole bands of BAND_BITS bits."""
    size = BAND_BITS // 8
    return [F.conv(F.hex(F.substring("__fp", 1 + k * size, size)), 16, 10).cast("long") + F.lit(k << BAND_BITS) for k in range(8 * LANES // size)]


def _similar_enough(shared: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Whether sets of n and m hashes that share at most so many can have a similarity of num / den."""
    return shared * (num + den) >= (n + m) * num


def candidate_pairs(shared: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of sets of different labels that share a hash of their prefixes and may be similar enough. shared: __row, __n, __pos and __key of
    the prefixes' hashes that several sets have.

    At a hash of up to FEW_LABELS labels the sets meet each other, and what a pair shares is counted over such hashes. At a hash of more labels
    two sets meet only if it is the first that they share, so that a pair comes once however many frequent hashes it shares.
    """
    c = F.col
    named = shared.join(_small(checkpoint(labels)), c("__row") == c("node"), "left").select("__key", "__row", "__n", "__pos", F.coalesce("label", "__row").alias("__label"))
    rows = named.repartition("__key")  # once for both counts and the join
    per_label = rows.groupBy("__key", "__label").count().groupBy("__key").agg(F.max_by("__label", "count").alias("__main"), F.count("*").alias("__labels"))
    mixed = checkpoint(rows.join(per_label.filter("__labels > 1"), "__key"))
    apart = (c("x.__key") == c("y.__key")) & (c("x.__label") != c("y.__label"))
    once = (c("y.__label") == c("y.__main")) | (c("x.__row") < c("y.__row"))  # of two labels at a hash one isn't the main one

    def ends(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return df.filter("__label <> __main").alias("x"), df.alias("y")

    def at_most(before: Column, pos_x: Column, pos_y: Column) -> Column:
        """Hashes that a pair shares, if they share those at the positions and so many before them."""
        return before + F.least(c("x.__n") - pos_x, c("y.__n") - pos_y)

    frequent = c("__labels") > FEW_LABELS
    times = _small(checkpoint(mixed.filter(frequent).groupBy("__row").agg(F.count("*").alias("__frequent"))))
    x, y = ends(mixed.filter(~frequent).join(times, "__row", "left").fillna(0, ["__frequent"]))
    possible = _similar_enough(at_most(F.least("x.__pos", "y.__pos"), c("x.__pos"), c("y.__pos")), c("x.__n"), c("y.__n"), num, den)
    met = x.join(y, apart & once & possible)
    swap = c("x.__row") > c("y.__row")
    sides = [F.when(swap, c(f"{v}.__{k}")).otherwise(c(f"{u}.__{k}")).alias(f"{k}_{u}") for u, v in ("xy", "yx") for k in ("row", "n", "pos", "frequent")]
    grouped = met.select(*sides).groupBy(c("row_x").alias("a"), c("row_y").alias("b"), "n_x", "n_y", "frequent_x", "frequent_y").agg(F.max("pos_x").alias("pos_x"), F.max("pos_y").alias("pos_y"), F.count("*").alias("same"))
    most = c("same") - 1 + F.least("frequent_x", "frequent_y") + F.least(c("n_x") - c("pos_x"), c("n_y") - c("pos_y"))
    counted = grouped.filter(_similar_enough(most, c("n_x"), c("n_y"), num, den)).select("a", "b")

    # With each frequent hash of a set the few before it: sets that share one of those have met there.
    before = F.collect_list("__key").over(Window.partitionBy("__row").orderBy("__pos").rowsBetween(-RECENT, -1))
    listed = mixed.join(times, "__row", "left_semi").withColumn("__recent", before).filter(frequent)
    x, y = ends(listed.select("__row", "__n", "__label", "__recent", "__key", "__pos", "__main"))
    possible = _similar_enough(at_most(F.lit(0), c("x.__pos"), c("y.__pos")), c("x.__n"), c("y.__n"), num, den)
    first = F.when(possible, ~F.arrays_overlap("x.__recent", "y.__recent"))  # the cheap test first
    frequent_pairs = x.join(y, apart & once & F.coalesce(first, F.lit(False))).select(F.least("x.__row", "y.__row").alias("a"), F.greatest("x.__row", "y.__row").alias("b"))
    return counted.union(frequent_pairs).distinct()


def similar_sets(slim: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of sets of Jaccard similarity num / den or more. nodes: __row of a row of
    slim for each set.

    First the links that span those of wide fingerprints in the buckets of their bands are confirmed, which joins nearly all of a large
    group of near copies by links as many as its members. Then all pairs of different components that share a hash of their prefixes are, so
    that none is missed.
    """
    sets = slim.join(_small(nodes), "__row", "left_semi")
    alike = num / den
    radius = int(64 * LANES * (math.acos(2 * alike / (1 + alike)) / math.pi + RADIUS_SLACK))
    first = checkpoint(link_buckets(sets.select(F.col("__row").alias("__node"), "__fp"), band_keys(), radius, direct=True))
    links = confirmed(first, docs, slim, words, num, den)

    keyed = sets.select("__row", "__n", F.posexplode("__prefix").alias("__pos", "__key"))
    at_key = Window.partitionBy("__key").orderBy("__row")
    shared = checkpoint(keyed.withColumns({"before": F.lag("__row").over(at_key), "after": F.lead("__row").over(at_key)}).filter("before is not null or after is not null").drop("before", "after"))
    rest = candidate_pairs(shared, components(links), num, den).join(first, ["a", "b"], "left_anti")
    likely = checkpoint(not_ruled_out(checkpoint(rest), slim, num, den))
    return links.union(confirmed(likely, docs, slim, words, num, den))


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate class, all columns as they are.

    Linked are texts whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more, no others: candidates
    are found by bit-sliced SimHash and, where it misses them, by the prefixes of the sets, and each link is confirmed by the sets
    themselves. Classes are what links connect. The class keeps the row of its least id (nulls last), and one of repeated rows. Texts
    without words, null or empty, are one class; long texts count whole. An empty table stays empty.
    """
    docs, back = set_aside(docs)
    num, den = Fraction(str(similarity)).as_integer_ratio()
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(F.col(doc_id).alias("__id"), own.alias("__th"), F.col(text).alias("__text"))
    slim = checkpoint(set_prefixes(named, words, num, den, common_shingles(named, words)).withColumn("__row", F.monotonically_increasing_id()))
    of_set = checkpoint(slim.groupBy("__set", "__n").agg(F.min("__row").alias("__node")))
    labels = components(similar_sets(slim, of_set.select(F.col("__node").alias("__row")), named, words, num, den))
    of_set = of_set.join(labels, F.col("__node") == F.col("node"), "left").select("__set", "__n", F.coalesce("label", "__node").alias("__label"))
    rows = slim.select("__id", "__th", "__set", "__n").join(of_set, ["__set", "__n"])
    best = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__th")).alias("best")
    keepers = rows.groupBy("__label").agg(best).select(*(F.col(f"best.{c}").alias(c) for c in ("__id", "__th")))
    key = lambda i: F.xxhash64(i.isNull(), i.cast("string"))
    counted = rows.groupBy("__th", key(F.col("__id")).alias("__key")).count()
    decided = checkpoint(counted.join(keepers.select("__th", key(F.col("__id")).alias("__key"), F.lit(True).alias("__kept")), ["__th", "__key"], "left"))
    keyed = docs.withColumns({"__th": own, "__key": key(F.col(doc_id))})
    gone = _small(decided.filter("__kept is null").select("__th", "__key"))
    again = _small(decided.filter("__kept and count > 1").select("__th", "__key"))
    left = keyed.join(gone, ["__th", "__key"], "left_anti")
    once = left.join(again, ["__th", "__key"], "left_semi").dropDuplicates(["__th", "__key"])
    every = left.join(again, ["__th", "__key"], "left_anti").unionByName(once)
    return every.select(*docs.columns).withColumnsRenamed(back)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))

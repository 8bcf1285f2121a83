"""Texts to counted buckets and terms, by one Arrow pass over each batch: a text is cut, hashed and counted where it stands, and nothing is shuffled.

The functions are declared nondeterministic, as the optimiser would otherwise count twice: once for a filter that it infers from an explode.
As builtin functions these counts are nested lambdas, which Spark interprets with an object for each element; see `words` for what a word is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WORD

ENTRIES = "array<struct<bucket: bigint, weight: double>>"
TERMS = "struct<dl: bigint, terms: array<struct<term: string, tf: bigint>>>"
#: Words whose buckets a task remembers.
REMEMBERED = 1 << 18
#: Longer ones aren't remembered.
LONG = 64
#: Characters of texts, and cells of counts, that are hashed at once; messages that are digested at once.
CUT_CHARS, CELLS, DIGESTS = 1 << 22, 1 << 21, 1 << 14
_WORD = re.compile(WORD)
_OF_WORDS = np.array([re.fullmatch(WORD, chr(c)) is not None for c in range(256)])


def words(text: str | None) -> list[str]:
    """As `text.tokens`: lower-cased runs of a-z, 0-9 and apostrophes; none of a null."""
    return _WORD.findall(text.lower()) if text else []


class Buckets(dict):
    """The bucket of a word, as `text.bucket`; those met lately are remembered."""

    def __init__(self, dims: int, alias: Callable[[str], str] = lambda word: word):
        super().__init__()
        self.dims, self.alias = dims, alias

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.md5(self.alias(word).encode()).digest()[:4], "big") % self.dims
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


#: What md5 adds in each of its steps, and by how many bits it turns.
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNED = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_of_md5(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes, as a big-endian number, of the md5 of padded messages of one block each, [message, 64 bytes]."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), x) for x in _BEGIN)
    u, v = np.empty_like(a), np.empty_like(a)
    for i, (added, turned) in enumerate(zip(_ADDED, _TURNED, strict=True)):
        if i < 16:
            np.bitwise_xor(c, d, out=u)
            u &= b
            u ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=u)
            u &= d
            u ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=u)
            u ^= d
        else:
            np.invert(d, out=u)
            u |= b
            u ^= c
        u += a
        u += added
        u += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        np.left_shift(u, np.uint32(turned), out=v)
        u >>= np.uint32(32 - turned)
        u |= v
        u += b
        a, b, c, d, u = d, u, b, c, a
    return (a + _BEGIN[0]).byteswap().astype(np.int64)


def digest_buckets(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, dims: int) -> np.ndarray:
    """Buckets, as `text.bucket`, of pieces of UTF-8 bytes, of DIGESTS at a time; those that don't fit into one block of md5 are digested one by one."""
    out, place = np.zeros(len(starts), np.int64), np.arange(64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(64, np.uint8)]), 64)
    short = np.flatnonzero(lengths <= 55)
    for at in (short[i : i + DIGESTS] for i in range(0, len(short), DIGESTS)):
        n = lengths[at]
        blocks = view[starts[at]] * (place < n[:, None])
        blocks[np.arange(len(at)), n] = 128
        blocks.view("<u4")[:, 14] = n * 8
        out[at] = _first_of_md5(blocks)
    for i in np.flatnonzero(lengths > 55):
        out[i] = int.from_bytes(hashlib.md5(text[starts[i] : starts[i] + lengths[i]].tobytes()).digest()[:4], "big")
    return out % dims


def _first_met(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal values, and where each number is met first."""
    number = codes.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.zeros(number.max(initial=-1) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


def _words_in_a_row(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as UTF-8 bytes, each with a "_" behind it; where each begins and ends, and the place of its text."""
    low = [t.lower().encode() if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join([b"", *low, b""]), np.uint8)
    inside = _OF_WORDS[raw]
    after = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # behind each word
    row = np.searchsorted(np.cumsum([len(x) + 1 for x in low]), after)
    kept = inside.copy()
    kept[after] = True
    text = np.where(inside, raw, ord("_"))[kept].astype(np.uint8)
    ends = np.flatnonzero(text == ord("_"))
    return text, np.concatenate([[0], ends[:-1] + 1])[: len(ends)], ends, row


def _strings(text: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words, each with its "_": no copy."""
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int64)), pa.py_buffer(text))


def hashed_counts(texts: list[str | None], dims: int, bigrams: bool) -> np.ndarray:
    """[text, bucket]: a word counts 1 and a pair of neighbours, joined by "_", 0.5. Each distinct word or pair is digested once for all texts."""
    text, starts, ends, row = _words_in_a_row(texts)
    number, first = _first_met(_strings(text, ends))
    out = 2.0 * np.bincount(row * dims + digest_buckets(text, starts[first], (ends - starts)[first], dims)[number], minlength=len(texts) * dims)
    if bigrams:
        pair = np.flatnonzero(row[1:] == row[:-1])
        same, first = _first_met(pa.array(number[pair].astype(np.int64) * (number.max(initial=0) + 1) + number[pair + 1]))
        at = pair[first]
        out += np.bincount(row[pair] * dims + digest_buckets(text, starts[at], ends[at + 1] - starts[at], dims)[same], minlength=len(texts) * dims)
    return out.reshape(len(texts), dims) / 2


def hashed_weights(texts: list[str | None], dims: int, bigrams: bool, logarithmic: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) by row and bucket, of unit length: a bucket weighs 1 + ln(count), or the count."""
    counts = hashed_counts(texts, dims, bigrams)
    row, bucket = np.nonzero(counts)
    n = counts[row, bucket]
    weight = 1 + np.log(n) if logarithmic else n
    return row, bucket, weight / np.sqrt(np.bincount(row, weight * weight, len(texts)))[row]


def hashed_matrix(texts: list[str | None], dims: int, bigrams: bool = True, logarithmic: bool = True) -> np.ndarray:
    """[text, bucket]: the weights, 0 elsewhere."""
    row, bucket, weight = hashed_weights(texts, dims, bigrams, logarithmic)
    out = np.zeros((len(texts), dims))
    out[row, bucket] = weight
    return out


def _lists(rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Rows of (buckets, weights) as lists of structs."""
    buckets, weights, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [0]
    for b, w in rows:
        buckets.append(b)
        weights.append(w)
        ends.append(ends[-1] + len(b))
    entries = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets), pa.int64()), pa.array(np.concatenate(weights), pa.float64())], ["bucket", "weight"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def _unit(counted: tuple[np.ndarray, np.ndarray], logarithmic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights of counts, at length one."""
    buckets, n = counted
    weights = 1 + np.log(n) if logarithmic else n
    return buckets, weights / np.sqrt((weights * weights).sum()) if len(weights) else weights


def _slices(texts: pa.Array, most: int) -> Iterator[list[str | None]]:
    """A batch's texts, about CUT_CHARS of them and `most` rows at a time; an empty slice of an empty batch."""
    held, chars = [], 0
    for t in texts:
        held.append(t.as_py())
        chars += len(held[-1] or "")
        if chars >= CUT_CHARS or len(held) >= most:
            yield held
            held, chars = [], 0
    if held or not len(texts):
        yield held


def _lists_by_row(row: np.ndarray, rows: int, fields: list[tuple[str, pa.Array]]) -> pa.Array:
    """Lists of structs of what is ordered by row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([x for _, x in fields], [name for name, _ in fields]))


def hashed(text: Column, dims: int, bigrams: bool, logarithmic: bool) -> Column:
    """ENTRIES of unit length, by bucket: a word counts 1 and a pair of neighbours, joined by "_", 0.5; a bucket weighs 1 + ln(count), or the count."""

    def lists(held: list[str | None]) -> pa.Array:
        row, bucket, weight = hashed_weights(held, dims, bigrams, logarithmic)
        return _lists_by_row(row, len(held), [("bucket", pa.array(bucket, pa.int64())), ("weight", pa.array(weight, pa.float64()))])

    @F.arrow_udf(ENTRIES)
    def entries(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([lists(held) for held in _slices(texts, max(1, CELLS // dims))])

    return entries.asNondeterministic()(text)


def weighed(text: Column, dims: int, alias: Callable[[str], str], weight: Callable[[str], float]) -> Column:
    """ENTRIES of unit length, by bucket, where a word counts weight(word) in the bucket of alias(word)."""
    known = Buckets(dims, alias)  # a task's own

    def count(t: str | None) -> tuple[np.ndarray, np.ndarray]:
        w = words(t)
        buckets, place = np.unique(np.array([known[x] for x in w], np.int64), return_inverse=True)
        return buckets, np.bincount(place, [weight(x) for x in w], len(buckets))

    @F.arrow_udf(ENTRIES)
    def entries(texts: pa.Array) -> pa.Array:
        return _lists(_unit(count(t.as_py()), False) for t in texts)

    return entries.asNondeterministic()(text)


def counted_terms(text: Column) -> Column:
    """TERMS: how many words a text has, and each of them with its count, by word."""

    def count(held: list[str | None]) -> pa.Array:
        text, _, ends, row = _words_in_a_row(held)
        words = _strings(text, ends).dictionary_encode()
        names = pc.utf8_slice_codeunits(words.dictionary, 0, -1).cast(pa.string())
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes, times = np.unique(row * len(order) + place[words.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        of, at = np.divmod(codes, max(1, len(order)))
        each = _lists_by_row(of, len(held), [("term", names.take(pa.array(order[at]))), ("tf", pa.array(times, pa.int64()))])
        return pa.StructArray.from_arrays([pa.array(np.bincount(row, minlength=len(held)), pa.int64()), each], ["dl", "terms"])

    @F.arrow_udf(TERMS)
    def terms(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([count(held) for held in _slices(texts, CELLS)])

    return terms.asNondeterministic()(text)

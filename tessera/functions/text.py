"""Text expressions shared by the operators; all are Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9']+"
CHARS_PER_TOKEN = 4


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value made once, however often f names it: the optimiser may put a column's expression wherever it is named, also in lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def long_words(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: F.length(t) > 3)


def token_estimate(text: Column) -> Column:
    """A token for every four characters, one at least; an empty text has none."""
    n = F.length(text).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n / CHARS_PER_TOKEN)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def bucket(token: Column, dims: int) -> Column:
    """The first four bytes of the md5, modulo dims."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null components of unequal arrays don't count."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def stepped_percentile_rank(n: Column, q: float) -> Column:
    """The 1-based rank min(n, floor(q n) + 1) of a quantile."""
    return F.least(n, F.floor(n * q) + 1)


def running(values: Column, block: int = 512) -> Column:
    """Sums of an array<long> before each of its elements, in blocks, so that the cost stays near linear."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def before(x: Column) -> Column:
        start = F.struct(zero.alias("sum"), none.alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))["out"]

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block)), lambda i: F.slice(values, i, block))
    total = lambda x: F.aggregate(x, zero, lambda acc, v: acc + v)
    placed = lambda parts, bases: F.zip_with(parts, bases, lambda p, base: F.transform(before(p), lambda v: v + base))
    return let(blocks, lambda parts: F.flatten(let(before(F.transform(parts, total)), lambda bases: placed(parts, bases))))

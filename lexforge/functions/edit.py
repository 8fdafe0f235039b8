"""Edit distances over arrays of tokens in built-in expressions.

Each distinct token of a pair becomes one code point of its own, so that Spark's own levenshtein counts tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.text import graphemes, let

#: The first code point that stands for a token, and how many distinct tokens a pair may have.
FIRST, MOST = 0xE000, 1_000_000


def encoded(tokens: Column, alphabet: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.lit(FIRST) + F.array_position(alphabet, x).cast("int")), 8, "0")), "UTF-32")), "")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays; a pair of more than MOST distinct tokens raises."""

    def of(p: Column) -> Column:
        distance = lambda al: F.when(F.size(al) > MOST, F.raise_error(F.lit("too many distinct tokens")).cast("int")).otherwise(F.levenshtein(encoded(p["a"], al), encoded(p["b"], al)))
        return F.when(p["a"] == p["b"], 0).otherwise(let(F.array_distinct(F.concat(p["a"], p["b"])), distance))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def grapheme_distance(a: Column, b: Column) -> Column:
    return token_distance(graphemes(a), graphemes(b))


def grapheme_ned(a: Column, b: Column) -> Column:
    """Distance over the longer side's graphemes; 0 if both are empty."""
    sides = F.struct(graphemes(a).alias("a"), graphemes(b).alias("b"))
    return let(sides, lambda p: token_distance(p["a"], p["b"]) / F.greatest(F.size(p["a"]), F.size(p["b"]), F.lit(1)))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_distance(a: Column, b: Column) -> Column:
    return token_distance(words(a), words(b))


def order_distance(seq: Column) -> Column:
    """Read-order edit of a sequence of places: its distance from the sorted one, over its length."""
    s = F.transform(seq, lambda x: x.cast("string"))
    return F.when(F.size(seq) > 0, token_distance(s, F.transform(F.array_sort(seq), lambda x: x.cast("string"))) / F.size(seq)).otherwise(F.lit(0.0))


def window_ned(short: Column, long: Column) -> Column:
    """The least distance share of `short` to any window of its length in `long`, by code points; null if `long` is shorter."""
    n = F.length(short)
    at = F.sequence(F.lit(1), F.length(long) - n + 1)
    return F.when((n > 0) & (F.length(long) >= n), F.array_min(F.transform(at, lambda i: F.levenshtein(F.substring(long, i, n), short))) / n)

"""Keyed permutations of short values as DataFrame expressions.

A value is a list of symbols, each with a radix: a digit counts to ten, a letter
through its alphabet, a fixed character has radix one.  A form is a list of
radices (and a tweak), and :func:`permuted` is a permutation of all values of
its form without a fixed point: an unbalanced Feistel network E whose halves are
added symbol by symbol, a step T that moves one symbol, and the network undone,
i.e. the conjugate of T by E.  T leaves no value in place, so neither does its
conjugate.  Two values of a form never share an image, whatever the key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _number(hashed: Column, at: Column) -> Column:
    """Sixteen bits of a hash, by the place of a symbol."""
    return F.conv(F.substr(hashed, at % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _text(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda x: x.cast("string")), ",")


def _moved(half: Column, radices: Column, sign: Column, hashed: Column) -> Column:
    """A half with a number of the hash added to (or taken from) each symbol."""
    let = F.transform(F.array(hashed), lambda h: F.transform(half, lambda x, i: F.pmod(x + sign * _number(h, i), F.get(radices, i)).cast("int")))
    return F.get(let, F.lit(0))


def permuted(symbols: Column, radices: Column, tweak: Column, key: str) -> Column:
    """The image of ``symbols`` (an array of int), all of radix one: unchanged.

    ``radices`` and ``tweak`` must be the same for a value and its image.
    """
    n = F.size(symbols)
    cut = F.floor(n / 2).cast("int")
    left, right = F.slice(radices, F.lit(1), cut), F.slice(radices, cut + 1, n - cut)

    def network(state: Column, i: Column, sign: Column) -> Column:
        a, b = state["a"], state["b"]
        hashed = lambda other: _hash(key, tweak, i.cast("string"), _text(other))
        even = F.struct(_moved(a, left, sign, hashed(b)).alias("a"), b.alias("b"))
        odd = F.struct(a.alias("a"), _moved(b, right, sign, hashed(a)).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    halves = lambda x: F.struct(F.slice(x, F.lit(1), cut).alias("a"), F.slice(x, cut + 1, n - cut).alias("b"))
    there = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves(symbols), lambda s, i: network(s, i, F.lit(1)), lambda s: F.concat(s["a"], s["b"]))
    # The place of the last symbol that can change.
    last = F.aggregate(radices, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last")), lambda s, r: F.struct((s["at"] + 1).alias("at"), F.when(r > 1, s["at"]).otherwise(s["last"]).alias("last")), lambda s: s["last"])

    def step(x: Column, p: Column) -> Column:
        radix = F.get(radices, p)
        rest = _hash(key, tweak, F.lit("step"), _text(F.transform(x, lambda y, i: F.when(i == p, 0).otherwise(y))))
        return F.transform(x, lambda y, i: F.when(i == p, F.pmod(y + 1 + F.pmod(_number(rest, F.lit(0)), radix - 1), radix)).otherwise(y).cast("int"))

    moved = F.get(F.transform(F.array(F.struct(there.alias("x"), last.alias("p"))), lambda s: step(s["x"], s["p"])), F.lit(0))
    back = F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), halves(moved), lambda s, i: network(s, i, F.lit(-1)), lambda s: F.concat(s["a"], s["b"]))
    return F.when(last < 0, symbols).otherwise(back)

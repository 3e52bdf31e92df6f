"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row.

    A column that is named inside a lambda is otherwise computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def ts_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def second_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def half_up(value: Column, digits: int) -> Column:
    """Round half up through decimal(18,3), so that text does not depend on binary noise."""
    return F.round(value.cast("decimal(18,3)"), digits)


def num1(value: Column) -> Column:
    """One decimal, as text."""
    return half_up(value, 1).cast("string")


def num2(value: Column) -> Column:
    return F.round(value.cast("decimal(18,9)"), 2).cast("string")


def hash_number(*parts: Column) -> Column:
    """First 32 bits of an md5 digest as a bigint: the same number on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


# Up to this mean a Poisson count comes from its cumulative probabilities, above it from a normal number.
POISSON_EXACT = 6


def poisson_steps(mean: int) -> list[float]:
    """Cumulative probabilities of a Poisson count, until less than 2**-33 is left."""
    p, total, out = math.exp(-mean), 0.0, []
    while 1 - total > 2.0**-33:
        total += p
        out.append(total)
        p *= mean / len(out)
    return out


# Fixed values of the draw generator: a prime for which x**5 is a permutation, and two strides.
DRAW_PRIME = 2_147_483_647
DRAW_STRIDES = (1_103_515_245, 1_013_904_223)


def key_numbers(key: Column) -> list[Column]:
    """Three numbers below DRAW_PRIME from the digest of a text; the first is not 0."""
    digest = F.md5(key)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return [part(1) % (DRAW_PRIME - 1) + 1, part(9) % DRAW_PRIME, part(17) % DRAW_PRIME]


def poisson_count(mean: Column, u: Column, v: Column) -> Column:
    """A Poisson count of a whole-numbered mean from two uniform numbers.

    A small mean uses the inverse of the distribution, a large one a normal number with the first skewness
    correction.
    """
    out = F.lit(None).cast("bigint")
    for c in range(POISSON_EXACT, 0, -1):
        passed = sum(((u >= F.lit(x)).cast("int") for x in poisson_steps(c)), F.lit(0))
        out = F.when(mean == c, passed.cast("bigint")).otherwise(out)
    z = F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)
    large = F.floor(mean + F.sqrt(mean.cast("double")) * z + (z * z - 1.0) / 6.0 + 0.5)
    return F.when(mean <= POISSON_EXACT, out).otherwise(F.greatest(F.lit(0), large).cast("bigint"))


def hash_order(seed: str | int, key: Column) -> Column:
    """Sort key that stands in for a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def map_text(col: Column) -> Column:
    """A map<string,string> as `k=v` pairs in key order (for comparison and display)."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_keys(col)),
            lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(col, k), F.lit("null"))),
        ),
        "|",
    )

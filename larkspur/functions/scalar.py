"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The rounding boundary sits just beside the exact half, so decimal ties do not hang on last-bit noise.
ROUND_SHIFT = 0.0003719


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, the same in every engine (twin: ``r6``)."""
    scale = float(10**digits)
    return F.rint(col(c).cast("double") * F.lit(scale) + F.lit(ROUND_SHIFT)) / F.lit(scale) + F.lit(0.0)


def flag(cond: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as doubles, NULL where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def bins(value: Column | str, edges: list[float], labels: list, outside=None) -> Column:
    """Right-closed bins ``(e[i], e[i+1]]``; values outside the edges are NULL."""
    v = col(value)
    out = F.when(v <= edges[0], F.lit(outside))
    for hi, label in zip(edges[1:], labels):
        out = out.when(v <= hi, F.lit(label))
    return out.otherwise(F.lit(outside))


def ladder(value: Column | str, steps: list[tuple[float, str]], default: str) -> Column:
    """First label whose lower limit the value reaches, testing the limits in the given order."""
    v = col(value)
    out = None
    for limit, label in steps:
        out = F.when(v >= limit, label) if out is None else out.when(v >= limit, label)
    return out.otherwise(default)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km on a sphere of radius 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: A Mersenne prime: products of two residues stay below 2**62
MIX_PRIME = 2_147_483_647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    A filter computes a repeated subexpression every time, and a method that grows with the repeats is no longer compiled.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def mix_hash(key: Column | str, seed: Column | int = 0) -> Column:
    """Uniform [0, 1) number from an integer key and a seed, in plain modular arithmetic over the key's low 62 bits.

    Any SQL engine reproduces it (twin: ``mix``), and it is stable under repartitioning and retries.
    """
    m, mask = F.lit(MIX_PRIME).cast("bigint"), F.lit(MIX_PRIME).cast("bigint")
    s = F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint")

    def of_key(k: Column) -> Column:
        low, high = k.bitwiseAND(mask), F.shiftright(k, 31).bitwiseAND(mask)

        def of_a(a: Column) -> Column:
            b = (a * a + 31 * a + high * 127773) % m
            return let((b * 69621 + a * (s + 7)) % m, lambda c: (c * c + 8191 * c + a) % m)

        return let((low * 48271 + high * 69621 + s * 16807 + 1) % m, of_a)

    return let(col(key).cast("bigint"), of_key).cast("double") / F.lit(float(MIX_PRIME))


# Cumulative Poisson(1) probabilities
POISSON1 = [0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626, 0.99634015317265634, 0.99940581518241833, 0.99991675885071198, 0.99998975080332532]


def poisson1(u: Column) -> Column:
    """Poisson(1) count from a uniform number: the bootstrap weight of a row (plain comparisons)."""
    def count(v: Column) -> Column:
        total = F.lit(0)
        for p in POISSON1:
            total = total + (v >= F.lit(p)).cast("int")
        return total

    return let(u, count)

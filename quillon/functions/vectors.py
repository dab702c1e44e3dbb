"""Vector checks and arithmetic as column expressions, evaluated in coordinate order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.spec import LEAST_NORM, MAX_NORM

INFINITE = float("inf")


def bad_coordinate(v: Column) -> Column:
    """Position, from 0, of the first null, NaN or infinite coordinate; -1 if there is none; null for a null vector."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INFINITE))
    return (F.array_position(F.transform(v, lambda x: F.coalesce(bad(x), F.lit(True))), True) - 1).cast("long")


def norm(v: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, length: Column | None = None) -> Column:
    """The direction as floats, that of a vector too short to have one null."""
    n = norm(v) if length is None else length
    return F.when(n >= F.lit(LEAST_NORM), F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def unit_exact(v: Column, length: Column | None = None) -> Column:
    """The direction as doubles, null for the zero vector only."""
    n = norm(v) if length is None else length
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def fault(v: Column, dim: int) -> Column:
    """Why a vector cannot be stored: ``null``, ``dimension``, ``non_finite``, ``above`` (too long for the stored
    length), ``below`` (too short for a direction); null if it can."""
    n = norm(v)
    return (
        F.when(v.isNull(), "null")
        .when(F.size(v) != dim, "dimension")
        .when(bad_coordinate(v) >= 0, "non_finite")
        .when(n > F.lit(MAX_NORM), "above")
        .when(n < F.lit(LEAST_NORM), "below")
    )


def magnitude_units(bits: Column) -> Column:
    """A half-precision number, given by its bits, as a multiple of 2^-24."""
    exponent, fraction = F.shiftright(bits, 10), bits.bitwiseAND(1023).cast("long")
    return F.when(exponent == 0, fraction).otherwise((fraction + 1024) * F.pow(F.lit(2.0), (exponent - 1).cast("double")).cast("long"))


def hadamard_row(v: Column, i: Column, n: int) -> Column:
    """Coordinate ``i`` of the orthonormal Hadamard transform, from its definition."""
    signed = F.transform(v, lambda x, j: x.cast("double") * (1 - 2 * (F.bit_count(i.cast("int").bitwiseAND(j)) % 2)))
    return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / F.sqrt(F.lit(float(n)))


def pack_nibbles(codes: Column) -> Column:
    """Two codes a byte value, the even one low."""
    return F.transform(F.sequence(F.lit(0), F.expr("int(-1)") + F.shiftright(F.size(codes), 1)), lambda i: (codes[(2 * i).cast("int")] + 16 * codes[(2 * i + 1).cast("int")]).cast("int"))

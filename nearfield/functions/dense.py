"""Dense and half-precision vectors: distances, arithmetic, shape and comparison, as Catalyst-visible expressions.

Sums run in double over the elements in order; ``float32=True`` accumulates in single precision instead. Every function
of a null is null. Vectors of different length are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import VECTOR_MAX_DIM, col, fail_if

Arg = Column | str


def _same(a: Column, b: Column, body: Column, kind: str = "vector") -> Column:
    message = F.format_string(f"different {kind} dimensions %d and %d", F.size(a), F.size(b))
    return fail_if(F.size(a) != F.size(b), message, body)


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column], float32: bool = False) -> Column:
    kind = "float" if float32 else "double"
    terms = F.zip_with(a, b, lambda x, y: f(x.cast(kind), y.cast(kind)).cast(kind))
    return F.aggregate(terms, F.lit(0.0).cast(kind), lambda s, x: (s + x).cast(kind)).cast("double")


def l2_squared_distance(a: Arg, b: Arg, float32: bool = False) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, _sum(a, b, lambda x, y: (x - y) * (x - y), float32))


def l2_distance(a: Arg, b: Arg, float32: bool = False) -> Column:
    return F.sqrt(l2_squared_distance(a, b, float32))


def inner_product(a: Arg, b: Arg, float32: bool = False) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, _sum(a, b, lambda x, y: x * y, float32))


def negative_inner_product(a: Arg, b: Arg, float32: bool = False) -> Column:
    return -inner_product(a, b, float32)


def l1_distance(a: Arg, b: Arg, float32: bool = False) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, _sum(a, b, lambda x, y: F.abs(x - y), float32))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def cosine_distance(a: Arg, b: Arg, float32: bool = False) -> Column:
    """1 - cosine similarity; NaN if a vector is zero."""
    a, b = col(a), col(b)
    square = lambda x, _: x * x
    norms = _sum(a, a, square, float32) * _sum(b, b, square, float32)
    ratio = F.when(norms == 0, F.lit(math.nan)).otherwise(
        1 - _clamp(_sum(a, b, lambda x, y: x * y, float32) / F.sqrt(norms))
    )
    return _same(a, b, F.when(a.isNotNull() & b.isNotNull(), ratio))


def spherical_distance(a: Arg, b: Arg) -> Column:
    """Angle of two unit vectors as a share of pi."""
    return F.acos(_clamp(inner_product(a, b))) / math.pi


def vector_dims(a: Arg) -> Column:
    a = col(a)
    return F.when(a.isNotNull(), F.size(a))


def vector_norm(a: Arg) -> Column:
    a = col(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _finite(v: Column, kind: str = "vector") -> Column:
    return fail_if(F.exists(v, lambda x: F.abs(x) == float("inf")), "value out of range: overflow", v)


def scaled_by(values: Column, norm: Column) -> Column:
    """The elements over ``norm`` (zeros if it is zero); the norm is computed once a row and bound to no lambda variable."""
    unit = lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float")
    return F.zip_with(values, F.array_repeat(norm, F.size(values)), unit)


def l2_normalize(a: Arg, half: bool = False) -> Column:
    a = col(a)
    scaled = scaled_by(a, vector_norm(a))
    return _rounded(_finite(scaled), half)


def binary_quantize(a: Arg) -> Column:
    """'1' for each element above zero, else '0'."""
    return F.array_join(F.transform(col(a), lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def subvector(a: Arg, start: int | Column, count: int | Column) -> Column:
    """The elements whose places (from 1) lie in the interval of ``count`` places from ``start``; none is an error."""
    a = col(a)
    start, count = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (start, count))
    low = F.greatest(start, F.lit(1).cast("long"))
    high = F.least(start + count - 1, F.size(a).cast("long"))
    inside = F.slice(a, F.least(low, F.size(a).cast("long") + 1).cast("int"), F.greatest(high - low + 1, F.lit(0).cast("long")).cast("int"))
    return fail_if(high < low, "vector must have at least 1 dimension", inside)


def _elementwise(a: Column, b: Column, f: Callable[[Column, Column], Column], half: bool) -> Column:
    return _rounded(_finite(_same(a, b, F.zip_with(a, b, lambda x, y: f(x, y).cast("float")))), half)


def vector_add(a: Arg, b: Arg, half: bool = False) -> Column:
    return _elementwise(col(a), col(b), lambda x, y: x + y, half)


def vector_sub(a: Arg, b: Arg, half: bool = False) -> Column:
    return _elementwise(col(a), col(b), lambda x, y: x - y, half)


def vector_mul(a: Arg, b: Arg, half: bool = False) -> Column:
    """Element-wise product; a product of non-zero elements that becomes zero is an error."""
    a, b = col(a), col(b)
    out = _elementwise(a, b, lambda x, y: x * y, half)
    lost = F.exists(F.arrays_zip(a.alias("x"), b.alias("y"), out.alias("z")), lambda r: (r["z"] == 0) & (r["x"] != 0) & (r["y"] != 0))
    return fail_if(lost, "value out of range: underflow", out)


def vector_concat(a: Arg, b: Arg) -> Column:
    a, b = col(a), col(b)
    message = f"vector cannot have more than {VECTOR_MAX_DIM} dimensions"
    return fail_if(F.size(a) + F.size(b) > VECTOR_MAX_DIM, message, F.concat(a, b))


def vector_cmp(a: Arg, b: Arg) -> Column:
    """-1, 0 or 1: elements in order, then the shorter vector first."""
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def vector_lt(a: Arg, b: Arg) -> Column:
    return col(a) < col(b)


def vector_le(a: Arg, b: Arg) -> Column:
    return col(a) <= col(b)


def vector_eq(a: Arg, b: Arg) -> Column:
    return col(a) == col(b)


def vector_ne(a: Arg, b: Arg) -> Column:
    return col(a) != col(b)


def vector_ge(a: Arg, b: Arg) -> Column:
    return col(a) >= col(b)


def vector_gt(a: Arg, b: Arg) -> Column:
    return col(a) > col(b)


def half_element(x: Column) -> Column:
    """A number rounded to half precision (ties to even), as float; an error beyond its range.

    Adding and taking away the power of two whose last place is the half's rounds in IEEE arithmetic. (No lambda variable is
    bound in here: Python functions over nested ones cannot be planned.)
    """
    d = x.cast("double")
    size = F.when(F.abs(d) < 65520, F.abs(d)).otherwise(F.lit(0.0))
    exponent = F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))).cast("double")
    unit = F.pow(F.lit(2.0), F.greatest(F.when(size > 0, exponent).otherwise(F.lit(-14.0)), F.lit(-14.0)) + 42)
    rounded = F.signum(d) * ((size + unit) - unit)
    rounded = F.when(F.isnan(d) | (F.abs(d) == float("inf")), d).otherwise(rounded)
    over = (F.abs(d) >= 65520) & (F.abs(d) != float("inf")) & ~F.isnan(d)
    return fail_if(over, F.format_string('"%s" is out of range for type halfvec', d.cast("string")), rounded.cast("float"))


def to_half(a: Arg) -> Column:
    return F.transform(col(a), half_element)


def _rounded(v: Column, half: bool) -> Column:
    if not half:
        return v
    over = F.exists(v, lambda x: F.abs(x) >= 65520)
    return fail_if(over, "value out of range: overflow", to_half(v))



"""Sparse vectors ``struct<dim, indices, values>``: indices from 0, ascending, no stored zeros."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import SPARSE_DDL, SPARSE_MAX_NNZ, VECTOR_MAX_DIM, bound, col, fail_if
from .dense import scaled_by, to_half

Arg = Column | str


def sparse(dim: Column | int, indices: Column, values: Column) -> Column:
    dim = F.lit(dim) if isinstance(dim, int) else dim
    made = F.struct(dim.cast("int").alias("dim"), indices.cast("array<int>").alias("indices"), values.cast("array<float>").alias("values"))
    return made.cast(SPARSE_DDL)


def _both(a: Arg, b: Arg, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of two vectors that are computed once a row; null if one is."""
    of = lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), body(p["a"], p["b"]))
    return bound(F.struct(col(a).alias("a"), col(b).alias("b")), of)


def _same(a: Arg, b: Arg, body: Callable[[Column, Column], Column]) -> Column:
    def checked(a: Column, b: Column) -> Column:
        message = F.format_string("different sparsevec dimensions %d and %d", a["dim"], b["dim"])
        return fail_if(a["dim"] != b["dim"], message, body(a, b))

    return _both(a, b, checked)


def _map(v: Column) -> Column:
    return F.map_from_arrays(v["indices"], v["values"])


def _pairs(a: Column, b: Column) -> Column:
    """(index, element of a, element of b) over the stored indices of both, in order; absent elements are zero."""
    zero = F.lit(0.0).cast("float")
    both = F.map_zip_with(_map(a), _map(b), lambda k, x, y: F.struct(F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y")))
    entry = lambda e: F.struct(e["key"].alias("i"), e["value"]["x"].alias("x"), e["value"]["y"].alias("y"))
    return F.transform(F.array_sort(F.map_entries(both)), entry)


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(_pairs(a, b), F.lit(0.0), lambda s, p: s + f(p["x"].cast("double"), p["y"].cast("double")))


def l2_squared_distance(a: Arg, b: Arg) -> Column:
    return _same(a, b, lambda a, b: _sum(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Arg, b: Arg) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a: Arg, b: Arg) -> Column:
    return _same(a, b, lambda a, b: _sum(a, b, lambda x, y: x * y))


def negative_inner_product(a: Arg, b: Arg) -> Column:
    return -inner_product(a, b)


def l1_distance(a: Arg, b: Arg) -> Column:
    return _same(a, b, lambda a, b: _sum(a, b, lambda x, y: F.abs(x - y)))


def _squares(v: Column) -> Column:
    return F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine_distance(a: Arg, b: Arg) -> Column:
    def body(a: Column, b: Column) -> Column:
        cos = lambda norms: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _sum(a, b, lambda x, y: x * y) / F.sqrt(norms)))
        return bound(_squares(a) * _squares(b), lambda norms: F.when(norms == 0, F.lit(math.nan)).otherwise(1 - cos(norms)))

    return _same(a, b, body)


def l2_norm(a: Arg) -> Column:
    return F.sqrt(_squares(col(a)))


def _without_zeros(dim: Column, indices: Column, values: Column) -> Column:
    kept = F.filter(F.arrays_zip(indices.alias("i"), values.alias("x")), lambda p: p["x"] != 0)
    return sparse(dim, F.transform(kept, lambda p: p["i"]), F.transform(kept, lambda p: p["x"]))


def l2_normalize(a: Arg) -> Column:
    """Unit length; entries that underflow to zero are dropped."""
    a = col(a)
    scaled = scaled_by(a["values"], l2_norm(a))
    return F.when(a.isNotNull(), _without_zeros(a["dim"], a["indices"], scaled))


def sparsevec_cmp(a: Arg, b: Arg) -> Column:
    """-1, 0 or 1: the first element that differs decides, absent ones being zero, within the shorter dimension."""

    def body(a: Column, b: Column) -> Column:
        least = F.least(a["dim"], b["dim"])
        unequal = F.filter(_pairs(a, b), lambda p: (p["x"] != p["y"]) & (p["i"] < least))
        by_dim = F.when(a["dim"] < b["dim"], -1).when(a["dim"] > b["dim"], 1).otherwise(0)
        return F.coalesce(F.get(F.transform(unequal, lambda p: F.when(p["x"] < p["y"], -1).otherwise(1)), F.lit(0)), by_dim)

    return _both(a, b, body)


def sparsevec_lt(a: Arg, b: Arg) -> Column:
    return sparsevec_cmp(a, b) < 0


def sparsevec_le(a: Arg, b: Arg) -> Column:
    return sparsevec_cmp(a, b) <= 0


def sparsevec_eq(a: Arg, b: Arg) -> Column:
    return sparsevec_cmp(a, b) == 0


def sparsevec_ne(a: Arg, b: Arg) -> Column:
    return sparsevec_cmp(a, b) != 0


def sparsevec_ge(a: Arg, b: Arg) -> Column:
    return sparsevec_cmp(a, b) >= 0


def sparsevec_gt(a: Arg, b: Arg) -> Column:
    return sparsevec_cmp(a, b) > 0


def sort_key(a: Arg) -> Column:
    """A key of ascending order: the stored (index, sign, value) entries so arranged that arrays compare as vectors do.

    A positive entry makes a vector greater the earlier its index, a negative one less.
    """
    entry = lambda i, x: F.array(
        F.when(x > 0, F.lit(2.0)).otherwise(F.lit(0.0)), F.when(x > 0, -i.cast("double")).otherwise(i.cast("double")), x.cast("double")
    )
    body = lambda a: F.flatten(F.zip_with(a["indices"], a["values"], entry))
    return bound(a, lambda a: F.struct(F.concat(body(a), F.array(F.lit(1.0))).alias("k"), a["dim"].alias("d")))


def from_dense(a: Arg) -> Column:
    """(Binds no lambda variable: Python functions over nested ones cannot be planned.)"""
    a = col(a)
    made = _without_zeros(F.size(a), F.sequence(F.lit(0), F.size(a) - 1), a)
    stored = F.size(F.filter(a, lambda x: x != 0))
    over = stored > SPARSE_MAX_NNZ
    return F.when(a.isNotNull(), fail_if(over, f"sparsevec cannot have more than {SPARSE_MAX_NNZ} non-zero elements", made))


def to_dense(a: Arg) -> Column:
    def body(a: Column) -> Column:
        zeros = F.map_from_arrays(F.sequence(F.lit(0), a["dim"] - 1), F.array_repeat(F.lit(0.0).cast("float"), a["dim"]))
        out = F.map_values(F.map_zip_with(zeros, _map(a), lambda i, zero, x: F.coalesce(x, zero)))
        return fail_if(a["dim"] > VECTOR_MAX_DIM, f"vector cannot have more than {VECTOR_MAX_DIM} dimensions", out)

    return bound(a, body)


def to_half_dense(a: Arg) -> Column:
    return to_half(to_dense(a))


def with_dim(a: Arg, dim: int) -> Column:
    """``a``, or an error if it has another dimension."""
    a = col(a)
    return fail_if(a["dim"] != dim, F.format_string(f"expected {dim} dimensions, not %d", a["dim"]), a)

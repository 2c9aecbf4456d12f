"""Casts between arrays, vector, halfvec and sparsevec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import HALF_MAX_DIM, check_vector, col, fail_if
from . import dense, sparse

Arg = Column | str


def _plain(a: Arg, kind: str) -> Column:
    """An array of numbers of any type as floats; no nulls allowed. Too large a number becomes infinite, and so an error."""
    a = col(a)
    narrow = F.transform(a, lambda x: x.cast("double").cast("float"))
    return fail_if(F.exists(a, lambda x: x.isNull()), "array must not contain nulls", narrow)


def array_to_vector(a: Arg, dim: int | None = None) -> Column:
    return check_vector(_plain(a, "vector"), "vector", dim)


def array_to_half(a: Arg, dim: int | None = None) -> Column:
    return check_vector(dense.to_half(_plain(a, "halfvec")), "halfvec", dim, HALF_MAX_DIM)


def array_to_sparse(a: Arg, dim: int | None = None) -> Column:
    return sparse.from_dense(check_vector(_plain(a, "sparsevec"), "sparsevec", dim))


def vector_to_vector(a: Arg, dim: int) -> Column:
    return check_vector(col(a), "vector", dim)


def vector_to_half(a: Arg, dim: int | None = None) -> Column:
    return check_vector(dense.to_half(a), "halfvec", dim, HALF_MAX_DIM)


def half_to_half(a: Arg, dim: int) -> Column:
    return check_vector(col(a), "halfvec", dim, HALF_MAX_DIM)


def half_to_vector(a: Arg, dim: int | None = None) -> Column:
    return check_vector(col(a), "vector", dim)


def vector_to_array(a: Arg) -> Column:
    return col(a)


vector_to_sparse = sparse.from_dense
half_to_sparse = sparse.from_dense
sparse_to_vector = sparse.to_dense
sparse_to_half = sparse.to_half_dense
sparse_to_sparse = sparse.with_dim

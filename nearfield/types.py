"""Vector types as Spark columns: dense and half as ``array<float>``, sparse as a struct, bits as '0'/'1' strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, IntegerType, StructField, StructType

VECTOR: DataType = ArrayType(FloatType(), False)
SPARSE: DataType = StructType(
    [
        StructField("dim", IntegerType()),
        StructField("indices", ArrayType(IntegerType(), False)),
        StructField("values", ArrayType(FloatType(), False)),
    ]
)
SPARSE_DDL = "struct<dim:int,indices:array<int>,values:array<float>>"

# Limits of the types and of what an index takes.
VECTOR_MAX_DIM, HALF_MAX_DIM, SPARSE_MAX_DIM, SPARSE_MAX_NNZ = 16000, 16000, 1_000_000_000, 16000
INDEX_MAX_DIM = {"vector": 2000, "halfvec": 4000, "bit": 64000, "sparsevec": 1000}
HALF_MAX = 65504.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often and under whatever lambda ``body`` names it."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def fail_if(bad: Column, message: Column | str, otherwise: Column) -> Column:
    """``otherwise``, or an error at run time where ``bad`` holds."""
    return F.when(bad, F.raise_error(message if isinstance(message, Column) else F.lit(message))).otherwise(otherwise)


def check_vector(v: Column, kind: str = "vector", dim: int | None = None, most: int = VECTOR_MAX_DIM) -> Column:
    """``v`` if it has 1 to ``most`` (or just ``dim``) finite elements, else an error."""
    n = F.size(v)
    out = fail_if(F.exists(v, lambda x: F.abs(x) == float("inf")), f"infinite value not allowed in {kind}", v)
    out = fail_if(F.exists(v, F.isnan), f"NaN not allowed in {kind}", out)
    if dim is not None:
        out = fail_if(n != dim, F.format_string(f"expected {dim} dimensions, not %d", n), out)
    out = fail_if(n > most, f"{kind} cannot have more than {most} dimensions", out)
    return F.when(v.isNotNull(), fail_if(n < 1, f"{kind} must have at least 1 dimension", out))


def type_modifier(dim: int, kind: str = "vector", most: int = VECTOR_MAX_DIM) -> dict:
    """Column metadata for a fixed dimension."""
    if dim < 1:
        raise ValueError(f"dimensions for type {kind} must be at least 1")
    if dim > most:
        raise ValueError(f"dimensions for type {kind} cannot exceed {most}")
    return {"vec_kind": kind, "vec_dim": dim}

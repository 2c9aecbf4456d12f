"""Element-wise ``avg`` and ``sum`` of vector columns, with partial aggregation.

Elements are exploded with their position, so that a partial aggregate per (group, position) runs before the shuffle and
its size does not depend on the rows. Sums run in double and are narrowed once (halfvec: to half precision). Null
vectors are skipped; a group without a vector gives null. Vectors of different length in a group are an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dense import to_half


def _by_position(df: DataFrame, vector: str, by: Sequence[str], how: str, half: bool, name: str) -> DataFrame:
    keys = list(by)
    rows = df.select(*keys, F.size(vector).alias("_d"), F.posexplode_outer(vector).alias("_p", "_x"))
    total = {"avg": F.avg, "sum": F.sum}[how](F.col("_x").cast("double"))
    cells = rows.groupBy(*keys, "_p").agg(total.alias("_x"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    item = F.when(F.col("_p").isNotNull(), F.struct("_p", "_x"))
    out = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    values = F.transform("_c", lambda c: c["_x"].cast("float"))
    values = F.when(F.exists(values, lambda x: F.abs(x) == float("inf")), F.raise_error("value out of range: overflow")).otherwise(values)
    values = to_half(values) if half else values
    mixed = F.format_string("different vector dimensions %d and %d", F.col("_lo"), F.col("_hi"))
    values = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(mixed)).otherwise(values)
    return out.select(*keys, F.when(F.size("_c") > 0, values).alias(name))


def vec_avg(df: DataFrame, vector: str, by: Sequence[str] = (), half: bool = False, name: str = "avg") -> DataFrame:
    """Mean vector of each group, ``by`` columns and ``name``."""
    return _by_position(df, vector, by, "avg", half, name)


def vec_sum(df: DataFrame, vector: str, by: Sequence[str] = (), half: bool = False, name: str = "sum") -> DataFrame:
    """Sum vector of each group, ``by`` columns and ``name``."""
    return _by_position(df, vector, by, "sum", half, name)

"""Bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(col: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of ``col``."""
    return (F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def balanced(df: DataFrame, id_col: str, label_col: str, most: int, seed: int = 7) -> tuple[DataFrame, dict]:
    """About ``most`` rows of ``df``, classes weighted inversely to their size, and the size of each class.

    Weighted sampling without replacement: of the keys log(u) / w the largest stay. Only ids and labels are read to find the
    cut; the rows themselves are filtered by it where they lie. Rows with equal ids share a key.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}  # a row a class
    if not sizes:
        return df.limit(0), sizes
    weight = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(1.0 / n))])
    key = F.log(uniform(F.col(id_col), seed)) / weight[F.col(label_col)]
    cut = df.select(key.alias("k")).orderBy(F.desc("k")).limit(most).agg(F.min("k")).head()[0]
    return df.where(key >= cut), sizes

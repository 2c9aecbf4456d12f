"""Bit strings of '0' and '1'. Distances pack them into 60-bit words, so that counting stays in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import col, fail_if

Arg = Column | str
_WORD = 60


def words(a: Column) -> Column:
    n = F.greatest(F.ceil(F.length(a) / _WORD).cast("int"), F.lit(1))
    cut = lambda k: F.conv(F.coalesce(F.nullif(F.substring(a, k * _WORD + 1, F.lit(_WORD)), F.lit("")), F.lit("0")), 2, 10)
    return F.when(a.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda k: cut(k).cast("bigint")))


def _count(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(words(a), words(b), lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x)


def _same(a: Column, b: Column, body: Column) -> Column:
    message = F.format_string("different bit lengths %d and %d", F.length(a), F.length(b))
    return fail_if(F.length(a) != F.length(b), message, body)


def hamming_distance(a: Arg, b: Arg) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, _count(a, b, lambda x, y: x.bitwiseXOR(y)).cast("double"))


def jaccard_distance(a: Arg, b: Arg) -> Column:
    """1 - common ones / ones of either; 1 without a common one."""
    a, b = col(a), col(b)
    both, either = _count(a, b, lambda x, y: x.bitwiseAND(y)), _count(a, b, lambda x, y: x.bitwiseOR(y))
    return _same(a, b, F.when(both == 0, F.lit(1.0)).otherwise(1 - both / either))

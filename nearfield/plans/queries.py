"""The engine's named queries, each over its whole tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, casts, dense, sparse, textio
from ..functions.sqlrewrite import vector_sql
from ..operators import aggregates, knn
from ..operators.ivf import IvfIndex
from ..operators.lsm import LsmIndex
from ..operators.ranking import global_rank
from ..storage import fresh_path, written
from ..streaming.ingest import ingest, slide, tumbling
from .catalog import Catalog

CATALOG = Catalog()
K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def first_vector(rows: DataFrame) -> Column:
    """The vector with id 0 as a literal."""
    return knn.as_query(knn.stored_vector(rows, "embedding", "vec_id", 0))


# --- SQL building blocks ---------------------------------------------------------------------------------------------

def _fold(items: str) -> str:
    return f"list_reduce(list_prepend(0::DOUBLE, {items}), lambda s, x: s + x)"


def _pairs(a: str, b: str, f: str) -> str:
    return _fold(f"list_transform(list_zip({a}, {b}), lambda p: {f.format(x='p[1]::DOUBLE', y='p[2]::DOUBLE')})")


def _dot(a: str, b: str) -> str:
    return _pairs(a, b, "({x}) * ({y})")


def _l2sq(a: str, b: str) -> str:
    return _pairs(a, b, "({x} - {y}) * ({x} - {y})")


def _l1(a: str, b: str) -> str:
    return _pairs(a, b, "abs({x} - {y})")


def _cos(a: str, b: str) -> str:
    return f"1 - greatest(-1::DOUBLE, least(1::DOUBLE, {_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)})))"


SQL_METRICS = {
    "l2": lambda a, b: f"sqrt({_l2sq(a, b)})", "ip": lambda a, b: f"-({_dot(a, b)})", "cosine": _cos, "l1": _l1,
}
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_WITH_Q = f"WITH e AS (SELECT vec_id, label, embedding AS v, {_Q} AS q FROM embeddings)"
_SIGNS = "list_transform({v}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_HAMMING = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS DOUBLE)"


def _topk_sql(distance: str, where: str = "true", k: int = K) -> str:
    return f"{_WITH_Q} SELECT vec_id, {distance} AS distance FROM e WHERE {where} ORDER BY distance, vec_id LIMIT {k}"


def _cells_sql(values: str) -> str:
    """(vec_id, pos, x) of a list expression over e."""
    return f"{_WITH_Q}, r AS (SELECT vec_id, {values} AS w FROM e) SELECT vec_id, CAST(unnest(range(len(w))) AS BIGINT) AS pos, CAST(unnest(w) AS DOUBLE) AS x FROM r"


def _cells(df: DataFrame, values: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode_outer(values).alias("p", "y")).select("vec_id", F.col("p").cast("long").alias("pos"), F.col("y").cast("double").alias("x"))


# --- distances (top-k by each) ----------------------------------------------------------------------------------------

def _add_topk(name: str, metric: str, sql: str) -> None:
    @CATALOG.add(name, sql)
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return knn.exact(rows, "embedding", first_vector(rows), K, metric, "vec_id").select("vec_id", "distance")


for _name, _metric in (("l2_topk", "l2"), ("ip_topk", "ip"), ("cosine_topk", "cosine"), ("l1_topk", "l1")):
    _add_topk(_name, _metric, _topk_sql(SQL_METRICS[_metric]("v", "q")))


def _add_scalar(name: str, f, sql: str) -> None:
    """A scalar of every vector and the vector with id 0."""

    @CATALOG.add(name, f"{_WITH_Q} SELECT vec_id, {sql} AS x FROM e")
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return rows.select("vec_id", f(F.col("embedding"), first_vector(rows)).alias("x"))


_BIT = lambda v: dense.binary_quantize(v)
_SPARSE = lambda v: sparse.from_dense(F.transform(v, lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0)).otherwise(x).cast("float")))
_CUT = "list_transform({v}, lambda x: CASE WHEN abs(x) < 0.1 THEN 0::FLOAT ELSE x END)"
_HALF_SQL = (
    "list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0::DOUBLE ELSE round_even(x::DOUBLE / pow(2::DOUBLE, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0)"
    " * pow(2::DOUBLE, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END)"
)
_BV, _BQ, _CV, _CQ, _HV, _HQ = (t.format(v=v) for t in (_SIGNS, _CUT, _HALF_SQL) for v in ("v", "q"))
_AND = f"list_sum(list_transform(list_zip({_BV}, {_BQ}), lambda p: p[1] & p[2]))"
_OR = f"list_sum(list_transform(list_zip({_BV}, {_BQ}), lambda p: p[1] | p[2]))"

_add_scalar("l2_squared", dense.l2_squared_distance, _l2sq("v", "q"))
_add_scalar("inner_product", dense.inner_product, _dot("v", "q"))
_add_scalar("spherical", lambda a, b: F.round(dense.spherical_distance(a, b), 9), f"round(acos(greatest(-1::DOUBLE, least(1::DOUBLE, {_dot('v', 'q')}))) / pi(), 9)")
_add_scalar("vec_norm", lambda a, b: dense.vector_norm(a), f"sqrt({_dot('v', 'v')})")
_add_scalar("vec_dims", lambda a, b: dense.vector_dims(a).cast("long"), "CAST(len(v) AS BIGINT)")
_add_scalar("binary_quantize", lambda a, b: _BIT(a), f"array_to_string({_BV}, '')")
_add_scalar("hamming_distance", lambda a, b: bits.hamming_distance(_BIT(a), _BIT(b)), _HAMMING.format(a=_BV, b=_BQ))
_add_scalar("jaccard_distance", lambda a, b: bits.jaccard_distance(_BIT(a), _BIT(b)), f"CASE WHEN {_AND} = 0 THEN 1::DOUBLE ELSE 1 - {_AND}::DOUBLE / {_OR}::DOUBLE END")
_add_scalar("vec_cmp", lambda a, b: dense.vector_cmp(a, b).cast("long"), "CAST(CASE WHEN v < q THEN -1 WHEN v > q THEN 1 ELSE 0 END AS BIGINT)")
for _op, _f in (("lt", dense.vector_lt), ("le", dense.vector_le), ("eq", dense.vector_eq), ("ne", dense.vector_ne), ("ge", dense.vector_ge), ("gt", dense.vector_gt)):
    _add_scalar(f"vec_{_op}", _f, f"v {dict(lt='<', le='<=', eq='=', ne='<>', ge='>=', gt='>')[_op]} q")
for _name, _f, _sql in (
    ("half_l2", dense.l2_distance, lambda a, b: f"sqrt({_l2sq(a, b)})"),
    ("half_ip", dense.negative_inner_product, lambda a, b: f"-({_dot(a, b)})"),
    ("half_cosine", dense.cosine_distance, _cos),
    ("half_l1", dense.l1_distance, _l1),
):
    _add_scalar(_name, lambda a, b, f=_f: f(dense.to_half(a), dense.to_half(b)), _sql(_HV, _HQ))
for _name, _f, _sql in (
    ("sparse_l2", sparse.l2_distance, lambda a, b: f"sqrt({_l2sq(a, b)})"),
    ("sparse_l2_squared", sparse.l2_squared_distance, _l2sq),
    ("sparse_ip", sparse.negative_inner_product, lambda a, b: f"-({_dot(a, b)})"),
    ("sparse_cosine", sparse.cosine_distance, _cos),
    ("sparse_l1", sparse.l1_distance, _l1),
):
    _add_scalar(_name, lambda a, b, f=_f: F.round(f(_SPARSE(a), _SPARSE(b)), 9), f"round({_sql(_CV, _CQ)}, 9)")
_add_scalar("sparse_norm", lambda a, b: sparse.l2_norm(_SPARSE(a)), f"sqrt({_dot(_CV, _CV)})")
_add_scalar("sparse_nnz", lambda a, b: F.size(_SPARSE(a)["indices"]).cast("long"), f"CAST(len(list_filter({_CV}, lambda x: x <> 0)) AS BIGINT)")
_add_scalar("sparse_cmp", lambda a, b: sparse.sparsevec_cmp(_SPARSE(a), _SPARSE(b)).cast("long"), f"CAST(CASE WHEN {_CV} < {_CQ} THEN -1 WHEN {_CV} > {_CQ} THEN 1 ELSE 0 END AS BIGINT)")

for _op, _f in (
    ("lt", sparse.sparsevec_lt), ("le", sparse.sparsevec_le), ("eq", sparse.sparsevec_eq), ("ne", sparse.sparsevec_ne), ("ge", sparse.sparsevec_ge), ("gt", sparse.sparsevec_gt),
):
    _add_scalar(f"sparse_{_op}", lambda a, b, f=_f: f(_SPARSE(a), _SPARSE(b)), f"{_CV} {dict(lt='<', le='<=', eq='=', ne='<>', ge='>=', gt='>')[_op]} {_CQ}")
_H = dense.to_half
_add_scalar("half_l2_squared", lambda a, b: dense.l2_squared_distance(_H(a), _H(b)), _l2sq(_HV, _HQ))
_add_scalar("half_norm", lambda a, b: dense.vector_norm(_H(a)), f"sqrt({_dot(_HV, _HV)})")
_add_scalar("half_dims", lambda a, b: dense.vector_dims(_H(a)).cast("long"), "CAST(len(v) AS BIGINT)")
_add_scalar("half_quantize", lambda a, b: dense.binary_quantize(_H(a)), f"array_to_string({_SIGNS.format(v=_HV)}, '')")
_add_scalar("half_spherical", lambda a, b: F.round(dense.spherical_distance(_H(a), _H(b)), 9), f"round(acos(greatest(-1::DOUBLE, least(1::DOUBLE, {_dot(_HV, _HQ)}))) / pi(), 9)")
_add_scalar("half_cmp", lambda a, b: dense.vector_cmp(_H(a), _H(b)).cast("long"), f"CAST(CASE WHEN {_HV} < {_HQ} THEN -1 WHEN {_HV} > {_HQ} THEN 1 ELSE 0 END AS BIGINT)")
for _op, _f in (("lt", dense.vector_lt), ("le", dense.vector_le), ("eq", dense.vector_eq), ("ne", dense.vector_ne), ("ge", dense.vector_ge), ("gt", dense.vector_gt)):
    _add_scalar(f"half_{_op}", lambda a, b, f=_f: f(_H(a), _H(b)), f"{_HV} {dict(lt='<', le='<=', eq='=', ne='<>', ge='>=', gt='>')[_op]} {_HQ}")
_add_scalar("half_inner_product", lambda a, b: dense.inner_product(_H(a), _H(b)), _dot(_HV, _HQ))
_add_scalar("sparse_inner_product", lambda a, b: F.round(sparse.inner_product(_SPARSE(a), _SPARSE(b)), 9), f"round({_dot(_CV, _CQ)}, 9)")
_add_scalar("vec_negative_ip", dense.negative_inner_product, f"-({_dot('v', 'q')})")

# --- element-wise and shape -------------------------------------------------------------------------------------------


def _add_cells(name: str, f, sql: str) -> None:
    @CATALOG.add(name, _cells_sql(sql))
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        return _cells(rows, f(F.col("embedding"), first_vector(rows)))


_zip = lambda f: f"list_transform(list_zip(v, q), lambda p: CAST(p[1] {f} p[2] AS FLOAT))"
_add_cells("vec_add", dense.vector_add, _zip("+"))
_add_cells("vec_sub", dense.vector_sub, _zip("-"))
_add_cells("vec_mul", dense.vector_mul, _zip("*"))
_add_cells("vec_concat", dense.vector_concat, "list_concat(v, q)")
_add_cells("subvector", lambda a, b: dense.subvector(a, 5, 16), "v[5:20]")
_add_cells("l2_normalize", lambda a, b: dense.l2_normalize(a), f"list_transform(v, lambda x: CAST(x::DOUBLE / sqrt({_dot('v', 'v')}) AS FLOAT))")
_add_cells("to_half", lambda a, b: dense.to_half(a), _HALF_SQL.format(v="v"))
_hzip = lambda f: _HALF_SQL.format(v=f"list_transform(list_zip({_HV}, {_HQ}), lambda p: p[1] {f} p[2])")
_add_cells("half_add", lambda a, b: dense.vector_add(_H(a), _H(b), half=True), _hzip("+"))
_add_cells("half_sub", lambda a, b: dense.vector_sub(_H(a), _H(b), half=True), _hzip("-"))
_add_cells("half_mul", lambda a, b: dense.vector_mul(_H(a), F.transform(a, lambda x: F.lit(0.75).cast("float")), half=True), _HALF_SQL.format(v=f"list_transform({_HV}, lambda y: y * 0.75::DOUBLE)"))
_add_cells("half_concat", lambda a, b: dense.vector_concat(_H(a), _H(b)), f"list_concat({_HV}, {_HQ})")
_add_cells("half_subvector", lambda a, b: dense.subvector(_H(a), 60, 10), f"({_HV})[60:64]")
_add_cells("half_normalize", lambda a, b: dense.l2_normalize(_H(a), half=True), _HALF_SQL.format(v=f"list_transform({_HV}, lambda y: CAST(y / sqrt({_dot(_HV, _HV)}) AS FLOAT))"))
_add_cells("half_to_sparse", lambda a, b: sparse.to_dense(casts.half_to_sparse(_H(a))), _HALF_SQL.format(v="v"))
_add_cells("sparse_to_half", lambda a, b: casts.sparse_to_half(_SPARSE(a)), _HALF_SQL.format(v=_CUT.format(v="v")))
_add_cells("sparse_normalize", lambda a, b: sparse.to_dense(sparse.l2_normalize(_SPARSE(a))), f"list_transform({_CUT.format(v='v')}, lambda y: CAST(y::DOUBLE / sqrt({_dot(_CV, _CV)}) AS FLOAT))")
_add_cells("cast_half_arrays", lambda a, b: casts.array_to_half(F.transform(a, lambda x: x.cast("double"))), _HALF_SQL.format(v="v"))
_add_cells("cast_sparse_arrays", lambda a, b: sparse.to_dense(casts.array_to_sparse(F.transform(a, lambda x: x.cast("double")))), "v")
_add_cells("half_binary_roundtrip", lambda a, b: textio.vector_recv(textio.vector_send(_H(a), "halfvec"), "halfvec"), _HALF_SQL.format(v="v"))
_add_cells("sparse_roundtrip", lambda a, b: sparse.to_dense(_SPARSE(a)), _CUT.format(v="v"))
_add_cells("cast_arrays", lambda a, b: casts.array_to_vector(F.transform(a, lambda x: x.cast("double"))), "v")
_add_cells("text_roundtrip", lambda a, b: textio.vector_in(textio.vector_out(a)), "v")
_add_cells("binary_roundtrip", lambda a, b: textio.vector_recv(textio.vector_send(a)), "v")


_add_cells("half_text_roundtrip", lambda a, b: textio.vector_in(textio.vector_out(_H(a)), "halfvec"), _HALF_SQL.format(v="v"))
_add_cells("cast_integer_arrays", lambda a, b: casts.array_to_vector(F.transform(a, lambda x: F.floor(x * 100).cast("int"))), "list_transform(v, lambda x: floor(x::DOUBLE * 100))")
_add_cells("cast_real_arrays", lambda a, b: casts.array_to_vector(a, 64), "v")
_add_cells("cast_numeric_arrays", lambda a, b: casts.array_to_vector(F.transform(a, lambda x: F.floor(x * 100).cast("decimal(12,2)"))), "list_transform(v, lambda x: floor(x::DOUBLE * 100))")
_add_cells("cast_integer_half", lambda a, b: casts.array_to_half(F.transform(a, lambda x: F.floor(x * 100).cast("int"))), "list_transform(v, lambda x: floor(x::DOUBLE * 100))")
_add_cells("cast_real_half", lambda a, b: casts.array_to_half(a, 64), _HALF_SQL.format(v="v"))
_add_cells("cast_numeric_half", lambda a, b: casts.array_to_half(F.transform(a, lambda x: F.floor(x * 100).cast("decimal(12,2)"))), "list_transform(v, lambda x: floor(x::DOUBLE * 100))")
_add_cells("cast_integer_sparse", lambda a, b: sparse.to_dense(casts.array_to_sparse(F.transform(a, lambda x: F.floor(x * 4).cast("int")))), "list_transform(v, lambda x: floor(x::DOUBLE * 4))")
_add_cells("cast_real_sparse", lambda a, b: sparse.to_dense(casts.array_to_sparse(a, 64)), "v")
_add_cells("cast_numeric_sparse", lambda a, b: sparse.to_dense(casts.array_to_sparse(F.transform(a, lambda x: F.floor(x * 4).cast("decimal(12,2)")))), "list_transform(v, lambda x: floor(x::DOUBLE * 4))")
_add_cells("typmod_vector", lambda a, b: casts.vector_to_vector(a, 64), "v")
_add_cells("typmod_half", lambda a, b: casts.half_to_half(_H(a), 64), _HALF_SQL.format(v="v"))
_add_cells("typmod_sparse", lambda a, b: sparse.to_dense(casts.sparse_to_sparse(_SPARSE(a), 64)), _CUT.format(v="v"))
_add_cells("vector_to_array", lambda a, b: casts.vector_to_array(a), "v")
_add_cells("half_to_array", lambda a, b: casts.vector_to_array(_H(a)), _HALF_SQL.format(v="v"))
_add_cells("half_to_vector", lambda a, b: casts.half_to_vector(_H(a), 64), _HALF_SQL.format(v="v"))
_add_cells("vector_to_half_dim", lambda a, b: casts.vector_to_half(a, 64), _HALF_SQL.format(v="v"))


@CATALOG.add("sparse_binary_roundtrip", _cells_sql(_CUT.format(v="v")))
def sparse_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectors(spark, sf_dir).select("vec_id", textio.sparsevec_recv(textio.sparsevec_send(_SPARSE(F.col("embedding")))).alias("s"))
    return _cells(coded, sparse.to_dense("s"))


# --- the same through SQL text ----------------------------------------------------------------------------------------


def _sql_view(spark: SparkSession, sf_dir: str) -> None:
    rows = vectors(spark, sf_dir)
    rows.select("vec_id", "label", F.col("embedding").alias("v"), first_vector(rows).alias("q")).createOrReplaceTempView("nearfield_e")


def _add_sql_scalar(name: str, expression: str, sql: str) -> None:
    @CATALOG.add(f"sql_{name}", f"{_WITH_Q} SELECT vec_id, {sql} AS x FROM e")
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        _sql_view(spark, sf_dir)
        return vector_sql(spark, f"SELECT vec_id, {expression} AS x FROM nearfield_e")


def _add_sql_cells(name: str, expression: str, sql: str) -> None:
    @CATALOG.add(f"sql_{name}", _cells_sql(sql))
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        _sql_view(spark, sf_dir)
        return _cells(vector_sql(spark, f"SELECT vec_id, {expression} AS r FROM nearfield_e"), F.col("r"))


_SV, _SQ2 = "vector_to_sparsevec(v)", "vector_to_sparsevec(q)"
_HV2, _HQ2 = "vector_to_halfvec(v, -1)", "vector_to_halfvec(q, 64)"
for _name, _call, _sql in (
    ("op_l2", "v <-> q", SQL_METRICS["l2"]("v", "q")), ("op_ip", "v <#> q", SQL_METRICS["ip"]("v", "q")), ("op_l1", "v <+> q", SQL_METRICS["l1"]("v", "q")),
    ("op_hamming", "binary_quantize(v) <~> binary_quantize(q)", _HAMMING.format(a=_BV, b=_BQ)),
    ("op_jaccard", "binary_quantize(v) <%> binary_quantize(q)", f"CASE WHEN {_AND} = 0 THEN 1::DOUBLE ELSE 1 - {_AND}::DOUBLE / {_OR}::DOUBLE END"),
    ("op_less", "v < q", "v < q"), ("op_not_equal", "v <> q", "v <> q"),
    ("l2_squared_distance", "l2_squared_distance(v, q)", _l2sq("v", "q")), ("vector_norm", "vector_norm(v)", f"sqrt({_dot('v', 'v')})"),
    ("vector_dims", "bigint(vector_dims(v))", "CAST(len(v) AS BIGINT)"), ("quantize", "binary_quantize(v)", f"array_to_string({_BV}, '')"),
    ("halfvec_ip", f"halfvec_negative_inner_product({_HV2}, {_HQ2})", f"-({_dot(_HV, _HQ)})"),
    ("halfvec_inner_product", f"inner_product({_HV2}, {_HQ2})", _dot(_HV, _HQ)),
    ("sparse_l2", f"round(sparsevec_l2_distance({_SV}, {_SQ2}), 9)", f"round(sqrt({_l2sq('v', 'q')}), 9)"),
    ("sparse_inner_product", f"round(sparsevec_inner_product({_SV}, {_SQ2}), 9)", f"round({_dot('v', 'q')}, 9)"),
    ("sparse_cosine", f"round(sparsevec_cosine_distance({_SV}, {_SQ2}), 9)", f"round({_cos('v', 'q')}, 9)"),
    ("sparse_norm", f"sparsevec_l2_norm({_SV})", f"sqrt({_dot('v', 'v')})"), ("sparse_ge", f"sparsevec_ge({_SV}, {_SQ2})", "v >= q"),
):
    _add_sql_scalar(_name, _call, _sql)
for _name, _call, _sql in (
    ("add", "v::vector + q::vector", _zip("+")), ("sub", "v::vector - q", _zip("-")), ("mul", "v::vector * q::vector", _zip("*")),
    ("concat", "v::vector || q::vector", "list_concat(v, q)"), ("subvector", "subvector(v, 5, 16)", "v[5:20]"),
    ("normalize", "l2_normalize(v)", f"list_transform(v, lambda x: CAST(x::DOUBLE / sqrt({_dot('v', 'v')}) AS FLOAT))"),
    ("halfvec_add", f"halfvec_add({_HV2}, {_HQ2})", _hzip("+")), ("halfvec_sub", f"halfvec_sub({_HV2}, {_HQ2})", _hzip("-")),
    ("to_halfvec", _HV2, _HALF_SQL.format(v="v")), ("cast_array", "array_to_vector(transform(v, x -> double(x)), 64)", "v"),
    ("text", "vector_in(vector_out(v))", "v"), ("binary", "halfvec_recv(halfvec_send(vector_to_halfvec(v, -1)))", _HALF_SQL.format(v="v")),
    ("sparse_roundtrip", "sparsevec_to_vector(sparsevec_in(sparsevec_out(vector_to_sparsevec(v))))", "v"),
    ("sparse_normalize", f"sparsevec_to_vector(sparsevec_l2_normalize({_SV}))", f"list_transform(v, lambda x: CAST(x::DOUBLE / sqrt({_dot('v', 'v')}) AS FLOAT))"),
):
    _add_sql_cells(_name, _call, _sql)


@CATALOG.add("sparse_text_roundtrip", _cells_sql(_CUT.format(v="v")))
def sparse_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectors(spark, sf_dir).select("vec_id", textio.sparsevec_in(textio.sparsevec_out(_SPARSE(F.col("embedding")))).alias("s"))
    return _cells(coded, sparse.to_dense("s"))



@CATALOG.add("vec_sort", "SELECT vec_id, CAST(row_number() OVER (ORDER BY embedding, vec_id) AS BIGINT) AS place FROM embeddings")
def vec_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_rank(vectors(spark, sf_dir), "embedding", "vec_id").select("vec_id", "place")


@CATALOG.add("vec_distinct", "SELECT label, CAST(count(DISTINCT embedding) AS BIGINT) AS n FROM embeddings GROUP BY label")
def vec_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("label").agg(F.countDistinct("embedding").alias("n"))


# --- aggregates -------------------------------------------------------------------------------------------------------

_UNNEST = "SELECT {g} CAST(unnest(range(len(embedding))) AS BIGINT) AS pos, unnest(embedding)::DOUBLE AS y FROM embeddings"


def _agg_cells(df: DataFrame, name: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(name).alias("p", "y")).select(*keys, F.col("p").cast("long").alias("pos"), F.round(F.col("y").cast("double"), 5).alias("x"))


@CATALOG.add("vec_avg", f"SELECT pos, round(avg(y)::FLOAT::DOUBLE, 5) AS x FROM ({_UNNEST.format(g='')}) GROUP BY pos")
def vec_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg_cells(aggregates.vec_avg(vectors(spark, sf_dir), "embedding"), "avg")


@CATALOG.add("vec_sum", f"SELECT pos, round(sum(y)::FLOAT::DOUBLE, 5) AS x FROM ({_UNNEST.format(g='')}) GROUP BY pos")
def vec_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg_cells(aggregates.vec_sum(vectors(spark, sf_dir), "embedding"), "sum")


@CATALOG.add("vec_avg_by_label", f"SELECT label, pos, round(avg(y)::FLOAT::DOUBLE, 5) AS x FROM ({_UNNEST.format(g='label,')}) GROUP BY label, pos")
def vec_avg_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg_cells(aggregates.vec_avg(vectors(spark, sf_dir), "embedding", ["label"]), "avg", "label")


@CATALOG.add("vec_sum_by_label", f"SELECT label, pos, round(sum(y)::FLOAT::DOUBLE, 5) AS x FROM ({_UNNEST.format(g='label,')}) GROUP BY label, pos")
def vec_sum_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agg_cells(aggregates.vec_sum(vectors(spark, sf_dir), "embedding", ["label"]), "sum", "label")


_HALF_OF = lambda y: _HALF_SQL.format(v=f"[{y}]") + "[1]"
_HALF_UNNEST = f"SELECT label, pos, {_HALF_OF('y')} AS y FROM ({_UNNEST.format(g='label,')})"


def _half_agg_sql(how: str) -> str:
    return f"SELECT label, pos, round({_HALF_OF('z')}, 5) AS x FROM (SELECT label, pos, {how}(y)::FLOAT AS z FROM ({_HALF_UNNEST}) GROUP BY label, pos)"


@CATALOG.add("half_sum_by_label", _half_agg_sql("sum"))
def half_sum_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("h", dense.to_half("embedding"))
    return _agg_cells(aggregates.vec_sum(rows, "h", ["label"], half=True), "sum", "label")


@CATALOG.add("half_avg_by_label", _half_agg_sql("avg"))
def half_avg_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("h", dense.to_half("embedding"))
    return _agg_cells(aggregates.vec_avg(rows, "h", ["label"], half=True), "avg", "label")


def _add_sql_aggregate(how: str) -> None:
    @CATALOG.add(f"sql_{how}", f"SELECT label, pos, round({how}(y)::FLOAT::DOUBLE, 5) AS x FROM ({_UNNEST.format(g='label,')}) GROUP BY label, pos")
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        _sql_view(spark, sf_dir)
        return _agg_cells(vector_sql(spark, f"SELECT label, {how}(v::vector(64)) AS r FROM nearfield_e GROUP BY label"), "r", "label")


_add_sql_aggregate("avg")
_add_sql_aggregate("sum")


# --- query shapes -----------------------------------------------------------------------------------------------------


@CATALOG.add("knn_filtered", _topk_sql(SQL_METRICS["l2"]("v", "q"), "label = 3"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.exact(rows, "embedding", first_vector(rows), K, "l2", "vec_id", F.col("label") == 3).select("vec_id", "distance")


@CATALOG.add("knn_range", f"SELECT * FROM ({_WITH_Q} SELECT vec_id, {SQL_METRICS['l2']('v', 'q')} AS distance FROM e) WHERE distance < 1.35")
def knn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.within(rows, "embedding", first_vector(rows), 1.35).select("vec_id", "distance")


@CATALOG.add("knn_self_exclude", _topk_sql(SQL_METRICS["l2"]("v", "q"), "vec_id <> 0"))
def knn_self_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest_to_row(vectors(spark, sf_dir), "embedding", 0, K, "l2", "vec_id").select("vec_id", "distance")


@CATALOG.add("knn_projection", f"{_WITH_Q} SELECT vec_id, 1 - ({_cos('v', 'q')}) AS similarity FROM e")
def knn_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id", (1 - dense.cosine_distance("embedding", first_vector(rows))).alias("similarity"))


@CATALOG.add("knn_subquery", _topk_sql(SQL_METRICS["l2"]("v", "q")))
def knn_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors(spark, sf_dir).createOrReplaceTempView("nearfield_vectors")
    return vector_sql(
        spark,
        "SELECT vec_id, embedding <-> (SELECT first(embedding) FROM nearfield_vectors WHERE vec_id = 0) AS distance "
        f"FROM nearfield_vectors ORDER BY distance, vec_id LIMIT {K}",
    )


@CATALOG.add(
    "knn_batch",
    f"SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {SQL_METRICS['l2']('b.embedding', 'a.embedding')} AS distance, "
    f"row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_METRICS['l2']('b.embedding', 'a.embedding')}, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= {K}",
)
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    got = knn.batch(rows, rows, K, "l2", "embedding", "vec_id", "embedding", "vec_id")
    return got.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


_COARSE_SQL = "WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CASE WHEN x > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS v FROM embeddings)"


@CATALOG.add(
    "knn_ties",
    f"{_COARSE_SQL} SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {SQL_METRICS['l2']('b.v', 'a.v')} AS distance, "
    f"row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_METRICS['l2']('b.v', 'a.v')}, b.vec_id) AS rank FROM e a, e b) WHERE rank <= {K}",
)
def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which an eighth are equal: the smaller ids win."""
    signs = F.transform(F.slice("embedding", 1, 3), lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
    rows = vectors(spark, sf_dir).select("vec_id", signs.alias("v"))
    got = knn.batch(rows, rows, K, "l2", "v", "vec_id", "v", "vec_id")
    return got.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


@CATALOG.add("mixed_dimensions", _topk_sql(SQL_METRICS["l2"]("v[1:32]", "q[1:32]"), "vec_id % 2 = 0"))
def mixed_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with vectors of 32 and of 64 elements: a query meets those of its own dimension."""
    rows = vectors(spark, sf_dir)
    mixed = rows.withColumn("v", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return knn.exact(mixed, "v", F.slice(first_vector(rows), 1, 32), K, "l2", "vec_id", dim=32).select("vec_id", "distance")


@CATALOG.add(
    "knn_join_nation",
    f"{_WITH_Q} SELECT vec_id, n_name, {SQL_METRICS['l2']('v', 'q')} AS distance FROM e JOIN nation ON label = n_nationkey WHERE n_regionkey = 1 ORDER BY distance, vec_id LIMIT {K}",
)
def knn_join_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    joined = rows.join(nation, F.col("label") == F.col("n_nationkey"))
    return knn.exact(joined, "embedding", first_vector(rows), K, "l2", "vec_id").select("vec_id", "n_name", "distance")


@CATALOG.add(
    "centroid_nearest",
    f"WITH c AS (SELECT label, list(y ORDER BY pos) AS c FROM (SELECT label, pos, avg(y)::FLOAT AS y FROM ({_UNNEST.format(g='label,')}) GROUP BY label, pos) GROUP BY label) "
    f"SELECT vec_id, label, round(distance, 5) AS distance FROM (SELECT vec_id, e.label, {SQL_METRICS['l2']('embedding', 'c')} AS distance, "
    f"row_number() OVER (PARTITION BY e.label ORDER BY {SQL_METRICS['l2']('embedding', 'c')}, vec_id) AS r FROM embeddings e JOIN c USING (label)) WHERE r = 1",
)
def centroid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    means = aggregates.vec_avg(rows, "embedding", ["label"])
    near = rows.join(means, "label").withColumn("distance", dense.l2_distance("embedding", "avg"))
    best = near.groupBy("label").agg(F.min(F.struct("distance", "vec_id")).alias("b"))
    return best.select("b.vec_id", "label", F.round("b.distance", 5).alias("distance"))


@CATALOG.add(
    "similarity_join",
    f"SELECT left_id, right_id, distance FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id, {SQL_METRICS['l2']('a.embedding', 'b.embedding')} AS distance "
    "FROM embeddings a, embeddings b) WHERE distance < 1.0",
)
def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.similarity_join(rows, rows, 1.0, "l2", "embedding", "vec_id")


@CATALOG.add(
    "rerank_binary",
    f"{_WITH_Q}, near AS (SELECT *, {_HAMMING.format(a=_BV, b=_BQ)} AS h FROM e ORDER BY h, vec_id LIMIT 20) "
    f"SELECT vec_id, {_cos('v', 'q')} AS distance FROM near ORDER BY distance, vec_id LIMIT 5",
)
def rerank_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.rerank_binary(rows, "embedding", first_vector(rows), 5, 20, "vec_id").select("vec_id", "distance")


@CATALOG.add(
    "rerank_subvector",
    f"{_WITH_Q}, near AS (SELECT *, {_cos('v[1:16]', 'q[1:16]')} AS h FROM e ORDER BY h, vec_id LIMIT 20) "
    f"SELECT vec_id, {_cos('v', 'q')} AS distance FROM near ORDER BY distance, vec_id LIMIT 5",
)
def rerank_subvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.rerank_subvector(rows, "embedding", first_vector(rows), 1, 16, 5, 20, "vec_id").select("vec_id", "distance")


@CATALOG.add("half_l2_topk", _topk_sql(f"sqrt({_l2sq(_HV, _HQ)})"))
def half_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    half = rows.withColumn("h", dense.to_half("embedding"))
    return knn.exact(half, "h", dense.to_half(first_vector(rows)), K, "l2", "vec_id").select("vec_id", "distance")


@CATALOG.add("hamming_topk", _topk_sql(_HAMMING.format(a=_BV, b=_BQ)))
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    coded = rows.withColumn("b", _BIT(F.col("embedding")))
    return knn.exact(coded, "b", _BIT(first_vector(rows)), K, "hamming", "vec_id").select("vec_id", "distance")


@CATALOG.add("jaccard_topk", _topk_sql(f"CASE WHEN {_AND} = 0 THEN 1::DOUBLE ELSE 1 - {_AND}::DOUBLE / {_OR}::DOUBLE END"))
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    coded = rows.withColumn("b", _BIT(F.col("embedding")))
    return knn.exact(coded, "b", _BIT(first_vector(rows)), K, "jaccard", "vec_id").select("vec_id", "distance")


@CATALOG.add(
    "rrf_hybrid",
    "WITH t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY (length(text) - length(replace(text, 'the', ''))) DESC, doc_id) AS rank FROM documents), "
    f"s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM ({_WITH_Q} SELECT vec_id, {SQL_METRICS['l2']('v', 'q')} AS distance FROM e)), "
    "u AS (SELECT * FROM t WHERE rank <= 50 UNION ALL SELECT * FROM s WHERE rank <= 50) "
    "SELECT id, round(sum(1.0 / (60 + rank)::DOUBLE), 12) AS score FROM u GROUP BY id",
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = table(spark, sf_dir, "documents"), vectors(spark, sf_dir)
    hits = F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))
    text = docs.select(F.col("doc_id").alias("id"), hits.alias("h")).orderBy(F.desc("h"), "id").limit(50)
    near = knn.exact(rows, "embedding", first_vector(rows), 50, "l2", "vec_id").select(F.col("vec_id").alias("id"), "distance")
    text = text.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("h"), "id")))  # 50 rows
    near = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # 50 rows
    fused = knn.reciprocal_rank_fusion([text, near])
    return fused.select("id", F.round("score", 12).alias("score"))


@CATALOG.add("operator_syntax", _topk_sql(_cos("v", "q"), "label < 5"))
def operator_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    rows.createOrReplaceTempView("nearfield_vectors")
    q = textio.format_dense(knn.stored_vector(rows, "embedding", "vec_id", 0))
    return vector_sql(
        spark, f"SELECT vec_id, embedding <=> '{q}'::vector(64) AS distance FROM nearfield_vectors WHERE label < 5 ORDER BY embedding <=> '{q}', vec_id LIMIT {K}"
    )


# --- indexes ----------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, rows: DataFrame, metric: str = "l2", lists: int = 20) -> IvfIndex:
    return IvfIndex.build(rows, fresh_path(spark, "ivf"), "embedding", "vec_id", metric, lists=lists)


@CATALOG.add("ivf_full_probe", _topk_sql(SQL_METRICS["l2"]("v", "q")))
def ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    query = knn.stored_vector(rows, "embedding", "vec_id", 0)
    return _index(spark, rows).search(spark, query, K, probes=20).withColumnRenamed("id", "vec_id")


def _add_full_probe(name: str, kind: str, metric: str, coded, sql: str) -> None:
    """An index of another kind: with all lists read it must give the exact rows."""

    @CATALOG.add(name, sql)
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir).select("vec_id", coded(F.col("embedding")).alias("embedding"))
        index = IvfIndex.build(rows, fresh_path(spark, "ivf"), "embedding", "vec_id", metric, kind, lists=10)
        query = rows.where("vec_id = 0").head()[1]
        query = query.asDict() if kind == "sparsevec" else query if kind == "bit" else [float(x) for x in query]
        return index.search(spark, query, K, probes=10).withColumnRenamed("id", "vec_id")


_HALF_METRICS = {m: f(_HV, _HQ) for m, f in SQL_METRICS.items()}
_SPARSE_METRICS = {m: f(_CV, _CQ) for m, f in SQL_METRICS.items()}
for _metric in ("ip", "l1"):
    _add_full_probe(f"ivf_{_metric}", "vector", _metric, lambda v: v, _topk_sql(SQL_METRICS[_metric]("v", "q")))
for _metric in ("l2", "ip", "l1"):
    _add_full_probe("ivf_half" if _metric == "l2" else f"ivf_half_{_metric}", "halfvec", _metric, dense.to_half, _topk_sql(_HALF_METRICS[_metric]))
_add_full_probe("ivf_hamming", "bit", "hamming", _BIT, _topk_sql(_HAMMING.format(a=_BV, b=_BQ)))
_add_full_probe("ivf_jaccard", "bit", "jaccard", _BIT, _topk_sql(f"CASE WHEN {_AND} = 0 THEN 1::DOUBLE ELSE 1 - {_AND}::DOUBLE / {_OR}::DOUBLE END"))
for _metric in ("l2", "ip", "l1"):
    _add_full_probe("ivf_sparse" if _metric == "ip" else f"ivf_sparse_{_metric}", "sparsevec", _metric, _SPARSE, _topk_sql(_SPARSE_METRICS[_metric]))


def _add_cosine_probe(name: str, kind: str, coded, sql: str) -> None:
    """Indexes under cosine hold unit vectors in single precision, hence distances to six places."""

    @CATALOG.add(name, f"SELECT vec_id, round(distance, 6) AS distance FROM ({_topk_sql(sql)})")
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir).select("vec_id", coded(F.col("embedding")).alias("embedding"))
        index = IvfIndex.build(rows, fresh_path(spark, "ivf"), "embedding", "vec_id", "cosine", kind, lists=10)
        query = rows.where("vec_id = 0").head()[1]
        got = index.search(spark, query.asDict() if kind == "sparsevec" else [float(x) for x in query], K, probes=10)
        return got.select(F.col("id").alias("vec_id"), F.abs(F.round("distance", 6)).alias("distance"))


_add_cosine_probe("ivf_cosine", "vector", lambda v: v, f"abs({_cos('v', 'q')})")
_add_cosine_probe("ivf_half_cosine", "halfvec", dense.to_half, f"abs({_cos(_HV, _HQ)})")
_add_cosine_probe("ivf_sparse_cosine", "sparsevec", _SPARSE, f"abs({_cos(_CV, _CQ)})")


@CATALOG.add("ivf_partitioned", " UNION ALL ".join(f"SELECT * FROM ({_topk_sql(SQL_METRICS['l2']('v', 'q'), f'label = {k}', 3)})" for k in (1, 2, 3)))
def ivf_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index for each of three labels, as for the partitions of a table; a query reads the one of its label."""
    rows = vectors(spark, sf_dir)
    query, out = knn.stored_vector(rows, "embedding", "vec_id", 0), None
    for k in (1, 2, 3):
        index = IvfIndex.build(rows, fresh_path(spark, "ivf"), "embedding", "vec_id", lists=4, where=F.col("label") == k)
        got = index.search(spark, query, 3, probes=4).withColumnRenamed("id", "vec_id")
        out = got if out is None else out.union(got)
    return out


@CATALOG.add("ivf_relaxed", f"SELECT * FROM ({_topk_sql(SQL_METRICS['l2']('v', 'q'), 'label = 3', 1_000_000)})")
def ivf_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed order, then strictly sorted: all rows that pass the filter, as the limit is beyond them."""
    rows = vectors(spark, sf_dir)
    query = knn.stored_vector(rows, "embedding", "vec_id", 0)
    wanted = rows.where("label = 3").select(F.col("vec_id").alias("id"))
    got = _index(spark, rows).search(spark, query, 1_000_000, probes=1, where=wanted, iterative="relaxed_order", max_scan_tuples=2**31 - 1)
    return got.orderBy("distance", "id").withColumnRenamed("id", "vec_id")


@CATALOG.add("ivf_recall_full", "SELECT 20 AS probes, 1.0::DOUBLE AS recall")
def ivf_recall_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all lists read the recall is one."""
    return _recall(spark, sf_dir, 20)


@CATALOG.add("ivf_recall")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 by number of lists read, over all stored vectors as queries."""
    return _recall(spark, sf_dir, 1, 5, 10, 20)


def _recall(spark: SparkSession, sf_dir: str, *probes: int) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = _index(spark, rows)
    queries = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    truth = written(knn.batch(rows, queries, K, "l2", "embedding", "vec_id"), "truth")
    got = [(p, knn.recall(index.search_batch(spark, queries, K, p), truth, K)) for p in probes]
    return spark.createDataFrame(got, "probes int, recall double")


@CATALOG.add("ivf_iterative", f"{_WITH_Q} SELECT vec_id, {SQL_METRICS['l2']('v', 'q')} AS distance FROM e WHERE label = 3")
def ivf_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows asked for than pass the filter: the scan must go on until it has found each of them."""
    rows = vectors(spark, sf_dir)
    query = knn.stored_vector(rows, "embedding", "vec_id", 0)
    wanted = rows.where("label = 3").select(F.col("vec_id").alias("id"))
    got = _index(spark, rows).search(spark, query, 1_000_000, probes=1, where=wanted, iterative="strict_order", max_scan_tuples=2**31 - 1)
    return got.withColumnRenamed("id", "vec_id")


def _lsm(spark: SparkSession, rows: DataFrame) -> LsmIndex:
    """Half of the labels at the start, the rest inserted, one label deleted, one written again."""
    at = lambda c: rows.where(c)
    index = LsmIndex.create(at("label < 5"), fresh_path(spark, "lsm"), "embedding", "vec_id", lists=10)
    index.insert(at("label >= 5"), "late", "embedding", "vec_id")
    index.insert(at("label >= 5"), "late", "embedding", "vec_id")  # the same batch again is no insert
    index.delete(at("label = 3"), "vec_id")
    index.upsert(at("label = 7"), "again", "embedding", "vec_id")
    return index


@CATALOG.add("lsm_insert_delete", _topk_sql(SQL_METRICS["l2"]("v", "q"), "label <> 3"))
def lsm_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    query = knn.stored_vector(rows, "embedding", "vec_id", 0)
    return _lsm(spark, rows).search(query, K, probes=10).withColumnRenamed("id", "vec_id")


@CATALOG.add("lsm_compact", "SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE label <> 3 GROUP BY label")
def lsm_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = _lsm(spark, rows)
    index.flush()
    index.compact()
    index.vacuum()
    live = index.rows().join(rows.select("vec_id", "label"), F.col("id") == F.col("vec_id"))
    return live.groupBy("label").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@CATALOG.add("lsm_generation", "SELECT 'same' AS readers, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE label <> 3")
def lsm_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reader of the writer's generation sees the same rows, also after the writer has moved on."""
    index = _lsm(spark, vectors(spark, sf_dir))
    reader = LsmIndex(spark, index.path, index.state.generation)
    before = index.rows()
    index.delete(before.limit(5))
    same = reader.rows().select("id").exceptAll(before.select("id")).isEmpty()
    return reader.rows().agg(F.count("*").alias("n")).select(F.lit("same" if same else "different").alias("readers"), "n")


@CATALOG.add("sliding_window", "SELECT vec_id FROM embeddings WHERE label >= 8")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = LsmIndex.create(rows.where("label < 2"), fresh_path(spark, "lsm"), "embedding", "vec_id", lists=10)
    for label in range(2, 10):
        new = rows.where(F.col("label") == label).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        slide(index, new, rows.where(F.col("label") == label - 2).select(F.col("vec_id").alias("id")), f"step-{label}")
    return index.rows().select(F.col("id").alias("vec_id"))


@CATALOG.add("stream_ingest", _topk_sql(SQL_METRICS["l2"]("v", "q")))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    index = LsmIndex.create(rows.limit(0), fresh_path(spark, "lsm"), "embedding", "vec_id", lists=1)
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/embeddings.parquet*")
    ingest(stream, index.path, fresh_path(spark, "stream"), "embedding", "vec_id").awaitTermination()
    query = knn.stored_vector(rows, "embedding", "vec_id", 0)
    return LsmIndex(spark, index.path).search(query, K).withColumnRenamed("id", "vec_id")


# --- relational surface -----------------------------------------------------------------------------------------------


def _add_sql(name: str, sql: str) -> None:
    """A query in plain SQL that both engines read alike; views are made of the tables it names."""

    @CATALOG.add(name, sql)
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: table(spark, sf_dir, t) for t in TABLES if t in sql}
        text = sql
        for t, df in views.items():
            df.createOrReplaceTempView(f"nearfield_{t}")
        return spark.sql(_renamed(text, views))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def _renamed(sql: str, views) -> str:
    import re

    return re.sub(rf"\b({'|'.join(views)})\b(?!\.)", lambda m: f"nearfield_{m[1]}", sql)


_add_sql("join_inner", "SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_add_sql("join_left", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_add_sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add_sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add_sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add_sql("rollup_orders", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_add_sql("cube_orders", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_add_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_add_sql("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running FROM orders")
_add_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_add_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
_add_sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier")
_add_sql("cte_subquery", "WITH big AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT o_custkey, m FROM big WHERE m > (SELECT avg(o_totalprice) FROM orders)")
_add_sql("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
_add_sql("filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24")
_add_sql("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")


@CATALOG.add(
    "avg_vector_from_columns",
    "SELECT l_returnflag, round(avg(l_quantity::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) AS q, round(avg(l_discount::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) AS d, round(avg(l_tax::FLOAT::DOUBLE)::FLOAT::DOUBLE, 3) AS t FROM lineitem GROUP BY l_returnflag",
)
def avg_vector_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", casts.array_to_vector(F.array("l_quantity", "l_discount", "l_tax")).alias("v"))
    got = aggregates.vec_avg(rows, "v", ["l_returnflag"])
    at = lambda k: F.round(F.col("avg")[k].cast("double"), 3)
    return got.select("l_returnflag", at(0).alias("q"), at(1).alias("d"), at(2).alias("t"))


@CATALOG.add(
    "events_tumbling",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "1 hour", ["event_type"])
    start = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("w.start"))
    return got.select(start.alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

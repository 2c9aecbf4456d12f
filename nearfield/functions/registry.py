"""Session SQL functions. Their bodies are SQL, so Catalyst inlines them into the plan; text and binary forms are Arrow functions.

halfvec shares the representation of vector, so functions without rounding serve both; what rounds has a ``halfvec_`` form.
Errors are those of the Column functions: unequal dimensions, overflow, underflow of a product, limits of the types.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import textio
from ..types import SPARSE_DDL, SPARSE_MAX_NNZ, VECTOR_MAX_DIM

_V, _S = "ARRAY<FLOAT>", SPARSE_DDL.upper()


def _fail(bad: str, message: str, body: str, kind: str) -> str:
    return f"CASE WHEN {bad} THEN CAST(raise_error({message}) AS {kind}) ELSE {body} END"


def _dims(body: str, what: str = "vector dimensions", size: str = "size({})", kind: str = "DOUBLE") -> str:
    a, b = size.format("a"), size.format("b")
    return _fail(f"{a} <> {b}", f"concat('different {what} ', {a}, ' and ', {b})", body, kind)


def _acc(f: str) -> str:
    return f"aggregate(zip_with(a, b, (x, y) -> {f}), 0D, (s, x) -> s + x)"


_L2 = _acc("(double(x) - double(y)) * (double(x) - double(y))")
_IP = _acc("double(x) * double(y)")
_L1 = _acc("abs(double(x) - double(y))")
_SQ = "aggregate({}, 0D, (s, x) -> s + double(x) * double(x))"


def _cosine(dot: str, na: str, nb: str) -> str:
    return f"CASE WHEN {na} * {nb} = 0 THEN double('NaN') ELSE 1 - greatest(-1D, least(1D, {dot} / sqrt({na} * {nb}))) END"


def _sparse(f: str) -> str:
    both = (
        "map_zip_with(map_from_arrays(a.indices, a.values), map_from_arrays(b.indices, b.values), "
        "(k, x, y) -> named_struct('x', coalesce(double(x), 0D), 'y', coalesce(double(y), 0D)))"
    )
    return f"aggregate(array_sort(map_entries({both})), 0D, (s, e) -> s + {f.format(x='e.value.x', y='e.value.y')})"


_SL2, _SIP, _SL1 = _sparse("({x} - {y}) * ({x} - {y})"), _sparse("{x} * {y}"), _sparse("abs({x} - {y})")
_SD = lambda body: _dims(body, "sparsevec dimensions", "{}.dim")
_WORDS = "transform(sequence(0, greatest(int(ceil(length({v}) / 60)), 1) - 1), k -> bigint(conv(coalesce(nullif(substring({v}, k * 60 + 1, 60), ''), '0'), 2, 10)))"
_BITS = "aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x {op} y)), 0, (s, x) -> s + x)"
_bit = lambda op: _BITS.format(a=_WORDS.format(v="a"), b=_WORDS.format(v="b"), op=op)

_INF = "float('Infinity')"
_FINITE = f"WHEN exists(r, z -> abs(z) = {_INF}) THEN CAST(raise_error('value out of range: overflow') AS {_V})"
_LOST = (
    "WHEN exists(zip_with(zip_with(a, b, (x, y) -> x <> 0 AND y <> 0), r, (f, z) -> f AND z = 0), w -> w) "
    f"THEN CAST(raise_error('value out of range: underflow') AS {_V})"
)


def _half(v: str) -> str:
    """Elements rounded to half precision, as in :func:`dense.half_element`."""
    unit = "pow(2D, greatest(CASE WHEN d = 0 THEN -14D ELSE double(floor(log2(CASE WHEN d = 0 THEN 1D ELSE abs(double(d)) END))) END, -14D) + 42)"
    return (
        f"transform({v}, d -> CASE WHEN abs(d) >= 65520 THEN CAST(raise_error(concat('\"', string(double(d)), '\" is out of range for type halfvec')) AS FLOAT) "
        f"ELSE float(signum(double(d)) * ((abs(double(d)) + {unit}) - {unit})) END)"
    )


def _elementwise(op: str, half: bool = False) -> str:
    """An operation on equal places, checked for equal length, overflow and (products) underflow."""
    over = _FINITE + (f" WHEN exists(r, z -> abs(z) >= 65520) THEN CAST(raise_error('value out of range: overflow') AS {_V})" if half else "")
    made = f"zip_with(a, b, (x, y) -> float(x {op} y))"
    kept = _half("r") if half else "r"
    lost = f"CASE {_LOST} ELSE r END" if op == "*" else "r"
    body = f"transform(transform(array({made}), r -> CASE {over} ELSE {kept} END), r -> {lost})[0]"
    return _dims(body, kind=_V)


def _checked(body: str, kind: str, dim: str = "dim") -> str:
    """Limits of a dense type; ``dim`` -1: any dimension."""
    tests = (
        ("exists(r, z -> z IS NULL)", "'array must not contain nulls'"), ("exists(r, z -> isnan(z))", f"'NaN not allowed in {kind}'"),
        (f"exists(r, z -> abs(z) = {_INF})", f"'infinite value not allowed in {kind}'"), ("size(r) < 1", f"'{kind} must have at least 1 dimension'"),
        (f"size(r) > {VECTOR_MAX_DIM}", f"'{kind} cannot have more than {VECTOR_MAX_DIM} dimensions'"),
        (f"{dim} >= 0 AND size(r) <> {dim}", f"concat('expected ', {dim}, ' dimensions, not ', size(r))"),
    )
    cases = " ".join(f"WHEN {bad} THEN CAST(raise_error({message}) AS {_V})" for bad, message in tests)
    return f"transform(array({body}), r -> CASE WHEN r IS NULL THEN r {cases} ELSE r END)[0]"


def _to_sparse(v: str) -> str:
    entries = f"filter(zip_with(sequence(0, size({v}) - 1), {v}, (i, x) -> named_struct('i', i, 'x', x)), e -> e.x <> 0)"
    made = f"named_struct('dim', size({v}), 'indices', transform({entries}, e -> e.i), 'values', transform({entries}, e -> e.x))"
    over = f"size(filter({v}, e -> e <> 0)) > {SPARSE_MAX_NNZ}"
    return f"CASE WHEN {v} IS NOT NULL THEN {_fail(over, f"'sparsevec cannot have more than {SPARSE_MAX_NNZ} non-zero elements'", f'CAST({made} AS {_S})', _S)} END"


_TO_DENSE = _fail(
    f"a.dim > {VECTOR_MAX_DIM}", f"'vector cannot have more than {VECTOR_MAX_DIM} dimensions'",
    "transform(sequence(0, a.dim - 1), k -> coalesce(try_element_at(map_from_arrays(a.indices, a.values), k), float(0)))", _V,
)
_SPARSE_CMP = (
    "coalesce(get(transform(filter(array_sort(map_entries(map_zip_with(map_from_arrays(a.indices, a.values), map_from_arrays(b.indices, b.values), "
    "(k, x, y) -> named_struct('x', coalesce(x, float(0)), 'y', coalesce(y, float(0)))))), e -> e.value.x <> e.value.y AND e.key < least(a.dim, b.dim)), "
    "e -> CASE WHEN e.value.x < e.value.y THEN -1 ELSE 1 END), 0), CASE WHEN a.dim < b.dim THEN -1 WHEN a.dim > b.dim THEN 1 ELSE 0 END)"
)
_LOW, _HIGH = "greatest(bigint(start), 1L)", "least(bigint(start) + count - 1, bigint(size(a)))"
_SUBVECTOR = _fail(
    f"{_HIGH} < {_LOW}", "'vector must have at least 1 dimension'", f"slice(a, int(least({_LOW}, bigint(size(a)) + 1)), int(greatest({_HIGH} - {_LOW} + 1, 0L)))", _V
)
_CONCAT = _fail(f"size(a) + size(b) > {VECTOR_MAX_DIM}", f"'vector cannot have more than {VECTOR_MAX_DIM} dimensions'", "concat(a, b)", _V)
_UNIT = "zip_with({v}, array_repeat({n}, size({v})), (z, n) -> float(CASE WHEN n > 0 THEN double(z) / n ELSE 0D END))"
_NORM, _SNORM = f"sqrt({_SQ.format('a')})", f"sqrt({_SQ.format('a.values')})"
_NORMALIZED = f"transform(array({_UNIT.format(v='a', n=_NORM)}), r -> CASE {_FINITE} ELSE r END)[0]"
_COMPARE = {"lt": "<", "le": "<=", "eq": "=", "ne": "<>", "ge": ">=", "gt": ">"}

#: name -> (arguments, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "l2_distance": (f"a {_V}, b {_V}", "DOUBLE", _dims(f"sqrt({_L2})")),
    "l2_squared_distance": (f"a {_V}, b {_V}", "DOUBLE", _dims(_L2)),
    "inner_product": (f"a {_V}, b {_V}", "DOUBLE", _dims(_IP)),
    "negative_inner_product": (f"a {_V}, b {_V}", "DOUBLE", _dims(f"-({_IP})")),
    "cosine_distance": (f"a {_V}, b {_V}", "DOUBLE", _dims(_cosine(_IP, _SQ.format("a"), _SQ.format("b")))),
    "l1_distance": (f"a {_V}, b {_V}", "DOUBLE", _dims(_L1)),
    "spherical_distance": (f"a {_V}, b {_V}", "DOUBLE", _dims(f"acos(greatest(-1D, least(1D, {_IP}))) / pi()")),
    "vector_dims": (f"a {_V}", "INT", "CASE WHEN a IS NOT NULL THEN size(a) END"),
    "vector_norm": (f"a {_V}", "DOUBLE", f"sqrt({_SQ.format('a')})"),
    "l2_norm": (f"a {_V}", "DOUBLE", _NORM),
    "l2_normalize": (f"a {_V}", _V, _NORMALIZED),
    "halfvec_l2_normalize": (f"a {_V}", _V, _half(_NORMALIZED)),
    "binary_quantize": (f"a {_V}", "STRING", "array_join(transform(a, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"),
    "subvector": (f"a {_V}, start INT, count INT", _V, _SUBVECTOR),
    "vector_cmp": (f"a {_V}, b {_V}", "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    "vector_concat": (f"a {_V}, b {_V}", _V, _CONCAT),
    "vector_add": (f"a {_V}, b {_V}", _V, _elementwise("+")),
    "vector_sub": (f"a {_V}, b {_V}", _V, _elementwise("-")),
    "vector_mul": (f"a {_V}, b {_V}", _V, _elementwise("*")),
    "halfvec_add": (f"a {_V}, b {_V}", _V, _elementwise("+", True)),
    "halfvec_sub": (f"a {_V}, b {_V}", _V, _elementwise("-", True)),
    "halfvec_mul": (f"a {_V}, b {_V}", _V, _elementwise("*", True)),
    "halfvec_concat": (f"a {_V}, b {_V}", _V, _CONCAT),
    "vector": (f"a {_V}, dim INT", _V, _checked("a", "vector")),
    "halfvec": (f"a {_V}, dim INT", _V, _checked("a", "halfvec")),
    "sparsevec": (f"a {_S}, dim INT", _S, _fail("a.dim <> dim", "concat('expected ', dim, ' dimensions, not ', a.dim)", "a", _S)),
    "array_to_vector": ("a ARRAY<DOUBLE>, dim INT", _V, _checked("transform(a, x -> float(x))", "vector")),
    "array_to_halfvec": ("a ARRAY<DOUBLE>, dim INT", _V, _checked(_half("transform(a, x -> float(x))"), "halfvec")),
    "array_to_sparsevec": ("a ARRAY<DOUBLE>, dim INT", _S, f"transform(array({_checked('transform(a, x -> float(x))', 'sparsevec')}), v -> {_to_sparse('v')})[0]"),
    "vector_to_halfvec": (f"a {_V}, dim INT", _V, _checked(_half("a"), "halfvec")),
    "halfvec_to_vector": (f"a {_V}, dim INT", _V, _checked("a", "vector")),
    "vector_to_float4": (f"a {_V}", _V, "a"),
    "halfvec_to_float4": (f"a {_V}", _V, "a"),
    "vector_to_sparsevec": (f"a {_V}", _S, _to_sparse("a")),
    "halfvec_to_sparsevec": (f"a {_V}", _S, _to_sparse("a")),
    "sparsevec_to_vector": (f"a {_S}", _V, _TO_DENSE),
    "sparsevec_to_halfvec": (f"a {_S}", _V, _half(_TO_DENSE)),
    "sparsevec_l2_distance": (f"a {_S}, b {_S}", "DOUBLE", _SD(f"sqrt({_SL2})")),
    "sparsevec_inner_product": (f"a {_S}, b {_S}", "DOUBLE", _SD(_SIP)),
    "sparsevec_l1_distance": (f"a {_S}, b {_S}", "DOUBLE", _SD(_SL1)),
    "sparsevec_cosine_distance": (f"a {_S}, b {_S}", "DOUBLE", _SD(_cosine(_SIP, _SQ.format("a.values"), _SQ.format("b.values")))),
    "sparsevec_l2_squared_distance": (f"a {_S}, b {_S}", "DOUBLE", _SD(_SL2)),
    "sparsevec_negative_inner_product": (f"a {_S}, b {_S}", "DOUBLE", _SD(f"-({_SIP})")),
    "sparsevec_l2_norm": (f"a {_S}", "DOUBLE", _SNORM),
    "sparsevec_l2_normalize": (
        f"a {_S}", _S,
        f"CASE WHEN a IS NOT NULL THEN transform(array(filter(zip_with(a.indices, {_UNIT.format(v='a.values', n=_SNORM)}, (i, x) -> named_struct('i', i, 'x', x)), e -> e.x <> 0)), "
        f"k -> CAST(named_struct('dim', a.dim, 'indices', transform(k, e -> e.i), 'values', transform(k, e -> e.x)) AS {_S}))[0] END",
    ),
    "sparsevec_cmp": (f"a {_S}, b {_S}", "INT", f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {_SPARSE_CMP} END"),
    "hamming_distance": ("a STRING, b STRING", "DOUBLE", _dims(f"double({_bit('^')})", "bit lengths", "length({})")),
    "jaccard_distance": (
        "a STRING, b STRING", "DOUBLE", _dims(f"CASE WHEN {_bit('&')} = 0 THEN 1D ELSE 1 - {_bit('&')} / {_bit('|')} END", "bit lengths", "length({})")
    ),
}
for _name, _op in _COMPARE.items():
    FUNCTIONS[f"vector_{_name}"] = (f"a {_V}, b {_V}", "BOOLEAN", f"a {_op} b")
    FUNCTIONS[f"sparsevec_{_name}"] = (f"a {_S}, b {_S}", "BOOLEAN", f"{FUNCTIONS['sparsevec_cmp'][2]} {_op} 0")
for _name in ("l2_squared_distance", "negative_inner_product", "spherical_distance"):
    FUNCTIONS[f"vector_{_name}"] = FUNCTIONS[f"halfvec_{_name}"] = FUNCTIONS[_name]
for _name in ("cmp", *_COMPARE):
    FUNCTIONS[f"halfvec_{_name}"] = FUNCTIONS[f"vector_{_name}"]


def register(spark: SparkSession) -> None:
    """Make all functions known to the session."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, f in textio.sql_functions().items():
        spark.udf.register(name, f)

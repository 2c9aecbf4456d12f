import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import bits, casts, dense, sparse, textio
from nearfield.functions.registry import FUNCTIONS, register
from nearfield.functions.sqlrewrite import translate, vector_sql
from nearfield.types import type_modifier


def vec(*x):
    return F.array(*[F.lit(float(v)).cast("float") for v in x]).cast("array<float>")


def sp(text):
    v = textio.parse_sparse(text)
    return sparse.sparse(v["dim"], F.array(*map(F.lit, v["indices"])).cast("array<int>"), F.array(*map(F.lit, v["values"])).cast("array<float>"))


@pytest.fixture(scope="module")
def value(spark):
    def get(*cols):
        row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).head()
        return row[0] if len(cols) == 1 else tuple(row)

    return get


def fails(value, col, text):
    with pytest.raises(Exception, match=text):
        value(col)


def test_dense_distances(value):
    got = value(
        dense.l2_distance(vec(0, 0), vec(3, 4)), dense.l2_squared_distance(vec(0, 0), vec(3, 4)), dense.inner_product(vec(1, 2), vec(3, 4)),
        dense.negative_inner_product(vec(1, 2), vec(3, 4)), dense.cosine_distance(vec(1, 2), vec(2, 4)), dense.cosine_distance(vec(1, 1), vec(-1, -1)),
        dense.l1_distance(vec(0, 0), vec(3, 4)), dense.spherical_distance(vec(1, 0), vec(0, 1)), dense.l2_distance(vec(3e38), vec(-3e38), float32=True),
    )
    assert got == (5, 25, 11, -11, 0, 2, 7, 0.5, math.inf)
    assert math.isnan(value(dense.cosine_distance(vec(1, 2), vec(0, 0))))
    none = F.lit(None).cast("array<float>")
    assert value(*[f(none, vec(1)) for f in (dense.l2_distance, dense.inner_product, dense.cosine_distance, dense.l1_distance)]) == (None,) * 4
    for f in (dense.l2_distance, dense.inner_product, dense.cosine_distance, dense.l1_distance):
        fails(value, f(vec(1, 2), vec(3)), "different vector dimensions 2 and 1")


def test_arithmetic_and_shape(value):
    assert value(dense.vector_add(vec(1, 2, 3), vec(4, 5, 6))) == [5, 7, 9]
    assert value(dense.vector_sub(vec(1, 2, 3), vec(4, 5, 6))) == [-3, -3, -3]
    assert value(dense.vector_mul(vec(1, 2, 3), vec(4, 5, 6))) == [4, 10, 18]
    assert value(dense.vector_concat(vec(1), vec(2, 3))) == [1, 2, 3]
    fails(value, dense.vector_add(vec(3e38), vec(3e38)), "overflow")
    fails(value, dense.vector_mul(vec(1e37), vec(1e37)), "overflow")
    fails(value, dense.vector_mul(vec(1e-37), vec(1e-37)), "underflow")
    fails(value, dense.vector_add(vec(1, 2), vec(3)), "different vector dimensions")
    assert value(dense.vector_dims(vec(1, 2)), dense.vector_norm(vec(3, 4))) == (2, 5)
    assert value(dense.l2_normalize(vec(3, 4))) == pytest.approx([0.6, 0.8]) and value(dense.l2_normalize(vec(0, 0))) == [0, 0]
    assert value(dense.binary_quantize(vec(1, 0, -1))) == "100"
    five = vec(1, 2, 3, 4, 5)
    assert value(*[dense.subvector(five, a, n) for a, n in ((1, 3), (3, 2), (-1, 3), (3, 9))]) == ([1, 2, 3], [3, 4], [1], [3, 4, 5])
    for a, n in ((1, 0), (3, -1), (-1, 2), (6, 1)):
        fails(value, dense.subvector(five, a, n), "at least 1 dimension")


def test_comparison(value):
    pairs = [((1, 2, 3), (1, 2)), ((1, 2), (1, 2, 3)), ((1, 2), (1, 2)), ((1, 3), (2,)), ((-0.0,), (0.0,))]
    want = [1, -1, 0, -1, 0]
    for (a, b), w in zip(pairs, want):
        got = value(dense.vector_cmp(vec(*a), vec(*b)), *[f(vec(*a), vec(*b)) for f in (dense.vector_lt, dense.vector_le, dense.vector_eq, dense.vector_ne, dense.vector_ge, dense.vector_gt)])
        assert got == (w, w < 0, w <= 0, w == 0, w != 0, w >= 0, w > 0)


def test_half_rounding_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 10.0 ** rng.integers(-9, 4, 2000)), np.arange(0, 66, 0.25), [65504, 65519, -65519, 6e-8, 2.9e-8, 1e-9, 0.1, 2049, 2051]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", dense.half_element(F.col("x").cast("float")).alias("h"))
    for r in df.collect():
        assert r.h == float(np.float16(np.float32(r.x))), r.x


def test_half_limits(value):
    assert value(dense.to_half(vec(65519, -65519))) == [65504, -65504]
    fails(value, dense.to_half(vec(65520)), "out of range for type halfvec")
    assert value(dense.vector_add(vec(2048), vec(1), half=True)) == [2048]
    fails(value, dense.vector_add(vec(65504), vec(65504), half=True), "overflow")


def test_bits(value):
    b = F.lit
    assert value(bits.hamming_distance(b("111"), b("100")), bits.hamming_distance(b("1" * 130), b("0" * 130))) == (2, 130)
    assert value(bits.jaccard_distance(b("1111"), b("1110")), bits.jaccard_distance(b("1111"), b("0000")), bits.jaccard_distance(b(""), b(""))) == (0.25, 1, 1)
    fails(value, bits.hamming_distance(b("111"), b("00")), "different bit lengths 3 and 2")


def test_sparse(value):
    a, b = sp("{1:1,3:3,5:5,7:7}/8"), sp("{2:2,4:4,6:6,8:8}/8")
    assert value(sparse.l1_distance(a, b), sparse.inner_product(a, b), sparse.l2_squared_distance(a, b)) == (36, 0, 204)
    assert value(sparse.l2_distance(sp("{1:3}/2"), sp("{2:4}/2")), sparse.l2_norm(sp("{1:3,2:4}/2")), sparse.cosine_distance(sp("{1:1}/2"), sp("{1:2}/2"))) == (5, 5, 0)
    assert math.isnan(value(sparse.cosine_distance(sp("{1:1}/2"), sp("{}/2"))))
    fails(value, sparse.l2_distance(sp("{1:1}/2"), sp("{1:1}/3")), "different sparsevec dimensions 2 and 3")
    assert value(sparse.to_dense(sp("{2:5}/3"))) == [0, 5, 0]
    assert value(sparse.from_dense(vec(0, 2, 0))).asDict() == {"dim": 3, "indices": [1], "values": [2]}
    got = value(sparse.l2_normalize(sp("{1:3,2:4}/2")))
    assert got["values"] == pytest.approx([0.6, 0.8])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([-1.0, 0.0, 0.0, 2.0]), min_size=1, max_size=4), st.lists(st.sampled_from([-1.0, 0.0, 0.0, 2.0]), min_size=1, max_size=4))
def test_sparse_comparison_equals_dense(spark, a, b):
    x, y = sparse.from_dense(vec(*a)), sparse.from_dense(vec(*b))
    got = spark.range(1).select(sparse.sparsevec_cmp(x, y).alias("c"), (sparse.sort_key(x) < sparse.sort_key(y)).alias("lt")).head()
    want = (a > b) - (a < b)
    assert got.c == want
    if len(a) == len(b):
        assert got.lt == (want < 0)


def test_sparse_arguments_are_computed_once_a_row(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    x, y = sparse.from_dense(F.reverse("a")), sparse.from_dense(F.reverse("b"))
    once = rows.select(x.alias("c"))._jdf.queryExecution().analyzed().toString().count("reverse(")
    for f, n in ((sparse.sparsevec_lt, 2), (sparse.sparsevec_ge, 2), (sparse.cosine_distance, 2), (lambda x, y: sparse.to_dense(x), 1)):
        plan = rows.select(f(x, y).alias("c"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("reverse(") == n * once
    for _ in range(3):  # Python functions take what is computed so
        assert rows.select(textio.sparsevec_out(sparse.from_dense(F.transform("a", lambda v: v + 1))).alias("t")).head().t == "{1:2,2:1}/2"


def test_kinds_agree_on_small_integers(spark):
    rng = random.Random(1)
    rows = [([float(rng.randrange(-2, 2)) for _ in range(5)], [float(rng.randrange(-2, 2)) for _ in range(5)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    sa, sb, ha, hb = sparse.from_dense("a"), sparse.from_dense("b"), dense.to_half("a"), dense.to_half("b")
    names = ("l2_distance", "inner_product", "cosine_distance", "l1_distance")
    cols = [c for n in names for c in (getattr(dense, n)("a", "b"), getattr(sparse, n)(sa, sb), getattr(dense, n)(ha, hb))]
    for r in df.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect():
        for k in range(0, len(cols), 3):
            assert all(x == pytest.approx(r[k], nan_ok=True) for x in r[k : k + 3])


def test_casts(value):
    assert value(casts.array_to_vector(F.array(F.lit(1), F.lit(2)))) == [1, 2]
    assert value(casts.array_to_vector(F.array(F.lit(1e-46)))) == [0]
    fails(value, casts.array_to_vector(F.array(F.lit(4e38))), "infinite value not allowed in vector")
    fails(value, casts.array_to_vector(F.array(F.lit(float("nan")))), "NaN not allowed in vector")
    fails(value, casts.array_to_vector(F.array(F.lit(1.0), F.lit(None).cast("double"))), "must not contain nulls")
    fails(value, casts.array_to_vector(F.array().cast("array<double>")), "at least 1 dimension")
    fails(value, casts.array_to_vector(F.array(F.lit(1.0)), 2), "expected 2 dimensions, not 1")
    fails(value, casts.array_to_half(F.array(F.lit(65520.0))), "out of range for type halfvec")
    assert value(casts.array_to_sparse(F.array(F.lit(0), F.lit(3)))).asDict() == {"dim": 2, "indices": [1], "values": [3]}
    assert value(casts.sparse_to_half(sp("{1:0.1}/2"))) == [float(np.float16(0.1)), 0]
    assert value(casts.vector_to_half(vec(0.1))) == [float(np.float16(0.1))]
    fails(value, casts.sparse_to_sparse(sp("{1:1}/2"), 3), "expected 3 dimensions, not 2")
    for bad in (0, 16001):
        with pytest.raises(ValueError):
            type_modifier(bad)


@pytest.mark.parametrize("text", ["[1,2,3]", " [ 1 , 2.5e1, -3 ] ", "[.5]", "[1.]", "[1e-46]"])
def test_vector_text(text):
    assert textio.parse_dense(text) == [float(np.float32(x)) for x in text.strip(" []").replace(" ", "").split(",")]


@pytest.mark.parametrize(
    "text,error",
    [("", "invalid"), ("[", "invalid"), ("[]", "at least 1"), ("[1,]", "invalid"), ("[1", "invalid"), ("1]", "invalid"), ("[1a]", "invalid"), ("[1,,2]", "invalid"), ("[hello]", "invalid"),
     ("[nan]", "NaN"), ("[inf]", "infinite"), ("[4e38]", "out of range"), ("[1] x", "invalid"), ("[[1]]", "invalid")],
)
def test_vector_text_errors(text, error):
    with pytest.raises(ValueError, match=error):
        textio.parse_dense(text)


def test_sparse_text():
    for a, b in {"{1:0,2:1,3:0}/3": "{2:1}/3", "{2:1,1:1}/2": "{1:1,2:1}/2", " { 1 : 1.5 } / 5 ": "{1:1.5}/5", "{}/5": "{}/5"}.items():
        assert textio.format_sparse(textio.parse_sparse(a)) == b
    for bad, error in {"{1:1,1:1}/2": "duplicates", "{0:1}/1": "out of bounds", "{2:1}/1": "out of bounds", "{1:1}/0": "at least 1", "{1:1}": "invalid", "{1:1e-46}/1": "out of range", "{1:nan}/1": "NaN", "{1:1,}/2": "invalid", "{1:1}/1000000001": "cannot have more"}.items():
        with pytest.raises(ValueError, match=error):
            textio.parse_sparse(bad)


@settings(max_examples=200, deadline=None)
@given(st.text("[]{}:/,.0123456789e+- anif", max_size=12))
def test_fuzzed_literals_parse_or_name_the_type(text):
    for parse, kind in ((textio.parse_dense, "vector"), (lambda t: textio.parse_dense(t, "halfvec"), "halfvec"), (textio.parse_sparse, "sparsevec")):
        try:
            parse(text)
        except ValueError as e:
            assert kind in str(e)


def test_shortest_numbers():
    want = {1.0: "1", 0.1: "0.1", 1e10: "1e+10", 1e-5: "1e-05", 100000.0: "100000", 1e6: "1e+06", 0.0001: "0.0001", -2.5: "-2.5", 1234567.0: "1.234567e+06"}
    assert {x: textio.shortest(x) for x in want} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), min_size=1, max_size=5))
def test_text_and_binary_round_trips(x):
    x = [float(np.float32(v)) for v in x]
    assert textio.parse_dense(textio.format_dense(x)) == x
    assert textio.unpack_dense(textio.pack_dense(x)) == x
    v = {"dim": len(x), "indices": [k for k, e in enumerate(x) if e], "values": [e for e in x if e]}
    assert textio.unpack_sparse(textio.pack_sparse(v)) == v


def test_text_functions_on_columns(spark):
    df = spark.createDataFrame([("[1,2]", "{1:2}/3"), (None, None)], "v string, s string")
    got = df.select(textio.vector_out(textio.vector_in("v")).alias("v"), textio.sparsevec_out(textio.sparsevec_in("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("[1,2]", "{1:2}/3"), (None, None)]


def test_sql_functions(spark):
    register(spark)
    a, b = "array(float(1), float(2))", "array(float(2), float(4))"
    for name, f in (("l2_distance", dense.l2_distance), ("inner_product", dense.inner_product), ("cosine_distance", dense.cosine_distance), ("l1_distance", dense.l1_distance), ("vector_add", dense.vector_add), ("vector_cmp", dense.vector_cmp)):
        assert spark.sql(f"SELECT {name}({a}, {b})").head()[0] == spark.range(1).select(f(vec(1, 2), vec(2, 4))).head()[0]
    assert spark.sql("SELECT l2_normalize(array(float(3), float(4)))").head()[0] == pytest.approx([0.6, 0.8])
    assert spark.sql("SELECT hamming_distance('111', '100'), jaccard_distance('1111', '1110')").head()[:] == (2.0, 0.25)
    s = "named_struct('dim', 3, 'indices', array({}), 'values', array(float({})))"
    assert spark.sql(f"SELECT sparsevec_l1_distance({s.format(0, 2)}, {s.format(1, 3)})").head()[0] == 5
    with pytest.raises(Exception, match="different vector dimensions 2 and 1"):
        spark.sql(f"SELECT l2_distance({a}, array(float(1)))").collect()
    assert len(FUNCTIONS) > 20


def test_operator_translation(spark):
    assert translate("SELECT a <-> b FROM t") == "SELECT l2_distance(a, b) FROM t"
    assert translate("WHERE v<#>q < 1 + 2") == "WHERE negative_inner_product(v, q) < 1 + 2"
    assert translate("ORDER BY f(v, (x)) <+> '[1,2]'::vector LIMIT 5") == "ORDER BY l1_distance(f(v, (x)), array(float('1.0'), float('2.0'))) LIMIT 5"
    assert translate("SELECT '<->' , a <~> b <-- c\n") != "" and "'<->'" in translate("SELECT '<->' , a <%> b")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None)], "id int, v array<float>").createOrReplaceTempView("vt")
    got = vector_sql(spark, "SELECT id, 1 - (v <=> '[1,2]') AS s FROM vt WHERE v <-> '[1,2]' < 5 AND id > 0 ORDER BY v <-> '[1,2]'").collect()
    assert [r.id for r in got] == [1, 2] and got[0].s == pytest.approx(1)
    with pytest.raises(ValueError, match="lacks an operand"):
        translate("SELECT <-> b")

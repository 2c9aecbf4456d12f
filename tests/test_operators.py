import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import dense, sparse
from nearfield.operators import aggregates, blocks, knn
from nearfield.operators.ivf import IvfIndex, option
from nearfield.operators.lsm import LsmIndex
from nearfield.sources import vecfiles
from nearfield.streaming.ingest import ingest, slide, tumbling


def frame(spark, n=400, dim=3, seed=1):
    rng = random.Random(seed)
    rows = [(k, [rng.random() for _ in range(dim)], k % 10) for k in range(n)]
    return spark.createDataFrame(rows, "id long, vector array<float>, c int").repartition(4), rows


def ids(df):
    return [r.id for r in df.collect()]


# --- aggregates -------------------------------------------------------------------------------------------------------


def test_averages_and_sums(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [3.0, 5.0, 7.0]), (1, None), (2, None)], "g int, v array<float>")
    assert {r.g: r.avg for r in aggregates.vec_avg(df, "v", ["g"]).collect()} == {1: [2.0, 3.5, 5.0], 2: None}
    assert aggregates.vec_sum(df, "v").head()["sum"] == [4, 7, 10]
    assert aggregates.vec_avg(df.limit(0), "v", ["g"]).count() == 0
    with pytest.raises(Exception, match="different vector dimensions"):
        aggregates.vec_avg(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<float>"), "v").collect()
    big = spark.createDataFrame([([3e38],), ([3e38],)], "v array<float>")
    with pytest.raises(Exception, match="overflow"):
        aggregates.vec_sum(big, "v").collect()
    assert aggregates.vec_avg(big, "v").head()["avg"][0] == pytest.approx(3e38, rel=1e-6)
    half = spark.createDataFrame([([2048.0],), ([1.0],), ([1.0],)], "v array<float>")
    assert aggregates.vec_sum(half, "v", half=True).head()["sum"] == [2050]


def test_average_is_partial_before_the_shuffle(spark):
    df, _ = frame(spark)
    plan = aggregates.vec_avg(df, "vector", ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan


# --- nearest neighbours -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_batch_equals_single_queries(spark, metric):
    df, rows = frame(spark)
    queries = df.where("id < 5")
    got = knn.batch(df, queries, 7, metric, exclude_self=False).collect()
    for q in range(5):
        want = knn.exact(df, "vector", rows[q][1], 7, metric).collect()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.id for r in mine] == [r.id for r in want]
        assert [r.distance for r in mine] == pytest.approx([r.distance for r in want], rel=1e-6, abs=1e-7)
    alone = knn.batch(df, queries, 3, metric, exclude_self=True).collect()
    assert all(r.query_id != r.id for r in alone) and len(alone) == 15


def test_batch_in_several_blocks(spark, monkeypatch):
    df, _ = frame(spark, 100)
    want = sorted(map(tuple, knn.batch(df, df, 4).collect()))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 700)
    assert sorted(map(tuple, knn.batch(df, df, 4).collect())) == want
    assert knn.batch(df, df.limit(0), 4).count() == 0


def test_exact_filters_first_and_puts_nulls_last(spark):
    df, rows = frame(spark, 50)
    df = df.union(spark.createDataFrame([(99, None, 3)], df.schema))
    got = knn.exact(df, "vector", [0.0, 0.0, 0.0], 10, where=F.col("c") == 3).collect()
    assert len(got) == 6 and all(r.c == 3 for r in got) and got[-1].id == 99 and got[-1].distance is None
    assert ids(knn.nearest_to_row(df, "vector", 7, 3))[0] != 7
    assert knn.nearest_to_row(df, "vector", 12345, 3).count() == 0
    near = knn.within(df, "vector", rows[0][1], 0.3).collect()
    assert all(r.distance < 0.3 for r in near) and 0 in {r.id for r in near}


def test_single_queries_push_down(spark, tmp_path):
    df, _ = frame(spark)
    df.write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    plan = knn.exact(rows, "vector", [0.0, 0.0, 0.0], 5, where=F.col("c") == 3).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(c,3)" in plan and "Exchange" not in plan


def test_similarity_join_in_blocks(spark):
    df, rows = frame(spark, 60)
    want = {(a[0], b[0]) for a in rows for b in rows if np.linalg.norm(np.float32(a[1]) - np.float32(b[1])) < 0.2}
    for lists in (64, 3):
        got = knn.similarity_join(df, df, 0.2, lists=lists).collect()
        assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)


def test_rerank_and_fusion(spark):
    df, rows = frame(spark, 80, dim=8)
    centred = df.withColumn("vector", F.transform("vector", lambda x: (x - 0.5).cast("float")))
    query = [x - 0.5 for x in rows[3][1]]
    assert ids(knn.rerank_binary(centred, "vector", query, 5, 80))[0] == 3
    assert ids(knn.rerank_subvector(centred, "vector", query, 1, 4, 5, 80)) == ids(knn.exact(centred, "vector", query, 5, "cosine"))
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.score for r in knn.reciprocal_rank_fusion([a, b]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


# --- inverted lists ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_ivf_reads_a_few_lists_and_all_give_the_exact_rows(spark, tmp_path, metric):
    df, rows = frame(spark, 1500)
    index = IvfIndex.build(df, str(tmp_path / metric), metric=metric, lists=20)
    index = IvfIndex.load(spark, str(tmp_path / metric))
    queries = df.where("id < 20").select("id", "vector")
    truth = knn.batch(df, queries, 10, metric)
    if metric == "cosine":  # the index holds unit vectors, whose last bits differ
        truth = truth.withColumn("distance", F.col("distance") + 1e-6)
    got = {p: knn.recall(index.search_batch(spark, queries, 10, p), truth, 10) for p in (1, 5, 20)}
    assert got[1] < got[20] and got[5] >= 0.8 and got[20] >= 0.999
    found = index.search(spark, rows[0][1], 10, probes=20)
    assert ids(found) == ids(knn.exact(df, "vector", rows[0][1], 10, metric))


def test_ivf_prunes_partitions(spark, tmp_path):
    df, rows = frame(spark)
    index = IvfIndex.build(df, str(tmp_path / "i"), lists=10)
    plan = index.search(spark, rows[0][1], 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan


def test_ivf_iterates_until_the_limit_is_met(spark, tmp_path):
    df, rows = frame(spark, 1000)
    index = IvfIndex.build(df, str(tmp_path / "i"), lists=30)
    wanted = df.where("id % 100 = 0").select("id")
    assert index.search(spark, rows[1][1], 10, probes=1, where=wanted).count() < 10
    for mode in ("relaxed_order", "strict_order"):
        got = index.search(spark, rows[1][1], 11, probes=1, where=wanted, iterative=mode).collect()
        assert {r.id for r in got} == set(range(0, 1000, 100))
        assert mode == "relaxed_order" or [r.distance for r in got] == sorted(r.distance for r in got)
    assert index.search(spark, rows[1][1], 11, probes=1, where=wanted, iterative="strict_order", max_probes=2).count() < 10
    with pytest.raises(ValueError):
        index.search(spark, rows[1][1], 1, iterative="sometimes")


def test_ivf_other_kinds(spark, tmp_path):
    rng = random.Random(5)
    bits = spark.createDataFrame([(k, "".join(rng.choice("01") for _ in range(16))) for k in range(300)], "id long, vector string")
    index = IvfIndex.build(bits, str(tmp_path / "b"), metric="hamming", kind="bit", lists=5)
    q = bits.where("id = 3").head().vector
    assert ids(index.search(spark, q, 8, probes=5)) == ids(knn.exact(bits, "vector", q, 8, "hamming"))
    df, rows = frame(spark, 200, 6)
    sp = df.select("id", sparse.from_dense("vector").alias("vector"))
    index = IvfIndex.build(sp, str(tmp_path / "s"), metric="l2", kind="sparsevec", lists=5)
    q = sp.where("id = 3").head().vector.asDict()
    assert ids(index.search(spark, q, 5, probes=5)) == ids(knn.exact(df, "vector", rows[3][1], 5))
    half = df.select("id", dense.to_half("vector").alias("vector"))
    index = IvfIndex.build(half, str(tmp_path / "h"), kind="halfvec", lists=5)
    assert ids(index.search(spark, rows[3][1], 5, probes=5))[0] == 3


def test_ivf_degenerate_inputs(spark, tmp_path):
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(20)] + [(30, None), (31, [0.0, 0.0])], "id long, vector array<float>")
    index = IvfIndex.build(same, str(tmp_path / "a"), metric="cosine", lists=10)
    assert index.rows(spark).count() == 20
    assert ids(index.search(spark, [1.0, 1.0], 3)) == [0, 1, 2]
    empty = IvfIndex.build(same.limit(0), str(tmp_path / "b"), lists=10)
    assert empty.centres == []
    with pytest.raises(ValueError, match="ef_construction"):
        IvfIndex.build(same, str(tmp_path / "c"), m=64, ef_construction=64)
    with pytest.raises(ValueError, match="operator class"):
        IvfIndex.build(same, str(tmp_path / "d"), metric="jaccard")
    for name, bad in (("lists", 0), ("lists", 32769), ("probes", 0), ("ef_search", 2001), ("m", 1)):
        with pytest.raises(ValueError, match=name):
            option(name, bad)


def test_partial_index_and_settings(spark, tmp_path):
    df, rows = frame(spark)
    index = IvfIndex.build(df, str(tmp_path / "p"), lists=5, where=F.col("c") == 2)
    assert index.rows(spark).count() == 40
    spark.conf.set("spark.nearfield.probes", "3")
    try:
        assert index.probes_for(spark, None, None) == 3 and index.probes_for(spark, 1, None) == 1
    finally:
        spark.conf.unset("spark.nearfield.probes")


# --- life of an index -------------------------------------------------------------------------------------------------


def test_lsm_life(spark, tmp_path):
    df, rows = frame(spark, 300)
    path = str(tmp_path / "lsm")
    index = LsmIndex.create(df.where("id < 100"), path, lists=5)
    assert index.insert(df.where("id between 100 and 199"), "one") and not index.insert(df.where("id between 100 and 199"), "one")
    assert index.rows().count() == 200
    index.delete(df.where("id % 10 = 0").select("id"))
    assert index.rows().count() == 180
    index.insert(df.where("id = 10"), "back")  # an id that was deleted may come again
    live = {r.id for r in index.rows().collect()}
    assert live == {k for k in range(200) if k % 10} | {10}
    moved = df.where("id = 11").withColumn("vector", F.array(*[F.lit(9.0).cast("float")] * 3))
    index.upsert(moved, "moved")
    assert ids(index.search([9.0, 9.0, 9.0], 1)) == [11] and index.rows().where("id = 11").count() == 1
    before = sorted(map(str, index.rows().collect()))
    reader = LsmIndex(spark, path)
    index.flush()
    assert index.state.deltas == [] and sorted(map(str, index.rows().collect())) == before
    assert index.compact() >= 1 and len(index.state.segments) == 1
    assert sorted(map(str, index.rows().collect())) == before
    index.vacuum()
    assert index.state.tombstones == [] and sorted(map(str, index.rows().collect())) == before
    assert sorted(map(str, reader.rows().collect())) == before  # a reader keeps its generation
    again = LsmIndex(spark, path)
    assert again.state == index.state and again.insert(df.limit(1), "one") is False
    with pytest.raises(RuntimeError, match="another writer"):
        reader.delete(df.limit(1))


def test_lsm_search_equals_exact_with_all_lists(spark, tmp_path):
    df, rows = frame(spark, 200)
    index = LsmIndex.create(df.where("id < 150"), str(tmp_path / "l"), lists=4)
    index.insert(df.where("id >= 150"))
    index.delete(df.where("c = 3"))
    want = ids(knn.exact(df, "vector", rows[3][1], 12, where=F.col("c") != 3))
    assert ids(index.search(rows[3][1], 12, probes=4)) == want


def test_lsm_from_an_empty_table(spark, tmp_path):
    df, rows = frame(spark, 20)
    index = LsmIndex.create(df.limit(0), str(tmp_path / "e"))
    assert index.search(rows[0][1], 3).count() == 0
    index.insert(df)
    index.flush()
    assert ids(index.search(rows[0][1], 1)) == [0]


def test_merge_policy(spark, tmp_path):
    df, _ = frame(spark, 20)
    index = LsmIndex.create(df, str(tmp_path / "m"), lists=2)
    seg = lambda k, n, flat=False: {"path": index.state.segments[0]["path"], "first": k, "last": k, "rows": n, "flat": flat}
    plan = lambda *s: (setattr(index.state, "segments", list(s)), index.plan())[1]
    assert plan(seg(0, 10)) is None
    assert plan(seg(0, 1_500_000), seg(1, 1_500_000, True))[0] == "rebuild"
    what, segs = plan(seg(0, 900_000), seg(1, 40_000), seg(2, 700_000))
    assert what == "merge" and [s["rows"] for s in segs] == [40_000, 700_000]
    assert plan(seg(0, 1_200_000), seg(1, 1_100_000)) is None


def test_stream_into_an_index(spark, tmp_path):
    df, rows = frame(spark, 60)
    src, path, check = (str(tmp_path / n) for n in ("src", "idx", "check"))
    LsmIndex.create(df.limit(0), path)
    df.where("id < 30").write.parquet(src)
    for part in (None, "id >= 30"):
        if part:
            df.where(part).write.mode("append").parquet(src)
        ingest(spark.readStream.schema(df.schema).parquet(src), path, check).awaitTermination()
    ingest(spark.readStream.schema(df.schema).parquet(src), path, check).awaitTermination()  # nothing new
    assert LsmIndex(spark, path).rows().count() == 60


def test_tumbling_windows_with_late_rows(spark):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "t string, k string, value double").withColumn("ts", F.to_timestamp("t"))
    got = sorted((r.w.start.hour, r.n, r.total) for r in tumbling(df, "1 hour", ["k"], late="10 minutes").collect())
    assert [g[1:] for g in got] == [(2, 3.0), (1, 4.0)]


# --- files ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["fvecs", "bvecs", "ivecs", "fbin", "bbin"])
def test_vector_files(spark, tmp_path, fmt):
    x = np.arange(60).reshape(20, 3) % 50
    path = str(tmp_path / f"x.{fmt}")
    with open(path, "wb") as f:
        f.write(vecfiles.encode(x, fmt))
    got = {r.id: r.vector for r in vecfiles.read_vectors(spark, path).collect()}
    assert got == {k: row for k, row in enumerate(x.tolist())}
    if fmt in vecfiles.PER_VECTOR:
        split = vecfiles.read_vectors(spark, path, dim=3)
        assert {r.id: r.vector for r in split.collect()} == got
    out = str(tmp_path / f"y.{fmt}")
    vecfiles.write_vectors(vecfiles.read_vectors(spark, path), out, fmt)
    assert open(out, "rb").read() == open(path, "rb").read()


def test_broken_vector_files():
    with pytest.raises(ValueError, match="whole vectors"):
        vecfiles.decode(b"\x03\x00\x00\x00abc", "fvecs")
    ids_, dist = vecfiles.read_ground_truth(np.array([2, 1, 7, 8], "<i4").tobytes() + np.array([0.5, 1.5], "<f4").tobytes())
    assert ids_.tolist() == [[7], [8]] and dist.tolist() == [[0.5], [1.5]]


def test_batch_ties_go_to_smaller_ids(spark, monkeypatch):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(100)], "id long, vector array<float>").repartition(4)
    for block in (knn.BLOCK_BYTES, 300):  # with small blocks: several passes
        monkeypatch.setattr(knn, "BLOCK_BYTES", block)
        got = knn.batch(df, df, 10).collect()
        by_query = {}
        for r in got:
            by_query.setdefault(r.query_id, []).append((r["rank"], r.id))
        assert len(by_query) == 100 and all([i for _, i in sorted(v)] == list(range(10)) for v in by_query.values())


def test_slide_is_one_commit(spark, tmp_path):
    df, rows = frame(spark, 40)
    index = LsmIndex.create(df.where("id < 20"), f"file://{tmp_path}/i", lists=2)
    new, old = df.where("id >= 20"), df.where("id < 10").select("id")
    crashed = LsmIndex(spark, index.path)
    crashed._commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        slide(crashed, new, old, "s#1")
    again = LsmIndex(spark, index.path)
    assert sorted(ids(again.rows())) == list(range(20))
    assert slide(again, new, old, "s#1") and not slide(LsmIndex(spark, index.path), new, old, "s#1")
    assert sorted(ids(LsmIndex(spark, index.path).rows())) == list(range(10, 40))
    again.insert(df.where("id = 30").withColumn("vector", F.expr("transform(vector, x -> float(x + 9))")), "s#2")
    far = [x + 9 for x in rows[30][1]]
    best = again.search(far, 1, probes=2).head()
    assert best.id == 30 and best.distance < 1e-5 and again.rows().count() == 30
    for k in range(3, 6):
        again.insert(df.limit(0), f"s#{k}")
    assert again.state.batches == [] and again.state.streams == {"s": 5}


@pytest.mark.parametrize("fmt", ["fvecs", "fbin"])
def test_vector_files_of_a_folder_have_ids_of_their_own(spark, tmp_path, fmt):
    df, rows = frame(spark, 50)
    folder = f"file://{tmp_path}/out"
    assert vecfiles.write_vector_files(df, folder, fmt) == 50
    got = {r.id: r.vector for r in vecfiles.read_vectors(spark, folder, fmt).collect()}
    assert sorted(got) == list(range(50)) and all(np.allclose(got[k], rows[k][1]) for k in got)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_batch_search_of_lists_is_no_join_of_pairs(spark, tmp_path, monkeypatch, metric):
    df, rows = frame(spark, 300)
    index = IvfIndex.build(df, str(tmp_path / "i"), metric=metric, lists=6)
    queries = df.where("id < 12").select("id", "vector")
    assert "Join" not in index.search_batch(spark, queries, 5, 2)._jdf.queryExecution().optimizedPlan().toString()
    for block in (knn.BLOCK_BYTES, 300):  # with small blocks: several passes
        monkeypatch.setattr(knn, "BLOCK_BYTES", block)
        got = index.search_batch(spark, queries, 5, 2).collect()
        for q in range(12):
            want = index.search(spark, rows[q][1], 5, probes=2).collect()
            mine = sorted((r["rank"], r.id, r.distance) for r in got if r.query_id == q)
            assert [m[1] for m in mine] == [r.id for r in want]
            assert [m[2] for m in mine] == pytest.approx([r.distance for r in want], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_similarity_join_is_no_join_of_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=(90, 5)) + np.where(np.arange(90) % 3 == 0, 1000, 0)[:, None])
    x[7], x[11] = x[5], 0
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id long, vector array<float>")
    radius = {"l2": 1.5, "ip": 0.5, "cosine": 0.3, "l1": 2.5}[metric]
    far = knn.METRICS[metric](F.col("a.vector"), F.col("b.vector"))
    want = df.alias("a").join(df.alias("b"), far < radius).select("a.id", "b.id", far).collect()
    for block in (knn.BLOCK_BYTES, 900):
        monkeypatch.setattr(knn, "BLOCK_BYTES", block)
        got = knn.similarity_join(df, df, radius, metric, lists=4)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_batch_meets_equal_vectors_once(spark, monkeypatch):
    df = spark.createDataFrame([(k, [float(k % 2), float(k % 3)]) for k in range(120)], "id long, vector array<float>").repartition(3)
    sizes, real = [], blocks.query_blocks
    monkeypatch.setattr(blocks, "query_blocks", lambda *a: (sizes.append(b.num_rows) or b for b in real(*a)))
    got = knn.batch(df, df, 25).collect()
    assert sizes == [6] and len(got) == 120 * 25
    for q in (0, 5, 119):
        want = sorted((((k % 2 - q % 2) ** 2 + (k % 3 - q % 3) ** 2) ** 0.5, k) for k in range(120))[:25]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_blocks_agree_with_distances_in_order():
    rng = np.random.default_rng(5)
    for metric in blocks.METRICS:
        for shift, scale in ((0, 1), (1e4, 1), (0, 1e17), (0, 1e-21)):
            x = np.float32((rng.integers(0, 3, (500, 4)) + shift) * scale).astype(np.float64)
            nearest = blocks.Nearest(blocks.Block(metric, x[:40]), 6)
            for at in range(0, 500, 120):
                nearest.meet(np.arange(500)[at : at + 120], x[at : at + 120])
            of, own, d = nearest.found()
            for q in range(40):
                all_d = blocks.pair_distances(metric, np.repeat(x[q : q + 1], 500, axis=0), x)
                assert own[of == q].tolist() == np.lexsort((np.arange(500), all_d))[:6].tolist()

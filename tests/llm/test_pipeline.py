import random

import pytest
from nearfield.llm.bpe import load
from nearfield.llm.queries import BYTE_BPE

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, a shared passage and leaks, and clean ones."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = {k: prose(200) for k in range(120)}
    for k in range(0, 60, 2):
        texts[k] += " you stupid zzidiot"
    near = texts[71].split()
    near[100] = "edited"
    passage, item = prose(60), prose(30)
    texts |= {200: texts[71], 201: " ".join(near), 202: f"{prose(80)} {passage} {prose(80)}", 203: f"{prose(90)} {passage} {prose(70)}"}
    texts |= {204: f"{prose(100)} {item} {prose(50)}", 205: None, 206: ""}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()] + [(None, prose(60), "en", "s", 1)]
    base = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    labels = [(k, 1, int(k < 60 and k % 2 == 0)) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, texts, passage


def test_stages_take_out_what_they_should(spark, folder):
    base, texts, passage = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    every = set(texts) | {None}
    toxic = {k for k in range(0, 60, 2)}
    assert set(seen["toxicity"]) == every - toxic
    kept = set(seen["near-dedup"])
    assert every - toxic - kept == {200, 201, 206}
    cut = seen["substring dedup"]
    assert set(cut) == kept and passage in cut[202] and passage not in cut[203]
    assert {k for k in cut if cut[k] != texts.get(k) and k is not None} == {203}
    assert kept - set(seen["decontamination"]) == {204}


def test_run_encodes_what_is_left(spark, folder):
    base, texts, _ = folder
    rows = corpus_pipeline.run(spark, base).collect()
    tok = load(BYTE_BPE)
    assert len({r.doc_id for r in rows}) == len(rows) == 60 + 30 + 3 + 1
    for r in rows:
        assert r.n_tokens * 4 == len(r.ids)
        if r.doc_id in texts and r.doc_id != 203:
            assert tok.decode_packed(bytes(r.ids)) == (texts[r.doc_id] or "")


def test_repeats_are_cut_from_rows_whose_id_is_null_or_repeated(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9))) for _ in range(n))
    one, two = prose(60), prose(70)
    texts = [f"{prose(80)} {one} {prose(80)}", f"{prose(90)} {one}", f"{prose(300)} {two}", "aa " + prose(9), f"{prose(30)} {two}"]
    rows = [(k, t, "en", "s", len(t)) for k, t in zip([1, None, 5, 5, None], texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted((r.doc_id or 0, len(r.text.split()), one in r.text, two in r.text) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect())
    rest = {g[:2] for g in got if g[2] or g[3]}
    assert len(got) == 5 and [g[0] for g in got] == [0, 0, 1, 5, 5] and (1, 220) in rest and len(rest) == 2
    assert (5, 10) in {g[:2] for g in got} and (0, 90) in {g[:2] for g in got}

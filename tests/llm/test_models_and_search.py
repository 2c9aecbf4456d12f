import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import langid, quality, topk, toxicity
from nearfield.llm.sampling import balanced

# --- quality ----------------------------------------------------------------------------------------------------------


def slow_model(texts, order=4):
    """Interpolated modified Kneser-Ney over UTF-16 units, with dictionaries."""
    grams = Counter()
    for t in texts:
        if t:
            u = [0] * (order - 1) + np.frombuffer(t.encode("utf-16-le"), "<u2").tolist() + [1]
            grams.update(tuple(u[i : i + order]) for i in range(len(u) - order + 1))
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    floor = 1 / (len(tables[1]) + 1)

    def discounts(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3))]

    ds = {n: discounts(c) for n, c in tables.items()}
    total, weight = {}, {}
    for n, c in tables.items():
        for g, v in c.items():
            total[n, g[:-1]] = total.get((n, g[:-1]), 0) + v
            weight[n, g[:-1]] = weight.get((n, g[:-1]), 0) + ds[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return floor
        c, t = tables[n].get(g, 0), total.get((n, g[:-1]))
        if not t:
            return p(g[1:])
        return (max(c - ds[n][min(c, 3) - 1], 0) if c else 0) / t + weight[n, g[:-1]] / t * p(g[1:])

    def perplexity(t):
        u = [0] * (order - 1) + np.frombuffer(t.encode("utf-16-le"), "<u2").tolist() + [1]
        logs = [math.log(p(tuple(u[i : i + order]))) for i in range(len(u) - order + 1)]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "é 😀 ü the", "aaaa aaaa aaaa"]


@pytest.mark.parametrize("entries", [10**6, 60])
def test_perplexity_against_dictionaries(spark, entries):
    docs = [*TEXTS, "the cat", "zzz qqq", "x", "", None]
    model = quality.train(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    rows = spark.createDataFrame([(k, "en", t) for k, t in enumerate(docs)], "id long, lang string, text string")
    got = {r.id: r for r in quality.perplexities(rows, model, entries).collect()}
    slow = slow_model(TEXTS)
    for k, t in enumerate(docs):
        if t:
            assert math.exp(-got[k].lp / got[k].units) == pytest.approx(slow(t), rel=1e-9)
        else:
            assert got[k].units == 0


def test_quality_keeps_and_rejects(spark):
    rng = random.Random(1)
    words = {"en": "the and of to in that it was for on".split(), "de": "der die und das nicht ist ein zu von mit".split()}
    good = [(k, " ".join(rng.choices(words["en" if k % 2 else "de"], k=60)), "en" if k % 2 else "de") for k in range(80)]
    bad = [(100 + k, "".join(rng.choices("#$%&*@!~^", k=200)), "en") for k in range(5)]
    odd = [(200, None, "en"), (201, "", None), (202, good[0][1], None), (203, good[0][1], "xx"), (None, good[0][1], "de"), (1, good[1][1], "en")]
    docs = spark.createDataFrame([(*r, "c") for r in good + bad + odd], "doc_id long, text string, lang string, keep string").repartition(4)
    trusted = spark.createDataFrame([(k,) for k in range(60)] + [(None,)], "doc_id long")
    got = quality.classify(docs, trusted).collect()
    assert len(got) == len(good + bad + odd)
    kept = {r.id for r in got if r.keep}
    assert not kept & {r[0] for r in bad} and {200, 201, 202, 203, None} <= kept
    assert sum(r.keep for r in got if r.id is not None and r.id < 80) >= 72  # 15 held-out texts a language set the limit
    none = quality.classify(docs, trusted.limit(0)).collect()
    assert all(r.keep and r.perplexity is None for r in none)
    assert quality.classify(docs.limit(0), trusted).count() == 0


# --- language ---------------------------------------------------------------------------------------------------------


def language_rows(n=240):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "hijklmnop", "cc": "äöüßrst"}
    rows = []
    for k in range(n):
        lang = ["aa", "aa", "bb", "cc"][k % 4]
        rows.append((k, " ".join("".join(rng.choices(alphabets[lang], k=rng.randrange(2, 9))) for _ in range(30)), lang))
    return rows


def test_language_id(spark):
    rows = language_rows()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "abc" * 300_000, "aa"), (None, rows[0][1], "aa"), (904, rows[3][1], None), (0, rows[0][1], "aa")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double").repartition(4)
    model = langid.train(docs.where("doc_id % 3 > 0"), sample_rows=60)
    assert model.labels == ["aa", "bb", "cc"] and model.rows == 160
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows + odd)
    by = {r.id: r for r in got}
    assert all(by[k].lang_pred == lang for k, _, lang in rows)
    assert [by[k].lang_pred for k in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "aa", "aa", "cc"]
    assert all(0 <= r.score <= 1 for r in got)
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_features_of_long_texts_do_not_depend_on_slices(monkeypatch):
    text = "abc déf " * 400
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_STEP", 97)
    cut = langid.features(text)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_ftrl_is_sparse_and_temperature_helps():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(200):
        y = k % 2
        ids = np.sort(rng.choice(np.arange(2, 500), 5, replace=False))
        rows.append((np.concatenate([[y], ids]), np.ones(6), y))
    w = langid.ftrl(rows, 2, 3, 0.5, 1.0, 1.0, 0.1, 1)
    assert (w == 0).mean() > 0.99 and w[0, 0] > 0 > w[0, 1]
    z = np.array([[4.0, -4.0]] * 8 + [[-4.0, 4.0]] * 2)
    assert langid.temperature(z, np.zeros(10, int)) > 1.5


def test_balanced_sample(spark):
    df = spark.createDataFrame([(k, "rare" if k % 50 == 0 else "usual") for k in range(5000)], "id long, label string")
    sample, sizes = balanced(df, "id", "label", 100)
    n = Counter(r.label for r in sample.collect())
    assert sizes == {"rare": 100, "usual": 4900} and sum(n.values()) == 100 and n["rare"] > 25


# --- toxicity ---------------------------------------------------------------------------------------------------------


def test_grammar_contexts():
    m = toxicity.ToxicityModel()
    score = lambda t: sum(m.clauses(t))
    plain = score("an idiot")
    assert plain == toxicity.PRIOR_WEIGHT
    assert score("you idiot") > plain > score("he wrote idiot") > score("he wrote not idiot") > 0
    assert score("not a real idiot") < plain == score("not at all here now an idiot") == score("no. idiot")
    assert score("we kill time") == 0 < score("you we kill") == score("we will kill you") == plain
    assert score("we kill you") == score("kill it") == 0 and score("I will never kill you") < plain
    assert score("he said he will kill them") == score("you: he said idiot") / 1.25 == plain / 2 and score("a total utter idiot") > plain
    assert score("idiot, moron") == 2 * plain and len(m.clauses("idiot! moron")) == 2
    assert m.clauses(None) == m.clauses("") == m.clauses("fine words") == []
    assert m.score("") == m.score(None) < 0.5


def test_composition_is_that_of_the_parts():
    g = toxicity.grammar()
    rng = random.Random(1)
    parts = [toxicity.insults(), toxicity.threats(), toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.scoring()]
    for _ in range(200):
        word = [rng.choice(toxicity._READ) for _ in range(12)]
        state, factors = g.start, []
        for s in word:
            state, _, f = g.arcs[state, s]
            factors.append(f)
        tape, weights = word, [1.0] * 12
        for p in parts:
            state, out = p.start, []
            for k, s in enumerate(tape):
                state, o, f = p.arcs[state, s]
                out.append(o)
                weights[k] *= f
            tape = out
        assert factors == pytest.approx(weights)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(["zulk", "xorpen" + word(), "xorpen" + word()])
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(toxic)))
    odd = [(900, None), (901, ""), (None, "zulk"), (0, rows[0][1]), (902, "a zulk " + "b " * 200_000)]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows + odd], "doc_id long, text string, score double").repartition(4)
    truth = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, truth)
    assert "zulk" in model.lexicon and any(e.startswith("xor") for e in model.lexicon)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows + odd)
    by = {r.id: r for r in got}
    assert all(by[k].predicted == t for k, t in labels)
    assert by[902].predicted == by[None].predicted == 1 and by[900].predicted == by[901].predicted == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.id for r in got if not r.predicted}
    bare = toxicity.train(docs, truth.limit(0))
    assert bare.lexicon == {} and toxicity.score(docs.limit(0), bare).count() == 0


# --- top-k ------------------------------------------------------------------------------------------------------------


def slow_topk(rows, queries, k):
    out = []
    for i, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [topk.BROADCAST_BYTES, 0])
def test_topk_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(3)
    rows = [(k, [rng.choice([-3, 0, 1, 2]) for _ in range(6)]) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 360)]  # many equal vectors
    df = spark.createDataFrame([(*r, 1) for r in [*rows, (900, None), (None, rows[0][1])]], "id long, vector array<long>, score int").repartition(5)
    got = topk.exact_topk(df, df.where("id % 25 = 0"), 10).collect()
    queries = [r for r in rows if r[0] % 25 == 0]
    assert sorted(map(tuple, got)) == slow_topk(rows, queries, 10)
    few = df.where("id < 4")
    assert sorted(map(tuple, topk.exact_topk(few, few, 10).collect())) == slow_topk(rows[:4], rows[:4], 10)
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    x = np.rint(rng.pareto(0.5, (3000, 3)) * 4).clip(0, 2**19).astype(np.int64)
    ids = rng.permutation(3000)
    q = np.array([[5, 1, 0], [-2, 3, 1]])
    got = [(i, list(zip(w.tolist(), s.tolist()))) for i, w, s in topk.nra_block(q, np.array([-1, int(ids[5])]), x, ids, 7)]
    for i, best in got:
        s = x @ q[i]
        want = sorted(((-int(v), int(j)) for v, j in zip(s, ids) if not (i == 1 and j == ids[5])))[:7]
        assert best == [(j, -v) for v, j in want]


def test_quantised_leaves_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, [0.5, -0.0001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [])], "id long, v array<float>")
    got = {r.id: r.q for r in df.select("id", topk.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}

import hashlib
import itertools
import random
import time

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm import bpe, chat, components, decontaminate, simhash, substrings, urlfilter
from nearfield.llm.words import WordIds, gram_runs, grams

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- BPE --------------------------------------------------------------------------------------------------------------

LIBRARY, OWN = Tokenizer.from_file(PATH), bpe.BpeTokenizer(PATH, cache_size=50)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_bpe_equals_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "<|endoftext|>" * 3, " \n\t x", "don't we'll", "\x85\xa0\u3000x", "é" * 3000, "x" * 5000])
def test_bpe_cases(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.decode(OWN.encode(text)) == text


def test_bpe_every_code_point():
    for at in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(at, at + 64))
        assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_frame(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, "x"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode_decode(df, PATH)).collect()
    assert len(got) == 4
    by = {r.doc_id: r for r in got}
    ids = LIBRARY.encode("hello world", add_special_tokens=False).ids
    assert by[1].n_tokens == 2 and by[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert by[None].n_tokens == 0 and by[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


# --- URL filters ------------------------------------------------------------------------------------------------------


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    tail = rest[n:]
    path = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    _, rule, verdict = max(fit)
    return host, path, rule, verdict


def test_url_filters_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["org", "a.org", "b.a.org", "x.com", "com", "A.Org", ".org", "org.", "", "xorg", "a.org:80"]
    paths = ["", "/", "/e", "/es/", "/es/1", "/en/12", "/\u00e9/\U0010ffff", "/en/1?x=/es/", "?q", "#/es/", "/es/\u00ff"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a?b://org/es/"]
    rules = [("org", "/", "allow"), ("a.org", "/es/", "block"), ("a.org", "/es/1", "allow"), ("com", "", "block"), ("org", "/e", "block"), ("x.com", "/en/1", "allow")]
    rows = [(k, rng.choice(urls), "z") for k in range(300)] + [(None, u, "z") for u in urls]
    pages = spark.createDataFrame(rows, "page_id long, url string, stack string").repartition(5)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urlfilter.judge(pages, table).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(k, *judge(u, rules)) for k, u, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    empty = urlfilter.judge(pages, table.limit(0)).collect()
    assert len(empty) == len(rows) and {r.verdict for r in empty} == {"allow"} and all(r.rule is None for r in empty)
    assert urlfilter.judge(pages.limit(0), table).count() == 0


def test_url_filters_stay_in_the_jvm(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")
    plan = urlfilter.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- chat -------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<|turn|>", "<", "|", "text|>", "[INST]", "</s>", "a", "\n", "[", "/"]), max_size=12).map("".join))
def test_chat_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)
    assert chat.parse_turn(chat.format_turn(text, text))[:2] == (text, text)


def test_chat_prefix_tree(spark):
    first = "same start"
    convs = {1: [("user", first), ("assistant", "one")], 2: [("user", first), ("assistant", "two"), ("user", "x")], 3: [("user", first), ("assistant", "one")]}
    convs[4] = [("system", "</s>[INST] \\"), ("assistant", ""), ("assistant", "é😀")]
    convs[5] = [("user", first)]
    rows = [(c, t, r, x, "e") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rows += [(6, None, None, None, "e"), (6, 1, "user", None, "e")]
    convs[6] = [("", ""), ("user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, idx string").repartition(3)
    packs = chat.format_conversations(df).collect()
    text, at = {}, {}
    for r in sorted(packs, key=lambda r: (r.pack, r.place, r.idx)):
        assert r.ends or r.start == len(text.get(r.pack, ""))
        text[r.pack] = text.get(r.pack, "") + r.content
    for r in packs:  # a segment's ancestors are exactly the turns before it, and its position their length
        path = "".join(text[r.pack][a.start : a.stop] for a in r.ancestors)
        turns = [chat.format_turn(*x) for x in convs[r.conv_id][: r.idx]]
        assert path == "".join(turns) and r.position == len(path)
    emitted = [r.content for r in packs if not r.ends]
    assert len(emitted) <= len({tuple(t[: k + 1]) for t in convs.values() for k in range(len(t))}) + 4  # again per partition
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c, turns in convs.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.format_turn(*t)) for t in turns)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    small = chat.read_back(chat.format_conversations(df, pack_chars=10, shared_turns=1)).collect()
    assert {tuple(r) for r in small} == {tuple(r) for r in got.values()}


# --- SimHash ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "a b c", "É É a B", *(prose(rng, n, 30) for n in (4, 5, 9, 70))]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(prose(rng, 70_000, 50)) >= 0  # more than one block


def classes(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_simhash_components_against_all_pairs(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(12):
        words = prose(rng, 200, 500).split()
        for edits in (0, 0, 1, 1, 2, 4, 8):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit"
            rows.append((k, " ".join(w), "e"))
            k += 1
    rows += [(900, None, "e"), (901, "", "e"), (901, "", "e"), (None, "x", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    prints = {i: slow_fingerprint(t) for i, t, _ in rows if i is not None}
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert len(got) == len(rows) - 1
    assert {r.id: r.component_id for r in got} == want
    assert {r.id: r.fp % 2**64 for r in got} == prints
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_heavy_keys_are_cut_into_cells(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 3, 5, 9]))) for _ in range(400)})
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, id long"), 4, chunk=16)
    found = {r.id: r.component for r in components.connected_components(edges).collect()}
    want = classes(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {k: found.get(k, k) for k in range(len(prints))} == want


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(0)
    for n in (10, 10**5, 10**8):
        p = rng.random(64)
        plan = simhash.make_plan(n, p * n, np.outer(p, p) * n, 4)
        assert sorted(b for part in plan.parts for b in part) == list(range(64))
        assert sum(plan.thresholds) == 4 - len(plan.parts) + 1 and min(plan.thresholds) >= -1


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(11)
    rows, k = [], 0
    for _ in range(15):
        words = prose(rng, 150, 3000).split()
        for edits in (0, 0, 1, 2, 3, 5, 9):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((k, " ".join(w), "en", "s", 1))
            k += 1
    rows += [(500, None, None, None, None), (501, "", None, None, None), (502, "short", None, None, None), (503, "short", None, None, None), (None, "x", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    table = WordIds()
    sets = {i: set(simhash.shingle_set(table.of(t)[0], 5).tolist()) for i, t, *_ in rows if i is not None}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = classes(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    found = {r.id: r.component_id for r in simhash.similar_documents(df).collect()}
    got = {i: found.get(i, i) for i in sets}
    assert all(want[i] == want[got[i]] for i in sets)  # no false link
    assert sum(got[i] != want[i] for i in sets) <= 2  # at similarity 0.8 some two percent may be missed
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_similar_documents_in_cells(spark):
    rng = random.Random(2)
    words = prose(rng, 300, 3000).split()
    rows = []
    for k in range(120):
        w = list(words)
        w[rng.randrange(300)] = f"e{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "id long, text string")
    fps = df.rdd.map(lambda r: (r[0], simhash.wide_fingerprint(simhash.shingle_set(WordIds().of(r[1])[0], 5)).tobytes()))
    fps = spark.createDataFrame(fps.map(lambda r: (r[0], bytearray(r[1]), 0)), "id long, fp binary, label long")
    pairs = simhash.similar_pairs(fps, simhash.wide_plan(fps, 0.8, 0.02), 0.8, chunk=8).select(F.col("a").alias("u"), F.col("b").alias("v"))
    assert {r.component for r in components.connected_components(pairs).collect()} == {0}


def test_thinning_to_a_forest_loses_no_similar_pair(spark):
    """Versions of one text whose similarities lie around the limit: a forest's links often fail, the others must be found."""
    rng, rows = random.Random(31), []
    base = prose(rng, 260, 9000).split()
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(260), rng.choice([4, 5, 6, 7])):
            w[at] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "x"))
    rows += [(200, "?! ...", "x"), (201, "--", "x"), (202, "--", "x"), (203, None, "x"), (204, "", "x")]
    table = WordIds()
    sets = {i: set(simhash.shingle_set(table.of(t)[0], 5).tolist()) for i, t, _ in rows[:150]}
    want = classes(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    found = {r.id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert {i: found.get(i, i) for i in sets} == want and len(set(want.values())) > 1
    assert {i: found[i] for i in found if i >= 200} == {201: 201, 202: 201, 203: 203, 204: 203}


# --- components -------------------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- substrings -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 12))
def test_compact_windows_cover_each_subsequence_once(values, least):
    h = np.array(values, np.uint64)
    windows = substrings.compact_windows(h, least)
    for i in range(len(values)):
        for j in range(i + least - 1, len(values)):
            inside = [c for low, c, high in windows if low <= i <= c <= j <= high]
            assert len(inside) == 1 and h[inside[0]] == h[i : j + 1].min()


def test_windows_of_many_texts_equal_those_of_each_tree():
    rng, least = np.random.default_rng(9), 12
    texts = [rng.integers(0, k, n).astype(np.uint64) for k in (1, 3, 40, 1 << 60) for n in (0, 11, 12, 13, 60, 400)]
    key, at, text = substrings.keys_of_texts(texts, least)
    for k, g in enumerate(texts):
        want, near = {}, substrings._running_min(substrings._mix(g, 1000), least // 2 + 1) if len(g) >= least else g
        for f in range(substrings.FUNCTIONS):
            h = substrings._mix(g, f + 1)
            for low, c, high in substrings.compact_windows(h, least):
                for side, some, first in ((1, c - low, c - least // 2), (2, high - c, c)):
                    if some >= least // 2:
                        x = substrings._mix(h[c : c + 1] ^ substrings._mix(near[first : first + 1], 2 * f + side), 76 + side)[0]
                        want[int(x)] = min(c, want.get(int(x), c))
        assert dict(zip(key[text == k].tolist(), at[text == k].tolist())) == want


def passage_rows():
    rng = random.Random(4)
    shared = prose(rng, 60, 9000)
    near = shared.split()
    near[30] = "edited"
    rows = [(k, prose(rng, rng.choice([20, 120, 400]), 9000)) for k in range(40)]
    for k in (3, 8, 21, 33):
        rows[k] = (k, f"{prose(rng, 90, 9000)} {shared} {prose(rng, 70, 9000)}")
    rows[15] = (15, f"{prose(rng, 10, 9000)} {' '.join(near)} {prose(rng, 200, 9000)}")
    rows[30] = (30, " ".join(shared.split()[:45]))  # too short a passage
    rows[39] = rows[2] = (2, rows[1][1])  # an exact copy, twice
    rows[39] = (39, rows[1][1] if len(rows[1][1].split()) >= 50 else rows[3][1])
    return [*rows, (50, None), (51, ""), (None, shared)]


def test_substrings_against_all_pairs(spark):
    rows = passage_rows()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, key string").repartition(4)
    got = substrings.repeated_passages(df).collect()
    table = WordIds()
    sh = {i: grams(table.of(t)[0], 5) for i, t in rows if i is not None}
    pairs = {(a, b) for b, a in itertools.combinations(sorted(sh), 2) if substrings.common_passages(sh[a], sh[b], 46, 0.8)}
    assert {r.doc_id for r in got} == {a for a, _ in pairs}
    assert {(r.doc_id, r.source_doc_id) for r in got} <= pairs
    linked = components.star_edges([(r.doc_id, r.source_doc_id) for r in got])
    wanted = components.star_edges(sorted(pairs))
    assert dict(linked) == dict(wanted)
    words = dict(rows)
    for r in got:
        a, b = words[r.doc_id].split()[r.start_word : r.stop_word], words[r.source_doc_id].split()[r.source_start : r.source_stop]
        assert len(a) >= 50 and (a == b or "edited" in a + b)
    assert substrings.repeated_passages(df.limit(0)).count() == 0


def passage_shares(a, b, least, similarity):
    """Whether some stretch reaches the similarity: local alignment over all cells, kept apart by where it starts in a."""
    for start in range(len(a) - least + 1):
        row = [(0, -1)] * (len(b) + 1)  # (matches - what is passed over, weighted; start in b)
        for i in range(start, len(a)):
            new = [(-np.inf, -1)]
            for j in range(1, len(b) + 1):
                best = max((row[j][0] - 1, row[j][1]), (new[j - 1][0] - 1, new[j - 1][1]))
                if a[i] == b[j - 1]:
                    came = (0.0, j - 1) if i == start else row[j - 1]
                    best = max(best, (came[0] + 1 / similarity - 1, came[1]))
                elif i == start:
                    best = (-np.inf, -1)
                new.append(best)
                if best[0] >= -1e-9 and i - start + 1 >= least and j - best[1] >= least and a[i] == b[j - 1]:
                    return True
            row = new
    return False


def test_passages_with_repeated_lines():
    rng = random.Random(21)
    new = lambda n: [rng.randrange(10**6) for _ in range(n)]
    shared = new(60)
    quoted = [*new(20), *shared[:20], *new(40), *shared, *new(10)]
    line, long = new(5), new(80)
    cases = [([*new(9), *shared, *new(9)], quoted)]
    cases.append(([*long[:40], *line, *long[40:]], [*new(12), *line, *new(40), *long, *new(7)]))
    for s, t in cases:
        x, y = (grams(np.array(v, np.uint64), 5) for v in (s, t))
        assert passage_shares(x.tolist(), y.tolist(), 46, 0.8)
        assert substrings.common_passages(x, y, 46, 0.8)
    missed = 0
    for _ in range(100):
        text = new(30)
        s, t = (list(text) for _ in range(2))
        for v in (s, t):
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(v))
                v[at : at + rng.randrange(3)] = rng.choice([text[:6], new(2), text[20:24]])
        x, y = np.array(s, np.uint64), np.array(t, np.uint64)
        got, there = bool(substrings.common_passages(x, y, 14, 0.8)), passage_shares(s, t, 14, 0.8)
        assert there or not got
        missed += there and not got
    assert missed <= 2  # a chain keeps one predecessor a run


@pytest.mark.parametrize("held", [0, 8])
def test_runs_of_texts_that_repeat_themselves(monkeypatch, held):
    monkeypatch.setattr(substrings, "_MATCHES", held)
    a, b = np.array([7, 7, 7, 1, 2], np.uint64), np.array([1, 7, 7, 1, 2], np.uint64)
    got = sorted(zip(*(x.tolist() for x in substrings._runs(a, b, 3))))
    assert got == ([(0, 1, 2), (0, 2, 1), (1, 1, 4), (2, 1, 1), (3, 0, 1)] if held else [(1, 1, 4)])


def test_a_text_of_one_repeated_word_stays_cheap():
    words = np.full(1_000_000, 5, np.uint64)
    started = time.perf_counter()
    g = grams(words, 5)
    assert len(substrings.window_keys(g, 46)[0]) <= 2 * substrings.FUNCTIONS
    start, stop = substrings.common_passages(g, g[:50_000], 46, 0.8)[0][:2]
    assert time.perf_counter() - started < 20 and start == 0 and stop >= 50_000


def test_gram_runs_name_contents():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 400).astype(np.uint64)
    h = gram_runs(g, 6)
    named = {}
    for k, x in enumerate(h.tolist()):
        assert named.setdefault(x, tuple(g[k : k + 6])) == tuple(g[k : k + 6])
    assert len(set(named.values())) == len(named) and not len(gram_runs(g[:5], 6))


def test_a_short_version_in_the_smallest_document_hides_no_repeat(spark):
    """Document 1 of each case shares 45 to 49 words with two others, which repeat 50 to 60 words of each other."""
    rng, rows, n = random.Random(77), [], 0
    for _ in range(60):
        length = rng.choice([50, 52, 55, 60])
        shared = prose(rng, length, 9000).split()
        cut = shared[: rng.choice([45, 47, 49])] if rng.random() < 0.5 else shared[-rng.choice([45, 47, 49]) :]
        for words in (cut, shared, shared):
            rows.append((n, " ".join([prose(rng, 30, 9000), *words, prose(rng, 30, 9000)]), "x"))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(df).collect()}
    assert got == {(k + 2, k + 1) for k in range(0, n, 3)}


def test_a_short_version_in_the_smallest_document_hides_no_edited_repeat(spark):
    """As above, but the third document has a word of the passage changed, so no 50 words of it are repeated as they are."""
    rng, rows, n = random.Random(78), [], 0
    for _ in range(60):
        shared = prose(rng, rng.choice([58, 60, 64]), 9000).split()
        cut = shared[:46] if rng.random() < 0.5 else shared[-46:]
        other = shared.copy()
        other[rng.randrange(20, 40)] = "changed"
        for words in (cut, shared, other):
            rows.append((n, " ".join([prose(rng, 30, 9000), *words, prose(rng, 30, 9000)]), "x"))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(df).collect()}
    assert got == {(k + 2, k + 1) for k in range(0, n, 3)}


def test_an_edited_repeat_of_documents_joined_elsewhere_is_found(spark):
    """As above, and both repeat another passage of the first document, which joins all three."""
    rng, rows, n = random.Random(80), [], 0
    for _ in range(60):
        shared, more = prose(rng, rng.choice([58, 60, 64]), 9000).split(), prose(rng, 70, 9000).split()
        other = shared.copy()
        other[rng.randrange(20, 40)] = "changed"
        for words in (shared[:46], shared, other):
            rows.append((n, " ".join([prose(rng, 200, 9000), *words, prose(rng, 200, 9000), *more, prose(rng, 30, 9000)]), "x"))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(df).collect()}
    assert {(k + 2, k + 1) for k in range(0, n, 3)} <= got


def test_a_repeat_of_a_linked_document_is_found(spark):
    """The second document of a case repeats the first one but for two words; the third repeats the second one's part between them."""
    rng, rows, n = random.Random(79), [], 0
    for _ in range(40):
        shared = prose(rng, 150, 9000).split()
        first = shared.copy()
        first[60], first[90] = "one", "two"
        for words in (first, shared, shared[48:102]):
            rows.append((n, " ".join([prose(rng, 30, 9000), *words, prose(rng, 30, 9000)]), "x"))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {(r.doc_id, r.source_doc_id) for r in substrings.repeated_passages(df).collect()}
    assert got == {p for k in range(0, n, 3) for p in ((k + 1, k), (k + 2, k + 1))}


def test_documents_that_meet_link_to_every_set_they_repeat():
    rng = np.random.default_rng(5)
    a, b, c = (rng.integers(1, 1 << 32, 60, dtype=np.uint32) for _ in range(3))
    edited = a.copy()
    edited[28:33] += 1
    near = [x.tobytes() for x in (a, edited, b, a, c, b[:40])]
    ids = np.arange(1, 7)
    assert sorted(substrings.met(ids, ids, ids, np.full(6, 4), near, 46, 0.8)) == [(2, 1), (4, 1)]
    assert len(substrings.met(ids[:3], np.array([1, 0, 0]), ids[:3], np.full(3, 4), [near[0], near[1], near[3]], 46, 0.8)) == 1


def test_near_misses_around_a_key_are_not_aligned(monkeypatch):
    rng, at = np.random.default_rng(3), 76
    first = rng.integers(1, 1 << 32, 153).astype(np.uint32)
    near = [first.tobytes()]
    for step in [4] * 40 + [25]:  # every so many shingles outside the run at the key differ; the similarity with 4 is below 0.8
        other = first.copy()
        places = [65, 88, *(p for p in range(int(rng.integers(0, step)), 153, step) if not 65 <= p <= 88)]
        other[places] = rng.integers(1, 1 << 32, len(places))
        near.append(other.tobytes())
    aligned, align = [], substrings.common_passages
    monkeypatch.setattr(substrings, "common_passages", lambda *a: aligned.append(a) or align(*a))
    ids = np.arange(1, 43)
    assert substrings.met(ids, ids, np.where(ids == 1, 1, np.where(ids == 42, 42, 2)), np.full(42, at), near, 46, 0.8) == [(42, 1)]
    assert len(aligned) <= 2


@pytest.mark.parametrize("seed", range(4))
def test_documents_that_meet_are_joined_as_by_all_pairs(seed):
    rng, least, at = np.random.default_rng(seed), 12, 15
    texts = rng.integers(1, 9, (6, 40)).astype(np.uint32)[rng.integers(0, 6, 60)]
    for t in texts:  # stretches of two texts on either side of the key
        t[: rng.integers(0, 16)] = rng.integers(1, 1 << 32)
        t[rng.integers(17, 40) :] = rng.integers(1, 1 << 32)
    starts = rng.integers(0, 8, 60)
    near = [t[s : rng.integers(20, 41)] for t, s in zip(texts, starts)]
    ids, places, one, want = np.arange(60), at - starts, np.zeros(60, np.int64), components.Forest()
    for x, y in itertools.combinations(range(60), 2):
        (a, p), (b, q) = (near[x], places[x]), (near[y], places[y])
        sides = (a[:p][::-1], b[:q][::-1]), (a[p:], b[q:])
        run = sum(len(list(itertools.takewhile(lambda pair: pair[0] == pair[1], zip(*side)))) for side in sides)
        if run >= least:
            want.join(x, y)
    got = components.Forest()
    links = substrings.met(ids, ids, one, places, [x.tobytes() for x in near], least, 0.8)
    for x, y in links:
        got.join(x, y)
    assert [got.find(x) for x in range(60)] == [want.find(x) for x in range(60)] and len(links) == 60 - len({want.find(x) for x in range(60)})


def test_chains_take_the_best_run_before(monkeypatch):
    rng = np.random.default_rng(5)
    p, q, n = rng.integers(0, 200, 150), rng.integers(0, 200, 150), rng.integers(1, 20, 150)
    order = np.lexsort((q, p))
    p, q, n = p[order], q[order], n[order]
    for local, size in itertools.product((False, True), (1 << 17, 50)):
        monkeypatch.setattr(substrings, "_REACHED", size)
        via, skip, score, common = substrings._chained(n, substrings._reached(p, q, n), 0.25, local)
        best, held = [], []
        for k in range(150):
            ways = []
            for j in range(k):
                over = max(0, p[j] + n[j] - p[k], q[j] + n[j] - q[k])
                gaps = p[k] + over - p[j] - n[j], q[k] + over - q[j] - n[j]
                if over < n[k] and max(gaps) < substrings.GAP:
                    ways.append((best[j] + 0.25 * (n[k] - over) - sum(gaps), -j, over))
            top = max(ways, default=None)
            if top is None or local and top[0] <= 0.25 * n[k]:
                top = 0.25 * n[k], 1, 0
            best.append(top[0])
            held.append(n[k] - top[2] + (held[-top[1]] if top[1] <= 0 else 0))
            assert (via[k], skip[k], score[k], common[k]) == (-top[1], top[2], top[0], held[k])


def test_remove_passages_keeps_one(spark):
    rows = passage_rows()
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DOCS).repartition(4)
    out = substrings.remove_passages(df, substrings.repeated_passages(df))
    assert out.columns == df.columns and out.count() == len(rows)
    text = {r.doc_id: r.text for r in out.collect()}
    shared = rows[-1][1]
    assert [k for k in (3, 8, 21, 33) if shared in text[k]] == [3]
    assert text[5] == dict(rows)[5] and text[50] is None and text[None] == shared


# --- decontamination --------------------------------------------------------------------------------------------------


def slow_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=14), st.lists(st.integers(1, 5), max_size=14))
def test_alignment_score(a, b):
    score, _ = decontaminate.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == slow_alignment(a, b)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_finds_copies_and_edits(spark, block_bytes):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([15, 30, 50]), 5000)) for k in range(12)] + [(90, "two words"), (91, None), (92, "...")]
    rows, want = [], set()
    for k in range(60):
        text = prose(rng, 150, 5000)
        if k % 3 == 0:
            item, passage = items[k // 3 % 12]
            w = passage.split()
            for _ in range(len(w) // 8 if k % 2 else 0):
                w[rng.randrange(len(w))] = "other"
            text = f"{text} {'. '.join(w).title()} {prose(rng, 40, 5000)}"
            want.add((k, item))
        rows.append((k, text))
    rows += [(70, "say two words more"), (71, None), (72, ""), (None, items[0][1])]
    want |= {(70, 90), (None, 0)}
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    exact = next(r for r in got if r.doc_id == 0)
    assert exact.score == 1.0 and exact.start_word == 150 and exact.stop_word == 150 + len(items[0][1].split())
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_does_not_leave_out_seeds(spark):
    rng = random.Random(14)
    items, rows, at = [], [], {}
    for k in range(24):
        w = [f"i{k}x{n}" for n in range(40)]
        items.append((k, " ".join(w)))
        v = list(w)
        if k < 8:
            spots = range(2, 35, 5)  # 21 of the 38 seeds are broken
        else:
            spots = rng.sample(range(40), (6, 8, 10)[k % 3])  # 15, 20, 25 %
        for n in spots:
            v[n] = f"edit{k}x{n}"
        copies = 3 if k % 4 == 1 else 1
        texts = [" ".join(v)] * copies + ([items[-1][1]] if k % 4 == 2 else [])
        for text in texts:
            rows.append((len(rows), f"{prose(rng, 60, 500)} {text} {prose(rng, 30, 500)}"))
    rows += [(len(rows) + k, prose(rng, 120, 500)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = WordIds()
    want = {
        (i, k)
        for k, item in items
        for i, text in rows
        if decontaminate.align(table.of(item)[0], table.of(text)[0])[0] >= 0.5
    }
    assert len(want) == len(rows) - 20
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=14), st.lists(st.integers(1, 9), min_size=1, max_size=14))
def test_bound_of_an_alignment(a, b):
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    assert decontaminate.most(a, b) >= decontaminate.align(a, b)[0]


def test_pairs_of_texts_are_aligned_together_as_one_by_one(monkeypatch):
    from nearfield.llm import substrings

    rng = np.random.default_rng(5)
    texts = []
    for _ in range(6):
        b = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
        edited = b.copy()
        edited[rng.integers(0, 400, 9)] = 7
        other = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
        twice = np.concatenate([b[50:120], other[:80], b[40:130]])
        texts += [(a, b) for a in (b.copy(), edited, other, twice, b[:20], np.tile(b[:5], 60))]
    texts.append((np.tile(texts[0][1][:5], 60), np.tile(texts[0][1][:5], 70)))  # too many pairs of equal shingles
    alone = [substrings.common_passages(a, b, 46, 0.8) for a, b in texts]
    assert sum(map(bool, alone)) >= 18
    calls, chained = [], substrings._chained
    monkeypatch.setattr(substrings, "_chained", lambda *a: calls.append(1) or chained(*a))
    assert substrings.passages_of_pairs(texts, 46, 0.8) == alone
    assert len(calls) <= 4  # not one or two for each pair

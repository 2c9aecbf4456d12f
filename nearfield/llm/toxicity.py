"""Toxicity by a weighted finite-state pattern grammar.

Method: words map to the symbols insult, threat, target, negation, report, intent, strength, other. Six letter-to-letter
transducers are composed into one machine over clauses. The insult machine reads phrases of strengthening words and an
epithet and writes an attack where the phrase ends; the threat machine reads an intent, a violent verb and a target, in the
orders in which they make a threat, and writes a menace where the pattern is complete, so a violent verb alone is an other
word. Negation dampens what was matched in its reach, reported speech halves it, a target in the clause raises attacks, and
scoring lets only attacks and menaces count. A clause's score is the sum of its arcs' factors times the lexical weights (a
menace has that of the clause's last violent verb); a text's score is a calibrated function of its clause scores.

The lexicon has a small fixed part and a learned part: words and word stems (prefixes) whose document frequency among
toxic training rows exceeds that among the others beyond chance. Only the bounded, class-balanced sample of the labels
(``sample_rows``) is learned from.

Defined cases: null and empty texts have no clause and get the base rate as score; texts of any length are scored whole;
rows with a null id or label are never learned from but are scored; repeated rows stay; without labels the fixed
lexicon and calibration are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, materialize, release
from .sampling import balanced

# The hand-written part of the lexicon.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, STRONG, ATTACK, MENACE = range(10)
_READ = range(8)  # the symbols of words; attacks and menaces are written by the machines
INSULTS = "idiot idiots moron morons scum loser losers stupid pathetic worthless disgusting imbecile bastard".split()
THREATS = "kill hurt destroy shoot stab strangle beat".split()
TARGETS = "you your yours yourself u he she they him her them this that these those du dich dein ihr tu te ton vous vos usted ustedes ellos".split()
NEGATIONS = "not never no isn aren wasn don nor without nicht kein keine ne pas jamais nunca jamas tampoco".split()
REPORTS = "said says say wrote claimed called reported quoted allegedly sagte behauptete dit selon dijo dice según".split()
INTENTS = "will shall gonna going should must want wanna let werde wirst soll vais va veux voy vamos quiero".split()
STRENGTHS = "such so total totally complete completely utter utterly absolute bloody damn damned fucking real very sehr total complètement très muy tan".split()
PRIOR_WEIGHT = 3.0

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[.!?;\n]")
_PREFIXES = (6, 5, 4, 3)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted letter-to-letter transducer: ``arcs[state, symbol] = (next state, output, factor)``."""

    start: object
    arcs: dict


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that feeds the output of ``a`` to ``b``; factors multiply."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    inputs = {i for _, i in a.arcs}
    while todo:
        p, q = state = todo.pop()
        for i in inputs:
            p2, mid, f = a.arcs[p, i]
            q2, out, g = b.arcs[q, mid]
            arcs[state, i] = ((p2, q2), out, f * g)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return Transducer(start, arcs)


def insults(bonus: float = 0.1, most: int = 2) -> Transducer:
    """Insult phrases: any strengthening words (``most`` of them add to the factor), then an epithet, at which an attack is written."""
    arcs = {}
    for state in range(most + 1):  # strengthening words just before
        for s in _READ:
            out, factor = (ATTACK, 1.0 + bonus * state) if s == INSULT else (s, 1.0)
            arcs[state, s] = (min(most, state + 1) if s == STRONG else 0, out, factor)
    return Transducer(0, arcs)


def threats(window: int = 4) -> Transducer:
    """Threat patterns, each part within ``window`` words of the one before: (intent or target) verb target, or target intent verb.

    A violent verb outside of a pattern is an other word; the pattern's last word is written as a menace.
    """
    arcs, symbols = {}, [*_READ, ATTACK]
    for named in (False, True):  # a target was named in the clause
        for meant in range(window + 1):  # words for which the last intent still holds
            for verb in range(window + 1):  # words for which a violent verb awaits its target
                for s in symbols:
                    nxt = [named or s == TARGET, window if s == INTENT else max(0, meant - 1), max(0, verb - 1)]
                    out = OTHER if s == THREAT else s
                    if s == THREAT and named:
                        out = MENACE
                    elif s == THREAT and meant:
                        nxt[2] = window
                    elif s == TARGET and verb:
                        out, nxt[2] = MENACE, 0
                    arcs[(named, meant, verb), s] = (tuple(nxt), out, 1.0)
    return Transducer((False, 0, 0), arcs)


_MATCHED = [OTHER, TARGET, NEGATION, REPORT, INTENT, STRONG, ATTACK, MENACE]


def negation(window: int = 3, factor: float = 0.2) -> Transducer:
    """Dampens what is matched up to ``window`` words after a negation."""
    arcs = {}
    for state in range(window + 1):  # words for which the last negation still holds
        for s in _MATCHED:
            nxt = window if s == NEGATION else max(0, state - 1)
            arcs[state, s] = (nxt, s, factor if state and s in (ATTACK, MENACE) else 1.0)
    return Transducer(0, arcs)


def reported(factor: float = 0.5) -> Transducer:
    """Dampens what follows a verb of saying in its clause."""
    arcs = {}
    for state in (False, True):
        for s in _MATCHED:
            arcs[state, s] = (state or s == REPORT, s, factor if state and s in (ATTACK, MENACE) else 1.0)
    return Transducer(False, arcs)


def targeted(bonus: float = 1.25) -> Transducer:
    """Raises attacks in a clause that has named a target."""
    arcs = {}
    for state in (False, True):
        for s in _MATCHED:
            arcs[state, s] = (state or s == TARGET, s, bonus if state and s == ATTACK else 1.0)
    return Transducer(False, arcs)


def scoring() -> Transducer:
    """Lets only attacks and menaces count."""
    return Transducer(0, {(0, s): (0, s, 1.0 if s in (ATTACK, MENACE) else 0.0) for s in _MATCHED})


def grammar() -> Transducer:
    out = insults()
    for part in (threats(), negation(), reported(), targeted(), scoring()):
        out = compose(out, part)
    return out


@dataclass
class ToxicityModel:
    """Lexicon (word or ``prefix*`` -> weight) and calibration; at most ``MOST_ENTRIES`` learned entries."""

    lexicon: dict[str, float] = field(default_factory=dict)
    calibration: tuple[float, float, float] = (-4.0, 1.5, 1.0)

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "calibration": self.calibration, "_ready": None}

    def _prepare(self):
        if self._ready is None:
            classes: dict[str, tuple[int, float]] = {}
            for words, symbol in (
                (STRENGTHS, STRONG), (INTENTS, INTENT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT),
            ):
                classes |= {w: (symbol, PRIOR_WEIGHT) for w in words}
            machine = grammar()
            states = {s: k for k, s in enumerate(dict.fromkeys([machine.start, *(s for s, _ in machine.arcs)]))}
            step = [[None] * len(_READ) for _ in states]
            for (s, i), (n, _, f) in machine.arcs.items():
                step[states[s]][i] = (states[n], f)
            self._ready = (_Words(self.lexicon, classes), _Hits(), step)
            self._ready[1].words = self._ready[0]
        return self._ready

    def clauses(self, text: str | None) -> list[float]:
        """The scores of the clauses that matched the grammar."""
        words, hits, step = self._prepare()
        low = (text or "").lower()
        if not any(map(hits.__getitem__, low.split())):
            return []
        out, state, score, verb = [], 0, 0.0, 0.0
        for w in _TOKEN.findall(low):
            if w in ".!?;\n":
                if score:
                    out.append(score)
                state, score, verb = 0, 0.0, 0.0
                continue
            symbol, weight = words[w]
            if symbol == THREAT:
                verb = weight
            state, factor = step[state][symbol]
            score += factor * (verb if symbol == TARGET else weight)
        return [*out, score] if score else out

    def score(self, text: str | None) -> float:
        a, b, c = self.calibration
        return logistic(a + b * math.log1p(sum(got := self.clauses(text))) + c * (len(got) > 0))


class _Words(dict):
    """word -> (symbol, weight), looked up once per word; forgets all when it has grown large."""

    def __init__(self, lexicon: dict[str, float], classes: dict[str, tuple[int, float]]):
        super().__init__()
        self.lexicon, self.classes = lexicon, classes

    def __missing__(self, w: str) -> tuple[int, float]:
        if len(self) > 100_000:
            self.clear()
        weight = self.lexicon.get(w)
        for n in _PREFIXES if weight is None else ():
            if len(w) >= n and (weight := self.lexicon.get(w[:n] + "*")) is not None:
                break
        symbol, prior = self.classes.get(w, (OTHER, 0.0))
        if weight is not None:  # learned entries go before the fixed ones; a weight of 0 takes a fixed word out
            symbol, prior = (OTHER if not weight else THREAT if symbol == THREAT else INSULT), weight
        self[w] = got = (symbol, prior if symbol in (INSULT, THREAT) else 0.0)
        return got


class _Hits(dict):
    """token between white space -> whether it holds an insult or a threat."""

    def __missing__(self, token: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        self[token] = got = any(self.words[w][0] in (INSULT, THREAT) for w in _WORD.findall(token))
        return got


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


#: The most entries of a learned lexicon, by weight of evidence.
MOST_ENTRIES = 20_000


def _entries(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w)
        out.update(w[:n] + "*" for n in _PREFIXES if len(w) >= n)
    return out


def _frequencies(sample: DataFrame) -> DataFrame:
    """``(entry, toxic, clean)``: in how many sampled texts of each class an entry occurs; added up per task first."""
    schema = arrow_schema("entry string, toxic long, clean long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                counts = (Counter(), Counter())
                for text, label in zip(*(c.to_pylist() for c in b.slice(at, 128).columns)):
                    counts[bool(label)].update(_entries(text))
                words = list(counts[0].keys() | counts[1].keys())
                cols = (words, [counts[1][w] for w in words], [counts[0][w] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = sample.mapInArrow(run, "entry string, toxic long, clean long")
    return rows.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(texts: DataFrame, entries: set[str]) -> DataFrame:
    """``(entry, toxic)``: in how many different contexts (the words before and after) each of ``entries`` occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0):
                words = _WORD.findall(text.as_py().lower())
                rows = set()
                for k, w in enumerate(words):
                    if own := entries & {w, *(w[:n] + "*" for n in _PREFIXES if len(w) >= n)}:
                        near = f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"
                        rows.update((e, xxhash.xxh64_intdigest(near.encode()) >> 1) for e in own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["entry", "context"])

    rows = texts.select("text").mapInArrow(run, "entry string, context long")
    return rows.groupBy("entry").agg(F.count_distinct("context").alias("toxic"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, evidence: float = 9.5, ratio: float = 100.0) -> dict[str, float]:
    """Entries that are ``ratio`` times as frequent among toxic texts, with ``evidence`` nats against chance."""
    base = n_toxic / (n_toxic + n_clean)
    t, c = F.col("toxic"), F.col("clean")
    share = t / (t + c)
    nats = t * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
    log_ratio = F.log((t + 0.5) / (n_toxic + 1.0)) - F.log((c + 0.5) / (n_clean + 1.0))
    least = math.log(ratio)
    frequencies = materialize(_frequencies(sample), "entries")
    found = frequencies.where(t > 0).withColumn("nats", nats).withColumn("w", log_ratio)
    # Small samples cannot show the ratio: there, entries never seen in clean texts pass on evidence alone.
    passing = (F.col("nats") >= evidence) & (share > base) & ((F.col("w") >= least) | (c == 0))
    first = found.where(passing).orderBy(F.desc("nats"), "entry").limit(MOST_ENTRIES).select("entry", "clean").collect()
    # Copies of one toxic text are one piece of evidence: entries have to pass again on the contexts that they occur in.
    own = _contexts(sample.where("label = 1"), {r.entry for r in first}).join(frequencies.select("entry", "clean"), "entry")
    own = own.withColumn("nats", nats).withColumn("w", log_ratio)
    rows = own.where(passing).orderBy(F.desc("nats"), "entry").collect()
    got = {r.entry: (r.toxic, r.clean, r.w) for r in rows}
    # A stem whose longer form loses a tenth of its toxic texts at most, and fewer clean ones hold, gives way to that form.
    drop = set()
    for entry, (toxic, clean, _) in got.items():
        for n in range(3, len(entry.rstrip("*"))):
            stem = entry[:n] + "*"
            if stem in got and stem != entry and toxic >= 0.9 * got[stem][0] and clean < got[stem][1]:
                drop.add(stem)
    lexicon = {e: float(w) for e, (_, _, w) in got.items() if e not in drop}
    # What the labels say about the fixed words adds to their prior weight.
    for r in frequencies.where(F.col("entry").isin(INSULTS + THREATS) & (t + c >= 5)).collect():
        own = PRIOR_WEIGHT + math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1))
        lexicon[r.entry] = max(lexicon.get(r.entry, 0.0), own, 0.0)
    release(frequencies)
    return lexicon


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 0.05 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(3)
        move = np.linalg.solve(hess, grad)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(w.tolist())


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 8000, seed: int = 7,
) -> ToxicityModel:
    """Learn from the texts of about ``sample_rows`` rows of ``labels(id, label 0/1)``.

    The sample of ids is bounded by that parameter, so it is broadcast to the texts, which are not shuffled.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen, sizes = balanced(rows, "id", "label", sample_rows, seed)
    if set(sizes) != {0, 1}:
        return ToxicityModel()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = materialize(texts.join(F.broadcast(chosen), "id").select("text", "label"), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if set(n) != {0, 1}:
        return ToxicityModel()
    model = ToxicityModel(learn_lexicon(sample, n.get(1, 0), n.get(0, 0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.clauses(t.as_py()) for t in b.column(0)]
            cols = [pa.array([sum(g) for g in got], pa.float64()), pa.array([len(g) > 0 for g in got], pa.bool_()), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, ["total", "hit", "label"])

    seen = sample.mapInArrow(measure, "total double, hit boolean, label int").toPandas()  # of the bounded sample
    seen = seen.sort_values(["label", "total", "hit"])
    y = seen["label"].to_numpy(dtype=float)
    x = np.column_stack([np.log1p(seen["total"].to_numpy(dtype=float)), seen["hit"].to_numpy(dtype=float)])
    weight = np.where(y == 1, sizes[1] / max((y == 1).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    model.calibration = _calibrate(x, y, weight)
    release(sample)
    return model


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row, from its text alone."""
    kind = df.schema[id_col].dataType.simpleString()

    def fn(ids, texts):
        got = [model.score(t) for t in texts]
        return {"id": ids, "score": got, "predicted": [int(s >= 0.5) for s in got]}

    return map_rows(df, id_col, text_col, fn, f"id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns and their order stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < limit for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

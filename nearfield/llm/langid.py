"""Language identification.

Method: sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to 3 over letters, hashed), trained
with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), then temperature calibration on a part
of the sample that the fit has not seen. Document frequencies are counted over all training rows; the regression is fit
on a bounded, class-balanced sample of them (``sample_rows``).

Defined cases: null texts and texts without a letter are ``und`` with score 0, so is every text if there is nothing to
learn from; one learned language gives score 1; texts of any length are read whole; rows with a null id or label are
never learned from but are predicted; repeated rows stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows
from .sampling import balanced

BITS = 15
DIMS = 1 << BITS
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> code point of its lower case if it is a letter, else 0."""
    global _letters
    if _letters is None:
        points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        keep = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points.tolist()), bool, len(points))
        _letters = np.where(keep, points, 0).astype(np.uint32)
        for c in np.nonzero(keep)[0].tolist():
            low = chr(c).lower()
            if len(low) == 1:
                _letters[c] = ord(low)
    return _letters


_STEP = 1 << 20


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids of a text, ascending, and how often each occurs; empty without a letter."""
    total = None
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    for at in range(0, len(codes), _STEP):  # slices overlap by two, so every n-gram is counted once
        s = letters()[codes[max(at - 2, 0) : at + _STEP]].astype(np.uint64)
        if at == 0:
            s = np.concatenate([np.zeros(2, np.uint64), s])
        if at + _STEP >= len(codes):
            s = np.append(s, np.uint64(0))
        if not s.any():
            continue
        a, b, c = s[:-2], s[1:-1], s[2:]
        two = b * np.uint64(0x9E3779B1) + c * np.uint64(0x85EBCA77) + np.uint64(1)
        three = a * np.uint64(0xC2B2AE3D) + two + np.uint64(2)
        keys = np.concatenate([c[c > 0], two[(b > 0) | (c > 0)], three[(b > 0) & ((a > 0) | (c > 0))]])
        ids = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        n = np.bincount(ids.astype(np.int64), minlength=DIMS)
        total = n if total is None else total + n
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.nonzero(total)[0]
    return at, total[at]


@dataclass
class LanguageModel:
    """Weights of a trained classifier; its size is bounded by ``DIMS`` times the number of languages."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS + 1 rows, the last one is the bias
    temperature: float = 1.0
    rows: int = 0
    extra: dict = field(default_factory=dict)

    def vector(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[ids]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(ids, n) @ self.weights[ids] + self.weights[DIMS]

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, n = features(text)
        if not len(ids) or not self.labels:
            return UNKNOWN, 0.0
        p = softmax(self.logits(ids, n) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Follow the regularised leader, proximal form; ``rows`` of (feature ids, values, class)."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def leader(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            ids, x, y = rows[r]
            w = leader(ids)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g[None, :]
            g2 = g * g
            z[ids] += g - (np.sqrt(n[ids] + g2) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g2
    return leader(np.arange(DIMS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, from a grid on a log scale."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)).tolist(), key=loss)


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Over all rows: the number of texts with a letter, and in how many of them each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                ids, _ = features(t.as_py())
                df[ids] += 1
                n += bool(len(ids))
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    sums = texts.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # at most DIMS + 1 rows
    out = np.zeros(DIMS, np.int64)
    ids, n = got["feature"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.int64)
    out[ids[ids >= 0]] = n[ids >= 0]
    return int(n[ids < 0].sum()), out


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 4000,
    epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 7,
) -> LanguageModel:
    """Fit on ``labelled``; ``sample_rows`` bounds the rows of the regression (about; all rows of a tied key stay)."""
    labelled = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    chosen, sizes = balanced(labelled.select(id_col, text_col, label_col), id_col, label_col, sample_rows, seed)
    labels = sorted(sizes)
    if not labels:
        return LanguageModel([], np.ones(DIMS), np.zeros((DIMS + 1, 0)))
    total, df = document_frequencies(labelled, text_col)
    idf = np.log((total + 1) / (df + 1)) + 1

    schema = arrow_schema("label string, ids binary, n binary")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids, n = features(text.as_py())
                if len(ids):
                    rows.append((label, ids.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    sample = chosen.select(F.col(label_col).cast("string"), text_col).mapInArrow(extract, "label string, ids binary, n binary")
    model = LanguageModel(labels, idf, np.zeros((DIMS + 1, len(labels))), rows=total)
    rows = []
    for label, ids, n in sorted(map(tuple, sample.collect())):
        ids, n = np.frombuffer(ids, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)
        rows.append((np.append(ids, DIMS), np.append(model.vector(ids, n), 1.0), labels.index(label)))
    held = np.random.default_rng(seed).random(len(rows)) < 0.1
    fit = [r for r, h in zip(rows, held) if not h] or rows
    model.weights = ftrl(fit, len(labels), epochs, alpha, beta, l1, l2, seed)
    check = [r for r, h in zip(rows, held) if h] or rows
    if check and len(labels) > 1:
        model.temperature = temperature(np.array([x @ model.weights[ids] for ids, x, _ in check]), np.array([y for *_, y in check]))
    return model


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row, from its text alone."""
    kind = df.schema[id_col].dataType.simpleString()
    small = LanguageModel(model.labels, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature)

    def fn(ids, texts):
        got = [small.predict(t) for t in texts]
        return {"id": ids, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_rows(df, id_col, text_col, fn, f"id {kind}, lang_pred string, score double")

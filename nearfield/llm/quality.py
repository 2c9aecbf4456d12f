"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Method: n-grams of UTF-16 units of all trusted texts are counted (per task, then in Spark); continuation counts of the
lower orders, discounts, context totals and interpolated probabilities come from joins of these count tables, sharded by
key. A position's probability needs only entries with one and the same preceding unit, so the finished tables are cut
into shards by that unit; each shard of bounded size is joined with all documents, and a document's log probability is
the sum over shards. A document is kept if its perplexity is at most a quantile of the trusted texts of its language;
the model is trained on one half of the trusted texts (by a hash of the id) and the quantiles are those of the other.

Defined cases: null and empty texts have no perplexity (null) and are kept; a language without trusted texts is judged
by the quantile over all trusted texts, so is a null language; without any trusted text everything is kept, with the
perplexity null; texts of any length are scored whole; repeated rows stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, release

#: Order of the model (at most 4: a key holds four 16-bit units), and entries of one broadcast shard.
ORDER, SHARD_ENTRIES = 4, 3_000_000
_STEP = 1 << 20
#: Most ids of trusted rows that are broadcast to the texts; with more, the texts are joined by shuffle.
BROADCAST_IDS = 2_000_000


def gram_counts(text: str | None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (start padded with zeros, an end unit 1) as 64-bit keys, and their counts."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = text.encode("utf-16-le", "surrogatepass")
    units = np.concatenate([np.zeros(order - 1, np.uint16), np.frombuffer(raw, "<u2"), np.ones(1, np.uint16)]).astype(np.uint64)
    parts = []
    for at in range(0, len(units) - order + 1, _STEP):
        u = units[at : at + _STEP + order - 1]
        key = np.zeros(len(u) - order + 1, np.uint64)
        for k in range(order):
            key = (key << np.uint64(16)) | u[k : k + len(key)]
        parts.append(np.unique(key, return_counts=True))
    return _added(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _count(texts: DataFrame, text_col: str) -> DataFrame:
    """``(key, c)`` over all rows, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = _added(parts)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "c"])

        for b in batches:
            for t in b.column(0):
                got = gram_counts(t.as_py())
                parts.append(got)
                size += len(got[0])
                if size > 2_000_000:
                    parts = [_added(parts)]
                    size = len(parts[0][0])
                    if size > 1_000_000:
                        yield out()
                        parts, size = [], 0
        if parts:
            yield out()

    return texts.select(text_col).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts."""
    n = dict(counts.where("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


def _mask(units: int) -> int:
    return (1 << (16 * units)) - 1


@dataclass
class KneserNey:
    """Tables of the finished model by order: ``p(key, p)`` of seen n-grams, ``gamma(ctx, g)`` of seen contexts."""

    p: dict[int, DataFrame]
    gamma: dict[int, DataFrame]
    floor: float

    def entries(self) -> int:
        return sum(t.count() for t in (*self.p.values(), *self.gamma.values()))


def train(trusted: DataFrame, text_col: str = "text") -> KneserNey | None:
    """Count and smooth over all rows of ``trusted``; None without a single n-gram."""
    tables = {ORDER: materialize(_count(trusted, text_col), "grams")}
    for n in range(ORDER - 1, 0, -1):  # in how many different units' company an n-gram follows
        low = tables[n + 1].groupBy(F.expr(f"key & {_mask(n)}L").alias("key")).agg(F.count("*").alias("c"))
        tables[n] = materialize(low, "grams")
    units = tables[1].count()
    if not units:
        return None
    floor = 1.0 / (units + 1)
    p, gamma = {}, {}
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[n])
        c = F.col("c")
        d = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        t = tables[n].select("key", "c", F.expr("shiftrightunsigned(key, 16)").alias("ctx"), d.alias("d"))
        sums = t.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        q = t.join(sums, "ctx").withColumn("own", (c - F.col("d")) / F.col("total"))
        if n == 1:
            done = q.select("key", (F.col("own") + F.col("g") * floor).alias("p"))
        else:
            lower = p[n - 1].select(F.col("key").alias("low"), F.col("p").alias("below"))
            q = q.withColumn("low", F.expr(f"key & {_mask(n - 1)}L")).join(lower, "low")
            done = q.select("key", (F.col("own") + F.col("g") * F.col("below")).alias("p"))
        p[n] = materialize(done, "prob")
        gamma[n] = materialize(sums.select("ctx", "g"), "gamma")
    for t in tables.values():
        release(t)
    return KneserNey(p, gamma, floor)


@dataclass
class Shard:
    """The entries of all orders for positions after units u with ``u % of == part``: sorted keys and log values."""

    part: int
    of: int
    p: dict[int, tuple[np.ndarray, np.ndarray]]
    gamma: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: float

    def log_probability(self, keys: np.ndarray, n: np.ndarray) -> tuple[float, int]:
        """Sum over those n-grams that belong to this shard, and how many they are."""
        if self.of > 1:
            mine = (keys >> np.uint64(16)) % np.uint64(1 << 16) % np.uint64(self.of) == self.part
            keys, n = keys[mine], n[mine]
        total, count = 0.0, int(n.sum())
        for order in range(ORDER, 0, -1):
            if not len(keys):
                return total, count
            at, hit = _find(self.p[order][0], keys)
            total += float((n[hit] * self.p[order][1][at[hit]]).sum())
            keys, n = keys[~hit], n[~hit]
            at, seen = _find(self.gamma[order][0], keys >> np.uint64(16))
            total += float((n[seen] * self.gamma[order][1][at[seen]]).sum())
            keys = keys & np.uint64(_mask(order - 1))
        return total + float(n.sum()) * math.log(self.floor), count


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _packed(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A (long, double) frame as arrays sorted by key, fetched as a few packed rows."""
    schema = arrow_schema("k binary, v binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], schema=schema)

    rows = df.mapInArrow(run, "k binary, v binary").collect()
    k = np.concatenate([np.frombuffer(r.k, np.int64) for r in rows] or [np.empty(0, np.int64)]).view(np.uint64)
    v = np.concatenate([np.frombuffer(r.v, np.float64) for r in rows] or [np.empty(0)])
    order = np.argsort(k)
    return k[order], np.log(v[order])


def shards(model: KneserNey, most: int = SHARD_ENTRIES) -> Iterator[Shard]:
    """The model in as few shards as keep an even share of its entries below ``most``."""
    of = max(1, -(-model.entries() // most))

    def own(col: str, shift: int, part: int) -> Column:
        return F.expr(f"shiftrightunsigned({col}, {shift}) & 65535") % of == part

    for part in range(of):
        p = {n: _packed(t if n == 1 else t.where(own("key", 16, part))) for n, t in model.p.items()}
        gamma = {n: _packed(t if n == 1 else t.where(own("ctx", 0, part))) for n, t in model.gamma.items()}
        yield Shard(part, of, p, gamma, model.floor)


def perplexities(rows: DataFrame, model: KneserNey, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``rows(id, lang, text)`` -> ``id, lang, lp, units`` in one pass for each shard, added up by row."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "lang")}
    parts = list(shards(model, shard_entries))
    several = len(parts) > 1
    if several:  # rows need a name of their own, the same in each pass
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    ddl = f"row long, id {kinds['id']}, lang {kinds['lang']}, lp double, units long"
    names, total = ["row", "id", "lang", "lp", "units"], None
    for shard in parts:
        held = rows.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            s = held.value
            for b in batches:
                got = [s.log_probability(*gram_counts(t.as_py())) for t in b.column(3)]
                sums = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *sums], names)

        part = rows.select("row", "id", "lang", "text").mapInArrow(run, ddl)
        total = part if total is None else total.union(part)
    if several:
        total = total.groupBy("row", "id", "lang").agg(F.sum("lp").alias("lp"), F.sum("units").alias("units"))
    return total.select("id", "lang", "lp", "units")


def classify(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.995, shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """``id, lang, perplexity, threshold, keep`` for every row; ``trusted_ids`` has the ids of trusted rows."""
    trusted = trusted_ids.select(F.col(id_col).alias("_t")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    is_trusted = F.col("id") == F.col("_t")
    # Texts are not shuffled for a set of ids of bounded size.
    few = trusted.count() <= BROADCAST_IDS
    even = trusted.where(F.pmod(F.xxhash64("_t"), F.lit(2)) == 0)
    model = train(rows.join(F.broadcast(even) if few else even, is_trusted, "left_semi"))
    none = F.lit(None).cast("double")
    if model is None:
        return rows.select("id", "lang", none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("keep"))
    ppl = F.when(F.col("units") > 0, F.exp(-F.col("lp") / F.col("units"))).alias("perplexity")
    scored = materialize(perplexities(rows, model, shard_entries).select("id", "lang", ppl), "perplexity")
    for t in (*model.p.values(), *model.gamma.values()):
        release(t)
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    known = scored.join(trusted.where(F.pmod(F.xxhash64("_t"), F.lit(2)) == 1), is_trusted, "left_semi")
    if known.where("perplexity is not null").isEmpty():
        known = scored.join(trusted, is_trusted, "left_semi")
    overall = known.agg(cut).head()[0]
    by_lang = known.where("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(cut.alias("own"))
    out = scored.join(by_lang, F.col("lang") == F.col("_lang"), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    keep = F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("id", "lang", "perplexity", threshold.alias("threshold"), keep.alias("keep"))

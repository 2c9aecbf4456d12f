"""Benchmark decontamination.

Method: n-grams of the test items are seeds, and documents are joined to items on them. A document that shares a seed with an
item is aligned with it (Smith-Waterman over words, around the seeds), which scores exact, edited and paraphrased copies
alike. No seed is left out for being frequent; alignments that cannot reach the score are ruled out by the words that the
item and the passage have in common.

Test items of at most ``block_bytes`` are broadcast with their seeds, and the join is a lookup in one pass over the documents.
More are never gathered: a Bloom filter of bounded size picks the places of documents whose n-grams may be seeds, these are
joined with the seeds by shuffle (frequent seeds dealt out over salts), and the (document, item) pairs meet their words.

Defined cases: null, empty and wordless texts and items match nothing; items shorter than the seed are matched by their
whole text; repeated items and documents are reported each; rows with a null id are reported with that null; very long texts
are scanned whole, but aligned only around seeds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, materialize, slices, small_batches
from .words import WordIds, grams

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of test items up to which they are broadcast.
BLOCK_BYTES = 8 << 20
#: Words of a seed.
SEED_WORDS = 3


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two id sequences, and the end of that alignment in ``b``."""
    best, end = 0, 0
    h = np.zeros(len(b) + 1, np.int64)
    slope = -GAP * np.arange(len(b) + 1)
    for x in a.tolist():
        t = np.maximum(h + GAP, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(b == x, MATCH, MISMATCH))
        h = np.maximum.accumulate(t + slope) - slope  # gaps along b
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
    return best, end


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int]:
    """Alignment score as a share of the item's own, and the aligned interval of ``doc``."""
    best, stop = smith_waterman(item, doc)
    if not best:
        return 0.0, 0, 0
    _, back = smith_waterman(item[::-1], doc[:stop][::-1])
    return best / (MATCH * len(item)), stop - back, stop


def most(item: np.ndarray, doc: np.ndarray) -> float:
    """A bound on the score of :func:`align`: an aligned word that ``doc`` does not hold costs a mismatch or a gap."""
    sums = np.cumsum(np.where(np.isin(item, doc), MATCH, max(MISMATCH, GAP)))
    before = np.minimum.accumulate(np.concatenate([np.zeros(1, np.int64), sums[:-1]]))
    return max(0, int((sums - before).max())) / (MATCH * len(item))


@dataclass
class Items:
    """A block of test items: word ids, and the seeds as sorted hashes with the (item, position) of each."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    where: dict[int, list[tuple[int, int]]]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Items:
        table, ids, words, where = WordIds(), [], [], defaultdict(list)
        for item, text in rows:
            w, _ = table.of(text)
            if len(w):
                for k, g in enumerate(grams(w, min(SEED_WORDS, len(w))).tolist()):
                    where[g].append((len(ids), k))
                ids.append(item)
                words.append(w)
        return cls(ids, words, np.array(sorted(where), np.uint64), dict(where))

    def found(self, w: np.ndarray) -> list[tuple[int, int]]:
        """(position, seed) of each seed in a document; shorter items have shorter seeds."""
        out = []
        if len(self.seeds):
            for n in sorted({min(SEED_WORDS, len(x)) for x in self.words}):
                g = grams(w, n)
                k = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
                at = np.nonzero(self.seeds[k] == g)[0]
                out += zip(at.tolist(), g[at].tolist())
        return out

    def matches(self, w: np.ndarray, least: float) -> Iterator[tuple[object, float, int, int]]:
        """(item id, score, start, stop) of the alignments that reach ``least``."""
        by_item = defaultdict(set)
        for p, g in self.found(w):
            for item, q in self.where[g]:
                by_item[item].add(p - q)
        for item, offsets in by_item.items():
            for score, s, e in around(self.words[item], w, sorted(offsets), least):
                yield self.ids[item], score, s, e


def around(x: np.ndarray, w: np.ndarray, offsets: list[int], least: float) -> Iterator[tuple[float, int, int]]:
    """(score, start, stop) of the alignments of item ``x`` in ``w`` near the diagonals ``offsets`` that reach ``least``."""
    slack, stop = max(4, len(x) // 2), -1
    for o in offsets:
        start = max(o - slack, stop, 0)
        if stop >= 0 and o + len(x) <= stop:
            continue  # inside the interval just aligned
        end = min(len(w), o + len(x) + slack)
        if most(x, w[start:end]) < least:
            continue
        score, s, e = align(x, w[start:end])
        if score >= least:
            yield score, start + s, start + e
            stop = start + e


#: Bits of the filter of seeds, at most; pairs of one seed that are joined in one piece.
FILTER_BITS, HOT_SEEDS = 1 << 26, 4096


def _seeds(ids: list, texts: list, table: WordIds) -> pa.RecordBatch:
    """``seed, at, n`` of each item with its number: its row's hash cannot name it, as rows may repeat."""
    rows = []
    for i, text in zip(ids, texts):
        w, _ = table.of(text)
        n = min(SEED_WORDS, len(w))
        rows += [(i, g, k, n) for k, g in enumerate(grams(w, n).view(np.int64).tolist() if n else ())]
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow_schema(_SEEDS))], schema=arrow_schema(_SEEDS))


_SEEDS, _CODED = "item long, seed long, at int, n int", "id {kind}, row long, w binary, t binary, hits array<struct<seed:long,p:int>>"


def _seed_filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A bit for each of a bounded number of slots; fuller filters let more places through, never fewer."""
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * max(n, 1)).bit_length()))
    slot = F.pmod(F.col("seed"), F.lit(bits))
    words = seeds.select((slot / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(seed, {bits}) % 32 as int))").alias("m"))
    got = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.uint32)
    return table


def _by_shuffle(docs: DataFrame, items: DataFrame, kinds: list[str], least: float) -> DataFrame:
    """Matches by a join on seeds: ``docs(id, text)``, ``items(item, words)``."""
    spark = docs.sparkSession
    items = materialize(items.where("words is not null").withColumn("number", F.monotonically_increasing_id()), "items")
    seeds = materialize(map_rows(items, "number", "words", _seeds, _SEEDS, WordIds), "seeds")
    lengths = sorted(r[0] for r in seeds.select("n").distinct().collect())  # 1 to SEED_WORDS
    held = spark.sparkContext.broadcast(_seed_filter(seeds, seeds.count()))
    schema = arrow_schema(_CODED.format(kind=kinds[0]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits, table, row = held.value, WordIds(), TaskContext.get().partitionId() << 36
        for b in batches:
            for part in slices(b, 1):
                out = []
                for i, text in zip(*(c.to_pylist() for c in part.columns)):
                    w, at = table.of(text)
                    hits = []
                    for n in lengths:
                        g = grams(w, n)
                        slot = g.view(np.int64) & np.int64(len(bits) * 32 - 1)
                        p = np.flatnonzero((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1))
                        hits += [{"seed": x, "p": y} for x, y in zip(g.view(np.int64)[p].tolist(), p.tolist())]
                    if hits:
                        out.append((i, row, w.tobytes(), None if at is None else at.tobytes(), hits))
                    row += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    small_batches(spark)
    coded = materialize(docs.mapInArrow(code, _CODED.format(kind=kinds[0])), "coded")
    hits = coded.select("row", F.explode("hits").alias("h")).select("row", "h.seed", "h.p")
    hot = hits.groupBy("seed").agg(F.ceil(F.count("*") / HOT_SEEDS).cast("int").alias("salts")).where("salts > 1")
    hot = materialize(hot.withColumnRenamed("seed", "hot"), "hot")
    salts = F.coalesce("salts", F.lit(1))
    hits = hits.join(hot, F.col("seed") == F.col("hot"), "left").select("row", "seed", "p", F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"))
    seeds = seeds.join(hot, F.col("seed") == F.col("hot"), "left").select("item", "seed", "at", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    pairs = hits.join(seeds, ["seed", "salt"]).groupBy("row", "item").agg(F.sort_array(F.collect_set(F.col("p") - F.col("at"))).alias("offsets"))
    words = items.select("number", F.col("item").alias("item_id"), "words")
    met = pairs.join(words, F.col("item") == F.col("number")).join(coded.select("id", "row", "w", "t"), "row").select("id", "w", "t", "item_id", "words", "offsets")
    ddl = f"doc_id {kinds[0]}, {MATCHES.format(item=kinds[1])}"
    result = arrow_schema(ddl)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordIds()
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                i, w, t, item, words, offsets = (c[k].as_py() for c in b.columns)
                w, at = np.frombuffer(w, np.uint64), None if t is None else np.frombuffer(t, np.int64)
                rows += [(i, item, score, *_tokens(at, s, e)) for score, s, e in around(table.of(words)[0], w, offsets, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), result)], schema=result)

    return met.mapInArrow(check, ddl)


def _tokens(at: np.ndarray | None, start: int, stop: int) -> tuple[int, int]:
    """An interval of words as one of tokens."""
    return (start, stop) if at is None else (int(at[start]), int(at[stop - 1]) + 1)


MATCHES = "item_id {item}, score double, start_word long, stop_word long"


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
    item_text: str = "text", least: float = 0.5, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, score, start_word, stop_word`` for each passage that aligns with an item.

    ``score`` is the alignment's share of the item's own score, ``least`` or more; the interval counts tokens between
    white space.
    """
    kinds = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    ddl = f"doc_id {kinds[0]}, {MATCHES.format(item=kinds[1])}"
    names = [f.name for f in arrow_schema(ddl)]
    chosen = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("words"))
    size = chosen.agg(F.sum(F.coalesce(F.octet_length("words"), F.lit(0)) + 16)).head()[0] or 0
    if size > block_bytes:
        return _by_shuffle(docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text")), chosen, kinds, least)
    held = docs.sparkSession.sparkContext.broadcast(Items.of(sorted(map(tuple, chosen.collect()), key=str)))  # of a checked size

    def fn(ids, texts, table):
        rows = []
        for i, t in zip(ids, texts):
            w, at = table.of(t)
            rows += [(i, item, score, *_tokens(at, s, e)) for item, score, s, e in held.value.matches(w, least)]
        return dict(zip(names, zip(*rows))) if rows else None

    return map_rows(docs, doc_id, doc_text, fn, ddl, WordIds)

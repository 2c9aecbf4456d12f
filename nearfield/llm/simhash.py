"""SimHash near-dedup by the generalised pigeonhole principle.

Method: a 64-bit fingerprint per document; correlated bits are grouped into partitions; a dynamic programme gives each
partition its own threshold t_i (-1: never probed) with sum(t_i) = radius - m + 1, by estimated candidate counts. Two
fingerprints within the radius then agree within t_i on at least one partition i, so probing every partition with all
keys within t_i finds every pair; each candidate is verified on all 64 bits.

Copies are collapsed to one row per distinct fingerprint first. Inside a probed key only a spanning forest of the
verified links leaves the task. Keys with many fingerprints are cut into chunks and met chunk pair by chunk pair, so no
task holds or compares more than two chunks at a time.

:func:`near_duplicates` links by a radius on 64 bits, and finds every link. :func:`similar_documents` links by the
Jaccard similarity of word shingles: fingerprints are wider, because at similarity 0.8 some 15 percent of the bits
differ and no exact radius of that size can be probed; there the programme allots thresholds for the least cost at which
a pair of the stated similarity is missed with a probability below ``miss``, and links are verified on the shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, give_back, map_rows, materialize, release, sweep
from .pairs import id_filter, prepared, with_values
from .components import Forest, connected_components
from .words import WordIds, grams

SEED = 42
#: Most fingerprints of one chunk of a heavy key.
CHUNK = 512
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash of all ``width``-word shingles of a text, repeats included.

    A-Z is lower-cased, words are runs of anything but ASCII white space. Fewer words than ``width``: the whole
    sequence is the one shingle. Null or no words: 0. A bit is set if it is set in over half of the shingle hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
    n = max(1, len(words) - width + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[-n:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        got = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])])
        ones += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint's 64 bits as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()
    fn = lambda ids, texts: {"id": ids, "fp": [_signed(fingerprint(t, width)) for t in texts]}
    return map_rows(df, id_col, text_col, fn, f"id {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit partitions and their thresholds."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bit_moments(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, ones per bit, and joint ones per pair of bits; 64 x 65 sums per task, added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, joint = 0, np.zeros((64, 64))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            joint += bits.T @ bits
            n += len(x)
        if n:
            i, j = np.nonzero(np.triu(np.ones((64, 64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i * 64 + j, -1)), pa.array(np.append(joint[i, j].astype(np.int64), n))], ["cell", "n"]
            )

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = dict(rows)
    joint = np.zeros((64, 64))
    for cell, v in got.items():
        if cell >= 0:
            joint[cell // 64, cell % 64] = joint[cell % 64, cell // 64] = v
    return got.get(-1, 0), joint.diagonal().copy(), joint


def _distance_law(p_differ: np.ndarray) -> np.ndarray:
    """Law of the number of differing bits, bits taken as independent."""
    law = np.ones(1)
    for p in p_differ:
        law = np.convolve(law, (1 - p, p))
    return law


def _grouped(n: int, ones: np.ndarray, joint: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """64 bits in ``m`` partitions of even size; each grows by the free bit most correlated with what it holds."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1)
    free, parts = set(range(64)), []
    for k in range(m):
        size = (64 + k) // m
        part = [min(free, key=lambda b: (-corr[b, sorted(free)].max(), b))]
        free.discard(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: (corr[b, part].mean(), -b))
            part.append(b)
            free.discard(b)
        parts.append(tuple(sorted(part)))
    return parts


def make_plan(n: int, ones: np.ndarray, joint: np.ndarray, radius: int, probe_cost: float = 500.0) -> Plan:
    """Choose partitions and thresholds. ``probe_cost``: the cost of a probe row in units of a verified candidate."""
    p = ones / max(n, 1)
    differ = 2 * p * (1 - p)
    best = None
    for m in range(1, radius + 2):
        parts = _grouped(n, ones, joint, m)
        # cost[i][t]: probe rows and candidates of partition i at threshold t; -1: none.
        total = radius - m + 1
        cost = []
        for part in parts:
            law = np.cumsum(_distance_law(differ[list(part)]))
            balls = np.cumsum([math.comb(len(part), t) for t in range(total + m)])
            cost.append([0.0, *(n * (1 + balls[t]) * probe_cost + n * n / 2 * law[min(t, len(law) - 1)] for t in range(total + m))])
        table = {0: (0.0, ())}
        for c in cost:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (v, ts) in table.items():
                for t in range(-1, total + m):
                    s = used + t
                    if s not in new or v + c[t + 1] < new[s][0]:
                        new[s] = (v + c[t + 1], (*ts, t))
            table = new
        v, ts = table[total]
        if best is None or v < best[0]:
            best = (v, Plan(tuple(parts), ts))
    return best[1]


def _keys(fps: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(part):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


_ROWS = "bucket long, probe boolean, fp long, id long"


def _probes(plan: Plan):
    """Each fingerprint under its own key in every probed partition, and under the larger keys within the threshold.

    A pair with different keys is met once, where the smaller key probes the larger one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_ROWS)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part_b = b.slice(at, 4096)
                raw = part_b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, fps = part_b.column(1), raw.view(np.uint64)
                for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
                    if t < 0:
                        continue
                    keys = _keys(fps, part)
                    salt = np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    for r in range(t + 1):
                        for flips in itertools.combinations(range(len(part)), r):
                            mask = np.uint64(sum(1 << f for f in flips))
                            other = keys ^ mask
                            keep = np.nonzero(other > keys)[0] if r else np.arange(len(keys))
                            if len(keep):
                                bucket = (other[keep] * np.uint64(0xD6E8FEB86659FD93) ^ salt).view(np.int64)
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(bucket), pa.array(np.full(len(keep), r > 0)), pa.array(raw[keep]), ids.take(pa.array(keep))],
                                    schema=schema,
                                )

    return run


def _verify(radius: int):
    """Rows sorted by bucket -> a spanning forest of the pairs within the radius, one forest per task."""

    def links(own, own_ids, probe, probe_ids, forest) -> None:
        for at in range(0, len(own), 256):
            a = own[at : at + 256]
            i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ own[None, at:]) <= radius, 1))
            for x, y in zip(own_ids[at + i].tolist(), own_ids[at + j].tolist()):
                forest.join(x, y)
            if len(probe):
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ probe[None, :]) <= radius)
                for x, y in zip(own_ids[at + i].tolist(), probe_ids[j].tolist()):
                    forest.join(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def flush(cols) -> None:
            bucket, side, fps, ids = cols
            edges = np.nonzero(np.diff(bucket))[0] + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)]):
                if e - s > 1:
                    k = s + int(np.searchsorted(side[s:e], 1))
                    if k > s:
                        links(fps[s:k], ids[s:k], fps[k:e], ids[k:e], forest)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            cols = [cols[0], cols[1].astype(np.int8), cols[2].astype(np.int64).view(np.uint64), cols[3].astype(np.int64)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            first = int(np.searchsorted(cols[0], cols[0][-1]))
            flush([c[:first] for c in cols])
            held = [c[first:] for c in cols]
        if held is not None:
            flush(held)
        out = [(x, r) for x, r in forest.edges() if x != r]
        for at in range(0, len(out), 10_000):
            u, v = zip(*out[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _in_cells(rows: DataFrame, spread: str, chunk: int) -> DataFrame:
    """Deal out heavy buckets. One of c chunks becomes cells of two chunks each, which together hold all its pairs: the rows
    of chunk x go to the c cells (min(x, y), max(x, y)), each with a bucket number of its own."""
    heavy = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * chunk)
    heavy = materialize(heavy, "heavy")
    rows = rows.join(heavy, "bucket", "left").withColumn("c", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)))
    rows = rows.withColumn("x", F.pmod(F.xxhash64(spread), F.col("c")))
    rows = rows.withColumn("y", F.explode(F.expr("sequence(0L, c - 1)")))
    cell = F.xxhash64("bucket", F.least("x", "y"), F.greatest("x", "y"))
    return rows.withColumn("bucket", F.when(F.col("c") == 1, F.col("bucket")).otherwise(cell))


def links(distinct: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """``distinct(fp, id)``: each fingerprint once. Returns edges ``(u, v)`` whose components are those of all pairs
    of fingerprints with at most ``radius`` differing bits."""
    n, ones, joint = _bit_moments(distinct)
    plan = make_plan(n, ones, joint, radius)
    rows = distinct.select("fp", "id").mapInArrow(_probes(plan), _ROWS)
    rows = _in_cells(rows, "fp", chunk).select("bucket", "probe", "fp", "id")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "probe").mapInArrow(_verify(radius), "u long, v long")
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """``(id, fp, component_id)`` per document: its fingerprint and the smallest id reachable over links.

    Documents with a null id take no part (there is nothing to name them by); null and empty texts have fingerprint
    0 and link like any other; repeated ids keep their rows and share a component. An empty table gives an empty one.
    """
    fps = materialize(fingerprints(df.where(F.col(id_col).isNotNull()), id_col, text_col, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").cast("long").alias("id")), "distinct")
    parts = connected_components(links(distinct, radius))
    named = distinct.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


# ---------------------------------------------------------------------------------------------------------------------
# Links by similarity, on wide fingerprints.

#: 64-bit words of a wide fingerprint; those that travel with a probe and sift its candidates; bits of a partition.
WIDE, SIFT, PART_BITS = 12, 2, 16


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(ids: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text's word ids; a shorter text is one shingle."""
    return np.unique(grams(ids, min(width, len(ids)))) if len(ids) else np.empty(0, np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WIDE`` 64-bit words; zeros without a shingle."""
    out = np.zeros(WIDE, np.uint64)
    for k in range(WIDE if len(shingles) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), _BLOCK):
            h = _mixed(shingles[at : at + _BLOCK], k + 1)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]
    return out


def differing_share(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity (of sets of equal size)."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def allot(n: int, differ: list[np.ndarray], share: float, miss: float, probe_cost: float = 500.0) -> tuple[int, ...]:
    """A threshold (-1, 0 or 1) for each partition, least cost at which a pair is missed with probability <= ``miss``.

    ``differ``: the probability, for each bit of each partition, that it differs between two documents. Misses multiply,
    so their logarithms add up; the programme runs over these in steps of 0.02.
    """
    step, need = 0.02, -math.log(miss)
    goal = math.ceil(need / step)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for bits in differ:
        w, law = len(bits), np.cumsum(_distance_law(bits))
        hit = np.cumsum([math.comb(w, t) * share**t * (1 - share) ** (w - t) for t in range(2)])
        options = [(-1, 0.0, 0)]
        for t in range(2):
            cost = n * (1 + t * w / 2) * probe_cost + n * n / 2 * law[min(t, w)]
            options.append((t, cost, int(-math.log(1 - hit[t]) / step)))
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (v, ts) in best.items():
            for t, cost, gain in options:
                s = min(goal, have + gain)
                if s not in new or v + cost < new[s][0]:
                    new[s] = (v + cost, (*ts, t))
        best = new
    return best[max(best)][1]


_WIDE_ROWS = "bucket long, probe boolean, id long, label long, sift binary"
#: What bounds the similarity of two documents: the number of shingles, and for each of ``CLASSES`` classes of their hashes how
#: many any other document has too (16 bits; the largest value stands for any number).
_BOUNDS = "n int, shared binary"
CLASSES, _ANY = 64, 65535


def _wide_probes(plan: list[tuple[int, tuple[int, ...], int]], words: int, rows: str = _WIDE_ROWS):
    """``plan``: (word, bits, threshold) of each partition; ``words`` of the fingerprint travel with a probe, and all columns
    after the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(rows)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                cut = b.slice(at, 4096)
                ids, labels, more = cut.column(0), cut.column(2), cut.columns[3:]
                fps = np.frombuffer(b"".join(cut.column(1).to_pylist()), "<u8").reshape(-1, WIDE)
                sift = pa.array([f.tobytes() for f in fps[:, :words]], pa.binary())
                for i, (word, bits, t) in enumerate(plan):
                    keys = _keys(fps[:, word], bits)
                    salt = np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    for flip in [0, *(1 << k for k in range(len(bits)) if t > 0)]:
                        other = keys ^ np.uint64(flip)
                        keep = np.nonzero(other > keys)[0] if flip else np.arange(len(keys))
                        if len(keep):
                            bucket = (other[keep] * np.uint64(0xD6E8FEB86659FD93) ^ salt).view(np.int64)
                            at_rows = pa.array(keep)
                            cols = [pa.array(bucket), pa.array(np.full(len(keep), flip > 0)), *(c.take(at_rows) for c in (ids, labels, sift, *more))]
                            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _nearest_tree(sift: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest over pairs with at most ``within`` differing bits (Prim, row by row)."""
    n = len(sift)
    dist, via = np.full(n, 1 << 20), np.full(n, -1)
    left = np.ones(n, bool)
    a, b = [], []
    for _ in range(n):
        x = int(np.where(left, dist, 1 << 21).argmin())
        left[x] = False
        if dist[x] <= within:
            a.append(x)
            b.append(via[x])
        d = np.bitwise_count(sift ^ sift[x]).sum(axis=1, dtype=np.int64)
        near = left & (d < dist)
        dist[near], via[near] = d[near], x
    return np.array(a, np.int64), np.array(b, np.int64)


def _apart(
    sift: np.ndarray, label: np.ndarray, n: np.ndarray, shared: np.ndarray, within: int, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs with different labels, at most ``within`` differing bits and counts that allow the similarity, some rows of the
    first at a time.

    Two documents have at most the lesser ``shared`` of each class in common, so with m in all their similarity is at most
    m / (n + n' - m).
    """
    step = max(1, (1 << 17) // max(1, len(sift)))
    total = np.where((shared == _ANY).any(axis=1), 1 << 40, shared.sum(axis=1, dtype=np.int64))
    for at in range(0, len(sift), step):
        some = slice(at, at + step)
        need = similarity * (n[some, None] + n[None, at:]) / (1 + similarity) - 1e-6
        fits = (np.minimum(total[some, None], total[None, at:]) >= need) & (label[some, None] != label[None, at:])
        i, j = np.nonzero(np.triu(fits, 1))
        near = np.bitwise_count(sift[at + i] ^ sift[at + j]).sum(axis=1, dtype=np.int64) <= within
        i, j = i[near], j[near]
        common = np.minimum(shared[at + i], shared[at + j])
        keep = (common.sum(axis=1, dtype=np.int64) >= need[i, j]) | (common == _ANY).any(axis=1)
        if keep.any():
            yield at + i[keep], at + j[keep]


def _sifted(within: int, words: int, tree: bool, similarity: float, small: int = 24):
    """Rows sorted by bucket -> candidate pairs of each bucket: a minimum spanning forest of its near pairs, or (without ``tree``)
    all near pairs of rows with different labels whose counts allow the similarity.

    Distances are met first along diagonals of the sorted batch, for all buckets at once; only buckets in which some pair is near
    are looked at closer. Own-key rows and probes of a bucket count alike.
    """

    def pairs(
        bucket: np.ndarray, ids: np.ndarray, label: np.ndarray, sift: np.ndarray, *bounds: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edges = np.flatnonzero(np.diff(bucket)) + 1
        starts, stops = np.append(0, edges), np.append(edges, len(bucket))
        size = stops - starts
        hits = np.zeros(len(bucket), bool)
        at_small = np.repeat(size <= small, size)
        for shift in range(1, min(small, int(size.max()))):
            same = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & at_small[shift:])
            if not len(same):
                break
            near = same[np.bitwise_count(sift[same] ^ sift[same + shift]).sum(axis=1) <= within]
            hits[near] = True
        for k in np.flatnonzero((size > small) | (np.add.reduceat(hits, starts) > 0)).tolist():
            s, e = starts[k], stops[k]
            if tree:
                a, b = _nearest_tree(sift[s:e], within)
                yield ids[s + a], ids[s + b]
            else:
                for a, b in _apart(sift[s:e], label[s:e], *(c[s:e] for c in bounds), within, similarity):
                    yield ids[s + a], ids[s + b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3)]
            cols.append(np.frombuffer(b"".join(b.column(4).to_pylist()), "<u8").reshape(-1, words))
            if not tree:
                cols.append(b.column(5).to_numpy(zero_copy_only=False).astype(np.int64))
                cols.append(np.frombuffer(b"".join(b.column(6).to_pylist()), "<u2").reshape(-1, CLASSES))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            first = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[first:] for c in cols]
            if first:
                yield from emit(pairs(*(c[:first] for c in cols)))
        if held is not None:
            yield from emit(pairs(*held))
        give_back()

    def emit(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for part in itertools.chain(found, [None]):
            if part is not None:
                parts.append(part)
                size += len(part[0])
            if parts and (part is None or size > 100_000):
                a, b = (np.concatenate(x) for x in zip(*parts))
                both = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)])[a != b], axis=0)
                parts, size = [], 0
                if len(both):
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def wide_plan(fps: DataFrame, similarity: float, miss: float) -> list[tuple[int, tuple[int, ...], int]]:
    """(word, bits, threshold) of the partitions that are probed, for ``fps(id, fp)``: distinct wide fingerprints."""
    differ, parts, n = [], [], 0
    for word in range(WIDE):
        value = F.conv(F.hex(F.reverse(F.substring("fp", 8 * word + 1, 8))), 16, -10).cast("long")
        n, ones, joint = _bit_moments(fps.select(value.alias("fp")))
        plan = _grouped(n, ones, joint, 64 // PART_BITS)
        p = ones / max(n, 1)
        for bits in plan:
            parts.append((word, bits))
            differ.append(2 * p[list(bits)] * (1 - p[list(bits)]))
    thresholds = allot(n, differ, differing_share(similarity), miss)
    return [(word, bits, t) for (word, bits), t in zip(parts, thresholds) if t >= 0]


def similar_pairs(fps: DataFrame, plan: list, similarity: float, tree: bool = True, chunk: int = 2048) -> DataFrame:
    """``fps(id, fp, label)`` -> candidate pairs ``(a, b)``, a > b: of each bucket a spanning forest, or all with different labels.

    Pairs are candidates if their bits differ no more than at five standard deviations above the share of ``similarity``; a
    forest is sifted by ``SIFT`` words, the pairs of the second kind by all, and by the bounds ``n, shared`` of :func:`_bounds`,
    which ``fps`` has then.
    """
    words, share = SIFT if tree else WIDE, differing_share(similarity)
    within = math.ceil(64 * words * share + 5 * math.sqrt(64 * words * share * (1 - share)))
    ddl = _WIDE_ROWS if tree else f"{_WIDE_ROWS}, {_BOUNDS}"
    bounds = [] if tree else ["n", "shared"]
    rows = fps.select("id", "fp", "label", *bounds).mapInArrow(_wide_probes(plan, words, ddl), ddl)
    if bounds:
        rows = rows.withColumnRenamed("n", "shingles")  # a bucket's count goes by that name
    rows = _in_cells(rows, "id", chunk).select("bucket", "probe", "id", "label", "sift", *(["shingles", "shared"] if bounds else []))
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_sifted(within, words, tree, similarity), "a long, b long").distinct()


def _bounds(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(id, n, shared)`` of the documents in ``ids(id)``: their shingles, and by class how many another one of these has too.

    Counted by two aggregations, without a join on shingles, so a shingle of very many documents is no hot key. An id with
    several texts has the least ``n`` and any number of shared ones.
    """
    schema = arrow_schema("id long, n int, shingle long")

    def fn(ids, texts, table):
        sets = [shingle_set(table.of(t)[0], width) for t in texts]
        sizes = np.array([len(x) for x in sets], np.int32)
        cols = [np.repeat(np.array(ids, np.int64), sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = []
            for several, held in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                counts = np.full(CLASSES, _ANY)
                if not several:
                    counts[:] = 0
                    for c in held:
                        counts[c["class"]] = min(c["c"], _ANY)
                shared.append(counts.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.binary())], ["id", "n", "shared"])

    held = texts.where(id_filter(ids)(F.col("id"))).join(ids, "id", "left_semi")
    rows = materialize(map_rows(held, "id", "text", fn, "id long, n int, shingle long", WordIds), "shingles")
    kind = F.pmod("shingle", F.lit(CLASSES)).cast("int").alias("class")
    all_of = rows.groupBy("id", kind).agg(F.min("n").alias("n"), F.count("*").alias("c"))
    once = rows.groupBy("shingle").agg(F.count("*").alias("seen"), F.min("id").alias("id")).where("seen = 1")
    own = once.groupBy("id", kind).agg(F.count("*").alias("own"))
    left = all_of.join(own, ["id", "class"], "left").withColumn("left", F.col("c") - F.coalesce("own", F.lit(0)))
    packed = left.groupBy("id").agg(
        F.min("n").alias("n"),
        (F.sum("c") != F.min("n")).alias("several"),
        F.collect_list(F.struct("class", F.col("left").alias("c"))).alias("held"),
    )
    out = materialize(packed.mapInArrow(by_class, f"id long, {_BOUNDS}"), "bounds")
    release(rows)
    return out


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs, as ``(u, v)``, whose shingle sets have that Jaccard similarity."""

    def code(ids, texts, table):
        sets = [shingle_set(table.of(t)[0], width) for t in texts]
        return {"id": ids, "s": [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in sets]}  # half the bytes to ship

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            keep, held = np.zeros(b.num_rows, bool), (None, None)
            for k in range(b.num_rows):
                if held[0] != (head := b.column(at["b"])[k].as_py()):
                    held = (head, np.frombuffer(b.column(at["s_b"])[k].as_py(), np.uint32))
                x, y = np.frombuffer(b.column(at["s_a"])[k].as_py(), np.uint32), held[1]
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both >= similarity * (len(x) + len(y) - both) and both > 0
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(at["a"]).take(rows), b.column(at["b"]).take(rows)], ["u", "v"])
        give_back()

    values = prepared(pairs, texts, code, "s binary", WordIds)
    out = materialize(with_values(pairs, values).mapInArrow(verify, "u long, v long"), "links")
    release(values)
    sweep(texts.sparkSession)
    return out


def similar_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, miss: float = 0.02
) -> DataFrame:
    """``(id, component_id)`` of documents that share ``width``-word shingles with Jaccard ``similarity`` or more.

    Only documents with a link are returned; ``component_id`` is the smallest id of the component. Candidates of a bucket are
    thinned to a spanning forest and verified; where a link of a forest fails, all near pairs of that group that the verified
    links do not join are verified in a second round, so thinning loses no link. That round leaves out pairs that cannot reach the
    similarity, given the shingles that no other document there has. Documents with equal wide fingerprints are
    taken as copies; texts without words are copies only where the texts are equal. A pair of just that similarity is no
    candidate with probability ``miss`` at most, more similar pairs are missed less. Null ids take no part; repeated ids
    count as one document; null texts are texts without words.
    """

    def fn(ids, texts, table):
        rows = [shingle_set(table.of(t)[0], width) for t in texts]
        wordless = [None if len(r) else xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for r, t in zip(rows, texts)]
        return {"id": ids, "fp": [w or wide_fingerprint(r).tobytes() for w, r in zip(wordless, rows)]}

    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fps = materialize(map_rows(texts, "id", "text", fn, "id long, fp binary", WordIds), "wide")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    copies = fps.join(distinct.withColumnRenamed("id", "first"), "fp").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    worded = distinct.where(F.octet_length("fp") == 8 * WIDE)  # a digest of a text without words is shorter
    plan = wide_plan(worded, similarity, miss)
    pairs = materialize(similar_pairs(worded.withColumn("label", F.lit(0).cast("long")), plan, similarity), "pairs")
    found = _similar(pairs, texts, width, similarity)
    # A true link can be lost with a forest's failed one only among documents that candidates join and verified links do not.
    joined = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    verified = connected_components(found).withColumnRenamed("component", "label")
    label = joined.join(verified, "id", "left").select("id", "component", F.coalesce("label", "id").alias("label"))
    label = materialize(label, "labels")
    split = label.groupBy("component").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("component")
    split = materialize(split, "split")
    if not split.isEmpty():
        some = materialize(label.join(split, "component", "left_semi").select("id", "label"), "some")
        bounds = _bounds(some.select("id"), texts, width)
        rows = worded.join(some, "id").join(bounds, "id").select("id", "fp", "label", "n", "shared")
        more = materialize(similar_pairs(rows, plan, similarity, tree=False).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = found.union(_similar(more, texts, width, similarity))
        release(some, bounds, more)
    links = found.union(verified.select(F.col("id").alias("u"), F.col("label").alias("v"))).union(copies)
    out = connected_components(links).withColumnRenamed("component", "component_id")
    release(fps, distinct, pairs, label, split)
    sweep(df.sparkSession)
    return out

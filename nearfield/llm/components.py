"""Connected components of an edge table, without a driver-side graph.

Alternating large-star and small-star steps on a table of integer edges; each round is two partial-aggregated
group-bys and joins, and its result is written to the shared scratch folder. Rounds grow with the logarithm of the
longest chain, not with the number of edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


class Forest:
    """Union-find with the smallest id as root; what a task has seen becomes one star per local component."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def edges(self) -> Iterator[tuple[int, int]]:
        for x in list(self.up):
            yield x, self.find(x)


def star_edges(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(member, smallest member) for each local component of ``pairs``."""
    f = Forest()
    for a, b in pairs:
        f.join(a, b)
    return [(x, r) for x, r in f.edges() if x != r]


#: Nodes with more links than this (and than a share of all links that at most ``HOT_NODES`` nodes can have) are hot.
HOT_LINKS, HOT_NODES = 512, 100_000


def _with_least(e: DataFrame, least: DataFrame, hot_links: int | None) -> DataFrame:
    """``e(u, v)`` with the ``m`` of ``least(c, m, n)`` for its u. Nodes with many links, a bounded number, are not shuffled to but
    broadcast, so that no task gets all links of one of them."""
    if hot_links is None:
        return e.join(least, F.col("u") == F.col("c")).select("u", "v", "m")
    hot = materialize(least.where(F.col("n") > hot_links).select(F.col("c").alias("h"), F.col("m").alias("hm")), "hot")
    marked = e.join(F.broadcast(hot), F.col("u") == F.col("h"), "left")
    cold = marked.where("h is null").join(least.where(F.col("n") <= hot_links), F.col("u") == F.col("c"))
    return cold.select("u", "v", "m").union(marked.where("h is not null").select("u", "v", F.col("hm").alias("m")))


def _large_star(e: DataFrame, hot_links: int | None) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least, hot_links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, hot_links: int | None) -> DataFrame:
    least = e.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(e, least, hot_links).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of long ids -> ``(id, component)`` for every id in an edge; component is its smallest id.

    Null ends, loops and repeated edges are ignored. An empty table gives an empty table. Raises when the star form
    isn't reached in ``max_rounds`` rounds (a chain of 2**60 links), rather than return wrong labels.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = materialize(e.distinct(), "edges")
    mark, links = None, e.count()
    for _ in range(max_rounds):
        hot = max(HOT_LINKS, 2 * links // HOT_NODES)
        if links <= hot:  # no node can be hot
            step = materialize(_small_star(_large_star(e, None), None).where("u > v"), "edges")
        else:
            large = materialize(_large_star(e, hot), "edges")
            step = materialize(_small_star(large, hot).where("u > v"), "edges")
            release(large)
        release(e)
        e = step
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if tuple(row) == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        mark, links = tuple(row), row[0]
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


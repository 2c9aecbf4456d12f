"""The life of an index: ingest, delete, flush, merge, rebuild and recovery over immutable Parquet files.

The state is a manifest; each change writes new files and then commits the next generation of the manifest, whose file
name holds its number, by a rename. A reader of a generation sees just the files it names, so all readers of one
generation get equal results. Rows carry the sequence number ``sid`` of their batch; a tombstone deletes the rows of its
id with a smaller number, which makes an upsert a tombstone and an append. A batch with a known ``batch_id`` is skipped,
so a restarted stream does not insert twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ivf import IvfIndex

# Rows of a growing batch, and the thresholds of the merge policy.
MEMTABLE_ROWS, SMALL_SEGMENT, MAX_SEGMENT, DELETED_SHARE = 50_000, 1_000_000, 2_000_000, 0.1


@dataclass
class State:
    generation: int = 0
    next_sid: int = 1
    segments: list[dict] = field(default_factory=list)  # path, first, last, rows, flat
    deltas: list[dict] = field(default_factory=list)  # path, sid, rows
    tombstones: list[dict] = field(default_factory=list)  # path, sid
    batches: list[str] = field(default_factory=list)  # named batches that were inserted
    streams: dict[str, int] = field(default_factory=dict)  # the last batch of each numbered sequence (``name#number``)
    log: list[dict] = field(default_factory=list)  # the last events; older ones are in the manifests before

    def knows(self, batch_id: str | None) -> bool:
        name, _, number = (batch_id or "").rpartition("#")
        if name and number.isdigit():
            return self.streams.get(name, -1) >= int(number)
        return batch_id is not None and batch_id in self.batches

    def learn(self, batch_id: str | None) -> None:
        name, _, number = (batch_id or "").rpartition("#")
        if name and number.isdigit():
            self.streams[name] = int(number)
        elif batch_id is not None:
            self.batches.append(batch_id)


#: Events that a manifest repeats.
LOG_LENGTH = 100


class _Files:
    """The few file operations of the manifest, in whatever store the path is."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark.sparkContext._jvm
        self.base = self.jvm.org.apache.hadoop.fs.Path(base)
        self.fs = self.base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.base, name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def commit(self, name: str, text: str) -> None:
        """Write and rename; fails if another writer has committed that name."""
        tmp = self.path(f"manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self.path(name)
        if self.fs.exists(target) or not self.fs.rename(tmp, target):
            self.fs.delete(tmp, False)
            raise RuntimeError(f"generation {name} was committed by another writer")

    def read(self, spark: SparkSession, name: str) -> str:
        return "\n".join(r[0] for r in spark.read.text(str(self.path(name).toString())).collect())


class LsmIndex:
    """An index with inserts and deletes; searches read the segments' probed lists and all unflushed batches."""

    def __init__(self, spark: SparkSession, path: str, generation: int | None = None):
        self.spark, self.path, self.files = spark, path, _Files(spark, path)
        found = sorted(int(n[4:-5]) for n in self.files.names("manifest") if n.startswith("gen-"))
        if not found:
            raise FileNotFoundError(f"no manifest in {path}")
        g = found[-1] if generation is None else generation
        self.state = State(**json.loads(self.files.read(spark, f"manifest/gen-{g:010d}.json")))
        self.ivf = IvfIndex.load(spark, f"{path}/centres")

    @classmethod
    def create(cls, df: DataFrame, path: str, vector: str = "vector", id_col: str = "id", metric: str = "l2", lists: int = 100, seed: int = 42) -> LsmIndex:
        """Fit the lists on ``df`` (may be empty) and store its rows as the first segment."""
        spark = df.sparkSession
        IvfIndex.build(df, f"{path}/centres", vector, id_col, metric, lists=lists, seed=seed)
        files = _Files(spark, path)
        files.commit(f"manifest/gen-{0:010d}.json", json.dumps(State().__dict__))
        index = cls(spark, path)
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector")).where("vector is not null")
        index._add_segment(rows.withColumn("sid", F.lit(0).cast("long")), 0, 0)
        index._commit("create")
        return index

    def _commit(self, event: str, **more) -> int:
        s = self.state
        s.generation += 1
        s.log = [*s.log, {"generation": s.generation, "event": event} | more][-LOG_LENGTH:]
        self.files.commit(f"manifest/gen-{s.generation:010d}.json", json.dumps(s.__dict__))
        return s.generation

    def _write(self, df: DataFrame, kind: str, by_list: bool = False) -> tuple[str, int]:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        w = df.hint("rebalance", F.col("list_id")).write.partitionBy("list_id") if by_list else df.write
        w.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path).count()

    def _add_segment(self, rows: DataFrame, first: int, last: int, flat: bool = False) -> None:
        path, n = self._write(self._assigned(rows), "segment", True)
        if n:
            self.state.segments.append({"path": path, "first": first, "last": last, "rows": n, "flat": flat})
            self.state.segments.sort(key=lambda s: s["first"])

    def _assigned(self, rows: DataFrame) -> DataFrame:
        """Rows with their list."""
        return self.ivf.assign(rows.select("id", "vector", "sid"))

    # -- changes ----------------------------------------------------------------------------------------------------

    def insert(
        self, df: DataFrame, batch_id: str | None = None, vector: str = "vector", id_col: str = "id",
        replaced: DataFrame | None = None, expired: DataFrame | None = None,
    ) -> bool:
        """Append a batch; False if ``batch_id`` was inserted before (of ids ``name#number``: that number or a later one of the
        name). Null vectors are not stored. ``replaced`` holds ids whose older rows are deleted, ``expired`` ids of which no row
        stays, in the same commit: a crash leaves all of it or nothing."""
        s = self.state
        if s.knows(batch_id):
            return False
        if replaced is not None:
            self._tombstone(replaced, id_col)
        sid = s.next_sid
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector")).where("vector is not null")
        path, n = self._write(rows.withColumn("sid", F.lit(sid).cast("long")), "delta")
        s.next_sid += 1
        if n:
            s.deltas.append({"path": path, "sid": sid, "rows": n})
        if expired is not None:
            self._tombstone(expired, id_col)
        s.learn(batch_id)
        self._commit("insert", sid=sid, rows=n)
        if sum(d["rows"] for d in s.deltas) > MEMTABLE_ROWS:
            self.flush()
        return True

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        """Delete the rows of these ids that are stored now."""
        self._tombstone(ids, id_col)
        self._commit("delete", sid=self.state.next_sid - 1)

    def _tombstone(self, ids: DataFrame, id_col: str) -> None:
        s = self.state
        rows = ids.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("sid", F.lit(s.next_sid).cast("long"))
        path, _ = self._write(rows, "tombstones")
        s.tombstones.append({"path": path, "sid": s.next_sid})
        s.next_sid += 1

    def upsert(self, df: DataFrame, batch_id: str | None = None, vector: str = "vector", id_col: str = "id") -> bool:
        return self.insert(df, batch_id, vector, id_col, replaced=df)

    def flush(self) -> None:
        """Turn all unflushed batches into a segment."""
        s = self.state
        if s.deltas:
            rows, done = self._live(self._union([d["path"] for d in s.deltas], False)), s.deltas
            s.deltas = []
            self._add_segment(rows.select("id", "vector", "sid"), done[0]["sid"], done[-1]["sid"])
            self._commit("flush", first=done[0]["sid"], last=done[-1]["sid"])

    # -- reading ----------------------------------------------------------------------------------------------------

    def _union(self, paths: list[str], lists: bool) -> DataFrame:
        kind = "array<float>"
        ddl = f"id long, vector {kind}, sid long" + (", list_id int" if lists else "")
        out = self.spark.createDataFrame([], ddl)
        for p in paths:
            out = out.unionByName(self.spark.read.schema(ddl).parquet(p))
        return out

    def _tombstones(self) -> DataFrame:
        rows = self.spark.createDataFrame([], "id long, sid long")
        for t in self.state.tombstones:
            rows = rows.union(self.spark.read.schema("id long, sid long").parquet(t["path"]))
        return rows.groupBy("id").agg(F.max("sid").alias("sid"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows without a later tombstone."""
        if self.state.tombstones:
            dead = self._tombstones().select(F.col("id").alias("_i"), F.col("sid").alias("_s"))
            rows = rows.join(dead, (F.col("id") == F.col("_i")) & (F.col("sid") < F.col("_s")), "left_anti")
        return rows

    def rows(self) -> DataFrame:
        """All live rows ``id, vector``; of rows with one id the latest."""
        s = self.state
        every = self._union([x["path"] for x in s.segments], True).drop("list_id").unionByName(self._union([d["path"] for d in s.deltas], False))
        return self._live(every).groupBy("id").agg(F.max_by("vector", "sid").alias("vector"))

    def search(self, query, k: int, probes: int | None = None) -> DataFrame:
        """``id, distance``: probed lists of every segment and all unflushed rows, without deleted ones; of rows
        with one id the latest that was read."""
        s = self.state
        near = self.ivf.nearest_lists(query)[: self.ivf.probes_for(self.spark, probes, None)]
        flushed = self._union([x["path"] for x in s.segments], True).where(F.col("list_id").isin(near)).drop("list_id")
        rows = self._live(flushed.unionByName(self._union([d["path"] for d in s.deltas], False)))
        rows = rows.select("id", "sid", self.ivf.distance(query).alias("distance"))
        return rows.groupBy("id").agg(F.max_by("distance", "sid").alias("distance")).orderBy("distance", "id").limit(k)

    # -- maintenance ------------------------------------------------------------------------------------------------

    def _deleted(self, segment: dict) -> int:
        rows = self._union([segment["path"]], True)
        return rows.count() - self._live(rows).count()

    def plan(self) -> tuple[str, list[dict]] | None:
        """The next piece of maintenance: rebuild a flat segment, merge small ones, rebuild one with over a tenth of its rows
        deleted, merge middle-sized ones; a partner is the smaller neighbour that keeps the sum within bounds."""
        segs = self.state.segments
        for s in segs:
            if s["flat"]:
                return "rebuild", [s]

        def partner(at: int, most: int) -> dict | None:
            near = [segs[k] for k in (at - 1, at + 1) if 0 <= k < len(segs) and segs[k]["rows"] + segs[at]["rows"] < most]
            return min(near, key=lambda x: x["rows"], default=None)

        for rule, most in (("merge", MEMTABLE_ROWS), ("deleted", 0), ("merge", SMALL_SEGMENT), ("merge", MAX_SEGMENT)):
            for at, s in enumerate(segs):
                if rule == "deleted":
                    if self.state.tombstones and self._deleted(s) > DELETED_SHARE * s["rows"]:
                        return "rebuild", [s]
                elif s["rows"] <= most and (p := partner(at, MAX_SEGMENT)):
                    return "merge", [s, p]
        return None

    def compact(self, steps: int = 100) -> int:
        """Run maintenance until nothing is due; the number of steps taken."""
        for done in range(steps):
            job = self.plan()
            if job is None:
                return done
            what, segs = job
            rows = self._live(self._union([s["path"] for s in segs], True)).select("id", "vector", "sid")
            self.state.segments = [s for s in self.state.segments if s not in segs]
            self._add_segment(rows, min(s["first"] for s in segs), max(s["last"] for s in segs))
            self._commit(what, first=segs[0]["first"], last=segs[-1]["last"])
        return steps

    def vacuum(self) -> None:
        """Write deleted rows out of all segments, then forget the tombstones that no stored row is older than."""
        self.flush()
        s = self.state
        if s.tombstones:
            segs, s.segments = s.segments, []
            for x in segs:
                self._add_segment(self._live(self._union([x["path"]], True)).select("id", "vector", "sid"), x["first"], x["last"])
            s.tombstones = []
            self._commit("vacuum")

"""Readers and writers of vector benchmark files: fvecs, bvecs, ivecs (a header per vector), fbin, bbin (one header)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element type of each format, little-endian.
PER_VECTOR = {"fvecs": "<f4", "bvecs": "<u1", "ivecs": "<i4"}
ONE_HEADER = {"fbin": "<f4", "bbin": "<u1"}


def decode(raw: bytes, fmt: str) -> np.ndarray:
    """The vectors of a whole file (or of whole records of one) as a matrix."""
    if fmt in PER_VECTOR:
        kind = np.dtype(PER_VECTOR[fmt])
        if not raw:
            return np.empty((0, 0), kind)
        dim = int(np.frombuffer(raw, "<i4", 1)[0])
        width = 4 + dim * kind.itemsize
        if dim < 1 or len(raw) % width:
            raise ValueError(f"{fmt}: {len(raw)} bytes are not whole vectors of {dim} elements")
        rows = np.frombuffer(raw, np.uint8).reshape(-1, width)
        if (np.ascontiguousarray(rows[:, :4]).view("<i4") != dim).any():
            raise ValueError(f"{fmt}: vectors of different dimensions")
        return np.ascontiguousarray(rows[:, 4:]).view(kind)
    n, dim = np.frombuffer(raw, "<i4", 2).tolist()
    return np.frombuffer(raw, ONE_HEADER[fmt], n * dim, 8).reshape(n, dim)


def encode(x: np.ndarray, fmt: str) -> bytes:
    if fmt in PER_VECTOR:
        body = np.ascontiguousarray(x, PER_VECTOR[fmt]).view(np.uint8).reshape(len(x), -1)
        head = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
        return np.hstack([head, body]).tobytes()
    return np.array(x.shape, "<i4").tobytes() + np.ascontiguousarray(x, ONE_HEADER[fmt]).tobytes()


def read_vectors(spark: SparkSession, path: str, fmt: str | None = None, dim: int | None = None) -> DataFrame:
    """``id, vector`` of the files at ``path``; ids count from 0 in file order.

    With ``dim`` a file of records is read in splits, so that its size does not matter; otherwise a file is one task.
    """
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt not in PER_VECTOR | ONE_HEADER:
        raise ValueError(f"unknown vector format {fmt!r}")
    element = "int" if fmt == "ivecs" else "float"
    if dim is not None and fmt in PER_VECTOR:
        width = 4 + dim * np.dtype(PER_VECTOR[fmt]).itemsize
        records = spark.sparkContext.binaryRecords(path, width).zipWithIndex()
        rows = records.map(lambda r: (r[1], decode(bytes(r[0]), fmt)[0].tolist()))
        if element == "float":
            rows = rows.map(lambda r: (r[0], [float(v) for v in r[1]]))
        return spark.createDataFrame(rows, f"id long, vector array<{element}>")
    kind = pa.int32() if element == "int" else pa.float32()
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(decode(raw.as_py(), fmt)) for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["path", "n"])

    base, total = {}, 0
    for name, n in sorted(files.mapInArrow(count, "path string, n long").collect()):  # a row a file
        base[name], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = decode(raw.as_py(), fmt)
                for at in range(0, len(x), 8192):
                    part = x[at : at + 8192]
                    offsets = pa.array(np.arange(0, part.size + 1, x.shape[1], dtype=np.int32))
                    flat = pa.array(np.ascontiguousarray(part).ravel().astype(kind.to_pandas_dtype()))
                    ids = np.arange(base[name] + at, base[name] + at + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, flat)], ["id", "vector"])

    return files.mapInArrow(run, f"id long, vector array<{element}>")


def write_vector_files(df: DataFrame, folder: str, fmt: str, vector: str = "vector", id_col: str = "id") -> int:
    """A file for each range of ``id_col`` in a folder that all machines share, written by the executors; the number of vectors.

    Files are named in the order of the ids, so :func:`read_vectors` of the folder counts them in that order. A file appears
    whole, by a rename, so a task that is run again leaves one.
    """
    if fmt not in PER_VECTOR | ONE_HEADER:
        raise ValueError(f"unknown vector format {fmt!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores
        from pyspark import TaskContext

        parts = [b.column(0) for b in batches if b.num_rows]
        if parts:
            store, base = stores.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            x = np.concatenate([p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1) for p in parts])
            task = TaskContext.get()
            name = f"{base}/part-{task.partitionId():06d}.{fmt}"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(encode(x, fmt))
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64())], ["n"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(vector).isNotNull()).repartitionByRange(parts, id_col).sortWithinPartitions(id_col)
    return rows.select(vector).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def write_vectors(df: DataFrame, path: str, fmt: str, vector: str = "vector", id_col: str = "id") -> None:
    """One local file with the vectors in the order of ``id_col``, streamed from the executors partition by partition."""
    rows = df.select(vector).orderBy(id_col) if id_col not in (vector,) else df.select(vector)
    n = df.count() if fmt in ONE_HEADER else 0
    with open(path, "wb") as f:
        batch, first = [], True
        for r in rows.toLocalIterator():
            batch.append(r[0])
            if len(batch) == 4096:
                first = _put(f, batch, fmt, n, first)
                batch = []
        if batch:
            first = _put(f, batch, fmt, n, first)
        if first and fmt in ONE_HEADER:
            f.write(np.array([0, 0], "<i4").tobytes())


def _put(f, batch: list, fmt: str, n: int, first: bool) -> bool:
    x = np.array(batch)
    if fmt in PER_VECTOR:
        f.write(encode(x, fmt))
    else:
        if first:
            f.write(np.array([n, x.shape[1]], "<i4").tobytes())
        f.write(np.ascontiguousarray(x, ONE_HEADER[fmt]).tobytes())
    return False


def read_ground_truth(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour ids and distances of a ground-truth file: counts n and k, n * k ids, n * k distances."""
    n, k = np.frombuffer(raw, "<i4", 2).tolist()
    ids = np.frombuffer(raw, "<u4", n * k, 8).reshape(n, k)
    return ids, np.frombuffer(raw, "<f4", n * k, 8 + 4 * n * k).reshape(n, k)

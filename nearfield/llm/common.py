"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.storage import fresh_path

#: Bytes of text that a Python worker takes apart at once, and rows of one Arrow batch of whole texts.
SLICE_BYTES, BATCH_ROWS = 4 << 20, 2048
#: Rows of a Parquet row group that a writer holds back, in bytes.
_ROW_GROUP = 16 << 20
#: Lets Spark delete the shuffle files of a statement as soon as it has ended, rather than when the driver's garbage is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input table, read through Spark (the path may be in any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`materialize`, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so when the driver's garbage is collected."""
    gc.collect()
    if (jvm := spark.sparkContext._jvm) is not None:
        jvm.System.gc()


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers are kept for later tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared scratch folder and read it back.

    Survives the loss of any executor, unlike a cache or a local checkpoint. The shuffle files of the write go with its end:
    nothing reads them once the table is there.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    small_batches(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    atexit.register(_quietly, spark, path)
    return out


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is already gone at interpreter exit
        return


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold ``BATCH_ROWS`` rows at most, as rows here are whole texts."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: int, max_rows: int = BATCH_ROWS, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``max_rows`` rows and about ``max_bytes`` bytes of a text column (a longer text is a part)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < batch.num_rows:
        stop = min(max(int(np.searchsorted(ends, done + max_bytes, "right")), at + 1), at + max_rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def map_rows(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: Callable[[list, list], dict[str, list] | pa.RecordBatch | None],
    schema: str,
    ctx: Callable[[], object] | None = None,
    max_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Apply ``fn(ids, texts[, ctx])`` to slices of bounded rows and bytes, inside one Arrow stage.

    Only the two named columns are read, so other columns of the input never clash with the output.
    ``ctx`` is called once per task.
    """
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        args = () if ctx is None else (ctx(),)
        for b in batches:
            for part in slices(b, 1, max_rows):
                out = fn(part.column(0).to_pylist(), part.column(1).to_pylist(), *args)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
                del part, out
        give_back()

    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return chosen.mapInArrow(run, schema)


_PLAIN = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(),
    "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
}


def _fields(text: str, sep: str) -> list[tuple[str, str]]:
    """``name<sep>type`` items between the commas outside of angle brackets."""
    items, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            items.append("")
        else:
            items[-1] += c
    return [tuple(x.strip() for x in i.strip().split(sep, 1)) for i in items]


def _arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    if name.startswith("struct<"):
        return pa.struct([pa.field(n, _arrow_type(t)) for n, t in _fields(name[7:-1], ":")])
    return _PLAIN[name]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string; needs no session, so tasks can call it."""
    return pa.schema([pa.field(n, _arrow_type(t)) for n, t in _fields(ddl, " ")])

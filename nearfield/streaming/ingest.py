"""Streams into an index, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lsm import LsmIndex


def ingest(stream: DataFrame, index_path: str, checkpoint: str, vector: str = "vector", id_col: str = "id", upsert: bool = False, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of ``stream`` to the index; a batch replayed after a restart is skipped by its number."""

    def put(batch: DataFrame, number: int) -> None:
        index = LsmIndex(batch.sparkSession, index_path)
        (index.upsert if upsert else index.insert)(batch, f"{checkpoint}#{number}", vector, id_col)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def slide(index: LsmIndex, new_rows: DataFrame, expired_ids: DataFrame, batch_id: str | None = None) -> bool:
    """One step of a sliding window: insert the new rows and delete the expired ids, in one commit; False for a known batch."""
    return index.insert(new_rows, batch_id, expired=expired_ids)


def tumbling(events: DataFrame, width: str, by: list[str | Column], value: str = "value", time: str = "ts", late: str | None = None) -> DataFrame:
    """Count and sum of ``value`` per window of ``width`` and ``by``; with ``late``, a watermark for streams."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))

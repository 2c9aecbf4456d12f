"""Global ranks without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_path


def global_rank(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's number (from 1) in ascending order of ``order``, which should name every row.

    Rows are range-partitioned by the order and numbered within their partition; a partition starts where the counts of
    those before it end. The partitioned rows are written to the shared scratch folder, so that counts and rows agree.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "ranked")
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    start, starts = 0, []
    for r in sorted(rows.groupBy("_part").count().collect()):  # a row a partition
        starts += [F.lit(r[0]), F.lit(start)]
        start += r[1]
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return rows.withColumn(name, local + F.create_map(*starts)[F.col("_part")]).drop("_part")

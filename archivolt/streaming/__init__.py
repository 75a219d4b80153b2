"""Structured Streaming over the event tables; each run drains what is there and can be resumed.

State is bounded by watermarks. Aggregates run in update mode: every batch
appends the groups that it changed, and the last state of a group counts, so a
run that is repeated or resumed changes nothing that was right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from archivolt.session import materialize


def arriving(df: DataFrame, column: str, folder: str, parts: int = 4) -> DataFrame:
    """A stream that reads ``df`` in the order of ``column``, one file a trigger, as it would arrive.

    The files are written one after the other: the source takes them by age.
    """
    rows = materialize(df.withColumn("_at", F.col(column).try_cast("timestamp").cast("double")).where("_at is not null"), f"{folder}/rows")
    cuts = rows.approxQuantile("_at", [i / parts for i in range(1, parts)], 0.001)
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows
        if low is not None:
            part = part.where(F.col("_at") > low)
        if high is not None:
            part = part.where(F.col("_at") <= high)
        part.drop("_at").coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
    return read_folder(df.sparkSession, df.schema, f"{folder}/arrived")


def read_folder(spark: SparkSession, schema, path: str) -> DataFrame:
    """A stream of the files of a folder, one a trigger, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_time(df: DataFrame, column: str, watermark: str, name: str = "at") -> DataFrame:
    """``column`` as a timestamp with a watermark; rows without a readable time are dropped."""
    return df.withColumn(name, F.col(column).try_cast("timestamp")).where(F.col(name).isNotNull()).withWatermark(name, watermark)


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Run the stream to the end of its input into Parquet and read it back; a lost run resumes from its checkpoint."""
    spark = df.sparkSession
    job = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def drain_updates(df: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode; of each group the state of the last batch that changed it.

    A batch overwrites its own folder, so one that runs again counts once.
    """
    spark = df.sparkSession
    schema = df.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    job = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update")
    job.trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).option("basePath", f"{folder}/updates").parquet(f"{folder}/updates")
    rest = [c for c in df.columns if c not in keys]
    return held.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest]).select(*df.columns)

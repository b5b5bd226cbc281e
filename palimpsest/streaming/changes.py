"""Incremental saves of an arriving manifest: change capture by foreachBatch over a written state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class StateTable:
    """The last state (path, blob_hash) as a Parquet folder for each batch; `_batch` names the current one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def at(self, batch: int) -> DataFrame:
        return self.spark.read.schema("path string, blob_hash string").parquet(f"{self.folder}/state/{batch}")

    def put(self, batch: int, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")

    def changes(self) -> DataFrame:
        return self.spark.read.schema("path string, blob_hash string, change string, batch bigint").parquet(f"{self.folder}/changes/*")


def changes_of(state: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, blob_hash, change) for arriving (path, blob_hash); a null hash is a deletion; the last of a path wins by greatest version."""
    last = rows.groupBy("path").agg(F.max_by("blob_hash", "version").alias("new_hash"))
    both = last.join(state, "path", "left")
    change = F.when(F.col("new_hash").isNull(), F.when(F.col("blob_hash").isNotNull(), "delete")).when(F.col("blob_hash").isNull(), "insert").when(F.col("blob_hash") != F.col("new_hash"), "update")
    return both.select("path", F.col("new_hash").alias("blob_hash"), change.alias("change")).where("change is not null")


def capture(arriving: DataFrame, folder: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Writes the changes of each micro-batch and the state after it; a batch that is run again writes the same folders again."""
    spark = arriving.sparkSession
    table = StateTable(spark, folder)
    empty = spark.createDataFrame([], "path string, blob_hash string")

    def apply(rows: DataFrame, batch: int) -> None:
        state = table.at(batch - 1) if batch else empty
        found = changes_of(state, rows)
        found.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/{batch}")
        done = spark.read.parquet(f"{folder}/changes/{batch}")
        kept = state.join(done.select("path"), "path", "left_anti").unionByName(done.where("change <> 'delete'").select("path", "blob_hash"))
        table.put(batch, kept)

    stream = arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

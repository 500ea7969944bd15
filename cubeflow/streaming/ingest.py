"""Continuous import: traces or voxels that arrive as a stream become bricks of a volume, batch by batch.

Each micro-batch is written once, under its batch id, so a batch that is run again after a failure
replaces itself.  Readers merge the batches: of voxels that arrive more than once the latest batch
wins.  ``compact`` folds the batches into one brick table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cubeflow.operators import bricks
from cubeflow.plans.grid import Grid


class BrickIngest:
    def __init__(self, spark: SparkSession, path: str, grid: Grid) -> None:
        self.spark, self.path, self.grid = spark, path.rstrip("/"), grid

    def start(self, voxels: DataFrame, **trigger) -> StreamingQuery:
        """Starts writing a stream of (d0, d1, ..., value); ``trigger`` as for writeStream.trigger."""
        writer = voxels.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.path}/_progress")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        names = [f"d{d}" for d in range(len(self.grid.shape))]
        # of voxels that a batch holds more than once the largest value stays, whatever the order of its rows
        one = batch.groupBy(*names).agg(F.max("value").alias("value"))
        bricks.to_bricks(one, self.grid).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def voxels(self) -> DataFrame:
        """All batches so far, later ones over earlier ones."""
        stored = self.spark.read.parquet(f"{self.path}/batches")
        names = [f"d{d}" for d in range(len(self.grid.shape))]
        return bricks.from_bricks(stored, self.grid, ("batch",)).groupBy(*names).agg(F.max_by("value", "batch").alias("value"))

    def compact(self, path: str) -> None:
        bricks.to_bricks(self.voxels(), self.grid).write.mode("errorifexists").parquet(path)

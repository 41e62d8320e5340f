"""Datasets that are still being written, step by step, as Structured Streaming queries over their cell folders.

A writer adds Parquet files whose rows carry their ``step``; a reader takes every step in order (``all``), whatever is
there (``available``), or only the newest (``latest``). Offsets are in the query's checkpoint, so a restart goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import EndOfStream, StepDisappeared, StepNotReady

MODES = ("all", "available", "latest")


def source(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Cells of a folder as a stream, at most ``files`` new files in a batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def statistics(cells: DataFrame) -> DataFrame:
    """Running step statistics: the state is one row for each step."""
    v = F.col("value").cast("double")
    some = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return cells.groupBy("step").agg(F.count(some).alias("cnt"), F.min(some).alias("min"), F.max(some).alias("max"), F.avg(some).alias("avg"), F.stddev_pop(some).alias("std_dev"))


def matching(cells: DataFrame, condition: Column) -> DataFrame:
    """The cells of each step that satisfy a predicate; stateless."""
    return cells.filter(condition)


def follow(cells: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "all", timeout: float | None = None):
    """Call ``handle(cells of the step, step)`` for the steps that arrive. Steps of a batch come to the driver as numbers
    only. Without a timeout everything that is there is taken and the query ends; with one (seconds) it goes on so long.
    Returns the ended query."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")

    def each(batch: DataFrame, _: int) -> None:
        if mode == "latest":
            last = batch.agg(F.max("step")).first()[0]
            if last is not None:
                handle(batch.filter(F.col("step") == last), last)
            return
        if mode == "available":
            handle(batch, -1)
            return
        batch.persist()
        try:
            for row in batch.select("step").distinct().orderBy("step").collect():
                handle(batch.filter(F.col("step") == row.step), row.step)
        finally:
            batch.unpersist()

    writer = cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if timeout is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    else:
        query = writer.start()
        query.awaitTermination(timeout)
        query.stop()
    return query


def store(cells: DataFrame, path: str, checkpoint: str):
    """Append a stream's cells to a dataset folder, once each; returns the ended query."""
    query = cells.writeStream.format("parquet").partitionBy("step").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Cursor:
    """One visible step at a time over a folder that a writer fills: forward only, with an explicit end.

    ``ended()`` tells whether the writer has finished. Only step numbers come to the driver."""

    def __init__(self, spark: SparkSession, path: str, ended: Callable[[], bool] = lambda: True):
        self.spark, self.path, self.ended = spark, path, ended
        self.step: int | None = None

    def _cells(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def advance(self, last: bool = False) -> int:
        """Go to the next step, or the newest. Raises EndOfStream or StepNotReady where there is none."""
        later = self._cells().select("step").filter(F.lit(True) if self.step is None else F.col("step") > self.step)
        found = later.agg((F.max if last else F.min)("step")).first()[0]
        if found is None:
            raise EndOfStream("the stream has ended") if self.ended() else StepNotReady("no new step yet")
        self.step = found
        return found

    def cells(self) -> DataFrame:
        """Cells of the current step; StepDisappeared if the writer has dropped it."""
        if self.step is None:
            raise StepNotReady("advance first")
        now = self._cells().filter(F.col("step") == self.step)
        if now.isEmpty():
            raise StepDisappeared(f"step {self.step} is gone")
        return now

"""Versioned tables that micro-batches carry on: version b is what holds after batch b.

A batch reads the version before its own and writes its own, so one that runs again
after a failure starts from the same state and counts once. A batch other than the
first that finds no version before it fails: state that is lost must not read as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyfold.sources.shared import drop_path, exists


class Versions:
    """Tables by name and batch below ``path``, each with its schema."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path, schemas

    def _at(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/{batch_id}"

    def read(self, name: str, batch_id: int) -> DataFrame:
        """Table ``name`` after a batch; before the first it is empty."""
        if batch_id < 0:
            return self.spark.createDataFrame([], self.schemas[name])
        path = self._at(name, batch_id)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            raise RuntimeError(f"no {name} of batch {batch_id} at {self.path}: state is lost")
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def write(self, name: str, batch_id: int, table: DataFrame) -> DataFrame:
        """Write table ``name`` of a batch, in place of what a run before left, and read it back."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schemas[name]).schema]
        table.select(columns).write.mode("overwrite").parquet(self._at(name, batch_id))
        return self.read(name, batch_id)

    def forget(self, batch_id: int, names: list[str]) -> None:
        """Delete versions that no batch after ``batch_id`` reads."""
        if batch_id >= 2:
            for name in names:
                drop_path(self.spark, self._at(name, batch_id - 2))


def run(records: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of a streaming DataFrame through ``apply(batch, batch_id)``, until no more are available."""
    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

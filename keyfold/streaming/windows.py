"""Window pipes as streams, batch by batch, with all that a declaration can ask for.

After each batch the state is the open pane rows and the sentinel rows, the revision
that each pane was last emitted with, and two clocks: the largest ingest time seen and
the event-time horizon. A batch first deals with the rows before it, by the clocks
before it: a row past its expiry goes, a closed one is emitted and goes, so a revision
carries only the rows since the last. Then it folds its own records: groups beyond the
key cap are refused against the groups that have rows, late records are told by the
horizon after the batch, and rows beyond the byte cap against the bytes of the rows
there are. Revision marks go once nothing can add to their pane any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfold.functions import typed
from keyfold.operators import pipes
from keyfold.plans.declarations import WindowPipe
from keyfold.streaming.state import Versions, run

SCHEMAS = {
    "rows": f"g {typed.TYPE}, pane long, count long, sum decimal(38,0)",
    "marks": f"g {typed.TYPE}, pane long, revision long",
    "clocks": "ingest_ns long, horizon_ns long",
    "emitted": f"g {typed.TYPE}, pane long, count long, sum decimal(38,0), revision long",
}


def shown(rows: DataFrame) -> DataFrame:
    """Stored rows as :func:`pipes.window` gives them: (group_tag, group_value, pane, posting, ...)."""
    posting = F.when(F.col("pane") < 0, pipes.SENTINEL).otherwise(0)
    more = [c for c in rows.columns if c not in ("g", "pane")]
    return rows.select(F.col("g")["tag"].alias("group_tag"), typed.shown(F.col("g")).alias("group_value"), "pane", posting.alias("posting"), *more)


class WindowStream:
    """One pipe with its state below ``path``."""

    def __init__(self, spark: SparkSession, path: str, pipe: WindowPipe):
        self.spark, self.path, self.pipe = spark, path, pipe
        self.state = Versions(spark, path, SCHEMAS)

    def rows(self, batch_id: int) -> DataFrame:
        """Open pane rows and sentinel rows after a batch."""
        return shown(self.state.read("rows", batch_id))

    def emissions(self) -> DataFrame:
        """Everything emitted: (group_tag, group_value, pane, posting, count, sum, revision)."""
        return shown(self.spark.read.schema(SCHEMAS["emitted"]).parquet(f"{self.path}/emitted/*"))

    def _clocks(self, records: DataFrame, batch_id: int) -> tuple[int, int, int, int]:
        """Ingest clock and horizon before and after the batch."""
        before = self.state.read("clocks", batch_id - 1).first()
        ingest, horizon = (before["ingest_ns"], before["horizon_ns"]) if before else (0, 0)
        last, top = records.agg(F.max("ingest_time_ns"), F.max("event_time_ns")).first()
        after = max(horizon, (top or 0) - self.pipe.watermark_ns) if self.pipe.watermark_ns is not None else horizon
        return ingest, horizon, max(ingest, last or 0), after

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """One micro-batch; running it again writes the same versions again."""
        pipe, state = self.pipe, self.state
        rows, marks = state.read("rows", batch_id - 1), state.read("marks", batch_id - 1)
        ingest, horizon, ingest_after, horizon_after = self._clocks(records, batch_id)

        judged = pipes.disposition(rows.withColumn("posting", F.when(F.col("pane") < 0, pipes.SENTINEL).otherwise(0)), pipe, ingest, horizon)
        revision = F.coalesce("revision", F.lit(0)) + 1
        out = judged.where("disposition = 'emit'").select("g", "pane", "count", "sum").join(marks, ["g", "pane"], "left")
        emitted = state.write("emitted", batch_id, out.withColumn("revision", revision))
        open_rows = judged.where("disposition = 'keep'").select("g", "pane", "count", "sum")

        admitted = None
        if pipe.limit_keys:
            names = [typed.text(F.lit(x)) for x in (pipes.KEY_CAP, pipes.BYTE_CAP)]
            active = open_rows.where((F.col("g") != names[0]) & (F.col("g") != names[1])).select("g").distinct()
            seats = max(0, pipe.limit_keys - active.count())
            new = pipes.projected(records, pipe).join(active, "g", "left_anti")
            admitted = active.unionByName(pipes.admitted_groups(new, seats))
        d = pipes.window_rows(records, pipe, admitted, horizon_after)
        if pipe.limit_bytes:
            d = pipes.bytes_capped(d, pipe.limit_bytes, open_rows.select("g", F.col("pane").alias("row_pane")))
        delta = d.groupBy("g", F.col("row_pane").alias("pane")).agg(
            F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.col("counted").cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias("sum")
        )
        now = open_rows.unionByName(delta).groupBy("g", "pane").agg(F.sum("count").alias("count"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
        state.write("rows", batch_id, now)

        # a mark is of use as long as records can still reach its pane
        end = (F.col("pane") + 1) * pipe.pane_ns
        live = end + pipe.grace_ns >= F.lit(horizon_after) if pipe.watermark_ns is not None else end + (pipe.max_late_ns or 0) + pipe.window_ns > F.lit(ingest_after)
        if pipe.expire_ns is not None:
            live &= end + pipe.expire_ns > F.lit(ingest_after)
        kept = marks.unionByName(emitted.select("g", "pane", "revision")).groupBy("g", "pane").agg(F.max("revision").alias("revision"))
        state.write("marks", batch_id, kept.where(live))
        state.write("clocks", batch_id, self.spark.createDataFrame([(ingest_after, horizon_after)], SCHEMAS["clocks"]))
        state.forget(batch_id, ["rows", "marks", "clocks"])

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a streaming DataFrame of records until no more are available."""
        return run(records, self.apply, checkpoint)

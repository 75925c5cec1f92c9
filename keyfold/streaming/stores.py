"""Stores, indexes and logs as streams: each batch is folded into the version before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfold.functions import typed
from keyfold.operators import indexes, reads, stores, subscriptions
from keyfold.operators.pipes import enrich, strict_store
from keyfold.plans.declarations import Miss
from keyfold.streaming.state import Versions, run


class StoreStream:
    """The current rows of a journal (``op`` put, delete or clear by ``key`` in ``seq`` order) after each batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.state = Versions(spark, path, {"rows": schema, "applied": "seq long"})

    def rows(self, batch_id: int) -> DataFrame:
        return self.state.read("rows", batch_id)

    def applied(self, batch_id: int) -> int:
        """The last sequence that the rows after a batch contain."""
        row = self.state.read("applied", batch_id).first()
        return row["seq"] if row else 0

    def apply(self, journal: DataFrame, batch_id: int) -> None:
        """Rows before count as puts of their own sequence. Fails if an entry comes behind what is applied, as its place is gone."""
        row = self.state.read("applied", batch_id - 1).first()
        done = row["seq"] if row else None
        first, last = journal.agg(F.min("seq"), F.max("seq")).first()
        if first is not None and done is not None and first <= done:
            raise RuntimeError(f"entry {first} comes after {done} was applied")
        both = self.rows(batch_id - 1).unionByName(journal)
        self.state.write("rows", batch_id, stores.fold(both))
        now = [(done if last is None else last,)]
        self.state.write("applied", batch_id, journal.sparkSession.createDataFrame([x for x in now if x[0] is not None], "seq long"))
        self.state.forget(batch_id, ["rows", "applied"])

    def start(self, journal: DataFrame, checkpoint: str) -> StreamingQuery:
        return run(journal, self.apply, checkpoint)


class IndexStream:
    """The latest record of each key with its typed fields after each batch; ``strict`` refuses payloads that are not JSON."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fields: dict[str, Column], strict: bool = False):
        self.fields, self.strict = fields, strict
        self.state = Versions(spark, path, {"rows": schema})

    def rows(self, batch_id: int) -> DataFrame:
        return self.state.read("rows", batch_id).withColumns(self.fields)

    def apply(self, records: DataFrame, batch_id: int) -> None:
        if self.strict:  # each record is checked, also one that a later record of its key hides
            bad = F.when(~typed.is_json(F.col("payload")), F.raise_error(F.concat(F.lit("no JSON at "), F.col("key"))))
            records = records.where(bad.isNull())
        before = self.state.read("rows", batch_id - 1)
        self.state.write("rows", batch_id, indexes.latest_by_key(before.unionByName(records.select(before.columns))))
        self.state.forget(batch_id, ["rows"])

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        return run(records, self.apply, checkpoint)


class AppendStream:
    """An idempotent log: first attempts go to ``out``, attempts that contradict them to ``conflicts``, retries nowhere.

    What was accepted is remembered for ``within_ns`` of event time.
    """

    def __init__(self, spark: SparkSession, path: str, scope: dict[str, str], within_ns: int):
        self.path, self.scope, self.within_ns = path, list(scope), within_ns
        kinds = ", ".join(f"{k} {v}" for k, v in scope.items())
        self.state = Versions(spark, path, {"accepted": f"{kinds}, digest string, event_time_ns long"})

    def apply(self, attempts: DataFrame, batch_id: int) -> None:
        """``attempts`` has the scope, ``digest``, ``event_time_ns`` and ``attempt_no``, which orders them."""
        before = self.state.read("accepted", batch_id - 1)
        known = before.select(*self.scope, F.col("digest").alias("__known"))
        d = reads.append_outcomes(attempts, self.scope, "attempt_no", "digest").join(known, self.scope, "left")
        again = F.col("__known").isNotNull()
        outcome = F.when(again & (F.col("digest") == F.col("__known")), "deduplicated").when(again, "conflict").otherwise(F.col("outcome"))
        d = d.withColumn("outcome", outcome).drop("__known", "accepted_at").persist()
        try:
            for name, kind in (("out", "accepted"), ("conflicts", "conflict")):
                d.where(F.col("outcome") == kind).drop("outcome").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
            new = d.where("outcome = 'accepted'").select(*self.scope, "digest", "event_time_ns")
            top = F.max("event_time_ns")
            edge = before.unionByName(new).agg(top).first()[0] or 0
            self.state.write("accepted", batch_id, before.unionByName(new).where(F.col("event_time_ns") >= edge - self.within_ns))
        finally:
            d.unpersist()
        self.state.forget(batch_id, ["accepted"])

    def start(self, attempts: DataFrame, checkpoint: str) -> StreamingQuery:
        return run(attempts, self.apply, checkpoint)


class DelayStream:
    """Delivery held back by ``delay_ns`` of ingest time: what is due goes to ``out``, the rest is parked, and keys stay in order."""

    def __init__(self, spark: SparkSession, path: str, schema: str, delay_ns: int):
        self.path, self.delay_ns = path, delay_ns
        self.state = Versions(spark, path, {"parked": schema, "clock": "now_ns long"})

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """The clock is the largest ingest time that was seen."""
        before = self.state.read("parked", batch_id - 1)
        row = self.state.read("clock", batch_id - 1).first()
        now = max(row["now_ns"] if row else 0, records.agg(F.max("ingest_time_ns")).first()[0] or 0)
        held = before.unionByName(records.select(before.columns))
        due = subscriptions.delayed(held, now, self.delay_ns)
        out = f"{self.path}/out/batch={batch_id}"
        due.select(before.columns).write.mode("overwrite").parquet(out)
        gone = records.sparkSession.read.schema(before.schema).parquet(out).select("pos")
        self.state.write("parked", batch_id, held.join(gone, "pos", "left_anti"))
        self.state.write("clock", batch_id, records.sparkSession.createDataFrame([(now,)], "now_ns long"))
        self.state.forget(batch_id, ["parked", "clock"])

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        return run(records, self.apply, checkpoint)


def copy_store(journal: DataFrame, copy: str, out: str, checkpoint: str) -> StreamingQuery:
    """A copy of a journal: entries keep their order, and each gets a mutation id that follows from the copy and its sequence.

    A batch that runs again replaces its own folder, and :func:`stores.effective` drops
    entries that came twice by their mutation id.
    """

    def replay(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("mutation_id", typed.derived_id("copy", F.lit(copy), F.col("seq")))
        named.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run(journal, replay, checkpoint)


def enrich_strictly(records: DataFrame, store: StoreStream, version: int, committed: int, lookup: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Enrichment that reads one version of a store and fails while that is behind ``committed``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        applied = store.applied(version)
        rows = strict_store(store.rows(version), committed, applied).select(F.col("key").alias("store_key"), F.col("payload").alias("store_payload"))
        enrich(batch, rows, lookup, Miss.FORWARD, applied).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run(records, one, checkpoint)

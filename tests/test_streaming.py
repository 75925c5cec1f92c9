import pytest
from pyspark.sql import functions as F

from keyfold.functions import typed
from keyfold.operators import indexes, pipes, stores, subscriptions
from keyfold.plans.declarations import WindowPipe
from keyfold.queries import state as state_queries
from keyfold.sources.feeds import events_feed, positioned, project_events
from keyfold.sources.shared import new_path, table
from keyfold.streaming import feeds
from keyfold.streaming.stores import AppendStream, DelayStream, IndexStream, StoreStream, copy_store, enrich_strictly
from keyfold.streaming.windows import WindowStream

SF = "/root/testdata/sf0.001"
HOUR = 3600 * 10**9


def parts(spark, n):
    """``events`` in ``n`` files, as a source folder."""
    path = new_path(spark, "events")
    table(spark, SF, "events").repartitionByRange(n, "event_id").write.parquet(path)
    return path


def both(state, last):
    """Emitted and kept rows together: (group, pane, posting, count, sum)."""
    cols = ["group_value", "pane", "posting", "count", "sum"]
    d = state.emissions().select(cols).unionByName(state.rows(last).select(cols))
    d = d.groupBy(cols[:3]).agg(F.sum("count"), F.sum("sum").cast("long"))
    return sorted(map(tuple, d.collect()))


def panes(d):
    return sorted(map(tuple, d.select("group_value", "pane", "posting", "count", F.col("sum").cast("long")).collect()))


def batches(spark, rows, pipe):
    """A stream's state after ``rows``, a list of (customer, amount, event s, ingest s) for each batch."""
    state = WindowStream(spark, new_path(spark, "window"), pipe)
    for i, own in enumerate(rows):
        d = spark.createDataFrame([(100 * i + j, c, a, int(e * 10**9), int(t * 10**9)) for j, (c, a, e, t) in enumerate(own)], "pos long, c string, a long, event_time_ns long, ingest_time_ns long")
        payload = F.to_json(F.struct(F.col("c").alias("customer"), F.col("a").alias("amount")))
        state.apply(d.withColumn("payload", payload), i)
    return state


S = 10**9


def test_window_stream_equals_batch(spark):
    path = parts(spark, 4)
    raw = spark.readStream.schema(table(spark, SF, "events").schema).option("maxFilesPerTrigger", 1).parquet(path)
    pipe = WindowPipe("customer", 16 * HOUR, "cents", max_late_ns=HOUR)
    state = WindowStream(spark, new_path(spark, "window"), pipe)
    state.start(project_events(raw), new_path(spark, "checkpoint")).awaitTermination()
    assert both(state, 3) == panes(pipes.window(events_feed(spark, SF), pipe))
    emitted = state.emissions()
    assert emitted.count() > 100 and emitted.groupBy("group_value", "pane", "revision").count().where("count > 1").count() == 0
    before = both(state, 3)
    state.apply(project_events(table(spark, SF, "events").limit(0)), 4)  # a batch without records emits what is closed by now
    assert both(state, 4) == before and state.rows(4).count() < emitted.count()
    again = state.rows(4).collect()
    state.apply(project_events(table(spark, SF, "events").limit(0)), 4)  # run again, it replaces its own version
    assert sorted(state.rows(4).collect()) == sorted(again) and both(state, 4) == before


def test_watermark_stream_equals_paged_batch(spark):
    """Emissions, their revisions and late rows of pages that come one by one."""
    feed = positioned(events_feed(spark, SF))
    pipe = WindowPipe("customer", 16 * HOUR, "cents", watermark_ns=HOUR // 2, grace_ns=HOUR // 3)
    state = WindowStream(spark, new_path(spark, "window"), pipe)
    n = 250
    for page in range(4):
        state.apply(feed.where(f"(pos - 1) div {n} = {page}"), page)
    want = pipes.window_by_watermark(feed, pipe, n).collect()
    emitted = {(r.group_value, r.pane, r["count"], int(r["sum"]), r.revision) for r in want if r.posting == 0 and r.emit_page is not None and r.emit_page <= 3}
    assert emitted and {(r.group_value, r.pane, r["count"], int(r["sum"]), r.revision) for r in state.emissions().collect()} == emitted
    late = {(r.group_value, r["count"]) for r in want if r.posting == -1}
    assert late and {(r.group_value, r["count"]) for r in state.rows(3).where("posting = -1").collect()} == late
    assert both(state, 3) == panes(pipes.pane_totals(pipes.window_by_watermark(feed, pipe, n)).withColumn("posting", F.lit(0)).unionByName(pipes.window_by_watermark(feed, pipe, n).where("posting = -1").select("group_tag", "group_value", "pane", "count", "sum", "posting"), allowMissingColumns=True))


def test_revision_carries_only_new_rows(spark):
    pipe = WindowPipe("customer", 16 * S, "amount", watermark_ns=4 * S, grace_ns=6 * S)
    rows = [[("a", 10, 0.5, 0.5)], [("b", 1, 6, 6)], [("a", 5, 0.6, 7)], [("b", 1, 7, 8)], [("b", 1, 30, 30)], [("a", 9, 0.7, 31)]]
    state = batches(spark, rows, pipe)
    assert {(r.group_value, r.pane, r["count"], int(r["sum"]), r.revision) for r in state.emissions().collect() if r.group_value == "a"} == {("a", 0, 1, 10, 1), ("a", 0, 1, 5, 2)}
    assert ("a", -1, -1, 1, 0) in panes(state.rows(5))
    assert state.state.read("marks", 5).where("pane = 0").count() == 0  # beyond grace nothing can follow


def test_caps_hold_over_batches(spark):
    pipe = WindowPipe("customer", 16 * S, max_late_ns=5 * S, limit_keys=1)
    state = batches(spark, [[("b", 1, 0, 0)], [("a", 1, 0, 1)], [("c", 1, 1, 1), ("b", 1, 1, 1)]], pipe)
    assert both(state, 2) == [("__keycap__", -1, -1, 2, 0), ("b", 0, 0, 1, 0), ("b", 1, 0, 1, 0)]
    state = batches(spark, [[("b", 1, 0, 0)], [("x", 1, 90, 90)], [("a", 1, 90, 90)]], pipe)
    assert both(state, 2) == [("__keycap__", -1, -1, 1, 0), ("a", 90, 0, 1, 0), ("b", 0, 0, 1, 0)]  # the pane of b is gone, and its seat free
    rng = __import__("random").Random(2)
    data = [[(rng.choice(["a", "bb", "c" * 9]) + str(rng.randrange(5)), 1, rng.randrange(8), rng.randrange(8, 12)) for _ in range(60)] for _ in range(3)]
    left, rows, refused = 500, {}, 0
    for c, _, e, t in sum(data, []):
        late, cost = t - e > 90, 4 + 1 + len(c) + 8 + 26
        row = (c, -1 if late else e, -1 if late else 0)
        if row not in rows and cost > left:
            refused += 1
            continue
        left -= 0 if row in rows else cost
        rows[row] = rows.get(row, 0) + 1
    state = batches(spark, data, WindowPipe("customer", 16 * S, max_late_ns=90 * S, limit_bytes=500))
    assert both(state, 2) == sorted([(*k, n, 0) for k, n in rows.items()] + [("__bytecap__", -1, -1, refused, 0)])


def test_expired_panes_go_without_emission(spark):
    pipe = WindowPipe("customer", 16 * S, max_late_ns=2 * S, expire_ns=4 * S)
    state = batches(spark, [[("a", 1, 0, 0)], [("a", 1, 7, 7)], [("a", 1, 7.5, 8)], [("a", 1, 10, 10.5)], [("a", 1, 20, 20)]], pipe)
    assert {(r.pane, r["count"]) for r in state.emissions().collect()} == {(7, 2)}
    assert panes(state.rows(4)) == [("a", 10, 0, 1, 0), ("a", 20, 0, 1, 0)]


def test_lost_state_is_not_empty_state(spark):
    pipe = WindowPipe("customer", 16 * S, max_late_ns=S)
    state = batches(spark, [[("a", 1, 0, 0)]], pipe)
    with pytest.raises(RuntimeError, match="lost"):
        state.apply(events_feed(spark, SF).limit(1), 9)


def test_store_and_index_streams_equal_batch(spark):
    journal = state_queries._journal(spark, SF)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in journal.schema)
    path = new_path(spark, "journal")
    for i in range(3):  # files in the order of the journal
        journal.where(f"(seq - 1) div 334 = {i}").coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema(journal.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = StoreStream(spark, new_path(spark, "store"), schema)
    store.start(raw, new_path(spark, "checkpoint")).awaitTermination()
    assert sorted(store.rows(2).collect()) == sorted(stores.fold(journal).select(journal.columns).collect())
    assert store.applied(2) == journal.agg(F.max("seq")).first()[0]
    with pytest.raises(RuntimeError, match="comes after"):
        store.apply(journal.limit(1), 3)
    copied = new_path(spark, "copy")
    copy_store(raw, "west", copied, new_path(spark, "checkpoint")).awaitTermination()
    there = spark.read.parquet(copied).drop("batch")
    assert sorted(stores.fold(there).select("key", "seq", "amount").collect()) == sorted(stores.fold(journal).select("key", "seq", "amount").collect())
    once = stores.effective(there.unionByName(there)).where("status = 'applied'")
    assert once.count() == journal.count() == there.select("mutation_id").distinct().count()

    feed = positioned(events_feed(spark, SF)).select("key", "pos", "payload")
    fields = {"tag": typed.shown(typed.json_value(F.col("payload"), "tag"))}
    index = IndexStream(spark, new_path(spark, "index"), "key string, pos long, payload string", fields)
    for i in range(3):
        index.apply(feed.where(f"pos % 3 = {i}"), i)
    assert sorted(index.rows(2).collect(), key=repr) == sorted(indexes.build(feed, fields).collect(), key=repr)
    strict = IndexStream(spark, new_path(spark, "index"), "key string, pos long, payload string", fields, strict=True)
    with pytest.raises(Exception, match="no JSON"):
        strict.apply(feed, 0)


def test_append_stream_reports_conflicts(spark):
    log = AppendStream(spark, new_path(spark, "log"), {"producer": "int", "sequence": "long"}, 100)
    kinds = "producer int, sequence long, digest string, event_time_ns long, attempt_no long"
    log.apply(spark.createDataFrame([(1, 1, "a", 0, 1), (1, 1, "a", 0, 2), (1, 1, "b", 0, 3), (2, 1, "a", 0, 4)], kinds), 0)
    log.apply(spark.createDataFrame([(1, 1, "a", 50, 5), (2, 1, "c", 50, 6), (3, 1, "z", 500, 7)], kinds), 1)
    log.apply(spark.createDataFrame([(1, 1, "x", 501, 8)], kinds), 2)  # forgotten by now
    assert sorted(r.attempt_no for r in spark.read.parquet(f"{log.path}/out").collect()) == [1, 4, 7, 8]
    assert sorted(r.attempt_no for r in spark.read.parquet(f"{log.path}/conflicts").collect()) == [3, 6]


def test_delay_stream_equals_batch(spark):
    feed = positioned(events_feed(spark, SF)).select("pos", "key", "ingest_time_ns")
    stream = DelayStream(spark, new_path(spark, "delay"), "pos long, key string, ingest_time_ns long", 50 * HOUR)
    for i in range(4):
        stream.apply(feed.where(f"(pos - 1) div 250 = {i}"), i)
    now = feed.agg(F.max("ingest_time_ns")).first()[0]
    want = sorted(r.pos for r in subscriptions.delayed(feed, now, 50 * HOUR).collect())
    got = spark.read.parquet(f"{stream.path}/out").collect()
    assert sorted(r.pos for r in got) == want and 0 < len(want) < 1000
    assert sorted([r.pos for r in stream.state.read("parked", 3).collect()] + want) == list(range(1, 1001))


def test_strict_enrichment_waits_for_the_store(spark):
    store = StoreStream(spark, new_path(spark, "store"), "seq long, op string, key string, payload string")
    store.apply(spark.createDataFrame([(1, "put", "u1", "one"), (2, "put", "u2", "two")], "seq long, op string, key string, payload string"), 0)
    path, schema = parts(spark, 1), table(spark, SF, "events").schema
    out, lookup = new_path(spark, "out"), F.concat(F.lit("u"), F.col("user_id") % 4)
    with pytest.raises(Exception, match="applied 2 of 3"):
        enrich_strictly(project_events(spark.readStream.schema(schema).parquet(path)), store, 0, 3, lookup, out, new_path(spark, "checkpoint")).awaitTermination()
    enrich_strictly(project_events(spark.readStream.schema(schema).parquet(path)), store, 0, 2, lookup, out, new_path(spark, "checkpoint")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 1000 and got.where("matched and enrich_seq = 2").count() == got.where("user_id % 4 in (1, 2)").count()


def test_copy_and_enrich_streams(spark):
    path = parts(spark, 2)
    schema = table(spark, SF, "events").schema
    raw = project_events(spark.readStream.schema(schema).parquet(path))
    out, bad = new_path(spark, "out"), new_path(spark, "bad")
    store = spark.createDataFrame([("u1", "one"), ("u2", "two")], "store_key string, store_payload string")
    lookup = F.concat(F.lit("u"), F.col("user_id") % 4)
    feeds.enrich_with_quarantine(raw, store, lookup, out, bad, new_path(spark, "checkpoint")).awaitTermination()
    want = pipes.enrich(events_feed(spark, SF), store, lookup)
    assert spark.read.parquet(out).count() == want.where("matched").count()
    assert spark.read.parquet(bad).count() == want.where("not matched").count()
    copied = new_path(spark, "copy")
    feeds.copy_feed(feeds.deduplicated(raw, ["event_id"], "event_time_ns", "3 hours"), copied, new_path(spark, "checkpoint")).awaitTermination()
    assert spark.read.parquet(copied).count() == events_feed(spark, SF).count()

import pytest
from pyspark.sql import functions as F

from keyfold.functions import typed
from keyfold.functions.ordering import with_position, with_running_max
from keyfold.operators import demand, diagnostics, governance, indexes, pipes, reads, stores, subscriptions
from keyfold.plans.declarations import Miss, WindowPipe
from keyfold.queries import state, traffic

SF = "/root/testdata/sf0.001"
S = 10**9


def records(spark, rows):
    """(customer, amount, event s, ingest s) in delivery order."""
    d = spark.createDataFrame([(i + 1, c, a, int(e * S), int(t * S)) for i, (c, a, e, t) in enumerate(rows)], "pos long, c string, a long, event_time_ns long, ingest_time_ns long")
    payload = F.when(F.col("c").isNull(), "not json").otherwise(F.to_json(F.struct(F.col("c").alias("customer"), F.col("a").alias("amount"))))
    return d.select("pos", "event_time_ns", "ingest_time_ns", payload.alias("payload"))


def panes(d, *more):
    return sorted(tuple(r) for r in d.select("group_value", "pane", "posting", "count", F.col("sum").cast("long"), *more).collect())


def test_durations():
    assert typed.duration_ns("2m") == 120 * S and typed.duration_ns("5ms") == 5 * 10**6
    with pytest.raises(ValueError):
        typed.duration_ns("5y")


def test_json_types(spark):
    d = spark.createDataFrame([('{"a":1.0,"b":1e3,"c":18446744073709551615,"d":[1],"e":{"f":"x"},"g":"1","h":false}',)], "payload string")
    got = d.select(*[typed.json_value(F.col("payload"), p)["tag"].alias(p.replace(".", "_")) for p in ("a", "b", "c", "d", "e.f", "g", "h", "z")]).first()
    assert tuple(got) == (0, 0, 0, 0, 4, 4, 1, 0)


def test_typed_order(spark):
    values = [typed.null(), typed.boolean(F.lit(False)), typed.boolean(F.lit(True)), typed.i64(F.lit(-5)), typed.i64(F.lit(7)), typed.bytes_(F.lit(b"\x80")), typed.text(F.lit("a"))]
    d = spark.range(1)
    checks = [(values[i] < values[i + 1]).alias(f"c{i}") for i in range(len(values) - 1)] + [(typed.null() == typed.null()).alias("n")]
    assert all(d.select(*checks).first())


def test_window_groups_skips_and_late(spark):
    feed = records(spark, [("acme", 10, 0.1, 0.1), ("acme", 20, 0.2, 0.2), ("acme", None, 0.3, 0.3), (None, 1, 0.1, 0.1), ("acme", 5, 0.1, 9), ("globex", 7, 1.1, 1.1)])
    pipe = WindowPipe("customer", 8 * S, "amount", max_late_ns=5 * S)
    assert panes(pipes.window(feed, pipe)) == [("acme", -1, -1, 1, 0), ("acme", 0, 0, 2, 30), ("globex", 2, 0, 1, 7)]


def test_key_cap_comes_before_lateness(spark):
    feed = records(spark, [("a", 1, 0, 0), ("b", 1, 0, 0), ("c", 1, 0, 100), ("d", 1, 0, 0), ("c", 1, 0, 0)])
    got = panes(pipes.window(feed, WindowPipe("customer", 16 * S, max_late_ns=S, limit_keys=2)))
    assert got == [("__keycap__", -1, -1, 3, 0), ("a", 0, 0, 1, 0), ("b", 0, 0, 1, 0)]


def test_revisions_carry_only_new_rows(spark):
    pipe = WindowPipe("customer", 16 * S, "amount", watermark_ns=4 * S, grace_ns=6 * S)
    feed = records(spark, [("a", 10, 0.5, 0.5), ("b", 1, 6, 6), ("a", 5, 0.6, 7), ("b", 1, 30, 30), ("a", 9, 0.7, 31)])
    got = panes(pipes.window_by_watermark(feed, pipe, page_records=1), "revision")
    assert ("a", 0, 0, 1, 10, 1) in got and ("a", 0, 0, 1, 5, 2) in got and ("a", -1, -1, 1, 0, 0) in got
    totals = {(r.group_value, r.pane): (r["count"], int(r["sum"])) for r in pipes.pane_totals(pipes.window_by_watermark(feed, pipe, 1)).collect()}
    assert totals["a", 0] == (2, 15)


def test_byte_cap_equals_a_plain_fold(spark):
    rng = __import__("random").Random(1)
    data = [(rng.choice(["a", "bb", "a" * 30, "c" * 9]) + str(rng.randrange(6)), 1, rng.randrange(8), rng.randrange(8, 12)) for _ in range(300)]
    for limit in (39, 150, 600, 1500):
        got = panes(pipes.window(records(spark, data), WindowPipe("customer", 16 * S, max_late_ns=5 * S, limit_bytes=limit)))
        left, rows, refused = limit, {}, 0
        for c, _, e, t in data:
            late = t - e > 5
            row = (c, -1 if late else e, -1 if late else 0)
            if row not in rows and 4 + 1 + len(c) + 8 + 26 > left:
                refused += 1
                continue
            left -= 0 if row in rows else 4 + 1 + len(c) + 8 + 26
            rows[row] = rows.get(row, 0) + 1
        assert got == sorted([(*k, n, 0) for k, n in rows.items()] + [("__bytecap__", -1, -1, refused, 0)] * (refused > 0))


def test_disposition_order(spark):
    pipe = WindowPipe("customer", 16 * S, max_late_ns=S, expire_ns=10 * S)
    d = pipes.window(records(spark, [("a", 1, 0, 0), ("a", 1, 8, 8), ("a", 1, 19, 19)]), pipe)
    got = {r.pane: r.disposition for r in pipes.disposition(d, pipe, 12 * S).collect()}
    assert got == {0: "expire", 8: "emit", 19: "keep"}


@pytest.mark.parametrize("bad", [{"window_ns": 0}, {"clock": "wall"}, {"watermark_ns": 1, "max_late_ns": 1}, {"watermark_ns": 1, "clock": "ingest"}, {"grace_ns": 1}, {"limit_keys": 513}, {"limit_bytes": 0}])
def test_declarations_refused(bad):
    with pytest.raises(ValueError):
        WindowPipe(**{"group_path": "a", "window_ns": 16} | bad)


def test_enrich_miss_policies(spark):
    feed = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "event_id int, k string")
    store = spark.createDataFrame([("a", ""), ("c", "x")], "store_key string, store_payload string")
    got = {r.event_id: (r.matched, r.enrich_payload, r.enrich_seq) for r in pipes.enrich(feed, store, F.col("k"), applied_sequence=9).collect()}
    assert got == {1: (True, None, 9), 2: (False, None, 0), 3: (False, None, 0)}
    assert [r.event_id for r in pipes.enrich(feed, store, F.col("k"), Miss.DROP).collect()] == [1]
    assert sorted(r.event_id for r in pipes.enrich(feed, store, F.col("k"), Miss.QUARANTINE).where("quarantine").collect()) == [2, 3]


def test_positions_and_running_max_over_buckets(spark):
    d = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "t int, id int")
    got = with_position(d, F.expr("t div 9"), ["t", "id"]).orderBy("t").collect()
    assert [r.pos for r in got] == list(range(1, 51))
    d = spark.createDataFrame([(i, i * 37 % 11) for i in range(40)], "t int, v int")
    top, want = 0, []
    for i in range(40):
        top = max(top, i * 37 % 11)
        want.append(top)
    assert [r.m for r in with_running_max(d, F.expr("t div 6"), ["t"], "v", "m").orderBy("t").collect()] == want


def test_search_needs_a_predicate_and_bounds_its_scan(spark):
    feed = spark.createDataFrame([(i, f"k{i % 3}", i) for i in range(1, 31)], "pos long, key string, event_time_ns long")
    with pytest.raises(ValueError):
        reads.search(feed)
    assert [r.pos for r in reads.search(feed, after=3, key="k1", max_scan=10).orderBy("pos").collect()] == [4, 7, 10, 13]


def test_index_modes(spark):
    d = spark.createDataFrame([("k1", 1, '{"a":1}'), ("k1", 2, '{"a":"x"}'), ("k2", 3, "no json"), ("k3", 4, '{"a":true}')], "key string, pos long, payload string")
    index = indexes.build(d, {"a": typed.json_value(F.col("payload"), "a")})
    assert {r.key: r.a.tag for r in index.collect()} == {"k1": typed.TEXT, "k2": typed.NULL, "k3": typed.BOOL}
    assert [r.key for r in indexes.exact(index, {"a": typed.null()}, ["a"]).collect()] == ["k2"]
    assert [r.key for r in indexes.between(index, {}, "a", ["a"], upper=typed.i64(F.lit(0))).collect()] == ["k2", "k3"]
    with pytest.raises(ValueError):
        indexes.exact(index, {}, ["a"])
    with pytest.raises(Exception, match="no JSON"):
        indexes.build(d, {"a": typed.json_value(F.col("payload"), "a")}, strict=True).collect()


def plain_unique_fold(rows):
    out, held = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        scope = out.setdefault(r["scope"], {}), held.setdefault(r["scope"], {})
        if r["op"] == "clear":
            scope[0].clear(), scope[1].clear()
            continue
        if r["op"] == "put" and scope[1].get(r["unique_value"], r["key"]) != r["key"]:
            continue
        old = scope[0].pop(r["key"], None)
        if old:
            scope[1].pop(old["unique_value"], None)
        if r["op"] == "put":
            scope[0][r["key"]], scope[1][r["unique_value"]] = r, r["key"]
    return sorted((r["scope"], r["key"], r["seq"], r["unique_value"]) for s in out.values() for r in s.values())


def test_unique_fold_equals_plain_fold(spark):
    j = state._journal(spark, SF).withColumns({"scope": F.col("seq") % 5, "unique_value": F.col("amount") % 50})
    assert sorted(tuple(r) for r in state.store_unique_fold(spark, SF).collect()) == plain_unique_fold([r.asDict() for r in j.collect()])


def test_store_clear_and_iterate(spark):
    j = spark.createDataFrame([(1, "put", "a"), (2, "clear", None), (3, "put", "b"), (4, "put", "c"), (5, "delete", "b"), (6, "put", "d")], "seq int, op string, key string")
    s = stores.fold(j)
    assert sorted(r.key for r in s.collect()) == ["c", "d"]
    assert [(r.key, r.next_key) for r in stores.iterate(s, None, 1).collect()] == [("c", "c")]
    assert [(r.key, r.next_key) for r in stores.iterate(s, "c", 5).collect()] == [("d", None)]


def test_hot_key_raises_and_clears(spark):
    w = [(0, i, 20, "h", 15, {"h": 15, "x": 5}) for i in range(3)] + [(0, i, 20, "x", 12, {"h": 2, "x": 12}) for i in range(3, 7)] + [(0, 7, 3, "y", 3, {"y": 3})]
    d = spark.createDataFrame(w, "range long, window long, total long, top string, top_n long, counts map<string,long>")
    got = [r.flagged for r in demand.hot_keys(d, clear_after=2).orderBy("window").collect()]
    assert got == [None, "h", "h", "h", "x", "x", "x", "x"]
    assert traffic.hot_key_flags(spark, SF).count() > 0


def test_hot_key_windows_hold_only_heavy_tokens(spark):
    rows = [(0, w, f"t{i}", 1 + 60 * (i == w % 3)) for w in range(12) for i in range(100)] + [(1, 0, t, n) for t, n in (("a", 3), ("b", 3), ("c", 3), ("d", 1))]
    d = spark.createDataFrame(rows, "range int, window long, token string, n long")
    out = demand.window_tops(d)
    got = {(r.range, r.window): r for r in out.collect()}
    assert all(r.counts == {f"t{r.window % 3}": 61} and r.total == 160 and r.top_n == 61 for k, r in got.items() if k[0] == 0)
    assert got[1, 0].counts == {"a": 3, "b": 3, "c": 3} and got[1, 0].top == "a"
    n = d.groupBy("range", "window").agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("counts"))
    whole = out.drop("counts").join(n, ["range", "window"])
    flags = [sorted(demand.hot_keys(x, share_bp=3500, raise_after=1, clear_after=1).collect()) for x in (out, whole)]
    assert flags[0] == flags[1] and any(r.flagged for r in flags[0])


def test_ewma_holds_no_type_in_one_row(spark):
    rows = [("a", i, float(i * 37 % 101)) for i in range(5000)] + [("b", 1, 3.0)] + [("c", 1, 2.0), ("c", 2, None)] + [(None, 1, 4.0), (None, 2, 8.0)]
    d = spark.createDataFrame(rows, "t string, o long, v double").repartition(3)
    want = {}
    for t in {r[0] for r in rows}:
        a, *rest = [r[2] for r in rows if r[0] == t]
        for x in rest:
            a = None if a is None or x is None else a * 0.8 + x * (1 - 0.8)
        want[t] = a
    out = demand.batch_ewma(d, "t", "o", "v")
    assert {r.t: r.ewma for r in out.collect()} == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_unique_fold_streams_its_scopes(spark):
    """A scope comes as batches, never as one frame."""
    j = spark.range(4000).selectExpr("id % 2 AS scope", "id AS seq", "if(id = 100, 'clear', if(id % 9 = 0, 'delete', 'put')) AS op", "concat('k', id % 31) AS key", "nullif(id % 17, 3) AS unique_value")
    rows, holder = {}, {}
    for r in sorted(j.collect(), key=lambda r: r.seq):
        mine, held = rows.setdefault(r.scope, {}), holder.setdefault(r.scope, {})
        if r.op == "clear":
            mine.clear(), held.clear()
        elif r.op == "delete" or r.unique_value is None or held.get(r.unique_value, r.key) == r.key:
            old = mine.pop(r.key, None)
            if old is not None and old.unique_value is not None:
                held.pop(old.unique_value, None)
            if r.op == "put":
                mine[r.key] = r
                if r.unique_value is not None:
                    held[r.unique_value] = r.key
    out = stores.fold_unique(j.repartition(5), "scope")
    assert sorted(out.collect(), key=repr) == sorted((r for m in rows.values() for r in m.values()), key=repr)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_hot_key_query_equals_a_plain_fold(spark):
    """The registered query against counts and flags kept in dictionaries."""
    rows = traffic.events_feed(spark, SF).select("user_id", "event_time_ns").collect()
    counts = {}
    for r in rows:
        hot = r.event_time_ns // 86400000000000 % 5 < 3
        own = counts.setdefault((r.user_id % 4, r.event_time_ns // 43200000000000), {})
        token = "hot" if hot else f"u{r.user_id % 8}"
        own[token] = own.get(token, 0) + 1
    want, state = [], {}
    for (where, window), own in sorted(counts.items()):
        flagged, streak, candidate, calm = state.get(where, (None, 0, None, 0))
        total, (top, n) = sum(own.values()), min(own.items(), key=lambda x: (-x[1], x[0]))
        if total >= 10:
            big = n * 10000 // total >= 5000
            streak = (streak + 1 if top == candidate else 1) if big else 0
            candidate = top if big else None
            if flagged is not None:
                calm = calm + 1 if own.get(flagged, 0) * 10000 // total < 3000 and top != flagged else 0
                flagged, calm = (None, 0) if calm >= 2 else (flagged, calm)
            if flagged is None and streak >= 2:
                flagged, calm = candidate, 0
        state[where] = flagged, streak, candidate, calm
        want.append((where, window, flagged))
    got = sorted((tuple(r) for r in traffic.hot_key_flags(spark, SF).collect()), key=lambda r: r[:2])
    assert got == want and any(w[2] for w in want)


def test_claims_fold_equals_a_plain_fold(spark):
    d = state.stored_feed(spark, SF).selectExpr("event_id % 5 AS scope", "key", "if(cents % 11 <> 0, cents % 40, null) AS value", "pos")
    rows, holder = {}, {}
    for r in sorted(d.collect(), key=lambda r: r.pos):
        mine, held = rows.setdefault(r.scope, {}), holder.setdefault(r.scope, {})
        lost = r.value is not None and held.get(r.value, r.key) != r.key
        for v in [v for v, k in held.items() if k == r.key]:
            del held[v]
        if r.value is not None and not lost:
            held[r.value] = r.key
        mine[r.key] = (r.value, lost)
    want = sorted(((s, k, *v) for s, m in rows.items() for k, v in m.items()), key=repr)
    got = state.index_claims_fold(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == want and {w[3] for w in want} == {True, False}


def test_pressure_with_cooldown_equals_a_plain_fold(spark):
    rng = __import__("random").Random(5)
    rows = [(r, i, rng.random() < 0.7) for r in range(6) for i in range(80)]
    d = spark.createDataFrame(rows, "r int, i int, hot boolean").repartition(4)
    for n, cooldown in ((1, 0), (3, 0), (3, 5), (2, 1)):
        want = []
        for r in range(6):
            count = rest = 0
            for _, i, hot in [x for x in rows if x[0] == r]:
                if rest:
                    rest -= 1
                elif not hot:
                    count = 0
                else:
                    count += 1
                    if count == n:
                        want.append((r, i))
                        count, rest = 0, cooldown
        assert sorted(map(tuple, demand.pressure_due(d, "r", "i", F.col("hot"), n, cooldown).collect())) == want


def test_routes_among_many_ranges(spark):
    """More ranges than prefixes, uneven ones, and tokens on both sides of each edge."""
    rng = __import__("random").Random(6)
    edges = sorted({f"{rng.getrandbits(128):032x}" for _ in range(3000)} | {"40" + "0" * 30, "41" + "0" * 30})
    ranges = [(i, a, b) for i, (a, b) in enumerate(zip(["", *edges], [*edges, "f" * 33]))]
    d = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    got = demand.route(d, spark.createDataFrame(ranges, "range_id int, start string, end string")).collect()
    tokens = [__import__("hashlib").sha256(r.key.encode()).hexdigest()[:32] for r in got]
    assert len(got) == 2000 and all(ranges[r.range_id][1] <= t < ranges[r.range_id][2] for r, t in zip(got, tokens))


def test_reads_refuse_what_they_cannot_give(spark):
    feed = spark.createDataFrame([(1, b"12345", "k"), (2, b"1", "k")], "pos long, payload binary, key string")
    assert reads.read_within_bytes(feed, 0, 10, 6).count() == 2 and reads.read_within_bytes(feed, 0, 10, 5).count() == 1
    assert reads.read_within_bytes(feed, 2, 10, 1).count() == 0
    for bad in (lambda: reads.read_within_bytes(feed, 0, 10, 4).collect(), lambda: reads.lookup(feed, feed.selectExpr("pos + 1 AS pos")).collect(), lambda: subscriptions.start(feed, "CURSOR", 9).collect(), lambda: reads.search(feed), lambda: subscriptions.start(feed, "THEN")):
        with pytest.raises(Exception):
            bad()
    assert reads.search_progress(feed, 0, 1).first() == (1, False, 1) and reads.search_progress(feed, 0, 2).first() == (2, True, None)
    assert reads.search_progress(feed.limit(0)).first() == (0, True, None)
    rows = spark.createDataFrame([("a", 1)], "key string, v int")
    with pytest.raises(Exception, match="no row for the entry"):
        indexes.resolved(spark.createDataFrame([("i", "x", "b")], "index_name string, values string, key string"), rows).collect()


def test_logs_grow_behind_their_end(spark):
    from keyfold.sources.feeds import append_feed, events_feed
    from keyfold.sources.shared import new_path

    path, feed = new_path(spark, "log"), events_feed(spark, SF)
    append_feed(feed.where("event_id <= 600"), path)
    append_feed(feed.where("event_id > 600"), path)
    append_feed(feed.limit(0), path)
    rows = spark.read.parquet(path).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, feed.count() + 1))
    for part in (rows[: sum(r.event_id <= 600 for r in rows)], rows[sum(r.event_id <= 600 for r in rows) :]):
        assert [(r.ingest_time_ns, r.event_id) for r in part] == sorted((r.ingest_time_ns, r.event_id) for r in part)


def test_sweep_order(spark):
    d = spark.createDataFrame([(f, i, 10, 5, fl) for f, fl in (("held", 0), ("gone", 0), ("both", 0), ("old", 2)) for i in range(1, 4)], "feed string, seq long, bytes long, last_ingest_ns long, floor_seq long")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "feed string")
    got = sorted(map(tuple, governance.sweep(d, 50, 10, None, names("held", "both"), names("gone", "both")).collect()))
    assert got == [("gone", 1, "erased"), ("gone", 2, "erased"), ("gone", 3, "erased"), ("old", 2, "retention"), ("old", 3, "retention")]


def test_unreplicated_control_plane_is_limited(spark):
    d = diagnostics.control_plane(spark.createDataFrame([("n", False, None)], "node string, replicated boolean, leader string"))
    assert d.first().severity == "advisory" and {r.stage: r.status for r in diagnostics.explain(d).collect()}["control plane"] == "limited"
    empty = spark.createDataFrame([], "node string, eligible boolean, exclusions array<string>")
    assert diagnostics.storage(empty).count() == 0 and diagnostics.explain(diagnostics.storage(empty)).where("status <> 'healthy'").count() == 0


@pytest.mark.parametrize("path,found", [("a'b", "1"), ('q"', "2"), ("x.y z", "3"), ("x.none", None), ("c\\d", "4")])
def test_paths_with_quotes(spark, path, found):
    d = spark.createDataFrame([(__import__("json").dumps({"a'b": 1, 'q"': 2, "x": {"y z": 3}, "c\\d": 4}),)], "payload string")
    assert d.select(typed.shown(typed.json_value(F.col("payload"), path))).first()[0] == found
    with pytest.raises(ValueError):
        typed.json_value(F.col("payload"), "both'\"")


def test_averages_as_text(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 2.5, 12345678.9, 1 / 3, 1e16, -0.25, 100.0)], "v double")
    assert [r[0] for r in d.select(typed.plain_decimal(F.col("v"))).collect()] == ["1", "2.5", "12345678.9", "0.3333333333333333", "10000000000000000", "-0.25", "100"]


def test_delay_blocks_a_key_behind_its_parked_record(spark):
    d = spark.createDataFrame([(1, "a", 10), (2, "b", 50), (3, "b", 12), (4, "a", 13)], "pos long, key string, ingest_time_ns long")
    assert sorted(r.pos for r in subscriptions.delayed(d, 40, 10).collect()) == [1, 4]


def test_retention_stops_at_the_first_keeper(spark):
    d = spark.createDataFrame([("f", 1, 10, 5), ("f", 2, 10, 99), ("f", 3, 10, 5), ("g", 1, 10, 5)], "feed string, seq long, bytes long, last_ingest_ns long")
    got = governance.retention(d, 50, 10, None, holds=d.where("feed = 'g'")).collect()
    assert [(r.feed, r.seq) for r in got] == [("f", 1)]


def test_access_denies_by_default(spark):
    asked = spark.createDataFrame([("p", "read", "a.b"), ("p", "write", "a.b"), ("q", "read", "a")], "principal string, action string, resource string")
    grants = spark.createDataFrame([("p", "manage", "a", "allow"), ("p", "write", "a.b", "deny")], "principal string, action string, resource string, effect string")
    assert {(r.principal, r.action): r.allowed for r in governance.access(asked, grants).collect()} == {("p", "read"): True, ("p", "write"): False, ("q", "read"): False}


def test_operators_accept_empty_tables(spark):
    feed = records(spark, [("a", 1, 0, 0)]).limit(0)
    assert pipes.window(feed, WindowPipe("customer", 16 * S, max_late_ns=1, limit_keys=3)).count() == 0
    assert pipes.window_by_watermark(feed, WindowPipe("customer", 16 * S, watermark_ns=1)).count() == 0

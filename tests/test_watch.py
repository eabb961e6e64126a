import time

from docgate.plans import catalog
from docgate.streaming import watch

SF = "/root/testdata/sf0.001"


def put(spark, rows, folder, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_silent_entities_are_told_without_a_new_event_after_a_restart_too(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "entity long, event_id long, at timestamp, status string"
    t = __import__("datetime").datetime(2026, 1, 1)
    put(spark, [(1, 1, t, "running"), (2, 2, t, "running"), (3, 3, t, "finished")], folder, schema)

    def run(seconds, wanted):
        stream = watch.heartbeats(spark.readStream.schema(schema).parquet(folder), stale_ms=4000)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
        end = time.time() + seconds
        try:
            while time.time() < end and query.isActive and (wanted not in told() if wanted else not any(p["numInputRows"] for p in query.recentProgress)):
                time.sleep(0.5)
        finally:
            query.stop()  # wherever it is: a batch that was cut off runs again

    def told():
        try:
            return sorted((r.entity, r.event_id, r.event) for r in spark.read.schema(f"{schema}, event string").parquet(out).collect())
        except Exception:
            return []

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        run(60, None)  # stopped once the rows are in; the timers may not have fired yet
        put(spark, [(2, 4, t.replace(hour=1), "running")], folder, schema)
        run(90, (2, 4, "silent"))
        got = told()
        assert (1, 1, "silent") in got and (2, 4, "silent") in got
        assert not [g for g in got if g[0] == 3]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_poll_machine_restarted_midway_equals_the_query(spark, tmp_path):
    want = {r.segment: (r.state, r.steps, r.ignored) for r in catalog.run("poll_states")(spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "user_id AS segment", "event_id", "cast(ts AS timestamp) AS at",
        "CASE WHEN value > 150 THEN 'failed' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'click' THEN 'polling' WHEN event_type = 'view' THEN 'uploading' ELSE 'creating_task' END AS state",
    )
    rows = sorted(map(tuple, events.collect()), key=lambda r: (r[2], r[1]))
    schema = "segment long, event_id long, at timestamp, state string"
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    latest, paths = {}, {}

    def one(batch, number):
        for r in batch.collect():
            latest[r.segment], paths[r.segment] = (r.state, r.steps, r.ignored), r.path.split(",")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    third = len(rows) // 3
    try:
        # a third of the log is known before the stream begins
        start: dict[int, tuple[str, int, int]] = {}
        for segment, _, _, state in rows[:third]:
            old, steps, ignored = start.get(segment, ("", 0, 0))
            start[segment] = (old, steps, ignored + 1) if old in watch.FINAL else (state, steps + 1, ignored)
        known = spark.createDataFrame([(s, *v) for s, v in start.items()], "segment long, state string, steps long, ignored long")
        for part in (rows[third : 2 * third], rows[2 * third :]):  # the second run goes on from the first one's checkpoint
            put(spark, part, folder, schema)
            stream = watch.polls(spark.readStream.schema(schema).parquet(folder), known)
            stream.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        got = start | latest
        assert got == want
        assert all(p[-1] == latest[s][0] and all(a != b for a, b in zip(p, p[1:], strict=False)) for s, p in paths.items())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from trailspan import testbed
from trailspan.operators import cache, jobs, tracks
from trailspan.streaming import state, upsert

FOLDER = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def streamed(spark, df, parts=3, order=None):
    """The table as a file stream of several batches."""
    path = folder()
    rows = df.withColumn("_part", F.ntile(parts).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(order)))
    for i in range(1, parts + 1):
        rows.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder()).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_engine_health_equals_its_table_twin(spark):
    """Events of each batch out of order, some doubled; the watermark passes all of them with the last batch."""
    log = testbed.engine_log(spark, FOLDER)
    rng = random.Random(2)
    rows = sorted(log.collect(), key=lambda r: r.ts)
    end = rows[-1].ts + dt.timedelta(days=2)
    near = [rows[k:k + 40] for k in range(0, len(rows), 40)]
    shuffled = [r for part in near for r in rng.sample([*part, *part[:5]], len(part) + 5)]  # nothing further off than a block
    span = max((p[-1].ts - p[0].ts for p in near), default=dt.timedelta(0)) * 2 + dt.timedelta(seconds=1)
    # Two last rows of another engine carry the watermark past all others.
    tail = [("none", True, None, end + span, 10**9), ("none", True, None, end + 2 * span, 10**9 + 1)]
    feed = spark.createDataFrame([(i, *r) for i, r in enumerate([*shuffled, *tail])], "_at long, engine string, success boolean, reason string, ts timestamp, seq long")
    out = drain(state.engine_health_stream(streamed(spark, feed, parts=5, order="_at").drop("_at"), f"{int(span.total_seconds())} seconds"), "health", "update")
    last = {}
    for r in out.collect():
        last[r.engine] = (r.failures, r.suspended_until, r.last_reason)
    last.pop("none", None)
    want = {r.engine: (r.failures, r.suspended_until, r.last_reason) for r in jobs.engine_health(log, "2024-01-30 00:00:00").collect()}
    assert last == want


def test_suspension_ends_by_the_clock_and_late_events_go(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    batches = [
        [("a", False, "captcha", at(0), 1), ("a", False, "captcha", at(2), 3)],
        [("a", True, None, at(1), 2), ("a", False, "captcha", at(2), 3), ("b", False, "timed out", at(20), 4)],  # in between, doubled
        [("b", False, "timed out", at(21), 5), ("a", False, "captcha", at(22), 6), ("a", False, "captcha", at(24), 7)],
        [("a", True, None, at(3), 8), ("z", True, None, at(40), 9)],  # too late: the watermark is at 14
        [("z", True, None, at(80), 10)], [("z", True, None, at(200), 11)],
    ]
    path = folder()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "engine string, success boolean, reason string, ts timestamp, seq long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("engine string, success boolean, reason string, ts timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(path)
    out = [r for r in drain(state.engine_health_stream(stream, "10 minutes"), "clock", "update").collect()]
    a = [(r.failures, r.suspended_until, r.is_suspended) for r in out if r.engine == "a"]
    b = [(r.failures, r.suspended_until, r.is_suspended) for r in out if r.engine == "b"]
    assert a[-1] == (3, at(54), False) and (3, at(54), True) in a and all(f != 0 for f, _, _ in a[-2:])
    assert b[-1] == (2, at(51), False) and (2, at(51), True) in b


def test_track_stats_equal_the_table_in_any_order(spark):
    pts = testbed.points(spark, FOLDER).select("track_id", "track_idx", "seq", "lat", "lon", "ele", "ts").cache()
    mixed = pts.unionAll(pts.filter("seq % 7 = 0")).withColumn("_at", F.hash("track_id", "seq", F.monotonically_increasing_id()))
    out = drain(state.track_stats_stream(streamed(spark, mixed, order="_at").drop("_at"), "3650 days"), "stats", "update")
    got = {}
    for r in out.collect():
        if r.n_points >= got.get(r.track_id, (0,))[0]:
            got[r.track_id] = (r.n_points, r.total_distance_m, r.elevation_gain_m, r.elevation_loss_m, r.n_stretches)
    for r in tracks.track_table(pts).collect():
        n, length, up, down, parts = got[r.track_id]
        assert (n, up, down, parts) == (r.n_points, r.elevation_gain_m, r.elevation_loss_m, 1) and abs(length - r.total_distance_m) < 1e-6


def test_still_tracks_are_forgotten(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0, 45.0, 5.0, 1.0, t0, 0), ("a", 1, 45.001, 5.0, 1.0, t0 + dt.timedelta(minutes=1), 1), ("b", 0, 45.0, 5.0, None, t0 + dt.timedelta(days=3), 2), ("b", 1, 45.0, 5.0, None, t0 + dt.timedelta(days=4), 3), ("a", 2, 45.002, 5.0, 1.0, t0 + dt.timedelta(days=5), 4)]
    df = spark.createDataFrame(rows, "track_id string, seq long, lat double, lon double, ele double, ts timestamp, n int")
    out = drain(state.track_stats_stream(streamed(spark, df, parts=5, order="n")), "still", "update").collect()
    assert [r.n_points for r in out if r.track_id == "a"] == [1, 2, 1]


def test_failure_stream_equals_the_report(spark):
    from trailspan.operators import jobs
    from trailspan.sources import responses

    lines = [r.value for r in testbed.failure_lines(spark, FOLDER).select("value").collect()]
    path = folder()
    broken = ['{"source":"s","url":', '{"source":"s","url":"u","attempts":"many","lastError":"e"}', "no json"]
    for k, part in enumerate((lines[::2] + broken[:1], lines[1::2] + broken[1:])):
        with open(f"{path}/log-{k}.jsonl", "w") as f:
            f.write("\n".join(part))
    stream = responses.read_failures_stream(spark, path)
    report = drain(jobs.failure_report(responses.sound_failures(stream)), "failed", "complete")
    want = jobs.failure_report(responses.parse_failures(testbed.failure_lines(spark, FOLDER)))
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, jobs.failure_report(responses.read_failures(spark, path).filter("source = 'google-maps'")).collect())) == sorted(map(tuple, want.filter("source = 'google-maps'").collect()))
    rescued = drain(responses.rescued_failures(responses.read_failures_stream(spark, path)), "rescued", "append").collect()
    assert sorted(r.line for r in rescued) == sorted(broken)
    assert [(r.source, r.url, r.attempts, r.lastError) for r in rescued if "many" in r.line] == [("s", "u", None, "e")]


def test_ttl_misses_equal_table_and_loop(spark):
    req = testbed.requests(spark, FOLDER).select("key", "ts", "event_id").cache()
    last, want = {}, set()
    for r in sorted(req.collect(), key=lambda r: r.ts):
        if r.key not in last or r.ts >= last[r.key] + dt.timedelta(days=1):
            last[r.key] = r.ts
            want.add((r.key, r.ts))
    assert {tuple(r) for r in state.ttl_misses(req, 86_400).collect()} == want
    out = drain(state.ttl_misses_stream(streamed(spark, req, order="event_id"), 86_400), "misses", "append")
    assert {tuple(r) for r in out.collect()} == want


def test_cache_upsert_stream_equals_batch(spark):
    updates = testbed.cache(spark, FOLDER)
    root = folder()
    q = upsert.upsert_stream(streamed(spark, updates, order="version"), root, folder(), "version")
    assert q.awaitTermination(240)
    newest = upsert.read_cache(spark, root, "version").select("osm_id", "name", "version")
    want = cache.upsert(updates.limit(0).drop("status"), updates, "version").select("osm_id", "name", "version")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect()))
    # A query with a new checkpoint on the same root adds to what is there.
    late = cache.acceptable(updates).limit(1).withColumn("name", F.lit("late")).withColumn("version", F.lit(10**6).cast(updates.schema["version"].dataType)).withColumn("enriched_at", F.lit("2100-01-01").cast("timestamp")).withColumn("status", F.lit("done"))
    assert upsert.upsert_stream(streamed(spark, late, order="version"), root, folder(), "version").awaitTermination(240)
    again = {r.osm_id: r.name for r in upsert.read_cache(spark, root, "version").collect()}
    assert len(again) == want.count() and list(again.values()).count("late") == 1


def test_rate_stream_equals_table(spark):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"c{rng.randrange(3)}", t0 + dt.timedelta(seconds=i * 2), i) for i in range(600)]
    rows.append(("end", t0 + dt.timedelta(days=1), 600))
    df = spark.createDataFrame(rows, "client string, ts timestamp, n int")
    got = {(r.window_start, r.client, r.n_requests) for r in drain(upsert.rate_stream(streamed(spark, df, order="n"), limit=10), "rates", "append").collect()}
    want = {tuple(r) for r in jobs.rate_windows(df, limit=10).select("window_start", "client", "n_requests").collect()}
    assert got == want and got

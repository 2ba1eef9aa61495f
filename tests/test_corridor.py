import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_tracks import hav, table
from trailspan import rules
from trailspan.operators import corridor, dedup, pois, tracks
from trailspan.plans.corridor import corridor_pois, sweep
from trailspan.schemas import ELEMENTS

LINE = [(48.8566, 2.3522, None), (48.86, 2.36, None), (48.865, 2.37, None), (48.87, 2.38, None)]


def elements(spark, rows):
    data = []
    for n, (kind, i, lat, lon, center, tags) in enumerate(rows):
        data.append((kind, i, lat, lon, center, tags, n))
    return spark.createDataFrame(data, ELEMENTS + ", ord bigint")


def node(i, lat, lon, **tags):
    return ("node", i, lat, lon, None, tags)


def run(spark, rows, track=LINE, limit=1500.0, radius=50.0):
    return corridor_pois(elements(spark, rows), table(spark, ("t", track)), limit, radius).collect()


def test_first_cases(spark):
    out = run(spark, [
        node(1001, 48.858, 2.356, amenity="drinking_water"), node(1, 49.0, 2.36, amenity="drinking_water"),
        ("way", 6001, None, None, (48.86, 2.36), {"amenity": "shelter"}), ("way", 7001, None, None, None, {"amenity": "shelter"}),
        node(2, 48.86, 2.36, highway="bus_stop"),
    ])
    assert [(r.poi_id, r.category, r.name) for r in out] == [("node/1001", "Water", "Drinking water"), ("way/6001", "Shelter", "Shelter")]
    assert out[0].along_trace_distance < out[1].along_trace_distance


def test_richer_copy_is_kept_and_restaurants_are_not_merged(spark):
    out = run(spark, [
        node(4001, 48.858, 2.356, amenity="drinking_water"), node(4002, 48.8581, 2.3561, amenity="drinking_water", name="Fontaine du Parc"),
        node(5001, 48.858, 2.356, amenity="restaurant", name="Chez A"), node(5002, 48.8581, 2.3561, amenity="restaurant", name="Chez B"),
    ])
    assert sorted(r.name for r in out) == ["Chez A", "Chez B", "Fontaine du Parc"]


def test_adaptive_radius_on_a_chain(spark):
    rows = [node(4200 + i, 48.858 + i * 0.0003, 2.356 + i * 0.0003, amenity="drinking_water", name=f"Water {i}") for i in range(300)]
    rows += [node(99901, 48.95, 2.45, amenity="drinking_water", name="Dense A"), node(99902, 48.9505, 2.45, amenity="drinking_water", name="Dense B")]
    names = {r.name for r in run(spark, rows, limit=20000.0)}
    assert "Dense A" in names and "Dense B" not in names


def test_tag_order_decides_category(spark):
    # Tags come from JSON: a Python dict would not keep its order on the way in.
    df = spark.createDataFrame([
        ("node", 1, 48.9, 2.4, '{"name":"x","shop":"bakery","amenity":"cafe"}'), ("node", 2, 48.9, 2.4, '{"amenity":"cafe","shop":"bakery"}'),
        ("node", 3, 48.9, 2.4, '{"name":"","historic":"city_gate","amenity":"bicycle_repair_station"}'),
    ], "type string, id long, lat double, lon double, j string").select(
        "type", "id", "lat", "lon", F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), F.from_json("j", "map<string,string>").alias("tags"))
    got = {r.poi_id: (r.category, r.icon, r.name) for r in pois.categorize(df).collect()}
    assert got == {"node/1": ("Food shop", "bread", "x"), "node/2": ("Restaurant or Bar", "coffee", "Cafe"), "node/3": ("DIY", "wrench", "Bicycle repair station")}
    icons = {r[0] for r in pois.categorize(df).select(pois.osmand_icon("tags", F.col("category"))).collect()}
    assert icons == {"shop_bakery", "amenity_cafe", "amenity_bicycle_repair_station"}


def test_rules_table(spark):
    t = rules.rules_table(spark)
    assert t.count() == 81 and t.select("category").distinct().count() == 18
    assert len(rules.DEFAULT_CATEGORIES) == 9
    water = pois.tag_predicates(t, ["Water"]).collect()
    assert [(r["key"], r["values"]) for r in water] == [("amenity", ["drinking_water", "water_point"])]


def seg(p, a, b):
    dx, dy = b[1] - a[1], b[0] - a[0]
    if dx * dx + dy * dy == 0:
        return hav(p, a), 0.0
    t = max(0.0, min(1.0, ((p[1] - a[1]) * dx + (p[0] - a[0]) * dy) / (dx * dx + dy * dy)))
    return hav(p, (a[0] + t * dy, a[1] + t * dx)), t


def brute(p, tracks):
    best = (math.inf, None, None)
    for n, t in enumerate(tracks):
        d, along, cum = math.inf, 0.0, 0.0
        for a, b in zip(t, t[1:]):
            di, ti = seg(p, a, b)
            length = hav(a, b)
            if di < d:
                d, along = di, cum + ti * length
            cum += length
        d = min(d, hav(p, t[-1]))
        if d < best[0]:
            best = (d, n, along)
    return best


@pytest.mark.parametrize("lat", [0.0, -43.0, 48.85, 66.0])
@pytest.mark.parametrize("limit", [300.0, 3000.0])
def test_cell_join_equals_brute_force(spark, lat, limit):
    rng = random.Random(int(abs(lat) * 10 + limit))
    tracks = []
    for _ in range(4):
        y, x, t = lat + rng.uniform(-0.1, 0.1), 10 + rng.uniform(-0.1, 0.1), []
        for _ in range(rng.choice([1, 2, 25])):
            t.append((y, x, None))
            step = rng.choice([0.001, 0.01, 0.15])
            y, x = y + rng.uniform(-step, step), x + rng.uniform(-step, step)
        tracks.append(t)
    places = [(f"p{i}", lat + rng.uniform(-0.3, 0.3), 10 + rng.uniform(-0.3, 0.3)) for i in range(250)]
    places += [(f"q{i}", t[-1][0] + 0.001, t[-1][1] - 0.001) for i, t in enumerate(tracks)]
    df = spark.createDataFrame(places, "poi_id string, lat double, lon double")
    pts = table(spark, *[(f"t{i}", t) for i, t in enumerate(tracks)])
    got = {r.poi_id: r for r in corridor.nearest_track(corridor.track_distances(df, pts, limit, block=8)).collect()}
    want = {i: w for i, y, x in places if (w := brute((y, x), tracks))[0] <= limit}
    assert got.keys() == want.keys() and want
    for i, (d, n, along) in want.items():
        assert abs(got[i].distance_to_trace - d) < 1e-6 and got[i].track_idx == n
        assert abs(got[i].along_trace_distance - along) < 1e-4


def test_sweep_counts_agree_with_single_runs(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(f"p{i}", 48.86 + rng.uniform(-0.03, 0.03), 2.36 + rng.uniform(-0.03, 0.03)) for i in range(200)], "poi_id string, lat double, lon double")
    pts = table(spark, ("t", LINE))
    swept = {r.max_distance_m: r.n_pois for r in corridor.distance_sweep(corridor.track_distances(df, pts, 2000.0), [500, 1000, 2000]).collect()}
    for limit, n in swept.items():
        assert corridor.track_distances(df, pts, limit).count() == n


def walk(rows, radius):
    """The greedy walk in input order."""
    out, gone = [], set()
    for i, (cat, ord_, lat, lon, n) in enumerate(rows):
        if i in gone:
            continue
        best = rows[i]
        if cat not in rules.NEVER_MERGED:
            for j in range(i + 1, len(rows)):
                if j not in gone and rows[j][0] == cat and hav((lat, lon), (rows[j][2], rows[j][3])) <= radius:
                    gone.add(j)
                    best = rows[j] if rows[j][4] > best[4] else best
        out.append(best[1])
    return sorted(out)


@pytest.mark.parametrize("crowd", [16, 1])
@pytest.mark.parametrize("shape", ["cloud", "chain", "copies"])
def test_dedup_equals_the_walk(spark, crowd, shape):
    rng = random.Random(len(shape) + crowd)
    rows = []
    for i in range(160):
        cat = rng.choice(["Water", "Water", "Shelter", "Food shop"])
        if shape == "cloud":
            y, x = 60 + rng.uniform(0, 0.006), 5 + rng.uniform(0, 0.012)
        elif shape == "chain":
            y, x = 60 + i * 0.0004, 5 + i * 0.0001
        else:
            y, x = 60 + rng.randrange(3) * 0.0003, 5 + rng.randrange(3) * 0.0003
        rows.append((cat, i, y, x, rng.randrange(5)))
    df = spark.createDataFrame(rows, "category string, ord long, lat double, lon double, n int").selectExpr(
        "concat('p', ord) AS poi_id", "category", "ord", "lat", "lon", "map_from_entries(transform(slice(sequence(1, 9), 1, n), i -> struct(string(i), 'v'))) AS tags"
    )
    got = dedup.dedup_pois(df, 50.0, crowd=crowd)
    assert sorted(r.ord for r in got.collect()) == walk(rows, 50.0)
    assert got.agg(F.sum("n_merged")).first()[0] == len(rows)


@pytest.mark.parametrize("step", [0.0004, 0.00015])
def test_a_long_chain_takes_few_rounds(spark, step):
    """300 places in a row over many cells, each near the one before or the three before."""
    rows = [("run", "Water", i, 60 + i * step, 5.0, 60.0) for i in range(300)]
    spots = spark.createDataFrame(rows, "run_id string, category string, ord long, lat double, lon double, radius double")
    gone, rounds = dedup.absorbed_spots(dedup.neighbours(spots))
    taken = {r.v for t in gone for r in t.collect()}
    assert rounds <= 8 and sorted(set(range(300)) - taken) == walk([("Water", i, y, x, 0) for _, _, i, y, x, _ in rows], 60.0)
    assert {r.ord for r in dedup.find_leaders(spots).collect()} == set(range(300)) - taken


def test_merging_runs_no_python(spark):
    rows = [("p%d" % i, "Water", i, 60 + i * 0.0003, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "poi_id string, category string, ord long, lat double, lon double").withColumn("tags", F.expr("map('k', 'v')"))
    assert "Python" not in plan_of(dedup.dedup_pois(df)) and "Pandas" not in plan_of(dedup.dedup_pois(df))
    assert "Python" not in plan_of(dedup.find_leaders(df.selectExpr("'r' AS run_id", "*", "50.0D AS radius")))


def test_runs_of_segments_meet_few_places(spark):
    """The join sees runs, not segments: far fewer pairs, the same distances."""
    line = [(48.8 + 0.0002 * k, 2.3 + 0.0001 * math.sin(k), None) for k in range(800)]
    rng = random.Random(3)
    df = spark.createDataFrame([(f"p{i}", 48.8 + rng.uniform(0, 0.16), 2.3 + rng.uniform(-0.02, 0.02)) for i in range(300)], "poi_id string, lat double, lon double")
    seg = tracks.track_segments(table(spark, ("t", line)))
    sizes = {run: corridor.near_runs(df, seg, 300.0, run).count() for run in (1, 32)}
    assert 5 * sizes[32] <= sizes[1]
    near = lambda run: {(r.poi_id, r.seg_idx): round(r.d, 6) for r in corridor.near_segments(df, seg, 300.0, run).filter("d <= 300").collect()}
    assert near(1) == near(32) == near(7) != {}
    runs = plan_of(corridor.near_runs(df, tracks.measured_segments(table(spark, ("t", line)), tail=True), 300.0))
    assert "CartesianProduct" not in runs and "NestedLoop" not in runs


def test_runs_are_laid_out_over_few_cells(spark):
    """A run carries its segments into every cell of its padded box: at 1500 m two or three of them, not eight."""
    line = [(44 + 0.00045 * k, 1 + 0.00045 * k, None) for k in range(1600)]
    seg = tracks.measured_segments(table(spark, ("t", line)), tail=True)
    laid = corridor.segment_runs(seg, 1500.0).selectExpr("count(*) AS n", "count(DISTINCT segments[0].seg_idx) AS runs").first()
    assert laid.runs == 100 and laid.n <= 3 * laid.runs


def test_points_are_read_and_shuffled_once(spark):
    """Segments, the ends of blocks and the lengths of blocks come from one shuffle of narrow points."""
    from trailspan import testbed

    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        points = testbed.points(spark, "/root/testdata/sf0.001")
        plan = plan_of(tracks.measured_segments(points, tail=True).select("track_idx", "track_id", "block", "seg_idx", "a_lat", "b_lat", "a_lon", "b_lon", "cum_start_m"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_sweep_keeps_what_single_runs_keep(spark):
    rng = random.Random(12)
    rows = [node(i, 48.858 + rng.uniform(-0.004, 0.004), 2.358 + rng.uniform(-0.006, 0.006), amenity=rng.choice(["drinking_water", "shelter", "restaurant"])) for i in range(150)]
    df, pts = elements(spark, rows), table(spark, ("t", LINE))
    swept = {r.max_distance_m: (r.n_pois, r.n_near, round(r.sum_distance_m, 3)) for r in sweep(pois.categorize(df), pts, [100, 250, 600]).collect()}
    for limit, found in swept.items():
        alone = corridor_pois(df, pts, limit).collect()
        assert found == (len(alone), sum(r.n_merged for r in alone), round(sum(r.distance_to_trace for r in alone), 3))
    assert len(swept) == 3
    two = pts.withColumn("run_id", F.lit("a")).unionByName(pts.withColumn("run_id", F.lit("b")).withColumn("track_id", F.lit("u")).withColumn("track_idx", F.lit(1)))
    for r in sweep(pois.categorize(df), two, [100, 250, 600]).collect():
        assert r.run_id in ("a", "b") and swept[r.max_distance_m][:2] == (r.n_pois, r.n_near)


def test_only_regions_around_the_line_are_read(spark, tmp_path):
    """Folders of other regions may hold anything: they are never opened."""
    from trailspan.schemas import ELEMENTS
    from trailspan.sources import regions

    near = [node(i, 48.857 + 0.001 * i, 2.356, amenity="drinking_water") for i in range(5)]
    far = [node(100 + i, 40.0 + 5 * i, -60.0 + i, amenity="drinking_water") for i in range(4)]
    path = str(tmp_path / "elements")
    regions.write_elements(elements(spark, near + far + [("way", 9, None, None, None, {"amenity": "shelter"})]), path)
    pts = table(spark, ("t", LINE))
    wanted = {str(r.region) for r in regions.regions_around(pts).collect()}
    folders = {p.name.split("=")[1]: p for p in (tmp_path / "elements").glob("region=*")}
    assert set(folders) & wanted and set(folders) - wanted
    for name in set(folders) - wanted:
        for file in folders[name].glob("*.parquet"):
            file.write_bytes(b"not a table")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    read = regions.around(spark, path, f"{ELEMENTS}, ord bigint", pts)
    assert "dynamicpruning" in plan_of(read)
    assert sorted(r.id for r in read.collect()) == [0, 1, 2, 3, 4]


def test_stored_cache_is_looked_up_by_bucket(spark):
    from trailspan.operators import cache

    rows = [("node" if k % 2 else "way", k, f"n{k}", k % 3 == 0) for k in range(1, 400)]
    df = spark.createDataFrame(rows, "osm_type string, osm_id long, name string, old boolean").selectExpr(
        "*", "timestamp'2024-01-01' + make_dt_interval(if(old, 0, 200)) AS enriched_at")
    asked = spark.createDataFrame([("node", k) for k in range(0, 90)] + [("way", 4), ("way", 4), ("other", 3)], "osm_type string, osm_id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.sql("DROP TABLE IF EXISTS stored_cache")
    try:
        cache.store(df, "stored_cache", 16)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = cache.lookup_stored(asked, "stored_cache", "2024-08-01 00:00:00")
        plan = plan_of(found)
        scan = plan.index("FileScan")
        assert "Bucketed: true" in plan
        assert all("Exchange" not in line for line in plan[plan.rindex("\n", 0, plan.index("SortMergeJoin")):scan].splitlines())  # nothing between the join and the cache's scan
        want = cache.lookup(asked, df, "2024-08-01 00:00:00")
        assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect())) != []
        few = cache.lookup_keys(spark, "stored_cache", [("node", 5), ("way", 4), ("other", 1)], "2024-08-01 00:00:00")
        assert sorted(r.name for r in few.collect()) == ["n4", "n5"]
        own = {r[0] for r in few.select(F.input_file_name()).distinct().collect()}
        files = {Path(f.removeprefix("file:")) for f in spark.table("stored_cache").inputFiles()}
        others = [f for f in files if f"file://{f}" not in own and f"file:{f}" not in own]
        assert len(others) >= 10
        for f in others:  # what other buckets hold doesn't matter: they aren't opened
            f.write_bytes(b"not a table")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        again = cache.lookup_keys(spark, "stored_cache", [("node", 5), ("way", 4)], "2024-08-01 00:00:00")
        assert sorted(r.name for r in again.collect()) == ["n4", "n5"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS stored_cache")


def test_runs_are_kept_apart(spark):
    rows = [("a", "Water", 0, 60.0, 5.0), ("b", "Water", 1, 60.0, 5.0), ("b", "Water", 2, 60.0, 5.0)]
    df = spark.createDataFrame(rows, "run_id string, category string, ord long, lat double, lon double").selectExpr("concat('p', ord) AS poi_id", "*", "map('k', 'v') AS tags")
    got = {(r.run_id, r.ord): r.n_merged for r in dedup.dedup_pois(df).collect()}
    assert got == {("a", 0): 1, ("b", 1): 2}


def test_first_copy_wins(spark):
    df = spark.createDataFrame([("node", 1, 2, 0, "late"), ("node", 1, 0, 5, "first"), ("node", 1, 0, 9, "later"), ("way", 1, 3, 3, "other")], "type string, id long, chunk int, pos int, label string")
    assert {(r.type, r.label) for r in pois.osm_dedup(df).collect()} == {("node", "first"), ("way", "other")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops_and_no_row_udfs(spark):
    from trailspan.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    for name in ("corridor_join", "distance_sweep", "deterministic_enrich", "snippet_topk", "cache_split", "hours_rows", "resample_track"):
        plan = plan_of(QUERIES[name](spark, folder))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert word not in plan, (name, word)
    assert "WindowGroupLimit" in plan_of(QUERIES["snippet_topk"](spark, folder))
    enrich = plan_of(QUERIES["deterministic_enrich"](spark, folder))
    assert enrich.count("FileScan") == 4 and enrich.count("hashpartitioning(poi_id#") <= 3  # a scan for each source; one more by page
    for name in ("snippet_dedup", "price_level", "deterministic_enrich", "osm_dedup"):
        plan = plan_of(QUERIES[name](spark, folder))
        assert all("content" not in line for line in plan.splitlines() if "SortAggregate" in line), name
    scan = plan_of(QUERIES["track_length"](spark, folder))
    assert "ReadSchema: struct<event_id:bigint>" in scan


def test_runs_do_not_meet(spark):
    """Another run's tracks change nothing: not what is near, not the radius, not the merging."""
    from pyspark.sql import functions as F

    from trailspan.plans.corridor import corridor_pois

    rows = [("node", k, 48.85 + 0.0004 * k, 2.35, {"amenity": "drinking_water"}, k) for k in range(40)]
    elements = spark.createDataFrame(rows, "type string, id long, lat double, lon double, tags map<string,string>, ord long").withColumn(
        "center", F.lit(None).cast("struct<lat:double,lon:double>"))
    def track(run, idx, lon):
        return [(f"t{idx}", idx, s, 48.85 + 0.001 * s, lon, None, None, run) for s in range(18)]
    schema = "track_id string, track_idx int, seq long, lat double, lon double, ele double, time string, run_id string"
    one, two = track("a", 0, 2.351), track("b", 1, 2.352)
    def near(points, run):
        out = corridor_pois(elements, spark.createDataFrame(points, schema), 400.0)
        return [(r.poi_id, r.n_merged, round(r.distance_to_trace, 6)) for r in out.filter(F.col("run_id") == run).collect()]
    assert near(one + two, "a") == near(one, "a") != []
    assert near(one + two, "b") == near(two, "b") != []

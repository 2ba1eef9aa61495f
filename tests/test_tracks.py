import math

import pytest
from pyspark.sql import functions as F

from trailspan.functions import geo
from trailspan.functions import text as T
from trailspan.operators import tracks
from trailspan.schemas import POINTS


def hav(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12_742_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def table(spark, *named):
    rows = [(t, n, i, *p, None) for n, (t, pts) in enumerate(named) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, POINTS)


def wavy(n, ele=True):
    return [(45 + i * 0.001, 5 + math.sin(i / 7) * 0.01, 100.0 + (i * 37 % 11) if ele else None) for i in range(n)]


def test_haversine(spark):
    one = spark.range(1).select(
        geo.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(48.8656), F.lit(2.3522)).alias("d"),
        geo.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(48.8566), F.lit(2.3522)).alias("z"),
    ).first()
    assert 900 < one.d < 1100 and one.z == 0


def test_rounding_goes_up_at_half(spark):
    row = spark.range(1).select(T.js_round(F.lit(-2.5)).alias("a"), T.js_round(F.lit(2.5)).alias("b")).first()
    assert (row.a, row.b) == (-2, 3)


@pytest.mark.parametrize("block", [2, 7, 8, 1000])
def test_blocks_do_not_change_results(spark, block):
    pts = wavy(50)
    df = table(spark, ("a", pts), ("b", pts[:8]), ("c", pts[:1]))
    want = {}
    for name, p in (("a", pts), ("b", pts[:8]), ("c", pts[:1])):
        total = 0.0
        for i in range(len(p)):
            total += hav(p[i - 1], p[i]) if i else 0
            want[(name, i)] = total
    got = {(r.track_id, r.seq): r.cum_m for r in tracks.cumulative_distance(df, block).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    lengths = {r.track_id: (r.total_distance_m, r.n_points) for r in tracks.track_length(df, block).collect()}
    assert lengths["c"] == (0.0, 1) and abs(lengths["a"][0] - want[("a", 49)]) < 1e-6
    assert tracks.track_segments(df, block).count() == 49 + 7


@pytest.mark.parametrize("block", [1, 2, 3, 8, 8192])
def test_gaps_in_seq_change_nothing(spark, block):
    pts = wavy(20)
    seq = [5, 6, 7, 9, 30, 31, 64, 65, 66, 90, 91, 500, 501, 502, 503, 504, 9000, 9001, 20000, 20001]
    dense = table(spark, ("a", pts), ("b", pts[:2]), ("c", pts[:1]))
    gaps = dense.join(spark.createDataFrame(list(enumerate(seq)), "seq long, new long"), "seq").drop("seq").withColumnRenamed("new", "seq")
    want = {(r.track_id, seq[r.seq]): round(r.cum_m, 6) for r in tracks.cumulative_distance(dense, 8192).collect()}
    assert {(r.track_id, r.seq): round(r.cum_m, 6) for r in tracks.cumulative_distance(gaps, block).collect()} == want
    same = lambda f: [sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in f(df, b).collect()) for df, b in ((gaps, block), (dense, 8192))]
    for f in (tracks.track_length, tracks.track_table, lambda d, b: tracks.elevation_stats(d, block=b), lambda d, b: tracks.resample(d, 300.0, b)):
        got, expected = same(f)
        assert got == expected


def resample_loop(p, spacing):
    if len(p) < 2:
        return p
    cum = [0.0]
    for i in range(1, len(p)):
        cum.append(cum[-1] + hav(p[i - 1], p[i]))
    if cum[-1] == 0:
        return p[:1]
    n = max(2, math.floor(cum[-1] / spacing + 0.5))
    out = []
    for i in range(n):
        target = i / (n - 1) * cum[-1]
        j = next((k for k in range(1, len(cum)) if cum[k] >= target), len(cum) - 1) - 1
        length = cum[j + 1] - cum[j]
        t = (target - cum[j]) / length if length > 0 else 0
        out.append(tuple(p[j][c] + t * (p[j + 1][c] - p[j][c]) for c in range(3)))
    return out


@pytest.mark.parametrize("block", [4, 1000])
@pytest.mark.parametrize("spacing", [60.0, 500.0, 5000.0])
def test_resample_equals_the_loop(spark, block, spacing):
    pts = wavy(40)
    stops = [pts[0], pts[0], pts[1], pts[1], pts[2]]
    named = [("a", pts), ("b", stops), ("one", pts[:1]), ("still", [pts[3]] * 3)]
    got = {}
    for r in tracks.resample(table(spark, *named), spacing, block).orderBy("track_id", "seq").collect():
        got.setdefault(r.track_id, []).append((r.lat, r.lon, r.ele))
    for name, p in named:
        want = resample_loop(p, spacing)
        assert len(got[name]) == len(want)
        for g, w in zip(got[name], want):
            assert all(abs(a - b) < 1e-9 for a, b in zip(g, w))


def test_elevation(spark):
    up = [(45.0 + i * 0.01, 5.0, e) for i, e in enumerate([100.0, 101.0, 105.5, 103.0, 103.5])]
    gap = [(45.0 + i * 0.01, 5.0, e) for i, e in enumerate([100.0, None, 150.0])]
    nan = [(45.0 + i * 0.01, 5.0, e) for i, e in enumerate([100.0, float("nan"), 150.0, 153.0])]
    df = table(spark, ("up", up), ("gap", gap), ("nan", nan), ("one", [(45.0, 5.0, None)]))
    got = {r.track_id: (r.elevation_gain_m, r.elevation_loss_m) for r in tracks.elevation_stats(df).collect()}
    assert got == {"up": (5, 3), "gap": (0, 0), "nan": (3, 0), "one": (0, 0)}
    loose = {r.track_id: r.elevation_gain_m for r in tracks.elevation_stats(df, strict=False).collect()}
    assert loose["gap"] == 0 and loose["up"] == 5
    whole = {r.track_id: (r.elevation_gain_m, r.n_points) for r in tracks.track_table(df).collect()}
    assert whole["up"] == (5, 5) and whole["gap"] == (0, 3)


def test_dense_seq(spark):
    rows = [("t", 0, s, 45.0, 5.0, None, None) for s in (3, 10, 11, 40, 41, 99)]
    df = tracks.dense_seq(spark.createDataFrame(rows, POINTS), block=10).orderBy("seq")
    assert [r.seq for r in df.collect()] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("n,m", [(200, 50), (50, 50), (51, 50), (48, 25), (3, 25), (1, 25), (4, 4), (47 * 2 + 1, 50)])
def test_chunks(spark, n, m):
    want, i = [], 0
    if n <= m:
        want = [(0, n)]
    else:
        while i < n:
            if min(n, i + m) - i >= 2:
                want.append((i, min(n, i + m) - i))
            i += m - 3
    got = tracks.track_chunks(table(spark, ("t", wavy(n))), m).orderBy("chunk").collect()
    assert [(r.first_seq, r.n_points) for r in got] == want


def test_bbox_and_rollup(spark):
    df = table(spark, ("a", wavy(20)), ("b", wavy(5)))
    box = tracks.track_bbox(df).first()
    assert box.min_lat == 45 and abs(box.max_lat - 45.019) < 1e-9
    rolled = {r.track_id: (r.n_points, r.n_resampled) for r in tracks.track_rollup(df).collect()}
    assert rolled[None][0] == 25 and rolled[None][1] == tracks.resample(df).count()

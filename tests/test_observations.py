"""Small exact cases of the observation operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sonagrid.functions import geo, text, time
from sonagrid.operators import aggregates, clusters, dataset, filters, ingest, joins, voting, zones
from sonagrid.operators.filters import ObservationFilter

T0 = datetime(2024, 5, 1, 6, 0, 0)


def detections(spark, rows):
    """(id, device, species, confidence, minutes after T0, lat, lon)"""
    data = [(i, d, s, c, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m, seconds=7.5), lat, lon, None) for i, d, s, c, m, lat, lon in rows]
    return spark.createDataFrame(data, "id long, device_id string, species_slug string, confidence double, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz, lat double, lon double, duplicate_of_id long")


@pytest.fixture(scope="module")
def populated(spark):
    rows = [(i, "dev_a", "corvus", 0.8 + i % 10 / 50, -i, 59.9 + i % 5 * 1e-4, 41.1 + i % 7 * 1e-4) for i in range(150)]
    rows += [(200 + i, "dev_b", "corvus", 0.9, -2000 - i, 59.91, 41.11) for i in range(40)]
    rows += [(300 + i, "dev_a", "strix", 0.9, -1000 - i, 59.902, 41.102) for i in range(30)]
    rows += [(400, "dev_a", "strix", 0.9, -5, None, None)]
    return detections(spark, rows).cache()


def test_geohash_known_cells(spark):
    row = spark.range(1).select(geo.geohash(57.64911, 10.40744, 11).alias("a"), geo.geohash(0.0, 0.0, 5).alias("b"), geo.geohash(91.0, 0.0, 5).alias("c")).first()
    assert (row.a, row.b, row.c) == ("u4pruydqqvj", "s0000", None)


def test_geohash_box_holds_its_point(spark):
    rows = spark.createDataFrame([(59.9, 41.1), (-33.4, 151.2), (0.0, -179.9)], "lat double, lon double")
    box = geo.geohash_box(geo.geohash("lat", "lon", 7), 7)
    found = rows.select("lat", "lon", box.alias("b")).collect()
    assert all(r.b.min_lat <= r.lat < r.b.max_lat and r.b.min_lon <= r.lon < r.b.max_lon for r in found)


def test_haversine_and_ring(spark):
    row = spark.range(1).select(geo.haversine(0.0, 0.0, 0.0, 1.0).alias("d"), F.size(geo.circle_ring(59.9, 41.1, 500.0)).alias("n"), geo.haversine(F.lit(None).cast("double"), 0.0, 0.0, 1.0).alias("u")).first()
    assert abs(row.d - 111195.08) < 0.01 and row.n == 49 and row.u is None


def test_grid_counts_and_filters(populated):
    corvus = ObservationFilter(species=["corvus"]).apply(populated)
    cells = zones.grid(corvus).collect()
    assert sum(r.cnt for r in cells) == 190 and max(r.heat for r in cells) == 1.0
    recent = ObservationFilter(species=["corvus"], start=T0 - timedelta(minutes=59)).apply(populated)
    assert recent.count() == 60
    assert ObservationFilter(species=["strix"]).apply(populated).count() == 30
    assert ObservationFilter(species=["strix"], require_location=False).apply(populated).count() == 31


def test_radius_is_a_circle_not_a_box(spark):
    rows = detections(spark, [(1, "d", "s", 0.9, 0, 59.9, 41.1), (2, "d", "s", 0.9, 0, 59.9044, 41.1088)])
    assert [r.id for r in ObservationFilter(center=(59.9, 41.1), radius_m=600.0).apply(rows).collect()] == [1]


def test_filter_pushes_box_to_scan(spark, tmp_path, populated):
    populated.write.parquet(str(tmp_path / "d"))
    rows = ObservationFilter(center=(59.9, 41.1), radius_m=600.0).apply(spark.read.parquet(str(tmp_path / "d")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat" in plan and "LessThanOrEqual(lon" in plan


def test_filter_rejects_bad_box_and_knows_empty():
    with pytest.raises(ValueError):
        ObservationFilter(bbox=(2, 0, 1, 1))
    assert ObservationFilter(min_confidence=0.0).is_empty() and not ObservationFilter(hours=[30]).is_empty()
    assert ObservationFilter(hours=[30, -1, 6]).hours == (6, 23)


def test_limit_takes_the_earliest(populated):
    rows = ObservationFilter(species=["corvus"], limit=40).apply(populated).collect()
    assert {r.device_id for r in rows} == {"dev_b"}


def test_a_limit_is_kept_or_refused():
    assert ObservationFilter(limit=200_000).limit == 200_000
    with pytest.raises(ValueError, match="200000"):
        ObservationFilter(limit=200_001)


def test_hourly_is_filled_and_peak_takes_lowest(spark):
    rows = detections(spark, [(1, "d", "s", 0.9, 0, 1.0, 1.0), (2, "d", "s", 0.9, 60, 1.0, 1.0)])
    hours = aggregates.hourly(rows).collect()
    assert len(hours) == 24 and sum(r.cnt for r in hours) == 2
    assert aggregates.peak_hour(rows).first().peak_hour == 6


@pytest.mark.parametrize(("a", "b", "normalize", "delta", "change"), [(10, 20, True, 5.0, "grew"), (10, 20, False, 10.0, "grew"), (10, 10, True, 0.0, "stable"), (0, 20, True, 10.0, "appeared"), (20, 0, True, -10.0, "disappeared")])
def test_period_diff(spark, a, b, normalize, delta, change):
    make = lambda n: detections(spark, [(i, "d", "s", 0.9, i, 59.9003, 41.1003) for i in range(n)])
    two = spark.createDataFrame([(2,)], "n long")
    row = zones.period_diff(make(a), make(b), two, normalize=normalize).first()
    assert (row.delta, row.change) == (delta, change)


def windows(spark, species):
    rows = [("c", i, i * 2.5, i * 2.5 + 5, s, p) for i, (s, p) in enumerate(species)]
    return spark.createDataFrame(rows, "chunk_id string, idx int, start_sec double, end_sec double, species string, prob double")


def test_vote_needs_two_of_three(spark):
    assert voting.vote_spans(windows(spark, [(None, 0.1), ("a", 0.9), (None, 0.1)])).count() == 0
    spans = voting.vote_spans(windows(spark, [(None, 0.1), (None, 0.1)] + [("a", 0.93)] * 5)).collect()
    assert [(s.start_sec, s.end_sec, s.confidence) for s in spans] == [(5.0, 20.0, 0.93)]


def test_vote_change_of_species_and_tie(spark):
    series = windows(spark, [("a", 0.9)] * 3 + [("b", 0.8)] * 3)
    assert {s.species for s in voting.vote_spans(series).collect()} == {"a", "b"}
    assert [(r.idx, r.species) for r in voting.vote_changes(series).orderBy("idx").collect()] == [(1, "a"), (4, "b")]
    assert [(r.idx, r.species) for r in voting.vote_mobile(series).orderBy("idx").collect()] == [(1, "a"), (3, "a"), (4, "b")]


def test_vote_mean_is_pairwise(spark):
    spans = voting.vote_spans(windows(spark, [("a", 0.5), ("a", 0.7), ("a", 0.9)])).first()
    assert abs(spans.mean_confidence - ((0.5 + 0.7) / 2 + (0.5 + 0.7 + 0.9) / 3) / 2) < 1e-12


def test_classify_threshold_is_closed(spark):
    rows = spark.createDataFrame([("a", 0.6), ("a", 0.59), ("_noise", 0.99)], "s string, p double")
    assert [r.c for r in rows.select(voting.classify(F.col("s"), F.col("p")).alias("c")).collect()] == ["detected", "uncertain", "uncertain"]


def chunks(spark, rows):
    data = [(i, "d", T0 + timedelta(seconds=s), T0 + timedelta(seconds=e), i, i, "x") for i, (s, e) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, device_id string, started_at timestamp_ntz, ended_at timestamp_ntz, arrival long, seq int, sha256 string")


def test_chunk_timing_overlap_gap_and_order(spark):
    t = {r.id: r for r in ingest.chunk_timing(chunks(spark, [(0, 60), (5, 65), (265, 325), (345, 405), (10, 70)])).collect()}
    assert t[1].overlap_sec == 55 and not t[1].gap_event
    assert t[2].gap_sec == 200 and t[2].gap_event
    assert t[3].gap_sec == 20 and not t[3].gap_event
    assert t[4].out_of_order and t[4].gap_sec == 0 and t[4].overlap_sec == 0


def test_gap_threshold_is_strict(spark):
    row = spark.range(1).select(ingest.gap_required(F.lit(180.0), F.lit(60.0)).alias("a"), ingest.gap_required(F.lit(240.0), F.lit(60.0)).alias("b")).first()
    assert (row.a, row.b) == (False, True)


def test_duplicates_absorb_nothing(spark):
    # b overlaps a, c overlaps b but not a: c stays
    data = [(1, "d", "s", 0.0, 10.0), (2, "d", "s", 5.0, 15.0), (3, "d", "s", 10.0, 20.0), (4, "d", "s", 30.0, 40.0)]
    rows = spark.createDataFrame([(i, d, s, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b)) for i, d, s, a, b in data], "id long, device_id string, species_slug string, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz")
    assert {r.id: r.duplicate_of_id for r in ingest.mark_duplicates(rows).collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_only_the_seam_holds_duplicates(spark):
    """A call at the seam of two chunks is found twice; one inside a chunk is not looked at."""
    zones_ = spark.createDataFrame([(1, T0.timestamp(), T0.timestamp()), (2, T0.timestamp() + 54.7, T0.timestamp() + 60)], "id long, zone_start double, zone_end double")
    at = lambda i, chunk, a: (i, chunk, "d", "s", T0 + timedelta(seconds=a), T0 + timedelta(seconds=a + 5))
    rows = spark.createDataFrame([at(1, 1, 55.0), at(2, 2, 55.0), at(3, 2, 80.0), at(4, 2, 81.0), at(5, 9, 55.0)], "id long, chunk_id long, device_id string, species_slug string, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz")
    marked = ingest.at_seam(rows, zones_)
    assert {r.id for r in marked.filter("at_seam").collect()} == {2}
    assert {r.id: r.duplicate_of_id for r in ingest.mark_duplicates(marked, may="at_seam").collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    assert {r.id: r.duplicate_of_id for r in ingest.mark_duplicates(marked).collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: 1}


def test_trust_and_index(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    subs = spark.createDataFrame([(1, "accepted"), (1, "accepted"), (1, "rejected")], "user_id int, status string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    assert {r.user_id: r.trust for r in aggregates.trust_of(asked, users, subs).collect()} == {1: 0.67, 2: 1.0, 3: 0.0}
    counts = spark.createDataFrame([("a", 1), ("b", 1)], "slug string, n long")
    weights = spark.createDataFrame([("a", 0.8), ("b", 1.0)], "slug string, affinity double")
    assert aggregates.wetland_index(counts, weights).first().wetland_index == 0.9
    none = aggregates.wetland_index(counts, weights.withColumn("affinity", F.lit(None).cast("double"))).first()
    assert none.wetland_index is None and not none.calibrated
    assert aggregates.wetland_index(counts.limit(0), weights).first().status == "empty"


def test_split_never_shares_recordings(spark):
    rows = [(c, f"{c}_{r}", p) for c in "abc" for r in range(9) for p in range(2)] + [("one", "one_0", 0), ("two", "two_0", 0), ("two", "two_1", 0)]
    split = dataset.group_split(spark.createDataFrame(rows, "class string, recording_id string, file int"))
    assert dataset.leaking_recordings(split).count() == 0 and split.count() == len(rows)
    assert {r.split for r in split.filter("class = 'one'").collect()} == {"train"}
    assert {r.split for r in split.filter("class = 'two'").collect()} == {"train", "val"}
    assert {r.split for r in split.filter("class = 'a'").collect()} == {"train", "val", "test"}


def test_text_helpers(spark):
    rows = spark.createDataFrame([("a/rec_1_part02.wav",), ("b/x.wav",)], "p string")
    assert [r.x for r in rows.select(text.recording_id("p").alias("x")).collect()] == ["rec_1", "x"]
    row = spark.range(1).select(text.sanitize(F.lit("  Серая цапля!? ")).alias("a"), text.sanitize(F.lit("")).alias("b")).first()
    assert (row.a, row.b) == ("Серая_цапля", "unknown")


def test_time_bucket_starts_anew_each_day(spark):
    row = spark.range(1).select(time.time_bucket(F.lit(datetime(2024, 1, 1, 23, 30)), 5).cast("string").alias("a")).first()
    assert row.a.startswith("2024-01-01 20:00:00")


def test_density_equals_a_plain_sum(spark):
    """The bounded kernel over summed places against every point at every node."""
    import numpy as np

    rng = np.random.default_rng(5)
    points = [(i, "d", "s", round(float(rng.uniform(0.3, 1)), 3), i, 59.9 + int(rng.integers(30)) * 1e-3, 41.1 + int(rng.integers(30)) * 2e-3) for i in range(300)]
    rows = detections(spark, points)
    for some in (rows, rows.withColumn("confidence", F.lit(0.7))):
        data = some.select("lat", "lon", "confidence").collect()
        lat, lon, c = (np.array([r[k] for r in data]) for k in range(3))
        w = c / c.sum()
        x, y = (lon - lon.mean()) * geo.DEGREE_M * np.cos(np.radians(lat.mean())), (lat - lat.mean()) * geo.DEGREE_M
        spread = max(np.ptp(x), np.ptp(y))
        d = np.stack((x, y)) - np.array([[(w * x).sum()], [(w * y).sum()]])
        cov = (w * d) @ d.T * (200 / spread) ** 2 / (1 - (w**2).sum())
        gx, gy = (np.linspace(v.min() - 200, v.max() + 200, 32) for v in (x, y))
        inverse = np.linalg.inv(cov)
        want = np.zeros((32, 32))
        for a, b, v in zip(x, y, w, strict=True):
            dx, dy = gx[:, None] - a, gy[None, :] - b
            want += v * np.exp(-0.5 * (inverse[0, 0] * dx**2 + 2 * inverse[0, 1] * dx * dy + inverse[1, 1] * dy**2)) / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
        found = zones.kde(some, 200.0, size=32, fold_m=0).collect()
        got = np.zeros((32, 32))
        for r in found:
            got[r.gx, r.gy] = r.density
            assert abs(r.x - gx[r.gx]) < 1e-6 and abs(r.y - gy[r.gy]) < 1e-6
        assert len(found) == 1024 and np.abs(got - want).max() < 1e-9 * want.max()
        folded = {(r.gx, r.gy): r.density for r in zones.kde(some, 200.0, size=32).collect()}
        assert max(abs(folded[r.gx, r.gy] - r.density) for r in found) < 0.01 * want.max()
    assert zones.kde(rows.filter("false")).collect() == [] and zones.kde(rows.limit(1)).collect() == []


def test_hotspots_find_two_groups(spark):
    near = [(i, "d", "s", 0.9, i, 59.9 + i * 1e-4, 41.1) for i in range(6)]
    far = [(10 + i, "d", "s", 0.9, i, 59.95 + i * 1e-4, 41.2) for i in range(4)]
    rows = detections(spark, [*near, *far, (30, "d", "s", 0.9, 5, 59.0, 40.0)])
    for standard in (True, False):
        found = zones.hotspots(rows, eps_m=100.0, standard=standard).collect()
        assert sorted(r.detections for r in found) == [4, 6]


def test_clusters_equal_brute_force(spark):
    """Density clusters with many points of one place, against a plain search."""
    import random
    from math import asin, cos, radians, sin, sqrt

    rng = random.Random(4)
    spots = [(59.9 + rng.randrange(40) * 4e-4, 41.1 + rng.randrange(40) * 8e-4) for _ in range(60)]
    points = [(i, rng.choice("ab"), rng.choice([*spots, spots[0], spots[0]])) for i in range(160)]
    frame = spark.createDataFrame([(i, s, 1, *x) for i, s, x in points], "id long, species_slug string, bucket int, lat double, lon double")

    def apart(p, q):
        (a, b), (c, d) = (map(radians, x) for x in (p, q))
        return 2 * geo.EARTH_M * asin(sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2))

    for eps, least in ((120.0, 3), (200.0, 5), (50.0, 1)):
        near = {i: {j for j, t, y in points if t == s and apart(x, y) <= eps} for i, s, x in points}
        core = {i for i in near if len(near[i]) >= least}
        label = {i: i for i in core}
        while True:
            after = {i: min(label[j] for j in near[i] & core) for i in core}
            if after == label:
                break
            label = after
        want = label | {i: min(label[j] for j in near[i] & core) for i in near if i not in core and near[i] & core}
        got = {r.id: r.cluster for r in clusters.density_clusters(frame, eps, least).collect()}
        assert got == want


def test_missing_device_goes_by_its_id(spark):
    devices = spark.createDataFrame([("dev_a", "North")], "device_id string, name string")
    rows = detections(spark, [(1, "dev_a", "s", 0.9, 0, 1.0, 1.0), (2, "dev_b", "s", 0.9, 0, 1.0, 1.0)])
    assert {r.id: r.name for r in joins.with_device_name(rows, devices).collect()} == {1: "North", 2: "dev_b"}


def test_chunk_rejection(spark):
    rows = chunks(spark, [(0, 60), (0, 10), (0, 200), (0, 0)])
    found = rows.select("id", filters.chunk_rejection(F.lit(T0 + timedelta(seconds=90))).alias("why")).collect()
    assert {r.id: r.why for r in found} == {0: None, 1: "too_short", 2: "too_long", 3: "not_positive"}

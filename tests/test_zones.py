"""Density clusters by cells and contours as rings, against plain searches."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.functions import geo
from sonagrid.operators import clusters, contours


def apart(p, q):
    (a, b), (c, d) = ((math.radians(x) for x in p), (math.radians(x) for x in q))
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def brute(points, eps, least):
    near = [[j for j, q in enumerate(points) if apart(p, q) <= eps] for p in points]
    core = {i for i in range(len(points)) if len(near[i]) >= least}
    label = {i: i for i in core}
    while True:
        after = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if after == label:
            break
        label = after
    return label | {i: min(label[j] for j in near[i] if j in core) for i in range(len(points)) if i not in core and any(j in core for j in near[i])}


def frame(spark, points):
    return spark.createDataFrame([(i, "s", 1, *p) for i, p in enumerate(points)], "id long, species_slug string, bucket int, lat double, lon double")


def cluster(spark, points, eps, least):
    return {r.id: r.cluster for r in clusters.density_clusters(frame(spark, points), eps, least).collect()}


def near_the_line(rng, lat, lon, many, spread):
    """Points round a place, longitudes kept in range across the line where they jump."""
    width = spread / max(math.cos(math.radians(lat)), 1e-3)
    return [(lat + rng.uniform(-spread, spread), (lon + rng.uniform(-width, width) + 180) % 360 - 180) for _ in range(many)]


@pytest.mark.parametrize(("lat", "lon"), [(59.9, 41.1), (0.0, 180.0), (-89.99, 10.0)])
def test_clusters_anywhere_on_the_globe(spark, lat, lon):
    rng = random.Random(int(lat) + 100)
    points = near_the_line(rng, lat, lon, 120, 0.004) + near_the_line(rng, lat, lon, 40, 0.0004) + [(lat, lon if lon < 180 else -180.0)] * 3
    points = [(max(-90.0, a), b) for a, b in points]
    for eps, least in ((110.0, 4), (60.0, 3)):
        assert cluster(spark, points, eps, least) == brute(points, eps, least)


def test_cells_that_only_some_bins_link(spark):
    """Two dense lines whose ends alone are within reach, and two that stay a little beyond."""
    step = 1 / (math.pi / 180 * geo.EARTH_M)  # a metre
    line = lambda lat, n: [(lat + k * 2 * step, 20.0) for k in range(n)]
    for gap in (99.9, 100.1):
        points = line(10.0, 40) + line(10.0 + (78 + gap) * step, 40)
        found = cluster(spark, points, 100.0, 3)
        assert len(set(found.values())) == (1 if gap < 100 else 2)
        assert found == brute(points, 100.0, 3)


def test_many_places_in_one_cell_make_few_rows(spark, monkeypatch):
    """10 000 jittered points in one cell: no join gives rows in proportion to their pairs."""
    rng = random.Random(1)
    points = [(59.9 + rng.uniform(0, 1e-4), 41.1 + rng.uniform(0, 1e-4)) for _ in range(10_000)] + [(59.91, 41.1), (59.9004, 41.1)]
    made = []
    around = clusters.Grid.around

    def counted(self, rows, *box):
        out = around(self, rows, *box)
        made.append(out.count())
        return out

    monkeypatch.setattr(clusters.Grid, "around", counted)
    found = cluster(spark, points, 100.0, 5)
    assert set(found) == {*range(10_000), 10_001} and set(found.values()) == {0}
    assert sum(made) < 500


def plain_rings(density, size):
    """Crossed edges of a padded grid, chained by hand: for each level the sets of corners."""
    grid = np.zeros((size + 2, size + 2))
    for r in density:
        grid[r.gx + 1, r.gy + 1] = r.density
    out = {}
    for share in contours.LEVELS:
        level = share * grid.max()
        over = grid > level
        edges = set()
        for i in range(size + 2):
            for j in range(size + 2):
                if i + 1 < size + 2 and over[i, j] != over[i + 1, j]:
                    edges.add((i - 1, j - 1, 0))
                if j + 1 < size + 2 and over[i, j] != over[i, j + 1]:
                    edges.add((i - 1, j - 1, 1))
        out[share] = edges
    return out


def shoelace(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:], strict=False)) / 2


@pytest.fixture(scope="module")
def density(spark):
    size = 18
    rng = random.Random(6)
    hills = [(4, 4, 1.0), (13, 12, 0.9), (4.5, 13, 0.5), (17, 2, 0.8)]
    value = lambda x, y: sum(h * math.exp(-((x - a) ** 2 + (y - b) ** 2) / 5) for a, b, h in hills) + rng.random() * 0.05 - (0.6 if (x, y) == (4, 4) else 0)
    return spark.createDataFrame([(i, j, 10.0 * i, 10.0 * j, max(0.0, value(i, j))) for i in range(size) for j in range(size)], "gx int, gy int, x double, y double, density double").cache(), size


def test_contours_are_closed_rings(density):
    rows, size = density
    found = contours.rings(rows).collect()
    segments = contours.segments(rows).collect()
    want = plain_rings(rows.collect(), size)
    for share in contours.LEVELS:
        mine = [s for s in segments if s.share == share]
        assert {tuple(s.node) for s in mine} == want[share] and len(mine) == len(want[share])
        rings = [r for r in found if r.share == share and r.layer == "density"]
        assert sum(len(r.points) - 1 for r in rings) == len(mine)  # each segment in one ring
        step = {tuple(s.node): (tuple(s.next), (s.x, s.y)) for s in mine}
        for r in rings:
            assert r.points[0] == r.points[-1]
            node, walked = tuple(r.ring), []
            while not walked or node != tuple(r.ring):
                node, at = step[node]
                walked.append(at)
            assert [tuple(p) for p in r.points[:-1]] == walked
            assert math.isclose(r.area, shoelace([*walked, walked[0]]), rel_tol=1e-9, abs_tol=1e-9)
    areas = [r.area for r in found if r.layer == "density"]
    assert min(areas) < 0 < max(areas)  # the pit in a hill is a hole
    boundary = [r for r in found if r.layer == "boundary"]
    assert len(boundary) == 1 and boundary[0].area == max(r.area for r in found if r.share == 0.8 and r.layer == "density")


def test_flat_and_empty_densities(spark, density):
    rows, _ = density
    assert contours.rings(rows.withColumn("density", F.lit(0.0))).collect() == []
    assert contours.rings(rows.filter("false")).collect() == []
    flat = contours.rings(rows.withColumn("density", F.lit(1.0))).collect()
    assert len(flat) == 5 and all(r.points[0] == r.points[-1] for r in flat)

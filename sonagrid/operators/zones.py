"""Spatial analytics: heat grid, coverage, density, period comparison, hotspots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sonagrid.functions import geo
from sonagrid.functions.time import time_bucket
from sonagrid.operators import scan
from sonagrid.operators.clusters import density_clusters
from sonagrid.sources.shared import shared_folder


def grid(rows: DataFrame, precision: int = 6, weighted: bool = True) -> DataFrame:
    """Per geohash cell: count, weight (sum of confidence or count), mean confidence,
    distinct devices, first and last seen, heat (weight over the largest weight)."""
    weight = F.sum("confidence") if weighted else F.count("*").cast("double")
    cells = rows.withColumn("cell", geo.geohash("lat", "lon", precision)).groupBy("cell").agg(
        F.count("*").alias("cnt"), weight.alias("weight"), F.avg("confidence").alias("mean_confidence"), F.count_distinct("device_id").alias("devices"), F.min("window_start_ts").alias("first_seen"), F.max("window_start_ts").alias("last_seen")
    )
    top = cells.agg(F.max("weight").alias("top"))
    return cells.crossJoin(F.broadcast(top)).withColumn("heat", F.round(F.try_divide("weight", "top"), 4)).drop("top")  # top: one row


def _near_point(centre: Column, lat: Column, lon: Column, precision: int) -> tuple[Column, Column]:
    """The point of a cell that is taken for the distance to a device."""
    height, width = geo.cell_size_deg(precision)
    near_lat = F.least(F.greatest(lat, centre["lat"] - height / 2), centre["lat"] + height / 2)
    cos = F.greatest(F.cos(F.radians(near_lat)), F.lit(1e-6))
    near_lon = centre["lon"] + F.greatest(F.lit(-width / 2), F.least(F.lit(width / 2), (lon - centre["lon"]) / cos))
    return near_lat, near_lon


def covered_cells(cells: DataFrame, devices: DataFrame, radius_m: float, precision: int = 6) -> DataFrame:
    """Adds ``covered``: whether a located active device is within ``radius_m`` of the
    cell. Devices are filed under the cells around them, so the join is an equality."""
    height, width = geo.cell_size_deg(precision)
    d = devices.filter("is_active and lat is not null and lon is not null").select("lat", "lon").distinct()
    dlat = F.lit(radius_m / geo.DEGREE_M * 1.02)
    dlon = dlat / F.greatest(F.cos(F.radians("lat")), F.lit(0.01)) + width / 2
    steps = lambda lo, hi, low, size: F.sequence(F.floor((lo - low) / size), F.floor((hi - low) / size))
    around = d.withColumn("cy", F.explode(steps(F.col("lat") - dlat, F.col("lat") + dlat, -90, height))).withColumn("cx", F.explode(steps(F.col("lon") - dlon, F.col("lon") + dlon, -180, width)))
    centre = F.struct(((F.col("cy") + 0.5) * height - 90).alias("lat"), ((F.col("cx") + 0.5) * width - 180).alias("lon"))
    near = around.filter(geo.haversine("lat", "lon", *_near_point(centre, F.col("lat"), F.col("lon"), precision)) <= radius_m)
    near = near.withColumn("cell", geo.geohash(centre["lat"], centre["lon"], precision))
    return cells.join(near.select("cell", F.lit(True).alias("c")).distinct(), "cell", "left").withColumn("covered", F.coalesce("c", F.lit(False))).drop("c")


def coverage(devices: DataFrame, radius_m: float, precision: int = 6) -> DataFrame:
    """Located active devices with the ring of their range and the number of cells whose
    probed centre is within one and a half times the range."""
    height, width = geo.cell_size_deg(precision)
    d = devices.filter("is_active and lat is not null and lon is not null")
    span = lambda size, cos: F.greatest(F.lit(0), F.ceil(F.lit(radius_m) / (F.lit(geo.DEGREE_M) * cos) / size))
    cos = F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))
    middle = lambda c, low, size: (F.floor((F.col(c) - low) / size) + 0.5) * size + low
    base = d.withColumn("c", F.struct(middle("lat", -90, height).alias("lat"), middle("lon", -180, width).alias("lon")))
    offs = base.withColumn("i", F.explode(F.sequence(-span(height, F.lit(1.0)), span(height, F.lit(1.0))))).withColumn("j", F.explode(F.sequence(-span(width, cos), span(width, cos))))
    probe = offs.withColumn("plat", F.col("c.lat") + F.col("i") * height).withColumn("plon", F.col("c.lon") + F.col("j") * width)
    probe = probe.filter(geo.valid_coordinates("plat", "plon")).filter(geo.haversine("lat", "lon", "plat", "plon") <= radius_m * 1.5)
    counts = probe.select("device_id", geo.geohash("plat", "plon", precision).alias("cell")).distinct().groupBy("device_id").agg(F.count("*").alias("cells"))
    return d.join(counts, "device_id", "left").select("device_id", "lat", "lon", F.coalesce("cells", F.lit(0)).alias("cells"), geo.circle_ring("lat", "lon", radius_m).alias("ring"))


def covered_cell_set(devices: DataFrame, radius_m: float, precision: int = 6) -> DataFrame:
    """Distinct cells whose centre lies within one and a half times the range."""
    height, width = geo.cell_size_deg(precision)
    d = devices.filter("is_active and lat is not null and lon is not null")
    box = geo.bbox_around("lat", "lon", radius_m * 1.5)
    steps = lambda lo, hi, low, size: F.explode(F.sequence(F.floor((F.col(lo) - low) / size), F.floor((F.col(hi) - low) / size)))
    rows = d.withColumn("b", box).withColumn("cy", steps("b.min_lat", "b.max_lat", -90, height)).withColumn("cx", steps("b.min_lon", "b.max_lon", -180, width))
    lat, lon = (F.col("cy") + 0.5) * height - 90, (F.col("cx") + 0.5) * width - 180
    return rows.filter(geo.haversine("lat", "lon", lat, lon) <= radius_m * 1.5).select(geo.geohash(lat, lon, precision).alias("cell")).distinct()


def period_diff(a: DataFrame, b: DataFrame, active_devices: DataFrame, precision: int = 6, least: float = 1, normalize: bool = True) -> DataFrame:
    """Cells of two periods: counts, devices, delta and change. ``active_devices`` is one
    row with ``n``. Stable cells are kept here; ``changed`` drops them."""
    cells = lambda rows, x: rows.withColumn("cell", geo.geohash("lat", "lon", precision)).groupBy("cell").agg(F.count("*").alias(f"count_{x}"), F.count_distinct("device_id").alias(f"devices_{x}"))
    both = cells(a, "a").join(cells(b, "b"), "cell", "full_outer").fillna(0)
    n = F.greatest("n", F.lit(1)) if normalize else F.lit(1)
    rows = both.crossJoin(F.broadcast(active_devices))  # one row
    delta = F.col("count_b") / n - F.col("count_a") / n
    change = F.when((F.col("count_a") == 0) & (F.col("count_b") >= least), "appeared").when((F.col("count_b") == 0) & (F.col("count_a") >= least), "disappeared").when(delta >= least, "grew").when(delta <= -least, "shrunk").otherwise("stable")
    return rows.select("cell", "count_a", "count_b", "devices_a", "devices_b", F.round(delta, 4).alias("delta"), change.alias("change"))


def changed(diff: DataFrame) -> DataFrame:
    return diff.filter("change <> 'stable'")


def _plane(rows: DataFrame) -> DataFrame:
    """Metres east and north of the mean position, and weights that sum to 1 (all equal if
    the confidences are)."""
    origin = rows.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.sum("confidence").alias("total"), F.stddev_pop("confidence").alias("sd"), F.count("*").alias("n"))
    p = rows.crossJoin(F.broadcast(origin))  # one row
    w = F.when(F.col("sd") < 1e-9, 1.0 / F.col("n")).otherwise(F.col("confidence") / F.col("total"))
    return p.select("id", "window_start_ts", ((F.col("lon") - F.col("lon0")) * geo.DEGREE_M * F.cos(F.radians("lat0"))).alias("x"), ((F.col("lat") - F.col("lat0")) * geo.DEGREE_M).alias("y"), w.alias("w"), "lat0", "lon0")


def auto_bandwidth(rows: DataFrame, first: int = 200) -> DataFrame:
    """One row: half the upper median of the distances between consecutive points among
    the first ``first`` in time, within 150 and 2000 m; 300 for fewer than two points."""
    some = rows.orderBy("window_start_ts", "id").limit(first)
    order = Window.orderBy("window_start_ts", "id")  # at most ``first`` rows
    steps = some.withColumn("d", geo.haversine(F.lag("lat").over(order), F.lag("lon").over(order), "lat", "lon")).filter("d is not null")
    list_ = F.sort_array(F.collect_list("d"))
    return steps.agg(F.coalesce(F.least(F.greatest(F.try_element_at(list_, (F.size(list_) / 2).cast("int") + 1) / 2, F.lit(150.0)), F.lit(2000.0)), F.lit(300.0)).alias("bandwidth"))


def steps(rows: DataFrame) -> DataFrame:
    """Adds step_m, the distance to the device's place before, in the order of time."""
    place = F.struct("window_start_ts", "id", "lat", "lon")
    found = scan.running(rows, ["device_id"], ["window_start_ts", "id"], {"_before": ("max", place)})
    return found.withColumn("step_m", geo.haversine("_before.lat", "_before.lon", "lat", "lon")).drop("_before")


def spread(rows: DataFrame) -> DataFrame:
    """One row: the larger range of the points in metres; 100 for a single place."""
    p = _plane(rows)
    size = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return p.agg(F.when(size == 0, F.lit(100.0)).otherwise(size).alias("spread"))


#: Standard deviations within which a point counts at a node of the density grid.
KERNEL_REACH = 8.0


def kde(rows: DataFrame, bandwidth_m: float = 500.0, size: int = 64, fold_m: float | None = None) -> DataFrame:
    """Weighted Gaussian density on a ``size`` x ``size`` grid over the points: gx, gy, x,
    y, density.

    Rows are read once and summed by place; moments are taken of the places. Places are then
    summed in small squares (a fiftieth of the bandwidth, or ``fold_m``; ``fold_m=0`` keeps
    every place), and a square counts at the nodes within ``KERNEL_REACH`` standard deviations
    along both axes, so the work grows with the occupied squares and the nodes about them.
    What that leaves out is less than exp(-32), 1.3e-14, of the highest value that the
    density can have. Without a place, or with all places on one line, there is no density."""
    shared_folder(rows.sparkSession)
    fold = bandwidth_m / 50 if fold_m is None else fold_m
    places = rows.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(F.col("confidence") * F.col("confidence")).alias("c2")).checkpoint()
    whole = places.agg((F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("lat0"), (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("lon0"), F.sum("n").alias("many"), F.sum("c").alias("total"), F.sum("c2").alias("squares"))
    level = F.col("squares") / F.col("many") - F.pow(F.col("total") / F.col("many"), 2) < 1e-18  # all confidences are equal
    whole = whole.withColumn("w2", F.when(level, 1.0 / F.col("many")).otherwise(F.col("squares") / F.pow("total", F.lit(2)))).withColumn("level", level)
    p = places.crossJoin(F.broadcast(whole))  # one row
    p = p.select(((F.col("lon") - F.col("lon0")) * geo.DEGREE_M * F.cos(F.radians("lat0"))).alias("x"), ((F.col("lat") - F.col("lat0")) * geo.DEGREE_M).alias("y"), F.when(F.col("level"), F.col("n") / F.col("many")).otherwise(F.col("c") / F.col("total")).alias("w"), "w2")
    moments = p.agg(F.sum(F.col("w") * F.col("x")).alias("mx"), F.sum(F.col("w") * F.col("y")).alias("my"), F.max("w2").alias("w2"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    size_m = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    factor = F.pow(F.lit(bandwidth_m) / F.when(size_m == 0, F.lit(100.0)).otherwise(size_m), 2) / (1 - F.col("w2"))
    m = moments.filter("w2 < 1").select("*", ((F.col("xx") - F.col("mx") * F.col("mx")) * factor).alias("cxx"), ((F.col("yy") - F.col("my") * F.col("my")) * factor).alias("cyy"), ((F.col("xy") - F.col("mx") * F.col("my")) * factor).alias("cxy")).withColumn("det", F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")).filter("det > 0")
    m = m.select("cxx", "cyy", "cxy", "det", *[(F.col(f"{c}0") - bandwidth_m).alias(f"{c}_at") for c in "xy"], *[((F.col(f"{c}1") - F.col(f"{c}0") + 2 * bandwidth_m) / (size - 1)).alias(f"{c}_step") for c in "xy"]).checkpoint()
    if fold:
        p = p.groupBy(F.floor(F.col("x") / fold).alias("i"), F.floor(F.col("y") / fold).alias("j")).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))
    near = p.select("x", "y", "w").crossJoin(F.broadcast(m))  # one row
    for c in "xy":
        reach = KERNEL_REACH * F.sqrt(f"c{c}{c}")
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - reach - F.col(f"{c}_at")) / F.col(f"{c}_step"))).cast("int")
        last = F.least(F.lit(size - 1), F.floor((F.col(c) + reach - F.col(f"{c}_at")) / F.col(f"{c}_step"))).cast("int")
        # at most ``size`` nodes
        near = near.withColumn("lo", first).withColumn("hi", last).filter("lo <= hi").withColumn(f"g{c}", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    at = lambda c: F.col(f"{c}_at") + F.col(f"g{c}") * F.col(f"{c}_step")
    dx, dy = at("x") - F.col("x"), at("y") - F.col("y")
    form = (F.col("cyy") * dx * dx - 2 * F.col("cxy") * dx * dy + F.col("cxx") * dy * dy) / F.col("det")
    value = F.col("w") * F.exp(-0.5 * form) / (2 * 3.141592653589793 * F.sqrt("det"))
    found = near.select("gx", "gy", value.alias("density"))
    # every node of the grid, whose size is a parameter
    nodes = m.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    summed = found.unionByName(nodes.select("gx", "gy", F.lit(0.0).alias("density"))).groupBy("gx", "gy").agg(F.sum("density").alias("density"))
    return summed.crossJoin(F.broadcast(m)).select("gx", "gy", at("x").alias("x"), at("y").alias("y"), "density")


class _Near:
    """Places of one bucket by cells as wide as the reach. A place holds points until they are
    taken, and leaves its cell with the last of them."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, eps_m: float) -> None:
        self.eps_m, self.lat, self.lon = eps_m, np.radians(lat), np.radians(lon)
        reach = eps_m / geo.EARTH_M * 1.001
        self.row = np.floor(np.nan_to_num(self.lat) / max(reach, 1e-9)).astype(np.int64)
        # the greatest difference of longitudes within reach, at the latitude nearest to a pole
        cosine = np.cos(min(np.pi / 2, np.abs(np.nan_to_num(self.lat)).max(initial=0.0)))
        wide = np.arcsin(np.sin(reach) / cosine) if reach < np.pi / 2 and np.sin(reach) < cosine else 2 * np.pi
        self.columns = max(1, int(2 * np.pi / max(wide * 1.001, 1e-9)))
        self.column = np.floor((np.nan_to_num(self.lon) + np.pi) / (2 * np.pi) * self.columns).astype(np.int64) % self.columns
        self.cells: dict[tuple[int, int], np.ndarray] = {}
        order = np.lexsort((self.column, self.row))
        cuts = np.flatnonzero(np.diff(self.row[order]) | np.diff(self.column[order])) + 1
        for places in np.split(order, cuts) if len(order) else []:
            self.cells[self.row[places[0]], self.column[places[0]]] = places
        self.held = np.ones(len(lat), bool)

    def of(self, place: int) -> np.ndarray:
        """Places within reach that still hold points."""
        found = []
        for row in range(self.row[place] - 1, self.row[place] + 2):
            for column in {(self.column[place] + k) % self.columns for k in (-1, 0, 1)}:
                places = self.cells.get((row, column))
                if places is None:
                    continue
                held = self.held[places]
                if not held.all():
                    places = self.cells[row, column] = places[held]
                found.append(places)
        other = np.concatenate(found) if found else np.zeros(0, np.int64)
        a = np.sin((self.lat[other] - self.lat[place]) / 2) ** 2 + np.cos(self.lat[place]) * np.cos(self.lat[other]) * np.sin((self.lon[other] - self.lon[place]) / 2) ** 2
        return other[2 * geo.EARTH_M * np.arcsin(np.minimum(1, np.sqrt(a))) <= self.eps_m]


def _greedy(pdf: pd.DataFrame, eps_m: float, least: int) -> pd.DataFrame:
    """Order-dependent clusters of one bucket: seeds are taken from the latest; a seed
    with too few neighbours goes for good; only its first neighbours pass it on.

    Points of one place have the same neighbours, and all of them are taken at once but for
    seeds, so distances are taken between places: each place passes a cluster on once at most."""
    pdf = pdf.sort_values(["window_start_ts", "id"])
    spots, place = np.unique(pdf[["lat", "lon"]].to_numpy(), axis=0, return_inverse=True)
    place = place.reshape(-1)
    near = _Near(spots[:, 0], spots[:, 1], eps_m)
    many = np.bincount(place, minlength=len(spots))
    order = np.argsort(place, kind="stable")
    begins = np.cumsum(many) - many
    first = order[begins] if len(order) else order  # of the points that a place holds: seeds go from the end
    left, label, found = np.ones(len(pdf), bool), np.zeros(len(pdf), int), 0

    def take(places: np.ndarray, cluster: int) -> None:
        for p in places.tolist():
            points = order[begins[p] : begins[p] + many[p]]
            label[points], left[points] = cluster, False
        many[places], near.held[places] = 0, False

    for seed in range(len(pdf) - 1, -1, -1):
        if not left[seed]:
            continue
        left[seed] = False
        p = int(place[seed])
        many[p] -= 1
        near.held[p] = many[p] > 0
        around = near.of(p)
        if 1 + many[around].sum() < least:
            continue
        found += 1
        around = around[np.argsort(first[around])]
        take(around, found)
        label[seed] = found
        for k in [p, *around.tolist()]:
            fresh = near.of(k)
            if many[fresh].sum() >= least - 1:
                take(fresh, found)
    return pdf.assign(cluster=label)[lambda x: x["cluster"] > 0]


def hotspots(rows: DataFrame, eps_m: float = 500.0, least: int = 3, hours: int = 24, standard: bool = True) -> DataFrame:
    """Clusters of each species and time bucket: detections, mean confidence, centre,
    radius, first and last time. ``standard`` is density clustering by core points over
    joins; otherwise the order-dependent form, bucket by bucket."""
    p = rows.withColumn("bucket", time_bucket("window_start_ts", hours)).select("id", "species_slug", "bucket", "lat", "lon", "confidence", "window_start_ts")
    if standard:
        members = density_clusters(p, eps_m, least).join(p, ["id", "species_slug", "bucket"])
    else:
        members = p.groupBy("species_slug", "bucket").applyInPandas(lambda pdf: _greedy(pdf, eps_m, least), p.schema.simpleString()[7:-1].replace(":", " ") + ", cluster long")
    g = members.groupBy("species_slug", "bucket", "cluster").agg(F.count("*").alias("detections"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.min("window_start_ts").alias("period_from"), F.max("window_start_ts").alias("period_to"))
    return g.withColumn("radius_m", F.round(F.greatest(geo.haversine("a", "c", "b", "d"), F.lit(eps_m)) / 2, 1)).drop("a", "b", "c", "d")


def features(rows: DataFrame, geometry: Column, *properties: str) -> DataFrame:
    """GeoJSON features, one JSON text a row."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))

"""Density clusters of places, without pairs of points.

Places are filed in cells whose diagonal is at most the reach, so that all places of a cell
are near each other:

* a cell with enough points makes all of them core points, with no distance taken; the few
  places of any other cell are counted against the cells around them;
* core places of one cell are in one cluster, so clusters are components of cells. Two cells
  around each other are linked by the first pair of core places within reach: first one place
  of each small bin is tried, then the bins that could still hold a pair;
* a place that is not core belongs to the clusters of the cells around it that reach it.

What is joined are a cell's (or a bin's) places in lists of about ``LIST`` places, so that rows
grow with the cells and lists, whatever number of places lies in one spot. Distances between
two lists are taken in numpy, ``PAIRS`` at a time; the joins before that keep their number of
tasks, as these rows are few bytes but much work."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sonagrid.functions import geo
from sonagrid.sources.shared import shared_folder

KEYS = ("species_slug", "bucket")
#: Places in a list, about.
LIST = 256
#: Pairs of places whose distances are taken at once.
PAIRS = 1 << 18
#: Bins along a side of a cell.
BINS = 16
_CELL = [*KEYS, "cy", "cx"]


class Grid:
    """Cells whose diagonal is at most ``reach_m``. Rows have one height; a row's cells have
    the width that fits at its end towards the equator."""

    def __init__(self, reach_m: float) -> None:
        degree = pi / 180 * geo.EARTH_M
        self.reach_m, self.degree = reach_m, degree
        # a little less than reach / sqrt(2), against rounding
        self.height = min(reach_m / sqrt(2) / degree * 0.999, 45.0)

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.height).cast("long")

    def width(self, row: Column) -> Column:
        low = row * self.height - 90
        nearest = F.when((low <= 0) & (low + self.height >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + self.height)))
        return F.least(F.lit(self.height) / F.greatest(F.cos(F.radians(nearest)), F.lit(1e-9)), F.lit(360.0))

    def column(self, lon: Column, row: Column) -> Column:
        return F.floor((lon + 180) / self.width(row)).cast("long")

    def around(self, rows: DataFrame, low: str = "lat", high: str = "lat", left: str = "lon", right: str = "lon") -> DataFrame:
        """``rows`` with ky, kx: every cell that may hold a place within reach of the box. It
        goes on across the line where longitudes jump."""
        reach = F.lit(self.reach_m / self.degree * 1.001)
        rows = rows.withColumn("ky", F.explode(F.sequence(self.row(F.col(low) - reach), self.row(F.col(high) + reach))))
        farthest = F.greatest(F.abs(F.col(low) - reach), F.abs(F.col(high) + reach))
        # the greatest difference of longitudes within reach, for all latitudes of the box
        sine = F.sin(F.radians(reach)) / F.greatest(F.cos(F.radians(F.least(farthest, F.lit(90.0)))), F.lit(1e-12))
        wide = F.when(sine < 1, F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * 1.001).otherwise(F.lit(360.0))
        a, b = F.col(left) - wide, F.col(right) + wide
        span = lambda lo, hi: F.sequence(self.column(lo, F.col("ky")), self.column(hi, F.col("ky")))
        none = F.array().cast("array<bigint>")
        west, east = F.lit(-180.0), F.lit(180.0)
        found = F.concat(span(F.greatest(a, west), F.least(b, east)), F.when(a < west, span(F.greatest(a + 360, west), east)).otherwise(none), F.when(b > east, span(west, F.least(b - 360, east))).otherwise(none))
        return rows.withColumn("kx", F.explode(F.array_distinct(found)))


def _fields(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields end to end) of a column of lists of structs without nulls."""
    flat = column.flatten()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64))), {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def _crossed(batch: pa.RecordBatch, one: str, two: str, reach_m: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in ``one``, place in ``two``) of the pairs within reach in each row's two
    lists of places; places are numbered end to end."""
    (at1, p), (at2, q) = _fields(batch.column(one)), _fields(batch.column(two))
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (p["lat"], p["lon"], q["lat"], q["lon"]))
    width = np.diff(at2)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(at1) * width)))
    for lo in range(0, int(before[-1]), PAIRS):
        pair = np.arange(lo, min(lo + PAIRS, int(before[-1])))
        row = np.searchsorted(before, pair, side="right") - 1
        i, j = np.divmod(pair - before[row], width[row])
        i, j = i + at1[row], j + at2[row]
        a = np.sin((lat2[j] - lat1[i]) / 2) ** 2 + np.cos(lat1[i]) * np.cos(lat2[j]) * np.sin((lon2[j] - lon1[i]) / 2) ** 2
        near = 2 * geo.EARTH_M * np.arcsin(np.minimum(1, np.sqrt(a))) <= reach_m
        yield row[near], i[near], j[near]


def _with(rows: DataFrame, kept: list[str], name: str, kind: T.DataType, of) -> DataFrame:
    """``kept`` and a column that ``of`` makes of a batch."""
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(of(batch))], schema.names)

    return rows.mapInArrow(run, schema)


def _meet(rows: DataFrame, one: str, two: str, reach_m: float, kept: list[str]) -> DataFrame:
    """``kept`` and linked, whether a place of one list is within reach of one of the other."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        linked = np.zeros(batch.num_rows, bool)
        for row, _, _ in _crossed(batch, one, two, reach_m):
            linked[row] = True
        return linked

    return _with(rows, kept, "linked", T.BooleanType(), of)


def _points(rows: DataFrame, one: str, two: str, reach_m: float, kept: list[str]) -> DataFrame:
    """``kept`` and m, the points (n) of the places in ``two`` that the place in ``one`` reaches."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        n, m = _fields(batch.column(two))[1]["n"], np.zeros(batch.num_rows, np.int64)
        for row, _, j in _crossed(batch, one, two, reach_m):
            np.add.at(m, row, n[j])
        return m

    return _with(rows, kept, "m", T.LongType(), of)


def _bins(rows: DataFrame, one: str, two: str, reach_m: float, kept: list[str]) -> DataFrame:
    """``kept`` with by, bx, qy, qx: the bins of the places within reach, a row for each pair."""
    names = ("by", "bx", "qy", "qx")
    schema = T.StructType([*rows.select(*kept).schema.fields, *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = _fields(batch.column(one))[1], _fields(batch.column(two))[1]
            for row, i, j in _crossed(batch, one, two, reach_m):
                found = batch.select(kept).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*found.columns, *[pa.array(x) for x in (p["by"][i], p["bx"][i], q["by"][j], q["bx"][j])]], schema.names)

    return rows.mapInArrow(run, schema)


def _lists(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """The places of each key in lists of about ``LIST``."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_many"))
    dealt = rows.join(sizes, keys).withColumn("_list", F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("_many") / LIST)))
    return dealt.groupBy(*keys, "_list").agg(F.collect_list(place).alias("places")).drop("_list")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): the smallest node that the links (a, b) reach. Large-star and small-star
    steps in turn hang each node's neighbours under the smallest of them, so the rounds grow
    with the logarithm of the longest path.

    Rounds are written as files: after a checkpoint Spark still multiplies the sizes that it
    estimated for the joins before, numbers whose digits double with every round."""
    spark = links.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def written(rows: DataFrame, k: int) -> DataFrame:
        rows.filter("a <> b").distinct().write.parquet(f"{folder}/{k}")
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
        return spark.read.schema("a long, b long").parquet(f"{folder}/{k}")

    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), 0)
    state = None
    for k in count(1):
        before, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least), k)
    roots = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    label = nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster")).checkpoint()
    files.delete(path, True)
    return label


def density_clusters(points: DataFrame, eps_m: float, least: int) -> DataFrame:
    """id, species_slug, bucket, cluster: core points (at least ``least`` points within
    reach, with themselves) that reach each other, and the points that they reach. The
    cluster is named after its smallest core id; a point that several clusters reach goes to
    the smallest. Points of one place are one weighted place throughout. Points without a
    place are left out."""
    shared_folder(points.sparkSession)
    grid, keys = Grid(eps_m), list(KEYS)
    located = points.filter(geo.valid_coordinates("lat", "lon"))
    places = located.groupBy(*keys, "lat", "lon").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    places = places.withColumn("cy", grid.row(F.col("lat"))).withColumn("cx", grid.column(F.col("lon"), F.col("cy"))).checkpoint()
    full = places.groupBy(*_CELL).agg(F.sum("n").alias("points"))
    places = places.join(full, _CELL).withColumn("dense", F.col("points") >= least).drop("points").checkpoint()

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = [*keys, "ky", "kx"]

    # at most least - 1 places of a cell that is not dense, against the lists around it
    sparse = grid.around(places.filter("not dense").select(*keys, "id", "lat", "lon")).withColumn("here", F.array(F.struct("lat", "lon"))).repartition(parts, *around)
    lists = _lists(places, _CELL, F.struct("lat", "lon", "n")).withColumnsRenamed({"cy": "ky", "cx": "kx"})
    counted = _points(sparse.join(lists, around), "here", "places", eps_m, [*keys, "id"]).groupBy(*keys, "id").agg(F.sum("m").alias("m"))
    few = counted.filter(F.col("m") >= least).select(*keys, "id")
    core = places.filter("dense").unionByName(places.filter("not dense").join(few, [*keys, "id"], "left_semi")).drop("dense")
    size = grid.height / BINS
    core = core.withColumn("by", F.floor(F.col("lat") / size)).withColumn("bx", F.floor(F.col("lon") / (grid.width(F.col("cy")) / BINS))).checkpoint()

    cells = core.groupBy(*_CELL).agg(F.min("id").alias("cell"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1")).checkpoint()
    bins = core.groupBy(*_CELL, "by", "bx").agg(F.min(F.struct("lat", "lon")).alias("p"))
    # one place of each bin: a number that does not grow with the places
    first = bins.groupBy(*_CELL).agg(F.collect_list(F.struct("p.lat", "p.lon", "by", "bx")).alias("tried"))
    first = first.join(cells, _CELL).checkpoint()
    other = first.select(*keys, F.col("cy").alias("ky"), F.col("cx").alias("kx"), F.col("cell").alias("b"), F.col("tried").alias("others"))
    beside = grid.around(first.withColumnRenamed("cell", "a"), "lat0", "lat1", "lon0", "lon1").repartition(parts, *around).join(other, around).filter("a < b")
    beside = _meet(beside, "tried", "others", eps_m, [*_CELL, "ky", "kx", "a", "b"]).checkpoint()
    links = beside.filter("linked").select("a", "b")
    nodes = cells.select(F.col("cell").alias("id"))
    label = components(nodes, links)

    # cells that are still apart, where two bins could hold a pair within reach
    slack = eps_m + 2 * eps_m / BINS * 1.01
    named = lambda end: label.select(F.col("id").alias(end), F.col("cluster").alias(f"of_{end}"))
    apart = beside.filter("not linked").join(named("a"), "a").join(named("b"), "b").filter("of_a <> of_b")
    tried = lambda end, name: first.select(F.col("cell").alias(end), F.col("tried").alias(name))
    apart = apart.join(tried("b", "others"), "b").repartition(parts, "a").join(tried("a", "tried"), "a")
    asked = _bins(apart, "tried", "others", slack, [*_CELL, "ky", "kx", "a", "b"]).checkpoint()
    if not asked.isEmpty():
        lists = _lists(core, [*_CELL, "by", "bx"], F.struct("lat", "lon"))
        others = lists.withColumnsRenamed({"cy": "ky", "cx": "kx", "by": "qy", "bx": "qx", "places": "others"})
        both = asked.join(lists, [*_CELL, "by", "bx"]).repartition(parts, *around, "qy", "qx").join(others, [*around, "qy", "qx"])
        more = _meet(both, "places", "others", eps_m, ["a", "b"]).filter("linked").select("a", "b").distinct()
        label = components(nodes, links.union(more))

    of_cell = cells.select(*_CELL, F.col("cell").alias("id")).join(label, "id").drop("id")
    inner = core.join(of_cell, _CELL).select(*keys, "lat", "lon", "cluster")
    lists = _lists(core, _CELL, F.struct("lat", "lon")).join(of_cell, _CELL).withColumnsRenamed({"cy": "ky", "cx": "kx"})
    loose = sparse.join(few, [*keys, "id"], "left_anti").repartition(parts, *around).join(lists, around)
    loose = _meet(loose, "here", "places", eps_m, [*keys, "lat", "lon", "cluster"]).filter("linked")
    found = inner.unionByName(loose.groupBy(*keys, "lat", "lon").agg(F.min("cluster").alias("cluster")))
    return located.select(*keys, "id", "lat", "lon").join(found, [*keys, "lat", "lon"]).select(*keys, "id", "cluster")

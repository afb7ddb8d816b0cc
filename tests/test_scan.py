"""Running aggregates by ranges and the sweep over open spans, against windows and plain loops."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from sonagrid.operators import dataset, ingest, joins, scan

T0 = datetime(2024, 5, 1)


def rows_of(spark, many=3000, hot=1000):
    rng = random.Random(8)
    data = [(k, None if k % 97 == 0 else "hot" if k < hot else f"d{rng.randrange(40)}", rng.randrange(500), rng.randrange(1000)) for k in range(many)]
    return spark.createDataFrame(data, "id long, device_id string, at int, value int").repartition(5)


def answer(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("heavy", [0, 500, 10**9])
@pytest.mark.parametrize("keys", [["device_id"], []])
def test_running_equals_a_window(spark, monkeypatch, heavy, keys):
    monkeypatch.setattr(scan, "HEAVY_ROWS", heavy)
    rows = rows_of(spark)
    values = {"n": ("count", F.col("value")), "total": ("sum", F.col("value")), "top": ("max", F.struct("value", "id")), "low": ("min", F.col("value"))}
    got = scan.running(rows, keys, ["at", "id"], values)
    w = Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("*", F.count("value").over(w).alias("n"), F.coalesce(F.sum("value").over(w), F.lit(0)).alias("total"), F.max(F.struct("value", "id")).over(w).alias("top"), F.min("value").over(w).alias("low"))
    assert answer(got) == answer(want)


def test_a_hot_key_fills_no_task(spark, monkeypatch):
    """One device with a third of the rows: the largest task of the scan is under twice the
    mean."""
    monkeypatch.setattr(scan, "HEAVY_ROWS", 2000)
    rows = rows_of(spark, 12_000, 4000)
    sizes = []
    checkpoint = type(rows).checkpoint

    def counted(self, *args):
        out = checkpoint(self, *args)
        if "_part" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    monkeypatch.setattr(type(rows), "checkpoint", counted)
    assert scan.running(rows, ["device_id"], ["at", "id"], {"n": ("count", F.lit(1))}).count() == 12_000
    assert len(sizes) >= 3 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_pages_of_a_large_table(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"{'Ab'[k % 2]}{k * 7 % 101:03d}") for k in range(101)], "id long, ru string")
    want = [r.id for r in rows.orderBy(F.lower("ru"), "ru").collect()]
    for heavy in (10, 10**6):
        monkeypatch.setattr(scan, "HEAVY_ROWS", heavy)
        for number, at in ((0, 0), (3, 3), (16, 16), (99, 16), (-2, 0)):
            assert sorted(r.id for r in dataset.page(rows, number).collect()) == sorted(want[6 * at : 6 * at + 6])


def spans(spark, data):
    """(id, device, start, length) in seconds"""
    rows = [(i, d, "s", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + n)) for i, d, s, n in data]
    return spark.createDataFrame(rows, "id long, device_id string, species_slug string, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz")


def plain(data, absorbing):
    out, kept = {}, {}
    for i, d, s, n in sorted(data, key=lambda x: (x[2], x[0])):
        of = None
        for j, s0, e0 in kept.setdefault(d, []):
            shared, shorter = min(s + n, e0) - max(s, s0), min(n, e0 - s0)
            if (e0 > s or absorbing and e0 == s) and (max(0, shared) / shorter >= 0.5 if shorter > 0 else shared >= 0):
                of = j
                break
        out[i] = of
        if of is None or not absorbing:
            kept[d].append((i, s, s + n))
    return out


@pytest.mark.parametrize("heavy", [50, 10**6])
def test_sweep_equals_a_plain_fold(spark, monkeypatch, heavy):
    monkeypatch.setattr(scan, "HEAVY_ROWS", heavy)
    rng = random.Random(3)
    data = [(k, rng.choice("aab"), rng.randrange(600), rng.choice((0, 0, 1, 4, 10, 30))) for k in range(400)]
    rows = spans(spark, data)
    assert {r.id: r.duplicate_of_id for r in ingest.mark_duplicates(rows).collect()} == plain(data, True)
    assert {r.id: r.of_id for r in joins.first_overlap(rows).collect()} == {i: of for i, of in plain(data, False).items() if of is not None}
    pairs = joins.overlapping_pairs(rows).filter("fraction >= 0.5").join(rows.select(F.col("id").alias("of_id"), F.col("window_start_ts").alias("t")), "of_id")
    first = pairs.groupBy("id").agg(F.min_by("of_id", F.struct("t", "of_id")).alias("of_id"))
    assert answer(joins.first_overlap(rows).select("id", "of_id")) == answer(first.select("id", "of_id"))


def test_a_device_without_a_pause(spark):
    """A run of 100 000 overlapping spans takes time in proportion to it."""
    took = {}
    for many in (20_000, 100_000):
        rows = spark.range(many).select("id", F.lit("d").alias("device_id"), F.lit("s").alias("species_slug"), F.timestamp_seconds(F.col("id") * 4).cast("timestamp_ntz").alias("window_start_ts"), F.timestamp_seconds(F.col("id") * 4 + 10).cast("timestamp_ntz").alias("window_end_ts"))
        began = time.perf_counter()
        found = ingest.mark_duplicates(rows).groupBy().agg(F.count("*").alias("n"), F.count("duplicate_of_id").alias("d")).first()
        took[many] = time.perf_counter() - began
        # of spans of 10 seconds every 4, each second one is a duplicate
        assert found.n == many and found.d == many // 2
    assert took[100_000] < 12 * took[20_000] + 5

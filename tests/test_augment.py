"""Seeded augmentation, pairing and weighted draws."""

from __future__ import annotations

from collections import Counter
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import augment, dataset, scan


@pytest.fixture(scope="module")
def waves(spark):
    t = np.arange(512)
    rows = [(k, [float(v) for v in 0.3 * np.sin(2 * np.pi * (20 + k % 5) * t / 512)]) for k in range(60)]
    return spark.createDataFrame([*rows, (100, None), (101, [])], "id long, samples array<double>").cache()


def test_waveforms_say_what_was_done(waves):
    found = {r.id: r for r in augment.waveforms(waves, "id", seed=3).collect()}
    before = {r.id: r.samples for r in waves.collect()}
    assert found[100].samples is None and found[101].samples == [] and len(found) == 62
    kinds = Counter()
    for k in range(60):
        r, x = found[k], np.array(before[k])
        y = np.array(r.samples)
        assert len(y) == len(x)
        done = [c for c in ("gain_db", "shift", "steps", "snr_db") if r[c] is not None]
        kinds.update(done)
        if not done:
            assert np.allclose(x, y, atol=1e-6)
        if done == ["gain_db"]:
            assert np.isclose(20 * np.log10(np.std(y) / np.std(x)), r.gain_db, atol=1e-3)
        if done == ["shift"]:
            assert np.allclose(np.roll(x, r.shift), y, atol=1e-6)
        if done == ["snr_db"]:
            assert abs(10 * np.log10(np.mean(x**2) / np.mean((y - x) ** 2)) - r.snr_db) < 0.5
        if "steps" in done and "snr_db" not in done:
            peak = lambda v: np.abs(np.fft.rfft(v, 8192)).argmax()
            assert abs(peak(y) / peak(x) - 2 ** (r.steps / 12)) < 0.03
    assert all(10 <= kinds[c] <= 45 for c in ("gain_db", "shift", "steps", "snr_db"))


def test_same_values_for_any_partitioning(waves):
    one = augment.waveforms(waves.coalesce(1), "id", seed=3)
    assert sorted(map(str, one.collect())) == sorted(map(str, augment.waveforms(waves.repartition(7), "id", seed=3).collect()))
    assert sorted(map(str, one.collect())) != sorted(map(str, augment.waveforms(waves, "id", seed=4).collect()))


def test_masks_are_runs_of_bands_and_frames(spark):
    rows = spark.createDataFrame([(k, [1.0] * 800) for k in range(40)] + [(90, None)], "id long, mel array<double>")
    for r in augment.masked(rows, "id", 20, seed=1).collect():
        if r.mel is None:
            assert r.id == 90
            continue
        x = np.array(r.mel).reshape(20, 40)
        frames, bands = (x == 0).all(axis=0), (x == 0).all(axis=1)
        assert 1 <= frames.sum() <= 2 * 6 and 1 <= bands.sum() <= 2 * 3
        assert np.array_equal(x == 0, frames[None, :] | bands[:, None])
        assert all(np.diff(np.flatnonzero(np.diff(np.concatenate(([0], m.astype(int), [0]))) != 0)).size <= 3 for m in (frames, bands))


@pytest.mark.parametrize("heavy", [100, 10**6])
def test_every_row_is_a_partner_once(spark, monkeypatch, heavy):
    monkeypatch.setattr(scan, "HEAVY_ROWS", heavy)
    rows = spark.range(0, 2000, 2).withColumnRenamed("id", "k")
    for seed in (0, 1, 5):
        found = [(r.k, r.other) for r in augment.partners(rows, "k", seed).collect()]
        assert sorted(k for k, _ in found) == sorted(o for _, o in found) == list(range(0, 2000, 2))
        assert sum(k == o for k, o in found) <= 2
    assert augment.partners(rows.limit(1), "k").collect()[0].other == 0 and augment.partners(rows.filter("false"), "k").collect() == []


def test_mixed_rows_stay_between_their_two(spark):
    rows = spark.createDataFrame([(k, [float(k), 2.0 * k], k % 3) for k in range(50)], "id long, v array<double>, y long")
    for r in augment.mixed(rows, "id", "v", "y", seed=2).collect():
        assert 0 <= r.share <= 1 and (r.label_a, r.label_b) == (r.id % 3, r.other % 3)
        assert np.allclose(r.values, [r.share * r.id + (1 - r.share) * r.other, 2 * (r.share * r.id + (1 - r.share) * r.other)])


@pytest.mark.parametrize("heavy", [100, 10**6])
def test_weighted_draws(spark, monkeypatch, heavy):
    monkeypatch.setattr(scan, "HEAVY_ROWS", heavy)
    rows = [(k, "abc"[0 if k < 300 else 1 if k < 320 else 2]) for k in range(321)]
    files = dataset.sampling_weights(spark.createDataFrame(rows, "id long, class string"))
    many = 9000
    found = augment.drawn(files.repartition(5), "id", F.col("weight"), many, seed=1).collect()
    assert sorted(r.draw for r in found) == list(range(many))
    shares = Counter("abc"[0 if r.id < 300 else 1 if r.id < 320 else 2] for r in found)
    assert all(abs(shares[c] - many / 3) < 3 * sqrt(many * 2 / 9) for c in "abc")
    # each draw against a plain search, and another partitioning
    again = {r.draw: r.id for r in augment.drawn(files.coalesce(1), "id", F.col("weight"), many, seed=1).collect()}
    assert again == {r.draw: r.id for r in found}
    none = augment.drawn(files, "id", F.when(F.col("class") == "c", 1.0).otherwise(0.0), 10).collect()
    assert [r.id for r in none] == [320] * 10
    assert augment.drawn(files.filter("false"), "id", F.col("weight"), 10).collect() == []

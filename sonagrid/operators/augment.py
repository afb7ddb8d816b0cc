"""Seeded augmentation of waveforms and spectrograms, and pairing of rows.

Every random number comes from a counter-based generator whose key is the seed and the key of
the row, so that a task that runs again, or another partitioning, gives the same values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sonagrid.operators import scan

#: Shares of rows that a step changes, and the range of each step.
GAIN_SHARE, SHIFT_SHARE, PITCH_SHARE, NOISE_SHARE = 0.5, 0.5, 0.4, 0.5
GAIN_DB, SHIFT_PART, PITCH_STEPS, SNR_DB = 6.0, 0.4, 1.5, (5.0, 20.0)
#: Masks of each kind, the largest part that one covers, the shape of mixing.
MASKS, MASK_PART, MIX_ALPHA = 2, 0.15, 0.2
#: Multipliers of the permutation: primes, of which one at least divides no number of rows
#: below their product.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039)


def numbers(seed: int, key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([seed, key], np.int64).view(np.uint64)))


def pitched(x: np.ndarray, steps: float) -> np.ndarray:
    """Resampled so that it sounds ``steps`` half-tones higher: the middle of what is longer
    then, or zeros after what is shorter."""
    many = len(x)
    size = max(1, int(many / 2 ** (steps / 12)))
    out = np.interp(np.linspace(0, many - 1, size), np.arange(many), x)
    return out[(size - many) // 2 :][:many] if size >= many else np.pad(out, (0, many - size))


def noisy(x: np.ndarray, snr_db: float, noise: np.ndarray) -> np.ndarray:
    """With ``noise`` at a ratio of powers; silence counts as a power of 1e-9."""
    power = max(float(np.mean(x**2)), 1e-9) / 10 ** (snr_db / 10)
    return np.clip(x + noise * np.sqrt(power / max(float(np.mean(noise**2)), 1e-12)), -1, 1)


def _changed(x: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, list]:
    """Always takes the same numbers in the same order, whichever steps apply."""
    chance = draw.random(4)
    gain, part, steps, snr = draw.uniform(-GAIN_DB, GAIN_DB), draw.uniform(-SHIFT_PART, SHIFT_PART), draw.uniform(-PITCH_STEPS, PITCH_STEPS), draw.uniform(*SNR_DB)
    done: list = [None] * 4
    if not len(x):
        return x, done
    if chance[0] < GAIN_SHARE:
        x, done[0] = np.clip(x * 10 ** (gain / 20), -1, 1), gain
    if chance[1] < SHIFT_SHARE:
        by = int(len(x) * part)
        x, done[1] = np.roll(x, by), by
    if chance[2] < PITCH_SHARE:
        x, done[2] = pitched(x, steps), steps
    if chance[3] < NOISE_SHARE:
        x, done[3] = noisy(x, snr, draw.normal(size=len(x))), snr
    return x, done


def waveforms(rows: DataFrame, key: str, samples: str = "samples", seed: int = 0) -> DataFrame:
    """key, samples (of the length they had, within -1 and 1 where a step is applied that
    clips) and what was done: gain_db, shift (samples to the right, round the end), steps
    (half-tones), snr_db; null where a step was left out. A null waveform stays null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(None, [None] * 4) if x is None else _changed(np.asarray(x, np.float64), numbers(seed, int(k))) for k, x in zip(frame["key"], frame["samples"], strict=True)]
            columns = list(zip(*(d for _, d in found), strict=True)) or [[]] * 4
            yield pd.DataFrame({key: frame["key"], "samples": [x for x, _ in found], "gain_db": pd.array(columns[0], "Float64"), "shift": pd.array(columns[1], "Int64"), "steps": pd.array(columns[2], "Float64"), "snr_db": pd.array(columns[3], "Float64")})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(samples).cast("array<double>").alias("samples")).mapInPandas(run, f"{key} long, samples array<float>, gain_db double, shift long, steps double, snr_db double")


def masks(draw: np.random.Generator, size: int) -> list[tuple[int, int]]:
    """(begin, width) of ``MASKS`` masks, each of 1 to ``MASK_PART`` of ``size``."""
    out = []
    for _ in range(MASKS):
        width = int(draw.integers(1, max(1, int(size * MASK_PART)) + 1))
        out.append((int(draw.integers(0, max(0, size - width) + 1)), width))
    return out


def masked(rows: DataFrame, key: str, bands: int, mel: str = "mel", seed: int = 0) -> DataFrame:
    """key and mel, a spectrogram of ``bands`` rows of frames laid end to end, with runs of
    frames and of bands set to 0. A null one stays null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, values in zip(frame["key"], frame["mel"], strict=True):
                if values is not None and len(values):
                    x, draw = np.array(values, np.float32).reshape(bands, -1), numbers(seed, int(k))
                    for at, n in masks(draw, x.shape[1]):
                        x[:, at : at + n] = 0
                    for at, n in masks(draw, bands):
                        x[at : at + n] = 0
                    values = x.ravel()
                out.append(values)
            yield pd.DataFrame({key: frame["key"], "mel": out})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(mel).cast("array<float>").alias("mel")).mapInPandas(run, f"{key} long, mel array<float>")


def partners(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """key, other: each row with another one, so that every row is the other of exactly one.

    Rows are ranked by ``key``, which names each; rank r meets rank (a r + b) mod n, where a is
    a prime that does not divide n. So nothing is sorted by random numbers, and no row has to
    know where the others lie. A row may meet itself."""
    ranked = scan.running(rows.select(key), [], [key], {"rank": ("count", F.lit(1))})
    n = rows.agg(F.count("*").alias("n"))
    turned = PRIMES[seed % len(PRIMES) :] + PRIMES[: seed % len(PRIMES)]
    a = reduce(lambda rest, p: F.when(F.col("n") % p != 0, F.lit(p)).otherwise(rest), reversed(turned), F.lit(1)).cast("long")
    meets = ranked.crossJoin(F.broadcast(n)).select(key, F.pmod(a * F.col("rank") + seed * 7919, "n").alias("rank"))  # n: one row
    return meets.join(ranked.withColumnRenamed(key, "other"), "rank").drop("rank")


def mixed(rows: DataFrame, key: str, values: str, label: str, seed: int = 0, alpha: float = MIX_ALPHA) -> DataFrame:
    """key, other, share, values, label_a, label_b: each row's array mixed with that of its
    partner, ``share`` of its own and the rest of the other; labels go by the same shares.
    Arrays of two lengths are mixed as far as both go."""

    @F.pandas_udf("double")
    def drawn(keys: pd.Series) -> pd.Series:
        return pd.Series([numbers(seed, int(k)).beta(alpha, alpha) if alpha > 0 else 1.0 for k in keys], dtype="float64")

    pairs = partners(rows, key, seed).withColumn("share", drawn(F.col(key).cast("long")))
    one = rows.select(key, F.col(values).alias("_a"), F.col(label).alias("label_a"))
    two = rows.select(F.col(key).alias("other"), F.col(values).alias("_b"), F.col(label).alias("label_b"))
    both = pairs.join(one, key).join(two, "other")
    size = F.least(F.size("_a"), F.size("_b"))
    mix = F.zip_with(F.slice("_a", F.lit(1), size), F.slice("_b", F.lit(1), size), lambda x, y: F.col("share") * x + (1 - F.col("share")) * y)
    return both.select(key, "other", "share", mix.alias("values"), "label_a", "label_b")


def drawn(rows: DataFrame, key: str, weight: Column, many: int, seed: int = 0) -> DataFrame:
    """draw (from 0), key: ``many`` rows drawn with replacement, each with a probability in
    proportion to its weight. Rows with no weight are never drawn.

    Weights become whole numbers (parts of 2**60), so that their running sum by ``key`` does
    not depend on how rows are dealt. A draw is a place below the whole sum; rows and draws are
    put in one order of places, and a draw takes the row that begins last before it. ``key``
    names each row."""
    weighed = rows.select(F.col(key).alias("key"), weight.cast("decimal(38,18)").alias("w")).filter("w > 0")
    total = weighed.agg(F.sum("w").cast("double").alias("total"))
    parts = weighed.crossJoin(F.broadcast(total)).select("key", F.floor(F.col("w").cast("double") / F.col("total") * float(1 << 60)).cast("long").alias("part")).filter("part > 0")  # total: one row
    whole = parts.agg(F.sum("part").alias("whole"))
    placed = scan.running(parts, [], ["key"], {"place": ("sum", F.col("part"))})
    spark = rows.sparkSession
    draws = spark.range(many).crossJoin(F.broadcast(whole)).filter("whole > 0").select(F.lit(1).alias("kind"), F.pmod(F.xxhash64(F.lit(seed), "id"), "whole").alias("place"), "id")  # whole: one row
    none = dict(parts.dtypes)["key"]
    line = placed.select(F.lit(0).alias("kind"), F.col("place").cast("long").alias("place"), F.lit(0).cast("long").alias("id"), "key").unionByName(draws.withColumn("key", F.lit(None).cast(none)))
    held = F.when(F.col("kind") == 0, F.struct("place", "key"))
    found = scan.running(line, [], ["place", "kind", "id"], {"at": ("max", held)})
    return found.filter("kind = 1").select(F.col("id").alias("draw"), F.col("at.key").alias(key))

"""File and text sources: registries, dataset folders, manifests, audio, REST results."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def registry_from_json(text: DataFrame, column: str = "value") -> DataFrame:
    """A registry in the form {slug: {ru, habitat}} as rows."""
    parsed = F.from_json(column, "map<string, struct<ru: string, habitat: string>>")
    return text.select(F.explode(parsed).alias("slug", "r")).select("slug", "r.ru", "r.habitat")


def registry_file(spark: SparkSession, path: str) -> DataFrame:
    return registry_from_json(spark.read.text(path, wholetext=True))


def classes_from_json(text: DataFrame, column: str = "value") -> DataFrame:
    """A list of classes with their places."""
    return text.select(F.posexplode(F.from_json(column, "array<string>")).alias("class_idx", "slug"))


def dataset_folder(spark: SparkSession, path: str, suffix: str = "wav") -> DataFrame:
    """Files below class folders: path, class, file, length."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sniff_format(content: str | Column) -> Column:
    """Audio format by the first bytes: wav, flac, ogg, mp3, m4a or unknown."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.substring(c, 1, 4)
    is_ = lambda text: head == F.lit(text.encode())
    return (
        F.when(is_("RIFF") & (F.substring(c, 9, 4) == F.lit(b"WAVE")), "wav").when(is_("fLaC"), "flac").when(is_("OggS"), "ogg")
        .when((F.substring(c, 1, 3) == F.lit(b"ID3")) | F.hex(F.substring(c, 1, 2)).isin("FFFB", "FFF3", "FFF2"), "mp3")
        .when(F.substring(c, 5, 4) == F.lit(b"ftyp"), "m4a").otherwise("unknown")
    )


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(samples):
        return samples.astype(np.float32)
    n = max(1, round(len(samples) * to / rate))
    return np.interp(np.linspace(0, len(samples) - 1, n), np.arange(len(samples)), samples).astype(np.float32)


def decode_wav(content: bytes, rate: int = 32_000) -> np.ndarray:
    """Mono float samples of a PCM WAV file of 8 to 32 bits at ``rate``; the mean of its
    channels. Raises ValueError for a file that cannot be read."""
    try:
        with wave.open(io.BytesIO(content), "rb") as f:
            width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError("damaged") from e
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:  # as the upper bytes of 32-bit numbers
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").reshape(-1).astype(np.float32) / (1 << 31)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return resample(x.reshape(-1, channels).mean(axis=1), own, rate)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def decoded_audio(rows: DataFrame, key: str, rate: int = 32_000) -> DataFrame:
    """key, samples (mono, at ``rate``), reason for each row's ``content``. Bytes that are no
    WAV file, or a damaged one, have no samples but a reason; they fail no job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list = []
            for content, kind in zip(frame["content"], frame["kind"], strict=True):
                try:
                    found.append((decode_wav(bytes(content), rate), None) if kind == "wav" else (None, f"unsupported: {kind}"))
                except ValueError as e:
                    found.append((None, str(e)))
            yield pd.DataFrame({key: frame[key], "samples": [x for x, _ in found], "reason": [r for _, r in found]})

    kind = F.when(F.col("content").isNull(), "nothing").otherwise(sniff_format("content")).alias("kind")
    return rows.select(key, "content", kind).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, samples array<float>, reason string")


def log_mel(samples: np.ndarray, rate: int = 32_000, size: int = 1024, hop: int = 320, bands: int = 128) -> np.ndarray:
    """Z-scored log-mel spectrogram (HTK scale) of samples, bands by frames."""
    x = np.pad(samples, size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(size, 1 / rate)
    up = (freq - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freq) / np.diff(edges)[1:, None]
    out = np.log(np.maximum(0, np.minimum(up, down)) @ power.T + 1e-6)
    return ((out - out.mean()) / (out.std() + 1e-6)).astype(np.float32)


def crop_or_pad(samples: Column, size: int) -> Column:
    """The middle ``size`` elements of an array, or zeros after it."""
    n = F.size(samples)
    return F.when(n >= size, F.slice(samples, ((n - size) / 2).cast("int") + 1, size)).otherwise(F.concat(samples, F.array_repeat(F.lit(0.0), F.lit(size) - n)))


def rolled(values: Column, by: int) -> Column:
    """Circular shift to the right."""
    n = F.size(values)
    k = F.pmod(F.lit(by), n)
    return F.when(n == 0, values).otherwise(F.concat(F.slice(values, n - k + 1, k), F.slice(values, 1, n - k)))


def audio_features(files: DataFrame, rate: int = 32_000, clip_sec: float = 5.0, stride_sec: float = 2.5) -> DataFrame:
    """path, idx, start_sec, mel for each analysis window of a file. The content column is
    dropped in the same stage, so audio is never shuffled. Files that cannot be read have no
    windows; ``decoded_audio`` says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    x = decode_wav(content, rate)
                except ValueError:
                    continue
                size, step = int(clip_sec * rate), int(stride_sec * rate)
                x = np.pad(x, (0, max(0, size - len(x))))
                starts = list(range(0, len(x) - size + 1, step))
                if starts[-1] + size < len(x):
                    starts.append(len(x) - size)
                yield pd.DataFrame({"path": path, "idx": range(len(starts)), "start_sec": [s / rate for s in starts], "mel": [log_mel(x[s : s + size], rate).ravel() for s in starts]})

    return files.select("path", "content").mapInPandas(run, "path string, idx int, start_sec double, mel array<float>")


def rest_records(text: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Records of a saved search result: the elements of its ``recordings``."""
    return text.select(F.inline(F.from_json(column, f"struct<recordings: array<struct<{schema}>>>")["recordings"]))


def weather_hourly(text: DataFrame, column: str = "value") -> DataFrame:
    """Hourly arrays of a saved weather answer."""
    fields = "time: array<string>, temperature_2m: array<double>, precipitation: array<double>, relative_humidity_2m: array<double>, wind_speed_10m: array<double>"
    return text.select(F.from_json(column, f"struct<hourly: struct<{fields}>>")["hourly"].alias("h")).select("h.*")


def chunk_fields(uploads: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """Digest, size, format and size verdict of uploaded chunks; the bytes go on no
    further than this projection."""
    return uploads.select(*[c for c in uploads.columns if c != "content"], F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"), sniff_format("content").alias("audio_format"), (F.length("content") <= most_bytes).alias("accepted"))

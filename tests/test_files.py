"""File sources and sinks."""

from __future__ import annotations

import io
import json
import wave
from datetime import datetime

import numpy as np

from sonagrid.operators import export
from sonagrid.sources import files


def _wav(seconds: float = 6.0, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    t = np.arange(int(seconds * rate)) / rate
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.sin(2 * np.pi * 440 * t) * 12_000).astype("<i2").tobytes())
    return out.getvalue()


def test_dataset_folder_and_features(spark, tmp_path):
    for c in ("anas", "strix"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "rec_1_part01.wav").write_bytes(_wav())
    rows = files.dataset_folder(spark, str(tmp_path)).collect()
    assert {(r["class"], r.file) for r in rows} == {("anas", "rec_1_part01.wav"), ("strix", "rec_1_part01.wav")}
    mel = files.audio_features(files.audio_files(spark, str(tmp_path))).collect()
    assert len(mel) == 4 and all(len(r.mel) == 128 * 501 for r in mel)
    fields = files.chunk_fields(files.audio_files(spark, str(tmp_path))).collect()
    assert {r.audio_format for r in fields} == {"wav"} and all(len(r.sha256) == 64 and r.accepted for r in fields)


def test_decoded_audio_of_any_bytes(spark):
    """8 to 32 bits, two channels, another rate; damaged and foreign bytes become a reason."""
    def made(width: int, channels: int = 1, rate: int = 8000) -> bytes:
        out, x = io.BytesIO(), np.repeat(np.sin(np.arange(800) / 20) * 0.5, channels)
        raw = {1: lambda: (x * 128 + 128).astype(np.uint8).tobytes(), 2: lambda: (x * 32768).astype("<i2").tobytes(), 3: lambda: b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x), 4: lambda: (x * (1 << 31)).astype("<i4").tobytes()}[width]()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(rate)
            f.writeframes(raw)
        return out.getvalue()

    good = [made(1), made(2), made(3), made(4), made(2, 2), made(2, 1, 4000)]
    rows = [(k, c) for k, c in enumerate([*good, made(2)[:30], b"RIFF....WAVE", b"fLaC", b"", None])]
    got = {r.k: r for r in files.decoded_audio(spark.createDataFrame(rows, "k int, content binary"), "k", 8000).collect()}
    assert [len(got[k].samples) for k in range(6)] == [800] * 5 + [1600]
    for k in range(5):
        assert np.allclose(got[k].samples, np.sin(np.arange(800) / 20) * 0.5, atol=0.01)
    assert [(got[k].samples, got[k].reason) for k in range(6, 11)] == [(None, "damaged"), (None, "damaged"), (None, "unsupported: flac"), (None, "unsupported: unknown"), (None, "unsupported: nothing")]


def test_registry_manifest_and_rest(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": {"ru": "A", "habitat": "wetland"}}')
    assert files.registry_file(spark, str(tmp_path / "r.json")).collect()[0].habitat == "wetland"
    (tmp_path / "m.jsonl").write_text('{"class": "a", "file": "x"}\n{"class": "b", "file": "y"}\n')
    assert files.jsonl(spark, str(tmp_path / "m.jsonl"), "class string, file string").count() == 2
    answer = spark.createDataFrame([('{"recordings": [{"id": "1", "q": "A"}, {"id": "2", "q": "C"}]}',)], "value string")
    assert [r.q for r in files.rest_records(answer, "id: string, q: string").collect()] == ["A", "C"]
    hourly = spark.createDataFrame([('{"hourly": {"time": ["t"], "temperature_2m": [15.0, 16.0, 17.0], "precipitation": [0.5, null]}}',)], "value string")
    assert files.weather_hourly(hourly).first().temperature_2m == [15.0, 16.0, 17.0]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "d", "s", 0.5, datetime(2024, 1, 1), datetime(2024, 1, 1), 59.9, 41.1, None), (2, "d", "s", 0.5, datetime(2024, 1, 1), datetime(2024, 1, 1), None, None, None)], "id long, device_id string, species_slug string, confidence double, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz, lat double, lon double, duplicate_of_id long")
    export.write_geojson(rows, str(tmp_path / "g"))
    found = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert sorted((f["properties"]["id"], f["geometry"] is None) for f in found) == [(1, False), (2, True)]
    from pyspark.sql import functions as F

    export.write_csv(export.csv_rows(rows.withColumns({"name": F.lit('d "1"'), "ru": F.lit("S"), "habitat": F.lit("x")})), str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), sep=";", header=True, escape='"').collect()
    assert {r.confidence for r in back} == {"0.5000"} and {r.lat for r in back} == {"59.900000", None} and back[0].device_name == 'd "1"'


def test_crop_and_roll(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "a array<double>")
    r = rows.select(files.crop_or_pad(F.col("a"), 2).alias("c"), files.crop_or_pad(F.col("a"), 6).alias("p"), files.rolled(F.col("a"), 1).alias("r")).first()
    assert (r.c, r.p, r.r) == ([2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 0.0, 0.0], [4.0, 1.0, 2.0, 3.0])

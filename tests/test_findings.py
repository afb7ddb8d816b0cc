"""Small cases of what reviewers found in whole queries."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from sonagrid.plans import catalog


def events(spark, folder, rows):
    """A table of events (event_id, ts, user_id, event_type, value, props) in ``folder``."""
    data = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    data.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, folder).collect())
    assert got == sorted(want.fetchall())
    return got


@pytest.mark.parametrize("name", ["agg_hourly_mobile", "flt_date_range_ms"])
def test_milliseconds_are_rounded(spark, tmp_path, name):
    """Times within half a millisecond of an hour belong to it, before 1970 too."""
    times = [datetime(2024, 1, 10, 0, 0, 0, 499), datetime(2024, 1, 9, 23, 59, 59, 999_499), datetime(2024, 1, 9, 23, 59, 59, 999_500), datetime(2024, 1, 12, 0, 0, 0, 500), datetime(1969, 12, 31, 22, 0, 0, 500), datetime(1969, 12, 31, 21, 59, 59, 999_500)]
    same_as_sql(spark, events(spark, tmp_path, [(k, t, 1, "click", 1.0, '{"k": 1}') for k, t in enumerate(times)]), name)


def test_geohash_centre_stays_in_generated_code(spark):
    """The cell is computed once, without functions on arrays; every precision goes there and back."""
    from sonagrid.functions import geo

    rows = spark.createDataFrame([(59.9, 41.1), (-33.4, 151.2), (0.0, -179.9), (89.9, 179.9)], "lat double, lon double")
    plan = catalog.queries()["fn_geohash_center"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    for precision in range(1, 13):
        cells = rows.select("lat", "lon", geo.geohash("lat", "lon", precision).alias("cell"))
        for r in cells.select("*", geo.geohash_box("cell", precision).alias("b"), geo.geohash_box(F.concat("cell", F.lit("")), precision).alias("c")).collect():
            bits, x, y = "".join(f"{geo.BASE32.index(c):05b}" for c in r.cell), (-180.0, 180.0), (-90.0, 90.0)
            for k, bit in enumerate(bits):
                low, high = x if k % 2 == 0 else y
                half = ((low + high) / 2, high) if bit == "1" else (low, (low + high) / 2)
                x, y = (half, y) if k % 2 == 0 else (x, half)
            assert r.b == r.c and tuple(r.b) == pytest.approx((*y, *x)) and y[0] <= r.lat < y[1] and x[0] <= r.lon < x[1]


def test_activity_has_the_open_hours(spark, tmp_path):
    """The last hours are counted too, though no watermark closes them."""
    rows = [(k, datetime(2024, 1, 1, k // 4, 13 * (k % 4)), k % 3, "click", 1.0, '{"k": 1}') for k in range(40)]
    found = same_as_sql(spark, events(spark, tmp_path, rows), "stream_activity")
    assert len(found) == 10 and sum(r[2] for r in found) == 40


def test_greedy_clusters_do_not_grow_with_the_square(spark):
    """Many points of one spot beside single ones: old and new rules agree on a case done by hand."""
    import time

    import numpy as np
    import pandas as pd

    from sonagrid.operators import zones

    many = 20_000
    lat = np.concatenate((np.full(many, 59.9), [59.9, 59.901, 59.95, 59.96]))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(lat)), unit="s")
    began = time.process_time()
    found = zones._greedy(pd.DataFrame({"id": np.arange(len(lat)), "window_start_ts": at, "lat": lat, "lon": 41.1}), 300.0, 3)
    assert time.process_time() - began < 3
    assert len(found) == many + 2 and set(found["cluster"]) == {1}


@pytest.mark.parametrize("name", ["chunk_timing", "seam_dedup"])
def test_stream_keys_share_calls(spark, tmp_path, name):
    """Calls and states are for buckets of devices, whose number does not grow with theirs."""
    from sonagrid.plans import streams
    from sonagrid.streaming import pipelines

    batch = (streams._chunks if name == "chunk_timing" else streams._detections)(spark, "/root/testdata/sf0.001")
    batch.write.parquet(f"{tmp_path}/in")
    out = getattr(pipelines, name)(pipelines.read_stream(spark, f"{tmp_path}/in", batch.schema))
    plan = next(x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandasWithState" in x)
    assert "bucket" in plan


def test_pipeline_takes_bytes_that_are_not_utf8(spark, tmp_path):
    """Such a text ended the second stage; it counts as what it shows, character by character."""
    import hashlib

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    import tiktoken
    from sonagrid.llm import bpe, spans, toxicity

    raw = [b"good words \xff\xfe here", b"cut short \xe4\xb8", b"half \xed\xa0\x80 pair", b"\x80", b"", "\u4e2d".encode()[:2], "\u4e2d".encode()[2:], "r\u00e9st".encode()]
    shown = [x.decode("utf-8", "replace") for x in raw]
    docs = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(raw)], "doc_id long, text binary").select("doc_id", F.expr("cast(text as string)").alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), (1.0, 1.0, 0.0))
    want = [model.score(x.encode(), np.array([len(x.encode())]))[0] for x in shown]
    got = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(want)
    assert toxicity.keep(docs, model, threshold=2.0).count() == len(raw)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.encoded(spark, docs, "").collect()}
    for k, x in enumerate(shown):
        ids = np.array(plain.encode_ordinary(x), "<u4")
        assert (found[k].n_tokens, found[k].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[k].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()
    assert spans.as_utf8(b"".join(raw[5:7]), np.array([2, 1]))[0].decode() == shown[5] + shown[6]


def test_repeats_share_calls_and_keep_their_state(spark, tmp_path):
    """Calls and states are for buckets of devices and kinds; what one trigger leaves counts in the next."""
    from datetime import timedelta

    from sonagrid.streaming import pipelines, watch

    start = datetime(2024, 1, 1)
    seconds = {(1, 0): [0, 5, 30, 31, 60], (1, 1): [5, 14, 25], (2, 0): [0, 11, 22], (None, 0): [3, 4, 40], (2, None): [3, 50]}
    rows = [(k, d, kind, start + timedelta(seconds=s)) for k, (d, kind, s) in enumerate((d, kind, s) for (d, kind), many in seconds.items() for s in many)]
    schema = "id long, device_id long, kind int, started_at timestamp"
    for part in range(2):  # by time: one trigger each
        some = [r for r in rows if (r[3] < start + timedelta(seconds=20)) == (part == 0)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = watch.suppress_repeats(pipelines.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1), 10)
    assert "bucket" in next(x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandasWithState" in x)
    with watch.state_store(spark):
        out.writeStream.foreachBatch(pipelines.detection_sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = {r[0] for r in rows if not any(p[1:3] == r[1:3] and 0 < (r[3] - p[3]).total_seconds() <= 10 for p in rows)}
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_components_of_long_paths_take_few_rounds(spark):
    """Paths whose numbers jump about; estimates of sizes do not grow with the rounds."""
    import random

    from sonagrid.operators import clusters

    order = random.Random(3).sample(range(3000), 3000)
    paths = [order[k : k + 300] for k in range(0, 3000, 300)]
    links = spark.createDataFrame([(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)], "a long, b long")
    label = clusters.components(spark.createDataFrame([(k,) for k in range(3001)], "id long"), links)
    assert int(str(label._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 400
    assert dict(map(tuple, label.collect())) == {k: min(p) for p in [*paths, [3000]] for k in p}


def test_neighbours_pair_blocks_of_a_place(spark, monkeypatch):
    """Distances are taken for blocks of a place, full cubes are dealt over parts, and no pair
    is lost at the date line, at a pole, or where places, ids or keys are the same or missing."""
    from itertools import product
    from math import asin, cos, radians, sin, sqrt

    from sonagrid.functions import geo
    from sonagrid.operators import joins

    def apart(p, q):
        (a, b), (c, d) = (map(radians, x) for x in (p, q))
        return 2 * geo.EARTH_M * asin(min(1, sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2)))

    schema = "id long, species string, lat double, lon double"
    one, beside, far = (59.9, 41.1), (59.9, 41.104), (59.9, 41.2)
    places = [one] * 90 + [beside] * 40 + [far] * 30 + [(10.0, 180.0), (10.0, -179.999), (10.001, 179.999), (90.0, 5.0), (89.999, 100.0), (89.999, -80.0), (0.0, 0.0), (-0.0, -0.0), (0.001, -0.001)]
    rows = [(k, "a" if k % 40 else "b", *p) for k, p in enumerate(places)] + [(7, "a", *beside), (500, None, *one), (501, None, *one), (502, "a", None, 41.1), (503, "a", 59.9, float("nan"))]
    told = [r for r in rows if r[1] is not None and r[2] is not None and r[3] == r[3]]
    want = sorted((p[1], p[0], q[0]) for p, q in product(told, told) if p[1] == q[1] and p[0] != q[0] and apart(p[2:], q[2:]) <= 321.7)
    frame = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, joins.neighbours(frame, 321.7, ["species"]).collect())) == want
    assert joins.near_blocks(joins.id_blocks(frame, ["species"]), 321.7, ["species"]).count() < 60
    monkeypatch.setattr(joins, "BLOCK", 8)
    monkeypatch.setattr(joins, "DEALT", 20)
    assert sorted(map(tuple, joins.neighbours(frame, 321.7, ["species"]).collect())) == want

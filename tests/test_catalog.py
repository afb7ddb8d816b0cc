"""Every query with SQL against DuckDB on the smallest tables; streams against batch."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sonagrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in frame.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(_plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize(("stream", "batch", "columns"), [("stream_chunk_timing", "str_chunk_timing", ["id", "overlap_sec", "gap_sec", "out_of_order"]), ("stream_seam_dedup", "str_seam_dedup", ["id", "duplicate_of_id"])])
def test_stream_equals_batch(spark, stream, batch, columns):
    rows = lambda name: sorted(tuple(_plain(round(r[c], 3) if isinstance(r[c], float) else r[c]) for c in columns) for r in catalog.queries()[name](spark, SF).collect())
    assert rows(stream) == rows(batch)


@pytest.mark.parametrize(("stream", "batch", "columns"), [("stream_chunk_timing", "str_chunk_timing", ["id", "overlap_sec", "gap_sec", "out_of_order"]), ("stream_seam_dedup", "str_seam_dedup", ["id", "duplicate_of_id"])])
def test_stream_of_many_triggers_equals_batch(spark, monkeypatch, stream, batch, columns):
    """One file a trigger: results do not switch with the number of files."""
    from sonagrid.streaming import pipelines

    read = pipelines.read_stream
    monkeypatch.setattr(pipelines, "read_stream", lambda spark, path, schema, *_: read(spark, path, schema, 1))
    rows = lambda name: sorted(tuple(_plain(round(r[c], 3) if isinstance(r[c], float) else r[c]) for c in columns) for r in catalog.queries()[name](spark, SF).collect())
    assert rows(stream) == rows(batch)


@pytest.mark.parametrize("name", ["stream_activity", "stream_heartbeat", "stream_sessions", "stream_analysis_windows", "stream_stale_devices", "stream_record_stale", "stream_auto_batch"])
def test_stream_of_many_triggers_equals_sql(spark, duck, monkeypatch, name):
    from sonagrid.streaming import pipelines

    read = pipelines.read_stream
    monkeypatch.setattr(pipelines, "read_stream", lambda spark, path, schema, *_: read(spark, path, schema, 1))
    test_query_equals_sql(spark, duck, name)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("missing", ["sonagrid.llm", "corpus_pipeline", "zstandard", "tiktoken"])
def test_entry_without_what_the_subpackage_needs(missing):
    """The core queries stay when the subpackage, or a library that it needs, is not there."""
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.abspath(entry.__file__)), check=True).stdout.split()
    assert int(out[0]) >= len(catalog.queries()) and int(out[1]) >= len(catalog.oracle_sql())


def test_queries_without_sql_give_rows(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).limit(1).count() == 1, name


def test_sink_takes_a_batch_twice(spark, tmp_path):
    """A replayed micro-batch leaves no row twice, in the table and in the raw copy."""
    from sonagrid.streaming import pipelines

    seen = []
    sink = pipelines.detection_sink(f"{tmp_path}/out", f"{tmp_path}/raw", lambda batch, number: seen.append((number, batch.count())))
    first, second = (spark.range(a, b) for a, b in ((0, 5), (5, 8)))
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        sink(batch, number)
    for folder in ("out", "raw"):
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{folder}").collect()) == list(range(8))
    assert seen == [(0, 5), (1, 3), (1, 3)]


def test_exports_of_replayed_batches(spark, tmp_path):
    """Every row is exported once, whatever micro-batch comes again, at any point."""
    from sonagrid.streaming import exports

    sink = exports.auto_batch(str(tmp_path), 10)
    part = lambda a, b: spark.range(a, b)
    for number, (a, b) in ((0, (0, 7)), (0, (0, 7)), (1, (7, 25)), (1, (7, 25)), (2, (25, 26)), (2, (25, 26)), (3, (26, 44))):
        sink(part(a, b), number)
    found = sorted((r.id, r.export, r.place) for r in spark.read.parquet(f"{tmp_path}/export").collect())
    assert found == [(k, k // 10, k % 10 + 1) for k in range(40)]


@pytest.mark.parametrize("name", ["str_seam_dedup", "str_chunk_dedup", "str_seam_gate"])
def test_duplicates_equal_a_plain_fold(spark, name):
    """The queries of duplicates over the whole table against a loop in plain Python."""
    from sonagrid.operators import ingest
    from sonagrid.sources import fixtures as fx

    rows = fx.detections(spark, SF).collect()
    seam = {}
    if name == "str_seam_gate":
        seam = {r.id: (r.zone_start, r.zone_end) for r in ingest.overlap_zone(ingest.chunk_timing(fx.chunks(spark, SF))).collect()}
    second = lambda t: pd.Timestamp(t).timestamp()
    kept, want = {}, {}
    for r in sorted(rows, key=lambda r: (r.window_start_ts, r.id)):
        s, e = second(r.window_start_ts), second(r.window_end_ts)
        near = kept.setdefault((r.device_id, r.species_slug, r.window_start_ts.date() if name == "str_chunk_dedup" else None), [])
        a, b = seam.get(r.id, (0.0, 1e18))
        may = b > a and s < b + 1 and e > a - 1
        want[r.id] = next((i for i, x, y in near if may and (min(e, y) - max(s, x)) / min(e - s, y - x) >= 0.5), None)
        if want[r.id] is None:
            near.append((r.id, s, e))
    got = {r.id: r.duplicate_of_id for r in catalog.queries()[name](spark, SF).collect()}
    assert got == want and any(v is not None for v in want.values())

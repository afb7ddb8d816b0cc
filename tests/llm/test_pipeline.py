"""The pipeline against the same steps in plain Python on the smallest tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from sonagrid.llm import near, quality, store, toxicity
from tests.llm.test_text_operators import brute_components, brute_leaks

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_equals_plain_steps(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs, labels = table("documents"), table("labels")
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.score >= 0.7}
    calm = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.score < 0.3}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good & calm]
    kept = {i for i, _, c in brute_components(rows) if i == c}
    rows = [r for r in rows if r[0] in kept]
    leaked = {i for i, _ in brute_leaks(rows, [(r.item_id, r.text) for r in table("benchmark").collect()])}
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == kept - leaked and 0 < len(got) < len(good)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, SF).columns) == set(docs.columns)


def test_decontamination_decides_by_row(spark):
    """Clean rows without an id, or of a repeated id, stay beside ones that leak."""
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    rows = [(None, leak), (None, "clean words here"), (7, leak), (7, "other clean words"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontaminated(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, "clean words here"), (7, "other clean words"), (8, None)} and len(got) == 3


ODD = "doc_id long, text string, lang string, source string, n_chars long, _h1 long, score double, root long, _text long"


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    texts = [None, "", "  ", "plain words in a row that say little of note", " ".join(f"w{k % 900}" for k in range(20_000))]
    rows = [(i, t, None, "s", None, 1, 2.0, 3, 4) for i in (1, 1, None) for t in texts] + [(2, texts[3], None, None, 1, None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("odd") / "documents")
    spark.createDataFrame(rows, ODD).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_on_odd_documents(spark, odd_documents, stage):
    docs = odd_documents
    got = stage(spark, docs, SF)
    rows = got.collect()
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert got.columns == (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if last else list(corpus_pipeline.COLUMNS))
    assert stage(spark, docs.limit(0), SF).count() == 0
    if last or stage is corpus_pipeline.decontaminated:
        assert len(rows) == 16
    elif stage is corpus_pipeline.one_of_each_group:
        kept = sorted((str(r.doc_id), len(r.text or "")) for r in rows)
        # the two long texts of three rows each, one blank row of id 1, three without an id
        assert [k for k in kept if k[1] > 2] == [("1", 44), ("1", len(docs.filter("length(text) > 1000").first().text))]
        assert sum(k[0] == "1" for k in kept) == 3 and sum(k[0] == "None" for k in kept) == 3
    else:  # rows of one text fare alike
        counts = {}
        for r in rows:
            counts[r.text] = counts.get(r.text, 0) + 1
        assert all(n == (4 if t and t.startswith("plain") else 3) for t, n in counts.items())


def test_driver_gives_freed_memory_back(spark, monkeypatch):
    """What the near-duplicate stage has the JVM free does not stay with the C library."""
    if not store.trim(spark):
        pytest.skip("this JVM cannot")
    calls = []
    monkeypatch.setattr(store, "trim", lambda _: calls.append(1))
    docs = spark.createDataFrame([(k, f"the same few words as in all of these {k % 2}") for k in range(4)], "doc_id long, text string")
    assert near.keep_one(docs).count() == 2
    assert calls

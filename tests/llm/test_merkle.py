"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sonagrid.llm import merkle
from sonagrid.llm.store import Scratch

KIND = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def climb(nodes, fan):
    """All levels, and for each node of the lowest its (before, after) at every level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + fan])) for k in range(0, len(below), fan)])
    paths = []
    for p in range(len(nodes)):
        path, at = [], p
        for level in levels[:-1]:
            run = at // fan * fan
            path.append(("".join(level[run:at]), "".join(level[at + 1 : run + fan])))
            at //= fan
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, fan=8):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[4])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, paths = [], {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, paths[g] = climb([h for _, h in groups[g]], fan)
        tops.append(top)
    if not names:
        return []
    root, over = climb(tops, fan)
    out = []
    for g, top, above in zip(names, tops, over, strict=True):
        for (r, h), path in zip(groups[g], paths[g], strict=True):
            node = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, None if r[4] is None else r[4].translate(LOWER))
            for a, b in path + above:
                node = sha(a + node + b)
            out.append((r[0], h, top, root, sha("".join(a + b for a, b in path + above)), node, node == root))
    return out


def made(n):
    langs = [None, "de", "en", "en", "en", "en", "é", "fr"]
    return [(k * 3 % 101, ["a", None, "B"][k % 3], langs[k % 8], None if k % 7 == 0 else k, None if k % 11 == 0 else ["Some TEXT é" * (k % 4), "lower only", ""][k % 3]) for k in range(n)]


def answer(frame):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("fan", "every"), [(8, 3), (2, 1), (2, 2), (3, 2)])
def test_manifest_equals_a_plain_tree(spark, fan, every):
    rows = made(90) + [(None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id")] + [(7, "s", "en", 5, "Again")] * 5
    rows.append((8, "x", "lone", 1, "A long one " * 50_000))
    docs = spark.createDataFrame(rows, KIND).repartition(3).withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("h", F.lit("z"))
    assert answer(merkle.audit(spark, docs, fan, every)) == sorted(brute(rows, fan), key=str)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_manifests(spark, n):
    rows = [(k + 3, "s", "en", 1, "Text") for k in range(n)]
    assert answer(merkle.audit(spark, spark.createDataFrame(rows, KIND))) == sorted(brute(rows), key=str)


def test_only_every_few_levels_are_kept(spark):
    rows = [(k, "s", "en", 1, str(k)) for k in range(40)]
    with Scratch(spark) as tables:
        trees, _ = merkle.manifest(tables, spark.createDataFrame(rows, KIND), fan=2, every=2)
        # 40 leaves in blocks of 4, their 10 ancestors in 3 blocks, whose 3 ancestors are in 1
        assert [x.count() for x in trees.levels] == [10, 3, 1]
        assert [x.select(F.explode("nodes")).count() for x in trees.levels] == [40, 10, 3]


def test_equal_rows_are_dealt_over_tasks(spark):
    docs = spark.range(0, 4000, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text"))
    with Scratch(spark) as tables:
        merkle.manifest(tables, docs)
        sizes = spark.read.parquet(f"{tables.path}/leaves_ranged").groupBy("part").count().toPandas()["count"]
    assert len(sizes) >= 4 and sizes.max() < 2 * sizes.mean()

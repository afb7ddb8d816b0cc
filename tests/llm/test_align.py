"""Cross-tokenizer alignment against plain loops over the tokenizers' own ids."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonagrid.llm import align, mph, queries
from sonagrid.llm.store import Scratch

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    table = align.byte_of_char()

    def tokens(text):
        """[(id, bytes)] of both, or nothing."""
        if not text:
            return [], []
        whole = b" " + text.encode()
        x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([i - 3]) if 3 <= i < 259 else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        same = b"".join(t for _, t in x) == whole == b"".join(t for _, t in y)
        return (x, y) if same else ([], [])

    return tokens


def groups_of(x, y):
    """[(A ids, B ids)]"""
    ends = []
    for side in (x, y):
        at, mine = 0, []
        for _, t in side:
            at += len(t)
            mine.append(at)
        ends.append(mine)
    cuts, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for cut in cuts:
        ids = ([], [])
        while i < len(x) and ends[0][i] <= cut:
            ids[0].append(x[i][0])
            i += 1
        while j < len(y) and ends[1][j] <= cut:
            ids[1].append(y[j][0])
            j += 1
        out.append(ids)
    return out


def brute(rows, tokens):
    found = [groups_of(*tokens(t)) for _, t in rows]
    counts: Counter = Counter()
    for groups in found:
        counts.update({(a, b) for x, y in groups for a in x for b in y})
    top: Counter = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), groups in zip(rows, found, strict=True):
        links = [(a, b) for x, y in groups for a in x for b in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), shown))
    return out, counts, top


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def odd_rows():
    rng = random.Random(3)
    bits = ["word", "Éa's", "don't", "  two", "\n\nx", "\t", "漢字かな", "🙂!!", "<|endoftext|>", "<s>", "<0x41>", "x y", "　z", "​ q", "12345", "á", "x\u0085", "ﬁ", " ", "=====", "e  f", "\x1c g", "\r\n"]
    rows = [(1, None), (2, ""), (3, " "), (4, "   "), (5, "bad ▁ mark"), (None, "no id"), (6, " lead"), (7, "trail "), (8, "x" * 3000), (9, " " * 400 + "y" + "\n" * 300), (10, "é" * 500 + " " + "漢" * 200)]
    rows += [(20 + k, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for k in range(80)]
    rows += [(200 + k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    return [*rows, (20, rows[11][1]), (20, rows[11][1]), (300, " ".join(rng.choice(bits) for _ in range(20_000)))]


def test_alignment_equals_plain_loops(spark, plain, monkeypatch):
    rows = odd_rows()
    want, counts, top = brute(rows, plain)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("block", F.lit("clash")).withColumn("n_a", F.lit(0))
    with Scratch(spark) as tables:
        got = sorted((tuple(r[c] for c in NAMES) for r in align.align(tables, docs, A_PATH, B_PATH).collect()), key=str)
    assert got == sorted(want, key=str)
    monkeypatch.setattr(align, "BLOCKS_A_RUN", 1)  # several runs a shard
    pairs = align.pair_counts(docs.repartition(5), A_PATH, B_PATH).collect()
    assert {(r.a_id, r.b_id): r.docs for r in pairs} == counts
    assert all(r.best == (r.docs == top[r.a_id]) for r in pairs) and len(pairs) == len(counts)


def test_bytes_that_are_no_text_have_no_tokens(spark):
    docs = spark.createDataFrame([(1, bytearray(b"bad \xff byte")), (2, bytearray(b"good"))], "doc_id long, text binary")
    with Scratch(spark) as tables:
        got = {r.doc_id: r.n_a for r in align.align(tables, docs, A_PATH, B_PATH).collect()}
    assert got[1] == 0 and got[2] > 0
    with Scratch(spark) as tables:
        assert align.align(tables, docs.filter("false"), A_PATH, B_PATH).collect() == []


def test_large_groups_make_equal_links_once(monkeypatch):
    a, b = np.array([5, 5, 6, 5], np.uint16), np.array([9, 9, 8], np.uint16)
    size = np.full(16, 3, np.int64)
    of_b = np.full(16, 4, np.int64)
    found = {}
    for most in (1, 1 << 12):
        monkeypatch.setattr(align, "PLAIN_LINKS", most)
        total: Counter = Counter()
        for _, key, n in zip(*align.Groups(a, b, np.array([4]), np.array([3]), size, of_b).pairs(), strict=True):
            total[int(key)] += int(n)
        found[most] = total
    assert found[1] == found[1 << 12] and sum(found[1].values()) == 12


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 200_000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n).astype(np.uint32))
    table = mph.Table(mph.build(keys))
    assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
    if n:
        absent = np.setdiff1d(np.arange(100, dtype=np.uint32), keys)
        with pytest.raises(KeyError):
            table.find(absent)


def test_query_over_a_whole_table(spark, plain):
    import hashlib

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want = sorted((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in brute(rows, plain)[0])
    names = (*NAMES[:-1], "groups_sha256")
    assert sorted(tuple(r[c] for c in names) for r in queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()) == want


def test_a_worker_keeps_little_between_tasks():
    """Executors have bounds: units are remembered in few bytes, and the encoder goes once
    blocks are encoded."""
    encode = align._encoder(A_PATH, B_PATH)
    units = 4096
    data = np.frombuffer(b"".join(b" unit%06d" % k for k in range(units)), np.uint8)
    starts, sizes = np.arange(units) * 11, np.full(units, 11)
    hashes = np.arange(1, units + 1, dtype=np.uint64)[::-1].copy()
    ids, counts = np.tile(np.array([1, 50_000, 31_999], np.uint32), units), np.full(units, 3)
    memory = type(encode.memory)(units, encode.memory.ids.dtype.type)
    for part in (slice(0, 1000), slice(1000, None)):
        memory.add(hashes[part], data, starts[part], sizes[part], ids[: 3 * len(hashes[part])], counts[part])
    held = sum(x.nbytes for x in vars(memory).values() if isinstance(x, np.ndarray))
    assert held <= units * (24 + 11 + 3 * 2)
    found = memory.find(hashes, data, starts, sizes)
    assert (found >= 0).all() and memory.ids[memory.firsts[found] + 1].tolist() == [50_000] * units
    encode = memory = None
    align._token_sizes(A_PATH, B_PATH)
    assert align._encoder.cache_info().currsize == 0

"""Personal data: base spans against plain patterns, the model against all segmentations."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from sonagrid.llm import pii, queries, semicrf


def plain_base(text):
    """The patterns as they are written down, on characters."""
    out = []
    for k, (pattern, holds) in enumerate((
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(re.sub("[^0-9]", "", t)) <= 19 and plain_luhn(re.sub("[^0-9]", "", t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
    )):
        out += [(m.start(), m.end(), k) for m in re.finditer(pattern, text) if holds(m[0])]
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(digits[::-1]):
        total += sum(map(int, str(int(d) * 2))) if k % 2 else int(d)
    return total % 10 == 0


def odd_texts():
    rng = random.Random(2)
    bits = ["a@b.c", "x.y@@z.com", "@", "1.2.3.4", "256.1.1.1", "001.2.3.04", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111 11111111", "4111111111111112", "+1 (017) 555-7713", "+49 30 1234567", "+1", "é", "漢", "🙂", " ", "\n", ".", "-", "5", "a.b+c@d-e.f.g.", "token = \"" + "0f3a" * 10 + "\"", "jane at site dot com", "٣٤٥", "a@b", "a@b..c", "+5 ()5", "１２"]
    texts = ["", None, " ", "9" * 900, "a" * 900 + "@" + "b" * 900 + ".c", "@" * 900, "1." * 500, "+1" * 500, "4 " * 500]
    return texts + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)]


@pytest.fixture(scope="module")
def trained():
    return pii.model()


def laid(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def test_base_spans_equal_the_patterns(trained):
    texts = odd_texts()
    base, every = pii.found_in(trained, *laid(texts))
    for text, mine, more in zip(texts, base, every, strict=True):
        assert mine == plain_base(text or ""), text
        assert set(mine) <= set(more) and more == sorted(more, key=lambda x: (x[0], x[2], x[1]))
        added = [x for x in more if x not in mine]
        assert not any(a < q and p < b for a, b, _ in added for p, q, _ in mine)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(added, added[1:], strict=False))


def test_long_texts_take_linear_time(trained):
    """Runs on which a plain pattern takes time with the square of the length."""
    for text in ("9" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 10_000, "x" * 100_000 + "@", "1 " * 4000, "a@b.c " * 5000):
        pii.found_in(trained, *laid([text]))


def test_spans_do_not_depend_on_other_texts(trained):
    texts = [t for t in odd_texts() if t]
    together = pii.found_in(trained, *laid(texts))[1]
    assert together == [pii.found_in(trained, *laid([t]))[1][0] for t in texts]


def segmentations(n, segments, labels, at=0):
    if at == n:
        yield []
        return
    for rest in segmentations(n, segments, labels, at + 1):
        yield [(at, at + 1, 0, None), *rest]
    for k, (i, j, _) in enumerate(segments):
        if i == at:
            for rest in segmentations(n, segments, labels, j):
                for y in range(1, labels):
                    yield [(i, j, y, k), *rest]


def test_sums_and_best_equal_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 5):
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
        segments = [(i, j, (f"f{k}", "all")) for k, (i, j) in enumerate(spans)]
        model = semicrf.Model(("", "x", "y"), {f"f{k}": k for k in range(len(spans))} | {"all": len(spans)}, rng.normal(size=(len(spans) + 1, 3)), rng.normal(size=(3, 3)))
        scored, found = model.scores(segments), []
        for path in segmentations(n, segments, 3):
            total, last = 0.0, 0
            for _, _, y, k in path:
                total += model.pairs[last, y] + (0 if k is None else scored[k, y])
                last = y
            found.append((total, path))
        every = np.logaddexp.reduce([t for t, _ in found])
        total, held, expected = model.marginals(n, segments)
        assert np.isclose(total, every)
        want, pairs = np.zeros_like(held), np.zeros((3, 3))
        for t, path in found:
            last = 0
            for _, _, y, k in path:
                pairs[last, y] += np.exp(t - every)
                if k is not None:
                    want[k, y] += np.exp(t - every)
                last = y
        assert np.allclose(held, want) and np.allclose(expected, pairs)
        best = max(found, key=lambda x: x[0])[1]
        assert model.decode(n, segments) == [(i, j, y) for i, j, y, k in best if k is not None]


def test_made_lines_held_out(trained):
    true = right = given = 0
    for line, held in pii.made_lines(400, 99):
        got = {(a, b, pii.KINDS[y]) for a, b, y in pii.found_in(trained, *laid([line]))[1][0]}
        right, true, given = right + len(got & set(held)), true + len(held), given + len(got)
    assert right / true > 0.95 and right / given > 0.95


def digests(row):
    return hashlib.sha256(",".join(f"{pii.KINDS[y]}:{a}:{b}" for a, b, y in row).encode()).hexdigest()


def test_query_over_a_whole_table(spark, trained):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op12_private(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base, every = plain_base(text or ""), pii.found_in(trained, *laid([text]))[1][0]
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(y == k for *_, y in base) for k in range(4))
        assert r.base_sha256 == digests(base) and r.spans == ",".join(f"{pii.KINDS[y]}:{a}:{b}" for a, b, y in every)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "mail a@b.c"), (3, "mail a@b.c"), (3, "mail a@b.c")], "doc_id long, text string").selectExpr("*", "1 as base", "2 as spans", "'z' as kind")
    got = sorted(((r.doc_id, [tuple(x) for x in r.spans]) for r in pii.find(docs).collect()), key=str)
    found = [("email", 5, 10)]
    assert got == [(1, []), (2, []), (3, found), (3, found), (None, found)]
    broken = spark.createDataFrame([(1, bytearray(b"\xff\xfe a@b.c \xc3"))], "doc_id long, text binary")
    assert len(pii.find(broken).collect()) == 1 and pii.find(docs.filter("false")).collect() == []

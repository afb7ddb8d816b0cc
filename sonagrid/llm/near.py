"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

A document is the set of its distinct n-word shingles, held as 64-bit hashes. Equal
sets are collapsed first, so that a group of copies is one entity however large it
is. Then, as in prefix-filter joins:

* shingles are ordered rare first, by a frequency sketch over the whole corpus. The
  sketch has a fixed number of cells; its order decides only how much work is done,
  never which pairs are found. On a corpus that fills the cells, it still tells the
  shingles that stand out from what a cell usually holds;
* a set enters the index with its first ``n - ceil(2t/(1+t) n) + 1`` shingles and
  probes with its first ``n - ceil(t n) + 1``, so every pair over the threshold
  meets in some shingle;
* length and positional filters drop pairs that cannot reach the overlap asked for,
  and a suffix filter bounds the overlap from counts by hash range, before any set is
  sent. Each pair is verified once.

Groups are never expanded into all pairs at the outset: the first round compares each
set with the centre of the groups it is in, a set whose shingles are common, and one more
tries another centre. Later, only pairs that are still in different components are made,
each with a set outside its group's largest component, and only if their distances to the
centres that both were compared with leave it open whether they link (the Jaccard distance
is a metric). So a group of thousands of near copies costs about as many comparisons as it
has members, while no component is cut.

Frequent shingles are dealt over several tasks, and so are the pairs of one centre; other
joins on a key that may be frequent go through ``skew.join_unique``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sonagrid.llm import graph, spans
from sonagrid.llm.skew import join_unique
from sonagrid.llm.store import Scratch, partitions

SHINGLE = 5
#: Jaccard threshold as a fraction: NUMERATOR / DENOMINATOR = 0.75.
NUMERATOR, DENOMINATOR = 3, 4
#: Cells of the frequency sketch (2**bits) and the parts it is summed in.
SKETCH_BITS, SKETCH_PARTS = 22, 16
#: The filter for candidate documents has so many bits (2**bits) for each, up to a bound.
FILTER_SPARE, MOST_FILTER_BITS = 8, 28
#: A shingle is dealt over several tasks if it is estimated to be in more sets than this and
#: in more than a quarter of a task's even share of prefixes.
SALT_ROWS = 5_000
#: Pairs of one set that are verified in one task.
CENTRE_PAIRS = 500
#: Sets that share a first number, at most.
MOST_SHARED = 100_000
#: Ranges of hashes that the suffix filter counts by (2**bits).
RANGE_BITS = 4
#: Bytes of sets that a Python task hands over at once.
HELD_BYTES = 4 << 20


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the texts in a batch's second column."""
    data, offsets = spans.column_bytes(batch.column(1))
    for lo, hi in spans.slices(offsets):
        if keep is not None and not keep[lo:hi].any():
            continue
        low = spans.LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = spans.word_spans(spans.NONSPACE[low], offsets[lo : hi + 1] - offsets[lo])
        words = spans.span_hash(low, starts, ends)
        windows = spans.window_hash(words, size)
        for k in range(hi - lo):
            if keep is not None and not keep[lo + k]:
                continue
            a, b = first[k], first[k + 1]
            if b - a >= size:
                yield lo + k, np.unique(windows[a : b - size + 1])
            else:
                yield lo + k, spans.window_hash(words[a:b], b - a) if b > a else windows[:0]


def _signature(hashes: np.ndarray, shared: frozenset = frozenset()) -> int:
    """A number for a set. ``shared`` holds first numbers that unequal sets have in common;
    their sets go by a second one."""
    first = int(spans.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
    return _second(hashes) if first in shared else first


def _second(hashes: np.ndarray) -> int:
    return int(spans.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).astype(np.int64))


_PROFILE = "doc_id long, n long, sig long, second long, ranges array<int>, part int, cells binary"


def _profiled(size: int):
    """Columns after the text (longs) are passed on."""
    names = [x.split()[0] for x in _PROFILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[str] = []
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        pending: list[np.ndarray] = []
        held, shift = 0, np.uint64(64 - SKETCH_BITS)

        def flush() -> None:
            nonlocal held
            if pending:
                cells, counts = np.unique(np.concatenate(pending) >> shift, return_counts=True)
                sketch[cells.astype(np.int64)] += counts.astype(np.uint32)
                pending.clear()
                held = 0

        for batch in batches:
            many = batch.num_rows
            ns, signs, seconds = (np.zeros(many, np.int64) for _ in range(3))
            ranges = np.zeros((many, 1 << RANGE_BITS), np.int32)
            for row, hashes in shingle_sets(batch, size):
                ns[row], signs[row], seconds[row] = len(hashes), _signature(hashes), _second(hashes)
                ranges[row] = np.bincount((hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS)
                if len(hashes) and signs[row] not in seen:
                    seen.add(int(signs[row]))
                    pending.append(hashes)
                    held += len(hashes)
                if held > 1 << 18:
                    flush()
            flush()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) << RANGE_BITS), pa.array(ranges.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns), pa.array(signs), pa.array(seconds), lists, pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary()), *batch.columns[2:]], names + batch.schema.names[2:])
            marks = batch.schema.names[2:]
        if sketch.any():
            parts = [_pack(x) for x in sketch.reshape(SKETCH_PARTS, -1)]
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(SKETCH_PARTS, pa.list_(pa.int32())), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary()), *[none] * len(marks)], names + marks)

    return run


def _pack(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(kind).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), {1: np.uint8, 4: np.uint32}[packed[0]])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch parts of a partition, one running total for each part."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = _unpack(packed).astype(np.uint64)
            totals[part] = totals[part] + counts if part in totals else counts
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in totals.values()], pa.binary())], ["part", "cells"])


def _counts(coded: np.ndarray) -> np.ndarray:
    """Counts from their codes of one byte, eight times their binary logarithm."""
    return np.exp2(coded / 8) - 1


def _sketch(cells: DataFrame) -> np.ndarray:
    """The corpus-wide sketch, whose size is fixed: 2**SKETCH_BITS cells, each the code of an
    estimated count. Partial sums are made in the tasks, then once more for each part."""
    parts = cells.repartition(SKETCH_PARTS, "part").mapInArrow(_summed, "part int, cells binary")
    found = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for row in parts.collect():  # of a fixed size together
        found[row.part] = np.frombuffer(row.cells, np.uint8)
    return found.reshape(-1)


def _spread(often: np.ndarray, usual: int, salt_rows: int) -> np.ndarray:
    """Tasks that shingles are dealt over, from the codes of their cells and of what a cell
    usually holds."""
    return 1 + (np.maximum(_counts(often) - _counts(np.array(usual)), 0) // salt_rows).astype(np.int64)


#: Shingles of a set, at most; the arrays of a text with more would fit no task.
MOST_SHINGLES = 1 << 28


def _packed(n: int, pos: np.ndarray, rank: int) -> np.ndarray:
    """A set's size, places in its prefix and rank as one number each. What differs from row
    to row comes first, then zeros, so that the shuffle's rows are short when compressed."""
    if n >= MOST_SHINGLES:
        raise ValueError(f"a text has {n} shingles; sets have to be smaller than {MOST_SHINGLES}")
    return rank | (n & 0xFFFF) << 8 | (pos & 0xFFFF) << 24 | (n >> 16) << 40 | (pos >> 16) << 52


def _unpacked(rows: DataFrame) -> DataFrame:
    n = "shiftrightunsigned(packed, 8) & 65535 | shiftleft(shiftrightunsigned(packed, 40) & 4095, 16)"
    pos = "shiftrightunsigned(packed, 24) & 65535 | shiftleft(shiftrightunsigned(packed, 52), 16)"
    return rows.select("h", "salt", "sig", F.expr(f"cast({n} as int)").alias("n"), F.expr(f"cast({pos} as int)").alias("pos"), F.expr("cast(packed & 127 as byte)").alias("rank"))


def _prefixes(sketch, usual: int, salt_rows: int, shared: frozenset, size: int, num: int, den: int):
    schema = pa.schema([("h", pa.int64()), ("sig", pa.int64()), ("packed", pa.int64()), ("salt", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, shift = sketch.value, set(), np.uint64(64 - SKETCH_BITS)
        out: list[list[np.ndarray]] = [[] for _ in schema]
        held = 0
        for batch in batches:
            for _, hashes in shingle_sets(batch, size):
                n = len(hashes)
                if not n or (sig := _signature(hashes, shared)) in seen:
                    continue
                seen.add(sig)
                take = n - -(-num * n // den) + 1
                often = counts[(hashes >> shift).astype(np.int64)]
                chosen = np.argsort(often, kind="stable")[:take]
                spread = _spread(often[chosen], usual, salt_rows)
                rank = 127 - int(often.mean()) // 2
                for k, x in enumerate((hashes[chosen].view(np.int64), np.full(take, sig, np.int64), _packed(n, np.arange(take, dtype=np.int64), rank), np.where(spread > 1, sig % spread + 1, 0).astype(np.int32))):
                    out[k].append(x)
                held += take
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=schema)
                    out, held = [[] for _ in schema], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=schema)

    return run


def _cells(bits: int):
    """A bitmap of hashed ids for each partition, in SKETCH_PARTS parts. A null counts as 0,
    as in ``_wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = _cell(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(hit, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in hit.reshape(SKETCH_PARTS, -1)], pa.binary())], ["part", "cells"])

    return run


def _cell(ids: np.ndarray, bits: int) -> np.ndarray:
    return (spans.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
            totals[part] = totals[part] | bits if part in totals else bits
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["part", "cells"])


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits cells that holds at least the given ids (one column)."""
    parts = ids.mapInArrow(_cells(bits), "part int, cells binary").repartition(SKETCH_PARTS, "part").mapInArrow(_either, "part int, cells binary")
    found = np.zeros((SKETCH_PARTS, (1 << bits) // 8 // SKETCH_PARTS), np.uint8)
    for row in parts.collect():  # of a fixed size together
        found[row.part] = np.frombuffer(row.cells, np.uint8)
    return found.reshape(-1)


def _wanted(bitmap, bits: int, shared: frozenset, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = bitmap.value, set()
        signs: list[int] = []
        sets: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["sig", "hashes"])

        for batch in batches:
            at = _cell(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), bits)
            keep = ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            for _, hashes in shingle_sets(batch, size, keep):
                if not len(hashes) or (sig := _signature(hashes, shared)) in seen:
                    continue
                seen.add(sig)
                signs.append(sig)
                sets.append(hashes)
                if 8 * sum(map(len, sets[-64:])) > HELD_BYTES or len(sets) == 512:
                    yield made()
                    signs, sets = [], []
        if signs:
            yield made()

    return run


def _screened(pairs: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b: signatures) with passed, whether they pass the length filter and the
    suffix filter, which bounds the overlap by counts of hashes in each range; far, the least
    distance that this bound leaves; and the number of tasks that verify the pairs of ``a``,
    the end that is in more pairs than the other (turned: it was ``b``)."""
    rows, parts = pairs.count(), partitions(pairs.sparkSession)
    for side in ("b", "a"):
        ends = pairs.groupBy(side).agg(F.count("*").alias("held"))
        ends = ends.join(meta.select(F.col("sig").alias(side), F.col("n").alias(f"n_{side}"), F.col("ranges").alias(f"ranges_{side}")), side).withColumn(f"of_{side}", F.col("held"))
        found = join_unique(pairs if side == "b" else found, ends, side, rows, parts)
    found = found.withColumn("most", F.expr("aggregate(zip_with(ranges_a, ranges_b, (x, y) -> least(x, y)), 0, (x, y) -> x + y)"))
    passed = F.expr(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b) and {num + den} * most >= {num} * (n_a + n_b)")
    more, less = (F.expr(f"if(of_a >= of_b, {x}, {y})") for x, y in (("a", "b"), ("b", "a")))
    far = 1 - F.col("most") / (F.col("n_a") + F.col("n_b") - F.col("most"))
    return found.select(more.alias("a"), less.alias("b"), F.expr("of_a < of_b").alias("turned"), passed.alias("passed"), far.alias("far"), (1 + F.greatest("of_a", "of_b") / CENTRE_PAIRS).cast("int").alias("spread"))


def _counted(pairs: DataFrame) -> DataFrame:
    """``pairs`` in the form of ``_screened``, all of them passed."""
    ends = pairs.groupBy("a").agg(F.count("*").alias("held")).withColumn("of_a", F.col("held"))
    found = join_unique(pairs, ends, "a", pairs.count(), partitions(pairs.sparkSession))
    return found.select("a", "b", F.lit(False).alias("turned"), F.lit(True).alias("passed"), F.lit(0.0).alias("far"), (1 + F.col("of_a") / CENTRE_PAIRS).cast("int").alias("spread"))


def _links(spark: SparkSession, scratch: Scratch, texts: DataFrame, meta: DataFrame, pairs: DataFrame, name: str, shared: frozenset, size: int, num: int, den: int, screen: bool = True, last: tuple[str, ...] = ()) -> DataFrame:
    """What is found of ``pairs`` (a, b: signatures): a, b, linked (they reach the threshold),
    and bounds lo and hi of their Jaccard distance, which are equal where the sets were
    compared. The sets are made anew, only for the documents that a filter lets through.
    Without ``screen`` all pairs are compared: of those that the metric leaves open, hardly
    any would not pass the other filters. ``last`` names the tables that only ``pairs`` reads;
    they are removed once it is written."""
    asked = scratch.table(pairs, f"asked_{name}")
    scratch.done(*last)
    if asked.isEmpty():
        return asked.withColumns({"linked": F.lit(False), "lo": F.lit(0.0), "hi": F.lit(1.0)})
    screened = scratch.table(_screened(asked, meta, num, den) if screen else _counted(asked), f"screened_{name}")
    turn = [F.expr(f"if(turned, {x}, {y})").alias(y) for x, y in (("b", "a"), ("a", "b"))]
    missed = screened.filter("not passed").select(*turn, F.lit(False).alias("linked"), F.col("far").alias("lo"), F.lit(1.0).alias("hi"))
    pairs = screened.filter("passed")
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    ids = scratch.table(meta.join(ends, "sig").select("doc_id"), f"ends_{name}")
    bits = min(MOST_FILTER_BITS, max(16, (FILTER_SPARE * ids.count()).bit_length()))
    bitmap = spark.sparkContext.broadcast(id_filter(ids, bits))
    # partitioned by sig once, for both sides of the pairs
    sets = texts.mapInArrow(_wanted(bitmap, bits, shared, size), "sig long, hashes array<long>").dropDuplicates(["sig"])
    members = pairs.join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("set_b")), "b").withColumn("salt", F.pmod(F.xxhash64("b"), "spread"))
    centres = pairs.groupBy("a").agg(F.max("spread").alias("spread")).join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("set_a")), "a")
    centres = centres.select("a", "set_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread").cast("long") - 1)).alias("salt"))
    both = members.drop("spread").join(centres, ["a", "salt"]).withColumn("m", F.size(F.array_intersect("set_a", "set_b"))).withColumn("n", F.size("set_a") + F.size("set_b"))
    away = 1 - F.col("m") / (F.col("n") - F.col("m"))
    compared = both.select(*turn, F.expr(f"{num + den} * m >= {num} * n").alias("linked"), away.alias("lo"), away.alias("hi"))
    found = scratch.table(compared.unionByName(missed), f"links_{name}")
    bitmap.destroy()
    scratch.done(f"asked_{name}", f"screened_{name}", f"ends_{name}")
    return found


def _reaches(i: str, p: str, num: int, den: int) -> str:
    """Length and positional filters for a row of the index (i) and a probe (p)."""
    return f"{i}.pos < {i}.n - ceil({2 * num} * {i}.n / {num + den}) + 1 and {den} * {i}.n >= {num} * {p}.n and least({i}.n - {i}.pos, {p}.n - {p}.pos) >= ceil({num} * ({i}.n + {p}.n) / {num + den})"


def jaccard_components(docs: DataFrame, size: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach). Two documents link when the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``num / den``; words are runs of bytes other
    than white space after lower-casing A-Z.

    A shorter text is one shingle, its whole sequence of words. A null, empty or blank
    text has no shingle and links with nothing, so its component is its own id.
    Repeated rows stay; rows with a null id get the component of their text, which is
    null only if no row with an id is in it. Other columns are not looked at."""
    return _components(docs, size, num, den, text, key)


def _profiles(scratch: Scratch, marked: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame, frozenset]:
    """(the rows with their sets' numbers, one row for each distinct set, the sketch's
    parts, first numbers that unequal sets share). Sets are the same if their sizes and
    both of their numbers are, 128 bits; a first number that says otherwise is replaced."""
    names = marked.columns[2:]
    profiles = scratch.table(marked.mapInArrow(_profiled(size), ", ".join([_PROFILE, *[f"{c} long" for c in names]])), "profiles")
    members = profiles.filter("part is null").select("doc_id", "n", "sig", "second", "ranges", *names)
    kinds = members.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.max("n").alias("n_hi"), F.min("second").alias("second"), F.max("second").alias("second_hi"), F.first("ranges").alias("ranges"), F.count("*").alias("copies"))
    meta = scratch.table(kinds, "meta")
    wrong = "n <> n_hi or second <> second_hi"
    # about (sets)**2 / 2**65 of them: 3 for 10**10 sets
    shared = frozenset(r.sig for r in meta.filter(wrong).select("sig").limit(MOST_SHARED + 1).collect())
    if len(shared) > MOST_SHARED:
        raise RuntimeError("too many sets share a number")
    if shared:
        members = members.withColumn("sig", F.when(F.col("sig").isin(list(shared)), F.col("second")).otherwise(F.col("sig")))
        again = members.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.max("n").alias("n_hi"), F.min("second").alias("second"), F.max("second").alias("second_hi"), F.first("ranges").alias("ranges"), F.count("*").alias("copies"))
        meta = scratch.table(again, "meta_again")
        if not meta.filter(wrong).isEmpty():
            raise RuntimeError("two sets share both numbers")
    return members.drop("second", "ranges"), meta.select("sig", "doc_id", "n", "ranges", "copies"), profiles.filter("part is not null").select("part", "cells"), shared


#: A set's rank and the low bits of its number as one number, which aggregates without a sort.
_CENTRAL = "shiftleft(cast(rank as long), 56) | (sig & 72057594037927935)"


def _shared(scratch: Scratch, rows: DataFrame, salted: bool, parts: int) -> DataFrame:
    """The rows of shingles that are in the prefixes of two sets or more, with lo, the set
    among these whose shingles are the commonest: of a group of near copies, one with few
    changes of its own, to which most others are near."""
    # both uses of ``rows`` read all its columns, so they share one exchange; the sizes say
    # nothing, but keep the columns in both
    groups = rows.groupBy("h", "salt").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.min(F.expr(_CENTRAL)).alias("best"), F.max("n").alias("most_n"), F.max("pos").alias("most_pos"))
    groups = groups.filter("(lo < hi or salt > 0) and most_n > most_pos - 1").select("h", "salt", "best")
    one = Window.partitionBy("h", "salt")  # as they lie after the join
    found = rows.join(groups.hint("shuffle_hash"), ["h", "salt"]).withColumn("lo", F.min(F.when(F.expr(_CENTRAL) == F.col("best"), F.col("sig"))).over(one))
    found = scratch.table(found.drop("best"), "shared")
    if not salted:
        return found
    dealt = scratch.table(found.filter("salt > 0").drop("lo"), "dealt")  # those of frequent shingles
    whole = dealt.groupBy("h").agg(F.min("sig").alias("least"), F.max("sig").alias("hi"), F.min(F.struct("rank", "sig")).alias("m"), F.count("*").alias("held")).filter("least < hi").select("h", F.col("m.sig").alias("lo"), "held")
    whole = join_unique(dealt, whole, "h", dealt.count(), parts)
    return scratch.table(found.filter("salt = 0").unionByName(whole), "all_shared")


def _placed(scratch: Scratch, shared: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The rows of ``_shared`` with the component of their set as root."""
    rows = shared.drop("lo", "root").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    return scratch.table(rows.withColumn("root", F.coalesce("root", "sig")), name)


def _next_star(placed: DataFrame, pick: Column) -> DataFrame:
    """Pairs (a < b), one for each set that is outside the largest component of a shingle's
    sets: it and a set of that component, ``pick`` of them, that it meets in most shingles."""
    by_root = placed.groupBy("h", "root").agg(F.count("*").alias("c"), pick.alias("top"))
    major = by_root.groupBy("h").agg(F.max(F.struct("c", "root", "top")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("h", F.col("m.root").alias("major"), F.col("m.top").alias("top"))
    met = placed.join(major, "h").filter("root <> major").groupBy("sig", "top").count().groupBy("sig").agg(F.max(F.struct("count", "top")).alias("m"))
    return met.select(F.col("m.top").alias("a"), F.col("sig").alias("b")).distinct()


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Those of ``pairs`` that were not compared yet, either way round."""
    ends = lambda x: x.select("*", F.least("a", "b").alias("_1"), F.greatest("a", "b").alias("_2"))
    return ends(pairs).join(ends(tried).select("_1", "_2"), ["_1", "_2"], "left_anti").drop("_1", "_2")


def _pivots(tried: DataFrame) -> DataFrame:
    """For each set the centres that it was compared with, and itself, with bounds of the
    distance: a few for each set, one for each round."""
    near = tried.select(F.col("b").alias("sig"), F.struct(F.col("a").alias("c"), "lo", "hi").alias("t"))
    own = tried.select(F.col("a").alias("sig")).union(tried.select("b")).distinct().select("sig", F.struct(F.col("sig").alias("c"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).alias("t"))
    return near.union(own).groupBy("sig").agg(F.collect_list("t").alias("pivots"))


def _across(scratch: Scratch, placed: DataFrame, pivots: DataFrame, salted: bool, num: int, den: int) -> DataFrame:
    """Pairs of sets in different components that meet in a shingle and pass the filters, each
    one way round. One set of each, a, is outside the component that most sets of the shingle are in,
    so that the inside of a large component is never gone through pair by pair.

    The Jaccard distance is a metric. Two sets that a common centre has been compared with are
    at least as far apart as their distances to it differ, so most sets that share but a
    passage with a group of near copies meet none of its members."""
    counts = placed.groupBy("h", "salt", "root").count()
    by_root = counts.groupBy("h", "root").agg(F.sum("count").alias("c"))
    mixed = by_root.groupBy("h").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("h", F.col("m.root").alias("major"))
    mixed = counts.select("h", "salt").distinct().join(mixed, "h")
    apart = scratch.table(placed.join(mixed, ["h", "salt"]).join(pivots, "sig", "left"), "apart")
    minor = apart.filter("root <> major").select("h", F.col("salt").alias("to"), "sig", "n", "pos", "root", "pivots")
    if salted:
        minor = minor.drop("to").join(apart.select("h", F.col("salt").alias("to")).distinct(), "h")
    reach = 1 - num / den + 1e-9
    far = f"coalesce(exists(x.pivots, t -> exists(y.pivots, u -> t.c = u.c and (t.lo - u.hi > {reach} or u.lo - t.hi > {reach}))), false)"
    first = f"if(y.n < x.n or y.n = x.n and y.sig < x.sig, {_reaches('y', 'x', num, den)}, {_reaches('x', 'y', num, den)})"
    pairs = minor.alias("x").join(apart.alias("y"), F.expr(f"x.h = y.h and x.to = y.salt and x.root <> y.root and (y.root = y.major or x.sig < y.sig) and {first} and not ({far})"))
    found = pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.least("x.sig", "y.sig").alias("_1"), F.greatest("x.sig", "y.sig").alias("_2"))
    return found.dropDuplicates(["_1", "_2"]).select("a", "b")


def _components(docs: DataFrame, size: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, text: str = "text", key: str = "doc_id", marks: tuple = (), salt_rows: int | None = None) -> DataFrame:
    """``jaccard_components``; with ``marks`` (long columns of ``docs``) these are kept, and
    root: a number of the row's component, null for a text without a shingle."""
    spark = docs.sparkSession
    marked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *marks)
    names, parts = marked.columns[2:], partitions(spark, docs)
    texts = marked.select("doc_id", "text")
    with Scratch(spark) as scratch:
        members, meta, cells, twins = _profiles(scratch, marked, size)
        counts = _sketch(cells)
        usual = int(np.median(counts))
        if salt_rows is None:
            every = float(np.bincount(counts, minlength=256) @ _counts(np.arange(256)))
            salt_rows = max(SALT_ROWS, int(every * (den - num) / den / (4 * parts)))
        salted = bool(_spread(counts.max(keepdims=True), usual, salt_rows)[0] > 1)
        sketch = spark.sparkContext.broadcast(counts)
        rows = texts.mapInArrow(_prefixes(sketch, usual, salt_rows, twins, size, num, den), "h long, sig long, packed long, salt int").repartition(parts, "h", "salt")
        shared = _shared(scratch, _unpacked(rows), salted, parts)
        sketch.destroy()
        scratch.done()

        star = shared.filter("sig <> lo").groupBy(F.col("sig").alias("b"), F.col("lo").alias("a")).count()
        star = star.groupBy("b").agg(F.max(F.struct("count", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        tried = _links(spark, scratch, texts, meta, star, "star", twins, size, num, den)
        roots = scratch.table(graph.components(tried.filter("linked")), "roots")

        # sets that their first centre missed try another one, before all pairs are made
        placed, held = _placed(scratch, shared, roots, "placed"), "placed"
        scratch.done("shared", *("dealt", "all_shared") * salted)
        more = _links(spark, scratch, texts, meta, _untried(_next_star(placed, F.max("sig")), tried), "next", twins, size, num, den)
        tried = tried.unionByName(more)
        if not more.filter("linked").isEmpty():
            roots = scratch.table(graph.components(tried.filter("linked")), "roots_next")
            placed, held = _placed(scratch, placed, roots, "placed_next"), "placed_next"
            scratch.done("placed")

        rest = _untried(_across(scratch, placed, _pivots(tried), salted, num, den), tried)
        more = _links(spark, scratch, texts, meta, rest, "rest", twins, size, num, den, screen=False, last=("apart", held)).filter("linked")
        if not more.isEmpty():
            roots = scratch.table(graph.components(tried.filter("linked").unionByName(more)), "all_roots")

        named = scratch.table(meta.select("sig", "doc_id", "copies").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "named")
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("held"))
        named = scratch.table(join_unique(named.drop("doc_id"), least, "root", named.count(), parts), "components")
        full = members.filter("n > 0")
        found = join_unique(full, named.withColumnRenamed("copies", "held"), "sig", full.count(), parts)
        found = found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "root", *names)
        found = found.union(members.filter("n = 0").select("doc_id", "n", "doc_id", F.lit(None).cast("long"), *names))
        return (found if names else found.drop("root")).checkpoint()


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with marks before them until no column of ``docs`` has them."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options: int) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id (rows without an
    id come last), then the smallest text hash. It is decided for each row: rows of one id
    with unrelated texts are in different components and stay. A text without a shingle
    is a component with the rows of its id that have none either; without an id it stays.
    All columns are kept, whatever their names; an empty table stays empty."""
    # a row's component depends on its text only, so the id and a 128-bit hash name it
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    found = _components(docs, text=text, key=key, marks=(h1.alias("_h1"), h2.alias("_h2")), **options)
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "_h1", "_h2")
    rows = found.select("root", F.when(F.col("root").isNull(), F.col("doc_id")).alias("own"), row.alias("m"))
    best = rows.filter("root is not null or own is not null").groupBy("root", "own").agg(F.min("m").alias("m")).select("m.*")
    blank = rows.filter("root is null and own is null").select("m.*", F.lit(True).alias("all")).distinct()
    chosen = best.withColumn("all", F.lit(False)).union(blank)
    last, first, one, two, every = keys = unused(docs, "_last", "_id", "_h1", "_h2", "_all")
    id_ = F.col(key).cast("long")
    docs = docs.withColumns({last: id_.isNull(), first: F.coalesce(id_, F.lit(0)), one: h1, two: h2}).join(chosen.toDF(*keys), keys[:4])
    once = docs.filter(~F.col(every)).dropDuplicates(keys[:4])
    return once.unionByName(docs.filter(every)).drop(*keys)

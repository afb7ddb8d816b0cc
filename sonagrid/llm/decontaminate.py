"""Benchmark decontamination by spaced seeds.

A mask picks some of the places of a run of words and ignores the others, so the hash
under it is unmoved by substitutions at the ignored places. The masks below were chosen
by search: any run of 14 to ``WINDOW`` = 20 words with at most a fifth of them
substituted agrees with its original under one of them. Hashes of benchmark items and of documents are
joined; around each hit, the aligned words are compared, and a window of 20 words (or a
whole shorter item) of which four fifths agree is a leak.

Documents send only what can match: their hashes are looked up in a filter of the
benchmark's hashes, which is exact up to ``MOST_EXACT`` of them (checked) and a bitmap
of fixed size beyond. The words around hits are sent in blocks, once a block.

The thorough form, which the query and the pipeline use, also finds short items with a
fifth substituted, items under 5 words, and parts of items of 13 words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sonagrid.llm import near, spans

#: Places that each mask looks at.
MASKS = ((0, 1, 3, 5, 6, 8), (0, 2, 3, 6, 7, 8), (0, 2, 5, 10, 11, 12), (0, 1, 2, 6, 7, 10))
#: Likewise for items of 5 to 12 words with a fifth substituted.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
SPAN = 1 + max(m[-1] for m in MASKS)
WINDOW = 20
SHARE = 0.8
#: Unless thorough, items of fewer words than this are too common to be evidence of a
#: leak, and items up to SPAN words have to stand in a document word for word.
LEAST_WORDS = 5
#: Words of an item that are evidence of a leak, where the thorough form finds a part.
PART_WORDS = 13
BLOCK_WORDS = 64
MOST_EXACT = 2_000_000
BITMAP_BITS = 28
#: Rows of seeds that are sent to all executors at most, rather than shuffled.
MOST_SENT = 200_000


def _words(text: str):
    return F.lower(F.col(text)).cast("binary")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = spans.column_bytes(batch.column(1))
    for lo, hi in spans.slices(offsets):
        low = data[offsets[lo] : offsets[hi]]
        starts, ends, first = spans.word_spans(spans.ALNUM[low], offsets[lo : hi + 1] - offsets[lo])
        words = spans.span_hash(low, starts, ends)
        for k in range(hi - lo):
            yield lo + k, words[first[k] : first[k + 1]]


def _seed_hashes(words: np.ndarray, masks: tuple[int, ...], lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes under those of all masks that are asked for, then those of whole runs of
    each of ``lengths``."""
    every = MASKS + SHORT_MASKS
    found = [spans.window_hash(words, every[k][-1] + 1, every[k]) ^ np.uint64(k + 1) for k in masks]
    return found + [spans.window_hash(words, n) ^ np.uint64(1 << 20 | n) for n in lengths]


_LONG, _SHORT = tuple(range(len(MASKS))), tuple(range(len(MASKS), len(MASKS + SHORT_MASKS)))


def _item_seeds(n: int, thorough: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Masks and lengths for an item of ``n`` words."""
    if n < LEAST_WORDS:
        return (), (n,) if thorough and n else ()
    if not thorough:
        return (_LONG, ()) if n > SPAN else ((), (n,))
    return (_LONG if n >= SPAN else _SHORT), ()


def _item_rows(thorough: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _texts(batch):
                n = len(words)
                if not any(asked := _item_seeds(n, thorough)):
                    continue
                seeds = _seed_hashes(words, *asked)
                h = np.concatenate(seeds)
                at = np.concatenate([np.arange(len(s)) for s in seeds])
                many = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * many, pa.int64()), pa.array([n] * many, pa.int32()), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array([words.view(np.int64)] + [None] * (many - 1), pa.list_(pa.int64()))], ["item_id", "n", "h", "at", "words"])

    return run


class Filter:
    """Whether a hash may be one of the benchmark's."""

    def __init__(self, exact: np.ndarray | None, bitmap: np.ndarray | None) -> None:
        self.exact, self.bitmap = exact, bitmap

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bitmap is not None:
            at = near._cell(h.view(np.int64), BITMAP_BITS)
            return (self.bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        if not len(self.exact):
            return np.zeros(len(h), bool)
        # most hashes are ruled out by their high bits before they are searched for
        some = np.flatnonzero(self.high[(h >> np.uint64(44)).astype(np.int64)])
        found = self.exact[np.minimum(np.searchsorted(self.exact, h[some]), len(self.exact) - 1)] == h[some]
        out = np.zeros(len(h), bool)
        out[some[found]] = True
        return out

    @property
    def high(self) -> np.ndarray:
        if not hasattr(self, "_high"):
            self._high = np.zeros(1 << 20, bool)
            self._high[(self.exact >> np.uint64(44)).astype(np.int64)] = True
        return self._high


_HITS = "row long, doc_id long, h long, at int, block int, words array<long>"


def _doc_rows(sent, masks: tuple[int, ...], lengths: tuple[int, ...]):
    """Rows are numbered, as ids may be null or repeated; the result is checkpointed, so that
    the numbers stay."""
    names = [x.split()[0] for x in _HITS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, number = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0)
            rows, hs, ats = [], [], []
            of_block, blocks, lists = [], [], []
            for row, words in _texts(batch):
                mine = []
                for k, h in enumerate(_seed_hashes(words, masks, lengths)):
                    if not len(h) or not len(at := np.flatnonzero(may(h))):
                        continue
                    if k >= len(masks) and lengths[k - len(masks)] < LEAST_WORDS:
                        # a whole short item: its first place says all
                        at = at[np.unique(h[at], return_index=True)[1]]
                    rows.append(np.full(len(at), row))
                    hs.append(h[at].view(np.int64))
                    ats.append(at.astype(np.int32))
                    mine.append(at // BLOCK_WORDS)
                for b in np.unique(np.concatenate(mine)).tolist() if mine else ():
                    of_block.append(row)
                    blocks.append(b)
                    lists.append(words[max(0, b * BLOCK_WORDS - WINDOW) : (b + 1) * BLOCK_WORDS + WINDOW + SPAN].view(np.int64))
            if rows:
                row, at = np.concatenate(rows), np.concatenate(ats)
                hits = (pa.array(number + row), keys.take(pa.array(row)), pa.array(np.concatenate(hs)), pa.array(at), pa.array((at // BLOCK_WORDS).astype(np.int32)), pa.nulls(len(at), kinds[5]))
                yield pa.RecordBatch.from_arrays(list(hits), names)
                many = len(blocks)
                around = (pa.array(number + np.array(of_block)), keys.take(pa.array(of_block)), pa.nulls(many, kinds[2]), pa.nulls(many, kinds[3]), pa.array(blocks, kinds[4]), pa.array(lists, kinds[5]))
                yield pa.RecordBatch.from_arrays(list(around), names)
            number += batch.num_rows

    return run


def _window(same: np.ndarray, n: int, share: float, thorough: bool) -> tuple[float, int] | None:
    """(agreement, place) of a leak in the equal places of an aligned item of ``n`` words."""
    size = min(WINDOW, n)
    if thorough and PART_WORDS <= len(same) < size:
        size = len(same)  # the document starts or ends inside the item
    if len(same) < size:
        return None
    sums = np.concatenate(([0], np.cumsum(same)))
    counts = sums[size:] - sums[:-size]
    top = int(counts.argmax())
    if counts[top] >= (share * size if n > SPAN or thorough and n >= LEAST_WORDS else size):
        return counts[top] / size, top
    if thorough and size > PART_WORDS:
        whole = np.flatnonzero(sums[PART_WORDS:] - sums[:-PART_WORDS] == PART_WORDS)
        if len(whole):
            return 1.0, int(whole[0])
    return None


def _aligned(share: float, thorough: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            ids, items, best, firsts = [], [], [], []
            block, shift = col["block"].to_numpy(), col["shift"].to_numpy()
            for k in range(batch.num_rows):
                doc, item = col["doc_words"][k].values.to_numpy(), col["item_words"][k].values.to_numpy()
                origin = max(0, int(block[k]) * BLOCK_WORDS - WINDOW)
                lo = int(shift[k]) - origin  # where the item's first word falls in the block
                a, b = max(0, -lo), min(len(item), len(doc) - lo)
                if b <= a:
                    continue
                found = _window(item[a:b] == doc[a + lo : b + lo], len(item), share, thorough)
                if found:
                    ids.append(col["doc_id"][k].as_py())
                    items.append(col["item_id"][k].as_py())
                    best.append(found[0])
                    firsts.append(int(shift[k]) + a + found[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(best, pa.float64()), pa.array(firsts, pa.int64())], ["doc_id", "item_id", "agreement", "first_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text: str = "text", key: str = "doc_id", item: str = "item_id", thorough: bool = True) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id,
    agreement (the largest share of equal words in an aligned window) and first_word (the
    first place of such a window, words from 0).

    Words are runs of letters and digits in lower case. Null or empty texts and items,
    and items of fewer than ``LEAST_WORDS`` words, match nothing; repeated rows count
    once; a null doc_id or item_id stays as a value; other columns are not looked at, so
    their names may clash. Texts of any length are searched whole.

    ``thorough``: items of ``LEAST_WORDS`` or more match by ``share`` too, shorter ones word
    for word; so do ``PART_WORDS`` words of an item in a row, and by ``share`` that many or
    more where the document starts or ends inside the item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _words(text).alias("text"))
    made = benchmark.select(F.col(item).cast("long").alias("item_id"), _words(text).alias("text")).mapInArrow(_item_rows(thorough), "item_id long, n int, h long, at int, words array<long>").checkpoint()
    seeds = made.select("h", "item_id", F.col("at").alias("item_at"))
    short = [r.n for r in made.filter(F.col("n") <= SPAN).select("n").distinct().collect()]  # lengths up to SPAN
    asked = [_item_seeds(n, thorough) for n in [*short, SPAN + 1]]
    masks, lengths = (tuple(sorted({x for a in asked for x in a[k]})) for k in (0, 1))
    few = made.select("h").distinct().limit(MOST_EXACT + 1).count() <= MOST_EXACT
    if few:
        # at most MOST_EXACT numbers, as one column
        held = made.select("h").distinct().toArrow().column(0).to_numpy()
        may = Filter(np.unique(held.view(np.uint64)), None)
    else:
        may = Filter(None, near.id_filter(made.select("h"), BITMAP_BITS))
    found = rows.mapInArrow(_doc_rows(spark.sparkContext.broadcast(may), masks, lengths), _HITS).checkpoint()
    hits = found.filter("h is not null").select("row", "doc_id", "h", "at", "block")
    if seeds.limit(MOST_SENT + 1).count() <= MOST_SENT:
        seeds = F.broadcast(seeds)
    lines = hits.join(seeds, "h").select("row", "doc_id", "item_id", "block", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    blocks = found.filter("h is null").select("row", "block", F.col("words").alias("doc_words"))
    items = made.filter("words is not null").select("item_id", F.col("words").alias("item_words"))
    both = lines.join(blocks, ["row", "block"])
    both = both.alias("l").join(items.alias("i"), F.expr("l.item_id <=> i.item_id")).select("l.*", "item_words")
    kept = both.mapInArrow(_aligned(share, thorough), "doc_id long, item_id long, agreement double, first_word long")
    best = F.max(F.struct("agreement", (-F.col("first_word")).alias("f")))
    return kept.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", F.col("m.agreement").alias("agreement"), (-F.col("m.f")).alias("first_word"))

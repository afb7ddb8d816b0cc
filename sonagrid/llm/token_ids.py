"""Token ids of whole documents in a directly addressable binary form.

``write`` deals the documents by ranges of doc_id, encodes them and appends the ids of
each run of documents to a segment, a ``dac`` array. A segment is a row of a Parquet
folder, so that Spark's committers write it: a lost executor leaves no half file, and
any store will do. Part files and their segments are in ascending order of doc_id.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonagrid.llm import dac, ragged, spans
from sonagrid.llm.store import partitions

END_ID = 1
#: A segment ends with the document that takes it to so many ids.
SEGMENT_IDS = 1 << 19
#: Distinct pieces whose ids a worker remembers; beyond that, those not met for longest go.
REMEMBERED = 1 << 20
#: Longer pieces come once; they are not remembered.
LONGEST = 64
#: Words that are encoded in one text.
TOGETHER = 64
SLICE = 4 << 20

_SEGMENT = "part int, seq int, n_ids long, doc_ids array<long>, counts array<long>, codes binary"
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[33:127] = _MARK
    table[65:91] = table[97:123] = _LETTER
    table[48:58] = _DIGIT
    table[list(b" \t\n\r")] = _SPACE
    return table


_CLASSES = _byte_classes()


def pieces(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first piece of each text) of pieces whose ids do not depend on
    what stands around them, for a tokenizer that lower-cases after NFC, drops white space
    and splits letters, single digits, contractions and other marks.

    Texts are cut at white space and between ASCII characters of two classes or two digits,
    so that no combining mark loses its base; a quote stays with the letters after it, as
    they may be a contraction. ASCII letters are lowered but for those before another
    character, with which NFC could join them. A piece that holds one of the ``special``
    tokens, which are found before all that, stays as it is."""
    n = len(data)
    low = spans.LOWER[data]
    if n > 1:
        apart = np.flatnonzero((low[:-1] != data[:-1]) & (data[1:] >= 0x80))
        low[apart] = data[apart]
    kind = _CLASSES[low]
    kept = kind != _SPACE
    cuts = np.zeros(n, bool)
    if n > 1:
        a, b = kind[:-1], kind[1:]
        cuts[1:] = (a != _OTHER) & (b != _OTHER) & ((a != b) | (a == _DIGIT)) & ~((low[:-1] == ord("'")) & (b == _LETTER))
    text = low.tobytes() if special else b""
    for token in special:
        at = text.find(token.lower())
        while at >= 0:
            lo, hi = at, at + len(token)
            while lo > 0 and kept[lo - 1]:
                lo -= 1
            while hi < n and kept[hi]:
                hi += 1
            low[lo:hi] = data[lo:hi]
            cuts[lo:hi] = False
            at = text.find(token.lower(), hi)
    return low, *spans.word_spans(kept, offsets, cuts)


_NAMES = ("hashes", "sizes", "counts", "met", "begins", "firsts")
_KEPT = (np.uint64, np.int16, np.int16, np.int32, np.int32, np.int32)


class Memory:
    """Ids of pieces met before, in the order of the hashes of their bytes. The bytes are
    compared too, so that a hash that two pieces share does no harm."""

    def __init__(self, most: int | None = None, kind: type = np.uint32) -> None:
        """``kind`` holds an id."""
        self.most = most or REMEMBERED
        # what is kept of a piece in few bytes: places are below ``most`` * LONGEST ids or bytes
        self.hashes, self.sizes, self.counts, self.met, self.begins, self.firsts = (np.zeros(0, t) for t in _KEPT)
        self.raw, self.ids, self.now = np.zeros(0, np.uint8), np.zeros(0, kind), 0

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        self.now += 1
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            some = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
            some = some[ragged.same_bytes(data, starts[some], self.raw, self.begins[at[some]], sizes[some])]
            out[some] = at[some]
            self.met[out[some]] = self.now
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Pieces that were not found, and their ids, end to end. Long ones and those that
        share a hash with another are left out."""
        firsts = np.cumsum(counts) - counts
        _, once = np.unique(hashes, return_index=True)
        once = once[sizes[once] <= LONGEST]
        if len(self.hashes):
            once = once[self.hashes[np.minimum(np.searchsorted(self.hashes, hashes[once]), len(self.hashes) - 1)] != hashes[once]]
        if len(self.hashes) + len(once) > self.most:
            self._forget()
            once = once[: self.most - len(self.hashes)]
        more, added = ragged.take(data, sizes, once, starts)
        given, lengths = ragged.take(ids, counts, once, firsts)
        columns = (hashes[once], added, lengths, np.full(len(once), self.now), len(self.raw) + np.cumsum(added) - added, len(self.ids) + np.cumsum(lengths) - lengths)
        order = np.argsort(np.concatenate((self.hashes, columns[0])), kind="stable")  # two sorted runs
        for name, new, kind in zip(_NAMES, columns, _KEPT, strict=True):
            setattr(self, name, np.concatenate((getattr(self, name), new.astype(kind)))[order])
        self.raw, self.ids = np.concatenate((self.raw, more)), np.concatenate((self.ids, given.astype(self.ids.dtype)))

    def _columns(self) -> tuple[np.ndarray, ...]:
        return tuple(getattr(self, name) for name in _NAMES)

    def _forget(self) -> None:
        """Keeps the half of the pieces that were met last."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        self.raw, _ = ragged.take(self.raw, self.sizes, kept, self.begins)
        self.ids, _ = ragged.take(self.ids, self.counts, kept, self.firsts)
        self.hashes, self.sizes, self.counts, self.met = (x[kept] for x in self._columns()[:4])
        self.begins, self.firsts = ((np.cumsum(x, dtype=np.int64) - x).astype(np.int32) for x in (self.sizes, self.counts))


def give_back() -> None:
    """Hands what a worker has freed back to the system, where its C library can: a worker
    lives on between tasks, and what lies between used pieces of its heap would stay."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class _Encoder:
    """Ids of whole texts, from the ids of their distinct pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        #: Whether an id ends a word, which every word has one of.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.memory = Memory()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each)."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [x for f in found for x in f.ids]
        return np.array(ids, np.uint32), np.array([len(f) for f in found], np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of one word each: joined, they share what a call costs."""
        ids, _ = self.encode([" ".join(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(texts):
            return self.encode(texts)
        return ids, np.diff(ends, prepend=0)

    def fresh(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each), where those of one word are encoded together."""
        texts = [low[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        single = np.array([t.isalpha() for t in texts], bool)
        counts, begins = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, held = [np.zeros(0, np.uint32)], 0
        for some, encode in ((np.flatnonzero(single), self.words), (np.flatnonzero(~single), self.encode)):
            for at in range(0, len(some), 4096):
                mine = some[at : at + 4096]
                ids, sizes = encode([texts[k] for k in mine.tolist()])
                counts[mine], begins[mine] = sizes, held + np.cumsum(sizes) - sizes
                parts.append(ids)
                held += len(ids)
        return ragged.take(np.concatenate(parts), counts, np.arange(len(counts)), begins)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text)."""
        low, starts, ends, first = pieces(data, offsets, self.special)
        index, kind, hashes = ragged.distinct(low, starts, ends)
        starts, sizes = starts[index], (ends - starts)[index]
        known = self.memory.find(hashes, low, starts, sizes)
        new = np.flatnonzero(known < 0)
        more, lengths = self.fresh(low, starts[new], sizes[new])
        # all ids that this slice needs: those remembered, then those made now
        old = np.flatnonzero(known >= 0)
        held, taken = ragged.take(self.memory.ids, self.memory.counts, known[old], self.memory.firsts)
        counts, begins = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        counts[old], counts[new] = taken, lengths
        begins[old], begins[new] = np.cumsum(taken) - taken, len(held) + np.cumsum(lengths) - lengths
        if len(new):
            self.memory.add(hashes[new], low, starts[new], sizes[new], more, lengths)
        every, sizes = ragged.take(np.concatenate((held, more)), counts, kind, begins)
        totals = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        return every, np.diff(totals[first])


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One encoder for each Python worker: reading a vocabulary takes longer than a task
    takes for its texts, and common pieces come again in every task."""
    return _Encoder(path)


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[part], [seq], [len(ids)], [list(keys)], [list(counts)], [dac.encode(ids)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "seq", "n_ids", "doc_ids", "counts", "codes"])

        for batch in batches:
            data, offsets = spans.column_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for lo, hi in spans.slices(offsets, SLICE):
                ids, sizes = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cut = np.cumsum(sizes)
                full = np.insert(ids, cut, end_id).astype(np.uint32)
                ends = cut + np.arange(1, hi - lo + 1)
                begin = 0
                for k in range(hi - lo):
                    keys.append(names[lo + k])
                    counts.append(int(sizes[k]) + 1)
                    done = k == hi - lo - 1
                    if done or ends[k] - begin + sum(map(len, held)) >= SEGMENT_IDS:
                        held.append(full[begin : ends[k]])
                        begin = int(ends[k])
                        if sum(map(len, held)) >= SEGMENT_IDS:
                            yield segment()
                            seq += 1
                            keys, counts, held = [], [], []
        if keys:
            yield segment()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> None:
    """Writes the ids of every document, each followed by ``end_id``, in ascending order
    of doc_id (equal ids: of text; null ids first). A null text is empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession, rows), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_segments(tokenizer, end_id), _SEGMENT).write.option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, at = dac.Codes(row["codes"]), 0
            starts, sums = [], []
            for n in row["counts"]:
                starts.append(at)
                sums.append(zlib.crc32(codes.slice(at, at + n).astype("<u4").tobytes()))
                at += n
            many = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * many, pa.int32()), pa.array([row["seq"]] * many, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids_crc32.

    ``start`` needs the ids before each segment. They are summed in two levels, by part
    file and within one, so that no window runs over all segments."""
    segments = spark.read.schema(_SEGMENT).parquet(folder)
    sizes = segments.select("part", "seq", "n_ids")
    before = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = before.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("of_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    begins = sizes.withColumn("of_seq", inside).join(before, "part").select("part", "seq", (F.col("of_part") + F.col("of_seq")).alias("begin"))
    found = segments.mapInArrow(_read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(begins, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

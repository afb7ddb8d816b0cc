"""Alignment of the tokens of two tokenizers, and corpus-wide counts of the pairs they link.

A is a byte-level BPE of the ``tokenizers`` library over a space and the text; B is a
sentencepiece model, which adds that space itself. Byte offsets where tokens of both end cut
the tokens into groups; every A and every B token of a group are linked. The count of a pair
of ids is the number of documents that hold it linked.

1. Each slice of documents (a block) is encoded once. Texts are cut before spaces where
   neither tokenizer joins anything, and a worker remembers the ids of such units. The ids of
   a block are written, two bytes each.
2. Blocks are aligned. Each sends its distinct pairs to shards, by A id, with the number of
   its documents that hold them.
3. A shard gathers its distinct pairs and makes a minimal perfect hash of them, beside the
   pairs in the order of their hashes, by which every look-up is verified. The universe of
   pairs is fixed by the vocabularies, and so is the largest shard.
4. Counts are dense vectors in the order of the hash. They are summed in two levels: within
   runs of blocks of a shard, then over those. All pairs of an A id are in one shard, which
   therefore knows the highest count of each A id.
5. Blocks are aligned again. What their pairs count is looked up in the shards, and goes back
   to the block.

Nothing here is broadcast but the names of the vocabulary files, and no task holds more than a
block, or a shard and a run of what blocks ask it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.llm import mph, ragged, spans
from sonagrid.llm.store import Scratch, partitions
from sonagrid.llm.token_ids import Memory, give_back

#: Bytes of texts in a block, or one longer text.
BLOCK_BYTES = 1 << 20
#: Units whose ids a worker remembers.
REMEMBERED = 1 << 19
#: Units that are encoded in one text.
TOGETHER = 64
#: Links of a group that are made one by one; in larger groups equal ones are made once.
PLAIN_LINKS = 1 << 12
#: Blocks whose questions to a shard are answered in one group.
BLOCKS_A_RUN = 1024
#: Shards for each partition, so that they are dealt evenly.
SHARDS = 4

_BLOCKS = "block long, doc_ids array<long>, n_a array<int>, n_b array<int>, a binary, b binary"
_WANTED = "block long, shard int, run int, pairs binary, docs binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


def _cut_before(data: np.ndarray) -> np.ndarray:
    """Whether a unit may begin at each byte: at a space after a character that is surely not
    white space (visible ASCII, or letters of two or three bytes from blocks without any)."""
    n = len(data)
    out = np.zeros(n, bool)
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    last = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    sure = (last > 0x20) & (last < 0x7F) | (last >= 0x80) & ((two >= 0xC3) & (two <= 0xDF) | (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three <= 0xED))
    out[at[sure]] = True
    return out


class _Encoder:
    """Ids of both tokenizers for whole texts, from those of their distinct units. The
    memory holds a unit's ids as the number of A ids, the A ids and the B ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_of_char()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [special[i] if i in special else bytes(table[c] for c in names.get(i, "")) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids take two bytes here")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.memory = Memory(REMEMBERED, np.uint16)  # it holds units of at most LONGEST bytes

    def _both(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        found = self.a.encode_batch_fast(texts, add_special_tokens=False)
        # B adds the first space, but not to an empty text: a space at the end of a text
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [(x.ids, y if len(t) > 1 else [self.b.piece_to_id("▁")]) for t, x, y in zip(texts, found, b, strict=True)]

    def _parted(self, texts: list[bytes]) -> list[tuple[list[int], list[int]]] | None:
        """Ids of units that are encoded as one text; None if its ids do not part there."""
        ends = np.cumsum([len(t) for t in texts])
        out = []
        for ids, sizes in zip(self._both([b"".join(texts).decode()])[0], (self.a_size, self.b_size), strict=True):
            at = np.cumsum(sizes[ids])
            cut = np.searchsorted(at, ends)
            if cut[-1] >= len(at) or not np.array_equal(at[cut], ends):
                return None
            out.append([ids[i:j] for i, j in zip([0, *(cut[:-1] + 1).tolist()], (cut + 1).tolist(), strict=True)])
        return list(zip(*out, strict=True))

    def _entry(self, unit: bytes, a: list[int], b: list[int]) -> list[int]:
        same = b"".join([self.a_bytes[i] for i in a]) == unit == b"".join([self.b_bytes[i] for i in b])
        return [len(a), *a, *b] if same else [0]

    def fresh(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of all units end to end, size of each)."""
        units = [data[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        entries: list[list[int]] = [[] for _ in units]
        joined, single = [], []
        for k, u in enumerate(units):
            # visible ASCII at its end: the next unit's space begins a word
            (joined if 0x20 < u[-1] < 0x7F and u[:1] == b" " and u.isascii() else single).append(k)
        for at in range(0, len(joined), TOGETHER):
            mine = joined[at : at + TOGETHER]
            found = self._parted([units[k] for k in mine])
            if found is None:
                single += mine
                continue
            for k, (a, b) in zip(mine, found, strict=True):
                entries[k] = self._entry(units[k], a, b)
        for at in range(0, len(single), 1024):
            mine = single[at : at + 1024]
            for k, (a, b) in zip(mine, self._both([units[k].decode("utf-8", "replace") for k in mine]), strict=True):
                entries[k] = self._entry(units[k], a, b)
        counts = np.array([len(e) for e in entries], np.int64)
        return np.array([x for e in entries for x in e], np.uint32), counts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(A ids of all texts, B ids, number of A ids of each text, number of B ids). A text
        that is empty or has a unit whose tokens do not spell it has none."""
        some = np.flatnonzero(np.diff(offsets) > 0)
        n = len(offsets) - 1
        if not len(some):
            none = np.zeros(0, np.uint16)
            return none, none, np.zeros(n, np.int32), np.zeros(n, np.int32)
        data = np.insert(data, offsets[some], 0x20)  # the space before each text
        offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        starts, ends, first = spans.word_spans(np.ones(len(data), bool), offsets, _cut_before(data))
        index, kind, hashes = ragged.distinct(data, starts, ends)
        begins, sizes = starts[index], (ends - starts)[index]
        known = self.memory.find(hashes, data, begins, sizes)
        new, old = np.flatnonzero(known < 0), np.flatnonzero(known >= 0)
        more, lengths = self.fresh(data, begins[new], sizes[new])
        held, taken = ragged.take(self.memory.ids, self.memory.counts, known[old], self.memory.firsts)
        counts, at = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        counts[old], counts[new] = taken, lengths
        at[old], at[new] = np.cumsum(taken) - taken, len(held) + np.cumsum(lengths) - lengths
        if len(new):
            self.memory.add(hashes[new], data, begins[new], sizes[new], more, lengths)
        every, sizes = ragged.take(np.concatenate((held, more)), counts, kind, at)
        heads = np.cumsum(sizes) - sizes
        of_a = every[heads].astype(np.int64)  # A ids of each unit
        text = np.repeat(np.arange(n), np.diff(first))
        bad = np.zeros(n, bool)
        bad[text[of_a == 0]] = True
        place = np.arange(len(every)) - np.repeat(heads, sizes)
        good = np.repeat(~bad[text], sizes) & (place > 0)
        is_a = place <= np.repeat(of_a, sizes)
        n_a = np.where(bad, 0, np.bincount(text, of_a, n)).astype(np.int32)
        n_b = np.where(bad, 0, np.bincount(text, sizes - 1 - of_a, n)).astype(np.int32)
        return every[good & is_a].astype(np.uint16), every[good & ~is_a].astype(np.uint16), n_a, n_b


@lru_cache(maxsize=1)
def _encoder(a_path: str, b_path: str) -> _Encoder:
    return _Encoder(a_path, b_path)


@lru_cache(maxsize=1)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    known = _encoder(a_path, b_path)
    return known.a_size, known.b_size


def _let_go() -> None:
    """A worker outlives its tasks. Once blocks are encoded, it needs no encoder."""
    if _encoder.cache_info().currsize:
        _encoder.cache_clear()
        give_back()


def _token_sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of A and of B."""
    sizes = _sizes(a_path, b_path)
    _let_go()
    return sizes


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unzip(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _encoded(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = _encoder(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = spans.column_bytes(batch.column(1))
            for lo, hi in spans.slices(offsets, BLOCK_BYTES):
                a, b, n_a, n_b = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row = ([part << 32 | seq], [batch.column(0)[lo:hi].to_pylist()], [n_a], [n_b], [_zip(a)], [_zip(b)])
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "n_a", "n_b", "a", "b"])
                seq += 1
            give_back()

    return run


class Groups:
    """The groups of a block's tokens, by the byte offsets where both tokenizers end one."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a, self.b, self.docs = a.astype(np.int64), b.astype(np.int64), len(n_a)
        ends_a, ends_b = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.in_a, self.in_b = (np.bincount(np.searchsorted(cuts, x), minlength=len(cuts)) for x in (ends_a, ends_b))
        # tokens of one text end where it ends, so no group holds tokens of two
        last_a = np.cumsum(self.in_a)
        self.doc = np.searchsorted(np.cumsum(n_a), last_a)
        self.links = self.in_a * self.in_b
        self.first_a, self.first_b = last_a - self.in_a, np.cumsum(self.in_b) - self.in_b

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, A id << 16 | B id, number of links) of all links; equal links of a large
        group come once."""
        plain = np.flatnonzero(self.links <= PLAIN_LINKS)
        many = self.links[plain]
        group = np.repeat(plain, many)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
        wide = self.in_b[group]
        keys = self.a[self.first_a[group] + inside // wide] << 16 | self.b[self.first_b[group] + inside % wide]
        found = [(self.doc[group], keys, np.ones(len(group), np.int64))]
        for g in np.flatnonzero(self.links > PLAIN_LINKS).tolist():
            (x, n), (y, m) = (np.unique(ids[at : at + k], return_counts=True) for ids, at, k in ((self.a, self.first_a[g], self.in_a[g]), (self.b, self.first_b[g], self.in_b[g])))
            found.append((np.full(len(x) * len(y), self.doc[g]), (x[:, None] << 16 | y).reshape(-1), (n[:, None] * m).reshape(-1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        values, sizes = _decimals()
        n = self.in_a + self.in_b
        order_a = np.arange(len(self.a)) + np.repeat(self.first_b, self.in_a)  # A ids, then B ids
        order_b = np.arange(len(self.b)) + np.repeat(self.first_a + self.in_a, self.in_b)
        items = np.empty(len(self.a) + len(self.b), np.int64)
        items[order_a], items[order_b] = self.a * 3, self.b * 3
        ends = np.cumsum(n)
        items[ends - self.in_b - 1] += 1  # a bar after the last A id
        items[ends - 1] += 2  # a semicolon after the last B id
        written, lengths = ragged.take(values, sizes, items)
        at = np.concatenate(([0], np.cumsum(lengths)))
        last = np.searchsorted(self.doc, np.arange(self.docs), side="right")  # groups up to each text
        items_up_to = np.concatenate(([0], ends))[last]
        cut = at[items_up_to].tolist()
        raw = written.tobytes()
        return [raw[i : max(i, j - 1)].decode() for i, j in zip([0, *cut[:-1]], cut, strict=True)]


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Each number of two bytes in decimal, with a comma, a bar and a semicolon after it."""
    words = [f"{k}{mark}".encode() for k in range(1 << 16) for mark in ",|;"]
    return np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By A id, so that all pairs of one are together."""
    return (spans.mix((keys >> 16).astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % shards


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, _unzip(row["a"], np.uint16), _unzip(row["b"], np.uint16), np.array(row["n_a"], np.int64), np.array(row["n_b"], np.int64)


def _distinct(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in the order of shards, place of each key among them, their shards)."""
    place, kinds = pd.factorize(keys)
    shard = _shard(kinds, shards)
    order = np.lexsort((kinds, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[place], shard[order]


def _wanted(a_path: str, b_path: str, shards: int, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _token_sizes(a_path, b_path)
        for row, a, b, n_a, n_b in _block_rows(batches):
            doc, keys, _ = Groups(a, b, n_a, n_b, *sizes).pairs()
            if not len(keys):
                continue
            kinds, place, shard = _distinct(keys, shards)
            once = np.sort(doc * len(kinds) + place)  # a pair counts once for each text
            once = once[np.concatenate(([True], once[1:] != once[:-1]))] % len(kinds)
            held = np.bincount(once, minlength=len(kinds)).astype(np.uint32)
            heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            ends = np.append(heads[1:], len(shard))
            packed = kinds.astype(np.uint32)
            block, many = row["block"], len(heads)
            salt = int(spans.mix(np.array([block], np.uint64))[0] % np.uint64(runs))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * many, pa.int64()), pa.array(shard[heads], pa.int32()), pa.array([salt] * many, pa.int32()), pa.array([packed[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary()), pa.array([held[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary())],
                ["block", "shard", "run", "pairs", "docs"],
            )

    return run


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    every = np.sort(np.concatenate(parts))
    return every[np.concatenate(([True], every[1:] != every[:-1]))] if len(every) else every


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each shard of a partition, merged as they come."""
    _let_go()
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = held.setdefault(shard, [])
            mine.append(np.frombuffer(raw, np.uint32))
            size[shard] = size.get(shard, 0) + len(mine[-1])
            if len(mine) > 1 and size[shard] > 2 * len(mine[0]) + (1 << 16):
                held[shard] = [_merged(mine)]
                size[shard] = len(held[shard][0])
    for shard in list(held):
        keys = _merged(held.pop(shard))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([mph.build(keys)], pa.binary())], ["shard", "hash"])


def _counted(key: tuple, wanted: pa.Table, hashes: pa.Table) -> pa.Table:
    """The counts of a run of blocks, by the hash of a shard."""
    _let_go()
    table = mph.Table(hashes.column("hash")[0].as_py())
    total = np.zeros(len(table), np.int64)
    for pairs, docs in zip(wanted.column("pairs").to_pylist(), wanted.column("docs").to_pylist(), strict=True):
        total[table.find(np.frombuffer(pairs, np.uint32))] += np.frombuffer(docs, np.uint32)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(raw, np.int64)
            totals[shard] = totals[shard] + counts if shard in totals else counts
    for shard, counts in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["shard", "counts"])


def _best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its A id."""
    _, a = np.unique(keys >> 16, return_inverse=True)
    top = np.zeros(a.max(initial=-1) + 1, np.int64)
    np.maximum.at(top, a, counts)
    return counts == top[a]


def _answered(key: tuple, wanted: pa.Table, index: pa.Table) -> pa.Table:
    """For each question of a run of blocks, the counts of its pairs, doubled, one more where
    it is the highest of the A id."""
    _let_go()
    table, counts = mph.Table(index.column("hash")[0].as_py()), np.frombuffer(index.column("counts")[0].as_py(), np.int64)
    told = 2 * counts + _best(table.keys, counts)
    out = [_zip(told[table.find(np.frombuffer(raw, np.uint32))]) for raw in wanted.column("pairs").to_pylist()]
    return pa.table({"block": wanted.column("block"), "shard": wanted.column("shard"), "told": pa.array(out, pa.binary())})


def _looked_up(a_path: str, b_path: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _token_sizes(a_path, b_path)
        for row, a, b, n_a, n_b in _block_rows(batches):
            groups, many = Groups(a, b, n_a, n_b, *sizes), len(n_a)
            doc, keys, times = groups.pairs()
            kinds, place, shard = _distinct(keys, shards)
            told = np.concatenate([np.zeros(0, np.int64), *(_unzip(x["told"], np.int64) for x in sorted(row["answers"] or [], key=lambda x: x["shard"]))])
            if len(told) != len(kinds):
                raise RuntimeError("a block has not got an answer for each of its pairs")
            mine = told[place]
            best, total = np.zeros(many, np.int64), np.zeros(many, np.int64)
            np.add.at(best, doc, times * (mine & 1))
            np.add.at(total, doc, times * (mine >> 1))
            links = np.zeros(many, np.int64)
            np.add.at(links, groups.doc, groups.links)
            columns = (row["doc_ids"], n_a, n_b, np.bincount(groups.doc, minlength=many), links, best, total)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(groups.texts(), pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return run


def _indexed(tables: Scratch, docs: DataFrame, a_path: str, b_path: str, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(blocks, what they ask, hash and counts of every shard, number of shards)."""
    spark = docs.sparkSession
    shards = SHARDS * partitions(spark, docs)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    blocks = tables.table(rows.mapInArrow(_encoded(a_path, b_path), _BLOCKS), "blocks")
    runs = -(-blocks.count() // BLOCKS_A_RUN) or 1
    wanted = tables.table(blocks.drop("doc_ids").mapInArrow(_wanted(a_path, b_path, shards, runs), _WANTED), "wanted")
    hashes = tables.table(wanted.select("shard", "pairs").repartition(partitions(spark, docs), "shard").mapInArrow(_gathered, "shard int, hash binary"), "hashes")
    salted = _for_each_run(hashes, runs)
    partial = wanted.select("shard", "run", "pairs", "docs").groupBy("shard", "run").cogroup(salted.groupBy("shard", "run")).applyInArrow(_counted, "shard int, counts binary")
    counts = partial.repartition(partitions(spark, docs), "shard").mapInArrow(_summed, "shard int, counts binary")
    return blocks, wanted, tables.table(hashes.join(counts, "shard"), "index"), shards


def _for_each_run(index: DataFrame, runs: int) -> DataFrame:
    return index.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def align(tables: Scratch, docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has
    the highest count of all pairs of its A id, ties included), count_sum (of the pairs of all
    links) and groups (``a1,a2|b1;a3|b2,b3``). It is made when it is read, as the groups are
    several times as large as the texts, and holds as long as ``tables``.

    A text that is null, empty or not spelt by the tokens of both tokenizers (one with U+2581,
    or with bytes that are not UTF-8) has no tokens: zeros and ''. Strings of special tokens
    are plain text. Each row counts as a document, so repeated rows count again; null ids
    stay. An empty table gives no rows. Columns beyond key and text are not looked at. A text
    is one block at most, so it has to fit a task."""
    blocks, wanted, index, shards = _indexed(tables, docs, a_path, b_path, text, key)
    runs = (wanted.agg(F.max("run")).first()[0] or 0) + 1
    asked = wanted.select("block", "shard", "run", "pairs").groupBy("shard", "run")
    told = asked.cogroup(_for_each_run(index, runs).groupBy("shard", "run")).applyInArrow(_answered, "block long, shard int, told binary")
    # a row for each shard at most, of a block's pairs together
    answers = told.groupBy("block").agg(F.collect_list(F.struct("shard", "told")).alias("answers"))
    return blocks.join(answers, "block", "left").mapInArrow(_looked_up(a_path, b_path, shards), _OUT)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, counts = mph.Table(raw).keys.astype(np.int64), np.frombuffer(counted, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 16), pa.array(keys & 0xFFFF), pa.array(counts), pa.array(_best(keys, counts))], ["a_id", "b_id", "docs", "best"])


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every linked pair once: a_id, b_id, docs (how many hold it) and best (no other pair of
    the A id has more). Odd rows as in ``align``."""
    with Scratch(docs.sparkSession) as tables:
        index = _indexed(tables, docs, a_path, b_path, text, key)[2]
        return index.select("hash", "counts").mapInArrow(_listed, "a_id long, b_id long, docs long, best boolean").checkpoint()

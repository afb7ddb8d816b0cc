"""Byte-level BPE by a global shuffle of distinct words.

Documents are grouped into blocks. Each block explodes its texts into pre-tokens, whose
positions are their order in the block, and sends every distinct one once, packed by
hash bucket. A bucket therefore sees every block that uses a word, and encodes each
distinct word once for the whole corpus. The ids go back to the blocks, join on the word
and are reassembled by position. Decoding joins the table of token bytes, whose size is
that of the vocabulary. A word that is in all documents travels once for each block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonagrid.llm import ragged, spans
from sonagrid.llm.store import partitions

BLOCK_BYTES = 4 << 20
#: Most buckets of distinct words: more would make rows of a word or two.
MOST_BUCKETS = 8192
#: Words whose ids a bucket remembers; beyond that it starts anew.
REMEMBERED = 500_000

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, from its Unicode properties."""
    table = np.zeros(0x110000, np.uint8)
    for lo in range(0, 0x110000, 0x800):
        if 0xD800 <= lo < 0xE000:
            continue
        text = "".join(map(chr, range(lo, lo + 0x800)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                table[lo + m.start() : lo + m.end()] = kind
    return table


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid end to end as code points, by the rules of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
    a run of one class is a token and takes one space before it; a run of white space
    ends before its last character when text follows; a contraction stands alone."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin = begin[:n]
    changes = np.concatenate(([True], kind[1:] != kind[:-1])) | begin
    start = changes.copy()
    runs = np.flatnonzero(changes & (kind != _SPACE))
    led = runs[(runs > 0) & ~begin[runs]]
    led = led[kind[led - 1] == _SPACE]
    start[led - 1] = True
    start[led[points[led - 1] == 32]] = False
    quotes = runs[(points[runs] == 39) & start[runs]]
    quotes = quotes[quotes + 1 < n]
    if len(quotes):
        follows = lambda k, chars: (quotes + k < n) & np.isin(points[np.minimum(quotes + k, n - 1)], [ord(c) for c in chars])
        inside = lambda k: (quotes + k < n) & ~begin[np.minimum(quotes + k, n - 1)]
        one = follows(1, "stmd") & inside(1)
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= follows(1, a) & follows(2, b)
        pair &= inside(1) & inside(2)
        for at, size in ((quotes[one], 2), (quotes[pair & ~one], 3)):
            start[at + 1] = False
            start[at[at + size < n] + size] |= kind[at[at + size < n] + size] != _SPACE
    return np.flatnonzero(start)


class _Words:
    """The pre-tokens of a block and its distinct words in the order of their hashes."""

    def __init__(self, data: bytes, sizes: np.ndarray) -> None:
        data, sizes = spans.as_utf8(data, sizes)
        raw = np.frombuffer(data, np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        offsets = np.searchsorted(heads, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))))
        starts = pretoken_starts(points, offsets)
        begins = heads[starts] if len(starts) else starts
        ends = np.concatenate((begins[1:], [len(raw)])) if len(starts) else begins
        index, self.kind, hashes = ragged.distinct(raw, begins, ends)
        self.of_text = np.searchsorted(starts, offsets)
        self.raw, self.begins, self.sizes = raw, begins[index], (ends - begins)[index]
        self.hashes = hashes

    def bucket(self, count: int) -> np.ndarray:
        return (self.hashes >> np.uint64(20)) % np.uint64(count)


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.array([x.nbytes], "<u4").tobytes() + x.tobytes() for x in arrays))


def _unzip(data: bytes, *kinds: type) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = int(np.frombuffer(data, "<u4", 1, at)[0])
        out.append(np.frombuffer(data[at + 4 : at + 4 + size], kind))
        at += 4 + size
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    keys: list = []
    texts: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        sizes = np.array([len(x) for x in texts], np.int64)
        packed = zstandard.ZstdCompressor(level=3).compress(np.concatenate(texts).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["block", "doc_ids", "sizes", "texts"])

    for batch in batches:
        data, offsets = spans.column_bytes(batch.column(1))
        names = batch.column(0).to_pylist()
        for lo, hi in spans.slices(offsets, BLOCK_BYTES):
            if keys and sum(map(len, texts)) + offsets[hi] - offsets[lo] > BLOCK_BYTES:
                yield block()
                made, keys, texts = made + 1, [], []
            keys += names[lo:hi]
            texts += [data[offsets[k] : offsets[k + 1]] for k in range(lo, hi)]
    if keys:
        yield block()


def _spread(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _Words(zstandard.ZstdDecompressor().decompress(row["texts"]), np.array(row["sizes"]))
                of = words.bucket(buckets)
                at, packed = [], []
                for b in np.unique(of).tolist():
                    mine = np.flatnonzero(of == b)
                    begins, sizes = words.begins[mine], words.sizes[mine]
                    text = b"".join([words.raw[x : x + y].tobytes() for x, y in zip(begins.tolist(), sizes.tolist(), strict=True)])
                    at.append(b)
                    packed.append(_zip(sizes.astype(np.uint32), np.frombuffer(text, np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())], ["block", "bucket", "words"])

    return run


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for packed in batch.column(2):
                sizes, text = _unzip(packed.as_py(), np.uint32, np.uint8)
                text, ends = text.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
                if len(known) > REMEMBERED:
                    known.clear()
                ids, counts, at = [], [], 0
                for end in ends:
                    word = text[at:end]
                    at = end
                    if (found := known.get(word)) is None:
                        found = known[word] = encode(word.decode())
                    ids += found
                    counts.append(len(found))
                out.append(_zip(np.array(counts, np.uint32), np.array(ids, np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    return run


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _assembled(buckets: int, table=None):
    """Joins the texts of one block with the ids of its words; with ``table``, the bytes
    of each token, the ids are decoded in the same pass."""
    schema = _IDS if table is None else _IDS.append(pa.field("decoded", pa.binary()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {b: _unzip(x, np.uint32, np.uint32) for b, x in zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True)}
        rows: list[tuple] = []
        for row in left.to_pylist():
            words = _Words(zstandard.ZstdDecompressor().decompress(row["texts"]), np.array(row["sizes"]))
            of = words.bucket(buckets)
            order = np.argsort(of, kind="stable")
            mine = np.unique(of).tolist()
            sizes = np.zeros(len(of), np.int64)
            sizes[order] = np.concatenate([found[b][0] for b in mine]) if mine else 0
            begins = np.zeros(len(of), np.int64)
            begins[order] = np.cumsum(sizes[order]) - sizes[order]
            flat = np.concatenate([found[b][1] for b in mine]) if mine else np.zeros(0, np.uint32)
            counts = sizes[words.kind]
            before = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
            ids = flat[np.arange(before[-1]) + np.repeat(begins[words.kind] - before[:-1], counts)]
            cut = before[words.of_text]
            rows += [(k, int(b - a), ids[a:b].astype("<u4").tobytes()) for k, a, b in zip(row["doc_ids"], cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_IDS.types)]
        if table is not None:
            columns.append(_bytes_of(columns[2], table.value))
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _bytes_of(ids: pa.Array, pieces: dict[int, bytes]) -> pa.Array:
    """The join of each row's ids with the token-byte table, put together in order."""
    return pa.array([b"".join([pieces[i] for i in np.frombuffer(x.as_buffer(), "<u4").tolist()]) for x in ids], pa.binary())


def _token_bytes(spark: SparkSession, ranks: str):
    """The token-byte table on all executors; it has one entry for each id."""
    return spark.sparkContext.broadcast({i: b for b, i in ranks_of(ranks).items()})


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit), as the
    tiktoken library gives for the rank file ``ranks`` without special tokens; with
    ``decoded``, also the bytes that the ids decode to.

    A null or empty text has no ids; bytes that are not UTF-8 are encoded as U+FFFD;
    repeated rows stay; null ids pass through; other columns are not looked at. ``pattern`` must be the one of ``pretoken_starts``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    count = partitions(docs.sparkSession, rows)
    buckets = min(MOST_BUCKETS, count)
    blocks = rows.mapInArrow(_blocks, "block long, doc_ids array<long>, sizes array<long>, texts binary").repartition(count, "block")
    words = blocks.mapInArrow(_spread(buckets), "block long, bucket int, words binary")
    ids = words.repartition(count, "bucket").mapInArrow(_encoded(ranks, pattern), "block long, bucket int, ids binary")
    table = _token_bytes(docs.sparkSession, ranks) if decoded else None
    # a bucket's rows are worked on one batch at a time, so its memory is that of one batch
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assembled(buckets, table), "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def _decoded(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _bytes_of(part.column(2), table.value)], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids, by a join with the token-byte
    table."""
    table = _token_bytes(encoded.sparkSession, ranks)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoded(table), "doc_id long, n_tokens long, ids binary, decoded binary")

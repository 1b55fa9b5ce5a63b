"""Removal of strings of 200 bytes that the corpus holds more than once.

A column-wise construction over many strings at once: each round inserts one symbol of every
string, from the last column to the first. The symbols in the order of the last round are the
collection's Burrows-Wheeler column; sorting them stably gives the order of the new suffixes,
and the common prefixes of neighbours follow from the least of the old ones between them.
Columns stand in a temporary file of the task and are read once, one after the other; memory
holds the order and the common prefixes only. A start whose block of neighbours shares 200 symbols
with another start is a repeat.

Inserting whole documents would take as many rounds, and passes over everything, as the longest
document has bytes. So the strings are short windows, and equal strings are aligned beforehand:
every string of 200 bytes is named after its anchor, the leftmost run of ``GRAM`` bytes in it with
the least hash, so that equal strings have equal anchors at equal offsets. Anchors that occur once need no
more work. Starts that share an anchor are cut into pieces of ``PIECE`` offsets; a piece's window
holds all of its strings, and windows meet if they share the anchor, the offsets and the bytes
common to all their strings. All of a bucket's windows are inserted together, a round for each
column, and never compared pair by pair.

Texts are read once into chunks of about ``CHUNK_BYTES``. A chunk sends each distinct anchor and
window once, however often it has it, and gets the answers back; so hot copies shrink before
they are shuffled. What meets in one group are the distinct windows around one core of 176 bytes.

Texts are their UTF-8 bytes; null and empty texts have none. Matches stay inside a document. An
equal string counts wherever it starts, in the same document too. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import written
from strideframe.llm.text import Texts, covered, cuts, flat, mix

LENGTH = 200
GRAM = 128
PIECE = 25
WIDTH = LENGTH + PIECE - 1
CHUNK_BYTES = 4 << 20
SLICE_BYTES = 1 << 18
ANCHORS = 1 << 19
WINDOWS = 1 << 16
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole texts in rows of about ``chunk_bytes``: chunk, doc_ids, sizes, data (compressed)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size, held = TaskContext.get().partitionId(), 0, 0, []

        def chunk() -> pa.RecordBatch:
            ids, sizes = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[2] for x in held])
            data = np.concatenate([x[1] for x in held]).tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(sizes, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + count]), *lists, pa.array([pa.compress(data, "zstd", asbytes=True)])], names=["chunk", "doc_ids", "sizes", "data"])

        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in cuts(offsets, chunk_bytes // 4):
                held.append((batch.column(0).slice(a, b - a), data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])))
                size += int(offsets[b] - offsets[a])
                if size >= chunk_bytes:
                    yield chunk()
                    held, size, count = [], 0, count + 1
        if held:
            yield chunk()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(gather, "chunk long, doc_ids array<long>, sizes array<long>, data binary")


def chunk_slices(row: dict) -> Iterator[tuple[int, Texts]]:
    sizes = np.array(row["sizes"], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(pa.decompress(row["data"], int(offsets[-1]), "zstd", asbytes=True), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    for a, b in cuts(offsets, SLICE_BYTES):
        yield a, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the strings that share an anchor, the anchor's place, and its hash."""
    n = len(texts.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - GRAM + 1)
    grams = texts.hashes(at, at + GRAM)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (grams >> bits << bits) | at.astype(np.uint64)  # the place decides between equals: the leftmost
    span, need = 1, LENGTH - GRAM + 1
    while 2 * span <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if need > span:
        low = np.minimum(low[: len(low) - (need - span)], low[need - span :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    long_ = np.flatnonzero(np.diff(texts.offsets) >= LENGTH)
    np.add.at(inside, texts.offsets[long_], 1)
    np.add.at(inside, texts.offsets[long_ + 1] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], anchor[start[first]], grams[anchor[start[first]]]


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the ranges of the top bits in sorted keys."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _bits(n: int, each: int) -> int:
    return max(0, int(max(n, 1) - 1).bit_length() - each.bit_length() + 1)


def chunk_anchors(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk, sorted, and whether the chunk has each more than once."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(runs(t)[3] for _, t in chunk_slices(row))])
    distinct, count = np.unique(keys, return_counts=True)
    return distinct, count > 1


def shared_anchors(table: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, a flag for each of the chunk's anchors there (does the corpus have it twice), and their number."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, many = chunk_anchors(row)
                at = _bounds(keys, bits)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["chunk"])), pa.array([keys[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([np.packbits(many[at[b] : at[b + 1]]).tobytes() for b in full], pa.binary())], names=["bucket", "chunk", "keys", "many"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in rows["keys"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(rows["many"], keys, strict=True)])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        twice = (np.bincount(which) + np.bincount(which, weights=many) > 1)[which]
        each = np.split(twice, np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "flags": [np.packbits(x).tobytes() for x in each], "n": [len(x) for x in each], "n_shared": [int(x.sum()) for x in each]})

    sent = table.mapInArrow(send, "bucket int, chunk long, keys binary, many binary")
    return sent.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, flags binary, n long, n_shared long")


class Windows:
    """A chunk's windows around shared anchors.

    ``key`` and ``name`` tell what they meet by and what they hold; ``slice``, ``at`` (place of the first column),
    ``first`` and ``last`` (columns that are the piece's own starts) are by window; ``distinct``
    orders one window of each kind by key, and ``which`` is the kind of each.
    """

    def __init__(self, row: dict, flags: list[dict]):
        shared = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(f["flags"], np.uint8), count=f["n"]).astype(bool) for f in flags)])
        self.texts, found = [], []
        # the flags are in the order of the chunk's sorted anchors
        each = [(a, t, runs(t)) for a, t in chunk_slices(row)]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[3] for _, _, r in each)]))
        for k, (a, t, (low, high, anchor, gram)) in enumerate(each):
            self.texts.append((a, t))
            use = np.flatnonzero(shared[np.searchsorted(keys, gram)]) if len(gram) else np.zeros(0, np.int64)
            low, high, anchor, gram = low[use], high[use], anchor[use], gram[use]
            near, far = (anchor - high) // PIECE, (anchor - low) // PIECE
            size = far - near + 1
            which = np.repeat(np.arange(len(use)), size)
            piece = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + near[which]
            at = anchor[which] - (piece + 1) * PIECE + 1
            first, last = np.maximum(low[which] - at, 0), np.minimum(high[which] - at, PIECE - 1)
            core = t.hashes(at + PIECE - 1, at + LENGTH) if len(at) else np.zeros(0, np.uint64)
            doc = np.searchsorted(t.offsets, low[which], "right") - 1
            begin, end = np.maximum(at, t.offsets[doc]), np.minimum(at + WIDTH, t.offsets[doc + 1])
            key = mix(core + mix(gram[which] + piece.astype(np.uint64)))
            held = t.hashes(begin, end) if len(at) else np.zeros(0, np.uint64)
            name = mix(key + mix(held + (first * 1024 + last).astype(np.uint64)) + ((begin - at) * 512 + (end - at)).astype(np.uint64))
            found.append((key, name, np.full(len(at), k), at, first, last, begin, end))
        kinds = (np.uint64, np.uint64, *[np.int64] * 6)
        self.key, self.name, self.slice, self.at, self.first, self.last, self.begin, self.end = (np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate(kinds))
        order = np.lexsort((self.name, self.key))
        new = np.ones(len(order), bool)
        new[1:] = (self.key[order[1:]] != self.key[order[:-1]]) | (self.name[order[1:]] != self.name[order[:-1]])
        self.distinct = order[new]
        kind = np.cumsum(new) - 1
        self.which = np.zeros(len(order), np.int64)
        self.which[order] = kind
        self.many = np.bincount(kind, minlength=len(self.distinct)) > 1

    def symbols(self, some: np.ndarray) -> np.ndarray:
        """The windows' bytes, 0 where a window goes beyond its document."""
        out = np.zeros((len(some), WIDTH), np.uint8)
        for k in np.unique(self.slice[some]).tolist():
            data = self.texts[k][1].data
            mine = np.flatnonzero(self.slice[some] == k)
            w = some[mine]
            place = self.at[w][:, None] + np.arange(WIDTH)
            inside = (place >= self.begin[w][:, None]) & (place < self.end[w][:, None])
            out[mine] = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0)
        return out


def insert_columns(columns: Iterator[np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each inserted column, the strings in the order of their suffixes and the common prefixes of neighbours (at most ``LENGTH``).

    ``columns`` come from the last to the first. Groups are whole numbers in rising order; strings of different groups have no common prefix.
    """
    n = len(group)
    order = np.arange(n)
    common = np.zeros(n, np.int16)
    for column in columns:
        key = group[order].astype(np.int64) * 256 + column[order]
        by = np.argsort(key, kind="stable")  # mostly in order already
        sorted_ = key[by]
        least = common[by].copy()
        apart = np.flatnonzero(by[1:] != by[:-1] + 1) + 1
        same = apart[sorted_[apart] == sorted_[apart - 1]]
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[::2], ends[1::2] = by[same - 1] + 1, by[same] + 1
            least[same] = np.minimum.reduceat(np.append(common, 0), ends)[::2]
        least = np.minimum(least + 1, LENGTH).astype(np.int16)
        least[0:1] = 0
        least[1:][sorted_[1:] != sorted_[:-1]] = 0
        order, common = order[by], least
        yield order, common


def repeats(symbols: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which starts (string, column of the piece) begin a repeated string."""
    out = np.zeros((len(group), PIECE), bool)
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(symbols.T[::-1]).tobytes())
        file.seek(0)
        columns = (np.frombuffer(file.read(len(group)), np.uint8) for _ in range(symbols.shape[1]))
        for k, (order, common) in enumerate(insert_columns(columns, group)):
            c = WIDTH - 1 - k
            if c >= PIECE:
                continue
            own = ((first <= c) & (c <= last))[order]
            block = np.cumsum(common < LENGTH) - 1
            weight = np.bincount(block, weights=own * (1 + many[order]))
            out[order, c] = own & (weight > 1)[block]
    return out


def repeated_windows(table: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, and the repeats of the chunk's distinct windows there. ``table`` has the chunks and their flags."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                w = Windows(row, row["flags"])
                at = _bounds(w.key[w.distinct], bits)
                for b in np.flatnonzero(np.diff(at)).tolist():
                    some = w.distinct[at[b] : at[b + 1]]
                    raw = pa.compress(w.symbols(some).tobytes(), "zstd", asbytes=True)
                    side = np.stack([w.first[some], w.last[some], w.many[at[b] : at[b + 1]]]).astype(np.uint8)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "chunk": [row["chunk"]], "keys": pa.array([w.key[some].tobytes()], pa.binary()), "side": pa.array([side.tobytes()], pa.binary()), "symbols": pa.array([raw], pa.binary())})

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in rows["keys"]]
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
        side = np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in rows["side"]], 1)
        _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
        # a window alone with its core is no repeat
        order = np.argsort(group, kind="stable")
        order = order[((count > 1)[group] | (side[2] > 0))[order]]
        flags = np.zeros((len(keys), PIECE), bool)
        if len(order):
            symbols = np.empty((len(order), WIDTH), np.uint8)
            back = np.full(len(keys), -1)
            back[order] = np.arange(len(order))
            at = 0
            for raw, n in zip(rows["symbols"], sizes, strict=True):
                some = back[at : at + n]
                symbols[some[some >= 0]] = np.frombuffer(pa.decompress(raw, n * WIDTH, "zstd", asbytes=True), np.uint8).reshape(n, WIDTH)[some >= 0]
                at += n
            first, last, many = side[:, order].astype(np.int64)
            flags[order] = repeats(symbols, group[order], first, last, many)
        each = np.split(flags, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "repeats": [np.packbits(x).tobytes() for x in each], "n": sizes})

    sent = table.mapInArrow(send, "bucket int, chunk long, keys binary, side binary, symbols binary")
    return sent.groupBy("bucket").applyInPandas(build, "chunk long, bucket int, repeats binary, n long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, anchors: int = ANCHORS, windows: int = WINDOWS, with_text: bool = False) -> DataFrame:
    """One row per document: its bytes, what is removed of them, and the digest of the rest (``with_text``: and the rest, as bytes)."""
    table = written(chunks(docs, doc_id, text, chunk_bytes), "texts")
    size = table.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)).alias("n")).first().n
    flags = written(shared_anchors(table, _bits(size * 2 // (LENGTH - GRAM + 2), anchors)), "anchors")
    shared = flags.agg(F.coalesce(F.sum("n_shared"), F.lit(0)).alias("n")).first().n
    by_chunk = flags.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "flags", "n"))).alias("flags"))
    flagged = table.join(by_chunk, "chunk", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<struct<bucket:int,flags:binary,n:bigint>>")))
    repeats_ = written(repeated_windows(flagged, _bits(2 * shared, windows)), "repeats")
    found = repeats_.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "repeats", "n"))).alias("repeats"))
    rows = flagged.join(found, "chunk", "left")
    schema = SCHEMA + ", kept binary" * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = pa.array(row["doc_ids"], pa.int64())
                for a, columns in _kept(row, with_text):
                    yield pa.RecordBatch.from_arrays([ids.slice(a, len(columns[0])), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(finish, schema)


def _kept(row: dict, with_text: bool) -> Iterator[tuple[int, list[pa.Array]]]:
    w = Windows(row, row["flags"])
    hits = np.concatenate([np.zeros((0, PIECE), bool), *(np.unpackbits(np.frombuffer(x["repeats"], np.uint8), count=x["n"] * PIECE).reshape(-1, PIECE).astype(bool) for x in row["repeats"] or [])])
    window, column = np.nonzero(hits[w.which]) if len(hits) else (np.zeros(0, np.int64),) * 2
    start, where = w.at[window] + column, w.slice[window]
    for k, (a, t) in enumerate(w.texts):
        gone = covered(start[where == k], LENGTH, len(t.data)) if len(t.data) else np.zeros(0, bool)
        first, _ = t.spans(gone)
        left = [t.data[t.offsets[j] : t.offsets[j + 1]][~gone[t.offsets[j] : t.offsets[j + 1]]].tobytes() for j in range(t.n)]
        columns = [pa.array(np.diff(t.offsets)), pa.array(t.per_text(gone)), pa.array(np.diff(t.of(first)[1]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
        yield a, [*columns, *([pa.array(left, pa.binary())] if with_text else [])]

"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Tokens are words (lower-cased A-Z, split at ASCII white space) and one end for each text. The
model interpolates: p(w | h) = (1 - l) * base(w) + l * count(h w) / count(h) with
l = ``SHARE`` * count(h) / (count(h) + ``PRIOR``). Word counts are exact; bigram counts come from the filter:
a bigram seen c times is inserted once for each level up to 1 + floor(log2(c / ``least``)),
and is read back by probing level after level until one is absent, as the lower end of the
last level's range, and no more than the counts of both words. Bigrams seen fewer than ``least`` times are left to the base;
the query has ``least`` = 1, so level 1 is a bigram seen once and none is left out.

How it runs: texts are read once into *chunks* of about ``CHUNK_BYTES``, a table of token numbers
with the chunk's own words. A chunk sends its distinct words with their counts to the words'
buckets (ranges of the hash) and gets back the counts over all training texts, so no task holds
the corpus's vocabulary, and a word counts once for each chunk however frequent it is. Bigrams
go the same way; each bucket makes its segment of the filter. The segments are broadcast if
together they are below ``FILTER_BYTES``; else the chunks' distinct bigrams are sent to the
segments and the levels sent back. Both give the same scores for the same
buckets.

Words are told apart by 64-bit hashes, bigrams by 32 bits beyond their bucket's.
A null or empty text has the end only. A null id counts as the empty string when texts are
held out. Repeated rows count repeatedly. Without training texts N and V are 0 and the base is that of the formula.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import written
from strideframe.llm.text import SPACED_WORD, mix, slices

CHUNK_BYTES = 4 << 20
#: keys in a bucket, about
BUCKET = 1 << 20
FILTER_BYTES = 256 << 20
LEAST = 2
BITS, HASHES = 14, 10
SHARE, PRIOR = 0.4, 5.0
END = np.uint64(0xE0D0_5EED_0000_0001)
START = np.uint64(0x57A7_5EED_0000_0001)
_STEP = np.uint64(6364136223846793005)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of four bytes, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole texts as token numbers: chunk, doc_ids, held, sizes (tokens of each text), tokens, words (sorted hashes), n_tokens, n_words."""
    key = F.coalesce(docs[doc_id].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), (F.crc32(key) % 5 == 1).alias("held"), docs[text].alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            tokens = np.concatenate([x[2] for x in held])
            words, numbers = np.unique(tokens, return_inverse=True)
            sizes = np.concatenate([x[3] for x in held])
            ids, out = pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held])
            one = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + count]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, out), pa.array([packed(sizes)]), pa.array([packed(numbers)]), pa.array([words.tobytes()]), pa.array([len(tokens)]), pa.array([len(words)])],
                names=["chunk", "doc_ids", "held", "sizes", "tokens", "words", "n_tokens", "n_words"],
            )

        for batch in batches:
            for a, texts in slices(batch.column(2), lower=True):
                starts, ends = texts.spans(SPACED_WORD[texts.data])
                _, bounds = texts.of(starts)
                tokens = np.insert(texts.hashes(starts, ends), bounds[1:], END)
                held.append((batch.column(0).slice(a, texts.n), batch.column(1).slice(a, texts.n), tokens, np.diff(bounds) + 1))
                size += len(texts.data)
                if size >= chunk_bytes:
                    yield chunk()
                    held, size, count = [], 0, count + 1
        if held:
            yield chunk()

    return rows.mapInArrow(number, "chunk long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, n_tokens long, n_words long")


class Chunk:
    """A row of the chunk table, unpacked."""

    def __init__(self, row):  # noqa: ANN001
        self.tokens, self.words = unpacked(row["tokens"]), np.frombuffer(row["words"], np.uint64)
        sizes = unpacked(row["sizes"]).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.held = np.array(row["held"], bool)
        self.text = np.repeat(np.arange(len(sizes)), sizes)

    def bigrams(self) -> np.ndarray:
        """Hash of each token with the one before it in its text."""
        tokens = self.words[self.tokens]
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.bounds[:-1]] = START
        return mix(before * _STEP + tokens)

    def trained(self) -> np.ndarray:
        return ~self.held[self.text]


def _by_bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the buckets in sorted keys."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def bucket_bits(keys: int, bucket: int = BUCKET) -> int:
    return max(0, math.ceil(math.log2(max(keys, 1) / bucket)))


def word_counts(table: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, counts of the chunk's words there over all training texts, and the bucket's totals."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                count = np.bincount(c.tokens[c.trained()], minlength=len(c.words))
                at = _by_bucket(c.words, bits)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["chunk"])), pa.array([c.words[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([packed(count[at[b] : at[b + 1]]) for b in full], pa.binary())], names=["bucket", "chunk", "words", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        counts = np.concatenate([unpacked(x) for x in rows["counts"]])
        distinct, which = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in words])
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "counts": [x.tobytes() for x in np.split(total[which], ends[:-1])], "seen": int((total > 0).sum()), "tokens": int(total.sum())})

    sent = table.select("chunk", "tokens", "words", "sizes", "held").mapInArrow(send, "bucket int, chunk long, words binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(add, "chunk long, bucket int, counts binary, seen long, tokens long")


def level(count: np.ndarray, least: int = LEAST) -> np.ndarray:
    """1 + floor(log2(count / least)), 0 below least."""
    return np.where(count >= least, np.frexp(np.maximum(count, 1) / least)[1], 0)


def lower_end(levels: np.ndarray, least: int = LEAST) -> np.ndarray:
    return np.where(levels > 0, least * 2.0 ** (levels.astype(float) - 1), 0.0)


class Segment:
    """One bucket's Bloom filter: bits for (bigram, level)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.n = np.uint64(8 * len(bits))

    def _places(self, keys: np.ndarray, at_level: int) -> Iterator[np.ndarray]:
        one = mix(keys.astype(np.uint64) + np.uint64(at_level * 0x9E3779B97F4A7C15 % (1 << 64)))
        step = mix(one) | np.uint64(1)
        for k in range(HASHES):
            yield (one + np.uint64(k) * step) % self.n

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray) -> Segment:
        made = cls(np.zeros(max(8, int(levels.sum()) * BITS // 8 + 1), np.uint8))
        for j in range(1, int(levels.max(initial=0)) + 1):
            for at in made._places(keys[levels >= j], j):
                np.bitwise_or.at(made.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        return made

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found before one is absent."""
        out, open_, j = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(open_):
            j += 1
            inside = np.arange(len(open_))
            for at in self._places(keys[open_], j):
                at = at[inside]
                inside = inside[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                if not len(inside):
                    break
            open_ = open_[inside]
            out[open_] = j
            if j == 64:
                break
        return out


def filter_segments(table: DataFrame, bits: int, least: int = LEAST) -> DataFrame:
    """bucket and bits of each segment, from the bigram counts over all training texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                keys, count = np.unique(c.bigrams()[c.trained()], return_counts=True)
                at = _by_bucket(keys, bits)
                full = np.flatnonzero(np.diff(at))
                low = _low(keys, bits)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([low[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([packed(count[at[b] : at[b + 1]]) for b in full], pa.binary())], names=["bucket", "keys", "counts"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys, which = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows["keys"]]), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([unpacked(x) for x in rows["counts"]]), minlength=len(keys))
        levels = level(count, least)
        made = Segment.of(keys[levels > 0], levels[levels > 0])
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "bits": [made.bits.tobytes()], "n_bytes": len(made.bits)})

    sent = table.select("chunk", "tokens", "words", "sizes", "held").mapInArrow(send, "bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(build, "bucket int, bits binary, n_bytes long")


def _probe(keys: np.ndarray, bits: int, segments: dict[int, Segment]) -> np.ndarray:
    """Levels of sorted bigram hashes."""
    at, low, out = _by_bucket(keys, bits), _low(keys, bits), np.zeros(len(keys), np.uint8)
    for b in np.flatnonzero(np.diff(at)).tolist():
        if b in segments:
            out[at[b] : at[b + 1]] = segments[b].levels(low[at[b] : at[b + 1]])
    return out


def routed_levels(table: DataFrame, segments: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, levels of the chunk's distinct bigrams there: sent to the segments and back."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.unique(Chunk(row).bigrams())
                at, low = _by_bucket(keys, bits), _low(keys, bits)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["chunk"])), pa.array([low[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "chunk", "keys"])

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        segment = Segment(np.frombuffer(held["bits"].iloc[0], np.uint8)) if len(held) else None
        found = [(segment.levels(k) if segment else np.zeros(len(k), np.uint8)).tobytes() for k in (np.frombuffer(x, np.uint32) for x in asked["keys"])]
        return pd.DataFrame({"chunk": asked["chunk"], "bucket": asked["bucket"], "levels": pd.Series(found, dtype=object)})

    sent = table.select("chunk", "tokens", "words", "sizes", "held").mapInArrow(send, "bucket int, chunk long, keys binary")
    return sent.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInPandas(answer, "chunk long, bucket int, levels binary")


def scored(c: Chunk, count: np.ndarray, levels: np.ndarray, which: np.ndarray, total: int, seen: int, ends: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score of each text of a chunk."""
    counts = count[c.tokens]
    base = (counts + 0.5) / (total + 0.5 * (seen + 1))
    history = np.empty(len(counts))
    history[1:] = counts[:-1]
    history[c.bounds[:-1]] = ends
    weight = SHARE * history / (history + PRIOR)
    rarer = np.minimum(history, counts)
    pairs = np.where(rarer < least, 0, np.minimum(lower_end(levels, least)[which], rarer))
    ratio = pairs / np.maximum(history, 1)
    mixed = (1 - weight) * base + weight * ratio
    first = c.bounds[:-1]
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
    return add((counts > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(mixed))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES, chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET, least: int = LEAST) -> DataFrame:
    """One row per document with its base score and the model's score."""
    table = written(chunks(docs, doc_id, text, chunk_bytes), "chunks")
    size = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    word_bits, bits = bucket_bits(size.w, bucket), bucket_bits(size.t, bucket)
    counted = written(word_counts(table, word_bits), "word-counts")
    totals = counted.groupBy("bucket").agg(F.first("seen").alias("seen"), F.first("tokens").alias("tokens")).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first()
    total, seen = int(totals.n), int(totals.v)
    segments = written(filter_segments(table, bits, least), "segments")
    by_chunk = counted.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("counts"))
    rows = table.drop("n_tokens", "n_words").join(by_chunk, "chunk")
    held = None
    if (segments.agg(F.sum("n_bytes")).first()[0] or 0) <= filter_bytes:
        held = docs.sparkSession.sparkContext.broadcast({r.bucket: bytes(r.bits) for r in segments.collect()})
        rows = rows.withColumn("levels", F.lit(None).cast("array<struct<bucket:int,levels:binary>>"))
    else:
        routed = routed_levels(table, segments, bits).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels"))).alias("levels"))
        rows = rows.join(routed, "chunk")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {b: Segment(np.frombuffer(x, np.uint8)) for b, x in held.value.items()} if held else {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row)
                count = np.concatenate([np.frombuffer(x["counts"], np.int64) for x in row["counts"]])
                keys, which = np.unique(c.bigrams(), return_inverse=True)
                levels = _probe(keys, bits, filters) if held else np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in row["levels"]])
                end = np.flatnonzero(c.words == END)
                # every training text has one end, so the ends count its beginnings
                known, base, full = scored(c, count, levels, which, total, seen, int(count[end[0]]) if len(end) else 0, least)
                n = np.diff(c.bounds)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(c.held), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total)), pa.array(base), pa.array(full)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(finish, SCHEMA)

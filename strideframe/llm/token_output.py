"""Token ids in training order: fixed-stride records in shards.

Documents are tokenised, each ends with an end token, and the stream of a task is cut into
sequences of equal length (the last is filled up with end tokens). A first pass counts the
sequences of each task and stores no token; the second makes them, numbered 0..n-1; a keyed Feistel permutation on the next power of four, walked until
it falls below n, gives each number a slot of its own. Slots are dealt to shards by range, and a
record stands at (slot - first slot of the shard) * stride, so that a reader goes on
anywhere by position.

Tokenisation is that of the file's byte-pair vocabulary: a word with the white space before it
is a unit of the pattern, so each distinct one of a slice is encoded once. Texts with
white space outside ASCII are encoded whole.

Both passes must see the same documents in a task, as those over a table of files do (filters and
projections behind it too). A task whose count is another in the second pass fails with a message
rather than number sequences wrongly; write any other frame as a table first. The session's
``spark.sql.files.minPartitionNum`` is set where it is unset, so that lost executors don't change the splits.

A null text is an empty text: just an end token. Repeated rows are repeated sequences. An empty
table gives no sequences.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import shared_folder, written
from strideframe.llm.text import SPACED_WORD, Texts, mix, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pattern that goes with the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 1024
PER_SHARD = 16384
KEY = 20240607
ROUNDS = 6
INDEXED = ["slot", "shard", "offset", "doc_ids", "n_tokens"]
SLICE = 2 << 20
#: distinct units that a worker remembers
REMEMBERED = 400_000


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ranks; the end token is the number after the last."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.size = np.zeros(len(ranks), np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]
        self.type = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.known = np.zeros(0, np.uint64)
        self.ids, self.bounds = np.zeros(0, self.type), np.zeros(1, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def _units(self, part: Texts, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and bounds of distinct units, from memory or encoded now."""
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        old = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~old)
        fresh, fresh_width = self._encode_units(part.data, start[new], end[new])
        width = np.zeros(len(keys), np.int64)
        width[old] = self.bounds[at[old] + 1] - self.bounds[at[old]]
        width[new] = fresh_width
        bounds = np.concatenate([[0], np.cumsum(width)])
        ids = np.zeros(bounds[-1], self.type)
        ids[_ranges(bounds[:-1][old], width[old])] = self.ids[_ranges(self.bounds[at[old]], width[old])]
        ids[_ranges(bounds[:-1][new], fresh_width)] = fresh
        if len(self.known) + len(new) <= REMEMBERED:
            every = np.concatenate([self.known, keys[new]])
            order = np.argsort(every)
            widths = np.concatenate([np.diff(self.bounds), fresh_width])
            both = np.concatenate([self.ids, fresh])
            first = np.concatenate([[0], np.cumsum(widths)])[:-1]
            self.ids = both[_ranges(first[order], widths[order])]
            self.known, self.bounds = every[order], np.concatenate([[0], np.cumsum(widths[order])])
        return ids, bounds

    def _encode_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of units in a row, and how many each has.

        Units that begin with white space and end with something else don't touch each other when
        they are put together, so those are encoded as one text and cut by the tokens' bytes.
        """
        width = np.zeros(len(start), np.int64)
        apart = ~SPACED_WORD[data[start]] & SPACED_WORD[data[end - 1]] if len(start) else np.zeros(0, bool)
        joint = np.flatnonzero(apart)
        text = data[_ranges(start[joint], (end - start)[joint])].tobytes().decode("utf-8", "replace")
        many = np.array(self.encode(text), np.int64)
        stops = np.searchsorted(np.cumsum(self.size[many]), np.cumsum((end - start)[joint])) + 1
        width[joint] = np.diff(stops, prepend=0)
        alone = np.flatnonzero(~apart)
        few = [self.encode(data[start[i] : end[i]].tobytes().decode("utf-8", "replace")) for i in alone]
        width[alone] = [len(x) for x in few]
        at = np.concatenate([[0], np.cumsum(width)])[:-1]
        ids = np.zeros(width.sum(), self.type)
        ids[_ranges(at[joint], width[joint])] = many
        ids[_ranges(at[alone], width[alone])] = np.array([t for x in few for t in x], self.type)
        return ids, width

    def stream(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, an end token after each, and the texts' bounds."""
        bare = SPACED_WORD[part.data]
        first = ~bare
        first[1:] &= bare[:-1]
        # a unit begins where white space follows something else, and at each text's first byte
        begin = part.offsets[:-1][np.diff(part.offsets) > 0]
        first[begin] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(part.data)).astype(np.int64)
        keys = part.hashes(start, end) if len(start) else np.zeros(0, np.uint64)
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        ids, bounds = self._units(part, distinct, start[where], end[where])
        width = np.diff(bounds)[which]
        per_text = np.searchsorted(start, part.offsets)
        total = np.concatenate([[0], np.cumsum(width)])[per_text]
        whole = {i: np.array(self.encode(part.text(i)), self.type) for i in wide_space(part)}
        size = np.diff(total) + 1
        for i, x in whole.items():
            size[i] = len(x) + 1
        to = np.concatenate([[0], np.cumsum(size)])
        out = np.full(to[-1], self.end, self.type)
        plain = np.ones(part.n, bool)
        plain[list(whole)] = False
        unit_text = np.repeat(np.arange(part.n), np.diff(per_text))
        use = plain[unit_text]
        place = to[unit_text] + (np.cumsum(width) - width) - total[unit_text]
        out[_ranges(place[use], width[use])] = ids[_ranges(bounds[which[use]], width[use])]
        for i, x in whole.items():
            out[to[i] : to[i] + len(x)] = x
        return out, to


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def wide_space(part: Texts) -> list[int]:
    """Texts that may hold white space outside ASCII, by the bytes it begins with."""
    d = part.data
    at = np.flatnonzero((d == 0xE1) | (d == 0xE2) | (d == 0xE3) | (d == 0xC2))
    after = d[np.minimum(at + 1, max(len(d) - 1, 0))]
    some = at[np.where(d[at] == 0xC2, (after == 0x85) | (after == 0xA0), (after == 0x80) | (after == 0x81) | (after == 0x9A))]
    return np.unique(np.searchsorted(part.offsets, some, "right") - 1).tolist()


_made: dict[str, Tokenizer] = {}


def _tokenizer(vocabulary: str, ranks: dict[bytes, int]) -> Tokenizer:
    """The worker's tokenizer, made once."""
    if vocabulary not in _made:
        _made.clear()
        _made[vocabulary] = Tokenizer(ranks)
    return _made[vocabulary]


def sequence_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY) -> dict[int, int]:
    """Sequences of every part that has some: one number for each task. Reads the columns that ``sequences`` reads, so the parts are the same."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(vocabulary, ranks.value)
        tokens = sum(len(coder.stream(piece)[0]) for batch in batches for _, piece in slices(batch.column(1), most=SLICE))
        if tokens:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [-(-tokens // length)]})

    return {r.part: r.n for r in docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(count, "part int, n long").collect()}


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, counts: dict[int, int] | None = None) -> DataFrame:
    """part, place in the part, doc_ids (with a token in it), n_tokens (without filling) and record of every sequence.

    With ``counts`` a task fails unless it makes as many sequences as they say.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    expected = docs.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(vocabulary, ranks.value)
        part, count = TaskContext.get().partitionId(), 0
        tokens, owners = np.zeros(0, coder.type), pa.array([], pa.int64())
        starts = np.zeros(0, np.int64)  # where each waiting document begins in the waiting tokens

        def rows(n: int, filled: np.ndarray) -> pa.RecordBatch:
            at = np.arange(n) * length
            first = np.searchsorted(starts, at, "right") - 1
            last = np.searchsorted(starts, at + length, "left")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)), owners.take(pa.array(_ranges(first, last - first))))
            raw = tokens[: n * length].tobytes()
            wide = length * coder.type.itemsize
            record = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * wide).astype(np.int32)), pa.py_buffer(raw)])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(count, count + n)), lists, pa.array(filled.astype(np.int32)), record], names=["part", "place", "doc_ids", "n_tokens", "record"])

        for batch in batches:
            for a, piece in slices(batch.column(1), most=SLICE):
                new, bounds = coder.stream(piece)
                starts = np.concatenate([starts, bounds[:-1] + len(tokens)])
                owners = pa.concat_arrays([owners, batch.column(0).slice(a, piece.n).cast(pa.int64())])
                tokens = np.concatenate([tokens, new])
                if n := len(tokens) // length:
                    yield rows(n, np.full(n, length))
                    count += n
                    tokens = tokens[n * length :]
                    keep = max(int(np.searchsorted(starts, n * length, "right")) - 1, 0) if len(tokens) else len(starts)
                    starts, owners = starts[keep:] - n * length, owners.slice(keep)
        if len(tokens):
            held = len(tokens)
            tokens = np.concatenate([tokens, np.full(length - held, coder.end, coder.type)])
            yield rows(1, np.array([held]))
            count += 1
        if expected.value is not None and expected.value.get(part, 0) != count:
            raise RuntimeError(f"part {part} has {count} sequences, {expected.value.get(part, 0)} when they were counted: write the documents as a table first")

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(cut, "part int, place long, doc_ids array<long>, n_tokens int, record binary")


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of numbers below n: a Feistel network over two halves, walked along its cycles back below n."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    open_ = np.ones(len(x), bool)
    while open_.any():
        left, right = x[open_] >> half, x[open_] & mask
        for r in range(ROUNDS):
            secret = np.uint64((key * (2 * r + 1) + r * 0x9E3779B97F4A7C15) % (1 << 64))
            left, right = right, left ^ (mix(right + secret) & mask)
        x[open_] = (left << half) | right
        open_ &= x >= n
    return x.astype(np.int64)


def training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """slot, shard, offset (bytes in the shard), doc_ids, n_tokens and record, in partitions that are the shards, in order."""
    spark = docs.sparkSession
    # splits of files follow the number of cores unless it is set; both passes take the same one
    cores = "spark.sql.files.minPartitionNum"
    if spark.conf.get(cores, None) is None:
        spark.conf.set(cores, str(spark.sparkContext.defaultParallelism))
    # one number for each task that makes sequences, so a broadcast of a few bytes for each
    counts = sequence_counts(docs, doc_id, text, length, vocabulary)
    n = sum(counts.values())
    parts = sorted(counts)
    before = spark.sparkContext.broadcast(dict(zip(parts, np.cumsum([0, *(counts[p] for p in parts)]).tolist())))

    @F.pandas_udf("long")
    def slot(part: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(permuted((part.map(before.value) + place).to_numpy(np.int64), n, key))

    numbered = sequences(docs, doc_id, text, length, vocabulary, counts).withColumn("slot", slot("part", "place"))
    shards = max(1, -(-n // per_shard))
    dealt = numbered.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("slot")
    return dealt.select("slot", "shard", ((F.col("slot") - F.col("shard") * per_shard) * F.length("record")).cast("long").alias("offset"), "doc_ids", "n_tokens", "record")


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _shard_writer(folder: str, index: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's shard as a file; yields a row of the file, or with ``index`` its records' rows with file and sha256."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        waiting, out = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}", None
        shard, n, size, digest = None, 0, 0, hashlib.sha256()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            shard = batch.column("shard")[0].as_py()
            if out is None:
                out = store.open_output_stream(waiting)
            for record in batch.column("record"):
                raw = record.as_py()
                out.write(raw)
                digest.update(raw)
                n, size = n + 1, size + len(raw)
            if index:
                held.append(batch.select(INDEXED))
        if out is not None:
            out.close()
            store.move(waiting, f"{base}/{shard_name(shard)}")
            if not index:
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_records": [n], "n_bytes": [size], "sha256": [digest.hexdigest()]})
            for x in held:
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array([f"{folder}/{shard_name(shard)}"] * len(x)), pa.array([digest.hexdigest()] * len(x))], names=[*INDEXED, "file", "sha256"])

    return write


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's records one after the other; shard, n_records, n_bytes and sha256 of each.

    ``folder`` is a URI that all machines reach. A file appears under its name when it is whole,
    and a task that runs again writes the same bytes, so lost executors leave no half files.
    Nothing is written before the returned table is evaluated.
    """
    return ordered.select("shard", "record").mapInArrow(_shard_writer(folder, False), "shard int, n_records long, n_bytes long, sha256 string")


def training_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the shards to a new folder in the shared one; slot, shard, offset, doc_ids and n_tokens of each record, its file and the file's sha256.

    All files are there when this returns. A task holds the index rows of one shard, not its records.
    """
    folder = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    ordered = training_order(docs, doc_id, text, length, per_shard, key, vocabulary)
    kinds = "slot long, shard int, offset long, doc_ids array<long>, n_tokens int, file string, sha256 string"
    return written(ordered.select(*INDEXED, "record").mapInArrow(_shard_writer(folder, True), kinds), "shard-index")


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences of ``count`` slots from ``first`` on, read by position; ends with the last record."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(dtype).itemsize
    slot, stop = first, first + count
    while slot < stop:
        shard, at = divmod(slot, per_shard)
        path = f"{base}/{shard_name(shard)}"
        info = store.get_file_info(path)
        if info.type != fs.FileType.File or at * stride >= info.size:
            return
        with store.open_input_file(path) as f:
            f.seek(at * stride)
            for _ in range(min(stop - slot, per_shard - at)):
                raw = f.read(stride)
                if not raw:
                    return
                yield np.frombuffer(raw, dtype)
                slot += 1

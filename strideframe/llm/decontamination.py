"""Benchmark decontamination with suffix arrays over the documents.

Each shard (a slice of whole documents) gets a suffix array at word level, sorted by the first
``WINDOW`` words. Sparse: only suffixes whose first words occur together in the benchmark are
kept, as no other can match. Every window of every benchmark item is then binary-searched in
the array; the interval found holds all places of the window in the shard.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters. A window is 13
consecutive words of an item, or the whole item if that has fewer. A document word inside any
place of a window is hit; a document is contaminated if a twentieth of its words is hit.

Null and empty texts have no words: such items have no windows, such documents no hits. Items
with the same id count once; a null item id counts as the empty string. Rows are judged one by
one, so repeated rows get equal answers. The benchmark is read in blocks of bounded size, each
broadcast on its own, so the memory of a task does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.text import ALNUM_WORD, Texts, covered, mix, slices

WINDOW = 13
#: words of a suffix that must occur together in the benchmark
PREFIX = 4
#: bytes of benchmark text in a broadcast block
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_at long"
_PRIME = np.uint64(6364136223846793005)


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = texts.spans(ALNUM_WORD[texts.data])
    return texts.hashes(starts, ends), *texts.of(starts)


def _prefix(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive words at each place that has them."""
    total = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        total = total * _PRIME + words[k : k + len(total)]
    return mix(total + np.uint64(n))


class Windows:
    """The distinct windows of some items, as rows of word numbers filled up with zeros."""

    def __init__(self, names: list[str], texts: pa.Array):
        rows, at, self.vocabulary = [], [], np.zeros(0, np.uint64)
        hashes, owners = [], []
        for a, part in slices(texts, lower=True):
            words, owner, _ = words_of(part)
            hashes.append(words)
            owners.append(owner + a)
        words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        self.vocabulary = np.unique(words)
        numbers = np.searchsorted(self.vocabulary, words).astype(np.int32) + 1
        self.filters = {}
        keys: dict[int, list[np.ndarray]] = {}
        bounds = np.searchsorted(owner, np.arange(len(names) + 1))
        for i in range(len(names)):
            a, b = bounds[i], bounds[i + 1]
            m = min(WINDOW, b - a)
            if m:
                window = np.lib.stride_tricks.sliding_window_view(numbers[a:b], m)
                rows.append(np.pad(window, ((0, 0), (0, WINDOW - m))))
                at.append(np.stack([np.full(len(window), i), np.arange(len(window))], 1))
                keys.setdefault(min(PREFIX, m), []).append(_prefix(words[a:b], min(PREFIX, m))[: len(window)])
        self.names = names
        self.filters = {n: np.unique(np.concatenate(x)) for n, x in keys.items()}
        every = np.concatenate([np.zeros((0, WINDOW), np.int32), *rows])
        self.rows, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        self.width = (self.rows > 0).sum(1)
        order = np.argsort(which.ravel(), kind="stable")
        #: places (item, word) of each window, by window
        self.places = np.concatenate([np.zeros((0, 2), np.int64), *at])[order]
        self.first = np.searchsorted(which.ravel()[order], np.arange(len(self.rows) + 1))
        self.bits = {n: np.zeros(1 << 16, bool) for n in self.filters}
        for n, x in self.filters.items():
            self.bits[n][(x & np.uint64(0xFFFF)).astype(np.int64)] = True


def suffix_array(words: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that can match, sorted, and their first words' numbers (0: none, or not in the benchmark)."""
    keep = np.zeros(len(words), bool)
    for n, known in windows.filters.items():
        key = _prefix(words, n)
        maybe = np.flatnonzero(windows.bits[n][(key & np.uint64(0xFFFF)).astype(np.int64)])
        found = np.minimum(np.searchsorted(known, key[maybe]), len(known) - 1)
        keep[maybe[known[found] == key[maybe]]] = True
    places = np.flatnonzero(keep)
    stop = bounds[np.searchsorted(bounds, places, "right")]
    text = places[:, None] + np.arange(WINDOW)
    inside = text < stop[:, None]
    hashes = words[np.minimum(text, max(len(words) - 1, 0))]
    number = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    number = np.where(inside & (windows.vocabulary[number] == hashes), number + 1, 0).astype(np.int32)
    order = np.lexsort(number.T[::-1])
    return places[order], number[order]


def search(sorted_: np.ndarray, keys: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
    """First row at or after (past, if ``after``) each key, by the key's own words; binary search for all keys at once."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(sorted_))
    used = np.arange(WINDOW) < width[:, None]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        row = sorted_[np.minimum(middle, len(sorted_) - 1)]
        differ = (row != keys) & used
        first = differ.argmax(1)
        one = np.arange(len(keys))
        less = np.where(differ.any(1), row[one, first] < keys[one, first], after)
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each range, and the range each belongs to."""
    size = last - first
    which = np.repeat(np.arange(len(first)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[which], which


def matches(words: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every window that occurs in the shard."""
    if not len(windows.rows) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, text = suffix_array(words, bounds, windows)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, which = _expand(search(text, windows.rows, windows.width, False), search(text, windows.rows, windows.width, True))
    return places[rank], which


class Findings:
    """What the blocks of a benchmark leave in a shard."""

    def __init__(self, texts: Texts):
        self.words, self.owner, self.bounds = words_of(texts)
        self.n = texts.n
        self.hit = np.zeros(len(self.words), bool)
        self.items: list[set[str]] = [set() for _ in range(self.n)]
        self.longest = [(0, "", 0)] * self.n

    def add(self, windows: Windows) -> None:
        place, which = matches(self.words, self.bounds, windows)
        if not len(place):
            return
        self.hit |= covered(place, windows.width[which], len(self.words))
        seen = np.unique(np.stack([self.owner[place], which], 1), axis=0)
        at, row = _expand(windows.first[seen[:, 1]], windows.first[seen[:, 1] + 1])
        for doc, item in np.unique(np.stack([seen[row, 0], windows.places[at, 0]], 1), axis=0).tolist():
            self.items[doc].add(windows.names[item])
        # verbatim matches: windows that follow each other in a document and in an item
        at, row = _expand(windows.first[which], windows.first[which + 1])
        item, word = windows.places[at].T
        start, width = place[row], windows.width[which[row]]
        order = np.lexsort((start, start - word, item))
        item, word, start, width = item[order], word[order], start[order], width[order]
        new = np.ones(len(order), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1) | (word[1:] != word[:-1] + 1) | (self.owner[start[1:]] != self.owner[start[:-1]])
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(order))) + width[head] - 1
        for h, n in zip(head.tolist(), length.tolist(), strict=True):
            doc = int(self.owner[start[h]])
            found = (n, windows.names[int(item[h])], int(start[h] - self.bounds[doc]))
            self.longest[doc] = min(self.longest[doc], found, key=lambda x: (-x[0], x[2], x[1]))


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the items' windows, at most about ``block_bytes`` of text in each; items stream through the driver one at a time."""
    names, texts, size, blocks = [], [], 0, []
    sc = benchmark.sparkSession.sparkContext

    def close() -> None:
        nonlocal names, texts, size
        if names:
            blocks.append(sc.broadcast(Windows(names, pa.array(texts, pa.string()))))
        names, texts, size = [], [], 0

    for row in benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("i"), benchmark[text].alias("t")).where("t is not null").toLocalIterator():
        names.append(row.i)
        texts.append(row.t)
        size += len(row.t)
        if size >= block_bytes:
            close()
    close()
    return blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: the hits, the items, and the longest verbatim match with its word position."""
    blocks = benchmark_blocks(benchmark, item_id, item_text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(1), lower=True, most=SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, part.n), *_columns(part, blocks)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(judge, SCHEMA)


def _judged(part: Texts, blocks: list) -> tuple[Findings, np.ndarray, np.ndarray, np.ndarray]:
    found = Findings(part)
    for block in blocks:
        found.add(block.value)
    n_words, n_hit = np.diff(found.bounds), np.bincount(found.owner[found.hit], minlength=part.n)
    return found, n_words, n_hit, (n_hit > 0) & (20 * n_hit >= n_words)


def _columns(part: Texts, blocks: list) -> list[pa.Array]:
    found, n_words, n_hit, bad = _judged(part, blocks)
    items = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found.items]
    none = np.array([not x[0] for x in found.longest], bool)
    return [
        pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found.items], pa.int64()), pa.array(items), pa.array(bad),
        pa.array([x[0] for x in found.longest], pa.int64()), pa.array([x[1] for x in found.longest], pa.string(), mask=none), pa.array([x[2] for x in found.longest], pa.int64(), mask=none),
    ]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    blocks, place = benchmark_blocks(benchmark, item_id, item_text), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(place), lower=True, most=SHARD_BYTES):
                yield batch.slice(a, part.n).filter(pa.array(~_judged(part, blocks)[3]))

    return docs.mapInArrow(keep, docs.schema)

"""Periodic runs of words: Lyndon arrays by Baier's grouping, extended to runs.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(LEAST, 4 * q)`` that no neighbouring word extends. Each text is read whole in four steps:

1. *Peeling.* A word of a run occurs at least four times in it. So words that are rarer than that
   are taken out, which cuts the text into stretches; stretches of less than ``LEAST`` words, and
   words that are rare inside their stretch, are taken out in turn until nothing changes. No run
   loses a word; prose mostly vanishes.
2. *Grouping.* The first phase of Baier's suffix sorting puts the suffixes of what is left into
   groups, highest first: members of a group hand their context to the nearest unfinished suffix
   before them, which moves to a new group just above its old one. A suffix's last context is the longest
   Lyndon word that begins there, so the phase gives the Lyndon array itself, without the sorting
   of suffixes that would follow. It runs under both orders of the words.
3. *Candidates.* A run's period is the length of a Lyndon word under one of the orders, at the
   first full turn. Places whose Lyndon word is followed by two copies of itself are kept.
4. *Extension.* The longest common extension of the place and the place one period on, to the left
   and to the right by binary search on prefix hashes, gives the run.

Words are compared by 64-bit hashes inside a text. All steps take time in proportion to the text,
but for a logarithm in step 4 and the rounds of step 1. Texts share no work, so nothing is shuffled
and memory is that of a slice of texts, or of the longest one.

A null text has no words. A null id isn't altered by :func:`stuttered` and stays null. Repeated rows
get equal answers. An empty table gives no rows; other columns of the table aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm.text import _STEP, SPACED_WORD, Texts, mix, slices

#: least length of a run, and least number of periods in it
LEAST = 6
TURNS = 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by the first phase of Baier's grouping.

    ``ranks`` are small integers; an end of the word counts as less than anything.
    """
    n = len(ranks)
    size = [1] * n
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group = list(ranks)
    below = list(range(-1, len(members) - 1))  # the next lower group
    above = [*range(1, len(members)), -1]
    free = list(range(-1, n))  # free[i + 1]: the nearest unfinished place at or before i, by union-find
    top = len(members) - 1
    while top >= 0:
        mine = [i for i in members[top] if group[i] == top]
        members[top] = []
        for i in mine:
            free[i + 1] = i - 1
        previous: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while (k := free[j + 1]) != j:
                free[j + 1] = free[k + 1] if k >= 0 else -1
                j = k
            if j >= 0:
                previous[j] = previous.get(j, 0) + 1
        if previous:
            width = size[mine[0]]
            moves = sorted(previous.items(), key=lambda x: -x[1]) if max(previous.values()) > 1 else previous.items()
            made: dict[tuple[int, int], int] = {}
            for j, times in moves:
                old = group[j]
                new = made.get((old, times))
                if new is None:  # just above the old group, below those that took more copies
                    new = made[old, times] = len(members)
                    members.append([])
                    up = above[old]
                    above[old], below[up] = new, new
                    above.append(up)
                    below.append(old)
                members[new].append(j)
                group[j] = new
                size[j] += times * width
            for key in made:
                members[made[key]].sort()
        top = below[top]
    return size


def peeled(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and the stretch of each (0, 1, ...)."""
    at, stretch = np.arange(len(words)), owner
    while len(at):
        order = np.lexsort((words[at], stretch))
        w, s = words[at][order], stretch[order]
        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])))
        counts = np.diff(np.append(first, len(w)))
        keep = np.empty(len(at), bool)
        keep[order] = np.repeat(counts >= TURNS, counts)
        left, owners = at[keep], stretch[keep]
        cut = np.append(True, (np.diff(left) != 1) | (owners[1:] != owners[:-1])) if len(left) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        lengths = np.diff(np.append(first, len(left)))
        long = np.repeat(lengths >= LEAST, lengths)
        left, number = left[long], (np.cumsum(cut) - 1)[long]
        if len(left) == len(at):
            return left, number - number[0] if len(number) else number
        at, stretch = left, number
    return at, np.zeros(0, np.int64)


class _Prefixes:
    """Hashes of stretches of words by prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.up, down = np.full(n + 1, _STEP), np.full(n + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
        self.up[:1], down[:1] = 1, 1
        self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.of(a, length) == self.of(b, length)


def _reach(ok, most: np.ndarray) -> np.ndarray:
    """Largest length up to ``most`` at which a monotone test holds; 0 always does."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        good = ok(middle)
        low = np.where(open_ & good, middle, low)
        high = np.where(open_ & ~good, middle - 1, high)
    return low


def find_runs(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (owner, start, length, period) of all runs; starts count within ``words``.

    ``words`` are 64-bit hashes, ``owner`` the text of each (ascending); runs don't cross texts.
    """
    at, stretch = peeled(words, owner)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    w = words[at]
    bounds = np.append(np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1])), len(at))
    starts, periods = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        ranks = np.unique(w[a:b], return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            q = np.array(lyndon_array(order.tolist()))
            i = np.flatnonzero(np.arange(b - a) + 3 * q <= b - a)
            starts.append(a + i)
            periods.append(q[i])
    i, q = np.concatenate(starts), np.concatenate(periods)
    prefixes = _Prefixes(w)
    ok = prefixes.same(i, i + q, 2 * q)
    i, q = i[ok], q[ok]
    which = np.searchsorted(bounds, i, "right") - 1
    lo, hi = bounds[which], bounds[which + 1]
    right = _reach(lambda k: prefixes.same(i, i + q, k), hi - i - q)
    left = _reach(lambda k: prefixes.same(i - k, i + q - k, k), i - lo)
    length = left + q + right
    good = length >= np.maximum(LEAST, TURNS * q)
    runs = np.stack([owner[at[i - left]], at[i - left], length, q], 1)[good]
    return np.unique(runs, axis=0)


def stutter(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Place and period from which a document's words are made to repeat, if it is one of those."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def stuttered(ids: list[int | None], counts: np.ndarray) -> np.ndarray:
    """For each word of the texts in a row the word that stands in its place."""
    out = np.arange(counts.sum())
    first = 0
    for doc_id, n in zip(ids, counts.tolist(), strict=True):
        if change := stutter(doc_id, n):
            a, p = change
            out[first + a : first + n] = first + a + np.arange(n - a) % p
        first += n
    return out


def _joined(t: Texts, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words joined by one space within each text, and the bounds of the texts."""
    size = ends - starts
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    step = size + ~last
    to = np.cumsum(step) - step
    out = np.full(int(step.sum()), 0x20, np.uint8)
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + k] = t.data[np.repeat(starts, size) + k]
    total = np.bincount(owner, weights=step, minlength=t.n).astype(np.int64)
    return memoryview(out), np.concatenate([[0], np.cumsum(total)])


def _judge(ids: list[int | None], t: Texts) -> Iterator[tuple]:
    starts, ends = t.spans(SPACED_WORD[t.data])
    owner, bounds = t.of(starts)
    source = stuttered(ids, np.diff(bounds))
    words = t.hashes(starts, ends)[source]
    runs = find_runs(words, owner)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 1] + runs[:, 3], 1)
    np.add.at(drop, runs[:, 1] + runs[:, 2], -1)
    kept = np.cumsum(drop[:-1]) == 0
    text, ends_at = _joined(t, starts[source][kept], ends[source][kept], owner[kept])
    by_text = np.searchsorted(runs[:, 0], np.arange(t.n + 1))
    nothing = hashlib.sha256(b"").hexdigest()
    for i, doc_id in enumerate(ids):
        collapsed = hashlib.sha256(text[ends_at[i] : ends_at[i + 1]]).hexdigest()
        mine = runs[by_text[i] : by_text[i + 1], 1:] - [bounds[i], 0, 0]
        if not len(mine):
            yield doc_id, 0, None, None, None, None, nothing, collapsed
            continue
        mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
        digest = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in mine.tolist()).encode()).hexdigest()
        a, n, q = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
        yield doc_id, len(mine), a, n, q, 1000 * n // q, digest, collapsed


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its runs, the longest one, and digests of the runs and of the collapsed text."""
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SCHEMA.split(", ")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in slices(batch.column(1)):
                rows = list(_judge(ids[first : first + part.n], part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(find, SCHEMA)

"""Quality rules as a short-circuit cascade.

A rule rejects documents. Its cost (seconds a document) and its selectivity (share it rejects)
are measured on a bounded sample; rules run in the order of rejections per second, and each
sees only what the ones before let through. The order changes the time only: a document is
kept if no rule rejects it.

Words are runs of characters other than ASCII white space. A null or empty text has no words
and fails the base rule; rows are judged one by one, so repeated rows and ids get equal answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm.text import LINE, SPACED_WORD, Texts, byte_table, covered, grams, repeated, slices, with_owner

SYMBOLS = byte_table(b"#*$%&|<>")
DIGITS = byte_table(range(0x30, 0x3A))
LETTERS = byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean"
WINDOW = 8
#: at most so many documents are timed to find the order
SAMPLE_ROWS = 400


class Measures:
    """Counts of each text of a slice, made when a rule first asks for them."""

    def __init__(self, texts: Texts):
        self.t = texts

    @cached_property
    def inside(self) -> np.ndarray:
        return SPACED_WORD[self.t.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.t.spans(self.inside)

    @cached_property
    def owner(self) -> tuple[np.ndarray, np.ndarray]:
        return self.t.of(self.words[0])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.owner[1])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.t.per_text(self.inside & ((self.t.data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.t.per_text(SYMBOLS[self.t.data])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self.t.per_text(LETTERS[self.t.data] & ((self.t.data & 0xC0) != 0x80))

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self.t.per_text(DIGITS[self.t.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word: owner and whether an equal one came before in the text."""
        a, b = self.t.spans(LINE[self.t.data])
        seen = np.concatenate([[0], np.cumsum(self.inside, dtype=np.int64)])
        full = seen[b] > seen[a]
        a, b = a[full], b[full]
        owner, _ = self.t.of(a)
        return owner, repeated(with_owner(self.t.hashes(a, b), owner))[1]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.t.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        owner, again = self.lines
        return np.bincount(owner[again], minlength=self.t.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        owner = self.owner[0]
        keys, at = grams(self.t.hashes(*self.words), owner, WINDOW)
        twice, _ = repeated(with_owner(keys, owner[at]))
        return np.bincount(owner[covered(at[twice], WINDOW, len(owner))], minlength=self.t.n)

    @cached_property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


Rule = Callable[[Measures], np.ndarray]

#: True where a document is rejected.
RULES: dict[str, Rule] = {
    "symbols": lambda m: 2 * m.n_symbols > m.n_words,
    "word length": lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words),
    "letters": lambda m: 2 * m.n_letters < m.word_chars,
    "digits": lambda m: 4 * m.n_digits > m.word_chars,
    "repeated lines": lambda m: 100 * m.n_dup_lines > 40 * np.maximum(m.n_lines, 1),
}


def order_by_gain(texts: pa.Array, rules: dict[str, Rule]) -> list[str]:
    """Rule names by rejections per second on the sample; of equals the cheaper first."""
    gain = {}
    for name, rule in rules.items():
        spent, out, seen = 0.0, 0, 0
        for _, part in slices(texts):
            measures = Measures(part)
            began = time.perf_counter()
            out += int(rule(measures).sum())
            spent += time.perf_counter() - began
            seen += part.n
        gain[name] = (-(out / max(seen, 1)) / max(spent, 1e-9), spent)
    return sorted(rules, key=lambda name: gain[name])


def cascade(texts: Texts, measures: Measures, open_: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Which documents of ``open_`` no rule rejects; each rule sees what is left only."""
    for rule in rules:
        left = np.flatnonzero(open_)
        if not len(left):
            break
        if 2 * len(left) < texts.n:  # what was counted for the others is of no use any more
            sizes = texts.offsets[left + 1] - texts.offsets[left]
            small = Texts(np.concatenate([texts.data[texts.offsets[i] : texts.offsets[i + 1]] for i in left]), np.concatenate([[0], np.cumsum(sizes)]))
            kept = cascade(small, Measures(small), np.ones(small.n, bool), rules[rules.index(rule) :])
            open_ = np.zeros(texts.n, bool)
            open_[left[kept]] = True
            return open_
        open_ = open_ & ~rule(measures)
    return open_


def plan_rules(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The cascade's order, from a sample of at most ``sample_rows`` documents.

    The sample is read as one row per drawn document; an empty sample keeps the given order.
    """
    rows = docs.select(docs[text].alias("text")).sample(0.05, seed=11).limit(sample_rows).collect()
    return order_by_gain(pa.array([r.text for r in rows], pa.string()), rules) if rows else list(rules)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``."""
    chosen = [rules[x] for x in plan_rules(docs, text, rules)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(1)):
                m = Measures(part)
                counts = [pa.array(getattr(m, c).astype(np.int64)) for c in STATS]
                failed = m.base_failed
                kept = cascade(part, m, ~failed, chosen)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, part.n).cast(pa.int64()), *counts, pa.array(failed), pa.array(kept)], names=["doc_id", *STATS, "base_failed", "kept"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(judge, SCHEMA)


def keep_quality(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """The documents, all columns, that pass the base rule and the cascade."""
    chosen = [rules[x] for x in plan_rules(docs, text, rules)]
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(place)):
                m = Measures(part)
                yield batch.slice(a, part.n).filter(pa.array(cascade(part, m, ~m.base_failed, chosen)))

    return docs.mapInArrow(keep, docs.schema)

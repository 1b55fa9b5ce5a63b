"""Personal data: exact base spans, and further spans chosen by boosted trees.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay.
High-recall generators then propose overlapping candidates (loose numbers, mixed tokens,
loose addresses). Gradient-boosted trees score them on features of their format and of the text
before them; a candidate that overlaps no base span becomes a span if its score reaches a
threshold set for ``PRECISION`` on such candidates of its kind in held-out texts. Of overlapping candidates the best stays.

There are no labelled spans: a training candidate counts as personal if it overlaps a base span
or stands in an assignment to a secret's name. The features hold neither the checks (digit
sums, value ranges) nor that pattern, so that the trees learn formats and contexts. The trees are fitted on
the candidates of all documents but those held out for the thresholds (three in ten, by hash), and the thresholds
are set on all of these; equal candidates are one row with a weight.

Offsets are code points, ends exclusive. A null or empty text has no spans. Rows are judged one
by one, so repeated rows get equal answers. Candidates of one class only, or none, leave the
base spans alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.store import written

PRECISION = 0.95
KINDS = ["email", "ip", "card", "phone", "number", "secret", "address"]
BASE = 4
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehinds change no match: what fails at the start of a run fails inside it too. They
# keep the search linear in texts that are one long run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(2 * x - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match needs its @, so the search goes from one to the next; the local part is all that may stand before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Base spans in order of start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        # a part of any length: only a short one is read as a number
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: high recall: kind and pattern of each generator
GENERATORS = [
    (4, re.compile(r"\+?[0-9(](?:[\x20().-]{0,2}[0-9]){6,}")),
    (5, re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*[0-9])[A-Za-z0-9_/+=-]{12,}")),
    (6, re.compile(r"(?<![^\s@<>\"'])[^\s@<>\"']+@[^\s@<>\"']+")),
]
_ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential)s?\s*[=:]\s*[\"']?$", re.I)
FEATURES = 18


def candidates(text: str) -> list[Span]:
    return [(m.start(), kind, m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    a, kind, b = span
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 2]
    n = len(s)
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    groups = [len(x) for x in re.split(r"[^0-9A-Za-z]+", s) if x]
    counts = np.unique(list(s), return_counts=True)[1] / n
    return [
        float(kind), n, digits, letters, digits / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n, s.count("."), s.count("-"), s.count(" "), s[0] == "+", "(" in s, "@" in s,
        len(groups), max(groups, default=0), -(counts * np.log2(counts)).sum(), before[-1:] in {'"', "'", "=", ":"}, sum(c in "=:\"'" for c in before), after[:1] in {'"', "'"},
    ]


class Taken:
    """Disjoint stretches of a text in order; spans that touch a stretch join it."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, span: Span) -> bool:
        i = bisect_left(self.starts, span[2])
        return i > 0 and self.ends[i - 1] > span[0]

    def add(self, span: Span) -> None:
        """Takes a span that overlaps none."""
        i = bisect_left(self.starts, span[0])
        self.starts.insert(i, span[0])
        self.ends.insert(i, span[2])


def weak_label(text: str, span: Span, base: Taken) -> int:
    return int(base.overlaps(span) or bool(_ASSIGNED.search(text[max(0, span[0] - 32) : span[0]])))


@dataclass
class Trees:
    """Boosted regression trees as arrays, and the score from which a candidate counts, by kind."""

    weights: list[float] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature (-1: leaf), limit or value, left, right
    thresholds: dict[int, float] = field(default_factory=dict)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for weight, (feature, value, left, right) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                go = np.where(rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= value[at], left[at], right[at])
                at = np.where(inner, go, at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def read_trees(description: str) -> Trees:
    """Trees from a fitted model's ``toDebugString``."""
    out, lines = Trees(), [x.strip() for x in description.splitlines()[1:] if x.strip()]
    at = 0

    def node(feature: list, value: list, left: list, right: list) -> int:
        nonlocal at
        here, line = len(feature), lines[at]
        at += 1
        if m := re.fullmatch(r"Predict: (\S+)", line):
            for column, x in zip((feature, value, left, right), (-1, float(m[1]), 0, 0), strict=True):
                column.append(x)
            return here
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        for column, x in zip((feature, value, left, right), (int(m[1]), float(m[2]), 0, 0), strict=True):
            column.append(x)
        left[here] = node(feature, value, left, right)
        at += 1  # the Else of the same split
        right[here] = node(feature, value, left, right)
        return here

    while at < len(lines):
        out.weights.append(float(re.fullmatch(r"Tree \d+ \(weight (\S+)\):", lines[at])[1]))
        at += 1
        columns: tuple[list, list, list, list] = ([], [], [], [])
        node(*columns)
        out.trees.append(tuple(np.array(x) for x in columns))
    return out


def calibrated(scores: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """Least score at and above which the held-out candidates reach the precision; 2 where none does."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    ends = np.append(scores[order][1:] != scores[order][:-1], True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & ends)
    return float(scores[order][good[-1]]) if len(good) else 2.0


def thresholds(held: DataFrame, precision: float = PRECISION) -> dict[int, float]:
    """``calibrated`` for each kind of ``(kind, score, label)``, without a kind in one task.

    Equal scores are counted first. Running counts stay inside a stretch of scores and start from the totals of the stretches above it.
    Kinds that never reach the precision are left out.
    """
    n = written(held.groupBy("kind", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right")).withColumn("at", F.floor(F.col("score") * 1024)), "pii-scores")
    above = Window.partitionBy("kind").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("kind", "at").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    totals = n.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    totals = totals.select("kind", "at", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "right")])
    run = n.join(totals, ["kind", "at"]).select("kind", "score", *[(F.sum(c).over(upto) + F.col(f"{c}_above")).alias(c) for c in ("n", "right")])
    return {int(r.kind): r.least for r in run.where(F.col("right") / F.col("n") >= precision).groupBy("kind").agg(F.min("score").alias("least")).collect()}


def fit(docs: DataFrame, text: str = "text") -> Trees:
    """Trees fitted on the candidates of all texts with a digit or @.

    Three in ten of the texts, by hash, are held out for the thresholds.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, held = [], [], []
            for s in batch.column(0).to_pylist():
                base, out = Taken(base_spans(s)), hashlib.md5(s.encode()).digest()[0] % 10 < 3
                for span in candidates(s):
                    if out and base.overlaps(span):
                        continue  # the threshold decides on the others only
                    x.append([float(v) for v in features(s, span)])
                    y.append(float(weak_label(s, span, base)))
                    held.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(held, pa.bool_())], names=["x", "label", "held"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array(trees.scores(x)), batch.column(1)], names=["kind", "score", "label"])

    t = docs.select(docs[text].alias("t")).where("t rlike '[0-9@]'")
    found = written(t.mapInArrow(rows, "x array<double>, label double, held boolean"), "pii-candidates")
    # equal candidates are one row with a weight; in a fixed order, so that a run can be repeated
    fold = written(found.where("not held").groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")).sortWithinPartitions("x", "label"), "pii-training")
    if fold.select("label").distinct().count() < 2:
        return Trees()
    frame = fold.select(array_to_vector("x").alias("features"), "label", "weight")
    model = GBTClassifier(maxIter=12, maxDepth=3, seed=1, weightCol="weight").fit(frame)
    trees = read_trees(model.toDebugString)
    trees.thresholds = thresholds(found.where("held").select("x", "label").mapInArrow(scored, "kind long, score double, label double"))
    return trees


def all_spans(text: str, trees: Trees, base: list[Span] | None = None) -> list[Span]:
    """Base spans and the chosen candidates, by start and kind."""
    base = base_spans(text) if base is None else base
    taken = Taken(base)
    open_ = [x for x in candidates(text) if trees.thresholds.get(x[1], 2.0) <= 1 and not taken.overlaps(x)] if trees.trees else []
    if not open_:
        return base
    scores, chosen = trees.scores(np.array([features(text, x) for x in open_], float)), []
    for i in sorted(range(len(open_)), key=lambda i: (-scores[i], open_[i])):
        if scores[i] >= trees.thresholds[open_[i][1]] and not taken.overlaps(open_[i]):
            chosen.append(open_[i])
            taken.add(open_[i])
    return sorted(base + chosen)


_MAYBE = r"[0-9@]"


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: Trees | None = None) -> DataFrame:
    """One row per document: counts of the base spans, their digest, and all spans."""
    trees = fit(docs, text) if trees is None else trees

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = len(texts)
            counts, digest, spans = np.zeros((BASE, n), np.int64), [nothing] * n, [""] * n
            for i in np.flatnonzero(pc.match_substring_regex(texts, _MAYBE).to_numpy(zero_copy_only=False)):
                s = texts[i].as_py()
                base = base_spans(s)
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(all_spans(s, trees, base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(find, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """The documents, all columns, with personal data replaced in the text; a null text stays null."""
    trees = fit(docs, text) if trees is None else trees
    place = docs.columns.index(text)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts = pc.fill_null(column, "")
            at = np.flatnonzero(pc.match_substring_regex(texts, _MAYBE).to_numpy(zero_copy_only=False))
            if len(at):
                mask = np.zeros(len(texts), bool)
                mask[at] = True
                new = pa.array([redacted(s, all_spans(s, trees)) for s in (texts[i].as_py() for i in at)], column.type)
                column = pc.replace_with_mask(column, pa.array(mask), new)
            columns = list(batch.columns)
            columns[place] = column
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(change, docs.schema)

"""N-gram Jaccard self-join of documents by MinHash banding.

A document is its set of runs of five words (words are split at ASCII white space; a text of
one to four words is one run). Documents with equal sets are one *copy class*. Class
representatives are hashed into bands; a shared band makes two classes candidates, and
candidates are verified on their full sets.

No group is ever multiplied out into rows. Candidate components of up to ``BLOCK`` classes are
verified together; larger ones are cut into blocks and every pair of blocks is a unit of its
own, so a unit holds at most two blocks whatever the group's size. Within a unit a matrix
product over shared runs gives all intersections, and a unit returns one row per member: the
number of documents linked to it and one edge of a spanning forest.

Texts without words (null, empty, blank) have no runs and are linked to nothing. Repeated rows
are copies. A document id may be null or repeated: nodes are named by content. Names are 64-bit
hashes of the set, so among n distinct texts a false merge has a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.components import components
from strideframe.llm.store import written
from strideframe.llm.text import SPACED_WORD, Texts, grams, mix, repeated, slices, with_owner

GRAM = 5
#: similarity 4/5
SIMILARITY = (4, 5)
RECALL = 0.9999
#: classes in a block of a verification unit
BLOCK = 256


def bands_for(similarity: float, recall: float, rows: int = 7) -> tuple[int, int]:
    """Number of bands of ``rows`` rows that find a pair of that similarity with that chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def shingles(texts: Texts, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, in text order, and their texts."""
    starts, ends = texts.spans(SPACED_WORD[texts.data])
    owner, bounds = texts.of(starts)
    words, count = texts.hashes(starts, ends), np.diff(bounds)
    keys, at = grams(words, owner, n)
    parts, owners = [keys], [owner[at]]
    for k in range(1, n):
        few = count[owner] == k
        keys, at = grams(words[few], owner[few], k)
        parts.append(keys)
        owners.append(owner[few][at])
    keys, owners = np.concatenate(parts), np.concatenate(owners)
    if (count < n).any():
        order = np.argsort(owners, kind="stable")
        keys, owners = keys[order], owners[order]
    _, extra = repeated(with_owner(keys, owners))
    return keys[~extra], owners[~extra]


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def set_names(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, from order-free sums over its members."""
    size = np.diff(bounds).astype(np.uint64)
    return mix(_totals(mix(keys), bounds) + size), mix(_totals(mix(keys ^ np.uint64(0x5DEECE66D)), bounds) ^ size)


class Banding:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.flip = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.scale = draw.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Band hashes, one row for each text that has keys."""
        low = (keys >> np.uint64(32)).astype(np.uint32)
        first = bounds[:-1][np.diff(bounds) > 0]
        least = np.empty((self.bands * self.rows, len(first)), np.uint32)
        work = np.empty_like(low)
        for k in range(self.bands * self.rows):
            np.bitwise_xor(low, self.flip[k], out=work)
            np.multiply(work, self.scale[k], out=work)
            least[k] = np.minimum.reduceat(work, first) if len(first) else 0
        out = np.empty((len(first), self.bands), np.uint64)
        for b in range(self.bands):
            total = np.full(len(first), b + 1, np.uint64)
            for row in least[b * self.rows : (b + 1) * self.rows]:
                total = mix(total + row)
            out[:, b] = total
        return out


def _named(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, owner = shingles(texts)
    bounds = np.searchsorted(owner, np.arange(texts.n + 1))
    return keys, bounds, np.diff(bounds), *set_names(keys, bounds)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, node and check (names of the set, null without words) and bands of every document."""
    banding = Banding(*bands_for(similarity[0] / similarity[1], recall))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(1)):
                keys, bounds, size, node, check = _named(part)
                none = size == 0
                bands = banding(keys, bounds)
                width = np.where(none, 0, banding.bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, part.n), pa.array(node.view(np.int64), mask=none), pa.array(check.view(np.int64), mask=none), lists], names=["doc_id", "node", "check", "bands"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(sign, "doc_id long, node long, check long, bands array<long>")


def _spanning(linked: np.ndarray) -> np.ndarray:
    """Parent of each member in a spanning forest of the links, -1 at roots."""
    parent, open_ = np.full(len(linked), -1), np.ones(len(linked), bool)
    for root in range(len(linked)):
        queue = [root] if open_[root] else []
        open_[root] = False
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & open_)
            parent[new], open_[new] = x, False
            queue += new.tolist()
    return parent


def verify_unit(members: pd.DataFrame, similarity: tuple[int, int]) -> pd.DataFrame:
    """Exact links of a unit: within its block, or between its two blocks."""
    sets = [np.frombuffer(x, np.uint64) for x in members["keys"]]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, col = row[count[col] > 1], col[count[col] > 1]
    ids, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, len(ids), 4096):
        a, b = np.searchsorted(col, [c, c + 4096])
        hit = np.zeros((len(sets), 4096), np.float32)
        hit[row[a:b], col[a:b] - c] = 1
        common += hit @ hit.T
    p, q = similarity
    linked = common * (p + q) >= p * (size[:, None] + size[None, :])
    block, weight = members["block"].to_numpy(), members["size"].to_numpy()
    linked &= (block[:, None] != block[None, :]) | bool(members["i"].iloc[0] == members["j"].iloc[0])
    np.fill_diagonal(linked, False)
    parent, node = _spanning(linked), members["node"].to_numpy()
    return pd.DataFrame({"node": node, "links": linked @ weight, "parent": pd.array(np.where(parent < 0, 0, node[parent]), dtype="Int64").copy()}).assign(parent=lambda d: d["parent"].mask(parent < 0))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, and node.

    ``copy_id`` is the least id with the same set, ``class_id`` the least id that links lead to,
    ``n_links`` the number of other documents at or above the similarity (copies included).
    A document without words has its own id as both and no links.
    """
    return _grouped(docs, doc_id, text, similarity, recall).drop("component")


def _grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``near_duplicates`` with the component, the least node that links lead to."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed = written(signatures(docs, similarity=similarity, recall=recall), "signatures")
    classes = signed.where("node is not null").groupBy("node", "check").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    stars = banded.join(shared, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    candidates = components(stars)
    linked = written(_verified(docs, classes, candidates, similarity), "links")
    groups = components(linked.where("parent is not null").select(F.col("node").alias("u"), F.col("parent").alias("v")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.drop("bands").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "component").select("node", "check", "component", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return signed.drop("bands").join(named, ["node", "check"], "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "component")


def _verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """node, links, parent of every unit's members."""
    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = candidates.join(sizes, "component").join(classes.drop("bands"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(0)):
                keys, bounds, _, node, check = _named(part)
                rows = batch.slice(a, part.n)
                mine = (rows.column(1).to_numpy() == node.view(np.int64)) & (rows.column(2).to_numpy() == check.view(np.int64))
                held = pa.array([keys[bounds[i] : bounds[i + 1]].tobytes() for i in range(part.n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], held], names=["node", "check", "component", "blocks", "size", "keys"]).filter(pa.array(mine))

    found = _with_text(docs, wanted).mapInArrow(sets, "node long, check long, component long, blocks int, size long, keys binary").dropDuplicates(["node", "check"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "size", "keys")
    return units.groupBy("component", "i", "j").applyInPandas(lambda members: verify_unit(members, similarity), "node long, links long, parent long")


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the rows that carry a wanted class's id and set, so rows of one id don't meet all its classes."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(1)):
                *_, size, node, check = _named(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, part.n).columns, pa.array(node.view(np.int64), mask=size == 0), pa.array(check.view(np.int64), mask=size == 0)], names=["doc_id", "text", "node", "check"])

    d, w = docs.select("doc_id", "text").mapInArrow(name, "doc_id long, text string, node long, check long").alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.copy_id")) & (F.col("d.node") == F.col("w.node")) & (F.col("d.check") == F.col("w.check"))
    return d.join(w, same).select("d.text", "w.node", "w.check", "w.component", "w.blocks", "w.size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one left of each near-duplicate class: the least id's.

    Of repeated rows of that id, or several texts under it, one stays; a null id comes last.
    Documents without words all stay.
    """
    found = _grouped(docs, doc_id, text).where("node is not null")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"))
    found = least.select(F.col("least.node").alias("_node"), F.col("least.doc_id").alias("_id"))
    place, names = docs.columns.index(text), [*docs.columns, "_node"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in slices(batch.column(place)):
                *_, size, node, _ = _named(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, part.n).columns, pa.array(node.view(np.int64), mask=size == 0)], names=names)

    schema = docs.select("*", F.lit(0).cast("long").alias("_node")).schema
    schema["_node"].nullable = True
    rows = docs.mapInArrow(name, schema)
    blank = rows.where("_node is null").drop("_node")
    one = rows.where("_node is not null").join(found, "_node").where(F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))).dropDuplicates(["_node"])
    return one.select(*[one[c] for c in docs.columns]).union(blank)

"""Prefix trie of rebuilt conversations: union-find over sorted-neighbour LCP edges.

A node of depth d is a distinct sequence of d turns; conversations that begin with it are its
members. The trie is built from the sorted sequences:

1. Turns are numbered inside their conversation and rebuilt ones are put together. A turn is kept
   as two 64-bit hashes of its place, role and text, and its length; texts go no further.
2. A conversation is cut into blocks of ``BLOCK`` turns, so no row grows with it. A block's key is
   the hash of all turns before it, which names the node that the block hangs from. Blocks are
   sorted by range over (key, turns, conversation): common prefixes become neighbours.
3. *Forests.* Every chunk of a partition is joined up alone: edges between neighbouring rows, weighted by the
   length of their common prefix, are taken in descending depth by union-find; a merge of components
   makes a branching node, or widens the one already there at that depth. Nodes between two
   branchings have one child each and are written out from their compact edge.
4. *Contraction.* Only nodes that hold the first or last row of a chunk can go on in another chunk. These
   few (a path down either side) stay open: they carry sums over their finished subtrees, are merged
   across chunks by node, and hand their totals to their ancestors. All others are final at once.
5. Blocks past the first are joined up once before, and their totals are laid on the node they hang
   from, by way of its least member, for all blocks above.

Everything is a shuffle by node, by conversation or by range. A node with very many members or
children is spread over many chunks, each of which adds one row to its sums. The digest of the
conversations that end at one node is a sequential hash by definition: one task reads its ids in
order as a stream, in pieces of one chunk.

Nulls: a turn without conversation is left out; null role or text is empty; a null turn comes first.
Turns of a conversation with the same number stand in the order of role, then of a hash of role and text; repeated
rows are turns of their own. ``c % 5`` has the sign of c. An empty table has no node. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.store import written
from strideframe.operators.ordered import number_rows

#: turns in a block
BLOCK = 64
#: rows joined up at a time
CHUNK = 10_000
FAMILY = 5
HEADS = 9
#: turns of one conversation numbered, and of one joined, by one task
_NUMBERS, _SALT = 1024, 4096
NOTHING = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _head(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string")) % HEADS


def _base(conv: Column) -> Column:
    return conv - conv % FAMILY


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, idx, h1, h2, bytes) of each turn in its original place."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    block = F.coalesce(F.floor(F.col("turn") / _NUMBERS), F.lit(-(1 << 62)))
    return number_rows(t, ["conv"], ["turn", "role", "h1", "h2"], block, "idx").select("conv", "idx", "h1", "h2", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, pos, m, h1, h2, bytes): turns of the rebuilt conversations of m turns; pos is null in a turnless one."""
    n = turns.groupBy("conv").agg(F.count("*").alias("n"))
    have = n.select(F.col("conv").alias("base"), F.col("n").alias("have"))
    sizes = n.join(have, F.col("base") == _base(F.col("conv")), "left").withColumn("h", _head(F.col("conv")))
    sizes = sizes.withColumn("taken", F.least("h", F.coalesce("have", F.lit(0)))).withColumn("m", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    sizes = sizes.select("conv", "n", "h", "taken", "m")
    own = turns.where(F.col("idx") >= _head(F.col("conv"))).withColumn("own", F.lit(True))
    first = turns.where((F.col("conv") % FAMILY == 0) & (F.col("idx") < HEADS - 1))
    near = F.sequence(F.when(F.col("conv") <= 0, 1 - FAMILY).otherwise(0), F.when(F.col("conv") >= 0, FAMILY - 1).otherwise(0))
    first = first.withColumn("k", F.explode(near)).withColumn("to", F.try_add(F.col("conv"), F.col("k")))
    first = first.where((_base(F.col("to")) == F.col("conv")) & (F.col("idx") < _head(F.col("to")))).select(F.col("to").alias("conv"), "idx", "h1", "h2", "bytes", F.lit(False).alias("own"))
    both = own.unionByName(first).withColumn("_salt", F.when(F.col("own"), F.floor(F.col("idx") / _SALT)).otherwise(0).cast("long"))
    salted = sizes.select("conv", "h", "taken", "m", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _SALT).cast("long"))).alias("_salt"))
    pos = F.when(F.col("own"), F.col("idx") - F.col("h") + F.col("taken")).otherwise(F.col("idx"))
    rows = both.join(salted, ["conv", "_salt"]).select("conv", pos.cast("long").alias("pos"), "m", "h1", "h2", "bytes")
    none = F.lit(None).cast("long")
    return rows.unionByName(sizes.where("m = 0").select("conv", none.alias("pos"), "m", none.alias("h1"), none.alias("h2"), none.alias("bytes")))


def blocked(rows: DataFrame, block: int) -> DataFrame:
    """(blk, p1, p2, seq, conv, goes_on): blocks of turns under the hash of all turns before them."""
    x1, x2 = F.xxhash64("pos", "h1", "h2"), F.xxhash64("h2", "pos", "h1")
    one = rows.select("conv", "m", F.coalesce(F.floor(F.col("pos") / block), F.lit(0)).cast("long").alias("blk"), F.when(F.col("pos").isNotNull(), F.struct("pos", x1.alias("x1"), x2.alias("x2"), "bytes")).alias("s"))
    b = one.groupBy("conv", "blk", "m").agg(F.sort_array(F.collect_list("s")).alias("seq"), F.bit_xor("s.x1").alias("s1"), F.bit_xor("s.x2").alias("s2"))
    b = written(b.withColumn("seq", F.transform("seq", lambda s: F.struct(s.x1, s.x2, s.bytes))), "blocks")
    before = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    keys = b.where(F.col("m") > block).select("conv", "blk", F.bit_xor("s1").over(before).alias("p1"), F.bit_xor("s2").over(before).alias("p2"))
    some = b.where(F.col("m") > block).join(keys, ["conv", "blk"])
    b = b.where(F.col("m") <= block).withColumns({"p1": F.lit(0), "p2": F.lit(0)}).unionByName(some)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return b.select("blk", zero("p1"), zero("p2"), "seq", "conv", (F.col("m") > (F.col("blk") + 1) * block).alias("goes_on"))


_FOREST = (
    "kind int, chunk long, level int, id1 long, id2 long, up1 long, up2 long, depth long, conv long, parent long, n long, kids long, leaves long, saved long, bytes long, "
    "goes_on boolean, ends string, above array<struct<id1:long,id2:long>>"
)
CLOSED, OPEN, ENDS = 0, 1, 2


class _Chunk:
    """The forest of neighbouring rows."""

    def __init__(self, batch: pa.RecordBatch, number: int, block: int):
        names = batch.schema.names
        col = {n: batch.column(i) for i, n in enumerate(names)}
        self.number, self.block, self.rows = number, block, batch.num_rows
        array = lambda n: col[n].to_numpy(zero_copy_only=False)
        self.blk, self.p1, self.p2, self.conv, self.goes_on = (array(n) for n in ("blk", "p1", "p2", "conv", "goes_on"))
        self.more_leaves, self.more_saved, self.more_kids = (array(n) for n in ("more_leaves", "more_saved", "more_kids"))
        seq = col["seq"]
        flat = seq.flatten()
        self.size = np.diff(np.asarray(seq.offsets))
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.x1, self.x2, self.bytes = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x1", "x2", "bytes"))
        # running values with a 0 before the first
        self.c1 = np.concatenate([[0], np.bitwise_xor.accumulate(self.x1)]).astype(np.int64)
        self.c2 = np.concatenate([[0], np.bitwise_xor.accumulate(self.x2)]).astype(np.int64)
        self.sums = np.concatenate([[0], np.cumsum(self.bytes)]).astype(np.int64)

    def name(self, row, depth):
        """Hashes of the node at a depth of a row."""
        a, b = self.off[row], self.off[row] + depth
        return self.p1[row] ^ self.c1[a] ^ self.c1[b], self.p2[row] ^ self.c2[a] ^ self.c2[b]

    def common(self) -> np.ndarray:
        """Common prefix of each row with the next; -1 where they hang from different nodes."""
        same = (self.blk[1:] == self.blk[:-1]) & (self.p1[1:] == self.p1[:-1]) & (self.p2[1:] == self.p2[:-1])
        out = np.where(same, 0, -1)
        at, most = np.flatnonzero(same), np.minimum(self.size[1:], self.size[:-1])
        depth = 0
        while len(at := at[most[at] > depth]):
            a, b = self.off[at] + depth, self.off[at + 1] + depth
            at = at[(self.x1[a] == self.x1[b]) & (self.x2[a] == self.x2[b])]
            depth += 1
            out[at] = depth
        return out

    def forest(self) -> None:
        """Compact nodes: the rows, then the branchings in the order in which they arise."""
        m, common = self.rows, self.common()
        depth, first, last, parent = self.size.tolist(), list(range(m)), list(range(m)), [-1] * m
        root, top = list(range(m)), list(range(m))  # components of neighbours and their topmost node
        edges = np.argsort(-common, kind="stable")  # of one depth from left to right
        for e, d in zip(edges.tolist(), common[edges].tolist(), strict=True):
            if d < 0:
                break
            a, b = e, e + 1
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            left, right = top[a], top[b]
            if left < m or depth[left] != d:
                depth.append(d)
                first.append(first[left])
                last.append(last[left])
                parent.append(-1)
                parent[left] = left = len(depth) - 1
            parent[right] = left
            last[left] = last[right]
            root[b] = a
            top[a] = left
        self.depth, self.first, self.last, self.parent = (np.array(x, np.int64) for x in (depth, first, last, parent))

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.forest()
        m, depth, first, last, parent = self.rows, self.depth, self.first, self.last, self.parent
        k = len(depth)
        up = np.where(parent >= 0, depth[parent], -1)
        n = last - first + 1
        real = depth > up  # a row that ends at its branching has no node of its own
        open_ = (first == 0) | (last == m - 1)
        # the rows that end at a node lead its stretch of rows
        holder = np.where(real[:m], np.arange(m), parent[:m])
        at_end = np.bincount(holder, minlength=k)
        kids = np.bincount(parent[(parent >= 0) & real], minlength=k)
        closed_kids = np.bincount(parent[(parent >= 0) & real & ~open_], minlength=k)
        on = np.bincount(holder, weights=self.goes_on, minlength=k) > 0
        more = [np.zeros(k, np.int64) for _ in range(3)]
        for total, values in zip(more, (self.more_leaves, self.more_saved, self.more_kids), strict=True):
            np.add.at(total, holder, values)
        least = self._least()
        sums = self.sums
        path = np.where(real, sums[self.off[first] + depth] - sums[self.off[first] + np.maximum(up, 0)], 0)  # bytes on the compact edge
        # sums over subtrees, children before parents
        leaves = (more[0] + ((kids == 0) & ~on & real)).tolist()
        saved = more[1].tolist()
        below_l, below_s = more[0].tolist(), more[1].tolist()  # without open children and what a node adds itself
        own = ((n - 1) * path).tolist()
        for v, (p, is_real, is_open) in enumerate(zip(parent.tolist(), real.tolist(), open_.tolist(), strict=True)):
            if p >= 0 and is_real:
                leaves[p] += leaves[v]
                saved[p] += saved[v] + own[v]
                if not is_open:
                    below_l[p] += leaves[v]
                    below_s[p] += saved[v] + own[v]
        leaves, saved, below_l, below_s = (np.array(x, np.int64) for x in (leaves, saved, below_l, below_s))
        ends: list[str | None] = [None] * k
        for v in np.flatnonzero(real & (at_end > 0)).tolist():
            a = int(first[v])
            ids = self.conv[a : a + int(at_end[v])][~self.goes_on[a : a + int(at_end[v])]]
            if len(ids):
                ends[v] = ",".join(map(str, ids.tolist()))
        # every depth on a compact edge is a node; an edge from depth 0 of a later block is a place to hang from
        count = np.where(real, depth - up, 0)
        v = np.repeat(np.arange(k), count)
        level = depth[v] - (np.arange(len(v)) - np.repeat(np.cumsum(count) - count, count))
        row, bottom = first[v], level == depth[v]
        later = self.blk[row] > 0
        is_open = open_[v] | ((level == 0) & later)
        partly = open_[v]
        id1, id2 = self.name(row, level)
        up1, up2 = self.name(row, np.maximum(level - 1, 0))
        at_top = level == up[v] + 1
        p = parent[v]
        hanging = at_top & ((p < 0) | open_[p]) | (level == 1) & later
        above_conv = np.where(at_top, least[p], least[v])
        rest = sums[self.off[row] + depth[v]] - sums[self.off[row] + np.maximum(level - 1, 0)]
        zero = np.zeros(len(v), np.int64)
        values = {
            "kind": np.where(is_open, OPEN, CLOSED).astype(np.int32), "chunk": zero + self.number, "level": level.astype(np.int32), "id1": id1, "id2": id2, "up1": up1, "up2": up2,
            "depth": self.blk[row] * self.block + level, "conv": least[v], "parent": pa.array(above_conv, mask=hanging), "n": n[v],
            "kids": np.where(bottom, np.where(partly, closed_kids[v], kids[v]) + more[2][v], np.where(partly, 0, 1)),
            "leaves": np.where(partly, np.where(bottom, below_l[v], 0), leaves[v]), "saved": np.where(partly, np.where(bottom, below_s[v], 0), saved[v] + (n[v] - 1) * rest),
            "bytes": np.where(level > 0, sums[self.off[row] + level] - sums[self.off[row] + np.maximum(level - 1, 0)], 0), "goes_on": bottom & on[v],
        }
        digest = [NOTHING] * len(v)
        pieces: list[tuple[int, str]] = []
        for i in np.flatnonzero(bottom).tolist():
            if (ids := ends[v[i]]) is not None:
                if is_open[i]:
                    pieces.append((i, ids))
                else:
                    digest[i] = hashlib.sha256(ids.encode()).hexdigest()
        above: list[list[dict] | None] = [None] * len(v)
        for i in np.flatnonzero(is_open).tolist():
            a, b = self.name(int(row[i]), np.arange(int(level[i])))
            above[i] = [{"id1": x, "id2": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield _batch({**values, "ends": digest, "above": above})
        if pieces:
            at = np.array([i for i, _ in pieces])
            firsts = self.conv[[int(first[v[i]]) + int(np.argmin(self.goes_on[first[v[i]] : first[v[i]] + at_end[v[i]]])) for i in at]]
            only = {c: x[at] if isinstance(x, np.ndarray) else x.take(pa.array(at)) for c, x in values.items()}
            yield _batch({**only, "kind": np.full(len(at), ENDS, np.int32), "conv": firsts, "ends": [x for _, x in pieces], "above": [None] * len(at)})

    def _least(self) -> np.ndarray:
        """Least conversation of each node; a child comes before its parent."""
        values = np.concatenate([self.conv, np.full(len(self.depth) - self.rows, np.iinfo(np.int64).max)]).tolist()
        for v, p in enumerate(self.parent.tolist()):
            if p >= 0 and values[v] < values[p]:
                values[p] = values[v]
        return np.array(values, np.int64)


def _batch(columns: dict) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    arrays, names = [], []
    for part in _FOREST.split(", "):
        name, _, kind = part.partition(" ")
        of = types.get(kind, pa.list_(pa.struct([("id1", pa.int64()), ("id2", pa.int64())])))
        value = columns[name]
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, of))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def forests(blocks: DataFrame, block: int, chunk: int) -> DataFrame:
    """Closed nodes, parts of open nodes and pieces of the ids that end at open nodes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                yield from _Chunk(batch.slice(a, chunk), number, block).batches()
                number += 1

    keys = ["blk", "p1", "p2", "seq", "conv"]
    return written(blocks.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(build, _FOREST), "forests")


def _digests(pieces: DataFrame) -> DataFrame:
    """(level, id1, id2, ends): digest of the ids of each node, read in order as a stream."""
    keys = ["level", "id1", "id2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            *ids, texts = (c.to_pylist() for c in batch.columns[:3] + batch.columns[4:])
            for *now, text in zip(*ids, texts, strict=True):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            if done:
                yield _digest_batch(done)
        if key is not None:
            yield _digest_batch([(*key, state.hexdigest())])

    p = pieces.select(*keys, "conv", "ends").repartition(*keys).sortWithinPartitions(*keys, "conv")
    return p.mapInArrow(run, "level int, id1 long, id2 long, ends string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("level", pa.int32()), ("id1", pa.int64()), ("id2", pa.int64()), ("ends", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def merged(parts: DataFrame) -> DataFrame:
    """Open nodes over all chunks, with their children and the totals of their subtrees."""
    key = ["level", "id1", "id2"]
    same = ["depth", "bytes", "up1", "up2", "above"]
    sums = ["n", "kids", "leaves", "saved"]
    o = parts.where(F.col("kind") == OPEN).groupBy(*key).agg(
        *[F.any_value(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in sums], F.min("conv").alias("conv"), F.max("goes_on").alias("goes_on")
    )
    o = written(o, "open")
    children = o.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count("*").alias("more"))
    o = o.join(children, key, "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0)))
    leaf = ((F.col("kids") == 0) & ~F.col("goes_on")).cast("long")
    each = o.select(
        F.posexplode(F.concat("above", F.array(F.struct("id1", "id2")))).alias("level", "node"), (F.col("leaves") + leaf).alias("l"), (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("s")
    )
    totals = each.groupBy("level", F.col("node.id1").alias("id1"), F.col("node.id2").alias("id2")).agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved"))
    return o.drop("leaves", "saved", "more", "above").join(totals, key)


def _weighted(blocks: DataFrame, deep: DataFrame | None) -> DataFrame:
    """Blocks with what hangs below their conversation in later blocks, where it is the least member there."""
    names = ["more_leaves", "more_saved", "more_kids"]
    if deep is None:
        return blocks.withColumns({c: F.lit(0).cast("long") for c in names})
    after = Window.partitionBy("conv").orderBy(F.desc("blk"))
    totals = deep.groupBy("conv", "blk").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("kids").alias("more_kids"))
    # laid on every block of the conversation above the one it was found in
    longer = blocks.join(totals.select("conv").distinct(), "conv", "left_semi").select("conv", "blk")
    w = longer.join(totals.withColumn("blk", F.col("blk") - 1), ["conv", "blk"], "left")
    w = w.select("conv", "blk", F.sum("leaves").over(after).alias("more_leaves"), F.sum("saved").over(after).alias("more_saved"), "more_kids")
    return blocks.join(w, ["conv", "blk"], "left").fillna(0, names)


def prefix_trie(conversations: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    blocks = blocked(rebuilt(written(numbered(conversations), "turns")), block)
    blocks = written(blocks, "keyed")
    deep, later = None, blocks.where("blk > 0")
    if later.limit(1).count():
        top = merged(forests(_weighted(later, None), block, chunk)).where("level = 0")
        deep = top.select("conv", (F.col("depth") / block).cast("long").alias("blk"), "leaves", "saved", "kids")
    parts = forests(_weighted(blocks, deep), block, chunk)
    nodes = written(merged(parts), "merged")
    key = ["id1", "id2"]
    # a later block hangs from the last level of the block before, which has the same hashes
    lasts = parts.where((F.col("kind") == CLOSED) & (F.col("level") == block)).select(*key, "conv")
    name = lasts.unionByName(nodes.select(*key, "conv")).groupBy(*key).agg(F.min("conv").alias("parent"))
    up = [F.col(a).alias(b) for a, b in (("id1", "up1"), ("id2", "up2"))]
    closed = parts.where(F.col("kind") == CLOSED)
    here = parts.where(F.col("kind") == OPEN).select("chunk", *key).distinct().join(name, key).select("chunk", *up, "parent")
    hanging = closed.where("parent is null").drop("parent").join(here, ["chunk", "up1", "up2"])
    out = ["conv", "depth", "parent", "n", "kids", "leaves", "saved", "ends"]
    open_ = nodes.where("level > 0 or depth = 0").join(name.select(*up, "parent"), ["up1", "up2"], "left").withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))
    open_ = open_.join(_digests(parts.where(F.col("kind") == ENDS)), ["level", *key], "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    rows = closed.where("parent is not null").select(*out).unionByName(hanging.select(*out)).unionByName(open_.select(*out))
    return rows.toDF(*COLUMNS)

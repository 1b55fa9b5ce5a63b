"""The trie of conversations against one built by hand, with blocks and chunks of every small size."""

import hashlib
import random
import zlib

import pytest

from helpers import same
from strideframe.llm import conversation_trie as trie
from strideframe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows of the contract, from (conv_id, turn, role, text) in any order."""
    turns: dict = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members: dict = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    totals: dict = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        totals[node] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + own)
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def drawn(seed, convs=60, words=3, most=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([1, 2, 3, most, rng.randrange(1, most)])):
            x = rng.choice(["a", "bb", "ccc", None, ""][: words + 2])
            rows.append((c, t, "user" if t % 2 == 0 else rng.choice(["assistant", None]), x))
    rows += [(7, None, "user", "no number"), (None, 3, "user", "no conversation"), (900, 0, None, None)]
    return rows


@pytest.mark.parametrize(("block", "chunk", "seed"), [(64, 10_000, 1), (3, 5, 2), (2, 1, 3), (1, 7, 4), (4, 3, 5)])
def test_trie_by_brute_force(spark, block, chunk, seed):
    rows = drawn(seed, words=1 + seed % 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = trie.prefix_trie(df, block=block, chunk=chunk)
    assert out.columns == trie.COLUMNS
    same(out.collect(), brute(rows))


def test_query_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    same(QUERIES["op11_conversation_trie"](spark, sf).collect(), brute(rows))


def test_copies_long_conversations_and_turnless_ones(spark):
    long = [(3, t, "user", f"turn {t % 3}") for t in range(300)]
    copies = [(c, t, "user", f"turn {t % 3}") for c in range(100, 160) for t in range(9)]
    turnless = [(c, 0, "user", "x") for c in range(1000, 1050) if c % 5]  # the first of the family is absent
    rows = long + copies + turnless
    df = spark.createDataFrame(rows, SCHEMA)
    same(trie.prefix_trie(df, block=16, chunk=9).collect(), brute(rows))
    assert any(r[1] == 0 and r[-1] != trie.NOTHING for r in brute(rows))


def test_repeated_rows_are_turns_and_clashing_columns_are_left_alone(spark):
    rows = [(5, 1, "user", "a")] * 3 + [(6, 1, "user", "a")] * 2 + [(10, 2, None, "é\x00😀" * 2000)]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA + ", conv long, chunk string, idx int")
    same(trie.prefix_trie(df, block=2, chunk=2).collect(), brute(rows))
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_negative_and_very_large_ids(spark):
    rows = [(c, t, "user", "ab"[t % 2]) for c in (-7, -5, -3, 0, 3, 2**63 - 1) for t in range(4)]
    nodes = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.n_convs) for r in nodes if r.depth == 0] == [(-7, 6)]

"""N-gram Jaccard join, components and repeated strings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import ROWS, SPACED, docs, real, same
from strideframe.llm import ngram_join, suffix_dedup
from strideframe.llm.components import components


def shingles(t):
    w = SPACED.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    common = Counter((a, b) for l in at.values() for i, b in enumerate(l) for a in l[:i])
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            parent[root(b)] = root(a)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    members, copies = defaultdict(list), defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[root(k)].append(i)
        copies[sets[k]].append(i)
    return [(i, least(members[root(k)]) if sets[k] else i, least(copies[sets[k]]) if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows)], [(root(k), sets[k]) for k in range(len(rows))]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_by_brute_force(spark, sf, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = " ".join(f"t{i}" for i in range(300)).split()
    near = [(1000 + k, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in range(0, 40, 2)]
    rows = ROWS + real(sf) + near + near[:3]
    want, where = groups(rows)
    same([tuple(r) for r in ngram_join.near_duplicates(docs(spark, rows)).drop("node").collect()], want)
    if block == 256:
        kept = ngram_join.keep_one(docs(spark, rows))
        full = {r for r, s in where if s}
        blank = sum(not s for _, s in where)
        got = kept.collect()
        assert len(got) == len(full) + blank and kept.columns == docs(spark, []).columns
        ids = {w[1] for w, (_, s) in zip(want, where, strict=True) if s}
        assert {r.doc_id for r in got if SPACED.search(r.text or "")} <= ids


@pytest.mark.parametrize("ids", [[None, None, None], [7, 7, 7], [None, 7, 7]])
def test_one_is_kept_of_versions_without_ids_of_their_own(spark, ids):
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for i, k in zip(ids, (0, 100, 200), strict=True)] + [(i, "quite another text of some words") for i in ids] + [(None, None)]
    got = ngram_join.keep_one(docs(spark, rows)).collect()
    assert sorted(r.text.startswith("quite") for r in got if r.text) == [False, True] and len(got) == 3
    assert all(r.doc_id == min((i for i in ids if i), default=None) for r in got if r.text)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    got = ngram_join.near_duplicates(docs(spark, ROWS[:3])).collect()
    assert sorted((r.class_id, r.n_links) for r in got) == [(1, 0), (2, 0), (3, 0)]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7), (50, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((40, 45, 50), 40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def kept(rows):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for (k, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        yield k, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()


def test_repeats_by_brute_force(spark, sf):
    text = real(sf, 6)
    rows = [r for r in ROWS if len(r[1] or "") < 6000] + text
    rows += [(100 + i, t) for i, t in enumerate(["a" * 199, "a" * 200, "a" * 201, "ab" * 400, "é" * 300, "x" + "é" * 300 + "y", text[3][1][:250], "zz" + text[3][1][:199], text[4][1][:900] * 2, "\x00" * 250, "b" + "\x00" * 210])]
    got = suffix_dedup.remove_repeats(docs(spark, rows), chunk_bytes=4000, anchors=64, windows=64, with_text=True).collect()
    same([tuple(r)[:5] for r in got], kept(rows))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs(spark, ROWS[:5])).collect()] == [0] * 5


def test_columns_sort_suffixes():
    draw = np.random.default_rng(3)
    symbols = draw.integers(0, 3, (60, 9)).astype(np.uint8)
    group = np.sort(draw.integers(0, 4, 60))
    for k, (order, common) in enumerate(suffix_dedup.insert_columns(iter(symbols.T[::-1]), group)):
        rest = [(int(group[i]), tuple(symbols[i, 8 - k :])) for i in order]
        assert rest == sorted(rest)
        for (g, a), (h, b), c in zip(rest, rest[1:], common[1:], strict=False):
            assert c == (0 if g != h else next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a)))

"""Quality rules, URL filters, sharding and decontamination."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helpers import ROWS, SPACED, docs, lower, real, same
from strideframe.llm import decontamination, pii, quality, sharding, url_filters
from strideframe.llm.text import Texts


def base_counts(text):
    text = text or ""
    words, seen, dup = SPACED.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = set()
    for k in range(len(words) - 7):
        if grams[tuple(words[k : k + 8])] > 1:
            again.update(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def verdict(text):
    n, chars, symbols, dup, again = base_counts(text)
    if n < 20 or 100 * again > 30 * n:
        return True, False
    words, lines = SPACED.findall(text), [x for x in text.split("\n") if SPACED.search(x)]
    letters, digits = len(re.findall(r"[A-Za-z\u0080-\U0010ffff]", text)), len(re.findall(r"[0-9]", text))
    out = 2 * symbols > n or not 2 * n <= chars <= 15 * n or 2 * letters < chars or 4 * digits > chars or 100 * dup > 40 * len(lines)
    assert words
    return False, not out


def test_quality_by_brute_force(spark, sf):
    rows = ROWS + real(sf)
    got = quality.quality(docs(spark, rows)).collect()
    same([tuple(r) for r in got], [(i, *base_counts(t), *verdict(t)) for i, t in rows])
    kept = quality.keep_quality(docs(spark, rows))
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in rows if verdict(t)[1]])
    assert kept.columns == docs(spark, rows).columns


def test_cascade_order_changes_nothing_and_is_by_gain():
    texts = pa.array([t for _, t in ROWS], pa.string())
    rules = {"never": lambda m: np.zeros(m.t.n, bool), "short": lambda m: m.n_words < 10}
    assert quality.order_by_gain(texts, rules) == ["short", "never"]
    from strideframe.llm.text import slices

    for _, part in slices(texts):
        results = [quality.cascade(part, quality.Measures(part), np.ones(part.n, bool), list(x)).tolist() for x in (quality.RULES.values(), reversed(quality.RULES.values()))]
        assert results[0] == results[1]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert quality.quality(none).count() == 0 and quality.keep_quality(none).count() == 0
    assert sharding.place(none, "doc_id").count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(docs(spark), items).where("n_hit > 0").count() == 0
    assert Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64)).n == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(rows, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    for i, t in rows:
        w, hit, found = WORD.findall(lower(t or "")), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if got := windows.get(tuple(w[k : k + m])):
                    found |= got
                    hit.update(range(k, k + m))
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_decontamination_by_brute_force(spark, sf, block_bytes, monkeypatch):
    texts = real(sf)
    long_ = " ".join(texts[3][1].split()[5:40])
    items = [("a", long_), ("b", long_), (None, "line two"), ("c", None), ("d", "one"), ("e", "word " * 14), ("a", "with an end of its own"), ("f", "?!")]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontamination.benchmark_blocks, "__defaults__", ("item_id", "text", block_bytes))
    rows = ROWS + texts
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.decontaminate(docs(spark, rows), bench)
    want = list(hits(rows, items))
    same([tuple(r)[:6] for r in got.collect()], want)
    assert got.where("doc_id = 3 and longest_at = 5").count() == 1
    same([(r.doc_id, r.text) for r in decontamination.keep_clean(docs(spark, rows), bench).collect()], [r for r, w in zip(rows, want, strict=True) if not w[5]])


def test_host_rules_and_mined_rules(spark):
    urls = ["https://a.EXAMPLE.org/es/x?q", "http://example.org/en/123", "http://example.org/en/2", "x.com/fr/", None, "", "ftp://b.com/de/1#a", "http://com/fr/", "http://notexample.org/es/", "http://h.net", "a://b?c", "http://q.net/a\nb/c"]
    urls += [f"http://spam.net/win/{i}" for i in range(40)] + [f"http://fine.net/news/{i}" for i in range(200)] + ["http://spam.net/win/0"] * 5
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, int("spam" not in (u or "")), 0) for i, u in enumerate(urls) if i % 2] + [(4, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filters.filter_urls(pages, labels).collect()}
    assert len(got) == len(urls)
    parts = [(r.host, r.path, r.rule, r.verdict) for r in (got[i] for i in range(12))]
    assert parts[:5] == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/123", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert parts[6:] == [("b.com", "/de/1", "com/de/", "block"), ("com", "/fr/", "com/fr/", "allow"), ("notexample.org", "/es/", "org/", "allow"), ("h.net", "", None, "allow"), ("b", "", None, "allow"), ("q.net", "/a\nb/c", None, "allow")]
    assert all(got[i].verdict == ("block" if "spam" in u else "allow") for i, u in enumerate(urls) if i > 11)
    mined = url_filters.mine(pages, labels)
    rows = [(set(url_tokens(u)), "spam" in u) for i, u in enumerate(urls) if i % 2 and u is not None]
    for r in mined.collect():
        both, some = sum(set(r.rule) <= t and bad for t, bad in rows), sum(set(r.rule) <= t for t, _ in rows)
        assert some and abs(r.confidence - both / some) < 1e-9 and r.confidence >= url_filters.CONFIDENCE
    assert url_filters.mine(pages, labels.limit(0)) is None
    assert {r.verdict for r in url_filters.filter_urls(pages.where("page_id > 11"), labels.limit(0)).collect()} == {"allow"}


def test_a_bad_host_of_few_urls_becomes_a_rule(spark):
    urls = [f"http://farm.biz/p/x{i}" for i in range(10)] + [f"http://few.biz/q/y{i}" for i in range(9)] + [f"http://fine.net/news/{i}" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("fine" in u), 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    assert any(r.rule == ["host:farm.biz"] for r in url_filters.mine(pages, labels).collect())
    blocked = {r.page_id for r in url_filters.filter_urls(pages, labels, rules=[]).collect() if r.verdict == "block"}
    assert blocked == set(range(19))  # the nine of the other host by host:biz


def url_tokens(u):
    if "://" not in u:
        return []
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    labels = host.lower().split(".")
    return ["host:" + ".".join(labels[-k:]) for k in range(1, len(labels) + 1)] + ["word:" + w for w in re.split(r"[^A-Za-z0-9_-]+", rest[len(host) :]) if w]


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(13)]
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    moved = (full != less) & (full != 12)
    assert moved.mean() < 0.15
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place_keeps_columns_and_places_equal_keys_alike(spark):
    rows = docs(spark).withColumnRenamed("lang", "shard")
    got = sharding.place(rows, "doc_id", slots=1009)
    assert got.count() == len(ROWS) and got.columns == ["doc_id", "text", "source", "n_chars", "slot", "shard"]
    assert got.select("doc_id", "slot", "shard").distinct().count() == len({i for i, _ in ROWS})
    held = sharding.lookup_table(sharding.SHARDS, 1009)
    assert all(r["shard"] == sharding.SHARDS[held[r["slot"]]] for r in got.collect())


PLAIN = {
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    6: r"[^\s@<>\"']+@[^\s@<>\"']+",
}


def test_pii_lookbehinds_change_no_match():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices("12.@a <'", k=rng.randrange(24)))
        ips = [m.span() for m in re.finditer(PLAIN[1], text) if all(int(x) <= 255 for x in m.group().split("."))]
        assert [(a, b) for a, kind, b in pii.base_spans(text) if kind == 1] == ips
        assert [(a, b) for a, kind, b in pii.candidates(text) if kind == 6] == [m.span() for m in re.finditer(PLAIN[6], text)]


def test_pii_taken_stretches():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, 0, a + rng.randrange(1, 9)) for a in rng.choices(range(60), k=rng.randrange(8))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = rng.randrange(60)
            span = (a, 1, a + rng.randrange(1, 9))
            want = any(span[0] < y and x < span[2] for x, _, y in spans)
            assert taken.overlaps(span) == want
            if not want:
                taken.add(span)
                spans.append(span)


@pytest.mark.parametrize("text", ["1" * 200_000, "x" * 200_000, "+1 (555) 010-0199 a@b.io 4111111111111111 " * 3000, "(" * 200_000, "a@" * 60_000])
def test_pii_of_long_runs_is_linear(text):
    began = time.perf_counter()
    pii.all_spans(text, pii.Trees())
    assert len(pii.candidates(text)) <= len(text)
    assert time.perf_counter() - began < 10


def test_a_repeated_long_url_is_one_item(spark):
    long = "http://bad.example.net/" + "/".join(f"word{i}" for i in range(40)) + "?q=1"
    urls = spark.createDataFrame([(i, long) for i in range(14)] + [(100 + i, f"http://good.example.net/p{i}") for i in range(30)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 100 else 1, 0) for i in [*range(14), *range(100, 130)]], "doc_id long, quality int, toxic int")
    begun = time.time()
    mined = url_filters.mine(urls, labels)
    rules = mined.collect()
    assert time.time() - begun < 60 and len(rules) <= 3 and all(r.confidence == 1.0 for r in rules)
    assert any(r.rule == ["host:bad.example.net"] for r in rules)
    got = url_filters.filter_urls(urls, labels).collect()
    assert all((r.verdict == "block") == (r.page_id < 100) for r in got)

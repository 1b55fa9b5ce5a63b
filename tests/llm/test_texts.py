"""Personal data, pieces, token output and the language model."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helpers import ROWS, SPACED, docs, lower, real, same
from strideframe.llm import lm, pieces, pii, token_output

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PLAIN = [EMAIL, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    for kind, p in enumerate(PLAIN):
        for m in p.finditer(t):
            d = re.sub(r"[^0-9]", "", m.group())
            if [True, all(int(x) < 256 for x in m.group().split(".") if x.isdigit()), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][kind]:
                yield m.start(), kind, m.end()


ODD = ["a@b@c.d", "@x.y a@.b x@y-.z-", "é.a@b.c,d@e.f.", "a@b.c@d.e", "..@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "+1 2 +123456789012345 +1(2)3.4-567890", "4111-1111-1111-1111 4111111111111112", 'token = "0a1b2c3d4e5f60718293a4b5"']


def test_base_spans_by_plain_patterns(spark, sf):
    for t in [t or "" for _, t in ROWS + real(sf, 200)] + ODD:
        assert pii.base_spans(t) == sorted(plain_spans(t))


def train_rows():
    return [(i, f"some words token = \"{hashlib.md5(str(i).encode()).hexdigest()}\" and {10**9 + 7919 * i * i} units, write to user{i}@mail.example.com") for i in range(200)]


def test_private_spans(spark):
    rows = ROWS + train_rows() + list(enumerate(ODD, 500))
    got = pii.find_private(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        base = sorted(plain_spans(t or ""))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.doc_id == i and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert sum("secret:" in r.spans for r in got) >= 195
    assert not any(re.search(r"secret|number", r.spans) for r in got[: len(ROWS) - 3])
    clean = pii.redact(docs(spark, rows))
    texts = [r.text for r in clean.collect()]
    assert clean.columns == docs(spark, []).columns and texts[0] is None and texts[3] == "one"
    assert "[EMAIL]" in texts[17] and "[CARD]" in texts[17] and "@" not in texts[17]
    assert pii.find_private(docs(spark, [])).count() == 0


def test_trees_give_the_models_probabilities(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 3))
    data = spark.createDataFrame([(Vectors.dense(v), float(v[0] + v[1] ** 2 > 0.5)) for v in x], ["features", "label"])
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(data)
    want = [r.probability[1] for r in model.transform(data).collect()]
    assert np.allclose(pii.read_trees(model.toDebugString).scores(x), want)


def test_calibration_takes_whole_ties():
    assert pii.calibrated(np.array([0.9, 0.9, 0.8, 0.1]), np.array([1, 1, 0, 0]), 0.99) == 0.9
    assert pii.calibrated(np.array([0.9, 0.9]), np.array([1, 0]), 0.99) == 2.0
    assert pii.calibrated(np.zeros(0), np.zeros(0)) == 2.0


def test_thresholds_of_all_held_candidates(spark):
    draw = np.random.default_rng(2)
    held = [(int(k), float(np.round(x, 3)), float(draw.random() < x * 1.05)) for k, x in zip(draw.integers(4, 7, 3000), draw.random(3000), strict=True)] + [(7, 0.5, 0.0)]
    got = pii.thresholds(spark.createDataFrame(held, "kind long, score double, label double"), 0.9)
    want = {k: pii.calibrated(*(np.array([h[i] for h in held if h[0] == k]) for i in (1, 2)), 0.9) for k in (4, 5, 6, 7)}
    assert got == {k: x for k, x in want.items() if x < 2} and 7 not in got and got


def test_trees_learn_from_every_document(spark):
    # 1,700 texts with candidates of one class, and 60 of the other: a bounded sample may miss them
    plain = [(i, f"order {10**9 + 7919 * i} of lot{i}abcdefgh") for i in range(1700)]
    secret = [(5000 + i, f"token = \"{hashlib.md5(str(i).encode()).hexdigest()}\"") for i in range(60)]
    seen = []
    fold = lambda rows: [r for r in rows if hashlib.md5(r[1].encode()).digest()[0] % 10 >= 3]

    class Spy(pii.GBTClassifier):
        def fit(self, frame):
            seen.append(frame.agg({"weight": "sum"}).first()[0])
            return super().fit(frame)

    real, pii.GBTClassifier = pii.GBTClassifier, Spy
    try:
        trees = pii.fit(docs(spark, plain + secret))
    finally:
        pii.GBTClassifier = real
    assert seen == [sum(len(pii.candidates(t)) for _, t in fold(plain + secret))] and trees.trees


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_pieces())


def best_path(p, text):
    table = {t: (s, i) for t, s, i in zip(p.texts, p.scores, p.ids, strict=True)}
    raw = (b" " + text.encode()).replace(b" ", b"\xff") if text else b""
    best = [(0, 0, 0)] + [(-(10**18), 0, 0)] * len(raw)
    for k in range(1, len(raw) + 1):
        for size in range(min(k, 60), 0, -1):
            if (got := table.get(raw[k - size : k])) and best[k - size][0] + got[0] > best[k][0]:
                best[k] = (best[k - size][0] + got[0], size, got[1])
        if best[k - 1][0] + p.byte_score > best[k][0]:
            best[k] = (best[k - 1][0] + p.byte_score, 1, p.byte_ids[raw[k - 1]])
    out, k = [], len(raw)
    while k:
        out.append(best[k][2])
        k -= best[k][1]
    return out[::-1]


def test_pieces_by_brute_force(encoder, sf):
    texts = ["", None, " ", "  a  b ", "▁x ▁", "\n\t é日本語 漢😀", "the the"] + [t for _, t in real(sf, 12)]
    ids = encoder.encode(pa.array(texts))
    assert encoder.decode(ids).to_pylist() == [t or "" for t in texts]
    for got, t in zip(ids.to_pylist(), texts, strict=True):
        assert got == best_path(encoder.p, t or "")


def test_paths_agree_with_the_library_on_a_unigram_file(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.trainer_spec.model_type, m.normalizer_spec.name = 1, "identity"
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    words = ["▁", "a", "b", "c", "ab", "abc", "bc", "▁a", "▁ab", "ca", "cab"]
    for text, score, kind in [("<unk>", 0.0, 2), *((w, -1.0 - 0.37 * k % 2.9, 1) for k, w in enumerate(words))]:
        x = m.pieces.add()
        x.piece, x.score, x.type = text, score, kind
    model = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    p = pieces.Pieces([w.encode().replace("▁".encode(), b"\xff") for w in words], [model.piece_to_id(w) for w in words], [round(1e6 * model.get_score(model.piece_to_id(w))) for w in words], [0] * 256, -(10**9))
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("abc "), 30)).strip() for _ in range(40)]
    assert pieces.Encoder(p).encode(pa.array(texts)).to_pylist() == model.encode(texts)


def test_encode_keeps_columns(spark):
    rows = docs(spark).withColumnRenamed("lang", "piece_ids")
    got = pieces.decode(pieces.encode(rows), text="source")
    assert got.columns == ["doc_id", "text", "n_chars", "piece_ids", "source"]
    assert [r.source for r in got.collect()] == [t or "" for _, t in ROWS]
    assert pieces.encode(docs(spark, [])).count() == 0


def test_tokens_agree_with_the_library(sf):
    coder = token_output.Tokenizer(token_output.read_vocabulary())
    texts = ["", None, "a   b  \n\n c", "x  \n", "\n\n\tword 12ab's  end  ", "    z", "é\u00a0 b\u3000  c", "—dash  "] + [t for _, t in real(sf, 40)]
    for part in (texts, texts):
        for a, piece in token_output.slices(pa.array(part), most=4000):
            ids, bounds = coder.stream(piece)
            for i in range(piece.n):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == [*coder.encode(part[a + i] or ""), coder.end]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(token_output.permuted(np.arange(n), n)) == list(range(n))


def test_shards_hold_every_sequence_in_order(spark, sf, tmp_path):
    rows = ROWS + real(sf, 60)
    ordered = token_output.training_order(docs(spark, rows).repartition(3), length=64, per_shard=50)
    got = sorted(ordered.collect())
    assert [r.slot for r in got] == list(range(len(got)))
    assert all((r.shard, r.offset) == (r.slot // 50, r.slot % 50 * 128) for r in got)
    coder = token_output.Tokenizer(token_output.read_vocabulary())
    whole = Counter(t for _, x in rows for t in [*coder.encode(x or ""), coder.end])
    held = Counter(int(t) for r in got for t in np.frombuffer(r.record, "<u2")[: r.n_tokens])
    assert held == whole and sum(i is None for r in got for i in r.doc_ids) >= 2
    folder = f"file://{tmp_path}/shards"
    for _ in range(2):  # writing again gives the same files
        files = token_output.write_shards(ordered, folder).collect()
    assert sum(f.n_records for f in files) == len(got) and {f.n_bytes % 128 for f in files} == {0}
    read = list(token_output.read_slots(folder, 37, 40, length=64, per_shard=50))
    assert [x.tobytes() for x in read] == [bytes(r.record) for r in got[37:77]]
    assert len(list(token_output.read_slots(folder, len(got) - 1, 9, length=64, per_shard=50))) == 1
    assert token_output.training_order(docs(spark, [])).count() == 0


def test_training_order_query_writes_its_shards(spark, sf):
    from strideframe.llm.queries import op6_training_order, table

    got = sorted(op6_training_order(spark, sf).collect())
    want = sorted(token_output.training_order(table(spark, sf, "documents")).collect())
    assert [(r.slot, r.shard, r.offset) for r in got] == [(r.slot, r.shard, r.offset) for r in want] and "record" not in got[0]
    assert sum(r.n_tokens for r in got) == sum(r.n_tokens for r in want) and Counter(i for r in got for i in set(r.doc_ids)).keys() == Counter(i for r in want for i in r.doc_ids).keys()
    for name, sha in {(r.file, r.sha256) for r in got}:
        with open(name.removeprefix("file://"), "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == sha
    read = list(token_output.read_slots(got[0].file.rpartition("/")[0], 0, len(got) + 1))
    assert len(read) == len(got) and all((x[r.n_tokens :] == 50257 - 1).all() or r.n_tokens == 1024 for x, r in zip(read, got, strict=True))
    assert Counter(t for x in read for t in x.tolist()) == Counter(t for r in want for t in np.frombuffer(r.record, "<u2").tolist())


def test_scores_by_brute_force(spark, sf):
    rows = ROWS + real(sf, 150)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [[*SPACED.findall(lower(t or "")), None] for _, t in rows]
    count, pairs = Counter(), Counter()
    for (i, _), w in zip(rows, tokens, strict=True):
        if not held(i):
            count.update(w)
            pairs.update(zip(["<"] + w[:-1], w, strict=True))
    n, v = sum(count.values()), len(count)
    a = lm.score(docs(spark, rows).coalesce(1)).collect()
    b = lm.score(docs(spark, rows).coalesce(1), filter_bytes=0).collect()
    assert a == b
    for chunked in (a, lm.score(docs(spark, rows).coalesce(1), chunk_bytes=3000, bucket=200).collect()):
        for r, (i, _), w in zip(sorted(chunked, key=lambda r: (str(r.doc_id), r.n_tokens)), *zip(*sorted(zip(rows, tokens, strict=True), key=lambda x: (str(x[0][0]), len(x[1]))), strict=True), strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(w), sum(count[x] > 0 for x in w), n)
            base = [(count[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
            assert math.isclose(r.base_score, sum(map(math.log10, base)), rel_tol=1e-9)
            score = 0
            for h, x, p in zip(["<"] + w[:-1], w, base, strict=True):
                c, m = count[None] if h == "<" else count[h], pairs[h, x]
                m = min(2 ** int(math.log2(m)), c, count[x]) if m >= 2 else 0
                share = 0.4 * c / (c + 5)
                score += math.log10((1 - share) * p + share * m / max(c, 1))
            assert math.isclose(r.score, score, rel_tol=0.02)  # the filter's false positives


def test_query_scores_bigrams_seen_once(spark, sf):
    from strideframe.llm.queries import op8_language_model

    rows = real(sf, 10**6)
    tokens = [[*SPACED.findall(lower(t or "")), None] for _, t in rows]
    count, pairs = Counter(), Counter()
    for (i, _), w in zip(rows, tokens, strict=True):
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            count.update(w)
            pairs.update(zip(["<"] + w[:-1], w, strict=True))
    n, v = sum(count.values()), len(count)
    want = []
    for (i, _), w in zip(rows, tokens, strict=True):
        score = 0
        for h, x in zip(["<"] + w[:-1], w, strict=True):
            c, m = count[None] if h == "<" else count[h], pairs[h, x]
            share = 0.4 * c / (c + 5)
            score += math.log10((1 - share) * (count[x] + 0.5) / (n + 0.5 * (v + 1)) + share * (2 ** int(math.log2(m)) if m else 0) / max(c, 1))
        want.append((i, len(w), score))
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in op8_language_model(spark, sf).collect())
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=0.02)  # the filter's false positives
    assert lm.lower_end(lm.level(np.array([0, 1, 2, 3, 4, 9]), 1), 1).tolist() == [0, 1, 2, 2, 4, 8]


def test_scores_of_nothing(spark):
    assert lm.score(docs(spark, [])).count() == 0


def test_filter_never_reads_less_than_it_holds():
    keys = np.arange(5000, dtype=np.uint32) * np.uint32(2654435761)
    levels = lm.level(np.arange(5000) % 40)
    made = lm.Segment.of(keys[levels > 0], levels[levels > 0])
    got = made.levels(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.02
    assert lm.lower_end(lm.level(np.array([0, 1, 2, 3, 4, 9]))).tolist() == [0, 0, 2, 2, 4, 8]

"""The pipeline's stages on the smallest table, each against its operator's brute force."""

import corpus_pipeline
import pytest

from helpers import SPACED
from strideframe.llm.queries import ORACLES, QUERIES
from test_duplicates import groups
from test_document_filters import hits, verdict


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, sf)
        if k == 0:
            rows = [r for r in rows if verdict(r[1])[1]]
        elif k == 1:
            want, _ = groups(rows)
            rows = [r for r, w in zip(rows, want, strict=True) if w[0] == w[1]]
        else:
            rows = [r for r, w in zip(rows, hits(rows, bench), strict=True) if not w[5]]
        assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.run(spark, sf)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows) and out.columns[-1] == "piece_ids"
    before = dict(rows)
    assert all(r.text == before[r.doc_id] or "[" in r.text for r in got)
    assert all(len(r.piece_ids) > 0 for r in got if SPACED.search(r.text))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_every_row(spark, sf, name):
    table = "pages" if name.startswith("op1_") else "documents"
    if name == "op11_conversation_trie":
        pytest.skip("nodes, held against brute force elsewhere")
    n = QUERIES[name](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/{table}.parquet").count() or name.startswith("op6_")
    assert set(ORACLES) <= set(QUERIES)

"""Texts that every document operator must bear, and plain word splitting."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i} wört{i % 7}" for i in range(40))
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b c"), (5, "another text of the same id"), (None, "text without an id"), (None, None),
    (6, "line one here\nline one here\n\nline two\nline one here"), (7, PASSAGE), (8, PASSAGE), (9, PASSAGE + " with an end of its own"), (9, PASSAGE + " with an end of its own"),
    (10, "before " * 30 + PASSAGE), (11, "é日本語 漢😀 \x00 x\u00a0y" * 20), (12, "word " * 3000), (13, " ".join(f"w{i * i % 997}" for i in range(20000))),
    (14, "mail bob.x@mail.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.1"), (15, "### $$$ *** &&& " * 10), (16, "x" * 5000),
    (17, "host 1.1.1." + "5" * 5000 + " and 010.000255.1." + "0" * 5000 + "7"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def real(sf, n=120):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).slice(0, n)
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def same(got, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)

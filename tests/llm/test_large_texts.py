"""Texts with very many matches, and payloads of very many segments, end in seconds."""

import re
import time

from tallyforge.llm import secrets, warc

from .test_operators import KEY, docs


def test_secrets_in_a_text_of_many_spans(spark):
    many = "token=abcdef12 " * 100_000
    parts = "\n\n".join(f"AKIA{k:016d} {KEY}" if k % 2 else KEY for k in range(6_000))
    begin = time.time()
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secrets.secrets(docs(spark, [(1, many), (2, parts)])).collect()}
    assert time.time() - begin < 60
    assert found[1] == [("assign", 15 * k, 15 * k + 14) for k in range(100_000)]
    want = sorted([("access", m.start(), m.end()) for m in re.finditer("AKIA[0-9]+", parts)] + [("key", m.end() + 1, m.end() + 41) for m in re.finditer("AKIA[0-9]+", parts)], key=lambda x: x[1])
    assert found[2] == want


def test_a_page_of_very_many_segments(spark):
    html = "0123456789abcdef" * (100 << 16)  # 100 MB
    pages = spark.createDataFrame([(1, "u")], "page_id long, url string").selectExpr("page_id", "url", f"repeat('0123456789abcdef', {100 << 16}) as html")
    begin = time.time()
    (row,) = warc.archived(pages).collect()
    assert time.time() - begin < 90
    assert (row.payload_bytes, row.payload_digest, row.broken) == (len(html), warc.base32_sha1(html.encode()), False)

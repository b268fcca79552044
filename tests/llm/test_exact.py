import hashlib
from collections import defaultdict

import pytest

from tickloom.llm import exact

from .docs import awkward, empty

DROP = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("table_bytes", [exact.TABLE_BYTES, 2_000])
def test_against_brute_force(spark, table_bytes):
    docs = awkward(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        text = r.text or ""
        groups[text.translate(DROP)].append((-len(text), r.doc_id is None, r.doc_id or 0, r.doc_id))
    want = []
    for content, rows in groups.items():
        keep = min(rows)[3]
        sha = hashlib.sha256(content.encode()).hexdigest()
        want += [(r[3], keep, len(rows), r[3] == keep, sha) for r in rows]
    got = [tuple(r) for r in exact.exact_dedup(docs, table_bytes).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(spark):
    assert exact.exact_dedup(empty(spark)).count() == 0


def test_grace_recursion_keeps_everything():
    recs = [(bytes([i % 50]) * 400, hashlib.sha256(bytes([i % 50]) * 400).digest(), 400, i, 1) for i in range(500)]
    held = [t for t in exact.grace(iter(recs), 3_000)]
    assert len(held) > 1 and sum(len(t) for t in held) == 50
    assert sum(v[3] for t in held for v in t.values()) == 500
    assert all(v[2] == min(r[3] for r in recs if r[0] == k) for t in held for k, v in t.items())

from collections import Counter

import pytest

import corpus_pipeline as cp
from tickloom.llm import base, tokens, words
from tickloom.llm.base import staged
from tickloom.llm.tokens import PieceTokenizer, default_paths

from .docs import awkward, empty
from .test_minhash import brute_in_order

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("build", [awkward, empty])
def test_stages_pass_on_what_they_keep(spark, build):
    docs = build(spark)
    before = {r.doc_id: r.text for r in docs.collect()}
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == cp.COLUMNS
        rows = docs.collect()
        sizes.append(len(rows))
        assert all(r.doc_id in before for r in rows)
        if name == "quality":
            assert all((r.doc_id, r.text) in texts for r in rows)
        if name == "near_dedup":
            assert max(Counter(r for r in rows if r.text and r.text.split()).values(), default=1) == 1
            one = brute_in_order([(r.doc_id, r.text) for r in rows if r.text and r.text.split()], 5, 80)
            assert len(set(one)) == len(one)  # no two that stay are linked
    assert sizes[1] >= sizes[2] >= sizes[3]
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    tok = PieceTokenizer(*default_paths())
    assert sum(p.length for p in pieces) == sum(tok.count(r.text or "") + 1 for r in docs.collect())
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert max(fill.values(), default=0) <= 1024


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_a_worker_keeps_nothing_of_another_stage(spark, monkeypatch):
    """What packing leaves in a worker is gone when an earlier stage runs in it again, and freed memory is handed back."""
    sent, returned = [], []
    docs = awkward(spark)
    kind = type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *more: (sent.append(f), plain(self, f, *more))[1])
    for _, stage in cp.STAGES[:3]:
        stage(spark, docs, SF)
    monkeypatch.setattr(base, "give_back", lambda: returned.append(1))
    assert len(sent) >= 5
    for f in sent:
        tok = tokens.tokenizer(*default_paths())
        words._powers(1 << 17)
        assert list(f(iter(()))) is not None and tok not in tokens._loaded.values() and len(words._pow) == 1
    assert len(returned) == 2 * len(sent)

import math
import re
from collections import defaultdict

import pytest

from tickloom.llm import mixing

from .docs import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, weights=(5, 2, 1), epochs=3):
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total = sum(sizes.values())
    capped = {}
    while True:
        free = [k for k in names if k not in capped]
        left = total - sum(capped.values())
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] > epochs * sizes[k]]
        if not over:
            return capped | share
        capped |= {k: epochs * sizes[k] for k in over}


@pytest.mark.parametrize("build", [awkward, empty])
def test_targets_and_taken(spark, build):
    docs = build(spark)
    want = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(str, [(r.doc_id, r.source, r["size"]) for r in got])) == sorted(map(str, want))
    sizes = defaultdict(int)
    for _, s, n in want:
        sizes[s] += n
    targets = brute_targets(sizes) if sizes else {}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in rows)
    assert key(got) == key(again)


def test_zero_words_take_nothing(spark):
    docs = spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix_sources(docs).collect()} == {(0.0, 0)}


def test_repeated_rows_at_the_cut(spark):
    """A third of the rows repeat one (doc_id, size); some of them fit, and not more."""
    rows = [(i, "a b c", "a") for i in range(40)] + [(7, "a b c", "a")] * 60 + [(None, "x y", "a")] * 50 + [(i, "w " * 40, "b") for i in range(60)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    assert len(got) == len(rows)
    targets = brute_targets({"a": 400, "b": 2400})
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - targets[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert all(0 <= r.times <= 3 for r in mine)


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 300}") for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = brute_targets(sizes)
    assert all(math.isclose(r.target, targets[r.source], rel_tol=1e-9) for r in got)


def test_columns_can_be_carried(spark):
    docs = awkward(spark)
    got = mixing.mix_sources(docs, carry=["text", "lang"]).select("doc_id", "__carry_text", "__carry_lang").collect()
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(map(str, ((r.doc_id, r.text, r.lang) for r in docs.collect())))

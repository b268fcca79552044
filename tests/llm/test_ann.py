import random

import numpy as np

from tickloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, top, modulus):
    best = {}
    for i, v in rows:
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 16:
            continue
        best[i] = min(best.get(i, v), v)
    ids = sorted(best)
    x = np.array([best[i] for i in ids], np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % modulus == 0:
            s = (x * v).sum(1)
            out[i] = sorted(((-a, j) for a, j in zip(s, ids, strict=True) if j != i))[:top]
    return out


def rows_of(n, seed=1):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, 16)).astype(np.float32) * rnd.uniform(0.5, 2, (n, 1)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(n)]
    rows += [(n + i, v[7].tolist()) for i in range(60)]  # copies
    rows += [(n + 100, None), (n + 101, [0.0] * 16), (n + 102, [float("nan")] + [1.0] * 15), (n + 103, [None] + [1.0] * 15), (n + 104, [1.0]), (3, v[3].tolist()), (3, v[4].tolist())]
    return rows


def test_recall_scores_and_order(spark):
    rows = rows_of(1500)
    want = brute(rows, 20, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(df, shard_rows=600).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = dict((j, -a) for a, j in brute(rows, 10_000, 20)[q]) if random.Random(q).random() < 0.05 else None
        if exact:
            assert all(abs(exact[i] - s) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {j for _, j in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_few_candidates_and_empty(spark):
    rows = rows_of(8)[:1] + [(20, [1.0] * 16), (5, [2.0] * 16), (6, [2.0] * 16)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = brute(rows, 20, 20)
    assert sorted(got) == sorted((q, n, j) for q, r in want.items() for n, (_, j) in enumerate(r, 1))
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0

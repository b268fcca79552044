import random

import numpy as np
import pyarrow as pa

from tickloom.llm import quality
from tickloom.llm.base import raw_bytes

from .docs import awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=1200):
    rnd = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows, kind = [], {}
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randrange(30, 200))]
        kind[i] = rnd.choice(["good"] * 8 + ["junk", "toxic"])
        if kind[i] == "junk":
            w = [x + rnd.choice(["$$$", "###"]) for x in w]
        if kind[i] == "toxic":
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["vilest", "cretin"])
        rows.append((i, " ".join(w)))
    labels = [(i, int(k != "junk"), int(k == "toxic")) for i, k in kind.items() if i % 2]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), kind


def test_held_out_accuracy(spark):
    docs, labels, kind = corpus(spark)
    got = {r.doc_id: r.kept for r in quality.resample(docs, labels).collect() if r.doc_id % 2 == 0}
    of = lambda k: [v for i, v in got.items() if kind[i] == k]
    assert np.mean(of("good")) > 0.97 and np.mean(of("junk")) < 0.05


def test_rows_do_not_leak_into_each_other():
    texts = ["a b c", "A", "", None, "x!! y!! y", "ça va 12"]
    b, first = quality.ngram_buckets(*raw_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        one, _ = quality.ngram_buckets(*raw_bytes(pa.array([t], pa.string())))
        assert (one == b[:, first[i] : first[i + 1]]).all()


def test_kth_largest(spark):
    rnd = random.Random(2)
    xs = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [5, 5, -5]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for k in (1, 7, 150, 303):
        assert quality.kth_largest(df, "x", k) == sorted(xs)[-k]
    v = np.array([-3.5, -0.0, 0.0, 2.0, -1e-9, 1e9])
    assert (np.argsort(quality._ordered(v), kind="stable") == np.argsort(v, kind="stable")).all()


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], LABELS)
    assert quality.resample(docs, none).where("kept").count() == docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, None, 1), (None, 1, 0), (1, 1, 0), (4, 0, 0)], LABELS)
    assert quality.resample(docs, labels).count() == docs.count()
    assert quality.resample(empty(spark), labels).count() == 0

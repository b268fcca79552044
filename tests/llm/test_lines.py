import random
import re

from tickloom.llm import lines

from .docs import SCHEMA, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least):
    """doc_id → indices of deleted lines: in a run of ``least`` words or more whose first copy stands
    in another document or ends before it; all runs are tried, against their texts."""
    seqs = {i: [x for x in t.split("\n") if WORD.search(x)] for i, t in docs.items()}
    runs = {}
    for d in sorted(seqs):
        for i in range(len(seqs[d])):
            for j in range(i + 1, len(seqs[d]) + 1):
                if sum(len(WORD.findall(x)) for x in seqs[d][i:j]) >= least:
                    runs.setdefault(tuple(seqs[d][i:j]), []).append((d, i))
    gone = {d: set() for d in docs}
    for run, at in runs.items():
        first_doc, first = min(at)
        for d, i in at:
            if d != first_doc or i >= first + len(run):
                gone[d].update(range(i, i + len(run)))
    return gone


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [" ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.choice([1, 3, 9]))) for _ in range(12)]
    docs = {i: "\n".join(rnd.choice([*pool, "", f"only {i} {rnd.random()}"]) for _ in range(rnd.randrange(14))) for i in range(60)}
    docs[60] = docs[5] = "\n".join(rnd.choice(pool) for _ in range(40))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], SCHEMA)
    gone = brute(docs, 10)
    for r in lines.line_report(df, 10).collect():
        got = {x for part in r.removed.split(",") if part for x in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}
        assert got == gone[r.doc_id], r
        assert r.n_removed == len(got)
    out = {r.doc_id: r for r in lines.dedup_lines(df, 10).collect()}
    for i, t in docs.items():
        left = [x for n, x in enumerate(x for x in t.split("\n") if x) if n not in gone[i]]
        if left or not gone[i]:
            assert [x for x in out[i].text.split("\n") if x] == left and out[i].n_chars == len(out[i].text)
        else:
            assert i not in out


def removed(df, least=50):
    return {r.doc_id: r.removed for r in lines.line_report(df, least).collect()}


def test_a_later_copy_leaves_the_first_whole(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    docs = {1: "\n".join([ten] * 10), 2: "\n".join([ten] * 7), 3: "\n".join([ten] * 4), 4: "\n".join([f"x {ten}"] * 9)}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], SCHEMA)
    assert removed(df) == {1: "5-9", 2: "0-6", 3: "", 4: ""}
    assert {r.doc_id: len(r.text.split("\n")) for r in lines.dedup_lines(df).collect()} == {1: 5, 3: 4, 4: 9}


def test_lines_that_share_a_polynomial_hash_stay_apart(spark):
    morse = lambda a, b: " ".join((a, b)[i.bit_count() % 2] for i in range(512))
    texts = [morse("x", "y"), morse("y", "x"), "head\n" + morse("x", "y")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert removed(df) == {0: "", 1: "", 2: "1-1"}
    assert [r.text for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == [*texts[:2], "head"]


def test_ranks_follow_the_order_of_the_suffixes(spark):
    rnd = random.Random(9)
    rows = [(d, i, rnd.randrange(3), rnd.randrange(2)) for d in range(6) for i in range(9)]
    got = lines._ranked(spark.createDataFrame(rows, "doc long, i int, one long, two long"), ["one", "two"], len(rows), "t").collect()
    key = {(d, i): (a, b) for d, i, a, b in rows}
    by_rank = sorted(got, key=lambda r: r.rank)
    assert [key[r.doc, r.i] for r in by_rank] == sorted(key[r.doc, r.i] for r in got)
    assert len({r.rank for r in got}) == len({key[r.doc, r.i] for r in got})


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = lines.dedup_lines(docs, 5)
    assert got.columns == docs.columns and got.where("doc_id is null").count() == 1
    assert lines.line_report(docs, 5).count() == docs.where("doc_id is not null").select("doc_id").distinct().count()
    extra = docs.selectExpr("*", "1 AS spans", "doc_id AS doc", "text AS text_hash", "2 AS rank")
    assert lines.dedup_lines(extra, 5).columns == extra.columns and lines.dedup_lines(extra, 5).count() == got.count()
    assert lines.line_report(empty(spark)).count() == 0 and lines.dedup_lines(empty(spark)).count() == 0

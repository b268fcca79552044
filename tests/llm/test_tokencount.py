import random

from pyspark.sql import functions as F

from tickloom.llm import tokencount
from tickloom.llm.tokens import PieceTokenizer, default_paths

from .docs import awkward, empty


def apply(text, pos, delete, insert):
    pos = min(max(pos, 0), len(text))
    return text[:pos] + insert + text[pos + max(delete, 0) :]


def test_random_edits_equal_a_recount():
    tok = PieceTokenizer(*default_paths())
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "ab", "Cd", "é", "ß1", "22", ".", "'s", "- ", "\r\n", "漢", "x y", " z"]
    for k in range(120):
        text = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 40, 900])))
        tree = tokencount.CountTree(tok, text)
        assert tree.text() == text
        for _ in range(12):
            pos, delete = rnd.randrange(len(text) + 3), rnd.choice([0, 1, 3, 80, 500])
            insert = "".join(rnd.choice([*bits, " ", "<|endoftext|>"] if k % 9 == 0 else bits) for _ in range(rnd.choice([0, 1, 4, 60])))
            tree.edit(pos, delete, insert)
            text = apply(text, pos, delete, insert)
            assert tree.text() == text
            assert tree.tokens == tok.count(text), (text, pos, delete, insert)


def test_only_touched_regions_are_encoded():
    tok = PieceTokenizer(*default_paths())
    text = " ".join(f"word{i % 977}" for i in range(20_000))
    tree = tokencount.CountTree(tok, text)
    for i in range(10):
        tree.edit(i * 9_000, 5, "edit")
    assert tree.encoded < len(text) / 20 and tree.tokens == tok.count(tree.text())


def test_other_spaces_leave_the_tree_in_place():
    tok = PieceTokenizer(*default_paths())
    rnd = random.Random(8)
    words = [f"word{i}" + rnd.choice([" ", " ", "\n", "\u00a0", "\u00a0 ", " \u2003", "\x1c ", "<|endoftext|> "]) for i in range(8_000)]
    text = "".join(words)
    tree = tokencount.CountTree(tok, text)
    assert len(tree.leaves) > 100 and tree.text() == text and tree.tokens == tok.count(text)
    for _ in range(40):
        pos, delete, insert = rnd.randrange(len(text)), rnd.choice([0, 2, 30]), rnd.choice(["", " ", "\u00a0", "x", "<|endoftext|>", "\u2003y "])
        tree.edit(pos, delete, insert)
        text = apply(text, pos, delete, insert)
        assert tree.text() == text and tree.tokens == tok.count(text), (pos, delete, insert)
    assert tree.encoded < len(text)


def test_a_column_of_that_name_is_replaced(spark):
    docs = awkward(spark).where("doc_id < 3").selectExpr("*", "'x' AS edits", "2 AS e_")
    edits = spark.createDataFrame([(1, 1, 0, 1, "a")], "doc_id long, seq int, pos long, del long, ins string")
    assert {r.doc_id: r.n_edits for r in tokencount.count_edits(tokencount.with_edits(docs, edits)).collect()} == {0: 0, 1: 1, 2: 0}


def test_operator(spark):
    tok = PieceTokenizer(*default_paths())
    docs = tokencount.seeded_edits(awkward(spark))
    want = []
    for r in docs.collect():
        text = r.text or ""
        before = tok.count(text)
        for e in r.edits:
            text = apply(text, e.pos, e["del"], e.ins)
        want.append(str((r.doc_id, before, tok.count(text), len(text))))
    got = [str((r.doc_id, r.tokens_before, r.tokens_after, r.chars_after)) for r in tokencount.count_edits(docs).collect()]
    assert sorted(got) == sorted(want)
    assert tokencount.count_edits(tokencount.seeded_edits(empty(spark))).count() == 0
    edits = spark.createDataFrame([(1, 2, 0, 0, "b"), (1, 1, 0, 1, "a"), (2, 1, None, 1, None)], "doc_id long, seq int, pos long, del long, ins string")
    assert {r.doc_id: r.n_edits for r in tokencount.count_edits(tokencount.with_edits(awkward(spark).where(F.col("doc_id") < 3), edits)).collect()} == {0: 0, 1: 2, 2: 0}

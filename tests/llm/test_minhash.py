import itertools
import random
import re
from collections import Counter, defaultdict

from tickloom.llm import minhash
from tickloom.llm.graph import components

from .docs import SCHEMA, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_in_order(rows, k, percent):
    """From the definition: all pairs of different sets; names of components by search over links."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    ids = defaultdict(set)
    for i, s in sets:
        ids[s].add(i)
    keys = [s for s in ids if s]
    near = defaultdict(list)
    for a, b in itertools.combinations(keys, 2):
        n = len(a & b)
        if 100 * n >= percent * (len(a) + len(b) - n):
            near[a].append(b)
            near[b].append(a)
    name = {}
    for s in keys:
        if s not in name:
            group, todo = {s}, [s]
            while todo:
                todo += (fresh := [x for x in near[todo.pop()] if x not in group])
                group.update(fresh)
            least = min((i for x in group for i in ids[x] if i is not None), default=None)
            name.update(dict.fromkeys(group, least))
    return [str((i, len(s), name[s] if s else i)) for i, s in sets]


def brute(rows, k, percent):
    return sorted(brute_in_order(rows, k, percent))


def near_copies(n, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.randrange(0, 12)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10_000)}"
        rows.append((1000 + i, " ".join(words), "en", "s0", None))
    return rows


def check(docs, k, percent):
    got = minhash.near_duplicates(docs, k=k, percent=percent).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_contract_parameters(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame(near_copies(150, 5), SCHEMA))
    check(docs, 3, 85)


def test_small_blocks_agree(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(120, 8), SCHEMA)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    check(docs, 3, 85)


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_contents_that_share_a_polynomial_hash_stay_apart(spark):
    one, two = "".join(thue_morse(1024, "x", "y")), "".join(thue_morse(1024, "y", "x"))
    rows = [(1, f"p q {one}", "en", "s", None), (2, f"p q {two}", "en", "s", None), (3, f"p q {one}", "en", "s", None), (None, "p q r", "en", "s", None), (None, "p q  r", "en", "s", None), (4, "p Q r", "en", "s", None), (4, "another text", "en", "s", None)]
    check(spark.createDataFrame(rows, SCHEMA), 3, 85)


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([*near_copies(60, 6), (None, "no id but a copy", "en", "s", None), (None, "no id but a copy", "en", "s", None)], SCHEMA))
    got, rows = Counter(minhash.drop_copies(docs).collect()), docs.collect()
    groups = defaultdict(list)
    for r, name in zip(rows, (eval(x)[2] for x in brute_in_order([(r.doc_id, r.text) for r in rows], 5, 80)), strict=True):  # noqa: S307
        groups[name if name is not None else r.text].append(r)
    want = Counter()
    for name, members in groups.items():
        worded = [r for r in members if shingle_set(r.text, 5)]
        want.update(r for r in members if not shingle_set(r.text, 5))
        if worded:
            want[min(worded, key=lambda r: (r.doc_id is None, r.doc_id or 0))] += 1
    assert got == want
    assert minhash.drop_copies(empty(spark)).count() == 0


def test_defaults_and_empty(spark):
    check(spark.createDataFrame(near_copies(60, 6), SCHEMA), 5, 80)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "u long, v long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}

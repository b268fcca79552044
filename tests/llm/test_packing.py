import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tickloom.llm import packing
from tickloom.llm.base import raw_bytes
from tickloom.llm.tokens import PieceTokenizer, default_paths

from .docs import awkward, empty


def test_ids_equal_the_library_s():
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "22", ".", "'s", "'", "ll", "-", "\r\n", "漢", "x"]
    odd = [*parts, "\x1c", "\x85", " ", " ", "　", "᠎", "<|endoftext|>", "​"]
    texts = ["".join(rnd.choice(parts if i % 3 else odd) for _ in range(rnd.randrange(30))) for i in range(3000)] + [None, "", " ", "\n\n"]
    for paths in (default_paths(), default_paths()[:1]):
        tok = PieceTokenizer(*paths)
        ids, at = tok.encode(*raw_bytes(pa.array(texts)))
        for i, t in enumerate(texts):
            assert tok.inner.encode(t or "", add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist(), repr(t)


def test_words_that_share_a_polynomial_hash_have_their_own_ids():
    morse = lambda a, b: "".join((a, b)[i.bit_count() % 2] for i in range(1024))
    texts = [f"{morse('x', 'y')} {morse('y', 'x')}", morse("y", "x"), morse("x", "y")]
    for paths in (default_paths(), default_paths()[:1]):
        tok = PieceTokenizer(*paths)
        ids, at = tok.encode(*raw_bytes(pa.array(texts)))
        for i, t in enumerate(texts):
            assert tok.inner.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist()


def test_a_full_cache_starts_anew(monkeypatch):
    from tickloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    tok = PieceTokenizer(*default_paths())
    for n in range(5):
        ids, _ = tok.encode(*raw_bytes(pa.array([f"alpha beta{n} gamma delta{n} epsilon"])))
        assert ids.tolist() == tok.inner.encode(f"alpha beta{n} gamma delta{n} epsilon").ids


def test_shortest_pack_first_places_all_within_the_limit():
    rnd = random.Random(2)
    hist = {n: rnd.randrange(1, 50) for n in rnd.sample(range(1, 1025), 300)}
    packs = packing.shortest_pack_first(hist)
    placed = defaultdict(int)
    for pattern, count in packs:
        assert sum(pattern) <= 1024 and count > 0
        for n in pattern:
            placed[n] += count
    assert placed == hist
    need = sum(n * c for n, c in hist.items()) / 1024
    assert sum(c for _, c in packs) <= need * 1.05 + 1
    assert len(packs) <= 2 * 1024
    seen = defaultdict(int)
    for length, lo, hi, _, _ in packing.slots(packs):
        assert lo == seen[length]
        seen[length] = hi
    assert seen == hist


def test_round_trip(spark):
    docs = awkward(spark)
    tok = PieceTokenizer(default_paths()[0])
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*tok.inner.encode(r.text or "", add_special_tokens=False).ids, 0])
    rows = packing.pack(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, texts in want.items():
        ids = texts[0]
        assert sum(r.length for r in by_doc[d]) == sum(map(len, texts))
        for r in by_doc[d]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(empty(spark)).count() == 0

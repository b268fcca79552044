"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A document's text is cut into leaves of some LEAF pre-tokens, always after a character that is no
white space (of any kind) and before one of ``[\\x20\\x09-\\x0D]``, where a byte-level BPE never joins
anything; a binary tree keeps sums of code points
and of tokens. An edit finds its leaves by the code-point sums, changes their text, and encodes
only those leaves anew, with a neighbour for context where the change leaves no such cut at a
border (a word joined to the one before it, or white space left at the end). Sums are updated on
the path to the root. Leaves that grow past GROWN times their size rebuild the tree. Texts with other Unicode spaces or a
special token's string have the same leaves; only a leaf that holds one goes to the library whole.

Defined results: null text is empty; an edit's position counts code points of the text as left by
the edits before it, and positions or lengths beyond the end stop there; null edits or inserts
change nothing; rows with null or repeated doc_id are counted like any other; a column ``edits``
that a table already has is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import raw_bytes, slices, table
from .tokens import PieceTokenizer, default_paths, tokenizer

LEAF = 48
GROWN = 8
#: An edited region of at most so many code points is counted in one call, past the cache of pieces.
SMALL = 4_096
SPACE = frozenset(" \t\n\x0b\x0c\r")
#: \s here is wider than the tokenizer's (it has the separators \x1c-\x1f too), so a border is one for both.
_BORDER = re.compile(r"\S(?=[\x20\x09-\x0D])")


class CountTree:
    def __init__(self, tok: PieceTokenizer, text: str, leaves: list[str] | None = None, counts: list[int] | None = None):
        self.tok = tok
        self.encoded = 0  # code points encoded anew since the tree was made
        if leaves is None:
            leaves, counts = cut(tok, text)
        self._make(leaves, counts)

    def _make(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves or [""]
        n = 1
        while n < len(self.leaves):
            n *= 2
        self.n = n
        self.size, self.count = [0] * (2 * n), [0] * (2 * n)
        for i, t in enumerate(self.leaves):
            self.size[n + i] = len(t)
            self.count[n + i] = counts[i] if counts else 0
        for i in range(n - 1, 0, -1):
            self.size[i] = self.size[2 * i] + self.size[2 * i + 1]
            self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.count[1]

    @property
    def length(self) -> int:
        return self.size[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _at(self, pos: int) -> tuple[int, int]:
        """(leaf, offset in it) of a code point; the end belongs to the last leaf that has text."""
        i = 1
        while i < self.n:
            i *= 2
            if pos >= self.size[i] and self.size[i + 1]:
                pos -= self.size[i]
                i += 1
        return i - self.n, pos

    def _set(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        i = self.n + leaf
        self.size[i], self.count[i] = len(text), count
        while i > 1:
            i //= 2
            self.size[i] = self.size[2 * i] + self.size[2 * i + 1]
            self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    def edit(self, pos: int, delete: int, insert: str) -> None:
        pos = min(max(pos, 0), self.length)
        delete = min(max(delete, 0), self.length - pos)
        if not delete and not insert:
            return
        a, off = self._at(pos)
        b = self._at(pos + delete)[0] if delete else a
        old = "".join(self.leaves[a : b + 1])
        new = old[:off] + insert + old[off + delete :]
        while True:  # a border needs white space after it and a word before it
            if a > 0 and (not new or new[0] not in SPACE or (self.leaves[a - 1][-1:] or " ").isspace()):
                a -= 1
                new = self.leaves[a] + new
            elif b + 1 < len(self.leaves) and (not new or new[-1].isspace() or (self.leaves[b + 1][:1] or "x") not in SPACE):
                b += 1
                new += self.leaves[b]
            else:
                break
        if len(new) <= SMALL and not self.tok.needs_whole(new):
            leaves, counts = [new], [self.tok.count_plain(new)]
        else:
            leaves, counts = cut(self.tok, new)
        self.encoded += len(new)
        if len(leaves) > GROWN * (b - a + 1):
            every = [(t, self.count[self.n + i]) for i, t in enumerate(self.leaves)]
            every[a : b + 1] = list(zip(leaves, counts, strict=True))
            self._make([t for t, _ in every], [c for _, c in every])
        else:
            self._set(a, new, sum(counts))
            for i in range(a + 1, b + 1):
                self._set(i, "", 0)


def cut(tok: PieceTokenizer, text: str) -> tuple[list[str], list[int]]:
    """Leaves of a text and their token counts."""
    if tok.needs_whole(text):
        leaves = _cut_odd(text)
        return leaves, [tok.count(t) if tok.needs_whole(t) else tok.count_plain(t) for t in leaves]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return _cut_bytes(tok, raw, np.array([0, len(raw)]))[0]


def _cut_odd(text: str) -> list[str]:
    """Leaves of a text with other spaces; no special token's string holds a space, so none is cut."""
    at = [m.end() for m in _BORDER.finditer(text)][LEAF // 2 - 1 :: LEAF // 2]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


def _cut_bytes(tok: PieceTokenizer, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[str], list[int]]]:
    """The same for many texts at once; the caller has sorted out those that need the library whole."""
    s, e, first = tok.pieces(data, offsets)
    n = tok.counts(data, s, e) if len(s) else np.zeros(0, np.int64)
    sums = np.append(0, np.cumsum(n))
    space = np.isin(data, list(b" \t\n\x0b\x0c\r")) if len(data) else np.zeros(0, bool)
    head = np.zeros(len(s), bool)
    if len(s):
        head[1:] = space[s[1:]] & ~space[s[1:] - 1]
    raw = data.tobytes()
    out = []
    for r in range(len(offsets) - 1):
        a, b = first[r], first[r + 1]
        good = np.flatnonzero(head[a + 1 : b]) + a + 1
        good = good[:: LEAF // 2] if len(good) else good
        at = [int(x) for x in good[1:]] if len(good) > 1 else []
        edges = [int(offsets[r]), *(int(s[x]) for x in at), int(offsets[r + 1])]
        marks = [int(a), *at, int(b)]
        out.append(([raw[x:y].decode("utf-8", "replace") for x, y in zip(edges, edges[1:], strict=False)], [int(sums[y] - sums[x]) for x, y in zip(marks, marks[1:], strict=False)]))
    return out


def _run(paths):
    def run(batches):
        tok = tokenizer(*paths)
        for batch in batches:
            data, offsets = raw_bytes(batch.column("text"))
            edits = batch.column("edits").to_pylist()
            before, after, chars, again, done = [], [], [], [], []
            for i, j in slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                whole = set(tok._whole_rows(part, off).tolist())
                made = _cut_bytes(tok, part, off)
                for r in range(j - i):
                    text = part[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") if r in whole else ""
                    tree = CountTree(tok, text) if r in whole else CountTree(tok, "", *made[r])
                    before.append(tree.tokens)
                    n = 0
                    for x in edits[i + r] or []:
                        if x is not None and x["pos"] is not None:
                            tree.edit(x["pos"], x["del"] or 0, x["ins"] or "")
                            n += 1
                    after.append(tree.tokens)
                    chars.append(tree.length)
                    again.append(tree.encoded)
                    done.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, after, chars, again, done))], names=["doc_id", "tokens_before", "tokens_after", "chars_after", "chars_encoded", "n_edits"])

    return run


def count_edits(docs: DataFrame, paths: tuple | None = None) -> DataFrame:
    """Counts of each row of ``docs`` (doc_id, text, edits array<struct<pos, del, ins>>) before and after its edits."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("edits").cast("array<struct<pos:bigint,del:bigint,ins:string>>").alias("edits"))
    return rows.mapInArrow(_run(paths or default_paths()), "doc_id long, tokens_before long, tokens_after long, chars_after long, chars_encoded long, n_edits long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the edits (doc_id, seq, pos, del, ins) of each document in order of seq."""
    own = edits.groupBy(F.col("doc_id").alias("__edit_doc")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "pos", "del", "ins"))), lambda x: F.struct(x["pos"], x["del"], x["ins"])).alias("edits"))
    return docs.drop("edits").join(own, F.col("doc_id") == F.col("__edit_doc"), "left").drop("__edit_doc")


def seeded_edits(docs: DataFrame, n: int = 4, seed: int = 31) -> DataFrame:
    """``docs`` with ``n`` edits each that follow from seed and doc_id: replacements, deletions, insertions anywhere."""
    words = F.array(*[F.lit(x) for x in ("", " [mail] ", "x", "\n", " rewritten passage, with 3 numbers", "é ", "'s")])
    h = lambda i, k: F.xxhash64(F.lit(seed), F.lit(i), F.lit(k), "doc_id")
    one = lambda i: F.struct(
        F.pmod(h(i, 0), F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")).alias("pos"),
        F.pmod(h(i, 1), F.lit(30)).cast("long").alias("del"),
        F.element_at(words, (F.pmod(h(i, 2), F.size(words)) + 1).cast("int")).alias("ins"),
    )
    return docs.withColumn("edits", F.array(*[one(i) for i in range(n)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(seeded_edits(table(spark, sf_dir, "documents", "doc_id", "text")))

"""Byte-level BPE ids of whole texts, exact and vectorised.

A byte-level BPE pre-tokenizer never looks across the border between a run of white space and
the word after it, except that one plain space joins the word. So a text falls into pieces
(words with that space, and what is left of each run) whose ids do not depend on their
surroundings; each different piece is encoded once by the ``tokenizers`` library and then found
by its bytes. Texts with other Unicode spaces or with a special token's string, where that border
is less simple, go to the library whole.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import repeat

import numpy as np

from .base import KEPT
from .words import bounds

#: Pieces remembered by a worker process; beyond that its cache starts anew.
CACHE_PIECES = 200_000

_ODD = re.compile(rb"[\x1c-\x1f\xc2\xe1-\xe3]")
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def _has_odd_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the byte positions begin a Unicode space outside ASCII's six (or a separator)."""
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    return (
        (a < 0x20)
        | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))))
        | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """``x`` with room for ``more`` entries behind the first ``used``; grows by doubling."""
    if used + more <= len(x):
        return x
    out = np.zeros(max(2 * len(x), used + more), x.dtype)
    out[:used] = x[:used]
    return out


class PieceTokenizer:
    """Ids of texts by a tokenizers JSON file of the byte-level BPE kind.

    ``ranks`` may name a tiktoken file of the same vocabulary: new words are then encoded by that
    library, which gives the same ids in less time.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.newline = self._slow(["\n"])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.n = np.zeros(1024, np.int64)
        self.at = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.inner.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces. Words are encoded joined by line feeds, which part them and
        whose id no word has; what holds other spaces or a special string is encoded alone."""
        every = b"\n".join(texts)
        if _ODD.search(every) or any(x in every for x in self.special):
            plain = np.array([not _ODD.search(t) and not t.isspace() and not any(x in t for x in self.special) for t in texts], bool)
        else:
            plain = ~np.fromiter(map(bytes.isspace, texts), bool, len(texts))
        words = [t for t, ok in zip(texts, plain, strict=True) if ok]
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray | None] = [None] * len(texts)
        if words:
            joined = b"\n".join(words).decode("utf-8", "replace")
            flat = np.array(self.fast.encode_ordinary(joined) if self.fast else self._slow([joined])[0], np.uint32)
            cut = np.flatnonzero(flat == self.newline)
            if len(cut) != len(words) - 1:
                raise ValueError("the tokenizer joins a line feed with a word")
            ends = np.append(cut, len(flat))
            counts[plain] = np.diff(ends, prepend=-1) - 1
            flat = np.delete(flat, cut)
            if plain.all():
                return flat, counts
            at = np.append(0, np.cumsum(counts[plain]))
            for n, i in enumerate(np.flatnonzero(plain)):
                parts[i] = flat[at[n] : at[n + 1]]
        odd = np.flatnonzero(~plain)
        for i, ids in zip(odd, self._slow([texts[i].decode("utf-8", "replace") for i in odd]), strict=True):
            parts[i] = np.array(ids, np.uint32)
            counts[i] = len(ids)
        return np.concatenate(parts), counts

    def _learn(self, texts: list[bytes]) -> None:
        ids, counts = self._ids(texts)
        have, more = len(self.slot), len(texts)
        self.slot.update(zip(texts, range(have, have + more), strict=True))
        self.n = _room(self.n, have, more)
        self.at = _room(self.at, have, more)
        self.ids = _room(self.ids, self.used, len(ids))
        self.n[have : have + more] = counts
        self.at[have : have + more] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first): byte bounds of all pieces in order, and each row's first piece."""
        start, end, first = bounds(data, offsets)
        rows = len(offsets) - 1
        n = len(start) + rows
        row = np.repeat(np.arange(rows), np.diff(first))
        slot = np.arange(len(start)) + row
        last = first[1:] + np.arange(rows)
        lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
        lo[slot], hi[slot] = start, end
        lo[last] = hi[last] = offsets[1:]
        prev = np.empty(n, np.int64)
        prev[1:] = hi[:-1]
        prev[first[:-1] + np.arange(rows)] = offsets[:-1]
        real = np.zeros(n, bool)
        real[slot] = True
        gap = lo - prev
        spaced = real & (gap > 0)
        spaced[spaced] = data[lo[spaced] - 1] == 0x20
        alone = real & (gap > 0) & ~spaced  # the run's last character stands by itself
        b = np.empty((n, 4), np.int64)
        b[:, 0] = prev
        b[:, 1] = lo - spaced - alone
        b[:, 2] = lo - spaced
        b[:, 3] = hi
        s, e = b[:, :3].ravel(), b[:, 1:].ravel()
        keep = e > s
        count = keep.reshape(n, 3).sum(1)
        per = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=per[1:])
        at = np.append(first[:-1] + np.arange(rows), n)
        return s[keep], e[keep], per[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all rows, and by row the index of its first id."""
        whole = self._whole_rows(data, offsets)
        s, e, first = self.pieces(data, offsets)
        slot = self._known(data, s, e)
        n = self.n[slot]
        upto = np.zeros(len(s) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        flat = np.repeat(self.at[slot] - upto[:-1], n) + np.arange(upto[-1])
        ids, at = self.ids[flat], upto[first]
        if len(whole):
            parts = [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)]
            for i in whole:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                parts[i] = np.array(self.inner.encode(text, add_special_tokens=False).ids, np.uint32)
            at = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=at[1:])
            ids = np.concatenate(parts) if parts else ids
        return ids, at

    def counts(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How many ids each of the byte ranges (pieces) has."""
        slot = self._known(data, s, e)  # may replace the arrays
        return self.n[slot]

    def needs_whole(self, text: str) -> bool:
        """Must this text go to the library as one?"""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return bool(len(self._whole_rows(raw, np.array([0, len(raw)]))))

    def count(self, text: str) -> int:
        return len(self.inner.encode(text, add_special_tokens=False).ids)

    def count_plain(self, text: str) -> int:
        """The same for a text that needs no special care."""
        return len(self.fast.encode_ordinary(text)) if self.fast else self.count(text)

    def _known(self, data, s, e) -> np.ndarray:
        """The slot of each piece; pieces are looked up by their bytes."""
        if len(self.slot) > CACHE_PIECES:
            self._clear()
        raw = data.tobytes()
        pieces = [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        slot = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(slot < 0)):
            words = [pieces[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(words)))
            slot[new] = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        return slot

    def _whole_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odd = np.flatnonzero(_ODD_LEAD[data])
        odd = odd[_has_odd_space(data, odd)]
        rows = set((np.searchsorted(offsets, odd, "right") - 1).tolist())
        raw = data.tobytes() if self.special else b""
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                rows.add(int(np.searchsorted(offsets, i, "right")) - 1)
                i = raw.find(s, i + 1)
        return np.array(sorted(rows), np.int64)


_loaded: dict[tuple, PieceTokenizer] = {}
KEPT.append(_loaded.clear)


def tokenizer(path: str, ranks: str | None = None) -> PieceTokenizer:
    """One tokenizer and cache for each file and worker process."""
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = PieceTokenizer(path, ranks)
    return _loaded[path, ranks]


def default_paths() -> tuple[str, str]:
    """(JSON, ranks) of the public 50k byte-level vocabulary."""
    import public_tokenizers as p

    return str(p.path("byte_bpe_50k.json")), str(p.path("byte_bpe_50k.tiktoken"))

"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

Base spans are those of three patterns (see KINDS). The field tags every word of a text as
outside, begin or inside of a secret, from hashed features of the word's shape, its neighbours
and the whole file, and is decoded by Viterbi. Tagged runs that no base span overlaps are added as
kind ``crf``.

It is trained here by likelihood (forward and backward sums, Adam) on windows of words: at most
TRAIN_WINDOWS around base spans and as many without one, by smallest hash, from PER_TEXT windows a
text at most and, for those without, from one text in NEGATIVES. What the patterns find would only
teach the patterns, so secrets, and random strings of other alphabets and lengths, are also shown
among the words of any window and behind the keyword; windows without get ordinary words that look
odd (addresses, dates, numbers, names) in the same way.
From half of all windows the neighbours' and file features are left out. So shape has to
tell a secret where its surroundings don't, and surroundings where its shape doesn't.

Decoding is exact and mostly skips: where a word's outside score leads both others by more than
any change of its transitions could give back, outside is certain, and such words cut the text
into short chains; only those are decoded.

Defined results: null text is empty and has no spans; offsets are code points, end exclusive;
rows with null or repeated doc_id are scanned like any other; without a single base span in the
table the field stays untrained and adds nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop_staged, raw_bytes, slices, staged, table
from .words import Prefix, bounds, mix

ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
KINDS = ("assign", "access", "hex", "crf")
TRAIN_WINDOWS = 1_000
PER_TEXT = 16
NEGATIVES = 16
WINDOW = 12
#: Altered windows of either kind (two of each at least).
EXAMPLES = 2_000
BUCKETS = 1 << 14
#: Buckets of a word's own features; the rest are its surroundings', which are held back more (see train).
OWN_BUCKETS = 1 << 12
SEED = 23


def base_spans(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, secret start, secret end) in bytes, by start then kind."""
    out = []
    if KEYWORD.search(raw):
        out += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(raw)]
    return sorted(out)


# ---------------------------------------------------------------------------------------
# Features

#: Class of a byte: 1 lower, 2 upper, 3 digit, 4 marks of keys, 5 beyond ASCII, 6 marks of addresses and sentences.
_ID = np.zeros(256, np.uint8)
_ID[97:123], _ID[65:91], _ID[48:58], _ID[128:] = 1, 2, 3, 5
_ID[33:48] = _ID[58:65] = _ID[91:97] = _ID[123:127] = 6
_ID[list(b"+=-_")] = 4
CLASSES = 6
FEATURES = 13
#: Which features are the word's own; the others tell its surroundings.
OWN = (0, 1, 2, 3, 10, 11, 12)


def file_features(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """By row: the share of words with a digit, and the logarithm of its lines."""
    sums = np.append(0, np.cumsum(digits))
    share = (sums[first[1:]] - sums[first[:-1]]) * 16 // np.maximum(np.diff(first), 1)
    feeds = np.append(0, np.cumsum(data == 10))
    return share * 32 + np.log2(feeds[offsets[1:]] - feeds[offsets[:-1]] + 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, file: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets (words, FEATURES), start, end, first) of all words of some texts.

    ``file`` gives the rows' file features where the texts are windows of others.
    """
    start, end, first = bounds(data, offsets)
    n = len(start)
    if not n:
        return np.zeros((0, FEATURES), np.int64), start, end, first
    h = Prefix(data, lower=True).span(start, end)
    cls = _ID[data]
    has = np.zeros(n, np.int64)
    counts = []
    for k in range(CLASSES):
        s = np.append(0, np.cumsum(cls == k + 1, dtype=np.int32))
        c = s[end] - s[start]
        counts.append(c)
        has |= (c > 0).astype(np.int64) << k
    changes = []
    for k in (3, 2):  # to or from a digit, to or from a capital
        turn = np.append(0, np.cumsum(np.append(False, (cls[1:] == k) != (cls[:-1] == k)), dtype=np.int32))
        changes.append((turn[end] - turn[np.minimum(start + 1, len(data))]).astype(np.int64) * 8 // (end - start))
    turns, cases = changes
    scale = np.minimum(np.log2(end - start) * 2, 15).astype(np.int64)
    shape = has | (counts[2].astype(np.int64) * 8 // (end - start) << CLASSES)
    key = has * 16 + scale

    row_first = np.zeros(n, bool)
    row_first[first[:-1][first[:-1] < n]] = True
    row_last = np.append(row_first[1:], True)

    def before(x, fill):
        return np.where(row_first, fill, np.append(fill, x[:-1]))

    def after(x, fill):
        return np.where(row_last, fill, np.append(x[1:], fill))

    words = np.diff(first)
    if file is None:
        file = file_features(data, offsets, first, counts[2] > 0)
    file = np.repeat(file, words)
    prev, u = before(h, np.uint64(1)), np.uint64
    cols = [
        np.zeros(n, u),
        shape.astype(u),
        key.astype(u),
        (turns * 64 + has).astype(u),
        prev,
        after(h, u(2)),
        before(prev, u(3)),
        before(key, 9999).astype(u),
        after(key, 9999).astype(u),
        (file * 64 + has).astype(u),
        (cases * 64 + has).astype(u),
        ((turns * 16 + cases) * 16 + scale).astype(u),
        (np.minimum(counts[3] + counts[5], 15).astype(np.int64) * 16 + scale).astype(u),
    ]
    out = np.empty((n, FEATURES), np.int64)
    for k, c in enumerate(cols):
        h = mix(c * u(2 * k + 3) + u(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        out[:, k] = h % u(OWN_BUCKETS) if k in OWN else u(OWN_BUCKETS) + h % u(BUCKETS - OWN_BUCKETS)
    return out, start, end, first


# ---------------------------------------------------------------------------------------
# The field: labels 0 outside, 1 begin, 2 inside


def train(x: np.ndarray, y: np.ndarray, real: np.ndarray, epochs: int = 24, batch: int = 400, rate: float = 0.1, l2: tuple[float, float] = (0.1, 30.0), seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(weights (BUCKETS + 1, 3), transitions (3, 3)) from padded sequences: x (N, T, FEATURES), y and real (N, T).

    Nearly every word is outside, so that any neighbour leans that way; ``l2`` holds the surroundings'
    weights back more than the own ones, and only neighbours that tell something keep theirs.
    """
    n = len(y)
    rng = np.random.default_rng(seed)
    w, a = np.zeros((BUCKETS + 1, 3)), np.zeros((3, 3))  # the last row stands for what is left out, and stays 0
    moments = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, a)]
    hold = np.where(np.arange(BUCKETS + 1) < OWN_BUCKETS, *l2)[:, None]
    step, steps = 0, epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            take = order[i : i + batch]
            grad, grad_a = _gradient(x[take], y[take], real[take], w, a)
            grad -= hold * (len(take) / n) * w
            grad[BUCKETS] = 0
            step += 1
            for (p, m, v), g in zip(moments, (grad, grad_a), strict=True):  # Adam, the rate falling to 0
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                p += rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w, a


def _gradient(x, y, real, w, a) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood, by forward and backward sums."""
    n, t = y.shape
    gold = np.eye(3)[y] * real[:, :, None]
    pair = real[:, 1:] & real[:, :-1]
    e = w[x].sum(2)
    alpha, beta = np.empty((n, t, 3)), np.zeros((n, t, 3))
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        nxt = e[:, i] + np.logaddexp.reduce(alpha[:, i - 1, :, None] + a[None], axis=1)
        alpha[:, i] = np.where(real[:, i, None], nxt, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        prv = np.logaddexp.reduce(a[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
        beta[:, i] = np.where(real[:, i + 1, None], prv, beta[:, i + 1])
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
    joint = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
    diff = (gold - p)[real]
    flat = x[real].ravel()
    grad = np.stack([np.bincount(flat, np.repeat(diff[:, c], FEATURES), BUCKETS + 1) for c in range(3)], 1)
    return grad, np.einsum("ntx,nty->xy", gold[:, :-1], gold[:, 1:] * pair[:, :, None]) - joint.sum((0, 1))


def viterbi(e: np.ndarray, a: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """Best labels of a chain; ``left`` and ``right`` tell whether a certain outside word adjoins."""
    score = e[0] + (a[0] if left else 0)
    back = np.zeros((len(e), 3), np.int64)
    for i in range(1, len(e)):
        way = score[:, None] + a
        back[i] = way.argmax(0)
        score = way.max(0) + e[i]
    if right:
        score = score + a[:, 0]
    out = np.empty(len(e), np.int64)
    out[-1] = score.argmax()
    for i in range(len(e) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def decode(e: np.ndarray, a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of all words (emissions e) of rows that begin at ``first``; the same as whole-row Viterbi."""
    y = np.zeros(len(e), np.int64)
    if not len(e):
        return y
    # changing one label to outside changes two transitions, each by this spread at most
    spread = max(float((a - a[:, [0]]).max()), 0.0) + max(float((a - a[[0], :]).max()), 0.0)
    sure = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) > spread + 1e-6
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return y
    row = np.searchsorted(first, open_, "right") - 1
    cut = np.append(True, (np.diff(open_) > 1) | (row[1:] != row[:-1]))
    heads = np.flatnonzero(cut)
    for h, nxt in zip(heads, np.append(heads[1:], len(open_)), strict=True):
        i, j, r = open_[h], open_[nxt - 1] + 1, row[h]
        y[i:j] = viterbi(e[i:j], a, i > first[r], j < first[r + 1])
    return y


def _windows(batches):
    """Windows of words: their bytes, file feature, hash and (hit) where the span and its secret part stand in them."""
    for batch in batches:
        data, offsets = raw_bytes(batch.column("text"))
        out = {k: [] for k in ("t", "file", "h", "hit", "at")}
        for i, j in slices(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            raw = part.tobytes()
            rows = [raw[off[r] : off[r + 1]] for r in range(j - i)]
            dig = [hashlib.blake2b(t, digest_size=8, salt=b"crf").digest() for t in rows]
            base = [base_spans(t) for t in rows]
            want = [r for r in range(j - i) if base[r] or dig[r][0] % NEGATIVES == 0]
            if not want:
                continue
            start, end, first = bounds(part, off)
            three = np.append(0, np.cumsum(_ID[part] == 3))
            digits = three[end] > three[start]
            file = file_features(part, off, first, digits)
            for r in want:
                a, b = int(first[r]), int(first[r + 1])
                if a == b:
                    continue
                at = int.from_bytes(dig[r][1:5])
                odd = np.flatnonzero(digits[a:b])
                # without a span: a word anywhere, or one with digits
                centers = [(s, t, x) for s, _, t, x, _ in base[r][:PER_TEXT]] or [(None, None, int(odd[at % len(odd)]) if len(odd) and at & 1 else at % (b - a))]
                for n, (s, _, x) in enumerate(centers):
                    c = x if s is None else int(np.searchsorted(end[a:b], off[r] + x, "right"))
                    lo, hi = start[a + max(0, c - WINDOW)], end[min(b, a + c + WINDOW + 1) - 1]
                    inside = [] if s is None else [(p, q, y, z) for p, _, q, y, z in base[r] if off[r] + p >= lo and off[r] + q <= hi]
                    out["t"].append(raw[lo:hi])
                    out["file"].append(int(file[r]))
                    out["h"].append(int.from_bytes(hashlib.blake2b(dig[r] + n.to_bytes(2), digest_size=8).digest(), "little") >> 1)
                    out["hit"].append(s is not None)
                    out["at"].append(np.array(inside, "<i8").reshape(-1) - (lo - off[r]) if inside else np.zeros(0, np.int64))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


#: Words that look odd and are no secrets ({w}: a word, {n}: digits).
ORDINARY = (
    "{w}.{n}@{w}.example.com", "https://www.{w}.example/{w}/{n}/{w}-{w}.html", "+{n}-{n}-{n}", "20{n}-0{n}-1{n}T10:2{n}:31Z", "{n}.{n}.{n}.{n}", "v{n}.{n}.{n}",
    "{w}_{w}_{n}", "/usr/{w}/{w}{n}/{w}.conf", "{n}{n}{n}{n}", "{w}{n}", "#{n}", "${n},{n}.00", "{w}-{w}-{w}", "({w}/{w})", "{w}:{n}", "{w}.{w}({n})", "{n}x{n}", "&{w};", "@{w}{n}", "{w}+{w}",
)
#: Alphabets of random secrets.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def random_secret(rng: np.random.Generator) -> bytes:
    """A random string of one alphabet, maybe behind a short mark, in two parts, or between marks."""
    string = lambda n: "".join(rng.choice(list(ALPHABETS[rng.integers(len(ALPHABETS))]), n))
    out = string(rng.integers(16, 64))
    kind = rng.integers(6)
    if kind == 0:
        out = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 5))) + rng.choice(["_", "-"]) + out
    elif kind == 1:
        out += rng.choice([".", "-", "_"]) + string(rng.integers(8, 40))
    elif kind == 2:
        out = rng.choice(list("\"'([<=:")) + out + rng.choice(list("\"')]>,;."))
    return (out + rng.choice(["", "", "", ".", ",", "=="])).encode()


def doubtful(word: bytes) -> bool:
    """Could it be a secret that no base pattern covers? Windows without a span don't teach that it is none."""
    return any(len(w) >= 16 and sum(48 <= c < 58 for c in w) >= 2 and any(c >= 65 for c in w) for w in re.findall(rb"[A-Za-z0-9+/_=-]+", word))


def _ordinary(rng: np.random.Generator, words: list[bytes]) -> bytes:
    out = ORDINARY[rng.integers(len(ORDINARY))].encode()
    for mark in (b"{w}", b"{n}"):
        while mark in out:
            new = (words[rng.integers(len(words))].strip(b".,;:!?\"'()|") or b"word") if mark == b"{w}" else str(rng.integers(0, 10 ** rng.integers(1, 5))).encode()
            out = out.replace(mark, new.replace(b"{", b""), 1)
    return out


def _examples(windows: list, seed: int = SEED):
    """(bytes, file feature, secrets' starts and ends, surroundings left out?) of the windows and their altered forms."""
    rng = np.random.default_rng(seed)
    every = [(bytes(r.t), r.file, np.array(r.at, np.int64).reshape(-1, 4).tolist()) for r in windows]
    every = [(t if at else b" ".join(w for w in t.split() if not doubtful(w)), file, at) for t, file, at in every]
    around = []
    for text, file, at in every:
        for p, q, _, _ in reversed(at):
            text = text[:p] + text[q:]
        around.append(([w for w in text.split() if not doubtful(w)] or [b"word"], file))
    for kind in (True, False):
        own = [r for r in every if bool(r[2]) == kind and r[0]]
        forms = max(2, -(-EXAMPLES // max(1, len(own))))  # a small table's windows are altered more often
        for text, file, at in own:
            yield text, file, [(y, z) for _, _, y, z in at], False
            for form in range(forms):
                bare = bool(rng.integers(2))
                if not kind:  # a word gives way to an odd one, or the window stays and loses its surroundings
                    words = text.split() or [b"word"]
                    k = rng.integers(len(words))
                    yield b" ".join(words if form == 1 else [*words[:k], _ordinary(rng, words), *words[k + 1 :]]), file, [], bare
                elif rng.integers(4):  # a secret, this one's or a random one, among the words of any window
                    words, file2 = around[rng.integers(len(around))]
                    k = rng.integers(len(words) + 1)
                    secret = text[at[0][2] : at[0][3]] if form % 4 == 1 else random_secret(rng)
                    head = b" ".join(words[:k]) + b" " if k else b""
                    yield head + secret + b" " + b" ".join(words[k:]), file2, [(len(head), len(head) + len(secret))], bare
                else:  # a random one behind the keyword
                    p, q, y, z = at[0]
                    secret = random_secret(rng)
                    yield text[:y] + secret + b" " + text[max(q, z) :].lstrip(b"\"'"), file, [(y, y + len(secret))], bare


def _sample(windows: DataFrame, most: int) -> list:
    """``most`` windows by smallest hash; a cut by hash first, so that tasks send few more than that."""
    n = windows.count()
    if n > 2 * most:
        windows = windows.where(F.col("h") < F.lit(int(2 * most / n * (1 << 63))))
    return windows.orderBy("h", "t").limit(most).collect()


def fit(docs: DataFrame, windows: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray] | None:
    """The trained field, or None where the table has no base span to learn from."""
    every = staged(docs.select("text").mapInArrow(_windows, "t binary, file long, h long, hit boolean, at array<long>"), "windows")
    got = [r for hit in (True, False) for r in _sample(every.where(F.col("hit") == hit).distinct(), windows)]
    drop_staged(every)
    return fit_windows(got) if any(r.hit for r in got) else None


def fit_windows(got: list) -> tuple[np.ndarray, np.ndarray]:
    """The field trained on some windows and their altered forms."""
    made = list(_examples(got))
    data = np.frombuffer(b"".join(m[0] for m in made), np.uint8)
    offsets = np.append(0, np.cumsum([len(m[0]) for m in made])).astype(np.int64)
    f, start, end, first = features(data, offsets, np.array([m[1] for m in made], np.int64))
    t = int(np.diff(first).max())
    x, y, real = np.full((len(made), t, FEATURES), BUCKETS, np.int64), np.zeros((len(made), t), np.int64), np.zeros((len(made), t), bool)
    around = [k for k in range(FEATURES) if k not in OWN]
    for i, (_, _, spans, bare) in enumerate(made):
        a, b = first[i], first[i + 1]
        x[i, : b - a], real[i, : b - a] = f[a:b], True
        if bare:
            x[i][:, around] = BUCKETS
        for s, z in spans:
            hit = np.flatnonzero((start[a:b] - offsets[i] < z) & (end[a:b] - offsets[i] > s))
            y[i, hit] = 2
            y[i, hit[:1]] = 1
    return train(x, y, real)


def _core(data: np.ndarray, s: int, t: int) -> tuple[int, int]:
    """A word's bounds without quotes and other marks around it."""
    inner = np.flatnonzero((_ID[data[s:t]] > 0) & (_ID[data[s:t]] != 6) | (data[s:t] == 47))
    return (s + int(inner[0]), s + int(inner[-1]) + 1) if len(inner) else (s, t)


def _scan(field):
    def run(batches):
        w, a = field.value or (None, None)
        w = None if w is None else w.astype(np.float32)
        for batch in batches:
            data, offsets = raw_bytes(batch.column("text"))
            n = batch.num_rows
            counts, sha, spans = np.zeros((n, 4), np.int64), [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for i, j in slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                added: dict[int, list] = {}
                if w is not None:
                    f, start, end, first = features(part, off)
                    e = np.zeros((len(f), 3), np.float32)
                    for k in range(FEATURES):
                        e += w[f[:, k]]
                    y = decode(e, a, first)
                    tagged = np.flatnonzero(y)
                    row = np.searchsorted(first, tagged, "right") - 1
                    for p, r in zip(tagged, row, strict=True):
                        own = added.setdefault(int(r), [])
                        s, t = _core(part, int(start[p]), int(end[p]))
                        s, t = s - int(off[r]), t - int(off[r])
                        if y[p] == 2 and own and own[-1][2] == p - 1:
                            own[-1][1:] = [t, p]
                        else:
                            own.append([s, t, p])
                raw = part.tobytes()
                for r in range(j - i):
                    text = raw[off[r] : off[r + 1]]
                    base = base_spans(text)
                    if not base and r not in added:
                        continue
                    every = [(s, k, t) for s, k, t, _, _ in base]
                    mine = [(s, 3, t) for s, t, _ in added.get(r, []) if not any(s < b[2] and t > b[0] for b in every)]
                    point = (lambda x: x) if text.isascii() else (lambda x, text=text: len(text[:x].decode("utf-8", "replace")))
                    name = lambda l: ",".join(f"{KINDS[k]}:{point(s)}:{point(t)}" for s, k, t in l)  # noqa: B023, E731, E741
                    for _, k, _ in every + mine:
                        counts[i + r, k] += 1
                    sha[i + r] = hashlib.sha256(name(every).encode()).hexdigest()
                    spans[i + r] = name(sorted(every + mine))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(sha), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, windows: int = TRAIN_WINDOWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts by kind, base_sha256, spans."""
    two = docs.select(F.col("doc_id").cast("long"), "text")
    field = docs.sparkSession.sparkContext.broadcast(fit(two, windows))  # BUCKETS * 3 numbers
    return two.mapInArrow(_scan(field), "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))

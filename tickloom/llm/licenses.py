"""License scans by conditional compression.

A candidate block (the words around a cue such as "licen", "copyright" or "warrant", so many that
any statement with the cue lies whole in it) is compressed alone and once with each template as
zstandard raw dictionary; templates rank by the bytes that knowing them saves. In that order all of
them, none left out, are then confirmed by exact wording: words missing, or added, inside a stretch
may be DIFFERENCES of the statement at most (so none in a short one) and none of them in a word with
a digit or one that tells licenses apart. SPDX tags are read as expressions; a template holds its own
tag, and a license known by its tag alone is a template of that line, ranked where the tag stands. A
bare name ("MIT License") grants nothing and is no finding. A stretch may run over line
feeds and comment markers (MARKERS are words), and that of a statement which bears differences over
empty lines; one of a few words stands within a paragraph. Of overlapping statements the one with the
fewest differences counts, then the longest, then the one whose template ranks first; no rank rules a
template out, as ordinary words around a short statement save more with the longer templates. All
that are confirmed are findings.

Defined results: null text is empty; rows with null or repeated doc_id are scanned like any
other; offsets are code points, end exclusive; of equal savings the template first by name wins.
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Statements that name a license, as their own texts word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
LATER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU = {"AGPL-3.0": "Affero General Public License", "GPL-2.0": "General Public License", "GPL-3.0": "General Public License", "LGPL-2.0": "Library General Public License", "LGPL-2.1": "Lesser General Public License", "LGPL-3.0": "Lesser General Public License"}
CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-SA": "Attribution-ShareAlike"}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: Wordings of the name after "licensed under" and the like.
NAMED = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0"],
}
#: Ids of SPDX tags that have no statement here and no digit or hyphen.
TAGS = ("Beerware", "Fair", "NCSA", "OpenSSL", "PostgreSQL", "Python", "Ruby", "Unlicense", "Vim", "WTFPL", "Zlib", "curl", "libtiff")


def _wordings() -> dict[str, list[str]]:
    """Completes TEMPLATES; returns them with the wordings of NAMED."""

    def add(name: str, *statements: str) -> None:
        have = TEMPLATES.setdefault(name, [])
        have += [s for s in statements if s not in have]

    for name, license in GNU.items():
        v = name.split("-")[1]
        short = v.removesuffix(".0")
        add(name, LATER.format(license, short), f"This work is licensed under the GNU {license}, version {short}.")
        NAMED[name] = [f"GNU {license} {x}" for x in dict.fromkeys((f"version {short}", f"version {v}", f"v{short}", f"v{v}"))]
        abbreviation = name.split("-")[0]
        add(name, *[f"Licensed under {the}{x}" for the in ("", "the ") for x in (name, f"{abbreviation}v{short}")])
    for kind, words in CC.items():
        for v, where in CC_VERSIONS.items():
            add(f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.", f"Licensed under CC-{kind}-{v}", f"This work is licensed under a Creative Commons {words} {v} {where} License.")
            add(f"CC-{kind}-{v}", *[f"Licensed under {the} Creative Commons {w} {v}" for the in ("a", "the") for w in dict.fromkeys((words, words.replace("-", " ")))])
    add("CC0-1.0", "Licensed under CC0 1.0", "Licensed under the Creative Commons Zero v1.0", "Licensed under the Creative Commons CC0 1.0 Universal License")
    out = {name: list(statements) for name, statements in TEMPLATES.items()}
    for name, forms in NAMED.items():
        out.setdefault(name, []).extend(f"{verb} under {the}{form}" for verb in ("Licensed", "Released", "Distributed") for the in ("", "the ", "the terms of the ") for form in forms)
    return out


EVERY = _wordings()
CUES = (b"licen", b"copyright", b"warrant", b"redistribut", b"permission", b"creative", b"spdx")
DIFFERENCES = 0.1
TAG = "SPDX-License-Identifier: "
MARKERS = ("dnl", "rem")
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_BY = re.compile(rb"cc[\W_]+by")
_NAME = re.compile(r".*(?:affero|lesser|attribution|commercial|alike|noderiv|apache|mozilla).*|gnu|creative|commons|bsd|mit|isc")
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.\-]*\+?\)*"
_TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)", re.I | re.A)
_CUE = re.compile(r"licen|copyright|warrant|redistribut|permission|creative[\W_]+commons|cc[\W_]+by|spdx", re.I | re.A)


class Statement:
    """One statement of a template, and where it stands in other words with few differences."""

    def __init__(self, name: str, text: str):
        self.name = name
        self.words = [w.lower() for w in _WORD.findall(text)]
        self.most = int(DIFFERENCES * len(self.words))
        self.digits = [w for w in self.words if any(c.isdigit() for c in w)]
        self.names = names(self.words)
        self.first = dict.fromkeys(self.words[: self.most + 1])  # one of them at least is there
        self.bits: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << i

    def at(self, words: list[str], a: int, end: int):
        """(differences, last + 1 word) of the best stretch of words from a, or None.

        ``end`` is where the paragraph ends; a statement that bears differences may go on behind it.

        Exact: the longest common subsequence with every stretch, in the bits of one number. A
        longer stretch never has fewer added words, so the search ends at the first with too many.
        """
        n, most = len(self.words), self.most
        if not most:
            return (0, a + n) if a + n <= end and words[a : a + n] == self.words else None
        full = left = (1 << n) - 1
        same, best = 0, None
        for b in range(a, min(len(words), a + n + most)):
            if m := self.bits.get(words[b]):
                u = left & m
                left = ((left + u) | (left & ~m)) & full
                same = n - left.bit_count()
            added = b + 1 - a - same
            if added > most:
                break
            if m and n - same <= most:
                key = (max(n - same, added), n - same + added)
                if (best is None or key < best[0]) and self.named(words[a : b + 1]):
                    best = key, b + 1
        return best and (best[0][0], best[1])

    def named(self, part: list[str]) -> bool:
        """Another version or name is another license: the statement's words with a digit are all there, and just its names."""
        there = iter(part)
        return all(w in there for w in self.digits) and names(part) == self.names


def names(words: list[str]) -> list[str]:
    """The words that tell one license from another."""
    return [w for i, w in enumerate(words) if _NAME.fullmatch(w) or (w == "library" and i and words[i - 1] == "gnu")]


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=9, write_content_size=False)
        self.given = lambda texts: z.ZstdCompressor(level=9, dict_data=z.ZstdCompressionDict("\n".join(texts).encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False)
        self.known = []
        self.tags = {t.lower(): t for t in [*TAGS, *templates]}
        self.statements: dict[str, list[Statement]] = {}
        self.reach = 0
        for name in sorted(templates):
            self.known.append((name, self.given([TAG + name, *templates[name]])))
            self.statements[name] = [Statement(name, t) for t in templates[name]]
            self.reach = max([self.reach, *(len(s.words) + s.most for s in self.statements[name])])

    def ranked(self, block: bytes, tags: set[str] = frozenset()) -> list[tuple[int, str]]:
        """(bytes saved, name) of every template, most first; ``tags``: names that may have no template but their tag."""
        alone = len(self.plain.compress(block))
        more = [(n, self.given([TAG + n])) for n in sorted(tags) if n not in self.statements]
        return sorted(((alone - len(c.compress(block)), n) for n, c in self.known + more), key=lambda x: (-x[0], x[1]))

    def find_all(self, block: str, found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
        """(name, saved, differences, start, end) of every confirmed statement, in order, none overlapping.

        The block is compressed with every template first; in the order of what they save, all are
        looked for. Of overlapping statements the one with the fewest differences stays, then the
        longest, then the one whose template ranks first. ``found``: the block's words, with their offsets in the text.
        """
        words, paragraphs = [f[0] for f in found], [f[3] for f in found]
        tags = [(name, found[0][1] + a, found[0][1] + b) for name, a, b in self.tagged(block)] if "spdx-license-identifier" in words else []
        at: dict[str, list[int]] = {}
        for a, w in enumerate(words):
            at.setdefault(w, []).append(a)
        ends, hits, out = None, [], []
        for rank, (saved, name) in enumerate(self.ranked(block.encode(), {t[0] for t in tags})):
            out += [(name, saved, 0, a, b) for n, a, b in tags if n == name]
            for s in self.statements.get(name, ()):
                for w in s.first:
                    for a in at.get(w, ()):
                        ends = ends or paragraph_ends(paragraphs)
                        if hit := s.at(words, a, ends[a]):
                            hits.append((hit[0], -len(s.words), rank, a, hit[1], name, saved))
        taken = bytearray(len(words))
        for d, _, _, a, b, name, saved in sorted(hits):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((name, saved, d, found[a][1], found[b - 1][2]))
        return sorted(out, key=lambda x: x[3])

    def tagged(self, block: str):
        """(name, start, end) of each license of the block's SPDX tags; "-only", "-or-later" and "+" are left out."""
        for tag in _TAG.finditer(block):
            first, after = True, ""
            for m in re.finditer(r"[^\s()]+", tag[1]):
                word = m.group().rstrip(".")
                if after.upper() != "WITH" and word.upper() not in ("AND", "OR", "WITH"):
                    plain = re.sub(r"(?i)\+$|-only$|-or-later$", "", word)
                    name = self.tags.get(plain.lower()) or (plain if re.search(r"[\d\-]", plain) else "")
                    if name:
                        yield name, tag.start() if first else tag.start(1) + m.start(), tag.start(1) + m.start() + len(word)
                    first = False
                after = word

    def find(self, block: str):
        """(name, saved, differences, start, end) of the statement with the fewest differences, or None."""
        return min(self.find_all(block, list(word_places(block))), key=lambda x: x[2], default=None)


def paragraph_ends(paragraphs: list[int]) -> list[int]:
    """For each word, the first one behind its paragraph."""
    out = [len(paragraphs)] * len(paragraphs)
    for a in range(len(paragraphs) - 2, -1, -1):
        out[a] = out[a + 1] if paragraphs[a] == paragraphs[a + 1] else a + 1
    return out


def word_places(text: str):
    """(lower-case word, start, end, its paragraph) of each word; a line without words ends a paragraph."""
    paragraph = last = 0
    for m in _WORD.finditer(text):
        feeds = text.count("\n", last, m.start())
        word, last = m.group().lower(), m.end()
        paragraph += feeds > 1
        if word in MARKERS and feeds:
            continue
        yield word, m.start(), last, paragraph


def candidates(text: str, reach: int):
    """Blocks around cues, as lists of word_places(): ``reach`` words to both sides; blocks that touch are one.

    So a statement with a cue lies whole in one block, wherever in it the cue stands.
    """
    cues = [m.start() for m in _CUE.finditer(text)]
    before, block, left, k = deque(maxlen=reach), [], 0, 0
    for w in word_places(text):
        if k < len(cues) and cues[k] < w[2]:
            while k < len(cues) and cues[k] < w[2]:
                k += 1
            if not left:
                block = list(before)
            left = 2 * reach + 1
        elif not left and k == len(cues):
            return
        if left:
            block.append(w)
            left -= 1
            if not left:
                yield block[:-reach]
        before.append(w)
    if left:
        yield block[: len(block) - max(0, reach - left)]


def scan_text(raw: bytes, known: Templates) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """(candidate blocks, [(name, start, end, saved, differences)]) with code-point offsets."""
    low = raw.lower()
    if not any(c in low for c in CUES) and not _BY.search(low):
        return 0, []
    text, n, out = raw.decode("utf-8", "replace"), 0, []
    for found in candidates(text, known.reach):
        n += 1
        for name, saved, diff, s, e in known.find_all(text[found[0][1] : found[-1][2]], found):
            out.append((name, s, e, saved, diff))
    return n, out


def _scan(templates):
    def run(batches):
        known = Templates(templates)
        for batch in batches:
            n, names, spans, exact = [], [], [], []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid and text.as_buffer() is not None else b""
                k, found = scan_text(raw, known)
                n.append(k)
                names.append(",".join(sorted({f[0] for f in found})))
                spans.append(",".join(f"{f[0]}:{f[1]}:{f[2]}" for f in found))
                exact.append(sum(f[4] == 0 for f in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string()), pa.array(exact, pa.int64())], names=["doc_id", "n_candidates", "licenses", "spans", "n_exact"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_candidates, licenses, spans, n_exact."""
    two = docs.select(F.col("doc_id").cast("long"), "text")
    return two.mapInArrow(_scan(templates or EVERY), "doc_id long, n_candidates long, licenses string, spans string, n_exact long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))

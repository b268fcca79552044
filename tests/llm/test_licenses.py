import random
import textwrap

from tickloom.llm import licenses

from .docs import SCHEMA, awkward, empty


def test_each_statement_is_found_where_it_stands(spark):
    rnd = random.Random(3)
    prose = lambda n: " ".join(rnd.choice(["alpha", "bête", "gamma", "of", "the", "work"]) for _ in range(n))
    rows, want = [], {}
    for name, statements in licenses.TEMPLATES.items():
        for s in statements:
            for before in (prose(5) + ".\n", prose(900) + " "):
                i = len(rows)
                rows.append((i, f"{before}{s} \n{prose(4)}", "en", "s", 0))
                want[i] = (name, len(before), s)
    wrong = ["Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 7.", "His driving license and the copyright were lost.", "MIT License"]
    rows += [(1000 + i, w, "en", "s", 0) for i, w in enumerate(wrong)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (name, start, s) in want.items():
        assert got[i].licenses == name, (name, s, got[i])
        n, a, b = got[i].spans.split(",")[0].split(":")
        assert int(a) == start and s[: int(b) - int(a)].rstrip(".):\"") in s
    assert all(got[1000 + i].licenses == "" for i in range(len(wrong)))


def test_small_changes_in_a_long_statement():
    known = licenses.Templates(licenses.TEMPLATES)
    text = licenses.TEMPLATES["MIT"][1]
    assert known.find(text.replace("deal in", "trade in"))[0] == "MIT"
    assert known.find(text.replace("deal in", "trade in"))[2] >= 1
    words = text.split()
    assert known.find(" ".join(w if i % 3 else "other" for i, w in enumerate(words))) is None


def test_a_template_that_saves_little_is_tried_too():
    known = licenses.Templates(licenses.TEMPLATES)
    halves = [s[len(s) // 2 :] for n in ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "ISC", "MIT") for s in licenses.TEMPLATES[n] if len(s) > 80]
    text = " ".join(halves) + " Licensed under CC BY 4.0."
    assert "CC-BY-4.0" not in [r[1] for r in known.ranked(text.encode())[:3]]
    assert known.find(text)[0] == "CC-BY-4.0"


KNOWN = licenses.Templates(licenses.EVERY)


def spans(text):
    found = licenses.scan_text(text.encode(), KNOWN)[1]
    return [(f[0], text[f[1] : f[2]]) for f in found]


def test_every_statement_of_a_block_is_found():
    two = "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License."
    assert [s[0] for s in spans(two)] == ["MIT", "CC-BY-NC-4.0", "MIT"]
    long = [(n, s) for n in licenses.TEMPLATES for s in licenses.TEMPLATES[n]] * 2
    for filler in (0, 1, 7, 40, 75, 110, 300):  # one line, statements at every distance from the last cue
        text = ("é b " * filler).join(s + " " for _, s in long)
        assert [s[0] for s in spans(text)] == [n for n, _ in long], filler


def test_search_equals_brute_force():
    rnd = random.Random(5)
    lcs = lambda x, y: lcs_table(x, y)[-1][-1]
    s = licenses.Statement("x", "a b c d e f g h a b c d i j k a l m n o")
    for _ in range(60):
        words = [w for w in s.words if rnd.random() > 0.06]
        for _ in range(rnd.randrange(3)):
            words.insert(rnd.randrange(len(words)), rnd.choice("abcz"))
        want = [max(20 - lcs(s.words, words[:b]), b - lcs(s.words, words[:b])) for b in range(1, len(words) + 1)]
        got = s.at(words, 0, len(words))
        assert (got[0] if got else None) == (min(want) if min(want) <= 2 else None)


def lcs_table(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t


def test_a_wrapped_statement_is_found():
    for name, statements in licenses.EVERY.items():
        for s in statements:
            for mark in ("", "# ", " * ", "// ", "dnl "):
                for width in (20, 72):
                    lines = textwrap.wrap(s, width, break_long_words=False, break_on_hyphens=False)
                    for feed in ("\n", "\r\n"):
                        got = spans("Title\n" + "".join(mark + x + feed for x in lines) + "other words")
                        assert [g[0] for g in got] == [name] and got[0][1][:8] == s[:8], (s, mark, width)
    assert spans("covered by the license, released under\n\nthe MIT License.") == []
    long = licenses.TEMPLATES["MIT"][1]
    assert [g[0] for g in spans(long.replace("free of charge", "free\n\nof charge"))] == ["MIT"]


def test_names_tell_licenses_apart():
    for text, name in {
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
        "it is licensed under the Creative Commons Attribution 3.0 United States License": "CC-BY-3.0",
        "Licensed under the MIT License": "MIT",
        "distributed under the terms of the Apache License 2.0": "Apache-2.0",
        licenses.TEMPLATES["LGPL-2.1"][0].replace("This program", "This library"): "LGPL-2.1",
    }.items():
        assert [s[0] for s in spans(text)] == [name], text
    for text in ("This work is licensed under the GNU Secret Lesser General Public License, version 3.", licenses.TEMPLATES["ISC"][0].replace("any purpose", "any non-commercial purpose")):
        assert "GPL-3.0" not in [s[0] for s in spans(text)] and "ISC" not in [s[0] for s in spans(text)]


def test_spdx_tags():
    assert spans("// SPDX-License-Identifier: MIT\nint x;") == [("MIT", "SPDX-License-Identifier: MIT")]
    got = spans("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR apache-2.0\nand MIT")
    assert [g[0] for g in got] == ["GPL-2.0", "Apache-2.0"] and got[1][1] == "apache-2.0"
    assert [g[0] for g in spans("SPDX-License-Identifier: LGPL-2.1+ AND Zlib AND BSL-1.0.")] == ["LGPL-2.1", "Zlib", "BSL-1.0"]
    assert spans("An SPDX-License-Identifier: see the license") == spans("the SPDX-License-Identifier tag") == []


def test_compression_ranks_every_template_before_any_wording_is_checked(monkeypatch):
    steps = []
    ranked, at = licenses.Templates.ranked, licenses.Statement.at

    def watched(self, *a):
        steps.append([n for _, n in ranked(self, *a)])
        return ranked(self, *a)

    monkeypatch.setattr(licenses.Templates, "ranked", watched)
    monkeypatch.setattr(licenses.Statement, "at", lambda self, *a: (steps.append(self.name), at(self, *a))[1])
    for text in ("Licensed to nobody: the licence was lost.", "Released under the MIT License. Licensed under CC BY-NC 4.0."):
        steps.clear()
        spans(text)
        order, *tried = steps
        assert sorted(order) == sorted(licenses.EVERY)  # once a block, with all templates
        assert [order.index(n) for n in tried] == sorted(order.index(n) for n in tried)
    found = licenses.scan_text(b"SPDX-License-Identifier: BSL-1.0 OR MIT", KNOWN)[1]
    assert [(f[0], f[3] > 0) for f in found] == [("BSL-1.0", True), ("MIT", True)]


def test_awkward_and_empty(spark):
    assert licenses.scan_licenses(awkward(spark)).count() == awkward(spark).count()
    assert licenses.scan_licenses(empty(spark)).count() == 0

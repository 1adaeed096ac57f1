import random
import re

import pytest

from tesserae.llm import licenses
from tesserae.llm.text import ALNUM

from . import cases


def regex(markup):
    """The markup as one regular expression over words that each end in a space."""
    out = []
    for p in markup.replace("<<any ", "<<any").replace("<<", " <<").replace(">>", ">> ").split():
        if p == "<<opt>>":
            out.append("(?:")
        elif p == "<<end>>":
            out.append(")?")
        elif p.startswith("<<any"):
            out.append(f"(?:[^ ]+ ){{0,{p[5:-2]}}}")
        else:
            out.append(p + " ")
    return re.compile("".join(out))


def longest(words, at, pattern):
    best = -1
    for end in range(at + 1, len(words) + 1):
        if pattern.fullmatch("".join(w + " " for w in words[at:end])):
            best = end
    return best


MARKUPS = ["a b", "a <<opt>>b<<end>> c", "a <<any 2>> b", "a <<opt>>b <<opt>>c<<end>> a<<end>> b", "<<opt>>a<<end>> b <<any 1>>", "a a a", "<<opt>>a <<any 1>> b<<end>> c <<opt>>a<<end>>"]


def test_automata_against_regular_expressions():
    rng = random.Random(2)
    for markup in MARKUPS:
        t, pattern = licenses.compile_template(markup, "x"), regex(markup)
        for _ in range(150):
            words = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
            for at in range(len(words)):
                assert t.read([w.encode() for w in words], at) == longest(words, at, pattern), (markup, words, at)


def test_bad_markup():
    for markup in ("<<opt>>a", "a <<end>>", "a <<what>> b"):
        with pytest.raises(ValueError):
            licenses.compile_template(markup, "x")
    with pytest.raises(ValueError):
        licenses.compile_template("<<any 2>> a", "x").first_words()


def expected(doc_id, text):
    words = cases.ALNUM_WORD.findall(cases.lower(text or ""))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return [doc_id, len(words), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({x for _, x in found}))]


@pytest.mark.parametrize("source", ["fixture", "table"])
def test_base_against_brute_force(spark, source):
    if source == "fixture":
        data = [*cases.rows(n=20), (1, "CC-BY-NC cc by nc"), (2, "Under the MIT license, under the\nMIT LICENSE; Apache License, Version 2.0"), (3, "under the mit licenses"), (None, "cc by-nc")]
        docs = cases.frame(spark, data)
    else:
        docs = cases.table(spark, "sf0.01", "documents")
        data = [(r.doc_id, r.text) for r in docs.collect()]
    rows = licenses.scan(docs).collect()
    got = sorted(([r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] for r in rows), key=repr)
    assert got == sorted((expected(*r[:2]) for r in data), key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""


def test_templates(spark):
    texts = {
        1: (f"MIT License\n\nCopyright (c) 2020 Some One\n\n{MIT}", "mit"),
        2: (MIT, "mit"),
        3: (MIT.replace("notice shall be included", "notice (including the next paragraph) shall be included"), "mit"),
        4: (MIT.replace("free of charge", "for a fee"), ""),
        5: (MIT.replace("OTHER DEALINGS IN THE SOFTWARE", "OTHER DEALINGS IN THIS SOFTWARE"), ""),  # late wording counts as much
        6: (MIT.split("THE SOFTWARE IS PROVIDED")[0], ""),  # no disclaimer
        7: (f"{GPL}", "gpl-3"),
        8: (GPL.replace("version 3", "version 2").replace(", or (at your option) any later version", ""), "gpl-2"),
        9: (GPL.replace("WITHOUT ANY WARRANTY", "WITH A WARRANTY"), ""),
        10: (GPL.replace("General Public", "Lesser General Public").replace("version 3", "version 2.1"), "lgpl"),
        11: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        12: ("Licensed under the Apache License, Version 2.0 (the \"License\")", "apache-2"),
        13: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        14: ("Copyright (c) 2019, A. Body and Sons Ltd. All rights reserved.", ""),
        15: ("// SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        16: ("nothing here", ""),
        17: ("word " * 200_000 + MIT, "mit"),
    }
    rows = {r.doc_id: r for r in licenses.scan(cases.frame(spark, [(k, t) for k, (t, _) in texts.items()])).collect()}
    assert {k: r.labels for k, r in rows.items()} == {k: label for k, (_, label) in texts.items()}
    assert rows[1].score == rows[2].score == 1 and rows[16].score == 0 and rows[1].base_labels == ""


def plain(markup, optional):
    """The markup's wording with all optional parts, or none, and as many replaceable words as may be, or none."""
    if optional:
        markup = re.sub(r"<<any (\d+)>>", lambda m: " zz" * int(m[1]) + " ", re.sub(r"<<(opt|end)>>", " ", markup))
    else:
        markup = re.sub(r"<<any \d+>>", " ", markup)
        while "<<opt>>" in markup:
            markup = re.sub(r"<<opt>>[^<]*<<end>>", " ", markup)
    return markup.encode().translate(ALNUM).split()


def test_all_templates_read_themselves_and_refuse_a_changed_word():
    rng = random.Random(3)
    for markup, label in licenses.TEMPLATES:
        t = licenses.compile_template(markup, label)
        full, words = plain(markup, True), plain(markup, False)
        assert t.read(words, 0) == len(words) and t.read(full, 0) == len(full)
        assert t.first_words()
        for k in rng.sample(range(len(words)), min(len(words), 25)):
            assert t.read([*words[:k], b"qq", *words[k + 1 :]], 0) != len(words), (label, words[k])
            assert k == len(words) - 1 or t.read([*words[:k], *words[k + 1 :]], 0) != len(words) - 1


def test_empty_table(spark):
    assert licenses.scan(cases.frame(spark, [])).count() == 0

"""Queries with SQL against DuckDB; awkward documents for the operators that have it."""

import textwrap

import pytest
from pyspark.sql import functions as F

from statloom.llm import fingerprints, licences, mixing
from statloom.llm.queries import MIX_WEIGHTS, ORACLE_SQL, QUERIES, mix_levels
from tests.compare import same
from tests.llm import nasty


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_fingerprints_of_awkward_documents(spark):
    got = fingerprints.edited_pairs(nasty.docs(spark)).collect()
    assert len(got) == len(nasty.rows())
    known = sorted((r[0], r[1] or "") for r in nasty.rows() if r[0] is not None)
    after = {k: known[(i + 1) % len(known)][1] for i, k in enumerate(known)}
    for r in got:
        q = len(r.text) // 4
        follow = after[r.doc_id, r.text] if r.doc_id is not None else ""
        if r.doc_id != 0:  # the repeated row follows itself once
            assert r.edited == r.text[: len(r.text) - q] + follow[:q]
    same_text = {}
    for r in got:
        assert same_text.setdefault(r.text, r.sketch) == r.sketch
    assert fingerprints.edited_pairs(nasty.none(spark)).count() == 0


def test_estimates(spark):
    a, b = nasty.sentence(1, 3000), nasty.sentence(1, 2000) + " " + nasty.sentence(9, 1000)
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    sa, sb = ({tuple(t.split()[i : i + 5]) for i in range(2996)} for t in (a, b))
    assert abs(r.r - len(sa & sb) / len(sa | sb)) < 0.12
    assert abs(r.c - len(sa & sb) / len(sa)) < 0.15
    assert abs(r.n / len(sa) - 1) < 0.25


def test_mixture_of_awkward_documents(spark):
    got = mixing.mix(nasty.docs(spark), mix_levels(), MIX_WEIGHTS, 0.5, 2)
    assert set(got.columns) == set(nasty.docs(spark).columns)
    rows = got.collect()
    assert len(rows) == len(nasty.rows())
    assert sum(r.tokens * r.copies for r in rows) <= 0.5 * sum(r.tokens for r in rows)
    assert mixing.mix(nasty.none(spark), mix_levels(), MIX_WEIGHTS, 0.5).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000), ("c", "w", 1000)], "d string, s string, have long")
    got = {r.s: r.quota for r in mixing.leaf_budgets(leaves, ["d", "s"], {"d": {"a": 2, "b": 1, "c": 1}}, 0.4, 1).collect()}
    budget = int(3010 * 0.4)
    assert got["x"] == 10  # all it has
    assert got["x"] + got["y"] == budget // 2  # its sibling takes the shortage, not b or c
    assert abs(got["z"] - budget // 4) <= 1 and abs(got["w"] - budget // 4) <= 1


def test_wrapped_licences(spark):
    said = {c: s for s, c in licences.SENTENCES.items()}
    mit, bsd, apache = (". ".join(said[c] for c in letters) + "." for letters in ("NOP", "RSTUV", "ABD"))
    wrap = lambda text, lead="", end="\n": end.join(lead + line for line in textwrap.wrap(text, 72))
    texts = {
        1: ("MIT License\n\nCopyright (c) 2020 A\n\n" + wrap(mit), "NOP", "MIT"),
        2: ("MIT License\n" + wrap(mit, " * ", "\r\n") + "\n */ code", "NOP", "MIT"),
        3: (wrap(bsd, "# "), "RSTUV", "BSD-3-Clause"),
        4: (wrap(apache, "// "), "ABD", "Apache-2.0"),
        5: ("a line\nLicensed under CC BY 4.0\nanother line", "Y", "CC-BY-4.0"),
        6: ("This work is dedicated to the public\ndomain", "0", "CC0-1.0"),
        7: ("Released under\n\nthe MIT License", "", ""),
    }
    got = licences.scan(spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.sentence_ids, r.licences) for r in got} == {i: t[1:] for i, t in texts.items()}


def test_whole_licence_texts(spark):
    wrap = lambda text, lead="": "\n".join(lead + line for block in text.split("\n\n") for line in [*textwrap.wrap(block, 64), ""])
    mit = (
        "The MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        'promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS)."
    )
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
        "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    )
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    )
    texts = [mit, bsd, apache, gpl]
    rows = [(i * 3 + j, wrap(t, lead) if j else t) for i, t in enumerate(texts) for j, lead in enumerate(("", "", " * "))]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, want in enumerate([("NOPQ", "MIT"), ("RSTUVW", "BSD-3-Clause"), ("ABDE", "Apache-2.0"), ("Ighi", "GPL-3.0-or-later")]):
        for j in range(3):
            ids, names = got[i * 3 + j]
            assert (ids.replace("C", ""), names) == want, (i, j)


def test_sentences_without_a_usual_word(spark):
    docs = spark.createDataFrame([(1, "Take it. Zebras may graze here, always.")], "doc_id long, text string")
    assert licences.scan(docs, {"zebras may graze here always": "z"}, [("Zebra", "z")]).first().licences == "Zebra"


def test_licences_of_awkward_documents(spark):
    got = licences.scan(nasty.docs(spark)).collect()
    assert len(got) == len(nasty.rows())
    last = next(r for r in got if r.doc_id == 63)
    assert (last.sentence_ids, last.licences, last.n_unknown) == ("AM", "Apache-2.0,MIT", 0)
    mit = [s for s, c in licences.SENTENCES.items() if c in "NOP"]
    text = ".\n".join(s.capitalize() for s in mit) + ". Under some licence of its own. Licensed under CC BY-NC 4.0"
    one = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (one.sentence_ids, one.licences, one.n_unknown) == ("NOPX", "MIT,CC-BY-NC-4.0", 1)
    assert licences.scan(nasty.none(spark)).count() == 0


def test_wrapped_sentences_against_sql(spark, tmp_path):
    """The SQL of the licence scan unwraps as the operator does: sentences on one line, on several, beside each other and cut by blank lines."""
    known = list(licences.SENTENCES)
    wrap = lambda text, width: "\n".join(textwrap.wrap(text, width))
    texts = [f"{wrap(a, w)}.\n{wrap(b, 2 * w)}. Some other text about a licence\nof {c}" for a, b, c, w in zip(known, known[1:], known[2:], [20, 33, 47, 61] * 40)]
    texts += [" \r\n ".join([known[0], *known[3].split(), known[1]]), "\n\n".join(known[:4]), "\n".join(" ".join(known[:6]).split()), None, "", known[0].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    same(QUERIES["op7_licence_scan"](spark, str(tmp_path)), ORACLE_SQL["op7_licence_scan"], str(tmp_path))
    assert any("," in r.licences for r in licences.scan(docs).collect())

"""Quality rules and license scan."""

from __future__ import annotations

import random
import re

from brute import base, words

from folio.llm import license_scan, quality_rules
from folio.llm.license_texts import TEXTS
from folio.llm.queries import ORACLES


def test_base_counts(odd, none):
    want = sorted((str(r.doc_id), *base(r.text)) for r in odd.collect())
    got = quality_rules.quality_rules(odd)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got.collect()) == want
    assert quality_rules.quality_rules(none).count() == 0


def test_base_counts_of_repeats(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n#x", " | é"]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'h' AS source")
    for r in quality_rules.quality_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])


def test_lines_that_many_documents_share(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"Shared LINE of the host \n{own(i)}", "a") for i in range(20)] + [(100 + i, own(100 + i), "a") for i in range(20)]
    rows += [(200, "shared line of the host\nShared line of the host", "a"), (300, f"shared line of the host\n{own(300)}", "b")]
    rows += [(400 + i, own(400), "c") for i in range(50)]  # copies of one text are one text
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_words=5, max_repeat_percent=100).collect()}
    assert got[0].clean_text == own(0) and got[0].kept and got[0].n_removed_lines == 1
    assert not got[200].kept and not got[200].base_failed and got[200].clean_text == ""
    assert got[300].n_removed_lines == 0 and got[100].kept and all(got[400 + i].kept for i in range(50))


def _shingles(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def test_licenses(spark, none):
    rnd = random.Random(5)
    filler = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    docs, planted = [], set()
    for i in range(150):
        name = rnd.choice(list(TEXTS))
        body = TEXTS[name].split()
        if i % 3 == 0:
            docs.append((i, filler(60)))
            continue
        if len(body) > 100 and i % 3 == 1:
            body[len(body) // 2] = "changed"  # five of many shingles go
        docs.append((i, filler(rnd.randint(0, 80)) + "\n" + " ".join(body).upper() + "\n" + filler(rnd.randint(0, 80))))
        planted.add((i, name))
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(df).collect() if r.kind == "text"}
    assert planted == set(got)  # each license, and no sibling of it
    texts = dict(docs)
    for (i, name), r in got.items():
        template = set(_shingles(TEXTS[name]))
        assert len(template & set(_shingles(texts[i]))) / len(template) >= r.containment - 1e-4 >= 0.7999
    assert license_scan.scan_licenses(none).count() == 0
    assert words("a b") == ["a", "b"]


def test_licenses_of_odd_rows(odd):
    assert license_scan.scan_licenses(odd).count() == 0
    docs = odd.select("doc_id", "row").selectExpr("*", "'Released under the MIT License.' AS text")
    assert license_scan.scan_licenses(docs).where("kind = 'notice'").count() == docs.count() == license_scan.scan_licenses(docs).where("kind = 'name'").count()  # repeated rows and null doc_ids too


def test_siblings_are_told_apart(spark):
    """Invented files with the notices of related licenses, wrapped, commented and among other words."""
    header = lambda name: "\n".join(f" * {line}" for line in re.findall(r".{1,60}(?:\s|$)", TEXTS[name]))
    names = ["gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "mit", "bsl-1.0", "apache-2.0"]
    docs = [(i, f"Some tool\nCopyright 2020 A. Person\n{header(name)}\nint main() {{}}") for i, name in enumerate(names)]
    short_bsd2 = TEXTS["bsd-2-clause"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "AUTHOR")
    docs.append((100, short_bsd2))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.kind == "text"}
    assert got == {(i, name) for i, name in enumerate(names)} | {(100, "bsd-2-clause")}


def test_notices_are_sentences_of_their_own(spark):
    rows = [
        ("Released under the MIT License.", {"mit"}), ("A tool. Released under the MIT license!\nMore.", {"mit"}), ("This is not released under the MIT License.", set()),
        ("Never released under the MIT License, says the author.", set()), ("x\nLicensed under CC BY-NC 4.0.\ny", {"cc-by-nc-4.0"}), ("Licensed under CC BY 4.0.", {"cc-by-4.0"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa-4.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3.0"}), ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}), ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("Licensed under the Mozilla Public License, version 2.0.", {"mpl-2.0"}),
        ("A license is a permission.", set()),
    ]
    found = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    for i, (_, want) in enumerate(rows):
        assert {r.license for r in found if r.doc_id == i} == want


def test_every_template_tells_itself_from_every_other():
    sets = {k: set(_shingles(v)) for k, v in TEXTS.items()}
    for name, own in sets.items():
        assert len(own) > 5 and all(own - theirs for k, theirs in sets.items() if k != name)
    assert all(license_scan.SPEAKS in v.lower() for _, v in license_scan.notice_templates())


def test_telling_words_leave_out_no_match():
    """A text without any of them has lost over a fifth of every template's shingles."""
    told = license_scan.telling_words(list(TEXTS.items()), 0.8)
    assert 0 < len(told) < 60
    for body in TEXTS.values():
        sets = set(_shingles(body))
        assert sum(not set(told) & set(x.split()) for x in sets) < 0.8 * len(sets)
    assert license_scan.telling_words([("x", "é à ü ö ñ è")], 0.8) == []


def test_sql_of_siblings(spark):
    """The SQL over all templates, each in a file of its own, gives the operator's rows."""
    import duckdb

    rows = [(i, f"head words\n{v}\ntail words here") for i, v in enumerate([*TEXTS.values(), *(v for _, v in license_scan.notice_templates())])]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = connection.sql(ORACLES["op5_license_bands"]).df()
    plain = lambda frame: sorted(map(tuple, frame[sorted(frame.columns)].astype(str).values.tolist()))
    assert plain(got) == plain(want) and len(got) >= len(rows)


def test_lines_beyond_the_broadcast(spark, odd, none, monkeypatch):
    """Lines that a large share of all rows has go to where the rows are: the same rows."""
    from folio.llm import spread

    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"Shared LINE of the host \n{own(i)}\n\nother line {i % 3}", "a") for i in range(60)] + [(100, None, None), (100, None, None), (101, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(odd.select("doc_id", "text", "source"))
    want = sorted(map(str, quality_rules.quality_rules(docs).collect()))
    monkeypatch.setattr(spread, "LEAST_HOT", 3)
    assert sorted(map(str, quality_rules.quality_rules(docs).collect())) == want
    assert quality_rules.quality_rules(none).count() == 0


def test_long_lines_of_very_many_documents(spark):
    """On a large host a share says little: a long line goes from a number of documents on."""
    rows = [(i, f"{'This very line stands in many of the documents here' if i < 30 else 'x'}\nown{i} words of document {i}", "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed_lines for r in quality_rules.quality_rules(docs, always_docs=25).collect()}
    assert got[0] == 1 and quality_rules.quality_rules(docs).where("doc_id = 0").first().n_removed_lines == 0


# headers written without looking at the lists
HEADERS = [
    ("This project is released under the MIT License.", {"mit"}), ("This file is licensed under the MIT License.", {"mit"}), ("Licensed under the MIT license (see LICENSE).", {"mit"}),
    ("Released under CC BY 4.0.", {"cc-by-4.0"}), ("Licensed under GPL-3.0", {"gpl-3.0"}), ("// SPDX-License-Identifier: MIT", {"mit"}), ("# SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0"}),
    ("The code is distributed under the terms of the Apache License, Version 2.0; the docs are not.", {"apache-2.0"}), ("Our data set is available under CC-BY-SA 4.0, see below", {"cc-by-sa-4.0"}),
    ("It is published under the 3-clause BSD license", {"bsd-3-clause"}), ("Content is shared under the GNU Lesser General Public License v2.1.", {"lgpl-2.1"}), ("Software provided under MPL 2.0", {"mpl-2.0"}),
    ("All of it is licensed under the ISC License", {"isc"}), ("Not released under the MIT License", set()), ("This isn't licensed under the MIT License.", set()), ("Is it released under GPL-3.0?", set()),
    ("The driver, unlike others, is licensed under the MIT License.", set()), ("He studied at MIT and was released under supervision", set()), ("Released under the Apache License, Version 2.1", set()), ("licensed under GPL-3.01", set()),
]


def test_licenses_inside_sentences(spark):
    from folio.llm.license_scan import scan_licenses

    docs = spark.createDataFrame([(i, "First line.\n" + t + "\nLast line.") for i, (t, _) in enumerate(HEADERS)], "doc_id long, text string")
    found = {}
    for r in scan_licenses(docs).where("kind = 'name'").collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert {i: found.get(i, set()) for i in range(len(HEADERS))} == {i: want for i, (_, want) in enumerate(HEADERS)}

"""Conversations and licences against SQL, plain versions, and awkward rows."""

import re
import textwrap
from pathlib import Path

import duckdb
import pytest
from helpers_llm import SF, awkward, documents
from pyspark.sql import functions as F

from peergauge.llm import chat, licences, queries

TURNS = "conv_id long, turn long, role string, text string"


def sql_rows(query, **tables):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        if name in tables:
            con.register(name, tables[name].toArrow())
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    answer = con.execute(query)
    names = [c[0] for c in answer.description]
    return sorted((dict(zip(names, r, strict=True)) for r in answer.fetchall()), key=repr_sorted)


def repr_sorted(row):
    return repr(sorted(row.items()))


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=repr_sorted)


@pytest.mark.parametrize("name", ["op2_licences", "op3_chat"])
def test_query_equals_its_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF)) == sql_rows(queries.ORACLE[name])


def talk(conv_id, *texts, start=0):
    roles = ("user", "assistant")
    return [(conv_id, start + i, roles[i % 2], t) for i, t in enumerate(texts)]


def maximal(spark, turns):
    df = spark.createDataFrame(turns, TURNS).withColumn("n", F.lit("clash"))
    return {r.conv_id: (r.n_turns, r.n_copies) for r in chat.format_conversations(df).collect()}


def test_only_maximal_conversations_stay(spark):
    turns = talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "x")
    assert maximal(spark, turns) == {3: (3, 1), 4: (2, 1)}


def test_equal_conversations_are_one(spark):
    turns = talk(5, "a", "b") + talk(2, "a", "b") + talk(9, "a") + talk(7, "b")
    assert maximal(spark, turns) == {2: (2, 2), 7: (1, 1)}


def test_null_and_empty_differ_and_repeats_count_once(spark):
    turns = [(1, 0, "user", None), (2, 0, "user", ""), (2, 0, "user", ""), (3, 0, None, "")]
    turns += [(None, 0, "user", "lost"), (4, None, None, None), (4, 1, "user", "x")]
    assert maximal(spark, turns) == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (2, 1)}


def test_ties_in_turn_are_ordered(spark):
    turns = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "a")]
    got = chat.format_conversations(spark.createDataFrame(turns, TURNS)).first()
    order = [("assistant", "a"), ("user", "a"), ("user", "b")]
    assert got.text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in order)


def test_long_conversations_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 3)
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    texts = [f"t{i}" for i in range(19)]
    turns = talk(1, *texts) + talk(2, *texts[:13]) + talk(3, *texts[:12], "other") + talk(4, *texts)
    df = chat.format_conversations(spark.createDataFrame(turns, TURNS).repartition(5))
    got = sorted(df.collect(), key=lambda r: (r.conv_id, r.part))
    assert [(r.conv_id, r.part) for r in got if r.conv_id == 1] == [(1, p) for p in range(5)]
    assert {r.conv_id: (r.n_turns, r.n_copies) for r in got} == {1: (19, 2), 3: (13, 1)}
    whole = "".join(r.text for r in got if r.conv_id == 1)
    assert whole.count("<|im_start|>") == 19 and whole.index("t4") < whole.index("t18")


def test_parts_are_bounded_where_numbers_repeat(spark):
    """600 rows of one turn number and 300 without any: parts of 256, in order."""
    turns = [(1, 7, "user", f"t{i:04}") for i in range(600)]
    turns += [(1, None, "user", f"n{i:04}") for i in range(300)] + talk(2, "a", "b", start=10**12)
    df = spark.createDataFrame(turns, TURNS).repartition(4)
    got = {(r.conv_id, r.part): r.text for r in chat.format_conversations(df).collect()}
    parts = [got[1, p].count("<|im_start|>") for p in range(4)]
    assert parts == [256, 256, 256, 900 - 768] and set(got) == {*((1, p) for p in range(4)), (2, 0)}
    assert got[1, 1].index("n0299") < got[1, 1].index("t0000")
    assert rows(chat.format_conversations(df)) == sql_rows(chat.ORACLE_SQL, conversations=df)


def test_awkward_conversations_equal_their_sql(spark):
    turns = talk(1, "a", "b") + talk(2, "a", None) + talk(3, "", "b", start=-3) + talk(4, "a")
    turns += [(5, 10**6, "user", "far"), (6, 0, None, "x" * 50_000), (None, None, None, None)]
    df = spark.createDataFrame(turns + turns[:3], TURNS)
    assert rows(chat.format_conversations(df)) == sql_rows(chat.ORACLE_SQL, conversations=df)


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []


def scanned(spark, texts):
    docs = documents(spark, texts)
    found = licences.scan_licences(docs, licences.known_licences(spark)).collect()
    return {r.doc_id: (r.whole_licence, r.n_matches, r.licences) for r in found}


MIT = dict(licences.TEXTS[:1])["MIT"]


def test_whole_texts_in_any_dress(spark):
    dressed = "Copyright (c) 2020, Somebody\n\n" + MIT.upper().replace(",", " ;").replace("\n", "\n\n")
    british = MIT.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    texts = [MIT, dressed, british, "My tool.\n\n" + MIT, MIT.replace("free of charge", "for money")]
    got = scanned(spark, texts)
    assert [got[i][0] for i in range(5)] == ["MIT", "MIT", "MIT", None, None]


def test_notices_in_lines_and_paragraphs(spark):
    got = scanned(
        spark,
        [
            "Some words.\nReleased under the MIT License.\nMore words.",
            "Licensed under the APACHE licence, version 2.0",
            "Licensed under CC BY-NC 4.0.\n\nThis work is licensed under the GNU General Public "
            "License, version 3.",
            "We licensed under pressure.",
            "SPDX-License-Identifier: BSD-3-Clause",
            "GPLv3\nreleased under the GPL v3",
        ],
    )
    assert got == {
        0: (None, 1, "MIT"),
        1: ("Apache-2.0", 1, "Apache-2.0"),
        2: (None, 2, "CC-BY-NC-4.0,GPL-3.0"),
        3: (None, 0, ""),
        4: ("BSD-3-Clause", 1, "BSD-3-Clause"),
        5: (None, 1, "GPL-3.0"),
    }


def test_every_known_text_finds_itself(spark):
    known = licences.known_texts()
    got = scanned(spark, [t for _, t in known])
    assert all(got[i][0] is not None for i in range(len(known)))
    assert all(re.search(licences.MARKERS, t) for _, t in known)


def test_awkward_documents_equal_their_sql(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    got = licences.scan_licences(docs, licences.known_licences(spark))
    assert rows(got) == sql_rows(licences.oracle_sql(), documents=docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    # Known digests are few and their size is known: no document is shuffled to meet them.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_documents(spark):
    known = licences.known_licences(spark)
    assert licences.scan_licences(documents(spark, []), known).collect() == []


COMMON = Path("/usr/share/common-licenses")
COMMON_NAMES = {
    "Apache-2.0": "Apache-2.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-3": "LGPL-3.0",
    "MPL-2.0": "MPL-2.0",
    "CC0-1.0": "CC0-1.0",
    "BSD": "BSD-3-Clause",
}


def wrapped(text, width):
    """Wrapped anew, but for paragraphs with a copyright line."""
    keep = re.compile(r"copyright (\(c\)|\[)", re.I)
    return "\n\n".join(
        p if keep.search(p) else textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False)
        for p in re.split(r"\n\s*\n", text)
    )


@pytest.mark.skipif(not COMMON.is_dir(), reason="needs the texts that Debian installs")
def test_whole_files_of_long_licences(spark):
    cases = []
    for name, identifier in COMMON_NAMES.items():
        text = (COMMON / name).read_text()
        forms = [text, text.replace("https:", "http:"), text.split("END OF TERMS")[0]]
        cases += [(identifier, f) for f in (*forms, *(wrapped(text, w) for w in (33, 50, 66, 79, 10**6)))]
    got = scanned(spark, [t for _, t in cases])
    assert [got[i][0] for i in range(len(cases))] == [i for i, _ in cases]


def test_texts_in_files_are_each_one_licence(spark):
    folder = Path(licences.__file__).parent / "licence_texts"
    assert sorted(p.stem for p in folder.iterdir()) == sorted(licences.TEXT_FILES)
    got = scanned(spark, [(folder / f"{i}.txt").read_text() for i in licences.TEXT_FILES])
    assert [got[i][0] for i in range(len(got))] == list(licences.TEXT_FILES)


def test_headers_of_files(spark):
    apache = (
        "# Copyright 2019 The Authors\n#\n# Licensed under the Apache License, Version 2.0 (the "
        '"License");\n# you may not use this file except in compliance with the License.\n'
        "# You may obtain a copy of the License at\n#\n#     https://www.apache.org/licenses/LICENSE-2.0\n"
        "#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under "
        'the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.\n# See the License for the specific language governing permissions "
        "and\n# limitations under the License.\n\nimport os\n"
    )
    gnu = (
        "This program is free software; you can redistribute it and/or modify\nit under the terms of the "
        "GNU General Public License as published by\nthe Free Software Foundation; either version 2 of "
        "the License, or\n(at your option) any later version.\n\nint main() {}\n"
    )
    affero = gnu.replace("GNU", "GNU Affero").replace("version 2", "version 3")
    got = scanned(spark, [apache, gnu, affero])
    assert [got[i] for i in range(3)] == [
        (None, 1, "Apache-2.0"),
        (None, 1, "GPL-2.0"),
        (None, 1, "AGPL-3.0"),
    ]


SHORT = {
    "MIT": "The MIT License (MIT)",
    "ISC": "ISC License",
    "0BSD": "BSD Zero Clause License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
}


def test_files_of_short_licences_wrapped_and_titled(spark):
    cases = []
    for identifier, text in licences.TEXTS:
        for title in ("", SHORT[identifier] + "\n\n"):
            for notice in ("Copyright (c) 2020, Jane Doe\nAll rights reserved.", "Copyright Jane Doe"):
                for width in (40, 60, 72, 79, 10**6):
                    cases.append((identifier, f"{title}{notice}\n\n{wrapped(text, width)}\n"))
    got = scanned(spark, [t for _, t in cases])
    assert [got[i][0] for i in range(len(cases))] == [i for i, _ in cases]


def test_only_copyright_lines_are_deleted(spark):
    kept = [
        "copyright notice and this permission notice appear in all copies.",
        "COPYRIGHT HOLDERS BE LIABLE",
        "(c) You must retain",
        "copyright the software, and",
        "all rights reserved by the licensor",
    ]
    gone = [
        "Copyright (c) 2020, Jane Doe",
        "# © Jane Doe",
        "Copyright 1999-2004 notice",
        "Copyright The Authors",
        "Copyright [yyyy] [name of copyright owner]",
        "(c) 2020 Jane Doe",
        " * All rights reserved.",
    ]
    df = spark.createDataFrame([(t,) for t in kept + gone], "t string")
    forms = [r.f for r in df.select(licences.canonical(F.col("t")).alias("f")).collect()]
    assert all(forms[: len(kept)]) and not any(forms[len(kept) :])
    known = " ".join(t for _, t in licences.known_texts()).lower()
    words = re.findall(r"[^\W_]+", known)
    after = {b for a, b in zip(words, words[1:], strict=False) if a == "copyright"}
    assert {w for w in after if w not in " ".join(licences.CONTINUES).split()} == {"c", "yyyy"}

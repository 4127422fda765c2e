"""Licence texts found by the digest of their canonical form; DataFrame functions only.

A text, each of its paragraphs and each of its lines is taken whole, brought to a canonical form (lower
case, no copyright lines, no punctuation, one blank between words, one spelling of words that are
spelt in several ways) and looked up by digest among the known licences. Only units with a word that
every known licence has one of are brought to that form; that loses none.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergauge.llm.common import whole_text
from peergauge.session import write_shared

# Identifier and the names that notices use for a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0", "GPLv3", "GPL v3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
}
_SUBJECTS = ("This work is ", "This file is ", "This software is ", "This project is ", "")
_VERBS = ("licensed under ", "released under ", "distributed under ", "made available under ")
_TAILS = ("", "the terms of ")

# Whole texts.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    'and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    _USE
    + "without fee is hereby granted, provided that the above copyright notice and this "
    + "permission notice appear in all copies.\n\n"
    + _ISC_DISCLAIMER
)
_0BSD = _USE + "without fee is hereby granted.\n\n" + _ISC_DISCLAIMER
_UNNUMBERED = re.compile(r"(?m)^[123]\. ")
_BSD_2 = "\n\n".join((_BSD_GRANT, _BSD_DISCLAIMER))
_BSD_3 = "\n\n".join((_BSD_GRANT, _BSD_NAME, _BSD_DISCLAIMER))
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "\n\n".join((_MIT_GRANT, _WARRANTY))),
    ("ISC", _ISC),
    ("0BSD", _0BSD),
    *(("BSD-2-Clause", t) for t in (_BSD_2, _UNNUMBERED.sub("", _BSD_2))),
    *(("BSD-3-Clause", t) for t in (_BSD_3, _UNNUMBERED.sub("", _BSD_3))),
)
# Titles that short texts carry.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": (
        "BSD 2-Clause License",
        "The 2-Clause BSD License",
        "Simplified BSD License",
        "BSD 2-Clause \"Simplified\" License",
        "BSD License",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "The 3-Clause BSD License",
        "Modified BSD License",
        "New BSD License",
        "BSD 3-Clause \"New\" or \"Revised\" License",
        "BSD License",
    ),
}
# Licences whose whole texts lie in licence_texts.
TEXT_FILES = (
    *("Apache-2.0", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0"),
    *("GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"),
)
# Headers of files.
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
    "in compliance with the License. You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and "
    "limitations under the License.",
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
    "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
_GNU = {
    "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
_GNU_SUBJECTS = ("program", "library", "software", "file")
_GNU_WRITE = (
    *("see <http://www.gnu.org/licenses/>.", "see http://www.gnu.org/licenses/."),
    "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
    "02110-1301 USA.",
    "write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)
# Every known licence has one of these, in any case and however its words are set apart.
MARKERS = r"(?i)licen|permission|redistribution|(released|distributed|available)\W+under"
# Spellings that count as the same.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("v 2", "version 2"),
    ("v 3", "version 3"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)
# What continues a sentence after "copyright", or an item (c) of a list.
CONTINUES = (
    *("act", "acts", "also", "and", "are", "as", "disclaimer", "disclaimers", "doctrines", "for"),
    *("from", "has", "holder", "holders", "if", "in", "including", "infringement", "interest"),
    *("interests", "is", "more considerations", "resulting", "then"),
    *("law", "laws", "licence", "licences", "license", "licenses", "like", "line", "may", "notice"),
    *("notices", "of", "on", "or", "owner", "owners", "ownership", "patent", "patents", "permission"),
    *("protection", "protections", "right", "rights", "shall", "statement", "statements", "status"),
    *("term", "terms", "that", "the software", "this", "those", "to", "treaties", "treaty", "under"),
    *("which", "will", "with", "you", "your"),
)
# Letters beyond ASCII, as far as names are concerned.
_OTHER_LETTERS = "\u00c0-\u024f\u0370-\u1fff\u2c00-\ud7fb\uf900-\ufaff"


def _other_than(phrases: tuple[str, ...], begun: str = "") -> str:
    """Matches the beginning of a word that begins none of the phrases; without looking ahead."""
    nexts = sorted({p[len(begun)] for p in phrases if p.startswith(begun) and p != begun})
    letters = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in nexts) + _OTHER_LETTERS
    if begun and begun not in phrases:
        broken = " " in begun or any(p.startswith(begun + " ") for p in phrases)
        options = [rf"[^{''.join(nexts)}\n]", *([] if broken else ["$"])]
    else:
        options = [f"[{letters}]"]
    return f"(?:{'|'.join([*options, *(c + _other_than(phrases, begun + c) for c in nexts)])})"


# A line that names a year, (c), the sign or a name after its "copyright", or reserves all rights.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:©[^\n]*|copyright[^\p{L}\n]*(?:\p{N}{4}|©|\(c\))[^\n]*"
    r"|\(c\)[^\p{L}\n]*\p{N}{4}[^\n]*"
    rf"|(?:copyright|\(c\))[^\p{{L}}\n]+{_other_than(CONTINUES)}[^\n]*"
    r"|all rights reserved[^\p{L}\p{N}\n]*)$"
)
NOT_WORD = r"[^\p{L}\p{N}]+"


def _headers() -> list[tuple[str, str]]:
    """Headers of files, whole, and the paragraph of each that names its licence."""
    apache = [*_APACHE_HEADER]
    secure = [t.replace("http://", "https://") for t in apache]
    found = [("Apache-2.0", t) for t in (apache[0], "\n\n".join(apache), "\n\n".join(secure))]
    found += [("MPL-2.0", t) for t in (_MPL_HEADER, _MPL_HEADER.replace("http://", "https://"))]
    for identifier, (name, version) in _GNU.items():
        for subject in _GNU_SUBJECTS:
            for tail in (", or (at your option) any later version.", "."):
                for either in ("either ", ""):
                    first = (
                        f"This {subject} is free software: you can redistribute it and/or modify it "
                        f"under the terms of the {name} as published by the Free Software Foundation, "
                        f"{either}version {version} of the License{tail}"
                    )
                    second = (
                        f"This {subject} is distributed in the hope that it will be useful, but WITHOUT "
                        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
                        f"FOR A PARTICULAR PURPOSE. See the {name} for more details."
                    )
                    found += [(identifier, first), (identifier, f"{first}\n\n{second}")]
                    for end in (*_GNU_WRITE, *(w.replace("http:", "https:") for w in _GNU_WRITE[:2])):
                        third = (
                            f"You should have received a copy of the {name} along with this {subject}. "
                            f"If not, {end}"
                        )
                        found.append((identifier, f"{first}\n\n{second}\n\n{third}"))
    return found


def _files() -> list[tuple[str, str]]:
    """Whole texts in the forms that are handed on: without what follows the terms, and with links
    of either kind."""
    folder = resources.files("peergauge.llm").joinpath("licence_texts")
    found = []
    for identifier in TEXT_FILES:
        text = folder.joinpath(f"{identifier}.txt").read_text("utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        forms = [text, terms, terms + end]
        # The address is a line of its own, or goes with the copyright line.
        forms += [re.sub(r"(Foundation, Inc\.,)\n 51 ", r"\1 51 ", t) for t in forms]
        forms += [t.strip() for t in text.split("=" * 71) if "By exercising the Licensed" in t]
        for form in forms:
            found += [(identifier, form.replace("http:", "https:")), (identifier, form)]
            found.append((identifier, form.replace("https:", "http:")))
    return found


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of notices by rule, headers of files, and whole texts."""
    notices = []
    for identifier, names in NAMES.items():
        notices.append((identifier, f"SPDX-License-Identifier: {identifier}"))
        for name in names:
            for subject in _SUBJECTS:
                for verb in _VERBS:
                    for tail in _TAILS:
                        notices += [
                            (identifier, f"{subject}{verb}{tail}{article}{name}.")
                            for article in ("the ", "")
                        ]
    titled = [(i, f"{title}\n\n{t}") for i, t in TEXTS for title in TITLES[i]]
    return list(dict.fromkeys([*notices, *_headers(), *TEXTS, *titled, *_files()]))


def canonical(text: Column) -> Column:
    lowered = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    words = F.trim(F.regexp_replace(lowered, NOT_WORD, " "))
    return reduce(
        lambda t, pair: F.regexp_replace(t, rf"\b{pair[0]}\b", pair[1]), EQUIVALENT, words
    )


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, digest): as many rows as ``known_texts`` has, whatever is searched."""
    texts = spark.createDataFrame(known_texts(), "licence string, text string")
    return texts.select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def _marked(text: Column) -> Column:
    return text.rlike(MARKERS)


def _units(text: Column) -> Column:
    """Candidates among the whole text, its paragraphs and its lines; once each."""
    parts = F.array_distinct(
        F.concat(F.array(text), F.split(text, r"\n[\t ]*\n\s*"), F.split(text, "\n"))
    )
    return F.when(_marked(text), F.filter(parts, _marked))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row doc_id, whole_licence, n_matches and licences.

    ``whole_licence`` is the licence that the entire text is, or null. ``n_matches`` counts the
    distinct units (whole text, paragraphs, lines) that are a licence, and ``licences`` lists the
    licences by name, joined by commas. Of several licences with one canonical text the first by name
    counts. A null text is empty and matches nothing; rows alike are scanned each for itself; an
    empty table gives no rows. Only doc_id and text are read.
    """
    text = whole_text()
    rows = docs.select("doc_id", text.alias("text")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    units = rows.select("_row", "doc_id", "text", F.explode_outer(_units(F.col("text"))).alias("unit"))
    digest = F.when(F.col("unit").isNotNull(), F.sha2(canonical(F.col("unit")), 256))
    looked_up = units.select(
        "_row",
        "doc_id",
        F.coalesce(F.col("unit") == F.col("text"), F.lit(False)).alias("whole"),
        # Rows without a unit must not meet in one task: their own number is no digest.
        F.coalesce(digest, F.col("_row").cast("string")).alias("digest"),
    )
    # Written, so that the planner knows its size: it is broadcast while it is small, and a digest
    # that a third of the documents carry is then no key of a shuffle.
    first = write_shared(
        known.groupBy("digest").agg(F.min("licence").alias("licence")), "known-licences"
    )
    return (
        looked_up.join(first, "digest", "left")
        .groupBy("_row", "doc_id")
        .agg(
            F.min(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence"),
            F.count("licence").alias("n_matches"),
            F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        )
        .drop("_row")
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    lowered = f"regexp_replace(lower({text}), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    words = f"trim(regexp_replace({lowered}, {_sql_text(NOT_WORD)}, ' ', 'g'))"
    for spelling, kept in EQUIVALENT:
        words = rf"regexp_replace({words}, '\b{spelling}\b', '{kept}', 'g')"
    return words


def oracle_sql() -> str:
    values = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in known_texts())
    marked = f"regexp_matches({{}}, {_sql_text(MARKERS)})"
    return rf"""
WITH known AS (
  SELECT min(licence) AS licence, {_sql_canonical("text")} AS form
  FROM (VALUES {values}) AS v(licence, text) GROUP BY form
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT DISTINCT r, text, unit FROM (
    SELECT r, text, unnest(list_concat([text], list_concat(
      regexp_split_to_array(text, '\n[\t ]*\n\s*'), string_split(text, chr(10))))) AS unit
    FROM docs WHERE {marked.format("text")}) WHERE {marked.format("unit")}
), found AS (
  SELECT r, licence, unit = text AS whole
  FROM (SELECT r, text, unit, {_sql_canonical("unit")} AS form FROM units) JOIN known USING (form)
)
SELECT doc_id, min(licence) FILTER (WHERE whole) AS whole_licence,
  count(licence) AS n_matches,
  coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences
FROM docs LEFT JOIN found USING (r) GROUP BY r, doc_id
"""

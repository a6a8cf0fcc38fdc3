"""Licence scans by canonical digest look-up, with DataFrame functions only.

A text is brought into canonical form (lower case; copyright lines dropped; punctuation and
white space to single spaces; equivalent spellings to one), and its digest is joined with the
digests of known licence texts. Whole texts are looked up, and each line as a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matching

COPYRIGHT_LINE = r"(?md)^[ \t*#/;%-]*(copyright|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Words that count as equal, each side one or more whole words.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "authorised": "authorized",
    "organisation": "organization",
    "whilst": "while",
    "fulfil": "fulfill",
    "favour": "favor",
    "merchantibility": "merchantability",
    "per cent": "percent",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "http": "https",
}

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_KEEP = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Fixed values: (licence, text) of whole licences. More come from a folder by read_licenses.
KNOWN = [
    ("MIT", f"MIT License\n\n{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS_MIT}"),
    ("MIT", f"{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS_MIT}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n\n{_BSD_TAIL}"),
    ("ISC", f"{_ISC_GRANT}{_ISC_KEEP}\n\n{_ISC_TAIL}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_TAIL}"),
]
#: Fixed values: (what it grants, line) of one-line notices, which are no licences themselves.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]


def canonical(text: Column) -> Column:
    """The canonical form; a null text stays null. Words stand between two spaces each while
    spellings are replaced, so that only whole words are."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, "  ")), F.lit(" "))
    for spelling, chosen in SPELLINGS.items():
        out = F.replace(out, F.lit(_spaced(spelling)), F.lit(_spaced(chosen)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digests(table: DataFrame) -> DataFrame:
    """license_id and digest of known texts (license_id, text). Forms that agree count once; if two
    licences share a form, the alphabetically first is named."""
    return table.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Digests of whole licences."""
    return digests(spark.createDataFrame(known or KNOWN, "license_id string, text string"))


def known_notices(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Digests of one-line notices."""
    return digests(spark.createDataFrame(known or NOTICES, "license_id string, text string"))


def read_licenses(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Digests of the licence texts in a folder (or of the files named), one whole licence a file, named by the file (without
    .txt)."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("license_id"), F.col("value").alias("text"))
    return digests(files)


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan_licenses(docs: DataFrame, known: DataFrame, notices: DataFrame) -> DataFrame:
    """Look docs (doc_id, text) up among known whole licences and one-line notices (both:
    license_id, digest).

    One row per input row: doc_id, digest (of the canonical whole text; null for a null text),
    license_id (of the licence that the whole text is; null if unknown), notices (the sorted
    distinct ids of the notices that are a line of the document, joined by commas; null if none).
    Empty texts have the digest of the empty string. Rows that repeat a doc_id are each returned,
    with the notices of all of them; a null doc_id has none. Further columns are ignored; an
    empty table gives an empty result.
    """
    base = docs.select("doc_id", "text")
    whole = matching(base.select("doc_id", _digest(F.col("text")).alias("digest")), known.select("digest", "license_id").distinct(), "digest", "left")
    lines = base.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    found = matching(lines.select("doc_id", _digest(F.col("line")).alias("digest")), notices.select("digest", "license_id").distinct(), "digest")
    hits = found.groupBy("doc_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("license_id"))).alias("notices"))
    return whole.join(hits, "doc_id", "left").select("doc_id", "digest", "license_id", "notices")


def oracle_sql() -> str:
    """The same look-up in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canon(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE.replace('(?md)', '(?m)'))}, '', 'g')"
        out = f"(' ' || trim(regexp_replace({out}, {quoted(NOT_WORD)}, '  ', 'g')) || ' ')"
        for spelling, chosen in SPELLINGS.items():
            out = f"replace({out}, {quoted(_spaced(spelling))}, {quoted(_spaced(chosen))})"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    def table(name: str, rows: list[tuple[str, str]]) -> str:
        values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)
        return f"{name} AS (SELECT {canon('text')} AS digest, min(license_id) AS license_id FROM (VALUES {values}) t(license_id, text) GROUP BY 1)"

    return f"""
WITH {table('known', KNOWN)}, {table('notice', NOTICES)},
whole AS (SELECT doc_id, {canon('text')} AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
         FROM (SELECT doc_id, {canon('line')} AS digest FROM lines WHERE length(trim(line)) > 0) l JOIN notice USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, h.notices FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN hits h ON w.doc_id = h.doc_id"""

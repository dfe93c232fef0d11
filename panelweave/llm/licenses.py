"""Licence scan: canonical digests of whole texts and of their licence lines, hash-joined with known digests.

A text is brought to one form: A-Z lower-cased, typographic quotes, dashes and no-break spaces made plain, true copyright and
"all rights reserved" lines left out, everything else but letters and digits (and non-ASCII characters) one space, and
equivalent spellings made one (licence/license, -ise/-ize, -our/-or, and so on). Two texts have one SHA-256 digest when
they agree up to that. The rules are applied to known and to scanned texts alike, so a rule may be broad (every word on
"-ise" turns to "-ize") without harm. Known digests are a table; it is joined by hash, and broadcast only where Spark knows
it to be small. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import only

# Public licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# Digests (SHA-256 of the canonical form below) of whole public licence texts; where a name is there twice, one is the
# text with its appendix and one ends with "END OF TERMS AND CONDITIONS".
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "be01cebdf1c10aceed7cdd7b7691bad2741dfd4efad1a1b87465dc566ea479e7"),
    ("Apache-2.0", "83b4d1c124a926b0c125a3c447450395c25fca5bf12d19f29fa4fc71e280bd2d"),
    ("Artistic-1.0-Perl", "5f9e70ab939ac8241e1c25e7934d1fe55b18a590c20c4d20047ed59eee6088c3"),
    ("BSD-3-Clause", "e8daa50c96df2ade9d116da144a66a3e46944a78c9ae7c49064074817a5d8988"),
    ("CC0-1.0", "b096badc0168abbd7a6496f3097d3b3e33b5d3d54dbc0990a1eb8341c549c075"),
    ("GFDL-1.2", "27145d4afbeb463d2d21dcd54f69d596b7696f5a7e204535a0a2dad132ae9f03"),
    ("GFDL-1.3", "4341e77d3b05399123171257586c412e1eb747d8ba5a17c5595bdfc799851ec5"),
    ("GPL-1.0", "6ce0671a7f71b29d83566a96cfc6c3c1fbaf659c9e10492d2c402b221694d193"),
    ("GPL-1.0", "baccf64612a8a19a03c972733111f3654fec8f591e5a98733352a79c033e1fec"),
    ("GPL-2.0", "c2dbda1211368045e82409f6e185324425b2f9ef76c57ab0b5ee01e47f5c41e1"),
    ("GPL-2.0", "df1245e585026c1b8112ecc5c64e3d7b3e1db8af44c80eaa29e2d600504e787f"),
    ("GPL-3.0", "09cca19da041e748ed0c575232af2b2a378608a91e11a131772975ffd2d54fc3"),
    ("GPL-3.0", "ee26bec3bc5c5fb8d687e6393cf1be396ec33c7a472f549777019f57ecb6d5b0"),
    ("LGPL-2.0", "3182f6e3325d82debff90991a09779f55284870c721b9f1194de9b85ba34db24"),
    ("LGPL-2.0", "ec477454ba5b69cf0dffe55ac873edef77c3cdf7c34af1c5220398370d397c1b"),
    ("LGPL-2.1", "2ffa34316e3f21c27f001e70768e233c50477b875888b64a20f93eff2b14e60b"),
    ("LGPL-2.1", "b616ab1a361d7dfbd7a1c7b912cb1a48ee5d8cacb106726c6242de6c92605a00"),
    ("LGPL-3.0", "8e3b59e0c5c93d34fda7b8dba2cffff98d7a1ca97ef3c09ee49ab0e1c92338ac"),
    ("MPL-1.1", "6e30e0349ef37bb195f0d14d419d344ac51e89854307b621aa4c51e23dc37611"),
    ("MPL-2.0", "cf065efaf4e3f8b46a1127e8fdc71903f2ce4a6198fa39bfffd9577017737d7b"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ODD, PLAIN = "‘’“”–— ", "''\"\"-- "
#: True copyright lines: the word with a (c), a sign, a year (or its blank) or "by" behind it; a sign or dated "(c)" in front; "all rights
#: reserved" on its own. Words of a clause that is wrapped before "copyright notice" or "copyright holders" stay.
NOTICES = (r"\n[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*?(?:\(c\)|©|[0-9]{4}|[\[<{(](?:year|yyyy)|by\b)[^\n]*|©[^\n]*|\(c\)[^a-z0-9\n]*(?:copyright\b|[0-9]{4})[^\n]*|all rights reserved[^a-z0-9\n]*(?=\n|\z))", "\n")
#: A "(c)" before a mere name is a copyright line too, unless it letters a list, so a "(b)" is before it, or speaks of a licence.
HOLDERS = (r"\n[^a-z0-9\n]*\(c\)(?![^\n]*licen)[^\n]*", "\n")
LIST = (r"(?s)\(b\).*", "")
#: The same two rules for a single line, as patterns of RE2, which has no look-ahead.
NOTICE_LINE = r"^[^a-z0-9]*(copyright[^a-z0-9]*(\(c\)|©|[0-9]{4}|[\[<{(](year|yyyy)|by\b)|©|\(c\)[^a-z0-9]*(copyright\b|[0-9]{4})|all rights reserved[^a-z0-9]*$)"
HOLDER_LINE = r"^[^a-z0-9]*\(c\)"
#: Patterns that Java and RE2 read alike, with replacements; the text has a line break in front and a space behind.
MARKS = (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
SPELLINGS = [("licenc", "licens"), (" sub licens", " sublicens"), (" non commercial", " noncommercial"), (" non infring", " noninfring"), ("https", "http"), (" per cent ", " percent "), (" copyright owner", " copyright holder")]
ENDINGS = [(r"is(e|es|ed|ing|ation|ations) ", "iz"), (r"ll(ed|ing) ", "l"), (r"our(s?) ", "or")]


def canonical(text: Column) -> Column:
    """The form that digests are taken of; null for null."""
    x = F.concat(F.lit("\n"), F.translate(F.translate(text, UPPER, LOWER), ODD, PLAIN))
    x = F.regexp_replace(x, *NOTICES)
    head = F.regexp_replace(x, *LIST)
    # The rest of a text without a list is empty.
    x = F.concat(F.regexp_replace(head, *HOLDERS), F.substring(x, F.length(head) + 1, F.lit(2**31 - 1)), F.lit(" "))
    x = F.regexp_replace(x, *MARKS)
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    for pattern, new in ENDINGS:
        x = F.regexp_replace(x, pattern, new + "$1 ")
    return F.trim(x)


def canonical_sql(x: str) -> str:
    """``canonical`` as DuckDB SQL over the expression ``x``."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    blanked = lambda x, line, test: f"array_to_string(list_transform(string_split({x}, chr(10)), lambda {line}: CASE WHEN {test} THEN '' ELSE {line} END), chr(10))"
    plain = f"(chr(10) || translate(translate({x}, '{UPPER}', '{LOWER}'), {text(ODD)}, {text(PLAIN)}))"
    told = blanked(plain, "l", f"regexp_matches(l, {text(NOTICE_LINE)})")
    # A list of one element names the text, so that it is written once.
    head = "CASE WHEN contains(y, '(b)') THEN substr(y, 1, strpos(y, '(b)') - 1) ELSE y END"
    rest = "CASE WHEN contains(y, '(b)') THEN substr(y, strpos(y, '(b)')) ELSE '' END"
    holder = f"regexp_matches(h, {text(HOLDER_LINE)}) AND NOT regexp_matches(h, {text(HOLDER_LINE + '.*licen')})"
    x = f"list_transform([{told}], lambda y: {blanked(head, 'h', holder)} || {rest} || ' ')[1]"
    x = f"regexp_replace({x}, {text(MARKS[0])}, ' ', 'g')"
    for old, new in SPELLINGS:
        x = f"replace({x}, {text(old)}, {text(new)})"
    for pattern, new in ENDINGS:
        x = f"regexp_replace({x}, {text(pattern)}, {text(new)} || '\\1 ', 'g')"
    return f"trim({x}, ' ')"


def known_digests(spark: SparkSession, known: Iterable[tuple[str, str]] = KNOWN, digests: Iterable[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, license) of texts and of digests taken before: of equal digests the smallest name counts; blank texts are no licences."""
    rows = spark.createDataFrame(list(known), "license string, text string").select("license", canonical(F.col("text")).alias("c"))
    rows = rows.filter("c <> ''").select("license", F.sha2("c", 256).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, license, notices) of every row of ``docs``.

    ``license`` is the known licence that the whole text is, else null. ``notices`` lists the known licences (sorted,
    distinct, comma-joined) that single lines holding "licen" are, null if none: a notice is mostly a line of its own.
    A null text has no digest. A text without letters or digits has the digest of nothing and is no licence. Repeated rows
    each get a row. ``known`` has (digest, license), a digest once.
    """
    rows = only(docs, doc_id=id_column, text=text_column).withColumn("row_", F.monotonically_increasing_id())
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, UPPER, LOWER).contains("licen"))
    has_line = F.translate("text", UPPER, LOWER).contains("licen")
    own = F.when(has_line, F.transform(lines, lambda x: F.sha2(canonical(x), 256)))
    asked = rows.select("row_", "doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), own.alias("lines"))
    asked = asked.select("row_", "doc_id", "digest", F.explode_outer("lines").alias("line"))
    by_line = known.select(F.col("digest").alias("line"), F.col("license").alias("notice"))
    found = asked.join(known, "digest", "left").join(by_line, "line", "left")
    names = F.array_join(F.array_sort(F.collect_set("notice")), ",")
    done = found.groupBy("row_").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("license").alias("license"), names.alias("notices"))
    return done.select("doc_id", "digest", "license", F.when(F.col("notices") != "", F.col("notices")).alias("notices"))


def scan_sql(known: Iterable[tuple[str, str]] = KNOWN, digests: Iterable[tuple[str, str]] = DIGESTS) -> str:
    """The same as DuckDB SQL over ``documents``."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known)
    listed = ", ".join(f"('{name}', '{digest}')" for name, digest in digests)
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license
  FROM (SELECT license, sha256(c) AS digest FROM (SELECT license, {canonical_sql("t")} AS c FROM (VALUES {values}) AS v(license, t)) WHERE c <> ''
        UNION ALL SELECT * FROM (VALUES {listed}) AS d(license, digest)) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs WHERE contains(translate(text, '{UPPER}', '{LOWER}'), 'licen')),
notices AS (
  SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN known ON digest = sha256({canonical_sql("line")})
  WHERE contains(translate(line, '{UPPER}', '{LOWER}'), 'licen') GROUP BY k),
whole AS (SELECT k, doc_id, sha256({canonical_sql("text")}) AS digest FROM docs)
SELECT doc_id, whole.digest, license, notices
FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN notices USING (k)
"""

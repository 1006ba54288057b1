"""License scans: canonical digests of entire texts, hash-joined to those of known licences."""

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version {} of the
License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software."""

# Known licence texts and notices. Callers may pass a table of their own.
KNOWN = [
    ("MIT", _MIT), ("ISC", _ISC), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("Zlib", _ZLIB),
    ("GPL-2.0-or-later", _GPL.format(2)), ("GPL-3.0-or-later", _GPL.format(3)),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]
# The notices of the GNU family; whose ``{}`` is the licence's name.
_GNU = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU
{2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your
option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details.
"""
# Entire texts as their publishers give them; a file's name is the licence's.
TEXTS = Path(__file__).with_name("license_texts")


def standard_texts() -> list[tuple[str, str]]:
    """(license, text) of the entire standard texts in their paragraphs, and of usual notices of several
    paragraphs. An entire text counts with and without what follows its terms, its list numbers or its
    opening name."""
    out = [(f.stem, f.read_text("utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    for name, text in list(out):
        out.append((name, re.sub(r"(?m)^[ ]*[0-9][.)][ ]+", "", text)))
        terms = re.split(r"END OF TERMS AND CONDITIONS", text)
        if len(terms) == 2:
            out += [(name, terms[0]), (name, terms[0] + "END OF TERMS AND CONDITIONS")]
        if name in ("MIT", "Zlib", "ISC"):
            out.append((name, text[re.search("Permission|This software is", text).start():]))
    head, address, rest = re.split(r"(http://www.apache.org/licenses/LICENSE-2.0) ?", _APACHE)
    out.append(("Apache-2.0", f"{head}\n\n{address}\n\n{rest}"))
    for name, work, of, version in (
        ("GPL-2.0-or-later", "program", "General Public License", "2"),
        ("GPL-3.0-or-later", "program", "General Public License", "3"),
        ("LGPL-2.1-or-later", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0-or-later", "program", "Lesser General Public License", "3"),
        ("AGPL-3.0-or-later", "program", "Affero General Public License", "3"),
    ):
        out.append((name, _GNU.format(work, ":", of, ",", version)))
    return out


# Spellings that count as the same, (pattern, replacement) over lower-case words.
SAME = [
    (r"\blicence", "license"), (r"\bsub\s+licen[cs]e", "sublicense"), (r"\bnon\s+infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"), (r"\bcopyright\s+(?:owner|holder)s?\b", "copyright holder"),
    (r"\bper\s+cent\b", "percent"), (r"\bhttps\b", "http"),
    # A name stands for the copyright holder there.
    (r"\bneither the\s+names?\s+of\s[\p{L}\p{N}\s]{1,120}?\snor\s+the\s+names\s+of\s+(?:its|the|their)\s+contributors\b",
     "neither the name of the copyright holder nor the names of its contributors"),
]
# Lines that are a notice: "copyright" with a sign, a year or its stand-in, or a name (words such as
# "holder" are body text), a sign with a year, or "all rights reserved".
NOTICE = (
    r"(?m)^[^\p{L}\p{N}\n(\u00a9]*(?:"
    r"(?i:copyright)\x20*(?:\([cC]\)|\u00a9|:|[0-9]{4}|[<\[{](?i:y))"
    r"|Copyright\x20+(?:by\x20+)?(?!Holder|Owner|Licen[cs]e|Notice|Law|Act|Statement|Interest|Right|Treat)\p{Lu}\p{L}"
    r"|(?:\([cC]\)|\u00a9)\x20*[0-9]{4}"
    r"|(?i:all\x20rights\x20reserved)[^\p{L}\p{N}\n]*$"
    r")[^\n]*$"
)
# Lines of a canonical text that are no more than a licence's title.
TITLE = (
    r"(?m)^\x20?(?:the\x20)?(?:mit|mit\x20x11|expat|isc|zlib|(?:(?:new|simplified|modified|revised)\x20)?bsd(?:\x20[23]\x20clause)?)"
    r"\x20license(?:\x20(?:mit|isc|expat|zlib|bsd(?:\x20[23]\x20clause)?))?\x20?$"
)


def canonical(text: Column) -> Column:
    """The text in lower case without copyright lines and titles; whatever is neither letter nor
    digit becomes one space, line breaks stay; equivalent spellings become one. Null counts as
    empty."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), NOTICE, ""))
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for pattern, word in SAME:
        # Most texts hold none of them; a plain search is cheaper than building the text anew.
        text = F.regexp_replace(text, pattern, word)
    return F.regexp_replace(text, TITLE, "")


def digest(text: Column) -> Column:
    """Digest of a canonical text as one run of words; null if it has none."""
    words = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(words != "", F.md5(words))


def paragraph_digests(canonical: Column) -> Column:
    """Array of (digest, several, same): each paragraph that has words, whether it has several
    lines, and whether it is the text as a whole."""
    return F.filter(
        F.transform(F.split(canonical, r"\n(?:[ ]*\n)+"), lambda p: F.struct(
            digest(p).alias("digest"), p.contains("\n").alias("several"), (p == canonical).alias("same")
        )),
        lambda p: p["digest"].isNotNull(),
    )


def known_licenses(spark: SparkSession, known=None) -> DataFrame:
    """(digest, license), one row per digest, from (license, text) pairs."""
    return (
        spark.createDataFrame(known or KNOWN + standard_texts(), "license string, text string")
        .select(digest(canonical(F.col("text"))).alias("digest"), "license")
        .where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))
    )


def known_runs(spark: SparkSession, known=None) -> DataFrame:
    """(part, run, at, size, license): the paragraphs of each known text of several, in order, from
    (license, text) pairs. Texts of the same paragraphs count once."""
    parts = (
        spark.createDataFrame(known or standard_texts(), "license string, text string")
        .select("license", F.transform(paragraph_digests(canonical(F.col("text"))), lambda p: p["digest"]).alias("parts"))
        .where(F.size("parts") > 1).groupBy("parts").agg(F.min("license").alias("license"))
    )
    return parts.select(
        F.md5(F.array_join("parts", "")).alias("run"), F.size("parts").alias("size"), "license",
        F.posexplode("parts").alias("at", "part"),
    ).select("part", "run", "at", "size", "license")


def license_scan(
    docs: DataFrame, keys: list[str] | None = None, known: DataFrame | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs`` (``keys``, text): ``whole``, the licence whose text the document is as a
    whole (null if none), ``licenses``, the sorted licences whose texts are the document, one of
    its lines or paragraphs, or a run of its paragraphs, and ``n_units``, how many of those units are
    licence texts.

    A unit matches only if it is a known text in full; canonical forms decide, so case, spacing, wraps,
    punctuation, copyright lines, titles and equivalent spellings do not matter. A unit that is line
    and paragraph at once, or run and document, counts once. Null and empty texts match nothing;
    equal rows match alike; an empty table stays empty. ``known`` has (digest, license), unique by
    digest, ``runs`` the rows of ``known_runs``; with a ``known`` of the caller's there are none
    unless given. Spark chooses the joins by their sizes.
    """
    keys = keys or ["doc_id"]
    spark = docs.sparkSession
    if runs is None:
        runs = known_runs(spark) if known is None else known_runs(spark).where("false")
    known = known_licenses(spark) if known is None else known
    text, paragraphs = F.col("_canonical"), F.col("_paragraphs")

    def unit(all_=F.lit(False), digest_=F.lit(None), part=F.lit(None), at=F.lit(None)):
        return F.struct(
            all_.alias("all"), digest_.cast("string").alias("digest"), part.cast("string").alias("part"),
            at.cast("int").alias("at"),
        )

    none = F.array().cast("array<struct<all:boolean,digest:string,part:string,at:int>>")
    units = F.concat(
        F.when(text.contains("\n"), F.array(unit(F.lit(True), digest(text)))).otherwise(none),
        F.transform(
            F.filter(paragraphs, lambda p: p["several"] & ~p["same"]), lambda p: unit(digest_=p["digest"])
        ),
        F.transform(F.split(text, r"\n"), lambda u: unit(u == text, digest(u))),
        F.when(
            F.size(paragraphs) > 1,
            F.transform(paragraphs, lambda p, i: unit(part=p["digest"], at=i)),
        ).otherwise(none),
    )
    exploded = docs.select(
        F.monotonically_increasing_id().alias("_id"), F.struct(*keys).alias("_keys"),
        canonical(F.col("text")).alias("_canonical"),
    ).select("_id", "_keys", "_canonical", paragraph_digests(text).alias("_paragraphs")).select(
        "_id", "_keys", F.size(paragraphs).alias("_n"), F.explode(units).alias("_u")
    )
    named = known.select(F.col("digest").alias("_digest"), F.col("license").alias("_license"))
    parts = runs.select(
        F.col("part").alias("_part"), "run", "size", F.col("at").alias("_at"), F.col("license").alias("_of")
    )
    return (
        exploded.join(named, F.col("_u.digest") == F.col("_digest"), "left")
        .join(parts, F.col("_u.part") == F.col("_part"), "left")
        # A run has been found where all its paragraphs start from the same place.
        .groupBy("_id", "run", (F.col("_u.at") - F.col("_at")).alias("_start")).agg(
            F.first("_keys").alias("_keys"), F.first("_n").alias("_n"),
            F.max(F.when(F.col("_u.all"), F.col("_license"))).alias("whole"),
            F.collect_set("_license").alias("licenses"), F.count("_license").alias("n_units"),
            F.max(F.when(F.col("run").isNotNull(), F.col("_of"))).alias("_of"),
            F.first("size").alias("_size"), F.count("run").alias("_found"),
        )
        .withColumn("_of", F.when(F.col("_found") == F.col("_size"), F.col("_of")))
        .groupBy("_id").agg(
            F.first("_keys").alias("_keys"), F.max("whole").alias("whole"),
            F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("licenses")), F.collect_list("_of"))))
            .alias("licenses"),
            (F.sum("n_units") + F.count(F.when(F.col("_size") < F.col("_n"), F.col("_of")))).alias("n_units"),
        )
        .select("_keys.*", "whole", "licenses", "n_units")
    )

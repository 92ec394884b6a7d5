"""License scans by sentence rules.

A text is cut into sentences; each is normalised (case, blanks, punctuation,
version numbers) and looked up among known licence sentences by an equi-join. Known
sentences are found over single line feeds, so wrapped and commented texts match;
each may also stand on lines of its own without a closing sign. The
identifiers found, in the order of the text, are matched against ordered rules:
the first rule whose sequence occurs gives its licence and uses up its sentences,
then the next rules see what is left. Sentences that no rule uses are reported too,
as are sentences that speak of a licence but are not known.

The known sentences are a fixed table of a few dozen rows, so it is broadcast. Only
sentences with a cue word leave their row; they are pre-selected before the join.

Defined cases: null and empty texts have no sentences; an unknown cue sentence
counts as ``UNKNOWN``, once over all its lines; sentences repeated in a text count once per place; equal rows
(id and text) count as one document; a null id is an id of its own; an empty table
gives no rows; only ``doc_id`` and ``text`` are read. The SQL knows the one-line
sentences and their rules only (``SENTENCES``, ``RULES``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import table

# Known sentences in normalised form. <v> stands for a version number.
SENTENCES = {
    "apache_use": "licensed under the apache license version <v>",
    "apache_copy": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at",
    "mit_release": "released under the mit license",
    "mit_use": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies",
    "no_warranty": "the software is provided as is without warranty of any kind",
    "gpl_work": "this work is licensed under the gnu general public license version <v>",
    "gpl_redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl_later": "either version <v> of the license or at your option any later version",
    "bsd_redistribute": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse products",
    "cc_by": "licensed under cc by <v>",
    "cc_by_sa": "licensed under cc by sa <v>",
    "cc_by_nc": "licensed under cc by nc <v>",
    "cc0": "this work is dedicated to the public domain",
    "reserved": "all rights reserved",
}
# In order: a rule uses up the sentences of its sequence.
RULES = (
    ("Apache", ("apache_use", "apache_copy", "apache_obtain")),
    ("GPL-or-later", ("gpl_redistribute", "gpl_later")),
    ("MIT", ("mit_grant", "mit_notice", "no_warranty")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_names")),
    ("BSD-2-Clause", ("bsd_redistribute",)),
    ("Apache", ("apache_use",)),
    ("GPL", ("gpl_work",)),
    ("MIT", ("mit_release",)),
    ("MIT", ("mit_use",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY", ("cc_by",)),
    ("CC0", ("cc0",)),
    ("Proprietary", ("reserved",)),
)
# Sentences of the licences as they are published, in their own spelling; a sentence may have several forms.
FULL = {
    "mit_release": ("MIT License", "The MIT License (MIT)", "The MIT License", "This project is licensed under the MIT License", "Licensed under the MIT License (MIT)"),
    "mit_grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the'
        " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit_notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    "no_warranty": (
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a'
        " particular purpose and noninfringement.",),
    "mit_liability": (
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,"
        " arising from, out of or in connection with the software or the use or other dealings in the software.",),
    "apache_title": ("Apache License", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
                     "Apache License, Version 2.0", "Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "apache_use": ('Licensed under the Apache License, Version 2.0 (the "License")',),
    "apache_copy": ('you may not use this file except in compliance with the License', 'you may not use these files except in compliance with the License'),
    "apache_obtain": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                      "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache_basis": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR'
        " CONDITIONS OF ANY KIND, either express or implied.",),
    "apache_see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "gpl_title": ("GNU General Public License", "GNU General Public License Version 3, 29 June 2007", "GNU General Public License Version 2, June 1991"),
    "gpl_redistribute": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "gpl_redistribute_later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the"
        " License, or (at your option) any later version.",),
    "gpl_redistribute_only": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "gpl_details": ("See the GNU General Public License for more details.",),
    "gpl_copy": ("You should have received a copy of the GNU General Public License along with this program.",
                 "You should have received a copy of the GNU General Public License along with this program"),
    "gpl_see": ("If not, see <https://www.gnu.org/licenses/>.", "If not, see <http://www.gnu.org/licenses/>.", "if not, see https://www.gnu.org/licenses/",
                "if not, see http://www.gnu.org/licenses/"),
    "bsd_redistribute": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd_source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd_binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution.",),
    "bsd_names": tuple(
        f"Neither the name of the {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior"
        " written permission." for holder in ("copyright holder", "copyright holders", "copyright owner", "author", "University", "organization")),
    "bsd_as_is": tuple(
        f'This software is provided by the {holder} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of'
        " merchantability and fitness for a particular purpose are disclaimed." for holder in ("copyright holders and contributors", "copyright holder and contributors")),
    "bsd_liability": tuple(
        f"In no event shall the {holder} or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not"
        " limited to, procurement of substitute goods or services" for holder in ("copyright holder", "copyright holders", "copyright owner")),
    "bsd_title": ("BSD 2-Clause License", "BSD 3-Clause License", 'BSD 2-Clause "Simplified" License', 'BSD 3-Clause "New" or "Revised" License'),
}
# Tried before ``RULES``: sequences that only occur in whole licence texts.
FULL_RULES = (
    ("Apache", ("apache_use", "apache_copy", "apache_obtain", "apache_basis", "apache_see")),
    ("GPL-or-later", ("gpl_redistribute_later",)),
    ("GPL", ("gpl_redistribute_only",)),
    ("MIT", ("mit_grant", "mit_notice", "no_warranty", "mit_liability")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is", "bsd_liability")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_as_is", "bsd_liability")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary")),
)
CUE = r"(?i)licen[sc]e|all rights reserved|permission is hereby|redistribut|public domain|without warranty|copyright"
UNKNOWN = "unknown"


def plain(sentence: str) -> str:
    """``normalised`` of a Python string."""
    return re.sub("[^a-z<>]+", " ", re.sub(r"[0-9]+([.][0-9]+)*", "<v>", sentence.lower())).strip()


def _known() -> dict[str, str]:
    """Normal form to name, over short and full sentences."""
    return {v: k for k, v in SENTENCES.items()} | {plain(x): k for k, forms in FULL.items() for x in forms}


OTHER, END = "[^a-z0-9<>]", "[.!?;:]"


def _pattern() -> str:
    """A known sentence in a text: from the start to the end of a sentence or line, wrapped or not, not over an empty line."""
    gap = rf"(?!{OTHER}*?(?:{END}[ \t\r\n]|\n{OTHER[:-1]}\n]*\n)){OTHER}++"
    urls = rf"{OTHER}++"  # only before an address, which often has a paragraph of its own
    gaps = lambda ws: "".join((urls if w in ("http", "https") else gap) + x for w, x in zip(ws[1:], map(_word, ws[1:])))
    forms = sorted((normal.split(" ") for normal in _known()), key=lambda ws: (-len(ws), ws))
    inner = OTHER[:-1] + r"\n.!?;:]"
    lead = rf"{inner}*+(?:{END}++(?![ \t\r\n]){inner}*+){{0,3}}(?:[0-9a-z][.)][ \t]+)?"
    return (rf"(?i)(?:(?<=^|\n|{END}[ \t])){lead}(" + "|".join(_word(ws[0]) + gaps(ws) for ws in forms)
            + rf")(?={OTHER[:-1]}\n]*?(?:\n|\z|{END}[ \t]))")


def _word(word: str) -> str:
    return r"[0-9]+(?:[.][0-9]+)*".join(re.escape(x) for x in word.split("<v>"))


MARK = "\x01"


def sentences(text: Column) -> Column:
    """Known sentences, and between them sentences that end at an empty line or at a sign followed by a blank."""
    rest = lambda x: F.split(F.regexp_replace(x, r"([.!?;:])[ \t\r\n]+", "$1" + MARK), MARK + r"|\n[^a-zA-Z0-9<>\n]*\n", -1)
    parts = F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), _pattern(), MARK + "$1" + MARK), MARK, -1)
    return F.flatten(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(rest(x))))


def normalised(sentence: Column) -> Column:
    versions = F.regexp_replace(F.lower(sentence), r"[0-9]+([.][0-9]+)*", "<v>")
    return F.trim(F.regexp_replace(versions, r"[^a-z<>]+", " "))


def found(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, c, at, sentence, version): known or cue sentences of each text."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(_known().items()), "normal string, sentence string")
    cues = docs.filter(F.col("text").rlike(CUE)).dropDuplicates(["doc_id", "text"]).select(
        "doc_id", F.xxhash64("text").alias("c"), F.posexplode(sentences(F.col("text"))).alias("at", "raw")).filter(F.col("raw").rlike(CUE))
    named = cues.select("doc_id", "c", "at", normalised(F.col("raw")).alias("normal"),
                        F.rtrim(F.regexp_extract("raw", r"[0-9]+([.][0-9]+)*", 0)).alias("version"))
    return named.join(F.broadcast(known), "normal", "left").select("doc_id", "c", "at", F.coalesce("sentence", F.lit(UNKNOWN)).alias("sentence"), "version")


def scan(docs: DataFrame) -> DataFrame:
    """Per document with a licence sentence: sentences in order, licences, what no rule used, versions."""
    rows = found(docs).groupBy("doc_id", "c").agg(F.sort_array(F.collect_list(F.struct("at", "sentence", "version"))).alias("s"))
    out = rows.withColumn("left", F.concat(F.lit("|"), F.array_join(F.transform("s", lambda x: x["sentence"]), "||"), F.lit("|")))
    hits = []
    left = F.col("left")
    for name, sequence in FULL_RULES + RULES:
        pattern = "".join(f"|{s}|" for s in sequence)
        hits.append(F.when(left.contains(pattern), F.lit(name)))
        left = F.replace(left, F.lit(pattern), F.lit(""))
    return out.select(
        "doc_id", F.array_join(F.transform("s", lambda x: x["sentence"]), ",").alias("sentences"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",").alias("licenses"),
        F.array_join(F.filter(F.split(left, "[|]+", -1), lambda x: x != ""), ",").alias("unused"),
        F.array_join(F.array_distinct(F.filter(F.transform("s", lambda x: x["version"]), lambda v: v != "")), ",").alias("versions"))


def op6_sentence_rules(spark, sf_dir):
    """The licences named in every document that speaks of one."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    left, hits = "lefts", []
    for name, sequence in RULES:
        pattern = "".join(f"|{s}|" for s in sequence)
        hits.append(f"case when contains({left}, '{pattern}') then '{name}' end")
        left = f"replace({left}, '{pattern}', '')"
    return rf"""
with known(normal, sentence) as (values {known}),
texts as (select distinct doc_id, text from documents where regexp_matches(text, '{CUE}')),
cut as (select doc_id, text, unnest(string_split(regexp_replace(text, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10))) as raw,
               generate_subscripts(string_split(regexp_replace(text, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)), 1) as place from texts),
named as (select doc_id, text, place, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+([.][0-9]+)*', '<v>', 'g'), '[^a-z<>]+', ' ', 'g')) as normal,
                 regexp_extract(raw, '[0-9]+([.][0-9]+)*', 0) as version from cut where regexp_matches(raw, '{CUE}')),
per as (select doc_id, text, list(coalesce(sentence, '{UNKNOWN}') order by place) as s,
               list(version order by place) as v from named left join known using (normal) group by doc_id, text),
led as (select *, '|' || array_to_string(s, '||') || '|' as lefts from per)
select doc_id, array_to_string(s, ',') as sentences,
       array_to_string(list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda x: x is not null))), ',') as licenses,
       array_to_string(list_filter(string_split_regex({left}, '[|]+'), lambda x: x <> ''), ',') as unused,
       array_to_string(list_filter(v, lambda x, i: x <> '' and list_position(v, x) = i), ',') as versions
from led"""


SQL = _sql()

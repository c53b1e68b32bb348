"""Licence recognition by sentences and rules, in DataFrame expressions only.

A text is normalised (lower case, runs of anything but letters and digits as one space) and known licence sentences are
looked up in it, from one line or sentence end to another; they may be wrapped over lines, in comments too. What remains of a document is its sequence of sentence identifiers. Rules, the most
specific first, are sequences of identifiers; a rule that matches consumes its part, so that the sentences of a long licence
are not reported again as a shorter one. Identifiers that no rule consumes are reported too.

Everything happens within a row: nothing is shuffled, and a hot source or very common licence costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "mit-release": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-software": "this software is licensed under the mit license",
    "permission-granted": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                          "associated documentation files the software to deal in the software without restriction "
                          "including without limitation the rights to use copy modify merge publish distribute sublicense "
                          "and or sell copies of the software and to permit persons to whom the software is furnished to "
                          "do so subject to the following conditions",
    "notice-included": "the above copyright notice and this permission notice shall be included in all copies or "
                       "substantial portions of the software",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee "
                      "is hereby granted provided that the above copyright notice and this permission notice appear in "
                      "all copies",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to "
             "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2-licensed": "licensed under the apache license version 2 0",
    "apache-2-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2-limits": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is "
                      "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-2-licensed": "this work is licensed under the gnu general public license version 2",
    "gpl-3-licensed": "this work is licensed under the gnu general public license version 3",
    "gpl-2-or-later-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                             "published by the free software foundation either version 2 of the license or at your option "
                             "any later version",
    "gpl-3-or-later-modify": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                             "published by the free software foundation either version 3 of the license or at your option "
                             "any later version",
    "free-software": "this program is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
                  "the following disclaimer in the documentation and or other materials provided with the distribution",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4-licensed": "licensed under cc by nc 4 0",
    "cc-by-4-licensed": "licensed under cc by 4 0",
    "cc-by-sa-4-licensed": "licensed under cc by sa 4 0",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-dedication": "to the extent possible under law the author has waived all copyright and related or neighboring "
                      "rights to this work",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
}

# Licences and the sequences of sentences they are known by, in the order in which rules are tried.
RULES = [
    ("Apache-2.0", ["apache-2-the-license", "apache-2-limits", "apache-2-copy", "apache-2-basis", "apache-2-see"]),
    ("GPL-3.0-or-later", ["free-software", "gpl-3-or-later-modify", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["free-software", "gpl-2-or-later-modify", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("MIT", ["permission-granted", "notice-included", "as-is"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("MIT", ["permission-granted", "notice-included"]),
    ("ISC", ["isc-permission"]),
    ("GPL-3.0-or-later", ["gpl-3-or-later-modify"]),
    ("GPL-2.0-or-later", ["gpl-2-or-later-modify"]),
    ("Apache-2.0", ["apache-2-the-license"]),
    ("Apache-2.0", ["apache-2-licensed"]),
    ("GPL-3.0-only", ["gpl-3-licensed"]),
    ("GPL-2.0-only", ["gpl-2-licensed"]),
    ("MIT", ["mit-release"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-project"]),
    ("MIT", ["mit-software"]),
    ("MPL-2.0", ["mpl-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-licensed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("CC-BY-4.0", ["cc-by-4-licensed"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("Unlicense", ["public-domain"]),
]

# With what the SQL does not know.
MORE_SENTENCES = SENTENCES | {
    "bsd-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                       "promote products derived from this software without specific prior written permission",
}
MORE_RULES = [("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"]), *RULES]

# Sentence ends of the SQL, which does not join lines.
SENTENCE_END = r"[.!?;:]+(\s+|$)|[\r\n]+"
OTHER = r"[^a-z0-9\n]+"
# A capital marks the end of a sentence in lower case.
ENDED = "E"
PUNCTUATION = r"[.!?;:]+(\s+|$)"
OTHER_BUT_ENDED = rf"[^a-z0-9\n{ENDED}]+"
USED = "/"


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order, as `<a><b>`; a sentence may be wrapped over lines."""
    lines = F.translate(F.replace(F.lower(text), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    ended = F.regexp_replace(lines, PUNCTUATION, ENDED)
    flat = F.concat(F.lit("\n"), F.regexp_replace(ended, OTHER_BUT_ENDED, " "))
    by_sentence = F.create_map(*[F.lit(x) for name, sentence in known.items() for x in (sentence, f"<{name}>")])
    found = F.transform(F.regexp_extract_all(flat, F.lit(known_sentence(known)), F.lit(1)),
                        lambda s: F.try_element_at(by_sentence, F.regexp_replace(s, f"[ \n{ENDED}]+", " ")))
    return F.array_join(found, "")


def known_sentence(known: dict[str, str]) -> str:
    """A pattern of the known sentences, from one line or sentence end to another, the longest first. One line break may
    stand between words, with comment markers, and the point of `v. 2`."""
    gap = r"(?: ?\n ?| )"
    ways = [gap.join(x.split()).replace(f"{gap}v{gap}", f"{gap}v(?: ?\\n ?|[ {ENDED}])")
            for x in sorted(known.values(), key=len, reverse=True)]
    return rf"[\n{ENDED}] ?({'|'.join(ways)})(?= ?(?:[\n{ENDED}]|$))"


def scan(docs: DataFrame, known: dict[str, str] = MORE_SENTENCES, rules: list[tuple[str, list[str]]] = MORE_RULES) -> DataFrame:
    """(doc_id, licences, sentences, other): one row per row of `docs` that holds a known sentence.

    `licences` are the licences whose rules matched, without repetition, in the order of the rules; `sentences` all identifiers
    in the order of the text; `other` those that no rule consumed; each a comma-separated text, empty for none. Rows whose
    text is null or empty hold no sentence. Rows that repeat are each reported. Other columns of `docs` are not read.
    """
    found = docs.select("doc_id", identifiers(F.col("text"), known).alias("all")).filter("`all` <> ''")
    left, hits = F.col("all"), []
    for at, (_, ids) in enumerate(rules):
        # One projection a rule, so that each step is computed once.
        pattern = "".join(f"<{name}>" for name in ids)
        found = found.withColumn(f"hit{at}", F.instr(left, pattern) > 0)
        found = found.withColumn("left", F.replace(left, F.lit(pattern), F.lit(USED)))
        left = F.col("left")
        hits.append(F.when(F.col(f"hit{at}"), F.lit(rules[at][0])))
    matched = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return found.select("doc_id", F.array_join(matched, ",").alias("licences"), _listed(F.col("all")).alias("sentences"),
                        _listed(F.replace(left, F.lit(USED), F.lit(""))).alias("other"))


def _listed(marked: Column) -> Column:
    """`<a><b>` as `a,b`."""
    return F.replace(F.replace(F.replace(marked, F.lit("><"), F.lit(",")), F.lit("<"), F.lit("")), F.lit(">"), F.lit(""))


def oracle(known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The scan of table documents in DuckDB's SQL."""
    values = ", ".join(f"('{sentence}', '<{name}>')" for name, sentence in known.items())
    steps, left = [], '"all"'
    hits = []
    for at, (licence, ids) in enumerate(rules):
        pattern = "".join(f"<{name}>" for name in ids)
        steps.append(f"s{at} AS (SELECT *, contains({left}, '{pattern}') AS hit{at}, "
                     f"replace({left}, '{pattern}', '{USED}') AS left{at} FROM {f's{at - 1}' if at else 'found'})")
        left = f"left{at}"
        hits.append(f"CASE WHEN hit{at} THEN '{licence}' END")
    last = len(rules) - 1
    listed = "replace(replace(replace({0}, '><', ','), '<', ''), '>', '')"
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
split AS (
  SELECT doc_id, row_number() OVER () AS rid,
         string_split(regexp_replace(regexp_replace(lower(text), '{SENTENCE_END}', chr(10), 'g'), '{OTHER}', ' ', 'g'),
                      chr(10)) AS parts
  FROM documents),
parts AS (SELECT doc_id, rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM split),
found AS (
  SELECT doc_id, rid, string_agg(id, '' ORDER BY pos) AS "all"
  FROM parts JOIN known ON sentence = trim(part) GROUP BY doc_id, rid),
{', '.join(steps)},
named AS (SELECT *, [{', '.join(hits)}] AS hits FROM s{last})
SELECT doc_id,
       array_to_string(list_filter(list_transform(range(1, len(hits) + 1),
           lambda i: CASE WHEN hits[i] IS NOT NULL AND list_position(hits, hits[i]) = i THEN hits[i] END),
           lambda x: x IS NOT NULL), ',') AS licences,
       {listed.format('"all"')} AS sentences,
       {listed.format(f"replace(left{last}, '{USED}', '')")} AS other
FROM named"""

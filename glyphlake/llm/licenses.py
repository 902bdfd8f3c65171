"""Operator 8: licences, recognised by their sentences.

A text is cut into sentences (at stops followed by white space, and at line
ends, but not where a line only wraps: where it ends without a stop and the next
goes on in small letters, or in capitals). A sentence is normalised: ASCII letters in lower case, everything but
these and digits one space. Normalised sentences that are known have an
identifier. A licence is an ordered rule: a sequence of identifiers. Where the
identifiers of adjacent sentences contain a rule's sequence, its licence is
found. A match within a longer one doesn't count; of two of the same sentences,
that of the rule that comes first does.

The cutting also parts a list's numbers from what they number, and a sentence
where a line begins with a capitalised word, a digit or a quotation mark. So
numbers are known sentences, and each rule is there for all such line ends within
its notice (at least LINE characters apart); n_sentences counts these parts. Of
sentences that only name a licence, those that stand whole are known.

All of it is column expressions; known sentences and rules are small fixed
tables, sent to all tasks. Only texts with a word that every rule has one of
(ANCHORS) are cut up.

Defined results: null and blank texts have no licence, and no row. Rows of the
same doc_id and text are one document. Sentences that are known but complete no
rule give no row. A null doc_id is a value like others. Extra columns are not
looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

SPLIT = "[.!?;]+[ \\t\\n\\x0B\\f\\r]+|\\n+"
#: Marks of comments at the beginning of lines go, and a line end within a sentence is a space.
COMMENT = "\\n[ \\t]*[*#/]+[ \\t]*"
WRAP = "([^.!?;: \\t\\n\\x0B\\f\\r])[ \\t\\r]*\\n[ \\t]*([a-z(]|[A-Z][A-Z])"
ANCHORS = "licen[cs]|permi|warrant|redistribut|copyright|public[^a-z0-9]+domain|liable|cc0|cc[^a-z0-9]+by"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NAMES = {
    "MIT": ["MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["2-clause BSD License", "BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["3-clause BSD License", "BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, version 1.0", "Boost Software License 1.0"],
    **{f"CC-{a}-{v}": [f"CC {a} {v}", f"Creative Commons {b} {v} International License", f"Creative Commons {b} {v} License"]
       for a, b in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
       for v in ("3.0", "4.0")},
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal license"],
}
LEADS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under {}", "Distributed under the {}", "Available under the {}", "Published under the {} license",
         "This work is licensed under {}", "This work is licensed under a {}", "This work is licensed under the {}", "This file is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}",
         "This software is released under the {}", "The source code is licensed under the {}", "This program is distributed under the {}", "License: {}"]

SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-obtain-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl-3-version": "either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-no-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

_ENDORSE = "Neither the name of {} nor the names of {} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GPL = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
#: Further wordings of sentences.
WORDINGS = {
    "name:Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License")', 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")'],
    "apache-url": ["https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-obtain-url": ["You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "bsd-endorse": [_ENDORSE.format(who, whose) for who in ("the copyright holder", "the copyright holders", "the organization", "the <organization>", "the author", "the project", "the University") for whose in ("its", "their", "the")],
    "gpl-2-whole": [_GPL.format(2), "This program is free software: " + _GPL.format(2)],
    "gpl-3-later": [_GPL.format(3)],
}
#: Numbers of a list's entries, which are sentences or (as in "1)") begin one.
LISTS = [("1", "2", "3"), ("a", "b", "c")]
LISTED = ["bsd-source", "bsd-binary", "bsd-endorse"]
ADVERTISE = "All advertising materials mentioning features or use of this software must display the following acknowledgement"
#: Line ends within a sentence are at least that far apart.
LINE = 40


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")


def digest(sentence: str) -> str:
    return hashlib.md5(sentence.encode(), usedforsecurity=False).hexdigest()


def known() -> dict[str, str]:
    """Identifiers by the digest of the normalised sentence."""
    parts = {i for _, ids in RULES for i in ids if i.startswith("part:")}
    return {digest(s): i for s, i in spelled().items()} | {digest(i.removeprefix("part:")): i for i in parts}


@functools.cache
def spelled() -> dict[str, str]:
    """Identifiers by normalised sentence; a sentence that the text's cutting would cut is known by its longest part."""
    found: dict[str, str] = {}
    for name, spellings in NAMES.items():
        for spelling in spellings:
            for lead in LEADS:
                found.setdefault(normalised(lead.format(spelling)), f"name:{name}")
        found.setdefault(normalised(f"SPDX-License-Identifier: {name}"), f"name:{name}")
    for identifier, sentence in SENTENCES.items():
        found.setdefault(normalised(heads(sentence)), identifier)
    for identifier, sentences in WORDINGS.items():
        for sentence in sentences:
            found.setdefault(normalised(heads(sentence)), identifier)
    for of in LISTS:
        for number, identifier in zip(of, LISTED):
            for sentence in [SENTENCES[identifier], *WORDINGS.get(identifier, [])]:
                found.setdefault(normalised(f"{number}) {heads(sentence)}"), identifier)
    return found


def heads(sentence: str) -> str:
    """The longest part of a sentence that the text's cutting would cut."""
    return max(re.split(SPLIT, sentence), key=len)


def in_lines(sentence: str) -> list[list[str]]:
    """The parts of a sentence, for each choice of line ends that the text's cutting doesn't join."""
    words = sentence.split()
    starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    places = [i for i in range(1, len(words)) if words[i - 1][-1] == ":" or not re.match("[a-z(]|[A-Z][A-Z]", words[i])]
    chosen: list[list[int]] = [[]]
    for i in places:
        chosen += [c + [i] for c in chosen if not c or starts[i] - starts[c[-1]] >= LINE]
    return [[normalised(" ".join(words[a:b])) for a, b in zip([0, *c], [*c, len(words)])] for c in chosen]


def part(text: str) -> str:
    """The identifier of a normalised sentence or part of one."""
    return spelled().get(text, f"part:{text}")


#: Sentences that say no more about which licence it is; those before them are a rule too.
CLOSING = {"apache-as-is", "gpl-hope", "gpl-no-warranty"}


def wrapped(ids: list[str]) -> list[list[str]]:
    """A sequence of sentences, and the same with line ends within them (not within closing ones)."""
    ways = []
    for i in ids:
        texts = [] if i in CLOSING else [*([SENTENCES[i]] if i in SENTENCES else []), *WORDINGS.get(i, [])]
        split = [[part(t) for t in parts] for text in texts for parts in in_lines(heads(text)) if len(parts) > 1]
        ways.append([[i], *(list(x) for x in dict.fromkeys(map(tuple, split)))])
    return [sum(way, []) for way in itertools.product(*ways)]


def _bsd(one: str, two: str, three: str) -> list[tuple[str, list[str]]]:
    both = ["bsd-conditions", part(one), "bsd-source", part(two), "bsd-binary"]
    third = [*both, part(three)]
    return [("BSD-3-Clause", [*third, "bsd-endorse"]), ("BSD-4-Clause", [*third, part(normalised(ADVERTISE))]), ("LicenseRef-BSD-further-clauses", third), ("BSD-2-Clause", both)]


#: Notices as they stand whole.
NOTICES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", part(normalised(ADVERTISE))]),
    ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary"]),
    *(rule for of in LISTS for rule in _bsd(*of)),
    ("Apache-2.0", ["name:Apache-2.0", "apache-use", "apache-obtain", "apache-url", "apache-as-is"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-use", "apache-obtain-url", "apache-as-is"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-use", "apache-obtain", "apache-url"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-use", "apache-as-is"]),
    ("Apache-2.0", ["name:Apache-2.0", "apache-use"]),
    ("GPL-3.0-or-later", ["gpl-3-later", "gpl-hope", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3-later", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]),
    ("GPL-3.0-or-later", ["gpl-2-later", "gpl-3-version", "gpl-hope", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl-2-later", "gpl-3-version"]),
    ("GPL-2.0-or-later", ["gpl-2-later", "gpl-2-version", "gpl-hope", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2-later", "gpl-2-version"]),
    ("GPL-2.0-or-later", ["gpl-2-whole", "gpl-hope", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2-whole"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("Unlicense", ["unlicense"]),
    *[(name, [f"name:{name}"]) for name in NAMES],
]
#: In order; of rules that match the same sentences the first counts.
RULES = [(name, way) for name, ids in NOTICES for way in wrapped(ids)]


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, first_sentence, n_sentences)."""
    spark = docs.sparkSession
    sentences = F.broadcast(spark.createDataFrame(sorted(known().items()), "digest string, id string"))
    rules = F.broadcast(spark.createDataFrame([(i, name, ids) for i, (name, ids) in enumerate(RULES)], "rule int, licence string, sequence array<string>"))
    unwrapped = F.regexp_replace(F.regexp_replace("text", COMMENT, "\n"), WRAP, "$1 $2")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.identity(docs).alias("uid"), "text").filter(F.col("text").rlike(f"(?i){ANCHORS}")).select("doc_id", "uid", F.posexplode(F.filter(F.split(unwrapped, SPLIT), lambda x: x.rlike("[A-Za-z0-9]"))).alias("place", "raw"))
    plain = F.trim(F.regexp_replace(F.translate("raw", _UPPER, _LOWER), "[^a-z0-9]+", " "))
    met = cut.select("doc_id", "uid", "place", F.md5(plain).alias("digest")).join(sentences, "digest").select("doc_id", "uid", "place", "id").distinct()
    doc = Window.partitionBy("doc_id", "uid").orderBy("place")
    island = met.withColumn("island", F.col("place") - F.row_number().over(doc)).groupBy("doc_id", "uid", "island").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("run"))
    island = island.withColumn("ids", F.col("run.id"))
    starts = F.filter(F.sequence(F.lit(0), F.size("ids") - F.size("sequence")), lambda i: F.slice("ids", i + 1, F.size("sequence")) == F.col("sequence"))
    headed = island.withColumn("head", F.explode(F.array_distinct("ids")))
    fits = headed.join(rules, (headed["head"] == rules["sequence"][0]) & (F.size("ids") >= F.size("sequence"))).withColumn("start", F.explode(starts))
    fits = fits.withColumn("end", F.col("start") + F.size("sequence"))
    order = Window.partitionBy("doc_id", "uid", "island").orderBy("start", F.desc("end"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.max("end").over(order), F.lit(-1)) >= F.col("end")
    return fits.withColumn("within", within).filter("not within").select("doc_id", "licence", F.col("run")[F.col("start")]["place"].alias("first_sentence"), F.size("sequence").alias("n_sentences"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sorted(known().items()))
    rules = ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, ids))}])" for i, (name, ids) in enumerate(RULES))
    return rf"""
WITH k(digest, id) AS (VALUES {sentences}),
rules(rule, licence, sequence) AS (VALUES {rules}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '\n[ \t]*[*#/]+[ \t]*', chr(10), 'g'), '([^.!?;: \t\n\x0B\f\r])[ \t\r]*\n[ \t]*([a-z(]|[A-Z][A-Z])', '\1 \2', 'g'), '[.!?;]+[ \t\n\x0B\f\r]+|\n+'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS parts FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(parts))) AS place, unnest(parts) AS raw FROM d),
n AS (SELECT doc_id, place, trim(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM s),
m AS (SELECT doc_id, place, id FROM n JOIN k ON digest = md5(sentence)),
i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM m),
g AS (SELECT doc_id, island, min(place) AS base, list(id ORDER BY place) AS ids FROM i GROUP BY doc_id, island),
c AS (SELECT doc_id, island, base, ids, rule, licence, sequence, unnest(range(0, len(ids) - len(sequence) + 1)) AS start FROM g, rules WHERE len(ids) >= len(sequence)),
f AS (SELECT *, start + len(sequence) AS stop FROM c WHERE ids[start + 1 : start + len(sequence)] = sequence),
w AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id, island ORDER BY start, stop DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached FROM f)
SELECT doc_id, licence, (base + start)::INT AS first_sentence, len(sequence)::INT AS n_sentences FROM w WHERE reached < stop
"""

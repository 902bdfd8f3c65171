"""Operators 4, 5, 8 and 9."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA, differences
from pyspark.sql import functions as F

from glyphlake.llm import decontaminate as D, language_id as L, licenses as S, queries as Q, url_filter as U

CLASHING = ("__url", "__entry", "uid", "language", "score", "segment", "digest", "entry", "blocked", "place", "rule", "item_id", "island")


def extra(df, but=()):
    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in but and c not in df.columns})


@pytest.mark.parametrize("name", ["op4_url_filter", "op8_license_scan", "op9_benchmark_decontamination"])
def test_against_sql(spark, name):
    assert differences(Q.QUERIES[name], Q.ORACLE[name], spark, f"{DATA}/sf0.001") == ({}, {})


# --- Language identification


def segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(p * segmentations(word[len(k) :], pieces) for k, p in pieces.items() if word.startswith(k))


def test_forward_sums_all_segmentations():
    pieces = L.Pieces(L.vocabulary())
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces.pieces), 2))
    p /= p.sum(axis=0)
    grow = np.power(L.SCALE, [len(x) for x in pieces.pieces])[:, None]
    model = L.Model(["a", "b"], pieces, p * grow)
    words = [b"the", b"thing", b"\xc3\xa9t\xc3\xa9", b"x"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    scores = model.score(data, ends - [len(w) for w in words], ends)
    for k in range(2):
        table = dict(zip(pieces.pieces, p[:, k]))
        for i, w in enumerate(words):
            assert scores[i, k] == pytest.approx(np.log(segmentations(b" " + w, table)))


def log_sums(word, log_p):
    """The logarithm of the sum over all segmentations, in logarithms from the start."""
    longest, at = max(map(len, log_p)), [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        parts = [at[b] + log_p[word[b:e]] for b in range(max(0, e - longest), e) if word[b:e] in log_p]
        at[e] = np.logaddexp.reduce(parts)
    return at[-1]


def test_long_words_are_scored_whole():
    pieces = L.Pieces(L.vocabulary())
    p = np.random.default_rng(1).random((len(pieces.pieces), 2)) ** 4
    p /= p.sum(axis=0)
    model = L.Model(["a", "b"], pieces, p * np.power(L.SCALE, [len(x) for x in pieces.pieces])[:, None])
    words = ["自然言語処理は人間が日常的に使っている自然言語をコンピュータに処理させる一連の技術である", "हिन्दीहिन्दीहिन्दीहिन्दीहिन्दी", "the" * 11, "x" * 31, "x" * 32, "y" * 33, "été" * 300, "qzxj" * 3000, "\u0e20\u0e32" * 170]
    coded = [w.encode() for w in words]
    assert {len(w) <= L.SHORT for w in coded} == {True, False} and any(len(w) > L.MIDDLE for w in coded)
    data, ends = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([len(w) for w in coded])
    scores = model.score(data, ends - [len(w) for w in coded], ends)
    for k in range(2):
        log_p = dict(zip(pieces.pieces, np.log(p[:, k])))
        assert scores[:, k] == pytest.approx([log_sums(b" " + w, log_p) for w in coded], rel=1e-9)
    together = L.Scorer(model).texts(pa.array([" ".join(words)]))
    assert together[0][0] == pytest.approx(scores[:, :].sum(axis=0).tolist() + [0] * (together[0].shape[1] - 2), rel=1e-5) and together[1][0] == sum(len(w) + 1 for w in coded)


def test_expectation_of_long_words():
    """Each word's pieces cover its bytes, whatever its length; and side by side is as alone."""
    pieces = L.Pieces(L.vocabulary())
    lengths = np.array([len(x) for x in pieces.pieces])
    scaled = np.random.default_rng(2).random((len(lengths), 2)) ** 3 * np.power(L.SCALE, lengths)[:, None] * 1e-4
    words = ["言語" * 9, "a" * 40, "thing" * 11]
    coded = [w.encode() for w in words]
    data, ends = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([len(w) for w in coded])
    total = np.zeros_like(scaled)
    for which, matrix, n in L.side_by_side(data, ends - [len(w) for w in coded], ends, L.FITTED):
        total += L.expected_counts(pieces, scaled, matrix, n, np.ones((len(which), 2)))
    assert (total * lengths[:, None]).sum(axis=0) == pytest.approx([sum(len(w) + 1 for w in coded)] * 2)


def test_expectation_counts_add_up():
    pieces = L.Pieces(L.vocabulary())
    scaled = np.full((len(pieces.pieces), 1), 1e-4) * np.power(L.SCALE, [len(x) for x in pieces.pieces])[:, None]
    matrix = np.frombuffer(b" house train", np.uint8).reshape(2, 6)
    counts = L.expected_counts(pieces, scaled, matrix, np.array([6, 6]), np.array([[3.0], [2.0]]))
    lengths = np.array([len(x) for x in pieces.pieces])
    assert (counts[:, 0] * lengths).sum() == pytest.approx(6 * 5)  # each word's pieces cover its bytes


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = L.identified(docs, each=60).join(docs.select("doc_id", "lang"), "doc_id")
    held_out = {r[0] for r in docs.select("doc_id").collect()}
    rank = F.row_number().over(L.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    held_out -= {r[0] for r in docs.withColumn("rank", rank).filter("rank <= 60").select("doc_id").collect()}
    rows = [r for r in found.collect() if r.doc_id in held_out]
    assert len(rows) > 700
    assert sum(r.language == r.lang for r in rows) / len(rows) > 0.98


def test_language_cases(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    hard = [(9001, None, "en"), (9002, "", None), (9003, " \n ", "fr"), (9004, "これは日本語です", None), (None, "the of and that is", None), (9005, "qzxj" * 40_000, None), (9006, "the of and that is", None), (9006, "the of and that is", None)]
    both = extra(docs.union(spark.createDataFrame(hard, "doc_id long, text string, lang string")))
    rows = L.identified(both, each=20).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() + len(hard)
    assert all(found[i].language == "und" and found[i].score is None for i in (9001, 9002, 9003))
    assert found[9004].language == "und" and found[None].language == "en" == found[9006].language
    assert found[None].score == found[9006].score
    kept = L.of_known_languages(both, each=20)
    assert kept.columns == both.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {9001, 9002, 9003, 9004} & set(ids) and ids.count(9006) == 2 and None in ids
    plain = {r[0] for r in docs.select("doc_id").collect()}
    assert plain <= set(ids)
    unlabelled = both.withColumn("lang", F.lit(None).cast("string"))
    assert {r.language for r in L.identified(unlabelled).collect()} == {"und"}
    assert L.of_known_languages(unlabelled).count() == both.count() - 3
    assert L.identified(both.limit(0)).count() == 0 and L.of_known_languages(both.limit(0)).count() == 0


# --- Benchmark passages


def brute_matches(docs, items, least, item_least):
    out = {}
    for doc, text in docs:
        w = (text or "").split()
        for item, phrase in items:
            v = (phrase or "").split()
            need = least if len(v) >= least else len(v) if len(v) >= item_least else None
            if need is None:
                continue
            best = None
            for j in range(len(v)):
                for i in range(len(w)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= need and (best is None or (-n, j, i) < best):
                        best = (-n, j, i)
            if best:
                out[doc, item] = (-best[0], best[2], best[1])
    return out


def test_matches(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "aa", "ab", "the", "their", "é", "longwordindeed"])
    items = [(k, " ".join(word() for _ in range(rng.randrange(9)))) for k in range(12)] + [(50, None), (51, "")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(30)] + [(90, None), (91, ""), (92, items[3][1]), (93, items[3][1] + "x"), (94, "\n\n ".join(items[5][1].split()))]
    frame = extra(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = extra(spark.createDataFrame(items, "item_id long, text string"), but=("item_id",))
    found = {(r.doc_id, r.item_id): (r.match_words, r.doc_word, r.item_word) for r in D.locations(frame, bench, 4, 2).collect()}
    wanted = brute_matches(docs, items, 4, 2)
    assert found == wanted
    clean = D.decontaminated(frame, bench, 4, 2)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i not in {d for d, _ in wanted})


def test_match_cases(spark, monkeypatch):
    kind = "doc_id long, text string"
    passage = "one two three four five"
    docs = spark.createDataFrame([(None, f"x {passage} y"), (1, passage), (1, passage), (2, passage.upper()), (3, "z " * 200_000 + passage), (4, "one two three"), (5, "q" * 300_000)], kind)
    bench = spark.createDataFrame([(1, passage), (2, "six seven eight nine ten"), (2, passage)], "item_id long, text string")
    wanted = [(None, 1), (None, 2), (1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2)]
    for size in (D.PART, 10):  # in one part, and in several
        monkeypatch.setattr(D, "PART", size)
        assert sorted(((r.doc_id, r.item_id) for r in D.locations(docs, bench, 5, 3).distinct().collect()), key=repr) == sorted(set(wanted), key=repr)
        assert sorted(r.doc_id for r in D.decontaminated(docs, bench, 5, 3).collect()) == [2, 4, 5]
    assert D.locations(docs.limit(0), bench).count() == 0
    assert D.locations(docs, bench.limit(0)).count() == 0
    assert D.decontaminated(docs, bench.limit(0)).count() == docs.count()


# --- URL filter


def test_urls(spark):
    entries = ["a.com", "b.org/x?y=1", "c.net:8080/p", "www.d.com", "", None, "a.com", "sub.e.io", "com"]
    cases = {
        "http://a.com": "a.com", "https://www.a.com/any#f": "a.com", "http://m.x.a.com:80/q": "a.com", "http://nota.com": None, "HTTP://B.org/X?Y=1": "b.org/x?y=1", "http://b.org/x?y=2": None,
        "http://c.net:8080/p/": "c.net:8080/p", "https://user:pw@a.com/": "a.com", "http://e.io/": None, "http://sub.e.io:443/": "sub.e.io", "": None, "mailto:x": None, "http://a.com/b.org/x?y=1": "a.com", "x" * 100_000: None,
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(100, None), (101, "http://a.com"), (101, "http://a.com")]
    pages = extra(spark.createDataFrame(rows, "page_id long, url string"), but=("blocked", "entry"))
    listed = spark.createDataFrame([(e,) for e in entries], "entry string")
    for per_segment in (U.SEGMENT_ENTRIES, 2):
        found = U.filtered(pages, listed, per_segment).collect()
        assert len(found) == len(rows)
        assert {r.url: r.entry for r in found if r.url is not None} == cases
        assert all(r.blocked == (r.entry is not None) for r in found)
    assert not any(r.blocked for r in U.filtered(pages, listed.limit(0)).collect())
    assert U.filtered(pages.limit(0), listed).count() == 0


def test_entries_in_any_form(spark):
    listed = spark.createDataFrame([(e,) for e in ("www.d.com", "Example.com", "http://a.com/", "b.org/x/", "https://", "HTTPS://www.F.net:443/P/")], "entry string")
    cases = {"http://d.com/1": "d.com", "http://example.com": "example.com", "https://m.a.com/": "a.com", "http://b.org/x": "b.org/x", "http://f.net/p": "f.net/p", "http://g.com": None}
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    assert {r.url: r.entry for r in U.filtered(pages, listed).collect()} == cases


def test_a_missing_segment_fails(tmp_path):
    group = pa.table({"segment": pa.array([0], pa.int32()), "digest": pa.array([5], pa.int64()), "entry": ["same"]})
    U._segments(str(tmp_path))(group)
    batch = pa.record_batch({"url": ["u"], "entry": ["same"], "digest": pa.array([5], pa.int64()), "segment": pa.array([0], pa.int32())})
    assert [b.num_rows for b in U._probe(str(tmp_path), {0: 1})(iter([batch]))] == [1]
    assert [b.num_rows for b in U._probe(str(tmp_path), {})(iter([batch]))] == [0]
    with pytest.raises(OSError, match="whole"):
        list(U._probe(str(tmp_path), {0: 2})(iter([batch])))
    with pytest.raises(FileNotFoundError):
        list(U._probe(str(tmp_path / "gone"), {0: 1})(iter([batch])))


def test_collisions_are_confirmed(tmp_path):
    group = pa.table({"segment": pa.array([0, 0, 0], pa.int32()), "digest": pa.array([5, 5, -3], pa.int64()), "entry": ["same", "other", "high"]})
    U._segments(str(tmp_path))(group)
    segment = U.Segment(str(tmp_path), 0)
    digests = np.array([5, 5, 5, -3, 6], np.int64).view(np.uint64)
    assert segment.find(digests, [b"same", b"other", b"third", b"high", b"same"]).tolist() == [True, True, False, True, False]


# --- Licences


def test_every_known_sentence_has_an_anchor():
    import re

    assert all(re.search(S.ANCHORS, s) for s in S.spelled())
    assert {i for _, ids in S.RULES for i in ids} <= set(S.known().values())


def test_licences(spark):
    full = lambda *ids: ". ".join(S.SENTENCES[i].rstrip(":") for i in ids) + "."
    gpl = "You can redistribute it and/or modify it. " + full("gpl-3-later") + " " + full("gpl-no-warranty")
    wrapped = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    apache = "Licensed under the Apache License, Version 2.0 (see LICENSE)\n"
    docs = [
        (1, "Foo.\n" + gpl), (2, wrapped), (3, "Released under the MIT License. Bar. Licensed under CC BY-NC 4.0"), (4, None), (5, ""), (6, "the mit license"), (7, apache),
        (8, full("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse")), (9, full("bsd-conditions", "bsd-source", "bsd-binary")), (10, full("bsd-binary", "bsd-source")),
        (None, "SPDX-License-Identifier: ISC"), (3, "Released under the MIT License. Bar. Licensed under CC BY-NC 4.0"), (11, "word. " * 50_000 + "Released under the MIT License."), (12, "x" * 200_000),
    ]
    rows = S.licences(extra(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    found = sorted(((r.doc_id, r.licence, r.first_sentence, r.n_sentences) for r in rows), key=repr)
    assert found == sorted([(1, "GPL-3.0-or-later", 2, 2), (2, "GPL-3.0-or-later", 0, 1), (3, "MIT", 0, 1), (3, "CC-BY-NC-4.0", 2, 1), (8, "BSD-3-Clause", 0, 4), (9, "BSD-2-Clause", 0, 3), (None, "ISC", 0, 1), (11, "MIT", 50_000, 1)], key=repr)
    assert S.licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
GPL_2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_standard_notices(spark, tmp_path):
    rewrapped = GPL_2.replace("\n", " ").replace("GNU General", "GNU\nGeneral").replace("the Free Software", "the Free\nSoftware").replace("of the License", "of the\nLicense")
    notices = [
        ("Apache-2.0", APACHE), ("Apache-2.0", ASF), ("BSD-2-Clause", BSD + BSD_END), ("BSD-3-Clause", BSD + BSD_3 + BSD_END), ("BSD-3-Clause", (BSD + BSD_3 + BSD_END).replace(". R", ") R").replace(". N", ") N")),
        ("LicenseRef-BSD-further-clauses", BSD + "3. Whatever else there is.\n" + BSD_END), ("MPL-2.0", MPL), ("GPL-2.0-or-later", GPL_2), ("GPL-2.0-or-later", rewrapped), ("GPL-3.0-or-later", GPL_2.replace("version 2", "version 3")),
        ("Apache-2.0", APACHE.replace("Apache License", "Apache\nLicense").replace("compliance with the License", "compliance with the\nLicense")),
    ]
    for mark in ("", "# ", " * ", "// "):
        rows = [(i, "Copyright 2020 Somebody\n\n" + "".join(f"{mark}{line}\n" for line in text.split("\n"))) for i, (_, text) in enumerate(notices)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((r.doc_id, r.licence) for r in S.licences(docs).collect()) == [(i, name) for i, (name, _) in enumerate(notices)]
        assert of_sql(spark, docs, tmp_path) == ({}, {})


def of_sql(spark, docs, folder):
    """Differences from the SQL over given documents."""
    folder = folder / str(len(list(folder.iterdir())))
    folder.mkdir()
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (folder / f"{name}.parquet").symlink_to(f"{DATA}/sf0.001/{name}.parquet")
    pq.write_table(docs.toArrow(), folder / "documents.parquet")
    return differences(Q.QUERIES["op8_license_scan"], Q.ORACLE["op8_license_scan"], spark, folder)


def test_anchor_in_two_lines(spark, tmp_path):
    sentence = "This is free and unencumbered software released into the public{}domain."
    docs = spark.createDataFrame([(i, sentence.format(x)) for i, x in enumerate((" ", "\n", "  ", "\n# ", "\n * "))], "doc_id long, text string")
    assert sorted((r.doc_id, r.licence) for r in S.licences(docs).collect()) == [(i, "Unlicense") for i in range(5)]
    assert of_sql(spark, docs, tmp_path) == ({}, {})


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_mit(spark):
    texts = ["MIT License\n\nCopyright (c) 2001 A. Person\n\n" + MIT, MIT.replace("\n\n", "@").replace("\n", " ").replace("@", "\n"), "\n".join("// " + x for x in MIT.split("\n")), MIT[:600], MIT.upper()[:300]]
    found = {}
    for r in S.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.licence, r.n_sentences))
    assert {k: [x for x, _ in v] for k, v in found.items()} == {0: ["MIT"], 1: ["MIT"], 2: ["MIT"], 3: ["MIT"]}
    assert all(n >= 4 for v in (found[k] for k in (0, 1, 2)) for _, n in v)

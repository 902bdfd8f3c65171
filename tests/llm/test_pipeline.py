"""The pipeline: run() against brute force, and its stages on hard cases."""

import corpus_pipeline as C
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_dedup import HARD, brute_pairs, brute_spans
from test_filters import brute_matches

from glyphlake.llm import language_id as L, packing as P

SF = f"{DATA}/sf0.001"


def without(text, spans):
    """The text without these words; each word goes with the white space behind it."""
    import re

    lead = re.match(r"[ \t\n\x0b\f\r]*", text)[0]
    words = re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", text)
    return lead + "".join(w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans))


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.trained(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores, size = L.Scorer(model).texts(pa.array([t for _, t in rows]))
    best = L._best(model, scores, size)[0]
    rows = [r for r, b in zip(rows, best) if model.languages[b] != L.UND]
    group = {i: i for i, _ in rows}

    def root(i):
        return i if group[i] == i else root(group[i])

    for a, b, _, _ in brute_pairs(rows, 3, 0.5):
        x, y = sorted((root(a), root(b)))
        group[y] = x
    rows = [(i, t) for i, t in rows if root(i) == i]
    spans = brute_spans(rows, 50)
    rows = [(i, without(t, spans.get((i, t), []))) for i, t in rows]
    rows = [(i, t) for i, t in rows if t.strip()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for _, t in items for w in [t.split()] for k in range(len(w) - 12)}
    assert all(len(t.split()) >= 13 for _, t in items)
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + 13]) in grams for w in [t.split()] for k in range(len(w) - 12))]
    encode = P.encoding().encode_ordinary
    found = {}
    for r in C.run(spark, SF).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    assert found == {i: len(encode(t)) for i, t in rows}
    assert 0 < len(rows) < docs.count()


def hard(spark):
    rows = [(i, t, None, f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(HARD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(1) for c in ("uid", "row", "group", "ids", "home", "item", "__uid", "__spans", "stays")})


@pytest.mark.parametrize("k", range(len(C.STAGES)))
def test_stages_on_hard_cases(spark, k):
    name, stage = C.STAGES[k]
    docs = hard(spark)
    out = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0, name
    if k < len(C.STAGES) - 1:
        assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {1, 6, 8, 12} <= ids or k == 0, name


def test_names():
    assert [n for n, _ in C.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    assert C.ORACLE_SQL is None and brute_matches is not None

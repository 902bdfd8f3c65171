"""What Python workers hold at once doesn't grow with the texts."""

import tracemalloc

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from glyphlake.functions import arrow, bengali as B, classify as K
from glyphlake.plans import queries
from glyphlake.sources import made, ooxml


def test_batches_are_bounded(spark):
    docs = queries.table(spark, f"{DATA}/sf0.01", "documents")

    @F.arrow_udf("long")
    def held(text: pa.Array) -> pa.Array:
        return pa.array([text.get_total_buffer_size()] * len(text), pa.int64())

    many = docs.union(docs).union(docs).union(docs).coalesce(1)
    assert many.agg(F.sum(F.octet_length("text"))).first()[0] > 3 * arrow.BATCH
    assert many.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 2 * arrow.BATCH


def test_pieces():
    texts = pa.array(["ab", None, "", "c" * 50, "d", "é", "x" * 9])
    for most in (1, 8, 60, 1000):
        parts = [p.to_pylist() for (p,) in arrow.slices(texts, most=most)]
        assert sum(parts, []) == texts.to_pylist()
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p) <= most for p in parts)
    assert list(arrow.slices(texts.slice(0, 0))) == []
    assert arrow.by_pieces(lambda p: p, texts.slice(0, 0)).to_pylist() == []


def test_files_go_in_batches():
    files = [(f"{i}.docx", made.docx([("SutonnyMJ", "K" * 10), (None, "x")])) for i in range(300)] + [("bad.docx", b"no"), ("long.txt", b"t" * (3 << 20)), ("a.txt", b"t")]
    batch = pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.binary())], ["path", "content"])
    found = list(ooxml._scan(iter([batch])))
    assert [len(b) for b in found] == [602, 1]  # the long text ends a batch
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["doc_id"], r["paragraph_index"], r["font_name"], r["text"]) for r in rows[:2]] == [("0.docx", 0, "SutonnyMJ", "K" * 10), ("0.docx", 1, None, "x")]
    assert rows[600]["error"] and rows[601]["text"] == "t" * (3 << 20)


@pytest.mark.parametrize("name", ["file_results", "docx_round_trip", "batch_results", "pptx_round_trip"])
def test_files_meet_their_runs_without_a_function_for_each(spark, name):
    plan = queries.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Groups" not in plan and "CoGroup" not in plan


LINES = ["Avgvi †mvbvi evsjv, Avwg †Zvgvq fv‡jvevwm| the quick brown fox \n", "সোনার বাংলা আমি ", "plain words only "]
#: Functions of Arrow columns, by the queries that they are a step of.
STEPS = {"nfc": B.nfc.func, "keep_ya_phala": B.substitute_fast.func, "stream_convert": B.to_unicode, "logit_sigmoid": K.english_share}


@pytest.mark.parametrize("name", STEPS)
def test_python_memory_is_bounded(name):
    texts = pa.array([LINES[i % 3] * 200 for i in range(2000)])
    STEPS[name](texts.slice(0, 3))
    tracemalloc.start()
    done = STEPS[name](texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(done) == len(texts) and texts.get_total_buffer_size() > 16 * arrow.PIECE
    assert peak < 8 * arrow.PIECE
    assert done.slice(1000, 5).to_pylist() == STEPS[name](texts.slice(1000, 5)).to_pylist()


def test_known_words_are_bounded_by_bytes():
    one = B.Converter(B.tables.glyphs(), most=100_000)
    for i in range(20):
        words = [f"{i}x{j}{'K' * 5000}" for j in range(5)]
        assert one.words(words, one.substitute, one.substituted) == [one.substitute(w) for w in words]
        assert sum(len(k) + len(v) for k, v in one.substituted.items()) < 200_000
    one.words(["K" * 200_000], one.substitute, one.substituted)  # one that is longer than all that may be held
    assert one.words(["K"], one.substitute, one.substituted) == ["ক"] and len(one.substituted) == 1

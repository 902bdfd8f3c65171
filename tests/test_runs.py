import random

from conftest import DATA
from pyspark.sql import Window, functions as F

from glyphlake.functions import text as X
from glyphlake.operators import convert as C, reports as R, runs as O, styles as S
from glyphlake.sources import ooxml
from glyphlake.streaming import convert as stream

RUNS = "doc_id long, run_index long, font_name string, text string"
KIND = ["SutonnyMJ", "AnandaMJ", "Arial", None]


def some_runs(n=60):
    rng = random.Random(3)
    texts = ["‡", "w", "©", "Š", "‡w", "©Š", "Kv", "abc", "", "M"]
    return [(d, i, rng.choice(KIND), rng.choice(texts)) for d in range(n) for i in range(rng.randrange(7))]


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_orphans(spark):
    rows = some_runs()
    found = O.merge_orphans(spark.createDataFrame(rows, RUNS), ["doc_id"], ["run_index"]).orderBy("doc_id", "run_index").collect()
    wanted = []
    for doc, runs in by_doc(rows).items():
        items = [ooxml.Run(i, 0, r[2], r[3]) for i, r in enumerate(runs)]
        kept = ooxml.merged_orphans(items)[0] if len(items) > 1 else items
        wanted += [(doc, i, r.begin, r.text) for i, r in enumerate(kept)]
    assert [(r.doc_id, r.run_index, r["at"], r.text) for r in found] == wanted


def test_orphans_by_hand(spark):
    rows = [(1, 0, "SutonnyMJ", "‡"), (1, 1, "SutonnyMJ", "w"), (1, 2, "AnandaMJ", "K"), (1, 3, "SutonnyMJ", "©"), (2, 0, "Arial", "w"), (2, 1, "SutonnyMJ", "K"), (3, 0, "SutonnyMJ", "K"), (3, 1, "SutonnyMJ", "w")]
    found = O.merge_orphans(spark.createDataFrame(rows, RUNS), ["doc_id"], ["run_index"]).orderBy("doc_id", "run_index").collect()
    assert [(r.doc_id, r.text) for r in found] == [(1, "‡wK©"), (2, "w"), (2, "K"), (3, "K"), (3, "w")]


def test_groups(spark):
    rows = some_runs()
    found = O.group_runs(spark.createDataFrame(rows, RUNS), ["doc_id"], ["run_index"]).orderBy("doc_id", "run_index").collect()
    leads = {}
    for r in found:
        if r.leads:
            leads.setdefault(r.doc_id, []).append((r.run_index, r.group_text))
    for doc, runs in by_doc(rows).items():
        wanted = []
        for _, i, font, text in runs:
            if wanted and ooxml.is_legacy_font(font) and font == wanted[-1][2]:
                wanted[-1][1] += text
            else:
                wanted.append([i, text, font])
        assert leads[doc] == [(i, t) for i, t, _ in wanted]


def test_segments(spark):
    texts = {1: "aahé😀zzpbb", 2: "", 3: None, 4: "é", 5: "hh", 6: "hh", 7: "g", 8: "ab" * 3_000_000, 9: "\x00h"}
    ranges = [("", "A"), ("h", "B"), ("p", None)]
    found = {}
    for r in O.text_segments(spark.createDataFrame(list(texts.items()), "k long, text string"), ranges, "k").collect():
        found.setdefault(r.paragraph, []).append((r.start, r.end, r.font, r.text))
    assert found.pop(2) == [(None, None, "A", "")]
    assert found.pop(8) == [(0, 6_000_000, "A", texts[8])]
    chars = [(k, i, c, "A" if c < "h" else "B" if c < "p" else None) for k, t in texts.items() if k != 8 for i, c in enumerate(t or "")]
    wanted = {}
    for r in O.font_segments(spark.createDataFrame(chars, "paragraph long, position int, char string, font string")).orderBy("start").collect():
        wanted.setdefault(r.paragraph, []).append((r.start, r.end, r.font, r.text))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()} == wanted


def test_segments_have_no_row_for_each_character(spark):
    from glyphlake.plans import queries

    plan = queries.font_segments(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_carried_fonts(spark):
    rows = [(1, i, f, c) for i, (f, c) in enumerate([("Kalpurush", True), ("AOMJ", True), (None, False), ("Kalpurush", True), ("BOMJ", True), ("Kalpurush", True)])] + [(2, 0, "Kalpurush", True)]
    done = C.carry_fonts(spark.createDataFrame(rows, "doc_id long, run_index long, new_font string, changed boolean"), order=("run_index",)).orderBy("doc_id", "run_index")
    assert [r.new_font for r in done.collect()] == ["Kalpurush", "AOMJ", None, "AOMJ", "BOMJ", "BOMJ", "Kalpurush"]


def test_stream(spark, tmp_path):
    rows = [(1, 0, "K", "SutonnyMJ"), (1, 1, "hello", None), (2, 0, "M", "AnandaMJ"), (1, 2, "L", "AnandaMJ")]
    frame = spark.createDataFrame(rows, "doc_id long, seq long, text string, font_name string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    done = stream.convert_stream(source, C.ConvertOptions(auto_match=True))
    carried = stream.carry_fonts_stream(done, "Kalpurush", None)
    for name, df in (("plain", done.select("doc_id", "seq", "new_text", "new_font")), ("carried", carried)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.doc_id, r.seq): (r.new_text, r.new_font) for r in spark.table("plain").collect()} == {(1, 0): ("ক", "SutonnyOMJ"), (1, 1): (None, None), (2, 0): ("গ", "Kalpurush"), (1, 2): ("খ", "Kalpurush")}
    assert {(r.doc_id, r.seq): r.new_font for r in spark.table("carried").collect()} == {(1, 0): "SutonnyOMJ", (1, 1): None, (1, 2): "SutonnyOMJ", (2, 0): "Kalpurush"}


def test_summaries(spark):
    results = spark.createDataFrame([(True, None, None), (False, "bad", None), (False, None, True), (False, None, False)], "skipped boolean, error string, changed boolean")
    assert {r.status: r.files for r in C.batch_totals(results).collect()} == {"skipped": 1, "error": 1, "converted": 1, "unchanged": 1}
    summary = spark.createDataFrame([(False, None), (True, "x")], "any_change boolean, error string")
    assert C.exit_code(summary).first()[0] == 1
    assert C.exit_code(summary, "error").first()[0] == 2
    assert C.exit_code(summary.filter("not any_change")).first()[0] == 0
    assert C.exit_code(summary.filter("false")).first()[0] == 0


def test_edits_and_offsets(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xyz")], "k long, text string")
    edits = spark.createDataFrame([(1, 0, 1, "AA"), (1, 4, 6, "")], "k long, start int, end int, new_text string")
    assert {r.k: r.text for r in O.replace_spans(texts, edits, "k").collect()} == {1: "AAbcd", 2: "xyz"}
    shapes = spark.createDataFrame([(0, 1, 0, "ab\n", "F"), (0, 1, 1, "\n", "F"), (0, 1, 2, "cd", "G")], "slide int, shape int, seq int, text string, font string")
    assert {r.id: r.text for r in O.shape_runs(shapes).collect()} == {"slides:S0:SH1:C0-1": "ab", "slides:S0:SH1:C4-5": "cd"}
    w = Window.partitionBy("shape").orderBy("seq")
    assert [r.o for r in shapes.withColumn("o", O.running_offsets(w, F.col("text"))).orderBy("seq").collect()] == [0, 3, 4]


def test_styles(spark):
    rows = [(1, "a", "b", None), (1, "b", "c", None), (1, "c", None, "F"), (1, "x", "y", None), (1, "y", "x", None), (1, "m", "gone", None)]
    rows += [(2, f"s{i}", f"s{i + 1}", None) for i in range(70)] + [(2, "s70", None, "Deep")]
    found = {(r.doc_id, r.style_id): r.font for r in S.style_fonts(spark.createDataFrame(rows, "doc_id long, style_id string, based_on string, font string")).collect()}
    assert [found[1, k] for k in "abcxym"] == ["F", "F", "F", None, None, None]
    assert found[2, "s7"] == "Deep" and found[2, "s6"] is None  # the 64th is the last that is looked at
    sheet = ooxml.Styles({s: b for d, s, b, _ in rows if d == 2}, {s: f for d, s, _, f in rows if d == 2})
    assert (sheet.of("s7"), sheet.of("s6")) == ("Deep", None)


def test_reports(spark):
    ours = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    theirs = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("c", "c")], "key string, value string")
    cross = R.cross_reference(ours, theirs)
    assert {r.key: r.status for r in cross.collect()} == {"a": "match", "b": "conflict", "d": "only_theirs"}
    row = R.coverage(cross).first()
    assert (row.match, row.conflict, row.only_theirs, row.only_ours, round(row.coverage_pct, 3)) == (1, 1, 1, 0, 33.333)
    assert R.coverage(cross.filter("false")).first().coverage_pct == 0.0


def test_audit_json(spark):
    import json

    rows = spark.createDataFrame([("K", "SutonnyMJ"), ("hello", None)], "text string, font_name string")
    lines = [json.loads(r.value) for r in C.audit_json(C.audit(C.convert_runs(rows))).collect()]
    assert list(lines[0]) == list(C.AUDIT)
    assert (lines[0]["unicode_output"], lines[0]["original_text_b64"], lines[0]["slide_index"]) == ("ক", "Sw==", None)
    assert lines[1]["unicode_output"] is None and lines[1]["font_name"] is None
    assert X is not None

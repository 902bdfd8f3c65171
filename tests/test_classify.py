import pytest
from pyspark.sql import functions as F

from glyphlake.functions import classify as K, fonts as N, register, text as X
from glyphlake.operators import convert as C
from glyphlake.plans.options import ConvertOptions

ENGLISH = ["The quick brown fox jumps over the lazy dog", "Gas price is $5 today", "Please send the report before Monday morning", "This is a simple English sentence about weather"]
RUNS = "text string, font_name string"


def classified(spark, rows, mode="safe"):
    return K.with_classification(spark.createDataFrame(rows, RUNS), mode=mode).withColumn("signals", K.signals()).collect()


def test_stages(spark):
    rows = classified(spark, [("আমি বাংলায়", None), ("hello", "SutonnyMJ"), ("hello", "Kalpurush"), ("", "SutonnyMJ"), (None, None), ("আমি", "SutonnyMJ"), ("hello", "NikoshMJ")])
    assert [(r.decision, r.stage, r.confidence) for r in rows] == [
        ("unicode_bengali", "unicode_range", 1.0), ("ansi_bengali", "ansi_font", 0.99), ("unicode_bengali", "unicode_font", 0.99), ("latin", "heuristic", 0.0), ("latin", "heuristic", 0.0),
        ("unicode_bengali", "unicode_range", 1.0), ("ansi_bengali", "ansi_font", 0.99),
    ]
    assert all(r.signals == [] for r in rows)


def test_scores(spark):
    rows = classified(spark, [(t, None) for t in ENGLISH])
    assert all(r.confidence < 0.2 and r.decision == "latin" for r in rows)
    legacy, spaces, cafe = classified(spark, [("Avwg evsjvq Mvb MvB|", None), ("12 \t 34", None), ("café", None)])
    assert legacy.confidence == pytest.approx(0.993307, abs=1e-6)
    assert [s.name for s in legacy.signals] == ["high_byte_density", "distinctive_chars", "bigram_hits", "english_coverage"]
    assert spaces.confidence == pytest.approx(0.268941, abs=1e-6)
    assert (cafe.decision, round(cafe.confidence, 6)) == ("ambiguous", 0.880797)
    assert classified(spark, [("café", None)], "aggressive")[0].decision == "ansi_bengali"


def test_three_places(spark):
    values = sorted({a / b for b in range(1, 200) for a in range(b + 1)} | {k / 2000 for k in range(2001)} | {1e-9, 0.00049999999, 0.9995, 0.99949999})
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", K.three_places(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in found if r.s != f"{r.v:.3f}"] == []


def test_policy(spark):
    runs = spark.createDataFrame([("Avwg evsjvq Mvb MvB|", None), ("hello", None), ("hello", "Kalpurush"), ("K", "SutonnyMJ"), ("café", None)], RUNS)
    rows = C.convert_runs(runs).collect()
    assert [r.changed for r in rows] == [True, False, False, True, False]
    assert rows[3].new_text == "ক" and rows[3].new_font == "Kalpurush"
    assert rows[1].new_text is None and rows[1].new_font is None
    assert [r.changed for r in C.convert_runs(runs, ConvertOptions(threshold=0.6)).collect()] == [True, False, False, True, True]
    matched = C.convert_runs(runs, ConvertOptions(auto_match=True, unicode_font="Nikosh")).collect()
    assert [r.new_font for r in matched] == ["Nikosh", None, None, "SutonnyOMJ", None]


def test_font_names(spark):
    names = ["SutonnyMJ", "SutonnyXMJ-Bold", "JaJaDiMJ", "AnandaMJ", "ABCDEF+SutonnyMJ", "Arial", "StyleMJ", "SutonnyMJ Bold Italic", "abcdef+SutonnyMJ", "Siyam Rupali", "MJ"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(N.matched(F.col("n")).alias("m"), N.is_legacy(F.col("n")).alias("a"), N.is_unicode(F.col("n")).alias("u"), N.stem(F.col("n")).alias("s")).collect()
    assert [r.m for r in rows] == ["SutonnyOMJ", "SutonnyOMJ", "JaJaDiOMJ", "Kalpurush", "SutonnyOMJ", None, None, None, None, None, None]
    assert [r.a for r in rows] == [True, False, True, True, True, False, True, True, True, False, True]
    assert [r.u for r in rows] == [False] * 9 + [True, False]
    assert [rows[6].s, rows[7].s, rows[10].s] == ["styl", "sutonnymj bold", "mj"]


def test_options():
    assert ConvertOptions.of("SAFE", None, None) == ConvertOptions()
    assert ConvertOptions.of(mode="aggressive").bar == 0.85
    for bad in ({"mode": "x"}, {"encoding": "x"}, {"unicode_font": "Arial"}):
        with pytest.raises(ValueError):
            ConvertOptions.of(**bad)


def test_registered_functions_agree(spark):
    names = register.register(spark)
    assert "transliterate" in names
    rows = [("Avwg evsjvq", None), ("hello world", "SutonnyMJ"), ("It's café `x` a/b", "ABCDEF+AnandaMJ"), ("", "Kalpurush"), ("‡K wb Aviv", "Vrinda")]
    spark.createDataFrame(rows, RUNS).createOrReplaceTempView("some_runs")
    by_sql = spark.sql("SELECT transliterate(text) t, classify_stage(text, font_name) s, legacy_score(text) p, resolve_matched_font(font_name) m FROM some_runs").collect()
    frame = spark.table("some_runs")
    by_column = K.with_classification(frame).withColumn("m", N.matched(F.col("font_name"))).withColumn("p", K.sigmoid(K.logit({k: f(F.col("text")) for k, f in K.FEATURES.items()}))).collect()
    assert [(a.s, a.m, round(a.p, 9)) for a in by_sql] == [(b.stage, b.m, round(b.p, 9)) for b in by_column]
    assert by_sql[0].t == "আমি বাংলা" + by_sql[0].t[-2:]


def test_small_functions(spark):
    one = spark.createDataFrame([("a.B.DOCX", "docs:P5:C10-25", "<a&'\">")], "n string, i string, h string")
    r = one.select(X.file_kind(F.col("n")).alias("k"), X.output_name(F.col("n"), F.lit("docx")).alias("o"), X.parse_run_id(F.col("i"), "docs").alias("d"), X.parse_run_id(F.col("i"), "slides").alias("s"), X.escape_html(F.col("h")).alias("h")).first()
    assert (r.k, r.o, tuple(r.d), r.s, r.h) == ("docx", "a.B.unicode.docx", (5, 10, 25), None, "&lt;a&amp;&#39;&quot;&gt;")
    long = "x" * 100
    assert spark.createDataFrame([(long,)], "t string").select(X.base64_plain(F.col("t"))).first()[0] == __import__("base64").b64encode(long.encode()).decode()


def test_english_shares_agree(spark):
    import random

    rng = random.Random(3)
    parts = ["the", "The", "HOUSE", "it's", "né", "é", "x", "of", "\u00a0", "\u2003", "\x0b", "\x1c", ",", "(", "]", "`", "\\", "/", "-", "İt", " ", "\n", "\t", "\u3000", "\u0995"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(800)] + ["", None, "the", "of"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.english_coverage("t").alias("a"), K.english_coverage_native(F.col("t")).alias("b")).collect()
    assert [(r.t, r.a) for r in rows if r.t is not None] == [(r.t, r.b) for r in rows if r.t is not None]
    assert [r.a for r in rows if r.t is None] == [None]


def test_another_encoding(spark, monkeypatch):
    from glyphlake.functions import tables

    monkeypatch.setitem(tables.ENCODINGS, "toy", tables.Encoding("toy", ("toy", "plaything"), pairs=(("ab", "ক"), ("a", "খ"), ("X", "গ"))))
    options = ConvertOptions.of(encoding="Plaything")
    assert options.encoding == "toy"
    runs = spark.createDataFrame([("ab aX b", "SutonnyMJ"), ("ab", None)], RUNS)
    assert [r.new_text for r in C.convert_runs(runs, options).collect()] == ["ক খগ b", None]


def test_hosts(spark):
    assert register.core_version() == spark.sql(f"SELECT {'core_version()' if register.register(spark) else ''} AS v").first().v
    row = spark.range(1).select(X.is_entire_sheet(F.lit(3), F.lit(4), F.lit(3), F.lit(4)).alias("a"), X.is_entire_sheet(F.lit(3), F.lit(3), F.lit(3), F.lit(4)).alias("b")).first()
    assert (row.a, row.b) == (True, False)

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import bengali as B, tables

GOLDEN = [
    ("Avwg evsjvq Mvb MvB|", unicodedata.normalize("NFC", "আমি বাংলায় গান গাই।")),
    ("K", "ক"), ("L", "খ"), ("M", "গ"), ("N", "ঘ"), ("|", "।"), ("Ô", "‘"), ("Õ", "’"), ("wb", "নি"), ("‡Kv", "কো"), ("‡KŠ", "কৌ"),
    ("©K", "র্ক"), ("K©", "র্ক"), ("o", "ড়"), ("p", "ঢ়"), ("q", "য়"),
    ("Ku", "কঁ"), ("1234", "১২৩৪"), ("Ks", "কং"), ("Kv", "কা"), ("Av", "আ"), ("A", "অ"), (",", ","), ("K­M", "কগ"),
    ("M­", "গ"), ("w—", "ডি়"), ("wo", "ড়ি"), ("¶©", "ক্ষর্"), ("K©L©", "র্কর্খ"),
    ("‡Kv©", "র্কো"), ("h©", "র‍্য"), ("K\r\nL", "ক\nখ"), ("K\rL", "ক\nখ"), ("@", "ӯ"), ("Kuv", "কাঁ"), ("‡K«", "ক্রে"), ("w¯’", "স্থি"),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = spark.createDataFrame(GOLDEN, "text string, wanted string")
    return rows.select("text", "wanted", B.transliterate("text").alias("fast"), B.transliterate_native(F.col("text")).alias("native")).collect()


def test_golden(golden):
    assert [(r.text, r.fast) for r in golden] == [(r.text, r.wanted) for r in golden]
    assert [(r.text, r.native) for r in golden] == [(r.text, r.wanted) for r in golden]


def test_ya_phala_has_joiner():
    assert {"‌", "‍"} & set(B.text_to_unicode("i¨"))


@pytest.mark.parametrize(
    ("step", "text", "wanted"),
    [
        ("swap_leading_signs", "িক", "কি"), ("swap_leading_signs", "ীক", "ীক"), ("swap_leading_signs", "েক্র", "ক্রে"),
        ("reorder_conjuncts", "কা্র", "ক্রা"), ("reorder_marks", "কংি", "কিং"), ("join_vowel_signs", "োৌ", "োৌ"),
        ("move_reph", "কর্", "র্ক"), ("move_reph", "ক্কর্", "ক্কর্"), ("move_reph", "কর্খর্", "র্কর্খ"),
        ("keep_ya_phala", "র্য", "র‍্য"), ("keep_ya_phala", "‍র্য", "‍র্য"),
        ("pre_normalize", "a b\r\r\nc\r d", "a b\nc \nd"),
    ],
)
def test_steps(spark, step, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(getattr(B, step)(F.col("t"))).first()[0] == wanted


def test_native_and_fast_agree(spark):
    rng = random.Random(1)
    alphabet = [*tables.glyphs()[1], *tables.glyphs()[2], *tables.glyphs()[3], " ", "\n", "\r", " ", "­", "্", "ি", "ক", "‍"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.transliterate("t").alias("a"), B.transliterate_native(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(B.transliterate("t").alias("a"), B.transliterate_with_audit(F.col("t")).alias("s")).collect()
    assert [r.a for r in rows] == [None, ""]
    assert rows[1].s.spans[0].asDict() == {"source_start": 0, "source_end": 0, "target_start": 0, "target_end": 0}


def test_tables():
    assert {n: len(p) for n, p in tables.glyphs().items()} == {4: 0, 3: 4, 2: 77, 1: 188}
    assert len(tables.english()) == 2974
    assert len(tables.fonts()[2]) == 103
    assert len(tables.DISTINCTIVE) == 78
    assert len(tables.pairs()) == 83
    assert tables.encoding_of("SutonnyMJ") == "bijoy"
    with pytest.raises(ValueError):
        tables.encoding_of("other")

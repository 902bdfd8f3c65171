"""Which encoding a run of text is in: by its characters, its font, or a score of features."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from . import fonts, tables
from .arrow import by_pieces

THRESHOLDS = {"safe": 0.95, "aggressive": 0.85}
BIAS = -1.0
WEIGHTS = {"high_byte_density": 8.0, "distinctive_chars": 4.0, "bigram_hits": 6.0, "english_coverage": -6.0}
LEGACY, UNICODE, LATIN, AMBIGUOUS = "ansi_bengali", "unicode_bengali", "latin", "ambiguous"
BY_RANGE, BY_LEGACY_FONT, BY_UNICODE_FONT, BY_SCORE = "unicode_range", "ansi_font", "unicode_font", "heuristic"
#: White space in Unicode's sense, and the marks that end a token.
SPACE = "\\x09-\\x0D\\x20\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
TOKEN_END = f"[{SPACE}.,;:!?()\\[\\]{{}}<>\"'/\\\\|`]"
ASCII_SPACE = "[\\x09\\x0A\\x0C\\x0D\\x20]"


def mode_of(name: str | None) -> str:
    """A mode, by its name in any case."""
    wanted = (name or "safe").lower()
    if wanted not in THRESHOLDS:
        raise ValueError(f"unknown mode {name!r}; known: {', '.join(THRESHOLDS)}")
    return wanted


def has_bengali(text: Column) -> Column:
    return text.rlike("[\u0980-\u09ff]")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.char_length(text), F.lit(1))


def high_byte_density(text: Column) -> Column:
    """The share of characters from U+0080 to U+00FF."""
    return _share(text, "[\u0080-\u00ff]")


def distinctive_density(text: Column) -> Column:
    return _share(text, f"[{tables.DISTINCTIVE}]")


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x09\\x0A\\x0C\\x0D\\x20]+"))


def bigram_hits(text: Column) -> Column:
    """Patterns' occurrences per word, one at most. Patterns of a kind can't overlap, so a class counts them in one go."""
    patterns = [f"[{tables.AA_SIGN}]v", f"w[{tables.I_SIGN}]", f"‡[{tables.E_SIGN}]", *tables.PARTICLES, "[†‡][A-Za-z]"]
    hits = sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0])))
    return F.least(hits / F.greatest(word_count(text), F.lit(1)), F.lit(1.0))


def tokens(text: Column) -> Column:
    """Parts between white space and punctuation of three bytes and more."""
    return F.filter(F.split(text, TOKEN_END), lambda t: F.octet_length(t) >= 3)


def is_english(token: Column) -> Column:
    return F.lower(token).isin(sorted(tables.english()))


def english_coverage_native(text: Column) -> Column:
    """As english_coverage(), in built-in functions; the word list is looked through in an uncompiled lambda, so it takes far longer."""
    found = tokens(text)
    return F.when(F.size(found) > 0, F.size(F.filter(found, is_english)) / F.size(found)).otherwise(0.0)


_ENDS = np.arange(256, dtype=np.uint8)
_ENDS[[*range(9, 14), *map(ord, ".,;:!?()[]{}<>\"'/\\|`")]] = 32
_OTHER_SPACE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@cache
def _english_words() -> pa.Array:
    return pa.array(sorted(tables.english()))


def english_share(texts: pa.Array) -> pa.Array:
    """Of an Arrow column: tokens are cut at a table of bytes, and looked up in the hashed list, all of a piece at once."""
    return by_pieces(_english_share, texts)


def _english_share(texts: pa.Array) -> pa.Array:
    missing, texts = texts.is_null(), pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if data is not None:
        at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
        plain = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        changed = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(_ENDS[plain]))
        texts = pc.replace_substring_regex(changed, _OTHER_SPACE, " ") if (plain >= 0x80).any() else changed
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten()
    long = pc.greater_equal(pc.binary_length(found), 3)
    lower = pc.utf8_lower(pc.replace_substring(found, "\u0130", "i\u0307"))  # Arrow's own mapping of it is another
    known = pc.and_(long, pc.is_in(lower, value_set=_english_words()))
    at = lists.offsets.to_numpy()
    tokens, words = (np.concatenate([[0], np.cumsum(x.to_numpy(zero_copy_only=False), dtype=np.int64)])[at - at[0]] for x in (long, known))
    tokens, words = np.diff(tokens), np.diff(words)
    return pa.array(words / np.maximum(tokens, 1), pa.float64(), mask=missing.to_numpy(zero_copy_only=False))


@F.arrow_udf(DoubleType())
def english_coverage(text: pa.Array) -> pa.Array:
    """The share of tokens that are common English words."""
    return english_share(text)


FEATURES = {"high_byte_density": high_byte_density, "distinctive_chars": distinctive_density, "bigram_hits": bigram_hits, "english_coverage": english_coverage}


def logit(features: dict[str, Column]) -> Column:
    return sum((features[k] * w for k, w in WEIGHTS.items()), F.lit(BIAS))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def stage(text: Column, font: Column | None = None) -> Column:
    """What decides: the first that applies."""
    by = F.when(text == "", BY_SCORE).when(has_bengali(text), BY_RANGE)
    if font is not None:
        by = by.when(F.coalesce(fonts.is_legacy(font), F.lit(False)), BY_LEGACY_FONT).when(F.coalesce(fonts.is_unicode(font), F.lit(False)), BY_UNICODE_FONT)
    return by.otherwise(BY_SCORE)


def with_classification(runs, text: str = "text", font: str | None = "font_name", mode: str = "safe"):
    """runs with `stage`, `decision`, `confidence` and the features, which are null where another stage decided.

    A null text is classified as an empty one. Features are computed where they are
    needed, each once.
    """
    threshold = THRESHOLDS[mode_of(mode)]
    clean = F.coalesce(F.col(text), F.lit(""))
    out = runs.withColumn("stage", stage(clean, None if font is None else F.col(font)))
    scored = (F.col("stage") == BY_SCORE) & (clean != "")
    out = out.withColumns({name: F.when(scored, f(F.when(scored, clean))) for name, f in FEATURES.items()})
    p = sigmoid(logit({k: F.col(k) for k in FEATURES}))
    out = out.withColumn("confidence", F.when(F.col("stage") == BY_RANGE, 1.0).when(F.col("stage") != BY_SCORE, 0.99).when(scored, p).otherwise(0.0))
    by_score = F.when(~scored, LATIN).when(F.col("confidence") >= threshold, LEGACY).when(F.col("confidence") < 0.5, LATIN).otherwise(AMBIGUOUS)
    decision = F.when(F.col("stage") == BY_LEGACY_FONT, LEGACY).when(F.col("stage") == BY_SCORE, by_score).otherwise(UNICODE)
    return out.withColumn("decision", decision)


def signals(name: str = "signals") -> Column:
    """The features of with_classification() as ARRAY<STRUCT<name, value>>; empty where there are none."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in FEATURES])
    return F.filter(rows, lambda s: s["value"].isNotNull()).alias(name)


def three_places(share: Column) -> Column:
    """A number up to 1 as C's %.3f has it: rounded by its exact binary value, ties to even. F.format_string() and F.bround() round its shortest decimals.

    format_number() does that but for one number: the double 0.0005 is a little more than a tie.
    """
    return F.when(share == 0.0005, "0.001").otherwise(F.format_number(share, 3))


def explanation() -> Column:
    """name=0.123 for each feature."""
    return F.array_join(F.transform(signals(), lambda s: F.concat(s["name"], F.lit("="), three_places(s["value"]))), ", ")


def classification() -> Column:
    """STRUCT<decision, encoding, confidence, stage, signals> of with_classification()'s columns."""
    return F.struct("decision", F.when(F.col("decision") == LEGACY, "bijoy").alias("encoding"), "confidence", "stage", signals())

"""The functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from glyphlake import __version__

from . import bengali, classify, fonts, tables


def core_version() -> str:
    """Of the functions that are registered."""
    return __version__


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(texts: list[str]) -> str:
    return "array(" + ", ".join(map(_quoted, texts)) + ")"


def register(spark: SparkSession) -> list[str]:
    """Registers temporary functions and returns their names.

    transliterate(text), nfc(text): Arrow functions. The others are SQL expressions,
    which Catalyst puts in their callers' place.
    """
    legacy, unicode_, families = tables.fonts()
    spark.udf.register("transliterate", bengali.transliterator())
    spark.udf.register("nfc", bengali.nfc)
    plain = f"translate(regexp_replace(name, '^[A-Z]{{6}}\\\\+', ''), '{fonts.UPPER}', '{fonts.LOWER}')"
    base = plain
    for style in fonts.STYLES:
        base = f"regexp_replace({base}, '(?:{style})+$', '')"
    stems = " ".join(f"WHEN endswith(b, '{s}') AND char_length(b) > {len(s)} THEN substring(b, 1, char_length(b) - {len(s)})" for s in fonts.SUFFIXES)
    targets = ", ".join(f"{_quoted(f.stem)}, {_quoted(f.companion or (fonts.SANS_DEFAULT if f.sans else fonts.DEFAULT))}" for f in families)
    hits = " + ".join(f"regexp_count(text, {_quoted(p)})" for p in [f"[{tables.AA_SIGN}]v", f"w[{tables.I_SIGN}]", f"‡[{tables.E_SIGN}]", *tables.PARTICLES, "[†‡][A-Za-z]"])
    words = ", ".join(_quoted(w) for w in sorted(tables.english()))
    density = lambda chars: f"regexp_count(text, {_quoted(chars)}) / greatest(char_length(text), 1)"
    bodies = {
        "core_version() RETURNS STRING": f"'{__version__}'",
        "has_bengali_unicode(text STRING) RETURNS BOOLEAN": "text rlike '[ঀ-৿]'",
        "strip_subset_prefix(name STRING) RETURNS STRING": "regexp_replace(name, '^[A-Z]{6}\\\\+', '')",
        "is_ansi_font(name STRING) RETURNS BOOLEAN": f"exists({_strings(legacy)}, f -> contains({plain}, f)) OR endswith({plain}, 'mj')",
        "is_unicode_bengali_font(name STRING) RETURNS BOOLEAN": f"exists({_strings(unicode_)}, f -> contains({plain}, f))",
        "font_stem(name STRING) RETURNS STRING": f"element_at(transform(array({base}), b -> CASE {stems} ELSE b END), 1)",
        "resolve_matched_font(name STRING) RETURNS STRING": f"try_element_at(map({targets}), font_stem(name))",
        "high_byte_density(text STRING) RETURNS DOUBLE": density("[\u0080-ÿ]"),
        "distinctive_density(text STRING) RETURNS DOUBLE": density(f"[{tables.DISTINCTIVE}]"),
        "bigram_hits(text STRING) RETURNS DOUBLE": f"least(({hits}) / greatest(regexp_count(text, '[^\\\\x09\\\\x0A\\\\x0C\\\\x0D\\\\x20]+'), 1), 1.0D)",
        "english_coverage(text STRING) RETURNS DOUBLE": f"element_at(transform(array(filter(split(text, {_quoted(classify.TOKEN_END)}), t -> octet_length(t) >= 3)), ts -> CASE WHEN size(ts) = 0 THEN 0.0D ELSE size(filter(ts, t -> lower(t) IN ({words}))) / size(ts) END), 1)",
        "legacy_score(text STRING) RETURNS DOUBLE": "1 / (1 + exp(-(-1 + 8 * high_byte_density(text) + 4 * distinctive_density(text) + 6 * bigram_hits(text) - 6 * english_coverage(text))))",
        "classify_stage(text STRING, name STRING) RETURNS STRING": "CASE WHEN text = '' THEN 'heuristic' WHEN has_bengali_unicode(text) THEN 'unicode_range' WHEN is_ansi_font(name) THEN 'ansi_font' WHEN is_unicode_bengali_font(name) THEN 'unicode_font' ELSE 'heuristic' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["transliterate", "nfc", *[h.partition("(")[0] for h in bodies]]


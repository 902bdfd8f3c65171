"""Reports on tables of pairs and on fonts' code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphlake.functions import tables
from glyphlake.functions.text import code_points

PASSED = [*range(0x21), *map(ord, "!#%()*+,-./:;<=>?[]{}")]
FOREIGN = [0xFEFB, 0xFEFC, 0xFFFB, 0xFFFC, 0x20AC, 0xFFFD]
#: (least, greatest, category), the first that fits.
BLOCKS = [
    (0x21, 0x7E, "ascii-printable"), (0xA0, 0xFF, "latin1-extended"), (0x80, 0x9F, "c1-control"), (0x100, 0x24F, "latin-extended"), (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali-unicode"),
    (0x2000, 0x206F, "general-punctuation"), (0x2070, 0x209F, "superscripts"), (0x20A0, 0x20CF, "currency"), (0x2100, 0x214F, "letterlike"), (0x250, 0x2FF, "ipa-spacing-modifiers"), (0xF000, 0xF8FF, "private-use"), (0xFB00, 0xFFFE, "compat-specials"),
]
INTERESTING = ("ascii-printable", "latin1-extended", "ipa-spacing-modifiers", "general-punctuation", "other")


def category(point: Column) -> Column:
    """The kind of a code point."""
    out = F.when(point.isin(PASSED), "passthrough").when(point.isin(FOREIGN), "non-bijoy")
    for low, high, name in BLOCKS:
        out = out.when(point.between(low, high), name)
    return out.otherwise("other")


def glyph_pairs(spark: SparkSession, level: int | None = None) -> DataFrame:
    """(level, key, value): the glyph table."""
    rows = [(n, k, v) for n, pairs in tables.glyphs().items() for k, v in pairs.items() if level in (None, n)]
    return spark.createDataFrame(rows, "level int, key string, value string")


def glyph_points(pairs: DataFrame) -> DataFrame:
    """(point): the distinct code points of all keys."""
    return pairs.select(F.explode(code_points(F.col("key"))).alias("point")).distinct()


def cross_reference(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, our_value, their_value, status) of two tables (key, value): match, conflict, only_theirs, only_ours.

    A pair of theirs that maps a key to itself counts as known, but isn't compared.
    """
    both = ours.select("key", F.col("value").alias("our_value")).join(theirs.select("key", F.col("value").alias("their_value")), "key", "full")
    itself = F.coalesce(F.col("key") == F.col("their_value"), F.lit(False))
    status = F.when(itself, None).when(F.col("their_value").isNull(), "only_ours").when(F.col("our_value").isNull(), "only_theirs").when(F.col("our_value") == F.col("their_value"), "match").otherwise("conflict")
    return both.withColumn("status", status).filter("status is not null")


def coverage(cross: DataFrame) -> DataFrame:
    """Counts by status, and the share of their keys that match."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    theirs = F.count_if(F.col("status") != "only_ours")
    return cross.agg(count("match"), count("conflict"), count("only_theirs"), count("only_ours"), F.when(theirs > 0, F.count_if(F.col("status") == "match") * 100 / theirs).otherwise(0.0).alias("coverage_pct"))


def point_fonts(points: DataFrame) -> DataFrame:
    """(point, fonts, sample) of (point, font): how many fonts have it, and the first three by name."""
    return points.distinct().groupBy("point").agg(F.count("*").alias("fonts"), F.array_join(F.slice(F.sort_array(F.collect_list("font")), 1, 3), ", ").alias("sample"))


def unmapped_points(points: DataFrame, mapped: DataFrame) -> DataFrame:
    """(category, point, fonts, sample, interesting): points of fonts that no glyph has, but those that pass as they are."""
    skip = F.col("point").isin(PASSED + FOREIGN)
    kept = point_fonts(points).filter(~skip).join(mapped, "point", "left_anti")
    kind = category(F.col("point"))
    return kept.select(kind.alias("category"), "point", "fonts", "sample", kind.isin(*INTERESTING).alias("interesting"))


def category_counts(points: DataFrame, mapped: DataFrame) -> DataFrame:
    """(category, points, interesting) of unmapped points, the largest category first."""
    found = unmapped_points(points, mapped)
    return found.groupBy("category").agg(F.count("*").alias("points"), F.first("interesting").alias("interesting")).orderBy(F.desc("points"), "category")


def top_fonts(points: DataFrame, mapped: DataFrame, n: int = 10) -> DataFrame:
    """(font, unmapped): the fonts with most points that no glyph has, ties by name: a top-k, without a whole sort."""
    rest = points.distinct().filter(~F.col("point").isin(PASSED + FOREIGN)).join(mapped, "point", "left_anti")
    return rest.groupBy("font").agg(F.count("*").alias("unmapped")).orderBy(F.desc("unmapped"), "font").limit(n)


def dead_points(points: DataFrame, mapped: DataFrame) -> DataFrame:
    """(point): of glyphs, but of no font."""
    return mapped.select("point").subtract(points.select("point")).filter(~F.col("point").isin(PASSED + FOREIGN))


def point_coverage(points: DataFrame, mapped: DataFrame) -> DataFrame:
    """font_points, mapped_points, covered, coverage_pct."""
    seen = points.select("point").distinct().filter(~F.col("point").isin(PASSED + FOREIGN)).withColumn("in_font", F.lit(1))
    both = seen.join(mapped.select("point").distinct().withColumn("in_glyphs", F.lit(1)), "point", "full")
    counts = both.agg(F.count("in_font").alias("font_points"), F.count("in_glyphs").alias("mapped_points"), F.count_if(F.col("in_font").isNotNull() & F.col("in_glyphs").isNotNull()).alias("covered"))
    return counts.withColumn("coverage_pct", F.when(F.col("font_points") > 0, F.col("covered") * 100 / F.col("font_points")))

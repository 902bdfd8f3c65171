"""Fonts of styles that are based on others, as a relational operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

STEPS = 64


def style_fonts(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, font) of (doc_id, style_id, based_on, font): a style's own font, or that of the nearest style that it is based on.

    64 styles of a chain are looked at, itself among them. The chain is followed by
    doubling: after k joins each style knows what 2**k steps lead to, so six joins do,
    and cycles end.
    """
    known = styles.groupBy("doc_id", "style_id").agg(F.first("based_on").alias("next"), F.first("font").alias("font"))
    for _ in range(6):
        ahead = known.select("doc_id", F.col("style_id").alias("next"), F.col("next").alias("__next"), F.col("font").alias("__font"))
        known = known.join(ahead, ["doc_id", "next"], "left").select("doc_id", "style_id", F.when(F.col("font").isNull(), F.col("__next")).alias("next"), F.coalesce("font", "__font").alias("font"))
    return known.select("doc_id", "style_id", "font")


def cascade(runs: DataFrame, styles: DataFrame, defaults: DataFrame) -> DataFrame:
    """runs with `resolved_font`: the run's own, the paragraph's, its style's, the default paragraph style's, the document's.

    runs: doc_id, run_font, paragraph_font, style_id; defaults: doc_id, default_style,
    default_font, a row for each document that has any.
    """
    fonts = style_fonts(styles)
    own = fonts.select("doc_id", F.col("style_id"), F.col("font").alias("__style_font"))
    base = defaults.join(fonts.select("doc_id", F.col("style_id").alias("default_style"), F.col("font").alias("__base_font")), ["doc_id", "default_style"], "left").select("doc_id", "__base_font", F.col("default_font").alias("__default_font"))
    joined = runs.join(own, ["doc_id", "style_id"], "left").join(base, "doc_id", "left")
    return joined.withColumn("resolved_font", F.coalesce("run_font", "paragraph_font", "__style_font", "__base_font", "__default_font")).drop("__style_font", "__base_font", "__default_font")


def rfonts(token: str = "rfonts") -> "F.Column":
    """The font of a struct (ascii, hansi, ascii_theme, hansi_theme, minor_latin, major_latin)."""
    slot = F.coalesce(F.col(f"{token}.ascii_theme"), F.col(f"{token}.hansi_theme"))
    theme = F.when(slot.isin("minorHAnsi", "minorAscii"), F.col(f"{token}.minor_latin")).when(slot.isin("majorHAnsi", "majorAscii"), F.col(f"{token}.major_latin"))
    return F.coalesce(F.col(f"{token}.ascii"), F.col(f"{token}.hansi"), theme)

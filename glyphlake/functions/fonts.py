"""Font names: which are legacy, which are Unicode, and what a legacy one becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import tables

DEFAULT = "Kalpurush"
SANS_DEFAULT = "Siyam Rupali"
#: Target fonts that may be asked for.
TARGETS = (DEFAULT, "SolaimanLipi", "Noto Sans Bengali", "Nikosh")
STYLES = (" bold", " italic", " bolditalic", "-bold", "-italic", "-bolditalic")
SUFFIXES = ("sushreemj", "matramj", "sreemj", "xmj", "cmj", "emj", "omj", "mj")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without_subset_prefix(name: Column) -> Column:
    """Without the six capitals and a plus sign of an embedded subset."""
    return F.regexp_replace(name, "^[A-Z]{6}\\+", "")


def plain(name: Column) -> Column:
    return F.translate(without_subset_prefix(name), UPPER, LOWER)


def _has_part(name: Column, parts: list[str]) -> Column:
    """Whether any part is in the name: one regular expression."""
    return name.rlike("|".join(p.replace(".", "\\.") for p in sorted(parts)))


def is_legacy(name: Column) -> Column:
    known = plain(name)
    return _has_part(known, tables.fonts()[0]) | known.endswith("mj")


def is_unicode(name: Column) -> Column:
    return _has_part(plain(name), tables.fonts()[1])


def stem(name: Column) -> Column:
    """The family: in small letters, without style words (each kind as often as it is there, in order) and the first suffix that leaves something."""
    base = plain(name)
    for style in STYLES:
        base = F.regexp_replace(base, f"(?:{style})+$", "")
    found = None
    for suffix in SUFFIXES:
        hit = base.endswith(suffix) & (F.char_length(base) > len(suffix))
        rest = F.substring(base, F.lit(1), F.char_length(base) - len(suffix))
        found = F.when(hit, rest) if found is None else found.when(hit, rest)
    return found.otherwise(base)


def families(spark: SparkSession) -> DataFrame:
    """(stem, companion, sans): a table of fixed size."""
    return spark.createDataFrame([(f.stem, f.companion, f.sans) for f in tables.fonts()[2]], "stem string, companion string, sans boolean")


def resolved(companion: Column, sans: Column, known: Column) -> Column:
    return F.when(known, F.coalesce(companion, F.when(sans, SANS_DEFAULT).otherwise(DEFAULT)))


def matched(name: Column) -> Column:
    """The Unicode font that takes a legacy one's place, null if its family is unknown: a literal map."""
    targets = []
    for f in tables.fonts()[2]:
        targets += [F.lit(f.stem), F.lit(f.companion or (SANS_DEFAULT if f.sans else DEFAULT))]
    return F.try_element_at(F.create_map(*targets), stem(name))


def with_matched(runs: DataFrame, font: str = "font_name", to: str = "matched_font") -> DataFrame:
    """runs with a column as matched() gives it, by a join with the families (which are sent to all tasks: they are 103)."""
    dim = families(runs.sparkSession)
    key = f"__{to}_stem"
    dim = F.broadcast(dim.select(F.col("stem").alias(key), resolved(F.col("companion"), F.col("sans"), F.lit(True)).alias(to)))
    return runs.withColumn(key, stem(F.col(font))).join(dim, key, "left").drop(key)


def target_font(name: str | None) -> str:
    """A font of TARGETS, by its name; the default if none is given."""
    if name is None:
        return DEFAULT
    if name not in TARGETS:
        raise ValueError(f"unknown font {name!r}; known: {', '.join(TARGETS)}")
    return name

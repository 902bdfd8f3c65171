"""Runs of text converted: what to change, to which text and which font."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphlake.functions import bengali, classify, fonts
from glyphlake.functions.text import base64_plain
from glyphlake.plans.options import ConvertOptions

#: Runs' place in a document, if they have columns of these names.
PLACE = ("doc_id", "entry_idx", "slide_index", "paragraph_index", "run_index")
ORDER = ("entry_idx", "paragraph_index", "run_index")


def should_convert(bar: float) -> Column:
    return (F.col("decision") == classify.LEGACY) | ((F.col("decision") == classify.AMBIGUOUS) & (F.col("confidence") >= bar))


def convert_runs(runs: DataFrame, options: ConvertOptions = ConvertOptions(), text: str = "text", font: str | None = "font_name") -> DataFrame:
    """runs with the columns of with_classification(), `changed`, `new_text` and `new_font` (null where not changed).

    Only the texts to be changed go to Python. Extra columns stay.
    """
    out = classify.with_classification(runs, text, font, options.mode).withColumn("changed", should_convert(options.bar))
    out = out.withColumn("new_text", bengali.transliterate(F.when(F.col("changed"), F.col(text)), options.encoding))
    target: Column = F.lit(options.unicode_font)
    if options.auto_match and font is not None:
        target = F.coalesce(fonts.matched(F.col(font)), target)
    return out.withColumn("new_font", F.when(F.col("changed"), target))


def carry_fonts(converted: DataFrame, default: str = fonts.DEFAULT, partition: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Where a changed run's font is the default, the last other font that a changed run before it had takes its place.

    One sort by document. Runs that aren't changed neither give nor take.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("changed") & (F.col("new_font") != default), F.col("new_font")), ignorenulls=True).over(w)
    return converted.withColumn("new_font", F.when(F.col("changed"), F.coalesce(last, F.col("new_font"))))


def convert(runs: DataFrame, options: ConvertOptions = ConvertOptions(), partition: tuple[str, ...] = ("doc_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """convert_runs(), with carried fonts if fonts are matched. Any other DataFrame -> DataFrame function may take its place in DataFrame.transform()."""
    out = convert_runs(runs, options)
    return carry_fonts(out, options.unicode_font, partition, order) if options.auto_match else out


def actions(converted: DataFrame) -> DataFrame:
    """(place..., new_text, new_font): both null for a run that is kept."""
    return converted.select(*[c for c in PLACE if c in converted.columns], "new_text", "new_font")


AUDIT = ("slide_index", "paragraph_index", "run_index", "source_format", "font_name", "stage", "decision", "confidence", "original_text_b64", "unicode_output")


def audit(converted: DataFrame, source_format: Column | str = "plain_text") -> DataFrame:
    """A record for each run; places that a format doesn't have are null."""
    fmt = F.lit(source_format) if isinstance(source_format, str) else source_format
    place = [F.col(c).cast("int").alias(c) if c in converted.columns else F.lit(None).cast("int").alias(c) for c in AUDIT[:3]]
    font = F.col("font_name") if "font_name" in converted.columns else F.lit(None).cast("string")
    return converted.select(*place, fmt.alias("source_format"), font.alias("font_name"), "stage", "decision", "confidence", base64_plain(F.coalesce("text", F.lit(""))).alias("original_text_b64"), F.col("new_text").alias("unicode_output"))


def audit_json(records: DataFrame) -> DataFrame:
    """One column, value: a JSON object for each record, its keys in order, nulls written."""
    return records.select(F.to_json(F.struct(*AUDIT), {"ignoreNullFields": "false"}).alias("value"))


def explained(converted: DataFrame, source_format: str = "plain_text") -> DataFrame:
    """A line for each run on what decided."""
    place = [c for c in ("slide_index", "paragraph_index", "run_index") if c in converted.columns]
    where = F.concat_ws("/", *[F.concat(F.lit(c[0]), F.col(c)) for c in place]) if place else F.lit("")
    parts = [F.lit(f"[explain] {source_format} "), where, F.lit(" stage="), F.col("stage"), F.lit(" decision="), F.col("decision"), F.lit(" p="), classify.three_places(F.col("confidence")), F.lit(" signals=["), classify.explanation(), F.lit("]")]
    return converted.select(F.concat(*parts).alias("line"))


def file_summary(converted: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, any_change, runs_converted, runs_total)."""
    return converted.groupBy(by).agg(F.bool_or("changed").alias("any_change"), F.count_if("changed").alias("runs_converted"), F.count("*").alias("runs_total"))


def exit_code(summary: DataFrame, error: str | None = None) -> DataFrame:
    """exit_code: 1 if anything changed, 0 if not, 2 if any file has an error."""
    failed = F.max(F.col(error).isNotNull()) if error else F.lit(False)
    return summary.agg(F.when(failed, 2).otherwise(F.coalesce(F.max(F.col("any_change").cast("int")), F.lit(0))).alias("exit_code"))


def job_results(results: DataFrame) -> DataFrame:
    """(status, files, runs_converted) of what convert_batch() gives, by status."""
    return results.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("runs_converted"), F.lit(0)).alias("runs_converted"))


def batch_totals(results: DataFrame) -> DataFrame:
    """(status, files) of files with `error`, `skipped` and `changed`."""
    status = F.when(F.col("skipped"), "skipped").when(F.col("error").isNotNull(), "error").when(F.col("changed"), "converted").otherwise("unchanged")
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("files"))


def font_map(converted: DataFrame, sequence: Column) -> DataFrame:
    """(font_name, new_font, runs): each source font's target in its first changed run."""
    changed = converted.filter("changed and font_name is not null")
    return changed.groupBy("font_name").agg(F.min_by("new_font", sequence).alias("new_font"), F.count("*").alias("runs"))


def run_metrics(converted: DataFrame, by: str = "doc_id") -> DataFrame:
    """Runs of each decision, by document."""
    counts = [F.count_if(F.col("decision") == d).alias(f"runs_{d}") for d in (classify.LEGACY, classify.UNICODE, classify.LATIN, classify.AMBIGUOUS)]
    return converted.groupBy(by).agg(F.count("*").alias("runs_total"), *counts)

"""A whole conversion: files in, files and records out."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.functions.arrow import steady
from glyphlake.functions.text import batch_kind, extension, file_kind, output_name
from glyphlake.operators import convert as C
from glyphlake.sources import files, ooxml

from .options import ConvertOptions


@dataclass(frozen=True)
class Result:
    """runs: converted runs; contents: (path, content, any_change, runs_converted) of the files that aren't broken; errors: (path, error) of the others."""

    runs: DataFrame
    contents: DataFrame
    errors: DataFrame


def _result(source: DataFrame, read: DataFrame, converted: DataFrame) -> Result:
    return Result(converted, ooxml.write_back(source, converted), read.filter("error is not null").select(F.col("doc_id").alias("path"), "error"))


def convert_files(source: DataFrame, options: ConvertOptions = ConvertOptions()) -> Result:
    """Of files (path, content): DOCX, PPTX and text, by their names. A broken file is an error of its own."""
    steady(source.sparkSession)
    read = ooxml.read_runs(source)
    return _result(source, read, C.convert(read.filter("error is null").drop("error"), options))


def convert_batch(source: DataFrame, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """(path, status, runs_converted, error, output_name, content) of files (path, content, and mime if there is one).

    status: skipped (of a kind that isn't read), error, converted or unchanged. Only
    what was read has content. One bad file doesn't affect the others.
    """
    mime = F.col("mime") if "mime" in source.columns else F.lit(None).cast("string")
    known = source.withColumn("kind", batch_kind(F.col("path"), mime))
    result = convert_files(known.filter("kind <> 'skipped'").select("path", "content"), options)
    out = known.select("path", "kind").join(result.contents, "path", "left").join(result.errors, "path", "left")
    status = F.when(F.col("kind") == "skipped", "skipped").when(F.col("error").isNotNull(), "error").when(F.col("any_change"), "converted").otherwise("unchanged")
    name = F.when(F.col("content").isNotNull(), output_name(F.element_at(F.split("path", "/"), -1), extension(F.col("path"))))
    return out.select("path", status.alias("status"), F.coalesce("runs_converted", F.lit(0)).alias("runs_converted"), "error", name.alias("output_name"), "content")


def convert_texts(texts: DataFrame, key: str = "id", options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """(key, text) converted: with text, changed, runs_converted."""
    steady(texts.sparkSession)
    out = C.convert_runs(texts.select(key, F.col("text")), options, font=None)
    return out.select(key, F.coalesce("new_text", "text").alias("text"), "changed", F.col("changed").cast("int").alias("runs_converted"))


def _printed(lines: DataFrame, to) -> None:
    for row in lines.toLocalIterator():
        print(row[0], file=to)


def run_job(spark: SparkSession, source: str, target: str | None, options: ConvertOptions = ConvertOptions(), audit: str | None = None, explain: bool = False, dry_run: bool = False, audit_stdout: bool = False) -> int:
    """Converts the files of a folder into another. Returns 1 if anything changed, 0 if not, 2 if any file is broken (the others are converted).

    audit: a folder for the records; audit_stdout: they are printed. explain: what decided is printed to stderr. Both prints
    pass through the driver, line by line. Runs are read and converted once.
    """
    steady(spark)
    found = files.read_files(spark, source)
    if dry_run and found.filter(file_kind(F.col("path")) != "plain_text").limit(1).count():
        raise ValueError("a dry run is for text files only")
    if not dry_run and target is None:
        raise ValueError("a target folder is needed")
    read = ooxml.read_runs(found)
    runs, held = files.kept(C.convert(read.filter("error is null"), options).unionByName(read.filter("error is not null"), allowMissingColumns=True))
    try:
        converted = runs.filter("error is null")
        result = _result(found, runs, converted)
        order = ("doc_id", "entry_idx", "paragraph_index", "run_index")
        if audit:
            files.write_lines(C.audit_json(C.audit(converted, file_kind(F.col("doc_id")))), audit)
        if audit_stdout:
            _printed(C.audit_json(C.audit(converted.orderBy(*order), file_kind(F.col("doc_id")))), sys.stdout)
        if explain:
            _printed(C.explained(converted.orderBy(*order)), sys.stderr)
        if not dry_run:
            files.write_contents(result.contents, target, source).write.format("noop").mode("overwrite").save()
        broken = result.errors.orderBy("path").collect()
        for row in broken:
            print(f"error: {row.path}: {row.error}", file=sys.stderr)
        return 2 if broken else C.exit_code(C.file_summary(converted)).first()[0]
    finally:
        files.removed(spark, held)


def run_stream(spark: SparkSession, read: BinaryIO, write: BinaryIO, options: ConvertOptions = ConvertOptions()) -> int:
    """One text from a byte stream to another, as for standard input and output. DOCX and PPTX (archives) aren't taken: they have no text form."""
    data = read.read()
    if data[:4] == b"PK\x03\x04":
        raise ValueError("DOCX and PPTX files can't be read from standard input; name the file and --output")
    row = convert_texts(spark.createDataFrame([(1, data.decode("utf-8"))], "id long, text string"), options=options).first()
    write.write(row.text.encode())
    write.flush()
    return int(row.changed)


def run_one(spark: SparkSession, path: str, write: BinaryIO, options: ConvertOptions = ConvertOptions()) -> int:
    """A text file to a byte stream."""
    found = files.read_files(spark, path)
    if found.filter(file_kind(F.col("path")) != "plain_text").limit(1).count():
        raise ValueError("DOCX and PPTX files can't be written to standard output; name --output")
    rows = found.select("path", "content").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("only one text file can be written to standard output; name --output")
    import io

    return run_stream(spark, io.BytesIO(bytes(rows[0].content)), write, options)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Convert legacy-encoded Bengali text, DOCX and PPTX files to Unicode.")
    p.add_argument("source", help="a file or folder, or - for text from standard input")
    p.add_argument("--output", help="a folder; without it, one text goes to standard output")
    p.add_argument("--mode", default="safe")
    p.add_argument("--threshold", type=float)
    p.add_argument("--encoding", default="bijoy")
    p.add_argument("--unicode-font", default="Kalpurush")
    p.add_argument("--auto-match-fonts", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    records = p.add_mutually_exclusive_group()
    records.add_argument("--audit", help="a folder for a JSON record of each run")
    records.add_argument("--audit-stdout", action="store_true", help="print the records")
    p.add_argument("--explain", action="store_true")
    return p


def main(arguments: list[str] | None = None) -> int:
    """0: nothing changed; 1: something did; 2: an error."""
    a = parser().parse_args(arguments)
    try:
        options = ConvertOptions(**{"mode": ConvertOptions.of(a.mode).mode, "encoding": ConvertOptions.of(encoding=a.encoding).encoding, "unicode_font": a.unicode_font, "threshold": a.threshold, "auto_match": a.auto_match_fonts})
        spark = SparkSession.builder.getOrCreate()
        if a.source == "-" or (a.output is None and not (a.dry_run or a.audit or a.audit_stdout or a.explain)):
            if a.output is not None or a.dry_run or a.audit or a.audit_stdout or a.explain:
                raise ValueError("standard input goes to standard output, without records")
            return run_stream(spark, sys.stdin.buffer, sys.stdout.buffer, options) if a.source == "-" else run_one(spark, a.source, sys.stdout.buffer, options)
        return run_job(spark, a.source, a.output, options, a.audit, a.explain, a.dry_run, a.audit_stdout)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

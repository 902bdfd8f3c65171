"""Small functions on text, names and code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def base64_plain(text: Column) -> Column:
    """Base 64 of the text's UTF-8, in one line."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def escape_html(text: Column) -> Column:
    for mark, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    """docx, pptx, or else text."""
    ext = extension(path)
    return F.when(ext.isin("docx", "pptx"), ext).otherwise("plain_text")


def batch_kind(name: Column, mime: Column) -> Column:
    """docx, pptx, text, or skipped for anything else."""
    ext = extension(name)
    return F.when(ext.isin("docx", "pptx"), ext).when(ext.isin("txt", "md") | F.coalesce(mime.startswith("text/"), F.lit(False)), "text").otherwise("skipped")


def output_name(name: Column, ext: Column) -> Column:
    return F.concat(F.regexp_replace(name, "\\.[^.]+$", ""), F.lit(".unicode."), ext)


def code_points(text: Column) -> Column:
    """ARRAY<INT>."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, F.ascii)


def u_repr(text: Column) -> Column:
    """The text, and its code points: 'x' [U+0078]."""
    points = F.transform(code_points(text), lambda p: F.concat(F.lit("U+"), F.lpad(F.hex(p), 4, "0")))
    return F.concat(F.lit("'"), text, F.lit("' ["), F.array_join(points, " "), F.lit("]"))


#: Identifiers of runs in a host's documents: kind -> (pattern, names of the numbers).
RUN_IDS = {
    "docs": ("^docs:P([0-9]+):C([0-9]+)-([0-9]+)$", ("paragraph", "start", "end")),
    "sheets": ("^sheets:R([0-9]+):C([0-9]+)$", ("row", "column")),
    "slides": ("^slides:S([0-9]+):SH([0-9]+):C([0-9]+)-([0-9]+)$", ("slide", "shape", "start", "end")),
}


def parse_run_id(identifier: Column, kind: str) -> Column:
    """STRUCT of the numbers; null if it is none of that kind."""
    pattern, names = RUN_IDS[kind]
    parts = [F.regexp_extract(identifier, pattern, i + 1).cast("int").alias(n) for i, n in enumerate(names)]
    return F.when(identifier.rlike(pattern), F.struct(*parts))


def is_entire_sheet(rows: Column, columns: Column, most_rows: Column, most_columns: Column) -> Column:
    """Whether a selection covers its sheet."""
    return (rows >= most_rows) & (columns >= most_columns)

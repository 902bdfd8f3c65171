"""DOCX and PPTX files made from runs: for queries and tests, as the tables hold none."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphlake.functions.arrow import rows_by_bytes

_FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])

_SCHEMAS = "http://schemas.openxmlformats.org"
_SPACES = {"w": f"{_SCHEMAS}/wordprocessingml/2006/main", "a": f"{_SCHEMAS}/drawingml/2006/main"}


def element(name: str, *inside: str, **attributes: str) -> str:
    """An XML element; w_val is the attribute w:val, and xmlns=True declares its prefix."""
    if attributes.pop("xmlns", None):
        prefix = name.partition(":")[0]
        attributes[f"xmlns_{prefix}"] = _SPACES.get(prefix, prefix)
    head = "".join([name, *(f" {k.replace('_', ':')}={quoteattr(v)}" for k, v in attributes.items())])
    return f"<{head}>{''.join(inside)}</{name}>" if inside else f"<{head}/>"


def archive(parts: dict[str, str]) -> bytes:
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return sink.getvalue()


def docx(runs: list[tuple[str | None, str]]) -> bytes:
    """Each run is a paragraph."""

    def run(font: str | None, text: str) -> str:
        properties = [element("w:rPr", element("w:rFonts", w_ascii=font))] if font else []
        return element("w:r", *properties, element("w:t", escape(text), xml_space="preserve"))

    body = element("w:body", *(element("w:p", run(*r)) for r in runs))
    return archive({"[Content_Types].xml": "<Types/>", "word/document.xml": element("w:document", body, xmlns=True)})


def pptx(runs: list[tuple[str | None, str]]) -> bytes:
    """Each run is a paragraph on a slide of its own."""

    def slide(font: str | None, text: str) -> str:
        properties = [element("a:rPr", element("a:latin", typeface=font))] if font else []
        return element("a:sld", element("a:p", element("a:r", *properties, element("a:t", escape(text)))), xmlns=True)

    return archive({f"ppt/slides/slide{i + 1}.xml": slide(*r) for i, r in enumerate(runs)})


def files(runs: DataFrame, kind: str) -> DataFrame:
    """(path, content): a file for each doc_id of (doc_id, run_index, font_name, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = docx if kind == "docx" else pptx
        rows = ((f"{doc}.{kind}", whole([(r["font_name"], r["text"]) for r in runs.as_py()])) for batch in batches for doc, runs in zip(batch.column(0).to_pylist(), batch.column(1)))
        return rows_by_bytes(rows, _FILES, lambda r: len(r[1]))

    ordered = F.sort_array(F.collect_list(F.struct("run_index", "font_name", "text")))
    return runs.groupBy("doc_id").agg(ordered.alias("runs")).mapInArrow(make, "path string, content binary")


def _styled(doc: int) -> bytes:
    fonts = lambda **names: element("w:rFonts", **{f"w_{k}": v for k, v in names.items()})
    style = lambda name, *inside, **more: element("w:style", *inside, w_type="paragraph", w_styleId=name, **more)
    based = lambda name: element("w:basedOn", w_val=name)
    kind = doc % 7
    styles = element(
        "w:styles",
        element("w:docDefaults", element("w:rPrDefault", element("w:rPr", fonts(ascii="Default")))),
        style("Normal", element("w:rPr", fonts(hAnsi="Normal")), w_default="1"),
        style("s1", based("root")),
        style("s2", based("s1")),
        style("s3", based("s3")),
        style("s4", element("w:rPr", fonts(asciiTheme="minorHAnsi"))),
        style("root", element("w:rPr", fonts(ascii=f"Root{doc % 4}"))),
        xmlns=True,
    )
    theme = element("a:theme", element("a:fontScheme", *(element(f"a:{k}Font", element("a:latin", typeface=f)) for k, f in (("major", "Major"), ("minor", f"Minor{doc}")))), xmlns=True)
    own = [fonts(ascii="Own", asciiTheme="majorHAnsi")] if doc % 3 == 0 else [fonts(hAnsiTheme="minorAscii" if doc % 4 < 2 else "majorHAnsi")] if doc % 3 == 1 else []
    properties = [element("w:pStyle", w_val=f"s{kind}")] if 0 < kind < 5 else []
    properties += [element("w:rPr", fonts(ascii="Paragraph"))] if doc % 5 == 0 else []
    run = element("w:r", *([element("w:rPr", *own)] if own else []), element("w:t", f"run {doc}"))
    paragraph = element("w:p", *([element("w:pPr", *properties)] if properties else []), run)
    return archive({"word/document.xml": element("w:document", element("w:body", paragraph), xmlns=True), "word/styles.xml": styles, "word/theme/theme1.xml": theme})


def styled(ids: DataFrame) -> DataFrame:
    """(path, content): for each doc_id a DOCX file of one run, with styles and a theme."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f"{i}.docx", _styled(i)) for batch in batches for i in batch.column(0).to_pylist())
        return rows_by_bytes(rows, _FILES, lambda r: len(r[1]))

    return ids.select("doc_id").mapInArrow(make, "path string, content binary")

"""DOCX and PPTX files: the runs of text that they hold, and files with changed runs.

A file's XML is kept as a list of tags and texts; only the runs that change are
written anew, everything else stays byte for byte. One file is handled by one
task at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphlake.functions import tables
from glyphlake.functions.arrow import rows_by_bytes, slices

DOCUMENT, STYLES, THEME = "word/document.xml", "word/styles.xml", "word/theme/theme1.xml"
_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+", re.S)
_NAME = re.compile(r"</?\s*(?:[^\s/>:]+:)?([^\s/>]+)")
_ATTRIBUTE = re.compile(r"([^\s=<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_LEADING, _TRAILING = set("†‡ˆ‰w"), set("©Š")


class OoxmlError(ValueError):
    """A file that isn't what its name says."""


# --- Tags


def tokens(xml: str) -> list[str]:
    return _TOKEN.findall(xml)


def name(token: str) -> str:
    """The local name of a tag, empty for anything else."""
    return m[1] if token[0] == "<" and token[1:2] not in "!?" and (m := _NAME.match(token)) else ""


def opens(token: str) -> bool:
    return token[0] == "<" and token[1] not in "/!?" and not token.endswith("/>")


def closes(token: str) -> bool:
    return token.startswith("</")


def attribute(token: str, wanted: str) -> str | None:
    """By its local name; the last one if there are several."""
    found = [unescape(v[1:-1]) for k, v in _ATTRIBUTE.findall(token) if k.rpartition(":")[2] == wanted]
    return found[-1] if found else None


def text_of(token: str) -> str:
    return token[9:-3] if token.startswith("<![CDATA[") else "" if token[0] == "<" else unescape(token)


def with_attributes(token: str, values: dict[str, str], prefix: str) -> str:
    """A tag with these attributes' values, which are added where they are missing."""
    missing = dict(values)

    def put(m: re.Match) -> str:
        local = m[1].rpartition(":")[2]
        if local not in values:
            return m[0]
        missing.pop(local, None)
        return f"{m[1]}={quoteattr(values[local])}"

    done = _ATTRIBUTE.sub(put, token)
    end = "/>" if done.endswith("/>") else ">"
    return done[: -len(end)].rstrip() + "".join(f" {prefix}{k}={quoteattr(v)}" for k, v in missing.items()) + end


# --- Fonts


def is_legacy_font(font: str | None) -> bool:
    """As functions.fonts.is_legacy; null is not."""
    if font is None:
        return False
    known = re.sub("^[A-Z]{6}\\+", "", font).lower() if font.isascii() else _ascii_lower(re.sub("^[A-Z]{6}\\+", "", font))
    return any(part in known for part in tables.fonts()[0]) or known.endswith("mj")


def _ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def theme_fonts(xml: str) -> dict[str, str]:
    """The Latin fonts of a theme's minor and major font."""
    found: dict[str, str] = {}
    slot = None
    for t in tokens(xml):
        n = name(t)
        if n in ("minorFont", "majorFont"):
            slot = None if closes(t) else n[:5]
        elif n == "latin" and slot and not closes(t) and slot not in found and (face := attribute(t, "typeface")) is not None:
            found[slot] = face
    return found


def font_of(token: str, theme: dict[str, str]) -> str | None:
    """Of an rFonts tag: ascii, hAnsi, else the theme's font for the first token that is there."""
    direct = [attribute(token, k) for k in ("ascii", "hAnsi")]
    if (font := next((x for x in direct if x is not None), None)) is not None:
        return font
    slots = [attribute(token, k) for k in ("asciiTheme", "hAnsiTheme")]
    slot = next((x for x in slots if x is not None), None)
    return theme.get({"minorHAnsi": "minor", "minorAscii": "minor", "majorHAnsi": "major", "majorAscii": "major"}.get(slot or "", ""))


@dataclass
class Styles:
    based_on: dict[str, str | None] = field(default_factory=dict)
    fonts: dict[str, str | None] = field(default_factory=dict)
    paragraph: str | None = None
    default: str | None = None

    def of(self, style: str | None) -> str | None:
        """A style's font, or that of the first it is based on that has one (64 steps at most)."""
        for _ in range(64):
            if style is None or style not in self.fonts:
                return None
            if self.fonts[style] is not None:
                return self.fonts[style]
            style = self.based_on[style]
        return None

    def cascade(self, run: str | None, paragraph: str | None, style: str | None) -> str | None:
        candidates = (run, paragraph, self.of(style), self.of(self.paragraph), self.default)
        return next((f for f in candidates if f is not None), None)


def styles(xml: str, theme: dict[str, str]) -> Styles:
    out = Styles()
    current: list | None = None  # identifier, based on, font, whether the default for paragraphs
    properties, defaults, run_default = 0, 0, False
    for t in tokens(xml):
        n = name(t)
        if n == "docDefaults":
            defaults += 1 if opens(t) else -1 if closes(t) else 0
        elif n == "rPrDefault":
            run_default = opens(t) and defaults > 0
        elif n == "rPr":
            properties += 1 if opens(t) else -1 if closes(t) else 0
        elif n == "style" and opens(t):
            current = [attribute(t, "styleId") or "", None, None, attribute(t, "default") == "1" and attribute(t, "type") == "paragraph"]
        elif n == "style" and closes(t):
            if current and current[0]:
                out.based_on[current[0]], out.fonts[current[0]] = current[1], current[2]
                if current[3] and out.paragraph is None:
                    out.paragraph = current[0]
            current = None
        elif n == "basedOn" and current and not closes(t):
            current[1] = attribute(t, "val")
        elif n == "rFonts" and properties > 0 and not closes(t):
            if run_default and out.default is None:
                out.default = font_of(t, theme)
            elif current and current[2] is None:
                current[2] = font_of(t, theme)
    return out


# --- Runs


@dataclass
class Run:
    """A run's tokens are those from begin to before end, of its part."""

    begin: int
    end: int
    font: str | None
    text: str


@dataclass
class Unit:
    """What is converted as one: runs[0] takes the text, the others go; so do orphans, whose text went to neighbours."""

    paragraph: int
    index: int
    slide: int | None
    font: str | None
    text: str
    runs: list[Run]
    orphans: list[Run] = field(default_factory=list)


def run_text(part: list[str]) -> str:
    out, inside = [], False
    for t in part:
        if name(t) == "t":
            inside = opens(t)
        elif inside:
            out.append(text_of(t))
    return "".join(out)


def merged_orphans(runs: list[Run]) -> tuple[list[Run], list[Run]]:
    """Runs that stay and those whose text went to a neighbour, as operators.runs.merge_orphans has it."""
    legacy = {id(r): is_legacy_font(r.font) for r in runs}

    def fold(items: list[Run], orphan: set[str], forward: bool) -> list[Run]:
        out: list[Run] = []
        for r in items:
            last = out[-1] if out else None
            if last and legacy[id(last)] and legacy[id(r)] and last.text and set(last.text) <= orphan:
                r.text = last.text + r.text if forward else r.text + last.text
                out.pop()
                gone.append(last)
            out.append(r)
        return out

    gone: list[Run] = []
    kept = fold(runs, _LEADING, True)
    return fold(kept[::-1], _TRAILING, False)[::-1], gone


def paragraph_units(runs: list[Run], paragraph: int) -> list[Unit]:
    kept, gone = merged_orphans(runs) if len(runs) > 1 else (runs, [])
    units: list[Unit] = []
    for i, r in enumerate(kept):
        last = units[-1] if units else None
        if last and last.font == r.font and is_legacy_font(r.font):
            last.runs.append(r)
            last.text += r.text
        else:
            units.append(Unit(paragraph, i, None, r.font, r.text, [r]))
    if gone:
        units[0].orphans = gone
    return units


def document_units(part: list[str], sheet: Styles, theme: dict[str, str]) -> list[Unit]:
    units: list[Unit] = []
    runs: list[Run] = []
    paragraph, depth, begin = 0, 0, 0
    style = default = None
    in_paragraph_properties = False
    for i, t in enumerate(part):
        n = name(t)
        if n == "r" and (depth or opens(t)) and not t.endswith("/>"):
            if opens(t):
                begin = begin if depth else i
                depth += 1
            else:
                depth -= 1
                if not depth:
                    own = part[begin : i + 1]
                    fonts = [font_of(x, theme) for x in own if name(x) == "rFonts" and not closes(x)]
                    runs.append(Run(begin, i + 1, sheet.cascade(next((f for f in fonts if f is not None), None), default, style), run_text(own)))
        elif depth:
            continue
        elif n == "p" and opens(t):
            style = default = None
        elif n == "pPr":
            in_paragraph_properties = opens(t)
        elif in_paragraph_properties and n == "pStyle" and not closes(t):
            style = attribute(t, "val")
        elif in_paragraph_properties and n == "rFonts" and not closes(t):
            default = font_of(t, theme) if default is None else default
        elif n == "p" and closes(t):
            units += paragraph_units(runs, paragraph)
            runs, paragraph = [], paragraph + 1
    return units


def slide_units(part: list[str], slide: int) -> list[Unit]:
    units: list[Unit] = []
    paragraph = index = begin = 0
    inside = in_run = False
    for i, t in enumerate(part):
        n = name(t)
        if in_run:
            if n == "r" and closes(t):
                own = part[begin : i + 1]
                font = next((attribute(x, "typeface") for x in own if name(x) == "latin" and not closes(x)), None)
                text = run_text(own)
                units.append(Unit(paragraph, index, slide, font, text, [Run(begin, i + 1, font, text)]))
                index, in_run = index + 1, False
        elif n == "p" and opens(t):
            inside, index = True, 0
        elif n == "p" and closes(t):
            inside, paragraph = False, paragraph + 1
        elif n == "r" and opens(t) and inside:
            begin, in_run = i, True
    return units


def is_slide(entry: str) -> bool:
    return entry.startswith("ppt/slides/slide") and entry.endswith(".xml") and not any(x in entry for x in ("Layout", "Master", "_rels"))


def slide_number(entry: str) -> int:
    stem = entry[len("ppt/slides/slide") : -len(".xml")]
    return int(stem) if stem.isascii() and stem.isdigit() else 0


@dataclass
class Part:
    entry: int
    name: str
    tokens: list[str]
    units: list[Unit]


def kind_of(path: str) -> str:
    ext = path.rpartition(".")[2].lower()
    return ext if ext in ("docx", "pptx") else "plain_text"


def parts(content: bytes, kind: str) -> list[Part]:
    """The parts of a file that hold runs, in the archive's order."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise OoxmlError(f"not a {kind} file: {e}") from e
    names = archive.namelist()
    read = lambda n: archive.read(n).decode("utf-8") if n in names else ""
    if kind == "pptx":
        found = []
        for i, n in enumerate(names):
            if is_slide(n):
                part = tokens(read(n))
                found.append(Part(i, n, part, slide_units(part, slide_number(n))))
        return found
    if DOCUMENT not in names:
        raise OoxmlError(f"{DOCUMENT} is missing")
    theme = theme_fonts(read(THEME))
    part = tokens(read(DOCUMENT))
    return [Part(names.index(DOCUMENT), DOCUMENT, part, document_units(part, styles(read(STYLES), theme), theme))]


# --- Writing


def rewritten_run(part: list[str], text: str, font: str | None, kind: str) -> list[str]:
    """A run's tokens with another text (in its first text element; the others are blank) and another font."""
    out: list[str] = []
    inside = emitted = False
    tag, prefix = ("rFonts", "w:") if kind == "docx" else ("latin", "")
    values = {} if font is None else {"ascii": font, "hAnsi": font} if kind == "docx" else {"typeface": font}
    has_font = any(name(t) == tag and not closes(t) for t in part)
    has_properties = any(name(t) == "rPr" and not closes(t) for t in part)
    space = part[0][1:].partition(":")[0] if ":" in part[0].split()[0] else ""
    mark = f"{space}:" if space else ""
    new_font = with_attributes(f"<{mark}{tag}/>", values, mark if kind == "docx" else "") if values else ""
    added = not values or has_font
    for i, t in enumerate(part):
        n = name(t)
        if values and n == tag and not closes(t):
            t = with_attributes(t, values, prefix if kind == "docx" else "")
        elif not added and n == "rPr":
            if t.endswith("/>"):
                full = _NAME.match(t)[0][1:]
                out += [t[:-2].rstrip() + ">", new_font, f"</{full}>"]
                added = True
                continue
            if closes(t):
                out.append(new_font)
                added = True
        if n == "t":
            if opens(t) and kind == "docx" and "xml:space" not in t:
                t = t[:-1] + ' xml:space="preserve">'
            if closes(t) and inside and not emitted:
                out.append(escape(text))
                emitted = True
            inside = opens(t)
        elif inside:
            continue
        out.append(t)
        if i == 0 and not added and not has_properties:
            out += [f"<{mark}rPr>", new_font, f"</{mark}rPr>"]
            added = True
    return out


def rewritten(content: bytes, kind: str, actions: dict[tuple[int, int, int], tuple[str | None, str | None]]) -> bytes:
    """The file with the units' new texts and fonts; actions: by entry, paragraph and run."""
    changed: dict[int, str] = {}
    for part in parts(content, kind):
        edits: dict[int, tuple[int, list[str]]] = {}
        for unit in part.units:
            for r in unit.orphans:
                edits[r.begin] = (r.end, [])
            text, font = actions.get((part.entry, unit.paragraph, unit.index), (None, None))
            first, *others = unit.runs
            if text is not None:
                edits[first.begin] = (first.end, rewritten_run(part.tokens[first.begin : first.end], text, font, kind))
                edits |= {r.begin: (r.end, []) for r in others}
            else:
                for r in unit.runs:  # its text may have come from orphans
                    own = part.tokens[r.begin : r.end]
                    if r.text != run_text(own):
                        edits[r.begin] = (r.end, rewritten_run(own, r.text, None, kind))
        out, at = [], 0
        for begin in sorted(edits):
            end, new = edits[begin]
            out += part.tokens[at:begin] + new
            at = end
        changed[part.entry] = "".join(out + part.tokens[at:])
    source, sink = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    with zipfile.ZipFile(sink, "w") as target:
        for i, info in enumerate(source.infolist()):
            data = changed[i].encode() if i in changed else source.read(info)
            stored = info.compress_type == zipfile.ZIP_STORED
            target.writestr(info, data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return sink.getvalue()


# --- DataFrames

RUNS = "doc_id string, entry_idx int, slide_index int, paragraph_index int, run_index int, font_name string, text string"


_RUNS = pa.schema([("doc_id", pa.string()), *((c, pa.int32()) for c in ("entry_idx", "slide_index", "paragraph_index", "run_index")), ("font_name", pa.string()), ("text", pa.string()), ("error", pa.string())])
#: What a broken file raises: no archive, parts that aren't UTF-8 or can't be unpacked.
BROKEN = (OoxmlError, UnicodeDecodeError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def file_runs(path: str, content: bytes) -> list[tuple]:
    """RUNS of a file; one row with only an error if it is broken."""
    kind = kind_of(path)
    try:
        if kind == "plain_text":
            return [(path, 0, None, 0, 0, None, content.decode("utf-8"), None)]
        return [(path, p.entry, u.slide, u.paragraph, u.index, u.font, u.text, None) for p in parts(content, kind) for u in p.units]
    except BROKEN as e:
        return [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for paths, contents in slices(batch.column(0), batch.column(1)):
                for path, content in zip(paths, contents):
                    yield from file_runs(path.as_py(), content.as_py() or b"")

    return rows_by_bytes(rows(), _RUNS, lambda r: len(r[6] or ""))


def read_runs(files: DataFrame) -> DataFrame:
    """RUNS and `error`, of files (path, content), as spark.read.format("binaryFile") has them: orphans merged and adjacent runs grouped.

    A text file is one run; it must be UTF-8. A DOCX file's headers, footers and
    notes aren't read. A broken file has one row, with its error and nothing else; the
    others aren't affected.
    """
    return files.select("path", "content").mapInArrow(_scan, f"{RUNS}, error string")


def scan(files: DataFrame) -> DataFrame:
    """RUNS of the files that aren't broken."""
    return read_runs(files).filter("error is null").drop("error")


_WRITTEN = pa.schema([("path", pa.string()), ("content", pa.binary()), ("any_change", pa.bool_()), ("runs_converted", pa.int32())])
_ACTION = ("entry_idx", "paragraph_index", "run_index", "new_text", "new_font")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content, actions in zip(*batch.columns):
                path, content = path.as_py(), content.as_py()
                chosen = {tuple(a[k] for k in _ACTION[:3]): (a["new_text"], a["new_font"]) for a in actions.as_py() or () if a["new_text"] is not None}
                kind = kind_of(path)
                try:
                    if kind == "plain_text":
                        text = chosen.get((0, 0, 0), (None, None))[0]
                        data = content.decode("utf-8").encode() if text is None else text.encode()
                    else:
                        data = rewritten(content, kind, chosen)
                except BROKEN:  # it has its error among the runs, and no output
                    continue
                yield path, data, bool(chosen), len(chosen)

    return rows_by_bytes(rows(), _WRITTEN, lambda r: len(r[1]))


def write_back(files: DataFrame, converted: DataFrame) -> DataFrame:
    """(path, content, any_change, runs_converted): each file with its runs' new texts and fonts; broken ones are left out.

    A file meets its runs in a join; tasks go through files in batches of so many bytes.
    """
    actions = converted.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.when(F.col("changed"), F.struct(*_ACTION))).alias("__actions"))
    joined = files.select("path", "content").join(actions, F.col("path").eqNullSafe(F.col("__doc")), "left")
    return joined.select("path", "content", "__actions").mapInArrow(_write, "path string, content binary, any_change boolean, runs_converted int")

import io
import json
import zipfile

import pyarrow as pa
import pytest

from glyphlake.operators import convert as C
from glyphlake.plans import job
from glyphlake.plans.options import ConvertOptions
from glyphlake.sources import files, made, ooxml
from glyphlake.sources.made import element as el

LEGACY, UNICODE = "Avwg evsjvq", "আমি বাংলায়"


def archive(parts):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name) if name.startswith("stored") else name, data)
    return sink.getvalue()


def fonts(**names):
    return el("w:rPr", el("w:rFonts", **{f"w_{k}": v for k, v in names.items()}))


def run(text, font=None, properties=""):
    inner = [x for x in (el("w:rFonts", w_ascii=font, w_cs="Keep") if font else "", properties) if x]
    return el("w:r", *([el("w:rPr", *inner)] if inner else []), el("w:t", text))


def docx(*paragraphs, **parts):
    body = el("w:body", *(el("w:p", p) for p in paragraphs))
    return archive({"[Content_Types].xml": "<Types/>", "word/document.xml": el("w:document", body, xmlns=True), "stored.bin": b"\x00\x01", **{k.replace("__", "/") + ".xml": v for k, v in parts.items()}})


def style(name, *inside, **more):
    return el("w:style", *inside, w_type="paragraph", w_styleId=name, **more)


def of_style(name, *more):
    return el("w:pPr", el("w:pStyle", w_val=name), *more)


def part(content, name="word/document.xml"):
    return zipfile.ZipFile(io.BytesIO(content)).read(name).decode()


def units(content, kind="docx"):
    return [(u.paragraph, u.index, u.font, u.text) for p in ooxml.parts(content, kind) for u in p.units]


MIXED = docx(run(LEGACY, "SutonnyMJ"), run("Source: Daily Star, 2023", "Times New Roman"), run("hello"), run(UNICODE, "Kalpurush"))
STYLES = el(
    "w:styles",
    el("w:docDefaults", el("w:rPrDefault", fonts(ascii="Base"))),
    style("Normal", w_default="1").replace("/>", "></w:style>"),
    style("Body", el("w:basedOn", w_val="Root")),
    style("Root", fonts(ascii="SutonnyMJ")),
    style("A", el("w:basedOn", w_val="B")),
    style("B", el("w:basedOn", w_val="A")),
    xmlns=True,
)
STYLED = docx(of_style("Body") + run("K"), run("x"), of_style("A", fonts(hAnsi="Para")) + run("y"), of_style("A") + run("z"), word__styles=STYLES)
FACES = [el("a:latin", typeface=f) for f in ("Major", "SutonnyMJ", "Second")]
THEME = el("a:theme", el("a:fontScheme", el("a:majorFont", FACES[0]), el("a:minorFont", *FACES[1:])), xmlns=True)
THEMED = docx(*(el("w:r", fonts(**f), el("w:t", t)) for t, f in (("K", {"asciiTheme": "minorHAnsi"}), ("L", {"asciiTheme": "minorBidi", "hAnsiTheme": "majorHAnsi"}))), word__theme__theme1=THEME)


def slide(*runs):
    return el("p:sld", el("a:p", *runs), xmlns=True)


def slide_run(text, font=None):
    return el("a:r", el("a:rPr", *([el("a:latin", typeface=font)] if font else []), lang="bn"), el("a:t", text))


PPTX = archive({"ppt/slides/slide2.xml": slide(slide_run("K", "SutonnyMJ"), slide_run("Source: Daily Star", "Calibri")), "ppt/slides/slide1.xml": slide(slide_run(UNICODE, "Kalpurush")), "ppt/slideLayouts/slideLayout1.xml": "<x/>"})


def test_cascade():
    assert units(STYLED) == [(0, 0, "SutonnyMJ", "K"), (1, 0, "Base", "x"), (2, 0, "Para", "y"), (3, 0, "Base", "z")]
    assert units(THEMED) == [(0, 0, "SutonnyMJ", "K"), (1, 0, None, "L")]


def test_orphans_and_groups():
    content = docx(run("‡", "SutonnyMJ") + run("Kv", "SutonnyMJ") + run("w", "AnandaMJ") + run("abc", "Arial") + run("K", "AnandaMJ") + run("©", "SutonnyMJ"))
    assert units(content) == [(0, 0, "SutonnyMJ", "‡Kv"), (0, 1, "AnandaMJ", "w"), (0, 2, "Arial", "abc"), (0, 3, "AnandaMJ", "K©")]
    kept = part(ooxml.rewritten(content, "docx", {}))
    assert "‡Kv" in kept and "K©" in kept and kept.count("<w:r>") == 4
    grouped = docx(run("Avw", "SutonnyMJ") + '<w:bookmarkStart w:id="1"/>' + run("g ", "SutonnyMJ") + run("K", "SutonnyMJ"))
    assert units(grouped) == [(0, 0, "SutonnyMJ", "Avwg K")]
    entry = ooxml.parts(grouped, "docx")[0].entry
    done = part(ooxml.rewritten(grouped, "docx", {(entry, 0, 0): ("আমি ক", "Kalpurush")}))
    assert done.count("<w:r>") == 1 and "bookmarkStart" in done and "আমি ক" in done


def test_fonts_written():
    content = docx(run("K", "SutonnyMJ"), el("w:r", el("w:t", "L"), el("w:t", "M")), el("w:r", el("w:rPr"), el("w:t", "N")), run("O", properties=el("w:b")))
    entry = ooxml.parts(content, "docx")[0].entry
    done = part(ooxml.rewritten(content, "docx", {(entry, p, 0): (f"<{p}>", "Nikosh") for p in range(4)}))
    assert '<w:rFonts w:ascii="Nikosh" w:cs="Keep" w:hAnsi="Nikosh"/>' in done
    assert done.count('w:ascii="Nikosh"') == 4 and done.count("&lt;1&gt;") == 1 and "M" not in done.replace("wordprocessingml/2006/main", "")
    assert '<w:b/><w:rFonts w:ascii="Nikosh" w:hAnsi="Nikosh"/></w:rPr>' in done
    assert units(ooxml.rewritten(content, "docx", {})) == units(content)


def test_slides():
    assert [(p.entry, u.slide, u.index, u.font) for p in ooxml.parts(PPTX, "pptx") for u in p.units] == [(0, 2, 0, "SutonnyMJ"), (0, 2, 1, "Calibri"), (1, 1, 0, "Kalpurush")]
    empty = archive({"ppt/slides/slideX.xml": slide(slide_run("K"))})
    assert [u.slide for p in ooxml.parts(empty, "pptx") for u in p.units] == [0]
    done = part(ooxml.rewritten(empty, "pptx", {(0, 0, 0): ("ক", "Kalpurush")}), "ppt/slides/slideX.xml")
    assert '<a:rPr lang="bn"><a:latin typeface="Kalpurush"/></a:rPr><a:t>ক</a:t>' in done


def test_broken():
    with pytest.raises(ooxml.OoxmlError):
        ooxml.parts(b"no archive", "docx")
    with pytest.raises(ooxml.OoxmlError):
        ooxml.parts(archive({"x": "y"}), "docx")


def test_nested_and_special_tokens():
    nested = docx('<w:r><w:t xml:space="preserve">a &amp; </w:t><mc:x><w:r><w:t>b</w:t></w:r></mc:x><w:t><![CDATA[<c>]]></w:t></w:r><w:p/><!-- <w:r> -->' + run("d"))
    assert units(nested) == [(0, 0, None, "a & b<c>"), (0, 1, None, "d")]


def test_job(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    for name, data in {"mixed.docx": MIXED, "deep/styled.DOCX": STYLED, "deck.pptx": PPTX, "a.txt": "Avwg evsjvq Mvb MvB|".encode(), "b.md": b"hello"}.items():
        (source / name).write_bytes(data)
    audit = tmp_path / "audit"
    code = job.run_job(spark, str(source), str(tmp_path / "out"), ConvertOptions(auto_match=True), str(audit))
    assert code == 1
    out = tmp_path / "out"
    assert (out / "a.txt").read_text().startswith("আমি ")
    assert (out / "b.md").read_bytes() == b"hello"
    mixed = (out / "mixed.docx").read_bytes()
    assert "আমি" in part(mixed) and "SutonnyOMJ" in part(mixed) and "Source: Daily Star, 2023" in part(mixed) and "Times New Roman" in part(mixed)
    before, after = (zipfile.ZipFile(io.BytesIO(x)) for x in (MIXED, mixed))
    assert before.namelist() == after.namelist()
    assert all(before.read(n) == after.read(n) for n in before.namelist() if n != "word/document.xml")
    assert after.getinfo("stored.bin").compress_type == zipfile.ZIP_STORED
    records = [json.loads(line) for f in audit.glob("part-*") for line in f.read_text().splitlines()]
    kinds = [r["source_format"] for r in records]
    assert (kinds.count("docx"), kinds.count("pptx"), kinds.count("plain_text")) == (8, 3, 2)
    assert all(r["slide_index"] is not None for r in records if r["source_format"] == "pptx")
    assert job.run_job(spark, str(source / "b.md"), None, dry_run=True) == 0
    with pytest.raises(ValueError):
        job.run_job(spark, str(source), None, dry_run=True)
    assert job.main([str(tmp_path / "gone"), "--output", str(tmp_path / "o2")]) == 2
    assert job.main([str(source), "--mode", "wild"]) == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "ok.txt").write_bytes("ক".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    rows = {r.doc_id.rpartition("/")[2]: (r.text, r.valid) for r in files.text_runs(files.read_files(spark, str(tmp_path), "*.txt")).collect()}
    assert rows == {"ok.txt": ("ক", True), "bad.txt": (None, False)}
    texts = job.convert_texts(spark.createDataFrame([(1, "Avwg evsjvq Mvb MvB|"), (2, "hello"), (3, None)], "id long, text string")).orderBy("id").collect()
    assert [r.changed for r in texts] == [True, False, False] and texts[1].text == "hello" and texts[2].text is None


def test_pair_table(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<all><book><title> ক </title><price>K</price></book><book><title>খ</title><price>L</price></book><book><title>x</title><price> K</price></book><book><price>M</price></book></all>")
    assert {r.key: r.value for r in files.pair_table(spark, str(tmp_path / "t.xml")).collect()} == {"K": "x", "L": "খ"}


def test_broken_files_are_errors_of_their_own(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    for name, data in {"good.docx": MIXED, "half.docx": MIXED[: len(MIXED) // 2], "none.pptx": b"nothing", "bad.txt": b"\xff\xfe", "ok.txt": b"hello", "x.docx": archive({"other": "y"}), "latin.docx": archive({"word/document.xml": b"<w:p>\xe9</w:p>"})}.items():
        (source / name).write_bytes(data)
    found = files.read_files(spark, str(source))
    assert {r.doc_id.rpartition("/")[2] for r in ooxml.read_runs(found).filter("error is not null").collect()} == {"half.docx", "none.pptx", "bad.txt", "x.docx", "latin.docx"}
    assert job.run_job(spark, str(source), str(tmp_path / "out"), audit_stdout=True) == 2
    printed = capsys.readouterr()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["good.docx", "ok.txt"]
    assert printed.err.count("error: ") == 5 and len([json.loads(line) for line in printed.out.splitlines()]) == 5
    more = found.select("path", "content").union(spark.createDataFrame([("a/b.pdf", bytearray(b"%PDF"))], "path string, content binary"))
    rows = {r.path.rpartition("/")[2]: r for r in job.convert_batch(more).collect()}
    assert {k: r.status for k, r in rows.items()} == {"good.docx": "converted", "ok.txt": "unchanged", "b.pdf": "skipped"} | dict.fromkeys(("half.docx", "none.pptx", "bad.txt", "x.docx", "latin.docx"), "error")
    assert rows["good.docx"].output_name == "good.unicode.docx" and rows["b.pdf"].content is None and rows["bad.txt"].error.startswith("UnicodeDecodeError")
    assert {r.status: (r.files, r.runs_converted) for r in C.job_results(job.convert_batch(more)).collect()} == {"converted": (1, rows["good.docx"].runs_converted), "unchanged": (1, 0), "skipped": (1, 0), "error": (5, 0)}


def test_standard_streams(spark, tmp_path, monkeypatch):
    out = io.BytesIO()
    assert job.run_stream(spark, io.BytesIO("Avwg evsjvq Mvb MvB|".encode()), out) == 1 and out.getvalue().decode().startswith("আমি ")
    with pytest.raises(ValueError, match="standard input"):
        job.run_stream(spark, io.BytesIO(MIXED), out)
    (tmp_path / "a.docx").write_bytes(MIXED)
    (tmp_path / "a.txt").write_bytes(b"hello\r\n")
    with pytest.raises(ValueError, match="standard output"):
        job.run_one(spark, str(tmp_path / "a.docx"), out)
    plain = io.BytesIO()
    assert job.run_one(spark, str(tmp_path / "a.txt"), plain) == 0 and plain.getvalue() == b"hello\r\n"
    fake = type("S", (), {})()
    fake.buffer = io.BytesIO()
    monkeypatch.setattr(job.sys, "stdout", fake)
    assert job.main([str(tmp_path / "a.txt")]) == 0 and fake.buffer.getvalue() == b"hello\r\n"
    assert job.main([str(tmp_path / "a.docx")]) == 2
    with pytest.raises(SystemExit):
        job.main([str(tmp_path / "a.txt"), "--audit", "x", "--audit-stdout"])


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("file:/in/a b/x%20.txt", bytearray(b"1")), ("file:///in/y.txt", bytearray(b"2"))], "path string, content binary")
    for folder in (str(tmp_path / "p"), f"file://{tmp_path}/u"):
        for _ in range(2):
            assert files.write_contents(rows, folder, "/in").count() == 2
    assert {p: (tmp_path / p).read_bytes() for p in ("p/a b/x .txt", "u/y.txt")} == {"p/a b/x .txt": b"1", "u/y.txt": b"2"}
    assert [files.below(p, r) for p, r in (("hdfs://h:1/in/d/x", "hdfs://h:1/in"), ("s3a://b/in/x", "s3a://b/in/"), ("file:/in/x", "file:///in"))] == ["d/x", "x", "x"]


def test_many_styled_files_are_few_batches(spark):
    ids = spark.range(0, 700, 1, 1).withColumnRenamed("id", "doc_id")
    whole = made.styled(ids)
    batches = whole.mapInArrow(lambda found: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in ooxml._scan(found)), "n long").collect()
    assert sum(r.n for r in batches) == 700 and len(batches) < 10

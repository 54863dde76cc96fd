"""Parsers of files on generated input."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from papyra.sources import files as fl
from papyra.sources import html as ht
from papyra.sources import images as im
from papyra.sources import office as of
from papyra.sources import pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Zażółć &amp; 日本</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx() -> bytes:
    return archive({
        "xl/workbook.xml": '<workbook><sheets><sheet name="Users"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c></row><row><c r="A2" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })


def pptx() -> bytes:
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:pic/><a:p><a:r><a:t>Hello {}</a:t></a:r></a:p></p:sld>'
    return archive({"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": slide.format(2), "ppt/slides/slide10.xml": slide.format(10), "ppt/notesSlides/notesSlide2.xml": '<n xmlns:a="a"><a:p><a:r><a:t>note</a:t></a:r></a:p></n>'})


def ods() -> bytes:
    return archive({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<d xmlns:t="t" xmlns:x="x"><body><t:table t:name="One"><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>v</x:p></t:table-cell></t:table-row></t:table></body></d>'})


def a_pdf(text: bytes = b"BT (Hello \\(you\\)) Tj T* [(Wor) -10 (ld)] TJ ET") -> bytes:
    data = zlib.compress(text)
    return b"%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [0 0 595.28 841.89] /Rotate 90 /Contents 2 0 R >> endobj\n2 0 obj << /Filter /FlateDecode /Length " + str(len(data)).encode() + b" >> stream\n" + data + b"\nendstream endobj\n%%EOF"


def test_office(spark):
    df = fl.from_bytes(spark, [("a.docx", docx()), ("b.xlsx", xlsx()), ("c.pptx", pptx()), ("d.ods", ods()), ("bad", b"no zip"), ("cut", docx()[:60]), ("empty", b"")])
    nodes = of.parse_files(df).cache()
    errors = {r.path: r.error for r in nodes.where("error is not null").collect()}
    assert set(errors) == {"bad", "cut", "empty"}
    text = {r.path: r.text for r in of.file_text(nodes).collect()}
    assert text["a.docx"] == "Title\nZażółć & 日本\na\tb"
    assert text["b.xlsx"] == "name\t\t3.5\ntrue" and text["d.ods"] == "v\tv"
    assert text["c.pptx"] == "Hello 2\n[Speaker Notes] note\n\nHello 10"
    assert nodes.where("type = 'heading'").count() == 1 and nodes.where("type = 'image'").count() == 2


def test_pdf(spark):
    df = fl.from_bytes(spark, [("a.pdf", a_pdf()), ("no.pdf", b"text"), ("locked.pdf", a_pdf() + b"/Encrypt")])
    got = {r.path: r for r in pdf.parse_files(df).collect()}
    assert got["a.pdf"].text == "Hello (you)\nWorld" and got["a.pdf"].rotation_deg == 90 and got["a.pdf"].width_pt == 595.28
    assert got["no.pdf"].error == "not a PDF file" and got["locked.pdf"].error == "encrypted"


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (50).to_bytes(2, "big") + (70).to_bytes(2, "big") + b"\x00" * 12
    gif = b"GIF89a" + (11).to_bytes(2, "little") + (22).to_bytes(2, "little")
    svg = b'<svg xmlns="x" viewBox="0 0 200 100"></svg>'
    got = {r.path: (r.format, r.width, r.height) for r in im.with_size(fl.from_bytes(spark, [("p", png), ("j", jpg), ("g", gif), ("s", svg), ("none", b"zzzz")])).collect()}
    assert got == {"p": ("png", 300, 200), "j": ("jpg", 70, 50), "g": ("gif", 11, 22), "s": ("svg", 200, 100), "none": (None, None, None)}


def test_html(spark):
    page = '<html lang="de-AT"><head><title> T </title></head><body><nav>x</nav><article><h2>A</h2><p>one <b>two</b> <a href="/u">l</a></p><ol><li>i<li>j</ol><pre>c  d</pre><table><tr><th>h|1<th>2</tr><tr><td>3</td><td>4</td></tr></table></article><footer>f</footer></body></html>'
    md = ht.to_markdown(page)
    assert "## A" in md and "one **two** [l](/u)" in md and "1. i" in md and "```\nc  d\n```" in md and "x" not in md.split() and "f" not in md.split()
    assert ht.to_markdown(None) == "" and ht.to_markdown("<p>") == "" and "[l]" not in ht.to_markdown(page, links=False)
    r = spark.createDataFrame([(page,)], "h string").select(ht.title_of(F.col("h")).alias("t"), ht.language_of(F.col("h")).alias("l"), ht.count_elements(F.col("h"), "table").alias("n")).first()
    assert (r.t, r.l, r.n) == ("T", "de", 1)


def test_files(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(a_pdf())
    (tmp_path / "x.bin").write_bytes(b"1")
    new = fl.read_new(spark, str(tmp_path))
    assert new.count() == 1 and fl.read_new(spark, str(tmp_path), new).count() == 0
    assert fl.read_images(spark, str(tmp_path)).count() == 2
    got = fl.fetch(spark.createDataFrame([("file:///nowhere/x",)], "path string")).first()
    assert got.content is None and got.error


def test_fetch_reads_file_urls(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>hi</p>")
    got = fl.fetch(spark.createDataFrame([((tmp_path / "p.html").as_uri(),)], "path string")).first()
    assert bytes(got.content) == b"<p>hi</p>" and got.mime == "text/html" and got.error is None


def test_parts_and_relations():
    """Units come in the order the index lists; one bad part is one error; nothing of a wide row is lost."""
    from papyra.sources import samples

    error, nodes = of.parse(samples.talk_pptx())
    assert error is None and [n[7] for n in nodes if n[6] == "paragraph"] == ["First", "Second"] and [n[0] for n in nodes if n[6] == "error"] == [2]
    wide = archive({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<d xmlns:t="t" xmlns:x="x"><body><t:table t:name="One"><t:table-row><t:table-cell t:number-columns-repeated="1500"><x:p>v</x:p></t:table-cell></t:table-row></t:table></body></d>'})
    assert of.parse(wide)[1][1][7] == "\t".join(["v"] * 1500)


def test_too_large_a_part_is_an_error(monkeypatch):
    monkeypatch.setattr(of, "LARGEST_PART", 100)
    error, nodes = of.parse(docx())
    assert nodes == [] and "larger than" in error


def test_a_broken_stream_is_an_error_of_its_page():
    from papyra.sources import samples

    error, pages = pdf.parse(samples.pages_pdf())
    assert error.startswith("page 1: content stream") and [p[5] for p in pages] == ["The first page", ""]


def test_registry_precedence(spark):
    import json

    import pytest

    from papyra.streaming.streams import shared_folder

    folder = shared_folder(spark, "registry")
    a = fl.put(spark, f"{folder}/a.json", json.dumps({"providers": [{"id": "p", "models": [{"id": "a"}]}]}).encode())
    b = fl.put(spark, f"{folder}/b.json", json.dumps({"providers": [{"id": "p", "models": [{"id": "b"}]}]}).encode())
    assert [r.id for r in fl.first_registry(spark, [None, b, a]).collect()] == ["b"] and [r.id for r in fl.first_registry(spark, ["", f"{folder}/no.json", a]).collect()] == ["a"]
    with pytest.raises(FileNotFoundError, match="no.json"):
        fl.first_registry(spark, [None, f"{folder}/no.json"])

"""A folder of small real files, one for each reader and each way to fail, for queries and tests of sources."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession

from papyra.sources import files as fl
from papyra.streaming.streams import shared_folder

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(parts: dict[str, str]) -> bytes:
    """A ZIP of parts, of equal bytes each time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _relations(**targets: tuple[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="{_REL}/{kind}" Target="{to}"/>' for k, (kind, to) in targets.items()) + "</Relationships>"


def report_docx() -> bytes:
    def p(text: str, style: str = "") -> str:
        return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'

    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in (("crop", "tons"), ("rye", "12"))) + "</w:tbl>"
    body = p("Harvest", "Heading1") + p("Rye was early &amp; good.") + f"<w:sdt><w:sdtContent>{p('A note in a control.')}</w:sdtContent></w:sdt>" + table
    core = '<c xmlns:dc="dc" xmlns:cp="cp" xmlns:t="t"><dc:title>Harvest report</dc:title><dc:creator>A. Farmer</dc:creator><cp:keywords>rye, oats</cp:keywords><cp:revision>3</cp:revision><t:created>2024-08-01T06:30:00Z</t:created></c>'
    return archive({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "docProps/core.xml": core})


def talk_pptx() -> bytes:
    slide = '<p:sld xmlns:p="p" xmlns:a="a">{}<a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    return archive({
        "ppt/presentation.xml": f'<p {_R}><sldIdLst><sldId r:id="r9"/><sldId r:id="r2"/><sldId r:id="r3"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": _relations(r9=("slide", "slides/slide2.xml"), r2=("slide", "slides/slide1.xml"), r3=("slide", "slides/slide3.xml")),
        "ppt/slides/slide1.xml": slide.format("", "Second"),
        "ppt/slides/slide2.xml": slide.format("<p:pic/>", "First"),
        "ppt/slides/slide3.xml": "<broken",
        "ppt/slides/_rels/slide2.xml.rels": _relations(n=("notesSlide", "../notesSlides/notesSlide7.xml")),
        "ppt/notesSlides/notesSlide7.xml": '<n xmlns:a="a"><a:p><a:r><a:t>Say hello</a:t></a:r></a:p></n>',
    })


def stock_xlsx() -> bytes:
    sheet = "<worksheet><sheetData><row>{}</row></sheetData></worksheet>"
    return archive({
        "xl/workbook.xml": f'<workbook {_R}><sheets><sheet name="Later" r:id="b"/><sheet name="Sooner" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(a=("worksheet", "worksheets/sheet1.xml"), b=("worksheet", "worksheets/sheet2.xml")),
        "xl/sharedStrings.xml": "<sst><si><t>goats</t></si></sst>",
        "xl/worksheets/sheet1.xml": sheet.format('<c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.5</v></c>'),
        "xl/worksheets/sheet2.xml": sheet.format('<c r="A1" t="b"><v>1</v></c>'),
    })


def list_ods() -> bytes:
    row = '<t:table-row><t:table-cell t:number-columns-repeated="3"/><t:table-cell t:number-columns-repeated="2"><x:p>hen</x:p></t:table-cell><t:table-cell t:number-columns-repeated="16000"/></t:table-row>'
    return archive({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f'<d xmlns:t="t" xmlns:x="x"><body><t:table t:name="Coop">{row}</t:table></body></d>'})


def pages_pdf() -> bytes:
    good = zlib.compress(b"BT (The first page) Tj ET /Im1 Do")
    objects = [
        b"<< /Type /Page /MediaBox [0 0 200 100] /Contents 3 0 R >>", b"<< /Type /Page /MediaBox [0 0 100 200] /Rotate 90 /Contents 4 0 R >>",
        b"<< /Filter /FlateDecode >> stream\n" + good + b"\nendstream", b"<< /Filter /FlateDecode >> stream\nno data\nendstream",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (i + 1, x) for i, x in enumerate(objects)) + b"%%EOF"


PAGE_HTML = b"""<!DOCTYPE html><html lang="fr-CH"><head><title> The yard </title><style>p{}</style></head><body><nav>Home</nav><article><h1>Hens</h1><p>Six hens &amp; a <b>cock</b>.</p><ul><li>one</li><li>two</li></ul><img src="hen.png" alt="a hen"><table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td>2</td></tr></table></article><footer>Bye</footer><script>var x = '<p>';</script></body></html>"""
DRAWING_SVG = b'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 360"></svg>'
#: name to content, read in this order.
FILES: dict[str, bytes] = {
    "broken.docx": b"PK\x03\x04 cut short",
    "drawing.svg": DRAWING_SVG,
    "empty.pdf": b"",
    "list.ods": list_ods(),
    "notes.txt": b"no office file",
    "page.html": PAGE_HTML,
    "pages.pdf": pages_pdf(),
    "report.docx": report_docx(),
    "stock.xlsx": stock_xlsx(),
    "talk.pptx": talk_pptx(),
}


def as_rows(spark: SparkSession, *endings: str) -> DataFrame:
    """path, content of the samples, or of those with one of these endings."""
    return fl.from_bytes(spark, [(k, v) for k, v in FILES.items() if not endings or k.endswith(endings)])


def as_folder(spark: SparkSession) -> str:
    """The samples as files of a new folder that all executors share."""
    folder = shared_folder(spark, "samples")
    for name, content in FILES.items():
        fl.put(spark, f"{folder}/{name}", content)
    return folder


MIME = {".html": "text/html; charset=utf-8", ".pdf": "application/pdf", ".svg": "image/svg+xml", ".txt": "text/plain", ".docx": "application/octet-stream"}


def as_urls(spark: SparkSession) -> DataFrame:
    """path: data URLs of the samples, with the type a server would name, and one URL that can't be fetched."""
    urls = [f"data:{MIME.get(k[k.rfind('.'):], 'application/zip')};base64,{base64.b64encode(v).decode()}" for k, v in FILES.items()]
    return spark.createDataFrame([(u,) for u in [*urls, "data:broken"]], "path string")

"""Queries of readers over the sample files; their SQL states, as constants, what is in them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.lookup import get_extension, look_up
from papyra.plans.registry import Catalog
from papyra.sources import files as fl
from papyra.sources import html as ht
from papyra.sources import images as im
from papyra.sources import office as of
from papyra.sources import pdf, samples
from papyra.streaming.streams import shared_folder

catalog = Catalog()


def _values(columns: str, rows: list[tuple]) -> str:
    """A table of constants."""

    def one(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({columns})"


def _name():
    return F.regexp_extract("path", r"([^/]*)$", 1).alias("name")


@catalog.add("src_file", _values("name, length", [(k, len(v)) for k, v in samples.FILES.items() if v]))
def src_file(t):
    return fl.read_files(t.spark, samples.as_folder(t.spark)).select(_name(), "length")


@catalog.add("src_dir", _values("name", [("broken.docx",), ("drawing.svg",), ("list.ods",), ("pages.pdf",), ("report.docx",), ("stock.xlsx",), ("talk.pptx",)]))
def src_dir(t):
    """Files of known extension that have no output yet: web pages are done here."""
    folder = samples.as_folder(t.spark)
    return fl.read_new(t.spark, folder, fl.read_files(t.spark, folder, "*.html")).select(_name())


@catalog.add("src_image_guard", _values("path, accepted, width", [("drawing.svg", True, 640), ("notes.txt", False, None), ("page.html", False, None)]))
def src_image_guard(t):
    """An image is accepted where its ending says so, it is no larger than allowed and its size can be read."""
    named = look_up(fixed.EXTENSION_FORMAT, get_extension(F.col("path"))) == "image"
    sized = im.with_size(samples.as_rows(t.spark, ".svg", ".txt", ".html"))
    return sized.select("path", F.coalesce(named & (F.length("content") <= fixed.MAX_IMAGE_BYTES) & F.col("width").isNotNull(), F.lit(False)).alias("accepted"), "width")


@catalog.add("src_batch", _values("path, pages, error", [("empty.pdf", 0, "not a PDF file"), ("notes.txt", 0, "not a PDF file"), ("pages.pdf", 2, None)]))
def src_batch(t):
    """Several files at once, task slots side by side; a file that fails doesn't stop the others."""
    return pdf.parse_files(samples.as_rows(t.spark, ".pdf", ".txt")).groupBy("path").agg(F.count("page_index").alias("pages"), F.max(F.when(F.col("page_index").isNull(), F.col("error"))).alias("error"))


# --- URLs ----------------------------------------------------------------------------------------


def _fetched(t):
    return fl.route(fl.fetch(samples.as_urls(t.spark)))


_ROUTES = {"broken.docx": "docx", "drawing.svg": "image", "empty.pdf": "pdf", "list.ods": "docx", "notes.txt": None, "page.html": "html", "pages.pdf": "pdf", "report.docx": "docx", "stock.xlsx": "docx", "talk.pptx": "docx"}


@catalog.add("src_url", _values("format, bytes, failed", [*[(_ROUTES[k], len(v), False) for k, v in samples.FILES.items()], (None, None, True)]))
def src_url(t):
    """Each URL fetched and routed by the type the server names, else by its first bytes."""
    return _fetched(t).select("format", F.length("content").alias("bytes"), F.col("error").isNotNull().alias("failed"))


@catalog.add("src_url_pdf", _values("page_index, width_pt, rotation_deg, text, failed", [(0, 200.0, 0, "The first page", False), (1, 100.0, 90, "", True), (None, None, None, None, True)]))
def src_url_pdf(t):
    pages = pdf.parse_files(_fetched(t).where("format = 'pdf'"))
    return pages.select("page_index", "width_pt", "rotation_deg", "text", F.col("error").isNotNull().alias("failed"))


@catalog.add("src_url_office", _values("type, n", [("error", 1), ("heading", 1), ("image", 1), ("note", 1), ("paragraph", 4), ("row", 5), ("section", 1), ("sheet", 3), ("slide", 3), ("table", 1), ("unreadable", 1)]))
def src_url_office(t):
    nodes = of.parse_files(_fetched(t).where("format = 'docx'"))
    return nodes.groupBy(F.coalesce("type", F.lit("unreadable")).alias("type")).agg(F.count("*").alias("n"))


@catalog.add("src_url_html", _values("title, language", [("The yard", "fr")]))
def src_url_html(t):
    h = F.col("content").cast("string")
    return _fetched(t).where("format = 'html'").select(ht.title_of(h).alias("title"), ht.language_of(h).alias("language"))


@catalog.add("src_url_image", _values("width, height", [(640, 360)]))
def src_url_image(t):
    return im.with_size(_fetched(t).where("format = 'image'").select("path", "content")).select("width", "height")


# --- office files --------------------------------------------------------------------------------

_PARSED = [
    ("list.ods", 0, "Coop", 0, None, 0, "sheet", None), ("list.ods", 0, "Coop", 1, 0, 1, "row", "\t\t\then\then"),
    ("report.docx", 0, "Section 1", 0, None, 0, "section", None), ("report.docx", 0, "Section 1", 1, 0, 1, "heading", "Harvest"), ("report.docx", 0, "Section 1", 2, 0, 1, "paragraph", "Rye was early & good."),
    ("report.docx", 0, "Section 1", 3, 0, 1, "paragraph", "A note in a control."), ("report.docx", 0, "Section 1", 4, 0, 1, "table", ""), ("report.docx", 0, "Section 1", 5, 4, 2, "row", "crop\ttons"), ("report.docx", 0, "Section 1", 6, 4, 2, "row", "rye\t12"),
    ("stock.xlsx", 0, "Later", 0, None, 0, "sheet", None), ("stock.xlsx", 0, "Later", 1, 0, 1, "row", "true"), ("stock.xlsx", 1, "Sooner", 2, None, 0, "sheet", None), ("stock.xlsx", 1, "Sooner", 3, 2, 1, "row", "goats\t\t3.5"),
    ("talk.pptx", 0, "Slide 1", 0, None, 0, "slide", None), ("talk.pptx", 0, "Slide 1", 1, 0, 1, "image", ""), ("talk.pptx", 0, "Slide 1", 2, 0, 1, "paragraph", "First"), ("talk.pptx", 0, "Slide 1", 3, 0, 1, "note", "Say hello"),
    ("talk.pptx", 1, "Slide 2", 4, None, 0, "slide", None), ("talk.pptx", 1, "Slide 2", 5, 4, 1, "paragraph", "Second"), ("talk.pptx", 2, "Slide 3", 6, None, 0, "slide", None), ("talk.pptx", 2, "Slide 3", 7, 6, 1, "error", "ParseError: unclosed token: line 1, column 0"),
]


def _nodes(t):
    return of.parse_files(samples.as_rows(t.spark, ".docx", ".pptx", ".xlsx", ".ods", ".txt"))


@catalog.add("parse_office", _values("path, unit_index, unit_name, preorder, parent_id, depth, type, text", _PARSED))
def parse_office(t):
    """Units in the order the file lists them, not by their numbers; notes by relation; depth and parents of nodes."""
    return _nodes(t).where("error is null").select("path", "unit_index", "unit_name", "preorder", "parent_id", "depth", "type", "text")


@catalog.add("load_office", _values("path, text", [("list.ods", "\t\t\then\then"), ("report.docx", "Harvest\nRye was early & good.\nA note in a control.\ncrop\ttons\nrye\t12"), ("stock.xlsx", "true\n\ngoats\t\t3.5"), ("talk.pptx", "First\n[Speaker Notes] Say hello\n\nSecond")]))
def load_office(t):
    return of.file_text(_nodes(t).where("type is null or type <> 'error'"))


@catalog.add("detailed", _values("path, units, nodes, images, notes, errors", [("broken.docx", 0, 0, 0, 0, 1), ("list.ods", 1, 1, 0, 0, 0), ("notes.txt", 0, 0, 0, 0, 1), ("report.docx", 1, 6, 0, 0, 0), ("stock.xlsx", 2, 2, 0, 0, 0), ("talk.pptx", 3, 5, 1, 1, 1)]))
def detailed(t):
    """One row for each file, with what could not be read of it."""
    count = {"units": F.col("depth") == 0, "nodes": F.col("depth") > 0, "images": F.col("type") == "image", "notes": F.col("type") == "note", "errors": F.col("error").isNotNull() | (F.col("type") == "error")}
    return _nodes(t).groupBy("path").agg(*[F.count_if(x).alias(k) for k, x in count.items()])


@catalog.add("strict", _values("path, whole", [("broken.docx", False), ("list.ods", True), ("notes.txt", False), ("report.docx", True), ("stock.xlsx", True), ("talk.pptx", False)]))
def strict(t):
    """A file is whole only where every one of its units could be read."""
    return _nodes(t).groupBy("path").agg((~F.coalesce(F.max(F.col("error").isNotNull() | (F.col("type") == "error")), F.lit(False))).alias("whole"))


_NO = (None,) * 7


@catalog.add("doc_metadata", _values("path, author, title, subject, keywords, created, modified, last_modified_by, revision", [("broken.docx", None, *_NO), ("list.ods", None, *_NO), ("report.docx", "A. Farmer", "Harvest report", None, "rye, oats", "2024-08-01 06:30:00", None, None, "3")]))
def doc_metadata(t):
    m = of.with_metadata(samples.as_rows(t.spark, ".docx", ".ods"))
    return m.withColumns({k: F.date_format(k, "yyyy-MM-dd HH:mm:ss") for k in ("created", "modified")})


# --- web page, registry --------------------------------------------------------------------------

_MARKDOWN = "# Hens\n\nSix hens & a **cock**.\n\n- one\n- two\n\n![a hen](hen.png)\n\n| k | v |\n| --- | --- |\n| a\\|b | 2 |"


@catalog.add("html_text", _values("path, title, language, images, tables, markdown", [("page.html", "The yard", "fr", 1, 1, _MARKDOWN)]))
def html_text(t):
    """A page's article as Markdown, without navigation, scripts and footer."""
    h = F.col("content").cast("string")
    p = samples.as_rows(t.spark, ".html").select("path", h.alias("html"))
    h = F.col("html")
    return p.select("path", ht.title_of(h).alias("title"), ht.language_of(h).alias("language"), ht.count_elements(h, "img").alias("images"), ht.count_elements(h, "table").alias("tables"), ht.markdown("html").alias("markdown"))


_REGISTRY = {"providers": [
    {"id": "north", "models": [{"id": "n-1", "aliases": ["n"], "contextWindow": 1000, "pricing": {"input": 1.0, "output": 2.0}}, {"id": "", "pricing": {"input": 1.0, "output": 1.0}}]},
    {"id": "south", "models": [{"id": "s-1", "pricing": {"input": -1.0, "output": 2.0}}, {"id": "s-2"}, {"id": "s-3", "contextWindow": 0, "pricing": {"input": 0.0, "output": 0.0}}]},
]}


@catalog.add("load_registry", _values("ordinal, provider, id, problem", [(0, "north", "n-1", None), (1, "north", "", "model without id"), (10000, "south", "s-1", "negative price"), (10001, "south", "s-2", "model without price"), (10002, "south", "s-3", "context window is not positive")]))
def load_registry(t):
    """The first registry file that is there, of the named one, the setting's and the default; each model with what is wrong with it."""
    folder = shared_folder(t.spark, "registry")
    there = fl.put(t.spark, f"{folder}/models.json", json.dumps(_REGISTRY).encode())
    return fl.first_registry(t.spark, [None, f"{folder}/absent.json", there]).select("ordinal", "provider", "id", fl.registry_problem().alias("problem"))

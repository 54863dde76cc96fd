"""Office files (OOXML and ODF): ZIP archives of XML, read with the standard library into flattened nodes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file with a part that unpacks to more is refused with an error: one part is one task's memory.
LARGEST_PART = 256 * 1024 * 1024
#: Fixed value: the columns a sheet can have.
MOST_COLUMNS = 16384
NODES = "path string, error string, unit_index int, unit_name string, node_id int, parent_id int, preorder int, depth int, type string, text string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _text(e: ElementTree.Element) -> str:
    out = []
    for x in e.iter():
        name = _local(x.tag)
        if name in ("t", "span", "a", "p", "h") and x.text:
            out.append(x.text)
        elif name in ("tab", "s"):
            out.append(" ")
        elif name in ("br", "line-break"):
            out.append("\n")
        if x is not e and x.tail and name in ("span", "a", "s", "tab", "line-break"):
            out.append(x.tail)
    return "".join(out)


def _blocks(body: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables, also those within content controls and tracked insertions."""
    for e in body:
        if _local(e.tag) in ("p", "tbl"):
            yield e
        elif _local(e.tag) in ("sdt", "sdtContent", "customXml", "ins"):
            yield from _blocks(e)


def _number(name: str) -> int:
    m = re.search(r"(\d+)\.xml$", name)
    return int(m.group(1)) if m else 0


def _rows(z: zipfile.ZipFile, kind: str) -> Iterator[tuple[int, str, int, str, str]]:
    """(unit, unit name, depth, type, text) in walking order."""
    names = set(z.namelist())

    def tree(name: str) -> ElementTree.Element | None:
        if name not in names:
            return None
        if z.getinfo(name).file_size > LARGEST_PART:
            raise ValueError(f"{name} is larger than {LARGEST_PART} bytes")
        return ElementTree.fromstring(z.read(name))

    def part(name: str) -> tuple[ElementTree.Element | None, str | None]:
        """A unit's own part, or what is wrong with it: the other units are read all the same."""
        try:
            return tree(name), None
        except (ElementTree.ParseError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"[:200]

    def relations(name: str) -> dict[str, tuple[str, str]]:
        """(kind, target part) by id of what a part refers to."""
        folder, _, file = name.rpartition("/")
        rels = tree(f"{folder}/_rels/{file}.rels")
        out = {}
        for r in [] if rels is None else rels:
            target = r.get("Target") or ""
            where = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id") or ""] = ((r.get("Type") or "").rsplit("/", 1)[-1], where)
        return out

    def ordered(index: str, element: str, pattern: str) -> list[tuple[str, str]]:
        """(part, name) of the units in the order the index lists them; by number where it refers to none."""
        top, rels = tree(index), relations(index)
        listed = [] if top is None else [x for x in top.iter() if _local(x.tag) == element]
        found = [(rels[r][1], _attribute(x, "name") or "") for x in listed for r in [next((v for k, v in x.attrib.items() if k.endswith("}id")), "")] if r in rels]
        numbered = sorted((n for n in names if re.fullmatch(pattern, n)), key=_number)
        titles = [_attribute(x, "name") or "" for x in listed]
        return found or [(n, titles[i] if i < len(titles) else "") for i, n in enumerate(numbered)]

    if kind == "docx":
        body = tree("word/document.xml")
        for e in [] if body is None else _blocks(next((x for x in body if _local(x.tag) == "body"), body)):
            name = _local(e.tag)
            if name == "p":
                style = next((_attribute(x, "val") for x in e.iter() if _local(x.tag) == "pStyle"), "") or ""
                if any(_local(x.tag) in ("drawing", "pict") for x in e.iter()):
                    yield 0, "Section 1", 1, "image", ""
                yield 0, "Section 1", 1, "heading" if style.lower().startswith(("heading", "title")) else "paragraph", _text(e)
            elif name == "tbl":
                yield 0, "Section 1", 1, "table", ""
                for row in (x for x in e if _local(x.tag) == "tr"):
                    yield 0, "Section 1", 2, "row", "\t".join(_text(c).strip() for c in row if _local(c.tag) == "tc")
    elif kind == "pptx":
        for i, (place, _) in enumerate(ordered("ppt/presentation.xml", "sldId", r"ppt/slides/slide\d+\.xml")):
            slide, wrong = part(place)
            if wrong:
                yield i, f"Slide {i + 1}", 1, "error", wrong
            for e in [] if slide is None else slide.iter():
                if _local(e.tag) == "pic":
                    yield i, f"Slide {i + 1}", 1, "image", ""
                elif _local(e.tag) == "p" and (t := _text(e)).strip():
                    yield i, f"Slide {i + 1}", 1, "paragraph", t
            of_slide = [where for kind_, where in relations(place).values() if kind_ == "notesSlide"]
            notes, _ = part(of_slide[0] if of_slide else f"ppt/notesSlides/notesSlide{_number(place)}.xml")
            for e in [] if notes is None else notes.iter():
                if _local(e.tag) == "p" and (t := _text(e)).strip():
                    yield i, f"Slide {i + 1}", 1, "note", t
    elif kind == "xlsx":
        shared = tree("xl/sharedStrings.xml")
        strings = [] if shared is None else [_text(x) for x in shared if _local(x.tag) == "si"]
        for i, (place, title) in enumerate(ordered("xl/workbook.xml", "sheet", r"xl/worksheets/sheet\d+\.xml")):
            sheet, wrong = part(place)
            title = title or f"Sheet {i + 1}"
            if wrong:
                yield i, title, 1, "error", wrong
            for row in [] if sheet is None else (x for x in sheet.iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for c in (x for x in row if _local(x.tag) == "c"):
                    column = 0
                    for ch in re.sub(r"\d", "", _attribute(c, "r") or ""):
                        column = column * 26 + ord(ch) - 64
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind_ = _attribute(c, "t")
                    if kind_ == "s" and value.isdigit() and int(value) < len(strings):
                        value = strings[int(value)]
                    elif kind_ == "inlineStr":
                        value = _text(c)
                    elif kind_ == "b":
                        value = "true" if value == "1" else "false"
                    cells[column or len(cells) + 1] = value
                yield i, title, 1, "row", "\t".join(cells.get(k, "") for k in range(1, max(cells, default=0) + 1))
    else:
        content = tree("content.xml")
        body = None if content is None else next((x for x in content if _local(x.tag) == "body"), content)
        unit, title = (0, "Section 1") if kind == "odt" else (-1, "")
        for e in [] if body is None else body.iter():
            name = _local(e.tag)
            if kind == "odp" and name == "page" or kind == "ods" and name == "table":
                unit, title = unit + 1, _attribute(e, "name") or f"Unit {unit + 2}"
            elif unit < 0:
                continue
            elif kind == "ods" and name == "table-row":
                cells_, gap = [], 0
                for c in (x for x in e if _local(x.tag) in ("table-cell", "covered-table-cell")):
                    n, t = min(int(_attribute(c, "number-columns-repeated") or 1), MOST_COLUMNS), _text(c)
                    if t:  # empty cells count only before others
                        cells_ += [""] * gap + [t] * n
                        gap = 0
                    else:
                        gap += n
                if cells_:
                    yield unit, title, 1, "row", "\t".join(cells_)
            elif kind != "ods" and name in ("p", "h") and (t := _text(e)).strip():
                yield unit, title, 1, "heading" if name == "h" else "paragraph", t
            elif kind != "ods" and name == "image":
                yield unit, title, 1, "image", ""


def kind_of(z: zipfile.ZipFile) -> str | None:
    """The format by what the archive holds."""
    names = set(z.namelist())
    for part, kind in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx")):
        if part in names:
            return kind
    if "mimetype" in names:
        mime = z.read("mimetype").decode("ascii", "replace")
        return {"text": "odt", "presentation": "odp", "spreadsheet": "ods"}.get(mime.rsplit(".", 1)[-1].strip())
    return None


#: The element that holds each field, in both families of formats.
METADATA = {
    "author": ("creator", "initial-creator"), "title": ("title",), "subject": ("subject",), "keywords": ("keywords", "keyword"), "created": ("created", "creation-date"),
    "modified": ("modified", "date"), "last_modified_by": ("lastModifiedBy",), "revision": ("revision", "editing-cycles"),
}


def metadata(content: bytes | None) -> dict[str, str | None]:
    """The eight fields of a file's properties; all null where it has none or can't be read."""
    found: dict[str, str] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            for name in ("docProps/core.xml", "meta.xml"):
                if name in z.namelist() and z.getinfo(name).file_size <= LARGEST_PART:
                    for e in ElementTree.fromstring(z.read(name)).iter():
                        if e.text and e.text.strip():
                            found.setdefault(_local(e.tag), e.text.strip())
    except (zipfile.BadZipFile, ElementTree.ParseError, OSError, RuntimeError):
        pass
    return {k: next((found[n] for n in names if n in found), None) for k, names in METADATA.items()}


def with_metadata(files: DataFrame) -> DataFrame:
    """path and the eight fields of every file, times as timestamps."""

    @F.pandas_udf(", ".join(f"{k} string" for k in METADATA))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([metadata(x) for x in b], columns=list(METADATA))

    m = files.select("path", read("content").alias("m")).select("path", "m.*")
    return m.withColumns({k: F.try_to_timestamp(k) for k in ("created", "modified")})


def parse(content: bytes | None) -> tuple[str | None, list[tuple]]:
    """(error, nodes) of a file; content without ZIP magic is refused."""
    if not content or content[:4] != b"PK\x03\x04":
        return "not a ZIP archive", []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            kind = kind_of(z)
            if kind is None:
                return "unknown kind of archive", []
            out: list[tuple] = []
            last: int | None = None
            above: list[int] = []  # the last node of each depth, down to the one before
            for unit, title, depth, type_, text in _rows(z, kind):
                if unit != last:
                    above = [len(out)]
                    out.append((unit, title, above[0], None, above[0], 0, "slide" if kind in ("pptx", "odp") else "sheet" if kind in ("xlsx", "ods") else "section", None))
                    last = unit
                above = above[:depth]
                out.append((unit, title, len(out), above[-1], len(out), depth, type_, text))
                above.append(len(out) - 1)
            return None, out
    except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError, OSError, KeyError, ValueError) as e:
        return f"{type(e).__name__}: {e}"[:200], []


def parse_files(files: DataFrame) -> DataFrame:
    """Nodes of every file (path, content); a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                error, nodes = parse(content)
                rows += [(path, None, *n) for n in nodes] or [(path, error or "no units", *[None] * 8)]
            out = pd.DataFrame(rows, columns=names)
            for k in ("unit_index", "node_id", "parent_id", "preorder", "depth"):
                out[k] = out[k].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, NODES)


def file_text(nodes: DataFrame) -> DataFrame:
    """path, text of every file: units by blank lines; rows and paragraphs by line ends, notes under their own title."""
    note = F.when(F.col("type") == "note", F.concat(F.lit("[Speaker Notes] "), F.col("text"))).otherwise(F.col("text"))
    g = nodes.where("error is null and length(text) > 0").groupBy("path", "unit_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("preorder", note.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return g.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))

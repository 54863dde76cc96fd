"""PDF files with plain structure: pages and the text of their Flate or uncompressed content streams.

Without a PDF library this covers simple encodings only: literal and hexadecimal strings shown by Tj, TJ,
' and ". Encrypted files, object streams with pages and embedded-font encodings give an error or no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "path string, error string, page_index int, width_pt double, height_pt double, rotation_deg int, image_op_count int, text string"

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\[((?:\\.|[^\]])*)\]\s*TJ|\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")|<([0-9A-Fa-f\s]*)>\s*Tj|(T\*|(?:TD|Td|ET)\b)", re.S)
_PIECE = re.compile(rb"\(((?:\\.|[^()\\])*)\)|<([0-9A-Fa-f\s]*)>|(-?\d+(?:\.\d+)?)", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(x: bytes) -> str:
    def one(m: re.Match[bytes]) -> bytes:
        c = m.group(1)
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _PLAIN.get(c, b"" if c[-1:] == b"\n" else c)

    return _decode(_ESCAPE.sub(one, x))


def _decode(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _hex(x: bytes) -> str:
    digits = re.sub(rb"\s", b"", x)
    return _decode(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))


def content_text(stream: bytes) -> str:
    """Text in the order it is shown; a line end for each move to another line."""
    out: list[str] = []
    for m in _SHOW.finditer(stream):
        if m.group(1) is not None:
            for p in _PIECE.finditer(m.group(1)):
                out.append(_literal(p.group(1)) if p.group(1) is not None else _hex(p.group(2)) if p.group(2) is not None else " " if float(p.group(3)) < -200 else "")
        elif m.group(2) is not None:
            out.append(_literal(m.group(2)))
        elif m.group(3) is not None:
            out.append(_hex(m.group(3)))
        else:
            out.append("\n")
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def _data(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m.group(1))
        except zlib.error as e:
            raise ValueError(f"content stream: {e}") from e
    return m.group(1)


def parse(content: bytes | None) -> tuple[str | None, list[tuple[int, float, float, int, int, str]]]:
    """(error, pages)."""
    if not content or content[:5] != b"%PDF-":
        return "not a PDF file", []
    if b"/Encrypt" in content:
        return "encrypted", []
    objects = {int(m.group(1)): m.group(3) for m in _OBJECT.finditer(content)}
    pages = [(n, b) for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    boxes = re.search(rb"/MediaBox\s*\[([^\]]*)\]", content)
    out, broken = [], {}
    for i, (_, b) in enumerate(pages):
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", b) or boxes
        x = [float(v) for v in re.findall(rb"-?\d+(?:\.\d+)?", box.group(1))] if box else [0, 0, 612, 792]
        turn = re.search(rb"/Rotate\s+(-?\d+)", b)
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", b)
        try:
            stream = b"\n".join(_data(objects.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1))) if refs else b""
        except ValueError as e:
            broken[i] = str(e)
            stream = b""
        out.append((i, abs(x[2] - x[0]), abs(x[3] - x[1]), int(turn.group(1)) % 360 if turn else 0, len(re.findall(rb"/\w+\s+Do\b", stream)), content_text(stream)))
    if out and len(broken) == len(out):
        return next(iter(broken.values())), []
    return ("; ".join(f"page {i}: {x}" for i, x in broken.items()) or None, out) if out else ("no readable pages", [])


def parse_files(files: DataFrame) -> DataFrame:
    """Pages of every file (path, content); a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                error, pages = parse(content)
                rows += [(path, error if error and f"page {p[0]}:" in error else None, *p) for p in pages] or [(path, error, None, None, None, None, None, None)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])
            for k in ("page_index", "rotation_deg", "image_op_count"):
                out[k] = out[k].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, PAGES)

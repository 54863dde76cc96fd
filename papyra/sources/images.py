"""Image size from header bytes, as columns: png, gif, webp (VP8X, VP8L, VP8) and svg; jpeg by one scan in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.lookup import format_of_image

SIZE = "struct<width:int,height:int>"


def _int(content: Column, start: int, length: int, little: bool = False) -> Column:
    """Unsigned number of bytes from a 1-based position."""
    part = F.substring(content, start, length)
    return F.conv(F.hex(F.reverse(part) if False else part), 16, 10).cast("int") if not little else sum((F.conv(F.hex(F.substring(content, start + i, 1)), 16, 10).cast("int") * (1 << 8 * i) for i in range(length)), F.lit(0))


def jpeg_size(content: bytes) -> tuple[int, int] | None:
    i = 2
    while i + 9 < len(content):
        if content[i] != 0xFF:
            i += 1
            continue
        marker = content[i + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[i + 7 : i + 9], "big"), int.from_bytes(content[i + 5 : i + 7], "big")
        i += 2 if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD9 else 2 + int.from_bytes(content[i + 2 : i + 4], "big")
    return None


def with_size(files: DataFrame) -> DataFrame:
    """files (with content) plus format, width and height; null where the header doesn't say."""

    @F.pandas_udf(SIZE)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([jpeg_size(x) or (None, None) for x in b], columns=["width", "height"]).astype("Int32")

    c = F.col("content")
    typed = files.withColumn("format", format_of_image(c))
    jpeg = typed.where("format = 'jpg'").withColumn("__s", scan("content")).select(*typed.columns, "__s.width", "__s.height")
    head = F.decode(F.substring(c, 1, 2000), "UTF-8")

    def svg(name: str, place: int) -> Column:
        own = F.nullif(F.regexp_extract(head, rf"(?s)<svg[^>]*\b{name}\s*=\s*[\"']([0-9.]+)", 1), F.lit(""))
        box = F.nullif(F.regexp_extract(head, rf"(?s)<svg[^>]*\bviewBox\s*=\s*[\"']\s*(?:[-0-9.]+[\s,]+){{{place}}}([0-9.]+)", 1), F.lit(""))
        return F.coalesce(own, box).cast("double").cast("int")

    fmt = F.col("format")
    kind = F.decode(F.substring(c, 13, 4), "ISO-8859-1")
    width = F.when(fmt == "png", _int(c, 17, 4)).when(fmt == "gif", _int(c, 7, 2, True)).when((fmt == "webp") & (kind == "VP8X"), _int(c, 25, 3, True) + 1).when((fmt == "webp") & (kind == "VP8 "), _int(c, 27, 2, True)).when(fmt == "svg", svg("width", 2))
    height = F.when(fmt == "png", _int(c, 21, 4)).when(fmt == "gif", _int(c, 9, 2, True)).when((fmt == "webp") & (kind == "VP8X"), _int(c, 28, 3, True) + 1).when((fmt == "webp") & (kind == "VP8 "), _int(c, 29, 2, True)).when(fmt == "svg", svg("height", 3))
    rest = typed.where("format is null or format <> 'jpg'").select(*typed.columns, width.alias("width"), height.alias("height"))
    return jpeg.unionByName(rest)

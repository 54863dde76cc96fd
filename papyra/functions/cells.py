"""Cells, sheets and their text forms. A sheet is an array of rows, a row an array of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import trim_ws

#: Fixed value: text that a number prints as.
NUMBER = r"^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)[.][0-9]*[1-9])$"


def cell_type(text: Column) -> Column:
    """number, boolean, string or null, by what the text looks like; 007 and 1.0 stay strings."""
    x = F.coalesce(text, F.lit(""))
    return F.when(trim_ws(x) == "", "null").when(x.rlike(NUMBER), "number").when(x.isin("true", "false"), "boolean").otherwise("string")


def csv_cell(cell: Column, delimiter: str = ",") -> Column:
    """Quoted only where it holds the delimiter, a quote or a line end; null is empty."""
    x = F.coalesce(cell, F.lit(""))
    must = F.contains(x, F.lit(delimiter)) | x.rlike('["\n\r]')
    return F.when(must, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def sheet_csv(rows: Column, delimiter: str = ",", line_end: str = "\n") -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: csv_cell(c, delimiter)), delimiter)), line_end)


def text_csv(text: Column, is_sheet: Column, delimiter: str = ",") -> Column:
    lines = F.split(text, "\r?\n")
    sheet = F.transform(lines, lambda x: F.array_join(F.transform(F.split(x, "\t"), lambda c: csv_cell(c, delimiter)), delimiter))
    return F.array_join(F.when(is_sheet, sheet).otherwise(F.transform(lines, lambda x: csv_cell(x, delimiter))), "\n")


def tsv_cell(cell: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("\t"), F.lit(" ")), "\r\n|\n|\r", r"\\n")


def sheet_tsv(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, tsv_cell), "\t")), "\n")


def text_tsv(text: Column, is_sheet: Column) -> Column:
    return F.when(is_sheet, text).otherwise(F.array_join(F.transform(F.split(text, "\r?\n"), tsv_cell), "\n"))


def markdown_cell(cell: Column) -> Column:
    return trim_ws(F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def sheet_markdown(rows: Column, headers: bool = True, align: str = ":---") -> Column:
    """A table: header row (or Column i), alignment row, rows padded to the widest; the header isn't padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    has = (F.size(rows) > 1) & F.lit(headers)
    head = F.when(has, F.transform(rows[0], markdown_cell)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), width)), lambda i: F.concat(F.lit("Column "), i.cast("string"))))
    body = F.when(has, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows)
    padded = F.transform(body, lambda r: line(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), width) - 1), lambda i: markdown_cell(F.get(r, i)))))
    table = F.concat(F.array(line(head), line(F.array_repeat(F.lit(align), F.greatest(F.lit(1), width)))), padded)
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(table, "\n"))


def sheet_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " ")), "\n")


def sheet_objects(rows: Column) -> Column:
    """JSON array of objects named by the first row; a missing cell is null, a null header column_i."""
    names = F.transform(rows[0], lambda c, i: F.coalesce(c, F.concat(F.lit("column_"), i.cast("string"))))
    objects = F.transform(F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1)), lambda r: F.map_from_arrays(names, F.transform(names, lambda _, i: F.get(r, i))))
    return F.to_json(objects, {"ignoreNullFields": "false"})


def doc_markdown(title: Column, author: Column, created: Column, text: Column, errors: Column) -> Column:
    """Title, line of metadata, rule, text and a note on errors, each only where there is something to say."""
    meta = F.nullif(F.concat_ws(" | ", F.concat(F.lit("**Author:** "), author), F.concat(F.lit("**Created:** "), F.date_format(created, "yyyy-MM-dd"))), F.lit(""))
    note = F.when(errors > 0, F.concat(F.lit("\n---\n\n> **Note:** "), errors.cast("string"), F.lit(" error(s) occurred during extraction.")))
    return F.concat_ws("\n", F.concat(F.lit("# "), title, F.lit("\n")), F.concat(meta, F.lit("\n\n---\n")), text, note)


def slide_range(expression: Column, count: Column) -> Column:
    """1-5,7 as sorted distinct indices from 0 within the deck; junk and falling ranges are ignored."""

    def number(x: Column) -> Column:
        return F.nullif(F.regexp_extract(x, r"^\s*(\d+)", 1), F.lit("")).cast("int")

    def one(part: Column) -> Column:
        lo = number(F.substring_index(part, "-", 1))
        hi = F.when(F.contains(part, F.lit("-")), number(F.substring_index(part, "-", -1))).otherwise(lo)
        known = lo.isNotNull() & hi.isNotNull()
        lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, count)
        return F.when(known & (lo <= hi), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(F.split(expression, ","), one), lambda a: F.transform(a, lambda x: x - 1)))))


def sheet_wanted(name: Column, wanted: Column) -> Column:
    return F.array_contains(F.transform(F.split(wanted, ","), lambda x: F.lower(F.trim(x))), F.lower(F.trim(name)))

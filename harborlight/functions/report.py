"""Small results as text: tables, cards, CSV, all within a budget. For the edge, after a plan has been limited."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from itertools import accumulate
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Characters that one token of a language model stands for, on average.
CHARS_PER_TOKEN = 4


def fetched(df: DataFrame, rows: int = 1000) -> tuple[list[str], list[tuple]]:
    """Column names and at most ``rows`` rows."""
    return df.columns, [tuple(r) for r in df.limit(rows).collect()]


def shown(value: object, width: int, breaks: str = "") -> str:
    """One value on one line, at most ``width`` long, without the characters that would end its cell."""
    text = "" if value is None else f"{value:,.2f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)
    text = " ".join(text.split())
    for c in breaks:
        text = text.replace(c, "\\" + c if c == "|" else " ")
    return text if len(text) <= width else text[: max(width - 1, 0)] + "…"


def _more(rows: int, most: int, total: int | None) -> list[str]:
    total = rows if total is None else total
    return [f"({min(rows, most)} of {total} rows)"] if min(rows, most) < total else []


def markdown(columns: list[str], rows: list[tuple], most: int = 20, width: int = 40, total: int | None = None) -> str:
    if not rows or not columns:
        return "(no rows)"
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([shown(v, width, "|") for v in r]) for r in rows[:most]]
    return "\n".join([line(columns), line(["---"] * len(columns)), *body, *_more(len(rows), most, total)])


def compact(columns: list[str], rows: list[tuple], most: int = 500, width: int = 60, total: int | None = None) -> str:
    """One header with the names and the number of rows, then bare comma-separated lines."""
    if not rows or not columns:
        return "(no rows)"
    body = ["  " + ",".join(shown(v, width, ",") for v in r) for r in rows[:most]]
    return "\n".join([f"rows[{len(body)}]{{{','.join(columns)}}}:", *body, *_more(len(rows), most, total)])


def cards(columns: list[str], rows: list[tuple], most: int = 5, width: int = 200, total: int | None = None) -> str:
    """A block of "name: value" lines per row; nulls are left out."""
    if not rows or not columns:
        return "(no rows)"
    blocks = ["\n".join(f"**{c}**: {shown(v, width)}" for c, v in zip(columns, r, strict=True) if v is not None) for r in rows[:most]]
    return "\n\n".join([*blocks, *_more(len(rows), most, total)])


def best(columns: list[str], rows: list[tuple], total: int | None = None) -> str:
    """Cards for a few wide rows, a table for some, the compact form for many."""
    form = cards if len(rows) <= 3 and len(columns) > 4 else markdown if len(rows) <= 20 else compact
    return form(columns, rows, total=total)


def within_budget(rows: list[tuple], tokens: int) -> tuple[list[tuple], int]:
    """(the longest run of first rows that fits as JSON, how many are left out)."""
    sizes = accumulate(len(json.dumps(r, default=str)) + 1 for r in rows)
    keep = sum(s <= tokens * CHARS_PER_TOKEN for s in sizes)
    return rows[:keep], len(rows) - keep


def csv_text(columns: list[str], rows: list[tuple], notes: dict[str, str] | None = None) -> str:
    """CSV with a row number, nulls as empty fields, and notes as comment lines before the header."""
    out = io.StringIO()
    for k, v in (notes or {}).items():
        out.write(f"# {k}: {' '.join(str(v).split())}\n")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["row_id", *columns])
    w.writerows([i, *["" if v is None else v for v in r]] for i, r in enumerate(rows, 1))
    return out.getvalue()


def xlsx_bytes(columns: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: a header row, numbers as numbers, all else as text, nulls as empty cells."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def name(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(value: object, at: str) -> str:
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        text = "".join(c for c in str(value) if c in "\t\n\r" or c >= " ")
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = [f'<row r="{n}">{"".join(cell(v, f"{name(i)}{n}") for i, v in enumerate(r))}</row>' for n, r in enumerate([tuple(columns), *rows], 1)]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, body in parts.items():
            z.writestr(path, head + body)
    return out.getvalue()

"""Small workbooks: report tables, which have a row for each model, as sheets of an .xlsx file, and result tables read from one."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MOST_ROWS = 100_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _name(i: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(columns: list[str], rows) -> str:
    def cell(i, r, v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{_name(i)}{r}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{_name(i)}{r}"><v>{v!r}</v></c>'
        return f'<c r="{_name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = [f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(row))}</row>' for r, row in enumerate([columns, *rows], 1)]
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def write(path: str, sheets: dict[str, DataFrame]) -> None:
    """Writes the driver's file at path. Tables beyond MOST_ROWS belong in Parquet and are refused."""
    read = {}
    for name, df in sheets.items():
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has over {MOST_ROWS} rows")
        read[name] = (df.columns, rows)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(read) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(read, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(read) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for i, (columns, rows) in enumerate(read.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(columns, rows))


def _value(cell, shared: list[str]):
    kind, text = cell.get("t", "n"), cell.findtext(f"{{{_MAIN}}}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{_MAIN}}}t"))
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)]
    return text == "1" if kind == "b" else float(text) if kind == "n" else None if kind == "e" else text


def _place(cell: str) -> int:
    at = 0
    for c in re.match("[A-Z]+", cell)[0]:
        at = 26 * at + ord(c) - 64
    return at - 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, wherever Spark can read it from; its first row names the columns (those without a name stay out).
    A column is of numbers or of truth values if all its cells are, else of text; missing cells and errors are null. Sheets beyond
    MOST_ROWS are refused."""
    whole = spark.read.format("binaryFile").load(path).select("content").first()["content"]  # one small file
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_MAIN}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")]
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f".//{{{_MAIN}}}sheet").get(f"{{{_LINKS}}}id")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[first].lstrip("/")
        sheet = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = [{_place(c.get("r")): _value(c, shared) for c in row.iter(f"{{{_MAIN}}}c")} for row in sheet.iter(f"{{{_MAIN}}}row")]
    if len(rows) > MOST_ROWS + 1:
        raise ValueError(f"{path} has over {MOST_ROWS} rows")
    head = {i: str(n) for i, n in rows[0].items() if n not in (None, "")} if rows else {}
    body = [[row.get(i) for i in head] for row in rows[1:] if any(v is not None for v in row.values())]
    kinds = []
    for j in range(len(head)):
        seen = {type(r[j]) for r in body if r[j] is not None}
        kinds.append(T.DoubleType() if seen == {float} else T.BooleanType() if seen == {bool} else T.StringType())
        if isinstance(kinds[-1], T.StringType):
            for r in body:
                r[j] = None if r[j] is None else str(r[j])
    return spark.createDataFrame(body, T.StructType([T.StructField(n, t) for n, t in zip(head.values(), kinds, strict=True)]))

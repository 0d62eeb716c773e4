"""Workbooks (S2 to S7): cells of .xlsx files as rows, templates filled with values, reports of several sheets.

A workbook is a zip of XML parts and is read or written by one task, as the format allows a sheet a million rows at most; many
files are many tasks.  Cells travel as rows, so everything between reading and writing is relational.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, value string"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"


def _m(tag: str) -> str:
    return f"{{{_MAIN}}}{tag}"


def column_name(col: int) -> str:
    """A for 1, AA for 27."""
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, name of its part), in the workbook's order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(_m("sheets"))
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), part(rels[s.get(f"{{{_LINKS}}}id")])) for s in sheets]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_m("t")))


def _cell_value(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(_m("v"))
    if kind == "inlineStr":
        return _text(cell)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    return {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if kind == "b" else v.text


def _cells_of(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        for name, part in _sheet_parts(book):
            with book.open(part) as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == _m("row"):
                        for cell in node.iter(_m("c")):
                            value = _cell_value(cell, shared)
                            if value is not None:
                                yield name, *_place(cell.get("r")), value
                        node.clear()


def cells(files: DataFrame) -> DataFrame:
    """CELLS of workbooks (path, content): every cell with a value, rows and columns from 1; broken files give none."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for cell in _cells_of(content or b""):
                        rows.append((path, *cell))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError):
                    continue
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, CELLS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CELLS.split(", ")])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return cells(spark.read.format("binaryFile").load(path))


def named_cells(all_cells: DataFrame, sheet: str) -> DataFrame:
    """(path, row_index, name, value) of a sheet's cells under their headings, row_index from 0; columns without one are left out."""
    own = all_cells.where(F.col("sheet") == sheet)
    heads = own.where("row = 1 and trim(value) <> ''").select("path", "col", F.trim("value").alias("name"))
    return own.where("row > 1").join(heads, ["path", "col"]).select("path", (F.col("row") - 2).alias("row_index"), "name", "value", "col")


def products(all_cells: DataFrame, sheet: str, system: dict[str, str]) -> DataFrame:
    """One row for each row whose first column is filled: the system columns under their field names and a map of the
    other columns' values; ``system``: heading to field."""
    named = named_cells(all_cells, sheet)
    keyed = named.where("col = 1").select("path", "row_index")
    rows = named.join(keyed, ["path", "row_index"], "left_semi")
    other = F.map_from_entries(F.collect_list(F.when(~F.col("name").isin(*system), F.struct("name", "value"))))
    fields = [F.first(F.when(F.col("name") == head, F.col("value")), True).alias(field) for head, field in system.items()]
    return rows.groupBy("path", "row_index").agg(*fields, other.alias("characteristics"))


def validation(all_cells: DataFrame, sheet: str) -> DataFrame:
    """(path, name, allowed_values) of a validation sheet: each column's distinct trimmed values in order."""
    return named_cells(all_cells, sheet).groupBy("path", "name").agg(F.array_sort(F.collect_set(F.trim("value"))).alias("allowed_values"))


def target_columns(all_cells: DataFrame, sheet: str, system: dict[str, str], allowed: DataFrame) -> DataFrame:
    """(path, id, name, type, allowed_values) of the columns that are not of the system, numbered from 1 in each file; enum
    where the validation sheet lists values."""
    heads = all_cells.where((F.col("sheet") == sheet) & (F.col("row") == 1) & ~F.trim("value").isin(*system)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("col", F.trim("value").alias("name")))).alias("h"))
    numbered = heads.select("path", F.posexplode("h").alias("k", "x")).select("path", (F.col("k") + 1).alias("id"), "x.name")
    return numbered.join(allowed, ["path", "name"], "left").select("path", "id", "name", F.when(F.size("allowed_values") > 0, "enum").otherwise("text").alias("type"), "allowed_values")


def _filled(content: bytes, sheet: str, values: list[tuple[int, str, str]]) -> bytes:
    """The workbook with ``values`` (row_index, heading, value) in empty cells of a sheet; all other parts, and the cells' styles,
    stay as they are."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = dict(_sheet_parts(book))
        if sheet not in parts:
            return content
        raw = book.read(parts[sheet])
        for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(raw), events=["start-ns"]):
            ElementTree.register_namespace(prefix, uri)
        root = ElementTree.fromstring(raw)
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        data = root.find(_m("sheetData"))
        rows = {int(r.get("r")): r for r in data}
        heads = {(_cell_value(c, shared) or "").strip(): _place(c.get("r"))[1] for c in rows.get(1, ())}
        for row_index, name, value in sorted(values):
            number, col = row_index + 2, heads.get(name)
            if not name or col is None:
                continue
            if number not in rows:
                rows[number] = ElementTree.Element(_m("row"), {"r": str(number)})
                data.insert(sum(r < number for r in rows), rows[number])
            own = {_place(c.get("r"))[1]: c for c in rows[number]}
            cell = own.get(col)
            if cell is None:
                cell = ElementTree.Element(_m("c"), {"r": f"{column_name(col)}{number}"})
                rows[number].insert(sum(k < col for k in own), cell)
            elif _cell_value(cell, shared):
                continue
            for child in list(cell):
                cell.remove(child)
            cell.set("t", "inlineStr")
            ElementTree.SubElement(ElementTree.SubElement(cell, _m("is")), _m("t"), {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = value
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for item in book.infolist():
                new.writestr(item, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if item.filename == parts[sheet] else book.read(item.filename))
        return out.getvalue()


def filled_workbooks(files: DataFrame, values: DataFrame, sheet: str) -> DataFrame:
    """(path, content) of the workbooks with (path, row_index, name, value) filled into empty cells of a sheet."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        new = list(zip(*[right.column(c).to_pylist() for c in ("row_index", "name", "value")], strict=True))
        return pa.table({"path": left.column("path"), "content": pa.array([_filled(c, sheet, new) for c in left.column("content").to_pylist()], pa.binary())})

    return files.select("path", "content").groupBy("path").cogroup(values.select("path", "row_index", "name", "value").groupBy("path")).applyInArrow(run, "path string, content binary")


def _workbook(sheets: list[tuple[str, list[tuple[int, int, str]]]]) -> bytes:
    """A new workbook of named sheets of (row, col, value) cells."""
    from xml.sax.saxutils import escape, quoteattr

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    numbers = range(1, len(sheets) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        new.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in numbers) + "</Types>")
        new.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        new.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for n, (name, _) in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
        new.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="rId{n}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers) + "</Relationships>")
        for n, (_, listed) in zip(numbers, sheets, strict=True):
            rows: dict[int, list[str]] = {}
            for row, col, value in sorted(listed):
                clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", value)
                rows.setdefault(row, []).append(f'<c r="{column_name(col)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
            new.writestr(f"xl/worksheets/sheet{n}.xml", f'{head}<worksheet xmlns="{_MAIN}"><sheetData>' + "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def new_workbooks(all_cells: DataFrame, sheets: list[str]) -> DataFrame:
    """(path, content): one workbook for each path of CELLS, with the sheets in the given order, empty ones included."""

    def run(table: pa.Table) -> pa.Table:
        listed: dict[str, list] = {s: [] for s in sheets}
        for sheet, *cell in zip(*[table.column(c).to_pylist() for c in ("sheet", "row", "col", "value")], strict=True):
            if sheet in listed:
                listed[sheet].append(tuple(cell))
        return pa.table({"path": table.column("path").slice(0, 1), "content": pa.array([_workbook(list(listed.items()))], pa.binary())})

    return all_cells.where("value is not null").groupBy("path").applyInArrow(run, "path string, content binary")


def as_cells(rows: DataFrame, path: str, order: str, sheet: str, columns: list[str]) -> DataFrame:
    """CELLS of a table: headings in row 1, then the rows of each path by ``order``."""
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy(path).orderBy(order)) + 1
    body = rows.withColumn("_row", at).select(F.col(path).cast("string").alias("path"), F.col("_row").alias("row"), F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns, 1)])).alias("c")).select("path", F.lit(sheet).alias("sheet"), "row", "c.col", "c.value")
    heads = rows.select(F.col(path).cast("string").alias("path")).distinct().select("path", F.lit(sheet).alias("sheet"), F.lit(1).alias("row"), F.posexplode(F.array(*map(F.lit, columns))).alias("k", "value")).select("path", "sheet", "row", (F.col("k") + 1).alias("col"), "value")
    return heads.unionByName(body.where("value is not null"))

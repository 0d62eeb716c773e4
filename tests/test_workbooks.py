import io
import re
import zipfile

from pyspark.sql import functions as F

from attriva.sources import workbooks as w

SYSTEM = {"Артикул": "sku", "Название товара": "name", "Бренд": "brand"}


def styled_book():
    """A template with shared strings, styled empty cells, sparse rows, a number, a boolean and a hidden validation sheet."""
    base = w._workbook([("Товары", []), ("validation", [(1, 1, "Цвет"), (1, 3, "Пол"), (2, 1, " синий "), (3, 1, "белый"), (4, 1, "белый"), (2, 3, "муж"), (5, 2, "no head")])])
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f'<sst {main}><si><t>Артикул</t></si><si><r><t>Название </t></r><r><t>товара</t></r></si><si><t>Цвет</t></si><si><t>Пол</t></si><si><t>Кеды</t></si></sst>'
    sheet = f"""<worksheet {main} xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac" x14ac:dyDescent="1"><cols><col min="1" max="1" width="33"/></cols><sheetData>
<row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c></row>
<row r="2"><c r="A2"><v>17</v></c><c r="B2" t="s"><v>4</v></c><c r="C2" s="5"/><c r="D2" t="b"><v>1</v></c></row><row r="4" ht="30"><c r="A4" t="str"><f>1+1</f><v>b-4</v></c></row><row r="5"><c r="B5" t="s"><v>4</v></c></row>
</sheetData><mergeCells count="1"><mergeCell ref="A9:B9"/></mergeCells></worksheet>"""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as old, zipfile.ZipFile(out, "w") as new:
        for item in old.infolist():
            new.writestr(item.filename, sheet if item.filename.endswith("sheet1.xml") else old.read(item.filename))
        new.writestr("xl/sharedStrings.xml", shared)
        new.writestr("xl/styles.xml", "<styles keep='1'/>")
    return out.getvalue()


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c) if c is not None else None) for k, c in enumerate(contents)], "path string, content binary")


def test_reading(spark):
    cells = w.cells(files(spark, styled_book(), b"broken", None, b""))
    got = {(r.sheet, r.row, r.col): r.value for r in cells.collect()}
    assert got["Товары", 1, 2] == "Название товара" and got["Товары", 2, 1] == "17" and got["Товары", 2, 4] == "TRUE" and got["Товары", 4, 1] == "b-4" and ("Товары", 2, 3) not in got
    rows = {r.row_index: (r.sku, r.name, r.brand, r.characteristics) for r in w.products(cells, "Товары", SYSTEM).collect()}
    assert rows == {0: ("17", "Кеды", None, {"Пол": "TRUE"}), 2: ("b-4", None, None, {})}
    allowed = w.validation(cells, "validation")
    assert {r.name: r.allowed_values for r in allowed.collect()} == {"Цвет": ["белый", "синий"], "Пол": ["муж"]}
    assert {(r.id, r.name, r.type) for r in w.target_columns(cells, "Товары", SYSTEM, allowed.where("name = 'Цвет'")).collect()} == {(1, "Цвет", "enum"), (2, "Пол", "text")}


def test_filling_keeps_the_rest(spark):
    book = styled_book()
    values = spark.createDataFrame([("f0", 0, "Цвет", "синий <&>"), ("f0", 0, "Пол", "taken"), ("f0", 1, "Цвет", "new row"), ("f0", 2, "Пол", "муж"), ("f0", 0, "Нет такой", "x"), ("f9", 0, "Цвет", "x")], "path string, row_index int, name string, value string")
    new = w.filled_workbooks(files(spark, book), values, "Товары")
    got = {(r.row, r.col): r.value for r in w.cells(new).where(F.col("sheet") == "Товары").collect()}
    old = {(r.row, r.col): r.value for r in w.cells(files(spark, book)).where(F.col("sheet") == "Товары").collect()}
    assert got == old | {(2, 3): "синий <&>", (3, 3): "new row", (4, 4): "муж"}
    content = new.where("path = 'f0'").first().content
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(io.BytesIO(book)) as b:
        assert z.namelist() == b.namelist() and all(z.read(n) == b.read(n) for n in b.namelist() if not n.endswith("sheet1.xml"))
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert re.search(r'<c r="C2" s="5" t="inlineStr">', sheet) and 'width="33"' in sheet and 'ref="A9:B9"' in sheet and 'ht="30"' in sheet and "x14ac:dyDescent" in sheet
    assert [int(x) for x in re.findall(r'<row r="(\d+)"', sheet)] == [1, 2, 3, 4, 5]


def test_reports(spark):
    rows = spark.createDataFrame([("job1", 2, "b", None), ("job1", 1, "a & b", 5), ("job2", 1, "c\x01", 6)], "job string, k int, name string, score int")
    every = w.as_cells(rows, "job", "k", "results", ["name", "score"]).unionByName(w.as_cells(rows.where("job = 'job1'"), "job", "k", "checklist", ["k"]))
    new = w.new_workbooks(every, ["results", "checklist", "summary"])
    assert {(r.path, r.sheet, r.row, r.col): r.value for r in w.cells(new).collect()} == {
        ("job1", "results", 1, 1): "name", ("job1", "results", 1, 2): "score", ("job1", "results", 2, 1): "a & b", ("job1", "results", 2, 2): "5", ("job1", "results", 3, 1): "b",
        ("job1", "checklist", 1, 1): "k", ("job1", "checklist", 2, 1): "1", ("job1", "checklist", 3, 1): "2", ("job2", "results", 1, 1): "name", ("job2", "results", 1, 2): "score", ("job2", "results", 2, 1): "c", ("job2", "results", 2, 2): "6",
    }
    with zipfile.ZipFile(io.BytesIO(new.where("path = 'job2'").first().content)) as z:
        assert [n for n, _ in w._sheet_parts(z)] == ["results", "checklist", "summary"]


def test_column_names():
    assert [w.column_name(k) for k in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"] and all(w._place(f"{w.column_name(k)}7") == (7, k) for k in range(1, 2000, 37))

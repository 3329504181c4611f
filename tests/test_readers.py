import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from shapewright.operators import refine, structure
from shapewright.plans.scan import scan
from shapewright.sources import bytelevel as by
from shapewright.sources import readers


def book(rows: str, shared=(), formats="", cells="") -> io.BytesIO:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="o"><sheets><sheet name="one" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId9" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet><numFmts>{formats}</numFmts><cellXfs>{cells}</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/first.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    out.seek(0)
    return out


def test_excel_types():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c><c r="E1" t="s"><v>3</v></c><c r="F1" t="s"><v>4</v></c></row>'
    rows += '<row><c r="A2"><v>7311</v></c><c r="B2" s="1"><v>45475</v></c><c r="D2"><v>2596.32</v></c><c r="E2" t="b"><v>1</v></c><c r="F2" t="s"><v>0</v></c></row>'
    rows += '<row><c r="A3"><v>7312</v></c><c r="B3" s="2"><v>45475.5</v></c><c r="D3"><v>3</v></c></row>'
    got = readers.read_excel(book(rows, ["customer_id", "day", "amount", "paid", "note"], '<numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd &quot;at&quot; hh"/>', '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/>'))
    assert got.names == ["customer_id", "day", "column2", "amount", "paid", "note"] and got.rows == 2
    assert got.types == ["int", "timestamp", "any", "decimal", "bool", "text"]
    assert readers.read_excel(book("")).bucket == "degraded"


def test_sqlite_with_several_tables(tmp_path):
    at = tmp_path / "x.db"
    db = sqlite3.connect(at)
    db.execute("CREATE TABLE b (id INTEGER, v TEXT)")
    db.execute("CREATE TABLE a (k TEXT)")
    db.commit()
    db.close()
    for path in (str(at), None):
        assert readers.read_sqlite(io.BytesIO(at.read_bytes()), path).names == ["a.k", "b.id", "b.v"]
    sqlite3.connect(tmp_path / "empty.db").execute("PRAGMA user_version = 1").connection.commit()
    assert readers.read_sqlite(io.BytesIO((tmp_path / "empty.db").read_bytes()), None).bucket == "degraded"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "locked.zip", "w") as z:
        z.writestr("a.csv", "a,b\n1,2\n")
    data = bytearray((tmp_path / "locked.zip").read_bytes())
    data[6] |= 1
    data[data.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(data)
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 and no more")
    (tmp_path / "dead.csv.gz").write_bytes(b"\x1f\x8b nothing")
    v = {r.path.rsplit("/", 1)[1]: r for r in scan(spark, str(tmp_path)).verdicts.collect()}
    assert [f.reason_code for f in v["locked.zip"].findings] == ["ENCRYPTED_ARCHIVE"] and v["locked.zip"].bucket == "refused" and v["locked.zip"].verdict == "conforms"
    assert v["bad.zip"].bucket == "degraded" and [f.reason_code for f in v["dead.csv.gz"].findings] == ["CORRUPT_ARCHIVE"]


@pytest.mark.parametrize("data,want", [
    (b"\xff\xfe\x00\x00a\x00\x00\x00", ("utf-32-le", False)), (b"\x00\x00\xfe\xff", ("utf-32-be", False)), ("ab,c\n".encode("utf-16-le"), ("utf-16-le", False)), ("ab,c\n".encode("utf-16-be"), ("utf-16-be", False)),
    (b"", ("utf-8", False)), ("é".encode(), ("utf-8", False)), (b"\xe9", ("latin-1", True)), (b"a" * (by.HEAD - 1) + b"\xc3", ("utf-8", False)), (b"a" * 50 + b"\xc3", ("latin-1", True)),
])
def test_encodings(data, want):
    assert by.encoding_of(data) == want


@pytest.mark.parametrize("data,ext,want", [
    (b"", ".csv", "unknown"), (b"PAR1", "", "parquet"), (b"ORC", "", "orc"), (b"Obj\x01", "", "avro"), (b"ARROW1", "", "arrow"), (b'[1]', ".csv", "json"), (b'{"a": 1}\n', "", "jsonl"), (b'{"a":\n 1}', "", "json"),
    (b"a,b\n1,2\n", ".md", "text"), (b"a\tb,c\n1\t2,3\n", "", "tsv"), (b"a;b\n1;2\n", "", "csv"), (b"abc\ndef\n", "", "fixed-width"), (b"a\nbcd\nefghi\n", "", "text"),
])
def test_formats(data, ext, want):
    assert by.format_of(data, "utf-8", ext)[0] == want


def test_headers():
    assert readers.header_of([["id", "x"], ["1", "y"]]) and readers.header_of([["a", "b"]]) and readers.header_of([["city", "name"], ["x", "y"]])
    assert not readers.header_of([["1", "2"], ["3", "4"]]) and not readers.header_of([["1", "2.5"]])


def test_json_and_xml():
    assert readers.read_json(io.BytesIO(b'\n{"b": 1}\n{"a": 2}\n'), "utf-8", True).names == ["b", "a"]
    assert readers.read_json(io.BytesIO(b'{"z": {"y": 1}}'), "utf-8", False).names == ["z"]
    deep = b"<?xml version='1.0'?>" + b"".join(b"<e%d>" % i for i in range(9)) + b"".join(b"</e%d>" % i for i in range(8, -1, -1))
    assert len(readers.read_xml(io.BytesIO(deep)).names) == readers.Bounds().xml_depth + 1
    assert readers.read_xml(io.BytesIO(b"<?xml version='1.0'?><a><b>")).bucket == "degraded"
    big = b"<?xml version='1.0'?><r>" + b"<i><v>1</v></i>" * 60_000 + b"</r>"
    assert readers.read_xml(io.BytesIO(big)).names == ["r", "r/i", "r/i/v"]


def test_family_overlaps(spark):
    rows = [(0, ["a", "b"], None), (1, ["b", "a"], None), (2, ["a", "b", "c"], None), (3, ["z"], None)]
    files = spark.createDataFrame(rows, "file_id long, norm_names array<string>, type_classes array<string>")
    found = refine.families_of(refine.kinds(files))
    got = [(r.a_id, r.b_id, round(r.jaccard, 3), r.relation) for r in structure.overlaps(found).collect()]
    assert got == [("F0001", "F0002", 0.667, "subset")]

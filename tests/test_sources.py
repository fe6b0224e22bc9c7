"""Readers and sinks on files written here; intake as a stream."""

import bz2
import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerloom.operators import lobs as L
from ledgerloom.plans.demo_lobs import _office
from ledgerloom.sources import readers, writers
from ledgerloom.streaming.intake import format_counts, start_intake

CATALOG = """<?xml version="1.0"?><archive xmlns="urn:x"><schemas><schema><name>Main</name><folder>schema0</folder><tables><table><name>Person</name><folder>table0</folder>
<columns><column><name>id</name><type>INTEGER</type><nullable>false</nullable></column><column><name>navn</name><type>VARCHAR(50)</type><description>Name</description></column><column><name>dok</name><lobFolder>lob3</lobFolder><type>BLOB</type></column></columns>
<primaryKey><name>pk</name><column>id</column></primaryKey><foreignKeys><foreignKey><name>fk</name><referencedSchema>Main</referencedSchema><referencedTable>Code</referencedTable><reference><column>id</column><referenced>id</referenced></reference></foreignKey></foreignKeys><rows>3</rows></table></tables></schema></schemas></archive>"""
ROWS = """<?xml version="1.0"?><table xmlns="urn:x">
<row><c1>1</c1><c2>Kari &amp; co</c2><c3 file="rec1.bin" length="4" digest="AB"/></row>
<row><c1>2</c1><c2></c2></row>
<row><c1>3</c1></row>
</table>"""


def archive(tmp_path):
    base = tmp_path / "a1"
    (base / "header").mkdir(parents=True)
    (base / "header/metadata.xml").write_text(CATALOG)
    table = base / "content/schema0/table0"
    (table / "lob3").mkdir(parents=True)
    (table / "table0.xml").write_text(ROWS)
    (table / "lob3/rec1.bin").write_bytes(b"%PDF")
    return base


def test_catalog(spark, tmp_path):
    archive(tmp_path)
    cat = readers.read_catalog(spark, str(tmp_path))
    assert [tuple(r) for r in cat["tables"].select("archive_id", "table_key", "table_name", "declared_rows").collect()] == [("a1", "schema0/table0", "Person", 3)]
    assert [tuple(r) for r in cat["columns"].orderBy("col_idx").select("name", "max_len", "is_lob", "nullable", "description").collect()] == [("id", None, False, False, ""), ("navn", 50, False, True, "Name"), ("dok", None, True, True, "")]
    assert sorted((r["kind"], r["ref_table"], r["cols"][0]["column"]) for r in cat["keys"].collect()) == [("fk", "Main.Code", "id"), ("pk", None, "id")]


def test_rows_keep_null_and_empty_apart(spark, tmp_path):
    base = archive(tmp_path)
    rows = readers.read_rows(spark, str(base / "content/schema0/table0/table0.xml"), 3, {3})
    assert [(r["row_pos"], r["c1"], r["c2"]) for r in rows.orderBy("row_pos").collect()] == [(0, "1", "Kari & co"), (1, "2", ""), (2, "3", None)]
    assert [tuple(r) for r in readers.lob_refs(rows, [3]).collect()] == [("schema0/table0", 0, 3, "rec1.bin", 4, "AB", None)]
    inv = readers.read_inventory(spark, str(tmp_path)).collect()
    assert [(r["archive_id"], r["path"], r["length"]) for r in inv] == [("a1", "content/schema0/table0/lob3/rec1.bin", 4)]


def test_row_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "1", "x<y"), (1, "2", None)], "row_pos long, c1 string, c2 string")
    writers.write_rows(df, str(tmp_path / "out"))
    back = readers.read_rows(spark, str(tmp_path / "out/part-*"), 2)
    assert sorted((r["c1"], r["c2"]) for r in back.collect()) == [("1", "x<y"), ("2", None)] or sorted(((r["c1"], r["c2"] or "") for r in back.collect())) == [("1", "x<y"), ("2", "")]


def test_ledger_errors_template_report(spark, tmp_path):
    (tmp_path / "l.csv").write_text("fra;n;e;til;m;f;k\n a.doc ; 10.0 ;.DOC;a.pdf;12;pdf;Converted to PDF/A\nb;;;;;;\n", encoding="utf-8-sig")
    assert [(r["src_path"], r["src_size"], r["src_ext"]) for r in readers.read_ledger(spark, str(tmp_path / "l.csv")).collect()] == [("a.doc", 10, "doc"), ("b", 0, "")]
    (tmp_path / "e.log").write_text("# head\n\n[10:00]  x/y.doc  |  .doc  |  timed | out\nnothing\n")
    assert [tuple(r) for r in readers.read_errors(spark, str(tmp_path / "e.log")).select("path", "ext", "msg").collect()] == [("x/y.doc", "doc", "timed | out")]
    for k, root in enumerate(([{"name": "A", "description": "1"}, {"name": "a", "description": "2"}], {"tables": [{"name": "a", "description": "2"}]}, {"templateSchema": {"tables": [{"name": "a", "description": "2"}]}}, {"version": 1, "other": {"tables": [{"name": "a", "description": "2"}]}})):
        (tmp_path / f"t{k}.json").write_text(json.dumps(root, indent=1))
        assert [tuple(r) for r in readers.read_template(spark, str(tmp_path / f"t{k}.json")).collect()] == [("a", "2", [])]
    (tmp_path / "r.json").write_text(json.dumps({"files": [{"filename": "f", "matches": [{"id": "fmt/18", "warning": "w"}]}, {"filename": "g", "matches": []}]}))
    assert [(r["path"], r["code"]) for r in readers.read_ident_report(spark, str(tmp_path / "r.json")).collect()] == [("f", "fmt/18"), ("g", None)]
    writers.write_ledger(spark.createDataFrame([("a", 1)], "p string, n int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).first()["p"] == "a"


TEMPLATES = {
    "a": '[{"name": "R", "description": "root", "columns": [{"name": " c", "description": "e"}, {"name": "d"}]}, {"name": " "}, {"description": "no name"}]',
    "b": '{"tables":\n [{"name": "B"}, {"name": "b ", "description": "two", "columns": {"x": 1}}]}',
    "c": '{"q": {"w": {"tables": [{"name": "C3", "description": "deep"}]}}, "z": {"tables": "no"}, "e": {"e": {"e": {"tables": [{"name": "no"}]}}}}',
    "d": '{"tables": {"tables": [{"name": "D"}]}}',
    "e": '{"z": {"tables": [{"name": "late"}]}, "k": {"tables": [{"name": "E"}]}, "list": [{"tables": [{"name": "in a list"}]}]}',
    "f": '{"no": {"list": {"here": 1}}}',
}


def test_templates(spark, tmp_path):
    """Lists at any depth, the least deep first, then by path; entries without a name, columns that are no list, files without a list."""
    for name, text in TEMPLATES.items():
        (tmp_path / f"{name}.json").write_text(text)
    template = readers.read_template(spark, str(tmp_path))
    assert sorted((r["name"], r["description"]) for r in template.collect()) == [("C3", "deep"), ("D", ""), ("E", ""), ("R", "root"), ("b", "two")]
    assert sorted(map(tuple, readers.template_columns(template).collect())) == [("R", "c", "e", 0), ("R", "d", "", 1)]


def test_row_faults(spark, tmp_path):
    base = tmp_path / "a1/content/s/t"
    base.mkdir(parents=True)
    files = {
        "ok": "\ufeff<?xml version='1.0'?>\n<!-- head --><table xmlns='x'>\n<row><c1>a</c1></row>\n<!-- c --><row><c1>b</c1></row>\n</table>\n<!-- end -->", "empty": "<?xml version='1.0'?><table></table>", "closed": "<table/>",
        "bad": "<table><row><c1>a</c2></row> junk <row><c1>b & c</c1></row></table>", "cut": "<table><row><c1>a</c1></row><row><c1>b", "noend": "<table><row><c1>a</c1></row>", "nostart": "<row><c1>a</c1></row></table>",
        "twice": "<table><row><c1>a</c1></row></table></table>", "inner": "<table><row><c1>a</c1><row><c1>b</c1></row></table>", "control": "<table><row><c1>\x01</c1></row></table>",
    }
    for name, text in files.items():
        (base / f"{name}.xml").write_text(text)
    got = sorted((r["archive_id"], r["path"].split("/")[-1][:-4], r["fault"], r["n"]) for r in readers.row_faults(spark, str(tmp_path / "a1/content")).collect())
    row, between, begin, end = "row is not well formed", "text between rows", "root does not begin once", "root does not end once"
    want = [("bad", row, 2), ("bad", between, 1), ("control", row, 1), ("cut", row, 1), ("cut", end, 1), ("inner", row, 1), ("noend", end, 1), ("nostart", begin, 1), ("twice", between, 1), ("twice", end, 1)]
    assert got == sorted(("a1", *w) for w in want)


def test_headers(spark, tmp_path):
    for name, text in {"a1": CATALOG, "a2": "\ufeff<?xml version='1.0'?>\n<!-- x -->\n<archive version='2.2'><dbname>A &amp; b</dbname><lobFolder>content</lobFolder><messageDigest><digestType>MD5</digestType><digest>AB</digest></messageDigest>\n<schemas/></archive>", "a3": "<archive><dbname>x</archive>"}.items():
        (tmp_path / name / "header").mkdir(parents=True)
        (tmp_path / name / "header/metadata.xml").write_text(text)
    got = {r["archive_id"]: r for r in readers.read_databases(spark, str(tmp_path)).collect()}
    assert (got["a2"]["db_name"], got["a2"]["version"], got["a2"]["lob_folder"], got["a2"]["digest"], got["a2"]["digest_algo"]) == ("A & b", "2.2", "content", "AB", "MD5")
    assert got["a1"]["db_name"] is None and got["a3"]["db_name"] is None
    assert [(r["archive_id"], r["n"]) for r in readers.catalog_faults(spark, str(tmp_path)).collect()] == [("a3", 1)]
    assert ("a2", "dbname") in {tuple(r) for r in readers.catalog_elements(spark, str(tmp_path)).collect()}


def test_payloads(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "one")
        f.writestr("b.txt", "two")
    rows = [("gz", gzip.compress(b"<x/>")), ("bz2", bz2.compress(b"text")), ("bz4", b"\x01\x00\x00\x00" + bz2.compress(b"<?xml?>")), ("zip", z.getvalue()), ("raw", b"\x00\x01"), ("none", None), ("empty", b""), ("broken", b"\x1f\x8bxx")]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    got = {r["path"]: (r["route"], bytes(r["content"]) if r["content"] is not None else None) for r in L.recover_payload(df).collect()}
    assert got["gz"] == ("gz", b"<x/>") and got["bz2"] == ("bz2", b"text") and got["bz4"] == ("bz2", b"<?xml?>")
    assert got["zip"][0] == "as_is" and got["raw"] == ("as_is", b"\x00\x01") and got["none"] == ("as_is", None) and got["broken"][0] == "as_is"
    assert [tuple(r) for r in L.container_profile(df).where("path = 'zip'").collect()] == [("zip", "zip", 2, 6, True)]


def test_binary_content_saved_as_text(spark):
    """Bytes read as Windows-1252 and saved as UTF-8 come back; text of other scripts and plain text stay."""
    binary = b"%PDF-1.4 " + bytes(range(256)) * 3
    spelled = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in binary).encode()
    rows = [("pdf", spelled), ("cyrillic", ("%PDF " + "текст " * 40).encode()), ("accents", ("é" * 40).encode()), ("few", "%PDF é".encode()), ("none", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    got = {r["path"]: (r["route"], bytes(r["content"]) if r["content"] is not None else None) for r in L.recover_payload(df).collect()}
    assert got == {"pdf": ("respelled", binary)} | {p: ("as_is", c) for p, c in rows[1:]}


def test_formats(spark):
    rows = [(b"%PDF-1", "pdf"), (b"\xef\xbb\xbf  <?xml?>", "xml"), (b"<!doctype html><html>", "html"), (b"\x01\x00\x00\x00BZh91AY&SY", "bz2"), (b"plain", "txt"), (b"\x00\x01\x02", "bin"), (b"", "bin"), (b"xx {\\rtf1", "rtf"), (b"\xff\xd8\xff\xe0", "jpg")]
    df = spark.createDataFrame([(k, bytearray(c)) for k, (c, _) in enumerate(rows)], "k int, content binary")
    assert [r["ext"] for r in df.select("k", L.format_of(F.col("content"))["ext"].alias("ext")).orderBy("k").collect()] == [e for _, e in rows]


def test_office_formats(spark):
    """Containers of real and damaged office files; a password; marks outside the directory; a comment after the directory."""
    whole = [_office(k, "some text " * 50) for k in range(8)]
    excel = bytearray(whole[7])
    excel[1104:1120] = bytes.fromhex("2008020000000000C000000000000046")
    bare = whole[4][:1024].ljust(1536, b"\0")
    late = io.BytesIO()
    with zipfile.ZipFile(late, "w") as z:
        z.comment = b"x" * 60_000
        z.writestr("é.txt", b"PK\x01\x02" * 50)
        z.writestr("ppt/presentation.xml", "p")
    rows = [*zip(whole, [(e, e == "docx" and k == 7) for k, e in enumerate("docx xlsx odt zip doc xls ppt docx".split())], strict=True)]
    rows += [(bytes(excel), ("xlsx", True)), (late.getvalue(), ("pptx", False)), (whole[0][:-30], ("zip", False)), (b"PK\x03\x04", ("zip", False)), (whole[5][:600], ("doc", False)), (whole[5][:8], ("doc", False))]
    rows += [(bare + "Workbook".encode("utf-16-le"), ("xls", False)), (bare + b"PowerPoint.Show", ("ppt", False)), (bare + b"Impress", ("ppt", False)), (bare, ("doc", False)), (None, (None, None))]
    df = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, (c, _) in enumerate(rows)], "path int, content binary")
    got = {r["path"]: (r["ext"], r["encrypted"]) for r in L.identify(df).collect()}
    assert [got[k] for k in range(len(rows) - 1)] == [e for _, e in rows[:-1]]


def test_intake_resumes(spark, tmp_path):
    source, target, point = tmp_path / "in", tmp_path / "inv", tmp_path / "point"
    source.mkdir()
    for k, names in enumerate((["a.pdf", "b.txt"], ["c.pdf"])):
        for n in names:
            (source / n).write_bytes(b"%PDF" if n.endswith("pdf") else b"text")
        start_intake(spark, str(source), str(target), str(point)).awaitTermination(60)
        assert spark.read.parquet(str(target)).count() == (2, 3)[k]
    assert {r["ext"]: r["count"] for r in format_counts(spark.read.parquet(str(target))).collect()} == {"pdf": 2, "txt": 1}

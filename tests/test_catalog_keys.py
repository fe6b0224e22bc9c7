"""Keys of all kinds come from one parse of the catalog."""

from ledgerloom.sources import readers

CATALOG = """<archive><schemas><schema><name>s</name><folder>schema0</folder><tables>
<table><name>t</name><folder>table0</folder><columns><column><name>a</name><type>BIGINT</type></column></columns><primaryKey><name>p</name><column>a</column><column>b</column></primaryKey>
<foreignKeys><foreignKey><name>f</name><referencedSchema>s</referencedSchema><referencedTable>u</referencedTable><reference><column>a</column><referenced>x</referenced></reference><reference><column>b</column><referenced>y</referenced></reference></foreignKey>
<foreignKey><name>g</name><referencedTable>v</referencedTable></foreignKey></foreignKeys><candidateKeys><candidateKey><name>c</name><column>b</column></candidateKey></candidateKeys></table>
<table><name>u</name><folder>table1</folder></table></tables></schema></schemas></archive>"""


def test_keys_are_parsed_once(spark, tmp_path):
    (tmp_path / "a0" / "header").mkdir(parents=True)
    (tmp_path / "a0" / "header" / "metadata.xml").write_text(CATALOG)
    keys = readers.read_catalog(spark, str(tmp_path))["keys"]
    assert keys.columns == ["archive_id", "table_key", "kind", "name", "ref_table", "cols"]
    rows = sorted((r["archive_id"], r["table_key"], r["kind"], r["name"], r["ref_table"], r["cols"] and [tuple(c) for c in r["cols"]]) for r in keys.collect())
    assert rows == [
        ("a0", "schema0/table0", "fk", "f", "s.u", [("a", "x"), ("b", "y")]), ("a0", "schema0/table0", "fk", "g", "v", None),
        ("a0", "schema0/table0", "pk", "p", None, [("a", None), ("b", None)]), ("a0", "schema0/table0", "uk", "c", None, [("b", None)]),
    ]
    assert keys._jdf.queryExecution().executedPlan().toString().count("Scan xml") == 1

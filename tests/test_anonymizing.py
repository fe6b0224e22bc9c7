"""The whole anonymisation: two tables with a key, files, counts; edge cases of tables and files."""

from ledgerloom.functions.names import Names
from ledgerloom.operators import relations as R
from ledgerloom.operators.anonymizing import Subset, anonymize_archive, classify_tables

PEOPLE = "row_pos long, id int, fornavn string, epost string, notat string"


def people(spark, n=12):
    first = ("Kari", "Ola", "Liv")
    return spark.createDataFrame([(k, k, first[k % 3], f"{first[k % 3].lower()}{k}@mail.no", f"Ring {first[k % 3]} Hansen eller {first[k % 3].lower()}{k}@mail.no. Saken er nummer {k}.") for k in range(n)], PEOPLE)


def test_whole(spark):
    rows = {"p": people(spark), "s": spark.createDataFrame([(k, k % 12, "open") for k in range(40)], "row_pos long, pid int, status string")}
    keys = [R.ForeignKey("f", "s", ("pid",), "p", ("id",))]
    inv = spark.createDataFrame([("a", "s", "lob3", f"content/x/s/lob3/r{k}.pdf", f"r{k}.pdf", "pdf") for k in range(41)], "archive_id string, table_key string, lob string, path string, basename string, ext string")
    refs = spark.createDataFrame([("a", "s", k, 3, f"r{k}.pdf", 100, "AA") for k in range(40)], "archive_id string, table_key string, row_pos long, col_idx int, ref string, length long, digest string")
    stand_ins = spark.createDataFrame([("pdf", bytearray(b"stand-in"))], "kind string, content binary")
    out = anonymize_archive(rows, keys, Subset(5), inv, refs, stand_ins, {"p": {"epost": 10}})
    counts = {r["table_key"]: r.asDict() for r in out.counts.collect()}
    kept = {r["pid"] for r in out.tables["s"].collect()}
    left = out.tables["p"].collect()
    assert {r["id"] for r in left} >= kept and counts["s"]["kept_rows"] == 5 and counts["s"]["declared_rows"] == 40 and counts["s"]["files"] == 5
    assert counts["p"]["kept_rows"] == len(left) == counts["p"]["freetext_cells"] and counts["p"]["spans"] == 2 * len(left)
    for r in left:
        assert "Hansen" not in r["notat"] and "@mail.no" not in r["notat"] and r["notat"].startswith("Ring ") and r["notat"].endswith(f". Saken er nummer {r['id']}.")
        assert len(r["epost"]) == 10
    ledger = out.ledger.collect()
    assert sum(r["cells"] for r in ledger) == counts["p"]["cells"] == 2 * len(left)
    assert len({r["fake"] for r in ledger if r["original"] == "Kari"}) == 1
    assert sorted(out.tables["p"].columns) == sorted(rows["p"].columns)
    assert {(r["new_length"], r["how"]) for r in out.refs.collect()} == {(8, "column")} and out.refs.count() == 5 == out.files.count()


def test_edges(spark):
    empty = people(spark).limit(0)
    out = anonymize_archive({"p": empty, "n": spark.createDataFrame([(0, 1)], "row_pos long, x int")})
    assert out.tables["p"].count() == 0 and out.tables["n"].count() == 1 and out.ledger.count() == 0 and out.refs is None
    assert {tuple(r)[1:] for r in out.counts.collect()} == {(0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0)}
    nulls = spark.createDataFrame([(0, None, None, None, None)], PEOPLE).unionByName(people(spark))
    out = anonymize_archive({"p": nulls})
    assert [tuple(r) for r in out.tables["p"].where("id is null").collect()] == [(0, None, None, None, None)]
    assert classify_tables({"n": spark.createDataFrame([(0, 1)], "row_pos long, x int")}).count() == 0


def test_dictionary(spark):
    """Names that only a table of names knows."""
    rows = spark.createDataFrame([(k, f"Xqa{'b' * (k % 5)} Yqo", "Brev til Xqa Yqo ble sendt, og Xqa svarte i dag på lang tekst.") for k in range(20)], "row_pos long, navn string, notat string")
    names = Names.table(spark.createDataFrame([("xqa" + "b" * k, "first") for k in range(5)] + [("yqo", "last")], "token string, kind string"))
    known = anonymize_archive({"t": rows}, names=names)
    assert {r["pii_type"] for r in known.classes.collect()} == {"FULL_NAME", "FREE_TEXT"}
    assert all("Xqa" not in r["navn"] and "Xqa" not in r["notat"] for r in known.tables["t"].collect())
    assert known.counts.first()["spans"] == 40

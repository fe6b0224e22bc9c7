"""Decoding against the standard library: entities by number and name, escapes with halves of characters, markup heads."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import decoding as D, labels as B


def of(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}").select("k", f(F.col("v")).alias("o"))
    return [r["o"] for r in rows.orderBy("k").collect()]


def test_entities(spark):
    rng = random.Random(4)
    parts = ["&amp;", "&lt;", "&oslash;", "&AElig;", "&apos;", "&nbsp;x", "&#65;", "&#x1F600;", "&#0;", "&#128;", "&#x9F;", "&#xD800;", "&#1114112;", "&#99999999;", "a", " ", "&", ";", "#", "&;", "&#;", "&nosuch;", "&#xZ;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    for n in (1, 3):  # layers
        coded = texts
        for _ in range(n - 1):
            coded = [t.replace("&", "&amp;") for t in coded]
        once = lambda t: re.sub(r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", lambda m: html.unescape(m[0]), t)

        def want(t, once=once):
            for _ in range(4):
                t = once(t)
            return re.sub(r"^\s+|\s+$", "", t, flags=re.ASCII)

        got = of(spark, D.decoded_entities, coded)
        wrong = [(t, g, want(t)) for t, g in zip(coded, got, strict=True) if g != want(t) and not any(x in t for x in ("#129", "#x81"))]
        assert not wrong, wrong[:3]
    assert of(spark, D.decoded_entities, [None, "", "&lt" * 3]) == [None, "", "&lt&lt&lt"]
    assert of(spark, lambda c: D.decoded_entities(c, 1), ["&amp;lt;"]) == ["&lt;"]
    long = "&oslash; " * 50_000
    assert of(spark, D.decoded_entities, [long]) == [("ø " * 50_000).strip()]


def test_escapes(spark):
    def want(t):
        units = lambda m: "".join(f"{int(x, 16):04x}" for x in re.findall(r"\\u(....)", m[0]))
        return re.sub(r"(?:\\u[0-9a-fA-F]{4})+", lambda m: bytes.fromhex(units(m)).decode("utf-16-be", "replace").replace("��", "��"), t)

    texts = ["", r"Aå", r"x😀y", r"\ud83d", r"\ude00\ud83d", r"\ud83d😀\ude00", r"\u12", r"a\\u0042", "no escapes", r"￿\u0000", r"\ud83dA\ude00"]
    got = of(spark, D.unescaped, texts)
    assert got[:3] == ["", "Aå", "x😀y"] and got[3] == "�" and got[4] == "��" and got[5] == "�😀�"
    assert got[6:9] == [r"\u12", "a\\B", "no escapes"] and got[10] == "�A�"
    assert of(spark, D.unescaped, [None]) == [None]
    for t, g in zip(texts[:3], got[:3], strict=True):
        assert g == want(t)


@pytest.mark.parametrize(("head", "kind"), [(b"\xef\xbb\xbf <?xml", "xml"), (b"\x00\x00<?XML", "xml"), (b"\xff\xfe<!DOCTYPE", "html"), (b" <html", "html"), (b"<htm", None), (b"x" * 520 + b"<?xml", None), (b"", None), (None, None), (b"x <!doctype", None)])
def test_markup(spark, head, kind):
    assert of(spark, D.markup_header, [None if head is None else bytearray(head)], "binary") == [kind]


def test_labels(spark):
    assert of(spark, B.human_size, [0, 1023, 1024, 1536, 1 << 30, None, -2048], "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 GB", "–", "-2.0 KB"]
    assert of(spark, B.short_type, [None, "", "DOUBLE PRECISION", "double precision"]) == ["", "", "DOUBLE", "DOUBLE"]
    assert of(spark, lambda c: B.percent(c, F.lit(0)), [1, None], "int") == ["0,0 %", "0,0 %"]
    assert of(spark, lambda c: B.grouped_int(c, "."), [1234567, -1000, 12, None], "long") == ["1.234.567", "-1.000", "12", None]
    assert of(spark, B.file_type_label, [None, "", ".PDF", "xyz"]) == ["No extension", "No extension", "PDF document", ".xyz"]
    assert of(spark, lambda c: B.base_of_outputs(c, ["_a.b", "_C"]), ["x_a.b_c_A.B.zip", "_c", ".zip", "dir/x_axb.zip"]) == ["x", "", ".zip", "x_axb"]

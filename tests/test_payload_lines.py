"""Prose of letters and blanks is not base-64; lines of base-64 are."""

import base64

from ledgerloom.operators import lobs


def test_prose_stays(spark):
    data = bytes(range(256)) * 2
    plain = base64.b64encode(data).decode()
    pdf = base64.b64encode(b"%PDF-1.4 " + data).decode()
    cut = lambda text, n, by: by.join(text[k : k + n] for k in range(0, len(text), n))
    rows = {
        "prose": " ".join(["Thou", "tondingly", "anan"] * 12), "fours": " ".join(["Thou"] * 12), "words": "\n".join(["Thou"] * 12), "lines": "\n".join(["these are words of a line"] * 4), "short": plain[:40],
        "one": plain, "mime": cut(plain, 76, "\r\n") + "\r\n", "indented": "\n  " + cut(plain, 64, "\n  "), "bare": plain.rstrip("="), "spaced": cut(plain, 8, " "), "pdf": cut(pdf, 8, " "),
    }
    inv = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in rows.items()], "path string, content binary")
    got = {r["path"]: (r["route"], bytes(r["content"])) for r in lobs.recover_payload(inv).collect()}
    as_is, coded = ["prose", "fours", "words", "lines", "short", "spaced"], ["one", "mime", "indented", "bare"]
    assert got == {k: ("as_is", rows[k].encode()) for k in as_is} | {k: ("base64", data) for k in coded} | {"pdf": ("base64", b"%PDF-1.4 " + data)}

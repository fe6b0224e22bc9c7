"""Queries of large-object content."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import lobs as L
from .fixtures import Inputs
from .registry import demo

IDENT = "id AS (SELECT path, CASE WHEN ext = 'doc.pdf' THEN 'rtf' WHEN o_orderkey % 11 = 0 THEN 'qqq' WHEN o_orderkey % 17 = 0 THEN 'xls' WHEN ext = 'bin' THEN 'txt' ELSE ext END AS ext, o_orderkey % 23 = 0 AS encrypted FROM d_inv)"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
TRI = IDENT + f""", tr AS (SELECT path, CASE WHEN ext = 'bin' AND ends_with(path, '.txt') THEN 'txt' ELSE ext END AS ext, encrypted FROM id), ti AS (SELECT *, CASE WHEN encrypted THEN 'keep_encrypted' WHEN ext = 'wpt' THEN 'wpt' WHEN ext IN ('txt', 'xml', 'bin', 'pdf', 'html', 'htm') THEN 'keep' WHEN ext IN ({_IN(L.ARCHIVES)}) THEN 'archive'
WHEN ext IN ({_IN(L.UPGRADE)}) THEN 'upgrade' WHEN ext IN ({_IN(L.KEEP)}) THEN 'keep' WHEN ext IN ({_IN(L.CONVERT)}) THEN 'convert' ELSE 'unknown' END AS route FROM tr)"""
HEADS = "hd AS (SELECT doc_id, concat('f', doc_id) AS path, CASE doc_id % 8 WHEN 0 THEN concat('%PDF-1.4 ', text) WHEN 1 THEN concat('<?xml version=\"1.0\"?>', text) WHEN 2 THEN concat(chr(10), '  <html>', text) WHEN 3 THEN concat('{', chr(92), 'rtf1 ', text) WHEN 4 THEN concat('<note>', text) WHEN 5 THEN concat('GIF89a', text) WHEN 6 THEN '' ELSE text END AS body FROM documents)"


def _heads(i: Inputs) -> DataFrame:
    k, text = F.col("doc_id") % 8, F.col("text")
    body = F.when(k == 0, F.concat(F.lit("%PDF-1.4 "), text)).when(k == 1, F.concat(F.lit('<?xml version="1.0"?>'), text)).when(k == 2, F.concat(F.lit("\n  <html>"), text)).when(k == 3, F.concat(F.lit("{\\rtf1 "), text)).when(k == 4, F.concat(F.lit("<note>"), text)).when(k == 5, F.concat(F.lit("GIF89a"), text)).when(k == 6, F.lit("")).otherwise(text)
    return i.documents.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.encode(body, "UTF-8").alias("content"))


def _ident(i: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    ext = F.when(F.col("ext") == "doc.pdf", "rtf").when(k % 11 == 0, "qqq").when(k % 17 == 0, "xls").when(F.col("ext") == "bin", "txt").otherwise(F.col("ext"))
    return i.d_inv.select("path", ext.alias("ext"), (k % 23 == 0).alias("encrypted"))


@demo(f"WITH {HEADS} SELECT doc_id, path, CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xml' WHEN 2 THEN 'html' WHEN 3 THEN 'rtf' WHEN 4 THEN 'xml' WHEN 5 THEN 'gif' WHEN 6 THEN 'bin' ELSE 'txt' END AS ext, false AS encrypted FROM hd")
def identify_formats(i: Inputs) -> DataFrame:
    return L.identify(_heads(i)).select("doc_id", "path", "ext", "encrypted")


def _office(kind: int, text: str) -> bytes:
    """A container of one of eight kinds around a text: four ZIP ones, three compound ones, and a compound one with a password."""
    if kind < 4:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.xml", "<a/>")
            z.writestr(["word/document.xml", "xl/workbook.xml", "content.xml", "notes.txt"][kind], text)
        return out.getvalue()
    entries = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, 1 + (k > 0)).ljust(64, b"\0") for k, n in enumerate(["Root", *[["WordDocument"], ["Workbook"], ["PowerPoint Document"], ["EncryptionInfo", "EncryptedPackage"]][kind - 4]]))
    head = bytes.fromhex("D0CF11E0A1B11AE1").ljust(30, b"\0") + struct.pack("<H", 9).ljust(18, b"\0") + struct.pack("<I", 1)
    return head.ljust(1024, b"\0") + entries.ljust(512, b"\0") + text.encode()


@demo("""SELECT concat('o', doc_id) AS path, CASE doc_id % 8 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'odt' WHEN 3 THEN 'zip' WHEN 4 THEN 'doc' WHEN 5 THEN 'xls' WHEN 6 THEN 'ppt' ELSE 'docx' END AS ext, doc_id % 8 = 7 AS encrypted FROM documents""")
def office_formats(i: Inputs) -> DataFrame:
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": "o" + b["doc_id"].astype(str), "content": [_office(k % 8, t or "") for k, t in zip(b["doc_id"], b["text"], strict=True)]})

    return L.identify(i.documents.select("doc_id", "text").mapInPandas(packed, "path string, content binary")).select("path", "ext", "encrypted")


_REPORT = "rp AS (SELECT path, CASE o_orderkey % 5 WHEN 0 THEN 'fmt/18' WHEN 1 THEN 'fmt/40' WHEN 2 THEN 'fmt/61' WHEN 3 THEN 'fmt/99999' ELSE 'fmt/412' END AS code, CASE WHEN o_orderkey % 19 = 0 THEN 'File is Encrypted' WHEN o_orderkey % 29 = 0 THEN 'password needed' ELSE '' END AS warning FROM d_inv)"


def _report(i: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.when(k % 5 == 0, "fmt/18").when(k % 5 == 1, "fmt/40").when(k % 5 == 2, "fmt/61").when(k % 5 == 3, "fmt/99999").otherwise("fmt/412")
    return i.d_inv.select("path", code.alias("code"), F.when(k % 19 == 0, "File is Encrypted").when(k % 29 == 0, "password needed").otherwise("").alias("warning"))


@demo(f"WITH {_REPORT} SELECT path, code, CASE code WHEN 'fmt/18' THEN 'pdf' WHEN 'fmt/40' THEN 'doc' WHEN 'fmt/61' THEN 'xls' WHEN 'fmt/412' THEN 'docx' ELSE 'bin' END AS ext, warning <> '' AS encrypted FROM rp")
def format_codes(i: Inputs) -> DataFrame:
    return L.map_format_codes(_report(i), i.spark.createDataFrame(L.FORMAT_CODES, "code string, ext string"))


@demo(f"WITH {HEADS} SELECT path, CASE doc_id % 8 WHEN 0 THEN (CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'pdf' END) WHEN 1 THEN 'xml' WHEN 2 THEN (CASE WHEN doc_id % 2 = 0 THEN 'html' END) WHEN 3 THEN 'rtf' WHEN 4 THEN 'xml' WHEN 5 THEN 'gif' WHEN 6 THEN 'txt' ELSE 'txt' END AS ext, doc_id % 9 = 0 AS encrypted FROM hd")
def identify_hybrid(i: Inputs) -> DataFrame:
    heads = _heads(i)
    report = heads.select("path", F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("bin").alias("ext"), (F.col("doc_id") % 9 == 0).alias("encrypted"))
    return L.identify_hybrid(report, L.identify(heads))


_RAW = "xh AS (SELECT *, CAST(length(value) / 2 AS BIGINT) AS n FROM d_cells WHERE length(value) >= 2 AND length(value) % 2 = 0 AND regexp_matches(value, '^[0-9A-Fa-f]+$'))"


@demo(f"WITH {_RAW} SELECT table_key, row_pos, col_idx, CASE WHEN n < 200 THEN 'inline' ELSE 'file' END AS kind, CASE WHEN n < 200 THEN decode(unhex(value)) END AS text, CASE WHEN n >= 200 THEN concat('xrec', row_pos + 1, '.bin') END AS file, n AS length, upper(md5(decode(unhex(value)))) AS md5 FROM xh")
def hex_extract(i: Inputs) -> DataFrame:
    return L.extract_hex(i.d_cells)


@demo(f"WITH {_RAW} SELECT CASE WHEN n < 200 THEN 'inline' ELSE 'file' END AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS bytes FROM xh GROUP BY 1")
def hex_extract_stats(i: Inputs) -> DataFrame:
    return L.extract_hex(i.d_cells).groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


_CELLS = """ic AS (SELECT concat('schema0/table', doc_id % 9) AS table_key, doc_id AS row_pos, doc_id % 5 AS k, text, CASE doc_id % 5 WHEN 0 THEN hex(encode(text)) WHEN 1 THEN to_base64(encode(text)) WHEN 2 THEN concat(replace(text, ' ', concat(chr(92), 'u0020')), chr(92), 'u00e6&amp;amp;') ELSE text END AS value FROM documents),
im AS (SELECT *, CASE WHEN contains(value, chr(92) || 'u') AND NOT starts_with(value, chr(92) || 'x') THEN 'unicode' WHEN regexp_matches(regexp_replace(value, '\\s+', '', 'g'), '^([0-9A-Fa-f]{2}){4,}$') THEN 'hex' WHEN length(value) >= 48 AND length(value) % 4 = 0 AND regexp_matches(value, '^[A-Za-z0-9+/]+={0,2}$') THEN 'base64' ELSE 'text' END AS step,
row_number() OVER (PARTITION BY table_key ORDER BY row_pos) AS place FROM ic WHERE value <> '')"""


@demo(f"WITH {_CELLS} SELECT table_key, row_pos, step, concat('rec', place, '.txt') AS name, CAST(CASE step WHEN 'hex' THEN length(value) / 2 WHEN 'base64' THEN strlen(text) WHEN 'unicode' THEN strlen(text) + 7 ELSE strlen(value) END AS BIGINT) AS length, 'txt' AS ext FROM im")
def inline_extract(i: Inputs) -> DataFrame:
    """Texts in hex, in base-64, with blanks spelled out, and as they are."""
    k, text = F.col("doc_id") % 5, F.col("text")
    value = F.when(k == 0, F.hex(F.encode(text, "UTF-8"))).when(k == 1, F.base64(F.encode(text, "UTF-8"))).when(k == 2, F.concat(F.replace(text, F.lit(" "), F.lit("\\u0020")), F.lit("\\u00e6&amp;amp;"))).otherwise(text)
    return L.extract_inline(i.documents.select(F.concat(F.lit("schema0/table"), F.col("doc_id") % 9).alias("table_key"), F.col("doc_id").alias("row_pos"), F.lit(3).alias("col_idx"), value.alias("value")))


@demo("SELECT doc_id, CASE WHEN length(to_base64(encode(text))) >= 48 THEN text END AS text FROM documents")
def base64_recover(i: Inputs) -> DataFrame:
    """Whole texts in the alphabet for addresses, without padding; where that leaves fewer than 48 characters, with it."""
    plain = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    coded = F.translate(F.regexp_replace(plain, "=", ""), "+/", "-_")
    return i.documents.select("doc_id", L.base64_payload(F.when(F.length(plain) >= 48, F.rpad(coded, F.greatest(F.length(coded), F.lit(48)), "="))).cast("string").alias("text"))


def _packed(i: Inputs) -> DataFrame:
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.encode(F.hex(F.encode("text", "UTF-8")), "UTF-8")).when(k == 1, F.encode(F.base64(F.encode("text", "UTF-8")), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    return i.documents.select(F.concat(F.lit("p"), "doc_id").alias("path"), content.alias("content"))


@demo("""WITH v AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN hex(encode(text)) WHEN 1 THEN to_base64(encode(text)) ELSE text END AS value FROM documents)
SELECT concat('p', doc_id) AS path, CASE doc_id % 3 WHEN 0 THEN (CASE WHEN length(value) >= 8 THEN 'hex' ELSE 'as_is' END) WHEN 1 THEN (CASE WHEN length(value) >= 48 THEN 'base64' ELSE 'as_is' END) ELSE 'as_is' END AS route, CAST(CASE WHEN doc_id % 3 = 0 AND length(value) >= 8 OR doc_id % 3 = 1 AND length(value) >= 48 THEN strlen(text) ELSE strlen(value) END AS INTEGER) AS length FROM v""")
def recover_payload(i: Inputs) -> DataFrame:
    return L.recover_payload(_packed(i)).select("path", "route", F.length("content").alias("length"))


@demo(f"WITH {TRI} SELECT path, ext, encrypted, route FROM ti")
def triage(i: Inputs) -> DataFrame:
    return L.triage(_ident(i))


@demo(f"WITH {TRI} SELECT route, ext, count(*) AS n FROM ti GROUP BY ALL")
def triage_summary(i: Inputs) -> DataFrame:
    return L.triage_summary(L.triage(_ident(i)))


@demo(f"""WITH {TRI}, n AS (SELECT path, ext, regexp_replace(path, '\\.[^./]*$', '') || '.' || CASE WHEN ends_with(path, '.txt') AND ext IN ('xml', 'html') THEN 'txt' ELSE ext END AS new_path FROM ti WHERE route IN ('keep', 'keep_encrypted'))
SELECT path, new_path, CASE WHEN new_path = path THEN 'Kept original format' ELSE concat('Detected as ', ext, ' - extension changed') END AS note FROM n""")
def rename_plan(i: Inputs) -> DataFrame:
    return L.rename_plan(L.triage(_ident(i)))


@demo(f"""WITH {TRI}, a AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM ti WHERE route IN ('archive', 'keep_encrypted', 'unknown')), d AS (SELECT route, ext, name, row_number() OVER (PARTITION BY route, ext ORDER BY name) AS k FROM (SELECT DISTINCT route, ext, name FROM a))
SELECT route, ext, (SELECT count(*) FROM a WHERE a.route = d.route AND a.ext = d.ext) AS n, string_agg(name, ', ' ORDER BY name) AS examples FROM d WHERE k <= 3 GROUP BY route, ext""")
def risk_report(i: Inputs) -> DataFrame:
    return L.risk_report(L.triage(_ident(i)))


@demo(f"WITH {IDENT} SELECT regexp_extract(path, '\\.([^./]*)$', 1) AS declared, ext AS detected, count(*) AS n FROM id GROUP BY ALL")
def ext_crosstab(i: Inputs) -> DataFrame:
    return L.ext_crosstab(i.d_inv, _ident(i))


@demo(f"""WITH {HEADS} SELECT path, CAST(strlen(body) AS BIGINT) AS length, CASE doc_id % 8 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/xml' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/rtf' WHEN 4 THEN 'application/xml' WHEN 5 THEN 'image/gif' WHEN 6 THEN 'application/octet-stream' ELSE 'text/plain' END AS mime,
strftime(TIMESTAMP '2024-02-28 23:59:58' + to_seconds(doc_id * 3601), '%Y-%m-%dT%H:%M:%SZ') AS modified, sha256(body) AS sha256, upper(md5(body)) AS md5 FROM hd""")
def manifest(i: Inputs) -> DataFrame:
    changed = F.to_timestamp(F.from_utc_timestamp(F.timestamp_seconds(F.lit(1709164798) + F.col("doc_id") * 3601), "UTC"))
    return L.manifest(_heads(i).withColumn("modificationTime", changed))


@demo("SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, CAST(floor(sum(length) * 1.05) AS BIGINT) + 1048576 AS package, CAST(floor(sum(length) * 2.0) AS BIGINT) AS space FROM d_inv")
def package_estimate(i: Inputs) -> DataFrame:
    return L.package_estimate(i.d_inv)


@demo("SELECT table_key, row_pos, concat('xrec', row_pos + 1) AS by_row, concat('rec', k) AS by_count, concat('LOB', lpad(CAST(k AS VARCHAR), 6, '0')) AS padded FROM (SELECT *, row_number() OVER (PARTITION BY table_key ORDER BY row_pos) AS k FROM d_refs)")
def record_names(i: Inputs) -> DataFrame:
    return L.record_names(i.d_refs)


def _typed(i: Inputs) -> DataFrame:
    k = F.col("row_pos")
    return i.d_refs.select("table_key", "row_pos", "col_idx", "ref", F.when(k % 3 == 0, F.lit(" PDF ")).otherwise(F.lit("n/a")).alias("kind"), F.when(k % 5 == 0, F.lit("doc")).otherwise(F.lit("")).alias("extra"))


_TYPED = "ty AS (SELECT table_key, row_pos, col_idx, ref, CASE WHEN row_pos % 3 = 0 THEN 'pdf' END AS kind, CASE WHEN row_pos % 5 = 0 THEN 'doc' END AS extra FROM d_refs)"


@demo(f"WITH {_TYPED} SELECT table_key, row_pos, ref, coalesce(kind, extra) AS hint FROM ty WHERE coalesce(kind, extra) IS NOT NULL")
def type_hints(i: Inputs) -> DataFrame:
    return L.type_hints(_typed(i), ["kind", "extra"], ["pdf", "doc", "tif"])


@demo(f"WITH {_TYPED} SELECT col_idx, concat_ws(',', CASE WHEN count(extra) > 0 THEN 'extra' END, CASE WHEN count(kind) > 0 THEN 'kind' END) AS type_columns FROM ty WHERE row_pos < 2000 GROUP BY col_idx")
def lob_type_columns(i: Inputs) -> DataFrame:
    return L.lob_type_columns(_typed(i), ["kind", "extra"], ["pdf", "doc", "tif"])


@demo("SELECT table_key, row_pos, CASE WHEN length(value) >= 2 AND length(value) % 2 = 0 AND regexp_matches(value, '^[0-9A-Fa-f]+$') THEN '72656D6F766564' ELSE value END AS value FROM d_cells")
def inline_blob_mask(i: Inputs) -> DataFrame:
    return L.mask_inline_blobs(i.d_cells, ["value"]).select("table_key", "row_pos", "value")


@demo("WITH p AS (SELECT * FROM (VALUES ('pdf', 'PDF stand-in'), ('txt', 'Text stand-in')) v(kind, body)) SELECT archive_id, table_key, lob, path, coalesce(p.kind, 'bin') AS kind, CAST(length(coalesce(body, 'stand-in')) AS BIGINT) AS new_length, upper(md5(coalesce(body, 'stand-in'))) AS new_md5 FROM d_inv LEFT JOIN p ON p.kind = ext")
def lob_replacement(i: Inputs) -> DataFrame:
    stand_ins = i.spark.createDataFrame([("pdf", bytearray(b"PDF stand-in")), ("txt", bytearray(b"Text stand-in")), ("bin", bytearray(b"stand-in"))], "kind string, content binary")
    return L.replace_lobs(i.d_inv.where("ext != 'bin'").unionByName(i.d_inv.where("ext = 'bin'").withColumn("ext", F.lit("none"))), stand_ins)

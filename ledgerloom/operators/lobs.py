"""Large-object content: formats by signature, decoding, extraction, recovery, triage, manifests."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from typing import BinaryIO, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.decoding import spelled_text
from ..functions.text import decoded, let, respelled
from ..sources.shared import materialized
from .relations import numbered

T = TypeVar("T")

# Leading bytes in hex, extension and MIME type, in order of precedence.
SIGNATURES = [
    ("25504446", "pdf", "application/pdf"), ("D0CF11E0", "doc", "application/msword"), ("89504E47", "png", "image/png"), ("FFD8FF", "jpg", "image/jpeg"), ("47494638", "gif", "image/gif"),
    ("424D", "bmp", "image/bmp"), ("49492A00", "tiff", "image/tiff"), ("4D4D002A", "tiff", "image/tiff"), ("1F8B", "gz", "application/gzip"), ("425A68", "bz2", "application/x-bzip2"),
    ("377ABCAF", "7z", "application/x-7z-compressed"), ("52617221", "rar", "application/x-rar-compressed"), ("504B0304", "zip", "application/zip"), ("7B5C727466", "rtf", "application/rtf"),
    ("7B5C525446", "rtf", "application/rtf"), ("3C68746D6C", "html", "text/html"), ("3C48544D4C", "html", "text/html"), ("3C3F786D6C", "xml", "application/xml"), ("3C3F584D4C", "xml", "application/xml"),
    ("4D5A", "exe", "application/x-msdownload"), ("494433", "mp3", "audio/mpeg"), ("FFFB", "mp3", "audio/mpeg"), ("FFF3", "mp3", "audio/mpeg"), ("FFF2", "mp3", "audio/mpeg"), ("52494646", "wav", "audio/wav"),
    ("664C6143", "flac", "audio/flac"), ("4F676753", "ogg", "audio/ogg"), ("000001BA", "mpg", "video/mpeg"), ("000001B3", "mpg", "video/mpeg"), ("FF575043", "wpd", "application/vnd.wordperfect"),
    ("1A000004", "wpd", "application/vnd.wordperfect"), ("31BE0000", "wri", "application/x-mswrite"), ("32BE0000", "wri", "application/x-mswrite"), ("0000000C66747970", "mp4", "video/mp4"),
    ("0000001866747970", "mp4", "video/mp4"), ("0000002066747970", "mp4", "video/mp4"),
]
# Office documents by a part of a member's name in a ZIP container, in order of precedence.
OFFICE_PARTS = [("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("content.xml", "odt")]
# Office documents by a stream of a compound file; by what its first 32 KB hold, in UTF-16 or in single bytes; by programs named in its first 4 KB; class ids of encrypted ones.
STREAMS = [("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")]
STREAM_MARKS = [("WordDocument", "Word.Document", "doc"), ("Workbook", "Excel.Sheet", "xls"), ("PowerPoint Document", "PowerPoint.Show", "ppt")]
PROGRAMS = [("Microsoft Excel", "xls"), ("Microsoft PowerPoint", "ppt"), ("Calc", "xls"), ("Impress", "ppt")]
CLASS_IDS = [("2008020000000000C000000000000046", "xlsx"), ("108D81649B4FCF1186EA00AA00B929E8", "pptx")]
OFFICE_MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
}
# Format lists of the triage.
ARCHIVES = "zip gz bz2 tar rar 7z".split()
UPGRADE = {"xls": "xlsx", "xlt": "xlsx", "ppt": "pptx", "pot": "pptx"}
KEEP = "csv tiff tif jpg jpeg png gif bmp ppt pptx pot potx odp xls xlsx xlt xltx ods mp3 wav flac ogg mpg mpeg mp4 m4v avi sosi gml ifc warc zip tar gz bz2 msg eml jp2 jpe webp svg exe 7z rar".split()
CONVERT = "doc docx dot dotx odt ott odg rtf wpd wp wp5 wp6 wps wri lwp sxw sdw".split()
# Registry ids that ident reports use, by short extension.
CODES_OF = {
    "doc": "fmt/37 fmt/38 fmt/39 fmt/40 fmt/609 x-fmt/42 x-fmt/43 x-fmt/44 x-fmt/45",
    "docx": "fmt/412 fmt/523",
    "xls": "fmt/55 fmt/56 fmt/57 fmt/59 fmt/61 fmt/62 fmt/175 fmt/176 fmt/177",
    "xlsx": "fmt/214 fmt/445",
    "ppt": "fmt/125 fmt/126 fmt/179 fmt/181",
    "pptx": "fmt/215",
    "odt": "fmt/136 fmt/290 fmt/291",
    "ods": "fmt/137 fmt/294 fmt/295",
    "odp": "fmt/138 fmt/292 fmt/293",
    "odg": "fmt/139 fmt/296 fmt/297",
    "pdf": "fmt/14 fmt/15 fmt/16 fmt/17 fmt/18 fmt/19 fmt/20 fmt/95 fmt/276 fmt/354 fmt/476 fmt/477 fmt/478 fmt/479 fmt/480 fmt/481",
    "rtf": "fmt/45 fmt/50 fmt/52 fmt/53 fmt/355 fmt/969",
    "wpd": "x-fmt/203 x-fmt/204 x-fmt/394 fmt/394",
    "wri": "x-fmt/393",
    "png": "fmt/11 fmt/12 fmt/13",
    "jpg": "fmt/41 fmt/42 fmt/43 fmt/44 fmt/645",
    "gif": "fmt/3 fmt/4",
    "bmp": "fmt/115 fmt/116 fmt/117 x-fmt/25",
    "tiff": "fmt/152 fmt/153 fmt/154 fmt/155 fmt/156 fmt/353 fmt/387 x-fmt/399",
    "jp2": "fmt/92 fmt/93",
    "svg": "fmt/91 fmt/413 fmt/414",
    "webp": "fmt/573",
    "mp4": "fmt/199 fmt/636",
    "mpg": "fmt/640 fmt/641",
    "avi": "fmt/5 fmt/648",
    "m4v": "fmt/569",
    "zip": "x-fmt/263 fmt/610",
    "gz": "x-fmt/266",
    "7z": "fmt/484",
    "tar": "x-fmt/265",
    "rar": "fmt/410 fmt/411",
    "xml": "fmt/101 fmt/801",
    "html": "fmt/96 fmt/97 fmt/98 fmt/99 fmt/100 fmt/471",
    "txt": "x-fmt/16 x-fmt/21 x-fmt/22 fmt/111",
    "csv": "x-fmt/18 fmt/800",
    "mp3": "fmt/134",
    "wav": "fmt/141",
    "flac": "fmt/142 fmt/279",
    "ogg": "fmt/203 fmt/541 fmt/667",
    "eml": "fmt/278",
    "msg": "x-fmt/430 fmt/950",
    "warc": "fmt/289 fmt/700",
    "gml": "fmt/802 fmt/803",
    "ifc": "fmt/824 fmt/825",
}
#: (code, ext) of each of them; another table can be passed as a frame.
FORMAT_CODES = [(code, ext) for ext, codes in CODES_OF.items() for code in codes.split()]
#: Speculative decoders look at no larger payload.
LARGEST = 10 << 20


def _kind(ext: str, mime: str, encrypted: Column | bool = False) -> Column:
    return F.struct(F.lit(ext).alias("ext"), F.lit(mime).alias("mime"), (encrypted if isinstance(encrypted, Column) else F.lit(encrypted)).alias("encrypted"))


def _latin(content: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from at (from 0), each as the character of its number."""
    where = (at + 1 if isinstance(at, Column) else F.lit(at + 1)).cast("int")
    return F.decode(F.substring(content, where, n if isinstance(n, Column) else F.lit(n)), "ISO-8859-1")


def _number(text: Column, at: int, n: int) -> Column:
    """The number in n characters of such a text from at, the lowest first."""
    return reduce(lambda a, b: a + b, [F.ascii(F.substring(text, at + k + 1, 1)).cast("long") * (1 << (8 * k)) for k in range(n)])


def zip_names(content: Column) -> Column:
    """Names of the members in a ZIP container's directory; null without one. Only the directory is read."""

    def listed(directory: Column) -> Column:
        heads = F.regexp_extract_all(directory, F.lit(r"(?s)PK\x01\x02(?=(.{42}.{0,1000}))"), F.lit(1))
        return F.transform(heads, lambda h: F.substring(h, F.lit(43), _number(h, 24, 2).cast("int")))

    def found(tail: Column) -> Column:
        end = F.regexp_extract(tail, r"(?s).*PK\x05\x06(.{18})", 1)
        at = _number(end, 12, 4)
        return F.when((F.length(end) > 0) & (at < F.length(content)), let(_latin(content, at, _number(end, 8, 4).cast("int")), listed))

    back = F.least(F.length(content), F.lit(66_000))  # the end record and the longest comment after it
    return let(_latin(content, F.length(content) - back, back), found)


def compound_names(content: Column) -> Column:
    """Storages and streams in the first 64 entries of a compound file's directory; null if its header names none."""
    entry = lambda directory, k: F.substring(directory, k * 128 + 1, F.lit(128))

    def name(e: Column) -> Column:
        n = _number(e, 64, 2)
        good = (F.length(e) == 128) & _number(e, 66, 1).isin(1, 2) & n.between(2, 64)
        return F.when(good, F.regexp_replace(F.substring(e, F.lit(1), (n - 2).cast("int")), r"\x00", ""))

    names = lambda d: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: name(entry(d, k))), lambda x: F.length(x) > 0)
    at = _directory_at(content)
    return F.when(at.isNotNull(), let(_latin(content, F.least(at, F.length(content)), 64 * 128), names))


def _directory_at(content: Column) -> Column:
    """Where the directory of a compound file begins: after the header, so many sectors on."""

    def at(head: Column) -> Column:
        power, sector = _number(head, 30, 2), _number(head, 48, 4)
        return F.when((F.length(head) >= 52) & power.between(6, 20) & (sector != 0xFFFFFFFE), 512 + sector * F.pow(F.lit(2.0), power).cast("long"))

    return let(_latin(content, 0, 512), at)


def _compound_kind(content: Column) -> Column:
    def kind(names: Column) -> Column:
        has = lambda word: F.array_contains(names, word)
        secret = has("EncryptionInfo")
        root = F.hex(F.substring(content, (F.least(_directory_at(content), F.length(content).cast("long")) + 81).cast("int"), F.lit(16)))
        packed = reduce(lambda rest, c: F.when(root == c[0], _kind(c[1], OFFICE_MIME[c[1]], True)).otherwise(rest), CLASS_IDS, _kind("docx", OFFICE_MIME["docx"], True))
        start = _latin(content, 0, 1 << 15)
        out = F.when(names.isNull(), _kind("doc", OFFICE_MIME["doc"])).when(secret & has("EncryptedPackage"), packed)
        for stream, ext in STREAMS:
            out = out.when(has(stream), _kind(ext, OFFICE_MIME[ext], secret))
        for wide, narrow, ext in STREAM_MARKS:
            out = out.when(start.contains("".join(c + "\0" for c in wide)) | start.contains(narrow), _kind(ext, OFFICE_MIME[ext], secret))
        for program, ext in PROGRAMS:
            out = out.when(_latin(content, 0, 4096).contains(program), _kind(ext, OFFICE_MIME[ext], secret))
        return out.otherwise(_kind("doc", OFFICE_MIME["doc"]))

    return let(compound_names(content), kind)


def _zip_kind(content: Column) -> Column:
    def kind(names: Column) -> Column:
        out = F.when(names.isNull(), _kind("zip", "application/zip"))
        for part, ext in OFFICE_PARTS:
            out = out.when(F.exists(names, lambda n: n.contains(part)), _kind(ext, OFFICE_MIME[ext]))  # noqa: B023
        return out.otherwise(_kind("zip", "application/zip"))

    return let(zip_names(content), kind)


def format_of(content: Column) -> Column:
    """struct(ext, mime, encrypted) by leading bytes, byte-order mark and blanks aside; text without zero bytes is txt, the rest bin.

    Office documents are told apart by their inner directories: streams of compound files, which also tell whether
    there is a password, and members of ZIP containers. Damaged ones are doc and zip. Signatures that begin with '{', '<' or '%' also count within the first 512 bytes. Expressions only.
    """
    window = F.hex(F.substring(content, 1, 512))
    head = F.regexp_replace(F.regexp_replace(window, "^(?:EFBBBF|FFFE0000|0000FEFF|FFFE|FEFF)", ""), "^(?:20|09|0D|0A)+", "")
    kind = _kind
    within = lambda sig: window.rlike(f"^(?:..)*{sig}")
    out = F.when(F.length(content) == 0, kind("bin", "application/octet-stream")).when(head.startswith("D0CF11E0"), _compound_kind(content))
    out = out.when((F.length(content) > 10) & window.rlike("^.{8}425A683[1-9]"), kind("bz2", "application/x-bzip2"))
    out = out.when(head.startswith("504B0304"), _zip_kind(content))
    for sig, ext, mime in SIGNATURES:
        hit = head.startswith(sig) | within(sig) if sig[:2] in ("7B", "3C", "25") else head.startswith(sig)
        out = out.when(hit, kind(ext, mime))
    out = out.when(head.startswith("3C215750546F6F6C73"), kind("wpt", "application/x-wptools")).when(head.startswith("3C"), kind("xml", "application/xml"))
    valid = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    cut = (F.length(content) > 512) & (valid(511) | valid(510) | valid(509))  # the window may end within a character
    plain = ~window.rlike("^(?:..)*00") & (valid(512) | cut)
    return out.when(plain, kind("txt", "text/plain")).otherwise(kind("bin", "application/octet-stream"))


def identify(inv: DataFrame, identifier: Callable[[Column], Column] = format_of) -> DataFrame:
    """inv with ext, mime and encrypted by content; identifier may be any function of the content column, an Arrow UDF included."""
    return inv.withColumn("__f", identifier(F.col("content"))).withColumns({"ext": F.col("__f.ext"), "mime": F.col("__f.mime"), "encrypted": F.col("__f.encrypted")}).drop("__f", "content")


def map_format_codes(report: DataFrame, codes: DataFrame) -> DataFrame:
    """Report rows with the extension of their code (bin without) and encrypted from the warning."""
    warn = F.lower(F.coalesce("warning", F.lit("")))
    out = report.join(codes, "code", "left")
    return out.select("path", "code", F.coalesce("ext", F.lit("bin")).alias("ext"), (warn.contains("encrypt") | warn.contains("password")).alias("encrypted"))


def identify_hybrid(report: DataFrame, signs: DataFrame) -> DataFrame:
    """Report result; txt becomes xml or html where the signature says so, bin falls back to the signature; encrypted if either says it."""
    out = report.join(signs.select("path", F.col("ext").alias("sign_ext"), F.col("encrypted").alias("sign_encrypted")), "path", "left")
    better = ((F.col("ext") == "txt") & F.col("sign_ext").isin("xml", "html")) | (F.col("ext") == "bin")
    return out.select("path", F.when(better, F.coalesce("sign_ext", "ext")).otherwise(F.col("ext")).alias("ext"), (F.col("encrypted") | F.coalesce("sign_encrypted", F.lit(False))).alias("encrypted"))


def is_hex(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 2) & (F.length(c) % 2 == 0) & c.rlike("^[0-9A-Fa-f]+$"), F.lit(False))


def extract_hex(cells: DataFrame, least: int = 200) -> DataFrame:
    """Hex cells decoded: short ones become inline text, longer ones record files named by row, with length and MD5.

    Inline text is UTF-8 or else Windows-1252; control characters but tab and line ends become the replacement character.
    """
    raw = F.try_to_binary("value", F.lit("hex"))
    out = cells.where(is_hex(F.col("value"))).withColumn("raw", raw)
    small = F.length("raw") < least
    text = F.regexp_replace(decoded(F.col("raw")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "\ufffd")
    return out.select(
        "table_key", "row_pos", "col_idx", F.when(small, "inline").otherwise("file").alias("kind"), F.when(small, text).alias("text"),
        F.when(~small, F.concat(F.lit("xrec"), F.col("row_pos") + 1, F.lit(".bin"))).alias("file"), F.length("raw").cast("long").alias("length"), F.upper(F.md5("raw")).alias("md5"),
    )


def extract_inline(cells: DataFrame) -> DataFrame:
    """Inline cells decoded by the first step that fits, with format, record name and length.

    unicode: the cell spells characters as \\uXXXX; hex: of 8 digits or more; base64: 48 characters or more in the strict form, padding
    and all; else the text itself.
    """
    squeezed = F.regexp_replace("value", r"\s+", "")
    unbroken = F.regexp_replace(F.trim("value"), r"[\r\n]+", "")
    step = (
        F.when(F.col("value").contains("\\u") & ~F.col("value").startswith("\\x"), "unicode")
        .when(is_hex(squeezed) & (F.length(squeezed) >= 8), "hex")
        .when((F.length(unbroken) >= 48) & (F.length(unbroken) % 4 == 0) & unbroken.rlike("^[A-Za-z0-9+/]+={0,2}$"), "base64")
        .otherwise("text")
    )
    content = (
        F.when(F.col("step") == "unicode", F.encode(spelled_text(F.col("value")), "UTF-8"))
        .when(F.col("step") == "hex", F.try_to_binary(squeezed, F.lit("hex")))
        .when(F.col("step") == "base64", F.try_to_binary(unbroken, F.lit("base64")))
        .otherwise(F.encode("value", "UTF-8"))
    )
    rows = cells.where("value is not null and value != ''").withColumn("step", step).withColumn("content", content)
    found = rows.select("table_key", "row_pos", "step", F.length("content").cast("long").alias("length"), format_of(F.col("content"))["ext"].alias("ext"))
    rows = numbered(materialized(found), "table_key", ["row_pos"])  # written first: dealing out by range reads its rows twice
    return rows.select("table_key", "row_pos", "step", F.concat(F.lit("rec"), "at", F.lit("."), "ext").alias("name"), "length", "ext")


def base64_payload(c: Column) -> Column:
    """Bytes of a text that is base-64 in either alphabet, 48 characters or more with padding repaired; null otherwise.

    Lines are equally long, of four characters or a multiple and 16 at least; the last may be shorter, and blanks stand only around them.
    """
    return F.when(_in_lines(c), _loose_base64(c))


def _loose_base64(c: Column) -> Column:
    """base64_payload of a text with blanks anywhere, as they stand in prose without punctuation, too."""
    plain = F.translate(F.regexp_replace(c, r"\s+", ""), "-_", "+/")
    bare = F.regexp_replace(plain, "=+$", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    return F.when((F.length(plain) >= 48) & bare.rlike("^[A-Za-z0-9+/]+$") & (F.length(bare) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def _in_lines(c: Column) -> Column:
    """Whether a text is one line, or lines of one length with a last one that may be shorter, blanks around them aside."""

    def even(lines: Column) -> Column:
        long = F.length(F.get(lines, F.lit(0)))
        return (long >= 16) & (long % 4 == 0) & F.forall(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: F.length(x) == long) & (F.length(F.element_at(lines, -1)) <= long)

    return ~c.rlike(r"\S\s+\S") | ~c.rlike(r"\S[^\S\r\n]+\S") & let(F.filter(F.split(c, r"\s+"), lambda x: x != ""), even)


def _member_streams(data: bytes) -> tuple[str, Iterator[tuple[str, BinaryIO]]]:
    """Container kind by leading bytes, and its members as streams; a bz2 stream with a 4-byte length before it counts, too."""

    def zip_members() -> Iterator[tuple[str, BinaryIO]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.flag_bits & 1:
                    raise PermissionError(info.filename)
                if not info.is_dir():
                    yield info.filename, z.open(info)

    def tar_members() -> Iterator[tuple[str, BinaryIO]]:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m)

    if data[:4] == b"PK\x03\x04":
        return "zip", zip_members()
    if data[:3] == b"\x1f\x8b\x08":  # a gzip header names its one method, 8
        return "gz", iter([("", gzip.GzipFile(fileobj=io.BytesIO(data)))])
    for skip in (0, 4):
        if data[skip : skip + 3] == b"BZh":
            return "bz2", iter([("", bz2.BZ2File(io.BytesIO(data[skip:])))])
    return ("tar", tar_members()) if data[257:262] == b"ustar" else ("none", iter(()))


def _members(data: bytes | None, use: Callable[[str, BinaryIO], T], most: int | None = None) -> tuple[str, list[T]]:
    """Container kind and use(name, stream) of each member, of the first ones if most is given; kind broken or encrypted, without members, where it cannot be read whole."""
    kind, streams = _member_streams(data or b"")
    try:
        return kind, [use(name, stream) for name, stream in islice(streams, most)]
    except PermissionError:
        return "encrypted", []
    except (OSError, EOFError, ValueError, RuntimeError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, tarfile.TarError):
        return "broken", []


def recover_payload(inv: DataFrame, largest: int = 1 << 30) -> DataFrame:
    """path, route, content: containers of one member unpacked, text decoded from hex or base-64, binary content saved as text respelled, others as they are.

    Text is decoded up to LARGEST bytes; base-64 with blanks within its lines only if what comes out has a known format. A container that is damaged has the route broken, one with a password encrypted, one whose
    member exceeds largest bytes oversize: a guard against bombs, such a payload stays packed. Null content stays null.
    """

    def recovered(content: bytes | None) -> tuple[str, bytes | None]:
        first: list[bytes] = []

        def read(_: str, stream: BinaryIO) -> int:
            if not first:
                first.append(stream.read(largest + 1))
            return 1

        kind, members = _members(content, read, 2)
        if kind in ("broken", "encrypted") or len(members) != 1:
            return (kind if kind in ("broken", "encrypted") else "as_is"), content
        return (kind, first[0]) if len(first[0]) <= largest else ("oversize", content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows.append((path, *recovered(content)))
                held += len(rows[-1][2] or b"")
                if held > 32 << 20:
                    yield pd.DataFrame(rows, columns=["path", "route", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "route", "content"])

    out = inv.select("path", "content").mapInPandas(run, "path string, route string, content binary")
    text = F.when(F.length("content") <= LARGEST, F.try_validate_utf8(F.col("content").cast("string")))
    formed = lambda b: F.when(~format_of(b)["ext"].isin("txt", "bin"), b)
    loose = F.col("loose")
    decoded = out.withColumn("loose", _loose_base64(text)).withColumn("b64", F.when(loose.isNotNull(), F.when(_in_lines(text), loose).otherwise(formed(loose)))).withColumn("hexed", F.when(is_hex(F.trim(text)) & (F.length(text) >= 8), F.try_to_binary(F.trim(text), F.lit("hex"))))
    raw = F.col("route") == "as_is"
    # plain text in another script has such bytes as well; only what then has a known format was binary
    odd = F.regexp_count(F.decode(F.substring("content", 1, 512), "ISO-8859-1"), F.lit(r"[\x80-\xFF]")) >= 10
    known = let(respelled(text), formed)
    decoded = decoded.withColumn("spelled", F.when(raw & odd & F.col("hexed").isNull() & F.col("b64").isNull(), known))
    route = F.when(raw & F.col("hexed").isNotNull(), "hex").when(raw & F.col("b64").isNotNull(), "base64").when(F.col("spelled").isNotNull(), "respelled").otherwise(F.col("route"))
    return decoded.select("path", route.alias("route"), F.when(raw, F.coalesce("hexed", "b64", "spelled", "content")).otherwise(F.col("content")).alias("content"))


def container_profile(inv: DataFrame) -> DataFrame:
    """path, kind, members, bytes and all_text of each container; a broken or encrypted one has no members. Members are read as streams."""

    def measured(_: str, stream: BinaryIO) -> tuple[int, bool]:
        head = stream.read(512)
        size = len(head)
        while part := stream.read(1 << 20):
            size += len(part)
        return size, b"\x00" not in head

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, c in zip(b["path"], b["content"], strict=True):
                kind, members = _members(c, measured)
                if members or kind in ("broken", "encrypted"):
                    rows.append((path, kind, len(members), sum(n for n, _ in members), all(text for _, text in members)))
            yield pd.DataFrame(rows, columns=["path", "kind", "members", "bytes", "all_text"])

    return inv.select("path", "content").mapInPandas(run, "path string, kind string, members long, bytes long, all_text boolean")


def triage(ident: DataFrame, skip_pdf: bool = True) -> DataFrame:
    """path, ext, route of identified files (path, ext, encrypted): what is to happen to each."""
    file_ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    ext = F.when((F.col("ext") == "txt") & (file_ext == "csv"), "csv").when((F.col("ext") == "bin") & (file_ext == "txt"), "txt").otherwise(F.col("ext"))
    out = ident.select("path", ext.alias("ext"), "encrypted")
    e = F.col("ext")
    route = (
        F.when(F.col("encrypted"), "keep_encrypted").when(e == "wpt", "wpt").when(e.isin("txt", "xml", "bin"), "keep").when((e == "pdf") & F.lit(skip_pdf), "keep").when(e.isin("html", "htm"), "keep")
        .when(e.isin(*ARCHIVES), "archive").when(e.isin(*UPGRADE), "upgrade").when(e.isin(*KEEP), "keep").when(e.isin(*CONVERT), "convert").otherwise("unknown")
    )
    return out.withColumn("route", route)


def rename_plan(tri: DataFrame, standardize: bool = False) -> DataFrame:
    """path, new_path and note for files that are kept: the name gets the detected extension, except xml and html in .txt files."""
    file_ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    ext = F.when((file_ext == "txt") & F.col("ext").isin("xml", "html"), F.lit("txt")).otherwise(F.col("ext"))
    ext = F.when(~ext.isin("txt", "bin"), "bin").otherwise(ext) if standardize else ext
    new = F.concat(stem, F.lit("."), ext)
    note = F.when(new == F.col("path"), F.lit("Kept original format")).otherwise(F.concat(F.lit("Detected as "), F.col("ext"), F.lit(" - extension changed")))
    return tri.where(F.col("route").isin("keep", "keep_encrypted")).select("path", new.alias("new_path"), note.alias("note"))


def triage_summary(tri: DataFrame) -> DataFrame:
    return tri.groupBy("route", "ext").agg(F.count("*").alias("n"))


def risk_report(tri: DataFrame) -> DataFrame:
    """Archives left packed, encrypted and unknown files by extension, with three examples of names."""
    at_risk = tri.where(F.col("route").isin("archive", "keep_encrypted", "unknown"))
    name = F.substring_index("path", "/", -1)
    first = at_risk.select("route", "ext", name.alias("name")).distinct().withColumn("at", F.row_number().over(W.partitionBy("route", "ext").orderBy("name"))).where("at <= 3")
    examples = first.groupBy("route", "ext").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("examples"))
    return at_risk.groupBy("route", "ext").agg(F.count("*").alias("n")).join(examples, ["route", "ext"])


def ext_crosstab(inv: DataFrame, ident: DataFrame) -> DataFrame:
    declared = inv.select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("declared"))
    return declared.join(ident.select("path", F.col("ext").alias("detected")), "path").groupBy("declared", "detected").agg(F.count("*").alias("n"))


def manifest(files: DataFrame) -> DataFrame:
    """path, length, mime by content, time of change in UTC, SHA-256 and upper-case MD5 of each file (path, content, modificationTime)."""
    changed = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select("path", F.length("content").cast("long").alias("length"), format_of(F.col("content"))["mime"].alias("mime"), changed.alias("modified"), F.sha2("content", 256).alias("sha256"), F.upper(F.md5("content")).alias("md5"))


def package_estimate(files: DataFrame, factor: float = 2.0) -> DataFrame:
    """Files, bytes, package size (5 % and 1 MiB more) and working space."""
    n = F.sum("length")
    return files.agg(F.count("*").alias("files"), n.alias("bytes"), (F.floor(n * 1.05) + (1 << 20)).alias("package"), F.floor(n * factor).alias("space"))


def record_names(cells: DataFrame) -> DataFrame:
    at = F.col("at")
    named = numbered(cells.select("table_key", "row_pos"), "table_key", ["row_pos"])
    return named.select("table_key", "row_pos", F.concat(F.lit("xrec"), F.col("row_pos") + 1).alias("by_row"), F.concat(F.lit("rec"), at).alias("by_count"), F.concat(F.lit("LOB"), F.lpad(at.cast("string"), 6, "0")).alias("padded"))


def type_hints(rows: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Per row with a reference, the first of columns that holds a known type word, as the file's extension."""
    cells = F.array(*[F.lower(F.trim(F.col(c).cast("string"))) for c in columns])
    hit = F.get(F.filter(cells, lambda v: v.isin(*words)), F.lit(0))
    return rows.where("ref is not null").select("table_key", "row_pos", "ref", hit.alias("hint")).where("hint is not null")


def lob_type_columns(rows: DataFrame, columns: list[str], words: list[str], first: int = 2000) -> DataFrame:
    """For each reference column, the columns that hold type words within the first rows."""
    head = rows.where((F.col("row_pos") < first) & F.col("ref").isNotNull())
    long = head.select("col_idx", *[F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in columns]).unpivot(["col_idx"], columns, "type_col", "v").where(F.col("v").isin(*words))
    return long.groupBy("col_idx").agg(F.array_join(F.array_sort(F.collect_set("type_col")), ",").alias("type_columns"))


def mask_inline_blobs(df: DataFrame, columns: list[str], placeholder: bytes = b"removed") -> DataFrame:
    """Hex cells of large-object columns replaced by the hex of a placeholder."""
    return df.withColumns({c: F.when(is_hex(F.col(c)), F.lit(placeholder.hex().upper())).otherwise(F.col(c)) for c in columns})


def replace_lobs(inv: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Each file, with its archive, table and folder where inv has them, kind, new_length and new_md5 after it is replaced by the placeholder of its format, else by that of kind 'bin', else by no bytes.

    placeholders: kind, content; of several of a kind, the one with the least bytes in order counts.
    """
    own = placeholders.groupBy(F.col("kind").alias("ext")).agg(F.min("content").alias("content"))
    other = placeholders.where("kind = 'bin'").agg(F.min("content").alias("other"))
    out = inv.join(own, "ext", "left").crossJoin(F.broadcast(other)).withColumn("other", F.coalesce("other", F.lit(b"")))
    content = F.coalesce("content", "other")
    where = [c for c in ("archive_id", "table_key", "lob") if c in inv.columns]
    return out.select(*where, "path", F.when(F.col("content").isNotNull(), F.col("ext")).otherwise("bin").alias("kind"), F.length(content).cast("long").alias("new_length"), F.upper(F.md5(content)).alias("new_md5"))

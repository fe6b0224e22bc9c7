"""Short texts for reports: types, names, messages, numbers, sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Long spellings of SQL types and their short forms.
SHORT_TYPES = {
    "CHARACTER VARYING": "VARCHAR", "CHARACTER LARGE OBJECT": "CLOB", "BINARY LARGE OBJECT": "BLOB", "BINARY VARYING": "VARBINARY",
    "DOUBLE PRECISION": "DOUBLE", "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ", "TIME WITH TIME ZONE": "TIMETZ",
}
#: Labels of file types by extension; a table in another language can be given.
FILE_LABELS = {
    **dict.fromkeys(["pdf", "pdfa"], "PDF document"), **dict.fromkeys(["txt", "text"], "Text"), **dict.fromkeys(["html", "htm"], "Web page"), "csv": "Table (CSV)", "json": "JSON data", "xml": "XML data",
    **dict.fromkeys(["tif", "tiff", "jpg", "jpeg", "png", "gif", "bmp", "jp2"], "Image"), "rtf": "Rich text", **dict.fromkeys(["doc", "docx", "odt"], "Text document"), **dict.fromkeys(["xls", "xlsx", "ods"], "Spreadsheet"),
    **dict.fromkeys(["ppt", "pptx", "odp"], "Slides"), "bin": "Unknown binary",
}


def short_type(kind: Column, width: int = 18) -> Column:
    """A SQL type in its short spelling, what follows kept, cut to a width with an ellipsis."""
    t = F.trim(kind)
    out = t
    for long, short in SHORT_TYPES.items():
        out = F.when(F.upper(t).startswith(long), F.concat(F.lit(short), F.substring(t, F.lit(len(long) + 1), F.length(t)))).otherwise(out)
    return F.coalesce(F.when(F.length(out) > width, F.concat(F.substring(out, 1, width - 2), F.lit("…"))).otherwise(out), F.lit(""))


def base_of_outputs(name: Column, suffixes: Sequence[str]) -> Column:
    """A file name without folder, extension and the suffixes of earlier steps, however many, in any case."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")
    some = "|".join(rf"\Q{s}\E" for s in suffixes)
    return F.regexp_replace(stem, f"(?i)(?:{some})+$", "")


def clean_message(msg: Column, marks: Sequence[str] = (". Files: ",), hints: Mapping[str, str] | None = None) -> Column:
    """An error message up to the first mark after which a tool lists its own files, with a hint added where it holds a known phrase."""
    out = msg
    for mark in marks:
        out = F.when(out.contains(mark), F.substring_index(out, mark, 1)).otherwise(out)
    for phrase, hint in (hints or {}).items():
        out = F.when(out.contains(phrase), F.concat(out, F.lit(f". {hint}"))).otherwise(out)
    return out


def file_type_label(ext: Column, labels: Mapping[str, str] = FILE_LABELS) -> Column:
    """Label of an extension, with or without its dot; unknown ones are shown with the dot."""
    bare = F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), r"^\.+", "")
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.when(bare == "", "No extension").otherwise(F.coalesce(F.try_element_at(table, bare), F.concat(F.lit("."), bare)))


def grouped_int(n: Column, separator: str = " ") -> Column:
    """A whole number with its digits in threes."""
    return F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit(separator))


def percent(part: Column, whole: Column, decimals: int = 1, point: str = ",") -> Column:
    """Share as 'NN,N %'; of nothing it is 0."""
    share = F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(part / whole * 100.0).cast("double")
    return F.concat(F.replace(F.format_string(f"%.{decimals}f", F.bround(share, decimals)), F.lit("."), F.lit(point)), F.lit(" %"))


def human_size(n: Column, units: Sequence[str] = ("KB", "MB", "GB", "TB", "PB")) -> Column:
    """A size in the largest unit of 1,024 that it fills, or the last of units; whole bytes, else one decimal, halves to the even one; null is a dash."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(F.abs(n) >= float(1024**k), F.concat(F.format_string("%.1f", F.bround((n / float(1024**k)).cast("double"), 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.coalesce(out, F.lit("–"))

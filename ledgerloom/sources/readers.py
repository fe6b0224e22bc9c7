"""Readers of unpacked archives, ledgers, templates and identification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import version_of
from ..operators.ledger import clean_ledger, parse_errors
from ..operators.paths import path_keys
from .shared import materialized

_KEY = "struct<name:string,column:array<string>>"
_FOREIGN = "struct<name:string,referencedSchema:string,referencedTable:string,reference:array<struct<column:string,referenced:string>>>"
_COLUMN = "struct<name:string,lobFolder:string,type:string,typeOriginal:string,nullable:boolean,mimeType:string,description:string>"
_KEYS = f"primaryKey:{_KEY},foreignKeys:struct<foreignKey:array<{_FOREIGN}>>,candidateKeys:struct<candidateKey:array<{_KEY}>>"
_TABLE = f"struct<name:string,folder:string,description:string,rows:long,columns:struct<column:array<{_COLUMN}>>,{_KEYS}>"
_VIEW = f"struct<name:string,query:string,queryOriginal:string,description:string,rows:long,columns:struct<column:array<{_COLUMN}>>>"
#: A schema element of the catalog file; given in full, since a list of one element is otherwise read as a struct.
SCHEMA = f"name string, folder string, description string, tables struct<table:array<{_TABLE}>>, views struct<view:array<{_VIEW}>>"
#: What of it the keys are read from; the parser passes over the rest.
_KEY_SCHEMA = f"folder string, tables struct<table:array<struct<folder:string,{_KEYS}>>>"
#: What stands before the schemas in the catalog file.
_HEADER = (
    "dbname string, description string, archiver string, dataOwner string, dataOriginTimespan string, lobFolder string, producerApplication string, archivalDate string, databaseProduct string,"
    " messageDigest array<struct<digestType:string,digest:string>>"
)
#: Sub-stitute for null that no cell holds, so that an empty cell stays an empty string.
_NO_NULL = "\x00"
#: A parse that only asks whether a record is well formed.
_CHECK = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _archive_id(path):
    return F.regexp_extract(path, r"([^/]+)/header/metadata\.xml", 1)


def _catalog_text(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """archive_id and value: the catalog files of all archives, cut at a separator."""
    return spark.read.option("lineSep", separator).text(f"{path}/*/header/metadata.xml").select(_archive_id(F.col("_metadata.file_path")).alias("archive_id"), "value")


def read_databases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each archive: the header fields of its catalog, version, and the first digest with its algorithm. The text is cut before the schemas, which stay unparsed."""
    head = _catalog_text(spark, path, "<schemas").where(F.col("value").rlike("^\uFEFF?\\s*<"))
    plain = F.regexp_replace("value", "(?s)<!--.*?-->", "")
    body = F.regexp_extract(plain, r"(?s)^\uFEFF?\s*(?:<\?.*?\?>)?\s*<[A-Za-z_][^>]*>(.*)$", 1)
    parsed = head.withColumn("h", F.from_xml(F.concat(F.lit("<header>"), body, F.lit("</header>")), _HEADER, {"nullValue": _NO_NULL}))
    digest = F.get("h.messageDigest", F.lit(0))
    return parsed.select(
        "archive_id", F.col("h.dbname").alias("db_name"), F.col("h.databaseProduct").alias("product"), F.col("h.dataOwner").alias("owner"), F.col("h.dataOriginTimespan").alias("origin"), version_of(F.regexp_extract(plain, r"(?s)(<[A-Za-z_][^>]*>)", 1)).alias("version"),
        F.col("h.archivalDate").alias("archival_date"), F.col("h.producerApplication").alias("producer"), F.col("h.archiver").alias("archiver"), F.col("h.lobFolder").alias("lob_folder"),
        F.coalesce("h.description", F.lit("")).alias("description"), digest["digest"].alias("digest"), digest["digestType"].alias("digest_algo"),
    )


def catalog_elements(spark: SparkSession, path: str) -> DataFrame:
    """archive_id and element: the distinct local names of elements in each archive's catalog."""
    pieces = _catalog_text(spark, path, "<")
    name = F.regexp_extract("value", r"^(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1)
    return pieces.select("archive_id", name.alias("element")).where("element != ''").distinct()


def catalog_faults(spark: SparkSession, path: str) -> DataFrame:
    """archive_id, path, fault, n of catalogs that are not well formed. A catalog is read whole: it is as large as a list of columns."""
    whole = spark.read.text(f"{path}/*/header/metadata.xml", wholetext=True).select(_archive_id(F.col("_metadata.file_path")).alias("archive_id"), F.regexp_replace("value", "^\uFEFF", "").alias("value"))
    broken = F.from_xml("value", "_corrupt_record string", _CHECK)["_corrupt_record"].isNotNull()
    return whole.where(broken).select("archive_id", F.lit("header/metadata.xml").alias("path"), F.lit("catalog is not well formed").alias("fault"), F.lit(1).cast("long").alias("n"))


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """schemas, tables, columns, keys and views of every archive under path (<archive>/header/metadata.xml), as flat frames."""
    read = lambda schema: spark.read.format("xml").option("rowTag", "schema").option("nullValue", _NO_NULL).schema(schema).load(f"{path}/*/header/metadata.xml").select(_archive_id(F.col("_metadata.file_path")).alias("archive_id"), "*")
    raw = read(SCHEMA)
    tables = raw.select("archive_id", F.col("name").alias("schema_name"), F.col("folder").alias("schema_folder"), F.inline("tables.table"))
    tables = tables.withColumn("table_key", F.concat_ws("/", "schema_folder", "folder"))
    columns = tables.select("archive_id", "table_key", F.posexplode("columns.column").alias("at", "c")).select("archive_id", "table_key", (F.col("at") + 1).alias("col_idx"), "c.*")
    max_len = F.regexp_extract("type", r"CHAR[A-Z ]*\((\d+)\)", 1).try_cast("int")
    columns = columns.select("archive_id", "table_key", "col_idx", "name", "type", F.col("typeOriginal").alias("type_original"), max_len.alias("max_len"), F.coalesce("nullable", F.lit(True)).alias("nullable"), F.upper("type").rlike("LOB|LARGE OBJECT").alias("is_lob"), F.col("lobFolder").alias("lob_folder"), F.col("mimeType").alias("mime_type"), F.coalesce("description", F.lit("")).alias("description"))
    text = F.lit(None).cast("string")
    plain = lambda c: F.transform(c, lambda x: F.struct(x.alias("column"), text.alias("referenced")))
    one = lambda kind, name, ref_table, cols: F.struct(F.lit(kind).alias("kind"), name.alias("name"), ref_table.alias("ref_table"), cols.cast("array<struct<column:string,referenced:string>>").alias("cols"))
    pk = F.when(F.col("primaryKey").isNotNull(), F.array(one("pk", F.col("primaryKey.name"), text, plain(F.col("primaryKey.column")))))
    uk = F.transform("candidateKeys.candidateKey", lambda k: one("uk", k["name"], text, plain(k["column"])))
    fk = F.transform("foreignKeys.foreignKey", lambda k: one("fk", k["name"], F.concat_ws(".", k["referencedSchema"], k["referencedTable"]), k["reference"]))
    keys = read(_KEY_SCHEMA).select("archive_id", F.col("folder").alias("schema_folder"), F.inline("tables.table")).withColumn("table_key", F.concat_ws("/", "schema_folder", "folder"))
    # one list for each table, so that the catalog is parsed once for all kinds
    keys = keys.select("archive_id", "table_key", F.inline(F.flatten(F.array_compact(F.array(pk, uk, fk)))))
    return {
        "schemas": raw.select("archive_id", "name", "folder", F.coalesce("description", F.lit("")).alias("description")),
        "tables": tables.select("archive_id", "schema_folder", F.col("folder").alias("table_folder"), "table_key", "schema_name", F.col("name").alias("table_name"), F.coalesce("description", F.lit("")).alias("description"), F.col("rows").alias("declared_rows")),
        "columns": columns,
        "keys": keys,
        "views": raw.select("archive_id", F.col("name").alias("schema_name"), F.col("folder").alias("schema_folder"), F.inline("views.view")).select("archive_id", "schema_name", "schema_folder", F.col("name").alias("view_name"), F.coalesce("query", "queryOriginal").alias("query"), F.coalesce("description", F.lit("")).alias("description"), F.col("rows").alias("declared_rows"), F.coalesce(F.size("columns.column"), F.lit(0)).alias("n_columns")),
    }


def read_rows(spark: SparkSession, path: str, columns: int, lobs: set[int] = frozenset()) -> DataFrame:
    """Rows of one table's XML file: table_key, row_pos and c1..cN as text; a missing cell is null, an empty one ''.

    Records end at </row>, so large files split; row_pos counts from 0 in file order: the file, where a table has several, the place
    of the split, then the place in it. Cells of lobs come as structs with their attributes.
    """
    cell = "struct<_VALUE:string,_file:string,_length:long,_digest:string,_digestType:string>"
    schema = ", ".join(f"c{k} {cell if k in lobs else 'string'}" for k in range(1, columns + 1))
    raw = spark.read.option("lineSep", "</row>").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.regexp_extract("value", r"(?s)<row>(.*)$", 1).alias("body"), F.col("value").contains("<row>").alias("is_row")).where("is_row")
    parsed = raw.withColumn("r", F.from_xml(F.concat(F.lit("<row>"), "body", F.lit("</row>")), schema, {"nullValue": _NO_NULL, "attributePrefix": "_"}))
    key = F.regexp_extract("file", r"content/(.+?)/[^/]+\.xml$", 1)
    from ..operators.relations import numbered

    placed = numbered(parsed.select(key.alias("table_key"), "file", "start", "at", "r"), "table_key", ["file", "start", "at"], "at_")
    return placed.select("table_key", (F.col("at_") - 1).alias("row_pos"), "r.*")


def row_faults(spark: SparkSession, path: str) -> DataFrame:
    """archive_id, path, fault and n: what is not well formed in the table files under path, and how often.

    A file is cut at </row>, so that large files are read by many tasks, and each row is parsed on its own; what stands
    between rows must be white space or comments, before the first row the root's start, after the last one its end.
    Only counts for each file are shuffled. </row> within a comment or CDATA counts as the end of a row.
    """
    raw = spark.read.option("lineSep", "</row>").option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "value", F.col("value").contains("<row>").alias("has_row"))
    gap = F.when(F.col("has_row"), F.regexp_extract("value", "(?s)^(.*?)<row>", 1)).otherwise(F.col("value"))
    gap = F.trim(F.regexp_replace(F.regexp_replace(gap, "(?s)<!--.*?-->", ""), r"^[\uFEFF\s]+|\s+$", ""))  # comments may stand anywhere
    name = r"[A-Za-z_][\w.:-]*"
    start, end = rf"(?:<\?xml.*?\?>)?\s*<{name}[^<>]*>", rf"</{name}>"
    opens = gap.rlike(rf"(?s)^{start}\s*(?:{end})?$")
    closes = gap.rlike(rf"(?s)^(?:{start})?\s*{end}$") | gap.rlike(rf"(?s)^{start}$") & gap.endswith("/>")
    record = F.concat(F.lit("<row>"), F.regexp_extract("value", r"(?s)<row>(.*)$", 1), F.lit("</row>"))
    broken = F.from_xml(record, "_corrupt_record string", _CHECK)["_corrupt_record"].isNotNull()
    marked = raw.select("file", (F.col("has_row") & broken).alias("broken"), opens.alias("opens"), closes.alias("closes"), ((gap != "") & ~opens & ~closes).alias("between"))
    n = lambda c: F.count_if(F.col(c))
    counts = marked.groupBy("file").agg(n("broken").alias("broken"), n("between").alias("between"), n("opens").alias("opens"), n("closes").alias("closes"))
    fault = lambda text, count: F.struct(F.lit(text).alias("fault"), count.cast("long").alias("n"))
    faults = F.array(
        fault("row is not well formed", F.col("broken")), fault("text between rows", F.col("between")),
        fault("root does not begin once", F.abs(F.col("opens") - 1)), fault("root does not end once", F.abs(F.col("closes") - 1)),
    )
    out = counts.select(F.regexp_extract("file", r"([^/]+)/content/", 1).alias("archive_id"), F.regexp_extract("file", r"(content/.*)$", 1).alias("path"), F.inline(F.filter(faults, lambda f: f["n"] > 0)))
    return out


def inventory_of(files: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) under <archive>/content but the table files: archive_id, path within the archive, table_key, lob folder, basename, ext, length, modified."""
    inner = F.regexp_extract("path", r"(content/.*)$", 1)
    out = files.select(F.regexp_extract("path", r"([^/]+)/content/", 1).alias("archive_id"), inner.alias("path"), "length", F.col("modificationTime").alias("modified"))
    out = path_keys(out.where("path != '' and not path rlike '/table[^/]*[.](xml|xsd)$'"), "path")
    return out.select("archive_id", "path", F.concat_ws("/", "schema_folder", "table_folder").alias("table_key"), F.col("lob_folder").alias("lob"), F.col("name").alias("basename"), F.col("name_ext").alias("ext"), "length", "modified")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """inventory_of the files under path; contents stay unread."""
    return inventory_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime"))


def lob_refs(rows: DataFrame, lobs: list[int]) -> DataFrame:
    """One row per reference in the given cells of read_rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("col_idx"), F.col(f"c{k}._file").alias("ref"), F.col(f"c{k}._length").alias("length"), F.col(f"c{k}._digest").alias("digest"), F.col(f"c{k}._digestType").alias("digest_type")) for k in lobs])
    return rows.select("table_key", "row_pos", F.explode(cells).alias("x")).select("table_key", "row_pos", "x.*").where("ref is not null")


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with line_no, which grows along a file and from file to file; how far it grows says nothing."""
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Conversion ledger: semicolons, seven columns, header, byte-order mark or not; fields trimmed, sizes lenient; line_no in the order of the file."""
    schema = "src_path string, src_size string, src_ext string, dst_path string, dst_size string, dst_ext string, note string"
    raw = spark.read.csv(path, sep=";", header=True, schema=schema, enforceSchema=True)
    return clean_ledger(_numbered_lines(raw.na.fill("")))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return parse_errors(_numbered_lines(spark.read.text(path)), "value")


_ENTRIES = "array<struct<name:string,description:string,columns:variant>>"


def _entry_lists(spark: SparkSession, path: str) -> DataFrame:
    """file and tables: the list of tables of each JSON template.

    It is the root, or stands at tables, tabeller or templateSchema.tables, or at tables of any part at any depth: then
    the least deep one counts, of these the first by path. Parts are walked level by level, all files at once, as deep as
    any file goes.
    """
    level = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit("").alias("at"), F.parse_json("value").alias("v"))
    at = lambda p: F.try_variant_get("v", p, _ENTRIES)
    known = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit("").alias("at"), at(p).alias("tables")) for rank, p in enumerate(("$", "$.tables", "$.tabeller", "$.templateSchema.tables"))])
    found = level.select("file", F.inline(known)).where("tables is not null")
    depth = 4
    while True:
        level = materialized(level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where("key is not null and startswith(schema_of_variant(value), 'OBJECT')").select("file", F.concat_ws("/", "at", "key").alias("at"), F.col("value").alias("v")))
        if level.isEmpty():
            break
        found = found.unionByName(level.select("file", F.lit(depth).alias("rank"), "at", at("$.tables").alias("tables")).where("tables is not null"))
        depth += 1
    first = F.row_number().over(W.partitionBy("file").orderBy("rank", "at"))
    return found.withColumn("place", first).where("place = 1").select("file", "tables")


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Tables of JSON description templates: name, description and columns (array of name and description). The last entry of a name counts, in any case, by file and place."""
    rows = _entry_lists(spark, path).select("file", F.posexplode("tables").alias("at", "t")).where("trim(t.name) != ''")
    columns = F.try_variant_get("t.columns", "$", "array<struct<name:string,description:string>>")
    rows = rows.select(F.struct("file", "at").alias("at"), F.trim("t.name").alias("name"), F.coalesce("t.description", F.lit("")).alias("description"), F.coalesce(columns, F.array().cast("array<struct<name:string,description:string>>")).alias("columns"))
    return rows.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "description", "columns"), "at").alias("last")).select("last.*")


def template_columns(template: DataFrame) -> DataFrame:
    """table_name, name, text and ord of the columns that read_template describes: what catalog.enrich takes."""
    return template.select(F.col("name").alias("table_name"), F.posexplode("columns").alias("ord", "c")).select("table_name", F.trim("c.name").alias("name"), F.coalesce("c.description", F.lit("")).alias("text"), "ord")


def read_ident_report(spark: SparkSession, path: str) -> DataFrame:
    """path, code, format, mime, basis, warning from the first match of each file of an identification report."""
    schema = "files array<struct<filename:string,matches:array<struct<id:string,format:string,mime:string,basis:string,warning:string>>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("files").alias("f"))
    first = F.get("f.matches", F.lit(0))
    return raw.select(F.col("f.filename").alias("path"), first["id"].alias("code"), first["format"].alias("format"), first["mime"].alias("mime"), first["basis"].alias("basis"), first["warning"].alias("warning"))


def typed(rows: DataFrame, schema: StructType) -> DataFrame:
    """Text rows cast to a schema by name; what does not fit becomes null."""
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])

"""Queries of readers and incremental intake, over files that Spark writes from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog as C, ledger as LG, lobs as L
from ..sources import readers, writers
from ..sources.shared import parallel, shared_folder
from ..streaming.intake import format_counts, live_counts, start_counts, start_intake
from .demo_catalog import FINDINGS
from .demo_ledger import CLEAN, FAILED
from .fixtures import Inputs
from .registry import demo


def _folder(i: Inputs, name: str) -> str:
    return f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def _files(i: Inputs) -> DataFrame:
    """Documents as files with a content and the columns of the binary source."""
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.4 ").when(F.col("doc_id") % 3 == 1, "<?xml version='1.0'?>").otherwise("")
    return i.documents.select(F.concat(F.lit("content/schema0/table0/lob1/rec"), "doc_id").alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.length("text").cast("long").alias("length"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))


_EXT = "CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xml' ELSE 'txt' END"


@demo(f"SELECT {_EXT} AS ext, count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def stream_format_counts(i: Inputs) -> DataFrame:
    """Files arrive in three parts. The counts of the first are made in several batches, then the query ends; it is started again for each other part."""
    source, target, point = _folder(i, "in"), _folder(i, "counts"), _folder(i, "point")
    for part in range(3):
        _files(i).where(F.pmod(F.xxhash64("path"), F.lit(3)) == part).repartition(4).write.mode("append").parquet(source)
        start_counts(i.spark, source, target, point, "parquet", files_per_batch=2).awaitTermination()
    return live_counts(i.spark, target).select("ext", "count", "bytes")


@demo(f"SELECT {_EXT} AS ext, count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def inventory_format_counts(i: Inputs) -> DataFrame:
    """The same sums over a finished inventory."""
    source, target = _folder(i, "in"), _folder(i, "inventory")
    _files(i).write.parquet(source)
    start_intake(i.spark, source, target, _folder(i, "point"), "parquet").awaitTermination()
    return format_counts(i.spark.read.parquet(target))


@demo("SELECT concat('content/schema0/table0/lob1/rec', doc_id) AS path, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xml' ELSE 'txt' END AS ext FROM documents")
def stream_intake(i: Inputs) -> DataFrame:
    source, target = _folder(i, "in"), _folder(i, "inventory")
    _files(i).write.parquet(source)
    start_intake(i.spark, source, target, _folder(i, "point"), "parquet").awaitTermination()
    return i.spark.read.parquet(target).select("path", "ext")


@demo("SELECT CAST(o_orderkey AS VARCHAR) AS c1, o_orderstatus AS c2, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS c3 FROM orders")
def scan_rows(i: Inputs) -> DataFrame:
    path = _folder(i, "rows")
    rows = i.orders.select(F.col("o_orderkey").cast("string").alias("c1"), F.col("o_orderstatus").alias("c2"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("c3"))
    rows.write.format("xml").option("rootTag", "table").option("rowTag", "row").save(path)
    return readers.read_rows(i.spark, path, 3).select("c1", "c2", "c3")


@demo(f"WITH {CLEAN} SELECT src_path, src_size, src_ext, dst_path, dst_size, dst_ext, note FROM lc")
def ledger_file(i: Inputs) -> DataFrame:
    path = _folder(i, "ledger")
    writers.write_ledger(i.d_ledger.drop("line_no"), path)
    return readers.read_ledger(i.spark, path).drop("line_no")


@demo(f"WITH {FAILED} SELECT path, ext, msg, source FROM lf")
def failed_from_files(i: Inputs) -> DataFrame:
    """Error log and ledger as files, written in the order of their lines and read again."""
    log, ledger = _folder(i, "log"), _folder(i, "ledger")
    n = parallel(i.spark)
    i.d_errlog.repartitionByRange(n, "line_no").sortWithinPartitions("line_no").select("line").write.text(log)
    writers.write_ledger(i.d_ledger.repartitionByRange(n, "line_no").sortWithinPartitions("line_no").drop("line_no"), ledger)
    return LG.failed_files(readers.read_errors(i.spark, log), readers.read_ledger(i.spark, ledger))


@demo("SELECT CAST(o_orderkey AS VARCHAR) AS c1, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS c2, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(o_orderstatus, '<&>') END AS c3, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_pos FROM orders")
def rows_round_trip(i: Inputs) -> DataFrame:
    """Rows written by the sink, in order, and read again with their places."""
    path, k = _folder(i, "sink"), F.col("o_orderkey")
    rows = i.orders.repartitionByRange(parallel(i.spark), k).sortWithinPartitions(k)
    writers.write_rows(rows.select(k.cast("string").alias("c1"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("c2"), F.when(k % 5 == 0, "").otherwise(F.concat("o_orderstatus", F.lit("<&>"))).alias("c3")), path)
    return readers.read_rows(i.spark, path, 3).select("c1", "c2", "c3", "row_pos")


@demo("""SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS INTEGER) AS event, concat(event_label, ': ', message) AS detail FROM d_steps WHERE modifies AND success AND NOT skipped AND changed > 0""")
def events_appended(i: Inputs) -> DataFrame:
    """Events of even and odd runs, appended one after the other."""
    path = _folder(i, "events")
    for odd in (0, 1):
        writers.write_events(C.provenance_events(i.d_steps.where(F.substring("run_id", 2, 9).cast("int") % 2 == odd)), path)
    return i.spark.read.parquet(path).select("run_id", "event", "detail")


@demo("SELECT concat('f', item_id) AS path, CASE WHEN item_id % 4 = 0 THEN NULL ELSE concat('fmt/', item_id) END AS code FROM benchmark")
def ident_report(i: Inputs) -> DataFrame:
    path = _folder(i, "report")
    match = F.struct(F.concat(F.lit("fmt/"), "item_id").alias("id"), F.lit("x").alias("mime"))
    entry = F.struct(F.concat(F.lit("f"), "item_id").alias("filename"), F.when(F.col("item_id") % 4 != 0, F.array(match)).otherwise(F.array().cast("array<struct<id:string,mime:string>>")).alias("matches"))
    reports = i.benchmark.groupBy(F.floor(F.col("item_id") / 50).alias("report")).agg(F.collect_list(entry).alias("files"))
    reports.write.partitionBy("report").json(path)  # one report of 50 entries per file
    return readers.read_ident_report(i.spark, path).select("path", "code")


@demo("SELECT table_name AS name, max_by(description, table_key) AS description FROM d_tables WHERE archive_id = 'a0' GROUP BY 1")
def template_tables(i: Inputs) -> DataFrame:
    path = _folder(i, "template")
    entries = F.array_sort(F.collect_list(F.struct("table_key", F.col("table_name").alias("name"), "description")))
    root = F.to_json(F.struct(F.transform(entries, lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"))).alias("tables")))
    templates = i.d_tables.where("archive_id = 'a0'").groupBy(F.substring_index("table_key", "/", 1).alias("part")).agg(root.alias("value"))
    templates.write.partitionBy("part").text(path)  # one template per schema
    return readers.read_template(i.spark, path).select("name", "description")


def _nested_template(i: Inputs) -> DataFrame:
    """A template for each table of archive a1, the list at one of four depths, lines and all; a list deeper down or further on does not count."""
    path = _folder(i, "nested")
    one = lambda name, text: F.concat(F.lit('[{"name": '), F.to_json(F.struct(name.alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(name.alias("n")))) - 6), F.lit(', "description": "'), text, F.lit('",\n "columns": [{"name": "id", "description": "Key of '), F.col("table_key"), F.lit('"}, {"name": "note"}]}]'))
    real, other = one(F.col("table_name"), F.concat(F.lit("At "), F.col("table_key"))), one(F.lit("decoy"), F.lit("none"))
    kind = F.col("declared_rows") / 1000 % 4
    root = (
        F.when(kind == 0, real)
        .when(kind == 1, F.concat(F.lit('{"version": 1,\n "x": {"tables": '), other, F.lit('}, "tables": '), real, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"b": {"tables": "none", "c": {"d": {"tables": '), other, F.lit('}}}, "a": {"list": [1, 2], "k": {"tables": '), real, F.lit('}}, "z": {"k": {"tables": '), other, F.lit("}}}")))
        .otherwise(F.concat(F.lit('{"p": {"q": {"r": {"tables":\n'), real, F.lit("}}}, \"t\": {\"q\": {\"r\": {\"s\": {\"tables\": "), other, F.lit("}}}}}")))
    )
    templates = i.d_tables.where("archive_id = 'a1'").select(F.substring_index("table_key", "/", 1).alias("part"), F.translate("table_key", "/", "-").alias("t"), root.alias("value"))
    templates.where("part in ('schema0', 'schema1', 'schema2')").drop("part").write.partitionBy("t").text(path)
    return readers.read_template(i.spark, path)


_NESTED = "SELECT table_name, max_by(table_key, translate(table_key, '/', '-')) AS table_key FROM d_tables WHERE archive_id = 'a1' AND split_part(table_key, '/', 1) IN ('schema0', 'schema1', 'schema2') GROUP BY 1"


@demo(f"SELECT table_name AS name, concat('At ', table_key) AS description, 2 AS columns FROM ({_NESTED})")
def template_nested(i: Inputs) -> DataFrame:
    return _nested_template(i).select("name", "description", F.size("columns").alias("columns"))


@demo(f"SELECT table_name, 'id' AS name, concat('Key of ', table_key) AS text, 0 AS ord FROM ({_NESTED}) UNION ALL SELECT table_name, 'note', '', 1 FROM ({_NESTED})")
def template_columns(i: Inputs) -> DataFrame:
    return readers.template_columns(_nested_template(i))


def _catalogs(i: Inputs) -> dict[str, DataFrame]:
    """The catalogs of both archives as files, read again."""
    path = _folder(i, "catalog")
    column = F.struct("name", F.nullif(F.col("lob_folder"), F.lit("")).alias("lobFolder"), "type", "description")
    columns = i.d_columns.groupBy("archive_id", "table_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", column.alias("c")))), lambda x: x["c"]).alias("column"))
    foreign = F.struct("name", F.substring_index("ref_table_key", "/", 1).alias("referencedSchema"), F.substring_index("ref_table_key", "/", -1).alias("referencedTable"), F.array(F.struct(F.col("col").alias("column"), F.col("ref_col").alias("referenced"))).alias("reference"))
    keys = i.d_keys.groupBy("archive_id", "table_key").agg(F.collect_list(foreign).alias("foreignKey"))
    primary = i.d_primary.groupBy("archive_id", "table_key").agg(F.array_sort(F.collect_list("col")).alias("pk"))
    tables = i.d_tables
    for df in (columns, keys, primary):
        tables = tables.join(df, ["archive_id", "table_key"], "left")
    table = F.struct(
        F.col("table_name").alias("name"), F.substring_index("table_key", "/", -1).alias("folder"), "description", F.when(F.col("column").isNotNull(), F.struct("column")).alias("columns"),
        F.when(F.col("pk").isNotNull(), F.struct(F.lit("pk").alias("name"), F.col("pk").alias("column"))).alias("primaryKey"), F.when(F.col("foreignKey").isNotNull(), F.struct("foreignKey")).alias("foreignKeys"), F.col("declared_rows").alias("rows"),
    )
    view = F.struct(F.concat(F.lit("v_"), F.substring_index(F.min("table_key"), "/", 1)).alias("name"), F.lit("select 1").alias("query"), F.count("*").alias("rows"))
    schemas = tables.groupBy("archive_id", F.col("schema_name").alias("name"), F.substring_index("table_key", "/", 1).alias("folder")).agg(F.struct(F.collect_list(table).alias("table")).alias("tables"), F.struct(F.array(view).alias("view")).alias("views"))
    for archive in ("a0", "a1"):
        schemas.where(F.col("archive_id") == archive).drop("archive_id").write.format("xml").option("rootTag", "schemas").option("rowTag", "schema").save(f"{path}/{archive}/header/metadata.xml")
    return readers.read_catalog(i.spark, path)


@demo("SELECT archive_id, split_part(table_key, '/', 1) AS schema_folder, schema_name, table_key, table_name, description, CAST(declared_rows AS BIGINT) AS declared_rows FROM d_tables")
def catalog_tables(i: Inputs) -> DataFrame:
    return _catalogs(i)["tables"].select("archive_id", "schema_folder", "schema_name", "table_key", "table_name", "description", "declared_rows")


@demo("SELECT DISTINCT archive_id, schema_name AS name, split_part(table_key, '/', 1) AS folder, '' AS description FROM d_tables")
def catalog_schemas(i: Inputs) -> DataFrame:
    return _catalogs(i)["schemas"]


@demo("""SELECT archive_id, table_key, CAST(row_number() OVER (PARTITION BY archive_id, table_key ORDER BY col_idx) AS INTEGER) AS col_idx, name, type, CASE WHEN type LIKE 'VARCHAR%' THEN 25 END AS max_len, type IN ('BLOB', 'CLOB') AS is_lob, nullif(lob_folder, '') AS lob_folder, description FROM d_columns""")
def catalog_columns(i: Inputs) -> DataFrame:
    return _catalogs(i)["columns"].select("archive_id", "table_key", "col_idx", "name", "type", "max_len", "is_lob", "lob_folder", "description")


@demo("""SELECT archive_id, table_key, 'fk' AS kind, name, replace(ref_table_key, '/', '.') AS ref_table, 'parent_id=id' AS cols FROM d_keys SEMI JOIN d_tables USING (archive_id, table_key)
UNION ALL SELECT archive_id, table_key, 'pk', 'pk', NULL, string_agg(col || '=', ',' ORDER BY col) FROM d_primary SEMI JOIN d_tables USING (archive_id, table_key) GROUP BY ALL""")
def catalog_keys(i: Inputs) -> DataFrame:
    cols = F.array_join(F.transform("cols", lambda c: F.concat(c["column"], F.lit("="), F.coalesce(c["referenced"], F.lit("")))), ",")
    return _catalogs(i)["keys"].select("archive_id", "table_key", "kind", "name", "ref_table", cols.alias("cols"))


@demo("SELECT archive_id, schema_name, split_part(table_key, '/', 1) AS schema_folder, concat('v_', split_part(table_key, '/', 1)) AS view_name, 'select 1' AS query, count(*) AS declared_rows FROM d_tables GROUP BY ALL")
def catalog_views(i: Inputs) -> DataFrame:
    return _catalogs(i)["views"].select("archive_id", "schema_name", "schema_folder", "view_name", "query", "declared_rows")


def _headers(i: Inputs) -> str:
    """A catalog file for each region: a header and its nations as schemas; the third one breaks off."""
    path = _folder(i, "headers")
    k = F.col("r_regionkey")
    nations = i.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<schema><name>"), "n_name", F.lit("</name></schema>")))), "\n").alias("schemas"))
    owner = F.when(k % 2 == 0, F.concat(F.lit("<dataOwner>Owner "), k, F.lit("</dataOwner>"))).otherwise("")
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<archive version="2.'), k % 3, F.lit('">\n<dbname>'), "r_name", F.lit(" &amp; co</dbname>\n"), owner, F.lit("<databaseProduct>P"), k,
        F.lit("</databaseProduct>\n<messageDigest><digestType>SHA-256</digestType><digest>"), F.sha2("r_name", 256), F.lit("</digest></messageDigest>\n<schemas>"), F.coalesce("schemas", F.lit("")), F.when(k == 2, "</schemas>").otherwise("</schemas></archive>"),
    )
    rows = i.region.join(nations, "r_regionkey", "left").select("r_regionkey", text.alias("value"))
    for key in range(5):
        rows.where(k == key).select("value").coalesce(1).write.text(f"{path}/r{key}/header/metadata.xml")
    return path


@demo("SELECT concat('r', r_regionkey) AS archive_id, concat(r_name, ' & co') AS db_name, concat('P', r_regionkey) AS product, CASE WHEN r_regionkey % 2 = 0 THEN concat('Owner ', r_regionkey) END AS owner, concat('2.', r_regionkey % 3) AS version, sha256(r_name) AS digest, 'SHA-256' AS digest_algo FROM region")
def catalog_databases(i: Inputs) -> DataFrame:
    return readers.read_databases(i.spark, _headers(i)).select("archive_id", "db_name", "product", "owner", "version", "digest", "digest_algo")


#: Rows of orders in files of 2,000 keys each; every so often one is broken, and every third file has no end.
_BUCKET = "CAST(floor(o_orderkey / 2000) AS INTEGER)"
_FAULTS = f"""SELECT {_BUCKET} AS part, 'row is not well formed' AS fault, count(*) AS n FROM orders WHERE o_orderkey % 11 = 3 OR o_orderkey % 13 = 4 GROUP BY 1
UNION ALL SELECT {_BUCKET}, 'text between rows', count(*) FROM orders WHERE o_orderkey % 17 = 5 AND o_orderkey NOT IN (SELECT min(o_orderkey) FROM orders GROUP BY {_BUCKET}) GROUP BY 1
UNION ALL SELECT {_BUCKET}, 'root does not end once', CAST(1 AS BIGINT) FROM orders WHERE {_BUCKET} % 3 = 1 GROUP BY 1"""


def _row_files(i: Inputs) -> str:
    path = _folder(i, "tables")
    k, first = F.col("o_orderkey"), F.col("part") * 2000
    cell = F.when(k % 11 == 3, "<c1>a</c2>").when(k % 13 == 4, "<c1>a & b</c1>").otherwise(F.concat(F.lit("<c1>"), k, F.lit("</c1>\n <c2/><!-- c -->")))
    rows = i.orders.select("o_orderkey", F.floor(k / 2000).cast("int").alias("part"), cell.alias("cell"))
    rows = rows.join(rows.groupBy("part").agg(F.min("o_orderkey").alias("least")), "part")
    junk = F.when((k % 17 == 5) & (k != F.col("least")), "junk").otherwise("")
    files = rows.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(junk, F.lit("<row>"), "cell", F.lit("</row>")).alias("row")))), lambda r: r["row"]), "\n").alias("rows"))
    text = F.concat(F.lit('<?xml version="1.0"?>\n<table>'), "rows", F.when(F.col("part") % 3 == 1, "").otherwise("</table>"))
    files.select("part", text.alias("value")).write.partitionBy("part").text(f"{path}/a0/content")
    return path


def _faults(i: Inputs) -> DataFrame:
    return readers.row_faults(i.spark, f"{_row_files(i)}/a0/content").select("archive_id", F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), "fault", "n")


@demo(_FAULTS)
def row_faults(i: Inputs) -> DataFrame:
    return _faults(i).select("part", "fault", "n")


_XSD = "SELECT archive_id, 'table file has no schema file' AS rule, 'warning' AS severity, concat('content/', table_key, '/', split_part(table_key, '/', 2), '.xml') AS subject, CAST(1 AS BIGINT) AS n FROM d_tables WHERE declared_rows % 3000 = 0"
_ALL_FINDINGS = f"""{FINDINGS} UNION ALL {_XSD} UNION ALL SELECT 'a0', 'table file is not well formed', 'error', concat('part ', part, ': ', fault), n FROM ({_FAULTS})
UNION ALL SELECT concat('r', r_regionkey), 'required element is missing', 'error', 'dataOwner', 1 FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT concat('r', r_regionkey), 'archive has no tables', 'warning', concat('r', r_regionkey), 1 FROM region
UNION ALL SELECT 'r2', 'table file is not well formed', 'error', 'header/metadata.xml: catalog is not well formed', 1"""


def _findings(i: Inputs) -> DataFrame:
    """The catalogs of two archives, files that lack their schema, rows that are broken, headers of five more archives."""
    file = F.concat_ws("/", F.lit("content"), "table_key", F.substring_index("table_key", "/", -1))
    files = i.d_tables.select("archive_id", F.concat(file, F.lit(".xml")).alias("path"), F.lit("xml").alias("ext")).unionByName(i.d_tables.where("declared_rows % 3000 != 0").select("archive_id", F.concat(file, F.lit(".xsd")).alias("path"), F.lit("xsd").alias("ext")))
    rows = _faults(i).select("archive_id", F.concat(F.lit("part "), "part").alias("path"), "fault", "n")
    headers = _headers(i)
    rows = rows.unionByName(readers.catalog_faults(i.spark, headers))
    return C.validation_findings(i.d_tables, i.d_columns, i.d_keys, files, rows, readers.catalog_elements(i.spark, headers), ["DBName", "dataOwner", "schemas"])


@demo(_ALL_FINDINGS)
def validation_files(i: Inputs) -> DataFrame:
    return _findings(i)


@demo(f"""WITH vf AS ({_ALL_FINDINGS}), a AS (SELECT DISTINCT archive_id FROM d_tables UNION ALL SELECT concat('r', r_regionkey) FROM region), c AS (SELECT archive_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM vf GROUP BY 1)
SELECT archive_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'passed with warnings' ELSE 'passed' END AS result FROM a LEFT JOIN c USING (archive_id)""")
def validation_result(i: Inputs) -> DataFrame:
    archives = i.d_tables.select("archive_id").unionByName(i.region.select(F.concat(F.lit("r"), "r_regionkey").alias("archive_id")))
    return C.validation_result(archives, _findings(i))


@demo("SELECT archive_id, path, table_key, lob, basename, regexp_extract(basename, '\\.([^.]*)$', 1) AS ext, length FROM d_inv")
def lob_inventory(i: Inputs) -> DataFrame:
    """Files as the binary source lists them, table files among them."""
    store = lambda path: F.concat_ws("/", F.lit("file:/store"), "archive_id", path)
    files = i.d_inv.select(store(F.col("path")).alias("path"), "length", F.lit(None).cast("timestamp").alias("modificationTime"))
    tables = i.d_tables.select(store(F.concat_ws("/", F.lit("content"), "table_key", F.lit("table0.xml"))).alias("path"), F.lit(1).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return readers.inventory_of(files.unionByName(tables)).drop("modified")


@demo("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS col_idx, concat('rec', o_orderkey, '.bin') AS ref, CAST(o_orderkey * 7 AS BIGINT) AS length, upper(md5(CAST(o_orderkey AS VARCHAR))) AS digest, 'MD5' AS digest_type FROM orders WHERE o_orderkey % 5 <> 0")
def lob_refs(i: Inputs) -> DataFrame:
    """References in the cells of a table file; every fifth row has none."""
    path, k = _folder(i, "cells"), F.col("o_orderkey")
    cell = lambda rest: F.when((k % 5 != 0) & (k % 2 == rest), F.struct(F.concat(F.lit("rec"), k, F.lit(".bin")).alias("_file"), (k * 7).cast("long").alias("_length"), F.upper(F.md5(F.encode(k.cast("string"), "UTF-8"))).alias("_digest"), F.lit("MD5").alias("_digestType")))
    i.orders.select(k.cast("string").alias("c1"), cell(0).alias("c2"), cell(1).alias("c3")).write.format("xml").option("rootTag", "table").option("rowTag", "row").option("attributePrefix", "_").save(path)
    rows = readers.read_rows(i.spark, path, 3, {2, 3})
    refs = readers.lob_refs(rows, [2, 3])
    return refs.join(rows.select("table_key", "row_pos", F.col("c1").alias("id")), ["table_key", "row_pos"]).select("id", "col_idx", "ref", "length", "digest", "digest_type")


@demo()
def container_profile(i: Inputs) -> DataFrame:
    """Documents packed by a task into gz, bz2 and zip, and profiled again."""
    import bz2
    import gzip
    import io
    import zipfile

    def pack(batches):
        for b in batches:
            out = []
            for k, t in zip(b["doc_id"], b["text"], strict=True):
                raw = (t or "").encode()
                z = io.BytesIO()
                with zipfile.ZipFile(z, "w") as f:
                    f.writestr("a.txt", raw)
                    f.writestr("b.txt", raw[:10])
                out.append((gzip.compress(raw, 1), bz2.compress(raw, 1), z.getvalue())[k % 3])
            yield b.assign(path="p" + b["doc_id"].astype(str), content=out)[["path", "content"]]

    return L.container_profile(i.documents.select("doc_id", "text").mapInPandas(pack, "path string, content binary"))

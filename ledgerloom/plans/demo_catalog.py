"""Queries of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog as C
from .fixtures import Inputs
from .registry import demo


@demo(r"""WITH h AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('<a version="2.', o_orderkey % 3, '" x="y">') WHEN 1 THEN concat('<a xmlns="http://ns.example.org/arch/', 1 + o_orderkey % 2, '.', o_orderkey % 3, '/metadata.xsd">') WHEN 2 THEN '<a>' ELSE NULL END AS header FROM orders)
SELECT o_orderkey, CASE WHEN regexp_extract(header, 'version="([0-9.]+)"', 1) <> '' THEN regexp_extract(header, 'version="([0-9.]+)"', 1) WHEN header IS NULL THEN NULL ELSE regexp_extract(header, '/([0-9]+(\.[0-9]+)?)/', 1) END AS version FROM h""")
def version_detect(i: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    header = F.when(k % 4 == 0, F.concat(F.lit('<a version="2.'), k % 3, F.lit('" x="y">'))).when(k % 4 == 1, F.concat(F.lit('<a xmlns="http://ns.example.org/arch/'), 1 + k % 2, F.lit("."), k % 3, F.lit('/metadata.xsd">'))).when(k % 4 == 2, F.lit("<a>"))
    return i.orders.select("o_orderkey", C.version_of(header).alias("version"))


_SAFE = """s AS (SELECT archive_id, schema_name, min(table_key) AS first FROM d_tables GROUP BY ALL), o AS (SELECT archive_id, schema_name, row_number() OVER (PARTITION BY archive_id ORDER BY first) - 1 AS ordinal FROM s)"""
_BAD = "trim(schema_name) <> '' AND NOT regexp_matches(schema_name, '^[A-Za-z0-9_.-]+$')"


@demo(f"WITH {_SAFE} SELECT archive_id, schema_name, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN {_BAD} THEN concat('schema', ordinal) ELSE schema_name END AS safe_name, {_BAD} AS renamed FROM o")
def schema_sanitize(i: Inputs) -> DataFrame:
    return C.sanitize_schemas(i.d_tables)


#: Archive a0 has fixes for several of its nameless schemas, a1 for one alone.
_FIX = """f AS (SELECT DISTINCT archive_id, split_part(table_key, '/', 1) AS folder, concat('Restored ', split_part(table_key, '/', 1)) AS fixed FROM d_tables WHERE trim(schema_name) = '' AND (archive_id = 'a0' AND ends_with(split_part(table_key, '/', 1), '2') OR split_part(table_key, '/', 1) = 'schema2')),
of AS (SELECT archive_id, CASE WHEN count(*) = 1 THEN min(fixed) END AS only_one FROM f GROUP BY 1)"""


def _fixes(i: Inputs) -> DataFrame:
    folder = F.substring_index("table_key", "/", 1)
    some = (F.trim("schema_name") == "") & (((F.col("archive_id") == "a0") & folder.endswith("2")) | (folder == "schema2"))
    return i.d_tables.where(some).select("archive_id", folder.alias("schema_folder"), F.concat(F.lit("Restored "), folder).alias("fixed_name")).distinct()


@demo(f"""WITH {_FIX} SELECT archive_id, table_key, CASE WHEN trim(schema_name) <> '' THEN schema_name ELSE coalesce(fixed, only_one, '') END AS schema_name, trim(schema_name) = '' AND coalesce(fixed, only_one) IS NOT NULL AS filled, trim(schema_name) = '' AND coalesce(fixed, only_one) IS NULL AS unresolved
FROM d_tables LEFT JOIN f USING (archive_id) LEFT JOIN of USING (archive_id) WHERE folder = split_part(table_key, '/', 1) UNION ALL
SELECT archive_id, table_key, CASE WHEN trim(schema_name) <> '' THEN schema_name ELSE coalesce(only_one, '') END, trim(schema_name) = '' AND only_one IS NOT NULL, trim(schema_name) = '' AND only_one IS NULL
FROM d_tables LEFT JOIN of USING (archive_id) WHERE (archive_id, split_part(table_key, '/', 1)) NOT IN (SELECT (archive_id, folder) FROM f)""")
def schema_fill(i: Inputs) -> DataFrame:
    return C.fill_schema_names(i.d_tables, _fixes(i))


#: Keys name the schema of the table they refer to; a nameless one leaves the reference empty.
_EMPTY_REFS = f"""{_FIX}, r AS (SELECT k.archive_id, k.table_key, k.name, t.schema_name AS ref_schema FROM d_keys k JOIN d_tables t ON t.archive_id = k.archive_id AND t.table_key = k.ref_table_key),
e AS (SELECT r.archive_id, table_key, name, CASE WHEN trim(ref_schema) <> '' THEN ref_schema ELSE coalesce(fixed, only_one, '') END AS ref_schema, trim(ref_schema) = '' AND coalesce(fixed, only_one) IS NOT NULL AS updated, trim(ref_schema) = '' AND coalesce(fixed, only_one) IS NULL AS unresolved
FROM r LEFT JOIN f ON f.archive_id = r.archive_id AND f.folder = split_part(table_key, '/', 1) LEFT JOIN of ON of.archive_id = r.archive_id)"""


def _filled_refs(i: Inputs) -> DataFrame:
    target = i.d_tables.select("archive_id", F.col("table_key").alias("ref_table_key"), F.col("schema_name").alias("ref_schema"))
    refs = i.d_keys.join(target, ["archive_id", "ref_table_key"]).select("archive_id", "table_key", "name", "ref_schema")
    return C.fill_schema_refs(refs, _fixes(i))


@demo(f"WITH {_EMPTY_REFS} SELECT * FROM e")
def schema_ref_fill(i: Inputs) -> DataFrame:
    return _filled_refs(i)


@demo(f"WITH {_EMPTY_REFS} SELECT archive_id, count(*) AS refs, count(*) FILTER (updated) AS updated, count(*) FILTER (unresolved) AS unresolved FROM e GROUP BY 1")
def schema_ref_counts(i: Inputs) -> DataFrame:
    return C.schema_ref_counts(_filled_refs(i))


@demo("SELECT archive_id, table_key, table_name FROM d_tables WHERE lower(table_name) NOT IN (SELECT lower(table_name) FROM d_tables WHERE declared_rows % 5000 = 0)")
def table_drop(i: Inputs) -> DataFrame:
    marked = i.d_tables.where("declared_rows % 5000 = 0").select(F.concat(F.upper("table_name"), F.lit(" ")).alias("table_name"))
    return C.drop_tables(i.d_tables, marked).select("archive_id", "table_key", "table_name")


#: Marked archive by archive.
_LEFT = "lf AS (SELECT archive_id, table_key FROM d_tables WHERE (archive_id, lower(table_name)) NOT IN (SELECT (archive_id, lower(table_name)) FROM d_tables WHERE declared_rows % 5000 = 0))"


@demo(f"""WITH {_LEFT} SELECT 'column' AS kind, archive_id, table_key, name FROM d_columns SEMI JOIN lf USING (archive_id, table_key)
UNION ALL SELECT 'key', k.archive_id, k.table_key, name FROM d_keys k JOIN lf a ON a.archive_id = k.archive_id AND a.table_key = k.table_key JOIN lf b ON b.archive_id = k.archive_id AND b.table_key = ref_table_key
UNION ALL SELECT 'file', archive_id, table_key, path FROM d_inv SEMI JOIN lf USING (archive_id, table_key)""")
def table_drop_cascade(i: Inputs) -> DataFrame:
    left = C.drop_tables(i.d_tables, i.d_tables.where("declared_rows % 5000 = 0").select("archive_id", "table_name"))
    shown = lambda kind, df, name: C.of_tables(left, df).select(F.lit(kind).alias("kind"), "archive_id", "table_key", F.col(name).alias("name"))
    return shown("column", i.d_columns, "name").unionByName(shown("key", i.d_keys, "name")).unionByName(shown("file", i.d_inv, "path"))


@demo("""WITH sf AS (SELECT archive_id, table_key FROM d_tables WHERE ends_with(split_part(table_key, '/', 1), '1')),
c AS (SELECT archive_id, table_key, count(*) AS columns FROM d_columns GROUP BY ALL), k AS (SELECT k.archive_id, k.table_key, count(*) AS keys FROM d_keys k JOIN sf ON sf.archive_id = k.archive_id AND sf.table_key = ref_table_key GROUP BY ALL)
SELECT archive_id, table_key, coalesce(columns, 0) AS columns, coalesce(keys, 0) AS keys FROM sf LEFT JOIN c USING (archive_id, table_key) LEFT JOIN k USING (archive_id, table_key)""")
def schema_select_cascade(i: Inputs) -> DataFrame:
    kept = i.d_tables.where(F.substring_index("table_key", "/", 1).endswith("1"))
    n = lambda df, name: C.of_tables(kept, df).groupBy(*C.TABLE).agg(F.count("*").alias(name))
    return kept.select(*C.TABLE).join(n(i.d_columns, "columns"), C.TABLE, "left").join(n(i.d_keys, "keys"), C.TABLE, "left").na.fill(0)


@demo(f"""WITH {_SAFE}, b AS (SELECT archive_id, lower(trim(schema_name)) AS k, arg_min(concat('schema', ordinal), ordinal) AS safe FROM o WHERE {_BAD} GROUP BY ALL),
t AS (SELECT archive_id, table_key AS ref_table_key, schema_name FROM d_tables)
SELECT archive_id, d_keys.table_key, name, coalesce(safe, concat(upper(schema_name), ' ')) AS ref_schema, safe IS NOT NULL AS renamed FROM d_keys JOIN t USING (archive_id, ref_table_key) LEFT JOIN b USING (archive_id) WHERE k = lower(trim(schema_name))
UNION ALL SELECT archive_id, d_keys.table_key, name, concat(upper(schema_name), ' '), false FROM d_keys JOIN t USING (archive_id, ref_table_key) WHERE (archive_id, lower(trim(schema_name))) NOT IN (SELECT (archive_id, k) FROM b)""")
def schema_refs(i: Inputs) -> DataFrame:
    """Keys name the schema of the table they refer to, in capitals and with a blank after it."""
    target = i.d_tables.select("archive_id", F.col("table_key").alias("ref_table_key"), F.concat(F.upper("schema_name"), F.lit(" ")).alias("ref_schema"))
    refs = i.d_keys.join(target, ["archive_id", "ref_table_key"]).select("archive_id", "table_key", "name", "ref_schema")
    return C.rename_schema_refs(refs, C.sanitize_schemas(i.d_tables))


@demo("""WITH s AS (SELECT * FROM (VALUES ('custkey'), ('NAME'), ('orderkey'), ('absent')) v(suffix) CROSS JOIN (SELECT DISTINCT archive_id FROM d_columns)), c AS (SELECT archive_id, table_key, name, lower(regexp_replace(name, '^[^_]*_', '')) AS k FROM d_columns WHERE contains(name, '_'))
SELECT s.archive_id, suffix, table_key, name AS column_name, name IS NULL AS missing FROM s LEFT JOIN c ON k = lower(suffix) AND c.archive_id = s.archive_id""")
def suffix_resolve(i: Inputs) -> DataFrame:
    return C.resolve_suffixes(i.d_columns, ["custkey", "NAME", "orderkey", "absent"])


_TEMPLATE = "tp AS (SELECT lower(table_name) AS t, lower(name) AS k, concat('About ', name) AS text FROM d_tables JOIN d_columns USING (archive_id, table_key) WHERE archive_id = 'a0' AND col_idx <> 2 GROUP BY ALL)"
_ENRICHED = f"""{_TEMPLATE}, ec AS (SELECT archive_id, table_key, name, CASE WHEN name = 'c_name' AND archive_id = 'a1' THEN 'By hand' WHEN description <> '' THEN description ELSE coalesce(text, '') END AS description, CASE WHEN name = 'c_name' AND archive_id = 'a1' THEN 'By hand' WHEN description <> '' THEN description ELSE coalesce(text, '') END <> description AS changed
FROM (SELECT c.*, lower(d.table_name) AS t FROM d_columns c LEFT JOIN d_tables d USING (archive_id, table_key)) x LEFT JOIN tp ON tp.t = x.t AND tp.k = lower(name)),
tt AS (SELECT lower(table_name) AS t, max_by(concat('Table of ', table_key), table_key) AS text FROM d_tables WHERE archive_id = 'a0' AND declared_rows > 3000 GROUP BY 1),
et AS (SELECT archive_id, table_key, table_name, CASE WHEN archive_id = 'a1' AND declared_rows = 0 THEN 'Empty' ELSE coalesce(text, description) END AS description, CASE WHEN archive_id = 'a1' AND declared_rows = 0 THEN 'Empty' ELSE coalesce(text, description) END <> description AS changed FROM d_tables LEFT JOIN tt ON t = lower(table_name))"""


def _enriched_columns(i: Inputs) -> DataFrame:
    """A template made of archive a0, with names in capitals; edits for a1."""
    named = i.d_columns.join(i.d_tables.select(*C.TABLE, "table_name"), C.TABLE)
    template = named.where("archive_id = 'a0' and col_idx != 2").select(F.upper("table_name").alias("table_name"), F.upper("name").alias("name"), F.concat(F.lit("About "), "name").alias("text"), F.col("col_idx").alias("ord"))
    edits = i.d_columns.where("name = 'c_name' and archive_id = 'a1'").select(*C.TABLE, "name", F.lit("By hand").alias("text"))
    return C.enrich(i.d_columns, i.d_tables, template, edits)


def _enriched_tables(i: Inputs) -> DataFrame:
    """A template that overwrites."""
    template = i.d_tables.where("archive_id = 'a0' and declared_rows > 3000").select(F.concat(F.lit(" "), F.upper("table_name")).alias("table_name"), F.concat(F.lit("Table of "), "table_key").alias("description"), F.col("table_key").alias("ord"))
    edits = i.d_tables.where("archive_id = 'a1' and declared_rows = 0").select(*C.TABLE, F.lit("Empty").alias("text"))
    return C.enrich_tables(i.d_tables, template, edits, overwrite=True)


@demo(f"WITH {_ENRICHED} SELECT * FROM ec")
def enrich_descriptions(i: Inputs) -> DataFrame:
    return _enriched_columns(i)


@demo(f"WITH {_ENRICHED} SELECT * FROM et")
def enrich_table_descriptions(i: Inputs) -> DataFrame:
    return _enriched_tables(i)


@demo(f"WITH {_ENRICHED} SELECT archive_id, (SELECT count(*) FROM et WHERE changed AND et.archive_id = a.archive_id) AS tables_changed, (SELECT count(*) FROM ec WHERE changed AND ec.archive_id = a.archive_id) AS columns_changed FROM (SELECT DISTINCT archive_id FROM et) a")
def enrich_counts(i: Inputs) -> DataFrame:
    return C.enriched_counts(_enriched_tables(i), _enriched_columns(i))


@demo("""WITH f AS (SELECT DISTINCT archive_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM d_inv), p AS (SELECT archive_id, concat('content/', table_key) AS prefix, CASE WHEN description <> '' THEN description ELSE table_name END AS description FROM d_tables UNION ALL SELECT 'a0', 'content/schema0', 'Main part')
SELECT archive_id, folder, (SELECT max_by(p.description, length(p.prefix)) FROM p WHERE p.archive_id = f.archive_id AND starts_with(folder, p.prefix || '/')) AS description FROM f""")
def folder_desc(i: Inputs) -> DataFrame:
    text = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("table_name"))
    prefixes = i.d_tables.select("archive_id", F.concat(F.lit("content/"), "table_key").alias("prefix"), text.alias("description")).unionAll(i.spark.createDataFrame([("a0", "content/schema0", "Main part")], "c string, a string, b string"))
    return C.longest_prefix(i.d_inv.select("archive_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct(), prefixes)


@demo(r"""WITH n AS (SELECT *, lower(table_name) AS l FROM d_tables), b AS (SELECT *, regexp_replace(regexp_replace(l, '[ _-]*(\d{4}[ _-]?\d{2}[ _-]?\d{2}|\d{6}|\d{4}([ _-]\d{2}){0,2})$', ''), '([ _-]*(tmp|temp|copy|kopi|bak|backup|bup))+$', '') AS base FROM n)
SELECT archive_id, table_key, table_name, base FROM b WHERE base <> '' AND base <> l AND (archive_id, base) IN (SELECT (archive_id, l) FROM n)""")
def copy_tables(i: Inputs) -> DataFrame:
    return C.copy_tables(i.d_tables)


@demo("SELECT archive_id, path FROM d_inv i WHERE ext = 'xml' AND NOT EXISTS (SELECT 1 FROM d_inv j WHERE j.ext = 'jpg' AND j.archive_id = i.archive_id AND regexp_extract(j.path, '^(.*/[^/.]*)', 1) = regexp_extract(i.path, '^(.*/[^/.]*)', 1))")
def sibling_missing(i: Inputs) -> DataFrame:
    return C.siblings_missing(i.d_inv, "xml", "jpg")


@demo("""WITH l AS (SELECT archive_id, table_key FROM d_columns WHERE lob_folder <> '' UNION SELECT archive_id, table_key FROM d_inv)
SELECT archive_id, count(DISTINCT split_part(table_key, '/', 1)) AS schemas, count(*) AS tables, CAST(sum(declared_rows) AS BIGINT) AS rows, count(*) FILTER ((archive_id, table_key) IN (SELECT (archive_id, table_key) FROM l)) AS lob_tables,
(SELECT count(*) FROM d_inv i WHERE i.archive_id = t.archive_id) AS lob_files, (SELECT string_agg(ext, ',' ORDER BY ext) FROM (SELECT DISTINCT archive_id, ext FROM d_inv) x WHERE x.archive_id = t.archive_id) AS exts FROM d_tables t GROUP BY archive_id""")
def archive_stats(i: Inputs) -> DataFrame:
    return C.archive_stats(i.d_tables, i.d_columns, i.d_inv)


@demo("""WITH a AS (SELECT archive_id, 'tables' AS kind, description FROM d_tables UNION ALL SELECT archive_id, 'columns', description FROM d_columns)
SELECT archive_id, kind, count(*) AS total, count(*) FILTER (description <> '') AS described, count(*) FILTER (description = '') AS undescribed, round(count(*) FILTER (description <> '') / count(*), 6) AS share FROM a GROUP BY ALL""")
def metadata_coverage(i: Inputs) -> DataFrame:
    return C.metadata_coverage(i.d_tables, i.d_columns)


_DEGREE = "dg AS (SELECT archive_id, table_key, (SELECT count(*) FROM d_keys k WHERE k.archive_id = t.archive_id AND k.ref_table_key = t.table_key) AS incoming, (SELECT count(*) FROM d_keys k WHERE k.archive_id = t.archive_id AND k.table_key = t.table_key) AS outgoing FROM d_tables t)"


@demo(f"WITH {_DEGREE} SELECT * FROM dg")
def fk_degree(i: Inputs) -> DataFrame:
    return C.fk_degree(i.d_tables, i.d_keys)


@demo(f"""WITH {_DEGREE}, s AS (SELECT archive_id, table_key, table_name, declared_rows, CAST({' + '.join(f"CAST(contains(lower(table_name), '{w}') AS INTEGER)" for w in C.ENTITY_WORDS)} AS INTEGER) AS hits, incoming FROM d_tables JOIN dg USING (archive_id, table_key)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY hits DESC, incoming DESC, declared_rows DESC, table_key) AS INTEGER) AS place FROM s WHERE hits > 0 OR incoming > 0) SELECT * FROM r WHERE place <= 4""")
def rank_tables(i: Inputs) -> DataFrame:
    return C.rank_tables(i.d_tables, i.d_keys, 4)


@demo("SELECT archive_id, table_key, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM d_inv GROUP BY ALL ORDER BY bytes DESC, archive_id, table_key LIMIT 5")
def top_tables(i: Inputs) -> DataFrame:
    return C.top_k(i.d_inv.groupBy(*C.TABLE).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")), [F.desc("bytes"), *C.TABLE], 5)


@demo("""WITH k AS (SELECT archive_id, table_key, concat(array_to_string(list_slice(list(col ORDER BY col), 1, 4), ', '), CASE WHEN count(*) > 4 THEN concat(' (+', count(*) - 4, ')') ELSE '' END) AS cols FROM d_primary GROUP BY ALL), f AS (SELECT archive_id, table_key, count(*) AS n FROM d_inv GROUP BY ALL)
SELECT archive_id, schema_name, table_name, declared_rows, coalesce(n, 0) AS lob_files, coalesce(cols, '') AS key_columns, description FROM d_tables LEFT JOIN k USING (archive_id, table_key) LEFT JOIN f USING (archive_id, table_key)""")
def inventory_listing(i: Inputs) -> DataFrame:
    return C.inventory_listing(i.d_tables, i.d_inv, i.d_primary)


FINDINGS = """SELECT archive_id, 'schema name is empty' AS rule, 'error' AS severity, table_key AS subject, CAST(1 AS BIGINT) AS n FROM d_tables WHERE trim(schema_name) = '' UNION ALL SELECT archive_id, 'table has no columns', 'error', table_key, 1 FROM d_tables ANTI JOIN d_columns USING (archive_id, table_key)
UNION ALL SELECT archive_id, 'table has no description', 'info', table_key, 1 FROM d_tables WHERE description = '' UNION ALL SELECT archive_id, 'table is empty', 'warning', table_key, 1 FROM d_tables WHERE declared_rows = 0
UNION ALL SELECT k.archive_id, 'key refers to an unknown table', 'error', name, 1 FROM d_keys k WHERE NOT EXISTS (SELECT 1 FROM d_tables t WHERE t.archive_id = k.archive_id AND t.table_key = k.ref_table_key)"""


@demo(FINDINGS)
def validation_findings(i: Inputs) -> DataFrame:
    return C.validation_findings(i.d_tables, i.d_columns, i.d_keys)


@demo("""SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS INTEGER) AS event, CASE WHEN event_type IN ('Adjustment', 'Migration', 'Tidying', 'Deletion', 'Anonymisation', 'Normalisation') THEN event_type ELSE 'Adjustment' END AS event_type, concat(event_label, ': ', message) AS detail, 0 AS outcome
FROM d_steps WHERE modifies AND success AND NOT skipped AND changed > 0""")
def provenance_events(i: Inputs) -> DataFrame:
    return C.provenance_events(i.d_steps)


@demo("""WITH s AS (SELECT scan_id, max(return_code) AS return_code, count(*) FILTER (regexp_matches(lower(line), 'found$|infected files: [1-9]|threat')) AS findings, count(*) FILTER (regexp_matches(lower(line), 'error|failed with')) AS errors FROM d_scanlog GROUP BY 1)
SELECT *, CASE WHEN findings > 0 THEN 'infected' WHEN errors > 0 OR return_code > 1 THEN 'error' WHEN return_code = 1 THEN 'suspect' ELSE 'clean' END AS verdict FROM s""")
def scan_log(i: Inputs) -> DataFrame:
    return C.scan_log_verdict(i.d_scanlog)

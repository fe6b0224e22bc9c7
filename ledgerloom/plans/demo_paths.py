"""Queries of large-object paths and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import paths as P
from .fixtures import Inputs
from .registry import demo

EXTERNAL = r"""(trim(ref) <> '' AND (contains(ref, '..') OR contains(ref, chr(92)) OR regexp_matches(trim(ref), '^[A-Za-z]:') OR regexp_matches(trim(ref), '^[A-Za-z][A-Za-z0-9+.-]*://') OR starts_with(trim(ref), '/')))"""
BASE = r"regexp_extract({0}, '[^/]*$')"
DIR = r"regexp_extract({0}, '^(.*)/[^/]*$', 1)"
TAIL = r"regexp_extract({0}, '[^/]*/?[^/]*$')"


@demo(r"""SELECT path, length, regexp_extract(path, '^content/(schema[^/]*)/(table[^/]*)/', 1) AS schema_folder, regexp_extract(path, '^content/(schema[^/]*)/(table[^/]*)/', 2) AS table_folder,
regexp_extract(path, '/(lob[^/]*)/', 1) AS lob_folder, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '\.([^./]*)$', 1) AS name_ext FROM d_inv""")
def path_keys(i: Inputs) -> DataFrame:
    return P.path_keys(i.d_inv.select("path", "length"), "path")


@demo(r"""WITH f AS (SELECT archive_id, table_key, CASE WHEN NOT contains(ref, '/') THEN 'basename' WHEN regexp_matches(ref, '^lob[^/]*/[^/]+$') THEN 'lob_relative' WHEN starts_with(ref, 'content/') THEN 'full_relative' ELSE 'other' END AS format FROM d_refs)
SELECT archive_id, table_key, format, count(*) AS n, count(*) OVER (PARTITION BY archive_id, table_key) > 1 AS mixed FROM f GROUP BY archive_id, table_key, format""")
def ref_formats(i: Inputs) -> DataFrame:
    return P.ref_formats(i.d_refs)


@demo(f"SELECT table_key, row_pos, ref, {EXTERNAL} AS external FROM d_refs")
def external_flag(i: Inputs) -> DataFrame:
    return i.d_refs.select("table_key", "row_pos", "ref", P.is_external("ref").alias("external"))


_STORE = "st AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('archives/store/', table_key, '/', lob, '/', basename) ELSE concat('archives/moved/', lob, '/', basename) END AS path FROM d_inv WHERE o_orderkey % 3 <> 0)"


@demo(f"""WITH {_STORE}, e AS (SELECT archive_id, table_key, row_pos, ref, concat('archives', substr(ref, 3)) AS resolved, {TAIL.format('ref')} AS tail FROM d_refs WHERE {EXTERNAL}),
t AS (SELECT {TAIL.format('path')} AS tail, min(path) AS at_tail FROM st GROUP BY 1), p AS (SELECT DISTINCT path FROM st)
SELECT archive_id, table_key, row_pos, ref, resolved, coalesce(p.path, at_tail) AS path, CASE WHEN p.path IS NOT NULL THEN 'resolved' WHEN at_tail IS NOT NULL THEN 'last_two' ELSE 'missing' END AS route FROM e LEFT JOIN p ON p.path = resolved LEFT JOIN t USING (tail)""")
def external_resolve(i: Inputs) -> DataFrame:
    store = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("/", F.lit("archives/store"), "table_key", "lob", "basename")).otherwise(F.concat_ws("/", F.lit("archives/moved"), "lob", "basename"))
    return P.resolve_external(i.d_refs, i.d_inv.where("o_orderkey % 3 <> 0").select(store.alias("path")).distinct(), "archives/one")


_FLAT = r"""fl AS (SELECT archive_id, path, regexp_replace(path, '/seg_?\d+/', '/') AS target FROM d_inv), fc AS (SELECT *, count(*) OVER (PARTITION BY archive_id, target) > 1 AND path <> target AS collision, regexp_matches(path, '_part\d{3}') AS is_part, path <> target AS moved FROM fl)"""


@demo(f"WITH {_FLAT} SELECT * FROM fc")
def segment_flatten(i: Inputs) -> DataFrame:
    return P.flatten_segments(i.d_inv)


@demo(f"WITH {_FLAT} SELECT archive_id, count(*) AS files, count(*) FILTER (moved) AS moved, count(*) FILTER (collision) AS collisions, count(*) FILTER (is_part) AS part_files, count(DISTINCT CASE WHEN moved THEN {DIR.format('path')} END) AS segment_folders FROM fc GROUP BY 1")
def segment_audit(i: Inputs) -> DataFrame:
    return P.segment_audit(i.d_inv)


@demo(rf"""WITH {_FLAT}, r AS (SELECT archive_id, table_key, o_orderkey AS row_pos, 3 + o_orderkey % 2 AS col_idx, path, CASE o_orderkey % 4 WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '(lob.*)$') WHEN 2 THEN regexp_replace(path, '^.*/lob[^/]*/', '') ELSE basename END AS ref FROM d_inv)
SELECT r.archive_id, table_key, row_pos, CAST(col_idx AS INTEGER) AS col_idx, ref, CASE WHEN regexp_matches(ref, 'seg_\d+/') AND NOT collision THEN regexp_replace(ref, 'seg_\d+/', '') ELSE ref END AS new_ref,
CASE WHEN NOT regexp_matches(ref, 'seg_\d+/') THEN 'plain' WHEN collision THEN 'collision' ELSE 'moved' END AS status FROM r JOIN fc ON fc.archive_id = r.archive_id AND fc.path = r.path""")
def segment_refs(i: Inputs) -> DataFrame:
    """References by path, from the large-object folder on, from below it, and by name."""
    k, path = F.col("o_orderkey"), F.col("path")
    ref = F.when(k % 4 == 0, path).when(k % 4 == 1, F.regexp_extract(path, "(lob.*)$", 1)).when(k % 4 == 2, F.regexp_replace(path, "^.*/lob[^/]*/", "")).otherwise(F.col("basename"))
    refs = i.d_inv.select("archive_id", "table_key", k.alias("row_pos"), (3 + k % 2).cast("int").alias("col_idx"), ref.alias("ref"))
    return P.flatten_refs(refs, i.d_inv)


_STD = r"""se AS (SELECT archive_id, path, CASE WHEN regexp_extract(path, '\.([^./]*)$', 1) IN ('bin', 'txt') THEN path ELSE regexp_extract(path, '^(.*/[^/.]*)', 1) || '.bin' END AS new_path, substr(basename, strpos(basename, '.') + 1) AS old_ext FROM d_inv),
sc AS (SELECT *, count(*) OVER (PARTITION BY archive_id, new_path) > 1 AND path <> new_path AS collision FROM se)"""


@demo(f"WITH {_STD} SELECT * FROM sc")
def std_ext(i: Inputs) -> DataFrame:
    return P.standardize_ext(i.d_inv)


@demo(f"WITH {_STD} SELECT archive_id, old_ext, count(*) AS n, count(*) FILTER (path <> new_path) AS renamed, count(*) FILTER (collision) AS collisions FROM sc GROUP BY ALL")
def std_ext_collisions(i: Inputs) -> DataFrame:
    return P.standardize_ext(i.d_inv).groupBy("archive_id", "old_ext").agg(F.count("*").alias("n"), F.count_if(F.col("path") != F.col("new_path")).alias("renamed"), F.count_if("collision").alias("collisions"))


@demo(r"SELECT archive_id, table_key, row_pos, ref, regexp_replace(ref, '^content/[^/]+/[^/]+/lob[^/]*/', '') AS new_ref, regexp_matches(ref, '^content/[^/]+/[^/]+/lob[^/]*/') AS changed FROM d_refs")
def externalize_refs(i: Inputs) -> DataFrame:
    return P.externalize_refs(i.d_refs)


@demo(r"""WITH m AS (SELECT archive_id, path, concat('store/', archive_id, '/', substr(path, 9)) AS new_path, length FROM d_inv WHERE o_orderkey % 5 <> 0)
SELECT archive_id, path, new_path, count(*) AS files, CAST(sum(length) AS BIGINT) AS length FROM m GROUP BY GROUPING SETS ((archive_id, path, new_path), (archive_id))""")
def externalize_list(i: Inputs) -> DataFrame:
    """The files that move; every fifth one lies elsewhere and stays."""
    path = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("documentation/"), "basename")).otherwise(F.col("path"))
    return P.externalized_files(i.d_inv.withColumn("path", path), "store")


@demo(r"SELECT archive_id, table_key, col_idx, lob_folder, regexp_replace(regexp_replace(lob_folder, '^/*(content/)?', ''), '/+$', '') AS new_folder, regexp_matches(lob_folder, '^/*content/') AS had_prefix, ends_with(lob_folder, '/') AS had_slash FROM d_columns WHERE lob_folder <> ''")
def lobfolder_fix(i: Inputs) -> DataFrame:
    return P.fix_lobfolders(i.d_columns)


@demo(r"""WITH db AS (SELECT 'a0' AS archive_id, NULL AS lob_folder, '2020' AS origin UNION ALL SELECT 'a1', 'content', NULL UNION ALL SELECT concat('n', n_nationkey), NULL, NULL FROM nation), c AS (SELECT archive_id, count(*) FILTER (regexp_matches(lob_folder, '^/*content/')) AS prefixes, count(*) FILTER (ends_with(lob_folder, '/')) AS slashes FROM d_columns WHERE lob_folder <> '' GROUP BY 1)
SELECT archive_id, CASE WHEN lob_folder IS NOT NULL THEN 'kept' WHEN origin IS NOT NULL THEN 'added' ELSE 'missing' END AS db_folder, CASE WHEN lob_folder IS NULL AND origin IS NOT NULL THEN 'content' ELSE lob_folder END AS db_lob_folder, coalesce(prefixes, 0) AS prefixes, coalesce(slashes, 0) AS slashes FROM db LEFT JOIN c USING (archive_id)""")
def lobfolder_issues(i: Inputs) -> DataFrame:
    known = i.spark.createDataFrame([("a0", None, "2020"), ("a1", "content", " ")], "archive_id string, lob_folder string, origin string")
    databases = known.unionByName(i.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("archive_id"), F.lit("").alias("lob_folder"), F.lit(None).cast("string").alias("origin")))
    return P.lobfolder_issues(databases, i.d_columns).withColumn("db_lob_folder", F.nullif("db_lob_folder", F.lit("")))


@demo("SELECT archive_id, split_part(table_key, '/', 1) AS schema_folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, split_part(table_key, '/', 1) IN ('schema0') AS kept FROM d_inv GROUP BY ALL")
def schema_prune(i: Inputs) -> DataFrame:
    return P.select_schemas(i.d_inv, ["schema0"])


@demo("SELECT archive_id, split_part(table_key, '/', 1) AS schema_folder, table_key, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM d_inv GROUP BY ALL")
def schema_sizes(i: Inputs) -> DataFrame:
    return P.schema_sizes(i.d_inv)


#: References in all spellings: some name the wrong folder, some a file of another table, some lead far out. Files beside the archives, and a store of archive a0.
_REFS = f"""rf AS (SELECT archive_id, CASE WHEN row_pos % 31 = 0 THEN 'schema0/table99' ELSE table_key END AS table_key, row_pos, CASE WHEN row_pos % 29 = 0 THEN '../../../far/rec1.bin' WHEN row_pos % 31 = 0 THEN concat('lob9/', {BASE.format('ref')}) WHEN row_pos % 37 = 0 THEN concat('lob8/', {BASE.format('ref')}) ELSE ref END AS ref FROM d_refs),
ef AS (SELECT archive_id, concat('disk/in/store/', table_key, '/', lob, '/', basename) AS path, NULL AS store_key FROM d_inv WHERE o_orderkey % 3 = 0 UNION SELECT archive_id, concat('disk/st/', archive_id, '/', table_key, '/LOB9/missing', o_orderkey, '.bin'), CASE WHEN archive_id = 'a0' THEN concat(table_key, '|missing', o_orderkey, '.bin') END FROM d_inv WHERE o_orderkey % 2 = 0),
rx AS (SELECT *, {TAIL.format('ref')} AS tail, {BASE.format('ref')} AS name, {EXTERNAL} AS e, CASE WHEN starts_with(ref, '../../../') THEN NULL WHEN starts_with(ref, '../') THEN concat('disk/in/', substr(ref, 4)) ELSE concat('disk/in/', archive_id, '/', ref) END AS resolved FROM rf),
h1 AS (SELECT archive_id, table_key, concat(lob, '/', basename) AS tail, min(path) AS p1 FROM d_inv GROUP BY ALL), h2 AS (SELECT archive_id, table_key, basename AS name, min(path) AS p2 FROM d_inv GROUP BY ALL), h3 AS (SELECT archive_id, basename AS name, min(path) AS p3 FROM d_inv GROUP BY ALL),
rj AS (SELECT rx.*, p0.path AS p0, CASE WHEN NOT e THEN p1 END AS p1, CASE WHEN NOT e THEN p2 END AS p2, CASE WHEN NOT e THEN p3 END AS p3, e4.path AS p4, e5.path AS p5 FROM rx LEFT JOIN (SELECT DISTINCT archive_id, path FROM d_inv) p0 ON p0.archive_id = rx.archive_id AND p0.path = ref
LEFT JOIN h1 ON h1.archive_id = rx.archive_id AND h1.table_key = rx.table_key AND h1.tail = rx.tail LEFT JOIN h2 ON h2.archive_id = rx.archive_id AND h2.table_key = rx.table_key AND h2.name = rx.name LEFT JOIN h3 ON h3.archive_id = rx.archive_id AND h3.name = rx.name
LEFT JOIN ef e4 ON e4.archive_id = rx.archive_id AND e4.path = resolved LEFT JOIN ef e5 ON e5.archive_id = rx.archive_id AND e5.store_key = concat(rx.table_key, '|', ref)),
ra AS (SELECT archive_id, table_key, row_pos, ref, CASE WHEN p0 IS NOT NULL THEN 'path' WHEN p1 IS NOT NULL THEN 'lob_folder' WHEN p2 IS NOT NULL THEN 'name' WHEN p3 IS NOT NULL THEN 'known_name' WHEN p4 IS NOT NULL THEN 'beside_archive' WHEN p5 IS NOT NULL THEN 'store' ELSE 'missing' END AS route, coalesce(p0, p1, p2, p3, p4, p5) AS path,
CASE WHEN coalesce(p0, p1, p2, p3, p4, p5) IS NULL THEN (CASE WHEN e AND resolved IS NULL THEN '{P.REASONS[0]}' WHEN archive_id = 'a0' THEN '{P.REASONS[1]}' ELSE '{P.REASONS[2]}' END) END AS reason FROM rj)"""


def _audited(i: Inputs) -> DataFrame:
    k, name = F.col("row_pos"), P.basename("ref")
    ref = F.when(k % 29 == 0, "../../../far/rec1.bin").when(k % 31 == 0, F.concat(F.lit("lob9/"), name)).when(k % 37 == 0, F.concat(F.lit("lob8/"), name)).otherwise(F.col("ref"))
    refs = i.d_refs.select("archive_id", F.when(k % 31 == 0, "schema0/table99").otherwise(F.col("table_key")).alias("table_key"), "row_pos", ref.alias("ref"))
    beside = i.d_inv.where("o_orderkey % 3 = 0").select("archive_id", F.concat_ws("/", F.lit("disk/in/store"), "table_key", "lob", "basename").alias("path"))
    store = i.d_inv.where("o_orderkey % 2 = 0").select("archive_id", F.concat(F.lit("disk/st/"), "archive_id", F.lit("/"), "table_key", F.lit("/LOB9/missing"), "o_orderkey", F.lit(".bin")).alias("path"))
    bases = i.spark.createDataFrame([("a0", "disk/in/a0", "disk/st/a0"), ("a1", "disk/in/a1", None)], "archive_id string, base string, store string")
    return P.audit_refs(refs, i.d_inv, beside.unionByName(store).distinct(), bases)


@demo(f"WITH {_REFS} SELECT * FROM ra")
def missing_refs(i: Inputs) -> DataFrame:
    return _audited(i)


@demo(f"WITH {_REFS} SELECT archive_id, route, reason, count(*) AS n FROM ra GROUP BY ALL")
def missing_ref_counts(i: Inputs) -> DataFrame:
    return _audited(i).groupBy("archive_id", "route", "reason").agg(F.count("*").alias("n"))


@demo(f"SELECT archive_id, path, table_key, basename FROM d_inv i WHERE NOT EXISTS (SELECT 1 FROM d_refs r WHERE row_pos % 3 = 0 AND r.archive_id = i.archive_id AND r.table_key = i.table_key AND {BASE.format('r.ref')} = i.basename)")
def orphan_lobs(i: Inputs) -> DataFrame:
    keep = i.d_refs.where("row_pos % 3 = 0").select("archive_id", "table_key", "row_pos")
    return P.orphan_lobs(i.d_inv, i.d_refs, keep).select("archive_id", "path", "table_key", "basename")


#: Documents become ODT; every nineteenth move collided; every third reference stands in another column; archives in ZIP keep their names and get other bytes.
_REFRESH = f"""rn AS (SELECT archive_id, table_key, lob, basename, path, CASE WHEN ext = 'zip' THEN path ELSE regexp_extract(path, '^(.*/[^/.]*)', 1) || '.odt' END AS np, length + 7 AS nl, md5(path) AS nd, o_orderkey % 19 = 0 AS c FROM d_inv WHERE ext IN ('doc', 'pdf', 'zip')),
g1 AS (SELECT archive_id, table_key, concat(lob, '/', basename) AS tail, count(*) AS n, min(np) AS np, min(nl) AS nl, min(nd) AS nd, bool_or(c) AS c FROM rn GROUP BY ALL), g2 AS (SELECT archive_id, table_key, lob, basename AS name, count(*) AS n, min(np) AS np, min(nl) AS nl, min(nd) AS nd, bool_or(c) AS c FROM rn GROUP BY ALL),
g3 AS (SELECT archive_id, table_key, basename AS name, count(*) AS n, min(np) AS np, min(nl) AS nl, min(nd) AS nd, bool_or(c) AS c FROM rn GROUP BY ALL), rr AS (SELECT archive_id, table_key, row_pos, CAST(col_idx + CASE WHEN row_pos % 3 = 0 THEN 5 ELSE 0 END AS INTEGER) AS col_idx, ref, length, {BASE.format('ref')} AS name, {TAIL.format('ref')} AS tail, NOT contains(ref, '/') AS bare, NOT starts_with(ref, 'content/') AND NOT {EXTERNAL} AS loose FROM d_refs),
rb AS (SELECT rr.*, CASE WHEN rn.path IS NOT NULL THEN 0 WHEN g1.n IS NOT NULL THEN 1 WHEN g2.n IS NOT NULL THEN 2 WHEN g3.n IS NOT NULL THEN 3 END AS rank, CASE WHEN rn.path IS NOT NULL THEN 1 ELSE coalesce(g1.n, g2.n, g3.n) END AS n, CASE WHEN rn.path IS NOT NULL THEN rn.np WHEN g1.n IS NOT NULL THEN g1.np WHEN g2.n IS NOT NULL THEN g2.np ELSE g3.np END AS np,
CASE WHEN rn.path IS NOT NULL THEN rn.nl WHEN g1.n IS NOT NULL THEN g1.nl WHEN g2.n IS NOT NULL THEN g2.nl ELSE g3.nl END AS nl, CASE WHEN rn.path IS NOT NULL THEN rn.nd WHEN g1.n IS NOT NULL THEN g1.nd WHEN g2.n IS NOT NULL THEN g2.nd ELSE g3.nd END AS nd, CASE WHEN rn.path IS NOT NULL THEN rn.c WHEN g1.n IS NOT NULL THEN g1.c WHEN g2.n IS NOT NULL THEN g2.c ELSE g3.c END AS c
FROM rr LEFT JOIN rn ON rn.archive_id = rr.archive_id AND rn.path = ref LEFT JOIN g1 ON loose AND NOT bare AND g1.archive_id = rr.archive_id AND g1.table_key = rr.table_key AND g1.tail = rr.tail LEFT JOIN g2 ON loose AND bare AND g2.archive_id = rr.archive_id AND g2.table_key = rr.table_key AND g2.lob = concat('lob', col_idx) AND g2.name = rr.name
LEFT JOIN g3 ON loose AND g3.archive_id = rr.archive_id AND g3.table_key = rr.table_key AND g3.name = rr.name),
rw AS (SELECT archive_id, table_key, row_pos, col_idx, ref, CASE WHEN n = 1 AND NOT c THEN (CASE WHEN rank = 0 THEN np ELSE substr(ref, 1, length(ref) - length(name)) || {BASE.format('np')} END) ELSE ref END AS new_ref, CASE WHEN n = 1 AND NOT c THEN nl ELSE length END AS new_length, CASE WHEN n = 1 AND NOT c THEN nd ELSE '00' END AS new_digest,
CASE WHEN rank IS NULL THEN 'none' WHEN n > 1 THEN 'several' WHEN c THEN 'collision' ELSE (['full', 'folder', 'column', 'name'])[rank + 1] END AS how, coalesce(n = 1 AND NOT c, false) AS changed FROM rb)"""


def _refreshed(i: Inputs) -> DataFrame:
    new = F.when(F.col("ext") == "zip", F.col("path")).otherwise(F.concat(F.regexp_extract("path", "^(.*/[^/.]*)", 1), F.lit(".odt")))
    renames = i.d_inv.where("ext in ('doc', 'pdf', 'zip')").select("archive_id", "table_key", "lob", "path", new.alias("new_path"), (F.col("length") + 7).alias("new_length"), F.md5(F.encode("path", "UTF-8")).alias("new_digest"), (F.col("o_orderkey") % 19 == 0).alias("collision"))
    column = (F.col("col_idx") + F.when(F.col("row_pos") % 3 == 0, 5).otherwise(0)).cast("int")
    return P.refresh_refs(i.d_refs.withColumn("digest", F.lit("00")).withColumn("col_idx", column), renames)


@demo(f"WITH {_REFRESH} SELECT * FROM rw")
def refresh_refs(i: Inputs) -> DataFrame:
    return _refreshed(i)


@demo(f"WITH {_REFRESH} SELECT archive_id, table_key, how, count(*) AS refs, count(*) FILTER (changed) AS changed FROM rw GROUP BY ALL")
def refresh_counts(i: Inputs) -> DataFrame:
    return P.refresh_counts(_refreshed(i))

"""Derived views over the driver tables: portable SQL, the same text for Spark and the second engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "d_inv": r"""
select concat('content/schema', o_orderkey % 2, '/table', o_custkey % 7, '/lob', 3 + o_orderkey % 2,
              case when o_orderkey >= 400 then concat('/seg_', cast(floor(o_orderkey / 400) as int)) else '' end,
              '/rec', o_orderkey % 400, '.', ext) as path,
       concat('schema', o_orderkey % 2, '/table', o_custkey % 7) as table_key,
       concat('lob', 3 + o_orderkey % 2) as lob,
       concat('rec', o_orderkey % 400, '.', ext) as basename,
       ext, cast(floor(o_totalprice * 100) as bigint) as length, o_orderkey, concat('a', cast(floor(o_custkey / 7) as bigint) % 2) as archive_id
from (select *, case o_orderkey % 10 when 0 then 'doc' when 1 then 'pdf' when 2 then 'txt' when 3 then 'xml'
                when 4 then 'jpg' when 5 then 'doc.pdf' when 6 then 'zip' else 'bin' end as ext from orders) o
""",
    "d_refs": r"""
select table_key, o_orderkey as row_pos, cast(3 + o_orderkey % 2 as int) as col_idx,
       case when o_orderkey % 13 = 0 then concat('missing', o_orderkey, '.bin')
            when o_orderkey % 4 = 0 then basename
            when o_orderkey % 4 = 1 then concat(lob, '/', basename)
            when o_orderkey % 4 = 2 then path
            else concat('../store/', table_key, '/', lob, '/', basename) end as ref,
       length, archive_id
from d_inv
""",
    "d_ledger": r"""
select path as src_path,
       case when o_orderkey % 17 = 0 then '' when o_orderkey % 5 = 0 then concat(' ', length, '.0 ')
            else cast(length as string) end as src_size,
       case when o_orderkey % 3 = 0 then concat('.', ext) else ext end as src_ext,
       case when o_orderkey % 8 = 0 then '' else path end as dst_path,
       case when o_orderkey % 8 = 0 then '0' else cast(length as string) end as dst_size,
       case when o_orderkey % 8 = 1 then 'pdf' when o_orderkey % 8 = 0 then '' else ext end as dst_ext,
       case o_orderkey % 8 when 0 then (case when o_orderkey % 16 = 0 then 'Conversion timed out after 60 s' else 'Conversion error: bad file' end)
            when 1 then 'Converted to PDF/A' when 2 then 'Kept original format' when 3 then 'Charset changed to UTF-8'
            when 4 then 'Inline extract' when 5 then 'Standardised to .bin' when 6 then 'Detected as xml - extension changed' else '' end as note,
       o_orderkey as line_no
from d_inv
""",
    "d_errlog": r"""
select '# errors' as line, cast(0 as bigint) as line_no union all select '', 0 union all select 'no separator here', 0
union all
select concat('[12:00:', lpad(cast(o_orderkey % 60 as string), 2, '0'), ']  ', path, '  |  .', ext, '  |  ',
              case when o_orderkey % 16 = 0 then 'Conversion timed out after 60 s' else 'Conversion error: bad file' end), 1000000000 - o_orderkey
from d_inv where o_orderkey % 24 in (0, 9)
""",
    "d_tables": r"""
select concat('a', n) as archive_id, concat('schema', s, '/table', k % 25) as table_key,
       case s % 4 when 1 then concat('Ref data ', s) when 2 then '' else concat('main_', s) end as schema_name,
       case k % 4 when 0 then (case when g % 5 = 4 then concat('Solo_', g, 'b') else base end) when 1 then concat(base, '_tmp') when 2 then concat(base, '_20230101') else concat(base, '_Backup kopi') end as table_name,
       case when (k + n) % 3 = 0 then concat('About ', p_name) else '' end as description, cast((k + n) % 11 * 1000 as int) as declared_rows
from (select *, concat(case g % 6 when 0 then 'Customer' when 1 then 'Orders' when 2 then 'Journal' when 3 then 'Log' when 4 then 'Nation' else 'Region' end, '_', g, 'a') as base
      from (select p_partkey as k, p_name, cast(floor(p_partkey / 25) as bigint) as s, cast(floor(p_partkey / 4) as bigint) as g from part) p) q
cross join (select * from (values (0), (1)) as v(n)) a
where n = 0 or k % 7 <> 3
""",
    "d_columns": r"""
select archive_id, table_key, col_idx,
       case col_idx when 1 then concat(lower(substr(table_name, 1, 1)), case when declared_rows < 4000 then '_custkey' else '_orderkey' end) when 2 then concat(lower(substr(table_name, 1, 1)), '_name') else 'letter' end as name,
       case col_idx when 1 then 'BIGINT' when 2 then 'VARCHAR(25)' else (case when declared_rows < 4000 then 'BLOB' else 'CLOB' end) end as type,
       case when col_idx = 1 then 'Key' else '' end as description,
       case when col_idx < 3 then '' when declared_rows < 3000 then concat('content/', table_key, '/lob3/') when declared_rows < 6000 then concat('/content/', table_key, '/lob3') when declared_rows < 8000 then concat('/', table_key) else '' end as lob_folder
from d_tables cross join (select * from (values (1), (2), (3)) as v(col_idx)) c
where declared_rows <> 5000
""",
    "d_keys": r"""
select concat('a', n) as archive_id, concat('schema', cast(floor(k / 25) as bigint), '/table', k % 25) as table_key, concat('fk_', k) as name,
       case when k % 50 = 7 then concat('schema', k, '/none') else concat('schema', cast(floor(r / 25) as bigint), '/table', r % 25) end as ref_table_key, 'parent_id' as col, 'id' as ref_col
from (select p_partkey as k, cast(floor(p_partkey / 3) as bigint) as r from part where p_partkey > 0) p
cross join (select * from (values (0), (1)) as v(n)) a
where k % 5 <> 1 + n
""",
    "d_primary": r"""
select concat('a', m) as archive_id, concat('schema', cast(floor(p_partkey / 25) as bigint), '/table', p_partkey % 25) as table_key, concat('id', n) as col
from part cross join (select * from (values (0), (1)) as w(m)) a join (select * from (values (1), (2), (3), (4), (5), (6)) as v(n)) v on n <= 1 + (p_partkey + m) % 6
""",
    "d_people": r"""
select c_custkey as person_id,
       concat(f, ' ', l) as full_name,
       case c_custkey % 3 when 0 then upper(l) when 1 then lower(l) else l end as last_name,
       n as id_number,
       concat(lower(f), c_custkey, '@mail.example.org') as email,
       concat('+47 9', lpad(cast(c_custkey as string), 7, '0')) as phone,
       lpad(cast(c_custkey % 9999 as string), 4, '0') as postcode,
       concat('Case ', c_custkey, ': contact ', f, ' ', l, ' at ', lower(f), c_custkey, '@mail.example.org, id ', n, '.') as note
from customer
join (select * from (values (0,'Kari','Hansen','01819910150'),(1,'Ola','Berg','12837513772'),(2,'Liv','Solberg','28926017472'),
      (3,'Anne','Moen','05880121164'),(4,'Per','Dahl','17864524842'),(5,'Nina','Lund','23901228507'),(6,'Jan','Strand','12345678901')) as v(k, f, l, n)) v
  on v.k = c_custkey % 7
""",
    "d_cells": r"""
select concat('schema0/table', doc_id % 9) as table_key, doc_id as row_pos, 3 as col_idx,
       case when doc_id % 5 < 2 then hex(encode(text, 'UTF-8')) else text end as value
from documents
""",
    "d_pad": r"""
select p_partkey as row_pos, concat(replace(p_name, ' ', concat(chr(92), 'u0020', chr(92), 'u0020')),
       case when p_partkey % 2 = 0 then concat(chr(92), 'u0020', chr(92), 'u0020', chr(92), 'u0020') else '' end) as value
from part
""",
    "d_steps": r"""
select concat('r', cast(floor(event_id / 8) as bigint)) as run_id, event_id % 8 + 1 as seq, concat('op', event_id % 12) as op_id,
       case event_id % 4 when 0 then 'Integrity' when 1 then 'Pipeline' when 2 then 'Content' else 'Security' end as category,
       event_id % 3 <> 0 as modifies, event_id % 5 as changed,
       case event_id % 7 when 0 then 'Adjustment' when 1 then 'Migration' when 2 then 'Tidying' when 3 then 'Deletion' when 4 then 'Normalisation' when 5 then 'Other' else '' end as event_type,
       event_type as event_label, event_id % 17 <> 3 as success, event_id % 13 = 5 as skipped, value as elapsed, concat(event_id % 5, ' changed') as message
from events
""",
    "d_scanlog": r"""
select concat('s', cast(floor(event_id / 16) as bigint)) as scan_id, event_id as line_no, cast(floor(event_id / 16) % 3 as int) as return_code,
       case event_id % 97 when 3 then concat('rec', event_id, '.bin: Trojan.Test FOUND') when 4 then 'Infected files: 1' when 50 then 'CmdTool: Failed with hr = 0x80508023' when 51 then 'Error' when 80 then 'Infected files: 0' else concat('scanning rec', event_id) end as line
from events
""",
}


def needed(sql: str) -> list[str]:
    """Derived views that a text uses, those they use themselves first."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in [*needed(VIEWS[name]), name] if x not in found]
    return found


def oracle(sql: str) -> str:
    """sql with the derived views it uses as common table expressions, for DuckDB."""
    views = [f"{name} AS ({VIEWS[name].replace(", 'UTF-8')", ")")})" for name in needed(sql)]
    if not views:
        return sql
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return "WITH RECURSIVE " + ", ".join([*views, body[15:]])
    if body[:5].lower() == "with ":
        return "WITH " + ", ".join([*views, body[5:]])
    return f"WITH {', '.join(views)} {body}"


class Inputs:
    """The driver tables and derived views under one folder, as lazy DataFrames: inputs.orders, inputs.d_inv."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            sql = VIEWS[name]
            frames = {t: getattr(self, t) for t in [*TABLES, *VIEWS] if t != name and re.search(rf"\b{t}\b", sql)}
            for t in frames:
                sql = re.sub(rf"(?i)(\b(?:from|join)\s+){t}\b", rf"\g<1>{{{t}}}", sql)
            return self.spark.sql(sql, **frames)
        raise AttributeError(name)

"""Queries of the conversion and error ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import ledger as L
from .fixtures import Inputs
from .registry import demo

CLEAN = """lc AS (SELECT trim(src_path) AS src_path, coalesce(CAST(trunc(TRY_CAST(trim(src_size) AS DOUBLE)) AS BIGINT), 0) AS src_size, lower(regexp_replace(trim(src_ext), '^\\.+', '')) AS src_ext,
trim(dst_path) AS dst_path, coalesce(CAST(trunc(TRY_CAST(trim(dst_size) AS DOUBLE)) AS BIGINT), 0) AS dst_size, lower(regexp_replace(trim(dst_ext), '^\\.+', '')) AS dst_ext, trim(note) AS note, line_no FROM d_ledger)"""
STATUS = CLEAN + """, ls AS (SELECT *, CASE WHEN regexp_matches(lower(note), 'error|failed|timed out|timeout') THEN 'failed' WHEN contains(lower(note), 'kept') THEN 'kept' WHEN contains(lower(note), 'charset') THEN 'charset'
WHEN contains(lower(note), 'inline') THEN 'inline' WHEN contains(lower(note), '.bin') THEN 'bin' WHEN contains(lower(note), 'convert') OR dst_ext IN ('pdf', 'pdfa') THEN 'converted'
WHEN contains(lower(note), 'extension changed') OR contains(lower(note), 'renamed') THEN 'renamed' WHEN note <> '' THEN note ELSE 'processed' END AS status FROM lc)"""
ERRS = """le AS (SELECT trim(regexp_replace(split_part(line, '|', 1), '^\\s*\\[[^\\]]*\\]\\s*', '')) AS path, regexp_replace(trim(split_part(line, '|', 2)), '^\\.+', '') AS ext, trim(split_part(line, '|', 3)) AS msg, line_no
FROM d_errlog WHERE line <> '' AND line NOT LIKE '#%' AND contains(line, '|'))"""
FAILED = STATUS + ", " + ERRS + """, lf AS (SELECT path, ext, msg, source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source DESC, line_no, msg, ext) AS r FROM
(SELECT path, ext, msg, 'log' AS source, line_no FROM le UNION ALL SELECT src_path, src_ext, note, 'ledger', line_no FROM ls WHERE status = 'failed')) WHERE r = 1),
lz AS (SELECT lf.*, z.size FROM lf LEFT JOIN (SELECT src_path AS path, max_by(src_size, line_no) AS size FROM lc GROUP BY 1) z USING (path))"""


def _clean(i: Inputs) -> DataFrame:
    return L.clean_ledger(i.d_ledger)


def _failed(i: Inputs) -> DataFrame:
    return L.failed_files(L.parse_errors(i.d_errlog), _clean(i))


@demo(f"WITH {CLEAN} SELECT * FROM lc")
def ledger_clean(i: Inputs) -> DataFrame:
    return _clean(i)


@demo(f"WITH {STATUS} SELECT src_path, note, status FROM ls")
def ledger_status(i: Inputs) -> DataFrame:
    return L.with_status(_clean(i)).select("src_path", "note", "status")


@demo(f"WITH {ERRS} SELECT * FROM le")
def errors_parsed(i: Inputs) -> DataFrame:
    return L.parse_errors(i.d_errlog)


@demo(f"WITH {FAILED} SELECT * FROM lf")
def failed_files(i: Inputs) -> DataFrame:
    return _failed(i)


@demo(f"WITH {FAILED} SELECT path, ext, size FROM lz")
def failed_sizes(i: Inputs) -> DataFrame:
    return L.with_size(_failed(i), _clean(i)).select("path", "ext", "size")


@demo("SELECT path, length FROM d_inv WHERE path NOT IN (SELECT trim(src_path) FROM d_ledger WHERE dst_path <> '')")
def resume_filter(i: Inputs) -> DataFrame:
    done = _clean(i).where("dst_path != ''").select(F.col("src_path").alias("path"))
    return L.remaining(i.d_inv.select("path", "length"), done, "path")


@demo(f"""WITH {STATUS}, n AS (SELECT count(*) AS detected, count(*) FILTER (status = 'converted') AS converted, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'inline') AS inline, count(*) FILTER (status = 'failed') AS failed FROM ls)
SELECT *, CASE WHEN converted + failed > 0 THEN round(converted / (converted + failed), 6) ELSE 0.0 END AS success_rate, CASE WHEN converted + failed > 0 THEN round(failed / (converted + failed), 6) ELSE 0.0 END AS failure_rate FROM n""")
def conversion_kpis(i: Inputs) -> DataFrame:
    return L.conversion_kpis(_clean(i))


@demo(f"WITH {FAILED} SELECT ext, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lf GROUP BY ext")
def fail_by_ext(i: Inputs) -> DataFrame:
    return L.counted_share(_failed(i), "ext")


@demo(f"WITH {FAILED} SELECT CASE WHEN regexp_matches(lower(msg), 'timed out|timeout') THEN 'timeout' ELSE 'other' END AS cause, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lf GROUP BY 1")
def fail_by_cause(i: Inputs) -> DataFrame:
    return L.fail_by_cause(_failed(i))


@demo(f"WITH {FAILED} SELECT CASE WHEN size < 1048576 THEN '< 1 MB' WHEN size <= 10485760 THEN '1-10 MB' ELSE '> 10 MB' END AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lz WHERE size > 0 GROUP BY 1")
def fail_by_size(i: Inputs) -> DataFrame:
    return L.fail_by_size(_failed(i), _clean(i))


@demo(f"""WITH {STATUS}, f AS (SELECT regexp_extract(src_path, '^(.*)/[^/]*$', 1) AS folder, status, src_ext AS type FROM ls)
SELECT folder, status, type, count(*) AS n, 'cell' AS level FROM f GROUP BY ALL UNION ALL SELECT folder, CAST(count(DISTINCT status) AS VARCHAR), CAST(count(DISTINCT type) AS VARCHAR), count(*), 'folder' FROM f GROUP BY folder""")
def file_organization(i: Inputs) -> DataFrame:
    return L.file_organization(_clean(i))


@demo("""WITH c AS (SELECT ext, count(*) AS n FROM d_inv GROUP BY ext), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, ext) AS k FROM c), g AS (SELECT CASE WHEN k <= 5 THEN ext ELSE 'Other' END AS ext, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1)
SELECT ext, n, round(n / sum(n) OVER (), 6) AS share, round(n / max(n) OVER (), 6) AS bar FROM g""")
def format_distribution(i: Inputs) -> DataFrame:
    return L.format_distribution(i.d_inv, 5)


@demo(f"""WITH {FAILED}, f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path, msg FROM lf), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS rank, count(*) OVER (PARTITION BY folder) AS in_group FROM f)
SELECT folder, path, msg, CAST(rank AS INTEGER) AS rank, in_group, greatest(in_group - 15, 0) AS more FROM r WHERE rank <= 15""")
def top_failures(i: Inputs) -> DataFrame:
    rows = _failed(i).select(L.folder_of(F.col("path")).alias("folder"), "path", "msg")
    return L.top_per_group(rows, "folder", ["path"], 15)


@demo("""WITH s AS (SELECT run_id, count(*) AS steps, count(*) FILTER (success AND NOT skipped) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (skipped) AS skipped, round(sum(CAST(elapsed AS DOUBLE)), 3) AS seconds,
count(*) FILTER (NOT success AND category IN ('Integrity', 'Pipeline')) AS vital FROM d_steps GROUP BY run_id)
SELECT run_id, steps, succeeded, failed, skipped, seconds, CASE WHEN vital > 0 THEN 'failed' WHEN failed > 0 OR skipped > 0 THEN 'approved with deviations' ELSE 'approved' END AS verdict FROM s""")
def run_summary(i: Inputs) -> DataFrame:
    return L.run_summary(i.d_steps)

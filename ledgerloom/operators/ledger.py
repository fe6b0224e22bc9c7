"""Conversion and error ledgers: cleaning, status, failures, key figures, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def lenient_long(text: Column) -> Column:
    """Whole number of a text that may hold blanks or decimals; 0 where there is none."""
    return F.coalesce(F.trim(text).try_cast("double").try_cast("bigint"), F.lit(0))


def _line(df: DataFrame) -> list[str]:
    """The column that says where a row stood in its log, if there is one."""
    return ["line_no"] if "line_no" in df.columns else []


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Trimmed fields, extensions in lower case without leading dot, sizes as numbers; line_no, the place in the log, stays."""
    ext = lambda c: F.lower(F.regexp_replace(F.trim(c), r"^\.+", ""))
    return raw.select(
        F.trim("src_path").alias("src_path"), lenient_long(F.col("src_size")).alias("src_size"), ext("src_ext").alias("src_ext"),
        F.trim("dst_path").alias("dst_path"), lenient_long(F.col("dst_size")).alias("dst_size"), ext("dst_ext").alias("dst_ext"), F.trim("note").alias("note"),
        *_line(raw),
    )


def parse_errors(lines: DataFrame, column: str = "line") -> DataFrame:
    """path, ext, msg of error-log lines, with line_no where lines have it; comments, blank lines and lines without a separator are dropped."""
    kept = lines.where((F.col(column) != "") & ~F.col(column).startswith("#") & F.col(column).contains("|")).select(F.split(column, r"\|", 3).alias("p"), *_line(lines))
    part = lambda i: F.trim(F.coalesce(F.get("p", F.lit(i)), F.lit("")))
    path = F.trim(F.regexp_replace(part(0), r"^\[[^\]]*\]\s*", ""))
    return kept.select(path.alias("path"), F.regexp_replace(part(1), r"^\.+", "").alias("ext"), part(2).alias("msg"), *_line(lines))


def status_of(note: Column, dst_ext: Column) -> Column:
    """Status from the note, in a fixed order: failure words win over everything else."""
    n = F.lower(F.coalesce(note, F.lit("")))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: n.contains(w))
    return (
        F.when(has("error", "failed", "timed out", "timeout"), "failed")
        .when(has("kept"), "kept")
        .when(has("charset"), "charset")
        .when(has("inline"), "inline")
        .when(has(".bin"), "bin")
        .when(n.contains("convert") | F.lower(F.coalesce(dst_ext, F.lit(""))).isin("pdf", "pdfa"), "converted")
        .when(has("extension changed", "renamed"), "renamed")
        .when(n != "", F.coalesce(note, F.lit("")))
        .otherwise("processed")
    )


def with_status(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("status", status_of(F.col("note"), F.col("dst_ext")))


def _place(df: DataFrame) -> Column:
    return F.col("line_no").cast("long") if "line_no" in df.columns else F.lit(None).cast("long")


def failed_files(errors: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, ext, msg, source: error-log rows first, then ledger rows classed as failed; the first of a path counts, by line_no where there is one, else by message."""
    logged = errors.select("path", "ext", "msg", F.lit(0).alias("rank"), _place(errors).alias("place"))
    noted = with_status(ledger).where("status = 'failed'").select(F.col("src_path").alias("path"), F.col("src_ext").alias("ext"), F.col("note").alias("msg"), F.lit(1).alias("rank"), _place(ledger).alias("place"))
    first = logged.unionByName(noted).groupBy("path").agg(F.min(F.struct("rank", "place", "msg", "ext")).alias("first"))
    return first.select("path", "first.ext", "first.msg", F.when(F.col("first.rank") == 0, "log").otherwise("ledger").alias("source"))


def with_size(failed: DataFrame, ledger: DataFrame) -> DataFrame:
    """failed with the size that its path has in the last ledger row by line_no (without that, the largest); null where the ledger does not know it."""
    sizes = ledger.groupBy(F.col("src_path").alias("path")).agg(F.max(F.struct(_place(ledger).alias("place"), F.col("src_size").alias("size"))).alias("last"))
    return failed.join(sizes.select("path", "last.size"), "path", "left")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done, key, "left_anti")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def conversion_kpis(ledger: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = with_status(ledger).agg(F.count("*").alias("detected"), n("converted").alias("converted"), n("kept").alias("kept"), n("inline").alias("inline"), n("failed").alias("failed"))
    tried = F.col("converted") + F.col("failed")
    return out.select("*", _share(F.col("converted"), tried).alias("success_rate"), _share(F.col("failed"), tried).alias("failure_rate"))


def counted_share(df: DataFrame, key: str) -> DataFrame:
    """key, n and the share of all, over the grouped rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def fail_by_cause(failed: DataFrame) -> DataFrame:
    return counted_share(failed.withColumn("cause", F.when(F.lower("msg").rlike("timed? ?out"), "timeout").otherwise("other")), "cause")


def fail_by_size(failed: DataFrame, ledger: DataFrame) -> DataFrame:
    mb = 1 << 20
    bucket = F.when(F.col("size") < mb, "< 1 MB").when(F.col("size") <= 10 * mb, "1-10 MB").otherwise("> 10 MB")
    return counted_share(with_size(failed, ledger).where("size > 0").withColumn("bucket", bucket), "bucket")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_organization(ledger: DataFrame) -> DataFrame:
    """Counts by folder, status and type, and each folder's total, distinct statuses and types (grouping level 'folder').

    One pass of grouping sets over the counts by folder, status and type, with grouping_id; a folder's distinct statuses and
    types are the rows of the levels below it. Only counts are shuffled, one row for each combination that a task meets.
    """
    rows = with_status(ledger).select(folder_of(F.col("src_path")).alias("folder"), "status", F.col("src_ext").alias("type"))
    cells = rows.groupBy("folder", "status", "type").agg(F.count("*").alias("n"))
    sets = [["folder", "status", "type"], ["folder", "status"], ["folder", "type"], ["folder"]]
    levels = cells.groupingSets([[F.col(c) for c in s] for s in sets], "folder", "status", "type").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    # g has a bit for each column that a set leaves out: folder, status, type
    of_folder = lambda g: F.count_if(F.col("g") == g).over(W.partitionBy("folder")).cast("string")
    whole = F.col("g") == 3
    out = levels.withColumns({"statuses": of_folder(1), "types": of_folder(2)}).where("g in (0, 3)")
    pick = lambda total, cell: F.when(whole, F.col(total)).otherwise(F.col(cell))
    return out.select("folder", pick("statuses", "status").alias("status"), pick("types", "type").alias("type"), "n", F.when(whole, "folder").otherwise("cell").alias("level"))


def format_distribution(inv: DataFrame, top: int = 8) -> DataFrame:
    """ext, n, share and bar (n by the largest n); all after the top ones are one row, Other."""
    counts = inv.groupBy("ext").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "ext")))
    out = ranked.groupBy(F.when(F.col("rank") <= top, F.col("ext")).otherwise("Other").alias("ext")).agg(F.sum("n").alias("n"))
    every = W.partitionBy()
    return out.select("ext", "n", F.round(F.col("n") / F.sum("n").over(every), 6).alias("share"), F.round(F.col("n") / F.max("n").over(every), 6).alias("bar"))


def top_per_group(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with the group's size and how many stay out."""
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("in_group"))
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
    joined = ranked.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    return joined.withColumn("more", F.greatest(F.col("in_group") - k, F.lit(0)))


def run_summary(steps: DataFrame) -> DataFrame:
    """Per run: steps, succeeded, failed, skipped, seconds and the verdict."""
    ok = F.count_if(F.col("success") & ~F.col("skipped"))
    out = steps.groupBy("run_id").agg(F.count("*").alias("steps"), ok.alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if("skipped").alias("skipped"), F.round(F.sum(F.col("elapsed").cast("double")), 3).alias("seconds"), F.count_if(~F.col("success") & F.col("category").isin("Integrity", "Pipeline")).alias("vital"))
    verdict = F.when(F.col("vital") > 0, "failed").when((F.col("failed") > 0) | (F.col("skipped") > 0), "approved with deviations").otherwise("approved")
    return out.withColumn("verdict", verdict).drop("vital")

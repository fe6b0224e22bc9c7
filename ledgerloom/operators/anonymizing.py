"""The whole anonymisation of an archive: subset, values, free text, files, references, ledger and counts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import text as T
from ..functions.names import COLUMN, Names
from ..sources.shared import materialized
from . import lobs as L, paths as P, privacy, relations as R


@dataclass(frozen=True)
class Subset:
    """What referential_subset needs besides rows and keys."""

    n: int
    important: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    budget: int | None = None


@dataclass(frozen=True)
class Anonymized:
    """tables: the rewritten rows by table. classes: table_key, col_name, pii_type, source. ledger: type, original, fake, cells.

    files: what the kept rows' files became; refs: references of kept rows, refreshed. counts: table_key, declared and
    kept rows, cells changed, free-text cells changed, spans redacted, files replaced.
    """

    tables: dict[str, DataFrame]
    classes: DataFrame
    ledger: DataFrame
    files: DataFrame | None
    refs: DataFrame | None
    counts: DataFrame


def classify_tables(rows: Mapping[str, DataFrame], names: Names = privacy.KNOWN) -> DataFrame:
    """Classes of the text columns of all tables, from the last rows of each: one job, whatever the number of tables."""
    cells = []
    for table, df in rows.items():
        texts = [c for c, kind in df.dtypes if kind == "string"]
        if texts:
            last = df.agg(F.max("row_pos").alias("__last"))
            tail = df.crossJoin(F.broadcast(last)).where(F.col("row_pos") > F.col("__last") - 500)
            cells.append(tail.select(F.lit(table).alias("table_key"), "row_pos", *texts).unpivot(["table_key", "row_pos"], texts, "col_name", "value"))
    if not cells:
        return next(iter(rows.values())).sparkSession.createDataFrame([], "table_key string, col_name string, pii_type string, source string")
    return privacy.classify_columns(privacy.column_profile(privacy.tail_samples(reduce(DataFrame.unionByName, cells)), names))


def _rewritten(table: str, df: DataFrame, kinds: Mapping[str, str], limits: Mapping[str, int], names: Names) -> tuple[DataFrame, dict[str, int]]:
    """(rows with their changes, counts) of one table. Values, free text, changes and counts come out of one scan; the counts are observed while it is written."""
    values = {c: k for c, k in kinds.items() if k in privacy.VALUE_TYPES}
    texts = [c for c, k in kinds.items() if k == "FREE_TEXT"]
    out = names.on(df, privacy.value_words(values)).withColumn("__cells", privacy._replaced(df, values, names)).drop(COLUMN)
    new = {c: T.cap_length(F.get("__cells", F.lit(at))["fake"], F.lit(limits.get(c))) for at, c in enumerate(values)}
    out = out.withColumns({**new, "__changes": F.filter("__cells", lambda x: x["original"] != x["fake"])}).drop("__cells")
    spans = F.lit(0)
    touched = F.lit(0)
    for k, c in enumerate(texts):
        out = privacy.redact_text(out, c, names).withColumnRenamed("n_redacted", f"__n{k}")
        spans, touched = spans + F.col(f"__n{k}"), touched + (F.col(f"__n{k}") > 0).cast("int")
        out = out.withColumn(c, T.cap_length(F.col(c), F.lit(limits.get(c))))
    seen = Observation(f"changes of {table}")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = out.observe(seen, F.count("*").alias("kept"), total(F.size("__changes")).alias("cells"), total(touched).alias("freetext"), total(spans).alias("spans"))
    written = materialized(out.drop(*[f"__n{k}" for k in range(len(texts))]))
    return written, seen.get


def anonymize_archive(
    rows: Mapping[str, DataFrame],
    fks: Iterable[R.ForeignKey] = (),
    subset: Subset | None = None,
    inv: DataFrame | None = None,
    refs: DataFrame | None = None,
    placeholders: DataFrame | None = None,
    max_len: Mapping[str, Mapping[str, int]] | None = None,
    names: Names = privacy.KNOWN,
) -> Anonymized:
    """Anonymises tables (by table_key, with row_pos) of one archive, their files and the references to these.

    With a subset only its rows stay, with their parents. Columns are classified by the last rows of the tables as they
    come in; values of a type get stand-ins, the same for the same original everywhere; free text loses identity numbers,
    mail addresses and names. Files (inv: archive_id, table_key, lob, path, basename, ext) that a kept row refers to (refs: archive_id,
    table_key, row_pos, col_idx, ref, length, digest) become the placeholder of their format, other files go, and the
    references get the new length and digest.

    Each table is read once and written once, to the shared folder; only classes and counts, some rows for each table,
    reach the driver. An empty table stays empty.
    """
    fks = list(fks)
    declared = {t: df.count() for t, df in rows.items()}
    classes = materialized(classify_tables(rows, names))
    kinds: dict[str, dict[str, str]] = {t: {} for t in rows}
    for r in classes.collect():
        kinds[r["table_key"]][r["col_name"]] = r["pii_type"]
    kept = dict(rows)
    if subset is not None:
        keep = R.referential_subset(rows, fks, subset.n, important=subset.important, excluded=subset.excluded, budget=subset.budget)
        kept = {t: R.apply_keep(df, keep[t]) for t, df in rows.items()}
    written, counted = {}, {}
    for t, df in kept.items():
        written[t], counted[t] = _rewritten(t, df, kinds[t], (max_len or {}).get(t, {}), names)
    changes = [df.select(F.inline("__changes")) for df in written.values()]
    ledger = reduce(DataFrame.unionByName, changes).groupBy("type", "original", "fake").agg(F.count("*").alias("cells"))
    tables = {t: df.drop("__changes") for t, df in written.items()}
    spark = classes.sparkSession
    files = new_refs = None
    lobs: dict[str, int] = {}
    if inv is not None and refs is not None and placeholders is not None:
        positions = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("table_key"), "row_pos") for t, df in tables.items()])
        of_kept = refs.join(positions, ["table_key", "row_pos"], "left_semi")
        used = of_kept.select("archive_id", "table_key", P.basename("ref").alias("basename")).distinct()
        files = materialized(L.replace_lobs(inv.join(used, ["archive_id", "table_key", "basename"], "left_semi"), placeholders))
        renames = files.select("archive_id", "table_key", "lob", "path", F.col("path").alias("new_path"), "new_length", F.col("new_md5").alias("new_digest"), F.lit(False).alias("collision"))
        new_refs = P.refresh_refs(of_kept, renames)
        lobs = {r["table_key"]: r["n"] for r in files.groupBy("table_key").agg(F.count("*").alias("n")).collect()}
    counts = spark.createDataFrame(
        [(t, declared[t], c["kept"], c["cells"], c["freetext"], c["spans"], lobs.get(t, 0)) for t, c in counted.items()],
        "table_key string, declared_rows long, kept_rows long, cells long, freetext_cells long, spans long, files long",
    )
    return Anonymized(tables, classes, ledger, files, new_refs, counts)

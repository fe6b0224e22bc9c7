"""Catalog analytics: names, versions, descriptions, copies, statistics, rankings, validation, provenance, scanner logs.

Frames of the catalog hold many archives: a table is (archive_id, table_key), and nothing is compared across archives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

#: What names a table among all archives.
TABLE = ["archive_id", "table_key"]

# Words in table names that mark entities, and in step types that mark changes.
ENTITY_WORDS = (
    "person", "klient", "client", "bruker", "user", "ansatt", "employee", "medarbeider", "kontakt", "contact", "elev", "pasient", "patient", "innbygger", "borger", "medlem",
    "member", "kunde", "customer", "barn", "individ", "deltaker", "soker", "mottaker", "avsender", "journal", "sak", "case", "dokument", "document", "melding", "message", "mail",
    "notat", "note", "vedtak", "vedlegg", "brev", "henvendelse", "soknad", "soeknad", "oppgave", "hendelse", "aktivitet", "behandling",
)
# Words that mark a copy at the end of a table's name.
COPY_WORDS = ("tmp", "temp", "copy", "kopi", "bak", "backup", "sikkerhetskopi", "bup")
#: So many words or dates at the end of a name are taken off, one after the other.
COPY_LAYERS = 6
EVENT_TYPES = ("Adjustment", "Migration", "Tidying", "Deletion", "Anonymisation", "Normalisation")


def version_of(header: Column) -> Column:
    """Format version in a header: the version attribute, else the number in the namespace, else empty."""
    attribute = F.regexp_extract(header, r"""version=["']([0-9.]+)["']""", 1)
    space = F.regexp_extract(header, r"/([0-9]+(?:\.[0-9]+)?)/", 1)
    return F.when(attribute != "", attribute).otherwise(space)


def _plain(c: Column | str) -> Column:
    """A name for comparison: without case and outer blanks."""
    return F.lower(F.trim(c))


def sanitize_schemas(tables: DataFrame) -> DataFrame:
    """Schema names of each archive by first appearance with a safe name: a non-empty one with other characters becomes schema<ordinal>."""
    names = tables.groupBy("archive_id", "schema_name").agg(F.min("table_key").alias("first"))
    ordinal = F.row_number().over(W.partitionBy("archive_id").orderBy("first")) - 1
    bad = (F.trim("schema_name") != "") & ~F.col("schema_name").rlike(r"^[A-Za-z0-9_.-]+$")
    safe = F.when(bad, F.concat(F.lit("schema"), F.col("ordinal"))).otherwise(F.col("schema_name"))
    return names.withColumn("ordinal", ordinal).select("archive_id", "schema_name", "ordinal", safe.alias("safe_name"), bad.alias("renamed"))


def _with_fixes(frame: DataFrame, fixes: DataFrame) -> DataFrame:
    """frame with the fixed name of its schema's folder, and the one name where its archive has one fix only."""
    only = fixes.groupBy("archive_id").agg(F.when(F.count("*") == 1, F.min("fixed_name")).alias("only_name"))
    out = frame.withColumn("schema_folder", F.substring_index("table_key", "/", 1))
    return out.join(fixes, ["archive_id", "schema_folder"], "left").join(only, "archive_id", "left")


def fill_schema_names(tables: DataFrame, fixes: DataFrame) -> DataFrame:
    """Empty schema names from fixes (archive_id, schema_folder, fixed_name); a single fix of an archive serves all its folders, else what has none stays unresolved."""
    empty = F.trim("schema_name") == ""
    name = F.when(~empty, F.col("schema_name")).otherwise(F.coalesce("fixed_name", "only_name", F.lit("")))
    return _with_fixes(tables, fixes).select(*TABLE, name.alias("schema_name"), (empty & (name != "")).alias("filled"), (name == "").alias("unresolved"))


def fill_schema_refs(refs: DataFrame, fixes: DataFrame) -> DataFrame:
    """refs (archive_id, table_key, ref_schema: the schema that a key or a type of the table names) with empty names filled in.

    An empty reference means a schema without a name. It gets the fixed name of its own schema, or else the archive's only
    fix; between several it stays open. updated and unresolved say which; references with a name stay as they are.
    """
    empty = F.trim(F.coalesce("ref_schema", F.lit(""))) == ""
    out = _with_fixes(refs, fixes.withColumn("fixed_name", F.nullif(F.trim("fixed_name"), F.lit(""))))
    name = F.when(~empty, F.col("ref_schema")).otherwise(F.coalesce("fixed_name", "only_name", F.lit("")))
    return out.select(*[name.alias(c) if c == "ref_schema" else F.col(c) for c in refs.columns], (empty & (name != "")).alias("updated"), (empty & (name == "")).alias("unresolved"))


def schema_ref_counts(filled: DataFrame) -> DataFrame:
    """Of what fill_schema_refs returns: references of each archive, and how many were updated and stay unresolved."""
    return filled.groupBy("archive_id").agg(F.count("*").alias("refs"), F.count_if("updated").alias("updated"), F.count_if("unresolved").alias("unresolved"))


def drop_tables(tables: DataFrame, names: DataFrame) -> DataFrame:
    """Tables whose name, in any case, is not marked; names have an archive_id where marks hold for one archive."""
    on = [_plain("table_name") == F.col("marked")]
    marked = names.select(_plain("table_name").alias("marked"), *([F.col("archive_id").alias("marked_archive")] if "archive_id" in names.columns else []))
    if "archive_id" in names.columns:
        on.append(F.col("archive_id") == F.col("marked_archive"))
    return tables.join(marked, on, "left_anti")


def of_tables(tables: DataFrame, frame: DataFrame) -> DataFrame:
    """Rows of a frame whose table is among tables; a key between two tables needs both. Columns, keys and files follow their tables when these are dropped or selected."""
    left = tables.select(*TABLE).distinct()
    out = frame.join(left, TABLE, "left_semi")
    if "ref_table_key" in frame.columns:
        out = out.join(left.withColumnRenamed("table_key", "ref_table_key"), ["archive_id", "ref_table_key"], "left_semi")
    return out.select(*frame.columns)


def rename_schema_refs(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs with ref_schema in its safe name: names are what sanitize_schemas returns, compared without case and outer blanks; other references stay."""
    renamed = names.where("renamed").groupBy("archive_id", _plain("schema_name").alias("schema_key")).agg(F.min_by("safe_name", "ordinal").alias("safe_name"))
    out = refs.withColumn("schema_key", _plain("ref_schema")).join(renamed, ["archive_id", "schema_key"], "left")
    return out.select(*[F.coalesce("safe_name", "ref_schema").alias(c) if c == "ref_schema" else F.col(c) for c in refs.columns], F.col("safe_name").isNotNull().alias("renamed"))


def resolve_suffixes(columns: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Of each archive, each suffix with the columns whose name after the first underscore is it, in any case; none: missing."""
    after = columns.where(F.col("name").contains("_")).select(*TABLE, "name", F.lower(F.regexp_replace("name", "^[^_]*_", "")).alias("key"))
    wanted = columns.select("archive_id").distinct().select("archive_id", F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("suffix")).withColumn("key", F.lower("suffix"))
    out = wanted.join(after, ["archive_id", "key"], "left")
    return out.select("archive_id", "suffix", "table_key", F.col("name").alias("column_name"), F.col("name").isNull().alias("missing"))


def _described(overwrite: bool) -> tuple[Column, Column]:
    """Description of a row with from_edit and from_template: an edit wins, a template fills gaps or, if asked to, overwrites; and whether it differs."""
    order = ["from_edit", *(["from_template", "description"] if overwrite else ["description", "from_template"])]
    chosen = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in order], F.lit(""))
    return chosen, chosen != F.coalesce("description", F.lit(""))


def enrich_tables(tables: DataFrame, template: DataFrame, edits: DataFrame, overwrite: bool = False) -> DataFrame:
    """Descriptions of tables from a template (table_name, description, ord) by name in any case, the last entry of a name; edits (archive_id, table_key, text) win."""
    last = template.groupBy(_plain("table_name").alias("k")).agg(F.max_by("description", "ord").alias("from_template"))
    out = tables.withColumn("k", _plain("table_name")).join(last, "k", "left").join(edits.select(*TABLE, F.col("text").alias("from_edit")), TABLE, "left")
    chosen, changed = _described(overwrite)
    return out.select(*TABLE, "table_name", chosen.alias("description"), changed.alias("changed"))


def enrich(columns: DataFrame, tables: DataFrame, template: DataFrame, edits: DataFrame, overwrite: bool = False) -> DataFrame:
    """Descriptions of columns from a template (table_name, name, text, ord) by both names in any case; an edit (archive_id, table_key, name, text) always wins, a template fills gaps."""
    last = template.groupBy(_plain("table_name").alias("t"), _plain("name").alias("k")).agg(F.max_by("text", "ord").alias("from_template"))
    mine = edits.select(*TABLE, _plain("name").alias("k"), F.col("text").alias("from_edit"))
    out = columns.join(tables.select(*TABLE, _plain("table_name").alias("t")), TABLE, "left").withColumn("k", _plain("name"))
    out = out.join(last, ["t", "k"], "left").join(mine, [*TABLE, "k"], "left")
    chosen, changed = _described(overwrite)
    return out.select(*TABLE, "name", chosen.alias("description"), changed.alias("changed"))


def enriched_counts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per archive, tables and columns whose description was changed by enrich_tables and enrich."""
    n = lambda df, name: df.groupBy("archive_id").agg(F.count_if("changed").alias(name))
    return n(tables, "tables_changed").join(n(columns, "columns_changed"), "archive_id", "full").na.fill(0)


def longest_prefix(folders: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each folder with the description of the longest prefix of its archive that begins it.

    A folder is compared with its own leading paths, not with all prefixes: an equi-join, whatever the sizes.
    """
    parts = F.split("folder", "/")
    leading = folders.select("archive_id", "folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("prefix"))
    best = leading.join(prefixes, ["archive_id", "prefix"]).groupBy("archive_id", "folder").agg(F.max_by("description", F.length("prefix")).alias("description"))
    return folders.select("archive_id", "folder").join(best, ["archive_id", "folder"], "left").select("archive_id", "folder", "description")


def _without_last_layer(parts: Column) -> Column:
    """The parts of a name (digits, separators, other text) without a date or a copy word at the end, and without separators there."""
    separator = lambda p: p.rlike("^[ _-]+$")
    last = lambda p: F.element_at(p, -1)
    bare = lambda p: F.when((F.size(p) > 0) & separator(last(p)), F.slice(p, 1, F.size(p) - 1)).otherwise(p)

    def dated(p: Column, n: int) -> Column:
        """Whether the last n parts are a date: digits, a year first, four, six or eight of them."""
        digits = F.filter(F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), n), lambda x: ~separator(x))
        whole = F.length(F.array_join(digits, ""))
        return (F.size(p) >= n) & F.forall(digits, lambda x: x.rlike("^[0-9]+$")) & (F.length(F.get(digits, F.lit(0))) >= 4) & whole.isin(4, 6, 8)

    def shorter(p: Column) -> Column:
        less = lambda n: F.slice(p, 1, F.size(p) - n)
        out = p
        for word in COPY_WORDS:  # glued to what stands before it
            out = F.when(last(p).endswith(word), F.concat(less(1), F.array(F.substring(last(p), F.lit(1), F.length(last(p)) - len(word))))).otherwise(out)
        for n in (1, 3, 5):
            out = F.when(dated(p, n), less(n)).otherwise(out)
        return F.when(F.size(p) == 0, p).otherwise(F.filter(out, lambda x: x != ""))

    return T.let(T.let(bare(parts), shorter), bare)


def base_name(name: Column) -> Column:
    """A name without the copy words and dates at its end, and without blanks, dashes and underscores at either end."""
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[ _-]+|[^0-9 _-]+"), F.lit(0))
    for _ in range(COPY_LAYERS):
        parts = T.let(parts, _without_last_layer)
    return F.btrim(F.array_join(parts, ""), F.lit(" _-"))


def copy_tables(tables: DataFrame) -> DataFrame:
    """Tables whose name less its copy suffixes is another table's name in the same archive."""
    names = tables.select("archive_id", F.lower("table_name").alias("base")).distinct()
    out = tables.withColumn("base", base_name(F.lower("table_name"))).where((F.col("base") != "") & (F.col("base") != F.lower("table_name")))
    return out.join(names, ["archive_id", "base"], "left_semi").select(*TABLE, "table_name", "base")


def siblings_missing(files: DataFrame, ext: str, sibling: str) -> DataFrame:
    """Files with ext beside which no file of the same stem has the other extension."""
    stem = F.regexp_extract("path", r"^(.*/[^/.]*)", 1)
    other = files.where(F.col("ext") == sibling).select("archive_id", stem.alias("stem"))
    return files.where(F.col("ext") == ext).withColumn("stem", stem).join(other, ["archive_id", "stem"], "left_anti").select("archive_id", "path")


def archive_stats(tables: DataFrame, columns: DataFrame, inv: DataFrame) -> DataFrame:
    """Per archive: schemas, tables, declared rows, tables with large objects (in a column or as files), files, their extensions."""
    lobs = columns.where("lob_folder != ''").select(*TABLE).unionByName(inv.select(*TABLE)).distinct()
    t = tables.groupBy("archive_id").agg(F.countDistinct(F.substring_index("table_key", "/", 1)).alias("schemas"), F.count("*").alias("tables"), F.sum(F.col("declared_rows").cast("long")).alias("rows"))
    with_lobs = lobs.join(tables, TABLE, "left_semi").groupBy("archive_id").agg(F.count("*").alias("lob_tables"))
    f = inv.groupBy("archive_id").agg(F.count("*").alias("lob_files"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"))
    return t.join(with_lobs, "archive_id", "left").join(f, "archive_id", "left").na.fill(0, ["lob_tables", "lob_files"]).na.fill("", ["exts"])


def metadata_coverage(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per archive and kind (tables, columns): all, described, undescribed and the share described."""
    both = tables.select("archive_id", F.lit("tables").alias("kind"), "description").unionByName(columns.select("archive_id", F.lit("columns").alias("kind"), "description"))
    out = both.groupBy("archive_id", "kind").agg(F.count("*").alias("total"), F.count_if(F.trim("description") != "").alias("described"))
    return out.select("archive_id", "kind", "total", "described", (F.col("total") - F.col("described")).alias("undescribed"), F.round(F.col("described") / F.col("total"), 6).alias("share"))


def fk_degree(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """Incoming and outgoing keys of each table."""
    ends = keys.select("archive_id", F.inline(F.array(F.struct(F.col("table_key"), F.lit(0).alias("incoming"), F.lit(1).alias("outgoing")), F.struct(F.col("ref_table_key").alias("table_key"), F.lit(1).alias("incoming"), F.lit(0).alias("outgoing")))))
    counts = ends.groupBy(*TABLE).agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))
    return tables.select(*TABLE).join(counts, TABLE, "left").na.fill(0)


def entity_hits(name: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.lower(name).contains(w).cast("int") for w in ENTITY_WORDS])


def rank_tables(tables: DataFrame, keys: DataFrame, k: int = 8) -> DataFrame:
    """The k most important tables of each archive: by entity words, incoming keys, rows; without either, the largest."""
    scored = tables.join(fk_degree(tables, keys), TABLE).withColumn("hits", entity_hits(F.col("table_name")))
    central = (F.col("hits") > 0) | (F.col("incoming") > 0)
    scored = scored.withColumn("any_central", F.max(central).over(W.partitionBy("archive_id"))).where(central | ~F.col("any_central"))
    order = [F.desc("hits"), F.desc("incoming"), F.desc("declared_rows"), "table_key"]
    ranked = scored.withColumn("place", F.row_number().over(W.partitionBy("archive_id").orderBy(*order))).where(F.col("place") <= k)
    return ranked.select(*TABLE, "table_name", "hits", "incoming", "declared_rows", "place")


def inventory_listing(tables: DataFrame, inv: DataFrame, primary: DataFrame) -> DataFrame:
    """Catalog listing: rows, files and the first four columns of the primary key (primary: archive_id, table_key, col) of each table with (+k) for more, sorted by names."""
    files = inv.groupBy(*TABLE).agg(F.count("*").alias("lob_files"))
    cols = primary.groupBy(*TABLE).agg(F.array_sort(F.collect_list("col")).alias("cols"))
    out = tables.join(files, TABLE, "left").join(cols, TABLE, "left")
    more = F.size("cols") - 4
    shown = F.concat(F.array_join(F.slice("cols", 1, 4), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more, F.lit(")"))).otherwise(""))
    listed = out.select("archive_id", "schema_name", "table_name", "declared_rows", F.coalesce("lob_files", F.lit(0)).alias("lob_files"), F.coalesce(shown, F.lit("")).alias("key_columns"), "description")
    return listed.orderBy("archive_id", F.lower("schema_name"), F.lower("table_name"))


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows in an order; each task keeps k rows, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def validation_findings(tables: DataFrame, columns: DataFrame, keys: DataFrame, files: DataFrame | None = None, rows: DataFrame | None = None, elements: DataFrame | None = None, required: Sequence[str] = ()) -> DataFrame:
    """archive_id, rule, severity, subject, n: what each archive breaks; n counts rows where a rule is about rows, else 1.

    files (archive_id, path, ext): every table file needs its schema file. rows: what readers.row_faults returns.
    elements (archive_id, element) and required: names that every archive's catalog must have, in any case.
    Archives without schemas or tables show up if elements or files know them.
    """
    finding = lambda df, rule, severity, subject, n=None: df.select("archive_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    named = F.concat_ws(".", "table_key", "name")
    found = [
        finding(tables.where("trim(schema_name) = ''"), "schema name is empty", "error", F.col("table_key")),
        finding(tables.where("trim(table_name) = ''"), "table name is empty", "error", F.col("table_key")),
        finding(tables.join(columns, TABLE, "left_anti"), "table has no columns", "error", F.col("table_key")),
        finding(columns.join(tables, TABLE, "left_anti"), "column of an unknown table", "error", named),
        finding(keys.join(tables.select("archive_id", F.col("table_key").alias("ref_table_key")), ["archive_id", "ref_table_key"], "left_anti"), "key refers to an unknown table", "error", F.col("name")),
        finding(tables.where("declared_rows = 0"), "table is empty", "warning", F.col("table_key")),
        finding(tables.where("description = ''"), "table has no description", "info", F.col("table_key")),
    ]
    known = [df.select("archive_id") for df in (elements, files) if df is not None]
    if known:
        archives = reduce(DataFrame.unionByName, known).distinct()
        found.append(finding(archives.join(tables, "archive_id", "left_anti"), "archive has no tables", "warning", F.col("archive_id")))
    if files is not None:
        data = files.where(F.lower("path").rlike("/table[^/]*[.](xml|xsd)$"))
        found.append(finding(siblings_missing(data, "xml", "xsd"), "table file has no schema file", "warning", F.col("path")))
    if rows is not None:
        found.append(finding(rows, "table file is not well formed", "error", F.concat_ws(": ", "path", "fault"), F.col("n")))
    if elements is not None:
        wanted = elements.select("archive_id").distinct().select("archive_id", F.explode(F.array(*[F.lit(r) for r in required]).cast("array<string>")).alias("wanted")).withColumn("k", F.lower("wanted"))
        missing = wanted.join(elements.select("archive_id", F.lower("element").alias("k")), ["archive_id", "k"], "left_anti")
        found.append(finding(missing, "required element is missing", "error", F.col("wanted")))
    return reduce(DataFrame.unionByName, found)


def validation_result(archives: DataFrame, findings: DataFrame) -> DataFrame:
    """Per archive: errors, warnings and the result; archives without findings are sound."""
    counts = findings.groupBy("archive_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = archives.select("archive_id").distinct().join(counts, "archive_id", "left").na.fill(0)
    return out.withColumn("result", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed with warnings").otherwise("passed"))


def provenance_events(steps: DataFrame) -> DataFrame:
    """One event per step that modifies, succeeded, was not skipped and changed something, numbered within its run."""
    kept = steps.where("modifies and success and not skipped and changed > 0")
    kind = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("Adjustment")
    at = F.row_number().over(W.partitionBy("run_id").orderBy("seq"))
    return kept.select("run_id", at.alias("event"), kind.alias("event_type"), F.concat_ws(": ", "event_label", "message").alias("detail"), F.lit(0).alias("outcome"))


def scan_log_verdict(lines: DataFrame) -> DataFrame:
    """Findings, error lines and verdict of each scan from its lines and return code."""
    line = F.lower("line")
    finding = line.rlike("found$|infected files: [1-9]|threat")
    error = line.rlike("error|failed with")
    out = lines.groupBy("scan_id").agg(F.max("return_code").alias("return_code"), F.count_if(finding).alias("findings"), F.count_if(error).alias("errors"))
    verdict = F.when(F.col("findings") > 0, "infected").when((F.col("errors") > 0) | (F.col("return_code") > 1), "error").when(F.col("return_code") == 1, "suspect").otherwise("clean")
    return out.withColumn("verdict", verdict)

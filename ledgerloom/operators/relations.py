"""Row positions, even spreads, foreign-key edges and referentially consistent subsets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.shared import materialized, write_shared


@dataclass(frozen=True)
class ForeignKey:
    """Columns of a child table that name a row of a parent table; several columns make a composite key."""

    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def with_row_pos(df: DataFrame, order: Iterable[str], name: str = "row_pos", keep: Iterable[str] | None = None) -> DataFrame:
    """df, or its columns keep, with the 0-based place of each row in the given order.

    Rows are dealt out by range and sorted within partitions; a partition's offset is the count of the rows before it,
    so no task ever holds more than its range. Equal rows get neighbouring places. Only the columns asked for are written, and
    only those of the order are sorted that can tell them apart.
    """
    keep = None if keep is None else list(keep)
    placed = _placed(df, _telling(order, keep), keep)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def preview(rows: DataFrame, order: Iterable[str], n: int = 10) -> DataFrame:
    """The first n rows in order, null last, all columns as trimmed text; no table is sorted as a whole. The text of all columns settles ties, so that each run gives the same rows."""
    ties = [F.col(c).cast("string").asc_nulls_last() for c in rows.columns]
    first = rows.orderBy(*[F.col(c).asc_nulls_last() for c in order], *ties).limit(n)
    return first.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in rows.columns])


def _telling(order: Iterable[str], keep: Iterable[str] | None) -> list[str]:
    """The order up to its last column that is kept, if it names all that are: rows that agree so far are alike, whichever stands first."""
    order, keep = list(order), set(keep or ())
    return order[: max(order.index(c) for c in keep) + 1] if keep and keep <= set(order) else order


def _placed(df: DataFrame, order: Iterable[str], keep: Iterable[str] | None = None) -> DataFrame:
    """df, or its columns keep, dealt out by range and written, with each row's range and its 0-based place there."""
    cols = [F.col(c).asc_nulls_first() for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).select(*(keep or df.columns))
    placed = placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return materialized(placed)  # range bounds are sampled: a second run could draw others


def numbered(df: DataFrame, group: str, order: Iterable[str], name: str = "at") -> DataFrame:
    """df with the 1-based place of each row within its group, in the given order.

    A large group is spread over many tasks, and stays so: rows meet the number of their group's rows in earlier ranges by group and range.
    """
    placed = _placed(df, [group, *order])
    counts = placed.groupBy(F.col("__part").alias("__range"), F.col(group).alias("__group")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__group").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", "__group", (before - F.col("__first")).alias("__before"))
    joined = placed.join(counts, (F.col("__part") == F.col("__range")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__at") + F.col("__before") + 1).drop("__part", "__at", "__range", "__group", "__before")


def spread_positions(df: DataFrame, n: int, threshold: int) -> DataFrame:
    """row_pos of n rows spread evenly, int(i * total / n); of all rows if there are at most threshold or n."""
    total = df.count()
    if total <= max(threshold, n):
        return df.select("row_pos")
    places = df.sparkSession.range(n).select(F.floor(F.col("id") * F.lit(float(total)) / F.lit(float(n))).alias("row_pos")).distinct()
    return df.select("row_pos").join(F.broadcast(places), "row_pos", "left_semi")


def spread_sample(df: DataFrame, n: int, threshold: int) -> DataFrame:
    return df.join(spread_positions(df, n, threshold), "row_pos", "left_semi")


def fk_edges(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """(child_pos, parent_pos): a null in a key part resolves to nothing; of several parents with one key the last counts."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(fk.parent_columns)]
    parents = parent.select(*keys, "row_pos").groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max("row_pos").alias("parent_pos"))
    kids = child.select(F.col("row_pos").alias("child_pos"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(fk.columns)])
    return kids.join(parents, [f"k{i}" for i in range(len(keys))]).select("child_pos", "parent_pos")


def expand_children(edges: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """(parent_pos, child_pos) of the first cap children, in row order, of each seed row."""
    met = edges.join(seeds.select(F.col("row_pos").alias("parent_pos")), "parent_pos", "left_semi")
    at = F.row_number().over(W.partitionBy("parent_pos").orderBy("child_pos"))
    return met.withColumn("at", at).where(F.col("at") <= cap).select("parent_pos", "child_pos")


def _rings(tables: Iterable[str], fks: list[ForeignKey]) -> list[list[str]]:
    """Tables in an order that has every child before its parents; tables that reach each other through keys stand together."""
    to: dict[str, set[str]] = {t: {f.parent for f in fks if f.child == t} for t in tables}

    def reached(start: str) -> set[str]:
        seen, left = set(), [start]
        while left:
            more = to[left.pop()] - seen
            seen |= more
            left += more
        return seen

    below = {t: reached(t) for t in to}
    rings, done = [], set()
    while len(done) < len(to):
        for t in to:  # ready: all tables that reach t are done, or reach each other with it
            if t not in done and all(o in done or o in below[t] for o in to if t in below[o] and o != t):
                ring = [o for o in to if o == t or (o in below[t] and t in below[o])]
                rings.append(ring)
                done.update(ring)
    return rings


#: A pass sends at most so many rows of a table to every executor; more meet the keys by a shuffle, so that passes send the driver no more as tables grow.
FEW_ROWS = 50_000


def _met(df: DataFrame, rows: DataFrame, n: int, on: str, how: str) -> DataFrame:
    """df joined with n rows: sent to every executor if they are few, else sorted and merged, whatever their files' size lets expect."""
    return df.join(F.broadcast(rows) if n <= FEW_ROWS else rows.hint("merge"), on, how)


def _closed_ring(keep: dict[str, DataFrame], edges: Mapping[str, DataFrame], ring: list[str], fks: list[ForeignKey]) -> None:
    """Closes keep over the tables of a ring. Each pass joins the keys with the rows that the last one added, drops what is kept, and writes what is new.

    The keys within the ring are written once. A pass reads them, the rows of the last pass and those kept so far, and
    nothing else; its plan stays as it is, since what is kept is one scan over the parts written. The number of
    passes is the longest chain of keys from a kept row to a row not kept before, at most; a table of counts, one
    for each table, reaches the driver, and of rows at most FEW_ROWS for each join.
    """
    spark = keep[ring[0]].sparkSession
    inner = [f for f in fks if f.child in ring and f.parent in ring]
    linked = {f.name: materialized(edges[f.name].select("child_pos", "parent_pos")) for f in inner}
    parts: dict[str, list[str]] = {t: [] for t in ring}
    total = dict.fromkeys(ring, 0)

    def put(t: str, rows: DataFrame) -> DataFrame:
        parts[t].append(write_shared(rows))
        return spark.read.schema(rows.schema).parquet(parts[t][-1])

    def kept(t: str) -> DataFrame:
        return spark.read.schema(keep[t].schema).parquet(*parts[t])

    added = {t: put(t, keep[t].select("row_pos").distinct()) for t in ring}
    while added:
        counts = [df.select(F.lit(t).alias("t")) for t, df in added.items()]
        some = {r["t"]: r["count"] for r in reduce(DataFrame.unionByName, counts).groupBy("t").count().collect()}
        new = {t: df for t, df in added.items() if t in some}
        for t in new:
            total[t] += some[t]
        found = {}
        for f in inner:
            if f.child in new:
                start = new[f.child].select(F.col("row_pos").alias("child_pos"))
                more = _met(linked[f.name], start, some[f.child], "child_pos", "left_semi").select(F.col("parent_pos").alias("row_pos"))
                found[f.parent] = found[f.parent].unionByName(more) if f.parent in found else more
        added = {t: put(t, _met(df.distinct(), kept(t), total[t], "row_pos", "left_anti")) for t, df in found.items()}
    for t in ring:
        keep[t] = kept(t)


def close_parents(keep: Mapping[str, DataFrame], edges: Mapping[str, DataFrame], fks: list[ForeignKey]) -> dict[str, DataFrame]:
    """keep (row_pos per table) with the parents of every kept row, theirs, and so on.

    Tables are taken children first, so that one semi join for each foreign key does it; only tables whose keys form a
    ring (also one that refers to itself) go round in passes, see _closed_ring. What several keys read is written to
    the folder in spark.checkpoint.dir, so plans stay short and lost tasks cost one step.
    """
    keep = dict(keep)
    for ring in _rings(keep, fks):
        out = [f for f in fks if f.child in ring and f.parent not in ring]
        if len(ring) > 1 or any(f.child == f.parent == ring[0] for f in fks):
            _closed_ring(keep, edges, ring, fks)
        elif out:  # complete from here on, and read once for each foreign key
            keep[ring[0]] = materialized(keep[ring[0]])
        for f in out:
            kept = keep[f.child].select(F.col("row_pos").alias("child_pos"))
            more = edges[f.name].join(kept, "child_pos", "left_semi").select(F.col("parent_pos").alias("row_pos"))
            keep[f.parent] = keep[f.parent].unionByName(more).distinct()
    return keep


def referential_subset(rows: Mapping[str, DataFrame], fks: list[ForeignKey], n: int, threshold: int | None = None, cap: int | None = None, important: Iterable[str] = (), excluded: Iterable[str] = (), budget: int | None = None) -> dict[str, DataFrame]:
    """row_pos to keep, per table: seeds, then children of important tables' seeds, then all parents.

    Seeds are n rows spread over each table that is not excluded (a small one whole); children are the first cap per
    seed row and foreign key, one level, in the order of table, seed, foreign key and row, until budget rows (50 * n *
    tables) are kept, seeds counted; rows that are seeds already cost nothing. If the seeds alone fill the budget, the
    first child comes on top. Excluded tables can return as children or parents, which closure needs.
    """
    threshold, cap = n if threshold is None else threshold, n if cap is None else cap
    budget = 50 * n * len(rows) if budget is None else budget
    seeds = {t: materialized(spread_positions(df, n, threshold)) if t not in set(excluded) else df.select("row_pos").limit(0) for t, df in rows.items()}
    edges = {f.name: fk_edges(rows[f.child], rows[f.parent], f) for f in fks}
    keep, chosen = dict(seeds), []
    for i, t in enumerate(rows):
        for j, f in enumerate(fks):
            if t in set(important) and f.parent == t:
                chosen.append(expand_children(edges[f.name], seeds[t], cap).select(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(f.child).alias("table"), "parent_pos", F.col("child_pos").alias("row_pos")))
    if chosen:
        kids = chosen[0]
        for c in chosen[1:]:
            kids = kids.unionByName(c)
        order = ["i", "parent_pos", "j", "row_pos"]
        left = budget - sum(df.count() for df in seeds.values())
        if left > 0:
            kids = kids.groupBy("table", "row_pos").agg(F.min(F.struct("i", "parent_pos", "j")).alias("first")).select("table", "row_pos", "first.*")
            for t in {f.child for f in fks if f.parent in set(important)}:
                kids = kids.join(seeds[t].select(F.lit(t).alias("table"), "row_pos"), ["table", "row_pos"], "left_anti")
        kids = materialized(kids.orderBy(*order).limit(max(left, 1)))
        for t in {f.child for f in fks if f.parent in set(important)}:
            keep[t] = keep[t].unionByName(kids.where(F.col("table") == t).select("row_pos")).distinct()
    return close_parents(keep, edges, fks)


def kept_counts(rows: Mapping[str, DataFrame], keep: Mapping[str, DataFrame]) -> DataFrame:
    """table, kept, total."""
    out = None
    for t, df in rows.items():
        one = keep[t].agg(F.count("*").alias("kept")).crossJoin(df.agg(F.count("*").alias("total"))).select(F.lit(t).alias("table_name"), "kept", "total")
        out = one if out is None else out.unionByName(one)
    return out


def apply_keep(rows: DataFrame, keep: DataFrame) -> DataFrame:
    return rows.join(keep, "row_pos", "left_semi")


def fk_violations(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows whose complete key has no parent."""
    on = [child[c] == parent[p] for c, p in zip(fk.columns, fk.parent_columns, strict=True)]
    return child.dropna(subset=list(fk.columns)).join(parent, on, "left_anti")


def fk_audit(rows: Mapping[str, DataFrame], fks: list[ForeignKey]) -> DataFrame:
    """fk, checked, violations for each foreign key."""
    out = None
    for f in fks:
        child = rows[f.child]
        complete = child.dropna(subset=list(f.columns))
        one = complete.agg(F.count("*").alias("checked")).crossJoin(fk_violations(child, rows[f.parent], f).agg(F.count("*").alias("violations"))).select(F.lit(f.name).alias("fk"), "checked", "violations")
        out = one if out is None else out.unionByName(one)
    return out


def refreshed_counts(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """archive_id, table_key, declared_rows, actual_rows and whether they differ; rows has one row per kept row with its archive and table."""
    table = ["archive_id", "table_key"]
    out = declared.join(rows.groupBy(*table).agg(F.count("*").alias("actual_rows")), table, "left").na.fill(0, ["actual_rows"])
    return out.select(*table, "declared_rows", "actual_rows", (F.col("declared_rows") != F.col("actual_rows")).alias("changed"))


def pair_documents(rows: DataFrame, case_id: str, seq: str, order: list[str], main: int = 1, data: int = 2) -> DataFrame:
    """The rows whose seq is main, each with data: the first row, by order, whose seq is data in the same case; null without one.

    Rows with a null case have no data. Several main rows of a case share its first data row. One shuffle by case, after
    the first row of each case and task has been picked.
    """
    fields = F.struct(*[F.col(c) for c in rows.columns if c != case_id])
    first = rows.where(F.col(seq) == data).groupBy(case_id).agg(F.min_by(fields, F.struct(*order)).alias("data"))
    return rows.where(F.col(seq) == main).join(first, case_id, "left")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """mains, paired and singles of what pair_documents returns."""
    return pairs.agg(F.count("*").alias("mains"), F.count("data").alias("paired"), F.count_if(F.col("data").isNull()).alias("singles"))

"""Queries of relations: positions, spreads, foreign keys, subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import relations as R
from .fixtures import Inputs
from .registry import demo

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
KEYS = [
    R.ForeignKey("nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    R.ForeignKey("customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    R.ForeignKey("supplier_nation", "supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    R.ForeignKey("orders_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    R.ForeignKey("lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    R.ForeignKey("lineitem_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    R.ForeignKey("lineitem_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
]


def star_rows(i: Inputs) -> dict[str, DataFrame]:
    """Key columns of each table with row positions in the order of all columns."""
    keys = {t: sorted({c for f in KEYS for c in (f.columns if f.child == t else ()) + (f.parent_columns if f.parent == t else ())}) for t in STAR}
    out = {}
    for t in STAR:
        df = getattr(i, t)
        if t != "lineitem":  # the first column is unique: no need to carry the rest through the sort
            df = df.select(*dict.fromkeys([df.columns[0], *keys[t]]))
        out[t] = R.with_row_pos(df, df.columns, keep=keys[t])
    return out


ORDER = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
}
N = 50


def _p(*tables: str) -> str:
    """Row positions, in SQL; the first column of all tables but lineitem is unique."""
    return ", ".join(f"p_{t} AS (SELECT *, row_number() OVER (ORDER BY {ORDER[t]}) - 1 AS row_pos FROM {t})" for t in tables)


def _s(t: str, n: int = N, whole: int = N) -> str:
    spread = f"SELECT CAST(floor(i * CAST((SELECT count(*) FROM {t}) AS DOUBLE) / {n}.0) AS BIGINT) FROM range({n}) r(i)"
    return f"s_{t} AS (SELECT row_pos FROM p_{t} WHERE (SELECT count(*) FROM {t}) <= {whole} OR row_pos IN ({spread}))"


_KIDS = f"kids AS (SELECT parent_pos, row_pos FROM (SELECT c.row_pos AS parent_pos, o.row_pos, row_number() OVER (PARTITION BY c.row_pos ORDER BY o.row_pos) AS place FROM p_orders o JOIN p_customer c ON o.o_custkey = c.c_custkey JOIN s_customer s ON s.row_pos = c.row_pos) WHERE place <= {N})"


def _closure(base: dict[str, str]) -> str:
    parts = []
    for t in ["lineitem", "orders", "part", "customer", "supplier", "nation", "region"]:
        body = base.get(t, f"SELECT row_pos FROM s_{t}")
        for f in KEYS:
            if f.parent == t:
                body += f" UNION SELECT p.row_pos FROM p_{t} p JOIN p_{f.child} c ON c.{f.columns[0]} = p.{f.parent_columns[0]} JOIN k_{f.child} k ON k.row_pos = c.row_pos"
        parts.append(f"k_{t} AS ({body})")
    return ", ".join(parts)


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM k_{t}) AS kept, (SELECT count(*) FROM {t}) AS total" for t in STAR)
_SEEDS = ", ".join(_s(t) for t in STAR)


@demo(f"WITH {_p(*STAR)}, {_SEEDS}, {_KIDS}, {_closure({'orders': 'SELECT row_pos FROM s_orders UNION SELECT row_pos FROM kids'})} {_COUNTS}")
def referential_subset(i: Inputs) -> DataFrame:
    rows = star_rows(i)
    return R.kept_counts(rows, R.referential_subset(rows, KEYS, N, important=["customer"]))


_LEFT = "greatest(400 - (" + " + ".join(f"(SELECT count(*) FROM s_{t})" for t in STAR) + "), 1)"
_CAPPED = f"few AS (SELECT row_pos FROM (SELECT row_pos, row_number() OVER (ORDER BY parent_pos, row_pos) AS place FROM kids WHERE row_pos NOT IN (SELECT row_pos FROM s_orders)) WHERE place <= {_LEFT})"


@demo(f"WITH {_p(*STAR)}, {_SEEDS}, {_KIDS}, {_CAPPED}, {_closure({'orders': 'SELECT row_pos FROM s_orders UNION SELECT row_pos FROM few'})} {_COUNTS}")
def referential_subset_capped(i: Inputs) -> DataFrame:
    """At most 400 rows before closure: the budget binds."""
    rows = star_rows(i)
    return R.kept_counts(rows, R.referential_subset(rows, KEYS, N, important=["customer"], budget=400))


@demo(f"WITH {_p(*STAR)}, {_SEEDS}, {_closure({t: f'SELECT row_pos FROM p_{t} WHERE false' for t in STAR if t != 'lineitem'})} {_COUNTS}")
def parent_closure(i: Inputs) -> DataFrame:
    rows = star_rows(i)
    keep = {t: df.select("row_pos").where("false") for t, df in rows.items()} | {"lineitem": R.spread_positions(rows["lineitem"], N, N)}
    return R.kept_counts(rows, R.close_parents(keep, {f.name: R.fk_edges(rows[f.child], rows[f.parent], f) for f in KEYS}, KEYS))


@demo("""WITH pa AS (SELECT l_orderkey, l_suppkey, max(row_number) - 1 AS parent_pos FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END NULLS FIRST) AS row_number FROM lineitem WHERE l_linenumber <= 2) GROUP BY 1, 2),
ch AS (SELECT l_orderkey, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END NULLS FIRST) - 1 AS child_pos FROM lineitem WHERE l_linenumber > 1)
SELECT child_pos, parent_pos FROM ch JOIN pa ON ch.l_orderkey = pa.l_orderkey AND ch.l_suppkey = pa.l_suppkey""")
def fk_edges_composite(i: Inputs) -> DataFrame:
    """A key of two columns, one of them null now and then; of several parents the last counts."""
    lines = i.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("supplier"))
    placed = lambda df: R.with_row_pos(df, ["l_orderkey", "l_linenumber", "supplier"])
    fk = R.ForeignKey("f", "child", ("l_orderkey", "supplier"), "parent", ("l_orderkey", "supplier"))
    return R.fk_edges(placed(lines.where("l_linenumber > 1")), placed(lines.where("l_linenumber <= 2")), fk)


@demo(f"WITH {_p('customer')}, {_s('customer')} SELECT c_custkey, c_name, row_pos FROM p_customer WHERE row_pos IN (SELECT row_pos FROM s_customer)")
def keep_rows(i: Inputs) -> DataFrame:
    rows = R.with_row_pos(i.customer.select("c_custkey", "c_name"), ["c_custkey"])
    return R.apply_keep(rows, R.spread_positions(rows, N, N))


#: Orders that refer to the order with a third of their key, every seventh to the one after, every thirteenth to none; customers that refer to their last order.
_RING = """og AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1 ELSE CAST(floor(o_orderkey / 3) AS BIGINT) END AS p FROM orders), cg AS (SELECT o_custkey AS k, max(o_orderkey) AS p FROM orders GROUP BY 1),
ed AS (SELECT 'orders' AS a, og.k AS x, 'orders' AS b, q.k AS y FROM og JOIN og q ON q.k = og.p UNION ALL SELECT 'orders', og.k, 'customer', cg.k FROM og JOIN cg ON cg.k = og.c UNION ALL SELECT 'customer', cg.k, 'orders', og.k FROM cg JOIN og ON og.k = cg.p UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer),
sd AS (SELECT 'orders' AS t, o_orderkey AS row_pos FROM orders WHERE o_orderkey % 997 = 5)"""


@demo("WITH RECURSIVE " + _RING + ", kg AS (SELECT t, CAST(row_pos AS BIGINT) AS row_pos FROM sd UNION SELECT b, CAST(y AS BIGINT) FROM kg JOIN ed ON a = t AND x = row_pos) SELECT t AS table_name, row_pos FROM kg")
def closure_cycles(i: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    prev = F.when(k % 13 == 0, F.lit(-1)).when(k % 7 == 0, k + 1).otherwise(F.floor(k / 3))
    orders = i.orders.select(k.alias("row_pos"), k.alias("id"), F.col("o_custkey").alias("customer"), prev.alias("prev"))
    last = i.orders.groupBy(F.col("o_custkey").alias("row_pos")).agg(F.max("o_orderkey").alias("last"))
    customer = i.customer.select(F.col("c_custkey").alias("row_pos"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")).join(last, "row_pos", "left")
    nation = i.nation.select(F.col("n_nationkey").alias("row_pos"), F.col("n_nationkey").alias("id"))
    rows = {"orders": orders, "customer": customer, "nation": nation}
    fks = [R.ForeignKey(f"{a}_{c}", a, (c,), b, ("id",)) for a, c, b in (("orders", "prev", "orders"), ("orders", "customer", "customer"), ("customer", "last", "orders"), ("customer", "nation", "nation"))]
    keep = {t: df.select(F.col("row_pos").cast("long")).where(F.col("row_pos") % 997 == 5 if t == "orders" else F.lit(False)) for t, df in rows.items()}
    closed = R.close_parents(keep, {f.name: R.fk_edges(rows[f.child], rows[f.parent], f) for f in fks}, fks)
    return reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("table_name"), F.col("row_pos").cast("long")) for t, df in closed.items()])


@demo(f"WITH {_p('lineitem')} SELECT row_pos, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM p_lineitem")
def row_positions(i: Inputs) -> DataFrame:
    df = i.lineitem
    return R.with_row_pos(df, df.columns).select("row_pos", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@demo(f"WITH {_p('customer')}, {_s('customer', 100, 100)} SELECT p.row_pos, c_custkey, c_name FROM p_customer p JOIN s_customer USING (row_pos)")
def spread_sample(i: Inputs) -> DataFrame:
    df = R.with_row_pos(i.customer, i.customer.columns)
    return R.spread_sample(df, 100, 100).select("row_pos", "c_custkey", "c_name")


@demo(f"WITH {_p('orders', 'customer')} SELECT o.row_pos AS child_pos, c.row_pos AS parent_pos FROM p_orders o JOIN p_customer c ON o.o_custkey = c.c_custkey")
def fk_edges(i: Inputs) -> DataFrame:
    rows = {t: R.with_row_pos(getattr(i, t), [getattr(i, t).columns[0]]) for t in ("orders", "customer")}
    return R.fk_edges(rows["orders"], rows["customer"], KEYS[3])


@demo(f"WITH {_p('orders', 'customer')}, {_s('customer')}, {_KIDS} SELECT parent_pos, row_pos AS child_pos FROM kids")
def child_expand(i: Inputs) -> DataFrame:
    rows = {t: R.with_row_pos(getattr(i, t), [getattr(i, t).columns[0]]) for t in ("orders", "customer")}
    return R.expand_children(R.fk_edges(rows["orders"], rows["customer"], KEYS[3]), R.spread_positions(rows["customer"], N, N), N)


@demo("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0), p AS (SELECT * FROM part WHERE p_partkey % 7 <> 0)
SELECT 'orders_customer' AS fk, count(*) AS checked, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM c)) AS violations FROM orders WHERE o_custkey IS NOT NULL
UNION ALL SELECT 'lineitem_part', count(*), count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM p)) FROM lineitem WHERE l_partkey IS NOT NULL""")
def fk_audit(i: Inputs) -> DataFrame:
    rows = {"orders": i.orders, "lineitem": i.lineitem, "customer": i.customer.where("c_custkey % 5 <> 0"), "part": i.part.where("p_partkey % 7 <> 0")}
    return R.fk_audit(rows, [KEYS[3], KEYS[5]])


@demo("""SELECT t.archive_id, t.table_key, CAST(declared_rows AS BIGINT) AS declared_rows, coalesce(n, 0) AS actual_rows, declared_rows <> coalesce(n, 0) AS changed FROM d_tables t LEFT JOIN
(SELECT 'a0' AS archive_id, 'schema0/table0' AS table_key, count(*) AS n FROM customer UNION ALL SELECT 'a0', 'schema0/table2', count(*) FROM orders UNION ALL SELECT 'a1', 'schema0/table2', count(*) FROM nation) a USING (archive_id, table_key)""")
def row_count_refresh(i: Inputs) -> DataFrame:
    of = lambda df, archive, key: df.select(F.lit(archive).alias("archive_id"), F.lit(key).alias("table_key"))
    rows = of(i.customer, "a0", "schema0/table0").unionAll(of(i.orders, "a0", "schema0/table2")).unionAll(of(i.nation, "a1", "schema0/table2"))
    return R.refreshed_counts(i.d_tables.withColumn("declared_rows", F.col("declared_rows").cast("long")), rows)


@demo("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, trim(o_orderstatus) AS o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 10")
def row_preview(i: Inputs) -> DataFrame:
    return R.preview(i.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


@demo("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, trim(c_name) AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer ORDER BY customer.c_custkey LIMIT 25")
def row_preview_text(i: Inputs) -> DataFrame:
    return R.preview(i.customer.select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"], 25)


#: Turns as the documents of a case: the opening turn is the main document, answers of the assistant are data; every ninth case has lost them.
TURNS = "tn AS (SELECT conv_id, turn, text, CASE WHEN turn = 0 THEN 1 WHEN role = 'assistant' AND conv_id % 9 <> 4 THEN 2 ELSE 3 END AS seq FROM conversations), fd AS (SELECT conv_id, arg_min(text, turn) AS data_text, min(turn) AS data_turn FROM tn WHERE seq = 2 GROUP BY 1), pd AS (SELECT tn.conv_id, text, data_turn, data_text FROM tn LEFT JOIN fd USING (conv_id) WHERE seq = 1)"


def _pairs(i: Inputs) -> DataFrame:
    seq = F.when(F.col("turn") == 0, 1).when((F.col("role") == "assistant") & (F.col("conv_id") % 9 != 4), 2).otherwise(3)
    return R.pair_documents(i.conversations.select("conv_id", "turn", "text", seq.alias("seq")), "conv_id", "seq", ["turn"])


@demo(f"WITH {TURNS} SELECT conv_id, text, data_turn, data_text FROM pd WHERE data_turn IS NOT NULL")
def doc_pairs(i: Inputs) -> DataFrame:
    return _pairs(i).where("data is not null").select("conv_id", "text", F.col("data.turn").alias("data_turn"), F.col("data.text").alias("data_text"))


@demo(f"WITH {TURNS} SELECT conv_id, text FROM pd WHERE data_turn IS NULL")
def doc_singles(i: Inputs) -> DataFrame:
    return _pairs(i).where("data is null").select("conv_id", "text")


@demo(f"WITH {TURNS} SELECT count(*) AS mains, count(data_turn) AS paired, count(*) - count(data_turn) AS singles FROM pd")
def doc_pair_counts(i: Inputs) -> DataFrame:
    return R.pair_counts(_pairs(i))

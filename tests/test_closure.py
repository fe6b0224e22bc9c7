"""Closure of kept rows under foreign keys: random graphs of tables, with and without rings, against a plain search; what a pass reads."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import relations as R
from ledgerloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_order_of_tables():
    fk = lambda a, b: R.ForeignKey(f"{a}{b}", a, ("x",), b, ("id",))
    rings = R._rings("abcdef", [fk("a", "b"), fk("b", "c"), fk("c", "b"), fk("c", "d"), fk("e", "e"), fk("e", "a"), fk("d", "f")])
    assert rings.index(["e"]) < rings.index(["a"]) < rings.index(["b", "c"]) < rings.index(["d"]) < rings.index(["f"])
    assert R._rings([], []) == [] and R._rings("a", []) == [["a"]]


def searched(seeds, links, fks):
    kept = {t: set(v) for t, v in seeds.items()}
    left = [(t, x) for t, v in kept.items() for x in v]
    while left:
        t, x = left.pop()
        for f in fks:
            if f.child == t:
                for a, b in links[f.name]:
                    if a == x and b not in kept[f.parent]:
                        kept[f.parent].add(b)
                        left.append((f.parent, b))
    return kept


def test_random_graphs(spark):
    rng = random.Random(6)
    for _ in range(6):
        tables = "abcd"[: rng.randrange(1, 5)]
        fks = [R.ForeignKey(f"f{k}", rng.choice(tables), ("x",), rng.choice(tables), ("id",)) for k in range(rng.randrange(1, 6))]
        links = {f.name: [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] for f in fks}
        seeds = {t: [x for x in range(30) if rng.random() < 0.07] for t in tables}
        frame = lambda rows, kind: spark.createDataFrame(rows, kind)
        got = R.close_parents({t: frame([(x,) for x in v + v[:1]], "row_pos long") for t, v in seeds.items()}, {n: frame(v, "child_pos long, parent_pos long") for n, v in links.items()}, fks)
        assert {t: sorted(r[0] for r in df.distinct().collect()) for t, df in got.items()} == {t: sorted(v) for t, v in searched(seeds, links, fks).items()}


def test_passes(spark, monkeypatch):
    """A chain of 12 rows that ends in a ring of two: a pass for each step, each joins one row; plans do not grow."""
    written = []
    put = R.write_shared
    monkeypatch.setattr(R, "write_shared", lambda df: (written.append((df.count(), len(df._jdf.queryExecution().optimizedPlan().toString()))), put(df))[1])
    fk = R.ForeignKey("f", "a", ("p",), "a", ("id",))
    edges = spark.createDataFrame([(k, k + 1) for k in range(11)] + [(11, 10), (50, 51)], "child_pos long, parent_pos long")
    keep = R.close_parents({"a": spark.createDataFrame([(0,)], "row_pos long")}, {"f": edges}, [fk])
    assert sorted(r[0] for r in keep["a"].collect()) == list(range(12))
    assert [n for n, _ in written] == [1] * 12 + [0]
    sizes = [n for _, n in written[1:]]
    assert max(sizes) - min(sizes) < 40 * len(sizes)  # but for the list of paths


def test_many_rows_are_not_sent_to_the_driver(spark, monkeypatch):
    """Passes over more rows than FEW_ROWS join by a shuffle, however small their files are; fewer rows are sent to the executors."""
    plans, put = [], R.write_shared
    monkeypatch.setattr(R, "write_shared", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(df))[1])
    monkeypatch.setattr(R, "FEW_ROWS", 100, raising=False)
    fk = R.ForeignKey("f", "a", ("p",), "a", ("id",))
    edges = spark.range(1000).select(F.col("id").alias("child_pos"), F.floor(F.col("id") / 3).alias("parent_pos")).coalesce(1)
    for seeds, sent in ((400, 0), (1, 2)):
        plans.clear()
        keep = R.close_parents({"a": spark.range(999, 999 - seeds, -1).select(F.col("id").alias("row_pos"))}, {"f": edges}, [fk])
        assert {r[0] for r in keep["a"].collect()} == searched({"a": range(999, 999 - seeds, -1)}, {"f": [(k, k // 3) for k in range(1000)]}, [fk])["a"]
        assert plans[2].count("BroadcastHashJoin") == sent, plans[2]


def test_no_seeds(spark):
    fk = R.ForeignKey("f", "a", ("p",), "a", ("id",))
    none = spark.createDataFrame([], "row_pos long")
    assert R.close_parents({"a": none}, {"f": spark.createDataFrame([(1, 2)], "child_pos long, parent_pos long")}, [fk])["a"].count() == 0


def test_query_has_a_ring(spark):
    assert {r["table_name"] for r in registry.QUERIES["closure_cycles"](spark, DATA).collect()} == {"orders", "customer", "nation"}

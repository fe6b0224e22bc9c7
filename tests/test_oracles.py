"""Every registered query of the library against its SQL twin on a second engine."""

import duckdb
import pytest

from ledgerloom.plans import demo_catalog, demo_intake, demo_ledger, demo_lobs, demo_paths, demo_privacy, demo_relations, demo_text, registry  # noqa: F401
from ledgerloom.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert ours
        return
    cur = duck.execute(registry.ORACLES[name])
    found = [d[0] for d in cur.description]
    assert sorted(found) == names
    order = [found.index(n) for n in names]
    assert sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr) == ours


def test_golden_subset(spark):
    rows = {r["table_name"]: (r["kept"], r["total"]) for r in registry.QUERIES["referential_subset"](spark, DATA).collect()}
    assert rows == {"region": (5, 5), "nation": (25, 25), "customer": (98, 150), "supplier": (10, 10), "part": (85, 200), "orders": (576, 1500), "lineitem": (50, 6000)}

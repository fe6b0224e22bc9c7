"""Integer k-means against the contract in plain Python, and its SQL on a second engine."""

import hashlib
import math
import random

import duckdb

from ledgerloom.llm.centroids import CENTROID_SQL, centroid_clusters

DATA = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int"


def expected(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * max(-131072.0, min(131072.0, x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [list(v) for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, members in groups.items():
            centroids[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = [sum(d for _, k, d in out if k == c) for c in range(len(centroids))]
    return [(i, k, d, total[k], sum(total), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in out]


def key(row):
    return tuple((v is None, v or 0) for v in row[:3])


def test_edges(spark):
    rng = random.Random(11)
    vector = lambda: [rng.gauss(0, 1) for _ in range(64)]
    same = vector()
    rows = [(k, vector()) for k in range(150)] + [(k, same) for k in range(200, 260)] + [(7, vector()), (7, same), (7, same), (None, vector()), (None, same), (300, [0.0] * 64), (301, [-1e-9] * 64), (302, [9e5, -9e5] * 32)]
    bad = [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63), (405, [float("nan")] * 64), (406, [float("inf")] * 64), (407, [-float("inf")] + [1.0] * 63)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], KIND).selectExpr("*", "1 point", "2 cluster", "3 distance")
    assert sorted(map(tuple, centroid_clusters(table).collect()), key=key) == sorted(expected(rows), key=key)
    assert sorted(map(tuple, centroid_clusters(table.where("vec_id between 0 and 4")).collect())) == sorted(expected(rows[:5]))
    ties = [(k, [1.0] * 64) for k in range(20)]
    assert sorted(map(tuple, centroid_clusters(spark.createDataFrame([(i, v, None) for i, v in ties], KIND)).collect())) == sorted(expected(ties))
    empty = centroid_clusters(table.limit(0))
    assert empty.count() == 0 and empty.dtypes == centroid_clusters(table).dtypes


def test_sql_and_plain(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = sorted(map(tuple, centroid_clusters(table).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    assert got == sorted(con.execute(CENTROID_SQL).fetchall())
    assert got == sorted(expected([(r["vec_id"], r["embedding"]) for r in table.collect()]))

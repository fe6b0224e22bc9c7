"""Integer k-means by expressions: distances to literal centroid arrays, the nearest by array_min of structs, sums by column."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .store import written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components beyond this count as this, so that a squared distance over 64 of them fits into a long.
MOST = 1 << 27
_KIND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def points_of(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and point (integers floor(scale * x)) of the vectors with exactly so many components, all finite."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = given.where((F.size("vector") == dimensions) & F.coalesce(finite, F.lit(False)))
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * F.lit(float(scale))))).cast("int"))
    return kept.select("vec_id", whole.alias("point"))


def nearest(point: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number where distances tie."""
    table = F.lit(centroids).cast("array<array<bigint>>")

    def distance(centroid: Column) -> Column:
        squares = F.zip_with(point, centroid, lambda x, c: (x.cast("long") - c) * (x.cast("long") - c))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: total + square)

    return F.array_min(F.transform(table, lambda c, number: F.struct(distance(c).alias("distance"), number.alias("cluster"))))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS, salt: str = "3") -> list[list[int]]:
    """The points with the smallest sha256 of "<salt>:<vec_id>", in that order; equal hashes by the points themselves."""
    hashed = points.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "point")
    return [r["point"] for r in hashed.orderBy("hash", "point").limit(clusters).collect()]


def moved_centroids(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the mean of the points of each centroid; one without points stays. Only one row of sums a centroid reaches the driver."""
    sums = [F.sum(F.col("point")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    assigned = points.select(nearest(F.col("point"), centroids)["cluster"].alias("cluster"), "point")
    moved = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(centroids[0]))]
    return moved


def centroid_clusters(vectors: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """Per vector of vectors (vec_id, embedding) with exactly `dimensions` finite components: vec_id, cluster, distance,
    cluster_inertia, inertia and centroid_sha256.

    Points are floor(scale * x), components beyond 2^27 count as 2^27. Null vectors, other lengths, null and non-finite
    components leave a vector out. Rows with the same vec_id are points of their own; a null vec_id is assigned and
    counted but starts no centroid. Fewer vectors than clusters give fewer centroids, equal ones tie towards the smaller
    number; an empty table gives an empty result. Other columns are not read. An inertia beyond a long is null.

    A round is one scan of the written points: no row is shuffled, only a row of sums for each centroid and task, so
    neither a hot cluster nor many equal vectors fill a task. The points are quantised and written once.
    """
    points = written(points_of(vectors, dimensions, scale), "points")
    centroids = first_centroids(points, clusters, salt)
    if not centroids:
        return points.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in _KIND.split(", ")[1:])]).limit(0)
    for _ in range(rounds):
        centroids = moved_centroids(points, centroids)
    best = points.select("vec_id", nearest(F.col("point"), centroids).alias("best")).select("vec_id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))
    sums = {r["cluster"]: r["s"] for r in best.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    fit = lambda s: int(s) if s is not None and s < 1 << 63 else None
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>") if any(v is not None for v in values) else F.lit(None).cast(f"array<{kind}>"), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = [fit(sums.get(k)) for k in range(len(centroids))]
    return best.select(
        "vec_id", F.col("cluster").cast("int"), "distance",
        of(by_cluster, "bigint").alias("cluster_inertia"), F.lit(fit(sum(sums.values()))).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The same rounds, written out one after the other, for DuckDB."""
    parts = [
        f"""points as materialized (
  select row_number() over () as rn, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q
  from embeddings where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS})""",
        f"""c0 as materialized (
  select (row_number() over (order by h, q) - 1)::int as k, q as c
  from (select q, sha256('3:' || vec_id) as h from points where vec_id is not null order by h, q limit {CLUSTERS}))""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} as materialized (
  select rn, any_value(vec_id) as vec_id, any_value(q) as q, min({{'d': d, 'k': k}}) as b
  from (select p.rn, p.vec_id, p.q, c.k, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (p.q[i] - c.c[i]) * (p.q[i] - c.c[i])))::bigint as d from points p, c{r} c)
  group by rn)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} as materialized (
  select c.k, coalesce(m.c, c.c) as c from c{r} c left join (
    select k, list(((s - ((s % n + n) % n)) // n)::bigint order by i) as c
    from (select b.k as k, i, sum(q[i])::bigint as s, count(*) as n from a{r}, range(1, {DIMENSIONS + 1}) t(i) group by b.k, i) group by k) m using (k))""")
    last = f"a{ROUNDS}"
    return "with " + ",\n".join(parts) + f"""
select a.vec_id, a.b.k::int as cluster, a.b.d::bigint as distance, (sum(a.b.d) over (partition by a.b.k))::bigint as cluster_inertia,
  (sum(a.b.d) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from {last} a join c{ROUNDS} c on a.b.k = c.k"""


#: The contract of the registered query, for DuckDB.
CENTROID_SQL = _oracle()

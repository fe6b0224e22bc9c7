"""Near-duplicate embeddings: coarse inverted lists, residual product-quantisation codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .sampling import hash_sample
from .store import written

LISTS, SUBSPACES, CODES = 32, 8, 64
#: Vectors of an inverted list, and queries on it, that meet in one task; longer lists are cut into blocks.
BLOCK = 1500


@dataclass
class Index:
    centres: np.ndarray
    cuts: np.ndarray
    books: list[np.ndarray]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _squared(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(count > 0, total / np.maximum(count, 1), c)
    return c


def fit_index(sample: np.ndarray, seed: int = 9) -> Index:
    """Coarse centres and, of the residuals, a code book for each subspace. sample: vectors of length 1."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    centres = _means(sample, LISTS, rng)
    rest = sample - centres[_squared(sample, centres).argmin(1)]
    cuts = np.unique(np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int))
    return Index(centres, cuts, [_means(rest[:, i:j], CODES, rng) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def _index_of(indexes: dict[int, Index], d: int) -> Index:
    """Of a dimension not in the sample: one list and one code, so that every pair is reranked."""
    return indexes.get(d) or Index(np.zeros((1, d)), np.array([0, d]), [np.zeros((1, d))])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _encoded(index: Index, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and coding error of each vector, and the lists that can hold a vector within radius of it.

    A vector of list c is nearer to c's centre than to x's, so it is as far from x as x is from the plane between both.
    """
    far = _squared(x, index.centres)
    own = far.argmin(1)
    rest = x - index.centres[own]
    codes, error = [], np.zeros(len(x))
    for i, j, book in zip(index.cuts[:-1], index.cuts[1:], index.books, strict=True):
        d = _squared(rest[:, i:j], book)
        codes.append(d.argmin(1))
        error += ((rest[:, i:j] - book[codes[-1]]) ** 2).sum(1)
    between = np.sqrt(_squared(index.centres, index.centres))[own]
    plane = (far - far[np.arange(len(x)), own][:, None]) / np.maximum(2 * between, 1e-12)
    probes = plane <= radius + 1e-6
    probes[np.arange(len(x)), own] = True
    return own, np.stack(codes, axis=1).astype(np.uint8), np.sqrt(error), probes


_ENTRY = "label string, dim int, list int, node long, query boolean, vector binary, codes binary, error double"


def _entries(vectors: DataFrame, indexes, radius: float) -> DataFrame:
    """Each vector once in its list and once, as a query, in each list to probe."""
    names = [f.split()[0] for f in _ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding").to_pylist()
            for d in sorted({len(v) for v in lists}):
                rows = [k for k, v in enumerate(lists) if len(v) == d]
                for at in range(0, len(rows), 2000):
                    pick = rows[at : at + 2000]
                    raw = np.array([lists[k] for k in pick], np.float64)
                    own, codes, error, probes = _encoded(_index_of(indexes.value, d), _unit(raw), radius)
                    part = b.take(pa.array(pick))
                    data = pa.array([v.tobytes() for v in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([d] * len(pick), pa.int32()), pa.array(own, pa.int32()), part.column("node"), pa.array([False] * len(pick)), data, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names)
                    q, where = np.nonzero(probes)
                    q_ = pa.array(q)
                    n = len(q)
                    yield pa.RecordBatch.from_arrays([part.column("label").take(q_), pa.array([d] * n, pa.int32()), pa.array(where, pa.int32()), part.column("node").take(q_), pa.array([True] * n), data.take(q_), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64())], names)

    return vectors.mapInArrow(run, _ENTRY)


def _near(indexes, threshold: float, radius: float):
    """Links of one block of a list with one block of queries."""

    def run(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy(zero_copy_only=False).astype(bool)
        node = table["node"].to_numpy()
        d, at = table["dim"][0].as_py(), table["list"][0].as_py()
        raw = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(-1, d)
        index = _index_of(indexes.value, d)
        kept, asked = np.flatnonzero(~query), np.flatnonzero(query)
        found: list[np.ndarray] = []
        if len(kept) and len(asked):
            codes = np.frombuffer(b"".join(table["codes"].take(pa.array(kept)).to_pylist()), np.uint8).reshape(len(kept), -1)
            reach = (radius + table["error"].to_numpy()[kept] + 1e-6) ** 2
            for k in range(0, len(asked), 256):
                q = asked[k : k + 256]
                rest = _unit(raw[q]) - index.centres[at]
                far = np.zeros((len(q), len(kept)))
                for m, (i, j, book) in enumerate(zip(index.cuts[:-1], index.cuts[1:], index.books, strict=True)):
                    far += _squared(rest[:, i:j], book)[:, codes[:, m]]
                x, y = np.nonzero((far <= reach) & (node[q][:, None] < node[kept]))
                a, b = raw[q[x]], raw[kept[y]]
                cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                ok = cosine >= threshold
                found.append(np.stack([node[q[x[ok]]], node[kept[y[ok]]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, links) of valid vectors with a label: equal vectors form a class named by its smallest vec_id.

    classes: node, copies; members: vec_id, node, once per row; links: pairs a < b of classes of one label with cosine
    threshold or more, all of them: the lists probed and the reach of the codes follow from bounds, not from a number.
    The index is fitted on at most sample_rows vectors chosen by hash; every vector is in it.
    """
    spark = vectors.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>")).where("vec_id is not null and label is not null and embedding is not null").where(F.coalesce(sound, F.lit(False)))
    classes = written(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    members = valid.join(classes, ["label", "embedding"]).select("vec_id", "node")
    sample = hash_sample(classes.select("node", "embedding"), "node", sample_rows).toArrow().sort_by("node")["embedding"].to_pylist()
    fitted = {d: fit_index(_unit(np.array([v for v in sample if len(v) == d], np.float64))) for d in sorted({len(v) for v in sample})}
    indexes = spark.sparkContext.broadcast(fitted)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    entries = written(_entries(classes, indexes, radius), "entries")
    key = ["label", "dim", "list"]
    counts = entries.groupBy(*key).agg(F.ceil(F.count_if(~F.col("query")) / BLOCK).alias("kept_blocks"), F.ceil(F.count_if("query") / BLOCK).alias("query_blocks")).where("kept_blocks > 0")
    dealt = entries.join(counts, key)
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = dealt.withColumn("kept_block", F.explode(F.when(F.col("query"), every("kept_blocks")).otherwise(F.array(mine("kept_blocks")))))
    dealt = dealt.withColumn("query_block", F.explode(F.when(F.col("query"), F.array(mine("query_blocks"))).otherwise(every("query_blocks"))))
    links = dealt.groupBy(*key, "kept_block", "query_block").applyInArrow(_near(indexes, threshold, radius), "a long, b long")
    return classes.select("node", "copies"), members, written(links, "links")


def embedding_components(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine in double precision is threshold or more;
    null or zero vectors, null or non-finite components, null labels and null ids link with nothing and are kept;
    vectors of different lengths do not link. n_links counts rows, copies included. Repeated rows come out as often as
    they go in and count as vectors of their own. An empty table gives an empty result.
    """
    classes, members, links = embedding_links(vectors, threshold)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(classes.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("more"))
    per = classes.join(more, "node", "left").join(connected_components(links), "node", "left")
    per = per.select("node", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    found = members.join(per, "node").select("vec_id", "n_links", "component_id")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    alone = vectors.where(F.col("vec_id").isNull() | F.col("label").isNull() | F.col("embedding").isNull() | ~F.coalesce(sound, F.lit(False)))
    alone = alone.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

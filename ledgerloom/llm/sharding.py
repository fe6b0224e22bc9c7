"""Sharding by a k-d tree with distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .repeats import numbered
from .store import written

#: Bits of a coordinate: VALUE_BITS of the metadata, the rest of a hash that separates equal values.
VALUE_BITS, HASH_BITS = 20, 32
#: A median is found in rounds of so many bits.
ROUND_BITS = 13


def _coordinates(docs: DataFrame) -> list[Column]:
    """One number per metadata dimension: length of the text, source and language in code-point order, doc_id."""
    top = 1 << VALUE_BITS
    text = F.coalesce(F.length("text"), F.lit(0))
    length = F.least(F.log2(1.0 + text) * (top / 40.0), F.lit(top - 1.0))
    head = lambda c: F.conv(F.substring(F.rpad(F.hex(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 8)), 16, "0"), 1, 10), 16, 10).cast("double")
    name = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 10)) + F.floor(head(c) / F.lit(float(1 << 30))) * 1024
    spread = F.pmod(F.xxhash64(F.lit("order"), F.col("doc_id")), F.lit(top))
    return [length, name("source"), name("lang"), spread]


def kd_shards(docs: DataFrame, shards: int = 24, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs (doc_id, text, source, lang).

    size is the UTF-8 bytes of the text plus 8. The tree is split until there are shards leaves, or, where
    target_bytes is given, until leaves hold that many bytes on average. A node that is to become k leaves is cut along
    its widest dimension (range over that of the root) where floor(k/2)/k of its bytes lie below. Coordinates end in a
    hash of the document and of its number among equal rows, so equal values, however many, are cut as evenly as others. A cut is found in rounds: each
    sums bytes by node and range of the coordinate, and the next looks into the range that holds the median; only one
    row per node reaches the driver, at most shards. slot counts from 0 in each shard without gaps.
    Null text has 8 bytes and crc 0; null metadata are values like others; repeated rows get shards and slots of their
    own. An empty table gives an empty result.
    """
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32"), *[c.cast("long").alias(f"v{k}") for k, c in enumerate(_coordinates(docs))])
    dims = 4
    rows = numbered(rows.withColumn("key", F.xxhash64("doc_id", "text_crc32", "size")), "rows")
    copy = F.when(F.col("copy") > 0, F.col("copy"))
    for k in range(dims):
        rows = rows.withColumn(f"v{k}", F.shiftleft(F.col(f"v{k}"), HASH_BITS) + F.pmod(F.xxhash64(F.lit(k), "doc_id", "text_crc32", "size", copy), F.lit(1 << HASH_BITS)))
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    open_nodes = {0: (0, shards)}  # node: first leaf, leaves
    node, fresh, root = F.lit(0), 1, None
    while any(n > 1 for _, n in open_nodes.values()):
        placed = rows.withColumn("node", node)
        wide = placed.where(F.col("node").isin([k for k, (_, n) in open_nodes.items() if n > 1])).groupBy("node").agg(F.sum("size").alias("size"), *[f(F.shiftrightunsigned(f"v{k}", HASH_BITS)).alias(f"{g}{k}") for k in range(dims) for g, f in (("lo", F.min), ("hi", F.max))]).collect()
        if not wide:
            break
        root = root or [max(1, wide[0][f"hi{k}"] - wide[0][f"lo{k}"]) for k in range(dims)]
        chosen = {}
        for r in wide:
            k = max(range(dims), key=lambda k: ((r[f"hi{k}"] - r[f"lo{k}"]) / root[k], -k))
            n = open_nodes[r["node"]][1]
            chosen[r["node"]] = {"dim": k, "goal": r["size"] * (n // 2) / n, "prefix": 0, "below": 0}
        for bits in range(VALUE_BITS + HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
            at = F.lit(None).cast("long")
            for k, c in chosen.items():
                value = F.col(f"v{c['dim']}")
                at = F.when((F.col("node") == k) & (F.shiftrightunsigned(value, bits + ROUND_BITS) == c["prefix"]), F.shiftrightunsigned(value, bits)).otherwise(at)
            sums = placed.withColumn("at", at).where("at is not null").groupBy("node", "at").agg(F.sum("size").alias("own"))
            sums = sums.withColumn("upto", F.sum("own").over(W.partitionBy("node").orderBy("at")))
            goal = F.lit(0.0)
            for k, c in chosen.items():
                goal = F.when(F.col("node") == k, F.lit(float(c["goal"] - c["below"]))).otherwise(goal)
            found = sums.withColumn("goal", goal).where("upto >= goal").groupBy("node").agg(F.min(F.struct("at", "own", "upto")).alias("m")).collect()
            for r in found:
                c = chosen[r["node"]]
                c["prefix"], c["upto"] = r["m"]["at"], c["below"] + r["m"]["upto"]
                c["below"] = c["upto"] - r["m"]["own"]
        after, after_node = {}, node
        for k, (first, n) in open_nodes.items():
            if n == 1 or k not in chosen:
                after[k] = (first, n)
                continue
            c = chosen[k]
            cut = c["prefix"] if c["goal"] - c["below"] < c["upto"] - c["goal"] else c["prefix"] + 1  # below cut: left
            after[fresh], after[fresh + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            after_node = F.when(node == k, F.when(F.col(f"v{c['dim']}") < cut, fresh).otherwise(fresh + 1)).otherwise(after_node)
            fresh += 2
        open_nodes = after
        rows = written(rows.withColumn("node", after_node), "rows")
        node = F.col("node")
    leaf = F.create_map(*[F.lit(x) for k, (first, _) in open_nodes.items() for x in (k, first)])[node]
    rows = rows.select("doc_id", "size", "text_crc32", leaf.cast("int").alias("shard"), "copy", F.pmod(F.xxhash64("doc_id", F.when(F.col("copy") > 0, F.col("copy"))), F.lit(512)).alias("range"))
    counts = rows.groupBy("shard", "range").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    slot = F.row_number().over(W.partitionBy("shard", "range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "copy")) - 1
    return rows.withColumn("slot", slot).join(counts, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).alias("slot"))

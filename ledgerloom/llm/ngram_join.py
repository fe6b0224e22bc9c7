"""N-gram Jaccard join by vertical partitioning of a global n-gram order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .store import written
from .textvec import U, blocks, mix, small, window_hashes, word_bounds, word_hashes

#: Counters of the frequency sketch that orders the n-grams: its size, not its use, is fixed; any counts give an order that keeps all links.
CELLS = 1 << 21
#: Parts in which the sketch travels.
SLICES = 64
#: Leading fragments, used to link the bulk of large groups first.
LEADS = 16
#: Fragments of each frequency class in which partial overlaps are counted.
FRAGMENTS = 4096
#: Fragments of the whole order in which the overlap of a candidate pair is counted.
PARTS = 4
#: Sets of one posting list that are paired in one task; longer lists are dealt out in pairs of blocks.
BLOCK = 2048
#: Posting lists of so many sets are paired row by row, for all lists at once.
FEW = 8
#: Sets in posting lists of more sets than this are first compared with the most central one.
CROWD = 64
#: Bits of the filter that keeps sets of documents without a candidate from being sent.
FILTER_BITS = 1 << 23


def _sets(batch: pa.RecordBatch, text: str, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes."""
    for first, raw, offs in blocks(batch.column(text)):
        starts, ends, rows = word_bounds(raw, offs)
        grams, counts = window_hashes(word_hashes(raw, starts, ends), rows, n, len(offs) - 1)
        at = 0
        for r, c in enumerate(counts.tolist()):
            s = grams[at : at + c]
            at += c
            if c > 1:
                s = np.sort(s)
                keep = np.empty(c, bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield first + r, s


def _ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the global order: rare classes first, then by hash."""
    return np.sort((classes[s & U(len(classes) - 1)].astype(U) << U(60)) | (s >> U(4)))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _long(np.concatenate(parts) if parts else np.zeros(0, U)))


def _name(s: np.ndarray) -> np.uint64:
    return mix(np.array([s.sum(dtype=U) ^ np.bitwise_xor.reduce(mix(s + U(77))) + U(len(s))], U))[0]


def _digests(docs: DataFrame, n: int) -> DataFrame:
    """Of each document: set size, a 64-bit name of its set, the first n-gram of each leading fragment. Besides, rows with slices of the sketch."""
    names = ["doc_id", "n", "node", "leads", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        bounds = (np.arange(LEADS, dtype=U) << U(60))[1:]
        for b in small(batches):
            size, name, leads, seen, held = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U), [], [], 0
            for row, s in _sets(b, "text", n):
                size[row] = len(s)
                if len(s):
                    name[row] = _name(s)
                    cut = np.concatenate(([0], np.searchsorted(s, bounds)))
                    leads.append(s[cut[np.diff(np.append(cut, len(s))) > 0]])
                    seen.append((s & U(CELLS - 1)).astype(np.int32))
                    held += len(s)
                else:
                    leads.append(s)
                if held > 1_000_000 or row == b.num_rows - 1 and held:
                    counts += np.bincount(np.concatenate(seen), minlength=CELLS)
                    seen, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), _long(name), _lists(leads), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names)
        if counts.any():
            capped = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in capped], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n long, node long, leads array<long>, slice int, counts binary")


def _classes(slices: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequency class 0-15 of each sketch cell, from how many times the mean count it holds, and the cuts of the order. CELLS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint8).astype(np.uint32)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "counts"])

    counts = np.zeros((SLICES, CELLS // SLICES))
    for r in slices.repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").toLocalIterator():
        counts[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    mean = max(1.0, counts.sum() / CELLS)
    classes = np.clip(np.log2(np.maximum(counts.ravel(), 1) / mean / 1.5) * 1.25 + 1, 0, 15).astype(np.uint8)
    return classes, _edges(classes, counts.ravel())


def _edges(classes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Where the global order is cut into PARTS fragments of about equal mass; within a class, hashes are spread evenly."""
    per = np.bincount(classes, mass, 16)
    ends = np.cumsum(per)
    cuts = []
    for want in ends[-1] * np.arange(1, PARTS) / PARTS:
        c = int(np.searchsorted(ends, want))
        inside = 1 - (ends[c] - want) / per[c] if per[c] else 0.0
        cuts.append((c << 60) + int(min(max(inside, 0.0), 0.999) * (1 << 60)))
    return np.array(cuts, U)


def _kept(n: int, threshold: float) -> int:
    """Length of the prefix of a set of n: two sets that link share an n-gram of their prefixes."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def _prefixes(docs: DataFrame, n: int, threshold: float, classes) -> DataFrame:
    """Of each set, the prefix in the global order and the place in that order where it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = classes.value[0]
        for b in small(batches):
            size, name, end, lead = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, U), np.zeros(b.num_rows, U), []
            for row, s in _sets(b, "text", n):
                size[row] = k = len(s)
                lead.append(_ordered(s, order)[: _kept(k, threshold) if k else 0])
                if k:
                    name[row], end[row] = _name(s), lead[-1][-1]
            yield pa.RecordBatch.from_arrays([pa.array(size), _long(name), _long(end ^ U(1 << 63)), _lists(lead)], ["n", "node", "last", "grams"])

    return docs.mapInArrow(run, "n long, node long, last long, grams array<long>")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows in order of gram and blocks, cut between lists; a list has at most some 2 * BLOCK rows."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy() for c in ("gram", "p", "q")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        last = {c: rest[-1].column(c)[-1].as_py() for c in ("gram", "p", "q")} if rest else None
        if last and (last["gram"], last["p"], last["q"]) != tuple(key[:, 0].tolist()):
            cut = np.append(0, cut)
        if not len(cut):
            rest.append(b)
            continue
        t = pa.Table.from_batches([*rest, b.slice(0, cut[-1])])
        yield {c: t.column(c).to_numpy() for c in t.column_names}
        rest = [b.slice(cut[-1])]
    if rest:
        t = pa.Table.from_batches(rest)
        yield {c: t.column(c).to_numpy() for c in t.column_names}


def _pairs_of(x: dict[str, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs that meet in a list, of different components, and can still reach the threshold."""

    def able(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = x["n"][i], x["n"][j]
        need = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
        keep = (x["component"][i] != x["component"][j]) & (x["hub"][i] != x["hub"][j]) & (x["node"][i] != x["hub"][j]) & (x["hub"][i] != x["node"][j])
        keep &= (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (np.where(x["last"][i] <= x["last"][j], x["most"][i], x["most"][j]) >= need)
        return i[keep], j[keep]

    key = np.stack([x[c] for c in ("gram", "p", "q")])
    first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
    size = np.diff(np.append(first, key.shape[1]))
    place = np.arange(key.shape[1]) - np.repeat(first, size)
    left = np.repeat(size, size) - place
    long = (size > FEW) | x["split"][first]
    short = ~np.repeat(long, size)
    for k in range(1, FEW):
        i = np.flatnonzero(short & (left > k))
        if len(i):
            yield able(i, i + k)
    for at, count in zip(first[long].tolist(), size[long].tolist(), strict=True):
        rows = np.arange(at, at + count)
        rows = rows[np.argsort(x["n"][rows], kind="stable")]
        visits, free = x["visits"][rows], x["free"][rows]
        own, n, own_free = rows[~visits], x["n"][rows[~visits]], free[~visits]
        for i in rows[visits] if x["split"][at] else rows[free]:
            lo, hi = np.searchsorted(n, math.ceil(threshold * x["n"][i] - 1e-9)), np.searchsorted(n, math.floor(x["n"][i] / threshold + 1e-9), "right")
            j = own[lo:hi]
            # two free sets meet twice
            j = j[~own_free[lo:hi] | (x["node"][j] > x["node"][i])]
            if len(j):
                yield able(np.full(len(j), i), j)


def _across(postings: DataFrame, threshold: float) -> DataFrame:
    """Partial overlaps of pairs of sets of different components and hubs, counted within each fragment.

    most is what a set can share beyond what its prefix shows: of two sets, the one whose prefix ends first in the
    order shares at most its most with the other, so pairs that cannot reach the threshold are never made. base is
    what a pair can share beyond the n-grams counted here.
    """

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            x = np.concatenate(held, axis=1)
            swap = x[0] > x[1]
            x[:, swap] = x[:, swap][[1, 0, 3, 2, 4]]
            x = x[:, np.lexsort((x[4], x[1], x[0]))]
            at = np.flatnonzero(np.append(True, (x[:2, 1:] != x[:2, :-1]).any(0)))
            yield pa.RecordBatch.from_arrays([*(pa.array(y[at]) for y in x), pa.array(np.diff(np.append(at, x.shape[1])))], ["a", "b", "na", "nb", "base", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for x in _whole_lists(batches):
            x["visits"], x["free"], x["split"] = (x[c].astype(bool) for c in ("visits", "free", "split"))
            for i, j in _pairs_of(x, threshold):
                if len(i):
                    base = np.ceil(threshold * np.where(x["last"][i] == x["last"][j], np.maximum(x["n"][i], x["n"][j]), x["n"][np.where(x["last"][i] < x["last"][j], i, j)]) - 1e-9).astype(np.int64) - 1
                    held.append(np.stack([x["node"][i], x["node"][j], x["n"][i], x["n"][j], base]))
                    count += len(i)
                if count > 300_000:
                    yield from flush(held)
                    held, count = [], 0
        yield from flush(held)

    return postings.mapInArrow(run, "a long, b long, na long, nb long, base long, shared long")


def _within_hubs(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between sets of one hub, as many as bind them.

    members: node, n, hub, hub_n, over, differ (n-grams that only the hub or only the set has). Two sets of one hub share over + over - hub_n
    n-grams and those that both their differ have, so that a link costs no look at whole sets. Sets that link with the
    hub are bound already; each block of the others meets each block of all, and a task emits a forest of the links it
    finds. A block holds so many sets and n-grams at most.
    """
    whole = round(100 * threshold)
    members = members.where("node != hub").withColumn("loose", 100 * F.col("over") < whole * (F.col("n") + F.col("hub_n") - F.col("over")))
    mass = F.size("differ") + 64
    blocks = lambda mass: F.ceil(mass / (BLOCK * 128)).cast("int")
    groups = members.groupBy("hub").agg(blocks(F.sum(mass)).alias("ps"), blocks(F.sum(F.when(F.col("loose"), mass))).alias("qs")).where("qs > 0")
    rows = members.join(groups, "hub")
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(all_of("qs"), lambda q: F.struct(place(0, "ps").alias("p"), q.alias("q"), F.lit(False).alias("visits")))
    guest = F.transform(all_of("ps"), lambda p: F.struct(p.alias("p"), place(1, "qs").alias("q"), F.lit(True).alias("visits")))
    rows = rows.withColumn("seat", F.explode(F.when(F.col("loose"), F.concat(own, guest)).otherwise(own))).select("hub", "seat.*", "node", "n", "hub_n", "over", "differ")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, n, over, visits = (t.column(c).to_numpy() for c in ("node", "n", "over", "visits"))
        guest, home = np.flatnonzero(visits), np.flatnonzero(~visits)
        seat = np.empty(len(node), np.int64)
        seat[guest], seat[home] = np.arange(len(guest)), np.arange(len(home))
        lists = t.column("differ").combine_chunks()
        grams = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((~visits[owner], grams))
        grams, owner = grams[order], owner[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
        guests = np.add.reduceat(visits[owner].astype(np.int64), first) if len(first) else first
        homes = np.diff(np.append(first, len(grams))) - guests
        shared = np.zeros(len(guest) * len(home), np.int32)
        pairs, done = np.cumsum(guests * homes), 0
        while done < len(first):
            end = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + 1_000_000, "right")))
            count = (guests * homes)[done:end]
            which = np.repeat(np.arange(done, end), count)
            k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            i, j = first[which] + k // homes[which], first[which] + guests[which] + k % homes[which]
            at, times = np.unique(seat[owner[i]] * len(home) + seat[owner[j]], return_counts=True)
            shared[at] += times.astype(np.int32)
            done = end
        shared = shared.reshape(len(guest), len(home)) + (over[guest][:, None] + over[home][None, :] - t.column("hub_n")[0].as_py())
        link = (100 * shared >= whole * (n[guest][:, None] + n[home][None, :] - shared)) & (node[guest][:, None] != node[home][None, :])
        top = np.iinfo(np.int64).max
        mine, yours = np.where(link.any(1), node[guest], top), np.where(link.any(0), node[home], top)
        while True:
            new = np.minimum(mine, np.where(link, yours[None, :], top).min(1, initial=top))
            other = np.minimum(yours, np.where(link, new[:, None], top).min(0, initial=top))
            if (new == mine).all() and (other == yours).all():
                break
            mine, yours = new, other
        a, b = np.concatenate([mine, yours]), np.concatenate([node[guest], node[home]])
        keep = (a != top) & (a != b)
        return pa.table({"a": a[keep], "b": b[keep]})

    return rows.groupBy("hub", "p", "q").applyInArrow(run, "a long, b long")


def filter_bits(ids: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the hashes of ids: some 2 MB reach the driver, whatever the number of ids."""
    return packed_bits(ids.select(doc_bit(ids["doc_id"]).alias("bit")), FILTER_BITS)


def packed_bits(places: DataFrame, n: int) -> np.ndarray:
    """n bits, set at the places (bit, below n); each task sends one long for every 64 bits at most."""
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def doc_bit(column):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")


def _overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, order, n: int, threshold: float, residual: bool = False) -> DataFrame:
    """Of candidate pairs (a, b, na, nb) the n-grams they share, counted fragment by fragment of the global order and summed; with residual, also the n-grams that only one of them has, for pairs that share the share threshold of b."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bits = spark.sparkContext.broadcast(filter_bits(nodes.join(classes, "node").select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, edges = order.value
        for b in small(batches):
            b = pa.Table.from_batches([b]).filter(pa.array(bits.value[b.column("bit").to_numpy()])).combine_chunks()
            for b in b.to_batches():
                name, part, grams = [], [], []
                for _, s in _sets(b, "text", n):
                    if len(s):
                        name += [_name(s)] * PARTS
                        part += range(PARTS)
                        ordered = _ordered(s, freq)
                        grams += np.split(ordered, np.searchsorted(ordered, edges))
                yield pa.RecordBatch.from_arrays([_long(np.array(name, U)), pa.array(part, pa.int32()), _lists(grams)], ["node", "part", "grams"])

    sets = docs.select("text", doc_bit(docs["doc_id"]).alias("bit")).mapInArrow(run, "node long, part int, grams array<long>").where(F.size("grams") > 0)
    sets = sets.groupBy("node", "part").agg(F.first("grams").alias("grams"))
    left = pairs.select("a", "b", F.explode(F.array([F.lit(k) for k in range(PARTS)])).alias("part"))
    left = left.join(sets.select(F.col("node").alias("b"), "part", F.col("grams").alias("right")), ["b", "part"])
    if not residual:
        left = left.join(sets.select(F.col("node").alias("a"), "part", "grams"), ["a", "part"])
        shared = left.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("right", "grams"))).alias("shared"))
        return pairs.join(shared, ["a", "b"]).select("a", "b", "na", "nb", "shared")
    none = F.array().cast("array<bigint>")
    parts = pairs.select("a", "b", F.explode(F.array([F.lit(k) for k in range(PARTS)])).alias("part"))
    left = parts.join(left, ["a", "b", "part"], "left").join(sets.select(F.col("node").alias("a"), "part", "grams"), ["a", "part"], "left")
    left = left.select("a", "b", F.coalesce("right", none).alias("right"), F.coalesce("grams", none).alias("grams"))
    left = left.select("a", "b", F.array_except("grams", "right").alias("gaps"), F.array_except("right", "grams").alias("rest"))
    differ = left.groupBy("a", "b").agg(F.sum(F.size("rest")).alias("rests"), F.flatten(F.collect_list(F.concat("rest", "gaps"))).alias("differ"))
    shared = F.col("nb") - F.col("rests")
    return pairs.join(differ, ["a", "b"]).select("a", "b", "na", "nb", shared.alias("shared"), F.when(shared >= threshold * F.col("nb"), F.col("differ")).alias("differ"))


def _links(counted: DataFrame, threshold: float) -> DataFrame:
    whole = round(100 * threshold)
    return counted.where(100 * F.col("shared") >= whole * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _need(na: str, nb: str, threshold: float):
    return F.ceil(threshold / (1 + threshold) * (F.col(na) + F.col(nb)) - 1e-9)


def _central_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """Each set of a posting list of more than CROWD with the one of another component that can share most, of those that lead its lists; one pair per set."""
    rows = shared.select("node", "component", "n", "last", "most", F.explode("grams").alias("gram"))
    hub = F.max(F.struct((F.col("most") / F.col("n")).alias("ratio"), "node", "component", "n", "last", "most")).alias("hub")
    met = rows.join(rows.groupBy("gram").agg(hub, F.count("*").alias("rows")).where(F.col("rows") > CROWD), "gram").where("component != hub.component")
    met = met.where(F.when(F.col("last") <= F.col("hub.last"), F.col("most")).otherwise(F.col("hub.most")) >= _need("n", "hub.n", threshold))
    pairs = met.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.first("hub.n").alias("na"), F.first("n").alias("nb"), F.count("*").alias("shared"))
    best = pairs.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb", "shared"), F.struct("shared", "a")).alias("best"))
    best = best.select("best.a", "b", "best.na", "best.nb", "best.shared")
    rest = lambda c: F.ceil(threshold * F.col(c) - 1e-9) - 1
    return best.where(F.col("shared") + F.greatest(rest("na"), rest("nb")) >= _need("na", "nb", threshold)).select("a", "b", "na", "nb")


def _hubs(stars: DataFrame, threshold: float) -> DataFrame:
    """node, n, hub, hub_n, members (of the hub), over (n-grams the set shares with the hub) and differ of each set that shares the share threshold with a hub; of several hubs, the one of most sets."""
    close = stars.where(F.col("shared") >= threshold * F.col("nb"))
    own = close.select("a", F.col("a").alias("b"), "na", F.col("na").alias("nb"), F.col("na").alias("shared"), F.array().cast("array<bigint>").alias("differ")).dropDuplicates(["a"])
    rows = close.select("a", "b", "na", "nb", "shared", "differ").unionByName(own).join(close.groupBy("a").agg(F.count("*").alias("members")), "a")
    best = rows.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb", "members", "shared", "differ"), F.struct("members", "shared", "a")).alias("h"))
    return best.select(F.col("b").alias("node"), F.col("h.nb").alias("n"), F.col("h.a").alias("hub"), F.col("h.na").alias("hub_n"), "h.members", F.col("h.shared").cast("long").alias("over"), "h.differ")


def _dealt(shared: DataFrame) -> DataFrame:
    """Postings of shared, dealt out by fragment of the global order and sorted by n-gram; lists of one component fall out.

    Sets of one hub do not meet here: those of the largest hub of a list are met by its free sets only, so that a list
    of more than BLOCK sets goes out in blocks, each to be visited by the blocks of free sets.
    """
    rows = shared.select("node", "component", "n", "last", "most", F.coalesce("hub", "node").alias("hub"), F.coalesce("members", F.lit(0)).alias("members"), F.explode("grams").alias("gram"))
    lists = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("hub").alias("hub_low"), F.max("hub").alias("hub_high"), F.max(F.struct("members", "hub"))["hub"].alias("main"), F.count("*").alias("rows"))
    lists = lists.where("low != high and hub_low != hub_high").select("gram", "main", "rows")
    rows = rows.join(lists, "gram").withColumn("free", F.col("hub") != F.col("main")).drop("main", "members")
    blocks = F.when(F.col("rows") > BLOCK, F.ceil(F.col("rows") / BLOCK)).otherwise(1).cast("int")
    rows = rows.withColumn("ps", blocks).withColumn("split", F.col("ps") > 1)
    place = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("ps")).cast("int")
    all_of = F.sequence(F.lit(0), F.col("ps") - 1)
    own = F.transform(F.when(F.col("split"), all_of).otherwise(F.array(F.lit(0))), lambda q: F.struct(place(0).alias("p"), q.alias("q"), F.lit(False).alias("visits")))
    guest = F.transform(all_of, lambda p: F.struct(p.alias("p"), place(1).alias("q"), F.lit(True).alias("visits")))
    rows = rows.withColumn("seat", F.explode(F.when(F.col("split") & F.col("free"), F.concat(own, guest)).otherwise(own))).select("*", "seat.*")
    fragment = F.shiftrightunsigned("gram", 60) * FRAGMENTS + F.shiftrightunsigned("gram", 60 - int(math.log2(FRAGMENTS))) % FRAGMENTS
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flags = [F.col(c).cast("int").alias(c) for c in ("visits", "split", "free")]
    rows = rows.select("gram", "p", "q", *flags, "component", "node", "n", "last", "most", "hub", fragment.alias("fragment"))
    return rows.repartition(parts, "fragment", "p", "q").drop("fragment").sortWithinPartitions("gram", "p", "q")


def _shared_prefixes(prefixes: DataFrame, joined: DataFrame) -> DataFrame:
    """node, n, last, component, grams: of each prefix the n-grams that sets of two components have in theirs.

    Both sides of the join are dealt out by n-gram; which n-grams are shared is decided by sums made before the shuffle, so a
    hot n-gram costs one row per task there.
    """
    sets = written(prefixes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "prefixes")
    met = sets.select("component", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("gram")
    kept = sets.select("node", F.explode("grams").alias("gram")).join(met, "gram", "left_semi").groupBy("node").agg(F.collect_list("gram").alias("grams"))
    return kept.join(sets.drop("grams"), "node")


def ngram_components(docs: DataFrame, n: int = 5, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of n-word shingles is threshold or more; a text of
    fewer words is one shingle; a text without words, or null, links with nothing and is its own component. Equal sets
    always link. component_id is the smallest doc_id reachable, null only where all are null. Repeated rows come out
    as often as they go in; other columns are ignored. An empty table gives an empty result.

    Vertical partitioning: shingles have one global order (frequency class from a fixed-size sketch, then hash), and
    the order is cut into fragments. (1) Equal sets become one node. (2) Nodes that agree in several leading fragments
    with the node most central there, their hub, are compared with it and joined, which binds large groups with few
    comparisons. (3) The order's prefix of each set, of which two linking sets must share a shingle, goes to its
    fragments. Shingles that meet no other component there fall out, and those left bound what a set can share with any
    other; sets in long lists are compared with one more hub. Sets of one hub differ from it in few shingles, which
    alone tell what two of them share, block by block: the members of a large group that lie just outside the threshold
    cost no pairs. Fragments then count partial overlaps for pairs of different components and hubs within the
    bound; the sum of a pair bounds it again. (4) For pairs
    within the bound, overlaps are counted fragment by fragment over whole sets and summed. All links between
    components of step 2 are found in steps 3 and 4, so components are exact, up to equal 60-bit hashes in one pair.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    digests = written(_digests(docs, n), "digests")
    order = spark.sparkContext.broadcast(_classes(digests.where("slice is not null").select("slice", "counts")))
    rows = digests.where("slice is null")
    classes = written(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("leads").alias("leads")), "classes")

    leads = classes.select("node", "n", F.explode("leads").alias("lead"))
    common = leads.groupBy("lead").agg(F.count("*").alias("df")).where("df > 1")
    leads = leads.join(common, "lead")
    central = leads.groupBy("node").agg(F.sum(F.log2("df")).alias("central"))
    leads = leads.drop("df").join(central, "node")
    hubs = leads.groupBy("lead").agg(F.max(F.struct("central", "node", "n")).alias("hub"))
    near = leads.join(hubs, "lead").where("node != hub.node").groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.first("hub.n").alias("na"), F.first("n").alias("nb"), F.count("*").alias("agree"))
    near = near.where((F.col("agree") * 3 >= F.least(F.lit(LEADS), "na", "nb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    near = near.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("agree", "a")).alias("best")).select("best.a", "b", "best.na", "best.nb")
    stars = written(_overlaps(near, docs, classes, order, n, threshold, True), "stars")

    prefixes = _prefixes(docs, n, threshold, order).where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "last", "grams")])
    shared = _shared_prefixes(prefixes, connected_components(_links(stars, threshold)))
    most = F.size("grams") + F.ceil(threshold * F.col("n") - 1e-9) - 1
    shared = written(shared.withColumn("most", most), "shared")
    stars = stars.unionByName(written(_overlaps(_central_pairs(shared, threshold), docs, classes, order, n, threshold, True), "stars"))
    hubs = written(_hubs(stars, threshold), "hubs")
    first = written(_links(stars, threshold).unionByName(_within_hubs(hubs, threshold)), "links")
    joined = connected_components(first).withColumnRenamed("component", "now")
    shared = shared.join(joined, "node", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
    postings = _dealt(shared.join(hubs.select("node", "hub", "members"), "node", "left"))
    pairs = _across(postings, threshold).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("base").alias("base"), F.sum("shared").alias("shared"))
    pairs = pairs.where(F.col("shared") + F.col("base") >= _need("na", "nb", threshold)).select("a", "b", "na", "nb")
    links = first.unionByName(_links(_overlaps(pairs, docs, classes, order, n, threshold), threshold))
    joined = written(connected_components(links), "components")
    named = classes.join(joined, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, threshold: float = 0.75) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, one row per doc_id; rows with null doc_id stay.

    Only ids are written; the texts move in a shuffle only if the ids to drop are too many to send to all tasks.
    """
    found = written(ngram_components(docs, n, threshold).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "found")
    gone = written(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    again = written(found.where("rows > 1 and doc_id = component_id").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        return kept
    same = kept["doc_id"] == again["again"]
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, same, "left_anti").unionByName(once)

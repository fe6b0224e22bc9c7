"""Periodic runs of words by maximal pairs of an LCP-interval tree, and texts without what the runs repeat."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .textvec import U, mix

LEAST = 12
#: Bytes of text handled at once; a longer text is handled alone.
STEP = 1 << 21
_SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and the offsets of each text's words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    lengths = pc.list_value_length(lists).to_numpy()
    return words.filter(full), before[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)


def _repeated(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Positions whose n words stand in the same row once more (by a hash: a few others may come along)."""
    size = len(ids) - n + 1
    if size < 2:
        return np.zeros(0, np.int64)
    spread, total = mix(ids.astype(U) + U(1)), np.zeros(size, U)
    for k, factor in enumerate(mix(np.arange(11, 11 + n, dtype=U))):
        total += spread[k : k + size] * factor
    total = mix(total + mix(rows[:size].astype(U) + U(7)))
    inside = rows[:size] == rows[n - 1 :]
    ordered = np.sort(total[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(twice, total), len(twice) - 1)
    return np.flatnonzero(inside & (twice[at] == total))


def _ranks(values: np.ndarray) -> np.ndarray:
    """Place of each value in order, equal ones at the place of their first."""
    _, own, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[own]


def _window_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of all windows of n words in dictionary order; past the end stands a word less than all."""
    ranks, size, covered = _ranks(words), len(words), 1
    while covered < n:
        step = min(covered, n - covered)
        later = np.zeros(size, np.int64)
        later[: max(0, size - step)] = ranks[step:] + 1
        ranks = _ranks(ranks * (size + 2) + later)
        covered += step
    return ranks


def suffix_order(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The suffixes that start at `at`, in dictionary order, by doubling the words compared; only ties are sorted again.

    Every suffix that shares n words with another is in `at`.
    """
    size, ranks, k = len(words), _window_ranks(words, n), n
    tied = at
    while len(tied):
        later = np.zeros(len(tied), np.int64)
        more = tied + k < size
        later[more] = ranks[tied[more] + k] + 1
        order = np.lexsort((later, ranks[tied]))
        tied, later = tied[order], later[order]
        old = ranks[tied]
        first = np.concatenate([[True], (old[1:] != old[:-1])])
        new = first | np.concatenate([[True], later[1:] != later[:-1]])
        places = np.arange(len(tied))
        ranks[tied] = old + np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(first, places, 0))
        alone = new & np.concatenate([new[1:], [True]])
        tied, k = tied[~alone], 2 * k
    return at[np.argsort(ranks[at])]


def _shared_prefixes(words: list[int], order: list[int], at: list[int], n: int) -> list[int]:
    """Words that each suffix shares with the one before it in order. What a position shares, the next one shares but for one word."""
    place, size, out, h, last = dict(zip(order, range(len(order)), strict=True)), len(words), [0] * len(order), 0, -2
    for i in at:
        h = h - 1 if i == last + 1 and h > n else 0
        last = i
        r = place[i]
        if r:
            j = order[r - 1]
            most = size - max(i, j)
            while h < most and words[i + h] == words[j + h]:
                h += 1
        else:
            h = 0
        out[r] = h
    return out


def word_runs(words: np.ndarray, at: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words, by start, then period.

    `at` holds, in order, all positions whose first `least` / 2 words occur again. Two places i < j whose words agree for exactly
    h words, with other words to their left, are a maximal pair: the words from i to j + h have period j - i and no neighbour
    keeps it. They are a run if j - i <= h, that is, if the period stands there twice. So the LCP-interval tree is built from
    the bottom, and at each interval of h shared words the lists of its children are merged, each position with its class,
    the word to its left: positions of different children and classes are the maximal pairs. Of these only neighbours in
    text order are looked at: within a run's first period its first h words cannot begin again, else its period were
    smaller. Where pairs of one stretch have several distances, the least is the period. Each position is merged into a
    longer list at most log(n) times.
    """
    n = (least + 1) // 2
    if len(at) < 2:
        return []
    order = suffix_order(words, at, n).tolist()
    text = words.tolist()
    shared = _shared_prefixes(text, order, at.tolist(), n)
    shared.append(0)
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, h: int) -> None:
        if j - i <= h and h + j - i >= least and (i == 0 or text[i - 1] != text[j - 1]):
            key = (i, h + j - i)
            if j - i < found.get(key, j + 1):
                found[key] = j - i

    waiting: list[tuple[int, list[int]]] = []
    node = [order[0]]
    for r in range(1, len(shared)):
        depth = shared[r]
        while waiting and waiting[-1][0] >= depth:
            h, other = waiting.pop()
            few, many = (node, other) if len(node) <= len(other) else (other, node)
            for i in few:
                k = bisect(many, i)
                if k:
                    pair(many[k - 1], i, h)
                if k < len(many):
                    pair(i, many[k], h)
            if len(few) == 1:
                many.insert(k, few[0])
            else:
                many.extend(few)
                many.sort()
            node = many
        if depth >= n:
            waiting.append((depth, node))
        if r < len(order):
            node = [order[r]]
    return sorted(((i, length, d) for (i, length), d in found.items()), key=lambda x: (x[0], x[2]))


def _block(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    words, offsets = _words(batch.column("text"))
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    at = _repeated(ids, rows, (least + 1) // 2)
    keep, runs = np.ones(len(ids), bool), [[] for _ in counts]
    firsts = np.searchsorted(at, offsets)
    for r in np.flatnonzero(np.diff(firsts) > 1):
        low, high = offsets[r], offsets[r + 1]
        for start, length, period in (own := word_runs(ids[low:high], at[firsts[r] : firsts[r + 1]] - low, least)):
            keep[low + start + period : low + start + length] = False
        runs[r] = [{"start": s, "length": n, "period": p} for s, n, p in own]
    if not keep.all():
        words, offsets = words.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[offsets]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pc.binary_join(lists, " ").cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
                yield _block(batch.slice(at, to - at), least)
                at = to

    return run


def document_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed of each row of docs (doc_id, text).

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period q that is at least
    max(least, 2 q) words long and that no neighbouring word extends. runs: start, length and period, by start, then period.
    collapsed: the words joined by one space, without those that a run holds after its first q words.

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are independent: repeated rows come out as
    often, a null doc_id stays null, other columns are not read, an empty table gives an empty one. A row is handled in
    one task, without a shuffle; texts are taken in blocks of 2 MB, longer ones alone, in memory that grows with the text
    (at most some 25 times its bytes, where all of it repeats).
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_found(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where every tenth document by crc32 h of its doc_id is made to repeat.

    Of n words each word i >= a becomes word a + (i - a) % p, with g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8).
    A null doc_id and a text without words stay as they are.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("planted"), F.filter(F.split("text", _SPACE), lambda w: w != ""))
    given = given.withColumn("words", words).withColumn("n", F.size("words").cast("long"))
    a, g, n = F.col("a"), F.col("g"), F.col("n")
    given = given.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - a) / (3 + g % 8))))

    def source(w: Column, i: Column) -> Column:
        return F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % F.col("p")).cast("int")))

    return given.select("doc_id", F.when(F.col("planted") & (n > 0), F.array_join(F.transform("words", source), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of document_runs: the longest run (ties: smallest start, then period; none: nulls) and digests of runs and text."""
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    top = found.withColumn("top", ranked)
    length, period = F.col("top.length"), -F.col("top.period")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )

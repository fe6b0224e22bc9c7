"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .textvec import BYTE, U, blocks, mix, word_bounds, word_hashes

#: Words of a template window, and how many of them must be literal words.
WINDOW, LITERAL = 8, 5
#: Bits of the filter of benchmark windows that is sent to all tasks.
FILTER_BITS = 1 << 24
UNITS = "kg g mg lb oz km m cm mm mi ft in mph kmh l ml gal s sec seconds second min minutes minute h hours hour days day weeks week months month years year usd eur gbp dollars dollar euros euro cents percent degrees celsius fahrenheit kw kwh w v a hz mb gb tb".split()
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT, _UPPER, _LOWER, _ENDS, _JOINS = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58], _UPPER[65:91], _LOWER[97:123], _LOWER[128:] = True, True, True, True
_ENDS[[10, 13, 33, 46, 58, 63]] = True
_JOINS[[44, 46]] = True
_NUMBER, _UNIT, _NAME = mix(np.array([101, 102, 103], U))
#: Forms of a window: the template; the template with capitalised words at the start of sentences as names; all words in lower case.
FORMS = 3
_FORM = mix(np.array([701, 702, 703], U))
#: Words by which the alignment of one occurrence may drift, as names have one word or several.
DRIFT = 4


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), _OTHER)
    return np.sort(word_hashes(raw, starts, ends))


def _templates(raw: np.ndarray, offs: np.ndarray, units: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Of each word (letters, digits, points within numbers): its place in each form and whether that is a slot; its own hash; its row."""
    gap = _OTHER[raw]
    digit = _DIGIT[raw]
    inner = np.flatnonzero(_JOINS[raw[1:-1]] & digit[:-2] & digit[2:]) + 1 if len(raw) > 2 else np.zeros(0, int)
    marked = np.where(gap, np.uint8(1), np.uint8(0))
    marked[inner] = 0
    starts, ends, rows = word_bounds(marked, offs, np.arange(256) == 1)
    own = word_hashes(raw, starts, ends)
    if not len(starts):
        return [(own, np.zeros(0, bool))] * FORMS, own, rows
    ended = np.concatenate(([0], np.cumsum(_ENDS[raw] & gap)))
    first = np.append(True, (rows[1:] != rows[:-1]) | (ended[starts[1:]] > ended[ends[:-1]]))
    number = digit[starts]
    unit = np.append(False, number[:-1] & (rows[1:] == rows[:-1])) & (units[np.minimum(np.searchsorted(units, own), len(units) - 1)] == own)
    second = np.minimum(starts + 1, len(raw) - 1)
    capital = _UPPER[raw[starts]] & (ends - starts > 1) & _LOWER[raw[second]]
    forms = [(np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, own))), number | unit | name) for name in (~first & capital, capital)]
    return [*forms, (own, number | unit)], own, rows


def _windows(raw: np.ndarray, offs: np.ndarray, units: np.ndarray, short: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """For each form and length, of its windows: first words, rows, places, hashes; all words' slots and own hashes; length and form.

    Windows have WINDOW words; in the first two forms LITERAL of them are literal. Texts of fewer words are one window
    of all their words if short is None; else windows of the lengths in short are made of all texts.
    """
    forms, own, rows = _templates(raw, offs, units)
    begins = np.searchsorted(rows, np.arange(len(offs) - 1))
    counts = np.bincount(rows, minlength=len(offs) - 1)
    for n in (range(1, WINDOW + 1) if short is None else [*short, WINDOW]):
        size = len(own) - n + 1
        if size <= 0:
            continue
        inside = rows[:size] == rows[n - 1 :]
        if short is None and n < WINDOW:
            inside &= counts[rows[:size]] == n
        if not inside.any():
            continue
        factor = mix(np.arange(501, 501 + n, dtype=U)) if n == WINDOW else mix(np.arange(501 + 100 * n, 501 + 101 * n, dtype=U))
        for f, (place, slot) in enumerate(forms):
            h = np.zeros(size, U)
            for k in range(n):
                h += place[k : k + size] * factor[k]
            slots = np.concatenate(([0], np.cumsum(slot)))
            at = np.flatnonzero(inside & (slots[n:] - slots[:size] <= n - LITERAL) if f < FORMS - 1 else inside)
            yield at, rows[at], at - begins[rows[at]], mix(h[at] ^ _FORM[f]), slot, own, n, f


def _hits(table: DataFrame, key: str, bits=None, short: list[int] | None = None) -> DataFrame:
    """(key, place, window, form, words, slots) of the windows of each text; with bits, of those that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_hashes()
        for b in batches:
            keys = b.column(key)
            for first_row, raw, offs in blocks(b.column("text")):
                for at, rows, places, h, slot, own, n, form in _windows(raw, offs, units, short):
                    if bits is not None:
                        hit = bits.value[(h & U(FILTER_BITS - 1)).astype(np.int64)]
                        at, rows, places, h = at[hit], rows[hit], places[hit], h[hit]
                    values = [own[i : i + n][slot[i : i + n]].view(np.int64) for i in at.tolist()]
                    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                    same = lambda x, m=len(at): pa.array(np.full(m, x, np.int32))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(first_row + rows)), pa.array(places, pa.int64()), pa.array(h.view(np.int64)), same(form), same(n), lists], [key, "place", "window", "form", "words", "slots"])

    return table.select(F.col(key).cast("long"), "text").mapInArrow(run, f"{key} long, place long, window long, form int, words int, slots array<long>")


def _filter(windows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[b.column("window").to_numpy() & (FILTER_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in windows.select("window").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(bits).astype(bool)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, consistency: float = 0.8, run_words: int = 13) -> DataFrame:
    """doc_id, item_id, windows, coverage, consistency: one row for each benchmark item that a document holds.

    Texts become templates: numbers, units after numbers, and capitalised words are typed placeholders, at the start of
    sentences in one form of two; other words stand in lower case without punctuation. A third form is all words in
    lower case, so that verbatim copies match whatever their case, line breaks and share of slots. A document holds an
    item if one occurrence has the share coverage of the item's windows (of all places or of those of one form), or a
    run of them that spans run_words words, and the values in the slots agree: each value of the item stands for one
    value in the occurrence in the share consistency of all slots. An occurrence is what stands at one distance from
    the item, or at distances that drift by up to DRIFT words each, or the whole document. An item of fewer than
    WINDOW words is one window of all its words. Null and empty texts hold nothing; null ids meet nothing; rows that
    repeat an id are one document, or one item. An empty table gives an empty result. A fixed-size filter of the
    benchmark's windows goes to the tasks that read documents; only windows that pass are shuffled.
    """
    items = written(_hits(benchmark.where("item_id is not null"), "item_id").dropDuplicates(["item_id", "window", "place"]), "items")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(items))
    short = sorted(r["words"] for r in items.where(F.col("words") < WINDOW).select("words").distinct().collect())
    ours = _hits(docs.where("doc_id is not null"), "doc_id", bits, short)
    of = [F.countDistinct(F.when(F.col("form") == f, F.col("place"))).alias(f"of{f}") for f in range(FORMS - 1)]
    whole = items.groupBy("item_id").agg(F.countDistinct("place").alias("of"), *of)
    theirs = items.select("item_id", F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"))
    met = ours.join(theirs, "window").where(F.size("slots") == F.size("item_slots")).groupBy("doc_id", "item_id", "place", "item_place")
    met = written(met.agg(F.collect_set("form").alias("forms"), F.max(F.struct(F.size("slots").alias("n"), "slots", "item_slots")).alias("s")).withColumn("off", F.col("place") - F.col("item_place")), "met")
    offs = met.select("doc_id", "item_id", "off").distinct()
    own = Window.partitionBy("doc_id", "item_id").orderBy("off")
    starts = offs.withColumn("new", F.when(F.col("off") - F.lag("off").over(own) <= DRIFT, F.lit(None)).otherwise(F.col("off"))).withColumn("near", F.last("new", True).over(own)).drop("new")
    views = F.array(F.struct(F.lit(0).alias("view"), F.lit(0).cast("long").alias("at")), F.struct(F.lit(1).alias("view"), F.col("near").alias("at")), F.struct(F.lit(2).alias("view"), F.col("off").alias("at")))
    met = met.join(starts, ["doc_id", "item_id", "off"]).withColumn("o", F.explode(views)).select("doc_id", "item_id", F.col("o.view").alias("view"), F.col("o.at").alias("at"), "item_place", "forms", "s.slots", "s.item_slots")
    met = written(met, "occurrences")
    one = ["doc_id", "item_id", "view", "at"]
    by = [F.countDistinct(F.when(F.array_contains("forms", f), F.col("item_place"))).alias(f"has{f}") for f in range(FORMS - 1)]
    places = met.groupBy(*one).agg(F.array_sort(F.collect_set("item_place")).alias("places"), *by)
    step = lambda acc, p: F.struct(p.alias("last"), F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.greatest(acc["most"], F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("most"))
    zero = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most"))
    share = F.greatest(F.size("places") / F.col("of"), *[F.when(F.col(f"of{f}") > 0, F.col(f"has{f}") / F.col(f"of{f}")) for f in range(FORMS - 1)])
    found = places.join(whole, "item_id").select(*one, F.size("places").cast("long").alias("windows"), share.alias("coverage"), F.aggregate("places", zero, step)["most"].alias("run"))
    found = found.where((F.col("coverage") >= coverage) | (F.col("run") + (WINDOW - 1) >= run_words))
    pairs = met.where(F.size("slots") > 0).select(*one, F.explode(F.arrays_zip("slots", "item_slots")).alias("s")).groupBy(*one, "s.item_slots", "s.slots").count()
    agree = pairs.groupBy(*one, "item_slots").agg(F.max("count").alias("best"), F.sum("count").alias("all")).groupBy(*one).agg((F.sum("best") / F.sum("all")).alias("consistency"))
    found = found.join(agree, one, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= consistency)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "windows", "consistency")).alias("best"))
    return best.select("doc_id", "item_id", "best.windows", "best.coverage", "best.consistency")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id holds no item; a null doc_id stays."""
    leaked = written(leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct(), "leaked")
    return docs.join(leaked, docs["doc_id"] == leaked["leaked_id"], "left_anti")

"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .repeats import numbered
from .store import written

#: Ranges of the Pareto rank by which running counts are made, so that no source's rows meet in one task.
RANGES = 4096
#: Sizes up to EXACT are classes of their own; above, OCTAVE classes lie between a size and its double.
EXACT, OCTAVE = 16, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _unit(seed: int, *parts: Column) -> Column:
    """A number between 0 and 1, both excluded, that seed and parts decide."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _size_class(size: Column) -> Column:
    return F.when(size < EXACT, size).otherwise(F.floor(OCTAVE * F.log2(size.cast("double")))).cast("int")


def _rank(u: Column, size: Column, drawn: Column, docs: Column, mean: Column) -> Column:
    """Random odds divided by inclusion odds.

    Within a class the inclusion probability of a document rises with its size about the share drawn / docs; it lies
    between 0 and 1, and the probabilities of a class sum to drawn. Null where nothing is drawn or there are no words.
    """
    share = drawn / docs
    p = F.nullif(share + share * (1 - share) * (size / F.nullif(mean, F.lit(0.0)) - 1), F.lit(0.0))
    return (u / (1 - u)) * ((1 - p) / p)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target from source, size: the k-th source by code point (null last) weighs weights[k % len].

    Together they get share of all sizes by weight; a target stops at most times its source's size and the excess is
    shared again. Works on one row per source: a source is full if what it would get is its limit or more, and sources
    fill up in the order of limit by weight, so one running sum over that order finds the level of the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("limit", most * F.col("source_size"))
    order = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    after, before = order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("k", F.row_number().over(order))
    level = F.min(F.when(F.col("limit") / F.col("w") >= F.col("level"), F.struct("k", "level"))).over(every)["level"]
    per = per.withColumn("target", F.least("limit", F.coalesce(level, F.col("level")) * F.col("w")))
    return per.select("source", "source_size", "target")


def class_draws(plan: DataFrame, sized: DataFrame, seed: int) -> DataFrame:
    """source, source_size, target, copies, class, docs, mean and drawn: how many documents of each class of sizes get one more copy.

    Classes are walked from the largest sizes down. Each is to give the share of its words that the words still needed
    are of all words still to come; the count is that share of its documents, rounded up or down at random so that it
    is right on average, within what the smaller classes can make up for. A source has a few hundred classes at most.
    """
    classes = sized.groupBy("source", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    toss = _unit(seed, F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"), F.col("class").cast("string"))
    classes = classes.select("source", F.struct("class", "docs", F.col("words").cast("double").alias("words"), toss.alias("toss")).alias("c"))
    own = classes.groupBy("source").agg(F.sort_array(F.collect_list("c"), asc=False).alias("classes"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("copies", F.floor(ratio)).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    own = own.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))

    def step(acc: Column, c: Column) -> Column:
        mean, after = c["words"] / c["docs"], acc["rest"] - c["words"]
        some = F.nullif(mean, F.lit(0.0))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), acc["need"] / F.nullif(acc["rest"], F.lit(0.0))))
        low, high = F.ceil((acc["need"] - after) / some - 1e-9), F.floor(acc["need"] / some + 1e-9)
        nearest = F.when(low * mean - acc["need"] < acc["need"] - high * mean - after, low).otherwise(high)
        drawn = F.when(low > high, nearest).otherwise(F.greatest(low, F.least(high, F.floor(share * c["docs"] + c["toss"]))))
        drawn = F.when(mean > 0, F.greatest(F.lit(0), F.least(c["docs"], drawn))).otherwise(0).cast("long")
        given = lambda n: F.struct((acc["need"] - n * mean).alias("need"), after.alias("rest"), F.concat(acc["out"], F.array(F.struct(c["class"].alias("class"), c["docs"].alias("docs"), mean.alias("mean"), n.alias("drawn")))).alias("out"))
        return F.get(F.transform(F.array(drawn), given), F.lit(0))

    none = F.expr("cast(array() as array<struct<class:int,docs:bigint,mean:double,drawn:bigint>>)")
    start = F.struct(F.col("need").alias("need"), F.col("source_size").cast("double").alias("rest"), none.alias("out"))
    drawn = F.aggregate("classes", start, step, lambda acc: acc["out"])
    return own.select("source", "source_size", "target", "copies", F.inline(drawn))


def mix_plan(sized: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """What class_draws returns, with the range of the Pareto rank and the rank up to which documents of the class are drawn.

    sized has source, size, u and class. Documents are counted by range of their rank; only those in the one range of
    a class where the count is reached are put in order.
    """
    draws = written(class_draws(source_targets(sized, weights, share, most), sized, seed), "draws")
    some = draws.where("drawn > 0 and drawn < docs").select(F.col("source").alias("s"), F.col("class").alias("c"), "docs", "mean", "drawn")
    ranked = sized.join(some, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    ranked = ranked.select("source", "class", "drawn", _rank(F.col("u"), F.col("size"), F.col("drawn"), F.col("docs"), F.col("mean")).alias("rank")).withColumn("range", _range("rank"))
    counts = ranked.groupBy("source", "class", "range").agg(F.count("*").alias("own"), F.first("drawn").alias("drawn"))
    counts = counts.withColumn("upto", F.sum("own").over(W.partitionBy("source", "class").orderBy("range")))
    cut = counts.where("upto >= drawn").groupBy("source", "class").agg(F.min(F.struct("range", (F.col("upto") - F.col("own")).alias("before"))).alias("cut"))
    cut = cut.select(F.col("source").alias("s"), F.col("class").alias("c"), "cut.*").withColumnRenamed("range", "cut_range")
    same = lambda left: F.col(f"{left}.source").eqNullSafe(F.col("cut.s")) & (F.col(f"{left}.class") == F.col("cut.c"))
    last = ranked.alias("ranked").join(cut.alias("cut"), same("ranked") & (F.col("range") == F.col("cut_range")))
    place = F.count("*").over(W.partitionBy("source", "class").orderBy("rank")) + F.col("before")  # equal ranks share a place
    last = last.withColumn("place", place).where("place <= drawn").groupBy("source", "class").agg(F.max("rank").alias("cut_rank"))
    last = last.select(F.col("source").alias("s2"), F.col("class").alias("c2"), "cut_rank")
    plan = draws.alias("draws").join(cut.alias("cut"), same("draws"), "left")
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")), "left")
    return written(plan.select("source", "source_size", "target", "copies", "class", "docs", "mean", "drawn", "cut_range", "cut_rank"), "plan")


def _range(rank: str) -> Column:
    return F.floor(RANGES * F.col(rank) / (F.col(rank) + 1)).cast("long")


def _sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, class, mark, key and more of each row; equal rows share key, and mark stands for a null doc_id."""
    size = word_count(F.col("text"))
    mark = F.when(F.col("doc_id").isNull(), F.coalesce(F.md5("text"), F.lit("")))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), mark, F.lit("/"), F.col("source"), F.lit("/"), F.col("text"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), _size_class(size).alias("class"), mark.alias("mark"), key.alias("key"), *more)


def _with_units(rows: DataFrame, seed: int) -> DataFrame:
    """rows (what _sizes returns, with copy) with u, a number that seed, doc_id (where null the text) and copy decide."""
    u = _unit(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("mark")), F.when(F.col("copy") > 0, F.col("copy").cast("string")))
    return rows.withColumn("u", u).drop("mark", "copy")


def sized_documents(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, class, key and u of each row, as a table; rows that are equal have random numbers of their own."""
    return _with_units(numbered(_sizes(docs), "sized"), seed)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(decisions, plan). decisions: doc_id, size, source_size, target and taken for each row of docs (doc_id, text, source).

    taken is size times the copies that the mix takes: floor(target / source_size) whole copies of every document, and
    one more of those chosen by Pareto order sampling: each class of sizes of a source has a fixed number to draw, each
    document an inclusion probability, and documents with the least random odds over inclusion odds are drawn. The random
    number depends on seed, doc_id and, among equal rows, a count alone, so reruns agree: of equal rows, as many are
    drawn each time. Null source is a source of its own; null or empty text has size 0 and is taken with 0 words. An
    empty table gives an empty result. Sources meet only in sums: rows are joined with a few hundred rows per source,
    which Spark sends to all tasks only while they are small.
    """
    sized = sized_documents(docs, seed)
    plan = mix_plan(sized, weights, share, most, seed)
    return _decided(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")), plan


def _decided(sized: DataFrame, plan: DataFrame) -> DataFrame:
    own = plan.withColumnsRenamed({"source": "plan_source", "class": "plan_class"})
    joined = sized.join(own, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("class") == F.col("plan_class")))
    joined = joined.withColumn("rank", _rank(F.col("u"), F.col("size"), F.col("drawn"), F.col("docs"), F.col("mean")))
    reached = (_range("rank") < F.col("cut_range")) | ((_range("rank") == F.col("cut_range")) & (F.col("rank") <= F.col("cut_rank")))
    more = F.when(F.col("drawn") == 0, False).when(F.col("drawn") == F.col("docs"), True).otherwise(F.coalesce(reached, F.lit(False)))
    return joined.withColumn("times", F.col("copies") + more.cast("long"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns, whatever their names.

    Rows that occur once decide where they are read: their texts move in no shuffle while the keys of repeated rows are
    few enough for Spark to send them to all tasks. Repeated rows are written with their numbers and decided one by one.
    """
    sized = sized_documents(docs, seed)
    plan = mix_plan(sized, weights, share, most, seed)
    again = written(sized.groupBy("key").count().where("count > 1").select("key"), "repeated")
    rows = _sizes(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    once = rows.join(again, "key", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    repeated = numbered(rows.join(again, "key", "left_semi"), "copies")
    decided = _decided(_with_units(once.unionByName(repeated), seed), plan)
    return decided.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy")).select("doc.*")

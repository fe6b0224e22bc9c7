"""Dictionaries of names: a short list in the plan, a table of up to millions that goes to every executor, or a table of any size that meets the words of the texts in a join."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import materialized, parallel
from .text import let

#: Kinds of names; where a token has several, the least counts.
FIRST, AMBIGUOUS, LAST = 1, 2, 3
KINDS = {"first": FIRST, "ambiguous": AMBIGUOUS, "last": LAST}
#: Hidden column with the index of a dictionary that is a table, or with a row's own part of it.
COLUMN = "__names"
#: Words in more rows than this are looked up by a broadcast, so that no task gets all rows of one word; they are at most the words of all rows divided by this.
COMMON = 1 << 14
#: Parts of the dictionary up to this length are searched one by one, longer ones by halving.
_SHORT = 16
Kind = Callable[[Column], Column]


class Names:
    """A dictionary of names. kind (1 first, 2 first name that is a common word too, 3 last, null unknown) of a token in small letters is what `bound` hands to an expression.

    `Names.listed` puts the words into the plan: for some dozens. `Names.table` takes a DataFrame (token, kind: first,
    ambiguous or last). Its 64-bit hashes, the kind in their two last bits, stand in an array of short arrays by bucket:
    8 bytes for each name, one row, made by Spark and sent once to each executor as the result of a scalar subquery.
    A plan is as long for ten names as for a million, and a token costs one hash and one bucket. Two tokens of one
    hash would count as one. A dictionary of more than at_most tokens is refused, since its index goes to every executor.
    `Names.joined` takes such a DataFrame of any size: `on` joins it with the words of the rows, and each row gets the
    entries of its own words alone.
    """

    def __init__(self, kind: Kind | None, index: DataFrame | None = None, buckets: int = 1, known: DataFrame | None = None):
        self._kind, self.index, self.buckets, self._rows = kind, index, buckets, known

    @classmethod
    def listed(cls, first: Iterable[str], last: Iterable[str], ambiguous: Iterable[str] = ()) -> Names:
        vague = set(ambiguous)
        sure, unsure = [w for w in first if w not in vague], [w for w in first if w in vague]
        family = [w for w in last if w not in set(first)]
        return cls(lambda low: F.when(low.isin(sure), FIRST).when(low.isin(unsure), AMBIGUOUS).when(low.isin(family), LAST))

    @classmethod
    def table(cls, names: DataFrame, buckets: int = 1 << 15, at_most: int = 4_000_000) -> Names:
        coded = cls._coded(names).select(cls._key(F.xxhash64("token")).bitwiseOR(F.col("code")).alias("entry"), cls._bucket(F.xxhash64("token"), buckets).alias("bucket"))
        filled = coded.groupBy("bucket").agg(F.collect_list("entry").alias("entries"))
        every = names.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(filled, "bucket", "left")
        none = F.array().cast("array<bigint>")
        row = every.agg(F.sum(F.coalesce(F.size("entries"), F.lit(0))).alias("n"), F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("entries", none).alias("entries")))).alias("b"))
        checked = F.when(F.col("n") > at_most, F.raise_error(F.lit(f"the dictionary has more than {at_most} names")).cast("array<array<bigint>>")).otherwise(F.transform("b", lambda x: x["entries"]))
        return cls(None, row.select(checked.alias("index")), buckets)

    @classmethod
    def joined(cls, names: DataFrame) -> Names:
        return cls(None, known=cls._coded(names))

    @staticmethod
    def _coded(names: DataFrame) -> DataFrame:
        """token in small letters, and the least code of its kinds."""
        kind = F.lit(None).cast("int")
        for name, code in KINDS.items():
            kind = F.when(F.col("kind") == name, code).otherwise(kind)
        return names.select(F.lower(F.trim("token")).alias("token"), kind.alias("code")).where("token != '' and code is not null").groupBy("token").agg(F.min("code").alias("code"))

    @staticmethod
    def _key(hash_: Column) -> Column:
        return hash_.bitwiseAND(F.lit(-4).cast("long"))

    @staticmethod
    def _bucket(hash_: Column, buckets: int) -> Column:
        return F.pmod(F.shiftrightunsigned(hash_, 2), F.lit(buckets)).cast("int")

    def on(self, df: DataFrame, words: Column | None = None) -> DataFrame:
        """df as expressions with this dictionary need it; drop(COLUMN) takes the hidden column away. words: an array of the words, in small letters, that they look up; only a joined dictionary needs it.

        Use each such expression as a column of its own, in select or withColumn: there the optimizer puts the subquery in
        the hidden column's place. Within explode, a filter or an aggregate, or if several columns of one select use it, the
        index would be copied into each row.
        """
        if self._rows is not None:
            if words is None:
                raise ValueError("a joined dictionary needs the words that are looked up")
            return self._met(df, words)
        return df if self.index is None else df.withColumn(COLUMN, self.index.scalar())

    def _met(self, df: DataFrame, words: Column) -> DataFrame:
        """df, written once with a number for each row, and the sorted entries of each row's words: distinct words meet the dictionary, then their rows; common ones by a broadcast, the others by a shuffle."""
        rows = materialized(df.withColumn("__row", F.monotonically_increasing_id()))
        each = rows.select("__row", F.explode(F.array_distinct(words)).alias("token"))
        coded = materialized(each.groupBy("token").agg(F.count("*").alias("n")).join(self._rows, "token", "left").where(F.col("code").isNotNull() | (F.col("n") > COMMON)))
        common, rare = coded.where(F.col("n") > COMMON).select("token", "code"), coded.where((F.col("n") <= COMMON) & F.col("code").isNotNull()).select("token", "code")
        often = each.join(F.broadcast(common), "token").where("code is not null")
        seldom = each.join(F.broadcast(common.select("token")), "token", "left_anti").join(rare, "token")
        entry = self._key(F.xxhash64("token")).bitwiseOR(F.col("code"))
        n = parallel(df.sparkSession)  # so many tasks whatever their size: what is done with a row takes longer than moving it
        found = often.unionByName(seldom).repartition(n, "__row").groupBy("__row").agg(F.array_sort(F.collect_list(entry)).alias(COLUMN))
        return rows.repartition(n, "__row").join(found, "__row", "left").withColumn(COLUMN, F.coalesce(COLUMN, F.array().cast("array<bigint>"))).drop("__row")

    def _own(self, index: Column) -> Kind:
        """kind by a row's sorted entries."""

        def halved(key: Column) -> Column:
            """The first entry that is not below key."""

            def half(acc: Column, _: Column) -> Column:
                middle = ((acc["low"] + acc["high"]) / 2).cast("int")
                open_ = acc["low"] < acc["high"]
                right = open_ & F.coalesce(F.get(index, middle) < key, F.lit(False))
                return F.struct(F.when(right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(acc["high"]).alias("high"))

            zero = F.struct(F.lit(0).alias("low"), F.size(index).alias("high"))
            at = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(index) + 1.0)).cast("int")), zero, half, lambda acc: acc["low"])
            return let(F.get(index, at), lambda entry: F.when(self._key(entry) == key, entry))

        one = lambda key: F.when(F.size(index) <= _SHORT, F.get(F.filter(index, lambda entry: self._key(entry) == key), F.lit(0))).otherwise(halved(key))
        return lambda low: let(self._key(F.xxhash64(low)), one).bitwiseAND(F.lit(3).cast("long")).cast("int")

    def bound(self, use: Callable[[Kind], Column]) -> Column:
        """use(kind), with the index named once in the whole expression, so that the optimizer leaves the subquery where it is used and copies it into no row."""
        if self._rows is not None:
            return let(F.col(COLUMN), lambda index: use(self._own(index)))
        if self.index is None:
            return use(self._kind)

        def kind(index: Column) -> Kind:
            def of(low: Column) -> Column:
                same = lambda h: F.filter(F.get(index, self._bucket(h, self.buckets)), lambda entry: self._key(entry) == self._key(h))
                return let(F.xxhash64(low), lambda h: F.get(same(h), F.lit(0)).bitwiseAND(F.lit(3).cast("long")).cast("int"))

            return of

        return let(F.col(COLUMN), lambda index: use(kind(index)))

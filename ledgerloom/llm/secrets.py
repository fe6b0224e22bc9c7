"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import let
from ledgerloom.operators.privacy import spans_of

from .sampling import hash_sample

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{24,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
#: What the models judge: runs of SHORTEST key characters or more, bounded by other characters, no part of a base span; those are filled with MASK.
SHORTEST, MASK = 16, "\0"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=\x00-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+(?!\x00)"
#: States of the models: a letter in either case, a digit, or S for the rest; a run begins after ^.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points: array of (start, end, match)."""
    return F.transform(spans_of(text, pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("match")))


def _masked(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """text with its (valid) matches filled with MASK, of the same length."""
    fill = lambda m: F.repeat(F.lit(MASK), F.length(m))
    filled = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(valid(m), fill(m)).otherwise(m) if valid else fill(m))
    pieces = F.zip_with(F.split(text, pattern, -1), filled, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def without_base_spans(text: Column) -> Column:
    """text with all base spans filled with MASK: what overlaps one that is filled already stands beside MASK then."""
    plain = F.translate(text, MASK, " ")
    return let(_masked(plain, ASSIGN, _is_assign), lambda t: let(_masked(t, LONG_HEX), lambda t: _masked(t, LONG_ACCESS)))


def _is_assign(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of each base pattern, those that fail its length dropped after matching."""
    assign = F.filter(_found(text, ASSIGN), lambda s: _is_assign(s["match"]))
    access = F.filter(_found(text, ACCESS), lambda s: s["end"] - s["start"] >= 20)
    return {"assign": _kind(assign, "assign"), "access": _kind(access, "access"), "hex": _kind(_found(text, LONG_HEX), "hex")}


def _pairs(token: Column) -> Column:
    """The pairs of neighbouring states of a string, from its beginning."""
    states = F.split(F.concat(F.lit("^"), F.regexp_replace(F.lower(token), "[^a-z0-9]", "S")), "", -1)
    states = F.filter(states, lambda c: c != "")
    n = F.size(states) - 1
    return F.zip_with(F.slice(states, F.lit(1), n), F.slice(states, F.lit(2), n), lambda a, b: F.concat(a, b))


def fit_ratios(docs: DataFrame, max_docs: int = 2000, n_random: int = 4000) -> dict[str, float]:
    """For each pair of neighbouring characters, the log of its odds in random strings against ordinary identifiers.

    Labelled samples: identifiers are distinct words of 4 to 40 key characters from at most max_docs
    documents chosen by hash, those with a base match left out, alone, joined in pairs and numbered; random strings are base matches of the same documents
    (values only) and n_random digests in hex and base-64. Only the counts, one row per pair of 38 states and
    label, reach the driver.
    """
    spark = docs.sparkSession
    sample = hash_sample(docs.where("text is not null").select(F.col("doc_id").cast("long"), "text"), "doc_id", max_docs)
    words = sample.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{4,40}"), F.lit(0))).alias("token"))
    words = words.where(~F.col("token").rlike(f"{LONG_HEX}|{ACCESS}|[0-9]{{6,}}"))
    joined = words.groupBy("token").count()  # each word once: common ones would drown the others
    forms = [F.col("token"), F.concat_ws("_", "token", "token"), F.concat_ws("-", "token", "token"), F.concat_ws("/", "token", "token"), F.concat("token", F.lit("_"), F.length("token").cast("string"))]
    identifiers = joined.select(F.lit("identifier").alias("label"), F.explode(F.array(*forms)).alias("token"))
    values = sample.select(F.explode(F.transform(_found(F.col("text"), ASSIGN), lambda s: F.regexp_extract(s["match"], ASSIGN, 2))).alias("token")).where("length(token) >= 20")
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    drawn = spark.range(n_random).select(F.explode(F.array(F.substring(F.lower(F.hex(digest)), 1, 40), F.substring(F.base64(digest), 1, 40))).alias("token"))
    random = values.unionByName(drawn).select(F.lit("random").alias("label"), "token")
    pairs = identifiers.unionByName(random).select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}
    states = ALPHABET + "S"
    ratios = {}
    for a in "^" + states:
        total = {k: sum(counts.get((k, a + b), 0) for b in states) for k in ("random", "identifier")}
        for b in states:
            p = {k: (counts.get((k, a + b), 0) + 0.5) / (n + 0.5 * len(states)) for k, n in total.items()}
            ratios[a + b] = math.log(p["random"] / p["identifier"])
    return ratios


def markov_spans(text: Column, ratios: dict[str, float], least: float = 0.5) -> Column:
    """Runs of key characters apart from base spans whose mean log-likelihood ratio is least or more; digits alone are numbers."""
    table = F.create_map(*[F.lit(x) for k, v in ratios.items() for x in (k, v)])

    def judged(s: Column) -> Column:
        return let(_pairs(s["match"]), lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.coalesce(table[p], F.lit(0.0))) / F.size(pairs))

    spans = let(without_base_spans(text), lambda t: _found(t, CANDIDATE))
    return F.filter(spans, lambda s: s["match"].rlike("[A-Za-z]") & (judged(s) >= least))


def _digest(spans: Column) -> Column:
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, ratios: dict[str, float], least: float = 0.5) -> DataFrame:
    """doc_id and the array spans (start, end, kind, match) of each row of docs (doc_id, text), over whole texts.

    kind is assign, access or hex for the base patterns and markov for runs that only the models find: a run that
    touches a base span adds nothing, nor do runs shorter than SHORTEST or without a letter. Places are code points,
    ends exclusive. Null and empty texts have no spans; repeated rows come out as often as they go in. Each row is
    judged on its own, in time that grows with its length: no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    rows = docs.select(F.col("doc_id").cast("long"), F.concat(*base.values()).alias("base"), _kind(markov_spans(text, ratios, least), "markov").alias("more"))
    return rows.select("doc_id", "base", F.concat("base", "more").alias("spans"))


def secret_digests(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, the SHA-256 of their list, and the list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))

"""Finding personal data in columns and text, and deterministic stand-ins that keep joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.names import AMBIGUOUS, COLUMN, FIRST, LAST, Kind, Names

# Words in column names per type, in order of precedence, and names that only look like them.
COLUMN_WORDS = [
    ("FNR", "fodselsnummer foedselsnummer fodselsnr foedselsnr personnummer personnr fnr pnr pnummer fnummer ssn fnumber fodselnr"),
    ("EMAIL", "epostadresse epost email emailaddress mail epostadr"),
    ("POSTNR", "postnummer postnr postalcode postcode postkode zipcode zip poststednr"),
    ("CITY", "bosted city kommune sted stad place ort by"),
    ("ADDRESS", "gateadresse bostedsadresse postadresse adresse address gatenavn veinavn vegnavn veiadresse streetaddress gate vei veg"),
    ("FIRST_NAME", "fornavn firstname givenname forename"),
    ("LAST_NAME", "etternavn slektsnavn lastname surname familyname"),
    ("FULL_NAME", "fulltnavn fullname kontaktperson avsender mottaker navn name innbygger person"),
    ("FREE_TEXT", "fritekst kommentar merknad merknader beskrivelse notat notater memo innhold sakstekst brevtekst meldingstekst remarks description comments saksbeskrivelse"),
]
EXACT_WORDS = "vei veg gate by ort stad place street".split()
FALSE_FRIENDS = (
    "brukernavn username filnavn filename tabellnavn feltnavn kolonnenavn systemnavn schemanavn databasenavn arkivnavn domenenavn hostname servernavn fila dokumentnavn objektnavn "
    "fylkenavn kommunenavn landnavn fagnavn skjemanavn rapportnavn gruppenavn klassenavn romnavn skolenavn bedriftsnavn firmanavn produktnavn prosjektnavn menynavn kategorinavn "
    "typenavn statusnavn listenavn malnavn tjenestenavn modulnavn knappenavn"
).split()
EXCLUDED = "poststed poststad postalplace postplace".split()
NAME_TYPES = ("CITY", "ADDRESS", "FIRST_NAME", "LAST_NAME", "FULL_NAME")
STRONG_NAME = "fornavn etternavn slektsnavn mellomnavn fulltnavn firstname lastname surname givenname familyname forename".split()
#: Names that the dictionary knows: first and last names, in small letters. A list of another country can be given.
KNOWN_FIRST = ("kari", "ola", "liv", "anne", "per", "nina", "jan", "lars", "hans", "ingrid", "eva", "john", "mary", "anna", "peter")
KNOWN_LAST = ("hansen", "berg", "solberg", "moen", "dahl", "lund", "strand", "olsen", "larsen", "johansen")
AMBIGUOUS_FIRST = ("per", "liv", "dag", "bo")
#: The dictionary of these lists; Names.table takes one of any size.
KNOWN = Names.listed(KNOWN_FIRST, KNOWN_LAST, AMBIGUOUS_FIRST)
VALUE_TYPES = ("FNR", "FIRST_NAME", "LAST_NAME", "FULL_NAME", "ADDRESS", "POSTNR", "CITY", "EMAIL")


def tail_samples(cells: DataFrame, rows: int = 500, values: int = 50) -> DataFrame:
    """Of each column, the first values non-blank cells among its table's last rows."""
    last = cells.groupBy("table_key").agg(F.max("row_pos").alias("last_pos"))
    tail = cells.join(last, "table_key").where((F.col("row_pos") > F.col("last_pos") - rows) & (F.trim("value") != ""))
    at = F.row_number().over(W.partitionBy("table_key", "col_name").orderBy("row_pos"))
    return tail.withColumn("at", at).where(F.col("at") <= values).select("table_key", "col_name", "row_pos", "value")


def _known(kind: Kind) -> Callable[[Column], Column]:
    return lambda low: kind(low).isNotNull()


def column_profile(sample: DataFrame, names: Names = KNOWN) -> DataFrame:
    """Shares of each column's non-blank values that look like files, numbers, identity numbers, postcodes, mail, names; and lengths."""
    v = F.col("value")
    looks = names.bound(lambda kind: F.struct(T.name_shape(v, _known(kind)).alias("shaped"), T.known_name(v, _known(kind)).alias("known")))
    sample = names.on(sample.select("table_key", "col_name", "value"), T.name_words(v)).select("table_key", "col_name", "value", looks.alias("looks"))
    share = lambda p, name: F.round(F.avg(p.cast("int")), 6).alias(name)
    return sample.where(F.trim("value") != "").groupBy("table_key", "col_name").agg(
        F.count("*").alias("n"), share(T.looks_like_file(v), "files"), share(F.trim("value").rlike("^[0-9]+$"), "numbers"), share(F.length(T.digits(v)) == 11, "eleven"),
        share(F.trim("value").rlike("^[0-9]{4}$"), "four"), share(T.id_number_valid(v), "ids"), share(T.email_valid(v), "mails"), share(T.embedded_pii(v), "embedded"),
        share(F.col("looks.shaped"), "shaped"), share(F.col("looks.known"), "known"), F.round(F.avg(F.length(v)), 6).alias("avg_len"), F.max(F.length(v)).alias("max_len"),
    )


def _has(key: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.when(w.isin(*EXACT_WORDS), key == w).otherwise(key.contains(w)))


def column_type(name: Column) -> Column:
    """Type that a column's name suggests, by the first group of words that matches; null without."""
    key = T.column_key(name)
    out = F.lit(None).cast("string")
    for kind, words in reversed(COLUMN_WORDS):
        out = F.when(_has(key, words.split()), kind).otherwise(out)
    return F.when(~F.exists(F.array(*[F.lit(w) for w in FALSE_FRIENDS]), lambda w: key.contains(w)), out)


def classify_columns(profile: DataFrame) -> DataFrame:
    """table_key, col_name, pii_type, source. Name before values before length; a failed guard ends the name stage; ambiguous name columns need name-like values."""
    key, named = T.column_key(F.col("col_name")), column_type(F.col("col_name"))
    excluded = F.exists(F.array(*[F.lit(w) for w in EXCLUDED]), lambda w: key.contains(w))
    guarded = (named.isin(*NAME_TYPES) & (F.col("numbers") >= 0.7)) | ((named == "FNR") & (F.col("eleven") < 0.5)) | ((named == "POSTNR") & (F.col("four") < 0.5))
    vague = named.isin("FIRST_NAME", "LAST_NAME", "FULL_NAME") & ~F.exists(F.array(*[F.lit(w) for w in STRONG_NAME]), lambda w: key.contains(w))
    no_names = vague & ~((F.col("shaped") >= 0.6) & (F.col("known") >= 0.25))
    by_name = named.isNotNull() & ~F.coalesce(guarded, F.lit(False))
    pair = lambda kind, source: F.struct(kind.alias("pii_type"), F.lit(source).alias("source"))
    out = (
        F.when(excluded, pair(F.lit("OTHER"), "excluded"))
        .when(F.col("files") >= 0.5, pair(F.lit("OTHER"), "filename"))
        .when(by_name & no_names, pair(F.lit("OTHER"), "content"))
        .when(by_name, pair(named, "name"))
        .when(F.col("ids") >= 0.6, pair(F.lit("FNR"), "value"))
        .when(F.col("mails") >= 0.6, pair(F.lit("EMAIL"), "value"))
        .when(F.col("embedded") >= 0.3, pair(F.lit("FREE_TEXT"), "value"))
        .when((F.col("avg_len") > 40) | (F.col("max_len") > 120), pair(F.lit("FREE_TEXT"), "value"))
        .otherwise(pair(F.lit("OTHER"), "none"))
    )
    return profile.withColumn("c", out).select("table_key", "col_name", "c.pii_type", "c.source")


def may_replace(kind: str, v: Column, names: Names = KNOWN) -> Column:
    """Last guard before a value is replaced: blank cells, file names and values that lack the type's form stay."""
    form = {"FNR": F.length(T.digits(v)) == 11, "POSTNR": F.trim(v).rlike("^[0-9]{4}$"), "EMAIL": T.email_valid(v), "CITY": v.rlike(r"\p{L}"), "ADDRESS": v.rlike(r"\p{L}")}
    fits = form[kind] if kind in form else names.bound(lambda of: T.name_shape(v, _known(of)))
    return F.coalesce((F.trim(v) != "") & ~T.looks_like_file(v) & fits, F.lit(False))


def stand_in(kind: str, v: Column, names: Names = KNOWN) -> Column:
    """The replacement of a value of a type, or the value itself where the guard says no."""
    fake = T.let(F.trim(v), T.FAKES[kind])
    fake = T.let(fake, lambda f: T.like_case(v, f)) if kind.endswith("NAME") else fake
    return F.when(may_replace(kind, v, names), fake).otherwise(v)


def value_words(types: Mapping[str, str]) -> Column:
    """What a dictionary is asked about the columns of types (column: type) that are rewritten."""
    columns = [F.coalesce(T.name_words(F.col(c)), F.array().cast("array<string>")) for c, k in types.items() if k in VALUE_TYPES]
    return F.concat(*columns) if columns else F.array().cast("array<string>")


def _replaced(df: DataFrame, types: Mapping[str, str], names: Names) -> Column:
    """array of (col_name, type, original, fake), one for each column of types (column: type) that is rewritten: all columns in one expression, so that the table is read once."""
    kinds = {c: k for c, k in types.items() if k in VALUE_TYPES}

    def cells(kind: Kind) -> Column:
        bound = Names(kind)
        return F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(k).alias("type"), F.col(c).alias("original"), stand_in(k, F.col(c), bound).alias("fake")) for c, k in kinds.items()])

    return names.bound(cells) if kinds else F.array().cast("array<struct<col_name:string,type:string,original:string,fake:string>>")


def pseudonymize(df: DataFrame, types: Mapping[str, str], max_len: Mapping[str, int] | None = None, names: Names = KNOWN) -> DataFrame:
    """df with the columns of types (column: type) replaced, each by an expression without state, cut to its declared length."""
    limits = max_len or {}
    columns = [c for c, k in types.items() if k in VALUE_TYPES]
    out = names.on(df, value_words(types)).withColumn("__cells", _replaced(df, types, names)).drop(COLUMN)
    new = {c: T.cap_length(F.get("__cells", F.lit(at))["fake"], F.lit(limits.get(c))) for at, c in enumerate(columns)}
    return out.withColumns(new).drop("__cells")


def changed_cells(df: DataFrame, types: Mapping[str, str], names: Names = KNOWN) -> DataFrame:
    """df with its changes: an array of (col_name, type, original, fake), one for each cell whose value a replacement changes."""
    return names.on(df, value_words(types)).withColumn("changes", F.filter(_replaced(df, types, names), lambda c: c["original"] != c["fake"])).drop(COLUMN)


def mapping_ledger(df: DataFrame, types: Mapping[str, str], names: Names = KNOWN) -> DataFrame:
    """type, original, fake and how many cells each replacement changed; one scan for all columns."""
    changes = changed_cells(df, types, names).select(F.inline("changes"))
    return changes.groupBy("type", "original", "fake").agg(F.count("*").alias("cells"))


def mapping_consistency(ledger: DataFrame) -> DataFrame:
    """Originals of a type, in any case, that have more than one fake, in any case: there should be none."""
    return ledger.groupBy("type", F.lower("original").alias("original")).agg(F.countDistinct(F.lower("fake")).alias("fakes")).groupBy("type").agg(F.count("*").alias("originals"), F.count_if(F.col("fakes") > 1).alias("inconsistent"))


def preview(df: DataFrame, types: Mapping[str, str], k: int = 5, width: int = 80, names: Names = KNOWN) -> DataFrame:
    """Up to k pairs before and after of each column, by row_pos, cut to width.

    One scan for all columns: within each task a column's least k positions are kept, before anything is shuffled; only
    their rows are replaced.
    """
    cells = df.select("row_pos", *[F.col(c).cast("string").alias(c) for c in types]).unpivot(["row_pos"], list(types), "col_name", "before").where(F.trim("before") != "")
    first = cells.withColumn("at", F.row_number().over(W.partitionBy("col_name").orderBy("row_pos"))).where(F.col("at") <= k)
    kind = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    after = names.bound(lambda of: F.coalesce(*[F.when(F.element_at(kind, F.col("col_name")) == t, stand_in(t, F.col("before"), Names(of))) for t in dict.fromkeys(types.values()) if t in VALUE_TYPES], F.col("before")))
    out = names.on(first, T.name_words(F.col("before"))).select("col_name", "row_pos", F.substring("before", 1, width).alias("before"), F.substring(after, 1, width).alias("after"))
    return out


def dict_tokens(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Words of cells that a dictionary (token, kind) knows, with counts."""
    words = cells.select("col_name", F.explode(F.split(F.lower("value"), r"[^a-zæøå]+")).alias("token")).where("token != ''")
    return words.join(names, "token").groupBy("col_name", "token", "kind").agg(F.count("*").alias("n"))


#: A word: letters, joined by up to twenty single apostrophes and hyphens. Words and what stands between them make up a text.
_WORD = r"\p{L}+(?:['-]\p{L}+){0,20}"
_TOKEN = rf"{_WORD}|\P{{L}}+"
#: Classes of words, in capitals if the word begins with one: F first name, A first name that is a common word too, L last
#: name, N another word in capitals of three letters or more, S of two letters, U all in capitals, x other. Between words: , or -.
_KNOWN, _GIVEN = "[FfAaLl]", "[FfAa]"
_AFTER = f"(?:[,-]{_KNOWN})"
#: A name: up to four known words, with one other capitalised word after a first name; a turned one has the last name before a comma.
_RUN = (
    f"(?:[NS],(?=[Ff]))?(?:{_GIVEN}[,-][NU]{_AFTER}{{0,2}}|(?:{_GIVEN}[,-]{_KNOWN}|{_KNOWN}[,-]{_GIVEN})[,-][NU]{_AFTER}?"
    f"|(?={_KNOWN}?[,-]?{_KNOWN}?[,-]?{_GIVEN}){_KNOWN}{_AFTER}{{2}}[,-][NU]|{_KNOWN}{_AFTER}{{0,3}})"
)


#: Matches that are placed one after the other; longer rows of them are placed block by block.
_BLOCK = 128


def spans_of(text: Column, pattern: str) -> Column:
    """array of struct(start, end, text) of the matches of a pattern, in characters from 0: lengths of pieces and matches, summed.

    The sums run within blocks of matches and over the blocks, so that the time grows with the matches, not their square.
    """
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
    span = lambda start, end, hit: F.struct(start.alias("start"), end.alias("end"), hit.alias("text"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        end = start + F.length(piece["hit"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span(start, end, piece["hit"]))).alias("found"))

    def placed(pieces: Column) -> Column:
        last = F.floor((F.size(pieces) - 2) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(pieces, k * _BLOCK + 1, F.least(F.lit(_BLOCK), F.size(pieces) - 1 - k * _BLOCK)), zero, step))
        return T.let(blocks, together)

    def together(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda b, at: F.transform(b["found"], lambda s: span(s["start"] + at, s["end"] + at, s["text"]))))

    # one more than there are matches; split compiles its pattern for every row, but for a single character
    gaps = F.when(text.contains("\x00"), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, "\x00"), "\x00", -1))
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda hit, gap: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    return F.when(text.rlike(pattern), T.let(pieces, placed)).otherwise(none)


def _typed(spans: Column, kind: str, valid: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(spans, lambda s: valid(s["text"])) if valid else spans
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("type"), s["text"].alias("text")))


def _apart(spans: Column, taken: Column) -> Column:
    """Those of spans that do not overlap any of taken, which are in order and apart themselves: the last of these to start before a span ends is found by halving."""

    def last_before(t: Column, end: Column) -> Column:
        zero = F.struct(F.lit(0).alias("low"), F.size(t).alias("high"))

        def half(acc: Column, _: Column) -> Column:
            middle = ((acc["low"] + acc["high"]) / 2).cast("int")
            right = F.coalesce(F.get(t, middle)["start"] < end, F.lit(False)) & (acc["low"] < acc["high"])
            return F.struct(F.when(right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(right | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"))

        rounds = F.ceil(F.log2(F.size(t) + 1.0)).cast("int")
        return F.get(t, F.aggregate(F.sequence(F.lit(0), rounds), zero, half, lambda acc: acc["low"]) - 1)

    return F.when(F.size(taken) == 0, spans).otherwise(F.filter(spans, lambda s: ~F.coalesce(last_before(taken, s["end"])["end"] > s["start"], F.lit(False))))


def _by_rank(*kinds: Column) -> Column:
    """All spans of the first kind, and of each other kind those that overlap none taken before, in order."""

    def with_more(spans: Column) -> Callable[[Column], Column]:
        return lambda taken: F.array_sort(F.concat(taken, _apart(spans, taken)))

    def use(parts: Column) -> Column:
        taken = parts["k0"]
        for at in range(1, len(kinds)):
            taken = T.let(taken, with_more(parts[f"k{at}"]))
        return taken

    return T.let(F.struct(*[k.alias(f"k{at}") for at, k in enumerate(kinds)]), use)


def _numbers(text: Column, pattern: str, kind: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of numbers within runs of digits and blanks: of the groups of digits of a run, up to eight in a row, one blank apart, make a valid number; the leftmost and longest count."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def windows(run: Column, groups: Column, starts: Column) -> Column:
        """All rows of up to eight groups."""
        n = F.size(groups)
        at = lambda k: F.get(F.get(starts, F.floor(k / _BLOCK).cast("int")), k % _BLOCK)
        window = lambda k, j: F.struct(
            (run["start"] + at(k)).alias("start"), (-(run["start"] + at(k + j + 1) - 1)).alias("minus_end"), F.array_join(F.slice(groups, k + 1, j + 1), " ").alias("text")
        )
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.sequence(F.lit(0), F.least(F.lit(7), n - 1 - k)), lambda j: window(k, j))))

    def first_apart(found: Column) -> Column:
        step = lambda acc, w: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= w["start"]), F.concat(acc, F.array(F.struct(w["start"].alias("start"), (-w["minus_end"]).alias("end"), w["text"].alias("text"))))).otherwise(acc)
        return F.aggregate(F.array_sort(found), none, step)

    def within(run: Column) -> Column:
        def found(groups: Column) -> Column:
            return T.let(_starts(F.transform(groups, lambda g: F.length(g) + 1)), lambda starts: windows(run, groups, starts))

        sound = lambda w: ~w["text"].contains("  ") & ~w["text"].startswith(" ") & ~w["text"].endswith(" ") & valid(w["text"])
        return first_apart(F.filter(T.let(F.split(run["text"], " "), found), sound))

    enough = F.filter(spans_of(text, pattern), lambda run: F.length(run["text"]) >= 8)
    return _typed(F.flatten(F.transform(enough, within)), kind)


def _ids(text: Column) -> Column:
    """Identity numbers: eleven digits in one group, or six and five."""
    form = lambda n: (F.length(n) == 11) & ~n.contains(" ") | (F.length(n) == 12) & (F.instr(n, " ") == 7)
    return _numbers(text, T.NUMBER, "FNR", lambda n: form(n) & T.id_number_valid(n))


def pii_spans(text: Column) -> Column:
    """Spans (start, end, type, text) of identity numbers, mail addresses, postcodes with place and phone numbers, in order.

    A span gives way to those of an earlier type that it overlaps. Null text has none. Expressions only.
    """
    phones = rf"{T.NUMBER}(?!\.[\p{{L}}0-9])"  # not the start of a file's name
    return _by_rank(_ids(text), _typed(spans_of(text, T.EMAIL), "EMAIL"), _typed(spans_of(text, T.POSTAL), "POSTNR"), _numbers(text, phones, "PHONE", T.phone_valid))


def text_words(text: Column) -> Column:
    """What a dictionary is asked about a text: its words, in small letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def name_spans(text: Column, known: Names = KNOWN) -> Column:
    """Spans (start, end, type, text) of names: FULL_NAME of several words, FIRST_NAME of one that is no common word.

    Each word of the text becomes one letter for its class in the dictionary (first, last, ambiguous: in small
    letters), each gap a mark; names are the matches of one pattern in that string of classes. Null text has none.
    """

    def class_of(token: Column, kind: Kind) -> Column:
        capital = token.rlike(r"^\p{Lu}")
        letter = T.let(kind(F.lower(token)), lambda k: F.when(k == FIRST, "f").when(k == AMBIGUOUS, "a").when(k == LAST, "l"))
        other = F.when(~capital | (F.length(token) < 2), "x").when(F.upper(token) == token, F.when(F.length(token) > 2, "U").otherwise("x")).when(F.length(token) > 2, "N").otherwise("S")
        word = lambda k: F.coalesce(F.when(capital, F.upper(k)).otherwise(k), other)
        return F.when(token.rlike(r"^\p{L}"), T.let(letter, word)).when(token.rlike("^ ?, *$"), ",").otherwise("-")

    def names(tokens: Column, classes: Column) -> Column:
        several = lambda s: (F.length(s["text"]) > 1) & s["text"].rlike("[FALNUSfl]")
        single = lambda s: s["text"].isin("F", "f")
        runs = F.filter(spans_of(classes, _RUN), lambda s: several(s) | single(s))
        return T.let(_starts(F.transform(tokens, lambda t: F.length(t))), lambda at: F.transform(runs, lambda s: placed(tokens, at, s, several(s))))

    def placed(tokens: Column, at: Column, s: Column, several: Column) -> Column:
        of = lambda place: F.get(F.get(at, F.floor(place / _BLOCK).cast("int")), place % _BLOCK)
        return F.struct(of(s["start"]).alias("start"), of(s["end"]).alias("end"), F.when(several, "FULL_NAME").otherwise("FIRST_NAME").alias("type"), F.array_join(F.slice(tokens, s["start"] + 1, s["end"] - s["start"]), "").alias("text"))

    def found(tokens: Column) -> Column:
        classes = known.bound(lambda kind: F.array_join(F.transform(tokens, lambda t: class_of(t, kind)), ""))
        return T.let(classes, lambda c: names(tokens, c))

    none = F.array().cast("array<struct<start:int,end:int,type:string,text:string>>")
    return F.coalesce(T.let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), found), none)


def _starts(lengths: Column) -> Column:
    """Where each of the lengths starts, and the end of the last, if they stand one after the other: in blocks, place k at block k / _BLOCK."""
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("starts"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def shifted(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda b, at: F.transform(b["starts"], lambda s: s + at))

    last = F.floor(F.size(lengths) / _BLOCK).cast("int")
    return T.let(F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(F.concat(lengths, F.array(F.lit(0))), k * _BLOCK + 1, F.lit(_BLOCK)), zero, step)), shifted)


def text_spans(text: Column, known: Names = KNOWN) -> Column:
    """What redaction replaces: identity numbers, mail addresses, and names apart from both."""
    return _by_rank(_ids(text), _typed(spans_of(text, T.EMAIL), "EMAIL"), name_spans(text, known))


def redact_text(df: DataFrame, column: str, known: Names = KNOWN) -> DataFrame:
    """df with identity numbers, mail addresses and names in a text column replaced by their stand-ins, and n_redacted.

    Expressions only. What stands between the spans is cut out of the pieces between their starts, piece by piece.
    """
    spans, text = F.col("__spans"), F.col(column)
    value = lambda kind, t: F.when(kind == "FNR", T.fake_id_number(t)).when(kind == "EMAIL", T.fake_email(t)).when(kind == "FIRST_NAME", T.like_case(t, T.fake_first(t))).otherwise(T.like_case(t, T.fake_full(t)))
    fake = lambda s: T.let(s["text"], lambda t: value(s["type"], t))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    between = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda s, at: F.concat(F.substring(text, at + 1, s["start"] - at), fake(s)))
    whole = F.concat(F.array_join(between, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    out = known.on(df, text_words(text)).withColumn("__spans", text_spans(text, known)).drop(COLUMN)
    return out.withColumns({column: F.when(F.size(spans) > 0, whole).otherwise(text), "n_redacted": F.coalesce(F.size(spans), F.lit(0))}).drop("__spans")


def anonymize(df: DataFrame, table_key: str, max_len: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rewritten rows, column classes) of one table with row_pos: classify by its tail, replace values, redact free text.

    Only the classes, one row per column, reach the driver: they decide which expression each column gets.
    """
    texts = [c for c, k in df.dtypes if k == "string"]
    cells = df.select(F.lit(table_key).alias("table_key"), "row_pos", *texts).unpivot(["table_key", "row_pos"], texts, "col_name", "value")
    classes = classify_columns(column_profile(tail_samples(cells)))
    kinds = {r["col_name"]: r["pii_type"] for r in classes.collect()}
    out = pseudonymize(df, kinds, max_len)
    for c, k in kinds.items():
        if k == "FREE_TEXT":
            out = redact_text(out, c).drop("n_redacted")
    return out, classes

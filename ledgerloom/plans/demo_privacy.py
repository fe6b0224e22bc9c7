"""Queries of personal data: functions, profiles, classes, stand-ins, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.names import Names
from ..operators import privacy as P, relations as R
from ..operators.anonymizing import Anonymized, Subset, anonymize_archive
from ..sources.shared import spread
from .demo_relations import _KIDS, _p, _s
from .fixtures import Inputs
from .registry import demo

TYPES = {"full_name": "FULL_NAME", "last_name": "LAST_NAME", "id_number": "FNR", "email": "EMAIL", "postcode": "POSTNR"}
TEXTS = ["full_name", "last_name", "id_number", "email", "phone", "postcode", "note"]
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _digit(d: str, k: int) -> str:
    return f"TRY_CAST(substr({d}, {k}, 1) AS INTEGER)"


def _control_sql(d: str, weights: tuple[int, ...]) -> str:
    return "((11 - (" + " + ".join(f"{w} * {_digit(d, k)}" for k, w in enumerate(weights, 1)) + ") % 11) % 11)"


def id_sql(column: str) -> str:
    d = f"regexp_replace({column}, '\\D', '', 'g')"
    return f"coalesce(length({d}) = 11 AND {_control_sql(d, T.WEIGHTS_1)} = {_digit(d, 10)} AND {_control_sql(d, T.WEIGHTS_2)} = {_digit(d, 11)}, false)"


def phone_sql(column: str) -> str:
    return f"regexp_matches(replace(regexp_replace(trim({column}), '^(\\+47|0047)', ''), ' ', ''), '^(47)?[2-9][0-9]{{7}}$')"


def index_sql(value: str, kind: str, m: int) -> str:
    return f"CAST(concat('0x', substr(sha256(concat('{T.SALT}', chr(0), '{kind}', chr(0), {value})), 1, 16))::UBIGINT % {m} AS INTEGER)"


def pick_sql(values: list[str], value: str, kind: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{index_sql(value, kind, len(values))} + 1]"


def case_sql(original: str, fake: str) -> str:
    return f"CASE WHEN upper({original}) = {original} THEN upper({fake}) WHEN lower({original}) = {original} THEN lower({fake}) ELSE {fake} END"


def last_sql(column: str) -> str:
    fake = pick_sql(T.LAST_NAMES, f"lower({column})", "last")
    return case_sql(column, fake)


def full_sql(column: str) -> str:
    return f"concat({pick_sql(T.FIRST_NAMES, f'lower({column})', 'full-first')}, ' ', {pick_sql(T.LAST_NAMES, f'lower({column})', 'full-last')})"


def mail_sql(column: str) -> str:
    return f"concat(lower({pick_sql(T.FIRST_NAMES, f'lower({column})', 'mail-first')}), '.', lower({pick_sql(T.LAST_NAMES, f'lower({column})', 'mail-last')}), {index_sql(f'lower({column})', 'mail-no', 1000)}, '@example.invalid')"


CELLS = "ce AS (" + " UNION ALL ".join(f"SELECT 'people' AS table_key, person_id - 1 AS row_pos, '{c}' AS col_name, {c} AS value FROM d_people" for c in TEXTS) + ")"
TAIL = CELLS + ", tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY row_pos) AS k FROM ce WHERE row_pos > (SELECT max(row_pos) FROM ce) - 500 AND trim(value) <> '') WHERE k <= 50)"
_KNOWN = ", ".join(f"'{n}'" for n in P.KNOWN_FIRST + P.KNOWN_LAST)
_SHARE = "round(avg(CAST({0} AS INTEGER)), 6)"
_WORDS = "string_split(trim(value), ' ')"
_SHAPED = f"NOT regexp_matches(value, '\\d') AND len({_WORDS}) <= 4 AND (len(list_filter({_WORDS}, lambda w: lower(w) IN ({_KNOWN}))) > 0 OR len(list_filter({_WORDS}, lambda w: NOT regexp_matches(w, '^[A-Z][a-z]+$'))) = 0)"
_EMBEDDED = f"regexp_matches(value, '{MAIL}') OR {id_sql('value')} OR ({phone_sql('value')})"
PROFILE = TAIL + f""", pr AS (SELECT table_key, col_name, count(*) AS n, {_SHARE.format("regexp_matches(lower(value), '[.](doc|pdf|txt|xml)$') AND NOT contains(value, '@')")} AS files, {_SHARE.format("regexp_matches(trim(value), '^[0-9]+$')")} AS numbers, {_SHARE.format("length(regexp_replace(value, '[^0-9]', '', 'g')) = 11")} AS eleven,
{_SHARE.format("regexp_matches(trim(value), '^[0-9]{4}$')")} AS four, {_SHARE.format(id_sql('value'))} AS ids, {_SHARE.format(f"regexp_matches(trim(value), '^{MAIL}$')")} AS mails, {_SHARE.format(_EMBEDDED)} AS embedded, {_SHARE.format(_SHAPED)} AS shaped,
{_SHARE.format(f"len(list_filter({_WORDS}, lambda w: lower(w) IN ({_KNOWN}))) > 0")} AS known, round(avg(length(value)), 6) AS avg_len, CAST(max(length(value)) AS INTEGER) AS max_len FROM tl GROUP BY table_key, col_name)"""


def _people(i: Inputs) -> DataFrame:
    """People come in few splits."""
    return spread(i.d_people)


def _cells(i: Inputs) -> DataFrame:
    people = i.d_people.withColumn("row_pos", F.col("person_id") - 1).withColumn("table_key", F.lit("people"))
    return people.select("table_key", "row_pos", *TEXTS).unpivot(["table_key", "row_pos"], TEXTS, "col_name", "value")


@demo(f"SELECT person_id, id_number, {id_sql('id_number')} AS valid FROM d_people")
def id_numbers(i: Inputs) -> DataFrame:
    return i.d_people.select("person_id", "id_number", T.id_number_valid(F.col("id_number")).alias("valid"))


@demo(f"SELECT person_id, phone, {phone_sql('phone')} AS valid, {phone_sql('id_number')} AS id_is_phone FROM d_people")
def phones(i: Inputs) -> DataFrame:
    return i.d_people.select("person_id", "phone", T.phone_valid(F.col("phone")).alias("valid"), T.phone_valid(F.col("id_number")).alias("id_is_phone"))


@demo(f"SELECT person_id, {index_sql('full_name', 'demo', 97)} AS idx FROM d_people")
def stable_index(i: Inputs) -> DataFrame:
    return i.d_people.select("person_id", T.stable_index(F.col("full_name"), "demo", 97).alias("idx"))


@demo(f"SELECT person_id, list_extract(regexp_extract_all(note, '{MAIL}'), 1) AS email FROM d_people WHERE regexp_matches(note, '{MAIL}')")
def pii_emails(i: Inputs) -> DataFrame:
    return i.d_people.select("person_id", F.get(F.regexp_extract_all("note", F.lit(T.EMAIL), F.lit(0)), F.lit(0)).alias("email")).where("email is not null")


@demo(f"WITH {TAIL} SELECT table_key, col_name, row_pos, value FROM tl")
def tail_samples(i: Inputs) -> DataFrame:
    return P.tail_samples(_cells(i))


@demo(f"WITH {PROFILE} SELECT * FROM pr")
def column_profile(i: Inputs) -> DataFrame:
    return P.column_profile(P.tail_samples(_cells(i)))


@demo(f"""WITH {PROFILE} SELECT table_key, col_name, CASE WHEN col_name = 'full_name' THEN (CASE WHEN shaped >= 0.6 AND known >= 0.25 OR true THEN 'FULL_NAME' END) WHEN col_name = 'last_name' THEN 'LAST_NAME' WHEN col_name = 'email' THEN 'EMAIL' WHEN col_name = 'postcode' AND four >= 0.5 THEN 'POSTNR'
WHEN ids >= 0.6 THEN 'FNR' WHEN mails >= 0.6 THEN 'EMAIL' WHEN embedded >= 0.3 THEN 'FREE_TEXT' WHEN avg_len > 40 OR max_len > 120 THEN 'FREE_TEXT' ELSE 'OTHER' END AS pii_type,
CASE WHEN col_name IN ('full_name', 'last_name', 'email') OR col_name = 'postcode' AND four >= 0.5 THEN 'name' WHEN ids >= 0.6 OR mails >= 0.6 OR embedded >= 0.3 OR avg_len > 40 OR max_len > 120 THEN 'value' ELSE 'none' END AS source FROM pr""")
def classify_columns(i: Inputs) -> DataFrame:
    return P.classify_columns(P.column_profile(P.tail_samples(_cells(i))))


@demo(f"SELECT person_id, {full_sql('full_name')} AS full_name, {last_sql('last_name')} AS last_name, {mail_sql('email')} AS email, '9999' AS postcode FROM d_people")
def pseudonymize_names(i: Inputs) -> DataFrame:
    types = {k: v for k, v in TYPES.items() if k != "id_number"}
    return P.pseudonymize(_people(i), types, {"full_name": 60}).select("person_id", "full_name", "last_name", "email", "postcode")


@demo(f"""WITH m AS (SELECT 'FULL_NAME' AS type, full_name AS original, {full_sql('full_name')} AS fake FROM d_people UNION ALL SELECT 'LAST_NAME', last_name, {last_sql('last_name')} FROM d_people UNION ALL SELECT 'EMAIL', email, {mail_sql('email')} FROM d_people)
SELECT type, original, fake, count(*) AS cells FROM m WHERE original <> fake GROUP BY ALL""")
def mapping_ledger(i: Inputs) -> DataFrame:
    return P.mapping_ledger(_people(i), {"full_name": "FULL_NAME", "last_name": "LAST_NAME", "email": "EMAIL"})


@demo("SELECT 'FULL_NAME' AS type, count(DISTINCT lower(full_name)) AS originals, CAST(0 AS BIGINT) AS inconsistent FROM d_people UNION ALL SELECT 'LAST_NAME', count(DISTINCT lower(last_name)), CAST(0 AS BIGINT) FROM d_people UNION ALL SELECT 'EMAIL', count(DISTINCT lower(email)), CAST(0 AS BIGINT) FROM d_people")
def mapping_consistency(i: Inputs) -> DataFrame:
    return P.mapping_consistency(P.mapping_ledger(_people(i), {"full_name": "FULL_NAME", "last_name": "LAST_NAME", "email": "EMAIL"}))


@demo(f"SELECT 'last_name' AS col_name, person_id - 1 AS row_pos, last_name AS before, {last_sql('last_name')} AS after FROM d_people WHERE person_id < 5 UNION ALL SELECT 'email', person_id - 1, email, {mail_sql('email')} FROM d_people WHERE person_id < 5")
def pii_preview(i: Inputs) -> DataFrame:
    return P.preview(i.d_people.withColumn("row_pos", F.col("person_id") - 1), {"last_name": "LAST_NAME", "email": "EMAIL"})


_DICT = ", ".join(f"('{n}', 'first')" for n in P.KNOWN_FIRST) + ", " + ", ".join(f"('{n}', 'last')" for n in P.KNOWN_LAST)


@demo(f"WITH {CELLS}, d AS (SELECT * FROM (VALUES {_DICT}) v(token, kind)), w AS (SELECT col_name, unnest(regexp_split_to_array(lower(value), '[^a-zæøå]+')) AS token FROM ce) SELECT col_name, token, kind, count(*) AS n FROM w JOIN d USING (token) GROUP BY ALL")
def dict_tokens(i: Inputs) -> DataFrame:
    names = i.spark.createDataFrame([(n, "first") for n in P.KNOWN_FIRST] + [(n, "last") for n in P.KNOWN_LAST], "token string, kind string")
    return P.dict_tokens(_cells(i), names)


@demo(f"SELECT count(*) AS texts, CAST(sum(len(regexp_extract_all(note, '{MAIL}'))) AS BIGINT) AS mails, CAST(0 AS BIGINT) AS left_over FROM d_people")
def redact_email_counts(i: Inputs) -> DataFrame:
    """Addresses in the notes, and how many of them stand in the redacted ones."""
    mails = F.regexp_extract_all("note", F.lit(T.EMAIL), F.lit(0))
    before = i.d_people.select("person_id", mails.alias("before"))
    both = P.redact_text(_people(i).select("person_id", "note"), "note").select("person_id", mails.alias("after")).join(before, "person_id")
    return both.agg(F.count("*").alias("texts"), F.sum(F.size("before")).cast("long").alias("mails"), F.sum(F.size(F.array_intersect("before", "after"))).cast("long").alias("left_over"))


#: Where the parts of a note stand.
NOTES = f"""nt AS (SELECT *, string_split(full_name, ' ')[1] AS f, CAST(length(concat('Case ', person_id, ': contact ')) AS INTEGER) AS at_name, CAST(length(full_name) AS INTEGER) AS n_name, CAST(length(email) AS INTEGER) AS n_email, {id_sql('id_number')} AS valid FROM d_people),
np AS (SELECT *, at_name + n_name + 4 AS at_email, at_name + n_name + 4 + n_email + 5 AS at_id FROM nt)"""


@demo(f"WITH {NOTES} SELECT person_id, at_email AS start, at_email + n_email AS \"end\", 'EMAIL' AS type, email AS text FROM np UNION ALL SELECT person_id, at_id, at_id + 11, 'FNR', id_number FROM np WHERE valid")
def pii_spans(i: Inputs) -> DataFrame:
    return _each(_people(i).select("person_id", P.pii_spans(F.col("note")).alias("found")), "person_id")


@demo(f"WITH {NOTES} SELECT person_id, at_name AS start, at_name + n_name AS \"end\", 'FULL_NAME' AS type, full_name AS text FROM np UNION ALL SELECT person_id, at_email, CAST(at_email + length(f) AS INTEGER), 'FIRST_NAME', lower(f) FROM np WHERE lower(f) NOT IN ({', '.join(repr(w) for w in P.AMBIGUOUS_FIRST)})")
def name_spans(i: Inputs) -> DataFrame:
    return _each(_people(i).select("person_id", P.name_spans(F.col("note")).alias("found")), "person_id")


#: A dictionary made of the tables: a first name for each order, for each line and for each part; a last name for each customer and order. Every third first name is not in it.
_LETTERS = "translate(CAST({0} AS VARCHAR), '0123456789', 'abcdefghij')"
_LARGE = f"""ln AS (SELECT o_orderkey, concat('Fo', {_LETTERS.format('o_orderkey')}) AS f, concat('La', {_LETTERS.format('o_custkey')}) AS l FROM orders),
lt AS (SELECT o_orderkey, f, l, CAST(length(concat('Order ', o_orderkey, ' is signed by ')) AS INTEGER) AS pos, concat('Order ', o_orderkey, ' is signed by ', f, ' ', l, ', copy to ', lower(f), ' (æ) ', f, '.') AS text FROM ln)"""


def _large_names(i: Inputs) -> DataFrame:
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    token = lambda df, head, c, kind: df.select(F.concat(F.lit(head), letters(c)).alias("token"), F.lit(kind).alias("kind"))
    k = F.col("o_orderkey")
    first = token(i.orders.where(k % 3 != 0), "fo", k, "first").unionByName(token(i.lineitem, "li", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "first")).unionByName(token(i.part, "pa", F.col("p_partkey"), "ambiguous"))
    return first.unionByName(token(i.customer, "la", F.col("c_custkey"), "last")).unionByName(token(i.orders, "or", k, "last"))


def _each(found: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """One row for each span; outer, since else the optimizer works out the spans once more to see whether there are any."""
    return found.select(key, F.explode_outer("found").alias("s")).where("s is not null").select(key, "s.*")


def _signed(i: Inputs) -> DataFrame:
    k, letters = F.col("o_orderkey"), lambda c: F.translate(F.col(c).cast("string"), "0123456789", "abcdefghij")
    f, last = F.concat(F.lit("Fo"), letters("o_orderkey")), F.concat(F.lit("La"), letters("o_custkey"))
    return spread(i.orders).select("o_orderkey", F.concat(F.lit("Order "), k, F.lit(" is signed by "), f, F.lit(" "), last, F.lit(", copy to "), F.lower(f), F.lit(" (æ) "), f, F.lit(".")).alias("text"))


@demo(f"""WITH {_LARGE} SELECT o_orderkey, pos AS start, CAST(pos + length(f) + length(l) + 1 AS INTEGER) AS "end", 'FULL_NAME' AS type, concat(f, ' ', l) AS text FROM lt WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, CAST(pos + length(f) + length(l) + 11 AS INTEGER), CAST(pos + 2 * length(f) + length(l) + 11 AS INTEGER), 'FIRST_NAME', lower(f) FROM lt WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, CAST(pos + 2 * length(f) + length(l) + 16 AS INTEGER), CAST(pos + 3 * length(f) + length(l) + 16 AS INTEGER), 'FIRST_NAME', f FROM lt WHERE o_orderkey % 3 <> 0""")
def name_spans_large(i: Inputs) -> DataFrame:
    names = Names.joined(_large_names(i))
    found = names.on(_signed(i), P.text_words(F.col("text"))).select("o_orderkey", P.name_spans(F.col("text"), names).alias("found"))
    return _each(found)


_TURNED = f"""{_LARGE}, tu AS (SELECT o_orderkey, f, concat('Qv', substr(l, 3)) AS q FROM ln)"""


@demo(f"""WITH {_TURNED} SELECT o_orderkey, 8 AS start, CAST(10 + length(q) + length(f) AS INTEGER) AS "end", 'FULL_NAME' AS type, concat(q, ', ', f) AS text FROM tu WHERE o_orderkey % 3 <> 0""")
def name_spans_turned(i: Inputs) -> DataFrame:
    """A last name that the dictionary does not know, a comma, and a first name that it knows two times out of three."""
    names, letters = Names.joined(_large_names(i)), lambda c: F.translate(F.col(c).cast("string"), "0123456789", "abcdefghij")
    text = F.concat(F.lit("Sent by Qv"), letters("o_custkey"), F.lit(", Fo"), letters("o_orderkey"), F.lit(" today"))
    found = names.on(spread(i.orders.select("o_orderkey", text.alias("text"))), P.text_words(F.col("text"))).select("o_orderkey", P.name_spans(F.col("text"), names).alias("found"))
    return _each(found)


@demo(f"""WITH {_LARGE} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN text ELSE concat('Order ', o_orderkey, ' is signed by ', {full_sql("concat(f, ' ', l)")}, ', copy to ', lower({pick_sql(T.FIRST_NAMES, 'lower(f)', 'first')}), ' (æ) ', {pick_sql(T.FIRST_NAMES, 'lower(f)', 'first')}, '.') END AS text,
CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 3 END AS n_redacted FROM lt""")
def redact_text_large(i: Inputs) -> DataFrame:
    return P.redact_text(_signed(i), "text", Names.joined(_large_names(i)))


@demo(f"""WITH {_LARGE}, w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zæøå]+')) AS token FROM lt), d AS (SELECT lower(f) AS token, 'first' AS kind FROM ln WHERE o_orderkey % 3 <> 0 UNION ALL SELECT concat('la', {_LETTERS.format('c_custkey')}), 'last' FROM customer)
SELECT 'text' AS col_name, token, kind, count(*) AS n FROM w JOIN d USING (token) GROUP BY ALL""")
def dict_tokens_large(i: Inputs) -> DataFrame:
    return P.dict_tokens(_signed(i).select(F.lit("text").alias("col_name"), F.col("text").alias("value")), _large_names(i).distinct())


_NOTE = f"concat('Case ', person_id, ': contact ', {full_sql('full_name')}, ' at ', {mail_sql('email')}, ', id N.')"


@demo(f"SELECT person_id, {_NOTE} AS note, {id_sql('id_number')} AS id_valid, 2 + CAST({id_sql('id_number')} AS INTEGER) AS n_redacted FROM d_people")
def redact_text(i: Inputs) -> DataFrame:
    """Notes; of the number that stands in for another only that it is valid."""
    out = P.redact_text(_people(i).select("person_id", "note"), "note")
    return out.select("person_id", F.regexp_replace("note", "[0-9]{11}", "N").alias("note"), T.id_number_valid(F.regexp_extract("note", "[0-9]{11}", 0)).alias("id_valid"), "n_redacted")


@demo(f"SELECT person_id, {full_sql('full_name')} AS full_name, {last_sql('last_name')} AS last_name, {mail_sql('email')} AS email, '9999' AS postcode, phone, true AS id_valid, true AS id_changed, {_NOTE} AS note FROM d_people")
def anonymize_end_to_end(i: Inputs) -> DataFrame:
    people = _people(i).withColumn("row_pos", F.col("person_id") - 1)
    out = P.anonymize(people, "people", {"full_name": 100})[0].join(i.d_people.select("person_id", F.col("id_number").alias("before")), "person_id")
    return out.select("person_id", "full_name", "last_name", "email", "postcode", "phone", T.id_number_valid(F.col("id_number")).alias("id_valid"), (F.col("id_number") != F.col("before")).alias("id_changed"), F.regexp_replace("note", "[0-9]{11}", "N").alias("note"))


#: People and their orders, thinned to 50 of each, the people's first orders and all their people.
_KEPT = f"""{_p('customer', 'orders')}, {_s('customer')}, {_s('orders')}, {_KIDS}, ko AS (SELECT row_pos FROM s_orders UNION SELECT row_pos FROM kids),
kc AS (SELECT row_pos FROM s_customer UNION SELECT c.row_pos FROM p_customer c JOIN p_orders o ON o.o_custkey = c.c_custkey JOIN ko k ON k.row_pos = o.row_pos),
pk AS (SELECT d.* FROM d_people d JOIN p_customer c ON c.c_custkey = d.person_id JOIN kc k ON k.row_pos = c.row_pos), op AS (SELECT o.* FROM p_orders o JOIN ko k ON k.row_pos = o.row_pos)"""
_FILE = "concat('rec', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' ELSE '.xyz' END)"
_BODY = "CASE o_orderkey % 3 WHEN 0 THEN 'PDF stand-in' WHEN 1 THEN 'Text stand-in' ELSE 'stand-in' END"


def _anonymized(i: Inputs) -> Anonymized:
    k = F.col("o_orderkey")
    memo = F.concat(F.lit("Order "), k, F.lit(" was placed by mail of c"), "o_custkey", F.lit("@shop.example.org in time."))
    rows = {"people": R.with_row_pos(i.d_people, ["person_id"]), "orders": R.with_row_pos(i.orders.select("o_orderkey", "o_custkey", "o_orderstatus", memo.alias("memo")), ["o_orderkey"])}
    ext = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "txt").otherwise("xyz")
    name = F.concat(F.lit("rec"), k, F.lit("."), ext)
    inv = i.orders.select(F.lit("a0").alias("archive_id"), F.lit("orders").alias("table_key"), F.lit("lob3").alias("lob"), F.concat(F.lit("content/s/orders/lob3/"), name).alias("path"), name.alias("basename"), ext.alias("ext"))
    refs = rows["orders"].select(F.lit("a0").alias("archive_id"), F.lit("orders").alias("table_key"), "row_pos", F.lit(3).alias("col_idx"), name.alias("ref"), k.cast("long").alias("length"), F.lit("AA").alias("digest"))
    stand_ins = i.spark.createDataFrame([("pdf", bytearray(b"PDF stand-in")), ("txt", bytearray(b"Text stand-in")), ("bin", bytearray(b"stand-in"))], "kind string, content binary")
    keys = [R.ForeignKey("orders_people", "orders", ("o_custkey",), "people", ("person_id",))]
    return anonymize_archive(rows, keys, Subset(50, important=("people",)), inv, refs, stand_ins)


_CHANGED = f"CAST(full_name <> {full_sql('full_name')} AS INTEGER) + CAST(last_name <> {last_sql('last_name')} AS INTEGER) + CAST(email <> {mail_sql('email')} AS INTEGER) + CAST(postcode <> '9999' AS INTEGER) + 1"


@demo(f"""WITH {_KEPT} SELECT 'people' AS table_key, (SELECT count(*) FROM d_people) AS declared_rows, count(*) AS kept_rows, CAST(sum({_CHANGED}) AS BIGINT) AS cells, count(*) AS freetext_cells, CAST(sum(2 + CAST({id_sql('id_number')} AS INTEGER)) AS BIGINT) AS spans, CAST(0 AS BIGINT) AS files FROM pk
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), count(*), 0, count(*), count(*), count(*) FROM op""")
def anonymize_counts(i: Inputs) -> DataFrame:
    return _anonymized(i).counts


@demo(f"""WITH {_KEPT}, m AS (SELECT 'FULL_NAME' AS type, full_name AS original, {full_sql('full_name')} AS fake FROM pk UNION ALL SELECT 'LAST_NAME', last_name, {last_sql('last_name')} FROM pk UNION ALL SELECT 'EMAIL', email, {mail_sql('email')} FROM pk UNION ALL SELECT 'POSTNR', postcode, '9999' FROM pk)
SELECT type, original, fake, count(*) AS cells FROM m WHERE original <> fake GROUP BY ALL""")
def anonymize_ledger(i: Inputs) -> DataFrame:
    return _anonymized(i).ledger.where("type != 'FNR'")


@demo(f"""WITH {_KEPT} SELECT row_pos, {_FILE} AS new_ref, CAST(length({_BODY}) AS BIGINT) AS new_length, upper(md5({_BODY})) AS new_digest, 'column' AS how FROM op""")
def anonymize_refs(i: Inputs) -> DataFrame:
    return _anonymized(i).refs.select("row_pos", "new_ref", "new_length", "new_digest", "how")


@demo(f"""WITH {_KEPT} SELECT 'people' AS table_name, person_id AS id, {full_sql('full_name')} AS text, {_NOTE} AS note FROM pk
UNION ALL SELECT 'orders', o_orderkey, o_orderstatus, concat('Order ', o_orderkey, ' was placed by mail of ', {mail_sql("concat('c', o_custkey, '@shop.example.org')")}, ' in time.') FROM op""")
def anonymize_tables(i: Inputs) -> DataFrame:
    tables = _anonymized(i).tables
    people = tables["people"].select(F.lit("people").alias("table_name"), F.col("person_id").alias("id"), F.col("full_name").alias("text"), F.regexp_replace("note", "[0-9]{11}", "N").alias("note"))
    return people.unionByName(tables["orders"].select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"), F.col("memo").alias("note")))


@demo("SELECT row_pos, regexp_replace(regexp_replace(value, '(\\\\u0020)+$', ''), '(\\\\u0020)+', ' ', 'g') AS value FROM d_pad")
def padding_clean(i: Inputs) -> DataFrame:
    return i.d_pad.select("row_pos", T.clean_padding(F.col("value")).alias("value"))


@demo("""WITH c AS (SELECT value, regexp_replace(regexp_replace(value, '(\\\\u0020)+$', ''), '(\\\\u0020)+', ' ', 'g') AS new FROM d_pad)
SELECT count(*) AS cells, count(*) FILTER (value <> new) AS changed, CAST(sum(len(regexp_extract_all(value, '(\\\\u0020)+'))) AS BIGINT) AS runs, CAST(sum(strlen(value) - strlen(new)) AS BIGINT) AS bytes_saved FROM c""")
def padding_stats(i: Inputs) -> DataFrame:
    new = T.clean_padding(F.col("value"))
    return i.d_pad.agg(F.count("*").alias("cells"), F.count_if(F.col("value") != new).alias("changed"), F.sum(F.regexp_count("value", F.lit(r"(?:\\u0020)+"))).alias("runs"), F.sum(F.octet_length("value") - F.octet_length(new)).alias("bytes_saved"))


@demo("SELECT person_id, substr(full_name, 1, 6) AS name6, substr(hex(encode(full_name)), 1, 8) AS hex8 FROM d_people")
def length_cap(i: Inputs) -> DataFrame:
    whole = F.hex(F.encode("full_name", "UTF-8"))
    return i.d_people.select("person_id", T.cap_length(F.col("full_name"), F.lit(6)).alias("name6"), T.cap_length(whole, F.lit(9), True).alias("hex8"))

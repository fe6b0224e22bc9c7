"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .ngram_join import doc_bit, filter_bits
from .store import written
from .textvec import small

# Given names by gender, titles by gender, all in the scripts the names are written in.
FEMALE = "Anna Maria Emma Sofia Laura Julia Sarah Elena Marta Ines Lucia Claire Camille Hannah Katharina Greta Mary Linda Susan Jennifer Emily Olivia Анна Мария Елена Ольга Наталья Ирина Μαρία Ελένη Σοφία".split()
MALE = "Peter Hans Jan Lukas Paul Thomas Michael David Daniel Carlos Pablo Luis Miguel Pierre Jacques Louis John James Robert William George Oliver Иван Сергей Дмитрий Алексей Николай Павел Γιώργος Νίκος Δημήτρης".split()
TITLES_F = "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Signora Professorin Госпожа Κυρία".split()
TITLES_M = "Mr Herr Herrn Señor Sr Monsieur Signor Sir Господин Κύριος".split()
TITLES_ANY = "Dr Prof Doctor Doktor Professor Доктор Профессор".split()
# Small words that may stand between given and family names.
PARTICLES = set("von van de der den del della di da du la le dos zu zum ter ten bin ibn al y".split())
# Syllables of surrogate names, one list per script.
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо да де ди до га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви".split(),
    "greek": "βα βε βο δα δε δι δο γα γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "n", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н", ("greek", "f"): "α", ("greek", "m"): "ς"}

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)", re.A)
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{8,14}(?!\w)", re.A)
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", re.A)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
_TITLE = "|".join(TITLES_F + TITLES_M + TITLES_ANY)
_GIVEN = "|".join(FEMALE + MALE)
_ANCHOR = re.compile(rf"(?<!\w)(?:{_TITLE}|{_GIVEN})(?!\w)")
_GAP = re.compile(r"(?=\s)[^\S\n]{0,8}\n?[^\S\n]{0,8}(?=\S)")
_ENDING = re.compile(r"['’]s?$")
GENDER = dict.fromkeys(FEMALE, "f") | dict.fromkeys(MALE, "m")
TITLE_GENDER = dict.fromkeys(TITLES_F, "f") | dict.fromkeys(TITLES_M, "m") | dict.fromkeys(TITLES_ANY, "")
#: Capitalised words that are taken into one name beside titles, known given names and initials.
MOST_WORDS = 3
_ALONE, _PART = re.compile(_WORD), re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else (2 * int(c)) - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def _person(text: str, at: int, common: Callable[[], set[str]]) -> tuple[list[tuple[int, int, str, str]], int]:
    """Parts of the name that a title or given name at a place begins, and where to look on.

    Read on: titles, known given names, initials (with a point, or one letter before more of the name), small words
    like "von", and up to MOST_WORDS capitalised words, of which the last is the family name. Titles and initials are
    no part of what is replaced, and a title after a name begins another. Parts are apart by blanks, the next word of a
    name by one line break at most. Capitalised words after the first count only if the text never has them in small
    letters (common() tells), so that a heading does not run on.
    """
    given, other, gender, titled, pos, end = [], [], "", False, at, at
    broken = False
    while m := _ALONE.match(text, pos):
        word = _ENDING.sub("", m[0])
        stop, first = pos + len(word), word.split("-")[0]
        point = False
        if word in TITLE_GENDER:
            if given or other:
                break
            titled, gender, point = True, gender or TITLE_GENDER[word], True
        elif first in GENDER and not other:
            given.append((pos, stop, GENDER[first]))
            gender = gender or GENDER[first]
        elif len(word) == 1 and word.isupper() and (text[stop : stop + 1] == "." or word != "I"):
            point = True
        elif word in PARTICLES:
            pass
        elif word[0].isupper() and len(other) < MOST_WORDS and (not other or not (broken or word.lower() in common())):
            other.append((pos, stop))
        else:
            break
        end = stop
        gap = _GAP.match(text, stop + (point and text[stop : stop + 1] == ".")) if word == m[0] else None
        if not gap:
            break
        broken, pos = "\n" in gap[0], gap.end()
    if not other and not titled and len(given) < 2:
        return [], max(end, at + 1)
    form = lambda a, b, kind: (a, b, f"{kind}_{_script(text[a:b])}", text[a:b].lower())
    parts = [form(a, b, f"given_{g}") for a, b, g in given] + [form(a, b, f"given_{gender or 'm'}") for a, b in other[:-1]]
    return parts + [form(a, b, "family") for a, b in other[-1:]], max(end, at + 1)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, in order, apart from each other.

    Types: email, ip, phone, card (13 to 19 digits that pass the Luhn test), ssn, and parts of names: given names with
    gender and a family name, where a title or a known given name begins a name (see _person); where such names stand,
    also every other mention of them alone, before or after. The normal form is what mentions of one entity share.
    """
    found = []
    for kind, pattern in (("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            plain = m[0].lower() if kind in ("email", "ip") else re.sub(r"\D", "", m[0])
            if kind != "card" or luhn(plain):
                found.append((m.start(), m.end(), kind, plain))
    small_words: list[set[str]] = []

    def common() -> set[str]:
        if not small_words:
            small_words.append({w for w in _ALONE.findall(text) if w[0].islower()})
        return small_words[0]

    at = 0
    while m := _ANCHOR.search(text, at):
        parts, at = _person(text, m.start(), common)
        found += parts
    names = {}
    for start, end, kind, plain in sorted(found):
        if kind.startswith(("given", "family")):
            names.setdefault(plain, (kind, plain))
    if names:
        full = {(s[0], s[1]) for s in found}
        for m in _ALONE.finditer(text):
            # a part of a hyphenated word is a mention too, and so is a name before a possessive ending
            for start, end in [m.span()] if m[0].lower() in names else [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]:
                if text[start].isupper() and (start, end) not in full and text[start:end].lower() in names:
                    found.append((start, end, *names[text[start:end].lower()]))
    out, end = [], 0
    for s in sorted(found, key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


#: Attempts after which a format counts as full.
FULL = 12


def surrogate(key: bytes, kind: str, plain: str, attempt: int) -> str:
    """The normal form that stands for plain: of its type and length, from HMAC-SHA-512 of key, type, plain and attempt.

    After FULL attempts the format counts as full: numbers get a digit more for every eight attempts, IP parts any
    length and, at twice as many, there are more of them, so that a free value turns up whatever the originals are.
    """
    longer = max(0, attempt - FULL + 8) // 8
    n = int.from_bytes(hmac.new(key, f"{kind}|{plain}|{attempt}".encode(), hashlib.sha512).digest(), "big")

    def draw(m: int) -> int:
        nonlocal n
        n, r = divmod(n, m)
        return r

    if kind == "ip" and longer:
        return ".".join(str(draw(254) + 1) for _ in range(4 + max(0, attempt - FULL) // FULL))
    if kind == "ip":
        return ".".join(str(draw(9 if len(p) == 1 else 90 if len(p) == 2 else 155) + (1 if len(p) == 1 else 10 if len(p) == 2 else 100)) for p in plain.split("."))
    if kind == "email":
        local, domain = plain.split("@")
        parts = domain.split(".")
        d = int.from_bytes(hmac.new(key, f"domain|{domain}".encode(), hashlib.sha512).digest(), "big")
        labels = []
        for p in parts[:-1]:
            word = ""
            for c in p:
                word, d = word + (chr(97 + d % 26) if c.isalpha() else str(d % 10) if c.isdigit() else c), d // 26
            labels.append(word)
        body = "".join(chr(97 + draw(26)) if c.isalpha() else str(draw(10)) if c.isdigit() else c for c in local)
        body += "".join(chr(97 + draw(26)) for _ in range(attempt // 3))
        return f"{body}@{'.'.join([*labels, parts[-1]])}"
    if kind in ("phone", "ssn", "card"):
        keep = 1 if kind == "phone" and len(plain) > 10 else 0
        body = plain[:keep] + "".join(str(draw(10)) for _ in range(len(plain) - keep + longer))
        if kind == "card":
            body = next(body[:-1] + str(c) for c in range(10) if luhn(body[:-1] + str(c)))
        return body
    script = kind.rsplit("_", 1)[1]
    word = "".join(SYLLABLES[script][draw(len(SYLLABLES[script]))] for _ in range(3 + attempt // 3))
    return word + (ENDINGS[script, kind.split("_")[1]] if kind.startswith("given") else "")


def dressed(mention: str, kind: str, plain: str) -> str:
    """The surrogate's normal form in the format of the mention: its separators, or its case."""
    if kind in ("phone", "ssn", "card"):
        digits = iter(plain)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "ip":
        return plain
    if mention.isupper() and len(mention) > 1:
        return plain.upper()
    return plain.capitalize() if mention[0].isupper() and kind != "email" else plain


def _suspects(batch: pa.RecordBatch) -> Iterator[int]:
    """Rows with a digit, an @ or the letters of a title or given name anywhere: only there can an entity be."""
    marks = pc.match_substring_regex(batch.column("text"), f"[0-9@]|{_TITLE}|{_GIVEN}")
    other = pc.match_substring_regex(batch.column("text"), r"\p{Nd}")  # digits of other scripts
    yield from np.flatnonzero(pc.fill_null(pc.or_(marks, other), False).to_numpy(zero_copy_only=False)).tolist()


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, type, plain: each entity of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, plains = [], [], []
            for r in _suspects(b):
                for kind, plain in sorted({s[2:] for s in detect(b.column("text")[r].as_py())}):
                    ids.append(b.column("doc_id")[r].as_py())
                    kinds.append(kind)
                    plains.append(plain)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(plains, pa.string())], ["doc_id", "type", "plain"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, type string, plain string")


def surrogate_map(originals: DataFrame, key: str) -> DataFrame:
    """type, plain, surrogate: one to one within a type's family, and no surrogate is an original of that family.

    Families are names (given and family names of all scripts), numbers (phone, card, ssn), email and ip. Every original
    draws a surrogate; where several drew one, all but the smallest draw again, and so does one that drew an original.
    Each round is a join by value; nothing reaches the driver but counts. Rounds end because surrogates grow: see surrogate.
    """
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [surrogate(secret, k, p, a) for k, p, a in zip(*(b.column(c).to_pylist() for c in ("type", "plain", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.string())], [*b.schema.names, "surrogate"])

    family = F.when(F.col("type").rlike("^(given|family)_"), "name").when(F.col("type").isin("phone", "card", "ssn"), "number").otherwise(F.col("type"))
    originals = written(originals.distinct().withColumn("family", family), "originals")
    taken = originals.select("family", F.col("plain").alias("surrogate")).distinct().withColumn("is_original", F.lit(True))
    draws = originals.withColumn("attempt", F.lit(0))
    while True:
        draws = written(draws.select("type", "plain", "family", "attempt").mapInArrow(run, "type string, plain string, family string, attempt int, surrogate string"), "draws")
        first = draws.groupBy("family", "surrogate").agg(F.min(F.struct("attempt", "type", "plain")).alias("first"))
        checked = draws.join(first, ["family", "surrogate"]).join(taken, ["family", "surrogate"], "left")
        again = F.coalesce("is_original", F.lit(False)) | (F.col("first.type") != F.col("type")) | (F.col("first.plain") != F.col("plain"))
        checked = written(checked.select("type", "plain", "family", "attempt", "surrogate", again.alias("again")), "checked")
        if checked.where("again").isEmpty():
            return checked.select("type", "plain", "surrogate")
        draws = checked.withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions) and types, for each row of docs (doc_id, text).

    One original has one surrogate in all documents, mentions in other formats included, and two originals never share
    one. Titles, separators, case and length of numbers stay; cards keep a valid check digit; e-mail addresses of one
    domain stay together. Null text stays null, text without entities stays as it is; repeated rows come out as often as
    they go in. A null doc_id is treated like any other. An empty table gives an empty result. Only documents that a fixed-size
    filter of ids lets through are joined with their entities; the texts of the others do not move.
    """
    found = written(entities(docs), "entities")
    pairs = surrogate_map(found.select("type", "plain"), key)
    per = found.join(pairs, ["type", "plain"]).groupBy("doc_id").agg(F.collect_set(F.concat_ws("\x1f", "type", "plain", "surrogate")).alias("pairs"))
    per = written(per.withColumnRenamed("doc_id", "own_id"), "pairs")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(per.select(F.col("own_id").alias("doc_id"))))

    def only(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                hit = bits.value[b.column("bit").to_numpy()] == wanted
                yield from pa.Table.from_batches([b]).select(["doc_id", "text"]).filter(pa.array(hit)).to_batches()

        rows = docs.select(F.col("doc_id").cast("long"), "text", doc_bit(F.col("doc_id").cast("long")).alias("bit"))
        return rows.mapInArrow(run, "doc_id long, text string")

    rows = only(True).join(per, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select("doc_id", "text", "pairs")
    plain = only(False).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("types"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, texts = b.column("pairs"), b.column("text")
            counts, kinds, changed = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows, {}
            for r in np.flatnonzero(pairs.is_valid().to_numpy(zero_copy_only=False)).tolist():
                text = texts[r].as_py()
                known = {tuple(p.split("\x1f")[:2]): p.split("\x1f")[2] for p in pairs[r].as_py()}
                parts, end = [], 0
                spans = detect(text) if text else []
                for s, e, kind, plain in spans:
                    parts += [text[end:s], dressed(text[s:e], kind, known[kind, plain])]
                    end = e
                changed[r] = "".join([*parts, text[end:]]) if text else text
                counts[r], kinds[r] = len(spans), sorted({s[2].split("_")[0] for s in spans})
            new = texts if not changed else pa.array([changed.get(r, t) for r, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), new, pa.array(counts), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "n_entities", "types"])

    return rows.mapInArrow(run, "doc_id long, text string, n_entities long, types array<string>").unionByName(plain)

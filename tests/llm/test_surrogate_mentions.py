"""Surrogates: later mentions by one name, and names beside punctuation of more than one byte."""

import random

from ledgerloom.llm.surrogates import detect, dressed, surrogate, surrogate_map, with_surrogates


def test_mentions_alone_and_beside_punctuation(spark):
    texts = ["Anna Schmidt called. Schmidt said so, and Anna left. SCHMIDT's car, Schmidt-Braun.", "\u201cAnna Keller\u201d came", "\u00abMr Gruber\u00bb went", "\u00bfPeter Lang?", "\u2014Frau Vogel", "nobody here"]
    rows = {r["doc_id"]: r for r in with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    for k, names in enumerate((("Schmidt", "Anna", "SCHMIDT"), ("Anna", "Keller"), ("Gruber",), ("Peter", "Lang"), ("Vogel",))):
        assert not any(n in rows[k]["text"] for n in names)
    new = rows[0]["text"].split()
    assert new[3] == new[1].rstrip(".") and new[7] == new[0] and rows[0]["n_entities"] == 6
    assert rows[5]["text"] == texts[5] and rows[5]["n_entities"] == 0


def test_generated_names():
    """Names made from a grammar, in sentences with other capitalised words: every part is found, titles, initials and small words are not."""
    rng = random.Random(4)
    unknown = ["Ottilie", "Quincy", "Thorben", "Yasmin"]
    families = ["Schmidt", "Sarepe", "O'Brien", "Müller-Lüdenscheidt", "Neumann", "García", "Петров", "Παπαδόπουλος"]
    wanted = found = right = 0
    for _ in range(600):
        pieces, parts = [], []
        titles = rng.choice([[], [], ["Mr."], ["Frau", "Dr."], ["Prof.", "Dr."], ["Herr"], ["Mrs"]])
        givens = rng.sample(["Anna", "Maria", "Peter", "Thomas", "Anna-Lena", "Иван"], rng.choice([0, 1, 1, 2]))
        if titles and rng.random() < 0.2 and not givens:
            givens = [rng.choice(unknown)]
        if not titles and not givens:
            givens = ["Elena"]
        pieces += [(t, False) for t in titles] + [(g, True) for g in givens]
        pieces += [(rng.choice(["J.", "K"]), False)] * (rng.random() < 0.3)
        pieces += [(w, False) for w in rng.choice([[], [], ["von"], ["van", "der"], ["da"]])]
        pieces.append((rng.choice(families), True))
        before, after = rng.choice(["Gestern kam ", "The Plan of ", "(", "«"]), rng.choice([" said so.", "'s Plan", ", London", ") ging", ". Berlin is"])
        text = before
        for k, (word, part) in enumerate(pieces):
            if k:
                text += "\n" if k == len(pieces) - 1 and rng.random() < 0.1 and len(givens) < 2 else " "
            if part:
                parts.append((len(text), len(text) + len(word)))
            text += word
        text += after
        got = [s[:2] for s in detect(text)]
        wanted, found, right = wanted + len(parts), found + len(set(parts) & set(got)), right + len(got)
    # what is missed: a family name on the next line after an unknown given name
    assert found >= 0.99 * wanted and right == found, (found / wanted, found / right)


def test_titles_and_initials_stay_and_headings_do_not_run_on():
    names = lambda t: [t[a:b] for a, b, kind, _ in detect(t) if kind.startswith(("given", "family"))]
    assert names("Frau Dr. Schmidt rief an. Dr. Sarepe auch.") == ["Schmidt", "Sarepe"]
    assert names("Anna Maria Schmidt spoke. Mr. J. Smith left. Plan J stays.") == ["Anna", "Maria", "Schmidt", "Smith"]
    assert names("Anna Schmidt Frau Vogel Herrn Lang") == ["Anna", "Schmidt", "Vogel", "Lang"]
    assert names("Mrs Theresa May Visits London; she visits Mr. Thomas") == ["Theresa", "May", "Thomas"]
    assert names("Dr") == names("Anna left") == names("Dr. h.c.") == names("") == []


def test_names_of_all_types_are_apart(spark):
    """No surrogate is the original of another type of name, and a format that is full gives longer numbers."""
    kinds = [("given_f_latin", "anna"), ("family_latin", "schmidt")]
    first = {k: surrogate(b"k", k, p, 0) for k, p in kinds}
    rows = [*kinds, ("family_latin", first["given_f_latin"]), ("given_m_latin", first["family_latin"]), *[("ssn", f"{n:02d}") for n in range(100)]]
    pairs = {(r["type"], r["plain"]): r["surrogate"] for r in surrogate_map(spark.createDataFrame(rows, "type string, plain string"), "k").collect()}
    assert set(pairs) == set(rows) and len(set(pairs.values())) == len(rows) and not set(pairs.values()) & {p for _, p in rows}
    assert dressed("12-3", "ssn", "4567") == "45-67" and dressed("1-2", "ssn", "345") == "3-45"


def test_a_long_text_of_names():
    text = "Frau Dr. Schmidt und Anna Maria Keller; " * 20_000
    spans = detect(text)
    assert len(spans) == 80_000 and text[slice(*spans[-1][:2])] == "Keller"

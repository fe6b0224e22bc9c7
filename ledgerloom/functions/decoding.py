r"""Texts whose characters are spelled out: HTML entities and \uXXXX escapes; markup at the head of bytes."""

from __future__ import annotations

import html.entities
from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F

from .text import let

#: Names of entities and their characters; a larger table can be given.
ENTITIES: Mapping[str, str] = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}
_ENTITY = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_ESCAPES = r"(?:\\u[0-9a-fA-F]{4})+"
_HIGH, _LOW = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """text with each match of a pattern replaced by an expression of it: pieces and matches, woven together, in time that grows with both."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.concat(gap, F.coalesce(by(hit), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def character(code: Column) -> Column:
    """The character of a code point; those of none, and zero, are U+FFFD; the control characters from 128 on are what Windows-1252 has in their place."""
    sound = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code).otherwise(0xFFFD)
    wide = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
    narrow = "".join(chr(n) for n, c in wide.items() if c)
    return F.translate(F.decode(F.unhex(F.lpad(F.hex(sound), 8, "0")), "UTF-32"), narrow, "".join(c for c in wide.values() if c))


def _entity(names: Mapping[str, str]) -> Callable[[Column], Column]:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def of(hit: Column) -> Column:
        body = F.substring(hit, F.lit(2), F.length(hit) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 9), 16, 10)).otherwise(F.substring(body, 2, 9)).cast("long")
        return F.when(body.startswith("#"), character(number)).otherwise(F.coalesce(F.try_element_at(table, body), hit))

    return of


def decoded_entities(text: Column, passes: int = 4, names: Mapping[str, str] = ENTITIES) -> Column:
    """text with HTML entities (decimal, hexadecimal, by name, all with their semicolon) as characters, without blanks at its ends.

    What decoding yields is decoded again, so that up to `passes` layers of encoding come off; unknown names stay.
    """
    for _ in range(passes):
        text = let(text, lambda t: replaced(t, _ENTITY, _entity(names)))
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


def unescaped(text: Column) -> Column:
    r"""text with \uXXXX as characters. Two halves of a character outside the first plane make it; a half on its own is U+FFFD."""
    lone = rf"{_HIGH}(?!{_LOW})|(?<!{_HIGH}){_LOW}"
    run = lambda hit: F.decode(F.unhex(F.replace(F.regexp_replace(hit, lone, r"\\uFFFD"), F.lit("\\u"), F.lit(""))), "UTF-16BE")
    return replaced(text, _ESCAPES, run)


def spelled_text(text: Column) -> Column:
    r"""Text of a cell that holds \uXXXX: the five entities of XML first, then the escapes."""
    five = {"&amp;": "&", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
    for name, c in five.items():  # the ampersand first, so that what was encoded twice comes off, too
        text = F.replace(text, F.lit(name), F.lit(c))
    return let(text, unescaped)


def markup_header(content: Column) -> Column:
    """xml or html where bytes declare it: at their head, byte-order mark and blanks aside, or within the first 512; null otherwise."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    start = F.regexp_replace(F.regexp_replace(head, "^(?:ï»¿|ÿþ|þÿ)", ""), r"^[ \t\r\n]+", "")
    return F.when(head.contains("<?xml"), "xml").when(start.startswith("<!doctype") | head.contains("<html"), "html")

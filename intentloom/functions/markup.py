"""Text of markup: tags away, character references decoded, all as columns."""

from __future__ import annotations

import json
from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from intentloom.functions.text import text_or_empty

#: Names of characters as the standard has them, with their semicolon; some stand without it too.
NAMES: Mapping[str, str] = html5
#: Small maps that a name is looked up in by its hash, as Spark searches a map from end to end.
SHELVES = 128
GONE = "�"


def _windows(code: int) -> str:
    """What numbers 128 to 159 stand for: the characters that windows-1252 has there."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _shelf(name: str) -> int:
    """Where a name lies: a number from its letters that Spark computes alike."""
    return (sum(ord(c) * (i + 1) for i, c in enumerate(name[:4])) + 7 * len(name)) % SHELVES


def _shelf_of(name: Column) -> Column:
    letters = [F.coalesce(F.ascii(F.substring(name, i + 1, 1)), F.lit(0)) * (i + 1) for i in range(4)]
    return (sum(letters, F.lit(0)) + F.length(name) * 7) % SHELVES + 1


def _named(name: Column, names: Mapping[str, str]) -> Column:
    """The character of a name, null if there is none."""
    shelves: list[dict[str, str]] = [{} for _ in range(SHELVES)]
    for n, character in names.items():
        shelves[_shelf(n)][n] = character
    literal = F.from_json(F.lit(json.dumps(shelves)), "array<map<string,string>>")  # one constant, folded once
    return F.try_element_at(F.element_at(literal, _shelf_of(name)), name)


def _character(code: Column) -> Column:
    """The character of a number: windows-1252 between 128 and 159, none for control characters and non-characters, GONE for 0, surrogates and what is too large."""
    strange = F.from_json(F.lit(json.dumps([_windows(c) for c in range(128, 160)])), "array<string>")
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    none = (code < 9) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), GONE)
        .when(code.between(128, 159), F.get(strange, (code - 128).cast("int")))
        .when(none, "").otherwise(plain)
    )


def _number(part: Column) -> Column:
    """The number that a part begins with, `#65;` or `#x41;`; too large ones count as one beyond all characters. Null if there is none."""
    decimal, hexadecimal = F.regexp_extract(part, "^#0*([0-9]+)", 1), F.regexp_extract(part, "^#[xX]0*([0-9a-fA-F]+)", 1)
    beyond = F.lit(0x110000).cast("long")
    read = lambda digits, base: F.when(F.length(digits) > 7, beyond).otherwise(F.conv(digits, base, 10).cast("long"))
    return F.when(decimal != "", read(decimal, 10)).when(hexadecimal != "", read(hexadecimal, 16))


def decoded_references(c: Column, names: Mapping[str, str] = NAMES) -> Column:
    """`c` with its character references decoded once: `&amp;lt;` becomes `&lt;`.

    Numbers are decimal or hexadecimal, with or without semicolon. Of names, `names` has those that need the semicolon with it and those that don't also without;
    the longest that fits counts, as in `&notit;`. What is no reference stays as it is. The text is cut at every `&`; texts without one are not touched.
    """
    text = text_or_empty(c)
    bare = {n: names[n] for n in sorted((n for n in names if not n.endswith(";")), key=lambda n: (-len(n), n))}

    def decoded(part: Column) -> Column:
        number, full = _number(part), F.regexp_extract(part, "^[a-zA-Z][a-zA-Z0-9]{0,31};", 0)
        short = F.regexp_extract(part, f"^(?:{'|'.join(bare)})", 0) if bare else F.lit("")
        by_number = F.concat(_character(number), F.regexp_replace(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))
        by_full = F.concat(_named(full, names), F.substr(part, F.length(full) + 1))
        by_short = F.concat(_named(short, bare), F.substr(part, F.length(short) + 1))
        name = F.coalesce(F.when(full != "", by_full), F.when(short != "", by_short), F.concat(F.lit("&"), part))
        return F.when(F.startswith(part, F.lit("#")), F.coalesce(by_number, F.concat(F.lit("&"), part))).otherwise(name)

    parts = F.split(text, "&", -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(text)


def element_text(html: Column, names: Mapping[str, str] = NAMES) -> Column:
    """Text of a markup fragment: scripts, styles, comments and tags dropped, character references decoded, the pieces joined by single spaces.

    References are decoded after the tags are gone, so `&lt;b&gt;` is text. White space that they stand for is squeezed like any other, non-breaking spaces stay.
    """
    plain = F.regexp_replace(text_or_empty(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded_references(plain, names), r"\s+", " "))

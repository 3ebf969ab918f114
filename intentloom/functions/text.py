"""Text preparation. Null inputs count as the empty string everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case folding as Python has it: letters that fold to one other letter, and those that fold to several. Made from the interpreter's own table.
_FOLDED = {chr(i): chr(i).casefold() for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i)}
SINGLE = {a: b for a, b in _FOLDED.items() if len(b) == 1}
SEVERAL = {a: b for a, b in _FOLDED.items() if len(b) > 1}


def _spans(letters: str, gap: int = 256) -> str:
    """A pattern of few ranges that has all the letters, and some between them: quick to test."""
    out: list[list[str]] = []
    for a in sorted(letters):
        if out and ord(a) - ord(out[-1][1]) <= gap:
            out[-1][1] = a
        else:
            out.append([a, a])
    return "[" + "".join(f"{a}-{b}" for a, b in out) + "]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def item_blob(title: Column, text: Column) -> Column:
    """Lower-cased title and text with a space between, even if one of them is empty."""
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(text)))


def fold_text(c: Column) -> Column:
    """Full case folding, of all of Unicode as Python's `casefold` does it.

    Texts of ASCII alone, told by their byte count, are lower-cased. In others single letters are translated in one pass, whatever letters the JVM knows of;
    letters that fold to several are replaced one by one, but for the sharp s only where there are any.
    """
    text = text_or_empty(c)
    rare = {a: b for a, b in SEVERAL.items() if a != "ß"}
    each = F.when(text.rlike(_spans("".join(rare))), reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), rare.items(), text)).otherwise(text)
    folded = F.translate(F.replace(each, F.lit("ß"), F.lit("ss")), "".join(SINGLE), "".join(SINGLE.values()))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def strip_text(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def group_blob(group: Column, text: Column) -> Column:
    """Folded group name and text, in which markets are voted."""
    return fold_text(F.concat(text_or_empty(group), F.lit(" "), text_or_empty(text)))


def epoch_normalise(c: Column) -> Column:
    """A timestamp without zone as an instant; sessions of this library run in UTC."""
    return c.cast("timestamp")

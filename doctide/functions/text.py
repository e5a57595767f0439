"""Column functions on text: white space, letters, names, entities, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(c: Column | str) -> Column:
    """White space of any kind collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def collapse_html(c: Column | str) -> Column:
    """HTML's five spaces collapsed; ends and other white space stay."""
    return F.regexp_replace(c, r"[ \t\n\f\r]+", " ")


def has_letter(c: Column | str, least: int = 1) -> Column:
    return F.col(c).rlike(rf"\p{{L}}{{{least},}}") if isinstance(c, str) else c.rlike(rf"\p{{L}}{{{least},}}")


def clipped(c: Column, most: int) -> Column:
    """At most so many characters, cut back to a word's end, with three dots if anything was cut."""
    cut = F.regexp_replace(F.substring(c, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def numeric_cell(c: Column) -> Column:
    """A table cell that holds a number, maybe signed, with groups, decimals, an exponent, a unit sign or an error."""
    return F.trim(c).rlike(r"^[+\-−]?[0-9]+([.,][0-9]+)*([eE][+\-]?[0-9]+)?\s*(%|‰|°)?(\s*±\s*[0-9.]+)?$")


def escape_text(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def decode_text(c: Column) -> Column:
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return c


def redacted(c: Column, most: int = 500) -> Column:
    """Addresses, mail addresses, keys and long digit runs hidden, in this order; then at most so many characters."""
    for pattern, name in ((r"https?://[^\s\"<>]+", "<url>"), (r"[\w.+-]+@[\w-]+\.[\w.]+", "<mail>"), (r"\b(sk|pk|key|tok)[-_][A-Za-z0-9]{8,}", "<key>"), (r"[0-9]{9,}", "<number>")):
        c = F.regexp_replace(c, pattern, name)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def token_kind(c: Column) -> Column:
    """symbol, number, identifier or word."""
    bare = F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(bare == "", "symbol").when(bare.rlike(r"^[0-9][0-9.,]*$"), "number").when(bare.rlike(r"[0-9_]|\p{Ll}\p{Lu}"), "identifier").otherwise("word")

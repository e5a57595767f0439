"""Glyphs of a line: accents joined to their letters, and cells of a table placed on its grid."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spacing accents and the combining marks that they stand for.
ACCENTS = {
    "`": "̀", "ˋ": "̀", "´": "́", "ˊ": "́", "^": "̂", "ˆ": "̂", "~": "̃", "˜": "̃", "¯": "̄", "ˉ": "̄",
    "˘": "̆", "˙": "̇", "¨": "̈", "˚": "̊", "˝": "̋", "ˇ": "̌", "¸": "̧", "˛": "̨",
}
BELOW = "̧̨"
DOTLESS = {"ı": "i", "ȷ": "j"}
#: How far an accent may lie beside its letter, in its own size.
SLACK = 0.05


def _compositions() -> list[tuple[str, str, str]]:
    """(letter, accent, composed): every letter that a spacing accent may stand over, from the canonical compositions.

    As many as Unicode makes, some 1,800 whatever the input.  A dotless letter takes the dotted one's form under a mark
    above it.
    """
    undotted = {v: k for k, v in DOTLESS.items()}
    rows = []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) != 2 or parts[0].startswith("<"):
            continue
        letter, mark = (chr(int(p, 16)) for p in parts)
        if unicodedata.normalize("NFC", letter + mark) != chr(code) or not unicodedata.category(letter).startswith("L"):
            continue
        for accent, combining in ACCENTS.items():
            if combining == mark:
                rows.append((letter, accent, chr(code)))
                if letter in undotted and mark not in BELOW:
                    rows.append((undotted[letter], accent, chr(code)))
    return rows


COMPOSITIONS = _compositions()
#: Of each accented letter the letter, dotless where there is such a one, and the first spacing form of its accent.
FORMS = {c: max((letter, accent) for letter, accent, d in COMPOSITIONS if d == c) for c in sorted({c for *_, c in COMPOSITIONS})}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(text: Column) -> tuple[Column, Column]:
    """Two texts in place of one: of each accented letter the accent, and the letter; of any other sign itself in both."""
    return tuple(F.translate(text, "".join(FORMS), "".join(f[k] for f in FORMS.values())) for k in (1, 0))


def _composed(accent: Column, letter: Column) -> Column:
    """The letter with the accent; null where there is no such letter."""
    out = F.lit(None).cast("string")
    for mark in sorted(set(ACCENTS.values())):
        signs = [a for a, m in ACCENTS.items() if m == mark]
        on = {x: c for x, a, c in COMPOSITIONS if a == signs[0]}
        found = F.translate(letter, "".join(on), "".join(on.values()))
        found = F.when((F.length(letter) == 1) & (found != letter), found)
        out = F.when(accent.isin(*signs), found).otherwise(out)
    return out


def _near() -> str:
    """Pattern of the stretches of a line that accents may change: signs in the ranges of accents and of letters with one, and those beside."""
    codes = sorted(map(ord, {*ACCENTS, *FORMS}))
    ranges = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c - ranges[-1][1] > 256 or c >= 0x80 > ranges[-1][1] or c < 0x80:
            ranges.append([c, c])
        ranges[-1][1] = c
    inside = "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges)
    # two plain signs, as most of a text is, are passed by one look
    return f"(?![A-Za-z0-9 ,.]{{2}})[^{inside}]?+[{inside}]++(?:[^{inside}][{inside}]++)*+[^{inside}]?+"


#: A sign of another range reads as itself unless it stands beside one of these; with one such sign on either side a stretch is whole.
NEAR = _near()


def accented(glyphs: Column) -> Column:
    """Array of what each glyph of a line reads as: an accent that is joined to a letter as nothing, the letter in its accented form.

    glyphs: array of structs (u, font, size, x0, x1, y, top, ...) in order.  An accent belongs to the glyph after it, else to
    the one before, if both have one font, the accent's middle lies on the letter's advance, and its baseline is the
    letter's or above it by at most its height.  A letter takes one accent: the one after it only if the one before it did
    not take it.
    """

    def over(g: Column, letter: Column) -> Column:
        slack = SLACK * g["size"]
        middle, rise = (g["x0"] + g["x1"]) / 2, g["y"] - letter["y"]
        on = middle.between(letter["x0"] - slack, letter["x1"] + slack) & (rise >= -slack) & (rise <= F.greatest(letter["top"] - letter["y"], F.lit(0.0)) + slack)
        return F.when(g["u"].isin(*ACCENTS) & (g["font"] == letter["font"]) & on, _composed(g["u"], letter["u"]))

    def read(line: Column) -> Column:
        ahead = F.transform(line, lambda g, i: over(g, F.get(line, i + 1)))
        # the letter before is taken if the accent before that one took it
        behind = lambda to: F.transform(line, lambda g, i: F.when(F.get(to, i).isNull() & F.get(to, i - 2).isNull(), over(g, F.get(line, i - 1))))
        gone = lambda to, back, i: F.get(to, i).isNotNull() | F.get(back, i).isNotNull()
        text = lambda to, back: F.transform(line, lambda g, i: F.coalesce(F.get(to, i - 1), F.get(back, i + 1), F.when(gone(to, back, i), "").otherwise(g["u"])))
        return let(ahead, lambda to: let(behind(to), lambda back: text(to, back)))

    return let(glyphs, read)


def joined_accents(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs (keys..., ord, u, font, size, x0, x1, y, top, ...) with `text`, what each reads as in its line; see accented."""
    rest = [c for c in glyphs.columns if c not in keys]
    lines = glyphs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.struct("ord").alias("_by"), F.struct(*rest).alias("_g")))).alias("_line"))
    lines = lines.select(*keys, F.transform("_line", lambda x: x["_g"]).alias("_line"))
    read = lines.select(*keys, "_line", accented(F.col("_line")).alias("_text")).select(*keys, F.explode(F.arrays_zip("_line", "_text")).alias("_x"))
    return read.select(*keys, "_x._line.*", F.col("_x._text").alias("text")).select(*glyphs.columns, "text")


def placed_cells(cells: DataFrame, key: str) -> DataFrame:
    """cells (key, row, ord, rowspan, colspan, ...) with col: the first column from the left that is free in their row.

    Rows count from 0 and cells of a row go by ord.  A cell takes colspan columns of rowspan rows; spans below 1 count as 1.
    Where a wide cell meets columns that a higher one holds, both lie there.  Each table is one fold over its cells, which
    carries for each column the row from which it is free again.
    """
    cell = F.struct("row", "ord", F.greatest("rowspan", F.lit(1)).cast("int").alias("down"), F.greatest("colspan", F.lit(1)).cast("int").alias("wide"))
    sorted_cells = F.array_sort(F.collect_list(cell))
    kinds = {c: t for c, t in cells.dtypes}
    none = F.array().cast(f"array<struct<row:{kinds['row']},ord:{kinds['ord']},col:int>>")
    start = F.struct(F.array().cast("array<int>").alias("free"), F.lit(-1).cast(kinds["row"]).alias("row"), F.lit(0).alias("from"), none.alias("all"))

    def step(s: Column, c: Column) -> Column:
        begin = F.when(c["row"] == s["row"], s["from"]).otherwise(0)
        size = F.size(s["free"])
        open_ = F.filter(F.sequence(begin, F.greatest(begin, size)), lambda k: F.coalesce(F.get(s["free"], k), F.lit(0)) <= c["row"])
        col = F.get(open_, F.lit(0))
        end = col + c["wide"]
        until = (c["row"] + c["down"]).cast("int")
        free = F.transform(F.sequence(F.lit(0), F.greatest(size, end) - 1), lambda k: F.when((k >= col) & (k < end), F.greatest(until, F.coalesce(F.get(s["free"], k), F.lit(0)))).otherwise(F.coalesce(F.get(s["free"], k), F.lit(0))))
        one = F.struct(c["row"].alias("row"), c["ord"].alias("ord"), col.alias("col"))
        return F.struct(free.alias("free"), c["row"].alias("row"), end.alias("from"), F.array_append(s["all"], one).alias("all"))

    grids = cells.groupBy(key).agg(F.aggregate(sorted_cells, start, step)["all"].alias("_c"))
    places = grids.select(key, F.explode("_c").alias("_c")).select(key, "_c.row", "_c.ord", "_c.col")
    return cells.join(places, [key, "row", "ord"])

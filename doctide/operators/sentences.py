"""Sentence cuts of text units that hold elements, in the JVM.

Break classes follow the sentence breaking of UAX #29: a pattern over classes of code points finds the boundaries, then
rules that look at both sides of a boundary take away those after abbreviations, cases, labels and months.  An element
stands in a text as one U+FFFC and is read as its stand-in; cuts are given as places of the text with the elements.

Offsets count code points.  Classes are general categories where UAX #29 lists properties, so a few signs differ: letters
with the Other_Lowercase or Other_Uppercase property count by category, and only the stops listed here end sentences.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENT = "￼"
#: Marks a boundary while a text is being cut; a non-character, which counts as a space where a text has it.
MARK = "￿"

#: Break classes, as the inside of a bracket expression in the syntax that Java and RE2 share.
CLASSES = {
    "P": "\\n\\r\\x{85}\\x{2028}\\x{2029}",
    "E": r"\p{M}\p{Cf}",
    "S": "\\t\\x{0B}\\f \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}",
    "L": r"\p{Ll}ªº",
    "U": r"\p{Lu}\p{Lt}",
    "O": r"\p{Lo}\p{Lm}\p{Nl}",
    "N": r"\p{Nd}",
    "A": ".․﹒．",
    "T": "!?։؟۔।॥‼‽⁇⁈⁉。﹖﹗！？｡",
    "K": ",:;՝،؍–—、︐︑﹐﹑，：、\\-－",
    "C": r"\p{Ps}\p{Pe}\p{Pi}\p{Pf}" + "\"'",
}

#: Abbreviations whose stop ends no sentence; besides them, one capital letter.
ABBREVIATIONS = (
    "Fig Figs Eq Eqs Sec Secs Ref Refs Thm Def Lem Prop Cor Rev Phys Lett Nucl Astron Astrophys Mon Not Proc Conf Int J vs etc cf al approx resp viz ca c "
    "Dr Mr Mrs Ms Prof St Mt Jr No Vol pp Ed Eds Sci Rep Univ Dept Inst Inc Ltd Corp Co e.g i.e w.r.t a.k.a i.i.d a.e"
)
#: Those of them after which what follows decides.
TERMINAL = "etc al a.e i.i.d Inc Ltd Corp Co Jr ca c"
#: Labels of numbered parts, before their number.
LABELS = "Eqn Eqns Sect Sects Ch Chap Chaps Tab Tabs App Apps Alg Algs Ex Exs Thms Defs Lems Props Cors Rem Rems Conj Obs Prob Probs Nos Vols"
#: Months, before a day or year.
MONTHS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"


def _after_word(spellings: str) -> str:
    """Pattern of a piece that ends with one of the words and a stop."""
    return rf"(?:^|[^A-Za-z0-9_])(?:{spellings})\.$"


def _any(words: str) -> str:
    return "|".join(words.replace(".", r"\.").split())


_WHITE = r"^[\s\x{A0}]*"
#: Patterns of the end of a piece, white space cut off, and of the start of the next, that join both; in Java's and RE2's syntax.
ABBREVIATED = _after_word(f"[A-Z]|{_any(ABBREVIATIONS)}")
MAY_END = _after_word(_any(TERMINAL))
GOES_ON = _WHITE + r"[a-z0-9(\[]"
CASE = r"(?:^|[^A-Za-z0-9_])[A-Z][A-Za-z0-9_'’-]*[\s\x{A0}]+v\.$"
NUMBERED_PART = _after_word(_any(LABELS))
ITS_NUMBER = _WHITE + r"(?:\(?[0-9]|[A-Z]\.?[0-9]|[A-Z](?:$|[^A-Za-z0-9_])|[IVX]+(?:$|[^A-Za-z0-9_]))"
MONTH = _after_word(_any(MONTHS))
ITS_DATE = _WHITE + "[0-9]"
LABEL = _after_word("[A-Z][a-z]{1,4}")
NUMBERED = _WHITE + r"[0-9]+(?:$|[^0-9).]|\.[0-9])"


#: More than the longest word of a rule and its stop take, so the start of an end this long is never taken for a text's.
END = 2 + max(map(len, f"{ABBREVIATIONS} {LABELS} {MONTHS} Label".split()))


def joined(tail: Column, following: Column) -> Column:
    """Whether a piece that ends with `tail` (white space cut off) and the piece `following` are one sentence.

    All rules want a stop at the end.  The patterns of a last word see the end of the tail alone, as they would go through
    all of it; that of a case sees all, where a "v." is last.
    """
    end = F.substring(tail, -END, END)
    return tail.endswith(".") & (
        (end.rlike(ABBREVIATED) & (~end.rlike(MAY_END) | following.rlike(GOES_ON)))
        | (tail.endswith("v.") & tail.rlike(CASE))
        | (end.rlike(NUMBERED_PART) & following.rlike(ITS_NUMBER))
        | (end.rlike(MONTH) & following.rlike(ITS_DATE))
        | (end.rlike(LABEL) & following.rlike(NUMBERED))
    )


def _replaced(text: Column, signs: str, by: str) -> Column:
    """text with each of a few signs in place of which `by` stands; faster than a translation sign by sign."""
    return functools.reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(by)), signs, text)


def _boundary() -> str:
    """What stands before a boundary: stops, closing marks and spaces, with no rule against a break after them."""
    one = {k: f"[{v}]" for k, v in CLASSES.items()}
    e = f"{one['E']}*+"
    stop = "".join(CLASSES[k] for k in "OULPAT")
    tail = f"(?:{one['C']}{e})*+(?:{one['S']}{e})*+"
    line = rf"(?:\r\n|{one['P']})"
    # a full stop within a number or between capitals, and one before a word in lower case, ends nothing
    inside = f"(?!{one['N']})(?!(?<=[{CLASSES['U']}{CLASSES['L']}][{CLASSES['E']}]{{0,9}}{one['A']}[{CLASSES['E']}]{{0,9}}){one['U']})"
    goes_on = f"[{CLASSES['K']}{CLASSES['A']}{CLASSES['T']}]"
    return f"{line}|{one['T']}{e}{tail}(?:{line}|(?!{goes_on}))|{one['A']}{e}{inside}{tail}(?:{line}|(?!{goes_on}|[^{stop}]*+{one['L']}))"


#: Signs that are most of a text and stand before no boundary are passed by one look.
BOUNDARY = f"(?![A-Za-z0-9 ,\\x{{C0}}-\\x{{FF}}])(?:{_boundary()})"


def running(text: Column) -> Column:
    """White space as a paragraph's: each sign of a run is a space, but the first line end of a run that holds an empty line."""
    first = F.regexp_replace(text, r"([\t\f\r ]*)\n([\t\f\r ]*\n[\t\n\f\r ]*)", f"$1{MARK}$2")
    lines = _replaced(_replaced(first, "\n\t\f\r", " "), MARK, "\n")
    return F.when(F.contains(text, F.lit("\n")), lines).otherwise(_replaced(text, "\t\f\r", " "))


CITATION, ANNOTATION = "citation", "annotation"
#: What an element without a stand-in reads as, and a citation that opens a sentence.
WORD, OPENING = "Xx", "[Xx]"
_CLOSING = "\"'”’)\\]"


def _after_stop(state: Column, text: Column) -> Column:
    """0; 1 past a stop and closing marks; 2 with white space after them: of the state before `text` and `text`."""
    all_closing, all_white = text.rlike(rf"^[{_CLOSING}]*\z"), text.rlike(r"^[\t\n\f\r ]*\z")
    return (
        F.when(text.rlike(rf"[.!?][{_CLOSING}]*[\t\n\f\r ]+\z") | ((state == 1) & text.rlike(rf"^[{_CLOSING}]*[\t\n\f\r ]+\z")), 2)
        .when(text.rlike(rf"[.!?][{_CLOSING}]*\z") | ((state == 1) & all_closing), 1)
        .when((state == 2) & all_white, 2)
        .otherwise(0)
    )


def _token(reading: Column, state: Column, lower_next: Column) -> Column:
    """What an element reads as; a citation after a stop and white space, a word in lower case after it, opens a sentence."""
    blank = reading.rlike(r"^[\s\x{A0}]*\z")
    return (
        F.when(reading.isNull(), WORD)
        .when(reading == CITATION, F.when((state == 2) & lower_next, OPENING).otherwise(" "))
        .when(reading == ANNOTATION, " ")
        .when(blank, F.when(F.contains(reading, F.lit("\n")), "\n").otherwise(" "))
        .otherwise(F.regexp_replace(reading, r"[\t\f\r ]+", " "))
    )


def read_elements(text: Column, readings: Column) -> Column:
    """Array of (token, at, from, to) of a text's elements: its place in the text, and its token's span in the text read so.

    One fold over the parts between elements carries the places and whether a stop and white space stand before.
    """
    parts = F.split(text, ELEMENT, -1)
    # whether the first sign past white space and further elements is a lower-case letter, from the last part backward
    lower = F.reverse(
        F.aggregate(
            F.reverse(parts),
            F.struct(F.lit(False).alias("now"), F.array().cast("array<boolean>").alias("all")),
            lambda s, p: F.struct(
                F.when(p.rlike(r"^\s*\z"), s["now"]).otherwise(p.rlike(r"^\s*\p{Ll}")).alias("now"),
                F.array_append(s["all"], F.when(p.rlike(r"^\s*\z"), s["now"]).otherwise(p.rlike(r"^\s*\p{Ll}"))).alias("all"),
            ),
        )["all"]
    )
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("to"), F.lit(0).alias("state"),
        F.array().cast("array<struct<token:string,at:int,from:int,to:int>>").alias("all"),
    )

    def step(s: Column, i: Column) -> Column:
        part = F.get(parts, i)
        before = _after_stop(s["state"], part)
        token = _token(F.get(readings, i), before, F.get(lower, i + 1))
        at, begin = s["at"] + F.length(part), s["to"] + F.length(part)
        end = begin + F.length(token)
        one = F.struct(token.alias("token"), at.alias("at"), begin.alias("from"), end.alias("to"))
        return F.struct((at + 1).alias("at"), end.alias("to"), _after_stop(before, token).alias("state"), F.array_append(s["all"], one).alias("all"))

    some = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i < F.size(parts) - 1)
    return F.aggregate(some, start, step)["all"]


def sentence_cuts(units: DataFrame, keys: list[str], text: str, readings: str | None = None) -> DataFrame:
    """(keys..., ord, cut): where the sentences after the first of each unit begin, in code points, from ord 0.

    `keys` tell the units apart; `readings` is an array with the stand-in of each U+FFFC of `text`: 'annotation', 'citation',
    or the text that it stands for; a null one, or one that the array lacks, is a word.  A cut inside an element's own text
    is none of the unit's, and an element's own letter before a stop is no abbreviation.  Null and empty texts have no
    cuts; line ends are spaces but for empty lines.  Texts are cut where they are read; what is dealt by unit afterwards
    are numbers.
    """
    body, stand_ins = running(_replaced(F.col(text), MARK, " ")), F.col(readings) if readings else F.array().cast("array<string>")
    none = F.array().cast("array<struct<token:string,at:int,from:int,to:int>>")
    one = units.where(F.col(text).isNotNull()).select(*keys, F.length(text).alias("_n"), body.alias("_text"), stand_ins.alias("_readings"))
    elements = F.when(F.contains("_text", F.lit(ELEMENT)), read_elements(F.col("_text"), F.col("_readings"))).otherwise(none)
    one = one.select(*keys, "_n", "_text", elements.alias("_elements"))
    parts = F.split("_text", ELEMENT, -1)
    seen = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get("_elements", i)["token"], F.lit("")))), "")
    marked = F.split(F.regexp_replace(F.when(F.size("_elements") == 0, F.col("_text")).otherwise(seen), BOUNDARY, f"$0{MARK}"), MARK, -1)
    one = one.select(*keys, "_n", "_elements", F.filter(marked, lambda p: p != "").alias("_pieces"))

    def judged(i: Column) -> Column:
        piece = F.get("_pieces", i)
        tail = F.rtrim(piece, F.lit(" \t\n\f\r\xa0"))
        return F.struct(F.length(piece).alias("n"), (F.length(piece) - F.length(tail)).alias("white"), joined(tail, F.get("_pieces", i + 1)).alias("joined"))

    inner = F.filter(F.sequence(F.lit(0), F.size("_pieces") - 1), lambda i: i < F.size("_pieces") - 1)
    each = one.select(*keys, "_n", "_elements", F.posexplode(F.transform(inner, judged)).alias("_k", "_b"))
    each = each.withColumn("_elements", F.when(F.size("_elements") > 0, F.col("_elements")))
    order = Window.partitionBy(*keys).orderBy("_k")
    met = each.withColumn("_v", F.sum("_b.n").over(order))
    letter = F.col("_v") - F.col("_b.white") - 2
    own = F.coalesce(F.exists("_elements", lambda t: (t["from"] <= letter) & (letter < t["to"])), F.lit(False))
    inside = F.coalesce(F.exists("_elements", lambda t: (t["from"] < F.col("_v")) & (F.col("_v") < t["to"])), F.lit(False))
    last = F.try_element_at(F.filter("_elements", lambda t: t["to"] <= F.col("_v")), F.lit(-1))
    back = F.coalesce(last["at"] + 1 + F.col("_v") - last["to"], F.col("_v"))
    cuts = met.where((~F.col("_b.joined") | own) & ~inside).select(*keys, "_n", back.cast("int").alias("cut"))
    cuts = cuts.where((F.col("cut") > 0) & (F.col("cut") < F.col("_n"))).select(*keys, "cut")
    return cuts.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("cut")) - 1).alias("ord"), "cut")

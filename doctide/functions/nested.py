"""Column functions that read nesting: placeholders of a wire, brackets at a token's edges, groups of TeX."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS = "array<int>"


def integrity(tokens: Column, slots: Column, paired: Column) -> Column:
    """Why a reply's placeholders are refused, as (why, id); why is null if they are right.

    tokens: array of (kind, id), kind open, close or void; slots: the ids that the source has, paired: those of them that
    open and close.  The first fault in the reply's order counts: a close without an open (unbalanced), an id that the source
    lacks (unknown), of the other kind (kind-mismatch), or met before (duplicate).  Then an open without a close, then ids
    of the source that the reply lacks (missing), the first of them told.  Orders may differ; one fold keeps the stack.
    """
    start = F.struct(F.array().cast(_INTS).alias("stack"), F.array().cast(_INTS).alias("seen"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("int").alias("id"))

    def step(s: Column, t: Column) -> Column:
        pair, close = F.array_contains(paired, t["id"]), t["kind"] == "close"
        why = (
            F.when(s["why"].isNotNull(), s["why"])
            .when(close, F.when(F.size(s["stack"]) == 0, "unbalanced"))
            .when(~F.array_contains(slots, t["id"]), "unknown")
            .when((t["kind"] == "open") != pair, "kind-mismatch")
            .when(F.array_contains(s["seen"], t["id"]), "duplicate")
        )
        stack = F.when(close, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).when(t["kind"] == "open", F.array_append(s["stack"], t["id"])).otherwise(s["stack"])
        seen = F.when(close, s["seen"]).otherwise(F.array_append(s["seen"], t["id"]))
        return F.struct(stack.alias("stack"), seen.alias("seen"), why.alias("why"), F.when(s["why"].isNotNull(), s["id"]).when(why.isNotNull() & ~close, t["id"]).alias("id"))

    def end(s: Column) -> Column:
        lacks = F.array_sort(F.array_except(slots, s["seen"]))
        open_ = F.size(s["stack"]) > 0
        why = F.when(s["why"].isNotNull(), s["why"]).when(open_, "unbalanced").when(F.size(lacks) > 0, "missing")
        return F.struct(why.alias("why"), F.when(s["why"].isNotNull(), s["id"]).when(open_, F.get(s["stack"], F.size(s["stack"]) - 1)).otherwise(F.get(lacks, F.lit(0))).alias("id"))

    return F.aggregate(tokens, start, step, end)


#: Brackets that a token may hold in pairs.
PAIRS = (("(", ")"), ("[", "]"), ("{", "}"))
_AT_END, _AT_START = "[.,;:!?'\"`\\p{Pf}]", "['\"`\\p{Pi}]"


def _answered(signs: Column, near: str, far: str) -> Column:
    """Whether the bracket `near` that comes first in `signs` has its pair: its depth comes back to nothing."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("hit"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == near, 1).when(c == far, -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["hit"] | ((c == far) & (depth == 0))).alias("hit"))

    return F.aggregate(signs, start, step)["hit"]


def edge_mark(token: Column, at_end: bool) -> Column:
    """Whether the first or last sign of a token is punctuation that is none of it: stops and quotes, and a bracket without its pair inside."""
    signs = F.split(token, "")
    sign = F.right(token, F.lit(1)) if at_end else F.left(token, F.lit(1))
    ordered = F.reverse(signs) if at_end else signs
    held = F.lit(False)
    for a, b in PAIRS:
        near, far = (b, a) if at_end else (a, b)
        held = F.when(sign == near, _answered(ordered, near, far)).otherwise(held)
    return sign.rlike(_AT_END if at_end else _AT_START) | (sign.rlike(r"\p{Pe}" if at_end else r"\p{Ps}") & ~held)


def bare(token: Column) -> Column:
    """token without the marks at its end, one after another, and then without those at its start."""
    tail = F.length(F.regexp_extract(token, "[.,;:!?'\"`\\p{Pf}\\p{Pe}]*\\z", 0))
    t = F.aggregate(F.sequence(F.lit(0), tail), token, lambda t, _: F.when((t != "") & edge_mark(t, True), F.left(t, F.length(t) - 1)).otherwise(t))
    head = F.length(F.regexp_extract(token, "^['\"`\\p{Pi}\\p{Ps}]*", 0))
    return F.aggregate(F.sequence(F.lit(0), head), t, lambda t, _: F.when((t != "") & edge_mark(t, False), F.substring(t, F.lit(2), F.length(t))).otherwise(t))


#: What one pass over TeX without inner groups does, in order: (pattern, replacement with \\1); Java's and RE2's syntax.
TEX_INNER = (
    (r"\x{E003}\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1/\2"),
    (r"\x{E004}\s*\{([^{}]*)\}", r"√(\1)"),
    (r"([\^_])\{([^{}])\}", r"\1\2"),
    (r"([\^_])\{([^{}]*)\}", r"\1(\2)"),
    (r"\\[A-Za-z]+\s*\{([^{}]*)\}", r"\1"),
    (r"(^|[^A-Za-z}\s\x{E003}\x{E004}])\{([^{}]*)\}", r"\1\2"),
)
#: Before and after the passes.  Escaped braces, fractions and roots are private signs meanwhile.
TEX_BEFORE = ((r"\\\{", "\ue000"), (r"\\\}", "\ue001"), (r"\\\\(\[[^\]]*\])?|\\[ ,;:]", " "), (r"\\!", ""), (r"\\([%&#_$])", "\ue002\\1"), (r"\\frac([^A-Za-z]|$)", "\ue003\\1"), (r"\\sqrt([^A-Za-z]|$)", "\ue004\\1"))
TEX_AFTER = ((r"(^|[^\x{E002}])\$+", r"\1"), (r"\\[A-Za-z]+", ""), (r"[{}\\\x{E002}\x{E003}\x{E004}]", ""), ("\ue000", "{"), ("\ue001", "}"), (r"[\s~]+", " "))


def tex_plain(text: Column) -> Column:
    """TeX read as text: groups from the innermost out, fractions, roots and scripts spelled, other commands and shifts dropped."""
    swap = lambda c, rules: functools.reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].replace("\\1", "$1").replace("\\2", "$2")), rules, c)
    t = swap(text, TEX_BEFORE)
    depth = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(
        F.split(F.regexp_replace(t, "[^{}]", ""), ""), depth,
        lambda s, c: F.struct((s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "{", 1).otherwise(0)).alias("most")),
    )["most"]
    # a fraction's second group may only be plain one pass after its first
    t = F.aggregate(F.sequence(F.lit(0), deepest), t, lambda t, _: swap(t, TEX_INNER))
    return F.trim(swap(t, TEX_AFTER))

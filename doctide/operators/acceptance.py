"""The acceptance rule over tables of pieces: which replies are refused, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points that show nothing by themselves (Default_Ignorable_Code_Point), as the inside of a bracket expression.
IGNORABLE = (
    r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}"
    r"\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
#: What no reply's text may hold: controls but tab and line end, the sign of an element, and those.
FOREIGN = rf"[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}\x{{FFFC}}{IGNORABLE}]"
FLOOR_FROM, FLOOR = 200, 5


def refused(units: DataFrame, replies: DataFrame) -> DataFrame:
    """(reply, unit, why): the first refusal of each reply, null if it is accepted.

    units: (unit, pos, t, id, within, must, s), one row a piece in document order: t text, el or span, `within` the ids of
    the spans around it, `s` its text.  replies: (reply, unit, pos, t, id, within, s).  In order: foreign (a sign that no
    text may hold, or an id the unit lacks) and spans (inside a span that the unit does not put around it), whichever comes
    first in the reply; elements (one lost or doubled); spans (one doubled; or one that must stay lost, or emptied though the
    unit's has text); empty (nothing said where the unit has a letter); short (under a FLOOR-th of a unit of FLOOR_FROM signs
    or more, white space squashed, an element one sign).  A reply without pieces must come as one empty text.
    """
    solid = F.col("s").rlike(r"\S") & (F.col("t") == "text")

    def with_text(pieces: DataFrame, key: str) -> DataFrame:
        """Spans of pieces that have text, at any depth."""
        return pieces.where(solid).select(key, F.explode("within").alias("id")).distinct().withColumn("has_text", F.lit(True))

    def whole(pieces: DataFrame, *keys: str) -> DataFrame:
        joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", F.when(F.col("t") == "el", "￼").otherwise(F.col("s")).alias("s"))))), lambda x: x["s"]), "")
        squashed = F.length(F.trim(F.regexp_replace(joined(F.col("t") != "span"), r"(?U)\s+", " ")))
        return pieces.groupBy(*keys).agg(joined(F.col("t") == "text").alias("said"), squashed.alias("n"))

    shape = units.where("t <> 'text'").select("unit", "t", "id", F.col("within").alias("around"), "must").join(with_text(units, "unit"), ["unit", "id"], "left")
    met = replies.join(shape.select("unit", "t", "id", "around"), ["unit", "t", "id"], "left")
    fault = (
        F.when((F.col("t") == "text") & F.col("s").rlike(FOREIGN), "foreign")
        .when((F.col("t") != "text") & F.col("around").isNull(), "foreign")
        .when((F.col("t") != "text") & (F.size(F.array_except("within", "around")) > 0), "spans")
    )
    first = met.withColumn("fault", fault).groupBy("reply", "unit").agg(F.min_by(F.col("fault"), F.when(F.col("fault").isNotNull(), F.col("pos"))).alias("fault"))
    seen = replies.where("t <> 'text'").groupBy("reply", "t", "id").agg(F.count("*").alias("times"))
    asked = first.select("reply", "unit").join(shape, "unit").join(seen, ["reply", "t", "id"], "left").join(with_text(replies, "reply").withColumnRenamed("has_text", "kept"), ["reply", "id"], "left")
    times = F.coalesce("times", F.lit(0))
    lost = (F.col("t") == "el") & (times != 1)
    bad = (F.col("t") == "span") & ((times > 1) | (F.col("must") & ((times != 1) | (F.col("has_text").isNotNull() & F.col("kept").isNull()))))
    counted = asked.groupBy("reply").agg(F.bool_or(lost).alias("lost"), F.bool_or(bad).alias("bad"))
    a, b = whole(units, "unit").withColumnsRenamed({"said": "asked", "n": "asked_n"}), whole(replies, "reply")
    both = first.join(counted, "reply", "left").join(a, "unit").join(b, "reply")
    why = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("lost"), "elements").when(F.col("bad"), "spans")
        .when(F.col("asked").rlike(r"\p{L}") & ~F.col("said").rlike(r"[\p{L}\p{N}]"), "empty").when((F.col("asked_n") >= FLOOR_FROM) & (FLOOR * F.col("n") < F.col("asked_n")), "short")
    )
    return both.select("reply", "unit", why.alias("why"))

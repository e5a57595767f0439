"""Blocks of a page from its nodes in document order, as running sums over a sweep of opening and closing elements.

A node's subtree is the interval of places [pos, end).  Sweeping a page once, what holds above a place is a running sum of
+1 where an element opens and -1 where it closes, so neither a join of nodes with their ancestors nor a walk is needed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from doctide.functions import text as T


class Rule(NamedTuple):
    """What an element is by its tag, its class, or both (None is any).

    skip: nothing in it counts.  table: a block if a cell has words.  unit: a block if its own text has letters; one that
    `yields` is none inside another block.  protect: no part of the text around it; entered for further blocks only if
    `descend`, and if it is `closed`, not inside a block.
    """

    name: str
    kind: str
    tag: str | None = None
    cls: str | None = None
    descend: bool = False
    yields: bool = False
    closed: bool = False


#: The order in which kinds of rules are asked.
KINDS = ("skip", "table", "unit", "protect")
CELLS = ("td", "th")


def classified(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """nodes with `rule`, a struct of the first rule that fits, or null."""
    found = None
    for r in sorted(rules, key=lambda r: KINDS.index(r.kind)):
        fits = F.lit(True) if r.tag is None else F.col("tag") == r.tag
        fits &= F.lit(True) if r.cls is None else F.coalesce(F.array_contains(F.split("cls", r"\s+"), r.cls), F.lit(False))
        value = F.struct(*(F.lit(v).alias(c) for c, v in (("name", r.name), ("kind", r.kind), ("descend", r.descend), ("yields", r.yields), ("closed", r.closed))))
        found = F.when(fits & (F.col("tag") != "#text"), value) if found is None else found.when(fits & (F.col("tag") != "#text"), value)
    return nodes.withColumn("rule", found)


def _swept(nodes: DataFrame, opens: Column, *carried: str) -> DataFrame:
    """A row where a node stands (delta 1 if it opens something, else 0), and one where it closes (delta -1), with `place` to order by."""
    start = nodes.select("page_id", "pos", *carried, opens.cast("int").alias("delta"), (2 * F.col("pos") + 1).alias("place"))
    close = nodes.where(opens).select("page_id", "pos", *carried, F.lit(-1).alias("delta"), (2 * F.col("end")).alias("place"))
    return start.unionByName(close)


def _so_far() -> WindowSpec:
    """All up to a place; of elements that close there the last to open is the first."""
    return Window.partitionBy("page_id").orderBy("place", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)


def owned_text(nodes: DataFrame, opens: Column) -> DataFrame:
    """(page_id, owner, text): text of each node that opens by `opens`, less that of those that open inside it.

    At each depth the last node to open before a place is the one around it.
    """
    swept = _swept(nodes, opens, "text").withColumn("depth", F.sum("delta").over(_so_far()))
    by_depth = Window.partitionBy("page_id", "depth").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    around = swept.withColumn("owner", F.last(F.when(F.col("delta") == 1, F.col("pos")), ignorenulls=True).over(by_depth))
    texts = around.where("text is not null and delta = 0 and depth > 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    return texts.groupBy("page_id", "owner").agg(whole.alias("text"))


def extracted(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, ord, pos, kind, rule, tag, text, cells): the blocks of each page in document order, ord from 0.

    nodes: (page_id, pos, end, tag, cls, text), see sources.html.  The text of a unit is what no rule inside it claims;
    a table has the number of its cells and no text.
    """
    marked = classified(nodes, rules)
    kind = F.coalesce(F.col("rule.kind"), F.lit(""))
    own = owned_text(marked, F.col("rule").isNotNull())
    cell = F.col("tag").isin(*CELLS)
    cell_texts = owned_text(marked, (cell & F.col("rule").isNull()) | kind.isin("skip", "protect", "table"))
    full = marked.where(F.col("rule").isNotNull() | cell).join(own.withColumnRenamed("text", "own").withColumnRenamed("owner", "pos"), ["page_id", "pos"], "left")
    full = full.join(cell_texts.withColumnRenamed("text", "in_cell").withColumnRenamed("owner", "pos"), ["page_id", "pos"], "left")
    unit = (kind == "unit") & F.coalesce(T.has_letter("own"), F.lit(False))
    words = cell & F.coalesce(T.has_letter("in_cell") & ~T.numeric_cell(F.col("in_cell")), F.lit(False))
    facts = full.select(
        "page_id", "pos", "end", "tag", "rule", F.when(unit, F.col("own")).alias("text"), unit.alias("unit"), words.alias("words"), cell.alias("cell"), (kind == "table").alias("table"),
        (kind.isin("skip", "table") | ((kind == "protect") & ~F.col("rule.descend"))).alias("shut"),
        F.coalesce((kind == "protect") & F.col("rule.closed"), F.lit(False)).alias("closed"),
    )
    carried = [c for c in facts.columns if c not in ("page_id", "pos")]
    swept = _swept(facts, F.lit(True), *carried)
    above = lambda flag: F.sum(F.col("delta") * F.col(flag).cast("int")).over(_so_far()) - F.when(F.col("delta") == 1, F.col(flag).cast("int")).otherwise(0)
    swept = swept.withColumns({"in_units": above("unit"), "in_shut": above("shut"), "in_tables": above("table")})
    # a closed element closes by what stands above where it opens; that is the same where it ends
    swept = swept.withColumn("closes", F.col("closed") & (F.col("in_units") > 0)).withColumn("in_closed", above("closes"))
    # cells belong to the outermost table around them
    outer = F.last(F.when((F.col("delta") == 1) & F.col("table") & (F.col("in_tables") == 0), F.col("pos")), ignorenulls=True).over(_so_far())
    swept = swept.withColumn("outer", outer).where("delta = 1")
    cells = swept.where("cell and in_tables > 0").groupBy("page_id", F.col("outer").alias("pos")).agg(F.count("*").alias("cells"), F.max("words").alias("any_words"))
    met = swept.where("in_shut = 0 and in_closed = 0").join(cells, ["page_id", "pos"], "left")
    block = (F.col("unit") & ~(F.col("rule.yields") & (F.col("in_units") > 0))) | (F.col("table") & F.coalesce("any_words", F.lit(False)))
    blocks = met.where(block).withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1)
    return blocks.select("page_id", "ord", "pos", F.when(F.col("table"), "table").otherwise("text").alias("kind"), F.col("rule.name").alias("rule"), "tag", "text", F.when(F.col("table"), F.col("cells")).alias("cells"))

"""Queries whose results depend on a sequential algorithm within a page, document or service; tests check them by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctide.operators import sequences as S
from doctide.operators.blocks import Rule, extracted
from doctide.plans.layout import items
from doctide.plans.register import Plans
from doctide.sources.html import html_nodes as nodes
from doctide.sources.tables import epoch_ms, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
#: Steps of the alignment of one page; what is left past them stays unpaired and is told by `stopped`.
MOST_STEPS = 1 << 26


@P.query()
def html_nodes(spark, sf_dir):
    """Every node of every page with its interval in document order."""
    return nodes(table(spark, sf_dir, "pages"))


@P.query()
def html_text(spark, sf_dir):
    """Text nodes outside script and style."""
    n = nodes(table(spark, sf_dir, "pages"))
    parents = n.where(F.col("tag").isin("script", "style")).select("page_id", F.col("pos").alias("parent"))
    return n.where("tag = '#text'").join(parents, ["page_id", "parent"], "left_anti").select("page_id", "pos", "text")


#: How the given pages are read: what is skipped, what makes a block, and what a block holds whole.
PAGE_RULES = [
    Rule("script", "skip", tag="script"), Rule("style", "skip", tag="style"), Rule("table", "table", tag="table"), Rule("title", "unit", tag="title"), Rule("heading", "unit", tag="h1"),
    Rule("paragraph", "unit", tag="p"), Rule("item", "unit", tag="li"), Rule("footer", "unit", tag="footer"), Rule("note", "unit", tag="div", cls="ad", yields=True),
    Rule("code", "protect", tag="pre"), Rule("picture", "protect", tag="svg", descend=True, closed=True),
]


@P.query()
def extract_blocks(spark, sf_dir):
    """Blocks of each page in document order, with what each rule skips, closes or gives way."""
    return extracted(nodes(table(spark, sf_dir, "pages")), PAGE_RULES)


def _streams(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("code", F.concat("face", F.col("size").cast("string")))
    return (i.where(F.col("style") == s).select("page", "gid", "code") for s in "FO")


@P.query()
def lcs_align(spark, sf_dir):
    """Two streams of items of each page aligned by a longest common subsequence, and whether its bound of work stopped it."""
    a, b = _streams(spark, sf_dir)
    return S.aligned(a, b, "page", "gid", "code", MOST_STEPS)


@P.query()
def gap_align(spark, sf_dir):
    """What an alignment leaves between matched neighbours."""
    a, b = _streams(spark, sf_dir)
    return S.gaps(S.aligned(a, b, "page", "gid", "code"), "page")


def _turns(c, units):
    """(key, a, b): the units of each turn in order, and those of the turn before, where there are both; turns of one key are one."""
    key = lambda turn: F.concat_ws("/", "conv_id", turn).alias("key")
    none = F.lit(None).cast("array<string>")
    sides = c.select(key("turn"), units.alias("a"), none.alias("b")).unionByName(c.select(key(F.col("turn") + 1), none.alias("a"), units.alias("b")))
    placed = lambda every: F.array_sort(F.flatten(F.transform(every, lambda one: F.transform(one, lambda u, i: F.struct(i.alias("i"), u.alias("u"))))))
    merged = lambda every: F.when(F.size(every) > 1, F.transform(placed(every), lambda x: x["u"])).otherwise(F.get(every, F.lit(0)))
    both = sides.groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    return both.select("key", merged("a").alias("a"), merged("b").alias("b"))


@P.query()
def doc_align(spark, sf_dir):
    """Turns of a conversation aligned word by word with the turn before, and how much of them matches."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    met = _turns(c, F.split("text", r"\s+")).select("key", S.common(F.col("a"), F.col("b")).alias("met"))
    # a filter would be moved below the alignment and align once more
    matched = F.size("met.a").cast("long")
    return met.select("key", F.explode(F.when(matched > 0, F.array(matched))).alias("matched"))


@P.query()
def hunk_class(spark, sf_dir):
    """What an alignment of a turn with the turn before leaves between matched words, by how both sides are spelled."""
    c = table(spark, sf_dir, "conversations").where("text is not null and conv_id is not null and turn is not null")
    # a hyphen at a line's end is a unit of its own
    units = F.regexp_extract_all("text", F.lit(r"[-\u2010\u00ad](?=\n)|(?:(?![-\u2010\u00ad]\n)\S)+"), F.lit(0))
    met = _turns(c, units).withColumn("met", S.common(F.col("a"), F.col("b")))
    marked = lambda side: F.transform(side, lambda u: F.struct(u.alias("unit"), u.isin(*S.HYPHENS).alias("line_end"))).alias(side)
    return S.hunks_of(met.select("key", marked("a"), marked("b"), "met"), "key")


@P.query()
def merge_boxes(spark, sf_dir):
    """Lines of each page merged into boxes."""
    i = items(spark, sf_dir).select("page", "x0", "x1", (F.col("y") - F.col("size")).alias("y0"), (F.col("y") + F.col("size")).alias("y1"), (F.col("gid") % 10 / 10).alias("confidence"))
    return S.merge_boxes(i, "page")


@P.query()
def cut_lines(spark, sf_dir):
    """Items of each page cut into lines by an evolving baseline."""
    return S.cut_lines(items(spark, sf_dir), "page", "gid")


@P.query()
def breaker_states(spark, sf_dir):
    """The circuit of each service after each outcome."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), epoch_ms("ts").alias("t"), "event_id", F.col("event_type").isin("error", "view", "signup").alias("failed"))
    return S.breaker_states(e, "service", "t", "event_id", "failed")


@P.query()
def words_on_page(spark, sf_dir):
    """Words of each page's title placed on its heading, letter by letter; a word counts only if its letters stay together."""
    part = lambda tag: F.regexp_extract("html", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    p = table(spark, sf_dir, "pages").select("page_id", part("title").alias("a"), part("h1").alias("b"))
    letters = lambda c: p.select("page_id", F.posexplode(F.split(c, "")).alias("pos", "letter"))
    words = p.select("page_id", F.posexplode(F.regexp_extract_all("a", F.lit(r"\S+"), F.lit(0))).alias("ord", "word"), "a")
    before = F.array_join(F.slice(F.regexp_extract_all("a", F.lit(r"\S+\s*"), F.lit(0)), 1, F.col("ord")), "")
    placed = words.select("page_id", "ord", "word", F.length(before).alias("first"), (F.length(before) + F.length("word")).alias("end"))
    pairs = S.aligned(letters("a"), letters("b"), "page_id", "pos", "letter")
    on = placed.join(pairs, "page_id").where("a_pos >= first and a_pos < end").groupBy("page_id", "ord", "word").agg(F.count("*").alias("n"), F.min("b_pos").alias("b_first"), F.max("b_pos").alias("b_last"))
    return on.where((F.col("n") == F.length("word")) & (F.col("b_last") - F.col("b_first") + 1 == F.col("n"))).select("page_id", "ord", "word", "b_first")

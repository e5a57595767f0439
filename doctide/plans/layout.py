"""Layout and alignment over items on pages: the lines of orders stand for glyphs, suppliers for pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doctide.operators.ranges import islands, merged_stretches, points_in_boxes
from doctide.operators.ties import tied
from doctide.plans.register import Plans
from doctide.sources.tables import table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle


def items(spark, sf_dir):
    """Items with a page, a box, a size and a face: one for each line of an order."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")))
    x0 = (F.col("l_partkey") % 600).cast("double")
    return g.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gid"), F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("unit"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"),
        (F.floor(F.col("l_extendedprice") / 100) % 800).cast("double").alias("y"), (F.col("l_linenumber") + 8).alias("size"), F.col("l_returnflag").alias("face"), F.col("l_linestatus").alias("style"),
    )


ITEMS = """items AS (SELECT l_orderkey * 10 + l_linenumber AS gid, max(l_suppkey) AS page, l_orderkey AS unit, CAST(max(l_partkey) % 600 AS DOUBLE) AS x0, max(l_partkey) % 600 + max(l_quantity) AS x1,
 CAST(CAST(floor(max(l_extendedprice) / 100) AS BIGINT) % 800 AS DOUBLE) AS y, CAST(l_linenumber + 8 AS INTEGER) AS size, max(l_returnflag) AS face, max(l_linestatus) AS style FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def boxes(spark, sf_dir):
    """Link boxes: one for each part that a supplier's page has, as large as its size and number make it."""
    on = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("link")).distinct()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("link"), (F.col("p_size") * 10).cast("double").alias("bx0"), (F.col("p_partkey") % 12 * 60).cast("double").alias("by0"))
    return on.join(p, "link").select("page", "link", "bx0", (F.col("bx0") + 90).alias("bx1"), "by0", (F.col("by0") + 70).alias("by1"))


BOXES = "boxes AS (SELECT page, link, CAST(p_size * 10 AS DOUBLE) AS bx0, p_size * 10 + 90.0::DOUBLE AS bx1, CAST(link % 12 * 60 AS DOUBLE) AS by0, link % 12 * 60 + 70.0::DOUBLE AS by1 FROM (SELECT DISTINCT l_suppkey AS page, l_partkey AS link FROM lineitem) JOIN part ON p_partkey = link)"
WITH = f"WITH {ITEMS}, {BOXES}"
_IN = "i.page = b.page AND i.x0 > b.bx0 AND i.x0 < b.bx1 AND i.y > b.by0 AND i.y < b.by1"


def _inside(spark, sf_dir):
    points = items(spark, sf_dir).select("page", "gid", "unit", "face", F.col("x0").alias("x"), "y")
    return points_in_boxes(points, boxes(spark, sf_dir), ["page"])


@P.query(f"{WITH}, j AS (SELECT i.page, link, face, count(*) AS n FROM items i JOIN boxes b ON {_IN} GROUP BY ALL), t AS (SELECT page, link, sum(n) AS total FROM j GROUP BY ALL) SELECT j.page, j.link, j.face AS owner FROM j JOIN t USING (page, link) WHERE 2 * n > total")
def link_owner(spark, sf_dir):
    """Owner of each link: the face that most of the points inside it have."""
    j = _inside(spark, sf_dir).groupBy("page", "link", "face").agg(F.count("*").alias("n"))
    t = j.groupBy("page", "link").agg(F.sum("n").alias("total"))
    return j.join(t, ["page", "link"]).where("2 * n > total").select("page", "link", F.col("face").alias("owner"))


@P.query(f"{WITH} SELECT b.page, b.link, (SELECT min(i.gid) FROM items i WHERE i.page = b.page AND (b.bx0 + b.bx1) / 2 > i.x0 AND (b.bx0 + b.bx1) / 2 < i.x1 AND i.y > b.by0 AND i.y < b.by1) AS owner FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM items i WHERE {_IN})")
def link_owner_centre(spark, sf_dir):
    """Of links without a point inside, the first item over their centre."""
    b = boxes(spark, sf_dir)
    alone = b.join(_inside(spark, sf_dir).select("page", "link").distinct(), ["page", "link"], "left_anti")
    mid = (F.col("bx0") + F.col("bx1")) / 2
    over = alone.alias("b").join(items(spark, sf_dir).alias("i"), F.expr("b.page = i.page and (bx0 + bx1) / 2 > x0 and (bx0 + bx1) / 2 < x1 and y > by0 and y < by1"))
    first = over.groupBy("b.page", "link").agg(F.min("gid").alias("owner"))
    return alone.withColumn("mid", mid).join(first, ["page", "link"], "left").select("page", "link", "owner")


@P.query(f"{WITH} SELECT i.page, link, bool_and(i.face = 'N') AS whole, count(*) AS n FROM items i JOIN boxes b ON {_IN} GROUP BY ALL")
def covers_all(spark, sf_dir):
    return _inside(spark, sf_dir).groupBy("page", "link").agg(F.bool_and(F.col("face") == "N").alias("whole"), F.count("*").alias("n"))


@P.query(f"{WITH} SELECT page, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, count(*) AS n FROM items GROUP BY page")
def table_hull(spark, sf_dir):
    return items(spark, sf_dir).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


@P.query(f"{WITH} SELECT gid, least(x0, x1) AS left_, greatest(x0, x1) AS right_, least(y, y - size) AS top, greatest(y, y + size) AS bottom FROM items")
def quad_bounds(spark, sf_dir):
    """Bounding box of four corners."""
    xs, ys = F.array("x0", "x1", "x1", "x0"), F.array(F.col("y") - F.col("size"), F.col("y") - F.col("size"), F.col("y") + F.col("size"), F.col("y") + F.col("size"))
    return items(spark, sf_dir).select("gid", F.array_min(xs).alias("left_"), F.array_max(xs).alias("right_"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"))


@P.query(f"{WITH} SELECT gid, floor(x0 / 650 * 100000 + 0.5) / 100000 AS fx, floor(y / 800 * 100 + 0.5) / 100 AS fy FROM items")
def normalise_xy(spark, sf_dir):
    half_up = lambda v, k: F.floor(v * k + 0.5) / k
    return items(spark, sf_dir).select("gid", half_up(F.col("x0") / 650, 100_000).alias("fx"), half_up(F.col("y") / 800, 100).alias("fy"))


@P.query(f"{WITH} SELECT gid, round(sqrt(x0 * x0 + y * y), 6) AS size, round(atan2(y, x0), 6) AS angle, round(x0 * cos(atan2(y, x0)) + y * sin(atan2(y, x0)), 6) AS along FROM items WHERE x0 > 0")
def affine_axes(spark, sf_dir):
    angle = F.atan2("y", "x0")
    return items(spark, sf_dir).where("x0 > 0").select("gid", F.round(F.hypot("x0", "y"), 6).alias("size"), F.round(angle, 6).alias("angle"), F.round(F.col("x0") * F.cos(angle) + F.col("y") * F.sin(angle), 6).alias("along"))


@P.query(f"{WITH} SELECT page, count(*) FILTER (x1 > 600) AS off, bool_or(x1 > 600) AS any_off FROM items GROUP BY page")
def offpage(spark, sf_dir):
    return items(spark, sf_dir).groupBy("page").agg(F.count_if(F.col("x1") > 600).alias("off"), F.bool_or(F.col("x1") > 600).alias("any_off"))


@P.query(f"{WITH}, c AS (SELECT unit, size, count(*) AS n FROM items GROUP BY ALL) SELECT unit, size FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, size DESC) rn FROM c) WHERE rn = 1")
def mode_tie_high(spark, sf_dir):
    c = items(spark, sf_dir).groupBy("unit", "size").agg(F.count("*").alias("n"))
    return c.groupBy("unit").agg(F.max(F.struct("n", "size")).alias("m")).select("unit", "m.size")


@P.query(f"{WITH}, c AS (SELECT page, face, count(*) AS n, min(gid) AS first_ FROM items GROUP BY ALL) SELECT page, face FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, first_) rn FROM c) WHERE rn = 1")
def mode_tie_first(spark, sf_dir):
    c = items(spark, sf_dir).groupBy("page", "face").agg(F.count("*").alias("n"), F.min("gid").alias("first_"))
    return c.groupBy("page").agg(F.max_by("face", F.struct("n", -F.col("first_"))).alias("face"))


@P.query(f"{WITH} SELECT unit, list_sort(list(x1))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM items GROUP BY unit")
def upper_median(spark, sf_dir):
    """The middle value, the upper of two."""
    xs = F.array_sort(F.collect_list("x1"))
    return items(spark, sf_dir).groupBy("unit").agg(F.element_at(xs, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"))


@P.query(f"{WITH} SELECT page, round(quantile_cont(x1, 0.5), 6) AS p50, round(quantile_cont(x1, 0.95), 6) AS p95, max(x1) - min(x1) AS spread FROM items GROUP BY page")
def perf_stats(spark, sf_dir):
    return items(spark, sf_dir).groupBy("page").agg(F.round(F.percentile("x1", 0.5), 6).alias("p50"), F.round(F.percentile("x1", 0.95), 6).alias("p95"), (F.max("x1") - F.min("x1")).alias("spread"))


@P.query(f"""{WITH}, s AS (SELECT page, style, quantile_cont(x1 - x0, 0.5) AS m, (max(x1 - x0) - min(x1 - x0)) / 20 AS w FROM items GROUP BY ALL)
             SELECT a.page, round(a.m - b.m, 6) AS change, abs(a.m - b.m) > a.w + b.w AS differs FROM s a JOIN s b ON a.page = b.page AND a.style = 'F' AND b.style = 'O'""")
def perf_compare(spark, sf_dir):
    """Whether the medians of two sides differ by more than their spreads (a twentieth of each) together."""
    wide = F.col("x1") - F.col("x0")
    s = items(spark, sf_dir).groupBy("page", "style").agg(F.percentile(wide, 0.5).alias("m"), ((F.max(wide) - F.min(wide)) / 20).alias("w"))
    a, b = (s.where(F.col("style") == x).select("page", F.col("m").alias(f"m{x}"), F.col("w").alias(f"w{x}")) for x in "FO")
    return a.join(b, "page").select("page", F.round(F.col("mF") - F.col("mO"), 6).alias("change"), (F.abs(F.col("mF") - F.col("mO")) > F.col("wF") + F.col("wO")).alias("differs"))


@P.query(f"{WITH} SELECT unit, min(x0) AS x0, max(x1) AS x1 FROM items GROUP BY unit HAVING count(*) >= 2 AND max(abs(x0 - 300)) <= 290")
def column_box(spark, sf_dir):
    """Hull of columns with at least two entries, all near their anchor."""
    g = items(spark, sf_dir).groupBy("unit").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"), F.bool_and(F.abs(F.col("x0") - 300) <= 290).alias("near"))
    return g.where("n >= 2 and near").select("unit", "x0", "x1")


@P.query(f"{WITH} SELECT unit, CASE WHEN max(x0) - min(x0) <= 50 THEN 'l' WHEN max(x1) - min(x1) <= 50 THEN 'r' WHEN max(x0 + x1) - min(x0 + x1) <= 100 THEN 'c' END AS align FROM items GROUP BY unit")
def cell_align(spark, sf_dir):
    spread = lambda c: F.max(c) - F.min(c)
    align = F.when(spread("x0") <= 50, "l").when(spread("x1") <= 50, "r").when(spread(F.col("x0") + F.col("x1")) <= 100, "c")
    return items(spark, sf_dir).groupBy("unit").agg(align.alias("align"))


@P.query("SELECT p_brand AS face, sum(p_size) AS glyphs FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24".replace("sum(p_size)", "CAST(sum(p_size) AS BIGINT)"))
def top_faces(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("face")).agg(F.sum("p_size").alias("glyphs"))
    return g.orderBy(F.desc("glyphs"), "face").limit(24)


@P.query(f"{WITH} SELECT unit, max_by(gid, x1 * 1e10 - gid) AS gid FROM items WHERE x0 > 10 GROUP BY unit")
def pick_best(spark, sf_dir):
    """The reading of highest confidence, the first of equal ones; empty ones do not count."""
    return items(spark, sf_dir).where("x0 > 10").groupBy("unit").agg(F.max_by("gid", F.struct("x1", -F.col("gid"))).alias("gid"))


@P.query(f"{WITH}, k AS (SELECT page, CASE WHEN size = 9 THEN 'h' WHEN x1 - x0 > 40 THEN concat('c', CAST(floor(x0 / 100) AS INTEGER), '+2') ELSE concat('c', CAST(floor(x0 / 100) AS INTEGER)) END AS key FROM items) SELECT page, key, count(*) AS n FROM k GROUP BY ALL")
def table_groups(spark, sf_dir):
    """Cells grouped by header, column, or column and span."""
    col = F.floor(F.col("x0") / 100).cast("string")
    key = F.when(F.col("size") == 9, "h").when(F.col("x1") - F.col("x0") > 40, F.concat(F.lit("c"), col, F.lit("+2"))).otherwise(F.concat(F.lit("c"), col))
    return items(spark, sf_dir).groupBy("page", key.alias("key")).agg(F.count("*").alias("n"))


@P.query(f"{WITH} SELECT page, least(greatest(list_sort(list(x1 - x0))[CAST(floor(count(*) / 2) AS INTEGER) + 1], 24.0), 27.0) AS lead FROM items WHERE size < 14 GROUP BY page HAVING count(*) >= 2")
def clamped_median(spark, sf_dir):
    m = F.element_at(F.array_sort(F.collect_list(F.col("x1") - F.col("x0"))), (F.floor(F.count("*") / 2) + 1).cast("int"))
    g = items(spark, sf_dir).where("size < 14").groupBy("page").agg(m.alias("m"), F.count("*").alias("n"))
    return g.where("n >= 2").select("page", F.least(F.greatest("m", F.lit(24.0)), F.lit(27.0)).alias("lead"))


_TIES = f"""WITH RECURSIVE {ITEMS}, t AS (SELECT 'unit ' || unit AS tie, gid FROM items UNION ALL SELECT 'row ' || page || ' ' || y::BIGINT, gid FROM items),
ties AS MATERIALIZED (SELECT tie, gid FROM t QUALIFY count(*) OVER (PARTITION BY tie) > 1),
m AS MATERIALIZED (SELECT gid, x1 - x0 AS own, size::DOUBLE AS floor_, page AS first_ FROM items),
r AS (
  SELECT gid, own AS scale, 0 AS round FROM m
  UNION ALL
  SELECT gid, min(least(scale, cap)), round + 1 FROM (
    SELECT gid, scale, round, CASE WHEN tie IS NULL THEN scale ELSE greatest(floor_, least(min(scale) OVER w, min(CASE WHEN later THEN own END) OVER (PARTITION BY tie, round ORDER BY first_ RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))) END AS cap
    FROM (SELECT r.*, own, floor_, first_, tie, true AS later FROM r JOIN m USING (gid) LEFT JOIN ties USING (gid)) WINDOW w AS (PARTITION BY tie, round ORDER BY first_ RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  ) WHERE round < 40 GROUP BY gid, round
) SELECT gid, scale AS cap FROM r WHERE round = 40"""


@P.query(_TIES)
def tie_caps(spark, sf_dir):
    """Widths of items tied within their unit and within their row of a page, lowered until nothing changes."""
    i = items(spark, sf_dir)
    m = i.select(F.col("gid").alias("member"), (F.col("x1") - F.col("x0")).alias("own"), F.col("size").cast("double").alias("floor"), F.col("page").alias("first"))
    unit = F.concat(F.lit("unit "), F.col("unit").cast("string"))
    row = F.concat_ws(" ", F.lit("row"), F.col("page").cast("string"), F.col("y").cast("long").cast("string"))
    t = i.select(F.explode(F.array(unit, row)).alias("tie"), F.col("gid").alias("member"))
    return tied(m, t).select(F.col("member").alias("gid"), F.col("scale").alias("cap"))


@P.query(f"{WITH} SELECT face, style, count(*) AS n FROM items WHERE x1 > 600 OR y > 790 GROUP BY ALL")
def cause_counts(spark, sf_dir):
    return items(spark, sf_dir).where("x1 > 600 or y > 790").groupBy("face", "style").agg(F.count("*").alias("n"))


@P.query(f"{WITH}, d AS (SELECT DISTINCT page, CAST(y AS BIGINT) AS v FROM items), g AS (SELECT page, v, v - row_number() OVER (PARTITION BY page ORDER BY v) AS k FROM d) SELECT page, min(v) AS first_, max(v) AS last_, count(*) AS n FROM g GROUP BY page, k")
def page_stretches(spark, sf_dir):
    """Consecutive numbers joined into stretches."""
    d = items(spark, sf_dir).select("page", F.col("y").cast("long").alias("v")).distinct()
    k = d.withColumn("k", F.col("v") - F.row_number().over(Window.partitionBy("page").orderBy("v")))
    return k.groupBy("page", "k").agg(F.min("v").alias("first_"), F.max("v").alias("last_"), F.count("*").alias("n")).drop("k")


@P.query(f"""{WITH}, b AS (SELECT page, y - size AS low, y + size AS high FROM items), m AS (SELECT *, max(high) OVER (PARTITION BY page ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
             p AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS part FROM m) SELECT page, min(low) AS low, max(high) AS high, count(*) AS n FROM p GROUP BY page, part""")
def interval_merge(spark, sf_dir):
    """Bands of items that overlap."""
    b = items(spark, sf_dir).select("page", (F.col("y") - F.col("size")).alias("low"), (F.col("y") + F.col("size")).alias("high"))
    return merged_stretches(b, ["page"], "low", "high")


_BLOCK = "CASE WHEN lag(y) OVER w IS NULL OR y - lag(y) OVER w > 1.75 * size OR x0 > lag(x1) OVER w OR x1 < lag(x0) OVER w THEN 1 ELSE 0 END"


@P.query(f"{WITH}, s AS (SELECT *, {_BLOCK} AS s FROM items WINDOW w AS (PARTITION BY page ORDER BY y, gid)), b AS (SELECT page, gid, sum(s) OVER (PARTITION BY page ORDER BY y, gid ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT page, CAST(run AS BIGINT) AS run, min(gid) AS first_, count(*) AS n FROM b GROUP BY page, run")
def line_blocks(spark, sf_dir):
    """Lines stacked into blocks while they follow closely and overlap sideways."""
    w = Window.partitionBy("page").orderBy("y", "gid")
    before = lambda c: F.lag(c).over(w)
    breaks = before("y").isNull() | (F.col("y") - before("y") > 1.75 * F.col("size")) | (F.col("x0") > before("x1")) | (F.col("x1") < before("x0"))
    marked = items(spark, sf_dir).withColumn("_b", breaks)
    return islands(marked, ["page"], ["y", "gid"], F.col("_b")).groupBy("page", "run").agg(F.min("gid").alias("first_"), F.count("*").alias("n"))


@P.query(f"{WITH}, s AS (SELECT *, CASE WHEN lag(unit) OVER w IS NULL OR unit - lag(unit) OVER w > 3 THEN 1 ELSE 0 END AS s FROM items WINDOW w AS (PARTITION BY page ORDER BY unit, gid)), b AS (SELECT page, gid, unit, sum(s) OVER (PARTITION BY page ORDER BY unit, gid ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT page, CAST(run AS BIGINT) AS run, min(unit) AS first_, max(unit) AS last_ FROM b GROUP BY page, run")
def flow_chains(spark, sf_dir):
    """Members chained while each shares a line with the one before."""
    w = Window.partitionBy("page").orderBy("unit", "gid")
    before = F.lag("unit").over(w)
    marked = items(spark, sf_dir).withColumn("_b", before.isNull() | (F.col("unit") - before > 3))
    return islands(marked, ["page"], ["unit", "gid"], F.col("_b")).groupBy("page", "run").agg(F.min("unit").alias("first_"), F.max("unit").alias("last_"))


@P.query(f"{WITH}, r AS (SELECT page, gid, CASE WHEN face = 'N' THEN -1 WHEN abs(y - 400) < 20 THEN 0 WHEN y >= 400 THEN 1 + (y - 400) ELSE 1 + 2 * (400 - y) END AS rank FROM items) SELECT page, gid, rank, row_number() OVER (PARTITION BY page ORDER BY rank, gid) AS place FROM r")
def reading_rank(spark, sf_dir):
    """Items by distance from the reading place: names first, then near ones, ahead before behind."""
    d = F.col("y") - 400
    rank = F.when(F.col("face") == "N", -1.0).when(F.abs(d) < 20, 0.0).when(d >= 0, 1 + d).otherwise(1 - 2 * d)
    w = Window.partitionBy("page").orderBy("rank", "gid")
    return items(spark, sf_dir).select("page", "gid", rank.alias("rank")).withColumn("place", F.row_number().over(w).cast("long"))


@P.query("SELECT user_id, event_type, max(event_id) AS seq, rank() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS place FROM events GROUP BY user_id, event_type")
def urgent_order(spark, sf_dir):
    """Entries by their latest call."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("seq"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("seq"))).cast("long"))


@P.query(f"{WITH}, a2 AS (SELECT page, CAST(x0 AS BIGINT) // 20 AS k, min(gid) AS gid FROM items WHERE style = 'F' AND size = 9 GROUP BY ALL HAVING count(*) = 1), b2 AS (SELECT page, CAST(x0 AS BIGINT) // 20 AS k, min(gid) AS gid FROM items WHERE style = 'O' AND size = 9 GROUP BY ALL HAVING count(*) = 1) SELECT a2.page, a2.gid AS a_gid, b2.gid AS b_gid FROM a2 JOIN b2 ON a2.page = b2.page AND a2.k = b2.k")
def unique_match(spark, sf_dir):
    """Pairs whose key occurs exactly once on either side, within a page."""
    def once(style, name):
        i = items(spark, sf_dir).where((F.col("style") == style) & (F.col("size") == 9))
        return i.groupBy("page", F.floor(F.col("x0") / 20).alias("k")).agg(F.min("gid").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    return once("F", "a_gid").join(once("O", "b_gid"), ["page", "k"]).select("page", "a_gid", "b_gid")


@P.query(f"""{WITH}, n AS (SELECT page, gid, lag(face) OVER w AS p, lead(face) OVER w AS q, style FROM items WINDOW w AS (PARTITION BY page ORDER BY gid)), s AS (SELECT page, p, q, style, gid, row_number() OVER (PARTITION BY page, p, q, style ORDER BY gid) AS j, count(*) OVER (PARTITION BY page, p, q, style) AS c FROM n WHERE p IS NOT NULL AND q IS NOT NULL)
             SELECT a.page, a.gid AS a_gid, b.gid AS b_gid FROM s a JOIN s b ON a.page = b.page AND a.p = b.p AND a.q = b.q AND a.j = b.j AND a.c = b.c AND a.style = 'F' AND b.style = 'O'""")
def slot_join(spark, sf_dir):
    """The j-th item between the same neighbours on both sides, where both have equally many."""
    w = Window.partitionBy("page").orderBy("gid")
    n = items(spark, sf_dir).select("page", "gid", "style", F.lag("face").over(w).alias("p"), F.lead("face").over(w).alias("q")).where("p is not null and q is not null")
    slot = Window.partitionBy("page", "p", "q", "style")
    s = n.withColumn("j", F.row_number().over(slot.orderBy("gid"))).withColumn("c", F.count("*").over(slot))
    a, b = (s.where(F.col("style") == x).drop("style").withColumnRenamed("gid", name) for x, name in (("F", "a_gid"), ("O", "b_gid")))
    return a.join(b, ["page", "p", "q", "j", "c"]).select("page", "a_gid", "b_gid")


@P.query("""WITH f AS (SELECT l_suppkey AS flow, l_partkey % 50 AS page, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL), a AS (SELECT page, flow, 1 AS prio FROM f WHERE first_line = 1), b AS (SELECT DISTINCT g.page, f.flow, 2 AS prio FROM f JOIN f g ON f.flow = g.flow + 1 WHERE g.first_line = 1),
            u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT page, flow, CAST(min(prio) AS INTEGER) AS prio FROM u GROUP BY ALL""")
def page_closure(spark, sf_dir):
    """Flows a page takes: its own, then those tied to them; one hop only."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("flow"), (F.col("l_partkey") % 50).alias("page")).agg(F.min("l_linenumber").alias("first_line"))
    own = f.where("first_line = 1").select("page", "flow")
    tied = own.select("page", (F.col("flow") + 1).alias("flow")).join(f.select("flow").distinct(), "flow", "left_semi").select("page", "flow")
    both = own.withColumn("prio", F.lit(1)).unionByName(tied.withColumn("prio", F.lit(2)))
    return both.groupBy("page", "flow").agg(F.min("prio").alias("prio"))


@P.query("SELECT a.l_orderkey AS unit, a.l_suppkey AS page, b.l_suppkey AS other, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL")
def links_across(spark, sf_dir):
    """Members of one unit on different pages."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("page"))
    return li.join(li.withColumnRenamed("page", "other"), "unit").where("page <> other").groupBy("unit", "page", "other").agg(F.count("*").alias("n"))


@P.query(f"{WITH} SELECT (SELECT count(*) FROM items) AS glyphs, count(*) AS owned, count(DISTINCT gid) = count(*) AS once FROM (SELECT i.gid, min(b.link) AS owner FROM items i JOIN boxes b ON {_IN} GROUP BY i.gid)")
def ownership_once(spark, sf_dir):
    """Every item has at most one owner: the first link that it lies in."""
    owned = _inside(spark, sf_dir).groupBy("gid").agg(F.min("link").alias("owner"))
    sums = owned.agg(F.count("*").alias("owned"), (F.count_distinct("gid") == F.count("*")).alias("once"))
    return items(spark, sf_dir).agg(F.count("*").alias("glyphs")).join(F.broadcast(sums), F.lit(True))


@P.query(f"{WITH} SELECT unit, bool_and(x1 <= 600 AND y > 5) AS located, count(*) AS n FROM items GROUP BY unit")
def located_units(spark, sf_dir):
    """A unit is located if all of its items have a partner."""
    return items(spark, sf_dir).groupBy("unit").agg(F.bool_and((F.col("x1") <= 600) & (F.col("y") > 5)).alias("located"), F.count("*").alias("n"))


@P.query(f"""{WITH}, c AS (SELECT page, count(*) FILTER (x1 < 302) AS l, count(*) FILTER (x0 > 298) AS r FROM items GROUP BY page) SELECT gid, CAST(CASE WHEN l >= 3 AND r >= 3 THEN CASE WHEN x1 < 302 THEN 0 WHEN x0 > 298 THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS col FROM items JOIN c USING (page)""")
def line_columns(spark, sf_dir):
    """Column of each line on pages of two columns: left, right, or across both."""
    i = items(spark, sf_dir)
    c = i.groupBy("page").agg(F.count_if(F.col("x1") < 302).alias("l"), F.count_if(F.col("x0") > 298).alias("r"))
    col = F.when((F.col("l") >= 3) & (F.col("r") >= 3), F.when(F.col("x1") < 302, 0).when(F.col("x0") > 298, 1).otherwise(2)).otherwise(0)
    return i.join(c, "page").select("gid", col.alias("col"))


@P.query(f"{WITH}, n AS (SELECT gid, y, lead(y) OVER (PARTITION BY page, CAST(floor(x0 / 50) AS BIGINT) ORDER BY y, gid) AS below FROM items) SELECT gid, coalesce(below - y, 800 - y) AS room FROM n")
def rooms_below(spark, sf_dir):
    """Room below each item: to the next one of its strip, else to the page's end."""
    w = Window.partitionBy("page", F.floor(F.col("x0") / 50)).orderBy("y", "gid")
    return items(spark, sf_dir).select("gid", F.coalesce(F.lead("y").over(w) - F.col("y"), 800 - F.col("y")).alias("room"))


@P.query(f"{WITH} SELECT a.gid FROM items a WHERE EXISTS (SELECT 1 FROM items b WHERE a.page = b.page AND a.gid < b.gid AND abs(a.y - b.y) < 4 AND a.size = b.size)")
def shares_band(spark, sf_dir):
    """Items that share a band with a later one of their size."""
    i = items(spark, sf_dir).select("page", "gid", "y", "size")
    near = i.select("page", "size", F.explode(F.array(F.floor(F.col("y") / 4) - 1, F.floor(F.col("y") / 4), F.floor(F.col("y") / 4) + 1)).alias("band"), F.col("gid").alias("other"), F.col("y").alias("oy"))
    both = i.withColumn("band", F.floor(F.col("y") / 4)).join(near, ["page", "size", "band"]).where((F.col("gid") < F.col("other")) & (F.abs(F.col("y") - F.col("oy")) < 4))
    return both.select("gid").distinct()


@P.query(f"{WITH}, s AS (SELECT page, gid, face, x0, x1, CASE WHEN lag(face) OVER w IS DISTINCT FROM face THEN 1 ELSE 0 END AS s FROM items WINDOW w AS (PARTITION BY page ORDER BY gid)), r AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY gid ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT page, CAST(run AS BIGINT) AS run, min(face) AS face, min(x0) AS x0, max(x1) AS x1 FROM r GROUP BY page, run")
def sentence_rows(spark, sf_dir):
    """Boxes of consecutive items of one face."""
    w = Window.partitionBy("page").orderBy("gid")
    marked = items(spark, sf_dir).withColumn("_b", ~F.lag("face").over(w).eqNullSafe(F.col("face")))
    return islands(marked, ["page"], ["gid"], F.col("_b")).groupBy("page", "run").agg(F.min("face").alias("face"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@P.query(f"{WITH}, s AS (SELECT *, sum(x1 - x0) OVER (PARTITION BY page ORDER BY abs(y - 400), gid ROWS UNBOUNDED PRECEDING) AS run FROM items) SELECT page, gid FROM s WHERE run > 3000")
def evict_farthest(spark, sf_dir):
    """What goes when the items nearest the reading place fill the budget."""
    w = Window.partitionBy("page").orderBy(F.abs(F.col("y") - 400), "gid").rowsBetween(Window.unboundedPreceding, 0)
    return items(spark, sf_dir).withColumn("run", F.sum(F.col("x1") - F.col("x0")).over(w)).where("run > 3000").select("page", "gid")


@P.query(f"{WITH}, e AS (SELECT page, x0, y, lead(x0) OVER w AS nx, lead(y) OVER w AS ny FROM items WINDOW w AS (PARTITION BY page ORDER BY gid)) SELECT page, count(*) AS crossings, count(*) % 2 = 1 AS inside FROM e WHERE (y > 400.5) <> (ny > 400.5) AND x0 + (400.5 - y) / (ny - y) * (nx - x0) > 300 GROUP BY page")
def point_in_polygon(spark, sf_dir):
    """Whether a page's middle lies inside the path through its items: an odd number of crossings to its right."""
    w = Window.partitionBy("page").orderBy("gid")
    e = items(spark, sf_dir).select("page", "x0", "y", F.lead("x0").over(w).alias("nx"), F.lead("y").over(w).alias("ny")).where((F.col("y") > 400.5) != (F.col("ny") > 400.5))
    right = F.col("x0") + (400.5 - F.col("y")) / (F.col("ny") - F.col("y")) * (F.col("nx") - F.col("x0")) > 300
    return e.where(right).groupBy("page").agg(F.count("*").alias("crossings")).select("page", "crossings", (F.col("crossings") % 2 == 1).alias("inside"))


@P.query(f"{WITH} SELECT i.gid, c.c_name AS owner FROM items i JOIN orders o ON i.unit = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey")
def carry_owner(spark, sf_dir):
    """Owners carried to items through the mapping of their units."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("owner"))
    return items(spark, sf_dir).select("gid", "unit").join(o, "unit").join(c, "c_custkey").select("gid", "owner")


@P.query("SELECT l_orderkey, l_linenumber, [10, 20, 30][least(l_linenumber, 3)] AS measure FROM lineitem")
def line_shape(spark, sf_dir):
    """Measures by line; the last one holds for all further lines."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, (10, 20, 30))), F.least("l_linenumber", F.lit(3))).alias("measure"))


@P.query("""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'sans' WHEN p_type = 'LARGE' THEN 'mono' ELSE 'serif' END AS class, CASE WHEN p_size > 40 THEN 700 ELSE 400 END AS weight, p_name LIKE '%ring%' AS slanted FROM part""")
def font_class(spark, sf_dir):
    cls = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "sans").when(F.col("p_type") == "LARGE", "mono").otherwise("serif")
    return table(spark, sf_dir, "part").select("p_partkey", cls.alias("class"), F.when(F.col("p_size") > 40, 700).otherwise(400).alias("weight"), F.col("p_name").contains("ring").alias("slanted"))


@P.query("""WITH w AS (SELECT p_brand, p_partkey, p_size * 20 AS wt FROM part) SELECT p_brand, min_by(p_partkey, (CASE WHEN wt <= 500 THEN 0 ELSE 1 END) * 1e12 + abs(wt - 500) * 1e7 + p_partkey) AS face FROM w GROUP BY 1""")
def nearest_weight(spark, sf_dir):
    """The face whose weight fits 500 best: lighter ones before heavier, then the nearest, then the first."""
    w = table(spark, sf_dir, "part").withColumn("wt", F.col("p_size") * 20)
    return w.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.when(F.col("wt") <= 500, 0).otherwise(1), F.abs(F.col("wt") - 500), F.col("p_partkey"))).alias("face"))


@P.query(f"{WITH}, l AS (SELECT CASE WHEN x1 > 600 THEN 'off' WHEN y < 20 THEN 'head' WHEN y > 780 THEN 'foot' WHEN x1 - x0 < 5 THEN 'mark' ELSE 'body' END AS class FROM items) SELECT class, count(*) AS n FROM l GROUP BY 1")
def ledger_totals(spark, sf_dir):
    """Every item in exactly one class, by the first rule that fits."""
    cls = F.when(F.col("x1") > 600, "off").when(F.col("y") < 20, "head").when(F.col("y") > 780, "foot").when(F.col("x1") - F.col("x0") < 5, "mark").otherwise("body")
    return items(spark, sf_dir).groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@P.query(f"""{WITH}, p AS (SELECT page, sha256(string_agg(concat(CAST(CAST(x0 AS BIGINT) AS VARCHAR), face), ',' ORDER BY gid)) AS digest FROM items WHERE style = 'F' GROUP BY page), q AS (SELECT page, sha256(string_agg(concat(CAST(CAST(x0 AS BIGINT) AS VARCHAR), face), ',' ORDER BY gid)) AS digest FROM items WHERE style = CASE WHEN page % 2 = 0 THEN 'F' ELSE 'O' END GROUP BY page)
             SELECT p.page, p.digest = q.digest AS same FROM p JOIN q ON p.page = q.page""")
def page_identity(spark, sf_dir):
    """Pages of two documents that are equal item for item, found by digest before anything is aligned."""
    def digests(i, name):
        parts = F.array_sort(F.collect_list(F.struct("gid", F.concat(F.col("x0").cast("long").cast("string"), "face").alias("s"))))
        return i.groupBy("page").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), ","), 256).alias(name))

    i = items(spark, sf_dir)
    return digests(i.where("style = 'F'"), "p").join(digests(i.where("style = if(page % 2 = 0, 'F', 'O')"), "q"), "page").select("page", (F.col("p") == F.col("q")).alias("same"))


@P.query(f"""{WITH}, a AS (SELECT face, page, gid, row_number() OVER (PARTITION BY page, face ORDER BY gid) AS k, count(*) OVER (PARTITION BY page, face) AS n FROM items WHERE style = 'F'), b AS (SELECT face, page, gid, row_number() OVER (PARTITION BY page, face ORDER BY gid) AS k, count(*) OVER (PARTITION BY page, face) AS n FROM items WHERE style = 'O')
             SELECT a.page, a.face, a.gid AS lost, b.gid AS free FROM a JOIN b ON a.page = b.page AND a.face = b.face AND a.n = b.n AND a.k = b.k""")
def ordinal_place(spark, sf_dir):
    """The k-th lost group takes the k-th free place, if both sides have equally many."""
    w = Window.partitionBy("page", "face")
    n = items(spark, sf_dir).withColumn("n", F.count("*").over(w.partitionBy("page", "face", "style"))).withColumn("k", F.row_number().over(Window.partitionBy("page", "face", "style").orderBy("gid")))
    a, b = (n.where(F.col("style") == x).select("page", "face", "n", "k", F.col("gid").alias(name)) for x, name in (("F", "lost"), ("O", "free")))
    return a.join(b, ["page", "face", "n", "k"]).select("page", "face", "lost", "free")

"""Batching, windows of bounded size, and what else walks a sequence in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doctide.functions import nested as N
from doctide.operators.batches import batched, debounced, first_fit
from doctide.operators.stores import reusable
from doctide.operators.walks import reached
from doctide.plans.layout import ITEMS, items
from doctide.plans.register import Plans
from doctide.sources.tables import LINES, WORDS, epoch_ms, lines, table, words

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle


def fold_sql(source: str, keys: str, order: str, size: str, most: str, items_: int, cut: str = "false") -> str:
    """The same fold as a recursive query: one step for each place of all keys at once."""
    return f"""WITH RECURSIVE {source}, m AS (SELECT {keys} AS k, {order} AS o, CAST({size} AS BIGINT) AS s, {cut} AS c, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM src),
 f AS (SELECT k, o, s, rn, 0 AS b, 1 AS n, s AS t FROM m WHERE rn = 1
       UNION ALL SELECT m.k, m.o, m.s, m.rn, CASE WHEN f.t + m.s > {most} OR f.n >= {items_} OR m.c THEN f.b + 1 ELSE f.b END, CASE WHEN f.t + m.s > {most} OR f.n >= {items_} OR m.c THEN 1 ELSE f.n + 1 END,
                        CASE WHEN f.t + m.s > {most} OR f.n >= {items_} OR m.c THEN m.s ELSE f.t + m.s END FROM f JOIN m ON m.k = f.k AND m.rn = f.rn + 1)"""


@P.query(fold_sql(f"{LINES}, src AS (SELECT doc_id, pos, line FROM lines)", "doc_id", "pos", "length(line)", "2000", 8, "length(line) < 40") + " SELECT k AS doc_id, o AS pos, b AS batch FROM f")
def plan_batches(spark, sf_dir):
    """Lines in batches of 2,000 characters and eight lines; a heading starts a new one."""
    return batched(lines(spark, sf_dir), ["doc_id"], ["pos"], F.length("line"), 2_000, 8, cut=F.length("line") < 40)


@P.query(fold_sql(f"{LINES}, src AS (SELECT doc_id, pos, line FROM lines)", "doc_id", "pos", "length(line)", "CASE WHEN f.b = 0 THEN 500 ELSE 2400 END", 1_000_000) + " SELECT k AS doc_id, o AS pos, b AS batch FROM f")
def call_batches(spark, sf_dir):
    """A small first batch, then larger ones."""
    return batched(lines(spark, sf_dir), ["doc_id"], ["pos"], F.length("line"), 2_400, 1_000_000, first=500)


@P.query(fold_sql("src AS (SELECT conv_id, turn, text FROM conversations)", "conv_id", "turn", "3 * length(text)", "1800", 1_000_000) + " SELECT k AS conv_id, o AS turn, b AS batch FROM f")
def unit_windows(spark, sf_dir):
    """Windows bounded by an estimate of the size written, three times the length."""
    return batched(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3 * F.length("text"), 1_800, 1_000_000)


@P.query(f"""WITH RECURSIVE {ITEMS}, m AS (SELECT unit, gid, CAST(x1 - x0 AS BIGINT) AS s, row_number() OVER (PARTITION BY unit ORDER BY face, gid) AS rn FROM items),
 f AS (SELECT unit, rn, s, [s] AS held, [1] AS n, CAST(1 AS BIGINT) AS place FROM m WHERE rn = 1
       UNION ALL SELECT unit, rn, s, CASE WHEN p IS NULL THEN list_append(held, s) ELSE list_transform(held, lambda x, i: CASE WHEN i = p THEN x + s ELSE x END) END,
                        CASE WHEN p IS NULL THEN list_append(n, 1) ELSE list_transform(n, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END) END, coalesce(p, len(held) + 1)
       FROM (SELECT m.unit, m.rn, m.s, f.held, f.n, (SELECT min(i) FROM (SELECT unnest(f.held) AS h, unnest(f.n) AS k, unnest(range(1, len(f.held) + 1)) AS i) WHERE h + m.s <= 60 AND k < 3) AS p FROM f JOIN m ON m.unit = f.unit AND m.rn = f.rn + 1))
 SELECT unit, CAST(place - 1 AS INTEGER) AS batch, count(*) AS n, CAST(sum(s) AS BIGINT) AS size FROM f GROUP BY ALL""")
def pack_requests(spark, sf_dir):
    """Requests by unit, most urgent first: at most three items and 60 wide, what is too wide passed over, an oversize item alone."""
    b = first_fit(items(spark, sf_dir), ["unit"], ["face", "gid"], F.col("x1") - F.col("x0"), 60, 3)
    return b.groupBy("unit", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@P.query("""WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, sum(length(p_name)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS s FROM part WHERE length(p_name) > 8) SELECT p_partkey FROM r WHERE n <= 60 AND s <= 600""")
def glossary_limits(spark, sf_dir):
    """Valid terms of each glossary until one of its limits is reached."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    r = table(spark, sf_dir, "part").where(F.length("p_name") > 8).withColumn("n", F.row_number().over(w)).withColumn("s", F.sum(F.length("p_name")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where("n <= 60 and s <= 600").select("p_partkey")


@P.query("""WITH n AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
            d AS (SELECT *, CASE WHEN c <= 4 THEN 0 ELSE CAST(ceil(log2(c / 4)) AS INTEGER) END AS depth FROM n) SELECT k, id, CAST(depth AS INTEGER) AS depth, CAST(i * (1 << depth) // c AS BIGINT) AS leaf FROM d""")
def halving(spark, sf_dir):
    """Requests too large (over four) halved until they fit: the depth and the part of each member."""
    n = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    n = n.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1).withColumn("c", F.count("*").over(Window.partitionBy("k")))
    depth = F.when(F.col("c") <= 4, 0).otherwise(F.length(F.bin(F.ceil(F.col("c") / 4) - 1)))  # halvings until four are left
    return n.withColumn("depth", depth).select("k", "id", "depth", F.floor(F.col("i") * F.pow(F.lit(2), F.col("depth")) / F.col("c")).alias("leaf"))


@P.query("""SELECT text, source_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, pos) rn FROM (SELECT n_name AS text, 1 AS source_rank, CAST(n_nationkey AS BIGINT) AS pos FROM nation
            UNION ALL SELECT p_name, 2, p_partkey FROM part UNION ALL SELECT p_type, 3, p_partkey FROM part)) WHERE rn = 1""")
def union_first(spark, sf_dir):
    """Three sources united; of equal texts the first in order of source and place."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("text"), F.lit(1).alias("source_rank"), F.col("n_nationkey").cast("long").alias("pos"))
    p = table(spark, sf_dir, "part")
    a, b = (p.select(F.col(c).alias("text"), F.lit(k).alias("source_rank"), F.col("p_partkey").alias("pos")) for c, k in (("p_name", 2), ("p_type", 3)))
    first = F.min(F.struct("source_rank", "pos"))
    return n.unionByName(a).unionByName(b).groupBy("text").agg(first.alias("f")).select("text", "f.source_rank", "f.pos")


@P.query(f"WITH {LINES}, " + r"h AS (SELECT doc_id, pos, line, 1 + len(regexp_extract_all(line, '[,;]')) AS depth FROM lines WHERE length(line) < 60), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM h) SELECT doc_id, pos, CAST(depth AS INTEGER) AS depth FROM r WHERE k <= 3")
def contents_headings(spark, sf_dir):
    """Headings of the three smallest depths that a document uses."""
    h = lines(spark, sf_dir).where(F.length("line") < 60).select("doc_id", "pos", (F.regexp_count("line", F.lit("[,;]")) + 1).cast("int").alias("depth"))
    return h.withColumn("k", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("depth"))).where("k <= 3").drop("k")


@P.query(f"WITH {ITEMS} SELECT o.o_orderkey AS unit, i.page, i.gid FROM orders o LEFT JOIN items i ON i.unit = o.o_orderkey AND i.face = 'R'")
def contents_occurrences(spark, sf_dir):
    """A row for each placement of a heading, and one without page where it has none."""
    i = items(spark, sf_dir).where("face = 'R'").select("unit", "page", "gid")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit")).join(i, "unit", "left")


@P.query(f"WITH {ITEMS}, a AS (SELECT unit, min(page) AS p FROM items WHERE face = 'R' GROUP BY 1), b AS (SELECT unit, min(page) AS p FROM items GROUP BY 1) SELECT o_orderkey AS unit, coalesce(a.p, b.p, o_custkey % 100) AS page FROM orders LEFT JOIN a ON a.unit = o_orderkey LEFT JOIN b ON b.unit = o_orderkey")
def contents_page(spark, sf_dir):
    """The first page known: of the placement, of any item, of the outline."""
    g = items(spark, sf_dir).groupBy("unit").agg(F.min(F.when(F.col("face") == "R", F.col("page"))).alias("a"), F.min("page").alias("b"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_custkey") % 100).alias("c"))
    return o.join(g, "unit", "left").select("unit", F.coalesce("a", "b", "c").alias("page"))


@P.query(f"WITH {WORDS}, o AS (SELECT doc_id, pos, ord, word, sum(length(word) + 1) OVER (PARTITION BY doc_id, pos ORDER BY ord ROWS UNBOUNDED PRECEDING) - length(word) - 1 AS off FROM words) SELECT doc_id, pos, min(ord) AS first_ord FROM o WHERE off >= 50 GROUP BY ALL")
def first_word_at(spark, sf_dir):
    """The first word at or after offset 50 of each line."""
    w = Window.partitionBy("doc_id", "pos").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0))
    return words(spark, sf_dir).withColumn("off", off).where("off >= 50").groupBy("doc_id", "pos").agg(F.min("ord").alias("first_ord"))


@P.query(f"WITH {WORDS} SELECT doc_id, pos, min(ord) FILTER (ord > 0 AND regexp_matches(word, '^\\p{{Lu}}')) AS start_ord, min_by(word, ord) FILTER (ord > 0 AND regexp_matches(word, '^\\p{{Lu}}')) AS word FROM words GROUP BY ALL")
def sentence_first_word(spark, sf_dir):
    """The first word of the second sentence of a line: the first capital after its first word."""
    start = (F.col("ord") > 0) & F.col("word").rlike(r"^\p{Lu}")
    return words(spark, sf_dir).groupBy("doc_id", "pos").agg(F.min(F.when(start, F.col("ord"))).alias("start_ord"), F.min_by(F.when(start, F.col("word")), F.when(start, F.col("ord"))).alias("word"))


@P.query(f"WITH {LINES}, s AS (SELECT doc_id, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS end_ FROM lines) SELECT doc_id, min(pos) AS pos FROM s WHERE end_ > 300 GROUP BY doc_id")
def sentence_at(spark, sf_dir):
    """The part of each document that holds offset 300."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines(spark, sf_dir).withColumn("end_", F.sum(F.length("line") + 1).over(w)).where("end_ > 300").groupBy("doc_id").agg(F.min("pos").alias("pos"))


@P.query(f"WITH {WORDS}, s AS (SELECT w.doc_id, w.pos, w.ord FROM words w JOIN (SELECT doc_id, pos, min(ord) AS a, max(ord) AS b FROM words WHERE regexp_matches(word, '[0-9]') GROUP BY ALL) t USING (doc_id, pos) WHERE w.ord BETWEEN a AND b) SELECT doc_id, pos, count(*) AS n FROM s GROUP BY ALL")
def span_lookup(spark, sf_dir):
    """Words within the span from the first to the last digit of a line."""
    w = words(spark, sf_dir)
    t = w.where(F.col("word").rlike("[0-9]")).groupBy("doc_id", "pos").agg(F.min("ord").alias("a"), F.max("ord").alias("b"))
    return w.join(t, ["doc_id", "pos"]).where("ord between a and b").groupBy("doc_id", "pos").agg(F.count("*").alias("n"))


@P.query(f"WITH {WORDS}, c AS (SELECT doc_id, unicode(word) AS cp FROM words) SELECT doc_id, count(*) FILTER (cp < 128) AS ascii, count(*) FILTER (cp BETWEEN 192 AND 255) AS latin1, bool_and(cp < 384) AS drawable FROM c GROUP BY doc_id")
def cp_ranges(spark, sf_dir):
    """First code points of words by range, and whether a face of Latin letters can draw them all."""
    cp = F.conv(F.hex(F.encode(F.substring("word", 1, 1), "UTF-32")), 16, 10).cast("long")
    c = words(spark, sf_dir).select("doc_id", cp.alias("cp"))
    return c.groupBy("doc_id").agg(F.count_if(F.col("cp") < 128).alias("ascii"), F.count_if(F.col("cp").between(192, 255)).alias("latin1"), F.bool_and(F.col("cp") < 384).alias("drawable"))


@P.query(f"WITH {LINES} " + r"SELECT doc_id, pos, regexp_matches(line, '^[\x20-\x7EÀ-ſ]*$') AS can FROM lines")
def can_draw(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", F.col("line").rlike(r"^[\x20-\x7EÀ-ſ]*$").alias("can"))


def _held_sql(t: str, from_end: bool) -> str:
    """Whether the bracket at an edge of t has its pair: some stretch from that edge holds as many of both."""
    part = f"substr({t}, k)" if from_end else f"left({t}, k)"
    edge = f"right({t}, 1)" if from_end else f"left({t}, 1)"
    equal = lambda a, b: f"({edge} = '{b if from_end else a}' AND len(list_filter(range(1, length({t}) + 1), lambda k: length(replace({part}, '{a}', '')) = length(replace({part}, '{b}', '')) AND contains({part}, '{a}'))) > 0)"
    return "(" + " OR ".join(equal(a, b) for a, b in N.PAIRS) + ")"


_EDGE_SQL = rf"""WITH RECURSIVE {WORDS}, d AS (SELECT word, count(*) AS n FROM words GROUP BY word),
e AS (SELECT word, word AS t, 0 AS step, true AS more FROM d UNION ALL
  SELECT word, CASE WHEN m THEN left(t, length(t) - 1) ELSE t END, step + 1, m FROM (SELECT *, t <> '' AND (regexp_matches(right(t, 1), '[.,;:!?''"`\p{{Pf}}]') OR regexp_matches(right(t, 1), '\p{{Pe}}') AND NOT {_held_sql("t", True)}) AS m FROM e WHERE more)),
s AS (SELECT word, min_by(t, length(t)) AS t, 0 AS step, true AS more FROM e GROUP BY word UNION ALL
  SELECT word, CASE WHEN m THEN substr(t, 2) ELSE t END, step + 1, m FROM (SELECT *, t <> '' AND (regexp_matches(left(t, 1), '[''"`\p{{Pi}}]') OR regexp_matches(left(t, 1), '\p{{Ps}}') AND NOT {_held_sql("t", False)}) AS m FROM s WHERE more))
SELECT word, n, min_by(t, length(t)) AS bare FROM s JOIN d USING (word) GROUP BY word, n"""


@P.query(_EDGE_SQL)
def edge_mark(spark, sf_dir):
    """Each distinct word without the marks at its edges, how often it stands; brackets with their pair inside stay."""
    w = words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", "n", N.bare(F.col("word")).alias("bare"))


@P.query("SELECT user_id % 20 AS site, event_type AS doc, count(*) AS n, min_by(props, event_id) AS reason FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL")
def warning_sites(spark, sf_dir):
    """Warnings by site with the first reason."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view"))
    return e.groupBy((F.col("user_id") % 20).alias("site"), F.col("event_type").alias("doc")).agg(F.count("*").alias("n"), F.min_by("props", "event_id").alias("reason"))


@P.query("""SELECT event_id, CASE WHEN v > 90 THEN 'downgrade' WHEN v < 5 THEN 'unreadable' WHEN v < 22 THEN 'migrated' ELSE 'current' END AS reason, CAST(CASE WHEN v BETWEEN 5 AND 21 THEN 22 - v ELSE 0 END AS BIGINT) AS steps FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS v FROM events)""")
def migrate_reason(spark, sf_dir):
    """What becomes of a stored configuration of each version."""
    v = F.get_json_object("props", "$.k").cast("long")
    reason = F.when(v > 90, "downgrade").when(v < 5, "unreadable").when(v < 22, "migrated").otherwise("current")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"), F.when(v.between(5, 21), 22 - v).otherwise(0).alias("steps"))


@P.query("SELECT p_partkey, coalesce(n.n_name, 'none') AS class FROM part LEFT JOIN nation n ON n.n_nationkey = p_size")
def content_class(spark, sf_dir):
    """Class of each unit by a small dimension table, total."""
    n = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_size"), "n_name"))
    return table(spark, sf_dir, "part").join(n, "p_size", "left").select("p_partkey", F.coalesce("n_name", F.lit("none")).alias("class"))


@P.query("""WITH g AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS a, max(o_orderkey) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) SELECT o.o_orderkey FROM orders o JOIN g USING (o_custkey) WHERE o.o_orderkey BETWEEN a AND b""")
def author_block(spark, sf_dir):
    """What stands from the first to the last marked row of each sequence."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    g = o.groupBy("o_custkey").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return o.join(g, "o_custkey").where("o_orderkey between a and b").select("o_orderkey")


@P.query("SELECT p_brand, max_by(p_partkey, (CASE WHEN p_name LIKE 'red%' THEN 2 WHEN p_name LIKE '%ring' THEN 1 ELSE 0 END) * 1e12 + p_size * 1e9 - p_partkey) AS main FROM part GROUP BY 1")
def main_file(spark, sf_dir):
    """The best scored member: declared, then likely, then large, then first."""
    score = F.when(F.col("p_name").startswith("red"), 2).when(F.col("p_name").endswith("ring"), 1).otherwise(0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(score, F.col("p_size"), -F.col("p_partkey"))).alias("main"))


@P.query("""WITH last_ AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1),
r AS (SELECT o.o_custkey AS unit, o.o_orderstatus <> 'P' AS ok, o.o_orderpriority AS service FROM orders o JOIN last_ USING (o_custkey, o_orderkey)),
p AS (SELECT o_custkey AS unit, o_orderpriority AS service, bool_and(o_orderstatus = 'F') AS refused FROM orders ANTI JOIN last_ USING (o_custkey, o_orderkey) GROUP BY ALL)
SELECT unit, service AS "by", ok AND (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority AS service FROM orders) s WHERE s.service < r.service) = (SELECT count(*) FROM p WHERE p.unit = r.unit AND p.refused AND p.service < r.service) AS reusable FROM r""")
def row_reusable(spark, sf_dir):
    """Whether the last order of each customer may be used again: priorities are services in order, earlier orders their passes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("service"))
    last = o.groupBy("unit").agg(F.max("o_orderkey").alias("o_orderkey"))
    results = o.join(last, ["unit", "o_orderkey"]).select("unit", (F.col("o_orderstatus") != "P").alias("ok"), F.col("service").alias("by"))
    passes = o.join(last, ["unit", "o_orderkey"], "left_anti").select("unit", F.lit(None).cast("string").alias("part"), "service", F.when(F.col("o_orderstatus") == "F", "refused").otherwise("unreached").alias("why"))
    services = o.select("service").distinct().withColumn("rank", F.row_number().over(Window.orderBy("service")) - 1)
    return reusable(results, passes, services)


@P.query("SELECT p_partkey, coalesce(map {'ECONOMY': true, 'SMALL': false}[p_type], true) AS shown FROM part")
def kind_shown(spark, sf_dir):
    """Visibility by kind, shown unless switched off."""
    on = F.create_map(F.lit("ECONOMY"), F.lit(True), F.lit("SMALL"), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(on, F.col("p_type")), F.lit(True)).alias("shown"))


@P.query("SELECT p_partkey, p_type NOT IN ('ECONOMY', 'PROMO') AS by_sentence FROM part")
def by_sentence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (~F.col("p_type").isin("ECONOMY", "PROMO")).alias("by_sentence"))


@P.query("SELECT p_partkey, floor(p_retailprice / 25 + 1e-9) * 25 AS price FROM part")
def quantize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.floor(F.col("p_retailprice") / 25 + 1e-9) * 25).cast("double").alias("price"))


@P.query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7 + s_nationkey) % (SELECT count(*) FROM supplier) AS b FROM supplier), r AS (SELECT 0 AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT s_suppkey AS node, s_suppkey NOT IN (SELECT node FROM r) AS dead FROM supplier""")
def reachability(spark, sf_dir):
    """Nodes that a walk from node 0 reaches, however far away, and those it does not."""
    s = table(spark, sf_dir, "supplier")
    n = F.broadcast(s.agg(F.count("*").alias("total")))
    edges = s.join(n, F.lit(True)).selectExpr("s_suppkey as a", "(s_suppkey * 7 + s_nationkey) % total as b")
    walk = reached(edges, spark.range(1).select(F.col("id").alias("node")))
    return s.select(F.col("s_suppkey").alias("node")).join(walk.withColumn("hit", F.lit(True)), "node", "left").select("node", F.col("hit").isNull().alias("dead"))


@P.query("""WITH RECURSIVE s AS (SELECT user_id, event_type, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events)),
            f AS (SELECT user_id, event_type, t, rn, t AS first FROM s WHERE rn = 1 UNION ALL
                  SELECT s.user_id, s.event_type, s.t, s.rn, CASE WHEN s.t >= least(f.t + 1800000, f.first + 3600000) THEN s.t ELSE f.first END FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
            SELECT user_id, first, count(*) AS n, least(max(t) + 1800000, first + 3600000) AS fires, CASE WHEN bool_or(event_type = 'error') THEN 'full' ELSE string_agg(DISTINCT event_type, ',' ORDER BY event_type) END AS items FROM f GROUP BY user_id, first""")
def coalesce_sessions(spark, sf_dir):
    """Bursts of events that fire half an hour after the last, an hour after the first at the latest: their kinds, or `full` if an error asks for all."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", epoch_ms("ts").alias("t"))
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    g = debounced(e, "user_id", "t", "event_id", 1_800_000, 3_600_000).groupBy("user_id", "first", "fires")
    return g.agg(F.count("*").alias("n"), F.when(F.bool_or(F.col("event_type") == "error"), "full").otherwise(kinds).alias("items"))


@P.query("""WITH r AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS t FROM events) SELECT a.event_id, min(b.event_id) AS shares FROM r a JOIN r b ON a.key = b.key AND b.t <= a.t AND b.t > a.t - 600000 GROUP BY 1""")
def inflight_share(spark, sf_dir):
    """The earliest request of the same key that still runs (ten minutes) when another arrives; its own if none does."""
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-599_999, 0)
    r = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_ms("ts").alias("t"))
    return r.select("event_id", F.min("event_id").over(w).alias("shares"))

"""Units and their pieces: identity, names, wires, runs between elements, and what follows from their order."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from doctide.functions import nested as N
from doctide.functions.text import escape_text, token_kind
from doctide.operators import glyphs as G
from doctide.operators.glyphs import placed_cells
from doctide.operators.hyphens import break_points, syllable_patterns
from doctide.operators.mentions import mentions
from doctide.operators.ranges import islands
from doctide.plans.layout import ITEMS, items
from doctide.plans.register import Plans
from doctide.plans.text import _KIND, _TOKENS, tokens
from doctide.sources.tables import LINES, WORDS, lines, table, words

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
_UNIT = "CASE WHEN length(line) < 40 THEN 'title' WHEN contains(line, ' | ') THEN 'table' ELSE 'para' END"


def units(spark, sf_dir):
    kind = F.when(F.length("line") < 40, "title").when(F.contains("line", F.lit(" | ")), "table").otherwise("para")
    return lines(spark, sf_dir).withColumn("kind", kind)


@P.query(f"WITH {LINES} SELECT sha256(concat({_UNIT}, '|', line)) AS unit_id, {_UNIT} AS kind, count(*) AS n, min(doc_id) AS first_doc FROM lines GROUP BY ALL")
def unit_in(spark, sf_dir):
    """Units by content alone: equal kind and content, equal id."""
    u = units(spark, sf_dir)
    return u.groupBy(F.sha2(F.concat("kind", F.lit("|"), "line"), 256).alias("unit_id"), "kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@P.query(f"WITH {LINES} SELECT doc_id, sha256(string_agg(concat({_UNIT}, ':', line), chr(10) ORDER BY pos)) AS digest FROM lines GROUP BY doc_id")
def asked_digest(spark, sf_dir):
    """Digest of all that is asked of a document, in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat("kind", F.lit(":"), "line").alias("s"))))
    return units(spark, sf_dir).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), "\n"), 256).alias("digest"))


@P.query(f"WITH {LINES}, b AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^[A-Za-z]') THEN lower(regexp_extract(line, '^([A-Za-z]+)', 1)) ELSE 'axt' END AS base FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS k FROM b) SELECT doc_id, pos, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k) END AS id FROM r")
def assign_ids(spark, sf_dir):
    """Ids unique within a document: a unit's own base, later ones numbered."""
    base = F.when(F.col("line").rlike("^[A-Za-z]"), F.lower(F.regexp_extract("line", "^([A-Za-z]+)", 1))).otherwise("axt")
    k = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("pos"))
    r = lines(spark, sf_dir).select("doc_id", "pos", base.alias("base")).withColumn("k", k)
    return r.select("doc_id", "pos", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("id"))


_STRIP = r"regexp_replace(word, '^[(\[{]+|[)\]}.,;:]+$', '', 'g')"


@P.query(f"WITH {WORDS} SELECT doc_id, {_STRIP} AS tag, count(*) AS n FROM words WHERE regexp_matches({_STRIP}, '^[A-Z][A-Za-z]+[0-9]*$') AND NOT regexp_matches({_STRIP}, '^[IVXLCDM]+$') GROUP BY ALL")
def named_tag(spark, sf_dir):
    """Names of tags, brackets aside and Roman numbers excepted."""
    bare = F.regexp_replace("word", r"^[(\[{]+|[)\]}.,;:]+$", "")
    w = words(spark, sf_dir).select("doc_id", bare.alias("tag"))
    return w.where(F.col("tag").rlike("^[A-Z][A-Za-z]+[0-9]*$") & ~F.col("tag").rlike("^[IVXLCDM]+$")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@P.query(f"WITH {WORDS} SELECT doc_id, pos, CASE WHEN bool_and(({_KIND}) <> 'word') THEN 'words' WHEN bool_and(regexp_matches(word, '^\\p{{Lu}}')) THEN 'paperNames' END AS reason FROM words GROUP BY ALL")
def kept_reason(spark, sf_dir):
    """Why a line is kept as written: it holds no word, or names only."""
    reason = F.when(F.bool_and(token_kind(F.col("word")) != "word"), "words").when(F.bool_and(F.col("word").rlike(r"^\p{Lu}")), "paperNames")
    return words(spark, sf_dir).groupBy("doc_id", "pos").agg(reason.alias("reason"))


@P.query(f"WITH {WORDS}, low AS (SELECT DISTINCT word FROM words WHERE regexp_matches(word, '^\\p{{Ll}}{{2,}}$')), l AS (SELECT w.doc_id, w.pos, count(*) AS n, bool_and(length(w.word) <= 1 OR regexp_matches(w.word, '[0-9]') OR (regexp_matches(w.word, '\\p{{Lu}}') AND low.word IS NULL)) AS ok FROM words w LEFT JOIN low ON low.word = lower(w.word) GROUP BY ALL) SELECT doc_id, pos, ok AS name FROM l WHERE n <= 3")
def name_test(spark, sf_dir):
    """Lines of up to three words that are names: one letter, a digit, or a capital and nowhere in lower case."""
    w = words(spark, sf_dir)
    low = w.where(F.col("word").rlike(r"^\p{Ll}{2,}$")).select(F.col("word").alias("low")).distinct()
    both = w.withColumn("low_", F.lower("word")).join(low, F.col("low_") == F.col("low"), "left")
    ok = (F.length("word") <= 1) | F.col("word").rlike("[0-9]") | (F.col("word").rlike(r"\p{Lu}") & F.col("low").isNull())
    return both.groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.bool_and(ok).alias("name")).where("n <= 3").select("doc_id", "pos", "name")


_NAME = r"^(\p{Lu}\p{Ll}{3,}(?: \p{L}+){0,2})\.?$"
_NAMES_SQL = rf"""
WITH {LINES}, names AS (SELECT DISTINCT regexp_extract(line, '{_NAME}', 1) AS name FROM lines WHERE pos = 0 AND regexp_matches(line, '{_NAME}')),
t AS (SELECT doc_id, pos, regexp_replace(line, '[\s\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ' ', 'g') AS s FROM lines WHERE pos > 0),
n AS (SELECT doc_id, pos, s, name, unnest(range(length(s) - length(name) + 1)) AS k FROM t JOIN names ON contains(s, name)),
h AS (SELECT doc_id, pos, k, length(name) AS n, name FROM n WHERE substr(s, k + 1, length(name)) = name
  AND NOT regexp_matches(substr(s, k, CASE WHEN k = 0 THEN 0 ELSE 1 END), '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substr(s, k + length(name) + 1, 1), '[\p{{L}}\p{{N}}]')),
g AS (SELECT doc_id, pos, list_reduce(list([{{'name': name, 'k': k, 'n': n}}] ORDER BY n DESC, k, name),
  lambda taken, x: CASE WHEN len(list_filter(taken, lambda y: y.k < x[1].k + x[1].n AND x[1].k < y.k + y.n)) = 0 THEN taken || x ELSE taken END) AS taken FROM h GROUP BY ALL)
SELECT doc_id, pos, t.name, t.k::INTEGER AS at, t.n::INTEGER AS n FROM (SELECT doc_id, pos, unnest(taken) AS t FROM g)
"""


@P.query(_NAMES_SQL)
def name_mentions(spark, sf_dir):
    """Names of up to three words that are a document's first line, where they occur in later lines of any, the longest first."""
    line = lines(spark, sf_dir)
    first = line.where(F.col("pos") == 0).select(F.regexp_extract("line", _NAME, 1).alias("name")).where("name <> ''").distinct()
    return mentions(line.where("pos > 0").select("doc_id", "pos", "line"), ["doc_id", "pos"], "line", first)


@P.query("SELECT doc_id, replace(translate(replace(text, concat(chr(10), chr(10)), concat(chr(1), ' ')), concat(chr(10), chr(9), chr(13)), '   '), chr(1), chr(10)) AS text FROM documents")
def running_ws(spark, sf_dir):
    """White space blanked in place; a paragraph's break keeps its first newline, and every offset stays."""
    marked = F.translate(F.replace(F.col("text"), F.lit("\n\n"), F.lit("\x01 ")), "\n\t\r", "   ")
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(marked, F.lit("\x01"), F.lit("\n")).alias("text"))


@P.query(f"WITH {LINES} " + r"SELECT doc_id, pos, length(regexp_extract(line, '^([^.]{1,60}\.\s+)\p{Lu}', 1)) AS opens FROM lines WHERE regexp_matches(line, '^[^.]{1,60}\.\s+\p{Lu}')")
def opens_after(spark, sf_dir):
    """Where the running text opens after a run-in title of up to 60 characters."""
    line = lines(spark, sf_dir).where(F.col("line").rlike(r"^[^.]{1,60}\.\s+\p{Lu}"))
    return line.select("doc_id", "pos", F.length(F.regexp_extract("line", r"^([^.]{1,60}\.\s+)\p{Lu}", 1)).cast("long").alias("opens"))


@P.query(f"WITH {LINES}, " + r"""p AS (SELECT doc_id, pos, unnest(range(len(ps))) AS sentence, unnest(ps) AS piece FROM (SELECT doc_id, pos, regexp_extract_all(line, '(?s).+?(?:[.!?]+\s+|\z)') AS ps FROM lines)),
             q AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, pos ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, bool_and(regexp_matches(piece, '[\p{L}\p{N}]')) OVER (PARTITION BY doc_id, pos) AS ok FROM p)
             SELECT doc_id, pos, CAST(sentence AS INTEGER) AS sentence, CAST(base + length(regexp_extract(piece, '(?s)^(.*?)[\p{Ps}\p{Pi}]*[\p{L}\p{N}]', 1)) AS BIGINT) AS start FROM q WHERE ok""")
def starts_in_projection(spark, sf_dir):
    """Where each sentence of a line starts: at its first letter or digit, or the opening marks set against it.

    All or nothing: a line with a sentence that has neither gives no row.
    """
    pieces = F.regexp_extract_all("line", F.lit(r"(?s).+?(?:[.!?]+\s+|\z)"), F.lit(0))
    p = lines(spark, sf_dir).select("doc_id", "pos", pieces.alias("ps")).where(F.forall("ps", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    start = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<bigint>").alias("out"))
    before = lambda x: F.length(F.regexp_extract(x, r"(?s)^(.*?)[\p{Ps}\p{Pi}]*[\p{L}\p{N}]", 1))
    fold = F.aggregate("ps", start, lambda s, x: F.struct((s["base"] + F.length(x)).alias("base"), F.concat(s["out"], F.array(s["base"] + before(x))).alias("out")), lambda s: s["out"])
    return p.select("doc_id", "pos", F.posexplode(fold).alias("sentence", "start"))


_APART = r"regexp_replace({}, '(\p{{P}})(\p{{P}})', concat('\1', chr(1), '\2'), 'g')"


@P.query(f"WITH {LINES}, c AS (SELECT doc_id, pos, string_split({_APART.format(_APART.format('line'))}, chr(1)) AS parts FROM lines) SELECT doc_id, pos, CAST(unnest(range(len(parts))) AS INTEGER) AS part, unnest(parts) AS run FROM c")
def split_punct(spark, sf_dir):
    """Runs of each line, parted wherever one punctuation mark follows another."""
    apart = F.regexp_replace("line", r"(\p{P})(?=\p{P})", "$1\x01")
    return lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.split(apart, "\x01")).alias("part", "run"))


def _swapped(column: str, rules) -> str:
    for pattern, new in rules:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


@P.query(f"WITH {LINES} SELECT doc_id, pos, trim({_swapped('t', N.TEX_AFTER)}) AS plain FROM (SELECT doc_id, pos, list_reduce(list_prepend({_swapped('line', N.TEX_BEFORE)}, list_transform(string_split(regexp_replace(line, '[^{{]', '', 'g'), ''), lambda c: c)), lambda t, c: {_swapped('t', N.TEX_INNER)}) AS t FROM lines)")
def tex_plain(spark, sf_dir):
    """Each line read as TeX: groups from the innermost out, scripts and fractions spelled, commands dropped."""
    return lines(spark, sf_dir).select("doc_id", "pos", N.tex_plain(F.col("line")).alias("plain"))


_ESC = "replace(replace(replace(replace(token, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_TOUCHES = r"[\p{L}\p{N}\p{M}]"
_WIRE_SQL = rf"""k AS (SELECT page_id, ord, token, token LIKE '<%' AS el, sum(CASE WHEN token LIKE '<%' THEN 1 ELSE 0 END) OVER w AS slot,
  token LIKE '<%' AND coalesce(lag(token) OVER w NOT LIKE '<%' AND regexp_matches(lag(token) OVER w, '({_TOUCHES}|\.)$'), false) AS before, token LIKE '<%' AND coalesce(lead(token) OVER w NOT LIKE '<%' AND regexp_matches(lead(token) OVER w, '^{_TOUCHES}'), false) AS after
  FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
wires AS (SELECT page_id, string_agg(CASE WHEN el THEN concat(CASE WHEN before THEN ' ' ELSE '' END, '<', CAST(slot AS BIGINT), '/>', CASE WHEN after THEN ' ' ELSE '' END) ELSE {_ESC} END, '' ORDER BY ord) AS wire,
  CAST(max(slot) AS BIGINT) AS slots, CAST(sum(before::INT + after::INT) AS BIGINT) AS spaced FROM k GROUP BY page_id)"""


def _slotted(spark, sf_dir):
    """Tokens of each page with the slot of each element, and whether a space sets it apart before and after.

    An element that touches a word, or stands right after a full stop, would be read as one token with it.
    """
    w = Window.partitionBy("page_id").orderBy("ord")
    element = F.col("token").startswith("<")
    beside = lambda c, pattern: F.coalesce(~c.startswith("<") & c.rlike(pattern), F.lit(False))
    return tokens(spark, sf_dir).withColumns({
        "el": element, "slot": F.sum(F.when(element, 1).otherwise(0)).over(w),
        "before": element & beside(F.lag("token").over(w), rf"({_TOUCHES}|\.)\z"), "after": element & beside(F.lead("token").over(w), f"^{_TOUCHES}"),
    })


@P.query(f"WITH {_TOKENS}, {_WIRE_SQL} SELECT * FROM wires")
def serialize_wire(spark, sf_dir):
    """Pages as a wire: text escaped, every element a numbered slot, set apart from words by spaces, which are counted."""
    k = _slotted(spark, sf_dir)
    space = lambda c: F.when(F.col(c), " ").otherwise("")
    piece = F.when(F.col("el"), F.concat(space("before"), F.lit("<"), F.col("slot").cast("string"), F.lit("/>"), space("after"))).otherwise(escape_text(F.col("token")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("s")))), lambda x: x["s"])
    return k.groupBy("page_id").agg(F.array_join(parts, "").alias("wire"), F.max("slot").alias("slots"), F.sum(F.col("before").cast("int") + F.col("after").cast("int")).alias("spaced"))


@P.query(rf"""WITH {_TOKENS}, {_WIRE_SQL}, r AS (SELECT page_id, unnest(range(len(ps))) AS n, unnest(ps) AS piece FROM (SELECT page_id, regexp_extract_all(wire, '<[0-9]+/>|[^<]+') AS ps FROM wires)),
  s AS (SELECT r.*, k.token AS slot_token, k.before, k.after FROM r LEFT JOIN k ON k.page_id = r.page_id AND k.el AND r.piece = concat('<', CAST(k.slot AS BIGINT), '/>')),
  t AS (SELECT page_id, n, slot_token, CASE WHEN lag(after) OVER w THEN substr(piece, 2) ELSE piece END AS piece, coalesce(lead(before) OVER w, false) AS cut FROM s WINDOW w AS (PARTITION BY page_id ORDER BY n)),
  u AS (SELECT page_id, n, coalesce(slot_token, replace(replace(replace(replace(CASE WHEN cut THEN left(piece, length(piece) - 1) ELSE piece END, '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')) AS piece FROM t)
  SELECT page_id, string_agg(piece, '' ORDER BY n) = any_value(html) AS same, count(*) AS pieces FROM u JOIN pages USING (page_id) GROUP BY page_id""")
def rehydrate(spark, sf_dir):
    """The wire of each page read back: slots filled from their table, the wire's own spaces taken off, text unescaped; whether the page comes back."""
    slots = _slotted(spark, sf_dir).where("el").select("page_id", "token", "slot", "before", "after")
    read = serialize_wire(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("wire", F.lit("<[0-9]+/>|[^<]+"), F.lit(0))).alias("ord", "piece"))
    read = read.withColumn("slot", F.regexp_extract("piece", "^<([0-9]+)/>", 1).try_cast("int")).join(slots, ["page_id", "slot"], "left")
    w = Window.partitionBy("page_id").orderBy("ord")
    text = F.when(F.coalesce(F.lag("after").over(w), F.lit(False)), F.substring("piece", F.lit(2), F.length("piece"))).otherwise(F.col("piece"))
    text = F.when(F.coalesce(F.lead("before").over(w), F.lit(False)), F.left(text, F.length(text) - 1)).otherwise(text)
    for name, mark in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    filled = read.withColumn("piece", F.when(F.col("token").isNull(), text).otherwise(F.col("token")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"])
    whole = filled.groupBy("page_id").agg(F.array_join(parts, "").alias("back"), F.count("*").alias("pieces"))
    return whole.join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", (F.col("back") == F.col("html")).alias("same"), "pieces")


@P.query(f"WITH {_TOKENS} SELECT page_id, ord, token AS stretch FROM tokens WHERE token NOT LIKE '<%' AND len(regexp_extract_all(token, '\\p{{L}}')) >= 2")
def runs_floor(spark, sf_dir):
    """Stretches between elements with at least two letters."""
    return tokens(spark, sf_dir).where(~F.col("token").startswith("<") & (F.regexp_count("token", F.lit(r"\p{L}")) >= 2)).select("page_id", "ord", F.col("token").alias("stretch"))


@P.query(f"WITH {_TOKENS}, l AS (SELECT page_id, max(ord) AS last_ FROM tokens WHERE token NOT LIKE '<%' GROUP BY page_id) SELECT page_id, count(*) AS n, string_agg(token, '' ORDER BY ord) AS tail FROM tokens JOIN l USING (page_id) WHERE ord > last_ GROUP BY page_id")
def tail_split(spark, sf_dir):
    """Elements after the last text of a page."""
    t = tokens(spark, sf_dir)
    last = t.where(~F.col("token").startswith("<")).groupBy("page_id").agg(F.max("ord").alias("last_"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"])
    return t.join(last, "page_id").where("ord > last_").groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(parts, "").alias("tail"))


@P.query(f"WITH {_TOKENS}, s AS (SELECT page_id, ord, token, coalesce(sum(CASE WHEN token LIKE '<%' THEN 0 ELSE length(token) END) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM tokens) SELECT page_id, ord, CAST(seen AS BIGINT) AS landing FROM s WHERE token = '<br>'")
def boundary_landing(spark, sf_dir):
    """Where the boundary marks (line breaks) of a page land in its visible text."""
    w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(F.col("token").startswith("<"), 0).otherwise(F.length("token"))).over(w), F.lit(0)).cast("long")
    return tokens(spark, sf_dir).withColumn("landing", seen).where("token = '<br>'").select("page_id", "ord", "landing")


@P.query(f"""WITH RECURSIVE {ITEMS}, m AS (SELECT unit, gid, y, size, row_number() OVER (PARTITION BY unit ORDER BY gid) AS rn FROM items), f AS (SELECT unit, gid, rn, y AS y0, 0 AS run FROM m WHERE rn = 1 UNION ALL
             SELECT m.unit, m.gid, m.rn, CASE WHEN abs(m.y - f.y0) >= 20 * m.size THEN m.y ELSE f.y0 END, CASE WHEN abs(m.y - f.y0) >= 20 * m.size THEN f.run + 1 ELSE f.run END FROM f JOIN m ON m.unit = f.unit AND m.rn = f.rn + 1) SELECT unit, gid, run FROM f""")
def stream_runs(spark, sf_dir):
    """Runs of a stream; a new one begins far from the first member of the last, not from its neighbour."""
    m = items(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("gid", "y", "size"))).alias("m"))

    def step(s, x):
        far = F.abs(x["y"] - s["y0"]) >= 20 * x["size"]
        run = F.when(s["run"] < 0, 0).when(far, s["run"] + 1).otherwise(s["run"])
        y0 = F.when((s["run"] < 0) | far, x["y"]).otherwise(s["y0"])
        return F.struct(y0.alias("y0"), run.alias("run"), F.concat(s["out"], F.array(run)).alias("out"))

    start = F.struct(F.lit(0.0).alias("y0"), F.lit(-1).alias("run"), F.array().cast("array<int>").alias("out"))
    placed = m.withColumn("r", F.aggregate("m", start, step, lambda s: s["out"]))
    return placed.select("unit", F.explode(F.arrays_zip("m", "r")).alias("x")).select("unit", "x.m.gid", F.col("x.r").alias("run"))


@P.query(f"WITH {ITEMS}, s AS (SELECT *, CASE WHEN lag(x1) OVER w IS NULL OR x0 - lag(x1) OVER w > 1.5 * size THEN 1 ELSE 0 END AS s, CASE WHEN x0 - lag(x1) OVER w > 0.22 * size THEN 1 ELSE 0 END AS sp FROM items WINDOW w AS (PARTITION BY page, y ORDER BY x0, gid)), r AS (SELECT *, sum(s) OVER (PARTITION BY page, y ORDER BY x0, gid ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT page, y, CAST(run AS BIGINT) AS run, count(*) AS n, CAST(sum(CASE WHEN s = 0 THEN sp ELSE 0 END) AS BIGINT) AS spaces FROM r GROUP BY ALL")
def glyph_runs(spark, sf_dir):
    """Items on one baseline joined while gaps are narrow, with the spaces that fall between them."""
    w = Window.partitionBy("page", "y").orderBy("x0", "gid")
    gap = F.col("x0") - F.lag("x1").over(w)
    marked = items(spark, sf_dir).withColumn("_b", gap.isNull() | (gap > 1.5 * F.col("size"))).withColumn("_sp", F.when(gap > 0.22 * F.col("size"), 1).otherwise(0))
    return islands(marked, ["page", "y"], ["x0", "gid"], F.col("_b")).groupBy("page", "y", "run").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("_b"), F.col("_sp")).otherwise(0)).alias("spaces"))


@P.query(f"WITH {ITEMS}, g AS (SELECT page, x1, lag(x1) OVER (PARTITION BY page ORDER BY x1 DESC, gid) AS p FROM items), e AS (SELECT page, max(x1) AS right_ FROM g WHERE p - x1 <= 0.2 GROUP BY page) SELECT page, min(x0) AS left_, any_value(right_) AS right_ FROM items LEFT JOIN e USING (page) GROUP BY page")
def column_edges(spark, sf_dir):
    """Leftmost start of each page, and the furthest end that two of its lines share."""
    i = items(spark, sf_dir)
    g = i.withColumn("p", F.lag("x1").over(Window.partitionBy("page").orderBy(F.desc("x1"), "gid")))
    e = g.where("p - x1 <= 0.2").groupBy("page").agg(F.max("x1").alias("right_"))
    return i.groupBy("page").agg(F.min("x0").alias("left_")).join(e, "page", "left")


@P.query(f"WITH {ITEMS}, o AS (SELECT page, face, gid, row_number() OVER (PARTITION BY page ORDER BY y, gid) AS a, row_number() OVER (PARTITION BY page, face ORDER BY y, gid) AS b FROM items), r AS (SELECT page, face, a - b AS part, count(*) AS n, min(gid) AS first_ FROM o GROUP BY ALL) SELECT page, face, count(*) AS parts, max(n) AS longest FROM r GROUP BY ALL")
def apart_rows(spark, sf_dir):
    """Rows of each face of a page, cut apart where one of another face lies between."""
    o = items(spark, sf_dir).withColumn("a", F.row_number().over(Window.partitionBy("page").orderBy("y", "gid"))).withColumn("b", F.row_number().over(Window.partitionBy("page", "face").orderBy("y", "gid")))
    r = o.groupBy("page", "face", (F.col("a") - F.col("b")).alias("part")).agg(F.count("*").alias("n"))
    return r.groupBy("page", "face").agg(F.count("*").alias("parts"), F.max("n").alias("longest"))


@P.query(f"WITH {ITEMS}, u AS (SELECT unit, min(page) AS page, style, count(*) AS n FROM items GROUP BY unit, style), b AS (SELECT unit, min(page) AS page, max_by(style, n * 10 + (CASE WHEN style = 'F' THEN 1 ELSE 0 END)) AS style FROM u GROUP BY unit), p AS (SELECT page, max_by(style, n * 10 + (CASE WHEN style = 'F' THEN 1 ELSE 0 END)) AS around FROM (SELECT page, style, count(*) AS n FROM items GROUP BY ALL) GROUP BY page) SELECT unit, style FROM b JOIN p USING (page) WHERE style <> around")
def group_style(spark, sf_dir):
    """Units whose style, by most of their items, differs from that of their page."""
    i = items(spark, sf_dir)
    most = lambda df, key: df.groupBy(key).agg(F.max_by("style", F.struct("n", (F.col("style") == "F").cast("int"))).alias("s"))
    b = most(i.groupBy("unit", "style").agg(F.count("*").alias("n")), "unit").withColumnRenamed("s", "style").join(i.groupBy("unit").agg(F.min("page").alias("page")), "unit")
    p = most(i.groupBy("page", "style").agg(F.count("*").alias("n")), "page").withColumnRenamed("s", "around")
    return b.join(p, "page").where("style <> around").select("unit", "style")


_GRID = f"{LINES}, r AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS row FROM lines WHERE contains(line, ' | '))"


@P.query(f"WITH {_GRID}, c AS (SELECT doc_id, row, unnest(generate_series(1, len(string_split(trim(line, ' |'), ' | ')))) AS col, unnest(string_split(trim(line, ' |'), ' | ')) AS cell FROM r) SELECT doc_id, row, CAST(col AS INTEGER) AS col, cell, row = 1 AS header FROM c")
def table_grid(spark, sf_dir):
    """Cells of the tables in documents by row and column, the first row as header."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    r = lines(spark, sf_dir).where(F.contains("line", F.lit(" | "))).withColumn("row", F.row_number().over(w).cast("long"))
    cells = r.select("doc_id", "row", F.posexplode(F.split(F.trim(F.col("line"), F.lit(" |")), r" \| ")).alias("col", "cell"))
    return cells.select("doc_id", "row", (F.col("col") + 1).alias("col"), "cell", (F.col("row") == 1).alias("header"))


@P.query(f"WITH {LINES} SELECT doc_id, pos, line AS text FROM lines WHERE line <> ''")
def join_accents(spark, sf_dir):
    """Each line set as glyphs, its accents apart from their letters as fonts set them, and read back by where glyphs lie.

    Every other sign advances by itself, so accents that stand alone in a text stay alone.  A line is set and read where
    it is, and of it only what stands in reach of an accent: nothing is dealt by glyph.
    """

    def glyphs(x: Column, at: Column) -> Column:
        glyph = lambda u, y: F.struct(u.alias("u"), F.lit("f").alias("font"), F.lit(10.0).alias("size"), (at * 5.0).alias("x0"), (at * 5.0 + 5).alias("x1"), y.alias("y"), (y + 7).alias("top"))
        upper = x["letter"].rlike(r"^\p{Lu}$").cast("double") * 2
        return F.when(x["accent"] != x["letter"], F.array(glyph(x["accent"], upper), glyph(x["letter"], F.lit(0.0)))).otherwise(F.array(glyph(x["letter"], F.lit(0.0))))

    def read(part: Column) -> Column:
        accents, letters = (F.split(t, "") for t in G.apart(part))
        return F.array_join(G.accented(F.flatten(F.transform(F.arrays_zip(accents.alias("accent"), letters.alias("letter")), glyphs))), "")

    near = F.transform(F.regexp_extract_all("line", F.lit(G.NEAR), F.lit(0)), read)
    text = G.let(near, lambda parts: F.array_join(F.transform(F.split("line", G.NEAR, -1), lambda rest, i: F.concat(rest, F.coalesce(F.get(parts, i), F.lit("")))), ""))
    return lines(spark, sf_dir).where("line <> ''").select("doc_id", "pos", text.alias("text"))


@P.query()
def span_grid(spark, sf_dir):
    """Items of each page as cells of a table, a row for each height: each takes as many rows and columns as its size and place give."""
    i = items(spark, sf_dir)
    row = F.dense_rank().over(Window.partitionBy("page").orderBy("y")) - 1
    ord_ = F.row_number().over(Window.partitionBy("page", "y").orderBy("x0", "gid")) - 1
    cells = i.select("page", "gid", row.alias("row"), ord_.alias("ord"), (F.col("size") - 8).alias("rowspan"), F.ceil((F.col("x1") - F.col("x0")) / 20).cast("int").alias("colspan"))
    return placed_cells(cells, "page")


#: A sentence's end, with what closes after it; how far a cut may move to one.
_END, _SNAP = r"[.!?]+[\"”’)\]]*\s*", 3
_SNAP_SQL = rf"""settled AS (SELECT doc_id, pos, line, k * 60 AS cut, k * 60 + d AS p, d, regexp_matches(substr(line, greatest(1, k * 60 + d - 7), least(8, k * 60 + d)), '{_END}$') AS ends,
 NOT regexp_matches(substr(line, k * 60 + d + 1, 8), '^\s*\p{{Ll}}') AS free FROM (SELECT doc_id, pos, line, unnest(generate_series(1, CAST(floor((length(line) - 1) / 60) AS BIGINT))) AS k FROM lines WHERE length(line) > 60),
 (SELECT unnest(generate_series(-{_SNAP}, {_SNAP})) AS d)),
near AS (SELECT doc_id, pos, line, cut, bool_or(d = 0 AND ends) AS stays, min(abs(d)) FILTER (d < 0 AND ends AND free) AS back, min(d) FILTER (d > 0 AND ends AND free AND p < length(line)) AS ahead FROM settled GROUP BY ALL),
moved AS (SELECT doc_id, pos, line, cut, CASE WHEN stays OR (back IS NULL AND ahead IS NULL) THEN cut WHEN back = ahead THEN NULL WHEN ahead IS NULL OR back < ahead THEN cut - back ELSE cut + ahead END AS at_ FROM near),
parts AS (SELECT *, substr(line, coalesce(lag(at_) OVER w, 0) + 1, at_ - coalesce(lag(at_) OVER w, 0)) AS part, CASE WHEN lead(cut) OVER w IS NULL THEN substr(line, at_ + 1) ELSE 'x' END AS rest FROM moved WINDOW w AS (PARTITION BY doc_id, pos ORDER BY cut))"""


@P.query(rf"WITH {LINES}, {_SNAP_SQL} SELECT doc_id, pos, coalesce(bool_and(at_ IS NOT NULL AND regexp_matches(part, '\S') AND regexp_matches(rest, '\S')), FALSE) AS ok, count(*) AS cuts, count(*) FILTER (at_ <> cut) AS near_, string_agg(CAST(CASE WHEN whole THEN at_ ELSE cut END AS VARCHAR), ',' ORDER BY cut) AS at_ FROM (SELECT *, coalesce(bool_and(at_ IS NOT NULL AND regexp_matches(part, '\S') AND regexp_matches(rest, '\S')) OVER (PARTITION BY doc_id, pos), FALSE) AS whole FROM parts) GROUP BY doc_id, pos")
def snap_cuts(spark, sf_dir):
    """Cuts every 60 characters moved onto a sentence's end that each missed by up to three characters.

    A cut at a sentence's end stays, and no cut moves to where the text goes on in lower case.  All or nothing: a cut with
    ends on both sides at one distance, or a part with nothing to see, leaves every cut of the line as it was.
    """
    at = lambda p: F.substring("line", p, F.lit(8))
    ends = lambda p: F.substring("line", F.greatest(F.lit(1), p - 7), F.least(F.lit(8), p)).rlike(_END + r"\z")
    free = lambda p: ends(p) & ~at(p + 1).rlike(r"^\s*\p{Ll}")

    def moved(cut):
        out = F.when(ends(cut), cut)
        for d in range(1, _SNAP + 1):
            back, ahead = free(cut - d), free(cut + d) & (cut + d < F.length("line"))
            out = out.when(back & ahead, F.lit(None)).when(back, cut - d).when(ahead, cut + d)
        return out.otherwise(cut)

    cuts = F.transform(F.sequence(F.lit(1), F.floor((F.length("line") - 1) / 60).cast("int")), lambda k: k * 60)
    c = lines(spark, sf_dir).where(F.length("line") > 60).select("doc_id", "pos", "line", cuts.alias("cuts")).withColumn("to", F.transform("cuts", moved))
    edges = F.concat(F.array(F.lit(0)), "to", F.array(F.length("line")))
    seen = F.transform(F.sequence(F.lit(1), F.size("to") + 1), lambda i: F.substring("line", F.get(edges, i - 1) + 1, F.get(edges, i) - F.get(edges, i - 1)).rlike(r"\S"))
    ok = F.coalesce(F.forall("to", lambda x: x.isNotNull()) & F.forall(seen, lambda x: x), F.lit(False))
    near = F.size(F.filter(F.arrays_zip("cuts", "to"), lambda x: x["cuts"] != x["to"])).cast("long")
    return c.select("doc_id", "pos", ok.alias("ok"), F.size("cuts").cast("long").alias("cuts"), near.alias("near_"), F.array_join(F.when(ok, F.col("to")).otherwise(F.col("cuts")).cast("array<string>"), ",").alias("at_"))


@P.query(f"WITH {_TOKENS}, n AS (SELECT page_id, ord, token, lag(token) OVER (PARTITION BY page_id ORDER BY ord) AS p, lead(token) OVER (PARTITION BY page_id ORDER BY ord) AS q FROM tokens) SELECT page_id, ord, token FROM n WHERE token LIKE '<%' AND regexp_matches(p, '[\\p{{L}}\\p{{N}}]$') AND p NOT LIKE '<%' AND regexp_matches(q, '^[\\p{{L}}\\p{{N}}]') AND q NOT LIKE '<%'")
def whole_words(spark, sf_dir):
    """Elements whose edge lies strictly inside a word."""
    w = Window.partitionBy("page_id").orderBy("ord")
    n = tokens(spark, sf_dir).withColumn("p", F.lag("token").over(w)).withColumn("q", F.lead("token").over(w))
    cut = F.col("p").rlike(r"[\p{L}\p{N}]\z") & ~F.col("p").startswith("<") & F.col("q").rlike(r"^[\p{L}\p{N}]") & ~F.col("q").startswith("<")
    return n.where(F.col("token").startswith("<") & cut).select("page_id", "ord", "token")


#: Every word of a text between spaces of its own, so that neighbouring runs share none.
_SPACED = "list_aggregate(list_transform(list_filter(regexp_split_to_array({}, '[ \\n]'), lambda w: w <> ''), lambda w: concat(' ', w, ' ')), 'string_agg', '')"
_RUNS = rf"""t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
 p AS (SELECT conv_id, turn, {_SPACED.format("before")} AS pool, string_split_regex(text, '[.!?\n]+') AS parts FROM t),
 s AS (SELECT conv_id, turn, pool, unnest(generate_series(1, len(parts))) AS ord, unnest(parts) AS part FROM p WHERE pool <> ''),
 m AS (SELECT conv_id, turn, pool, ord, {_SPACED.format("part")} AS run FROM s),
 r AS (SELECT conv_id, turn, instr(pool, run) AS at_, length(run) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(run) DESC, ord) AS k FROM m WHERE run <> '' AND length(pool) - length(replace(pool, run, '')) = length(run)),
 g AS (SELECT DISTINCT conv_id, turn, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken FROM r
  UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN len(list_filter(taken, lambda x: x.a < at_ + n AND at_ < x.b)) > 0 THEN taken ELSE list_append(taken, {{'a': CAST(at_ AS BIGINT), 'b': CAST(at_ + n AS BIGINT)}}) END
  FROM g JOIN r ON r.conv_id = g.conv_id AND r.turn = g.turn AND r.k = g.k + 1)"""


@P.query(f"WITH RECURSIVE {_RUNS} SELECT conv_id, turn, CAST(len(max_by(taken, k)) AS BIGINT) AS runs, CAST(list_sum(list_transform(max_by(taken, k), lambda x: x.b - x.a)) AS BIGINT) AS size FROM g GROUP BY conv_id, turn")
def run_match(spark, sf_dir):
    """Sentences of a turn that stand exactly once in the turn before, word for word, longest first.

    A sentence whose place holds a word that a longer one has taken is not matched.
    """
    spaced = lambda c: F.array_join(F.transform(F.filter(F.split(c, r"[ \n]"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", spaced(before).alias("pool"))
    run = c.select("conv_id", "turn", "pool", F.posexplode(F.split("text", r"[.!?\n]+")).alias("ord", "part")).withColumn("run", spaced(F.col("part"))).where("run <> ''")
    once = run.where(F.length("pool") - F.length(F.replace("pool", F.col("run"))) == F.length("run"))
    first = F.instr("pool", F.col("run")).cast("long")
    sized = once.select("conv_id", "turn", F.struct((-F.length("run")).alias("n"), "ord", first.alias("a"), (first + F.length("run")).alias("b")).alias("r"))

    def step(taken, r):
        return F.when(F.exists(taken, lambda x: (x["a"] < r["b"]) & (r["a"] < x["b"])), taken).otherwise(F.concat(taken, F.array(F.struct(r["a"].alias("a"), r["b"].alias("b")))))

    taken = F.aggregate(F.array_sort(F.collect_list("r")), F.array().cast("array<struct<a:bigint,b:bigint>>"), step)
    g = sized.groupBy("conv_id", "turn").agg(taken.alias("taken"))
    return g.select("conv_id", "turn", F.size("taken").cast("long").alias("runs"), F.aggregate("taken", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("size"))


@P.query("WITH f AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) SELECT a.o_custkey AS scope, a.o_orderkey AS lost, b.o_orderkey AS place FROM f a JOIN f b ON a.o_custkey = b.o_custkey AND a.k = b.k AND a.n = b.n AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'")
def place_groups(spark, sf_dir):
    """Lost groups put at the free occurrences of their scope, in order, where the counts agree."""
    w = Window.partitionBy("o_custkey", "o_orderstatus")
    f = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(w))
    a, b = (f.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("scope"), "k", "n", F.col("o_orderkey").alias(name)) for s, name in (("F", "lost"), ("O", "place")))
    return a.join(b, ["scope", "k", "n"]).select("scope", "lost", "place")


_VOTES = "v AS (SELECT regexp_replace(pattern, '[0-9]', '', 'g') AS part, unnest(generate_series(0, len(d) - 1)) AS k, CAST(unnest(d) AS INTEGER) AS vote FROM (SELECT pattern, list_transform(regexp_extract_all(concat(pattern, ' '), '([0-9]?)[^0-9]', 1), lambda x: CASE WHEN x = '' THEN '0' ELSE x END) AS d FROM (SELECT unnest([{}]) AS pattern)))"
_VOTES = _VOTES.format(", ".join(f"'{p}'" for p in syllable_patterns()))


@P.query(f"""WITH {WORDS}, {_VOTES}, w AS (SELECT DISTINCT lower(word) AS word FROM words WHERE regexp_matches(word, '^\\p{{L}}{{5,}}$')),
 s AS (SELECT word, at_, substr(concat('.', word, '.'), at_ + 1, n) AS part FROM (SELECT word, unnest(generate_series(0, length(word) + 1)) AS at_ FROM w), (SELECT unnest(generate_series(1, 2)) AS n)),
 b AS (SELECT word, at_ + k - 1 AS o, max(vote) AS vote FROM s JOIN v USING (part) GROUP BY ALL),
 f AS (SELECT word, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS breaks FROM b WHERE vote % 2 = 1 AND o >= 2 AND o <= length(word) - 3 GROUP BY word)
 SELECT w.word, coalesce(f.breaks, '') AS breaks FROM w LEFT JOIN f USING (word)""")
def hyphenate(spark, sf_dir):
    """Where each distinct word of the documents may break, by patterns that one rule of syllables makes.

    Patterns of a language are data and come as a table of their own.
    """
    patterns = spark.createDataFrame([(p,) for p in syllable_patterns()], "pattern string")
    w = words(spark, sf_dir).where(F.col("word").rlike(r"^\p{L}{5,}\z")).select(F.lower("word").alias("word"))
    return break_points(w, patterns)

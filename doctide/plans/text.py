"""Text functions over lines, words, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from doctide.functions import nested as N
from doctide.functions import text as T
from doctide.operators import acceptance as A
from doctide.operators import sentences as S
from doctide.operators.walks import cut
from doctide.plans.register import Plans
from doctide.sources.tables import LINES, WORDS, lines, table, words

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle


def sql(body: str) -> str:
    return f"WITH {LINES} {body}"


@P.query(sql(r"SELECT doc_id, pos, trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g')) AS squashed FROM lines"))
def squash(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.squash("line").alias("squashed"))


@P.query(r"SELECT doc_id, regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g') AS text FROM documents")
def collapse_html_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_html("text").alias("text"))


@P.query(sql(r"SELECT doc_id, pos, regexp_matches(line, '\p{L}') AS one, regexp_matches(line, '\p{L}{2,}') AS two FROM lines"))
def has_letter(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.has_letter("line").alias("one"), T.has_letter("line", 2).alias("two"))


@P.query(f"WITH {WORDS} " + r"SELECT doc_id, pos, ord, regexp_matches(trim(word), '^[+\-−]?[0-9]+([.,][0-9]+)*([eE][+\-]?[0-9]+)?\s*(%|‰|°)?(\s*±\s*[0-9.]+)?$') AS numeric FROM words")
def numeric_cell(spark, sf_dir):
    return words(spark, sf_dir).select("doc_id", "pos", "ord", T.numeric_cell(F.col("word")).alias("numeric"))


_BARE = r"regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"
_KIND = rf"CASE WHEN {_BARE} = '' THEN 'symbol' WHEN regexp_matches({_BARE}, '^[0-9][0-9.,]*$') THEN 'number' WHEN regexp_matches({_BARE}, '[0-9_]|\p{{Ll}}\p{{Lu}}') THEN 'identifier' ELSE 'word' END"


@P.query(f"WITH {WORDS} SELECT doc_id, {_KIND} AS kind, count(*) AS n FROM words GROUP BY ALL")
def token_kind(spark, sf_dir):
    """Kinds of each document's words.  Each distinct word of a document is classified once."""
    w = words(spark, sf_dir).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return w.groupBy("doc_id", T.token_kind(F.col("word")).alias("kind")).agg(F.sum("n").alias("n"))


@P.query(f"WITH {WORDS} SELECT doc_id, pos, bool_and(({_KIND}) <> 'word') AS kept FROM words GROUP BY ALL")
def holds_no_word(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.groupBy("doc_id", "pos").agg(F.bool_and(T.token_kind(F.col("word")) != "word").alias("kept"))


@P.query(sql(r"SELECT doc_id, pos, regexp_matches(line, '\p{L}') AND NOT regexp_matches(trim(line), '^[+\-−]?[0-9]+([.,][0-9]+)*([eE][+\-]?[0-9]+)?\s*(%|‰|°)?(\s*±\s*[0-9.]+)?$') AS translatable FROM lines"))
def is_translatable(spark, sf_dir):
    line = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "pos", (T.has_letter(line) & ~T.numeric_cell(line)).alias("translatable"))


@P.query(r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(regexp_replace(substr(text, 1, 200), '\s+\S*$', ''), '...') END AS context FROM documents")
def context_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text"), 200).alias("context"))


@P.query(sql("SELECT doc_id, pos, replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, true AS same FROM lines"))
def escape_text(spark, sf_dir):
    """Escaping, and whether decoding gives the text back."""
    escaped = T.escape_text(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "pos", escaped.alias("escaped"), (T.decode_text(escaped) == F.col("line")).alias("same"))


_RED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, 'https?://[^\s\"<>]+', '<url>', 'g'), '[\w.+-]+@[\w-]+\.[\w.]+', '<mail>', 'g'), '\b(sk|pk|key|tok)[-_][A-Za-z0-9]{8,}', '<key>', 'g'), '[0-9]{9,}', '<number>', 'g')"


@P.query(sql(f"SELECT doc_id, pos, CASE WHEN length(r) > 500 THEN concat(substr(r, 1, 500), '…') ELSE r END AS line FROM (SELECT doc_id, pos, {_RED} AS r FROM lines)"))
def redact(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.redacted(F.col("line")).alias("line"))


@P.query(sql("SELECT doc_id, pos, concat('withheld (', CAST(length(line) AS VARCHAR), ')') AS line FROM lines"))
def failure_line(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", F.format_string("withheld (%d)", F.length("line")).alias("line"))


@P.query(r"SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS tag, regexp_extract(url, '/([a-z]{2})/', 1) IN ('ar', 'he', 'fa', 'ur') AS rtl, split_part(regexp_extract(html, 'lang=\"([A-Za-z-]+)\"', 1), '-', 1) AS language FROM pages")
def lang_tag(spark, sf_dir):
    tag = F.regexp_extract("url", r"/([a-z]{2})/", 1)
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tag.alias("tag"), tag.isin("ar", "he", "fa", "ur").alias("rtl"), F.split_part(F.regexp_extract("html", r'lang="([A-Za-z-]+)"', 1), F.lit("-"), F.lit(1)).alias("language"))


@P.query("SELECT conv_id, turn, replace(replace('Translate for {role}: {text}', '{role}', role), '{text}', text) AS prompt FROM conversations")
def render_template(spark, sf_dir):
    filled = F.replace(F.replace(F.lit("Translate for {role}: {text}"), F.lit("{role}"), F.col("role")), F.lit("{text}"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", filled.alias("prompt"))


@P.query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@P.query("""SELECT doc_id, string_agg(replace(replace(rtrim(base64(unhex(substr(sha256(encode(text)[k * 1024 + 1 : (k + 1) * 1024]), 1, 32))), '='), '+', '-'), '/', '_'), '' ORDER BY k) AS digests
            FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(octet_length(encode(text)) - 1, 0) // 1024)) AS k FROM documents WHERE text IS NOT NULL) GROUP BY doc_id""")
def chunk_digests(spark, sf_dir):
    """Digests of each document's chunks of 1,024 bytes: 16 bytes each in base64url, joined."""
    raw = F.encode("text", "UTF-8")
    chunk = lambda k: F.substring(raw, k * 1024 + 1, F.lit(1024))
    short = lambda k: F.rtrim(F.base64(F.unhex(F.substring(F.sha2(chunk(k), 256), 1, 32))), F.lit("="))
    last = F.floor(F.greatest(F.octet_length(raw) - 1, F.lit(0)) / 1024).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.translate(short(k), "+/", "-_"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(parts, "").alias("digests"))


@P.query("""SELECT n_nationkey, concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}') AS canonical FROM nation""")
def canonical_json(spark, sf_dir):
    """Keys sorted, no spaces, absent values left out."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_nationkey", "n_regionkey")).alias("canonical"))


@P.query("""SELECT p_partkey, concat('{"brand":"', p_brand, '","name":"', p_name, '","size":', p_size, '}') AS object, sha256(concat('{"brand":"', p_brand, '","name":"', p_name, '","size":', p_size, '}')) AS digest FROM part""")
def object_write(spark, sf_dir):
    """Canonical objects named by their digest."""
    made = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("object"), F.sha2(made, 256).alias("digest"))


_WHY = """CASE WHEN event_id % 7 = 0 THEN 'digest' WHEN length(props) > 9 THEN 'bounds' WHEN NOT json_valid(props) THEN 'json' WHEN CAST(props->>'$.k' AS BIGINT) < 10 THEN 'schema' END"""


@P.query(f"SELECT event_id, ({_WHY}) IS NULL AS ok, {_WHY} AS why FROM events")
def object_read_check(spark, sf_dir):
    """Objects read in order: digest (wrong for every seventh), byte bound, JSON, schema (k of 10 or more)."""
    e = table(spark, sf_dir, "events").withColumn("claimed", F.sha2(F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")), 256))
    k = F.from_json("props", "k long")["k"]
    why = F.when(F.sha2("props", 256) != F.col("claimed"), "digest").when(F.octet_length("props") > 9, "bounds").when(F.try_parse_json("props").isNull(), "json").when(k < 10, "schema")
    return e.select("event_id", why.isNull().alias("ok"), why.alias("why"))


@P.query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE json_valid(props)")
def parse_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k is not null")


@P.query(r"SELECT event_id, CAST(len(regexp_extract_all(regexp_replace(props, '\"(\\\\.|[^\"\\\\])*\"', 's', 'g'), '[\[{]|[^\s,:\[\]{}]+')) - len(regexp_extract_all(regexp_replace(props, '\"(\\\\.|[^\"\\\\])*\"', 's', 'g'), ':')) AS INTEGER) AS n_values, 1 AS depth FROM events".replace("\\\\\\\\", "\\\\"))
def json_shape(spark, sf_dir):
    """Values and depth of JSON text, without parsing it."""
    bare = F.regexp_replace("props", r'"(\\.|[^"\\])*"', "s")
    n = F.size(F.regexp_extract_all(bare, F.lit(r"[\[{]|[^\s,:\[\]{}]+"), F.lit(0))) - F.size(F.regexp_extract_all(bare, F.lit(":"), F.lit(0)))
    step = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    deep = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda s, c: F.struct((s["d"] + step(c)).alias("d"), F.greatest(s["m"], s["d"] + step(c)).alias("m")), lambda s: s["m"])
    return table(spark, sf_dir, "events").select("event_id", n.alias("n_values"), deep.alias("depth"))


@P.query(f"""WITH {WORDS} SELECT DISTINCT w.doc_id, w.word FROM words w WHERE w.ord > 0 AND regexp_matches(w.word, '^\\p{{Lu}}\\p{{Ll}}+$')
             AND NOT EXISTS (SELECT 1 FROM words l WHERE l.doc_id = w.doc_id AND l.word = lower(w.word))""")
def paper_names(spark, sf_dir):
    """Words that stand capitalised within a line and never in lower case in their document."""
    in_lines = F.transform(F.split("text", "\n"), lambda line: F.filter(F.split(line, " "), lambda w: w != ""))
    inner = F.flatten(F.transform(in_lines, lambda ws: F.slice(ws, 2, F.greatest(F.size(ws), F.lit(0)))))
    capital = F.array_distinct(F.filter(inner, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$")))
    # words in lower case that some name has when lowered; few, so a name seeks a short list
    lowered = F.transform(capital, F.lower)
    found = F.array_intersect(lowered, F.flatten(in_lines))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", capital.alias("names"), found.alias("found"))
    return d.select("doc_id", F.explode(F.filter("names", lambda w: ~F.array_contains("found", F.lower(w)))).alias("word")).distinct()


@P.query(f"""WITH {WORDS} SELECT lower(word) AS word FROM words WHERE regexp_matches(word, '^\\p{{Lu}}\\p{{L}}*$') EXCEPT SELECT word FROM words WHERE regexp_matches(word, '^\\p{{Ll}}+$')""")
def set_except(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.where(F.col("word").rlike(r"^\p{Lu}\p{L}*$")).select(F.lower("word").alias("word")).distinct().join(w.where(F.col("word").rlike(r"^\p{Ll}+$")).select("word").distinct(), "word", "left_anti")


@P.query(f"""WITH {WORDS}, c AS (SELECT doc_id, pos, count(*) AS n, count(*) FILTER (regexp_matches(word, '^\\p{{Lu}}')) AS names FROM words GROUP BY ALL) SELECT doc_id, pos FROM c WHERE 2 * names > n""")
def names_blocks(spark, sf_dir):
    """Lines most of whose words begin with a capital."""
    c = words(spark, sf_dir).groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.count_if(F.col("word").rlike(r"^\p{Lu}")).alias("names"))
    return c.where("2 * names > n").select("doc_id", "pos")


@P.query(sql(r"SELECT doc_id, pos, trim(regexp_replace(regexp_replace(line, '[^\p{L}\s.-]+', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS name FROM lines WHERE length(line) < 80"))
def name_norm(spark, sf_dir):
    return lines(spark, sf_dir).where(F.length("line") < 80).select("doc_id", "pos", T.squash(F.regexp_replace("line", r"(?U)[^\p{L}\s.-]+", "")).alias("name"))


@P.query(r"SELECT page_id, regexp_extract(url, '([0-9]+)', 1) AS id, regexp_matches(regexp_extract(url, '([0-9]+)', 1), '^[0-9]{3,5}$') AS shaped FROM pages")
def id_shape(spark, sf_dir):
    found = F.regexp_extract("url", "([0-9]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("id"), found.rlike("^[0-9]{3,5}$").alias("shaped"))


@P.query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'address' WHEN regexp_matches(url, '^10\.[0-9]{4,}/') THEN 'doi' ELSE 'query' END AS kind, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([0-9]+)', 1) AS id FROM pages""")
def read_query(spark, sf_dir):
    url = F.col("url")
    kind = F.when(url.rlike("^https?://"), "address").when(url.rlike(r"^10\.[0-9]{4,}/"), "doi").otherwise("query")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "/([0-9]+)", 1).alias("id"))


@P.query(f"WITH {LINES}, " + r"""x AS (SELECT doc_id, pos, regexp_matches(line, '[;{}]\s*$') AS ends, len(regexp_extract_all(line, '[A-Za-z]+[_0-9][A-Za-z_0-9]*')) AS ids, regexp_matches(line, '[=(]\S*\)') AS calls FROM lines)
             SELECT doc_id, pos, ends OR ids >= 2 OR calls AS code FROM x""")
def looks_like_code(spark, sf_dir):
    line = F.col("line")
    ids = F.size(F.regexp_extract_all(line, F.lit("[A-Za-z]+[_0-9][A-Za-z_0-9]*"), F.lit(0)))
    return lines(spark, sf_dir).select("doc_id", "pos", (line.rlike(r"[;{}]\s*$") | (ids >= 2) | line.rlike(r"[=(]\S*\)")).alias("code"))


@P.query(f"WITH {WORDS} " + r"SELECT doc_id, word AS identifier, count(*) AS n FROM words WHERE regexp_matches(word, '^[A-Za-z]+[_0-9][A-Za-z_0-9]*$') GROUP BY ALL")
def identifiers(spark, sf_dir):
    w = words(spark, sf_dir).where(F.col("word").rlike("^[A-Za-z]+[_0-9][A-Za-z_0-9]*$"))
    return w.groupBy("doc_id", F.col("word").alias("identifier")).agg(F.count("*").alias("n"))


#: The letter of weight 26^i in SQL; numbers from (26^(i + 1) - 1) / 25 up have it.
_LETTER = "CASE WHEN p_partkey + 1 >= {first} THEN chr(97 + CAST((p_partkey + 1 - {first}) // {weight} % 26 AS INTEGER)) ELSE '' END"


@P.query(f"SELECT p_partkey, concat({', '.join(_LETTER.format(first=(26 ** (i + 1) - 1) // 25, weight=26**i) for i in range(13, -1, -1))}) AS alpha FROM part")
def alpha_ids(spark, sf_dir):
    """Numbers from 1 as letters, bijective in base 26; a long has 14 letters at most."""
    n, letters = "p_partkey + 1", []
    for _ in range(14):
        letters.insert(0, F.expr(f"if({n} > 0, char(97 + ({n} - 1) % 26), '')"))
        n = f"(({n} - 1) div 26)"
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(*letters).alias("alpha"))


_TOKENS = "tokens AS (SELECT page_id, CAST(unnest(generate_series(0, len(regexp_extract_all(html, '<[^>]+>|[^<]+')) - 1)) AS INTEGER) AS ord, unnest(regexp_extract_all(html, '<[^>]+>|[^<]+')) AS token FROM pages)"


def tokens(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<[^>]+>|[^<]+"), F.lit(0))).alias("ord", "token"))


@P.query(f"WITH {_TOKENS} SELECT page_id, ord, CASE WHEN token LIKE '</%' THEN 'close' WHEN token LIKE '<%' THEN 'open' ELSE 'text' END AS kind, lower(regexp_extract(token, '^</?([A-Za-z0-9]+)', 1)) AS tag FROM tokens")
def tokenize_wire(spark, sf_dir):
    kind = F.when(F.col("token").startswith("</"), "close").when(F.col("token").startswith("<"), "open").otherwise("text")
    return tokens(spark, sf_dir).select("page_id", "ord", kind.alias("kind"), F.lower(F.regexp_extract("token", "^</?([A-Za-z0-9]+)", 1)).alias("tag"))


_WIRE = f"""WITH {_TOKENS}, k AS (SELECT page_id, ord, lower(regexp_extract(token, '^</?([A-Za-z0-9]+)', 1)) AS tag, token LIKE '</%' AS closes FROM tokens WHERE token LIKE '<%'),
t AS (SELECT page_id, ord, CASE WHEN closes THEN 'close' WHEN tag = 'br' THEN 'void' ELSE 'open' END AS kind, CASE WHEN NOT closes THEN count(*) FILTER (WHERE NOT closes) OVER (PARTITION BY page_id ORDER BY ord) END AS id
  FROM k WHERE tag IN ('a', 'b', 'p', 'li', 'div', 'br')),
p AS (SELECT page_id, coalesce(lag(page_id) OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id), page_id) AS source FROM pages),
e AS (SELECT page_id, source, t.* EXCLUDE page_id FROM p JOIN t USING (page_id)),
f AS (SELECT e.page_id, e.source, e.ord, e.kind, e.id, s.kind AS wanted, coalesce(sum(CASE e.kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY e.page_id ORDER BY e.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
  FROM e LEFT JOIN t s ON s.page_id = e.source AND s.id = e.id),
g AS (SELECT *, CASE WHEN kind = 'close' THEN CASE WHEN depth <= 0 THEN 'unbalanced' END WHEN wanted IS NULL THEN 'unknown' WHEN kind <> wanted THEN 'kind-mismatch' END AS why FROM f),
first_ AS (SELECT page_id, min_by(why, ord) AS why FROM g WHERE why IS NOT NULL GROUP BY page_id),
ends AS (SELECT page_id, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) AS depth, max(id) AS ids FROM e GROUP BY page_id)
SELECT p.page_id, p.source, coalesce(first_.why, CASE WHEN ends.depth > 0 THEN 'unbalanced' WHEN coalesce(ends.ids, 0) < coalesce(s.ids, 0) THEN 'missing' ELSE 'ok' END) AS why
FROM p LEFT JOIN first_ USING (page_id) LEFT JOIN ends USING (page_id) LEFT JOIN (SELECT page_id AS source, ids FROM ends) s USING (source)"""


@P.query(_WIRE)
def validate_wire(spark, sf_dir):
    """The first fault of each page's placeholders, read as a reply to the page before it of its site.

    Elements are numbered in order; br is void, the others come in pairs.  A site's first page is held against itself.
    """
    tags = F.transform(F.regexp_extract_all("html", F.lit("<[^>]+>"), F.lit(0)), lambda t: F.struct(F.lower(F.regexp_extract(t, "^</?([A-Za-z0-9]+)", 1)).alias("tag"), t.startswith("</").alias("closes")))
    kept = F.filter(tags, lambda t: t["tag"].isin("a", "b", "p", "li", "div", "br"))
    kind = lambda t: F.when(t["closes"], "close").when(t["tag"] == "br", "void").otherwise("open")
    numbered = F.aggregate(
        F.transform(kept, kind), F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<kind:string,id:int>>").alias("all")),
        lambda s, k: F.struct((s["n"] + (k != "close").cast("int")).alias("n"), F.array_append(s["all"], F.struct(k.alias("kind"), F.when(k != "close", s["n"] + 1).alias("id"))).alias("all")),
    )["all"]
    p = table(spark, sf_dir, "pages")
    wires = p.select("page_id", F.coalesce(numbered, F.array().cast("array<struct<kind:string,id:int>>")).alias("tokens"))
    before = F.lag("page_id").over(Window.partitionBy(F.split_part("url", F.lit("/"), F.lit(3))).orderBy("page_id"))
    asked = p.select("page_id", F.coalesce(before, "page_id").alias("source"))
    ids = lambda keep: F.transform(F.filter("tokens", keep), lambda t: t["id"])
    slots = wires.select(F.col("page_id").alias("source"), ids(lambda t: t["kind"] != "close").alias("slots"), ids(lambda t: t["kind"] == "open").alias("paired"))
    met = asked.join(wires, "page_id").join(slots, "source")
    return met.select("page_id", "source", F.coalesce(N.integrity(F.col("tokens"), F.col("slots"), F.col("paired"))["why"], F.lit("ok")).alias("why"))


@P.query(f"WITH {_TOKENS} SELECT page_id, string_agg(CASE WHEN token LIKE '<%' THEN chr(65532) ELSE token END, '' ORDER BY ord) AS projection FROM tokens GROUP BY page_id")
def projection(spark, sf_dir):
    """Text of each page with every element as one U+FFFC."""
    parts = F.regexp_extract_all("html", F.lit("<[^>]+>|[^<]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(parts, lambda t: F.when(t.startswith("<"), "￼").otherwise(t)), "").alias("projection"))


@P.query(f"WITH {_TOKENS} SELECT page_id, coalesce(string_agg(token, '' ORDER BY ord) FILTER (token NOT LIKE '<%'), '') AS text FROM tokens GROUP BY page_id")
def text_only(spark, sf_dir):
    parts = F.regexp_extract_all("html", F.lit("<[^>]+>|[^<]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.filter(parts, lambda t: ~t.startswith("<")), "").alias("text"))


@P.query(f"WITH {_TOKENS} SELECT page_id, ord, CAST(coalesce(sum(CASE WHEN token LIKE '<%' THEN 1 ELSE length(token) END) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM tokens QUALIFY token LIKE '<%'")
def element_offsets(spark, sf_dir):
    """Where each element stands in its page's projection."""
    w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.when(F.col("token").startswith("<"), 1).otherwise(F.length("token"))
    t = tokens(spark, sf_dir).withColumn("offset_", F.coalesce(F.sum(wide).over(w), F.lit(0)).cast("long"))
    return t.where(F.col("token").startswith("<")).select("page_id", "ord", "offset_")


@P.query(f"WITH {_TOKENS}, t AS (SELECT page_id, ord, token, sum(CASE WHEN token LIKE '<p%' OR token LIKE '<h1%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord) AS block FROM tokens) SELECT page_id, CAST(block AS BIGINT) AS block, coalesce(string_agg(token, '' ORDER BY ord) FILTER (token NOT LIKE '<%'), '') AS own FROM t GROUP BY ALL")
def own_text(spark, sf_dir):
    """Text of each block of a page, a block starting at every paragraph or heading."""
    w = Window.partitionBy("page_id").orderBy("ord")
    t = tokens(spark, sf_dir).withColumn("block", F.sum(F.when(F.col("token").startswith("<p") | F.col("token").startswith("<h1"), 1).otherwise(0)).over(w))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("token").startswith("<"), F.struct("ord", "token")))), lambda x: x["token"]), "")
    return t.groupBy("page_id", "block").agg(own.alias("own"))


_CLASS = "CASE WHEN tag IN ('script', 'style', 'nav') THEN 'skip' WHEN tag IN ('table', 'td') THEN 'table' WHEN tag IN ('p', 'h1', 'li', 'title') THEN 'unit' WHEN tag IN ('a', 'b', 'br') THEN 'protect' ELSE 'none' END"


@P.query(f"WITH {_TOKENS}, t AS (SELECT page_id, lower(regexp_extract(token, '^<([A-Za-z0-9]+)', 1)) AS tag FROM tokens WHERE token LIKE '<%' AND token NOT LIKE '</%') SELECT page_id, {_CLASS} AS kind, count(*) AS n FROM t GROUP BY ALL")
def rule_classify(spark, sf_dir):
    """Elements by the first rule that fits: skip, table, unit, protect."""
    tag = F.col("tag")
    kind = F.when(tag.isin("script", "style", "nav"), "skip").when(tag.isin("table", "td"), "table").when(tag.isin("p", "h1", "li", "title"), "unit").when(tag.isin("a", "b", "br"), "protect").otherwise("none")
    t = tokens(spark, sf_dir).where(F.col("token").startswith("<") & ~F.col("token").startswith("</")).withColumn("tag", F.lower(F.regexp_extract("token", "^<([A-Za-z0-9]+)", 1)))
    return t.groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@P.query(f"""WITH {_TOKENS}, t AS (SELECT page_id, lower(regexp_extract(token, '^<([A-Za-z0-9]+)', 1)) AS tag FROM tokens WHERE token LIKE '<%' AND token NOT LIKE '</%'), g AS (SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1)
             SELECT r.rule, coalesce(g.n, 0) AS n, coalesce(g.pages, 0) AS pages, coalesce(g.pages, 0) < (SELECT count(*) FROM pages) AS partial FROM (SELECT unnest(['p', 'h1', 'a', 'table', 'footer', 'math']) AS rule) r LEFT JOIN g ON g.tag = r.rule""")
def rule_coverage(spark, sf_dir):
    """Hits of every rule, also of those without any, and whether some page lacks it."""
    t = tokens(spark, sf_dir).where(F.col("token").startswith("<") & ~F.col("token").startswith("</")).withColumn("rule", F.lower(F.regexp_extract("token", "^<([A-Za-z0-9]+)", 1)))
    g = t.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))
    rules = spark.createDataFrame([(r,) for r in ("p", "h1", "a", "table", "footer", "math")], "rule string")
    total = F.broadcast(table(spark, sf_dir, "pages").agg(F.count("*").alias("total")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rules.join(g, "rule", "left").join(total, F.lit(True)).select("rule", zero("n").alias("n"), zero("pages").alias("pages"), (zero("pages") < F.col("total")).alias("partial"))


@P.query(f"""WITH {_TOKENS}, t AS (SELECT page_id, ord, lower(regexp_extract(token, '^<([A-Za-z0-9]+)', 1)) AS tag, token FROM tokens WHERE token LIKE '<%' AND token NOT LIKE '</%')
             SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages, min_by(token, page_id * 1000000 + ord) AS sample FROM t WHERE tag NOT IN ('p', 'a', 'b', 'h1', 'li', 'title') GROUP BY 1""")
def uncovered(spark, sf_dir):
    t = tokens(spark, sf_dir).where(F.col("token").startswith("<") & ~F.col("token").startswith("</")).withColumn("tag", F.lower(F.regexp_extract("token", "^<([A-Za-z0-9]+)", 1)))
    return t.where(~F.col("tag").isin("p", "a", "b", "h1", "li", "title")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.min_by("token", F.struct("page_id", "ord")).alias("sample"))


@P.query(f"""WITH {WORDS} SELECT word FROM words GROUP BY word HAVING count(DISTINCT doc_id) < (SELECT count(*) FROM documents) AND count(DISTINCT doc_id) >= 100""")
def partial_presence(spark, sf_dir):
    """Words of at least 100 but not all documents."""
    total = F.broadcast(table(spark, sf_dir, "documents").agg(F.count("*").alias("total")))
    g = words(spark, sf_dir).groupBy("word").agg(F.count_distinct("doc_id").alias("docs"))
    return g.join(total, (F.col("docs") < F.col("total")) & (F.col("docs") >= 100)).select("word")


@P.query(f"WITH {WORDS} SELECT length(word) AS bin, count(*) AS n FROM words GROUP BY 1")
def histogram(spark, sf_dir):
    return words(spark, sf_dir).groupBy(F.length("word").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@P.query("""WITH g AS (SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT source) AS sources, min(length(text)) AS span FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) >= 60 GROUP BY 1) SELECT digest, copies, sources, span * (copies - 1) AS repeated FROM g WHERE copies > 1 AND sources > 1""")
def exact_duplicates(spark, sf_dir):
    """Equal texts of 60 or more words across at least two sources, and the characters their copies take."""
    d = table(spark, sf_dir, "documents").where(F.regexp_count("text", F.lit(r"[^\s]+")) >= 60)
    g = d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.count_distinct("source").alias("sources"), F.min(F.length("text")).alias("span"))
    return g.where("copies > 1 and sources > 1").select("digest", "copies", "sources", (F.col("span") * (F.col("copies") - 1)).alias("repeated"))


@P.query(sql("SELECT doc_id, pos, last_value(CASE WHEN length(line) < 40 THEN substr(trim(line), 1, 80) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM lines"))
def asof_section(spark, sf_dir):
    """The heading (a short line) in force at each line; a heading belongs to its own section."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.length("line") < 40, F.substring(F.trim("line"), 1, 80))
    return lines(spark, sf_dir).select("doc_id", "pos", F.last(title, ignorenulls=True).over(w).alias("section"))


_PLAIN = "concat(' ', translate(lower({}), concat('.,', chr(10)), '   '), ' ')"


@P.query(f"""SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, {_PLAIN.format("split_part(text, '.', 1)")} AS term FROM benchmark) b
             JOIN documents d ON contains({_PLAIN.format("d.text")}, term)""")
def glossary_match(spark, sf_dir):
    """Benchmark openings (up to the first full stop) that a document contains as whole words.

    The longest word is an equi-join key, so only documents that have it are searched for the whole term.
    """
    plain = lambda c: F.concat(F.lit(" "), F.translate(F.lower(c), ".,\n", "   "), F.lit(" "))
    b = table(spark, sf_dir, "benchmark").select("item_id", plain(F.split_part("text", F.lit("."), F.lit(1))).alias("term"))
    seek = b.select("item_id", "term", F.array_max(F.transform(F.filter(F.split("term", " "), lambda w: w != ""), lambda w: F.struct(F.length(w), w.alias("w"))))["w"].alias("w"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", plain(F.col("text")).alias("low"))
    near = d.select("doc_id", F.explode(F.array_distinct(F.split("low", " "))).alias("w")).join(seek, "w").select("item_id", "doc_id", "term")
    return near.join(d, "doc_id").where(F.contains("low", "term")).select("item_id", "doc_id").distinct()


@P.query("""SELECT conv_id, turn, role, text AS source, nxt AS reply, length(text) AS n, length(nxt) AS m FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL AND role = 'user'""")
def sentence_pairs(spark, sf_dir):
    """Each user turn with the reply that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(w)).where("reply is not null and role = 'user'")
    return c.select("conv_id", "turn", "role", F.col("text").alias("source"), "reply", F.length("text").cast("long").alias("n"), F.length("reply").cast("long").alias("m"))


_ACCEPT = rf"""
WITH c AS (SELECT conv_id, turn, text, nxt FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL AND text IS NOT NULL),
l AS (SELECT conv_id, turn, side, unnest(range(len(ls))) AS line, unnest(ls) AS s FROM (SELECT conv_id, turn, 'unit' AS side, string_split(text, chr(10)) AS ls FROM c UNION ALL SELECT conv_id, turn, 'reply', string_split(nxt, chr(10)) FROM c)),
q AS (SELECT conv_id, turn, side, line, unnest(range(len(ps))) AS k, unnest(ps) AS s FROM (SELECT *, regexp_extract_all(s, '[0-9]+|[^0-9]+') AS ps FROM l)),
el AS (SELECT *, regexp_matches(s, '^[0-9]') AS el FROM q),
first_ AS (SELECT conv_id, turn, s AS id, min(row(line, k)) AS at_ FROM el WHERE side = 'unit' AND el GROUP BY ALL),
held AS (SELECT conv_id, turn, id, line FROM (SELECT conv_id, turn, s AS id, min(line) AS line FROM el WHERE side = 'unit' AND el GROUP BY ALL)),
faults AS (
  SELECT conv_id, turn, line, 0 AS k, 'foreign' AS why FROM l WHERE side = 'reply' AND line >= (SELECT count(*) FROM l u WHERE u.side = 'unit' AND u.conv_id = l.conv_id AND u.turn = l.turn)
  UNION ALL SELECT conv_id, turn, line, k + 1, 'foreign' FROM el WHERE side = 'reply' AND NOT el AND regexp_matches(s, '{A.FOREIGN}')
  UNION ALL SELECT e.conv_id, e.turn, e.line, e.k + 1, CASE WHEN h.id IS NULL THEN 'foreign' ELSE 'spans' END FROM el e LEFT JOIN held h ON h.conv_id = e.conv_id AND h.turn = e.turn AND h.id = e.s
    WHERE e.side = 'reply' AND e.el AND (h.id IS NULL OR h.line <> e.line)),
fault AS (SELECT conv_id, turn, min_by(why, row(line, k)) AS why FROM faults GROUP BY ALL),
lost AS (SELECT h.conv_id, h.turn, bool_or(n <> 1) AS lost FROM (SELECT h.conv_id, h.turn, h.id, count(e.s) AS n FROM held h LEFT JOIN el e ON e.side = 'reply' AND e.el AND e.conv_id = h.conv_id AND e.turn = h.turn AND e.s = h.id GROUP BY ALL) h GROUP BY ALL),
said AS (SELECT conv_id, turn, side, coalesce(string_agg(s, '' ORDER BY line, k) FILTER (WHERE NOT el), '') AS said, bool_or(line = 0 AND NOT el AND regexp_matches(s, '\S')) AS first_line,
  length(trim(regexp_replace(coalesce(string_agg(CASE WHEN el THEN chr(65532) ELSE s END, '' ORDER BY line, k) FILTER (WHERE side = 'reply' OR NOT el OR own), ''), '[\s\p{{Z}}]+', ' ', 'g'))) AS n FROM (SELECT el.*, f.id IS NOT NULL AS own FROM el LEFT JOIN first_ f ON f.conv_id = el.conv_id AND f.turn = el.turn AND f.id = el.s AND f.at_ = row(el.line, el.k)) GROUP BY conv_id, turn, side)
SELECT c.conv_id, c.turn, why IS NULL AS ok, why FROM (
  SELECT c.conv_id, c.turn, CASE WHEN fault.why IS NOT NULL THEN fault.why WHEN lost THEN 'elements' WHEN coalesce(u.first_line, false) AND NOT coalesce(r.first_line, false) THEN 'spans'
    WHEN regexp_matches(coalesce(u.said, ''), '\p{{L}}') AND NOT regexp_matches(coalesce(r.said, ''), '[\p{{L}}\p{{N}}]') THEN 'empty' WHEN coalesce(u.n, 0) >= {A.FLOOR_FROM} AND {A.FLOOR} * coalesce(r.n, 0) < u.n THEN 'short' END AS why
  FROM c LEFT JOIN fault USING (conv_id, turn) LEFT JOIN lost USING (conv_id, turn) LEFT JOIN said u ON u.conv_id = c.conv_id AND u.turn = c.turn AND u.side = 'unit' LEFT JOIN said r ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.side = 'reply') c
"""


@P.query(_ACCEPT)
def accept_rule(spark, sf_dir):
    """Each turn's next one judged as its reply: lines are spans, the first of which must stay, and numbers are elements."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt is not null and text is not null")

    def pieces(text: str):
        line = c.select("conv_id", "turn", F.posexplode(F.split(text, "\n")).alias("line", "s"))
        span = F.concat(F.lit("l"), F.col("line").cast("string"))
        spans = line.select("conv_id", "turn", F.struct("line", F.lit(0).alias("k")).alias("pos"), F.lit("span").alias("t"), span.alias("id"), F.array().cast("array<string>").alias("within"), (F.col("line") == 0).alias("must"), F.lit(None).cast("string").alias("s"))
        parts = line.select("conv_id", "turn", "line", span.alias("span"), F.posexplode(F.regexp_extract_all("s", F.lit("[0-9]+|[^0-9]+"), F.lit(0))).alias("k", "s"))
        el = F.col("s").rlike("^[0-9]")
        inner = parts.select("conv_id", "turn", F.struct("line", (F.col("k") + 1).alias("k")).alias("pos"), F.when(el, "el").otherwise("text").alias("t"), F.when(el, F.col("s")).alias("id"), F.array("span").alias("within"), F.lit(False).alias("must"), F.when(~el, F.col("s")).alias("s"))
        return spans.unionByName(inner).withColumn("unit", F.struct("conv_id", "turn")).drop("conv_id", "turn")

    # of a number that stands several times in a turn, the first is its element
    first = Window.partitionBy("unit", "t", "id").orderBy("pos")
    units = pieces("text").withColumn("_n", F.row_number().over(first)).where("t <> 'el' or _n = 1").drop("_n")
    replies = pieces("nxt").withColumn("reply", F.col("unit")).drop("must")
    return A.refused(units, replies).select("unit.conv_id", "unit.turn", F.col("why").isNull().alias("ok"), "why")


def _class_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '[{inside.replace(chr(39), chr(39) * 2)}]') THEN '{name}'" for name, inside in S.CLASSES.items()) + " ELSE 'X' END"


def _rule_sql(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_CUTS = rf"""
WITH {LINES}, signs AS (
  SELECT doc_id, pos, line, place, {_class_sql("c")} AS class FROM (SELECT doc_id, pos, line, unnest(string_split(line, '')) AS c, unnest(range(length(line))) AS place FROM (SELECT doc_id, pos, replace(line, chr(65532), ' ') AS line FROM lines) WHERE line <> '')
), spelled AS (
  SELECT doc_id, pos, line, string_agg(class, '' ORDER BY place) AS classes, list(place ORDER BY place) AS places FROM signs WHERE class <> 'E' GROUP BY ALL
), candidates AS (
  SELECT doc_id, pos, line, places, k, left(classes, k) AS before, substr(classes, k + 1) AS rest FROM (SELECT *, unnest(range(1, length(classes))) AS k FROM spelled)
  WHERE classes[k] IN ('A', 'T', 'C', 'S', 'P')
), ends AS (
  SELECT doc_id, pos, line, places[k + 1] AS cut FROM candidates
  WHERE regexp_matches(before, 'P$') OR regexp_matches(before, '[AT]C*S*$') AND NOT (
    regexp_matches(before, 'A$') AND regexp_matches(rest, '^N') OR regexp_matches(before, '[UL]A$') AND regexp_matches(rest, '^U')
    OR regexp_matches(before, 'AC*S*$') AND regexp_matches(rest, '^[^OULPAT]*L') OR regexp_matches(rest, '^[KAT]')
    OR regexp_matches(before, '[AT]C*$') AND regexp_matches(rest, '^[CSP]') OR regexp_matches(before, '[AT]C*S+$') AND regexp_matches(rest, '^[SP]'))
), pieces AS (
  SELECT doc_id, pos, cut, substr(line, coalesce(lag(cut) OVER w, 0) + 1, cut - coalesce(lag(cut) OVER w, 0)) AS piece,
    substr(line, cut + 1, coalesce(lead(cut) OVER w, length(line)) - cut) AS following FROM ends WINDOW w AS (PARTITION BY doc_id, pos ORDER BY cut)
), tails AS (SELECT *, regexp_replace(piece, '[\s\x{{A0}}]+$', '') AS tail FROM pieces)
SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id, pos ORDER BY cut) - 1)::INTEGER AS ord, cut::INTEGER AS cut FROM tails
WHERE NOT ({_rule_sql("tail", S.ABBREVIATED)} AND (NOT {_rule_sql("tail", S.MAY_END)} OR {_rule_sql("following", S.GOES_ON)}))
  AND NOT {_rule_sql("tail", S.CASE)} AND NOT ({_rule_sql("tail", S.NUMBERED_PART)} AND {_rule_sql("following", S.ITS_NUMBER)})
  AND NOT ({_rule_sql("tail", S.MONTH)} AND {_rule_sql("following", S.ITS_DATE)}) AND NOT ({_rule_sql("tail", S.LABEL)} AND {_rule_sql("following", S.NUMBERED)})
"""


@P.query(_CUTS)
def sentence_cuts(spark, sf_dir):
    """Where each sentence of a line after the first begins, by break classes and the rules that join pieces."""
    return S.sentence_cuts(lines(spark, sf_dir).withColumn("line", F.replace("line", F.lit(S.ELEMENT), F.lit(" "))), ["doc_id", "pos"], "line")


@P.query(sql("SELECT doc_id, bool_and(length(line) >= 0) AND sum(length(line) + 1) - 1 = max(n) AS valid FROM (SELECT l.*, length(d.text) AS n FROM lines l JOIN documents d USING (doc_id)) GROUP BY doc_id"))
def valid_sentences(spark, sf_dir):
    """Whether the lengths of a document's parts add up to its own."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    sizes = F.transform(F.split("text", "\n"), F.length)
    total = F.aggregate(sizes, F.lit(-1), lambda s, n: s + n + 1)
    return d.select("doc_id", (F.forall(sizes, lambda n: n >= 0) & (total == F.length("text"))).alias("valid"))


_PREFIXES = "a AS (SELECT doc_id, pos, ord, regexp_extract(word, '^(\\p{L}{2,5})\\.$', 1) AS stem FROM words WHERE regexp_matches(word, '^\\p{L}{2,5}\\.$')), f AS (SELECT DISTINCT doc_id, word FROM words WHERE regexp_matches(word, '^\\p{L}{3,}$'))"


@P.query(f"WITH {WORDS}, {_PREFIXES} SELECT a.doc_id, a.pos, a.ord, a.stem, min(f.word) AS full_ FROM a JOIN f ON a.doc_id = f.doc_id AND starts_with(f.word, a.stem) AND length(f.word) > length(a.stem) GROUP BY ALL")
def expand_abbrev(spark, sf_dir):
    """Words cut by a full stop with the first longer word of their document that they begin.

    A document's stems and longer words are sorted together where it is read, so a stem is followed by the words it
    begins; only documents that share an id are joined by it and the stem, every longer word under each of its beginnings.
    """
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", "text")
    several = cut(d.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    alone, shared = (d.join(several, "doc_id", how) for how in ("left_anti", "left_semi"))
    stem, long = r"^\p{L}{2,5}\.\z", r"(?<![^ \n])\p{L}{3,}+(?![^ \n])"
    in_line = lambda line: F.filter(F.split(line, " "), lambda w: w != "")

    cut_off = lambda pos: lambda w, ord_: F.when(w.rlike(stem), F.struct(F.regexp_replace(w, r"\.\z", "").alias("word"), F.lit(True).alias("stem"), pos.alias("pos"), ord_.alias("ord")))
    stems = F.flatten(F.transform(F.split("text", "\n"), lambda line, pos: F.filter(F.transform(in_line(line), cut_off(pos)), lambda x: x.isNotNull())))
    none = F.lit(None).cast("int")
    longer = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(long), F.lit(0))), lambda w: F.struct(w.alias("word"), F.lit(False).alias("stem"), none.alias("pos"), none.alias("ord")))

    def step(s: Column, x: Column) -> Column:
        one = F.struct(x["pos"].alias("pos"), x["ord"].alias("ord"), x["word"].alias("stem"), s["word"].alias("full_"))
        all_ = F.when(x["stem"] & s["word"].startswith(x["word"]), F.array_append(s["all"], one)).otherwise(s["all"])
        return F.struct(F.when(x["stem"], s["word"]).otherwise(x["word"]).alias("word"), all_.alias("all"))

    # from the last word back, a stem before the word that is spelled like it: the word met last is the first that the stem may begin
    start = F.struct(F.lit(None).cast("string").alias("word"), F.array().cast("array<struct<pos:int,ord:int,stem:string,full_:string>>").alias("all"))
    own = alone.select("doc_id", F.inline(F.aggregate(F.sort_array(F.concat(stems, longer), asc=False), start, step)["all"]))

    w = shared.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.posexplode(in_line(F.col("line"))).alias("ord", "word"))
    a = w.where(F.col("word").rlike(stem)).select("doc_id", "pos", "ord", F.regexp_replace("word", r"\.\z", "").alias("stem")).distinct()
    f = w.where(F.col("word").rlike(r"^\p{L}{3,}\z")).select("doc_id", "word").distinct()
    beginnings = F.transform(F.sequence(F.lit(2), F.least(F.length("word") - 1, F.lit(5))), lambda n: F.substring("word", F.lit(1), n))
    listed = f.select("doc_id", "word", F.explode(beginnings).alias("stem")).groupBy("doc_id", "stem").agg(F.min("word").alias("full_"))
    return own.unionByName(a.join(listed, ["doc_id", "stem"]))

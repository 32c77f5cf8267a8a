"""Bindings of the layout rows: every document's words are laid out on a 12-column grid, 50 lines per page."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions import patterns as X
from attestry.functions import tokens as T
from attestry.operators import layout as L
from attestry.plans.catalog import register
from attestry.plans.catalog import sql as Q
from attestry.scale import shared
from attestry.session import load_table


def words(spark, sf):
    """The word-box table: an input of these jobs, so it is materialised once."""
    return shared(spark, ("words", sf), lambda: lay_out(spark, sf))


def lay_out(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", F.posexplode(X.find_all(F.col("text"), r"\S+")).alias("i", "t"))
    j = F.col("i") % 600
    x0 = ((j % 12) * 50).cast("double")
    y0 = (F.floor(j / 12) * 14).cast("double")
    t = F.when(j % 60 == 0, F.concat(F.lit("○"), F.col("t"))).otherwise(F.col("t"))
    return d.select("doc_id", F.floor(F.col("i") / 600).cast("bigint").alias("page"), x0.alias("x0"), y0.alias("y0"),
                    (x0 + F.length(t) * 6).alias("x1"), (y0 + 10).alias("y1"), t.alias("text"))


def pages(spark, sf):
    return words(spark, sf).select("doc_id", "page").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(700.0))


W = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS t, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS i FROM documents),
w AS MATERIALIZED (SELECT doc_id, i // 600 AS page, ((i % 12) * 50)::double AS x0, ((i % 600) // 12 * 14)::double AS y0,
  ((i % 12) * 50)::double + length(t0) * 6 AS x1, ((i % 600) // 12 * 14)::double + 10 AS y1, t0 AS text
  FROM (SELECT *, CASE WHEN i % 60 = 0 THEN '○' || t ELSE t END AS t0 FROM tok)),
pg AS (SELECT DISTINCT doc_id, page FROM w)"""
EDGES = """hd AS (SELECT doc_id, page, (x0 + x1) / 2 AS c FROM w WHERE y0 < 140),
gp AS (SELECT *, c - lag(c) OVER o AS gap, (c + lag(c) OVER o) / 2 AS mid FROM hd WINDOW o AS (PARTITION BY doc_id, page ORDER BY c)),
tp AS (SELECT * FROM gp WHERE gap > 30 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY gap DESC, mid DESC) <= 5),
ed AS MATERIALIZED (SELECT pg.doc_id, pg.page, CASE WHEN count(mid) = 0 THEN [0e0, 120e0, 240e0, 360e0, 480e0, 600e0]
   ELSE [0e0] || list(mid ORDER BY mid) || [600e0] END AS edges FROM pg LEFT JOIN tp USING (doc_id, page) GROUP BY ALL)"""
LINES = """ln AS MATERIALIZED (SELECT doc_id, page, y0, string_agg(text, ' ' ORDER BY x0) AS text, avg((y0 + y1) / 2) AS yc FROM {src} GROUP BY doc_id, page, y0)"""
BLOCKS = """mw AS (SELECT w.* FROM w JOIN ed USING (doc_id, page) WHERE x1 <= edges[-2] - 12),
bw AS (SELECT *, sum(CASE WHEN contains(text, '○') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS b FROM mw),
bl AS MATERIALIZED (SELECT doc_id, page, b::bigint AS block_no, min(y0) AS y_top, max(y1) AS y_bottom, string_agg(line, chr(10) ORDER BY y) AS text FROM (
  SELECT doc_id, page, b, y0 AS y, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0) AS line FROM bw WHERE b > 0 GROUP BY doc_id, page, b, bw.y0) GROUP BY ALL)"""
DICT = """dc AS MATERIALIZED (SELECT t AS name FROM tok GROUP BY t ORDER BY count(*) DESC, t LIMIT 50)"""


def edges(spark, sf):
    return L.column_edges(words(spark, sf), pages(spark, sf))


def names(spark, sf):
    """Dictionary: the 50 most frequent words of the corpus (a top-k report)."""
    t = load_table(spark, sf, "documents").select(F.explode(X.find_all(F.col("text"), r"\S+")).alias("name"))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(50).select("name")


@register("l1_column_edges", f"WITH {W}, {EDGES} SELECT doc_id, page, len(edges) AS n_edges, round(list_sum(edges), 6) AS edge_sum, edges[-2] AS last_col_start FROM ed")
def l1(spark, sf):
    return edges(spark, sf).select(
        "doc_id", "page", F.size("edges").cast("bigint").alias("n_edges"),
        F.round(F.aggregate("edges", F.lit(0.0), lambda a, x: a + x), 6).alias("edge_sum"), "last_col_start")


@register("l1_column_edges_header")
def l1b(spark, sf):
    e = L.column_edges(words(spark, sf), pages(spark, sf), mode="header")
    return e.select("doc_id", "page", F.size("edges").cast("bigint").alias("n_edges"), "last_col_start")


@register("l2_cluster_lines", f"WITH {W}, {LINES.format(src='w')} SELECT doc_id, page, y0, md5(text) AS checksum FROM ln")
def l2(spark, sf):
    return L.cluster_lines(words(spark, sf)).select("doc_id", "page", "y0", F.md5("text").alias("checksum"))


@register("l3_filter_lines")
def l3(spark, sf):
    return L.filter_lines(L.cluster_lines(words(spark, sf))).select("doc_id", "page", "y0", F.md5("text").alias("checksum"))


@register("l4_layout_blocks", f"WITH {W}, {EDGES}, {BLOCKS} SELECT doc_id, page, block_no, y_top, y_bottom, md5(text) AS checksum FROM bl")
def l4(spark, sf):
    return L.layout_blocks(words(spark, sf), edges(spark, sf)).select(
        "doc_id", "page", F.col("block_no").cast("bigint").alias("block_no"), "y_top", "y_bottom", F.md5("text").alias("checksum"))


@register("l4_first_bullet", f"WITH {W} SELECT doc_id, page, min(y0) AS cut_y FROM w WHERE contains(text, '○') GROUP BY ALL")
def l4b(spark, sf):
    return L.first_bullet(words(spark, sf))


GRAMS = r"""lt AS (SELECT doc_id, page, y0, yc, string_split(text, ' ') AS ts FROM ln),
gr AS (SELECT DISTINCT doc_id, page, y0, yc, unnest(ts || list_transform(range(1, len(ts)), lambda i: ts[i] || ts[i + 1])
   || list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ts[i + 1] || ts[i + 2])) AS name
   FROM (SELECT doc_id, page, y0, yc, regexp_extract_all(regexp_replace(array_to_string(ts, ' '), '[,·/]+', ' ', 'g'), '\S+') AS ts FROM lt)),
mt AS MATERIALIZED (SELECT gr.* FROM gr SEMI JOIN dc USING (name))"""


@register("l7_match_ngrams", f"WITH {W}, {DICT}, {LINES.format(src='w')}, {GRAMS} SELECT doc_id, page, y0, name FROM mt")
def l7(spark, sf):
    return L.match_ngrams(L.cluster_lines(words(spark, sf)), names(spark, sf)).select("doc_id", "page", "y0", "name")


def label_rows(spark, sf):
    right = L.cluster_lines(words(spark, sf).where("x0 >= 500"), 8.0)
    hits = L.match_ngrams(right, names(spark, sf)).groupBy("doc_id", "page", "line_no").agg(F.collect_set("name").alias("labels"))
    none = F.array().cast("array<string>")
    return right.join(hits, ["doc_id", "page", "line_no"], "left").select("doc_id", "page", "y_center", F.coalesce("labels", none).alias("labels"))


@register("l5_assign_by_interval", f"""WITH {W}, {EDGES}, {BLOCKS}, {DICT}, {LINES.format(src='(SELECT * FROM w WHERE x0 >= 500)')}, {GRAMS},
ins AS (SELECT doc_id, page, block_no, string_agg(DISTINCT name, ',' ORDER BY name) AS labels FROM bl JOIN mt USING (doc_id, page)
  WHERE yc BETWEEN y_top - 5 AND y_bottom + 5 GROUP BY ALL),
rest AS (SELECT * FROM bl ANTI JOIN ins USING (doc_id, page, block_no)),
near AS (SELECT doc_id, page, block_no, arg_min(ln.yc, (least(abs(yc - y_top), abs(yc - y_bottom)), yc)) AS yc FROM rest JOIN ln USING (doc_id, page) GROUP BY ALL)
SELECT doc_id, page, block_no, labels, 'inside' AS how FROM ins UNION ALL
SELECT near.doc_id, near.page, block_no, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), ''), 'nearest' FROM near
 LEFT JOIN mt ON mt.doc_id = near.doc_id AND mt.page = near.page AND mt.yc = near.yc GROUP BY ALL""")
def l5(spark, sf):
    out = L.assign_by_interval(L.layout_blocks(words(spark, sf), edges(spark, sf)), label_rows(spark, sf))
    return out.select("doc_id", "page", F.col("block_no").cast("bigint").alias("block_no"), F.array_join("labels", ",").alias("labels"), "how")


@register("l6_to_grid", f"""WITH {W}, {EDGES}
SELECT doc_id, page, y0 + 5 AS row_y, len([e for e in edges if e < (x0 + x1) / 2])::bigint AS col_no, string_agg(text, ' ' ORDER BY x0) AS cell
FROM w JOIN ed USING (doc_id, page) GROUP BY ALL""")
def l6(spark, sf):
    g = L.to_grid(words(spark, sf), edges(spark, sf))
    return g.select("doc_id", "page", "row_y", F.col("col_no").cast("bigint").alias("col_no"), "cell")


@register("l8_strip_suffix_terms")
def l8(spark, sf):
    d = load_table(spark, sf, "documents")
    title = F.concat("text", F.lit(" 문화예술과 총무과"))
    s = L.strip_suffix_terms(title)
    return d.select("doc_id", F.md5(s["title"]).alias("checksum"), F.array_join(s["removed"], ",").alias("removed"))


@register("l9_deadline", r"""
WITH d AS (SELECT doc_id, text || ' 2024. 3. ' || (n_chars % 28 + 1) || '. end' AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(2,?0\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?') THEN
 replace(regexp_extract(t, '(2,?0\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?', 1), ',', '')::int || '. ' || regexp_extract(t, '(2,?0\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?', 2)::int
 || '. ' || regexp_extract(t, '(2,?0\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?', 3)::int || '.' ELSE '' END AS deadline,
 length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(2,?0\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?', ' ', 'g'),
   '2,?0\d{2}\.', ' ', 'g'), '\b\d{1,2}\.\s*\d{1,2}\.', ' ', 'g'), '\s{2,}', ' ', 'g'), '\.{2,}', '.', 'g'))) AS chars_left FROM d""")
def l9(spark, sf):
    d = load_table(spark, sf, "documents")
    t = F.concat(F.col("text"), F.lit(" 2024. 3. "), (F.col("n_chars") % 28 + 1).cast("string"), F.lit(". end"))
    return d.select("doc_id", X.extract_deadline(t).alias("deadline"), F.length(X.remove_dates(t)).cast("bigint").alias("chars_left"))


@register("l10_page_category")
def l10(spark, sf):
    c = X.page_category(F.col("text"))
    return load_table(spark, sf, "documents").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("docs"))


@register("l11_title_body", r"""
WITH l AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents),
j AS (SELECT doc_id, trim(regexp_replace(ls[1], '^\s*○+', '')) AS title, array_to_string(list_filter(list_transform(ls[2:], lambda x: trim(x)), lambda x: x <> ''), ' ') AS body FROM l),
b AS (SELECT doc_id, title, regexp_replace(regexp_replace(regexp_replace(body, '\s*([.?!])\s*', '\1' || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM j)
SELECT doc_id, md5(title) AS title, md5(CASE WHEN body = '' THEN '' WHEN starts_with(body, '-') THEN body ELSE '- ' || body END) AS body FROM b""")
def l11(spark, sf):
    s = X.split_title_body(F.col("text"))
    return load_table(spark, sf, "documents").select("doc_id", F.md5(s["title"]).alias("title"), F.md5(s["body"]).alias("body"))


LANGS = ("en", "de", "fr")


@register("l12_merge_labels", r"""
SELECT doc_id, array_to_string(list_filter(CASE WHEN lang = substr(text, 1, 2) THEN [lang] ELSE [lang, lower(substr(text, 1, 2))] END, lambda x: x IN ('en', 'de', 'fr')), ',') AS labels
FROM documents WHERE lang <> lower(substr(text, 1, 2)) UNION ALL
SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE '' END FROM documents WHERE lang = lower(substr(text, 1, 2))""")
def l12(spark, sf):
    m = L.merge_labels(F.array("lang"), F.array(F.lower(F.substring("text", 1, 2))), LANGS)
    return load_table(spark, sf, "documents").select("doc_id", F.array_join(m, ",").alias("labels"))


@register("l13_zip_longest", r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a, regexp_extract_all(text, '\d+') AS b FROM documents)
SELECT doc_id, i AS pos, coalesce(md5(a[i]), '-') AS a, coalesce(b[i], '-') AS b FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM d)""")
def l13(spark, sf):
    z = L.zip_longest(F.split("text", "\n"), X.find_all(F.col("text"), r"\d+"))
    d = load_table(spark, sf, "documents").select("doc_id", F.posexplode(z).alias("pos", "z"))
    dash = F.lit("-")
    return d.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.coalesce(F.md5("z.left"), dash).alias("a"), F.coalesce("z.right", dash).alias("b"))


def records(spark, sf):
    """One record per line: the first word is the title, the line the body, the language a label."""
    l = load_table(spark, sf, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("index", "body"))
    return l.select("doc_id", F.lit(1).alias("page"), "index", F.col("source").alias("category"), F.get(F.split("body", " "), F.lit(0)).alias("title"), "body",
                    F.array("lang").alias("departments"), F.when(F.length("body") % 2 == 0, "soon").otherwise("").alias("deadline"))


REC = r"""rec AS (SELECT doc_id, source AS category, lang, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
rc AS (SELECT *, string_split(body, ' ')[1] AS title FROM rec)"""


@register("l14_dedupe_records", f"""WITH {REC} SELECT doc_id, i AS line_no, md5(body) AS checksum FROM rc
QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(title || '||' || body || '||' || lang, '\\s+', ' ', 'g') ORDER BY i) = 1""")
def l14(spark, sf):
    out = L.dedupe_records(records(spark, sf))
    return out.select("doc_id", (F.col("index") + 1).cast("bigint").alias("line_no"), F.md5("body").alias("checksum"))


@register("l15_extraction_report", f"""WITH {REC} SELECT count(*) AS records, count(*) AS with_labels, count(*) FILTER (length(body) % 2 = 0) AS with_deadline,
 count(*) FILTER (regexp_matches(trim(title), '(ing|tion)$')) AS suffix_issues, count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) AS out_of_list FROM rc""")
def l15(spark, sf):
    return L.extraction_report(records(spark, sf), LANGS, ("ing", "tion"))


@register("l16_directive_summary", """
SELECT doc_id, 'category' AS kind, 1::bigint AS n_values, source AS value_list FROM documents UNION ALL SELECT doc_id, 'department', 1, lang FROM documents""")
def l16(spark, sf):
    return L.directive_summary(records(spark, sf))


@register("l17_merge_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, trim(line) AS line FROM l WHERE trim(line) <> ''),
g AS (SELECT *, CASE WHEN regexp_matches(lag(line) OVER o, '[.?!다]\s*$') THEN 1 ELSE 0 END AS n FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sno FROM g)
SELECT doc_id, sno::bigint AS sentence_no, md5(string_agg(line, ' ' ORDER BY i)) AS checksum FROM s GROUP BY ALL""")
def l17(spark, sf):
    l = load_table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("y0", "text"))
    return L.merge_lines(l).select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.md5("text").alias("checksum"))

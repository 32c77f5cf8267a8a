"""The registered operator queries and the pipeline, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import collocations, decontaminate, digests, htmltext, langid, maxscore, minhash, resample, runs, sentencepieces, suffixdedup, toxicity, urltrust
from attestry.session import load_table

#: The model file of the SentencePiece queries.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
k AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT node, len(s) AS n, unnest(s) AS g FROM k),
p AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.g = b.g AND a.node < b.node
      GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, root) AS (SELECT node, node FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, s.doc_id = coalesce(c.root, s.doc_id) AS kept
FROM s LEFT JOIN k ON list_sort(s.s) = k.s LEFT JOIN c ON c.node = k.node
"""


@register("op8_minhash_near_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, i, hash(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS g
                   FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM t)),
d AS (SELECT w.r, w.i FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) x ON w.g = x.g),
j AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM d),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM j),
s AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, run),
p AS (SELECT s.r, s.a, substr(t.h, CAST(2 * coalesce(lag(s.b) OVER (PARTITION BY s.r ORDER BY s.a), 0) + 1 AS BIGINT),
             CAST(2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.r ORDER BY s.a), 0)) AS BIGINT)) AS piece
      FROM s JOIN t ON s.r = t.r),
e AS (SELECT s.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM s GROUP BY s.r),
q AS (SELECT r, string_agg(piece, '' ORDER BY a) AS head FROM p GROUP BY r)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(e.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(e.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN e.r IS NULL THEN t.h ELSE q.head || substr(t.h, CAST(2 * e.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM t LEFT JOIN e ON e.r = t.r LEFT JOIN q ON q.r = t.r
"""


@register("op5_suffix_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.repeated_spans(load_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op7_importance_resampling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("row.doc_id", "n_grams", "log_weight", "key", "selected")


@register("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode_documents(load_table(spark, sf_dir, "documents"), sentencepieces.model_bytes(MODEL_PATH), carry=["doc_id"])
    return out.select("row.doc_id", "ids", "n_ids", "round_trip", "parity")


_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))"
_CANON = rf"""list_transform(w, lambda x, i: CASE
  WHEN regexp_matches(x, '\p{{N}}') THEN '#'
  WHEN lower(regexp_replace(x, '\P{{L}}+', '', 'g')) IN ({_UNITS}) AND i > 1 AND regexp_matches(w[i - 1], '\p{{N}}') THEN '@'
  WHEN regexp_matches(regexp_replace(x, '\P{{L}}+', '', 'g'), '^\p{{Lu}}') AND NOT (i = 1 OR regexp_matches(w[i - 1], '[.!?:;|][''")\]]*$')) THEN '$'
  ELSE lower(regexp_replace(x, '\P{{L}}+', '', 'g')) END)"""
_BARE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_TOKENS = rf"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([{_BARE}])', ' \1 ', 'g'), '[{_BARE}\p{{L}}\p{{M}}\p{{N}}]+')"
OP2_SQL = rf"""
WITH bw AS (SELECT item_id, text, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, w, {_CANON} AS t FROM bw WHERE len(w) >= 5),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, w, {_CANON} AS t FROM dw),
bi AS (SELECT item_id, w, t, least(8, len(t)) AS n, unnest(range(1, len(t) - least(8, len(t)) + 2)) AS q FROM b),
bq AS (SELECT *, t[q : q + n - 1] AS win FROM bi
       WHERE 2 * len(list_filter(t[q : q + n - 1], lambda c: c NOT IN ('#', '$', '@'))) >= n),
bn AS (SELECT item_id, count(DISTINCT q) AS n_windows FROM bq GROUP BY item_id),
di AS (SELECT r, unnest(range(1, len(t) - n + 2)) AS p, n, t FROM d, (SELECT DISTINCT n FROM bq) WHERE len(t) >= n),
m AS (SELECT DISTINCT di.r, bq.item_id, bq.w AS bw, bq.t AS bt, di.p - bq.q AS shift, bq.q, bq.n
      FROM (SELECT r, p, n, t[p : p + n - 1] AS win FROM di) di JOIN bq ON di.win = bq.win AND di.n = bq.n),
a AS (SELECT DISTINCT r, item_id, shift, bw, bt, unnest(range(q, q + n)) AS j FROM m),
s AS (SELECT DISTINCT a.r, item_id, shift, j, bt[j] AS kind,
        lower(regexp_replace(bw[j], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS asked,
        lower(regexp_replace(d.w[j + shift], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS given
      FROM a JOIN d ON d.r = a.r WHERE bt[j] IN ('#', '$', '@')),
c AS (SELECT DISTINCT r, item_id, shift, j FROM (SELECT *,
        min(given) OVER (PARTITION BY r, item_id, shift, kind, asked) <> max(given) OVER (PARTITION BY r, item_id, shift, kind, asked)
        OR min(asked) OVER (PARTITION BY r, item_id, shift, kind, given) <> max(asked) OVER (PARTITION BY r, item_id, shift, kind, given) AS clash FROM s)
      WHERE clash AND asked <> given),
k AS (SELECT m.r, m.item_id, count(DISTINCT m.q) / any_value(bn.n_windows) AS share FROM m JOIN bn ON bn.item_id = m.item_id
      ANTI JOIN c ON c.r = m.r AND c.item_id = m.item_id AND c.shift = m.shift AND c.j BETWEEN m.q AND m.q + m.n - 1 GROUP BY m.r, m.item_id),
vt AS (SELECT item_id, {_TOKENS} AS tk, {_CANON} AS t, least(8, len(w)) AS n FROM bw),
vb AS (SELECT DISTINCT item_id, tk, least(8, len(tk)) AS n FROM vt WHERE len(tk) >= 5 AND (len(t) < 5 OR len(list_filter(range(1, len(t) - n + 2),
        lambda q: 2 * len(list_filter(t[q : q + n - 1], lambda x: x NOT IN ('#', '$', '@'))) < n)) > 0)),
vq AS MATERIALIZED (SELECT item_id, n, q, tk[q : q + n - 1] AS win FROM (SELECT *, unnest(range(1, len(tk) - n + 2)) AS q FROM vb)),
vn AS (SELECT item_id, count(DISTINCT q) AS n_windows FROM vq GROUP BY item_id),
vd AS (SELECT row_number() OVER () AS r, {_TOKENS} AS tk FROM documents WHERE (SELECT count(*) FROM vq) > 0),
vw AS (SELECT DISTINCT r, n, tk[p : p + n - 1] AS win FROM (SELECT r, n, tk, unnest(range(1, len(tk) - n + 2)) AS p FROM vd, (SELECT DISTINCT n FROM vq) WHERE len(tk) >= n)),
v AS (SELECT r, vq.item_id, count(DISTINCT q) / any_value(n_windows) AS share FROM vw JOIN vq ON vw.win = vq.win AND vw.n = vq.n JOIN vn ON vn.item_id = vq.item_id GROUP BY r, vq.item_id),
u AS (SELECT r, item_id, max(share) AS share FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY r, item_id),
f AS (SELECT r, max(share) AS best, coalesce(list(item_id ORDER BY item_id) FILTER (share >= 0.5), []) AS ids FROM u GROUP BY r)
SELECT d.doc_id, coalesce(len(f.ids), 0) > 0 AS contaminated, CAST(coalesce(len(f.ids), 0) AS BIGINT) AS n_items,
       coalesce(f.ids, []) AS item_ids, coalesce(f.best, 0.0) AS best_coverage
FROM d LEFT JOIN f ON f.r = d.r
"""


@register("op2_template_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark")).drop("k1", "k2")


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(load_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op3_maxscore_topk", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load_table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@register("op10_link_trust")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge(load_table(spark, sf_dir, "pages"))


@register("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(load_table(spark, sf_dir, "pages"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_id
      FROM d WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, h AS text_sha256 FROM g
"""


@register("op12_exact_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.deduplicate(load_table(spark, sf_dir, "documents")).drop("known")


# CRC-32 bit by bit.  A diagonal of lag q >= 2 that makes a run holds the same six words q apart: equal blocks of six are
# put together to stretches, and a stretch is a run if no smaller period gives the same one.
OP13_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                  flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(0, 8), lambda k: CAST((ascii(c) >> k) & 1 AS BIGINT)))) AS bits
           FROM documents),
c AS (SELECT r, doc_id, w, len(w) AS n,
             xor(list_reduce(list_prepend(4294967295, bits), lambda x, y: xor(xor(x, y) >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM b),
g AS (SELECT r, doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 END AS g FROM c),
e AS (SELECT r, doc_id, w, n, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM e),
v AS MATERIALIZED (SELECT r, i, w[i + 1] AS word, CASE WHEN i + 6 <= n THEN array_to_string(w[i + 1 : i + 6], ' ') END AS six
                   FROM (SELECT r, n, w, unnest(range(0, n)) AS i FROM t)),
q AS (SELECT x.r, x.i - y.i AS q, x.i, 6 AS wide FROM v x JOIN v y ON x.r = y.r AND x.six = y.six AND x.i > y.i + 1
      UNION ALL SELECT r, 1, i, 1 FROM (SELECT r, i, word = lag(word) OVER (PARTITION BY r ORDER BY i) AS same FROM v) WHERE same),
j AS (SELECT r, q, wide, min(i) - q AS s, max(i) - min(i) + wide + q AS m
      FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q) GROUP BY r, q, wide, island),
k AS MATERIALIZED (SELECT r, s, m, min(q) AS q FROM j WHERE m >= greatest(6, 4 * q) GROUP BY r, s, m),
f AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listing FROM k GROUP BY r),
l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY r ORDER BY m DESC, s, q) = 1),
o AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM k),
z AS (SELECT v.r, string_agg(word, ' ' ORDER BY v.i) AS left_text FROM v ANTI JOIN o ON o.r = v.r AND o.i = v.i GROUP BY v.r)
SELECT t.doc_id, coalesce(f.n_runs, 0) AS n_runs, CAST(l.s AS BIGINT) AS start, CAST(l.m AS BIGINT) AS length, CAST(l.q AS BIGINT) AS period,
       CAST(1000 * l.m // l.q AS BIGINT) AS exponent_milli, sha256(coalesce(f.listing, '')) AS runs_sha256, sha256(coalesce(z.left_text, '')) AS collapsed_sha256
FROM t LEFT JOIN f ON f.r = t.r LEFT JOIN l ON l.r = t.r LEFT JOIN z ON z.r = t.r
"""


@register("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(load_table(spark, sf_dir, "documents"), carry=["doc_id"], change=runs.cycled, keep_text=False)
    best = F.col("longest")
    return out.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP11_SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
f AS MATERIALIZED (SELECT lang, n, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, n, phrase HAVING count(*) >= 10),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
k AS (SELECT lang, n, phrase, f AS a, unnest(range(1, n)) AS k, w FROM f WHERE n > 1),
c AS (SELECT k.lang, k.n, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1 : k.k], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1 : k.n], ' ')),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(w[1 : 2], ' ') AS phrase FROM f WHERE n = 3
                                             UNION ALL SELECT lang, f, array_to_string(w[2 : 3], ' ') FROM f WHERE n = 3) GROUP BY lang, phrase),
x AS (SELECT s.* FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * s.a),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
SELECT y.lang, y.rank, y.phrase, y.a, y.l, y.r, CAST(t.n AS BIGINT) AS n, y.score FROM y JOIN t ON t.lang = y.lang WHERE rank <= 2000
"""


@register("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load_table(spark, sf_dir, "documents"))

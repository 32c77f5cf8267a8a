"""Bindings of the session and conversation rows: conversations are the sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions.patterns import find_all
from attestry.operators import dialog as K
from attestry.operators import scope as T
from attestry.operators import sessions as W
from attestry.operators.lexical import bm25_topk, norm_by_max
from attestry import params as P
from attestry.plans.catalog import register
from attestry.plans.catalog import sql as Q
from attestry.plans.catalog.retrieval import lexical_of
from attestry.scale import shared
from attestry.session import load_table
from attestry.sources import records as SR


def messages(spark, sf):
    """Turns as messages; a message is an hour after the session number's start, plus a minute per turn."""
    c = load_table(spark, sf, "conversations")
    minutes = F.col("conv_id") * 60 + F.col("turn")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
                    F.timestamp_seconds(minutes * 60 + 1704067200).alias("ts"))


MSG = """m AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content, 1704067200 + (conv_id * 60 + turn) * 60 AS sec FROM conversations)"""


@register("w1_session_context", f"WITH {MSG} SELECT session_id, seq, role, md5(content) AS checksum FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4")
def w1(spark, sf):
    return W.session_context(messages(spark, sf), 4).select("session_id", "seq", "role", F.md5("content").alias("checksum"))


@register("w2_anchor_sources", f"""WITH {MSG}, a AS (SELECT *, length(content) > 900 AS usable FROM m WHERE role = 'assistant')
SELECT session_id, coalesce(min(seq) FILTER (usable), max(seq)) AS anchor_seq FROM a GROUP BY session_id""")
def w2(spark, sf):
    m = messages(spark, sf).withColumn("sources", F.when(F.length("content") > 900, F.array(F.col("session_id"))))
    return W.anchor_sources(m).select("session_id", "anchor_seq")


@register("w4_dedupe_first", """SELECT role, min_turn.conv_id AS session_id, min_turn.turn AS seq FROM (
 SELECT role, length(text) AS n, min(struct_pack(conv_id := conv_id, turn := turn)) AS min_turn FROM conversations GROUP BY role, length(text))""")
def w4(spark, sf):
    m = messages(spark, sf).withColumn("n", F.length("content"))
    return W.dedupe_first(m, ["role", "n"], ["session_id", "seq"]).select("role", "session_id", "seq")


@register("w5_bounded_facts", """WITH l AS (SELECT lang AS session_id, source AS doc_id, doc_id AS seq, unnest(string_split(text, chr(10))) AS text FROM documents),
u AS (SELECT session_id, doc_id, text, min(seq) AS seq FROM l WHERE text <> '' GROUP BY ALL)
SELECT session_id, doc_id, seq, md5(text) AS checksum FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, doc_id DESC, text DESC) <= 50""")
def w5(spark, sf):
    d = load_table(spark, sf, "documents")
    facts = d.select(F.col("lang").alias("session_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("seq"), F.explode(F.split("text", "\n")).alias("text"))
    return W.bounded_facts(facts).select("session_id", "doc_id", "seq", F.md5("text").alias("checksum"))


SES = """s AS (SELECT session_id, arg_min(content, seq) FILTER (role = 'user') AS first_user, count(*) AS message_count, max(sec) AS sec FROM m GROUP BY session_id)"""


@register("w6_list_sessions", f"WITH {MSG}, {SES} SELECT session_id, message_count FROM s ORDER BY sec DESC, session_id LIMIT 20 OFFSET 20")
def w6(spark, sf):
    return W.list_sessions(W.session_table(messages(spark, sf)), page=2).select("session_id", "message_count")


@register("w6_list_sessions_cursor", f"""WITH {MSG}, {SES} SELECT session_id, message_count FROM s WHERE sec < 1704067200 + 50 * 3600 ORDER BY sec DESC, session_id LIMIT 20""")
def w6b(spark, sf):
    cursor = F.timestamp_seconds(F.lit(1704067200 + 50 * 3600))
    t = W.session_table(messages(spark, sf))
    return W.list_sessions(t, after=(cursor, 10**9)).select("session_id", "message_count")


TITLES = """t AS (SELECT session_id, substr(first_user, 1, 30) || CASE WHEN length(first_user) > 30 THEN '...' ELSE '' END AS title FROM s WHERE first_user IS NOT NULL)"""


@register("w7_search_sessions", f"""WITH {MSG}, {SES}, {TITLES}, h AS (SELECT session_id, count(*) AS n, arg_min(content, seq) AS c FROM m WHERE contains(lower(content), 'tion') GROUP BY session_id),
r AS (SELECT session_id, title, (CASE WHEN contains(lower(title), 'tion') THEN 10 ELSE 0 END + coalesce(n, 0))::bigint AS score, c FROM t LEFT JOIN h USING (session_id)),
p AS (SELECT *, strpos(lower(c), 'tion') - 1 AS pos FROM r WHERE score > 0 ORDER BY score DESC, session_id LIMIT 20)
SELECT session_id, title, score, CASE WHEN pos > 50 THEN '...' ELSE '' END || substr(c, greatest(0, pos - 50) + 1, least(length(c), pos + 54) - greatest(0, pos - 50)) ||
 CASE WHEN pos + 54 < length(c) THEN '...' ELSE '' END AS preview FROM p""")
def w7(spark, sf):
    m = messages(spark, sf)
    return W.search_sessions(m, W.session_titles(m), "tion")


@register("w9_expired_sessions", f"WITH {MSG}, {SES} SELECT session_id FROM s WHERE sec < 1704067200 + 3 * 86400 - 1 * 86400")
def w9(spark, sf):
    now = F.timestamp_seconds(F.lit(1704067200 + 3 * 86400))
    return W.expired_sessions(W.session_table(messages(spark, sf)), now, 1).select("session_id")


@register("w10_session_titles", f"WITH {MSG}, {SES}, {TITLES} SELECT session_id, title FROM t")
def w10(spark, sf):
    return W.session_titles(messages(spark, sf))


ENDINGS = "|".join(P.TITLE_NOUN_ENDINGS)


@register("w10_keyword_titles", rf"""WITH {MSG},
n AS (SELECT session_id, seq, content AS c, regexp_extract_all(content, '[\p{{L}}]{{2,}}(?:{ENDINGS})') AS a, regexp_extract_all(content, '[\p{{L}}]{{3,}}') AS b, regexp_extract_all(content, '\S+') AS w FROM m WHERE role = 'user'),
p AS (SELECT *, CASE WHEN len(a) > 0 THEN a ELSE b END AS x FROM n),
k AS (SELECT *, list_transform(list_sort(list_transform(list_filter(x, lambda y, i: list_position(x, y) = i), lambda y, i: {{'n': -length(y), 'i': i, 'w': y}})), lambda s: s.w) AS ranked, trim(substr(array_to_string(w[1:5], ' '), 1, 20)) AS head FROM p),
t AS (SELECT *, CASE WHEN len(x) > 0 THEN array_to_string(ranked[1:2], ' ') ELSE (CASE WHEN length(head) < 5 THEN trim(substr(c, 1, 20)) ELSE head END) || (CASE WHEN length(c) > 20 THEN '...' ELSE '' END) END AS t1 FROM k),
u AS (SELECT *, CASE WHEN length(t1) < 3 THEN trim(substr(c, 1, 20)) ELSE t1 END AS t2 FROM t)
SELECT session_id, seq, CASE WHEN length(c) < 5 THEN '새 대화' ELSE substr(t2, 1, 20) END AS title FROM u""")
def w10b(spark, sf):
    return messages(spark, sf).where("role = 'user'").select("session_id", "seq", W.keyword_title(F.col("content"), letters=r"\p{L}").alias("title"))


@register("s10_nest_sessions", f"""WITH {MSG} SELECT session_id, (seq // 3)::bigint AS segment, count(*) AS message_count, md5(string_agg(role || content, '|' ORDER BY seq)) AS checksum FROM m GROUP BY ALL""")
def s10(spark, sf):
    n = SR.nest_sessions(messages(spark, sf), 3)
    text = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], x["content"])), "|")
    return n.select("session_id", "segment", "message_count", F.md5(text).alias("checksum"))


@register("s10_unnest_sessions", f"WITH {MSG} SELECT session_id, seq, role, md5(content) AS checksum FROM m")
def s10b(spark, sf):
    return SR.unnest_sessions(SR.nest_sessions(messages(spark, sf), 3)).select("session_id", "seq", "role", F.md5("content").alias("checksum"))


@register("k1_summarise_turns", f"""WITH {MSG} SELECT session_id, (seq // 2)::bigint AS delta_no, string_agg(role || ': ' || trim(regexp_replace(trim(content), '\\[[0-9]+\\]', '', 'g')), ' | ' ORDER BY seq) AS delta_text
FROM m WHERE trim(content) <> '' GROUP BY ALL""")
def k1(spark, sf):
    return K.summarise_turns(messages(spark, sf))


@register("k2_extract_entities", f"""WITH {MSG}, w AS (SELECT session_id, seq, unnest(regexp_extract_all(content, '[\\p{{L}}]{{3,}}')) AS entity FROM m WHERE role = 'assistant')
SELECT session_id, entity, min(seq) AS seq FROM w GROUP BY ALL""")
def k2(spark, sf):
    return K.extract_entities(messages(spark, sf)).select("session_id", "entity", "seq")


@register("k4_cluster_variants")
def k4(spark, sf):
    return K.cluster_variants(K.extract_entities(messages(spark, sf)))


@register("k5_merge_entities", """WITH a AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}]{8,}') AS p, regexp_extract_all(lower(text), '[\\p{L}]{9,}') AS c FROM documents)
SELECT doc_id, len(list_distinct(p || c))::bigint AS n_entities, coalesce((p || c)[1], '') AS first FROM a""")
def k5(spark, sf):
    t = F.col("text")
    m = K.merge_entities(find_all(t, r"\p{L}{8,}"), find_all(F.lower(t), r"\p{L}{9,}"))
    return load_table(spark, sf, "documents").select("doc_id", F.size(m).cast("bigint").alias("n_entities"), F.coalesce(F.get(m, F.lit(0)), F.lit("")).alias("first"))


@register("k6_key_terms")
def k6(spark, sf):
    return K.key_terms(messages(spark, sf))


def turns(spark, sf):
    m = messages(spark, sf)
    w = Window.partitionBy("session_id").orderBy("seq")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    ent = F.regexp_extract("content", r"\p{L}{3,}", 0)
    t = m.withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("content")), True).over(prior)).withColumn(
        "entity", F.last(F.when(F.col("role") == "assistant", ent), True).over(prior))
    return t.where("role = 'user'").select((F.col("session_id") * 1_000_000_000 + F.col("seq")).alias("query_id"), F.col("content").alias("query"), "last_user", "entity")


META = ("when", "avec", "nicht")


@register("k7_rewrite_queries", rf"""WITH {MSG}, x AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER p AS last_user,
 last_value(CASE WHEN role = 'assistant' THEN regexp_extract(content, '\p{{L}}{{3,}}') END IGNORE NULLS) OVER p AS entity
 FROM m WINDOW p AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT session_id * 1000000000 + seq AS query_id, content AS query, last_user, entity, regexp_extract_all(content, '[\p{{L}}]{{3,}}') AS qw, regexp_extract_all(entity, '[\p{{L}}]{{3,}}') AS ew FROM x WHERE role = 'user'),
r AS (SELECT *, CASE WHEN ({' OR '.join(f"contains(lower(query), '{k}')" for k in META)}) AND last_user IS NOT NULL THEN 'meta_question'
  WHEN entity IS NULL OR entity = '' THEN 'no_context_available' WHEN contains(lower(query), lower(entity)) THEN 'entity_already_present'
  WHEN len(qw) > 0 AND len(list_intersect(qw, ew)) = 0 THEN 'topic_change_no_overlap' ELSE 'context_enriched' END AS reason FROM t)
SELECT query_id, reason, md5(CASE WHEN reason = 'meta_question' THEN last_user WHEN reason = 'context_enriched' THEN entity || ' ' || query ELSE query END) AS checksum FROM r""")
def k7(spark, sf):
    return K.rewrite_queries(turns(spark, sf), meta=META).select("query_id", "reason", F.md5("search_query").alias("checksum"))


# ---- retrieval per user turn ---------------------------------------------------------------------------

def turn_hits(spark, sf):
    """Top ten documents of every user turn, retrieved once and shared (scores normalised per query)."""
    def build():
        q = messages(spark, sf).where("role = 'user'").select((F.col("session_id") * 1_000_000_000 + F.col("seq")).alias("query_id"), F.col("content").alias("text"))
        return norm_by_max(bm25_topk(q, lexical_of(spark, sf), 10)).withColumn("score", F.round("normalized_score", 6)).drop("normalized_score")

    return shared(spark, ("turn_hits", sf), build)


TURN_Q = "q AS (SELECT conv_id * 1000000000 + turn AS query_id, text FROM conversations WHERE role = 'user')"
TH = (f"WITH {TURN_Q}," + Q.bm25_ctes(10, out="th0") + """,
th AS MATERIALIZED (SELECT query_id, chunk_id AS doc_id, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score, rank FROM th0),
fst AS (SELECT query_id // 1000000000 AS conv, min(query_id) AS first_q FROM q GROUP BY ALL),
ctx AS MATERIALIZED (SELECT q.query_id, th.doc_id FROM q JOIN fst ON q.query_id // 1000000000 = conv JOIN th ON th.query_id = first_q WHERE q.query_id <> first_q)""")


def context_of(spark, sf):
    """Context documents of a later turn: the hits of its session's first question."""
    h = turn_hits(spark, sf)
    q = messages(spark, sf).where("role = 'user'").select((F.col("session_id") * 1_000_000_000 + F.col("seq")).alias("query_id"), "session_id")
    first = q.groupBy("session_id").agg(F.min("query_id").alias("first_q"))
    later = q.join(first, "session_id").where("query_id <> first_q").select("query_id", "first_q")
    return later.join(h.select(F.col("query_id").alias("first_q"), "doc_id"), "first_q").select("query_id", "doc_id")


def later_hits(spark, sf):
    return turn_hits(spark, sf).join(context_of(spark, sf).select("query_id").distinct(), "query_id", "left_semi")


FLAG = """fl AS (SELECT th.*, c.doc_id IS NOT NULL AS is_context, round(CASE WHEN c.doc_id IS NOT NULL THEN score * 1.15e0 ELSE score END, 6) AS boosted
  FROM th LEFT JOIN ctx c ON c.query_id = th.query_id AND c.doc_id = th.doc_id WHERE th.query_id IN (SELECT query_id FROM ctx)),
dc AS (SELECT query_id, max(boosted) FILTER (is_context) AS bc, max(boosted) FILTER (NOT is_context) AS bn FROM fl GROUP BY query_id),
de AS MATERIALIZED (SELECT query_id, coalesce(bc, 0) AS best_context, coalesce(bn, 0) AS best_new, CASE WHEN bc > 0 AND bn > 0 THEN round(bn - bc, 6) ELSE 0 END AS margin,
  CASE WHEN bc > 0 AND bn > 0 AND round(bn - bc, 6) > 0.03e0 THEN 'score_margin' WHEN bc IS NULL AND bn > 0 THEN 'no_context_results' ELSE 'context_preferred' END AS reason FROM dc)"""


@register("t1_two_stage_decision", TH + "," + FLAG + " SELECT query_id, best_context, best_new, margin, reason, reason <> 'context_preferred' AS changed FROM de")
def t1(spark, sf):
    d = T.two_stage_decision(T.two_stage_flags(later_hits(spark, sf), context_of(spark, sf)))
    return d.select("query_id", "best_context", "best_new", "margin", "reason", "changed")


@register("t1_two_stage", TH + "," + FLAG + """ SELECT query_id, doc_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY
 CASE WHEN is_context = (reason <> 'context_preferred') THEN 1 ELSE 0 END, boosted DESC, doc_id) AS position FROM fl JOIN de USING (query_id)""")
def t1b(spark, sf):
    return T.two_stage(later_hits(spark, sf), context_of(spark, sf)).select("query_id", "doc_id", "boosted", "position")


def scopes(spark, sf):
    """Scoped: hits among the context; expanded: the first five hits; unbounded: all hits."""
    h, ctx = later_hits(spark, sf), context_of(spark, sf)
    prev = ctx.groupBy("query_id").agg(F.collect_set("doc_id").alias("doc_ids"))
    return prev, h.join(ctx, ["query_id", "doc_id"], "left_semi"), h.where("rank <= 5"), h


T2 = """pv AS (SELECT query_id, list(DISTINCT doc_id) AS prev FROM ctx GROUP BY query_id),
sc AS (SELECT th.* FROM th SEMI JOIN ctx ON ctx.query_id = th.query_id AND ctx.doc_id = th.doc_id),
p AS (SELECT query_id, count(*) AS n, round(avg(score), 6) AS a, round(max(score), 6) AS m FROM sc GROUP BY query_id),
e AS (SELECT query_id, round(avg(score), 6) AS a, round(max(score), 6) AS m, list(DISTINCT doc_id) AS docs FROM th WHERE rank <= 5 GROUP BY query_id),
u AS (SELECT query_id, list(DISTINCT doc_id) AS docs FROM th GROUP BY query_id),
an AS (SELECT pv.query_id, coalesce(p.n, 0) AS pn, coalesce(p.a, 0) AS pa, coalesce(p.m, 0) AS pm, coalesce(e.a, 0) AS ea, coalesce(e.m, 0) AS em,
  [d for d in coalesce(e.docs, []) if NOT list_contains(prev, d)] AS enew, [d for d in coalesce(u.docs, []) if NOT list_contains(prev, d)] AS unew,
  coalesce(e.docs, []) AS ed, coalesce(u.docs, []) AS ud,
  CASE WHEN e.docs IS NULL THEN 1e0 ELSE round(len(list_intersect(prev, e.docs))::double / len(e.docs), 6) END AS ov FROM pv LEFT JOIN p USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN u USING (query_id)),
rs AS (SELECT *, CASE WHEN pn = 0 THEN 'no_primary_evidence' WHEN len(enew) > 0 AND (ea - pa >= 0.2e0 OR em - pm >= 0.2e0 * 1.5e0 OR ov < 0.4e0) THEN 'better_results_elsewhere'
  WHEN pa < 0.1e0 THEN 'low_primary_score' WHEN pm < 0.1e0 * 1.5e0 AND pn <= 2 THEN 'weak_primary_hits' WHEN len(enew) = 0 AND len(unew) > 0 THEN 'unbounded_has_new_docs' ELSE 'within_scope' END AS reason FROM an)"""


@register("t2_topic_change", TH + "," + T2 + """ SELECT query_id, reason, reason <> 'within_scope' AS changed, CASE WHEN pn = 0 THEN 0e0 ELSE ov END AS overlap, pa::double AS primary_avg, ea::double AS expanded_avg,
 array_to_string(list_sort(CASE WHEN pn = 0 THEN CASE WHEN len(ed) > 0 THEN ed ELSE ud END WHEN reason = 'within_scope' THEN enew WHEN len(enew) > 0 THEN enew WHEN reason = 'unbounded_has_new_docs' THEN unew
   WHEN len(ed) > 0 THEN ed ELSE ud END), ',') AS suggested FROM rs""")
def t2(spark, sf):
    out = T.topic_change(*scopes(spark, sf))
    return out.withColumn("suggested", F.array_join(F.sort_array("suggested"), ","))


def scope_turns(spark, sf):
    h = turn_hits(spark, sf)
    q = messages(spark, sf).where("role = 'user'").select((F.col("session_id") * 1_000_000_000 + F.col("seq")).alias("query_id"), F.col("content").alias("text"))
    ctx = context_of(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("previous"))
    n = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    none = F.array().cast("array<bigint>")
    return q.join(ctx, "query_id", "left").join(n, "query_id", "left").select(
        "query_id", F.when(F.length("text") > 300, F.array(F.lit(1).cast("bigint"))).otherwise(none).alias("requested"),
        F.when(F.length("text") > 100, F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint"))).otherwise(none).alias("session_docs"),
        F.coalesce("previous", none).alias("previous"), F.lit(True).alias("use_previous"), "n_hits")


@register("t3_resolve_scope", TH + "," + FLAG + """, bn AS (SELECT query_id, arg_max(doc_id, (boosted, -doc_id)) AS best_new_doc FROM fl WHERE NOT is_context GROUP BY query_id),
pv AS (SELECT query_id, list(DISTINCT doc_id) AS previous FROM ctx GROUP BY query_id),
md AS (SELECT q.query_id, previous, CASE WHEN length(text) > 300 THEN 'requested' WHEN previous IS NOT NULL THEN 'followup' WHEN length(text) > 100 THEN 'session' ELSE 'unbounded' END AS mode0,
  coalesce(reason, 'context_preferred') <> 'context_preferred' AS changed, best_new_doc, (SELECT count(*) FROM th WHERE th.query_id = q.query_id) AS n
  FROM q LEFT JOIN pv USING (query_id) LEFT JOIN de USING (query_id) LEFT JOIN bn USING (query_id))
SELECT query_id, CASE WHEN mode0 = 'followup' AND changed THEN 'expanded' ELSE mode0 END AS mode, CASE WHEN n = 0 THEN 'no_evidence' ELSE 'ok' END AS status,
 CASE WHEN mode0 = 'followup' AND changed THEN best_new_doc::varchar WHEN mode0 = 'requested' THEN '1' WHEN mode0 = 'followup' THEN array_to_string(list_sort(previous), ',') WHEN mode0 = 'session' THEN '2,3' ELSE '' END AS scope FROM md""")
def t3(spark, sf):
    d = T.two_stage_decision(T.two_stage_flags(later_hits(spark, sf), context_of(spark, sf)))
    out = T.resolve_scope(scope_turns(spark, sf), d)
    return out.withColumn("scope", F.coalesce(F.array_join("scope", ","), F.lit("")))


@register("t4_select_baseline", f"""WITH {MSG}, a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1 OR length(content) > 1200 AS st FROM m WHERE role = 'assistant')
SELECT session_id, seq, st AS stores_baseline, max(CASE WHEN st THEN seq END) OVER (PARTITION BY session_id ORDER BY seq) AS baseline_seq FROM a""")
def t4(spark, sf):
    a = messages(spark, sf).where("role = 'assistant'")
    return T.select_baseline(a, F.length("content") > 1200).select("session_id", "seq", "stores_baseline", "baseline_seq")


@register("t5_filter_scope", TH + """ SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM th
 WHERE query_id NOT IN (SELECT query_id FROM ctx) OR (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM ctx) QUALIFY position <= 5""")
def t5(spark, sf):
    return T.filter_scope(turn_hits(spark, sf), context_of(spark, sf), 5).select("query_id", "doc_id", "position")


EVID = """ev AS (SELECT query_id, string_agg(CASE WHEN rank <= 2 THEN '[출처: ' || th.doc_id || '] ' || substr(d.text, 1, 100) END, ' ' ORDER BY rank) AS snip FROM th JOIN documents d ON d.doc_id = th.doc_id GROUP BY query_id)"""


@register("k8_carry_over", TH + f""", {EVID} SELECT q.query_id, substr(concat_ws(' ', nullif(array_to_string([trim(s) for s in string_split(text, '.')[1:5] if length(trim(s)) > 20], ' '), ''), snip), 1, 500) AS facts
 FROM q LEFT JOIN ev USING (query_id)""")
def k8(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", F.col("text").alias("d_text"))
    hits = turn_hits(spark, sf).where("rank <= 2").join(d, "doc_id").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc_id", F.col("d_text").alias("text")))).alias("ev"))
    q = messages(spark, sf).where("role = 'user'").select((F.col("session_id") * 1_000_000_000 + F.col("seq")).alias("query_id"), "content")
    ev = F.coalesce("ev", F.array().cast(hits.schema["ev"].dataType))
    return q.join(hits, "query_id", "left").select("query_id", K.carry_over(F.col("content"), ev).alias("facts"))


@register("u2_token_set_jaccard", f"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
w AS (SELECT conv_id, turn, list_distinct({Q.words('text')}) AS a, list_distinct({Q.words('nxt')}) AS b FROM c WHERE nxt IS NOT NULL) SELECT conv_id, turn, round({Q.jaccard('a', 'b')}, 6) AS similarity FROM w""")
def u2(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load_table(spark, sf, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt IS NOT NULL")
    return c.select("conv_id", "turn", F.round(S.token_jaccard(F.col("text"), F.col("nxt")), 6).alias("similarity"))


@register("u4_new_documents", TH + " SELECT query_id, count(*) AS new_docs FROM th ANTI JOIN ctx ON ctx.query_id = th.query_id AND ctx.doc_id = th.doc_id GROUP BY query_id")
def u4(spark, sf):
    return turn_hits(spark, sf).join(context_of(spark, sf), ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("new_docs"))


@register("u5_overlap_ratio", TH + """, g AS (SELECT query_id, list(doc_id) AS cur FROM th GROUP BY query_id), p AS (SELECT query_id, list(DISTINCT doc_id) AS prev FROM ctx GROUP BY query_id)
SELECT query_id, round(len(list_intersect(prev, cur))::double / len(cur), 6) AS overlap FROM g JOIN p USING (query_id)""")
def u5(spark, sf):
    cur = turn_hits(spark, sf).groupBy("query_id").agg(F.collect_list("doc_id").alias("cur"))
    prev = context_of(spark, sf).groupBy("query_id").agg(F.collect_set("doc_id").alias("prev"))
    return cur.join(prev, "query_id").select("query_id", F.round(S.overlap_ratio(F.col("prev"), F.col("cur")), 6).alias("overlap"))

"""Bindings of the corpus rows: sources, normalisation and chunking over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions import normalize as N
from attestry.functions import patterns as X
from attestry.functions import tokens as T
from attestry.operators import chunking as C
from attestry.plans.catalog import register
from attestry.plans.catalog import sql as Q
from attestry.plans.catalog.retrieval import lexical_of
from attestry.session import load_table
from attestry.sources import corpus as SC
from attestry.sources import records as SR
from attestry.sources import snapshots as SS


def docs(spark, sf):
    return load_table(spark, sf, "documents")


def big(c):
    return c.cast("bigint")


# ---- sources -------------------------------------------------------------------------------------------

@register("s1_scan_corpus", "SELECT source, count(*) AS docs, sum(length(text))::bigint AS chars FROM documents GROUP BY source")
def s1(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


def listing(spark, sf):
    return load_table(spark, sf, "pages").select(
        F.col("url").alias("path"), big(F.length("html")).alias("size"), F.lit(None).cast("timestamp").alias("modified"))


URL_SUFFIX = r"lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1))"


@register("s2_inventory", f"""
SELECT upper({URL_SUFFIX}) AS type, count(*) AS files, round(sum(length(html)) / (1024e0 * 1024e0), 2) AS total_mb FROM pages GROUP BY ALL""")
def s2(spark, sf):
    inv = SC.corpus_inventory(listing(spark, sf))
    return inv.groupBy("type").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size") / F.lit(1024.0 * 1024.0), 2).alias("total_mb"))


@register("s16_intake_gate", f"""
SELECT reason, count(*) AS files FROM (SELECT CASE WHEN length(html) > {P.MAX_FILE_BYTES} THEN 'too_large'
 WHEN {URL_SUFFIX} NOT IN ('pdf', 'hwp') THEN 'bad_type' ELSE 'ok' END AS reason FROM pages) GROUP BY reason""")
def s16(spark, sf):
    return SC.intake_gate(listing(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def incoming(spark, sf):
    """The new version of every labelled document."""
    lab = load_table(spark, sf, "labels").select("doc_id")
    return docs(spark, sf).select("doc_id", "text").join(lab, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("v2 "), F.col("text")))


MERGED = """merged AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v2 ' || text ELSE text END AS text FROM documents)"""


@register("s4_upsert_by_doc", f"WITH {MERGED} SELECT doc_id, md5(text) AS checksum FROM merged")
def s4(spark, sf):
    merged, _ = SS.upsert_by_doc(docs(spark, sf).select("doc_id", "text"), incoming(spark, sf))
    return merged.select("doc_id", F.md5("text").alias("checksum"))


@register("s4_deleted_counts", "SELECT doc_id, count(*) AS deleted FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def s4b(spark, sf):
    return SS.upsert_by_doc(docs(spark, sf).select("doc_id", "text"), incoming(spark, sf))[1]


@register("s5_delete_docs", """
SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def s5(spark, sf):
    ids = load_table(spark, sf, "labels").where("toxic = 1")
    return SS.delete_docs(docs(spark, sf).select("doc_id", "n_chars"), ids)[0]


@register("s13_manifest_diff", f"""
WITH {MERGED}, kept AS (SELECT * FROM merged WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
 j AS (SELECT d.doc_id AS unit, md5(d.text) c0, length(d.text) s0, md5(k.text) c1, length(k.text) s1 FROM documents d LEFT JOIN kept k USING (doc_id))
SELECT unit, unnest(list_filter([CASE WHEN c1 IS NULL THEN 'missing' END, CASE WHEN c0 <> c1 THEN 'checksum_mismatch' END,
  CASE WHEN s0 <> s1 THEN 'size_mismatch' END], lambda x: x IS NOT NULL)) AS issue FROM j""")
def s13(spark, sf):
    old = docs(spark, sf).select("doc_id", "text")
    new, _ = SS.upsert_by_doc(old, incoming(spark, sf))
    new, _ = SS.delete_docs(new, load_table(spark, sf, "labels").where("toxic = 1"))
    return SS.diff_manifest(SS.make_manifest(old, "doc_id", "text"), SS.make_manifest(new, "doc_id", "text"))


def snapshot_listing(spark, sf):
    return load_table(spark, sf, "events").select(
        F.col("event_type").alias("store"), F.col("event_id").alias("name"), F.col("ts").alias("modified"), F.col("value").alias("size"))


S14_RANK = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events"


@register("s14_expire_snapshots", f"""
SELECT event_type AS store, count(*) AS expired, round(sum(value), 4) AS freed FROM ({S14_RANK}) WHERE rn > 5 GROUP BY event_type""")
def s14(spark, sf):
    out = SS.expire_snapshots(snapshot_listing(spark, sf))
    return out.groupBy("store").agg(F.count(F.lit(1)).alias("expired"), F.round(F.sum("size"), 4).alias("freed"))


@register("s14_retained", f"SELECT event_type AS store, event_id AS name, rn = 1 AS latest FROM ({S14_RANK}) WHERE rn <= 5")
def s14b(spark, sf):
    return SS.retained_snapshots(snapshot_listing(spark, sf)).select("store", "name", "latest")


def build_results(spark, sf):
    d = docs(spark, sf).join(load_table(spark, sf, "labels"), "doc_id", "left")
    body = N.replace(F.col("text"), r"^\s+|\s+$")
    kept = F.filter(C.fold_blocks(F.split("text", "\n"), 200), lambda c: F.length(c["text"]) >= 40)
    return d.select(
        "doc_id", F.when(F.col("toxic") == 1, "blocked").alias("error"), (F.coalesce("quality", F.lit(0)) == 1).alias("unchanged"),
        F.length(body).alias("content_chars"), big(F.size(kept)).alias("chunks"))


# C1 as a recursive query: lines of a document in order, the running sum restarting at each overflow.
C1_CTES = """lines AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), walk AS (
  SELECT doc_id, i, line, length(line) // 3 AS run, 0::bigint AS chunk_no FROM lines WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.line, CASE WHEN w.run + length(l.line) // 3 > 200 THEN length(l.line) // 3 ELSE w.run + length(l.line) // 3 END,
    CASE WHEN w.run + length(l.line) // 3 > 200 THEN w.chunk_no + 1 ELSE w.chunk_no END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1
), chunks AS MATERIALIZED (
  SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS blocks, sum(length(line) // 3)::bigint AS tokens, min(i) AS first_line
  FROM walk GROUP BY doc_id, chunk_no)"""


@register("s15_build_report", f"""
WITH RECURSIVE {C1_CTES}, n AS (SELECT doc_id, count(*) FILTER (length(text) >= 40) AS chunks FROM chunks GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(chunks, 0) AS chunks, CASE WHEN toxic = 1 THEN 'error' WHEN coalesce(quality, 0) = 1 THEN 'skipped'
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 THEN 'no_content' WHEN coalesce(chunks, 0) = 0 THEN 'no_chunks' ELSE 'success' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT status, count(*) AS files, sum(chunks)::bigint AS chunks FROM r GROUP BY status""")
def s15(spark, sf):
    return SC.build_report(build_results(spark, sf))


# ---- normalisation -------------------------------------------------------------------------------------

def over_docs(fn, *cols):
    def run(spark, sf):
        d = docs(spark, sf)
        return d.select("doc_id", *fn(F.col("text")))

    return run


def clean_sql(c):
    """P1 in SQL; unassigned code points, which RE2 has no class for, do not occur in the tables."""
    for pattern, to in ((r"\p{Co}|[^\P{Cc}\n\t]|\p{Cf}", ""), (r"(?m)^[ \t]+|[ \t]+$", ""), (r"[ \t]+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    c = f"regexp_replace({c}, '\\n{{4,}}', repeat(chr(10), 3), 'g')"
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@register("p1_clean_for_index", f"SELECT doc_id, md5({clean_sql('text')}) AS checksum, length(text) - length({clean_sql('text')}) AS removed FROM documents")
def p1(spark, sf):
    c = N.clean_for_index(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(c).alias("checksum"), big(F.length("text") - F.length(c)).alias("removed"))


WS = r"regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([가-힣])\s+(\d)', '\1\2', 'g'), '(\d)\s+([가-힣])', '\1\2', 'g')"


@register("p2_whitespace", f"SELECT doc_id, md5({WS}) AS checksum FROM documents")
def p2(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.norm_whitespace(F.col("text"))).alias("checksum"))


@register("p3_dates")
def p3(spark, sf):
    c = N.norm_dates(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(c).alias("checksum"), (c != F.col("text")).alias("changed"))


@register("p4_numbers")
def p4(spark, sf):
    c = N.norm_numbers(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(c).alias("checksum"), (c != F.col("text")).alias("changed"))


@register("p5_currency")
def p5(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.norm_currency(F.col("text"))).alias("checksum"))


@register("p6_law_refs")
def p6(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.norm_law_refs(F.col("text"))).alias("checksum"))


PUNCT = (f"regexp_replace(regexp_replace(regexp_replace(translate(text, {Q.quote(P.FULL_WIDTH)}, {Q.quote(P.HALF_WIDTH)}), "
         r"'\.{2,}', '.', 'g'), ',{2,}', ',', 'g'), '\s+([.,;:!?])', '\1', 'g')")


@register("p7_punct", f"SELECT doc_id, md5({PUNCT}) AS checksum FROM documents")
def p7(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.norm_punct(F.col("text"))).alias("checksum"))


TERMS = {"the": "THE", "und": "UND", "des": "DES", "los": "LOS", "and": "AND"}


def _terms_sql() -> str:
    # RE2 word boundaries are ASCII, so the oracle rewrites whole letter runs token by token.
    whens = " ".join(f"WHEN {Q.quote(a)} THEN {Q.quote(b)}" for a, b in TERMS.items())
    parts = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
    return f"array_to_string([CASE t {whens} ELSE t END for t in {parts}], '')"


@register("p8_expand_terms", f"SELECT doc_id, md5({_terms_sql()}) AS checksum FROM documents")
def p8(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.expand_terms(F.col("text"), TERMS)).alias("checksum"))


@register("p9_normalise")
def p9(spark, sf):
    c = N.normalise(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(c).alias("checksum"), big(F.length(c)).alias("chars"))


@register("p9_normalise_report")
def p9b(spark, sf):
    return N.normalise_report(docs(spark, sf), "text")


@register("p10_normalise_query")
def p10(spark, sf):
    return load_table(spark, sf, "benchmark").select("item_id", N.normalise_query(F.col("text")).alias("query"))


@register("p11_unicode", r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS checksum FROM documents")
def p11(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.norm_unicode("NFC")(F.col("text"))).alias("checksum"))


@register("p12_doc_id", r"""
SELECT page_id, regexp_replace(trim(url || '.pdf'), '\.(pdf|hwp|txt)$', '') AS doc_key FROM pages""")
def p12(spark, sf):
    return load_table(spark, sf, "pages").select("page_id", N.norm_doc_id(F.concat("url", F.lit(".pdf"))).alias("doc_key"))


@register("p13_compare", f"SELECT doc_id, md5({Q.norm_compare('text')}) AS checksum FROM documents")
def p13(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(N.norm_compare(F.col("text"))).alias("checksum"))


def _pii_sql() -> str:
    ctes, prev, counts = [], "text", []
    for i, kind in enumerate(P.PII_ORDER):
        pattern, mask = P.PII_PATTERNS[kind]
        src = "documents" if i == 0 else f"m{i - 1}"
        col = "text" if i == 0 else f"t{i - 1}"
        ctes.append(f"m{i} AS (SELECT *, len(regexp_extract_all({col}, {Q.quote(pattern)})) AS n_{kind}, "
                    f"regexp_replace({col}, {Q.quote(pattern)}, {Q.quote(mask)}, 'g') AS t{i} FROM {src})")
        counts.append(f"n_{kind}")
    return f"WITH {', '.join(ctes)} SELECT doc_id, {', '.join(counts)}, md5(t{len(ctes) - 1}) AS checksum FROM m{len(ctes) - 1}"


@register("p14_mask_pii", _pii_sql())
def p14(spark, sf):
    out = X.pii_counts(docs(spark, sf), "text")
    return out.select("doc_id", *[f"n_{k}" for k in P.PII_ORDER], F.md5("masked").alias("checksum"))


FORBIDDEN_SQL = "(" + " OR ".join(f"regexp_matches({{c}}, '(?i){p}')" for p in P.FORBIDDEN_PATTERNS) + ")"


@register("p15_sanitise", rf"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\x00-\x08\x0B-\x1F]', '', 'g'), '\s+', ' ', 'g'))) AS checksum,
 {FORBIDDEN_SQL.format(c='html')} AS forbidden FROM pages""")
def p15(spark, sf):
    h = F.col("html")
    return load_table(spark, sf, "pages").select("page_id", F.md5(X.sanitise(h)).alias("checksum"), X.flag_forbidden(h).alias("forbidden"))


@register("p16_validate_queries", rf"""
SELECT conv_id, turn, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'blank' WHEN length(text) > {P.MAX_QUERY_CHARS} THEN 'too_long'
 WHEN {FORBIDDEN_SQL.format(c='text')} THEN 'forbidden' ELSE 'ok' END AS status FROM conversations WHERE role = 'user'""")
def p16(spark, sf):
    c = load_table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", X.query_status(F.col("text")).alias("status"))


@register("p17_strip_sections", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace('<think>' || url || '</think>' || html, '(?is)<think>.*?</think>', '', 'g'),
 '(?is)</?thinking?>', '', 'g'), '^\s+|\s+$', '', 'g')) AS checksum FROM pages""")
def p17(spark, sf):
    c = N.strip_sections(F.concat(F.lit("<think>"), F.col("url"), F.lit("</think>"), F.col("html")))
    return load_table(spark, sf, "pages").select("page_id", F.md5(c).alias("checksum"))


@register("p18_strip_citations", r"""
SELECT conv_id, turn, md5(regexp_replace(text || ' [' || turn || ']', '\[[0-9]+\]', '', 'g')) AS checksum FROM conversations""")
def p18(spark, sf):
    c = N.strip_citations(F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("]")))
    return load_table(spark, sf, "conversations").select("conv_id", "turn", F.md5(c).alias("checksum"))


@register("p19_truncate", """
WITH h AS (SELECT doc_id, text, substr(text, 1, 97) AS h, strpos(reverse(substr(text, 1, 97)), ' ') AS back FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN back > 0 AND length(h) - back > 80 THEN substr(h, 1, length(h) - back) || '...'
 ELSE h || '...' END AS title FROM h""")
def p19(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate_text(F.col("text")).alias("title"))


@register("p20_text_hash", r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash, md5(lower(trim(text))) AS query_hash FROM documents""")
def p20(spark, sf):
    return docs(spark, sf).select("doc_id", N.text_hash(F.col("text")).alias("text_hash"), N.query_hash(F.col("text")).alias("query_hash"))


@register("p21_highlight", "SELECT doc_id, md5(regexp_replace(text, 'tion', '<mark>tion</mark>', 'gi')) AS checksum FROM documents")
def p21(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.highlight(F.col("text"), ["tion"])).alias("checksum"))


@register("p22_snippet", """
WITH a AS (SELECT doc_id, text, strpos(lower(text), 'tion') - 1 AS pos FROM documents),
b AS (SELECT *, greatest(0, pos - 50) AS s, least(length(text), pos + 4 + 50) AS e FROM a)
SELECT doc_id, CASE WHEN pos < 0 THEN '' ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(text, s + 1, e - s) ||
 CASE WHEN e < length(text) THEN '...' ELSE '' END END AS preview FROM b""")
def p22(spark, sf):
    return docs(spark, sf).select("doc_id", X.snippet(F.col("text"), F.lit("tion")).alias("preview"))


@register("p23_quantities", r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d+(?:,\d{3})*(?:\.\d+)?)\s*([\p{L}]+)', 1)) AS number,
 unnest(regexp_extract_all(text, '(\d+(?:,\d{3})*(?:\.\d+)?)\s*([\p{L}]+)', 2)) AS unit FROM documents)
SELECT unit, count(*) AS n, min(number) AS smallest FROM p WHERE regexp_matches(unit, '(s|e|n|m|d)$') GROUP BY unit""")
def p23(spark, sf):
    rows = X.extract_quantities(docs(spark, sf).select("doc_id", "text"), "text", ("s", "e", "n", "m", "d"), r"\p{L}")
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("smallest"))


REF_PATTERNS = (r"https?://[^\s<>]+", r"[a-z]+\.com", r"\d+\.\d+")


@register("p24_refs", f"""
SELECT doc_id, count(DISTINCT r) AS refs FROM (SELECT doc_id, unnest({" || ".join(f"regexp_extract_all(text, {Q.quote(p)})" for p in REF_PATTERNS)}) AS r
 FROM documents) GROUP BY doc_id""")
def p24(spark, sf):
    d = docs(spark, sf).select("doc_id", F.size(X.extract_refs(F.col("text"), REF_PATTERNS)).alias("refs"))
    return d.where("refs > 0").select("doc_id", big(F.col("refs")).alias("refs"))


@register("p25_numerals")
def p25(spark, sf):
    """The digit sum of each document written with Korean units, read back as a number."""
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("삼백"), F.translate(F.col("n_chars").cast("string"), "0123456789", "영일이삼사오육칠팔구")).alias("text"))
    return X.extract_numerals(d, "text").select("doc_id", "numeral", "value")


@register("p26_source_lines", r"""
SELECT doc_id, source AS parsed_doc, n_chars AS parsed_page, n_chars + 10 AS parsed_end FROM documents""")
def p26(spark, sf):
    line = F.format_string("see (%s, p.%d, %d-%d) for it", F.col("source"), F.col("n_chars"), F.col("n_chars"), F.col("n_chars") + 10)
    p = X.parse_source_line(line)
    return docs(spark, sf).select("doc_id", p["doc_id"].alias("parsed_doc"), big(p["page"]).alias("parsed_page"), big(p["end"]).alias("parsed_end"))


LOW = r"""(length(regexp_replace({c}, '^\s+|\s+$', '', 'g')) < 100 OR len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}]')) = 0
 OR len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}]'))::double / greatest(length({c}), 1) < 0.6)"""


@register("p27_low_text", f"SELECT page_id, {LOW.format(c='html')} AS low FROM pages")
def p27(spark, sf):
    return load_table(spark, sf, "pages").select("page_id", X.flag_low_text(F.col("html")).alias("low"))


@register("p28_line_class", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT coalesce(CASE WHEN regexp_matches(trim(line), '^\d+\.') THEN 'item' END, 'plain') AS kind, count(*) AS lines FROM l GROUP BY ALL""")
def p28(spark, sf):
    lines = docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line"))
    kind = F.coalesce(X.classify_line(F.col("line")), F.lit("plain"))
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@register("p29_page_estimate", "SELECT doc_id, (n_chars // 2000 + 1)::bigint AS page FROM documents")
def p29(spark, sf):
    return docs(spark, sf).select("doc_id", X.estimate_page(F.col("n_chars")).alias("page"))


@register("p30_drop_symbols", r"""
SELECT doc_id, md5(trim(regexp_replace(translate(text, '*#|%', ''), '\s+', ' ', 'g'))) AS checksum FROM documents""")
def p30(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.drop_symbols(F.col("text"), "*#|%")).alias("checksum"))


BLOCKED = ("lorem", "secret", "password", "license")


@register("p31_blocked", f"SELECT doc_id, ({' OR '.join(f'contains(text, {Q.quote(b)})' for b in BLOCKED)}) AS blocked FROM documents")
def p31(spark, sf):
    return docs(spark, sf).select("doc_id", X.flag_blocked(F.col("text"), BLOCKED).alias("blocked"))


GUARD = ("the", "und", "des", "los")
_guard = " + ".join(f"(contains({{c}}, {Q.quote(g)}))::int" for g in GUARD)


@register("p32_cleanup_guarded", r"""
WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\d+)\s*([월일년%회차])', '\1\2', 'g'),
 '\s{2,}', ' ', 'g'), ',,+', ',', 'g'), '\.\.+', '.', 'g'), '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g') AS t FROM documents),
g AS (SELECT *, (length(t) < length(text) * 0.7) OR (""" + _guard.format(c="text") + ") > 0 AND (" + _guard.format(c="t") + ") < (" + _guard.format(c="text") + r""") * 0.8 AS lost FROM t)
SELECT doc_id, lost AS reverted, md5(regexp_replace(CASE WHEN lost THEN text ELSE t END, '^\s+|\s+$', '', 'g')) AS checksum FROM g""")
def p32(spark, sf):
    trimmed = N.replace(F.col("text"), r"^\s+|\s+$")
    out = docs(spark, sf).withColumn("c", X.cleanup_guarded(F.col("text"), GUARD))
    return out.select("doc_id", ((F.col("c") == trimmed) & (trimmed != N.replace(_cleaned(F.col("text")), r"^\s+|\s+$"))).alias("reverted"), F.md5("c").alias("checksum"))


def _cleaned(c):
    return X.cleanup_guarded(c, ())


# ---- chunking ------------------------------------------------------------------------------------------

@register("c1_chunk_blocks", f"WITH RECURSIVE {C1_CTES} SELECT doc_id, chunk_no, md5(text) AS checksum, blocks, tokens FROM chunks")
def c1(spark, sf):
    out = C.chunk_documents(docs(spark, sf), budget=200)
    return out.select("doc_id", "chunk_no", F.md5("text").alias("checksum"), big(F.col("blocks")).alias("blocks"), "tokens")


def paragraphs(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return lines.select("doc_id", "ordinal", "text", X.classify_line(F.col("text")).alias("structure_type"),
                        big(F.col("ordinal") * 100).alias("start_char"), big(F.col("ordinal") * 100 + F.length("text")).alias("end_char"))


@register("c2_chunk_paragraphs")
def c2(spark, sf):
    out = C.chunk_paragraphs(paragraphs(spark, sf), 200, 256)
    return out.select("doc_id", "group_no", "chunk_no", F.md5("text").alias("checksum"), "start_char", "end_char", "tokens")


@register("c3_group_paragraphs")
def c3(spark, sf):
    g = C.group_paragraphs(paragraphs(spark, sf))
    return g.groupBy("doc_id", "group_no").agg(F.count(F.lit(1)).alias("paragraphs"))


@register("c4_chunk_directives")
def c4(spark, sf):
    d = docs(spark, sf)
    rec = d.select(
        "doc_id", F.col("source").alias("source_file"), X.estimate_page(F.col("n_chars")).cast("int").alias("page"), F.lit(1).alias("index"),
        X.page_category(F.col("text")).alias("category"), X.split_title_body(F.col("text"))["title"].alias("title"),
        X.split_title_body(F.col("text"))["body"].alias("body"), X.extract_deadline(F.col("text")).alias("deadline"),
        F.array("lang", "source").alias("departments"), F.lit(None).cast("string").alias("directive"))
    return C.chunk_directives(rec).select("doc_id", F.md5("text").alias("checksum"), "tokens")


@register("c5_chunk_tables", r"""
SELECT doc_id, md5('[표: ' || source || ']' || chr(10) || array_to_string([array_to_string(regexp_extract_all(l, '\S+'), ' | ') for l in
 string_split(regexp_replace(text, '\n+', chr(10), 'g'), chr(10)) if trim(l) <> ''], chr(10))) AS checksum FROM documents""")
def c5(spark, sf):
    lines = F.filter(F.split("text", "\n+"), lambda l: F.trim(l) != "")
    rows = F.transform(lines, lambda l: X.find_all(l, r"\S+"))
    return docs(spark, sf).select("doc_id", F.md5(C.table_text(rows, F.col("source"))).alias("checksum"))


@register("c6_chunk_footnotes", f"""SELECT doc_id, md5({clean_sql("('[각주 ' || n_chars || '] ' || text)")}) AS checksum FROM documents""")
def c6(spark, sf):
    notes = docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("footnote_id"), F.col("n_chars").alias("number"), "text")
    return C.chunk_footnotes(notes).select("doc_id", F.md5("text").alias("checksum"))


@register("c7_backlinks")
def c7(spark, sf):
    d = docs(spark, sf)
    content = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-chunk-0")).alias("chunk_id"), F.lit(0).alias("ordinal"),
                       F.lit("content").alias("type"), F.concat(F.lit("[표] "), F.col("text"), F.lit(" [1] [표] [2]")).alias("text"))
    tables = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-table-1")).alias("chunk_id"), F.lit(1).alias("ordinal"),
                      F.lit("table").alias("type"), F.col("source").alias("text"))
    notes = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-footnote-2")).alias("chunk_id"), F.lit(2).alias("ordinal"),
                     F.lit("footnote").alias("type"), F.col("lang").alias("text"))
    out = C.add_backlinks(content.unionByName(tables).unionByName(notes))
    return out.select("doc_id", "type", F.md5("text").alias("checksum"))


@register("c8_count_tokens", "SELECT doc_id, (length(text) // 3)::bigint AS tokens FROM documents")
def c8(spark, sf):
    return docs(spark, sf).select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@register("c9_sentences", r"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?。]\s*')) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM s) WHERE s <> '' GROUP BY doc_id""")
def c9(spark, sf):
    s = docs(spark, sf).select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), big(F.max(F.length("s"))).alias("longest"))


@register("c10_evidence_units", r"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
p AS (SELECT doc_id, text, flatten(list_transform(ls, lambda x: CASE WHEN length(x) > 180
   THEN list_filter(string_split(regexp_replace(x, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') ELSE [x] END)) AS ps FROM l),
u AS (SELECT doc_id, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [trim(text)] END) AS unit FROM p)
SELECT doc_id, count(*) AS units, max(length(unit)) AS longest FROM u GROUP BY doc_id""")
def c10(spark, sf):
    u = docs(spark, sf).select("doc_id", F.posexplode(C.evidence_units(F.col("text"))).alias("unit_no", "unit"))
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), big(F.max(F.length("unit"))).alias("longest"))


@register("c11_split_bullets", r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^(\p{Lu})', '○ \1', 'g'), '(?m)^(\s*○)', chr(1) || '\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(x, '○') AND length(x) >= 8)) AS block FROM m)
SELECT doc_id, count(*) AS blocks, CAST(sum(length(block)) AS BIGINT) AS chars FROM b GROUP BY doc_id""")
def c11(spark, sf):
    marked = F.regexp_replace("text", r"(?m)^(\p{Lu})", "○ $1")
    u = docs(spark, sf).select("doc_id", F.explode(C.split_bullets(marked)).alias("block"))
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"))


def line_chunks(spark, sf):
    c = C.chunk_documents(docs(spark, sf), budget=200)
    return c.select("doc_id", F.col("chunk_no").alias("chunk_id"), (F.floor(F.col("chunk_no") / 3) + 1).alias("page"), F.col("chunk_no").alias("start_char"), "text")


@register("c12_assemble_pages", f"""
WITH RECURSIVE {C1_CTES} SELECT doc_id, (chunk_no // 3 + 1)::bigint AS page, md5(string_agg(text, chr(10) ORDER BY chunk_no)) AS checksum, count(*) AS chunks
FROM chunks GROUP BY ALL""")
def c12(spark, sf):
    p = C.assemble_pages(line_chunks(spark, sf))
    return p.select("doc_id", big(F.col("page")).alias("page"), F.md5("page_text").alias("checksum"), "chunks")


@register("c12_page_totals", f"""
WITH RECURSIVE {C1_CTES} SELECT doc_id, count(*) AS total_chunks, count(DISTINCT chunk_no // 3) AS total_pages, round(avg(length(text)), 6) AS avg_chunk_chars
FROM chunks GROUP BY doc_id""")
def c12b(spark, sf):
    return C.page_totals(line_chunks(spark, sf))


@register("c13_dedupe_chunks", """
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT source AS doc_id, doc_id AS in_doc, i AS line_no, md5(line) AS checksum FROM l
QUALIFY row_number() OVER (PARTITION BY source, trim(line) ORDER BY doc_id, i) = 1""")
def c13(spark, sf):
    """Lines of all documents of one source, each distinct line once."""
    l = docs(spark, sf).select(F.col("source"), F.col("doc_id").alias("in_doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = l.select(F.col("source").alias("doc_id"), "in_doc", big(F.col("i") + 1).alias("line_no"), "text", F.struct("in_doc", "i").alias("start_char"))
    return C.dedupe_chunks(rows).select("doc_id", "in_doc", "line_no", F.md5("text").alias("checksum"))


@register("a15_token_stats", f"""
WITH t AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS term FROM documents),
ch AS (SELECT term, unnest(string_split(term, '')) AS c FROM t), f AS (SELECT term, c, count(*) AS n FROM ch GROUP BY ALL)
SELECT term, round(-sum(n::double / length(term) * log2(n::double / length(term))), 6) + 0e0 AS entropy, round(count(*)::double / length(term), 6) AS diversity FROM f GROUP BY term""")
def a15(spark, sf):
    t = lexical_of(spark, sf).terms
    return t.select("term", F.round(T.char_entropy(F.col("term")), 6).alias("entropy"), F.round(T.char_diversity(F.col("term")), 6).alias("diversity"))


def _stat_word(ent: float, div: float) -> str:
    rep = lambda k: (f"((len(string_split(term, right(term, {k}))) - 1) > 1 OR len(list_distinct(string_split(right(term, {k}), ''))) = 1)")
    return (f"length(term) >= 2 AND diversity >= {div} AND entropy >= {ent} AND NOT (length(term) >= 4 AND ({rep(2)} OR {rep(3)}))")


@register("k3_stat_filter", f"""
WITH t AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS term FROM documents),
ch AS (SELECT term, unnest(string_split(term, '')) AS c FROM t), f AS (SELECT term, c, count(*) AS n FROM ch GROUP BY ALL),
s AS (SELECT term, -sum(n::double / length(term) * log2(n::double / length(term))) + 1e-12 AS entropy, count(*)::double / length(term) AS diversity FROM f GROUP BY term)
SELECT term, ({_stat_word(1.2, 0.4)}) AS content, ({_stat_word(2.0, 0.6)}) AS strict FROM s""")
def k3(spark, sf):
    t = lexical_of(spark, sf).terms
    return t.select("term", T.is_stat_word(F.col("term")).alias("content"), T.is_stat_word(F.col("term"), True).alias("strict"))

"""Shared SQL fragments of the oracle queries."""

from __future__ import annotations

from attestry import params as P


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def word_list(ws) -> str:
    return "(" + ", ".join(quote(w) for w in ws) + ")"


def tokens(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '\p{{L}}+|[0-9]+'), lambda t: t NOT IN {word_list(P.STOP_WORDS)})"


def clean_query(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(c: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\S+')"


def norm_compare(c: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')))"


def split_words(c: str) -> str:
    return rf"regexp_extract_all({c}, '\S+')"


def grams(c: str) -> str:
    """Distinct character bigrams."""
    ch = f"string_split({c}, '')"
    return f"list_distinct(list_transform(list_zip({ch}[:-2], {ch}[2:]), lambda z: z[1] || z[2]))"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE {inter}::double / "
        f"(len(list_distinct({a})) + len(list_distinct({b})) - {inter}) END"
    )


def bm25_ctes(k: int, query_cte: str = "q", scope: str = "", out: str = "hits") -> str:
    """CTEs from ``q(query_id, text)`` to ``hits(query_id, chunk_id, score, rank)`` over documents."""
    return rf"""
dtok AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS tk FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM dtok) GROUP BY ALL),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM dtok),
dfreq AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
qclean AS MATERIALIZED (SELECT query_id, {clean_query('text')} AS c FROM {query_cte}),
qterm AS MATERIALIZED (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens('c')}) AS term FROM qclean)),
qid AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(regexp_extract_all(c, '\S+')) AS w FROM qclean)),
parts AS (
  SELECT query_id, post.doc_id AS chunk_id,
         (ln(n / (df + 1e0)) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(tk) / avgdl)) AS s
  FROM qterm JOIN dfreq USING (term) JOIN post USING (term) JOIN dtok ON dtok.doc_id = post.doc_id, stats
  UNION ALL
  SELECT query_id, doc_id, 1e0 FROM qid JOIN documents ON w = doc_id::varchar
),
scored AS MATERIALIZED (SELECT query_id, chunk_id, round(sum(s), 6) AS score FROM parts GROUP BY ALL),
{out} AS MATERIALIZED (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored {scope} QUALIFY rank <= {k})"""


BENCH_Q = "q AS (SELECT item_id AS query_id, text FROM benchmark)"

# Hashed bag-of-token vectors of the documents (dv) and of the queries (qv).
VECTOR_CTES = rf"""
bucketed AS (
  SELECT 'd' AS kind, doc_id AS id, cast('0x' || substr(md5(term), 1, 8) AS ubigint) % 64 AS d, count(*)::double AS c
  FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL
  UNION ALL
  SELECT 'q', query_id, cast('0x' || substr(md5(term), 1, 8) AS ubigint) % 64, count(*)::double
  FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM q) GROUP BY ALL
),
lens AS (SELECT kind, id, sqrt(sum(c * c)) AS l FROM bucketed GROUP BY ALL),
uvec AS MATERIALIZED (SELECT kind, id, d, c / l AS v FROM bucketed JOIN lens USING (kind, id)),
vscore AS (
  SELECT a.id AS query_id, b.id AS chunk_id, sum(a.v * b.v) AS s FROM uvec a JOIN uvec b ON a.d = b.d
  WHERE a.kind = 'q' AND b.kind = 'd' GROUP BY ALL
),
vall AS (
  SELECT qi.id AS query_id, di.id AS chunk_id, round(coalesce(s, 0e0), 6) AS score
  FROM (SELECT id FROM lens WHERE kind = 'q') qi CROSS JOIN (SELECT id FROM lens WHERE kind = 'd') di
  LEFT JOIN vscore ON query_id = qi.id AND chunk_id = di.id
),
vhits AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vall QUALIFY rank <= 60)"""

FUSED = """
fused AS MATERIALIZED (
  SELECT query_id, chunk_id, round(sum(0.4e0 * (1e0 / (60 + rank))), 9) AS rrf_score
  FROM (SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, rank FROM vhits) GROUP BY ALL)"""

KEYWORDS = (r"regexp_extract_all(text, '\d+') || [w for w in regexp_extract_all(text, '\p{L}{2,}') if length(w) >= 4]"
            r" || [w for w in regexp_extract_all(text, '\p{Latin}[\p{Latin}0-9]*') if length(w) >= 2]")


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by rows of the usual table: a row is a list, built entry by entry.

    Characters are code points, so that all lists are lists of numbers."""
    codes = lambda c: f"list_transform(string_split({c}, ''), lambda x: unicode(x)::bigint)"
    entry = "list_append(line, CASE WHEN other[j[1]] = ch[1] THEN up[j[1]] + 1 ELSE greatest(up[j[1] + 1], line[j[1]]) END)"
    entry = entry.replace("other", codes(b))
    step = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda n: [n]), lambda line, j: {entry}, [0::bigint])"
    return (f"list_reduce(list_transform({codes(a)}, lambda c: [c]), lambda up, ch: {step}, "
            f"list_transform(range(0, length({b}) + 1), lambda n: 0::bigint))[-1]")


def close_pairs(left: str, right: str, score: str, least: int = 1) -> str:
    """SELECT of (a, b, r): pairs of the strings ``x`` of two tables, of ``least`` characters and more, with an indel ratio r of
    at least ``score``.

    An indel distance is no less than Levenshtein's, which is native.  DuckDB counts bytes there, so accents are taken off
    first, which brings no two strings further apart; only pairs of fitting lengths are compared."""
    form = f"SELECT DISTINCT x, length(x) AS n, translate(strip_accents(x), 'ßæøœ', 'saoo') AS plain FROM {{}} WHERE length(x) >= {least}"
    return f"""SELECT a, b, r FROM (
  SELECT a, b, 200e0 * {lcs('a', 'b')} / (m + n) / 100e0 AS r FROM (
    SELECT l.x AS a, r.x AS b, l.n AS m, r.n AS n
    FROM (SELECT *, unnest(range(ceil(n * {score} / (2 - {score}) - 1e-9)::bigint, floor(n * (2 - {score}) / {score} + 1e-9)::bigint + 1)) AS other FROM ({form.format(left)})) l
    JOIN ({form.format(right)}) r ON r.n = l.other WHERE levenshtein(l.plain, r.plain) <= (1 - {score}) * (l.n + r.n) + 1e-9))
WHERE r >= {score} - 1e-9"""


# From pairs(query_id, chunk_id, kws, low) and hitdoc(doc_id, low): pmatch(query_id, chunk_id, k), a row for each keyword the
# text does not hold, but has a word that stands in it or comes close to it.
PARTIAL = rf"""
hw AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(regexp_extract_all(low, '\p{{L}}{{2,}}'))) AS w FROM hitdoc),
kx AS MATERIALIZED (SELECT DISTINCT unnest(kws) AS x FROM pairs),
wx AS MATERIALIZED (SELECT DISTINCT w AS x FROM hw),
lnk AS MATERIALIZED (
  SELECT DISTINCT k, w FROM (SELECT x AS k, i, unnest(range(2, length(x) - i + 2)) AS n FROM (SELECT x, unnest(range(1, length(x))) AS i FROM kx)) s
  JOIN (SELECT x AS w FROM wx) ON w = substr(k, i, n)
  UNION SELECT a, b FROM ({close_pairs('kx', 'wx', '0.8e0', 3)})
),
pmatch AS MATERIALIZED (
  SELECT query_id, chunk_id, pk.k FROM (SELECT query_id, chunk_id, low, unnest(kws) AS k FROM pairs) pk
  SEMI JOIN (SELECT DISTINCT doc_id, k FROM hw JOIN lnk USING (w)) ph ON ph.doc_id = chunk_id AND ph.k = pk.k WHERE NOT contains(low, pk.k))"""

# Keyword relevance of the fused hits: related(query_id, chunk_id, rrf_score, keyword_relevance).
RELATED = rf"""
kall AS (
  SELECT query_id, k, min(pos) AS pos FROM (
    SELECT query_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS pos FROM (SELECT query_id, {KEYWORDS} AS ks FROM q)
  ) GROUP BY ALL
),
kw AS MATERIALIZED (
  SELECT query_id, coalesce(list(lower(k) ORDER BY pos) FILTER (k IS NOT NULL), []) AS kws,
         coalesce(list(lower(k)) FILTER (regexp_matches(k, '\d')), []) AS nums,
         coalesce(string_agg(lower(k), ' ' ORDER BY pos), '') AS joined
  FROM (SELECT query_id FROM q) LEFT JOIN kall USING (query_id) GROUP BY query_id
),
hitdoc AS MATERIALIZED (SELECT doc_id, lower(text) AS low, {grams('lower(text)')} AS g FROM documents
  WHERE doc_id IN (SELECT chunk_id FROM fused)),
pairs AS (SELECT f.*, kws, nums, joined, low, g, {grams('joined')} AS kg FROM fused f JOIN kw USING (query_id) JOIN hitdoc ON doc_id = chunk_id),
{PARTIAL},
meas AS (
  SELECT query_id, chunk_id, rrf_score, len(kws) AS nk, coalesce(np, 0)::double / nullif(len(kws), 0) AS part,
    len([k for k in kws if contains(low, k)])::double / nullif(len(kws), 0) AS exact,
    {jaccard('kg', 'g')} AS gram,
    CASE WHEN len(nums) = 0 THEN 0e0 ELSE len([k for k in nums if contains(low, k)])::double / len(nums) END AS num,
    least(length(joined) / 20e0, 0.1e0) AS bonus
  FROM pairs LEFT JOIN (SELECT query_id, chunk_id, count(*) AS np FROM pmatch GROUP BY ALL) USING (query_id, chunk_id)
),
tot AS (SELECT *, exact * 0.4e0 + part * 0.25e0 + gram * 0.25e0 + num * 0.1e0 + bonus AS t FROM meas),
related AS MATERIALIZED (
  SELECT query_id, chunk_id, rrf_score, round(CASE WHEN nk = 0 THEN 0.2e0 ELSE
     least(CASE WHEN gram > 0.05 OR part > 0 OR exact > 0 THEN greatest(t, 0.1e0) ELSE t END, 1e0) END, 6) AS keyword_relevance
  FROM tot)"""

FILTERED = """
flagged AS (
  SELECT *, CASE WHEN rrf_score >= 0.006e0 AND keyword_relevance >= 0.15e0 THEN 'hybrid'
                 WHEN keyword_relevance >= 0.3e0 THEN 'strong_keyword' END AS reason,
         row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rn
  FROM related
),
filtered AS MATERIALIZED (
  SELECT query_id, chunk_id, rrf_score, keyword_relevance, coalesce(reason, 'emergency_fallback') AS include_reason,
         CAST(CAST(rrf_score AS DECIMAL(18,9)) * CAST(0.7 AS DECIMAL(2,1)) + CAST(keyword_relevance AS DECIMAL(18,9)) * CAST(0.3 AS DECIMAL(2,1)) AS DOUBLE) AS relevance
  FROM (SELECT *, max(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS anyk FROM flagged)
  WHERE reason IS NOT NULL OR (anyk = 0 AND rn <= 2))"""


def diverse(limit: int = 10, order: str = "doc") -> str:
    """One chunk per document here, so every hit is the best of its document."""
    first = "chunk_id" if order == "doc" else "round(rrf_score + keyword_relevance, 6) DESC, chunk_id"
    return f"""
diverse AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {first}) AS position FROM filtered QUALIFY position <= {limit})"""

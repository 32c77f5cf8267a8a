"""Pattern operators on text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.normalize import collapse, literal, quoted, replace, where


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _may_hold(c: Column, kind: str) -> Column:
    """A cheap test that every text with personal data of the kind passes."""
    return c.contains("@") if kind == "email" else c.rlike("[0-9]")


def mask_pii(c: Column, order: Sequence[str] = P.PII_ORDER) -> Column:
    """P14. Replace personal data by its mask, most specific kind first (``PII_ORDER_PARITY`` reproduces
    the order in which the phone rule eats parts of longer numbers)."""
    for kind in order:
        pattern, mask = P.PII_PATTERNS[kind]
        c = where(lambda t, k=kind: _may_hold(t, k), lambda t, p=pattern, m=mask: replace(t, p, m), c)
    return c


def pii_counts(df: DataFrame, col: str, order: Sequence[str] = P.PII_ORDER) -> DataFrame:
    """P14. ``df`` with the masked text and one hit count per kind, each counted on the text the earlier
    kinds left over."""
    c = F.col(col)
    out = df
    for kind in order:
        pattern, mask = P.PII_PATTERNS[kind]
        some = _may_hold(c, kind)
        out = out.withColumn(f"n_{kind}", F.when(some, count_matches(c, pattern)).when(c.isNotNull(), F.lit(0).cast("bigint")))
        out = out.withColumn("_left", F.when(some, replace(c, pattern, mask)).otherwise(c))
        c = F.col("_left")
    return out.withColumn("masked", c).drop("_left")


def sanitise(c: Column) -> Column:
    """P15. Drop tags and control characters, collapse white space."""
    c = replace(c, r"<[^>]+>")
    c = replace(c, r"[\x00-\x08\x0B-\x1F]")
    return F.trim(collapse(c))


def flag_forbidden(c: Column, patterns: Sequence[str] = P.FORBIDDEN_PATTERNS) -> Column:
    """P15. True when any forbidden pattern occurs."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike("(?i)" + p)
    return hit


def query_status(c: Column, max_chars: int = P.MAX_QUERY_CHARS) -> Column:
    """P16. Reason code: ok, blank, too_long, forbidden."""
    return (
        F.when(c.isNull() | (F.trim(collapse(c)) == ""), "blank")
        .when(F.length(c) > max_chars, "too_long")
        .when(flag_forbidden(c), "forbidden")
        .otherwise("ok")
    )


def truncate_text(c: Column, limit: int = 100, suffix: str = "...") -> Column:
    """P19. Cut to ``limit`` characters with a suffix, at the last space when that is past 80 % of the limit."""
    head = F.substring(c, 1, limit - len(suffix))
    back = F.instr(F.reverse(head), " ")
    last = F.when(back > 0, F.length(head) - back).otherwise(F.lit(-1))
    body = F.when(last > limit * 0.8, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(body, F.lit(suffix)))


def highlight(c: Column, keywords: Sequence[str], start: str = "<mark>", end: str = "</mark>") -> Column:
    """P21. Wrap each keyword, ignoring case; the keyword as given replaces the match."""
    for kw in keywords:
        c = replace(c, rf"(?iu){quoted(kw)}", literal(f"{start}{kw}{end}"))
    return c


def snippet(c: Column, query: Column, width: int = 50) -> Column:
    """P22. ``width`` characters around the first hit, with ellipses; empty when there is none."""
    q = F.lower(query)
    at = F.instr(F.lower(c), q) - 1
    start = F.greatest(F.lit(0), at - width)
    end = F.least(F.length(c), at + F.length(q) + width)
    text = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(c, start + 1, end - start),
        F.when(end < F.length(c), "...").otherwise(""),
    )
    return F.when(at >= 0, text).otherwise("")


def extract_quantities(df: DataFrame, col: str, units: Sequence[str] = P.QUANTITY_UNITS, letters: str = "가-힣") -> DataFrame:
    """P23. One row per number with a known unit (suffix match): columns ``number`` and ``unit``."""
    pattern = rf"(\d+(?:,\d{{3}})*(?:\.\d+)?)\s*([{letters}]+)"
    c = F.col(col)
    pairs = F.arrays_zip(find_all(c, pattern, 1).alias("number"), find_all(c, pattern, 2).alias("unit"))
    known = "(" + "|".join(units) + ")$"
    rows = df.withColumn("_q", F.explode(pairs)).withColumn("number", F.col("_q.number")).withColumn("unit", F.col("_q.unit"))
    return rows.where(F.col("unit").rlike(known)).drop("_q")


def extract_refs(c: Column, patterns: Sequence[str] = P.LEGAL_PATTERNS) -> Column:
    """P24. Distinct references over all patterns."""
    return F.array_distinct(F.concat(*[find_all(c, p) for p in patterns]))


def numeral_value(word: Column) -> Column:
    """P25. Korean numeral to integer by one fold over its characters.

    Small units multiply the running value (an empty one counts as 1), the 10^4 and 10^8 units close it, every
    other character shifts it by one decimal place.
    """
    values = F.create_map(*[F.lit(x) for kv in P.NUMERAL_VALUES.items() for x in kv])

    def step(acc: Column, ch: Column) -> Column:
        v = values[ch].cast("bigint")
        return (
            F.when(v.isin(10, 100, 1000), F.try_multiply(F.when(acc == 0, F.lit(1)).otherwise(acc).cast("bigint"), v))
            .when(v.isin(10_000, 100_000_000), F.try_multiply(acc, v))
            .otherwise(F.try_add(F.try_multiply(acc, F.lit(10).cast("bigint")), v))
        )

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), step)


def extract_numerals(df: DataFrame, col: str) -> DataFrame:
    """P25. One row per numeral run: ``numeral`` and ``value``."""
    out = df.withColumn("numeral", F.explode(find_all(F.col(col), P.NUMERAL_PATTERN)))
    return out.withColumn("value", numeral_value(F.col("numeral")))


def parse_source_line(c: Column) -> Column:
    """P26. ``(doc, p.N, a-b)`` or ``문서ID: X, 페이지: Y`` to a struct; null when neither form is present."""
    full = r"\(([^,]+),\s*p\.(\d+),\s*(\d+)-(\d+)\)"
    short = r"문서ID:\s*([^,]+),\s*페이지:\s*(\d+)"

    def num(p: str, g: int) -> Column:
        return F.regexp_extract(c, p, g).try_cast("int")

    as_full = F.struct(
        F.regexp_extract(c, full, 1).alias("doc_id"), num(full, 2).alias("page"), num(full, 3).alias("start"), num(full, 4).alias("end")
    )
    as_short = F.struct(
        F.regexp_extract(c, short, 1).alias("doc_id"), num(short, 2).alias("page"), F.lit(0).alias("start"), F.lit(0).alias("end")
    )
    return F.when(c.rlike(full), as_full).when(c.rlike(short), as_short)


def flag_low_text(c: Column, threshold: float = 0.6, script: str = "any") -> Column:
    """P27. True when the page is short or has too few meaningful characters."""
    chars = r"[가-힣a-zA-Z0-9]" if script == "hangul" else r"[\p{L}\p{N}]"
    n = F.regexp_count(c, F.lit(chars))
    short = c.isNull() | (F.length(replace(c, r"^\s+|\s+$")) < 100)
    return short | (n == 0) | (n / F.greatest(F.length(c), F.lit(1)) < threshold)


def classify_line(c: Column) -> Column:
    """P28. article / paragraph / item / subitem, else null."""
    t = replace(c, r"^\s+|\s+$")
    return (
        F.when(t.rlike(r"^제\s*\d+\s*조"), "article")
        .when(t.rlike(r"^[①②③④⑤⑥⑦⑧⑨⑩]"), "paragraph")
        .when(t.rlike(r"^\d+\."), "item")
        .when(t.rlike(r"^[가나다라마바사아자차카타파하]\."), "subitem")
    )


def estimate_page(offset: Column) -> Column:
    """P29."""
    return (F.floor(offset / F.lit(2000)) + 1).cast("bigint")


def drop_symbols(c: Column, symbols: str = P.BOX_SYMBOLS) -> Column:
    """P30. Remove box-drawing symbols, collapse white space."""
    return F.trim(collapse(F.translate(c, symbols, "")))


def flag_blocked(c: Column, terms: Sequence[str]) -> Column:
    """P31. True when the text contains a blocked term (the caller's list, literal match)."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | c.contains(t)
    return hit


def join_department_spacing(c: Column) -> Column:
    c = replace(c, r"전\s*부\s*서", "전부서")
    return replace(c, r"전\s*동", "전동")


def cleanup_guarded(c: Column, keywords: Sequence[str] = P.CRITICAL_KEYWORDS) -> Column:
    """P32. Tidy units, punctuation and empty brackets; keep the original when too much would be lost."""
    t = replace(c, r"(\d+)\s*([월일년%회차])", "$1$2")
    t = replace(t, r"제\s*(\d+)\s*회", "제 $1회")
    t = replace(t, r"\s{2,}", " ")
    t = replace(t, r",,+", ",")
    t = replace(t, r"\.\.+", ".")
    t = replace(t, r"\(\s*\)")
    t = replace(t, r"\[\s*\]")
    t = join_department_spacing(t)

    def present(x: Column) -> Column:
        n = F.lit(0)
        for kw in keywords:
            n = n + F.when(x.contains(kw), 1).otherwise(0)
        return n

    lost = (F.length(t) < F.length(c) * 0.7) | ((present(c) > 0) & (present(t) < present(c) * 0.8))
    return replace(F.when(lost, c).otherwise(t), r"^\s+|\s+$")


def extract_deadline(c: Column) -> Column:
    """L9. First date as ``Y. M. D.``, empty when there is none."""
    y = replace(F.regexp_extract(c, P.DATE_PATTERN, 1), ",").try_cast("int")
    m = F.regexp_extract(c, P.DATE_PATTERN, 2).try_cast("int")
    d = F.regexp_extract(c, P.DATE_PATTERN, 3).try_cast("int")
    return F.when(c.rlike(P.DATE_PATTERN), F.concat(y, F.lit(". "), m, F.lit(". "), d, F.lit("."))).otherwise("")


def remove_dates(c: Column) -> Column:
    """L9. Remove every date form."""
    for p in P.DATE_REMOVALS:
        c = replace(c, p, " ")
    c = replace(c, r"\s{2,}", " ")
    return F.trim(replace(c, r"\.{2,}", "."))


def page_category(c: Column) -> Column:
    """L10. Category from the first 20 lines."""
    head = F.array_join(F.slice(F.split(c, r"\r?\n"), 1, 20), "\n")
    return F.when(head.rlike(r"훈\s*시"), "훈시").when(head.rlike(r"보\s*고"), "보고").otherwise("지시")


def split_title_body(c: Column, bullet: str = P.BULLET) -> Column:
    """L11. First line without its bullet is the title; the rest, one sentence per line, is the body."""
    lines = F.split(c, r"\r?\n")
    title = F.trim(replace(F.get(lines, F.lit(0)), rf"^\s*{bullet}+"))
    rest = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), lambda x: x != "")
    body = F.array_join(rest, " ")
    body = replace(body, r"\s*([.?!])\s*", "$1\n")
    body = replace(replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$")
    body = F.when(body == "", "").when(body.startswith("-"), body).otherwise(F.concat(F.lit("- "), body))
    return F.struct(title.alias("title"), body.alias("body"))

"""Text normalisation as Column -> Column functions (P1-P13, P17, P18, P20) and their change report.

All of them compile to regular-expression and string built-ins, so a whole chain stays one projection inside
one whole-stage-codegen span; only Unicode normalisation (P11) needs Arrow.
Word patterns use ``(?U)`` or explicit ``\\p{..}`` classes because Java's plain classes are ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import params as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where(test: Callable[[Column], Column], rule: Callable[[Column], Column], c: Column) -> Column:
    """``rule`` for the texts that pass one cheap test, which every text that it changes does."""
    return let(c, lambda t: F.when(test(t), rule(t)).otherwise(t))


def replace(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def quoted(text: str) -> str:
    """A pattern that matches the very text, whatever it holds."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal(text: str) -> str:
    """A replacement that stands for the very text."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def collapse(c: Column) -> Column:
    return replace(c, r"\s+", " ")


def clean_for_index(c: Column, parity: bool = False) -> Column:
    """P1. Drop private-use and control characters, tidy lines, keep at most two blank lines in a row.

    The default drops the whole private-use category; ``parity`` only U+E000-F8FF.
    """
    private = r"[\x{E000}-\x{F8FF}]" if parity else r"\p{Co}"
    c = replace(c, private)
    c = replace(c, r"(?![\n\t ])[\p{Cc}\p{Cf}\p{Cn}]")
    c = replace(c, r"(?m)^[ \t]+|[ \t]+$")
    c = replace(c, r"[ \t]+", " ")
    c = replace(c, r"\n{4,}", "\n\n\n")
    return replace(c, r"^\s+|\s+$")


def norm_whitespace(c: Column) -> Column:
    """P2. Collapse white space; no space between Hangul and a digit."""
    c = collapse(c)
    c = replace(c, r"([가-힣])\s+(\d)", "$1$2")
    return replace(c, r"(\d)\s+([가-힣])", "$1$2")


def _padded(c: Column, pattern: str, year_prefix: str) -> Column:
    # Month and day get a leading zero between markers; the second pass drops it where it is not needed.
    c = replace(c, pattern, f"\x01{year_prefix}$1-0$2-0$3\x01")
    return replace(c, r"\x01(\d{4})-0?(\d{2})-0?(\d{2})\x01", "$1-$2-$3")


def norm_dates(c: Column, parity: bool = False) -> Column:
    """P3. Dates to ISO. The default does not fire inside longer dotted numbers (versions, addresses)."""
    return where(lambda t: t.rlike("[0-9]"), lambda t: _dates(t, parity), c)


def _dates(c: Column, parity: bool) -> Column:
    c = _padded(c, r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", "")
    if parity:
        c = _padded(c, r"(\d{2})\.(\d{1,2})\.(\d{1,2})", "20")
    else:
        tail = r"\.(\d{1,2})\.(\d{1,2})(?!\d|\.\d)"
        c = _padded(c, r"(?<![\d.])(\d{4})" + tail, "")
        c = _padded(c, r"(?<![\d.])(\d{2})" + tail, "20")
    return replace(c, r"(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")


def norm_numbers(c: Column, parity: bool = False) -> Column:
    """P4. Thousands commas, percent signs, common fractions. The default leaves ISO dates alone."""
    return where(lambda t: t.rlike(r"(?U)\d"), lambda t: _numbers(t, parity), c)


def _numbers(c: Column, parity: bool) -> Column:
    iso_guard = "" if parity else r"(?!\d{3}-\d{2}-\d{2}\b)"
    zero_guard = "" if parity else r"(?!\d+-\d{2}-\d{2}\b)"
    c = replace(c, r"(?U)\b(?=\d{4,}\b)" + zero_guard + r"0+(?=\d)")
    c = replace(c, r"(?U)(?:\b|\G(?!^))(\d{1,3})(?=(?:\d{3})+\b)" + iso_guard, "$1,")
    c = replace(c, r"(\d+)\s*％", "$1%")
    c = replace(c, r"(\d+)\s*퍼센트", "$1%")
    for frac, dec in (("1/2", "0.5"), ("1/3", "0.33"), ("1/4", "0.25"), ("3/4", "0.75")):
        c = replace(c, rf"(?U)\b{frac}\b", dec)
    return c


def norm_currency(c: Column, parity: bool = False) -> Column:
    """P5. Amounts before the currency sign: plain digits get commas, unit words become digits.

    A text without the sign is passed through after one substring test."""
    return where(lambda t: t.contains("원"), lambda t: _currency(t, parity), c)


def _currency(c: Column, parity: bool) -> Column:
    head = r"(?<!\d)" if parity else r"(?<![\d,])"
    c = replace(c, r"(\d)\s*원", "$1원")
    c = replace(c, head + r"0+(?=\d+원)")
    c = replace(c, rf"(?:{head}|\G(?!^))(\d{{1,3}})(?=(?:\d{{3}})+원)", "$1,")
    units = list(P.CURRENCY_UNITS.items())
    if not parity:
        units.sort(key=lambda kv: -len(kv[0]))
    for unit, value in units:
        zeros = str(value)[1:]
        c = replace(c, rf"(\d+)\s*{unit}\s*원", f"\x02$1{zeros}\x03원")
        c = replace(c, rf"\s*{unit}\s*원", f"\x02{value}\x03원")
        c = replace(c, r"\x020+(?=\d)", "\x02")
        c = replace(c, r"((?:\x02|\G(?!^))\d{1,3})(?=(?:\d{3})+\x03)", "$1,")
        c = replace(c, r"[\x02\x03]")
    return c


def norm_law_refs(c: Column) -> Column:
    """P6. Article, paragraph and item references without inner spaces."""
    return where(lambda t: t.contains("제"), _law_refs, c)


def _law_refs(c: Column) -> Column:
    for unit in ("조", "항", "호"):
        c = replace(c, rf"제\s*(\d+)\s*{unit}", f"제$1{unit}")
    c = replace(c, r"(제\d+조)(제\d+항)", "$1 $2")
    c = replace(c, r"([가-힣]+법)\s+제(\d+)", "$1 제$2")
    return replace(c, r"([가-힣]+)\s+법률\s+제(\d+)", "$1법률 제$2")


def norm_punct(c: Column) -> Column:
    """P7. Full-width to half-width, repeated dots and commas to one, no space before punctuation."""
    c = F.translate(c, P.FULL_WIDTH, P.HALF_WIDTH)
    c = replace(c, r"\.{2,}", ".")
    c = replace(c, r",{2,}", ",")
    return replace(c, r"\s+([.,;:!?])", "$1")


def expand_terms(c: Column, terms: Mapping[str, str] = P.ABBREVIATIONS) -> Column:
    """P8. Whole-word abbreviation expansion over a small fixed dictionary."""
    for abbr, full in terms.items():
        c = where(lambda t, a=abbr: t.contains(a), lambda t, a=abbr, f=full: replace(t, rf"(?U)\b{quoted(a)}\b", literal(f)), c)
    return c


def normalise(c: Column, parity: bool = False) -> Column:
    """P9. P2..P8 in order, trimmed: one projection."""
    c = norm_whitespace(c)
    c = norm_dates(c, parity)
    c = norm_numbers(c, parity)
    c = norm_currency(c, parity)
    c = norm_law_refs(c)
    c = norm_punct(c)
    return F.trim(expand_terms(c))


def normalise_query(c: Column, parity: bool = False) -> Column:
    """P10. P9 plus removal of question marks, interrogatives, copulas and standalone particles."""
    c = replace(normalise(c, parity), "[?？]")
    c = replace(c, "(" + "|".join(P.QUERY_INTERROGATIVES) + ")")
    c = replace(c, "(" + "|".join(P.QUERY_COPULAS) + ")")
    for particle in P.QUERY_PARTICLES:
        c = replace(c, rf"(?U)\b{particle}\b")
    return F.trim(collapse(c))


def norm_unicode(form: str = "NFKC") -> Callable[[Column], Column]:
    """P11. Unicode normal form, zero-width characters removed, white space collapsed (Arrow batches)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return lambda c: F.trim(collapse(replace(run(c), r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]")))


def norm_doc_id(c: Column, nfc: bool = False) -> Column:
    """P12. Document id without its known extension; ``nfc`` composes characters first."""
    c = norm_unicode("NFC")(c) if nfc else F.trim(c)
    return replace(c, P.DOC_SUFFIX_PATTERN)


def norm_compare(c: Column) -> Column:
    """P13. Comparison form: white space collapsed, punctuation dropped, lower case, trimmed."""
    return F.trim(F.lower(replace(collapse(c), r"[^\p{L}\p{N}_\s]")))


def strip_sections(c: Column) -> Column:
    """P17. Remove reasoning sections and their stray tags."""
    for p in (r"(?is)<think>.*?</think>", r"(?is)<thinking>.*?</thinking>", r"(?is)\[think\].*?\[/think\]",
              r"(?is)</?thinking?>", r"(?is)\[/?think\]"):
        c = replace(c, p)
    return replace(c, r"^\s+|\s+$")


def strip_citations(c: Column) -> Column:
    """P18. Remove ``[n]`` markers."""
    return replace(c, r"\[[0-9]+\]")


def text_hash(c: Column) -> Column:
    """P20. sha256 of the collapsed, trimmed text (apply :func:`norm_unicode` first for the full form)."""
    return F.sha2(F.trim(collapse(c)), 256)


def query_hash(c: Column) -> Column:
    """P20. md5 of the trimmed lower-case query: the repeat-query key."""
    return F.md5(F.lower(F.trim(c)))


RULES: dict[str, Callable[[Column], Column]] = {
    "whitespace": norm_whitespace,
    "dates": norm_dates,
    "numbers": norm_numbers,
    "currency": norm_currency,
    "law_refs": norm_law_refs,
    "punct": norm_punct,
    "terms": expand_terms,
}


def normalise_report(df: DataFrame, col: str, rules: Mapping[str, Callable[[Column], Column]] = RULES) -> DataFrame:
    """Per rule, applied in order: rows changed and characters removed. One scan, one partial aggregate."""
    stages = df.select(F.col(col).alias("_s0"))
    for i, fn in enumerate(rules.values()):
        stages = stages.withColumn(f"_s{i + 1}", fn(F.col(f"_s{i}")))
    aggs, names = [], list(rules)
    for i, name in enumerate(names):
        a, b = F.col(f"_s{i}"), F.col(f"_s{i + 1}")
        aggs += [
            F.count_if(~a.eqNullSafe(b)).alias(f"{name}_rows"),
            F.sum(F.length(a) - F.length(b)).alias(f"{name}_chars"),
        ]
    one = stages.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"{n}_rows").alias("rows_touched"), F.col(f"{n}_chars").alias("chars_removed"))
        for n in names
    ])
    return one.select(F.inline(rows))

"""Set and overlap measures as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.normalize import let, norm_compare
from attestry.functions.patterns import find_all
from attestry.functions.tokens import char_ngrams, words


def jaccard(a: Column, b: Column) -> Column:
    """U2. |a ∩ b| / |a ∪ b| of two arrays of distinct elements, 0 when either is empty."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("i"), F.size(a).alias("a"), F.size(b).alias("b"))
    return let(sizes, lambda n: F.when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(n["i"] / (n["a"] + n["b"] - n["i"])))


def overlap_ratio(prev: Column, cur: Column) -> Column:
    """U5. |prev ∩ cur| / |cur|, 1.0 when ``cur`` is empty."""
    return F.when(F.size(cur) == 0, 1.0).otherwise(
        F.size(F.array_intersect(prev, cur)) / F.size(F.array_distinct(cur))
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """V2. Word-set Jaccard of two texts."""
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def ngram_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """R15. Character n-gram Jaccard of two texts."""
    return jaccard(char_ngrams(a, n), char_ngrams(b, n))


def share_contained(parts: Column, text: Column) -> Column:
    """Share of array elements that occur in the text, 0 for an empty array."""
    # Both sides are bound first: an expression captured by a lambda would be evaluated once per element.
    both = F.struct(parts.alias("p"), text.alias("t"))
    return let(both, lambda b: F.when(F.size(b["p"]) == 0, 0.0).otherwise(
        F.size(F.filter(b["p"], lambda k: b["t"].contains(k))) / F.size(b["p"])))


def number_match(keywords: Column, text: Column) -> Column:
    """R16. Share of keywords with a digit found in the text."""
    numeric = F.filter(keywords, lambda k: k.rlike(r"\d"))
    return share_contained(F.transform(numeric, lambda k: F.lower(k)), F.lower(text))


def keyword_parts(keywords: Column, text: Column, text_ngrams: Column | None = None) -> Column:
    """R13. What the relevance of a (query, text) pair is made of: struct(n, exact, gram, num, bonus).

    ``text_ngrams`` lets the caller compute a document's bigrams once and share them over queries."""
    low = F.lower(text)
    kws = F.transform(keywords, lambda k: F.lower(k))
    joined = F.array_join(kws, " ")
    grams_b = char_ngrams(low) if text_ngrams is None else text_ngrams
    return F.struct(
        F.size(keywords).alias("n"), share_contained(kws, low).alias("exact"), jaccard(char_ngrams(joined), grams_b).alias("gram"),
        number_match(keywords, text).alias("num"), F.least(F.length(joined) / F.lit(20.0), F.lit(0.1)).alias("bonus"))


def missing_keywords(keywords: Column, text: Column) -> Column:
    """The lower-case keywords that the text does not hold, as often as they come in different cases."""
    both = F.struct(F.transform(keywords, lambda k: F.lower(k)).alias("k"), F.lower(text).alias("t"))
    return let(both, lambda b: F.filter(b["k"], lambda k: ~b["t"].contains(k)))


def keyword_score(parts: Column, partial: Column) -> Column:
    """R13. Weighted sum of the parts; ``partial`` is the share of keywords with only a partial or fuzzy match."""
    def combine(m: Column) -> Column:
        ex, pa, gr = m["p"]["exact"], m["partial"], m["p"]["gram"]
        total = ex * 0.4 + pa * 0.25 + gr * 0.25 + m["p"]["num"] * 0.1 + m["p"]["bonus"]
        floored = F.when((gr > 0.05) | (pa > 0) | (ex > 0), F.greatest(total, F.lit(0.1))).otherwise(total)
        return F.when(m["p"]["n"] == 0, 0.2).otherwise(F.least(floored, F.lit(1.0)))

    return let(F.struct(parts.alias("p"), partial.alias("partial")), combine)


def keyword_relevance(keywords: Column, text: Column, text_ngrams: Column | None = None, partial: Column | None = None) -> Column:
    """R13. Weighted keyword relevance of one (query, text) pair."""
    return keyword_score(keyword_parts(keywords, text, text_ngrams), F.lit(0.0) if partial is None else partial)


def content_similarity_normed(na: Column, nb: Column, wb: Column | None = None) -> Column:
    """V11 on texts already in comparison form; ``wb`` are the distinct words of ``nb`` when already known."""
    wb = F.array_distinct(find_all(nb, r"\S+")) if wb is None else wb

    def score(wa: Column) -> Column:
        longer = F.filter(wa, lambda w: F.length(w) > 2)
        j = jaccard(F.array_distinct(wa), wb)
        return let(longer, lambda lw: F.when(F.size(lw) > 0, j * 0.6 + share_contained(lw, nb) * 0.4).otherwise(j))

    return F.when((na == "") | (nb == ""), 0.0).when(nb.contains(na), 1.0).otherwise(let(find_all(na, r"\S+"), score))


def content_similarity(a: Column, b: Column) -> Column:
    """V11. 1.0 on containment, else .6 word Jaccard + .4 share of words over two characters found."""
    return content_similarity_normed(norm_compare(a), norm_compare(b))


def _content_score(na: str, nb: str, wb: set[str]) -> float:
    if not na or not nb:
        return 0.0
    if na in nb:
        return 1.0
    wa = re.findall(r"\S+", na, re.ASCII)  # white space as the column functions have it
    mine = set(wa)
    both = len(mine & wb)
    j = both / (len(mine) + len(wb) - both) if mine and wb else 0.0
    longer = [w for w in wa if len(w) > 2]
    if not longer:
        return j
    found = {w for w in mine if w in wb or w in nb}
    return j * 0.6 + sum(w in found for w in longer) / len(longer) * 0.4


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def content_scores(lines: pd.Series, texts: pd.Series) -> pd.Series:
    """V11 of every line with every text of a row, all in comparison form: as ``content_similarity_normed``.

    The words of a text are gathered once for all lines, and only words that it lacks are looked for inside its words."""
    out = []
    for ls, ts in zip(lines, texts):
        known = [(t, None if t is None else set(re.findall(r"\S+", t, re.ASCII))) for t in ts]
        out.append([[None if line is None or t is None else _content_score(line, t, wb) for t, wb in known] for line in ls])
    return pd.Series(out)


def content_matches(a: Column, b: Column, script: str = "any") -> Column:
    """V17. Overlap of words of 3+ letters above 30 % of the smaller set."""
    cls = r"[가-힣]{3,}" if script == "hangul" else r"\p{L}{3,}"
    wa, wb = (F.array_distinct(find_all(F.lower(x), cls)) for x in (a, b))
    smaller = F.least(F.size(wa), F.size(wb))
    return F.when(smaller == 0, False).otherwise(F.size(F.array_intersect(wa, wb)) / smaller > 0.3)


def multiset_f1(a: Column, b: Column) -> Column:
    """E2 on token arrays. The multiset intersection numbers equal tokens (``the#1``, ``the#2``) and then is
    an ordinary set intersection, so no explode or join is needed."""
    def numbered(x: Column) -> Column:
        # Sorted tokens; the k-th copy of a token is its index minus the token's first index.
        return let(F.array_sort(x), lambda s: F.transform(
            s, lambda t, i: F.concat_ws("#", t, (i - F.array_position(s, t)).cast("string"))))

    # 2pr / (p + r) with p = same/|a| and r = same/|b| is 2 same / (|a| + |b|).
    def score(m: Column) -> Column:
        na, nb = F.size(m["a"]), F.size(m["b"])
        same = F.size(F.array_intersect(numbered(m["a"]), numbered(m["b"])))
        return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(2 * same / (na + nb))

    return let(F.struct(a.alias("a"), b.alias("b")), score)


def token_f1(prediction: Column, reference: Column) -> Column:
    """E2. Multiset token F1 after the comparison normaliser."""
    return multiset_f1(find_all(norm_compare(prediction), r"\S+"), find_all(norm_compare(reference), r"\S+"))


def exact_match(prediction: Column, reference: Column) -> Column:
    """E1."""
    return F.when(norm_compare(prediction) == norm_compare(reference), 1.0).otherwise(0.0)


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """E4. Intersection over hull of two half-open spans."""
    inter = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(inter > 0, inter / hull).otherwise(0.0)

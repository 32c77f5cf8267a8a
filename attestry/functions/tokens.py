"""Tokenising, sentence splitting and word statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.normalize import collapse, let, replace
from attestry.functions.patterns import find_all

WORD_CLASS = {"any": r"\p{L}", "hangul": "가-힣"}
TOKEN_PATTERN = {"any": r"\p{L}+|[0-9]+", "hangul": r"[가-힣]+|[a-zA-Z]+|[0-9]+"}


def tokens(c: Column, script: str = "any", stop: Sequence[str] = P.STOP_WORDS) -> Column:
    """R1. Array of lower-case letter runs and digit runs without stop words."""
    found = find_all(F.lower(c), TOKEN_PATTERN[script])
    if not stop:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop))


def clean_query(c: Column) -> Column:
    """R4. Everything that is not a word character becomes a space."""
    return F.trim(collapse(replace(c, r"[^\p{L}\p{N}_\s]", " ")))


def words(c: Column) -> Column:
    """White-space words of the lower-case text without punctuation (V2)."""
    return find_all(F.lower(c), r"[\p{L}\p{N}_]+")  # punctuation parts words as a space does


def count_tokens(c: Column) -> Column:
    """C8. Token count: length / 3."""
    return F.floor(F.length(c) / F.lit(3)).cast("bigint")


def split_sentences(c: Column, mode: str = "strip") -> Column:
    """C9. Sentence arrays; the four variants differ in what counts as an end and whether it is kept.

    ``keep``   ends ``.!?。``, punctuation kept          ``strip``  ends ``.!?。`` plus white space, dropped
    ``spaced`` ends ``.!?`` followed by white space      ``lookback`` same, punctuation kept
    """
    if mode == "keep":
        parts = find_all(c, r"[^.!?。]+[.!?。]?|[.!?。]")
    elif mode == "strip":
        parts = F.split(c, r"[.!?。]\s*")
    elif mode == "spaced":
        parts = F.split(c, r"[.!?]\s+")
    elif mode == "lookback":
        parts = F.split(c, r"(?<=[.!?])\s+")
    else:
        raise ValueError(mode)
    return F.filter(F.transform(parts, lambda s: replace(s, r"^\s+|\s+$")), lambda s: s != "")


def strip_particles(c: Column, suffixes: Sequence[str] = P.PARTICLE_SUFFIXES) -> Column:
    """R12. Remove the longest listed suffix, once, unless nothing would be left."""
    alt = "|".join(sorted(suffixes, key=len, reverse=True))
    return replace(c, rf"(?s)^(.+?)(?:{alt})$", "$1")


def is_content_word(c: Column) -> Column:
    """R11. Content-word heuristic on one word."""
    n = F.length(c)
    verb = F.lit(False)
    for e in P.VERB_ENDINGS:
        verb = verb | c.endswith(e)
    return (
        F.when(n < 2, False)
        .when(n >= 4, True)
        .when(verb, False)
        .when(n == 3, ~c.isin(*P.FUNCTION_WORDS_3))
        .otherwise(F.substring(c, -1, 1).isin(*P.NOUN_FINALS))
    )


def extract_keywords(c: Column, script: str = "any") -> Column:
    """R10. Numbers with counters, ordinal references, content words, Latin terms; ordered distinct."""
    numbers = find_all(c, r"\d+(?:년|월|일|호|회|차|번|개|명|건)?")
    refs = find_all(c, r"제\s*\d+\s*[호조항차회]")
    if script == "hangul":
        content = F.filter(find_all(c, "[가-힣]{2,}"), is_content_word)
        latin = F.filter(find_all(c, "[a-zA-Z][a-zA-Z0-9]*"), lambda t: F.length(t) >= 2)
        return F.array_distinct(F.concat(numbers, refs, content, latin))
    content = F.filter(find_all(c, r"\p{L}{2,}"), lambda t: F.length(t) >= 4)
    latin = F.filter(find_all(c, r"\p{IsLatin}[\p{IsLatin}0-9]*"), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(numbers, refs, content, latin))


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams: one regular-expression pass with an overlapping look-ahead capture."""
    return F.array_distinct(find_all(c, "(?s)(?=(" + "." * n + "))", 1))


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda ch: ch != "")


def char_entropy(word: Column) -> Column:
    """A15. Shannon entropy of the characters, bits."""
    def total(chars: Column) -> Column:
        share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / F.size(chars).cast("double")
        term = lambda ch: let(share(ch), lambda p: -p * F.log2(p))
        return F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x)

    return let(_chars(word), total)


def char_diversity(word: Column) -> Column:
    """A15. Distinct characters over length."""
    return let(_chars(word), lambda ch: F.size(F.array_distinct(ch)) / F.size(ch).cast("double"))


def repetitive_suffix(word: Column) -> Column:
    """K3. The last two or three characters occur twice, or are one repeated character (words of 4+)."""
    def check(k: int) -> Column:
        suffix = F.substring(word, -k, k)
        # Occurrences without overlap: what is left after removing them, in units of k characters.
        occurrences = (F.length(word) - F.length(F.replace(word, suffix, F.lit("")))) / F.lit(k)
        same = F.size(F.array_distinct(_chars(suffix))) == 1
        return (occurrences > 1) | same

    return (F.length(word) >= 4) & (check(2) | check(3))


def is_stat_word(word: Column, strict: bool = False) -> Column:
    """K3. Statistical content word: entropy, diversity and suffix repetition (normal 1.2/.4, strict 2.0/.6)."""
    ent, div = (2.0, 0.6) if strict else (1.2, 0.4)
    return (
        (F.length(word) >= 2)
        & (char_diversity(word) >= div)
        & (char_entropy(word) >= ent)
        & ~repetitive_suffix(word)
    )

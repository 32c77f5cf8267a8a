"""Blocked fuzzy similarity join (FZ) and partial keyword matches.

Candidates lose no pair at or above the threshold.  Short strings under ``ratio`` and ``token_sort`` share a segment:
a ratio of at least s allows d insertions and deletions, each of which breaks one segment at most, so of the d + 1
segments of one string one stands in the other, shifted by no more than the edits before it.  Long strings and the other
methods use a prefix filter: two strings whose longest common subsequence has at least ``o`` characters share k of the
first ``m - o + k`` characters of either (characters are numbered by occurrence, high occurrence numbers first).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.fuzzy import fuzzy_score
from attestry.functions.normalize import let, norm_unicode
from attestry.functions.patterns import find_all
from attestry.functions.tokens import WORD_CLASS
from attestry.scale import cut_lineage, salted_join, spread

EPS = 1e-9
#: Digits of an occurrence number: a string has fewer than 2**31 characters, so none is ever cut.
OCCURRENCE_DIGITS = 10
#: Linked words of a keyword that are looked up first.
COMMON_LINKS = 4
#: Right strings of up to this many characters are cut into segments, longer ones matched by their rarest characters.
SEGMENT_CHARS = 24
#: Below it a string can need more segments than it has characters.
SEGMENT_SCORE = 2 / 3


def _numbered_chars(c: Column) -> Column:
    """Each character with its occurrence number, high occurrences and high code points first."""
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    marks = let(chars, lambda s: F.transform(
        s, lambda ch, i: F.concat(F.lpad((i - F.array_position(s, ch) + 1).cast("string"), OCCURRENCE_DIGITS, "0"), ch)))
    return F.sort_array(marks, asc=False)


def _need(marks: Column, s: float) -> Column:
    return F.ceil(F.size(marks) * (s / (2 - s)) - EPS).cast("int")


def _prefix(marks: Column, s: float, extra: int = 1) -> Column:
    return F.slice(marks, F.lit(1), F.greatest(F.size(marks) - _need(marks, s) + extra, F.lit(0)))


def _pair_keys(marks: Column, s: float) -> Column:
    """Two strings that share ``o`` >= 2 characters share two of their ``m - o + 2`` rarest ones, so pairs of
    characters are the keys: far more selective than single characters.  Strings short enough to match on one
    shared character carry single keys as well."""
    pairs = let(_prefix(marks, s, 2), lambda p: F.flatten(F.transform(
        p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.concat(x, F.lit("~"), y)))))
    single = F.when(_need(marks, s) < 2, _tag("S", _prefix(marks, s))).otherwise(F.array().cast("array<string>"))
    return F.concat(pairs, single)


def _tag(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def _keys(side: str, method: str, s: float) -> Column:
    marks = F.col("_marks")
    if method == "partial":
        short, full = _tag("A", _prefix(marks, s)), _tag("A", marks)
        short_b, full_b = _tag("B", _prefix(marks, s)), _tag("B", marks)
        return F.concat(short, full_b) if side == "left" else F.concat(full, short_b)
    if method == "token_set":
        return F.concat(_tag("W", F.array_distinct(find_all(F.col("_s"), r"\S+"))), _tag("C", _pair_keys(marks, s)))
    return _pair_keys(marks, s)


def _prepared(forms: DataFrame, side: str, method: str, s: float) -> DataFrame:
    """Distinct strings with their characters and blocking keys."""
    out = forms.withColumn("_marks", _numbered_chars(F.col("_form"))).withColumn("_keys", _keys(side, method, s))
    name = "l" if side == "left" else "r"
    return out.select(F.col("_s").alias(f"{name}_text"), F.col("_marks").alias(f"{name}_marks"), F.col("_keys").alias(f"{name}_keys"),
                      F.explode(F.array_distinct("_keys")).alias("key"))


def _edits(m: int, n: int, s: float) -> int:
    """Most insertions and deletions between strings of ``m`` and ``n`` characters whose ratio is at least ``s``; -1: never."""
    d = math.floor((1 - s) * (m + n) + EPS)
    d -= (d - m - n) % 2
    return d if d >= abs(m - n) else -1


def segment_rows(s: float) -> tuple[list[tuple], list[tuple]]:
    """Where segments stand: right rows (chars, kind, at, size) and left rows of the same kinds, at every shift allowed.

    A kind is (chars of the right string, edits, number of the segment).  A segment of the right string moves left by the
    deletions before it, right by the insertions; both counts follow from the edits and the two lengths."""
    left, right = [], set()
    for n in range(1, SEGMENT_CHARS + 1):
        for m in range(1, math.floor(n * (2 - s) / s + EPS) + 1):
            d = _edits(m, n, s)
            if d < 0:
                continue
            back, ahead = (d + n - m) // 2, (d + m - n) // 2
            for i in range(d + 1):
                at, end = i * n // (d + 1), (i + 1) * n // (d + 1)
                kind = f"{n}.{d}.{i}."
                right.add((n, kind, at + 1, end - at))
                left += [(m, kind, p + 1, end - at) for p in range(max(0, at - back), min(m - (end - at), at + ahead) + 1)]
    return left, sorted(right)


def _segment_keys(df: DataFrame, rows: list[tuple], name: str) -> DataFrame:
    """(``name``_text, key) for distinct (_s, _form); the table of places has a fixed size, whatever the data.

    A right string has each kind at one place, so its keys are distinct; a left one can hold a segment at several."""
    places = F.broadcast(df.sparkSession.createDataFrame(pa.table(list(map(list, zip(*rows, strict=True))), ["chars", "kind", "at", "size"])))
    cut = df.withColumn("_mask", _mask(F.col("_form"))).join(places, F.length("_form") == places["chars"])
    return cut.select(
        F.col("_s").alias(f"{name}_text"), F.length("_form").alias(f"{name}_n"), "_mask",
        F.concat("kind", F.substring(F.col("_form"), F.col("at").cast("int"), F.col("size").cast("int"))).alias("key")).withColumnRenamed("_mask", f"{name}_mask")


def _mask(form: Column) -> Column:
    """64 bits, one set for each numbered character; a bit that only one of two strings has is a character the other lacks."""
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m), F.lit(64)).cast("int"))
    return F.aggregate(_numbered_chars(form), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(bit(m)))


def _masks_fit(s: float) -> Column:
    """Whether the characters alone leave room for the score: no more of either may be missing in the other than there
    can be deletions and insertions."""
    d = F.floor((1 - s) * (F.col("l_n") + F.col("r_n")) + EPS)
    lacks = lambda a, b: F.bit_count(F.col(f"{a}_mask").bitwiseAND(F.bitwise_not(F.col(f"{b}_mask"))))
    return (2 * lacks("l", "r") <= d + F.col("l_n") - F.col("r_n")) & (2 * lacks("r", "l") <= d + F.col("r_n") - F.col("l_n"))


def _forms(df: DataFrame, method: str) -> DataFrame:
    """Distinct strings (_s) with the form that is compared (_form)."""
    form = F.col("_s")
    if method in ("token_sort", "token_set"):
        words = find_all(form, r"\S+")
        form = F.array_join(F.array_sort(F.array_distinct(words) if method == "token_set" else words), " ")
    return df.select(F.col("text").alias("_s")).where("_s IS NOT NULL").distinct().withColumn("_form", form)


def fuzzy_candidates(left: DataFrame, right: DataFrame, method: str = "ratio", min_score: float = 0.8) -> DataFrame:
    """FZ. Distinct (l_text, r_text) pairs that can reach ``min_score``; hot keys are salted by their frequency."""
    lf, rf = _forms(left, method), _forms(right, method)
    if method in ("partial", "token_set") or min_score <= SEGMENT_SCORE:
        return _prefix_candidates(lf, rf, method, min_score)
    at_left, at_right = segment_rows(min_score)
    right_keys = cut_lineage(_segment_keys(rf, at_right, "r"))  # read twice: counted by key and joined
    short = salted_join(_segment_keys(lf, at_left, "l").distinct(), right_keys, "key", "r_text")
    short = short.where(_masks_fit(min_score)).select("l_text", "r_text").distinct()
    # strings without characters (white space under token_sort) equal each other only
    empty = lf.where(F.length("_form") == 0).select(F.col("_s").alias("l_text"), "_form").join(
        rf.where(F.length("_form") == 0).select(F.col("_s").alias("r_text"), "_form"), "_form").select("l_text", "r_text")
    long_left = lf.where(F.length("_form") >= math.ceil((SEGMENT_CHARS + 1) * min_score / (2 - min_score) - EPS))
    return short.unionByName(empty).unionByName(_prefix_candidates(long_left, rf.where(F.length("_form") > SEGMENT_CHARS), method, min_score))


def _prefix_candidates(lf: DataFrame, rf: DataFrame, method: str, s: float) -> DataFrame:
    """Pairs by shared rare characters.

    A pair that shares several keys is emitted at its smallest one only, so no pair de-duplication shuffle
    follows; length band and character overlap are checked inside the join.
    """
    lp, rp = _prepared(lf, "left", method, s), _prepared(rf, "right", method, s)
    m, n = F.size("l_marks"), F.size("r_marks")
    common = F.array_intersect("l_keys", "r_keys")
    if method == "partial":
        tag = F.when(m <= n, "A").otherwise("B")
        owner = F.array_min(F.filter(common, lambda k: k.startswith(tag)))
        fits = F.size(F.array_intersect("l_marks", "r_marks")) >= F.least(m, n) * (s / (2 - s)) - EPS
    else:
        owner = F.array_min(common)
        fits = (2 * F.least(m, n) >= s * (m + n) - EPS) & (F.size(F.array_intersect("l_marks", "r_marks")) >= s * (m + n) / 2 - EPS)
        if method == "token_set":
            fits = F.col("key").startswith("W") | fits
    return lp.join(rp, "key").where(fits & (F.col("key") == owner)).select("l_text", "r_text")


def fuzzy_join(
    left: DataFrame, right: DataFrame, method: str = "ratio", min_score: float = 0.8, best_only: bool = True, normalise: bool = False
) -> DataFrame:
    """FZ. (id, text) x (id, text) -> (left_id, right_id, score) at or above ``min_score``; the best match per
    left row by default."""
    if normalise:
        left, right = (d.withColumn("text", norm_unicode("NFKC")(F.col("text"))) for d in (left, right))
    scored = spread(fuzzy_candidates(left, right, method, min_score), "l_text", "r_text").withColumn("score", fuzzy_score(method)(F.col("l_text"), F.col("r_text")))
    scored = scored.where(F.col("score") >= min_score - EPS)
    rows = (
        left.select(F.col("id").alias("left_id"), F.col("text").alias("l_text")).join(scored, "l_text")
        .join(right.select(F.col("id").alias("right_id"), F.col("text").alias("r_text")), "r_text"))
    if not best_only:
        return rows.select("left_id", "right_id", "score")
    best = rows.groupBy("left_id").agg(F.max_by(F.struct("right_id", "score"), F.struct("score", "right_id")).alias("b"))
    return best.select("left_id", "b.right_id", "b.score")


def candidate_report(left: DataFrame, right: DataFrame, method: str = "ratio", min_score: float = 0.8) -> DataFrame:
    """FZ. Pairs compared, pairs possible and the share that survives the blocking."""
    n = lambda d: d.select("text").distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    pairs = fuzzy_candidates(left, right, method, min_score).agg(F.count(F.lit(1)).alias("compared"))
    return pairs.withColumn("possible", n(left) * n(right)).withColumn(
        "share", F.when(F.col("possible") > 0, F.col("compared") / F.col("possible")))


def keyword_links(keywords: DataFrame, words: DataFrame, min_score: float = 0.8) -> DataFrame:
    """R14. (keyword, word) of distinct lower-case keywords and vocabulary words that match in part: the word stands
    in the keyword (two characters and more), or both have three and more and a ratio of at least ``min_score``.

    It depends on the two vocabularies only, so it is built once and serves every text; a word's keywords are found
    by joins, never by comparing all pairs."""
    kw = keywords.select("keyword").distinct()
    # A word inside a keyword: the keyword's own substrings are few, so they are the join key.
    subs = kw.where(F.length("keyword") >= 2).withColumn("word", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("keyword") - 1), lambda i: F.transform(
            F.sequence(F.lit(2), F.length("keyword") - i + 1), lambda n: F.substring(F.col("keyword"), i, n)))))).distinct()
    inside = subs.join(words.select("word").distinct(), "word", "left_semi").select("keyword", "word")
    close = fuzzy_candidates(
        kw.where(F.length("keyword") >= 3).select(F.col("keyword").alias("text")),
        words.where(F.length("word") >= 3).select(F.col("word").alias("text")), "ratio", min_score)
    scored = spread(close, "l_text", "r_text").withColumn("s", fuzzy_score("ratio")(F.col("l_text"), F.col("r_text")))
    near = scored.where(F.col("s") >= min_score - EPS).select(F.col("l_text").alias("keyword"), F.col("r_text").alias("word"))
    return inside.unionByName(near).distinct()


def chunk_words(chunks: DataFrame, script: str = "any") -> DataFrame:
    """(chunk_id, word): distinct words of two letters and more of each chunk, straight from the texts."""
    return chunks.select("chunk_id", F.explode(F.array_distinct(find_all(F.lower("text"), f"[{WORD_CLASS[script]}]{{2,}}"))).alias("word"))


def posting_words(postings: DataFrame, chunks: DataFrame, links: DataFrame, script: str = "any", stop=P.STOP_WORDS) -> DataFrame:
    """(chunk_id, word) for ``linked_keywords``, from an index: its postings, and from the texts only those words the index
    leaves out that some link asks for."""
    own = postings.select("chunk_id", F.col("term").alias("word"))
    left_out = [r[0] for r in links.where(F.col("word").isin(*stop)).select("word").distinct().collect()]  # of the stop list
    if not left_out:
        return own
    some = chunks.where(F.lower("text").rlike("|".join(left_out)))
    return own.unionByName(chunk_words(some, script).where(F.col("word").isin(*left_out)))


def vocabulary(postings: DataFrame, script: str = "any", stop=P.STOP_WORDS) -> DataFrame:
    """(word): the words of two letters and more in an index, and those it leaves out."""
    own = postings.select(F.col("term").alias("word")).distinct().where(F.col("word").rlike(f"^[{WORD_CLASS[script]}]{{2,}}$"))
    left_out = postings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in stop if len(w) >= 2] or [F.lit("")])).alias("word")).where("word <> ''")
    return own.unionByName(left_out).distinct()


def linked_keywords(missing: DataFrame, links: DataFrame, words: DataFrame) -> DataFrame:
    """R14. The (chunk_id, keyword) rows of ``missing`` for which the chunk holds a linked word.

    A keyword's commonest linked words are looked up first and settle nearly all rows; the others only for what is left."""
    asked = cut_lineage(missing.select("chunk_id", "keyword").distinct())
    share = words.join(links.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    ranked = links.join(share, "word").withColumn("_r", F.row_number().over(Window.partitionBy("keyword").orderBy(F.col("_n").desc(), "word")))
    ranked = cut_lineage(ranked.select("keyword", "word", (F.col("_r") <= COMMON_LINKS).alias("common")))
    hold = lambda rows, some: rows.join(ranked.where(some).select("keyword", "word"), "keyword").join(
        words, ["chunk_id", "word"], "left_semi").select("chunk_id", "keyword").distinct()
    settled = cut_lineage(hold(asked, "common"))
    return settled.unionByName(hold(asked.join(settled, ["chunk_id", "keyword"], "left_anti"), "not common"))


def partial_matches(pairs: DataFrame, chunks: DataFrame, script: str = "any", min_score: float = 0.8) -> DataFrame:
    """R14. Keywords of (query_id, chunk_id, keyword) with only a partial match in the chunk's words: one holds
    the other, or a fuzzy ratio of at least ``min_score`` for words of three or more.

    Exact containment is decided per text, with the keywords of a pair as one array."""
    asked = pairs.groupBy("query_id", "chunk_id").agg(F.collect_set(F.lower("keyword")).alias("_k"))
    texts = chunks.select("chunk_id", F.lower("text").alias("_t"))
    both = F.struct("_t", "_k")
    missing = asked.join(texts, "chunk_id").select("query_id", "chunk_id", F.explode(let(both, lambda b: F.filter(b["_k"], lambda k: ~b["_t"].contains(k)))).alias("keyword"))
    words = chunk_words(chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi"), script)
    missing, words = cut_lineage(missing), cut_lineage(words)
    links = cut_lineage(keyword_links(missing, words.select("word").distinct(), min_score))
    return missing.join(linked_keywords(missing, links, words), ["chunk_id", "keyword"]).select("query_id", "chunk_id", "keyword").distinct()

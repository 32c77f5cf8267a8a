"""Operator 2: benchmark decontamination on templates, in DataFrame functions only.

Words become lower-case letters; numbers, names and units become typed placeholders.  Windows of template words are
hash-joined with the benchmark's, and on every alignment found the windows whose placeholders do not map one to
one are left out, so that a question asked again with other numbers or names is caught and a chance likeness is not.  Items whose
template says too little (windows that are mostly placeholders, or passages without spaces) are matched verbatim as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.store import settle

WINDOW = 8
#: Items of fewer template words are too short to be told from chance and match nothing.
SHORTEST = 5
#: A template window needs this share of words that are not placeholders; items with other windows are matched verbatim too.
LITERAL = 0.5
#: Share of an item's windows that a contaminated text holds.
COVERAGE = 0.5
NUMBER, NAME, UNIT = "#", "$", "@"
SPACE = r"[\x20\x09-\x0D]+"
#: Scripts written without spaces: each letter is a token.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNITS = (
    "percent", "mm", "cm", "m", "km", "metre", "metres", "meter", "meters", "mile", "miles", "inch", "inches", "foot", "feet", "yard", "yards",
    "mg", "g", "kg", "gram", "grams", "tonne", "tonnes", "pound", "pounds", "ounce", "ounces", "ml", "l", "litre", "litres", "liter", "liters",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees", "volt", "volts", "watt", "watts", "hz", "kb", "mb", "gb", "kmh", "mph",
)


def words_of(text: Column) -> Column:
    """The words of a text that hold a letter or digit; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def tokens_of(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text, each letter of an unspaced script by itself; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]+)"), 1)


def template_of(words: Column) -> Column:
    """The template word of each word; a name is a capitalised word that does not begin a sentence."""

    def parts(w: Column) -> Column:
        return F.struct(w.alias("word"), F.regexp_replace(w, r"\P{L}+", "").alias("letters"), w.rlike(r"\p{N}").alias("digit"))

    def canon(known: Column, x: Column, i: Column) -> Column:
        low = F.lower(x["letters"])
        before = F.element_at(known, i)
        begins = F.when(i > 0, before["word"].rlike(r"[.!?:;|]['\")\]]*$")).otherwise(True)
        return (
            F.when(x["digit"], F.lit(NUMBER))
            .when(low.isin(*UNITS) & F.when(i > 0, before["digit"]).otherwise(False), F.lit(UNIT))
            .when(x["letters"].rlike(r"^\p{Lu}") & ~begins, F.lit(NAME))
            .otherwise(low))

    # the parts of a word are found once, not again for each rule
    once = F.transform(F.array(F.transform(words, parts)), lambda known: F.transform(known, lambda x, i: canon(known, x, i)))
    return F.element_at(once, 1)


def _windows(template: Column, hashes: Column, length: int) -> Column:
    """struct(p, length, h) of each window of ``length`` words, p from 1."""
    last = F.size(template) - length + 1
    one = lambda i: F.struct(i.alias("p"), F.lit(length).alias("length"), F.xxhash64(F.slice(hashes, i, length)).alias("h"))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), one)).otherwise(F.array().cast("array<struct<p:int,length:int,h:bigint>>"))


def _slot(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item_words, item_template, q, length, h, n_windows) of the benchmark's usable windows, each item once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("item_words")).where("item_id is not null")
    items = items.withColumn("item_template", template_of(F.col("item_words"))).withColumn("n", F.size("item_template")).where(F.col("n") >= SHORTEST).distinct()
    length = F.least(F.col("n"), F.lit(window))
    spot = F.explode(F.sequence(F.lit(1), F.col("n") - length + 1))
    out = items.withColumn("length", length).withColumn("q", spot)
    part = F.slice("item_template", F.col("q"), F.col("length"))
    literal = F.size(F.filter(part, lambda c: ~c.isin(NUMBER, NAME, UNIT))) >= F.col("length") * LITERAL
    out = out.where(literal).withColumn("h", F.xxhash64(F.transform(part, lambda c: F.xxhash64(c))))
    total = out.groupBy("item_id").agg(F.countDistinct("q").alias("n_windows"))
    return out.join(total, "item_id").select("item_id", "item_words", "item_template", "q", "length", "h", "n_windows")


def literal_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item_tokens, q, length, h, n_windows): all token windows of the items that templates serve in part or not at all."""
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(text).alias("words"), tokens_of(text).alias("item_tokens")).where("item_id is not null")
    items = items.withColumn("template", template_of(F.col("words"))).withColumn("n", F.size("template"))
    length = F.least(F.col("n"), F.lit(window))

    def weak(q: Column) -> Column:
        return F.size(F.filter(F.slice("template", q, length), lambda c: ~c.isin(NUMBER, NAME, UNIT))) < length * LITERAL

    unserved = (F.col("n") < SHORTEST) | F.exists(F.sequence(F.lit(1), F.col("n") - length + 1), weak)
    items = items.where(unserved & (F.size("item_tokens") >= SHORTEST)).select("item_id", "item_tokens").distinct()
    out = items.withColumn("length", F.least(F.size("item_tokens"), F.lit(window)))
    out = out.withColumn("q", F.explode(F.sequence(F.lit(1), F.size("item_tokens") - F.col("length") + 1)))
    out = out.withColumn("h", F.xxhash64(F.transform(F.slice("item_tokens", F.col("q"), F.col("length")), lambda c: F.xxhash64(c))))
    total = out.groupBy("item_id").agg(F.countDistinct("q").alias("n_windows"))
    return out.join(total, "item_id").select("item_id", "item_tokens", "q", "length", "h", "n_windows")


def literal_shares(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """(k1, k2, item_id, share) of the items' windows that stand verbatim in a text (columns k1, k2, text); None if no item needs it."""
    items = settle(literal_windows(benchmark, window))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    if not lengths:
        return None
    hashed = docs.select("k1", "k2", tokens_of(F.col("text")).alias("tokens")).withColumn("hashes", F.transform("tokens", lambda c: F.xxhash64(c)))
    spots = F.concat(*[_windows(F.col("tokens"), F.col("hashes"), n) for n in lengths])
    cells = hashed.select("k1", "k2", F.explode(spots).alias("w")).select("k1", "k2", "w.p", "w.length", "w.h")
    found = settle(cells.join(items.select("item_id", "q", "length", "h"), ["h", "length"]).select("k1", "k2", "item_id", "p", "q", "length").distinct())
    held = found.select("k1", "k2").distinct().hint("merge").join(docs, ["k1", "k2"])
    held = held.groupBy("k1", "k2").agg(F.min("text").alias("text")).select("k1", "k2", tokens_of(F.col("text")).alias("tokens"))
    texts = items.select("item_id", "item_tokens", "n_windows").distinct()
    spots = found.groupBy("k1", "k2", "item_id").agg(F.collect_set(F.struct("p", "q", "length")).alias("spots")).join(held, ["k1", "k2"]).join(texts, "item_id")
    same = lambda r: F.slice("tokens", r["p"], r["length"]) == F.slice("item_tokens", r["q"], r["length"])
    spots = spots.select("k1", "k2", "item_id", "n_windows", F.explode(F.filter("spots", same)["q"]).alias("q"))
    return spots.groupBy("k1", "k2", "item_id").agg((F.countDistinct("q") / F.first("n_windows")).alias("share"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_coverage) of each row of ``docs`` (columns doc_id, text).

    A text is contaminated by an item (columns item_id, text) if at least ``coverage`` of the item's windows stand in
    it, and a window counts where its placeholders map one to one over the whole alignment: one value changed against
    the others spoils the windows that hold it and no more, and values left as they were never spoil one.  Items with windows that are mostly placeholders, and items of
    fewer than ``SHORTEST`` words but as many tokens (an unspaced passage), also count by the share of their token
    windows that stand in the text verbatim.  Null and empty texts hold nothing; a null item_id or an item of fewer
    than ``SHORTEST`` words and tokens matches nothing; rows of one item_id with different texts count as one
    item.  Equal rows come back as often as they came, and an empty table gives an empty result.
    """
    keys = [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = settle(item_windows(benchmark, window))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most window - SHORTEST + 1 values
    none = F.array().cast("array<struct<p:int,length:int,h:bigint>>")

    worded = docs.select(*keys, words_of(F.col("text")).alias("words"))
    marked = worded.select("k1", "k2", template_of(F.col("words")).alias("template"))
    hashed = marked.select("k1", "k2", "template", F.transform("template", lambda c: F.xxhash64(c)).alias("hashes"))
    spots = F.concat(none, *[_windows(F.col("template"), F.col("hashes"), n) for n in lengths])
    cells = hashed.select("k1", "k2", F.explode(spots).alias("w")).select("k1", "k2", "w.p", "w.length", "w.h")
    found = cells.join(items.select("item_id", "q", "length", "h"), ["h", "length"]).select("k1", "k2", "item_id", "p", "q", "length").distinct()
    found = settle(found)

    # the words again, of the texts with a match only, dealt by key at every size
    held = found.select("k1", "k2").distinct().hint("merge").join(docs.select(*keys, "text"), ["k1", "k2"])
    held = held.groupBy("k1", "k2").agg(F.min("text").alias("text")).select("k1", "k2", words_of(F.col("text")).alias("words"))
    held = held.withColumn("template", template_of(F.col("words")))
    texts = items.groupBy("item_id", "item_words", "item_template").agg(F.first("n_windows").alias("n_windows"))
    line = ["k1", "k2", "item_id", "shift"]
    runs = found.withColumn("shift", F.col("p") - F.col("q")).groupBy(*line).agg(F.collect_set(F.struct("q", "length")).alias("runs"))
    runs = runs.join(held, ["k1", "k2"]).join(texts, "item_id")
    # equal hashes are confirmed on the template words themselves
    same = lambda r: F.slice("template", r["q"] + F.col("shift"), r["length"]) == F.slice("item_template", r["q"], r["length"])
    runs = runs.withColumn("runs", F.filter("runs", same)).where(F.size("runs") > 0)
    at = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["q"], r["q"] + r["length"] - 1))))
    runs = settle(runs.select(*line, "n_windows", "runs", F.transform(
        F.filter(at, lambda q: F.element_at("item_template", q).isin(NUMBER, NAME, UNIT)),
        lambda q: F.struct(q.alias("q"), F.element_at("item_template", q).alias("kind"), _slot(F.element_at("item_words", q)).alias("asked"), _slot(F.element_at("words", q + F.col("shift"))).alias("given"))).alias("slots")))
    slots = runs.select(*line, F.explode("slots").alias("s")).select(*line, "s.q", "s.kind", "s.asked", "s.given").distinct()
    changed = slots.where("asked <> given")
    clash = [changed.join(slots.groupBy(*line, "kind", one).agg(F.min(other).alias("a"), F.max(other).alias("z")).where("a <> z"), [*line, "kind", one], "left_semi").select(*line, "q")
             for one, other in (("asked", "given"), ("given", "asked"))]
    clash = clash[0].unionByName(clash[1]).groupBy(*line).agg(F.collect_set("q").alias("clashes"))
    sound = runs.join(clash, line, "left").withColumn("clashes", F.coalesce("clashes", F.array().cast("array<int>")))
    free = lambda r: ~F.exists("clashes", lambda q: q.between(r["q"], r["q"] + r["length"] - 1))
    sound = sound.select("k1", "k2", "item_id", "n_windows", F.filter("runs", free)["q"].alias("qs")).where(F.size("qs") > 0)
    scored = sound.groupBy("k1", "k2", "item_id").agg((F.size(F.array_distinct(F.flatten(F.collect_list("qs")))) / F.first("n_windows")).alias("share"))
    verbatim = literal_shares(docs.select(*keys, "text"), benchmark, window)
    if verbatim is not None:
        scored = scored.unionByName(verbatim).groupBy("k1", "k2", "item_id").agg(F.max("share").alias("share"))
    flagged = scored.groupBy("k1", "k2").agg(
        F.max("share").alias("best_coverage"),
        F.array_sort(F.collect_list(F.when(F.col("share") >= coverage, F.col("item_id")))).alias("item_ids"))
    flagged = settle(flagged)
    out = docs.select("doc_id", *keys).join(flagged, ["k1", "k2"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"), "k1", "k2")

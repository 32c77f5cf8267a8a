"""Layout-table operators over word boxes.

Input is ``words(doc_id, page, x0, y0, x1, y1, text)`` and ``pages(doc_id, page, width, height)``.  A page is
the unit of ordering; everything is partitioned by (doc_id, page) and repeated windows share that one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import params as P
from attestry.functions.normalize import collapse, let, replace
from attestry.functions.patterns import find_all, join_department_spacing
from attestry.scale import cut_lineage

PAGE = ["doc_id", "page"]


def _page(*order: Column | str) -> Window:
    w = Window.partitionBy(*PAGE)
    return w.orderBy(*order) if order else w


def _changes(table: pa.Table, keys: Sequence[str], last: pa.Table | None) -> np.ndarray:
    """Per row whether a key differs from the row before; the first row is compared with ``last``, one row or none."""
    both = table.select(keys) if last is None else pa.concat_tables([last.select(keys), table.select(keys)])
    n, new = both.num_rows, np.zeros(both.num_rows, dtype=bool)
    new[0] = True
    for c in both.columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy()
    return new[n - table.num_rows:]


def _anchored(tol: float):
    """Batches sorted by page -> the same with ``row_y``.  A height is matched once a page; its later words follow it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known, last = [], {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            y = pc.divide(pc.add(t["y0"], t["y1"]).cast(pa.float64()), 2.0).to_numpy()
            opens = _changes(t, PAGE, last)
            starts = np.flatnonzero(opens | np.append(True, y[1:] != y[:-1]))
            placed = np.empty(len(starts))
            for i, (at, opened) in enumerate(zip(y[starts].tolist(), opens[starts].tolist(), strict=True)):
                if opened:
                    rows, known = [], {}
                if at not in known:
                    near = next((a for a in rows if abs(at - a) < tol), None)
                    if near is None:
                        rows.append(near := at)
                    known[at] = near
                placed[i] = known[at]
            row_y = np.repeat(placed, np.diff(np.append(starts, len(y))))
            last = t.slice(len(y) - 1)
            yield from t.append_column("row_y", pa.array(row_y)).to_batches()

    return run


def anchor_rows(words: DataFrame, tol: float) -> DataFrame:
    """Rows of a page by vertical centre: a word belongs to the first row whose opening word is within ``tol``; each
    row is keyed by that word's centre (``row_y``)."""
    schema = T.StructType([*words.schema.fields, T.StructField("row_y", T.DoubleType())])
    return words.repartition(*PAGE).sortWithinPartitions(*PAGE, "y0", "x0").mapInArrow(_anchored(tol), schema)


def _joined(keys: Sequence[str]):
    """Batches sorted by ``keys`` -> one row a key with its texts joined by spaces; nulls are left out."""
    def merge(t: pa.Table) -> pa.Table:
        starts = np.flatnonzero(_changes(t, keys, None))
        text = t["text"].combine_chunks()
        before = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
        ends = before[np.append(starts, t.num_rows)]
        cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text.drop_null())
        return t.select(keys).take(pa.array(starts)).append_column("cell", pc.binary_join(cells, " "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the words of the last cell, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            opens = np.flatnonzero(_changes(t, keys, held[-1].slice(held[-1].num_rows - 1) if held else None))
            if not len(opens):
                held.append(t)
                continue
            done = pa.concat_tables([*held, t.slice(0, opens[-1])])
            if done.num_rows:
                yield from merge(done).to_batches()
            held = [t.slice(opens[-1])]
        if held:
            yield from merge(pa.concat_tables(held)).to_batches()

    return run


def column_edges(words: DataFrame, pages: DataFrame, mode: str = "gaps") -> DataFrame:
    """L1. Column edges per page: (doc_id, page, edges array, last_col_start).

    ``gaps``: centres of the words in the top fifth, the five widest gaps over 30 pt; ``header``: the row with
    the most header terms, the widest 40 % of its gaps.  Pages without either get equal parts.
    """
    centre = (F.col("x0") + F.col("x1")) / 2
    w = words.withColumn("_c", centre)
    if mode == "gaps":
        heads = (
            w.join(pages, PAGE)
            .withColumn("_h", F.col("y0") < F.col("height") * 0.2)
            .withColumn("_any", F.max("_h").over(_page()))
            .withColumn("_rn", F.row_number().over(_page("y0", "x0")))
            .where(F.col("_h") | (~F.col("_any") & (F.col("_rn") <= 60)))
        )
        prev = F.lag("_c").over(_page("_c"))
        gaps = heads.withColumn("_gap", F.col("_c") - prev).withColumn("_mid", (F.col("_c") + prev) / 2).where("_gap > 30")
        best = gaps.withColumn("_k", F.row_number().over(_page(F.desc("_gap"), F.desc("_mid")))).where("_k <= 5")
        mids = best.groupBy(*PAGE).agg(F.sort_array(F.collect_list("_mid")).alias("_m"))
        equal = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("width") * i / 5)
        edges = F.coalesce(F.concat(F.array(F.lit(0.0)), F.col("_m"), F.array(F.col("width").cast("double"))), equal)
        out = pages.join(mids, PAGE, "left").select(*PAGE, edges.alias("edges"))
        return out.withColumn("last_col_start", F.element_at("edges", -2))
    rows = anchor_rows(words.where("y1 < 220"), 5.0).withColumn("_c", centre)
    score = sum((F.when(F.col("_text").contains(t), 1).otherwise(0) for t in P.HEADER_TERMS), F.lit(0))
    row = rows.groupBy(*PAGE, "row_y").agg(
        F.sort_array(F.collect_list(F.struct("x0", "_c"))).alias("_w"), F.concat_ws(" ", F.collect_list("text")).alias("_text"))
    top = row.withColumn("_score", score).withColumn("_rn", F.row_number().over(_page(F.desc("_score"), "row_y"))).where("_rn = 1 AND _score >= 3")
    cs = F.transform("_w", lambda s: s["_c"])
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.struct(
        (F.get(cs, i - 1) - F.get(cs, i)).alias("neg_gap"), i.alias("at"), ((F.get(cs, i) + F.get(cs, i - 1)) / 2).alias("mid")))
    take = F.greatest(F.lit(1), F.floor((F.size("_w") - 1) * 0.4).cast("int"))
    edges = F.when(F.size("_w") > 1, F.array_sort(F.transform(F.slice(F.array_sort(pairs), F.lit(1), take), lambda g: g["mid"])))
    found = top.select(*PAGE, edges.alias("_e"))
    equal = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("width") * i / 5)
    out = pages.join(found, PAGE, "left").select(*PAGE, F.coalesce("_e", equal).alias("edges"))
    return out.withColumn("last_col_start", F.element_at("edges", -1))


def cluster_lines(words: DataFrame, tol: float = 3.5) -> DataFrame:
    """L2. Lines of a page: a vertical step over ``tol`` opens a new line; text runs left to right."""
    order = (F.round("y0", 1), F.col("x0"))
    step = F.abs(F.col("y0") - F.lag("y0").over(_page(*order)))
    marked = words.withColumn("_new", F.when(step > tol, 1).otherwise(0))
    lines = marked.withColumn("line_no", F.sum("_new").over(_page(*order)))
    return lines.groupBy(*PAGE, "line_no").agg(
        F.min("y0").alias("y0"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("y_center"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"))


def filter_lines(lines: DataFrame, bullet: str = P.BULLET) -> DataFrame:
    """L3. Drop header lines (unless they are bullets), rulings, page numbers, repeats at the same height, and
    everything above the first bullet."""
    t = F.trim("text")
    is_bullet = t.startswith(bullet)
    kept = lines.where((t != "") & ~(t.rlike("(?i)" + P.HEADER_PATTERN) & ~is_bullet) & ~t.rlike(P.RULE_LINE_PATTERN) & ~t.rlike(P.PAGE_NUMBER_PATTERN))
    w = Window.partitionBy(*PAGE, collapse(t), F.round("y0", 1)).orderBy("y0")
    uniq = kept.withColumn("text", t).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    first = F.min(F.when(F.col("text").startswith(bullet), F.col("y0"))).over(_page())
    return uniq.withColumn("_cut", first).where(F.col("_cut").isNull() | (F.col("y0") >= F.col("_cut") - 1.5)).drop("_cut")


def first_bullet(words: DataFrame, bullet: str = P.BULLET) -> DataFrame:
    """L4. Height of the first bullet per page."""
    return words.where(F.col("text").contains(bullet)).groupBy(*PAGE).agg(F.min("y0").alias("cut_y"))


def layout_blocks(words: DataFrame, edges: DataFrame, bullet: str = P.BULLET) -> DataFrame:
    """L4. Bullet blocks of the main columns with their vertical range."""
    main = words.join(edges.select(*PAGE, "last_col_start"), PAGE).where(
        (F.col("x1") <= F.col("last_col_start") + P.MAIN_BOUNDARY_OFFSET) & (F.trim("text") != ""))
    no = F.sum(F.when(F.col("text").contains(bullet), 1).otherwise(0)).over(_page("y0", "x0"))
    blocks = main.withColumn("block_no", no).where("block_no > 0")
    line = blocks.groupBy(*PAGE, "block_no", F.round("y0", 1).alias("_y")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", F.trim("text").alias("t")))), lambda s: s["t"]), " ").alias("_t"),
        F.min("y0").alias("_top"), F.max("y1").alias("_bottom"))
    return line.groupBy(*PAGE, "block_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_y", "_t"))), lambda s: s["_t"]), "\n").alias("text"),
        F.min("_top").alias("y_top"), F.max("_bottom").alias("y_bottom"))


def assign_by_interval(blocks: DataFrame, rows: DataFrame, slack: float = 5.0) -> DataFrame:
    """L5, J7. Labels of the rows inside each block's vertical range; a block that gets none takes the labels of
    the row nearest to its top or bottom.

    ``rows(doc_id, page, y_center, labels)``.  The nearest row is found with ordered windows (last row before
    and first row after each end), so no block x row pairs are formed for it.
    """
    key = [*PAGE, "block_no"]
    # Both are read several times below.
    blocks = cut_lineage(blocks.select(*key, "y_top", "y_bottom"))
    r = cut_lineage(rows.groupBy(*PAGE, "y_center").agg(F.flatten(F.collect_list("labels")).alias("labels")))
    inside = (
        blocks.join(r.where(F.size("labels") > 0), PAGE)
        .where((F.col("y_center") >= F.col("y_top") - slack) & (F.col("y_center") <= F.col("y_bottom") + slack))
        .groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
        .where(F.size("labels") > 0)
    )
    rest = blocks.join(inside.select(*key), key, "left_anti")
    probes = rest.select(*key, F.explode(F.array("y_top", "y_bottom")).alias("y"))
    line = probes.withColumn("hit", F.lit(None).cast(f"struct<y:double,labels:{r.schema['labels'].dataType.simpleString()}>")).unionByName(
        r.select(*PAGE, F.lit(None).cast(blocks.schema["block_no"].dataType).alias("block_no"), F.col("y_center").alias("y"),
                 F.struct(F.col("y_center").alias("y"), "labels").alias("hit")))
    before = F.last("hit", True).over(_page("y").rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("hit", True).over(_page("y").rangeBetween(0, Window.unboundedFollowing))
    near = line.withColumn("_b", before).withColumn("_a", after).where(F.col("block_no").isNotNull())
    cand = near.select(*key, "y", F.explode(F.array("_b", "_a")).alias("hit")).where(F.col("hit").isNotNull())
    nearest = cand.groupBy(*key).agg(F.min_by("hit", F.struct(F.abs(F.col("hit.y") - F.col("y")), F.col("hit.y"))).alias("hit"))
    fallback = nearest.select(*key, F.array_sort(F.array_distinct("hit.labels")).alias("labels"), F.lit("nearest").alias("how"))
    return inside.withColumn("how", F.lit("inside")).unionByName(fallback)


def to_grid(words: DataFrame, edges: DataFrame, tol: float = 10.0) -> DataFrame:
    """L6. Cell text per (row, column): the column is the number of edges left of the word's centre."""
    xc = (F.col("x0") + F.col("x1")) / 2
    keys = [*PAGE, "row_y", "col_no"]
    placed = words.join(edges.select(*PAGE, "edges"), PAGE).select(
        *PAGE, "x0", "y0", "y1", "text", F.size(F.filter("edges", lambda e: e < xc)).alias("col_no"))
    # A page is in one partition behind ``anchor_rows``, so that no further shuffle follows; its words are sorted by cell and
    # joined as they stream past, where an aggregation would hold many open cells.
    rows = anchor_rows(placed, tol).sortWithinPartitions(*keys, "x0", "text").select(*keys, "text")
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("cell", T.StringType())])
    return rows.mapInArrow(_joined(keys), schema)


def adjacent_grams(tokens: Column, upto: int = 3) -> Column:
    """All runs of 1..``upto`` neighbouring tokens, concatenated."""
    def grams(t: Column, n: int) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), ""))

    return let(tokens, lambda t: F.array_distinct(F.concat(*[grams(t, n) for n in range(1, upto + 1)])))


def match_ngrams(rows: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """L7. Names (one column ``name``) that equal 1-3 neighbouring tokens of a row, written without spaces.

    No side is hinted: the planner picks the join from the sizes it sees at run time.
    """
    cleaned = F.trim(join_department_spacing(collapse(replace(F.col(text), r"[,\x{00B7}·/]+", " "))))
    tok = find_all(cleaned, r"\S+")
    noisy = F.col(text).rlike(P.NOISE_PATTERN)
    grams = rows.where(~noisy).withColumn("name", F.explode(adjacent_grams(tok)))
    return grams.join(names.select("name"), "name", "left_semi")


def match_substrings(text: Column, names: Sequence[str] = P.DEPARTMENTS) -> Column:
    """L7, substring variant: fixed names that occur anywhere in the text, in list order."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: text.contains(n))


def strip_suffix_terms(c: Column, names: Sequence[str] = P.DEPARTMENTS) -> Column:
    """L8. Up to ten times remove the longest listed name at the end: struct(title, removed in text order)."""
    alt = "|".join(rf"\Q{n}\E" for n in sorted(names, key=len, reverse=True))
    space, longest = F.lit(" \t\n\x0b\f\r"), max(map(len, names))

    def step(acc: Column, _i: Column) -> Column:
        title = acc["title"]
        # A line may end behind the name and white space.
        open_end = F.when(F.substring(title, -1, 1).isin("\x85", "\u2028", "\u2029"), F.left(title, F.length(title) - 1)).otherwise(title)

        def cut(text: Column) -> Column:
            # Only the end is searched: a pattern over the whole text would try every name at every place.
            name = F.regexp_extract(F.right(text, F.lit(longest)), rf"(?is)(?:{alt})\z", 0)
            return let(name, lambda n: F.when(n != "", F.struct(
                F.trim(F.rtrim(F.left(text, F.length(text) - F.length(n)), space)).alias("title"),
                F.concat(F.array(n), acc["removed"]).alias("removed"))).otherwise(acc))

        return let(F.rtrim(open_end, space), cut)

    start = F.struct(join_department_spacing(c).alias("title"), F.array().cast("array<string>").alias("removed"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, step)


def merge_labels(a: Column, b: Column, names: Sequence[str] = P.DEPARTMENTS) -> Column:
    """L12. Both lists, listed names only, ordered distinct."""
    return F.array_distinct(F.filter(F.concat(a, b), lambda x: x.isin(*names)))


def zip_longest(a: Column, b: Column) -> Column:
    """L13. Positional zip; the shorter side is padded with nulls."""
    return F.arrays_zip(a.alias("left"), b.alias("right"))


def record_key(title: Column, body: Column, labels: Column, parity: bool = False) -> Column:
    """Hash of the whole collapsed record; ``parity`` gives its first 500 characters."""
    whole = collapse(F.concat_ws("||", title, body, F.array_join(labels, ",")))
    return F.substring(whole, 1, 500) if parity else F.sha2(whole, 256)


def dedupe_records(records: DataFrame, order: Sequence[str] = ("page", "index"), parity: bool = False) -> DataFrame:
    """L14. First record per document and record key."""
    w = Window.partitionBy("doc_id", "_k").orderBy(*order)
    return (
        records.withColumn("_k", record_key(F.col("title"), F.col("body"), F.col("departments"), parity))
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_k", "_rn"))


def extraction_report(records: DataFrame, names: Sequence[str] = P.DEPARTMENTS, suffixes: Sequence[str] = P.ORG_SUFFIXES) -> DataFrame:
    """L15. One pass of conditional counts."""
    tail = F.trim("title").rlike("(" + "|".join(suffixes) + ")$")
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.size("departments") > 0).alias("with_labels"),
        F.count_if(F.coalesce("deadline", F.lit("")) != "").alias("with_deadline"), F.count_if(tail).alias("suffix_issues"),
        F.count_if(F.exists("departments", lambda d: ~d.isin(*names))).alias("out_of_list"))


def directive_summary(records: DataFrame) -> DataFrame:
    """L16. Distinct categories and labels per document."""
    cat = records.select("doc_id", F.lit("category").alias("kind"), F.col("category").alias("value"))
    dep = records.select("doc_id", F.lit("department").alias("kind"), F.explode("departments").alias("value"))
    return cat.unionByName(dep).distinct().groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n_values"), F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("value_list"))


def merge_lines(lines: DataFrame, order: str = "y0") -> DataFrame:
    """L17. Join each line to the one before unless that ends a sentence."""
    clean = lines.withColumn("text", F.trim("text")).where("text <> ''")
    w = _page(order)
    opens = F.lag("text").over(w).rlike(r"[.?!다]\s*$")
    grouped = clean.withColumn("_new", F.when(opens, 1).otherwise(0)).withColumn("sentence_no", F.sum("_new").over(w))
    return grouped.groupBy(*PAGE, "sentence_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda s: s["text"]), " ").alias("text"))

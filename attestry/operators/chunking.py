"""Chunking and other flat-map operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import params as P
from attestry.functions.normalize import clean_for_index, collapse, replace
from attestry.functions.patterns import find_all
from attestry.functions.tokens import count_tokens
from attestry.params import Params


def fold_blocks(blocks: Column, budget: int = Params.chunk_tokens) -> Column:
    """C1 inside one row: an ordered array of blocks to an array of chunks (text, blocks, tokens).

    A block that would overflow a non-empty buffer closes it; blocks are never split and nothing overlaps.
    The running sum resets at data-dependent points, so it is a fold and not a window; because the blocks are
    already one row's array there is no shuffle.
    """
    chunk = lambda text, n, tok: F.struct(text.alias("text"), n.cast("int").alias("blocks"), tok.cast("bigint").alias("tokens"))
    empty = chunk(F.lit(""), F.lit(0), F.lit(0))
    init = F.struct(F.filter(F.array(empty), lambda x: F.lit(False)).alias("done"), empty.alias("cur"))

    def step(acc: Column, b: Column) -> Column:
        t, cur = count_tokens(b), acc["cur"]
        close = (cur["tokens"] + t > budget) & (cur["blocks"] > 0)
        joined = F.when(cur["blocks"] == 0, b).otherwise(F.concat(cur["text"], F.lit("\n"), b))
        return F.struct(
            F.when(close, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"),
            F.when(close, chunk(b, F.lit(1), t)).otherwise(chunk(joined, cur["blocks"] + 1, cur["tokens"] + t)).alias("cur"),
        )

    finish = lambda acc: F.when(acc["cur"]["blocks"] > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
    return F.aggregate(blocks, init, step, finish)


def chunk_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = Params.chunk_tokens) -> DataFrame:
    """C1 for whole documents, a line being a block: (doc_id, chunk_no, text, blocks, tokens)."""
    chunks = fold_blocks(F.split(F.col(text), "\n"), budget)
    out = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunks).alias("chunk_no", "_c"))
    return out.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "_c.text", "_c.blocks", "_c.tokens")


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], new_state: Callable[[], object], schema: str) -> DataFrame:
    """Run a small state machine over the ordered rows of each key, in bounded memory.

    Rows are partitioned by key and sorted (spilling) by Spark; the Python side streams batches and keeps only
    the state object: ``push(row) -> rows`` and ``flush() -> rows``.  A long group is never collected.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, names = None, None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if state is not None:
                        out += state.flush()
                    state, current = new_state(), key
                out += state.push(row)
            if out:
                names = names or list(out[0])
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            tail = state.flush()
            if tail:
                yield pd.DataFrame(tail, columns=names or list(tail[0]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class _Chunker:
    """Greedy token budget over the rows of one page or group."""

    def __init__(self, key: str, budget: int, overlap: bool):
        self.key, self.budget, self.overlap = key, budget, overlap
        self.buf: list[str] = []
        self.tokens = self.no = 0
        self.first = self.last = None

    def _emit(self, end_char: int) -> list[dict]:
        f = self.first
        row = {"doc_id": f.doc_id, self.key: getattr(f, self.key), "chunk_no": self.no, "text": "\n".join(self.buf),
               "start_char": f.start_char, "end_char": end_char}
        self.no += 1
        return [row]

    def push(self, row) -> list[dict]:
        out: list[dict] = []
        self.first = self.first or row
        t = len(row.text) // 3
        if self.buf and self.tokens + t > self.budget:
            out = self._emit(row.end_char)
            self.buf = [self.buf[-1], row.text] if self.overlap else [row.text]
            self.tokens = len("\n".join(self.buf)) // 3
        else:
            self.buf.append(row.text)
            self.tokens += t
        self.last = row
        return out

    def flush(self) -> list[dict]:
        return self._emit(self.last.end_char) if self.buf else []


def _finish(chunks: DataFrame, kind: str = "content") -> DataFrame:
    text = clean_for_index(F.col("text"))
    return chunks.withColumn("text", text).withColumn("type", F.lit(kind)).withColumn("tokens", count_tokens(F.col("text")))


def chunk_blocks(blocks: DataFrame, budget: int = Params.chunk_tokens) -> DataFrame:
    """C1 for a block table (doc_id, page, ordinal, text, start_char, end_char), per page."""
    schema = f"doc_id {_t(blocks, 'doc_id')}, page int, chunk_no bigint, text string, start_char bigint, end_char bigint"
    rows = blocks.select("doc_id", F.col("page").cast("int").alias("page"), "ordinal", "text", "start_char", "end_char")
    return _finish(ordered_fold(rows, ["doc_id", "page"], ["ordinal"], lambda: _Chunker("page", budget, False), schema))


def chunk_paragraphs(paras: DataFrame, budget: int = Params.chunk_tokens, overlap: int = Params.chunk_overlap) -> DataFrame:
    """C2. Like C1 per structural group (C3), carrying the last paragraph over when ``overlap`` > 0."""
    schema = f"doc_id {_t(paras, 'doc_id')}, group_no bigint, chunk_no bigint, text string, start_char bigint, end_char bigint"
    rows = group_paragraphs(paras).select("doc_id", "group_no", "ordinal", "text", "start_char", "end_char")
    return _finish(ordered_fold(rows, ["doc_id", "group_no"], ["ordinal"], lambda: _Chunker("group_no", budget, overlap > 0), schema))


class _Grouper:
    def __init__(self):
        self.no, self.size = -1, 0

    def push(self, row) -> list[dict]:
        kind = row.structure_type
        joins = kind in ("paragraph", "item", "subitem") and self.size > 0
        plain = kind not in ("article", "paragraph", "item", "subitem")
        if joins or (plain and 0 < self.size <= 5):
            self.size += 1
        else:
            self.no, self.size = self.no + 1, 1
        return [{**row._asdict(), "group_no": self.no}]

    def flush(self) -> list[dict]:
        return []


def group_paragraphs(paras: DataFrame) -> DataFrame:
    """C3. Structural groups (doc_id, ordinal, text, structure_type, ...) -> the same rows with ``group_no``.

    An article opens a group, its parts join it, a plain paragraph joins unless the group is empty or has more
    than five members."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paras.schema) + ", group_no bigint"
    return ordered_fold(paras, ["doc_id"], ["ordinal"], _Grouper, schema)


def _t(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def chunk_directives(records: DataFrame) -> DataFrame:
    """C4. One labelled text per directive record; absent parts are skipped."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    body = F.when(F.col("body") != F.coalesce(F.col("directive"), F.lit("")), F.col("body"))
    text = F.concat_ws(
        "\n", part("제목", F.col("title")), part("분류", F.col("category")), part("내용", F.col("directive")), part("상세", body),
        part("담당부서", F.array_join("departments", ", ")), part("처리기한", F.col("deadline")),
        F.concat(F.lit("출처: "), F.coalesce("source_file", F.lit("")), F.lit(" (페이지 "), F.coalesce("page", F.lit(1)).cast("string"), F.lit(")")),
    )
    return records.select(
        "doc_id", F.coalesce("page", F.lit(1)).alias("page"), F.col("index").alias("directive_index"),
        F.coalesce("category", F.lit("지시")).alias("directive_category"), F.col("title").alias("directive_title"),
        F.col("departments").alias("directive_departments"), F.col("deadline").alias("directive_deadline"),
        clean_for_index(text).alias("text"), F.lit("directive").alias("type"),
    ).withColumn("tokens", count_tokens(F.col("text")))


def table_text(rows: Column, caption: Column) -> Column:
    """C5. Caption line and pipe-joined rows; an empty table has its own marker."""
    body = F.transform(rows, lambda r: F.array_join(r, " | ", ""))
    head = F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("[표: "), caption, F.lit("]")))).otherwise(
        F.array().cast("array<string>"))
    return F.when(rows.isNull() | (F.size(rows) == 0), "[빈 표]").otherwise(F.array_join(F.concat(head, body), "\n"))


def chunk_tables(tables: DataFrame) -> DataFrame:
    """C5. One chunk per table (doc_id, table_id, rows, caption)."""
    text = clean_for_index(table_text(F.col("rows"), F.col("caption")))
    return tables.select("doc_id", "table_id", text.alias("text"), F.lit("table").alias("type")).withColumn("tokens", count_tokens(F.col("text")))


def chunk_footnotes(notes: DataFrame) -> DataFrame:
    """C6. One chunk per footnote."""
    text = F.concat(F.lit("[각주 "), F.coalesce(F.col("number").cast("string"), F.lit("")), F.lit("] "), F.coalesce("text", F.lit("")))
    return notes.select("doc_id", "footnote_id", F.lit(0).alias("page"), clean_for_index(text).alias("text"), F.lit("footnote").alias("type"))


def add_backlinks(chunks: DataFrame) -> DataFrame:
    """C7. In every content chunk the k-th table mark links to the document's k-th table chunk, the k-th
    number mark to its k-th footnote chunk (``ordinal`` gives their order)."""
    ids = lambda kind: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("ordinal", "chunk_id")))), lambda s: s["chunk_id"])
    links = chunks.where(F.col("type").isin("table", "footnote")).groupBy("doc_id").agg(
        ids("table").alias("_tables"), ids("footnote").alias("_notes"))
    # Anchored at the start of the text, so one substitution touches the first remaining mark only.
    first = lambda mark: lambda t, i: F.regexp_replace(t, F.lit(rf"(?s)\A(.*?){mark}"), F.concat(F.lit("$1[→"), replace(i, r"([\\$])", r"\\$1"), F.lit("]")))
    none = F.array().cast("array<string>")
    linked = F.aggregate(F.coalesce("_tables", none), F.col("text"), first(r"\[표\]"))
    linked = F.aggregate(F.coalesce("_notes", none), linked, first(r"\[\d+\]"))
    return chunks.join(links, "doc_id", "left").withColumn(
        "text", F.when(F.col("type") == "content", linked).otherwise(F.col("text"))).drop("_tables", "_notes")


def evidence_units(text: Column) -> Column:
    """C10. Lines; a line over 180 characters is split after sentence ends."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")
    pieces = F.flatten(F.transform(lines, lambda l: F.when(
        F.length(l) > 180, F.filter(F.split(l, r"(?<=[.?!])\s+"), lambda x: F.trim(x) != "")).otherwise(F.array(l))))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.trim(text)))


def split_bullets(text: Column, marker: str = P.BULLET, min_chars: int = 8) -> Column:
    """C11. Blocks that start with the marker at a line start and have at least ``min_chars`` characters."""
    parts = F.transform(F.split(text, rf"(?m)(?=^\s*{marker})"), lambda b: replace(b, r"^\s+|\s+$"))
    return F.filter(parts, lambda b: b.startswith(marker) & (F.length(b) >= min_chars))


def assemble_pages(chunks: DataFrame) -> DataFrame:
    """C12. Page text of each document from its chunks in character order."""
    parts = F.sort_array(F.collect_list(F.struct("start_char", "chunk_id", "text")))
    return chunks.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("page_text"), F.count(F.lit(1)).alias("chunks"))


def page_totals(chunks: DataFrame) -> DataFrame:
    """C12. Per document: chunks, pages, average chunk length."""
    per_page = chunks.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("text")).alias("l"))
    return per_page.groupBy("doc_id").agg(
        F.sum("c").alias("total_chunks"), F.count(F.lit(1)).alias("total_pages"),
        F.round(F.sum("l") / F.sum("c"), 6).alias("avg_chunk_chars"))


def dedupe_chunks(chunks: DataFrame, parity: bool = False, order: str = "start_char", prefix: int = 200) -> DataFrame:
    """C13. First chunk per document and trimmed text; ``parity`` compares the first ``prefix`` characters only, cut
    before they are trimmed.  ``row_number = 1`` is pushed below the shuffle, so copies are dropped where they are read."""
    w = Window.partitionBy("doc_id", "_p").orderBy(order)
    return (
        chunks.withColumn("_p", F.trim(F.substring("text", 1, prefix)) if parity else F.sha2(F.trim("text"), 256))
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_p", "_rn")
    )

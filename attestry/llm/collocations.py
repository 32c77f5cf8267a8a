"""Operator 11: collocations of words by Rabin-Karp fingerprints.

Every n-gram of every text gets a fingerprint from prefix polynomials over the codes of its words.  Tasks count the
fingerprints of a batch of texts, with the row where each stands; the shuffle brings equal fingerprints together, as
packed blocks of sorted ones rather than a row each.  Only fingerprints that reach the least frequency go on: their
phrases are read from the rows they point to.  A fingerprint that stands for several phrases shows by eight bits
of a second polynomial, or by the text of its first and last row; the phrases of such fingerprints are counted in the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.bytehash import mix64
from attestry.llm.store import discard, partitions, release, settle, small_batches

#: Words of a phrase, at most.
WORDS = 3
#: Occurrences of a phrase, at least.
LEAST = 10
#: Phrases reported of each language.
TOP = 2000
#: A phrase goes if a longer one around it has this percentage of its occurrences.
COVERED = 50
NO_LANGUAGE = "und"
#: Bits of a fingerprint; tests take few, so that phrases do share one.
BITS = 64
#: Fingerprints of a block of all batches together, on average and at most: what one group of the merge holds.
BLOCK = 2_000_000
#: Different fingerprints a task holds before it packs them, at 22 bytes each.
HELD = 3_000_000
#: Ranges of blocks in which they are packed, one after the other.
STEPS = 16
#: Bytes of text whose n-grams are held at a time; a longer text is cut where a piece ends.
PORTION = 1 << 20
#: Parts of a language that are ranked by themselves first.
PARTS = 64

#: Bytes that end a piece: full stop, comma, semicolon, colon, exclamation and question mark, line feed to carriage return.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_END = b"\xff"  # no byte of UTF-8
_CUT = bytes.maketrans(ENDS, _END * len(ENDS))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SEEDS = (0x243F6A88, 0x85A308D3)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[tuple[list[bytes], list[int]]]:
    """(lower-cased bytes with a lone ``_END`` between pieces, the text of each) of all texts, about ``most`` bytes at a time."""
    out, owner, held = [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_CUT)
        at = 0
        while at < len(data) or not len(data):
            end = len(data)
            if end - at > most:
                end = data.rfind(_END, at, at + most) + 1 or (data.find(_END, at + most) + 1 or len(data))
            out.append(data[at:end].replace(_END, b" \xff "))
            owner.append(i)
            held += end - at
            at = end
            if held >= most:
                yield out, owner
                out, owner, held = [], [], 0
            if not len(data):
                break
    if out:
        yield out, owner


class Grams:
    """The n-grams of a portion of texts: place, size, fingerprint and check value, all sizes in one array."""

    def __init__(self, portion: list[bytes], owner: list[int], langs: list[str], most: int, bits: int):
        self.words: list[bytes] = []
        sizes = np.zeros(len(portion), dtype=np.int64)
        for i, data in enumerate(portion):
            cut = data.split()
            cut.append(_END)
            self.words += cut
            sizes[i] = len(cut)
        self.text = np.repeat(np.array(owner, dtype=np.int64), sizes)
        known: dict[bytes, int] = {_END: 0}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), dtype=np.int64, count=len(self.words))
        solid = ids > 0
        self.n_words = np.bincount(self.text[solid], minlength=len(langs))
        seeds = _seeds(langs)
        sums = []
        for base, seed in zip(_BASES, _SEEDS, strict=True):
            code = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in known), dtype=np.uint64, count=len(known))
            sums.append((base, np.concatenate([[np.uint64(0)], np.cumsum(code[ids] * _powers(base, len(ids)))])))
        at, size, prints = [], [], ([], [])
        run = solid
        for n in range(1, most + 1):
            if n > 1:
                run = run[:-1] & solid[n - 1 :]
            here = np.flatnonzero(run)
            at.append(here)
            size.append(np.full(len(here), n, dtype=np.int8))
            for out, (base, c) in zip(prints, sums, strict=True):
                inverse = _powers(pow(base, -1, 1 << 64), len(ids))
                out.append(mix64((c[here + n] - c[here]) * inverse[here] + seeds[self.text[here]] + np.uint64(n)))
        self.at, self.size = np.concatenate(at), np.concatenate(size)
        self.print = np.concatenate(prints[0]) >> np.uint64(64 - bits) << np.uint64(64 - bits)
        self.check = (np.concatenate(prints[1]) >> np.uint64(56)).astype(np.uint8)

    def phrase(self, j: int) -> bytes:
        return b" ".join(self.words[self.at[j] : self.at[j] + int(self.size[j])])


def _seeds(langs: list[str]) -> np.ndarray:
    """A summand for each text's fingerprints, so that a phrase has one of its own in each language."""
    of = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in set(langs)}
    return np.array([of[lang] for lang in langs], dtype=np.uint64)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance: those that sorted numbers share lie together and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _groups(key: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)


def _count_batches(blocks: int, most: int, bits: int):
    """(row, lang, text) -> packed blocks (block, lang, start, prints, checks, counts, rows).

    Blocks from 0 hold fingerprints: sorted, each once, or twice with both check values where these differ.  Negative
    blocks, as many, hold words by language: ``start`` counts them.
    """
    shift = np.uint64(64 - (blocks.bit_length() - 1))

    def entries(rows: np.ndarray, grams: Grams) -> tuple[np.ndarray, ...]:
        """Sorted fingerprints of a portion with the least and greatest check value, count and first row."""
        order = np.argsort(grams.print)
        key, check, row = grams.print[order], grams.check[order], rows[grams.text[grams.at[order]]]
        at = _groups(key)
        return (key[at], np.minimum.reduceat(check, at), np.maximum.reduceat(check, at), np.diff(np.append(at, len(key))).astype(np.int32),
                np.minimum.reduceat(row, at))

    def packed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The parts merged, a range of blocks at a time."""
        step = max(1, blocks // STEPS)
        for lowest in range(0, blocks, step):
            ends = [np.uint64(lowest << int(shift)), np.uint64(min((lowest + step << int(shift)) - 1, (1 << 64) - 1))] if blocks > 1 else [np.uint64(0), ~np.uint64(0)]
            cuts = [slice(np.searchsorted(p[0], ends[0]), np.searchsorted(p[0], ends[1], "right")) for p in parts]
            if any(c.stop > c.start for c in cuts):
                yield merged([np.concatenate([p[j][c] for p, c in zip(parts, cuts, strict=True)]) for j in range(5)])

    def merged(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, least, check, count, low = columns
        order = np.argsort(key)
        at = _groups(key[order])
        key, count, low = key[order[at]], np.add.reduceat(count[order], at), np.minimum.reduceat(low[order], at)
        least, check = np.minimum.reduceat(least[order], at), np.maximum.reduceat(check[order], at)
        clash = least != check
        if clash.any():
            twice = np.sort(np.concatenate([np.arange(len(key)), np.flatnonzero(clash)]))
            second = np.append(False, twice[1:] == twice[:-1])
            key, low, count = key[twice], low[twice], np.where(second, 0, count[twice])
            check = np.where(second, least[twice], check[twice])
        part = (key >> shift).astype(np.int64) if blocks > 1 else np.zeros(len(key), dtype=np.int64)
        edges = np.append(_groups(part), len(key)).tolist()
        base = int(low.min())
        wide_count, wide_row = np.min_scalar_type(int(count.max())).type, np.min_scalar_type(int(low.max()) - base).type
        columns = [key, check, count.astype(wide_count), (low - base).astype(wide_row)]
        n = len(edges) - 1
        return pa.RecordBatch.from_arrays([
            pa.array(part[edges[:-1]]), pa.nulls(n, pa.string()), pa.array([base] * n, pa.int64()),
            *[pa.array([_planes(c[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for c in columns]], _BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        held = first = 0
        for batch in batches:
            rows, langs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            first = int(rows[0]) if batch.num_rows else first
            for portion, owner in portions(batch.column(2).to_pylist()):
                grams = Grams(portion, owner, langs, most, bits)
                for i in np.flatnonzero(grams.n_words).tolist():
                    total[langs[i]] = total.get(langs[i], 0) + int(grams.n_words[i])
                if not len(grams.at):
                    continue
                parts.append(entries(rows, grams))
                del grams
                held += len(parts[-1][0])
                if held > HELD:
                    yield from packed(parts)
                    parts, held = [], 0
        if parts:
            yield from packed(parts)
        # any block will do: the sums of a language meet in a grouping of their own
        block, none = -1 - first % blocks, pa.nulls(len(total), pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array([block] * len(total), pa.int64()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), none, none, none, none], _BLOCK_NAMES)

    return run


_BLOCK_NAMES = ["block", "lang", "start", "prints", "checks", "counts", "rows"]
_BLOCKS = "block long, lang string, start long, prints binary, checks binary, counts binary, rows binary"
_FREQUENT = "lang string, print long, f long, low long, high long, clash boolean"


def _unsigned(data: bytes, n: int) -> np.ndarray:
    """Numbers packed with as few bytes as the batch's largest needs."""
    return _unplanes(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64)


def _merge_block(least: int):
    """All batches' entries of a block -> its fingerprints with a sum of ``least`` or more, or its words by language."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("block")[0].as_py() < 0:
            sums = table.group_by("lang").aggregate([("start", "sum")])
            n = sums.num_rows
            columns = [sums["lang"].combine_chunks(), pa.nulls(n, pa.int64()), sums["start_sum"].combine_chunks(), *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.bool_())]
            return pa.table(columns, _FREQUENT_NAMES)
        keys, checks, counts, rows = [], [], [], []
        start = table.column("start").to_pylist()
        for i, (prints, check, count, row) in enumerate(zip(*[table.column(c) for c in ("prints", "checks", "counts", "rows")], strict=True)):
            keys.append(_unplanes(prints.as_py(), np.uint64))
            n = len(keys[-1])
            checks.append(_unplanes(check.as_py(), np.uint8))
            counts.append(_unsigned(count.as_py(), n))
            rows.append(_unsigned(row.as_py(), n) + start[i])
        key = np.concatenate(keys)
        order = np.argsort(key)
        key, check, row = key[order], np.concatenate(checks)[order], np.concatenate(rows)[order]
        at = _groups(key)
        total = np.add.reduceat(np.concatenate(counts)[order], at)
        good = total >= least
        clash = np.minimum.reduceat(check, at) != np.maximum.reduceat(check, at)
        low, high = np.minimum.reduceat(row, at), np.maximum.reduceat(row, at)
        columns = [key[at][good].view(np.int64), total[good], low[good], high[good], clash[good]]
        return pa.table([pa.nulls(int(good.sum()), pa.string()), *map(pa.array, columns)], _FREQUENT_NAMES)

    return run


_FREQUENT_NAMES = ["lang", "print", "f", "low", "high", "clash"]


def _read_phrases(most: int, bits: int):
    """(lang, text, prints) -> (lang, n, print, phrase): what stands in this text for each print that points here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            asked = [np.array(a, dtype=np.int64).view(np.uint64) for a in asked]
            found: dict[tuple, None] = {}  # every phrase there is, should a print have several
            for portion, owner in portions(batch.column(1).to_pylist()):
                grams = Grams(portion, owner, langs, most, bits)
                text = grams.text[grams.at]
                order = np.argsort(text, kind="stable")
                bounds = np.searchsorted(text, np.arange(len(langs) + 1), sorter=order)
                for i in set(owner):
                    mine = order[bounds[i] : bounds[i + 1]]
                    for j in mine[np.isin(grams.print[mine], asked[i])].tolist():
                        found[(langs[i], int(grams.size[j]), int(grams.print[j]), grams.phrase(j))] = None
            yield _rows_of(found, _PHRASE_NAMES)

    return run


_PHRASES = "lang string, n int, print long, phrase string"
_PHRASE_NAMES = ["lang", "n", "print", "phrase"]


def _rows_of(found: dict[tuple, int | None], names: list[str]) -> pa.RecordBatch:
    keys = list(found)
    columns = [
        pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(np.array([k[2] for k in keys], dtype=np.uint64).view(np.int64)),
        pa.array([k[3].decode("utf-8", "surrogatepass") for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns[: len(names)], names)


def _count_phrases(most: int, bits: int, marks: bytes):
    """(lang, text) -> (lang, n, print, phrase, f) of each n-gram whose print may be among the marked ones."""
    mask = np.unpackbits(np.frombuffer(marks, dtype=np.uint8)).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for portion, owner in portions(batch.column(1).to_pylist()):
                grams = Grams(portion, owner, langs, most, bits)
                total: dict[tuple, int] = {}
                for j in np.flatnonzero(mask[(grams.print >> np.uint64(48)).astype(np.int64)]).tolist():
                    key = (langs[grams.text[grams.at[j]]], int(grams.size[j]), int(grams.print[j]), grams.phrase(j))
                    total[key] = total.get(key, 0) + 1
                yield _rows_of(total, [*_PHRASE_NAMES, "f"])

    return run


def frequent_phrases(docs: DataFrame, most: int = WORDS, least: int = LEAST, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, n, phrase, f) of every phrase of 1 to ``most`` words with f >= ``least``; (lang, n_words).

    ``docs`` needs text and lang.  Exact: phrases that share a fingerprint are told apart by their text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = settle(docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text").cast("long")))
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    # A word takes two bytes at least, prints are uniform and a batch brings each once: no block exceeds ``block`` on average.
    blocks = max(4 * partitions(spark), size * most // 2 // block)
    blocks = min(1 << (blocks - 1).bit_length(), 1 << bits)
    counted = rows.select("row", "lang", "text").mapInArrow(_count_batches(blocks, most, bits), _BLOCKS)
    merged = settle(counted.groupBy("block").applyInArrow(_merge_block(least), _FREQUENT))
    del counted
    release(spark)  # the blocks' shuffle files have served
    totals = merged.where("print is null").groupBy("lang").agg(F.sum("f").alias("n_words"))
    frequent = merged.where("print is not null").drop("lang")

    points = frequent.select("print", F.explode(F.array_distinct(F.array("low", "high"))).alias("row"))
    asked = points.groupBy("row").agg(F.collect_list("print").alias("prints"))  # no more than the text has n-grams
    read = rows.select("row", "lang", "text").join(asked, "row").select("lang", "text", "prints").mapInArrow(_read_phrases(most, bits), _PHRASES)
    read = settle(read.distinct())
    seen = read.groupBy("print").agg(F.count(F.lit(1)).alias("phrases"), F.first("lang").alias("lang"), F.first("n").alias("n"), F.first("phrase").alias("phrase"))
    judged = settle(frequent.join(seen, "print").withColumn("clash", F.col("clash") | (F.col("phrases") > 1)))
    phrases = judged.where(~F.col("clash")).select("lang", "n", "phrase", "f")
    clashing = judged.where("clash").select("print")
    if not clashing.isEmpty():
        marks = np.zeros(1 << 16, dtype=bool)  # of fixed size: the first 16 bits of the clashing prints
        marks[[r[0] for r in clashing.select(F.shiftrightunsigned("print", 48).cast("int")).distinct().collect()]] = True
        again = rows.select("lang", "text").mapInArrow(_count_phrases(most, bits, np.packbits(marks).tobytes()), f"{_PHRASES}, f long")
        again = again.join(clashing, "print", "left_semi").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        phrases = phrases.unionByName(again)
    phrases, totals = settle(phrases), settle(totals)
    discard(rows, merged, read, judged)
    return phrases, totals


def _part_of(phrase: str, a: str, b: str):
    return F.array_join(F.slice(F.split(phrase, " "), F.expr(a), F.expr(b)), " ")


def collocations(docs: DataFrame, most: int = WORDS, least: int = LEAST, top: int = TOP, covered: int = COVERED, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most`` words of each language.

    ``docs`` needs text and lang; other columns are not read.  Words are lower-cased (A-Z), stand between spaces and tabs,
    and phrases do not cross ``ENDS``.  a, l and r count the phrase and the two sides of its worst cut, n all words of the
    language, score is floor(1000000 * a * a / (l * r)), lowest over the cuts (ties: the first cut).  Phrases inside a longer
    frequent one that has ``covered`` percent of their occurrences are left out.  Order: score, a, then the phrase's bytes.

    A null text counts as empty, a null lang as ``und``; repeated rows count as often as they come; an empty table or one
    without frequent phrases gives an empty result.  Counts up to 10**15 are multiplied exactly (38 decimal digits).
    """
    phrases, totals = frequent_phrases(docs, most, least, bits)
    wide = phrases.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"))
    cuts = wide.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part_of("phrase", "1", "k"), "right": _part_of("phrase", "k + 1", "n - k")})
    sides = phrases.select("lang", F.col("phrase").alias("side"), "f")
    cuts = cuts.join(sides.select("lang", F.col("side").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        sides.select("lang", F.col("side").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: f"cast({c} as decimal(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"({exact('a')} * {exact('a')} * 1000000) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))

    inner = wide.where("n > 2").select("lang", "n", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
    inner = inner.select("lang", "n", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", _part_of("phrase", "at", "m").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    flat = left.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", (F.abs(F.xxhash64("phrase")) % PARTS).alias("part"))
    first = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")

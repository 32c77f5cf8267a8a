"""Operator 5: removal of byte strings that repeat anywhere in the corpus, by suffix sorting.

1. A window of ``length`` bytes is represented by the smallest hashed ``anchor``-byte string in it, so equal windows
   have equal anchors wherever they stand.  Anchors that occur once cannot lie in a repeated window.
2. Around each repeated anchor the bytes that its windows can take are its context.  Equal contexts are counted and
   collapsed; the distinct contexts of one anchor are written with the anchor as a single symbol, suffix-sorted
   (``gsaca``), and windows that agree with a neighbour in the order repeat.
3. Repeated windows go back to their texts, where their union is cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.llm.bytehash import mix64, pieces, prefix_hash, span_hash
from attestry.llm.gsaca import suffix_array
from attestry.llm.store import discard, partitions, settle, small_batches

LENGTH = 200
ANCHOR = 100
#: Distinct contexts of one anchor that one task sorts together; a larger group is counted window by window.
GROUP = 30_000
#: Offsets of windows that are sorted together.
SLOT = 8
#: Symbols after which the collected contexts are sorted.
SYMBOLS = 150_000

_TOP = np.uint64(2**64 - 1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _slide(x: np.ndarray, width: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """Minimum or maximum of each ``width`` values, by blocks: two running passes and one comparison."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    after = pick.accumulate(grid, axis=1).ravel()
    before = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(before[: n - width + 1], after[width - 1 : n])


def window_anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor positions, smallest hash of each window) for the hashes of a text's anchor-size strings."""
    low = _slide(h, width, np.minimum, _TOP)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum, np.uint64(0)) == h), low


def _digest(data: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> (doc_id, key, digest, n_bytes, sha256)."""
    for batch in batches:
        size, digest, sha = [], [], []
        for _, data, offsets in pieces(batch.column(2)):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                raw = data[a:b]
                size.append(b - a)
                digest.append(_digest(raw))
                sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "key", "digest", "n_bytes", "sha"])


def _anchors(length: int, anchor: int):
    """(key, text) -> (hash, key, pos) of each anchor; equal texts met by one task are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in pieces(batch.column(1)):
                sums = prefix_hash(data)
                found, owner, place = [], [], []
                for i in range(len(offsets) - 1):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    name = (int(keys[row + i]), _digest(data[a:b]))
                    if b - a < length or name in seen:
                        continue
                    seen.add(name)
                    start = np.arange(a, b - anchor + 1)
                    h = span_hash(sums, start, start + anchor)
                    pos, _ = window_anchors(h, length - anchor + 1)
                    found.append(h[pos])
                    place.append(pos)
                    owner.append(np.full(len(pos), name[0]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(place))], ["h", "key", "pos"])

    return run


def _contexts(length: int, anchor: int):
    """(key, text, positions) -> one row for each repeated anchor: the offsets a of its windows (they start a bytes
    before it, first <= a <= last) and the bytes that those windows can take to its left and right."""
    width = length - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        seen: set[tuple[int, int]] = set()
        out: dict[str, list] = {k: [] for k in ("h", "ctx", "key", "digest", "pos", "first", "last")}
        left: list[bytes] = []
        right: list[bytes] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(v)) for v in out.values()] + [pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            batch = pa.RecordBatch.from_arrays(cols, [*out, "left", "right"])
            for v in (*out.values(), left, right):
                v.clear()
            return batch

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            spots = batch.column(2)
            for row, data, offsets in pieces(batch.column(1)):
                sums = prefix_hash(data)
                for i in range(len(offsets) - 1):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    name = (int(keys[row + i]), _digest(data[a:b]))
                    if b - a < length or name in seen:
                        continue
                    seen.add(name)
                    pos = np.unique(np.asarray(spots[row + i].values, dtype=np.int64))
                    pos = pos[pos <= b - a - anchor]
                    start = np.arange(a, b - anchor + 1)
                    h = span_hash(sums, start, start + anchor)
                    low = _slide(h, width, np.minimum, _TOP)
                    # windows of one anchor stand in one run of equal smallest hashes
                    runs = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
                    ends = np.concatenate([runs[1:], [len(low)]]) - 1
                    at = np.searchsorted(runs, np.maximum(pos - width + 1, 0), "right") - 1
                    wanted = h[pos]
                    for _ in range(width):
                        inside = np.minimum(at, len(runs) - 1)
                        wrong = (low[runs[inside]] != wanted) & (at < len(runs))
                        if not wrong.any():
                            break
                        at[wrong] += 1
                    good = at < len(runs)
                    at, pos, wanted = at[good], pos[good], wanted[good]
                    w0 = np.maximum(runs[at], np.maximum(pos - width + 1, 0))
                    w1 = np.minimum(ends[at], pos)
                    good = w0 <= w1
                    pos, wanted, w0, w1 = pos[good], wanted[good], w0[good], w1[good]
                    last, first = pos - w0, pos - w1
                    ctx = mix64(span_hash(sums, a + w0, a + w1 + length) + last.astype(np.uint64))
                    values = (wanted.view(np.int64), ctx.view(np.int64), np.full(len(pos), name[0]), np.full(len(pos), name[1]), pos.astype(np.int32), first.astype(np.int32), last.astype(np.int32))
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                    raw = data[a:b].tobytes()
                    left += [raw[x:y] for x, y in zip(w0.tolist(), pos.tolist(), strict=True)]
                    right += [raw[x + anchor : y + length] for x, y in zip(pos.tolist(), w1.tolist(), strict=True)]
                    if len(left) > 20_000:
                        yield flush()
        if left:
            yield flush()

    return run


def _common(rows: list[bytes], width: int) -> np.ndarray:
    """For each string the longest prefix (of at most ``width`` bytes) that another one shares."""
    order = sorted(range(len(rows)), key=rows.__getitem__)
    size = np.array([len(rows[i]) for i in order])
    near = np.frombuffer(b"".join([rows[i].ljust(width, b"\0") for i in order]), dtype=np.uint8).reshape(len(rows), width)
    differ = near[1:] != near[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(size[1:], size[:-1]))
    best = np.zeros(len(rows), dtype=np.int64)
    best[order[1:]] = lcp
    best[order[:-1]] = np.maximum(best[order[:-1]], lcp)
    return best


class _Sorter:
    """Sorts the contexts of whole anchor groups.

    The windows of a context are taken in slots of ``SLOT`` neighbouring offsets.  All windows of a slot share a core:
    the anchor and the bytes next to it.  The core becomes one symbol, followed and preceded by the few bytes that the
    slot's windows add; bytes further out than any other context agrees with are left out.  Equal strings repeat,
    and the different ones are suffix-sorted.
    """

    def __init__(self, length: int, anchor: int) -> None:
        self.span = length - anchor
        self.rows: list[tuple] = []
        self._clear()

    def _clear(self) -> None:
        self.text: list[int] = []
        self.symbol = 257
        self.asked: list[tuple] = []  # (h, ctx, begin, first start before the core, lowest a, highest a, symbols of a window)

    def add(self, h: int, entries: list[tuple[int, int, int, int, bytes, bytes]]) -> None:
        """entries: (ctx, copies, first, last, left, right); the contexts of one anchor, all different."""
        self.rows += [(h, e[0], e[2], e[3], None) for e in entries if e[1] > 1]
        if len(entries) < 2 or all(e[1] > 1 for e in entries):
            return
        span = self.span
        low = np.maximum([e[2] for e in entries], span - _common([e[5] for e in entries], span)).tolist()
        high = np.minimum([e[3] for e in entries], _common([e[4][::-1] for e in entries], span)).tolist()
        units: dict[tuple, dict[tuple[bytes, bytes], list[int]]] = {}
        for i, e in enumerate(entries):
            left, right, reach = e[4], e[5], len(e[4])
            for slot in range(low[i] // SLOT, high[i] // SLOT + 1) if low[i] <= high[i] else ():
                lo, hi = slot * SLOT, min(slot * SLOT + SLOT - 1, span)
                core = (slot, left[reach - lo :], right[: span - hi])
                ends = (left[reach - min(high[i], hi) : reach - lo], right[span - hi : span - max(low[i], lo)])
                units.setdefault(core, {}).setdefault(ends, []).append(i)
        for (slot, _, _), strings in units.items():
            lo, hi = slot * SLOT, min(slot * SLOT + SLOT - 1, span)
            for ends, who in strings.items():
                if len(who) > 1:
                    self.rows += [(h, entries[i][0], max(low[i], lo), min(high[i], hi), None) for i in who if entries[i][1] == 1]
            if len(strings) < 2:
                continue
            for (outer, tail), who in strings.items():
                i = who[0]
                if len(who) == 1 and entries[i][1] == 1:
                    self.asked.append((h, entries[i][0], len(self.text), lo + len(outer), max(low[i], lo), min(high[i], hi), hi - lo + 1))
                self.text += [x + 1 for x in outer]
                self.text.append(self.symbol)
                self.text += [x + 1 for x in tail]
                self.text.append(0)
            self.symbol += 1
            if len(self.text) >= SYMBOLS:
                self._sort()

    def _sort(self) -> None:
        """Look up the windows asked for among their neighbours in the order of all suffixes."""
        if self.asked:
            order = np.array(suffix_array(self.text), dtype=np.int64)
            text = np.array(self.text, dtype=np.int32)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            begin, reach, low, high, width = np.array([q[2:] for q in self.asked], dtype=np.int64).T
            count = high - low + 1
            owner = np.repeat(np.arange(len(count)), count)
            a = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - low, count)
            spots, width = begin[owner] + reach[owner] - a, width[owner]
            again = np.zeros(len(spots), dtype=bool)
            for step in (-1, 1):
                near = rank[spots] + step
                other = order[np.clip(near, 0, len(order) - 1)]
                idx = np.flatnonzero((near >= 0) & (near < len(order)) & ~again & (other + width <= len(text)))
                for x in range(0, len(idx), 50_000):
                    part = idx[x : x + 50_000]
                    j = np.arange(int(width[part].max()))
                    mine = text[np.minimum(spots[part][:, None] + j, len(text) - 1)]
                    theirs = text[np.minimum(other[part][:, None] + j, len(text) - 1)]
                    again[part] = ((mine == theirs) | (j >= width[part][:, None])).all(axis=1)
            hit = np.flatnonzero(again)
            if len(hit):
                fresh = np.concatenate([[True], (owner[hit][1:] != owner[hit][:-1]) | (a[hit][1:] != a[hit][:-1] + 1)])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(hit)) - 1
                for k, x, y in zip(owner[hit][first].tolist(), a[hit][first].tolist(), a[hit][last].tolist(), strict=True):
                    self.rows.append((*self.asked[k][:2], x, y, None))
        self._clear()

    def take(self) -> list[tuple]:
        """(h, ctx, lowest a, highest a, None) of the repeated windows of all contexts added so far."""
        self._sort()
        out: list[list] = []
        for row in sorted(self.rows, key=lambda r: r[:3]):
            if out and out[-1][:2] == list(row[:2]) and row[2] <= out[-1][3] + 1:
                out[-1][3] = max(out[-1][3], row[3])
            else:
                out.append(list(row))
        self.rows = []
        return [tuple(r) for r in out]


def _sort_groups(length: int, anchor: int, most: int):
    """Rows (h, ctx, copies, first, last, left, right) sorted by h -> repeated windows (h, ctx, low, high), or, of a
    group of more than ``most`` contexts, every window with its hash, to be counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        sorter = _Sorter(length, anchor)
        schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("window", pa.binary())])

        def windows(entry: tuple) -> Iterator[tuple]:
            ctx, copies, first, last, left, right = entry
            if copies > 1:
                yield key, ctx, first, last, None
            for a in range(first, last + 1):
                text = left[len(left) - a :] + b"|" + right[: length - anchor - a]
                yield key, ctx, a, a, hashlib.blake2b(text + a.to_bytes(4, "little") + key.to_bytes(8, "little", signed=True), digest_size=16).digest()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        key, held, rows = None, [], []
        for batch in batches:
            d = batch.to_pydict()
            for h, *entry in zip(*(d[c] for c in ("h", "ctx", "copies", "first", "last", "left", "right")), strict=True):
                if h != key:
                    if held and len(held) <= most:
                        sorter.add(key, held)
                    key, held = h, []
                    if len(sorter.text) >= SYMBOLS // 2 or len(sorter.rows) > 20_000:
                        rows += sorter.take()
                if len(held) <= most:
                    held.append(tuple(entry))
                    if len(held) > most:
                        rows += [w for e in held for w in windows(e)]
                else:
                    rows += list(windows(tuple(entry)))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        if held and len(held) <= most:
            sorter.add(key, held)
        rows += sorter.take()
        if rows:
            yield batch_of(rows)

    return run


def spans_of(size: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover, clipped to ``size``."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[i]), min(int(ends[i]), size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, ranges of struct(digest, start, stop)) -> what is cut from each text."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        out: list[tuple] = []
        for row, data, offsets in pieces(batch.column(1)):
            for i in range(len(offsets) - 1):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                digest = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                ranges = batch.column(2)[row + i].values
                own = np.asarray(ranges.field(0)) == digest
                spans = spans_of(len(raw), np.asarray(ranges.field(1))[own], np.asarray(ranges.field(2))[own])
                if spans:
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    kept.append(raw[at:])
                    out.append((keys[row + i], digest, sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(b"".join(kept)).hexdigest()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.string()), strict=True)], ["key", "digest", "n_removed", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(doc_id, key, digest, n_bytes, n_removed, n_spans, spans, kept_sha256), one row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are not read.  A byte is removed where a string of ``length``
    bytes that covers it also starts elsewhere, in the same text or another.  Null texts count as empty; texts
    under ``length`` bytes lose nothing; equal rows come back as often as they came and, being copies, are removed
    whole; a null doc_id is carried along.  An empty table gives an empty result.  ``key`` and ``digest`` name a text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    long_texts = docs.where(F.octet_length("text") >= length).select("key", "text")

    marks = settle(long_texts.mapInArrow(_anchors(length, anchor), "h long, key long, pos long"))
    # settled, so that the join below deals both sides anew and a very common anchor's partition can be split
    twice = settle(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    spots = settle(marks.join(twice, "h").groupBy("key").agg(F.collect_list(F.col("pos").cast("int")).alias("spots")))
    discard(marks, twice)
    texts = settle(long_texts.join(spots, "key").select("key", "text", "spots"))
    schema = "h long, ctx long, key long, digest long, pos int, first int, last int, left binary, right binary"
    contexts = settle(texts.mapInArrow(_contexts(length, anchor), schema))

    few = contexts.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.first("first").alias("first"), F.first("last").alias("last"), F.first("left").alias("left"), F.first("right").alias("right"))
    dealt = few.repartition(n, "h").sortWithinPartitions("h", "ctx").select("h", "ctx", "copies", "first", "last", "left", "right")
    found = settle(dealt.mapInArrow(_sort_groups(length, anchor, group), "h long, ctx long, low int, high int, window binary"))
    counted = found.where("window is not null")
    again = counted.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    windows = found.where("window is null").drop("window").unionByName(counted.join(again, "window", "left_semi").drop("window"))
    start, stop = (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("stop")
    ranges = contexts.select("h", "ctx", "key", "digest", "pos").join(windows, ["h", "ctx"]).select("key", F.struct("digest", start, stop).alias("range"))
    ranges = ranges.groupBy("key").agg(F.collect_list("range").alias("ranges"))
    cut = texts.join(ranges, "key").select("key", "text", "ranges")
    cut = settle(cut.mapInArrow(_cut, "key long, digest long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string").dropDuplicates(["key", "digest"]))
    discard(contexts, found, texts)

    about = settle(docs.select("doc_id", "key", "text").mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, digest long, n_bytes long, sha string"))
    copied = about.where(F.col("n_bytes") >= length).groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "digest", F.lit(True).alias("copied"))
    out = about.join(cut, ["key", "digest"], "left").join(copied, ["key", "digest"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start: long, stop: long>>")
    spans = F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", none))
    return out.select(
        "doc_id", "key", "digest", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), spans.alias("spans"),
        F.when(F.col("copied"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans less the bytes of characters that they only touch: UTF-8 stays valid when they are cut out."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, cuts of struct(digest, spans)) -> (row, text without the spans of its digest)."""
    for batch in batches:
        texts = []
        for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if cuts and text:
                raw = text.encode("utf-8")
                digest = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                spans = next((c["spans"] for c in cuts if c["digest"] == digest), [])
                kept, at = [], 0
                for a, b in whole_characters(raw, [(s["start"], s["stop"]) for s in spans]):
                    kept.append(raw[at:a])
                    at = b
                text = b"".join([*kept, raw[at:]]).decode("utf-8")
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "trimmed"])


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with its own columns, the repeated bytes of ``text`` cut out and ``n_chars``, where there is one, set anew.

    Rows are never dropped: a text that repeats from end to end becomes empty, a null text stays null.  A character
    that a repeated string covers only in part stays.
    """
    found = repeated_spans(docs, length, anchor).where("n_removed > 0").select("key", "digest", "spans").dropDuplicates(["key", "digest"])
    cuts = settle(found.groupBy("key").agg(F.collect_list(F.struct("digest", "spans")).alias("cuts")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col("text").cast("string").alias("text"))
    packed = packed.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = packed.hint("merge").join(cuts, "key", "left").select("row", "text", "cuts")
    out = joined.mapInArrow(_trim, StructType([packed.schema["row"], *StructType.fromDDL("trimmed string").fields]))
    new = {"text": F.col("trimmed"), "n_chars": F.coalesce(F.char_length("trimmed"), F.lit(0)).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

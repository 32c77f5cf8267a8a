"""Operator 13: periodic runs of words by an online sparse diagonal table.

Word ``i`` equals an earlier word ``i - q``: a cell of the diagonal with lag ``q``.  Reading a text from left to right,
the table holds only the diagonals that match at present, with their lengths; each word lengthens those it continues,
and a diagonal that ends long enough gives its run at once.

Most pairs of equal words can never grow into a run.  A lag between 2**k and 2**(k+1) needs 3 * 2**k matches at least, so
a diagonal is opened only where that many words are the same as at their nearest earlier place, and only at its first
match.  For a run's smallest period the nearest earlier place is always one period back: a nearer one would give the
stretch a smaller period still (two periods of a stretch at least as long as their sum have a common divisor as
period).  So every run is found, multiples of its period are not, and a text costs n log n whatever it repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.llm.store import small_batches

#: A run has as many words at least, and as many periods.
SHORTEST = 6
PERIODS = 4
_FACTOR = PERIODS - 1  # matches of a diagonal for each word of its period

Run = tuple[int, int, int]  # start, length, period


def _ranks(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, previous) over ``n`` places: equal keys at the places ``at`` (ascending) share a rank; -1 where a key stands once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    rank, previous = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    repeated = np.append(same, False) | np.insert(same, 0, False) if len(keys) else np.zeros(0, dtype=bool)
    numbers = np.cumsum(np.insert(~same, 0, True)) if len(keys) else np.zeros(0, dtype=np.int64)
    rank[at[order[repeated]]] = numbers[repeated]
    previous[at[order[1:][same]]] = at[order[:-1][same]]
    return rank, previous


def openings(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """(place, lag) where a diagonal starts that may become a run, in order of place.

    ``ids`` are the words of several texts one after the other, no id in two texts; ``first`` is the first place of the
    text of each word.
    """
    n = len(ids)
    out: list[np.ndarray] = []
    size, low = _FACTOR, 1
    if n < size:
        return []
    rank, _ = _ranks(ids, np.arange(n), n)
    for step in range(1, size):  # blocks of ``size`` words, one word more at a time
        at = np.flatnonzero(rank[: n - step] >= 0)
        rank, previous = _ranks(rank[at] * (int(ids.max()) + 1) + ids[at + step], at, n)
    while True:
        at = np.flatnonzero(previous >= 0)
        lag = at - previous[at]
        fits = (lag >= low) & (lag < 2 * low)
        at, lag = at[fits], lag[fits]
        before = at - lag - 1  # the diagonal starts here if the words before differ or the text begins
        starts = (before < first[at]) | (ids[at - 1] != ids[before])
        out.append(np.stack([at[starts], lag[starts]], axis=1))
        at = np.flatnonzero(rank[: max(0, n - size)] >= 0)
        at = at[rank[at + size] >= 0]
        if not len(at):
            break
        rank, previous = _ranks(rank[at] * (n + 1) + rank[at + size], at, n)
        size, low = 2 * size, 2 * low
    found = np.concatenate(out)
    return [tuple(p) for p in found[np.lexsort((found[:, 1], found[:, 0]))].tolist()]


def diagonal_runs(words: list[int], opened: list[tuple[int, int]]) -> list[Run]:
    """All runs of a text by (start, period): the online table over its words, with the diagonals that ``openings`` allows."""
    found: list[Run] = []
    active: dict[int, int] = {}  # lag: matches so far
    i, k, n = 0, 0, len(words)
    while i < n and (active or k < len(opened)):
        if not active:
            i = opened[k][0]  # no diagonal matches up to there
        word = words[i]
        for lag in list(active):
            if words[i - lag] == word:
                active[lag] += 1
            else:
                _close(found, i, lag, active.pop(lag))
        while k < len(opened) and opened[k][0] == i:
            active[opened[k][1]] = 1
            k += 1
        i += 1
    for lag, length in active.items():
        _close(found, n, lag, length)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _close(found: list[Run], end: int, lag: int, matches: int) -> None:
    length = matches + lag
    if length >= max(SHORTEST, PERIODS * lag):
        found.append((end - length, length, lag))


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] > 0


def text_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as its list of words."""
    ids, first, opened_at = [], [], [0]
    base = 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids.append(np.fromiter((base + known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)))
        first.append(np.full(len(words), opened_at[-1], dtype=np.int64))
        opened_at.append(opened_at[-1] + len(words))
        base += len(known)
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    per_text: dict[int, list[tuple[int, int]]] = {}
    starts = np.array(opened_at)
    opened = openings(flat, np.concatenate(first)) if len(flat) else []
    owner = np.searchsorted(starts, [p for p, _ in opened], "right") - 1
    for t, (place, lag) in zip(owner.tolist(), opened, strict=True):
        per_text.setdefault(t, []).append((place - opened_at[t], lag))
    return [diagonal_runs(ids[t].tolist(), per_text[t]) if t in per_text else [] for t in range(len(texts))]


def cycled(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text as the query of operator 13 asks: one document in ten is made to repeat from some word on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


_FIELDS = (
    "n_words long, runs array<struct<start:long,length:long,period:long>>, longest struct<start:long,length:long,period:long>, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string")


def _find(change: Callable[[list[bytes], int | None], list[bytes]] | None, keep_text: bool):
    def rows(texts: list[str | None], ids: list[int | None]) -> Iterator[dict]:
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        if change:
            split = [change(words, i) for words, i in zip(split, ids, strict=True)]
        for words, runs in zip(split, text_runs(split), strict=True):
            gone = dropped(len(words), runs) if runs else None
            left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if runs else b" ".join(words)
            best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
            listing = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
            name = ("start", "length", "period")
            yield {
                "n_words": len(words), "runs": [dict(zip(name, r, strict=True)) for r in runs], "longest": dict(zip(name, best, strict=True)) if best else None,
                "runs_sha256": hashlib.sha256(listing).hexdigest(), "collapsed_sha256": hashlib.sha256(left).hexdigest(),
                "collapsed": left.decode("utf-8", "surrogatepass") if keep_text else None}

    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = pa.schema([
        ("n_words", pa.int64()), ("runs", pa.list_(span)), ("longest", span), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.RecordBatch.from_pylist(list(rows(batch.column(1).to_pylist(), batch.column(2).to_pylist())), schema=types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["row", *types.names])

    return run


def periodic_runs(docs: DataFrame, carry: list[str] | None = None, change: Callable[[list[bytes], int | None], list[bytes]] | None = None, keep_text: bool = True) -> DataFrame:
    """(row, n_words, runs, longest, runs_sha256, collapsed_sha256, collapsed), one row for each row of ``docs`` (doc_id, text).

    ``row`` is a struct of the columns ``carry`` of ``docs`` (default: all).  Words are runs of other than ASCII white space.
    A run is a stretch of at least ``SHORTEST`` words and ``PERIODS`` times its smallest period that neither neighbour
    continues; ``runs`` are ordered by start, then period, and ``longest`` is the longest (ties: smallest start, then
    period; null without runs).  ``collapsed`` is the text without the words of any run behind its first period, joined by
    single spaces (null where ``keep_text`` is off).  ``change`` may rewrite a text's words by its doc_id first.

    Null and empty texts have no words and no runs; rows come back as often as they came, a null doc_id too; an empty
    table gives an empty result.  A row depends on itself alone, so there is no shuffle.
    """
    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return packed.mapInArrow(_find(change, keep_text), StructType([packed.schema["row"], *StructType.fromDDL(_FIELDS).fields]))

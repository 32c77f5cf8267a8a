"""Operator 1: SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed as a protobuf, and its normaliser, white-space marker, scores, merges and byte fallback are
rebuilt as a ``tokenizers`` pipeline.  Texts are encoded batch by batch with a few threads a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.llm.bytehash import pieces as text_runs
from attestry.llm.store import small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BATCH_BYTES = 1 << 19
#: Threads that the tokenizers library uses in one task; each keeps memory of its own.
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers for varints, bytes for all else."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if byte < 0x80:
                return value, i

    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, i = varint(i)
            if size is None:
                raise ValueError("not a SentencePiece model")
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """pieces [(text, score, kind)], model kind and the normaliser's settings of a model file's bytes."""
    model = {"pieces": [], "kind": UNIGRAM, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), dtype="<f4")[0])
            model["pieces"].append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            model["kind"] = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            model["charsmap"] = spec.get(2, b"")
            model["dummy_prefix"], model["squeeze"], model["escape"] = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if model["kind"] not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if any(kind == USER for _, _, kind in model["pieces"]):
        raise ValueError("user-defined pieces are not supported")
    return model


def rebuild(model: dict):
    """A ``tokenizers.Tokenizer`` that encodes and decodes like the parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    entries = model["pieces"]
    unknown = next((i for i, p in enumerate(entries) if p[2] == UNKNOWN), 0)
    fallback = any(p[2] == BYTE for p in entries)
    if model["kind"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in entries], unk_id=unknown, byte_fallback=fallback)
    else:
        normal = {p: (-s, i) for i, (p, s, k) in enumerate(entries) if k == NORMAL}
        merges = []
        for piece, rank in normal.items():
            merges += [(rank, cut, piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in normal and piece[cut:] in normal]
        merges.sort(key=lambda m: m[:2])
        core = models.BPE({p: i for i, (p, _, _) in enumerate(entries)}, [m[2:] for m in merges], unk_token=entries[unknown][0], fuse_unk=True, byte_fallback=fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if model["escape"] else " "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if model["escape"] and not any(MARK in p.lstrip(MARK) for p, _, k in entries if k == NORMAL):
        # no piece has a marker behind another character: a run of markers always begins a new word
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    finish = [decoders.Replace(MARK, " ")] if model["escape"] else []
    finish += [decoders.ByteFallback()] if fallback else []
    finish += [decoders.Fuse()]
    finish += [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    out.decoder = decoders.Sequence(finish)
    return out


#: Words whose ids a task remembers; the table is emptied when it is full, which costs time and changes nothing.
REMEMBERED = 400_000
#: New words encoded as one text: cheaper than a text each.
JOINED = 200


class Codec:
    """Encodes and decodes batches of texts; ``check`` compares with the sentencepiece library and decodes again.

    Where no piece of the model crosses the beginning of a word, texts are cut there and every word is encoded,
    compared and decoded once for as long as it is remembered, and not at each occurrence.
    """

    def __init__(self, data: bytes, check: bool = True, threads: int = THREADS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        model = parse_model(data)
        self.tokenizer = rebuild(model)
        self.by_word = self.tokenizer.pre_tokenizer is not None and model["dummy_prefix"] and not model["charsmap"] and not model["squeeze"]
        self.reference = None
        if check:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        if self.by_word:
            from tokenizers import normalizers

            self.tokenizer.normalizer = normalizers.Sequence([])  # words are cut from normalised texts
            self.split = re.compile(f"{MARK}+[^{MARK}]*").findall
            self.begins = np.array([p.startswith(MARK) for p, _, _ in model["pieces"]])
            self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.bounds = np.zeros(1, dtype=np.int64)
        self.same = np.zeros(0, dtype=bool)
        self.back = np.zeros(0, dtype=bool)

    def _learn(self, fresh: list[str]) -> None:
        joined = [w for w in fresh if w.count(MARK) == 1 and w != MARK]
        alone = [w for w in fresh if w.count(MARK) != 1 or w == MARK]
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)] + [[w] for w in alone]
        texts = ["".join(g) for g in groups]
        raw = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = [np.array(x, dtype=np.int32) for x in raw]
        same, back = [True] * len(groups), [True] * len(groups)
        if self.reference:
            spoken = [t[1:].replace(MARK, " ") for t in texts]
            # one lone marker can't be asked for: the library adds its own before any text
            same = [t == MARK or i == r for t, i, r in zip(texts, raw, self.reference.encode(spoken, num_threads=1), strict=True)]
            back = [a == b for a, b in zip(self.decode(raw), spoken, strict=True)]
        sizes: list[np.ndarray] = []
        for group, x in zip(groups, ids, strict=True):
            starts = np.flatnonzero(self.begins[x]) if len(group) > 1 else np.zeros(1, dtype=np.int64)
            if len(starts) != len(group):
                raise ValueError("a piece crosses the beginning of a word")
            sizes.append(np.diff(np.append(starts, len(x))))
        repeat = [len(g) for g in groups]
        self.words.update(zip([w for g in groups for w in g], range(len(self.words), len(self.words) + len(fresh)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))])
        self.same = np.concatenate([self.same, np.repeat(same, repeat)])
        self.back = np.concatenate([self.back, np.repeat(back, repeat)])

    def encode(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of each text (a list array), whether it decodes to itself, and whether both libraries agree."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back, same = np.ones(len(ids), dtype=bool), np.ones(len(ids), dtype=bool)
            if self.reference:
                same = np.array([a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=1), strict=True)], dtype=bool)
                back = np.array([a == b for a, b in zip(self.decode(ids), texts, strict=True)], dtype=bool)
            return pa.array(ids, pa.list_(pa.int32())), back, same
        cut = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.words)
        if len(self.words) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = set().union(*cut)
        if fresh:
            self._learn(list(fresh))
        known = self.words.__getitem__
        word = np.fromiter((i for words in cut for i in map(known, words)), dtype=np.int64)
        size = self.bounds[word + 1] - self.bounds[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.bounds[word] - ends[:-1], size) + np.arange(ends[-1])
        per_text = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
        ids = pa.ListArray.from_arrays(pa.array(ends[per_text], pa.int32()), pa.array(self.flat[at], pa.int32()))
        good = [np.add.reduceat(np.append(~f[word], False), per_text[:-1]) * (per_text[1:] > per_text[:-1]) == 0 for f in (self.back, self.same)]
        if any(MARK in t for t in texts):  # the marker itself comes back as a space
            good[0] &= np.array([MARK not in t for t in texts])
        return ids, *good

    def decode(self, ids: list) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _code(data: bytes, check: bool, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, check, threads)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            for row, _, offsets in text_runs(column, BATCH_BYTES):
                size = len(offsets) - 1
                ids, back, same = codec.encode(pc.fill_null(column.slice(row, size), "").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, size), ids, pc.list_value_length(ids).cast(pa.int64()), pa.array(back), pa.array(same)], ["row", "ids", "n_ids", "round_trip", "parity"])

    return run


def encode_documents(docs: DataFrame, model: bytes, carry: list[str] | None = None, check: bool = True, threads: int = THREADS) -> DataFrame:
    """(row, ids, n_ids, round_trip, parity): ``row`` is a struct of the columns ``carry`` of ``docs`` (default: all).

    ``docs`` needs text.  ``ids`` are the whole text's ids, ``round_trip`` tells whether they decode to the very
    text, ``parity`` whether the sentencepiece library encodes it alike (both true where ``check`` is off).
    A null or empty text has no ids and round-trips to the empty text; rows come back as often as they came, and an
    empty table gives an empty result.  A text that holds the marker character itself decodes with a space in its
    place, so its ``round_trip`` is false.
    """
    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([packed.schema["row"], *StructType.fromDDL("ids array<int>, n_ids long, round_trip boolean, parity boolean").fields])
    return packed.mapInArrow(_code(model, check, threads), schema)


def decode_column(data: bytes):
    """A function for ``mapInArrow`` over (row, ids array<int>) -> (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, check=False)
        for batch in batches:
            text = codec.decode([x or [] for x in batch.column(1).to_pylist()])  # null counts as no ids
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["row", "text"])

    return run


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()

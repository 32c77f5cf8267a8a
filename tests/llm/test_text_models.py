import math
import random

import numpy as np
import pytest

from attestry.llm import langid, resample, sentencepieces, toxicity
from attestry.llm.queries import MODEL_PATH
from tests.llm.conftest import sentence


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, 1.5, rng.gauss(0, 1e3), rng.gauss(0, 1e-6)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3).cache()
    for k in (1, 2, 17, 250, 499, 500):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_resample_equals_brute_force(spark):
    rng = random.Random(2)
    good = [(i, sentence(rng, rng.randint(3, 40))) for i in range(60)]
    bad = [(100 + i, " ".join("Xq###" for _ in range(rng.randint(3, 40)))) for i in range(15)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:30]] + [(i, 0) for i, _ in bad[:8]], "doc_id long, quality int")
    out = resample.resample(docs, labels).selectExpr("row.doc_id", "key", "selected", "n_grams", "log_weight").collect()
    assert all(r.selected == (r.doc_id < 100) for r in out)
    few = resample.resample(docs, labels, keep=10).selectExpr("row.doc_id", "key", "selected").collect()
    assert {r.doc_id for r in few if r.selected} == {r.doc_id for r in sorted(few, key=lambda r: -r.key)[:10]}
    # the weight of one text from its n-grams' buckets, counted here one by one
    seen, target = {}, {}
    told = {i for i, _ in good[:30]}
    grams = {}
    for i, t in good + bad:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        with np.errstate(over="ignore"):
            grams[i] = resample.ngram_buckets(raw, np.array([0, len(raw)]), resample.BUCKETS)[0].tolist()
        for g in grams[i]:
            seen[g] = seen.get(g, 0) + 1
            target[g] = target.get(g, 0) + (i in told)
    n, m = sum(seen.values()), sum(target.values())
    for r in out:
        ratios = [math.log((target[g] + 0.5) / (m + 0.5 * resample.BUCKETS)) - math.log((seen[g] + 0.5) / (n + 0.5 * resample.BUCKETS)) for g in grams[r.doc_id]]
        assert r.n_grams == len(ratios) and r.log_weight == pytest.approx(resample.NGRAMS * sum(ratios) / len(ratios))


def test_resample_odd_rows(odd_docs, no_docs, labels):
    out = resample.resample(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and out[0].row.key == "x"
    assert all(r.n_grams == 0 for r in out if not (r.row.text or "").strip())
    assert resample.resample(no_docs, labels).collect() == []
    assert all(r.selected for r in resample.resample(odd_docs, labels.limit(0)).collect())


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        words = sentence(rng, 40).split()
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["grumble" + rng.choice("abcdef") + "x", "Nastyword!"])
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(toxic_docs):
    out = toxicity.toxicity(toxic_docs.select("doc_id", "text"), toxic_docs.select("doc_id", "toxic")).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and 40 < len(held) < 130
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_label_model_finds_wrong_labels():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.2
    votes = np.stack([np.where(y, rng.random(2000) < 0.8, rng.random(2000) < 0.02) for _ in range(6)], axis=1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)  # two copies of one voter
    labels = np.where(rng.random(2000) < 0.05, ~y, y).astype(float)
    posterior, scale = toxicity.label_model(votes, labels)
    assert ((posterior > 0.5) == y).mean() > (labels == y).mean()
    assert scale[0] < 0.5 < scale[1]  # copies share their evidence


def test_toxicity_odd_rows(odd_docs, no_docs, labels):
    out = toxicity.toxicity(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert {r.score for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.93 * len(out)


def test_windows_cover_every_byte():
    data = np.arange(1000, dtype=np.int64).astype(np.uint8)
    offsets = np.array([0, 0, 3, 131, 700, 1000])
    windows, row = langid.cut_windows(data, offsets)
    assert 0 not in row and windows.shape[1] == langid.WINDOW
    for r in range(1, 5):
        own = data[offsets[r] : offsets[r + 1]].tobytes()
        joined = b"".join(w.tobytes()[: langid.WINDOW - max(langid.WIDTHS) + 1] for w in windows[row == r][:-1]) + windows[row == r][-1].tobytes()
        assert joined[: len(own)] == own


def test_language_odd_rows(odd_docs, no_docs):
    out = langid.language(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (2, 3, 4, 8))
    assert all(r.lang_pred == "en" for r in out if r.doc_id in (1, 5, 7))
    assert langid.language(no_docs).collect() == []


TEXTS = ["Hello  world", " lead", "tail  ", "a\nb\tc", "", None, "日本𝒳\x00z", "<s> <unk> <0x41>", "x" * 5000, "   ", "né ñ ß", "1 22,333.5 km"]


def test_codec_parity_with_the_model_library(spark):
    import sentencepiece

    rng = random.Random(4)
    alphabet = "abc éß日\n\t 012 .,!?𝒳  "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    data = sentencepieces.model_bytes(MODEL_PATH)
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = sentencepieces.encode_documents(df, data, carry=["doc_id"])
    got = {r.row.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == model.encode(t or "") and got[i].n_ids == len(got[i].ids) and got[i].round_trip and got[i].parity
    back = out.select("row", "ids").mapInArrow(sentencepieces.decode_column(data), "row struct<doc_id: long>, text string").collect()
    assert {r.row.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_codec_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 5)
    codec = sentencepieces.Codec(sentencepieces.model_bytes(MODEL_PATH))
    texts = [["one two three four", "five six"], ["seven eight nine ten eleven twelve"], ["one two"]]
    for t in texts:
        ids, back, same = codec.encode(t)
        assert ids.to_pylist() == codec.reference.encode(t) and back.all() and same.all()


def test_codec_odd_rows(odd_docs, no_docs):
    data = sentencepieces.model_bytes(MODEL_PATH)
    out = sentencepieces.encode_documents(odd_docs, data).collect()
    assert len(out) == odd_docs.count() and all(r.round_trip and r.parity for r in out) and out[0].row.key == "x"
    assert all(r.n_ids == 0 for r in out if not r.row.text)
    assert sentencepieces.encode_documents(no_docs, data).collect() == []


def test_marker_does_not_round_trip(spark):
    df = spark.createDataFrame([(1, "a ▁b")], "doc_id long, text string")
    assert not sentencepieces.encode_documents(df, sentencepieces.model_bytes(MODEL_PATH)).first().round_trip


def test_unigram_model_is_rebuilt():
    import struct

    def field(n, kind, value):
        return bytes([n << 3 | kind]) + value

    def piece(text, score, kind):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    model = b"".join(piece(*p) for p in [("<unk>", 0, 2), ("▁ab", -1, 1), ("▁a", -2, 1), ("b", -2.5, 1), ("c", -3, 1), ("▁", -4, 1)])
    model += field(2, 2, b"\x02" + field(3, 0, b"\x01")) + field(3, 2, b"\x04" + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = sentencepieces.Codec(model)
    for t in ("ab", "abc", "a b", "cab ab"):
        assert codec.encode([t])[0].to_pylist() == [lib.encode(t)]

import hashlib
import random

from attestry.llm import suffixdedup
from attestry.llm.gsaca import suffix_array
from tests.llm.conftest import sentence


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(600):
        x = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def corpus(rng):
    shared = [sentence(rng, 60) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [sentence(rng, rng.randint(5, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts.insert(1, s[a : a + rng.randint(30, 400)])
        texts.append(" ".join(parts))
    return texts + [texts[0], "ab" * 300, "é" * 250, "x" * 199, "y" * 200, "y" * 200, None, "", texts[1][:400] * 2]


def test_equals_brute_force(spark):
    texts = corpus(random.Random(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (30_000, 3):  # all groups sorted; large groups counted window by window
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_spans(df, group=group).collect())
        assert got == brute(texts, 200)


def test_other_lengths(spark):
    texts = corpus(random.Random(4))[:30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_spans(df, length=60, anchor=25).collect())
    assert got == brute(texts, 60)


def test_odd_rows(odd_docs, no_docs):
    got = suffixdedup.repeated_spans(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_removed for r in got if r.doc_id in (5, 6)} == {r.n_bytes for r in got if r.doc_id == 5}
    assert all(r.n_removed == 0 and r.n_spans == 0 for r in got if r.doc_id in (2, 3, 4, 7))
    assert suffixdedup.repeated_spans(no_docs).collect() == []
    cut = {r.doc_id: r for r in suffixdedup.without_repeats(odd_docs).collect()}
    assert cut[5].text == "" and cut[5].n_chars == 0 and cut[2].text is None and cut[7].text == "one two" and cut[1].key == "x"
    assert suffixdedup.without_repeats(no_docs).columns == no_docs.columns


def test_characters_stay_whole():
    raw = "aéb".encode()
    assert suffixdedup.whole_characters(raw, [(0, 2)]) == [(0, 1)] and suffixdedup.whole_characters(raw, [(2, 4)]) == [(3, 4)]

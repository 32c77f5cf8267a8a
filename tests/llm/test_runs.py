import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Runs by trying every start and period."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + m - p)) for p in range(1, q)):
                found.add((i, m, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def fields(words):
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text, from the definition."""
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=60), min_size=1, max_size=4))
def test_small_alphabets(texts):
    assert runs.text_runs(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 9)), min_size=1, max_size=6))
def test_planted_powers(parts):
    """Blocks repeated one to nine times, side by side: overlapping runs, periods that are powers of shorter ones."""
    words = [w for block, times in parts for w in block * times]
    assert runs.text_runs([words, words]) == [brute(words)] * 2


def test_long_texts_need_no_quadratic_work():
    same = [b"x"] * 300_000
    deep = [b"%d" % (i % 1000) for i in range(200_000)]
    spaced = [w for i in range(60_000) for w in (b"the", b"%d" % i)]
    assert runs.text_runs([same, deep, spaced]) == [[(0, 300_000, 1)], [(0, 200_000, 1000)], []]


def test_query_columns_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """The registered query against brute force, with documents that its rule makes periodic."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 5000]
    rows += [(100 + i, " ".join(rng.choice(["a", "b", "A", "é"]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(n, t) for n in (300, 301, 302, 303, 304, 305, 306) for t in ("", "one", "a\x1fb \x85 a\xa0b\n\n" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def changed(i, words):
        import zlib

        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not words:
            return words
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i if i < a else a + (i - a) % p] for i in range(n)]

    want = [(i, *fields(changed(i, WORDS.findall(t or "")))) for i, t in rows]
    assert any(changed(i, WORDS.findall(t or "")) != WORDS.findall(t or "") for i, t in rows)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_operator_keeps_columns_and_text(spark, odd_docs, no_docs):
    out = runs.periodic_runs(odd_docs)
    rows = out.collect()
    assert out.columns == ["row", "n_words", "runs", "longest", "runs_sha256", "collapsed_sha256", "collapsed"]
    assert sorted(str(r.row) for r in rows) == sorted(str(r) for r in odd_docs.collect())
    assert runs.periodic_runs(no_docs).count() == 0
    one = spark.createDataFrame([(1, "go " + "b c  " * 5 + "end", 2)], "doc_id long, text string, `my col` int")
    r = runs.periodic_runs(one).first()
    assert r.collapsed == "go b c end" and r.longest.asDict() == {"start": 1, "length": 10, "period": 2} and r.row["my col"] == 2

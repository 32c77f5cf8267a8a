import random

import numpy as np

from attestry.llm import minhash
from attestry.llm.bytehash import shingle_sets
from attestry.llm.components import components
from tests.llm.conftest import sentence


def brute(rows, percent=85):
    """Components by comparing the shingle sets of all pairs."""
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(text):
        w = (text or "").translate(table).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(rng, n, words=80, edits=2):
    base = sentence(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [t for _ in range(8) for t in near_copies(rng, 7)] + [sentence(rng, rng.randint(1, 30)) for _ in range(40)] + ["a b", "A B", "a b c d e", ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (3000, 5):  # whole clusters, and clusters cut into blocks
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, block=block).collect()}
        assert got == want


def test_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id is None and r.kept for r in by[None]) and len(by[None]) == 2
    assert [by[i][0].n_shingles for i in (2, 3, 4)] == [0, 0, 0] and all(by[i][0].kept for i in (2, 3, 4))
    assert by[6][0].component_id == 5 and not by[6][0].kept and by[5][0].kept
    assert len(by[7]) == 2 and all(r.kept and r.component_id == 7 for r in by[7])
    assert by[10][0].component_id == 7  # case does not count
    assert minhash.near_duplicates(no_docs).collect() == []


def test_signature_is_circulant():
    sets = [np.arange(1, 200, dtype=np.uint64), np.arange(20, 220, dtype=np.uint64)]
    sig = minhash.signature(sets, 2000)
    assert abs((sig[0] == sig[1]).mean() - 180 / 219) < 0.05
    assert (minhash.signature(sets, 50) == sig[:, :50]).all()


def test_shingles_of_short_texts():
    import pyarrow as pa

    sets = dict(shingle_sets(pa.array(["a b c", "A  b\tc ", None, "a b c d e f", "x"]), 5))
    assert sets[0].tolist() == sets[1].tolist() and len(sets[2]) == 0 and len(sets[3]) == 2 and len(sets[4]) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 == got[100]

import random
import re
from collections import Counter

import numpy as np
import pytest

from attestry.llm import collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, most=3, least=10, top=2000, covered=50):
    """Rows (lang, rank, phrase, a, l, r, n, score) counted on strings."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {k: f for k, f in counts.items() if f >= least}
    wide = {k: f for k, f in frequent.items() if len(k[1]) > 1}
    out = {}
    for (lang, p), a in wide.items():
        inside = [f for (other, q), f in wide.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * f >= covered * a for f in inside):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "c", "é", "É", "x\x1fy", "\x00", "naïve", "d"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ", "\r"]) for w in words)))
    return rows + [("en", None), ("fr", ""), (None, "..."), ("en", " New York City, new york city;" * 30), ("fr", "un deux trois quatre " * 40)]


def frame(spark, rows):
    return spark.createDataFrame([(n, lang, text, "x", 1) for n, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, row int").repartition(3)


@pytest.mark.parametrize("bits", [64, 12, 4])
def test_against_brute_force(spark, bits):
    """Also with so few bits that most phrases share a fingerprint."""
    rows = corpus(bits, 120)
    got = collocations.collocations(frame(spark, rows), bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_other_parameters(spark):
    rows = corpus(3, 80)
    got = collocations.collocations(frame(spark, rows), most=4, least=4, top=7, covered=80)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 4, 7, 80)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd_docs).collect()) == brute(rows)
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(frame(spark, [("en", "too few words")])).count() == 0


def test_portions_keep_every_gram():
    texts = [t for _, t in corpus(5, 50)] + [None, "", "no end at all " * 30]
    langs = ["l"] * len(texts)

    def grams(most):
        out = Counter()
        for portion, owner in collocations.portions(texts, most):
            g = collocations.Grams(portion, owner, langs, 3, 64)
            out.update(zip(g.text[g.at].tolist(), g.print.tolist(), g.check.tolist(), map(g.phrase, range(len(g.at))), strict=True))
        return out

    assert grams(1 << 30) == grams(64) == grams(1)


def test_prefix_polynomials_agree_with_the_plain_sum():
    g = collocations.Grams([b"a b c a b"], [0], ["l"], 3, 64)
    of = {g.phrase(j): g.print[j] for j in range(len(g.at))}
    assert len(set(g.print.tolist())) == len(of) == 3 + 3 + 3
    assert [g.phrase(j) for j in np.flatnonzero(g.print == of[b"a b"])] == [b"a b", b"a b"]

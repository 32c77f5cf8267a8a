"""Fuzzy ratios and joins against brute force."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestry.functions import fuzzy as Z
from attestry.operators import audit as A
from attestry.operators import fuzzyjoin as J


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], p + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    one = lambda x, y: max(ratio(x, y[max(0, i):i + len(x)]) for i in range(1 - len(x), len(y)) if y[max(0, i):i + len(x)])
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def words(n, seed, size=(3, 9), alphabet="abcde"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(*size))) for _ in range(n)]


def test_ratios_match_brute_force():
    r = random.Random(3)
    for i in range(120):
        a, b = (words(1, r.random(), (1, 80 if i % 6 == 0 else 12))[0] for _ in range(2))
        assert Z.ratio(a, b) == pytest.approx(ratio(a, b))
        want = partial(a, b)
        assert Z.partial_ratio(a, b) == pytest.approx(want)
        for t in (50, 60, 80):
            assert (Z.partial_ratio(a, b, t) >= t - 1e-9) == (want >= t - 1e-9)
    assert Z.token_set_ratio("a b c", "c a") == 100.0
    assert Z.token_sort_ratio("b a", "a b") == 100.0
    assert Z.ratio("예산이 증액되었습니다", "예산이 증액 되었습니다") >= 90 > 80 > Z.ratio("예산이 증액되었습니다", "완전히 다른 텍스트입니다")


@pytest.mark.parametrize("method,score", [("ratio", .7), ("partial", .8), ("token_sort", .75), ("token_set", .8)])
def test_fuzzy_join_is_exact(spark, method, score):
    mk = lambda seed: [" ".join(words(2, seed * 100 + i, (2, 5), "abcd")) if method.startswith("token") else words(1, seed * 100 + i)[0] for i in range(40)]
    left, right = mk(1), mk(2)
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {(r.left_id, r.right_id) for r in J.fuzzy_join(df(left), df(right), method, score, best_only=False).collect()}
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if Z.METHODS[method](a, b) >= 100 * score - 1e-7}
    assert got == want


def test_partial_keyword_matches(spark):
    text = "budget plans for regional tourism"
    chunks = spark.createDataFrame([(1, text), (2, "nothing in common")], "chunk_id int, text string")
    kws = ["budgets", "tourisn", "regional", "planetary", "forum"]
    pairs = spark.createDataFrame([(9, c, k) for c in (1, 2) for k in kws], "query_id int, chunk_id int, keyword string")
    got = {(r.chunk_id, r.keyword) for r in J.partial_matches(pairs, chunks).collect()}

    def brute(k, t):
        return k not in t and any(len(w) >= 2 and (w in k or k in w or (len(w) >= 3 and ratio(k, w) >= 80)) for w in t.split())

    assert got == {(c, k) for c, t in ((1, text), (2, "nothing in common")) for k in kws if brute(k, t)}


EV = [(1, 1, "budget_2024", 3, "2024년도 예산 편성 지침의 주요 변경사항은 디지털 전환 예산 10% 증액입니다."), (1, 2, "budget_2024", 5, "탄소중립 관련 예산이 신설되어 500억원이 배정되었습니다.")]


def test_audit_examples(spark):
    ev = spark.createDataFrame(EV + [(2, *e[1:]) for e in EV], "response_id int, rank int, doc_id string, page int, text string")
    rs = spark.createDataFrame([
        (1, "디지털 전환 예산이 10% 증액되고 탄소중립 예산이 신설되었습니다.", ["디지털 전환 예산 10% 증액", "탄소중립 예산 500억원 배정"], ""),
        (2, "예산이 50% 삭감되고 모든 사업이 중단됩니다.", ["예산 50% 삭감", "사업 중단"], "")], "response_id int, answer string, key_facts array<string>, details string")
    cites = spark.createDataFrame([(1, "budget_2024", 4), (1, "budget_2024", 8)], "response_id int, doc_id string, page int")
    out = {r.response_id: r for r in A.audit_responses(rs, ev, cites).collect()}
    assert out[1].jaccard_score == pytest.approx(.285714, abs=1e-6) and not out[1].hallucination_detected
    assert out[2].jaccard_score == pytest.approx(.083333, abs=1e-6) and out[2].hallucination_detected and out[2].quality_level == "low"
    assert out[1].citation_accuracy == 0.5 and out[2].citation_accuracy == 0.5
    text = " ".join(e[4] for e in EV)
    sents = [x.strip() for x in (rs.first().answer + " " + " ".join(rs.first().key_facts) + " ").split(".") if x.strip()]
    assert out[1].sentence_coverage == pytest.approx(sum(partial(x.lower(), text.lower()) >= 60 for x in sents) / len(sents))


def test_alignment_and_corrections(spark):
    ev = spark.createDataFrame([(1, 1, 7, 2, "the quick brown fox jumps over the lazy dog"), (1, 2, 8, 1, "Gamcheonville tourism plan")],
                               "response_id int, rank int, doc_id int, page int, text string")
    rs = spark.createDataFrame([(1, "over the lazy dog jumps the quick brown fox [2]\nsomething else entirely different"), ], "response_id int, answer string")
    rows = A.align_lines(rs, ev).orderBy("line_no").collect()
    assert rows[0].doc_id == 7 and rows[0].adjusted and rows[0].corrected == "the quick brown fox jumps over the lazy dog [2]"
    assert rows[1].doc_id is None and not rows[1].adjusted
    a = spark.createDataFrame([(1, "Gamcheonvilla is nice")], "response_id int, answer string")
    fix = A.entity_corrections(a, ev)
    assert [(r.entity, r.replacement) for r in fix.collect()] == [("Gamcheonvilla", "Gamcheonville")]
    assert A.apply_corrections(a, fix).first().answer == "Gamcheonville is nice"
    var = A.entity_variations(a, ev).first()
    assert (var.entity, var.similar_to) == ("Gamcheonvilla", "Gamcheonville")
    t, e = F.lit("감천마을(벽화) 안내"), F.lit("감천마을 소개")
    assert spark.range(1).select(A.fix_parentheticals(t, e, "hangul")).first()[0] == "감천마을 안내"


@pytest.mark.parametrize("score", [.8, .85, .95])
@pytest.mark.parametrize("method", ["ratio", "token_sort"])
def test_segments_lose_no_pair(spark, method, score):
    """Words of every length, the empty one and some beyond the segment limit, with planted edits, against brute force."""
    r = random.Random(int(score * 100))
    left = ["", "a", "ab", "é"] + [w for n in range(1, 12) for w in words(6, n, (n, n), "abcé")] + words(8, 77, (20, 34), "abcdefgh")
    right = ["", "b", "ab"] + [w for n in range(1, 12) for w in words(6, 50 + n, (n, n), "abcé")]
    for w in left:
        edited = list(w)
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(edited))
            if edited and r.random() < .5:
                edited.pop(min(at, len(edited) - 1))
            else:
                edited.insert(at, r.choice("abcx"))
        right.append("".join(edited))
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {(x.left_id, x.right_id) for x in J.fuzzy_join(df(left), df(right), method, score, best_only=False).collect()}
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if Z.METHODS[method](a, b) >= 100 * score - 1e-7}


def test_a_hot_segment_is_salted(spark):
    """One key of many right rows is dealt to several parts and loses nothing."""
    from attestry.scale import salted_join

    left = spark.createDataFrame([("k", i) for i in range(5)] + [("other", 9)], "key string, l int")
    right = spark.createDataFrame([("k", str(i)) for i in range(1000)] + [("other", "x")], "key string, r string")
    got = salted_join(left, right, "key", "r", most=100)
    assert got.count() == 5001 and got.distinct().count() == 5001 and got.columns == ["key", "l", "r"]


def test_long_sentences_in_a_long_text():
    """Unrelated texts just below the threshold, the dearest case."""
    text = " ".join(words(5_000, 1, (3, 9), "etaoinshrdlu"))
    w, began = Z.Windows(text), time.perf_counter()
    assert [Z.partial_ratio(" ".join(words(230, i, (3, 9), "etaoinshrdlu")), text, 75, w) >= 75 for i in range(2, 22)] == [False] * 20
    assert time.perf_counter() - began < 8
    cut = list(text[9_000:10_500])
    for i in range(0, len(cut), 6):
        cut[i] = "#"
    assert Z.partial_ratio("".join(cut), text, 83, w) >= 83 > Z.partial_ratio("".join(cut), text, 84, w)


def test_windows_of_every_length_match_brute_force():
    r = random.Random(8)
    for _ in range(150):
        text = words(1, r.random(), (5, 160), "abcd é")[0]
        a = words(1, r.random(), (1, len(text)), "abcd éx")[0]
        want = max(lcs(a, text[i : i + len(a)]) for i in range(len(text) - len(a) + 1))
        assert Z.Windows(text).best(a, -1, len(a) + 1) == want


def test_sentences_and_facts_are_searched_together(spark):
    rows = [([["alpha beta", "nothing"], ["alpha beta"], []], "xx alpha beto yy"), ([[], ["a"], []], "")]
    got = spark.createDataFrame(rows, "l array<array<string>>, t string").select(Z.shares_matched(.8)("l", "t").alias("s")).collect()
    assert [r.s for r in got] == [[.5, 1.0, 0.0], [0.0, 0.0, 0.0]]


def test_the_best_unit_is_the_first_of_the_best():
    r, vocabulary = random.Random(4), ["a", "b", "ab", "the", "né", "가나", "abc", "zz"]
    mk = lambda n: "".join(r.choice(vocabulary) + r.choice(" \t") for _ in range(r.randint(0, n)))
    for _ in range(300):
        texts, lines = [mk(6) for _ in range(r.randint(0, 9))], [mk(7) for _ in range(3)]
        units = Z.Units(texts, lines)
        for line in lines:
            scores = [Z.token_set_ratio(line, u) if u else -1.0 for u in texts]
            want = (scores.index(max(scores)), max(scores)) if scores and max(scores) >= 0 else (-1, -1.0)
            assert units.best(line) == want


def test_lines_pass_all_units_at_once(monkeypatch):
    """Before, a line was compared with each unit by itself, also where they share no word."""
    calls, one = [], Z._set_ratio
    monkeypatch.setattr(Z, "_set_ratio", lambda *a: calls.append(a) or one(*a))
    units, lines = [" ".join(words(9, i, (3, 9), "etaoi")) for i in range(200)], [" ".join(words(9, i, (3, 9), "nshrd")) for i in range(8)]
    found = Z.best_units.func(pd.Series([lines]), pd.Series([units]))[0]
    assert not calls and [x["score"] for x in found] == [max(one(set(x.split()), set(u.split()), -1.0) for u in units) / 100 for x in lines]


def entities_of_two_responses(spark):
    mk = lambda n, seed: words(n, seed, (3, 8), "abé")
    rows = {i: (mk(25, i), mk(40, 10 + i)) for i in (1, 2)}
    rs = spark.createDataFrame([(i, " ".join(a)) for i, (a, _) in rows.items()] + [(3, "no evidence")], "response_id int, answer string")
    ev = spark.createDataFrame([(i, k, " ".join(b[k::2])) for i, (_, b) in rows.items() for k in (0, 1)], "response_id int, rank int, text string")
    return rows, rs, ev


def no_pairs_move(df):
    """One join, of a row for each response: before, three joins moved all pairs of entities."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_variations_match_brute_force_and_no_pair_moves(spark):
    from difflib import SequenceMatcher

    rows, rs, ev = entities_of_two_responses(spark)
    want = set()
    for i, (ours, theirs) in rows.items():
        for a in {a for a in ours if len(a) >= 4} - set(theirs):
            found = [(SequenceMatcher(None, a, b).ratio(), b) for b in theirs if b[:2] == a[:2]]
            found = [x for x in found if .7 < x[0] < .95]
            if found:
                want.add((i, a, max(found)[1], round(max(found)[0], 6)))
    out = A.entity_variations(rs, ev)
    assert {tuple(x) for x in out.collect()} == want and len(want) > 10 and no_pairs_move(out)


def test_corrections_match_brute_force_and_no_pair_moves(spark):
    from difflib import SequenceMatcher

    rows, rs, ev = entities_of_two_responses(spark)

    def score(a, b):
        ga, gb = ({x[i : i + 2] for i in range(len(x) - 1)} for x in (a, b))
        head = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        seq = SequenceMatcher(None, a, b).ratio()
        return seq * .5 + len(ga & gb) / len(ga | gb) * .3 + head / min(len(a), len(b)) * .2, seq

    want = set()
    for i, (ours, theirs) in rows.items():
        for a in set(ours) - set(theirs):
            found = [(score(a, b)[0], b) for b in theirs if a[0] == b[0] and abs(len(a) - len(b)) <= 3 and min(score(a, b)) > .6]
            if found:
                want.add((i, a, max(found)[1]))
    out = A.entity_corrections(rs, ev, threshold=.6)
    assert {tuple(x)[:3] for x in out.collect()} == want and len(want) > 5 and no_pairs_move(out)


def test_lines_meet_all_texts_of_a_response_at_once(spark):
    """Scores of a row's lines and texts equal those of the column form, pair by pair."""
    from attestry.functions import similarity as S
    from attestry.operators import citations as C

    r = random.Random(9)
    mk = lambda n: " ".join(r.choice(["a", "ab", "abc", "xabcx", "né", "가나다", "long word", "x y"]) for _ in range(r.randint(0, n)))
    rows = [([mk(5) for _ in range(3)], [mk(8) for _ in range(2)]) for _ in range(60)]
    df = spark.createDataFrame(rows, "l array<string>, t array<string>")
    got = [x.s for x in df.select(S.content_scores("l", "t").alias("s")).collect()]
    pairs = df.select(F.array(*[F.array(*[S.content_similarity_normed(F.get("l", F.lit(i)), F.get("t", F.lit(k))) for k in (0, 1)]) for i in (0, 1, 2)]).alias("s"))
    assert got == [x.s for x in pairs.collect()]
    ev = spark.createDataFrame([(1, 1, 5, "alpha beta gamma"), (1, 2, 6, "delta")], "response_id int, rank int, doc_id int, text string")
    lines = spark.createDataFrame([(1, [("alpha beta",), ("none",)]), (2, [("alpha",)])], "response_id int, lines array<struct<na:string>>")
    found = {(x.l.na, x["rank"], x.doc_id): x.score for x in C.line_scores(lines, ev).collect()}
    assert found == {("alpha beta", 1, 5): 1.0, ("alpha beta", 2, 6): 0.0, ("none", 1, 5): 0.0, ("none", 2, 6): 0.0}

"""Hand-computed values of the column functions and small operators."""

import math

import pytest
from pyspark.sql import functions as F

from attestry.functions import normalize as N
from attestry.functions import patterns as X
from attestry.functions import similarity as S
from attestry.functions import tokens as T
from attestry.operators import chunking as C
from attestry.operators import citations as CI
from attestry.operators import dialog as K
from attestry.operators import evaluate as E
from attestry.operators import fusion, layout, lexical, scope
from attestry.operators import sessions as W
from attestry.params import PII_ORDER_PARITY, Params


def val(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def s(text):
    return F.lit(text)


@pytest.mark.parametrize("fn,text,want", [
    (lambda c: N.norm_numbers(c, True), "2024-01-05", "2,024-01-05"),
    (N.norm_numbers, "2024-01-05", "2024-01-05"),
    (N.norm_numbers, "1234567 and 12 and 1/2", "1,234,567 and 12 and 0.5"),
    (lambda c: N.norm_dates(c, True), "2024.1.5", "202024-01-05"),
    (N.norm_dates, "2024.1.5", "2024-01-05"),
    (N.norm_dates, "2024년 1월 15일, 24.1.5", "2024-01-15, 2024-01-05"),
    (N.norm_dates, "10.0.0.1", "10.0.0.1"),
    (lambda c: N.norm_currency(c, True), "1,000원", "1,0원"),
    (N.norm_currency, "1,000원 2000 원", "1,000원 2,000원"),
    (lambda c: N.norm_currency(c, True), "5십억원", "5십100,000,000원"),
    (N.norm_currency, "5십억원", "5,000,000,000원"),
    (N.norm_law_refs, "제 3 조제 2 항", "제3조 제2항"),
    (N.norm_punct, "가。。 나 ， ？", "가. 나 ，?"),
    (N.clean_for_index, "a​b\tc\u0007", "ab c"),
    (N.clean_for_index, "x\n\n\n\n\ny", "x\n\n\ny"),
    (N.strip_sections, "a<think>b</think>c[think]d[/think]", "ac"),
    (lambda c: X.mask_pii(c, PII_ORDER_PARITY), "900101-1234567", "[전화번호]567"),
    (X.mask_pii, "900101-1234567", "[주민등록번호]"),
    (lambda c: X.mask_pii(c, PII_ORDER_PARITY), "1234-5678-1234-5678", "1[전화번호]-5678"),
    (X.mask_pii, "1234-5678-1234-5678", "[카드번호]"),
    (N.norm_whitespace, "예산 10 억", "예산10억"),
    (N.normalise_query, "예산 은 무엇 인가요?", "예산"),
    (T.strip_particles, "부산에서", "부산"),
    (lambda c: N.expand_terms(c), "이 지침 참고", "이 지침서 참고"),
])
def test_text_rules(spark, fn, text, want):
    assert val(spark, fn(s(text))) == want


def test_numerals(spark):
    assert val(spark, X.numeral_value(s("삼백"))) == 300
    assert val(spark, X.numeral_value(s("오만"))) == 50000


def test_unicode(spark):
    assert val(spark, N.norm_unicode("NFC")(s("가"))) == "가"
    assert val(spark, N.norm_doc_id(s("가.pdf"), nfc=True)) == "가"


def test_measures(spark):
    assert val(spark, S.ngram_jaccard(s("night"), s("nacht"))) == pytest.approx(1 / 7)
    a, b = "디지털 전환 예산이 증액되었습니다.", "디지털 전환 예산이 10% 증액되었습니다."
    assert val(spark, S.token_jaccard(s(a), s(b))) == pytest.approx(4 / 5)
    assert val(spark, S.token_f1(s("a b b c"), s("b b d"))) == pytest.approx(0.571429, abs=1e-6)
    assert val(spark, S.token_f1(s("."), s("!"))) == 1.0
    assert val(spark, S.token_f1(s("a"), s("!"))) == 0.0
    kws = F.array(s("budget"), s("2024"))
    assert val(spark, S.keyword_relevance(kws, s("the budget of 2024 rose"))) == pytest.approx(0.713636, abs=1e-6)
    # 5 union words, 2 shared; two of the three long words occur
    assert val(spark, S.content_similarity(s("aaa bbb ccc"), s("aaa bbb dd e"))) == pytest.approx(0.6 * 2 / 5 + 0.4 * 2 / 3)
    span = lambda d, x, y: F.array(F.struct(s(d).alias("doc_id"), F.lit(x).alias("start"), F.lit(y).alias("end")))
    assert val(spark, E.citation_iou(span("d", 150, 250), span("d", 200, 280))) == pytest.approx(50 / 130)
    assert val(spark, E.citation_iou(span("d", 150, 250), span("e", 200, 280))) == 0
    assert val(spark, T.char_entropy(s("banana"))) == pytest.approx(1.459148, abs=1e-6)
    assert val(spark, T.char_diversity(s("banana"))) == 0.5
    assert val(spark, T.char_entropy(s("예술촌"))) == pytest.approx(math.log2(3))


def test_bm25_values(spark):
    docs = spark.createDataFrame([("d1", "alpha beta alpha"), ("d2", "beta gamma"), ("d3", "gamma gamma gamma delta")], "chunk_id string, text string")
    idx = lexical.build_lexical_index(docs.withColumn("doc_id", F.col("chunk_id")))
    q = spark.createDataFrame([(1, "alpha gamma"), (2, "d2")], "query_id int, text string")
    rows = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_topk(q, idx, 5).collect()}
    assert rows[1, "d1"] == pytest.approx(1.932515, abs=1e-6)
    assert rows[1, "d3"] == pytest.approx(1.466667, abs=1e-6)
    assert rows[1, "d2"] == pytest.approx(1.157895, abs=1e-6)
    assert rows[2, "d2"] == 1.0  # a document id in the query


def test_rrf_values(spark):
    mk = lambda ids: spark.createDataFrame([(1, i, i, r) for r, i in enumerate(ids, 1)], "query_id int, chunk_id int, doc_id int, rank int")
    got = {r.chunk_id: r.rrf_score for r in fusion.rrf([mk([1, 2, 3]), mk([2, 3, 4])]).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in {2: .013009, 3: .012801, 1: .006557, 4: .006349}.items()}
    swapped = {r.chunk_id: r.rrf_score for r in fusion.rrf([mk([2, 3, 4]), mk([1, 2, 3])]).collect()}
    assert swapped == got


def test_filter_and_diversity(spark):
    hits = spark.createDataFrame(
        [(1, 1, 10, .0061, .2), (1, 2, 10, .0059, .2), (1, 3, 11, .001, .5), (2, 4, 12, .002, .1), (2, 5, 12, .003, .1), (2, 6, 13, .001, .1)],
        "query_id int, chunk_id int, doc_id int, rrf_score double, keyword_relevance double")
    kept = fusion.relevance_filter(hits)
    assert sorted((r.chunk_id, r.include_reason) for r in kept.collect()) == [
        (1, "hybrid"), (3, "strong_keyword"), (4, "emergency_fallback"), (5, "emergency_fallback")]
    order = [(r.query_id, r.chunk_id) for r in fusion.diversify(kept, 10).orderBy("query_id", "position").collect()]
    assert order == [(1, 1), (1, 3), (2, 5), (2, 4)]


def test_chunks(spark):
    tokens = [5, 5, 5, 12, 3]
    lines = F.array(*[s("x" * 3 * t) for t in tokens])
    got = spark.range(1).select(F.explode(C.fold_blocks(lines, 10)).alias("c")).select("c.*").collect()
    assert [r.blocks for r in got] == [2, 1, 1, 1] and [r.tokens for r in got] == [10, 5, 12, 3]
    blocks = spark.createDataFrame([("d", 1, i, "x" * 3 * t, i * 10, i * 10 + 9) for i, t in enumerate(tokens)],
                                   "doc_id string, page int, ordinal int, text string, start_char bigint, end_char bigint")
    rows = C.chunk_blocks(blocks, 10).orderBy("chunk_no").collect()
    assert [len(r.text.split("\n")) for r in rows] == [2, 1, 1, 1] and rows[0].end_char == 29
    paras = blocks.drop("page").withColumn("structure_type", F.lit(None).cast("string"))
    over = C.chunk_paragraphs(paras, 10, 256).orderBy("chunk_no").collect()
    assert [len(r.text.split("\n")) for r in over] == [2, 2, 2, 2]
    kinds = ["article", "item", None, "article", None, None, None, None, None, None, None]
    g = C.group_paragraphs(spark.createDataFrame([("d", i, k) for i, k in enumerate(kinds)], "doc_id string, ordinal int, structure_type string"))
    assert [r.group_no for r in g.orderBy("ordinal").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 2, 2]
    assert val(spark, C.table_text(F.array().cast("array<array<string>>"), s("c"))) == "[빈 표]"
    assert val(spark, C.table_text(F.array(F.array(s("a"), s("b"))), s("c"))) == "[표: c]\na | b"


def test_backlinks(spark):
    rows = [("d", "d-chunk-0", 0, "content", "[표] x [1] [표] [7]"), ("d", "d-table-1", 1, "table", "t"), ("d", "d-footnote-2", 2, "footnote", "f")]
    out = C.add_backlinks(spark.createDataFrame(rows, "doc_id string, chunk_id string, ordinal int, type string, text string"))
    assert out.where("type = 'content'").first().text == "[→d-table-1] x [→d-footnote-2] [표] [7]"


def test_bullets_and_units(spark):
    assert val(spark, C.split_bullets(s("머리\n○ 첫째 항목입니다\n내용\n ○ 짧\n○ 둘째 항목입니다"))) == ["○ 첫째 항목입니다\n내용", "○ 둘째 항목입니다"]
    long = "A" * 100 + ". " + "B" * 100
    assert val(spark, C.evidence_units(s(f"short\n\n{long}"))) == ["short", "A" * 100 + ".", "B" * 100]


def test_layout_values(spark):
    got = val(spark, layout.strip_suffix_terms(s("축제 준비 문화예술과 총무과")))
    assert (got["title"], got["removed"]) == ("축제 준비", ["문화예술과", "총무과"])
    rows = spark.createDataFrame([("d", 1, "시설관 리사업소")], "doc_id string, page int, text string")
    names = spark.createDataFrame([("시설관리사업소",), ("총무과",)], "name string")
    assert [r.name for r in layout.match_ngrams(rows, names).collect()] == ["시설관리사업소"]
    lines = spark.createDataFrame([("d", 1, 1.0, 1.0, "구청장 지시사항"), ("d", 1, 10.0, 10.0, "앞"), ("d", 1, 20.0, 20.0, "○ 제목"), ("d", 1, 30.0, 30.0, "- 3 -"),
                                   ("d", 1, 40.0, 40.0, "본문"), ("d", 1, 40.0, 40.0, "본문")], "doc_id string, page int, y0 double, y_center double, text string")
    assert [r.text for r in layout.filter_lines(lines).orderBy("y0").collect()] == ["○ 제목", "본문"]
    page = spark.createDataFrame([("d", 1, 500.0, 700.0)], "doc_id string, page int, width double, height double")
    heads = ["일련", "번호", "지시", "사항", "처리", "기한", "주관"]
    words = spark.createDataFrame([("d", 1, 60.0 * i, 10.0, 60.0 * i + 20, 20.0, t) for i, t in enumerate(heads)],
                                  "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert layout.column_edges(words, page, mode="header").first().edges == [40.0, 100.0]


def test_entities_and_clusters(spark):
    rows = [(1, 0, i, w) for i, w in enumerate(["홍티예술촌", "홍티예술촌에", "홍티예술촌의", "부산시청"])]
    e = spark.createDataFrame(rows, "session_id int, seq int, word_no int, entity string")
    assert [r.canonical for r in K.cluster_variants(e).orderBy("cluster_no").collect()] == ["홍티예술촌", "부산시청"]
    assert val(spark, K.append_summary(s("a"), s("b"))) == "a || b"


def test_citation_numbers(spark):
    r = spark.createDataFrame([(1, "x [3] y [1] z [3]", ["f [12]", "g [문서 1, 116]"], "")], "response_id int, answer string, key_facts array<string>, details string")
    out = CI.renumber_citations(r)
    row = out.first()
    assert row.answer == "x [1] y [2] z [1]" and row.key_facts == ["f [3]", "g [2]"]
    assert {(t.old_no, t.new_no) for t in CI.citation_table(out).collect()} == {(3, 1), (1, 2), (12, 3)}
    assert val(spark, CI.drop_invalid_citations(s("a [1] b [2]"), F.array(s("1")))) == "a [1] b"
    ev = spark.createDataFrame([(1, 1, 10, 1, "alpha beta gamma delta"), (1, 2, 11, 1, "one two three four")], "response_id int, rank int, doc_id int, page int, text string")
    a = spark.createDataFrame([(1, "one two three\nnothing here\n1.[9] alpha beta")], "response_id int, answer string")
    assert CI.insert_citations(a, ev).first().answer == "one two three[1]\nnothing here\n1.[2] alpha beta"


def test_two_stage_values(spark):
    hits = spark.createDataFrame([(1, 1, 1, .5), (1, 2, 2, .61), (2, 3, 3, .4)], "query_id int, chunk_id int, doc_id int, score double")
    ctx = spark.createDataFrame([(1, 1), (2, 3)], "query_id int, doc_id int")
    d = {r.query_id: r for r in scope.two_stage_decision(scope.two_stage_flags(hits, ctx)).collect()}
    assert d[1].changed and d[1].margin == pytest.approx(.035) and not d[2].changed
    assert [r.doc_id for r in scope.two_stage(hits, ctx).where("query_id = 1").orderBy("position").collect()] == [2, 1]


def test_titles(spark):
    assert val(spark, W.keyword_title(s("지역 문화정책 지원계획 알려줘"))) == "문화정책 지원계획"
    assert val(spark, W.keyword_title(s("안녕"))) == "새 대화"


def test_parity_params():
    assert Params().rrf_k == 60 and Params(parity=True).parity


def test_title_and_body(spark):
    got = val(spark, X.split_title_body(s("○ 제목\n첫 문장. 둘째 문장\n셋째")))
    assert (got["title"], got["body"]) == ("제목", "- 첫 문장.\n둘째 문장 셋째")
    assert val(spark, X.split_title_body(s("○ 제목")))["body"] == ""
    assert val(spark, X.page_category(s("a\n훈 시\nb"))) == "훈시"


def test_suffix_names_of_a_long_text(spark):
    """Only the end is searched: the time does not grow with names times characters."""
    import time

    body = "가나 다라 " * 300_000
    spark.range(1).select(layout.strip_suffix_terms(s("x 총무과"))).collect()
    began = time.time()
    got = val(spark, F.struct(F.length(layout.strip_suffix_terms(F.repeat(s("가나 다라 "), 300_000))["title"]).alias("n"),
                              layout.strip_suffix_terms(F.concat(F.repeat(s("가나 다라 "), 300_000), s("감사실  총무과 \r\n ")))["removed"].alias("removed")))
    assert (got["n"], got["removed"]) == (len(body), ["감사실", "총무과"]) and time.time() - began < 8


def test_words_take_one_pass(spark):
    """Before, punctuation was written over with spaces first, a second pass over each text."""
    from attestry.functions.tokens import words

    texts = ["A-b c_d\te f g 가,나 x1.²y", "", "--", "né́!Q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    two = F.regexp_extract_all(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}_\s]", " "), F.lit(r"\S+"), F.lit(0))
    assert all(r.a == r.b for r in df.select(words(F.col("t")).alias("a"), two.alias("b")).collect())
    assert "regexp_replace" not in df.select(words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()

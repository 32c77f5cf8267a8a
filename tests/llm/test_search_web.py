import random

import duckdb
import pytest

from attestry.llm import decontaminate, htmltext, maxscore, urltrust
from attestry.llm.queries import OP2_SQL


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1], 0) for i in range(25)]  # ties
    rows += [(2000, None, 0), (2020, [0.1, None], 0), (2040, [float("nan"), 0.2], 0), (2060, [float("inf")], 0), (None, [0.1] * 12, 0), (2080, [0.9, -0.4], 0), (2100, [], 0), (7, rows[7][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k):
    import math

    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sound if i % 20 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_top_k_equals_brute_force(vectors, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    for size in ((4096, 512, 512), (50, 20, 4)):
        for name, value in zip(("SHARD", "RUN", "BLOCK"), size):
            monkeypatch.setattr(maxscore, name, value)
        got = {tuple(r) for r in maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()}
        assert got == brute(rows, 20)


def test_few_and_no_candidates(spark, vectors):
    two = vectors.where("vec_id in (20, 21)")
    assert [(r.query_id, r.rank, r.vec_id) for r in maxscore.top_k(two, two.where("vec_id = 20")).collect()] == [(20, 1, 21)]
    none = vectors.limit(0)
    assert maxscore.top_k(none, none).collect() == [] and maxscore.top_k(vectors, none).collect() == []


LEAKS = [
    (1, "The train leaves Berlin at 9 and covers 120 km before it reaches the station in Berlin again after 3 hours of travel."),
    (2, "A small farmer keeps some sheep in a field and sells the wool to every neighbour in spring."),
    (3, "too short"), (4, None), (None, "The train leaves somewhere and nobody knows where it has gone to today.")]


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame(LEAKS, "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Intro words here. the train leaves Madrid at 7 and covers 95 km before it reaches the station in Madrid again after 2 hours of travel. More."),
        (2, "the train leaves Madrid at 7 and covers 95 km before it reaches the station in Lisbon again after 2 hours of travel."),  # one name, two values
        (3, "Quite different text about nothing at all that stands in no list of questions whatsoever."),
        (4, "x y z A small farmer keeps some sheep in a field and sells the wool to every neighbour in spring. end"),
        (5, None), (6, ""), (7, "too short"), (None, LEAKS[1][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert [got[i].item_ids for i in (1, 2, 3, 4, None)] == [[1], [], [], [2], [2]]
    assert not any(got[i].contaminated for i in (5, 6, 7)) and len(got) == 8
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_decontamination_odd_rows(odd_docs, spark):
    bench = spark.createDataFrame([(1, odd_docs.where("doc_id = 1").first().text)], "item_id long, text string")
    out = decontaminate.contamination(odd_docs, bench).collect()
    assert len(out) == odd_docs.count() and {r.doc_id for r in out if r.contaminated} == {1}


def test_items_without_literal_windows_match_verbatim(spark):
    names = "List the rivers Donau Rhein Elbe Oder Weser Main Neckar Mosel Saar Isar Inn Lech Iller Spree Havel"
    shout = "WHICH OF THESE SENTENCES IS WRITTEN IN CAPITALS FROM ITS BEGINNING TO ITS END"
    sums = "12 + 30 = 42 7 * 6 = 42 50 - 8 = 42 84 / 2 = 42"
    passage = "昔々あるところにおじいさんとおばあさんが住んでいました"
    bench = spark.createDataFrame([(1, names), (2, shout), (3, sums), (4, passage), (5, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, f"so {names.lower()} and more"), (2, f"It says: {shout}, or so."), (3, f"We have {sums} here"), (4, f"これは物語です。{passage}。終わり"),
        (5, "List the rivers Seine Loire Rhone Garonne Marne Oise Aisne Somme Meuse Yonne Cher Indre Vienne Creuse Allier"),
        (6, "山へ柴刈りに行きました。川へ洗濯に行きました。"), (7, "two words"), (8, sums.replace("42", "43")), (9, None)], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [], 7: [], 8: [], 9: []}


RENAMED = (
    "In the evening a tired baker named Smith counts every loaf on the long shelf beside the door because nobody told old Smith that bread is cheap.")


def test_one_changed_value_spoils_its_windows_only(spark):
    bench = spark.createDataFrame([(1, RENAMED), (2, "LIST ALL RIVERS OF THE WORLD THAT FLOW NORTH AND END THERE"), (3, "昔々あるところにおじいさん")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, RENAMED), (2, RENAMED.replace("old Smith", "old Jones")), (3, RENAMED.replace("Smith", "Jones")), (4, RENAMED.replace("named Smith", "named Miller").replace("old Smith", "old Jones")),
        (5, "so: list all rivers of the world that flow north and end there"), (6, "これは昔々あるところにおじいさん。"), (7, None), (7, "nothing of the kind")], "doc_id long, text string")
    out = decontaminate.contamination(docs, bench).drop("k1", "k2")
    got = {(r.doc_id, *r.item_ids): round(r.best_coverage, 3) for r in out.collect()}
    # 27 words, 20 windows: the second name (word 23) stands in 5 of them, the first (word 8) in 8
    assert got == {(1, 1): 1.0, (2, 1): 15 / 20, (3, 1): 1.0, (4,): 7 / 20, (5, 2): 1.0, (6, 3): 1.0, (7,): 0.0}
    db = duckdb.connect()
    for name, table in (("documents", docs), ("benchmark", bench)):
        db.register(name, table.toArrow())
    rows = db.sql(OP2_SQL).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in out.collect())


PAGE = (
    "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><div class='ad'>buy</div>"
    "<article><h1>Head&amp;Tail</h1><p><b>One<br>two<p>Thr&eacute;e &#65;</p><div class='share-box'>share</div><script>var x='<p>no</p>';</script></article>"
    "<section id='comments'><p>first!</p></section><!-- c --><footer>f</footer>")


def test_recurring_subtrees_inside_main(spark):
    """Menus and boxes that stand on many different pages of a host go, also inside main; copies of a page lose nothing."""
    menu = "<ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul><div><p>Write to us every day</p></div>"
    own = lambda i: "<p>Same opening line</p><h2>Summary</h2><ul><li>one<li>two</ul>" + "".join(f"<p>text {i} {j}</p>" for j in range(9))
    rows = [(i, f"http://a.org/{i}", f"<main>{menu}{own(i)}</main>") for i in range(6)]
    rows += [(10 + i, f"http://b.org/{i}", f"<main>{menu}<section>{own(0)}</section></main>") for i in range(6)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: "\n\n".join(["Same opening line", "Summary", "one", "two", *(f"text {i} {j}" for j in range(9))])
    assert [got[i] for i in range(6)] == [text(i) for i in range(6)]
    assert {got[i] for i in range(10, 16)} == {"Alpha\n\nBeta\n\nWrite to us every day\n\n" + text(0)}


def test_main_text():
    assert htmltext.main_text(htmltext.parse(PAGE), set()) == "Head&Tail\n\nOne two\n\nThrée A"
    of = lambda page: htmltext.main_text(htmltext.parse(page), set())
    long = "word " * 60
    assert of(f"<body><div class='page no-sidebar'><p>{long}</p></div></body>") == long.strip()
    assert of(f"<body><form id=f><div><p>{long}</p><input><button>go</button></div></form></body>") == long.strip()
    assert of(f"<main><form><p>{long}</p></form></main>") == long.strip()
    assert of(f"<body><form><p>Your name</p></form><p>{long}</p></body>") == long.strip()
    assert of(f"<main><article><p>{long}</p></article><article class='comment'><p>first</p></article></main>") == long.strip()
    assert of(f"<section class='comments'><article>{'noise ' * 200}</article></section><article><p>{long}</p></article>") == long.strip()
    assert of(f"<aside><article class='teaser'>read on</article></aside><div class='comment-list'>a</div><article><p>{long}</p></article>") == long.strip()
    assert of(f"<div class='layout-sidebar'><article><p>{long}</p></article><div class='sidebar-left'>x</div></div>") == long.strip()
    assert of(f"<article class='post comments-open'><p>{long}</p></article>") == long.strip()
    assert of("<nav>a</nav><div class='cookie-consent'>we use cookies</div>") == ""
    for broken in ("", "plain", "<", "<p", "<p>a<p>b</i>", "<script>x", "<!-- x", "</div></p>", "<div><p>a</div>b"):
        htmltext.main_text(htmltext.parse(broken), set())
    assert htmltext.main_text(htmltext.parse("<div><p>a</div>b"), set()) == "a\n\nb"
    deep = "<div>" * 5000 + "x"
    assert htmltext.main_text(htmltext.parse(deep), set()) == "x"


def test_site_templates_go_and_article_text_stays(spark):
    body = "<body><div class=top>Our shop is the best</div><div class=text><p>Own text {i} of this page.</p></div><p>Same line everywhere</p></body>"
    rows = [(i, f"http://a.example/{i}", body.format(i=i)) for i in range(8)] + [(100, "http://b.example/1", body.format(i=100)), (101, None, None), (102, "x", "")]
    rows += [(200 + i, f"http://c.example/{i}", "<article><p>Same line everywhere</p></article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as key", "'r' as row", "'h' as host")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert all(got[i] == f"Own text {i} of this page." for i in range(8))
    assert got[100] == "Our shop is the best\n\nOwn text 100 of this page.\n\nSame line everywhere"
    assert got[101] == got[102] == "" and all(got[200 + i] == "Same line everywhere" for i in range(6))
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_hosts_paths_and_rules(spark):
    urls = {
        "https://Ex.ORG/a?b#c": ("ex.org", "/a", "org/"), "http://example.org/es/x": ("example.org", "/es/x", "example.org/es/"), "x": ("", "", None),
        None: ("", "", None), "http://a.com?x/y": ("a.com", "", None), "http://a.com/fr/1": ("a.com", "/fr/1", "com/fr/"), "ftp://www.example.org/en/12": ("www.example.org", "/en/12", "example.org/en/1"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/"), "http://h#a://b/c": ("h", "", None), "http://forum/": ("forum", "/", None), "a://b://c/d": ("b:", "//c/d", None)}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urltrust.judge(pages).collect()}
    for i, (host, path, rule) in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == ("block" if rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")
    assert urltrust.judge(pages.limit(0)).collect() == []


def test_trust_and_distrust_flow(spark):
    a = "<a href='{}'>x</a>"
    rows = [
        (1, "http://good.org/", a.format("http://friend.net/x") + a.format("/own")), (2, "http://bad.com/de/1", a.format("http://innocent.net/")),
        (3, "http://friend.net/1", None), (4, "http://shady.net/1", a.format("http://BAD.com/de/2") + a.format("//bad.com/q")), (5, "http://innocent.net/1", ""),
        (6, "http://behind.net/", a.format("http://shady.net/"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urltrust.judge(pages).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["allow", "block", "allow", "block", "allow", "block"]
    # the same by plain iteration
    links = {("good.org", "friend.net"): 1, ("bad.com", "innocent.net"): 1, ("shady.net", "bad.com"): 2, ("behind.net", "shady.net"): 1}
    for seed, edges, name in (("good.org", links, "trust"), ("bad.com", {(d, s): n for (s, d), n in links.items()}, "distrust")):
        rank = {seed: 1.0}
        for _ in range(urltrust.ROUNDS):
            new = {seed: 1 - urltrust.DAMPING}
            for (s, d), n in edges.items():
                total = sum(m for (x, _), m in edges.items() if x == s)
                new[d] = new.get(d, 0) + urltrust.DAMPING * rank.get(s, 0) * n / total
            rank = new
        for r in got.values():
            assert r[name] == pytest.approx(rank.get(r.host, 0))


def test_small_shares_and_long_ways_are_judged(spark):
    """70,000 blocked pages, one of them of a host to which a host has one link of 2,001; a chain of 15 hosts behind it."""
    a = "<a href='http://{}/'>x</a>"
    rows = [(1, "http://seed.com/de/1", ""), (2, "http://many.net/", a.format("seed.com") * 2000), (3, "http://one.net/", a.format("seed.com"))]
    rows += [(10 + i, f"http://h{i}.net/", a.format(f"h{i - 1}.net" if i else "one.net")) for i in range(15)]
    rows += [(4, "http://good.org/", a.format("friend.net")), (5, "http://friend.net/", None), (6, "http://alone.net/", "")]
    rest = spark.range(1000, 71_000).selectExpr("id as page_id", "concat('http://s', id % 7, '.com/de/', id) as url", "cast(null as string) as html")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(rest)
    got = {r.page_id: r for r in urltrust.judge(pages).where("page_id < 1000").collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, *range(10, 25)}
    want = 0.15 / 70_001
    for i, share in ((1, 1), (3, 1 / 2001), *((10 + i, 1) for i in range(15))):
        want *= share * (0.85 if i > 1 else 1)
        assert got[i].distrust == pytest.approx(want)

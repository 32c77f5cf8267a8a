import hashlib
import random
import re
import tempfile

import pytest

from attestry.llm import digests
from tests.llm.conftest import sentence

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and the number of kept rows of each text."""
    groups = {}
    for i, text in rows:
        groups.setdefault(WHITE.sub("", text or ""), []).append((-len(text or ""), i is None, i))
    best = {k: min(v, key=lambda g: (g[0], g[1], g[2] or 0))[2] for k, v in groups.items()}
    sha = {k: hashlib.sha256(k.encode()).hexdigest() for k in groups}
    return sorted((str(i), str(best[k]), len(groups[k]), sha[k]) for i, t in rows for k in [WHITE.sub("", t or "")])


def judged(df):
    rows = df.collect()
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows), rows


def folder():
    return tempfile.mkdtemp(prefix="digests-", dir="/tmp") + "/index"


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [sentence(rng, rng.randint(1, 30)) for _ in range(20)]
    rows = [(n, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n", "\t\r\x0b\x0c", ""]))) for n in range(400)]
    rows += [(None, base[0]), (None, None), (7, None), (7, ""), (8, " \n"), (9, "a b"), (10, "ab"), (11, "a\x1fb"), (12, "é"), (12, "é"), (13, sentence(rng, 50000))]
    got, full = judged(digests.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows)
    texts = {r.text_sha256 for r in full}
    kept = [r for r in full if r.kept]
    assert len(kept) == len(texts) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    got, full = judged(digests.deduplicate(odd_docs))
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sum(r.kept for r in full) == len({r.text_sha256 for r in full})
    empty = digests.deduplicate(no_docs)
    assert empty.count() == 0 and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "known", "text_sha256"]


def test_later_batches(spark):
    """Batches against one index equal one pass in order: earlier batches win, whatever the later rows look like."""
    path = folder()
    first = digests.open_index(spark, path, 3)
    a = digests.admit(spark.createDataFrame([(5, "x y"), (6, "xy"), (7, "z")], "doc_id long, text string"), first, "a").collect()
    assert {(r.doc_id, r.keep_id, r.kept, r.known) for r in a} == {(5, 5, True, False), (6, 5, False, False), (7, 7, True, False)}
    first.close()
    again = digests.open_index(spark, path, 3)  # as a later session would
    batch = spark.createDataFrame([(1, "x  y"), (2, "new"), (3, "n ew"), (4, "z")], "doc_id long, text string")
    b = digests.admit(batch, again, "b").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.known) for r in b} == {(1, 5, 1, False, True), (2, 3, 2, False, False), (3, 3, 2, True, False), (4, 7, 1, False, True)}
    assert again.read().count() == 3
    repeat = digests.admit(batch, again, "b").collect()  # the same batch again, as after a crash
    assert sorted(map(str, repeat)) == sorted(map(str, b)) and again.read().count() == 3
    small = digests.compact(again, folder())
    assert sorted(map(str, small.read().collect())) == sorted(map(str, again.read().collect())) and len(small.read().inputFiles()) <= 3
    again.drop()
    small.drop()


def test_index_is_read_in_its_buckets(spark):
    """The anti-join is a sort-merge join and the index side is not shuffled."""
    index = digests.open_index(spark, folder(), 4)
    digests.admit(spark.createDataFrame([(n, f"t{n}") for n in range(50)], "doc_id long, text string"), index, "a")
    new = spark.createDataFrame([(b"x",)], "digest binary").repartition(4, "digest").hint("merge").join(index.read().select("digest"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    index.drop()


@pytest.mark.parametrize("n", [1, 5000])
def test_hot_text_is_looked_up_by_broadcast(spark, n):
    """A third and more of all rows alike; the rows are whole and only one of each text is kept."""
    rows = [(i, "same" if i % 2 else f"other {i}") for i in range(n)]
    got, full = judged(digests.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and sum(r.kept for r in full) == len({r.text_sha256 for r in full})

"""Containment join against plain substring search."""

import random

import pytest

from attestry.operators.containment import PART_BYTES, containing, kept_hashes


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_contains(spark, seed):
    """Passages of all lengths, cut inside words, without any word, with many-byte characters, and some that stand nowhere."""
    r = random.Random(seed)
    letters = "ab é한.,  \n"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.choice([0, 3, 40, 400, 3000])))) for i in range(60)] + [(60, None), (61, ""), (7, "repeated id ,,,")]
    passages = [(0, ""), (1, None), (2, ","), (3, " , "), (4, "nowhere at all"), (5, "é"), (6, "zzzz" * 50)]
    for i in range(7, 150):
        source = r.choice([t for _, t in texts if t])
        at = r.randrange(len(source))
        passages.append((i, source[at : at + r.choice([1, 2, 3, 5, 8, 17, 40, 64, 65, 130, 500])]))
    passages += [(7, passages[20][1]), (200, passages[30][1])]
    got = containing(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(passages, "passage_id int, text string"))
    want = {(t, p) for t, text in texts for p, passage in passages if text and passage and passage in text}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 150


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text_id long, text string")
    some = spark.createDataFrame([("a", "text")], "passage_id string, text string")
    assert containing(none, some).count() == 0
    assert containing(some.withColumnRenamed("passage_id", "text_id"), none.withColumnRenamed("text_id", "passage_id")).count() == 0


def test_parts_of_a_long_text_keep_every_window():
    r = random.Random(3)
    data = bytes(r.choice(b"abcdefgh ") for _ in range(PART_BYTES + 300))
    for at in (0, PART_BYTES - 70, PART_BYTES - 1, PART_BYTES, len(data) - 64):
        assert set(kept_hashes(data[at : at + 64], 6)) <= set(kept_hashes(data, 6))

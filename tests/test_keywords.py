"""Keyword tables as automata against a test of every keyword."""

import random

import pytest

from sievecrest.operators import textlines as TL

rnd = random.Random(3)
TEXTS = ["".join(rnd.choice("abcé 陨石") for _ in range(rnd.randint(0, 60))) for _ in range(120)] + [None, "", "ababab"]
WORDS = list({"".join(rnd.choice("abcé 陨") for _ in range(rnd.randint(1, 4))) for _ in range(150)})


def tables(spark, words):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    return docs, spark.createDataFrame(words, "keyword string, label int")


@pytest.mark.parametrize("most", [1 << 24, 40])
def test_automata_equal_single_tests(spark, most):
    words = [(w, len(w) % 2) for w in WORDS] + [(WORDS[0], 7), (WORDS[0], 7), ("", 3), (None, 4)]
    docs, table = tables(spark, words)
    got = [tuple(r) for r in TL.table_keyword_labels(docs, "doc_id", "text", table, most).collect()]
    want = {(i, w, y) for i, t in enumerate(TEXTS) if t is not None for w, y in words if w is not None and w in t}
    assert sorted(got) == sorted(want)
    few = [w for w in WORDS[:6]]
    listed = TL.keyword_labels(docs, "doc_id", "text", few[:3], few[3:]).collect()
    again = TL.table_keyword_labels(docs, "doc_id", "text", tables(spark, [(w, int(w in few[:3])) for w in few])[1]).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, again))


def test_large_table_takes_one_pass(spark):
    """A hundred thousand keywords, three of which occur."""
    docs, table = tables(spark, [(f"key{i:06d}", i) for i in range(100_000)])
    docs = docs.unionByName(spark.createDataFrame([(900, "xkey000007key099999y"), (901, "key05000 key050000")], docs.schema))
    got = TL.table_keyword_labels(docs, "doc_id", "text", table).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(900, 7), (900, 99_999), (901, 50_000)]


def test_detection_and_nothing(spark):
    lines = spark.createDataFrame([(1, "Me te-OR", 0.9), (2, "meteor", 0.1), (3, "rock", 0.9), (4, None, 0.9)], "id int, text string, score double")
    words = spark.createDataFrame([("Meteor",), (" - ",)], "keyword string")
    assert [r.id for r in TL.table_keyword_images(lines, "id", words, 0.5).collect()] == [1]
    assert TL.table_keyword_images(lines, "id", words.limit(0), 0.5).count() == 0

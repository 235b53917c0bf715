"""The stored passage index, set joins and what they promise about their plans."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import set_join
from inkspan.operators.passage_index import PassageIndex
from inkspan.operators.set_join import dice_pairs, similar_sets
from inkspan.operators.sparse import products


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def index(spark, tmp_path):
    rows = [(f"w{k % 300} x", k // 50, k % 50, k % 3 > 0) for k in range(600)] + [("every where", 99, 0, True)]
    return PassageIndex(spark, f"t{abs(hash(str(tmp_path))):x}").build(spark.createDataFrame(rows, "gram string, src long, j int, eligible boolean"), str(tmp_path), 8)


def test_index_finds_equal_windows(spark, index):
    rng = random.Random(1)
    windows = [(d, i, f"w{rng.randint(0, 3000)} x" if i else "every where") for d in range(400) for i in range(6)]  # one window in every document
    frame = spark.createDataFrame(windows, "doc_id long, i int, gram string")
    postings = {}
    for r in index.windows().collect():
        postings.setdefault(r.gram, []).append((r.src, r.j, r.eligible))
    expected = sorted((d, s, i, j, e) for d, i, g in windows for s, j, e in postings.get(g, []))
    assert sorted(map(tuple, index.hits(frame).collect())) == expected
    assert sorted(map(tuple, index.hits(frame, hot_key=50).collect())) == expected  # the common window is dealt out in parts
    assert len({r[0] for r in expected if r[1] == 99}) == 400
    likely = {r.gram for r in index.likely(frame).collect()}
    assert set(postings) & {g for _, _, g in windows} <= likely and len(likely - set(postings)) < 150


def test_index_is_not_shuffled(spark, index):
    frame = spark.createDataFrame([(1, 0, "w1 x")], "doc_id long, i int, gram string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(index.hits(frame))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in plan


def test_index_of_nothing_and_documents_of_nothing(spark, tmp_path, index):
    empty = PassageIndex(spark, "t_empty").build(spark.createDataFrame([], "gram string, src long, j int, eligible boolean"), str(tmp_path / "e"), 2)
    frame = spark.createDataFrame([(1, 0, "w1 x"), (None, 1, None)], "doc_id long, i int, gram string")
    assert empty.hits(frame).count() == 0 and index.hits(frame.limit(0)).count() == 0
    assert {r.doc_id for r in index.hits(frame).collect()} == {1}


@pytest.mark.parametrize("percent", [30, 60, 80, 100])
@pytest.mark.parametrize("hot_key", [3, 10_000])
def test_similar_sets_are_all_found(spark, percent, hot_key):
    rng = random.Random(percent)
    words = [f"w{k}" for k in range(14)]
    pick = lambda: rng.sample(words[: rng.choice([4, 14])], rng.randint(0, 4)) + ["the"] * (rng.random() < 0.8)
    left, right = [(i, pick()) for i in range(70)], [(i, pick()) for i in range(60)]
    frames = spark.createDataFrame(left, "a long, words array<string>"), spark.createDataFrame(right, "b long, words array<string>")
    expected = {}
    for (i, x), (j, y) in itertools.product(left, right):
        shared = len(set(x) & set(y))
        if shared and 200 * shared >= percent * (len(x) + len(y)):
            expected[i, j] = shared
    pairs = dice_pairs(*frames, percent, hot_key)
    assert "CartesianProduct" not in plan_of(pairs) and "NestedLoop" not in plan_of(pairs)
    own = [(tuple(r.left_words), tuple(r.right_words)) for r in pairs.collect()]
    assert len(own) == len(set(own)) and set(own) == {(tuple(sorted(dict(left)[i])), tuple(sorted(dict(right)[j]))) for i, j in expected}
    if hot_key > 3:
        found = similar_sets(*frames, ["a"], ["b"], percent).collect()
        assert {(r.a, r.b): r.shared for r in found} == expected and len(found) == len(expected)


def test_sets_of_nothing(spark):
    some = spark.createDataFrame([(1, ["x"]), (2, []), (3, None)], "a long, words array<string>")
    assert dice_pairs(some, some.filter("a > 1"), 50).count() == 0 == dice_pairs(some.limit(0), some, 50).count()
    assert [tuple(r) for r in similar_sets(some, some.select(F.col("a").alias("b"), "words"), ["a"], ["b"], 50).collect()] == [(1, 1, 1, 100.0)]


@pytest.mark.parametrize("few", [0, set_join.FEW])
def test_similar_sets_of_a_small_side_leave_the_other_in_place(spark, monkeypatch, few):
    rng = random.Random(8)
    draw = lambda: sorted({f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(0, 9))})
    a, b = [(i, draw()) for i in range(300)] + [(300, None)], [(i, draw()) for i in range(60)]
    left, right = spark.createDataFrame(a, "l long, words array<string>").repartition(3), spark.createDataFrame(b, "r long, words array<string>")
    monkeypatch.setattr(set_join, "FEW", few)
    if few:
        monkeypatch.setattr(set_join, "dice_pairs", None)  # its exchanges hold every word with its whole set
        kept = set_join.met_in_place(left, set_join.prefixed(right, 60), ["l"], 60)
        assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    found = {(r.l, r.r): (r.shared, r.dice) for r in set_join.similar_sets(left, right, ["l"], ["r"], 60).collect()}
    both = {(i, j): len(set(x) & set(y)) for i, x in a for j, y in b if x and y}
    sizes = {(i, j): len(x) + len(y) for i, x in a for j, y in b if x and y}
    assert found == {k: (n, round(200 * n / sizes[k] + 1e-9, 1)) for k, n in both.items() if 200 * n >= 60 * sizes[k]}


def test_texts_of_term_products_are_dealt_out_once(spark):
    left = spark.createDataFrame([(1, "a b b"), (1, "b c"), (2, None), (3, ""), (None, "a b"), (4, "z " * 3000 + "c")], "id int, text string")
    right = spark.createDataFrame([(10, "b c"), (11, "z a")], "id int, text string")
    found = products(left, right, "regexp_extract_all(text, '[a-z]+', 0)", lambda words, counts: counts * np.array([2.0 if w == "a" else 1.0 for w in words]), lambda dot, left, right: dot > 0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = {(r.left_id, r.right_id): (r.dot, r.left_square, r.right_square) for r in found.collect()}
    assert rows == {(1, 10): (4.0, 14.0, 2.0), (1, 11): (4.0, 14.0, 5.0), (4, 10): (1.0, 9000001.0, 2.0), (4, 11): (3000.0, 9000001.0, 5.0)}

import math

import pytest
from pyspark.sql import functions as F

from siftmill.llm.mixture import allocate, mix_sources, solve_rate

DOC, WEIGHT = "doc_id long, text string, source string, n_tokens long, copies long", "source string, target_weight double, max_repeats long"


def mix(spark, docs, weights, **kw):
    chosen, shares = mix_sources(spark.createDataFrame(docs, DOC), spark.createDataFrame(weights, WEIGHT), **kw)
    return [r.asDict() for r in chosen.collect()], {r.source: r.asDict() for r in shares.collect()}


def doc(i, source, words):
    return (i, " ".join(["word"] * words), source, None, None)


def test_allocation():
    assert allocate({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, None) == {"a": 10, "b": 10}
    assert allocate({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, 60) == {"a": 10, "b": 50}
    assert allocate({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5, "c": 0.3}, 1e9) == {"a": 10, "b": 100}
    assert allocate({}, {"a": 1.0}, None) == {} and allocate({"a": 5}, {"a": 0.0}, 9) == {}
    c = solve_rate([(1.0, 100), (4.0, 50)], 2, 180)
    assert math.isclose(100 * min(2, c) + 50 * min(2, 4 * c), 180)


@pytest.mark.parametrize("weight", [None, "log2(n_tokens + 2)"])
def test_shares_repeats_and_seed(spark, weight):
    weight = F.expr(weight) if weight else None
    docs = [doc(i, " Big-One", 5 + i % 40) for i in range(600)] + [doc(1000 + i, "small", 20) for i in range(12)] + [doc(2000 + i, "other", 9) for i in range(30)]
    weights = [("big_one", 3.0, 1), ("SMALL", 3.0, 4), ("none", 1.0, 2)]
    chosen, shares = mix(spark, docs, weights, weight=weight)
    assert all(r["source"] in ("big_one", "small") for r in chosen)
    assert all(1 <= r["copies"] <= (4 if r["source"] == "small" else 1) for r in chosen)
    assert abs(shares["big_one"]["actual_share"] - 0.5) < 0.005 and shares["small"]["actual_tokens"] == 4 * 12 * 20
    assert shares["none"]["actual_share"] == 0 and abs(shares["none"]["target_share"] - 1 / 7) < 1e-9
    again, _ = mix(spark, docs, weights, weight=weight)
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, chosen)) == sorted(map(key, again))
    other, _ = mix(spark, docs, weights, weight=weight, seed=5)
    assert sorted(map(key, chosen)) != sorted(map(key, other))


def test_total_beyond_capacity(spark):
    _, shares = mix(spark, [doc(i, "a", 10) for i in range(10)] + [doc(100 + i, "b", 10) for i in range(10)], [("a", 1.0, 1), ("b", 1.0, 3)], total_tokens=250.0)
    assert (shares["a"]["actual_tokens"], shares["b"]["actual_tokens"]) == (100, 150)


def test_inclusion_follows_weight(spark):
    docs = [doc(i, "a", 4 if i % 2 else 64) for i in range(2000)]
    chosen, _ = mix(spark, docs, [("a", 1.0, 1)], total_tokens=14_000.0, weight=F.col("n_tokens"))
    long = sum(r["n_tokens"] == 64 for r in chosen)
    short = len(chosen) - long
    assert 10 < long / max(short, 1) < 26  # sixteen times as likely


def test_dirt(spark):
    docs = [doc(1, None, 5), (2, None, "a", 0, 0), (3, "", "a", 0, 0), doc(4, "a", 5), doc(4, "a", 5), (None, "word word", "a", 0, 0), doc(5, "zz", 5)]
    chosen, shares = mix(spark, docs, [("a", 1.0, None), ("a", 1.0, 3), (None, 1.0, 1), ("b", None, 1), ("c", float("nan"), 1), ("d", -1.0, 1)])
    assert sorted((r["doc_id"] or 0, r["copies"]) for r in chosen) == [(0, 1), (4, 1)]
    assert shares["a"]["actual_share"] == 1.0 and set(shares) == {"a", "b", "c", "d"}
    assert mix(spark, [], [("a", 1.0, 1)])[0] == [] and mix(spark, docs, []) == ([], {})

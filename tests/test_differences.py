import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerquarry.operators.differences import assign, compare_copies, latest_per_key, transport
from pyspark.sql import functions as F

SCHEMA = "k string, a bigint, b string, diff string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_compare(spark):
    left = spark.createDataFrame([("1", 1, "x", "e"), ("1", 1, "x", "e"), ("2", 5, None, "e"), ("3", 7, "y", "e"), (None, 9, "z", "e")], SCHEMA)
    right = spark.createDataFrame([("1", 1, "x", "q"), ("2", 5, None, "q"), ("3", 8, None, "q"), (None, 9, "z", "q"), ("4", 0, "w", "q")], SCHEMA)
    got = rows(compare_copies(left, right, ["k"], ["a", "b"]).select("k", "diff", "n"))
    assert got == sorted([("1", "left_only", 1), ("3", "a", 1), ("3", "b", 1), ("4", "right_only", 1)], key=str)


def test_many_rows_of_one_key_pair_at_least_cost(spark):
    left = spark.createDataFrame([("k", 1, "x", ""), ("k", 2, "y", ""), ("k", 3, "z", "")], SCHEMA)
    right = spark.createDataFrame([("k", 1, "q", ""), ("k", 2, "r", "")], SCHEMA)
    assert rows(compare_copies(left, right, ["k"], ["a", "b"]).select("diff", "n")) == [("b", 2), ("left_only", 1)]


def test_large_keys_give_the_same_counts(spark):
    left = spark.createDataFrame([("k", i % 5, "x" if i % 2 else None, "") for i in range(40)], SCHEMA)
    right = spark.createDataFrame([("k", i % 4, "x", "") for i in range(38)], SCHEMA)
    exact = {r[0]: r[1] for r in rows(compare_copies(left, right, ["k"], ["a", "b"]).select("diff", "n"))}
    spread = {r[0]: r[1] for r in rows(compare_copies(left, right, ["k"], ["a", "b"], exact_group_rows=1).select("diff", "n"))}
    assert spread.get("left_only") == exact.get("left_only") == 2
    assert sum(v for k, v in exact.items() if k in "ab") <= sum(v for k, v in spread.items() if k in "ab")


def test_large_keys_pair_at_least_cost(spark):
    left = spark.createDataFrame([("k", 1, "A", ""), ("k", 1, "D", ""), (None, 5, None, "")] * 3, SCHEMA)
    right = spark.createDataFrame([("k", 1, "C", ""), ("k", 3, "A", ""), (None, 6, None, "")] * 3, SCHEMA)
    got = rows(compare_copies(left, right, ["k"], ["a", "b"], exact_group_rows=1).select("k", "diff", "n"))
    assert got == sorted([("k", "a", 3), ("k", "b", 3), (None, "a", 3)], key=str)


@given(st.integers(1, 3), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_transport_is_least(d, seed):
    rng = np.random.default_rng(seed)
    l, r = ([tuple(map(int, x)) for x in {tuple(y) for y in rng.integers(0, 4, size=(rng.integers(1, 9), d)).tolist()}] for _ in "lr")
    r = [x for x in r if x not in l]
    n, m = [int(x) for x in rng.integers(1, 4, len(l))], [int(x) for x in rng.integers(1, 4, len(r))]
    got = transport(l, r, n, m)
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert all(sum(c for i, _, c in got if i == k) <= n[k] for k in range(len(l))) and all(sum(c for _, j, c in got if j == k) <= m[k] for k in range(len(r)))
    a, b = sorted([[x for x, c in zip(l, n) for _ in range(c)], [x for x, c in zip(r, m) for _ in range(c)]], key=len)
    cost = np.array([[differ(x, y) for y in b] for x in a], dtype=float).reshape(len(a), len(b))
    assert sum(c for *_, c in got) == len(a)
    assert sum(c * differ(l[i], r[j]) for i, j, c in got) == (sum(cost[i, j] for i, j in assign(cost)) if a else 0)


def test_empty(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("1", 1, "x", "")], SCHEMA)
    assert rows(compare_copies(empty, empty, ["k"], ["a", "b"])) == []
    assert rows(compare_copies(one, empty, ["k"], ["a", "b"]).select("diff")) == [("left_only",)]
    assert rows(compare_copies(empty, one, ["k"], ["a", "b"]).select("diff")) == [("right_only",)]


def test_latest(spark):
    df = spark.createDataFrame([("1", 1, "x", ""), ("1", 2, "y", ""), ("1", 2, "z", "")], SCHEMA)
    assert rows(latest_per_key(df, ["k"], [F.col("a"), F.col("b")], ["a", "b"])) == [("1", 2, "z")]


@given(st.integers(1, 4), st.integers(0, 2), st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_assignment_is_least(n, more, seed):
    cost = np.random.default_rng(seed).integers(0, 5, size=(n, n + more)).astype(float)
    got = sum(cost[i, j] for i, j in assign(cost))
    assert got == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + more), n))

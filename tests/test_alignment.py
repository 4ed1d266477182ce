import random

from pyspark.sql import functions as F

from ledgerquarry.functions.text import jaccard, words
from ledgerquarry.operators import alignment


def greedy(rows):
    left, right, out = set(), set(), []
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a)), right.add((g, b)), out.append((g, a, b, s))
    return sorted(out)


def test_equals_greedy(spark):
    rng = random.Random(7)
    rows = [(g, a, b, round(rng.choice([0.5, 0.6, 0.7, 0.8]), 1)) for g in range(6) for a in range(5) for b in range(5) if rng.random() < 0.6]
    df = spark.createDataFrame(rows + rows[:3] + [(0, 9, 9, None)], "g int, a int, b int, s double")
    assert sorted(tuple(r) for r in alignment.greedy_pairs(df, "g", "a", "b", "s").collect()) == greedy(rows)
    assert alignment.greedy_pairs(df.where("false"), "g", "a", "b", "s").count() == 0


def test_lines_and_packets(spark):
    known = spark.createDataFrame([(1, 1, "red bolt"), (1, 2, "blue nut"), (1, 3, None)], "d int, n int, t string")
    read = spark.createDataFrame([(1, 7, "nut blue"), (1, 8, "red bolt big")], "d int, n int, t string")
    got = alignment.align_lines(known, read, "d", "n", jaccard(words(F.col("k_t")), words(F.col("r_t"))))
    assert sorted((r.k_n, r.r_n) for r in got.collect()) == [(1, 8), (2, 7)]
    truth = spark.createDataFrame([("a", [1, 2]), ("a", [3]), ("b", [1]), ("c", [1])], "f string, p array<int>")
    found = spark.createDataFrame([("a", [3]), ("a", [2, 1]), ("b", [1, 2])], "f string, p array<int>")
    assert {r.f: r.exact for r in alignment.exact_packets(truth, found, "f", "p").collect()} == {"a": True, "b": False, "c": False}


def test_many_equal_lines_all_pair(spark):
    rows = [(1, a, b, 0.9) for a in range(110) for b in range(110)] + [(1, a, 200, 0.95) for a in (3, 4)]
    df = spark.createDataFrame(rows, "g int, a int, b int, s double")
    assert sorted(tuple(r) for r in alignment.greedy_pairs(df, "g", "a", "b", "s").collect()) == greedy(rows)

import itertools
import random

from pyspark.sql import functions as F

from ledgerquarry.llm import canonical as C

ENTRIES = [(1, "Gorpoluford Fasteners Pty Ltd", ["GFX"]), (2, "Gorpoluford Haulage Inc", None), (3, "Brinnivuton Tool Company Pty Ltd", ["Zanluvuworth Direct"]), (4, "Norgapostead Steel Supply Pty Ltd", None), (5, "Norgapostead Steel Services Ltd", None), (6, None, None)]
NAMES = {
    "Gorpoluford Fasteners": 1, "GORPOLUFODR FASTENRS PTY LTD": 1, "gfx p/l": 1, "Gorp0luford Háulage - Depot 3": 2, "Fasteners, Gorpoluford": 1, "GorpolufordFasteners": 1, "Gorpoluford": -1, "Gorpoluford Catering Pty Ltd": -1,
    "Brinnivuton Tool Co": 3, "Zanluvuworth Direct": 3, "Brinnivuton": 3, "Norgapostead Steel": -1, "Norgapostead Steel Svcs": 5, "-": -1, "Please remit to": -1, "GFY": -1, "Sandlewood Farm - GFX": 1, "Nobody trading as Zanluvuworth Direct": 3, "The Brinnivuton Tool Comapny t/a Zanluvuworth Direct": 3, "x" * 5000: -1,
}


def entries(spark, rows=ENTRIES):
    return spark.createDataFrame(rows, "supplier_id bigint, name string, aliases array<string>")


def test_names(spark):
    rows = [(i, n, "e") for i, n in enumerate([*NAMES, None, "", "  "])] + [(0, "Gorpoluford Fasteners", "e")]
    df = spark.createDataFrame(rows, "read_id bigint, supplier_name string, entry_id string")
    got = [(r.read_id, r.entry_id) for r in C.map_names(df, "read_id", "supplier_name", entries(spark), "supplier_id", "name", "aliases").collect()]
    assert sorted(got) == sorted([(i, w) for i, w in enumerate(NAMES.values())] + [(0, 1)])


def test_empty_list_and_table(spark):
    df = spark.createDataFrame([(1, "Gorpoluford Fasteners")], "read_id bigint, supplier_name string")
    assert [r.entry_id for r in C.map_names(df, "read_id", "supplier_name", entries(spark, []), "supplier_id", "name", "aliases").collect()] == [-1]
    assert C.map_names(df.where("false"), "read_id", "supplier_name", entries(spark), "supplier_id", "name", "aliases").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_deletion_forms_meet_within_two_edits(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    meet = df.select("a", "b", F.arrays_overlap(C.deletion_forms(F.col("a"), F.lit(2)), C.deletion_forms(F.col("b"), F.lit(2))).alias("m")).collect()
    assert all(r.m for r in meet if distance(r.a, r.b) <= 2) and sum(distance(*p) <= 2 for p in pairs) > 50
    one = spark.range(1).select(F.size(C.deletion_forms(F.lit("abcd"), F.lit(0))).alias("a"), F.size(C.deletion_forms(F.lit("abcd"), F.lit(1))).alias("b"), F.size(C.deletion_forms(F.lit("abcd"), F.lit(2))).alias("c")).collect()[0]
    assert tuple(one) == (1, 5, 11)


def test_repair_equals_brute_force(spark):
    vocabulary = [("gorpoluford", False), ("haulage", True), ("hire", True), ("gfx", False)]
    tokens = ["gorpolufrod", "gorpoluforda", "haulge", "hrie", "hre", "gfy", "gfx", "hlg", "unrelated", "g0rpoluford"]
    got = {(r.token, r.word) for r in C.repair_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), vocabulary).collect()}
    assert got == {("gorpolufrod", "gorpoluford"), ("gorpoluforda", "gorpoluford"), ("g0rpoluford", "gorpoluford"), ("haulge", "haulage"), ("hlg", "haulage"), ("hrie", "hire"), ("hre", "hire"), ("gfx", "gfx")}
    assert not [p for p in itertools.product(["gfy"], ["gfx"]) if p in got]

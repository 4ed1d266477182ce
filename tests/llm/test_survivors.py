from datetime import datetime

from ledgerquarry.llm import survivors as S

READS = "read_id bigint, doc_type string, status string, received_at timestamp, reader string, doc_number string, value string"
VALUES = "read_id bigint, field_name string, value string, confidence double, evidence string, source string"


def t(d):
    return datetime(2026, 1, d)


def test_order_of_trust(spark):
    reads = spark.createDataFrame(
        [(1, "inv", "read", t(1), "a", "X-200 000 001", ""), (2, "inv", "read", t(2), "b", "X200000001", ""), (3, "inv", "held", t(3), "c", "x/200000001", ""), (4, "inv", "duplicate", t(4), "d", "200000001", ""), (5, "inv", "read", t(1), "a", "200000009", ""), (6, "cn", "read", t(1), "a", "200000001", ""), (7, None, "read", t(1), "a", "200000001", ""), (8, "inv", None, None, "a", None, "")], READS)
    values = spark.createDataFrame(
        [(1, "total", "5", 0.9, "label", "a"), (1, "total", "5", 0.9, "label", "a"), (2, "total", "6", None, "master", "b"), (4, "total", "7", 1.0, "master", "d"), (1, "date", "", 0.9, "master", "a"), (3, "date", "x", 0.1, "", "c"), (1, "gst", "1", 0.5, None, "a"), (2, "gst", "2", 0.5, "none", "b"), (4, "only", "z", 1.0, "master", "d"), (5, "total", "9", 1.0, "master", "a"), (8, "total", "9", 1.0, "master", "a"), (1, None, "9", 1.0, "master", "a")], VALUES)
    got = {r.field_name: r.read_id for r in S.surviving_readings(reads, values).collect()}
    assert got == {"total": 2, "date": 3, "gst": 2}
    assert S.surviving_readings(reads.where("false"), values).count() == 0
    assert S.surviving_readings(reads, values.where("false")).count() == 0


def test_copied_votes_count_less(spark):
    claims, naive = [], 0
    for i in range(120):
        honest = [f"t{i}" if (i + k) % n else f"{k}{i}" for k, n in ((1, 4), (2, 5), (3, 6), (4, 7))]
        claims += [(i, s, v) for s, v in zip("abeg", honest)]
        wrong = f"w{i}" if i % 2 else f"t{i}"
        claims += [(i, s, wrong) for s in "cdf"]
        votes = [*honest, *[wrong] * 3]
        naive += max(sorted(set(votes)), key=votes.count) == f"t{i}"
    df = spark.createDataFrame(claims + [(None, "a", "x"), (1, None, "x"), (1, "a", None), (1, "a", "t1")], "item bigint, source string, value string")
    got = {r.item: r.value for r in S.fuse(df).collect()}
    right = sum(got[i] == f"t{i}" for i in range(120))
    assert right >= 114 and right > naive
    assert S.fuse(df.where("false")).count() == 0


def test_every_reading_of_a_channel_votes(spark):
    reads = spark.createDataFrame([(i, "inv", "read", t(1), "r", f"20000000{i // 10}", "") for i in (10, 11, 12, 20, 21, 22, 23)], READS)
    values = spark.createDataFrame([(10, "total", "a", 0.9, "", "ubl"), (11, "total", "z", 0.9, "", "ubl"), (12, "total", "z", 0.9, "", "ubl"), (12, "total", "z", 0.9, "", "ubl"), *[(i, "total", v, 0.9, "", s) for i, v, s in ((20, "a", "ubl"), (21, "z", "ubl"), (22, "m", "csv"), (23, "z", "csv"))]], VALUES)
    got = {r.number_key: (r.value, r.n_sources, r.posterior) for r in S.fused_readings(reads, values).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"200000001": ("z", 1), "200000002": ("z", 2)}
    assert all(0.5 < v[2] < 1 for v in got.values())


def test_values_of_any_script_survive_as_printed(spark):
    reads = spark.createDataFrame([(i, "inv", "read", t(1), "r", "200000001", "") for i in (1, 2, 3)], READS)
    names = ("Müller & Söhne", "Muller & Söhne", "Wirth GmbH")
    kanji = ("東京商店", "大阪商店", "東京商店")
    values = spark.createDataFrame([(i, "supplier_name", n, 0.9, "", f"s{i}") for i, n in enumerate(names, 1)] + [(i, "a|b", n, 0.9, "", f"s{i}") for i, n in enumerate(kanji, 1)] + [(i, "signs", "***", 0.9, "", f"s{i}") for i in (1, 2)], VALUES)
    got = {r.field_name: (r.value, r.n_sources) for r in S.fused_readings(reads, values).collect()}
    assert got == {"supplier_name": ("Muller & Söhne", 2), "a|b": ("東京商店", 2)}


def test_fusion_against_planted_truth(spark):
    """Sources of unlike accuracy, one copied by two others: fusion is right more often than a majority, and as often as
    the best source or oftener."""
    import random

    rng, claims, truth = random.Random(9), [], {}
    accuracy = {"a": 0.9, "b": 0.75, "c": 0.7, "d": 0.45}
    for i in range(400):
        truth[i] = f"t{i}"
        said = {s: truth[i] if rng.random() < p else f"f{i}-{rng.randrange(8)}" for s, p in accuracy.items()}
        said |= {s: said["d"] if rng.random() < 0.95 else f"f{i}-{rng.randrange(8)}" for s in ("e", "f")}
        claims += [(i, s, v) for s, v in said.items()]
    df = spark.createDataFrame(claims, "item bigint, source string, value string")
    got = {r.item: r.value for r in S.fuse(df).collect()}
    by = {i: [v for j, _, v in claims if j == i] for i in truth}
    majority = sum(max(sorted(set(by[i])), key=by[i].count) == truth[i] for i in truth)
    fused = sum(got[i] == truth[i] for i in truth)
    best = sum(v == truth[i] for i, s, v in claims if s == "a")
    assert fused >= best - 4 and fused > majority

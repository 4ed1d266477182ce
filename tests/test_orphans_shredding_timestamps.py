import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerquarry.operators import orphans, shredding, timestamps


def t(day):
    return datetime(2026, 1, day)


def test_orphans(spark):
    target = spark.createDataFrame([("A", t(1), None), ("B", t(5), None), ("C", t(1), t(3)), ("C", t(1), t(4)), ("D", t(1), t(2)), ("D", t(1), None), (None, t(1), None), ("E", None, None)], "k string, made timestamp, gone timestamp")
    refs = spark.createDataFrame([(1, "A", t(2)), (2, "B", t(2)), (3, "C", t(4)), (4, "C", t(3)), (5, "D", t(9)), (6, "X", t(2)), (7, "E", t(2))], "read_id bigint, ref_key string, at timestamp")
    life = orphans.key_lifetimes(target, F.col("k"), F.col("made"), F.col("gone"))
    got = {r.read_id: r.reason for r in orphans.find_orphans(refs, life, "at").collect()}
    assert got == {2: "late", 3: "deleted", 6: "missing"}
    assert {r.read_id for r in orphans.find_orphans(refs, life.where("false"), "at").collect()} == set(range(1, 8))
    assert orphans.find_orphans(refs.where("false"), life, "at").count() == 0


def test_cascade(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (2, 4), (5, 9), (None, 1), (6, None)], "node bigint, parent bigint")
    got = {r.node: r.depth for r in orphans.cascade(spark.createDataFrame([(1,), (None,)], "node bigint"), edges).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    assert orphans.cascade(spark.createDataFrame([], "node bigint"), edges).count() == 0


LINE = {"sku": "S", "deliveries": {"docket": "D", "lots": [{"heat": "H1"}, {"heat": None}]}}
XML = """<?xml version="1.0" encoding="UTF-8"?><x:Invoice xmlns:x="u1" xmlns:c="u2"><c:ID>1</c:ID><c:InvoiceLine><c:Item><c:SellersItemIdentification><c:ID>K</c:ID></c:SellersItemIdentification></c:Item>
<c:Delivery><c:ID>D1</c:ID></c:Delivery><c:Delivery><c:Shipment><c:GoodsItem><c:Item><c:ItemInstance><c:LotIdentification><c:LotNumberID>L</c:LotNumberID></c:LotIdentification></c:ItemInstance></c:Item></c:GoodsItem></c:Shipment></c:Delivery></c:InvoiceLine><c:InvoiceLine/></x:Invoice>"""


def flat(spark, payloads):
    df = spark.createDataFrame([(i, f, p, "n", "p") for i, (f, p) in enumerate(payloads)], "rec_id bigint, fmt string, payload string, node_kind string, node_path string")
    return sorted(tuple(r) for r in shredding.flatten_records(df).collect())


def test_shredding(spark):
    got = flat(spark, [
        ("json", json.dumps({"lines": [LINE, None, {"sku": None, "deliveries": []}, {"lines": 1}]})),
        ("json", json.dumps({"documents": [{"lines": json.dumps(LINE)}, {"lines": None}, {}, {"lines": [LINE, {"sku": 7}]}]})),
        ("ubl_xml", XML), ("json", '{"lines": ['), ("ubl_xml", "<Invoice><a></Invoice>"), ("json", None), ("json", ""), ("json", "[]"), ("json", "5"), ("ubl_xml", "<Other/>"),
    ])
    assert got == sorted([
        (0, "line", "1.1", "S"), (0, "delivery", "1.1.1", "D"), (0, "lot", "1.1.1.1", "H1"), (0, "lot", "1.1.1.2", ""), (0, "line", "1.3", ""), (0, "line", "1.4", ""),
        (1, "line", "1.1", "S"), (1, "delivery", "1.1.1", "D"), (1, "lot", "1.1.1.1", "H1"), (1, "lot", "1.1.1.2", ""),
        (1, "line", "4.1", "S"), (1, "delivery", "4.1.1", "D"), (1, "lot", "4.1.1.1", "H1"), (1, "lot", "4.1.1.2", ""), (1, "line", "4.2", "7"),
        (2, "line", "1.1", "K"), (2, "delivery", "1.1.1", "D1"), (2, "delivery", "1.1.2", ""), (2, "lot", "1.1.2.1", "L"), (2, "line", "1.2", ""),
    ])


def plain_walk(doc, path):
    """Brute force over the plain lists."""
    for i, line in enumerate(doc, 1):
        yield "line", f"{path}.{i}", line["sku"]
        for j, d in enumerate(line["deliveries"], 1):
            yield "delivery", f"{path}.{i}.{j}", d["docket"]
            for k, lot in enumerate(d["lots"], 1):
                yield "lot", f"{path}.{i}.{j}.{k}", lot["heat"]


def test_shredding_equals_walk(spark):
    import random

    rng = random.Random(3)
    records = []
    for _ in range(60):
        records.append([[{"sku": str(rng.random()), "deliveries": [{"docket": str(rng.random()), "lots": [{"heat": str(rng.random())} for _ in range(rng.randrange(3))]} for _ in range(rng.randrange(3))]} for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 4))])
    want = sorted((i, *row) for i, docs in enumerate(records) for n, d in enumerate(docs, 1) for row in plain_walk(d, str(n)))
    assert flat(spark, [("json", json.dumps({"documents": [{"lines": d} for d in docs]})) for docs in records]) == want


def test_parents(spark):
    nodes = spark.createDataFrame([(1, "lot", "1.2.3.4", ""), (1, "line", "1.2", "")], "rec_id bigint, node_kind string, node_path string, node_key string")
    assert [(r.parent_kind, r.parent_path) for r in shredding.parent_links(nodes).collect()] == [("delivery", "1.2.3"), ("document", "1")]


def test_timestamps(spark, tmp_path):
    df = spark.createDataFrame([(1, "2025-07-03", "z", None), (1, "2025-07-03", "z", None), (2, "2025-07-03 10:00", "07/08/2025", "Australia/Perth"), (3, None, "", "Australia/Perth"), (4, "soon", None, "raw")], "read_id bigint, date string, raw string, zone string")
    want = sorted([(1, "date", "2025-07-03"), (1, "date", "2025-07-03"), (2, "date", "2025-07-03T02:00:00.000000Z"), (2, "raw", "2025-08-07")])
    assert sorted(tuple(r) for r in timestamps.normalise(df, "read_id", ["date", "raw"], "zone").collect()) == want
    folder = str(tmp_path / "dictionary")
    for _ in range(2):
        assert sorted(tuple(r) for r in timestamps.normalise(df, "read_id", ["date", "raw"], "zone", folder).collect()) == want
    assert spark.read.parquet(folder).count() == 5
    assert timestamps.normalise(df.where("false"), "read_id", ["date", "raw"], "zone").count() == 0

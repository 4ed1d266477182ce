import random
from datetime import date

from pyspark.sql import functions as F

from ledgerquarry.functions import text as T
from ledgerquarry.operators import alignment, copies, extraction, fields, geometry, links, orphans, segments, shredding, timestamps, titles
from ledgerquarry.runtime import cut, drop_cuts, hot_keys, join_spread, shared_dir
from ledgerquarry.sources import grids, readings, sinks, ubl


def test_cut_survives_and_is_removed(spark):
    df = cut(spark.range(10).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 10 and cut(df.where("false")).count() == 0
    drop_cuts(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", None if i % 50 == 7 else 1) for i in range(3000)], "id bigint, a string, b int")
    entries = rows.select("a", "b").distinct().where("a <> 'k9'").withColumn("v", F.concat("a", F.lit("!")))
    counts = rows.groupBy("a", "b").count()
    hot = hot_keys(counts, ["a", "b"], "count")
    assert hot.count() <= 1000
    got = {r.id: r.v for r in join_spread(rows, entries, ["a", "b"], hot, F.col("id")).collect()}
    assert got == {r.id: r.a + "!" for r in rows.collect() if r.b is not None and r.a != "k9"}


def test_blank_zone_is_no_zone(spark):
    rows = [(1, "3/7/2025", None), (2, "3/7/2025", ""), (3, "3/7/2025", " "), (4, "3/7/2025 10:00", ""), (5, None, "UTC"), (6, "", None), (1, "3/7/2025", None)]
    df = spark.createDataFrame(rows, "id bigint, d string, z string")
    assert sorted((r.id, r.normal_form) for r in timestamps.normalise(df, "id", ["d"], "z").collect()) == [(1, "2025-07-03"), (1, "2025-07-03"), (2, "2025-07-03"), (3, "2025-07-03")]


def test_dictionary_grows(spark, tmp_path):
    folder = str(tmp_path / "dictionary")
    df = lambda *d: spark.createDataFrame([(i, x, "Australia/Sydney") for i, x in enumerate(d)], "id bigint, d string, z string")
    first = timestamps.normalise(df("1 May 2025", "soon"), "id", ["d"], "z", folder).collect()
    again = timestamps.normalise(df("1 May 2025", "2025-05-02 08:00", "soon"), "id", ["d"], "z", folder).collect()
    assert [tuple(r) for r in first] == [(0, "d", "2025-05-01")]
    assert {r.id: r.normal_form for r in again} == {0: "2025-05-01", 1: "2025-05-01T22:00:00.000000Z"}
    assert spark.read.parquet(folder).count() == 3  # the second run parsed one new entry
    spark.read.parquet(folder).where("raw = 'soon'").write.mode("append").parquet(folder)  # as if two runs had added it
    assert timestamps.normalise(df("1 May 2025", "1 May 2025"), "id", ["d"], "z", folder).count() == 2


def test_cascade_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(15)] + [(0, 15), (7, 7), (None, 3), (3, None)], "node bigint, parent bigint")
    got = {r.node: r.depth for r in orphans.cascade(spark.createDataFrame([(0,), (None,)], "node bigint"), edges).collect()}
    assert got == {i: i for i in range(16)}
    assert orphans.cascade(edges.select("node").where("false"), edges).count() == 0


def test_copies_of_a_hot_content(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}", "x") for i in range(500)] + [(900, None, "x")], "id bigint, text string, content_hash string")
    got = {r.id: r.first_seen for r in copies.mark_copies(df, F.col("text"), F.col("id")).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(500)} | {900: 900}


def test_page_groups_over_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["f", "f", "g", None]), p, rng.choice(["invoice", "statement", "unknown"]), 1.0, rng.choice(["", "A", "B"]), None, None, rng.random() < 0.1, rng.random() < 0.1) for p in range(400)]
    df = spark.createDataFrame(rows, "ref string, page int, doc_type string, title_strength double, number string, page_n int, page_m int, continued boolean, continues boolean")
    by = lambda chunk: {r.page: r.segment for r in segments.group_pages(df, chunk=chunk).collect()}
    whole = by(100_000)
    assert by(7) == whole and by(50) == whole and len(whole) == 400


def test_page_facts(spark):
    df = spark.createDataFrame([("Tax Invoice", "I-1", "Page 1 of 3 continued overleaf"), (None, None, None), ("Delivery note", "", "continued from page 1")], "title string, no string, text string")
    got = [(r.doc_type, r.title_strength, r.number, r.page_n, r.page_m, r.continued, r.continues) for r in segments.page_facts(df, "text", "title", "no").collect()]
    assert got == [("supplier_invoice", 1.0, "I-1", 1, 3, False, True), ("unknown", 0.0, "", None, None, False, False), ("goods_receipt", 1.0, "", None, None, True, False)]


def test_continuations(spark):
    docs = spark.createDataFrame([("f", 1, 1, "invoice", "A-1"), ("f", 2, 2, "invoice", "B-2"), ("g", 3, 3, "invoice", "A-1")], "ref string, doc_id bigint, seq bigint, doc_type string, number string")
    parts = spark.createDataFrame([("f", 10, "invoice", "B-2", None), ("f", 11, None, "", "goes on from A-1, see B-2"), ("f", 12, None, "", "A-12 and XA-1"), ("g", 13, "receipt", "A-1", ""), ("g", 14, None, None, "(A-1)")], "ref string, part_id bigint, doc_type string, number string, text string")
    links_ = segments.attach_continuations(parts, docs, scope=["ref"])
    assert {r.part_id: r.doc_id for r in links_.collect()} == {10: 2, 11: 1, 14: 3}
    lines = spark.createDataFrame([(2, 1, "bolt", None), (2, 2, "nut", 3)], "doc_id bigint, line_no int, what string, n int")
    more = spark.createDataFrame([(10, 1, "bolt", None), (10, 2, "nut", 4), (12, 1, "lost", 1)], "part_id bigint, line_no int, what string, n int")
    assert sorted((r.doc_id, r.part_id or 0, r.what, r.n) for r in segments.append_lines(lines, more, links_, ["what", "n"]).collect()) == [(2, 0, "bolt", None), (2, 0, "nut", 3), (2, 10, "nut", 4)]


def test_title_rules(spark):
    cases = {"TAX INVOICE": "supplier_invoice", "Tax lnvoice": "supplier_invoice", "see order": "unknown", "Purchase Order: PO-1": "unknown", "Invoice number": "unknown", "C R E D I T  N O T E": "credit_note", "STATEMENT OF ACCOUNT May 2026": "statement", "please quote our tax invoice": "unknown", "": "unknown", None: "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", titles.title_type(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == cases


GRID = [
    ["ACME STEEL PTY LTD"], ["Tax Invoice"], ["ABN 51 824 753 556"], ["Invoice no:", "INV-77"], ["Invoice date", "13/02/2026"], ["Your order no"], ["PO-4102"], [""],
    ["Code", "Description", "Qty", "Unit price", "Amount"], ["ST-1", "Beam 40x14", "2", "10.00", "20.00"], ["", "galvanised", "", "", ""], ["ST-2", "Flat", "1", "5.50", "5.50"],
    ["Subtotal", "", "", "", "25.50"], ["GST", "2.55"], ["Total: $28.05"],
]


def grid(spark, rows, ref="a"):
    return spark.createDataFrame([(ref, i, r) for i, r in enumerate(rows)], "ref string, row_no bigint, cells array<string>")


def test_extraction(spark):
    suppliers = spark.createDataFrame([(1, "Beta Pty Ltd", None, None), (2, "Acme Steel Pty Ltd", "51 824 753 556", ["ASX"])], "supplier_id bigint, name string, abn string, aliases array<string>")
    rows = grid(spark, GRID).unionByName(grid(spark, [["nothing here"], [""]], "b")).unionByName(grid(spark, [["Delivery docket"], ["Haul Co Limited"], ["Docket no", "D-5"], ["sent to ASX today"]], "c"))
    out = extraction.extract(rows, suppliers)
    assert {r.ref: (r.doc_type, r.status) for r in out.documents.collect()} == {"a": ("supplier_invoice", "read"), "b": ("unknown", "held"), "c": ("goods_receipt", "read")}
    values = {(r.ref, r.field): (r.value, r.evidence) for r in out.values.collect()}
    assert values == {
        ("a", "supplier_name"): ("Acme Steel Pty Ltd", "master"), ("a", "supplier_abn"): ("51 824 753 556", "label"), ("a", "doc_number"): ("INV-77", "label"), ("a", "date"): ("2026-02-13", "label"), ("a", "po_reference"): ("PO-4102", "label"),
        ("a", "subtotal"): ("25.50", "label"), ("a", "gst"): ("2.55", "label"), ("a", "total"): ("28.05", "label"), ("c", "doc_number"): ("D-5", "label"), ("c", "supplier_name"): ("Acme Steel Pty Ltd", "master"),
    }
    lines = [(r.sku, r.description, float(r.quantity), r.unit_price_c, r.amount_c) for r in out.lines.orderBy("line_no").collect()]
    assert lines == [("ST-1", "Beam 40x14 galvanised", 2.0, 1000, 2000), ("ST-2", "Flat", 1.0, 550, 550)]
    alone = extraction.extract(rows.where("ref = 'c'"))
    assert {(r.field, r.value, r.evidence) for r in alone.values.collect()} == {("doc_number", "D-5", "label"), ("supplier_name", "Haul Co Limited", "layout")}
    assert extraction.extract(rows.where("false")).values.count() == 0


def test_cells_go_to_columns_by_place(spark):
    rows = [(0, ["Description", "Qty", "Amount"], [50.0, 150.0, 250.0]), (1, ["Bolt", "9.00"], [40.0, 240.0]), (2, ["Nut", "M8", "3", "1.00"], [30.0, 60.0, 160.0, 255.0]), (3, ["Total", "10.00"], [50.0, 250.0])]
    df = spark.createDataFrame([("a", *r) for r in rows], "ref string, row_no int, cells array<string>, xs array<double>")
    assert [dict(r.values) for r in fields.table_rows(df).orderBy("row_no").collect()] == [{"description": "Bolt", "amount": "9.00"}, {"description": "Nut M8", "quantity": "3", "amount": "1.00"}]


def test_words_to_cells(spark):
    words = [("p", 1, "Tax", 0.0, 20.0, 0.0, 10.0), ("p", 2, "Invoice", 25.0, 60.0, 1.0, 11.0), ("p", 3, "No", 100.0, 110.0, 2.0, 12.0), ("p", 4, "7", 113.0, 118.0, 2.0, 12.0), ("p", 5, "below", 0.0, 20.0, 30.0, 40.0), ("p", 6, " ", 0.0, 1.0, 60.0, 70.0), ("p", 7, "x", None, 1.0, 60.0, 70.0)]
    df = spark.createDataFrame([(*w, None) for w in words], "ref string, word_no bigint, text string, x0 double, x1 double, top double, bottom double, size double")
    assert [(r.row_no, r.cells, r.xs) for r in geometry.cells_of_words(df, ["ref"]).orderBy("row_no").collect()] == [(0, ["Tax Invoice", "No 7"], [30.0, 109.0]), (1, ["below"], [10.0])]
    # A row keeps to its first word: words that drift down in small steps part from it.
    steps = spark.createDataFrame([("p", i, f"w{i}", 50.0 * i, 50.0 * i + 9, 2.0 * i, 2.0 * i + 10, 10.0) for i in range(4)], df.schema)
    assert [r.cells for r in geometry.cells_of_words(steps, ["ref"]).orderBy("row_no").collect()] == [["w0", "w1"], ["w2", "w3"]]


def test_settled_days(spark):
    rows = [("3/4/2026", None, False, "2026-04-03", True), ("3/4/2026", "monthfirst", False, "2026-03-04", False), ("3/4/2026", "monthfirst", True, "2026-04-03", False), ("3/4/2026", "dayfirst", False, "2026-04-03", False), ("5/5/2026", None, False, "2026-05-05", False), ("13/4/2026", None, False, "2026-04-13", False), ("3 April 2026", None, False, "2026-04-03", False)]
    df = spark.createDataFrame(rows, "d string, p string, au boolean, day string, amb boolean").select("*", T.settled_day(F.col("d"), F.col("p"), F.col("au")).alias("s"))
    assert all((str(r.s.day), r.s.ambiguous) == (r.day, r.amb) for r in df.collect())
    assert spark.range(1).select(T.settled_day(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)).alias("s")).collect()[0].s is None


def test_scored_links_do_not_depend_on_passes(spark):
    # Documents 1 and 2 are alike, and so are PO-2 and PO-1; of these only the smaller can be the best.
    day = date(2026, 8, 20)
    docs = spark.createDataFrame([(1, "acme steel", 5000, day), (2, "acme steel", 5000, day), (3, "acme steel", 7000, day), (4, None, None, None)], "doc_id bigint, supplier_key string, net_c bigint, day date")
    lines = spark.createDataFrame([(1, 1, None, "bolt m8"), (2, 1, None, "bolt m8"), (4, 1, "B-3", "nut")], "doc_id bigint, line_no int, sku string, description string")
    orders = spark.createDataFrame([(po, "acme steel", c, date(2026, 8, 1)) for po, c in (("PO-2", 5000), ("PO-1", 5000), ("PO-3", 7000))], "po string, supplier_key string, net_c bigint, day date")
    order_lines = spark.createDataFrame([("PO-2", 1, "B-2", "bolt m8"), ("PO-1", 4, "B-2", "bolt m8"), ("PO-3", 1, "B-3", "nut")], "po string, po_line_no int, po_sku string, po_description string")
    of = lambda **k: {r.doc_id: (r.po, r.score) for r in links.scored_links(docs, lines, orders, order_lines, **k).collect()}
    assert of(pass_pairs=1) == of() == {1: ("PO-1", 1.0), 2: ("PO-1", 1.0), 3: ("PO-3", 0.75)}
    assert links.scored_links(docs.where("false"), lines, orders, order_lines).count() == 0


def test_scored_links_write_no_pairs(spark, monkeypatch):
    day, n, written = date(2026, 8, 20), 60, []
    monkeypatch.setattr(links, "cut", lambda df, cut=links.cut: written.append(cut(df)) or written[-1])
    docs = spark.createDataFrame([(i, "acme steel", 5000 + 100 * i, day) for i in range(n)], "doc_id bigint, supplier_key string, net_c bigint, day date")
    lines = spark.createDataFrame([(i, 1, None, "bolt m8 zinc") for i in range(n)], "doc_id bigint, line_no int, sku string, description string")
    orders = spark.createDataFrame([(f"PO-{i:02}", "acme steel", 5000 + 100 * i, date(2026, 8, 1)) for i in range(n)], "po string, supplier_key string, net_c bigint, day date")
    order_lines = spark.createDataFrame([(f"PO-{i:02}", 1, None, "zinc bolt m8" if i % 2 else "paint") for i in range(n)], "po string, po_line_no int, po_sku string, po_description string")
    got = {r.doc_id: (r.po, r.score) for r in links.scored_links(docs, lines, orders, order_lines).collect()}
    # The order of the value has the goods, or the next one has and is as near as one of 100 cents more.
    assert all(got[i] == (f"PO-{i:02}", 1.0) for i in range(1, n, 2)) and all(got[i][0] in (f"PO-{i - 1:02}", f"PO-{i + 1:02}") for i in range(0, n, 2))
    assert max(d.count() for d in written) <= 2 * n


def test_fits_are_those_of_line_match(spark):
    texts = ["", None, "bolt", "Bolt M8 zinc pack", "zinc M8 bolt", "m8 bolt zinc plated pack 50", "FX-10 bolt", "paint grey 20L", "grey paint 20l drum", "bolt bolt bolt", "a b c d e", "a b c x y", "a b c d x"]
    codes = [None, "", "FX-10", "fx10", "B2", "--"]
    both = [(c, t) for c in codes for t in texts]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(both)], "text bigint, sku string, description string")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(both)], "goods bigint, po_sku string, po_description string")
    want = a.crossJoin(b).where(F.round(T.line_match(F.col("sku"), F.col("description"), F.col("po_sku"), F.col("po_description")), 6) >= 0.6)
    pairs = lambda d: {(r.text, r.goods) for r in d.collect()}
    assert pairs(links._fits(a, b).select("text", F.explode("fits").alias("goods"))) == pairs(want)
    assert links._fits(a.where("false"), b).count() == links._fits(a, b.where("false")).count() == 0


def test_links_of_a_scenario(spark):
    orders = spark.createDataFrame([("PO-1", "acme steel", 10000, date(2026, 8, 1)), ("PO-2", "acme steel", 5000, date(2026, 8, 1)), ("PO-3", "", 7000, date(2026, 8, 2))], "po string, supplier_key string, net_c bigint, day date")
    order_lines = spark.createDataFrame([("PO-1", 1, "A-1", "beam"), ("PO-2", 1, "B-2", "bolt m8"), ("PO-3", 1, None, "paint grey")], "po string, po_line_no int, po_sku string, po_description string")
    docs = spark.createDataFrame([(1, ["PO-9", "PO-1"], "acme steel"), (2, ["PO-1"], "other firm"), (3, [], "acme steel"), (4, None, "acme steel")], "doc_id bigint, numbers array<string>, supplier_key string")
    assert {r.doc_id: r.po for r in links.stated_links(docs, orders).collect()} == {1: "PO-1"}
    free = spark.createDataFrame([(5, "acme steel", 5000, date(2026, 8, 20)), (6, "nobody", None, None), (7, "acme steel", 5000, None)], "doc_id bigint, supplier_key string, net_c bigint, day date")
    lines = spark.createDataFrame([(5, 1, None, "bolt m8"), (6, 1, "A1", "x"), (7, 1, "B-2", "y")], "doc_id bigint, line_no int, sku string, description string")
    assert {r.doc_id: (r.po, r.score) for r in links.scored_links(free, lines, orders, order_lines).collect()} == {5: ("PO-2", 1.0), 7: ("PO-2", 0.85)}
    invoices = spark.createDataFrame([(1, "100", 1000), (2, "200", 500), (3, "300", 400)], "doc_id bigint, number string, total_c bigint")
    credits = spark.createDataFrame([("100", 250), (None, 9)], "number string, amount_c bigint")
    paid = spark.createDataFrame([("200", 500), ("300", 100), ("300", 50)], "number string, amount_c bigint")
    assert {r.doc_id: r.open_c for r in links.balances(invoices, credits, paid).collect()} == {1: 750, 3: 250}
    notes = spark.createDataFrame([(9, ["900", "100"]), (10, ["901"])], "doc_id bigint, originals array<string>")
    held = invoices.select("doc_id", "number", F.when(F.col("doc_id") == 1, "PO-1").alias("po"))
    assert [tuple(r) for r in links.credit_links(notes, held).collect()] == [(9, 1, "PO-1")]


def test_shredding_round_trip(spark):
    import json

    rng = random.Random(5)
    def tree(kind):
        make = {
            "line": lambda: {"sku": rng.choice(["a", "b", None, ""]), "quantity": rng.choice([1, 2.5, "7", None])} | ({"deliveries": some("delivery")} if rng.random() < 0.8 else {}),
            "delivery": lambda: {"docket": rng.choice(["d", None])} | ({"lots": some("lot")} if rng.random() < 0.8 else {}),
            "lot": lambda: {"heat": "h", "qty": 3},
            "document": lambda: {"doc_type": "x", "lines": some("line"), "sources": [{"file": "f", "pages": [1, 2]}]},
        }
        return make[kind]()
    def some(kind):
        out = [None if rng.random() < 0.15 else tree(kind) for _ in range(rng.randint(0, 3))]
        if len(out) == 1 and out[0] and rng.random() < 0.4:
            out = out[0]
        return json.dumps(out) if rng.random() < 0.2 else None if out == [] and rng.random() < 0.5 else out
    payloads = [(i, "json", json.dumps({"documents": [tree("document") for _ in range(rng.randint(1, 2))]} if rng.random() < 0.5 else tree("document"))) for i in range(120)]
    payloads += [(900, "json", "{broken"), (901, "json", None), (902, "ubl_xml", "<Invoice>"), (903, None, "<x/>"), (904, "json", "null")]
    expected = set()
    def listed(v):
        v = json.loads(v) if isinstance(v, str) else v
        v = v if isinstance(v, list) else [] if v is None else [v]
        return [(i, x) for i, x in enumerate(v, 1) if x is not None]
    def leaf(x):
        return None if x in (None, "") else x if isinstance(x, str) else json.dumps(x)
    for i, _, p in payloads[:120]:
        doc = json.loads(p)
        for a, d in listed(doc["documents"] if "documents" in doc else doc):
            for b, li in listed(d["lines"]):
                expected.add((i, "line", f"{a}.{b}", leaf(li["sku"]), leaf(li["quantity"])))
                for c, de in listed(li.get("deliveries")):
                    expected.add((i, "delivery", f"{a}.{b}.{c}", leaf(de["docket"]), None))
                    for e, lo in listed(de.get("lots")):
                        expected.add((i, "lot", f"{a}.{b}.{c}.{e}", "h", "3"))
    df = spark.createDataFrame(payloads, "rec_id bigint, fmt string, payload string")
    rows = shredding.shred_records(df, {"line": {"key": "sku", "n": "quantity"}, "delivery": {"key": "docket"}, "lot": {"key": "heat", "n": "qty"}}).collect()
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    pages = shredding.node_table(df, "page")
    assert {(r.parent_path.count("."), r.page) for r in pages.collect()} == {(1, "1"), (1, "2")}


def test_broken_ubl_gives_no_row(spark):
    whole = "<a:Invoice xmlns:a='u'><a:ID>1</a:ID><a:InvoiceLine><a:ID>1</a:ID></a:InvoiceLine></a:Invoice>"
    df = spark.createDataFrame([(1, whole), (2, whole[:-20]), (3, whole.replace("</a:ID>", "", 1)), (4, None), (5, "{}"), (6, "<Other/>")], "rec_id bigint, payload string")
    assert [r.rec_id for r in ubl.read_headers(df).collect()] == [1] and [r.rec_id for r in ubl.read_lines(df, "rec_id").collect()] == [1]


def test_report_lines(spark):
    df = spark.createDataFrame([("read", 2, 12345), ("held", 1, None)], "k string, n bigint, c bigint")
    got = [r.line for r in sinks.report_lines([("Readings", df, "k", "n", None), ("Open", df.where("k = 'read'"), "k", "n", "c"), ("None", df.where("false"), "k", "n", "c")]).orderBy("place").collect()]
    assert got == ["Readings: 3", "  held: 1", "  read: 2", "Open: 2  $123.45", "  read: 2  $123.45", "None: 0  n/a"]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("ACME Steel Pty. Ltd.", "ABN 51824753556, 51 824 753 557"), ("Pty Ltd", None), (None, "x")], "n string, t string")
    got = [(r.k, r.a) for r in df.select(T.name_key(F.col("n")).alias("k"), T.find_abns(F.col("t")).alias("a")).collect()]
    assert got == [("acme steel", ["51 824 753 556"]), ("pty ltd", []), ("", [])]


def test_documents_are_aligned(spark):
    docs = lambda *rows: spark.createDataFrame(list(rows), "f string, doc bigint, pages array<int>, number string")
    known = docs(("a", 1, [1, 2], "X1"), ("a", 2, [3], "X2"), ("a", 3, [4], ""), ("b", 4, [1], None))
    found = docs(("a", 11, [1], ""), ("a", 12, [2, 3], "X2"), ("a", 13, [4, 4], "X9"), ("c", 14, [1], "X1"))
    assert {(r.k_doc, r.f_doc, r.score) for r in alignment.align_documents(known, found, "f").collect()} == {(2, 12, 101), (1, 11, 1), (3, 13, 1)}


def test_readings_and_context(spark, tmp_path):
    import json

    raws = ['{"doc_type": "statement", "page_no": "1", "page_of": "2", "fields": {"total": "5", "date": "", "gst": null}, "lines": [{"sku": "a"}, {"sku": ""}]}', '{"doc_type": "poem", "page_no": "1", "page_of": "x"}', "not json", None]
    got = [r.x for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(readings.page_reading(F.col("raw")).alias("x")).collect()]
    assert [(x.doc_type, x.page_n, x.page_m, x.fields, x.lines) for x in got] == [("statement", 1, 2, {"total": "5"}, [{"sku": "a"}]), *[("unknown", None, None, {}, [])] * 3]

    class Echo:
        def read_page(self, image):
            return json.dumps({"doc_type": "remittance", "fields": {"n": image.decode()}})

    pages = spark.createDataFrame([("a", 1, b"one"), ("a", 2, b"\xff")], "ref string, page int, content binary")
    assert [(r.page, r.reading.doc_type, r.reading.fields) for r in readings.read_pages(pages, Echo).orderBy("page").collect()] == [(1, "remittance", {"n": "one"}), (2, "unknown", {})]
    (tmp_path / "context.json").write_text(json.dumps({"buyer": {"name": "B", "abn": "1"}, "suppliers": [{"name": "S"}, {"name": "T", "aliases": ["U"]}]}, indent=1))
    buyer, suppliers = readings.load_context(spark, str(tmp_path / "context.json"))
    assert [tuple(r) for r in buyer.collect()] == [("B", "1")] and [tuple(r) for r in suppliers.collect()] == [(1, "S", None, None), (2, "T", None, ["U"])]
    items = spark.createDataFrame([("a", "pipes", b"x|y")], "ref string, kind string, content binary")
    assert grids.grid_rows(items, {"pipes": lambda b: [(1, b.decode().split("|"))]}).collect()[0].cells == ["x", "y"]


def test_names_on_pages(spark):
    page = "acme steel and north shore supplies invoice gorpo luford".split()
    df = spark.createDataFrame([("Acme Steel Pty Ltd", page), ("North Shore Building Supplies Group", page), ("Nobody Steel Works", page), ("Gorpoluford", page), ("x", None)], "n string, p array<string>")
    assert [r.x for r in df.select(T.name_on_page(F.col("n"), F.col("p")).alias("x")).collect()] == [True, False, False, True, None]

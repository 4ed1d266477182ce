import io
import re
import zipfile

from pyspark.sql import functions as F

from ledgerquarry.operators import copies, fields, registers, segments, titles
from ledgerquarry.sources import grids, items, ubl
from ledgerquarry.streaming.ledger import follow_folder

CSV = b"\xef\xbb\xbfSupplier;Acme Steel Pty Ltd\nStatement date;31/08/2026\n\nTrans Date;Reference;Description;Debit;Credit;Balance\n01/08/2026;INV-1;Invoice;100.00;;100.00\n05/08/2026;PAY-2;Payment;;40.00;60.00\nClosing balance;;;;;60.00\n"
MAIL = b"From: a@b\r\nSubject: s\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nshort\r\n--B\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=x.csv\r\n\r\na,b\r\n--B--\r\n"
UBL = "<n:Invoice xmlns:n='urn:x:Invoice-2' xmlns:c='u'><c:ID>I-1</c:ID><c:LegalMonetaryTotal><c:PayableAmount currencyID='AUD'>0.0</c:PayableAmount><c:TaxInclusiveAmount currencyID='AUD'>11</c:TaxInclusiveAmount></c:LegalMonetaryTotal><c:InvoiceLine><c:ID>1</c:ID><c:InvoicedQuantity unitCode='EA'>2</c:InvoicedQuantity><c:Item><c:Name>bolt</c:Name></c:Item></c:InvoiceLine></n:Invoice>"


def xlsx(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        cells = "".join(f"<row>{''.join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{n}"><v>{v}</v></c>' for i, v in enumerate(r))}</row>" for n, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name, data in {"a.csv": CSV, "sub/m.eml": MAIL, "u.xml": UBL.encode(), "t.xlsx": xlsx([["Code", "Qty"], ["x", 2.5]]), "d.docx": docx("Tax Invoice"), "skip.json": b"{}", "n.txt": b"one  two\nthree"}.items():
        (root / name).write_bytes(data)
    return str(root)


def test_files_to_grids(spark, tmp_path):
    found = items.expand_mails(items.scan_folder(spark, folder(tmp_path)))
    kinds = found.withColumn("kind", items.format_of(F.col("content"), F.col("name")))
    assert {(r.ref, r.kind) for r in kinds.select("ref", "kind").collect()} == {("a.csv", "csv"), ("sub/m.eml#x.csv", "csv"), ("u.xml", "ubl"), ("t.xlsx", "xlsx"), ("d.docx", "docx"), ("n.txt", "text")}
    rows = {(r.ref, r.row_no): r.cells for r in grids.grid_rows(kinds).collect()}
    assert rows[("t.xlsx", 1)] == ["x", "2.50"] and rows[("d.docx", 0)] == ["Tax Invoice"] and rows[("n.txt", 0)] == ["one", "two"]
    grid = grids.grid_rows(kinds.where("ref = 'a.csv'"))
    values = {r.field: r.value for r in fields.label_values(grid).collect()}
    assert values["date"] == "2026-08-31" and values["closing_balance"] == "60.00" and values["supplier_name"] == "Acme Steel Pty Ltd"
    lines = [dict(r.values) for r in fields.table_rows(grid).orderBy("row_no").collect()]
    assert [x["reference"] for x in lines] == ["INV-1", "PAY-2"] and lines[1]["credit"] == "40.00"


def test_ubl(spark):
    df = spark.createDataFrame([(1, UBL)], "rec_id bigint, payload string")
    head = ubl.read_headers(df).collect()[0]
    assert (head.doc_number, head.total, head.doc_type, head.due_date) == ("I-1", "11", "supplier_invoice", None)
    line = ubl.read_lines(df, "rec_id").collect()[0]
    assert (line.description, line.quantity, line.sku, line.line_no) == ("bolt", "2", None, 1)


def test_titles(spark):
    cells = spark.createDataFrame([("a", 0, 0, "TAX INVOICE"), ("b", 0, 0, "Credit Note"), ("b", 1, 0, "against tax invoice"), ("c", 0, 0, "Purchase Order: PO-1"), ("d", 0, 0, "D E L I V E R Y  D O C K E T"), ("e", 0, 0, "nothing")], "ref string, row_no int, cell_no int, text string")
    assert {r.ref: r.doc_type for r in titles.classify(cells).collect()} == {"a": "supplier_invoice", "b": "credit_note", "c": "unknown", "d": "goods_receipt", "e": "unknown"}


def test_pages(spark):
    rows = [("f", 1, "invoice", 1.0, "A", 1, 2, False, False), ("f", 2, "invoice", 0.0, "A", 2, 2, False, False), ("f", 3, "invoice", 1.0, "B", None, None, False, True), ("f", 4, "invoice", 1.0, "C", None, None, False, False), ("f", 5, "receipt", 0.9, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "ref string, page int, doc_type string, title_strength double, number string, page_n int, page_m int, continued boolean, continues boolean")
    assert [r.segment for r in segments.group_pages(df).orderBy("page").collect()] == [1, 1, 2, 2, 3]


def test_copies(spark):
    df = spark.createDataFrame([(1, "x", "h"), (2, "x", "h"), (3, None, "h"), (4, None, "h")], "id bigint, text string, content_hash string")
    assert {r.id: r.first_seen for r in copies.mark_copies(df, F.col("text"), F.col("id")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_registers(spark):
    df = spark.createDataFrame([("p", 1, "order", 10, 5), ("p", 1, "receipt", 4, 0), ("p", 2, "receipt", 4, 0)], "po string, line_no int, kind string, qty_m bigint, amt_c bigint")
    chains = registers.chain(df, ["po", "line_no"])
    assert [tuple(r) for r in registers.outstanding(chains, ["po"], F.col("ordered_m"), F.col("received_m")).collect()] == [("p", 10, 4, 6, 3)]
    none = registers.recall_precision(chains.where("false"), chains.where("false"), ["po"]).collect()[0]
    assert (none.n_true, none.recall) == (0, None)


def test_ledger_stream(spark, tmp_path):
    root = folder(tmp_path)
    ledger, check = str(tmp_path / "ledger"), str(tmp_path / "check")
    for _ in range(2):
        follow_folder(spark, root, ledger, check).awaitTermination(60)
        (tmp_path / "in" / "copy.csv").write_bytes(CSV)
    assert spark.read.parquet(ledger).count() == 6  # copy.csv holds what a.csv does


def test_queries_match_sql(spark):
    import duckdb

    from ledgerquarry.plans import catalogue

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    base = "/root/testdata/sf0.001"
    import glob
    import os

    if not os.path.isdir(base):
        import pytest

        pytest.skip("no test tables")
    for p in glob.glob(f"{base}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    for name in ("p2_found", "p3_found", "goods_owed", "stated_order_lines", "page_groups", "parsed_money"):
        df, sql = catalogue.QUERIES[name](spark, base), con.sql(catalogue.SQL[name])
        columns = sorted(df.columns)
        assert columns == sorted(sql.columns)
        assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[sql.columns.index(c)] for c in columns]) for r in sql.fetchall()), name


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(grids.__file__).resolve().parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]


def test_printed_days_of_every_reading(spark, tmp_path):
    from datetime import date, timedelta

    from ledgerquarry.plans.paperwork_queries import QUERIES

    rows = [(None, None), ("", None), ("soon", None), ("31/02/2026", None)]
    for i in range(40):
        d = date(2026, 1, 3) + timedelta(days=9 * i)
        month = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"][d.month - 1]
        rows += [(t, str(d)) for t in (f"{d}", f"{d.day}/{d.month}/{d.year}", f"{d.day:02}.{d.month:02}.{d.year % 100}", f"Issued {d.day}-{d.month}-{d.year} at noon", f"{d.day} {month} {d.year}", f"{month[:3]} {d.day}, {d.year}", f"dated {d.day}th {month.upper()} {d.year}")]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "read_id bigint, date string").write.parquet(str(tmp_path / "model_read.parquet"))
    assert {r.read_id: r.day for r in QUERIES["printed_days"](spark, str(tmp_path)).collect()} == {i: day for i, (_, day) in enumerate(rows)}

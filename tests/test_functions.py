from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerquarry.functions import text as T
from ledgerquarry.functions.ids import canonical_id, digit_runs
from ledgerquarry.functions.instants import normal_form
from ledgerquarry.functions.money import money_cents, number_cents


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_money(spark):
    cases = {
        "$1,234.56": 123456, "(609.84)": -60984, "609.84 CR": -60984, "1.234,56": 123456, "AUD 17 002.58": 1700258, "-$5.00": -500, "13647.72-": -1364772,
        "12": 1200, "1,234": 123400, "5.5": 550, "": None, "none": None, None: None, "credit 5.00": 500,
    }
    assert column(spark, list(cases), money_cents) == list(cases.values())


def test_number_cents(spark):
    assert column(spark, [1.005, -2.5, None, float("nan"), 14741.17], number_cents, "double") == [101, -250, None, None, 1474117]


def test_ids(spark):
    assert column(spark, ["ab-12 c", "", None], canonical_id) == ["AB12C", "", None]
    runs = column(spark, ["PO-1003 6491 & PO 10038397", "123456789", "12 10034537", "x", None, "10034537 10034537"], lambda c: digit_runs(c, 8))
    assert runs == [["10036491", "10038397"], [], ["10034537"], [], [], ["10034537"]]


def test_text_functions(spark):
    assert column(spark, ["51 824 753 556", "51 824 753 557", None], T.abn_valid) == [True, False, False]
    assert column(spark, ["ABN 51 824 753 556 or 51824753557"], T.find_abns) == [["51 824 753 556"]]
    assert column(spark, ["Acme Steel Pty. Ltd.", None], T.name_key) == ["acme steel", ""]
    assert column(spark, ["1,5", "1,500", "1,234.5", "5-10", "x", None], T.parse_number) == [Decimal("1.5"), 1500, Decimal("1234.5"), None, None, None]
    days = column(spark, ["07/08/2026", "03/20/2023", "9 Aug 2026", "02 Juillet 2015", "2026-13-04", "31/02/2026", None], lambda c: T.parse_day(c).cast("string"))
    assert days == ["2026-08-07", "2023-03-20", "2026-08-09", "2015-07-02", None, None, None]
    assert column(spark, ["3/4/2026 and 13/4/2026", "3/20/2026", "3/4/2026"], T.order_evidence) == ["dayfirst", "monthfirst", None]
    assert column(spark, ["Page 2 of 5", "no"], lambda c: T.page_of(c)["m"]) == [5, None]
    assert column(spark, ["Invoice №: 5", None], T.normal_label) == ["invoice no 5", ""]


def test_line_match(spark):
    df = spark.createDataFrame([("A-1", "x", "a1", "y"), ("A1", "x", "B1", "x"), (None, "bolt A1 big", "A1", "z"), (None, "red bolt", None, "blue bolt"), (None, None, None, None)], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(T.line_match(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [1.0, 0.0, 0.95, pytest.approx(1 / 3), 0.0]


def test_on_page(spark):
    df = spark.createDataFrame([("INV 12", ["the", "inv", "12", "x"]), ("inv 13", ["inv", "12"]), ("a", None), ("", ["a"])], "v string, p array<string>")
    assert [r[0] for r in df.select(T.on_page(F.col("v"), F.col("p"))).collect()] == [True, False, None, False]


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2025-07-03", None, "2025-07-03"), ("20250704063500", "Australia/Sydney", "2025-07-03T20:35:00.000000Z"), ("1751684524", None, "2025-07-05T03:02:04.000000Z"),
        ("1752032626727", None, "2025-07-09T03:43:46.727000Z"), ("45844", None, "2025-07-06"), ("45844.583333", "Australia/Perth", "2025-07-06T06:00:00.000000Z"), ("45844.5", None, None),
        ("03/04/25", "America/Chicago", "2025-03-04"), ("03/04/25", "Australia/Perth", "2025-04-03"), ("13/04/25", "America/Chicago", "2025-04-13"), ("31/02/2026", None, None),
        ("12 juillet 2025", None, "2025-07-12"), ("31. März 2026", None, "2026-03-31"), ("17. Juli 2025", None, "2025-07-17"), ("01JUL2025", None, "2025-07-01"), ("16th July 2025", None, "2025-07-16"),
        ("Mon, 07 Jul 2025 18:07:17 +1000", None, "2025-07-07T08:07:17.000000Z"), ("3:25 PM, July 10, 2025 AEDT", None, "2025-07-10T04:25:00.000000Z"), ("19 Jul 2025 23:04:49 (UTC+10)", None, "2025-07-19T13:04:49.000000Z"),
        ("25 August 2025 15h29", "Australia/Sydney", "2025-08-25T05:29:00.000000Z"), ("2025-10-05T02:35", "Australia/Melbourne", None), ("2026-04-05 02:30", "Australia/Melbourne", None), ("2025-07-10T08:57:46", None, None),
        ("20250705T083100Z", None, "2025-07-05T08:31:00.000000Z"), ("12:06 PM, August 20, 2025 AEST", None, "2025-08-20T02:06:00.000000Z"), ("12:06 am, August 20, 2025 UTC", None, "2025-08-20T00:06:00.000000Z"),
        ("ASAP", None, None), ("", None, None), (None, None, None), ("30 days EOM", None, None), ("2025-08-07\xa0", None, "2025-08-07"), ("2025-07-10 25:00", "Australia/Perth", None), ("x" * 50_000, None, None),
    ],
)
def test_normal_form(text, zone, want):
    assert normal_form(text, zone) == want

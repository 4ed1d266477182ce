"""UBL 2.1 invoices and credit notes; prefixes and namespaces are ignored, broken payloads give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AMOUNT = "struct<_VALUE:string>"
_LINE = f"struct<ID:string,InvoicedQuantity:{_AMOUNT},CreditedQuantity:{_AMOUNT},LineExtensionAmount:{_AMOUNT},Item:struct<Name:string,SellersItemIdentification:struct<ID:string>>,Price:struct<PriceAmount:{_AMOUNT}>>"
_PARTY = "struct<Party:struct<PartyLegalEntity:struct<RegistrationName:string,CompanyID:string>>>"
_SCHEMA = (
    "ID string, IssueDate string, DueDate string, OrderReference struct<ID:string>, BillingReference struct<InvoiceDocumentReference:struct<ID:string>>, "
    f"AccountingSupplierParty {_PARTY}, AccountingCustomerParty {_PARTY}, TaxTotal struct<TaxAmount:{_AMOUNT}>, "
    f"LegalMonetaryTotal struct<LineExtensionAmount:{_AMOUNT},TaxInclusiveAmount:{_AMOUNT},PayableAmount:{_AMOUNT}>, "
    f"InvoiceLine array<{_LINE}>, CreditNoteLine array<{_LINE}>, __broken string"
)
HEADER = {
    "doc_number": "ID", "date": "IssueDate", "due_date": "DueDate", "po_reference": "OrderReference.ID", "original_invoice": "BillingReference.InvoiceDocumentReference.ID",
    "supplier_name": "AccountingSupplierParty.Party.PartyLegalEntity.RegistrationName", "supplier_abn": "AccountingSupplierParty.Party.PartyLegalEntity.CompanyID",
    "buyer_name": "AccountingCustomerParty.Party.PartyLegalEntity.RegistrationName", "subtotal": "LegalMonetaryTotal.LineExtensionAmount._VALUE", "gst": "TaxTotal.TaxAmount._VALUE",
}


def _parsed(records: DataFrame, xml: str) -> DataFrame:
    """The payloads that are whole, parsed once in the JVM; what the parser reports as broken is left out. The parser may stop
    at the end of the root, so a payload must also end there."""
    x = F.from_xml(F.col(xml), _SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    root = F.regexp_extract(F.col(xml), r"^[\s﻿]*(?:<\?[^>]*\?>\s*|<!--.*?-->\s*)*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z]+)", 1)
    whole = F.regexp_extract(F.col(xml), r"</(?:[A-Za-z_][\w.-]*:)?([A-Za-z]+)\s*>\s*$", 1)
    return records.where(root.isin("Invoice", "CreditNote") & (whole == root)).withColumns({"__x": x, "__root": root}).where(F.col("__x").isNotNull() & F.col("__x.__broken").isNull())


def _text(path: str) -> Column:
    return F.nullif(F.trim(F.col(f"__x.{path}")), F.lit(""))


def read_headers(records: DataFrame, xml: str = "payload") -> DataFrame:
    """One row per whole record: its other columns and the header fields as text; absent and empty fields are null.

    The total is the payable amount, or the tax-inclusive amount where that is absent or zero.
    """
    payable, inclusive = _text("LegalMonetaryTotal.PayableAmount._VALUE"), _text("LegalMonetaryTotal.TaxInclusiveAmount._VALUE")
    total = F.when(F.coalesce(payable.try_cast("double"), F.lit(0.0)) != 0, payable).otherwise(inclusive)
    kind = F.when(F.col("__root") == "CreditNote", "credit_note").otherwise("supplier_invoice")
    return _parsed(records, xml).select(*[c for c in records.columns if c != xml], kind.alias("doc_type"), *[_text(p).alias(f) for f, p in HEADER.items()], total.alias("total"))


def read_lines(records: DataFrame, key: str, xml: str = "payload") -> DataFrame:
    """(key, line_no, sku, description, quantity, unit_price, amount) per invoice or credit line, as text."""
    lines = _parsed(records, xml).select(key, F.posexplode(F.coalesce("__x.InvoiceLine", "__x.CreditNoteLine")).alias("n", "l"))
    return lines.select(
        key, (F.col("n") + 1).alias("line_no"), F.col("l.Item.SellersItemIdentification.ID").alias("sku"), F.col("l.Item.Name").alias("description"),
        F.coalesce("l.InvoicedQuantity._VALUE", "l.CreditedQuantity._VALUE").alias("quantity"), F.col("l.Price.PriceAmount._VALUE").alias("unit_price"), F.col("l.LineExtensionAmount._VALUE").alias("amount"),
    )

"""Money text to cents and decimals, on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_cents(c: Column) -> Column:
    """Printed money to signed cents (BIGINT).

    The last ``.`` or ``,`` is the decimal sign when one or two digits follow it; every other separator groups.
    Brackets, a minus sign at either end or the letters CR make it negative. Text without a digit, or with more
    than 17 digits, is null; currency signs and words are ignored.
    """
    text = F.coalesce(c, F.lit(""))
    figures = F.rtrim(F.regexp_replace(text, "[^0-9.,]", ""), F.lit(".,"))
    padding = F.when(figures.rlike(r"[.,]\d\d$"), "").when(figures.rlike(r"[.,]\d$"), "0").otherwise("00")
    cents = F.concat(F.regexp_replace(figures, "[.,]", ""), padding).try_cast("bigint")
    negative = text.rlike(r"(?i)^[^0-9]*[(\-−]|[-−][^0-9]*$|(^|[^A-Z])CR([^A-Z]|$)")
    return F.when(text.rlike("[0-9]"), F.when(negative, -cents).otherwise(cents))


def number_cents(c: Column) -> Column:
    """A DOUBLE amount to the cent, half away from zero; null and NaN give null."""
    return F.when(~F.isnan(c), F.round(c.cast("decimal(28,6)") * 100, 0).cast("bigint"))

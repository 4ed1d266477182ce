"""Document types from printed titles.

A title is a run of words. The phrases are data (``PHRASES``, or the caller's own); a cell is reduced to words, with the
letters that scanners confuse folded, and looked through for whole phrases. A phrase that fills more than half of its cell
is a title, less is a mention. How much it fills, and how far up the cell stands, make the score. A phrase that is followed by a colon, a numero sign or a word of a label names a field and is no title. Letters set
wide apart are read without their gaps.

Defined cases: null and empty cells name nothing; a document without any title is 'unknown' with score 0; ties go to the
longer phrase, then to the upper and left cell, then to the type's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.functions.text import bound

PHRASES: dict[str, list[str]] = {
    "supplier_invoice": ["invoice", "tax invoice", "sales invoice", "facture", "rechnung"],
    "credit_note": ["credit note", "credit memo", "adjustment note", "avoir", "gutschrift"],
    "goods_receipt": ["delivery docket", "delivery note", "packing slip", "goods received note", "lieferschein", "bon de livraison"],
    "purchase_order": ["order", "purchase order", "bestellung", "bon de commande"],
    "price_schedule": ["price list", "price schedule", "preisliste"],
    "remittance": ["remittance advice", "payment advice", "zahlungsavis"],
    "statement": ["statement of account", "account statement", "statement", "kontoauszug"],
}
LABEL_WORDS = ("no", "nr", "number", "date", "ref", "reference", "total")
#: Rows after which a title counts half.
HALF_ROWS = 25
#: Scores are whole numbers, so they are the same in any order of evaluation; a title alone in the first row has all.
FULL_SCORE = 1_000_000
# Signs that scanners exchange with the letter i.
LOOKALIKES, LETTERS = "l|", "ii"


def folded(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), LOOKALIKES, LETTERS)


def _fold(phrase: str) -> str:
    return phrase.translate(str.maketrans(LOOKALIKES, LETTERS))


def title_hit(cell: Column, row_no: Column, phrases: dict[str, list[str]] | None = None) -> Column:
    """struct(score, words, kind) of the best title in a cell, null if there is none."""
    def best(tokens: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        letters = F.regexp_replace(F.array_join(tokens, ""), "[^a-zäöüéèàç]", "")
        wide = (F.size(tokens) >= 4) & (F.length(letters) == F.size(F.filter(tokens, lambda t: F.length(t) == 1)))
        return bound(F.struct(line.alias("line"), letters.alias("letters"), wide.alias("wide"), F.size(tokens).alias("n")), of_line)

    def of_line(x: Column) -> Column:
        options = []
        for kind, list_of in (phrases or PHRASES).items():
            for phrase in list_of:
                words, n = _fold(phrase), len(phrase.split())
                spread = x["wide"] & (x["letters"] == words.replace(" ", ""))
                label = x["line"].rlike(f" {words} (?:[:#]|{'|'.join(_fold(w) for w in LABEL_WORDS)}) ")
                share = F.when(spread, F.lit(1.0)).when((2 * n > x["n"]) & F.contains(x["line"], F.lit(f" {words} ")) & ~label, F.lit(float(n)) / x["n"])
                score = F.floor(share * FULL_SCORE * HALF_ROWS / (HALF_ROWS + row_no)).cast("bigint")
                options.append(F.when(share.isNotNull(), F.struct(score.alias("score"), F.lit(n).alias("words"), F.lit(kind).alias("kind"))))
        return F.array_max(F.filter(F.array(*options), lambda h: h.isNotNull()))

    return bound(F.regexp_extract_all(folded(cell), F.lit(r"([a-zäöüéèàç]+|[0-9]+|[:#])"), F.lit(1)), best)


def title_type(cell: Column) -> Column:
    """The type a single title cell names, 'unknown' if none."""
    return F.coalesce(title_hit(cell, F.lit(0))["kind"], F.lit("unknown"))


def classify(cells: DataFrame, key: str = "ref", phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, doc_type, score, evidence) from ``cells`` (key, row_no, cell_no, text), row_no from 0 without blank rows.

    One aggregation with map-side combine; every cell of a document is looked at.
    """
    # Most cells hold none of the phrases' last words: they pay one pattern instead of all.
    ends = sorted({_fold(p).split()[-1] for ps in (phrases or PHRASES).values() for p in ps})
    likely = folded(F.col("text")).rlike("|".join(ends)) | (F.length(F.regexp_replace("text", r"\s", "")) * 2 <= F.length("text") + 1)
    hit = F.when(likely, title_hit(F.col("text"), F.col("row_no"), phrases))
    place = F.struct(F.col("hit.score").alias("s"), F.col("hit.words").alias("w"), (-F.col("row_no")).alias("r"), (-F.col("cell_no")).alias("c"), F.col("hit.kind").alias("kind"), "text")
    best = cells.select(key, "row_no", "cell_no", "text", hit.alias("hit")).groupBy(key).agg(F.max(F.when(F.col("hit").isNotNull(), place)).alias("b"))
    return best.select(key, F.coalesce("b.kind", F.lit("unknown")).alias("doc_type"), F.coalesce("b.s", F.lit(0)).cast("bigint").alias("score"), F.trim("b.text").alias("evidence"))

"""Words with positions, as a text layer or a recogniser gives them, to rows of cells.

Words of a page are taken from the top down; a word belongs to the row whose first word's middle is near its own, else it
begins a row. Within a row, from left to right, a gap wider than the letters are high begins a cell. Both are folds over
the words of one page, in the JVM.

Defined cases: words without text or position are left out; pages without words have no rows; of words at one place the
one with the lower number comes first; a font size of null counts as the word's height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "struct<mid:double,x0:double,n:bigint,x1:double,size:double,text:string>"


def _append(acc: Column, joins, item: Column, fresh: Column, grown) -> Column:
    last = F.element_at(acc, -1)
    return F.when((F.size(acc) > 0) & joins(last), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown(last)))).otherwise(F.concat(acc, F.array(fresh)))


def cells_of_words(words: DataFrame, page: list[str], *, row_gap: float = 3.0, row_gap_by_size: float | None = None, cell_gap: float = 0.9, least_size: float = 6.0) -> DataFrame:
    """(page columns, row_no, cells, xs) of ``words`` (page columns, word_no, text, x0, x1, top, bottom, size).

    ``row_gap`` is the most a middle may lie off its row's first word, or ``row_gap_by_size`` times that word's height;
    ``cell_gap`` times the height (at least ``least_size``) is the widest gap within a cell. One shuffle by page.
    """
    height = F.coalesce("size", F.col("bottom") - F.col("top"))
    word = F.struct(((F.col("top") + F.col("bottom")) / 2).cast("double").alias("mid"), F.col("x0").cast("double").alias("x0"), F.col("word_no").cast("bigint").alias("n"), F.col("x1").cast("double").alias("x1"), height.cast("double").alias("size"), F.col("text"))
    pages = words.where("trim(text) <> '' and x0 is not null and x1 is not null and top is not null and bottom is not null").groupBy(*page).agg(F.array_sort(F.collect_list(word)).alias("words"))
    near = lambda last, w: F.abs(w["mid"] - last["anchor"]) <= (F.lit(row_gap) if row_gap_by_size is None else row_gap_by_size * F.greatest(last["height"], F.lit(least_size)))
    rows = F.aggregate(
        "words",
        F.array().cast(f"array<struct<anchor:double,height:double,words:array<{_WORD}>>>"),
        lambda acc, w: _append(acc, lambda last: near(last, w), w, F.struct(w["mid"].alias("anchor"), w["size"].alias("height"), F.array(w).alias("words")), lambda last: F.struct(last["anchor"].alias("anchor"), last["height"].alias("height"), F.concat(last["words"], F.array(w)).alias("words"))),
    )
    each = pages.select(*page, F.posexplode(rows).alias("row_no", "row"))
    left_to_right = F.array_sort(F.transform("row.words", lambda w: F.struct(w["x0"].alias("x0"), w["n"].alias("n"), w["x1"].alias("x1"), w["size"].alias("size"), w["text"].alias("text"))))
    cells = F.aggregate(
        left_to_right,
        F.array().cast("array<struct<text:string,x0:double,x1:double>>"),
        lambda acc, w: _append(
            acc,
            lambda last: w["x0"] - last["x1"] <= cell_gap * F.greatest(w["size"], F.lit(least_size)),
            w,
            F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1")),
            lambda last: F.struct(F.concat(last["text"], F.lit(" "), w["text"]).alias("text"), last["x0"].alias("x0"), F.greatest(last["x1"], w["x1"]).alias("x1")),
        ),
    )
    return each.select(*page, "row_no", cells.alias("c")).select(*page, "row_no", F.col("c.text").alias("cells"), F.transform("c", lambda x: (x["x0"] + x["x1"]) / 2).alias("xs"))


def page_kinds(pages: DataFrame, key: list[str], text: str, least: int = 40) -> DataFrame:
    """Per document: how many pages hold text (``least`` characters that are no blanks) and how many are images, with the
    mean number of characters and the share of digits among them."""
    n = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s", ""))
    digits = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^0-9]", ""))
    return pages.groupBy(*key).agg(
        F.count("*").alias("pages"), F.count_if(n >= least).alias("text_pages"), F.count_if(n < least).alias("image_pages"),
        F.sum(n).cast("bigint").alias("chars"), F.sum(digits).cast("bigint").alias("digits"),
    )

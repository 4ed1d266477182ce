"""Pages to documents: boundaries between neighbouring pages, then islands; continuations to their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.functions.text import page_of
from ledgerquarry.operators import titles
from ledgerquarry.runtime import cut


def boundary(prev: dict[str, Column], page: dict[str, Column], first: Column) -> Column:
    """True where a new document begins. Keys: doc_type, title_strength, number, page_n, page_m, continued, continues.

    In order: marks of continuation and an unfinished 'n of m' keep, a page 1 cuts, a strong title with another number
    or another type cuts, else the page is kept.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    titled = no(page["title_strength"] >= 0.8)
    return (
        F.when(first, True)
        .when(no(page["continued"]) | no(prev["continues"]), False)
        .when(no((prev["page_n"] < prev["page_m"]) & (F.coalesce(page["page_n"], F.lit(0)) != 1)), False)
        .when(no(page["page_n"] == 1), True)
        .when(titled & no((page["number"] != prev["number"]) & (page["number"] != "") & (prev["number"] != "")), True)
        .when(titled & no((page["doc_type"] != prev["doc_type"]) & (prev["doc_type"] != "unknown")), True)
        .otherwise(False)
    )


def group_pages(pages: DataFrame, file: str = "ref", page: str = "page", tie: str | None = None, chunk: int = 1000) -> DataFrame:
    """Adds ``segment`` (1-based document number within the file).

    Pages are in the order of (``page``, ``tie``). A file may hold any share of all pages: its pages are parted by number
    into chunks, each chunk is one window, the last page of a chunk is handed to the next filled one, and the documents
    begun in the chunks before are added up per chunk. So no task sees more than a chunk's pages, and the sum per file runs
    over chunks only.
    """
    names = ("doc_type", "title_strength", "number", "page_n", "page_m", "continued", "continues")
    order = [F.col(page), *([F.col(tie)] if tie else [])]
    state = F.struct(*[F.col(n).alias(n) for n in names])
    parted = pages.withColumn("__chunk", F.floor(F.coalesce(F.col(page), F.lit(0)) / chunk).cast("bigint"))
    ends = parted.groupBy(file, "__chunk").agg(F.max_by(state, F.struct(*order)).alias("__last"))
    by_file = W.partitionBy(file).orderBy("__chunk")
    before = cut(ends.select(file, "__chunk", F.lag("__last").over(by_file).alias("__before")))
    same = lambda d: d.join(before.withColumnsRenamed({file: "__f", "__chunk": "__c"}), F.col(file).eqNullSafe(F.col("__f")) & (F.col("__chunk") == F.col("__c"))).drop("__f", "__c")
    w = W.partitionBy(file, "__chunk").orderBy(*order)
    prev = F.coalesce(F.lag(state).over(w), F.col("__before"))
    with_prev = same(parted).withColumn("__prev", prev)
    cut_here = boundary({n: F.col("__prev")[n] for n in names}, {n: F.col(n) for n in names}, F.col("__prev").isNull())
    marked = cut(with_prev.withColumn("__cut", cut_here.cast("int")).drop("__prev", "__before"))
    begun = marked.groupBy(file, "__chunk").agg(F.sum("__cut").alias("__n"))
    begun = begun.select(F.col(file).alias("__f"), F.col("__chunk").alias("__c"), F.coalesce(F.sum("__n").over(W.partitionBy(file).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    here = F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, 0))
    out = marked.withColumn("segment", here).join(begun, F.col(file).eqNullSafe(F.col("__f")) & (F.col("__chunk") == F.col("__c")))
    return out.withColumn("segment", (F.col("segment") + F.col("__offset")).cast("bigint")).drop("__cut", "__chunk", "__f", "__c", "__offset")


#: What a page says of its place: continued from the page before, or going on overleaf.
CONTINUED = r"(?i)\b(?:continued\s+from|cont(?:inued|'?d)?\s*\.?\s+from|page\s+continued)\b"
CONTINUES = r"(?i)\b(?:continue[sd]?\s+(?:over(?:leaf)?|on\s+(?:the\s+)?next)|carried\s+forward|please\s+turn\s+over|p\.?\s?t\.?\s?o\.?)(?!\w)"


def page_facts(pages: DataFrame, text: str, title: str, number: str) -> DataFrame:
    """Adds to pages what ``boundary`` asks for: doc_type and title_strength from the printed title, number, page_n and
    page_m from an 'n of m' mark, continued and continues from marks in the text; nothing found is null or false."""
    hit = titles.title_hit(F.col(title), F.lit(0))
    mark = page_of(F.coalesce(F.col(text), F.lit("")))
    body = F.coalesce(F.col(text), F.lit(""))
    return pages.withColumns({
        "doc_type": F.coalesce(hit["kind"], F.lit("unknown")), "title_strength": F.coalesce(hit["score"] / titles.FULL_SCORE, F.lit(0.0)), "number": F.coalesce(F.col(number), F.lit("")),
        "page_n": mark["n"], "page_m": mark["m"], "continued": body.rlike(CONTINUED), "continues": body.rlike(CONTINUES),
    })


def attach_continuations(parts: DataFrame, documents: DataFrame, *, scope: list[str], order: str = "seq") -> DataFrame:
    """(part_id, doc_id): the document each part goes on with.

    ``parts``: scope columns, part_id, doc_type, number, text; ``documents``: scope columns, doc_id, ``order``, doc_type,
    number. A part belongs to the first document of its scope with its type and number; a part without number to the first
    document whose number stands in its text as a whole word. The second way is an equi-join too: the words of the text
    meet the numbers. Parts that meet nothing give no row; empty numbers meet nothing.
    """
    known = documents.where("number <> ''").select(*scope, "doc_id", order, F.col("doc_type").alias("__type"), "number")
    ranked = lambda d, tier: d.select(*scope, "part_id", "doc_id", F.lit(tier).alias("tier"), order)
    same = parts.where("number <> ''").select(*scope, "part_id", "doc_type", "number").join(known, [*scope, "number"]).where("doc_type = __type")
    words = parts.where("coalesce(number, '') = ''").select(*scope, "part_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}\p{N}_](?:[\p{L}\p{N}_/.-]*[\p{L}\p{N}_])?)"), F.lit(1)))).alias("number"))
    quoted = words.join(known, [*scope, "number"])
    found = ranked(same, 0).unionByName(ranked(quoted, 1))
    return found.groupBy(*scope, "part_id").agg(F.min_by("doc_id", F.struct("tier", order, "doc_id")).alias("doc_id")).select("part_id", "doc_id")


def append_lines(lines: DataFrame, parts: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of documents (doc_id, line_no, columns) and, behind them, the lines of their continuations (part_id, line_no,
    columns) that the document does not have yet, compared null-safe over ``columns``; (doc_id, part_id, line_no, columns),
    part_id null for the document's own."""
    own = lines.select("doc_id", F.lit(None).cast(dict(parts.dtypes)["part_id"]).alias("part_id"), "line_no", *columns)
    more = parts.join(links, "part_id").select("doc_id", "part_id", "line_no", *columns)
    have = lines.select(F.col("doc_id").alias("__d"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)]).distinct()
    same = [F.col("doc_id") == F.col("__d"), *[F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(columns)]]
    new = more.join(have, same, "left_anti")
    return own.unionByName(new)

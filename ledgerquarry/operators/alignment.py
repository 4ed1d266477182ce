"""Known lines against read lines of the same document, one to one.

Pairs are taken from the highest score down; ties go to the earlier known line, then the earlier read line. This equals
the greedy assignment over all pairs of a document and needs no matrix: each round takes every pair that is the best of
both its sides, which are all pairs a greedy pass would take before touching either side. Lines that score alike with
all lines left stand for each other: equal lines of both sides pair by their ordinals in one round.

Defined cases: lines without partner stay unpaired; null descriptions score 0; empty sides give no pairs; repeated lines
are lines of their own (``line_no`` must tell them apart).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.runtime import cut


def greedy_pairs(pairs: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """(group, left, right, score): a one-to-one choice among scored pairs, best first. Every round is some aggregations,
    windows and joins on the cluster; the rounds needed are the longest chain of contention among unequal lines. Every
    round takes a pair, so it ends when none is left."""
    rest = cut(pairs.select(group, left, right, score).where(F.col(score).isNotNull()).distinct())
    chosen = None
    alike = lambda one, other: rest.groupBy(group, one).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(other, score)))), 256).alias(f"__{one}_class"))
    for taken_rounds in itertools.count(1):
        if rest.isEmpty():
            break
        # Place of a line among its like, and of a pair in the order of either line; a chain of pairs that stand at the
        # same place in all four, from the first on, is what a greedy pass takes of these lines.
        of_left, of_right = (alike(a, b).withColumn(f"__{a}_place", F.row_number().over(W.partitionBy(group, f"__{a}_class").orderBy(a))) for a, b in ((left, right), (right, left)))
        by_left, by_right = W.partitionBy(group, left).orderBy(F.desc(score), right), W.partitionBy(group, right).orderBy(F.desc(score), left)
        ranked = rest.withColumns({"__k": F.row_number().over(by_left), "__m": F.row_number().over(by_right)}).where("__k = __m")
        placed = ranked.join(of_left, [group, left]).join(of_right, [group, right]).where((F.col(f"__{left}_place") == F.col("__k")) & (F.col(f"__{right}_place") == F.col("__k")))
        chain = W.partitionBy(group, f"__{left}_class", f"__{right}_class").orderBy("__k")
        taken = cut(placed.withColumn("__n", F.row_number().over(chain)).where("__n = __k").select(group, left, right, score))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        chosen = cut(chosen) if taken_rounds % 20 == 0 else chosen
        rest = cut(rest.join(taken.select(group, left), [group, left], "left_anti").join(taken.select(group, right), [group, right], "left_anti"))
    return chosen if chosen is not None else rest.where("false")


def align_lines(known: DataFrame, read: DataFrame, group: str, line: str, score: Column, least: float = 0.5) -> DataFrame:
    """Scored pairs within each document, from ``least`` up, made one to one. ``score`` sees the known line's columns with
    the prefix ``k_`` and the read line's with ``r_``."""
    k = known.select(F.col(group), *[F.col(c).alias(f"k_{c}") for c in known.columns if c != group])
    r = read.select(F.col(group), *[F.col(c).alias(f"r_{c}") for c in read.columns if c != group])
    scored = k.join(r, group).withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return greedy_pairs(scored, group, f"k_{line}", f"r_{line}", "score")


def align_documents(known: DataFrame, found: DataFrame, file: str, *, same_number: int = 100) -> DataFrame:
    """(file, k_doc, f_doc, score): known documents and those read from the same file, one to one, best first.

    Both sides: file, doc, pages array<int>, number. The score is the number of pages they share, and ``same_number`` more
    where their numbers are the same. Pages and numbers meet in equi-joins; pairs that share nothing are never formed.
    """
    pages = lambda d, n: d.select(file, F.col("doc").alias(n), F.explode(F.array_distinct("pages")).alias("page"))
    numbers = lambda d, n: d.where("number <> ''").select(file, F.col("doc").alias(n), "number").distinct()
    by_page = pages(known, "k_doc").join(pages(found, "f_doc"), [file, "page"]).groupBy(file, "k_doc", "f_doc").agg(F.count("*").alias("score"))
    by_number = numbers(known, "k_doc").join(numbers(found, "f_doc"), [file, "number"]).select(file, "k_doc", "f_doc", F.lit(same_number).cast("bigint").alias("score")).distinct()
    scored = by_page.unionByName(by_number).groupBy(file, "k_doc", "f_doc").agg(F.sum("score").alias("score"))
    return greedy_pairs(scored, file, "k_doc", "f_doc", "score")


def exact_packets(truth: DataFrame, found: DataFrame, file: str, pages: str) -> DataFrame:
    """(file, exact): whether the found documents of a file are the true ones, as sets of page sets."""
    as_set = lambda d, n: d.groupBy(file).agg(F.array_sort(F.collect_set(F.array_sort(pages))).alias(n))
    return as_set(truth, "__true").join(as_set(found, "__found"), file, "left").select(file, F.coalesce(F.col("__true") == F.col("__found"), F.lit(False)).alias("exact"))

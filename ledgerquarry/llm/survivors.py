"""One surviving value per field of each group of duplicate records.

``survive`` takes the value that ranks first by stated trust: an ordered list of criteria, compared lexicographically, in
one aggregation per (group, field).

``fuse`` is Bayesian fusion with copy detection: each source has an accuracy, estimated together with the true values;
sources that share false values beyond chance depend on each other, and their votes are discounted; the value of highest
posterior survives. Sources are a small set (readers), groups are any number.

Defined cases: null and empty values never survive; a null in a criterion ranks last; remaining ties go to the smaller
record id; repeated rows count once; groups of one record are no group; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.functions.ids import digit_runs
from ledgerquarry.functions.text import literal_map
from ledgerquarry.llm.canonical import ACCENTED, UNACCENTED
from ledgerquarry.runtime import bounded_rows, cut


def rank_in(c: Column, order: list[str]) -> Column:
    """Position in the list; values not in it, and null, come after all."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def survive(candidates: DataFrame, group: list[str], criteria: list[Column], keep: list[str]) -> DataFrame:
    """For each group the ``keep`` columns of the row with the least criteria; partial aggregation, no window, no sort."""
    first = F.min_by(F.struct(*keep), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(criteria)]))
    return candidates.groupBy(*group).agg(first.alias("__first")).select(*group, *[F.col("__first")[k].alias(k) for k in keep])


STATUS_ORDER = ["read", "flagged", "held"]
EVIDENCE_ORDER = ["master", "structure", "label", "layout", "model", "none"]


def reading_groups(reads: DataFrame) -> DataFrame:
    """The readings that share doc_type and number with another reading; groups are counted before the join."""
    number = F.get(digit_runs(F.col("doc_number"), 9), F.lit(0))
    keyed = reads.select("read_id", "doc_type", "status", "received_at", "reader", number.alias("number_key")).where("doc_type is not null and number_key is not null")
    sizes = keyed.groupBy("doc_type", "number_key").agg(F.min("read_id").alias("a"), F.max("read_id").alias("b")).where("a <> b").select("doc_type", "number_key")
    return keyed.join(sizes, ["doc_type", "number_key"])


def competing_values(reads: DataFrame, values: DataFrame) -> DataFrame:
    """Every non-empty field value of a reading in a group, repeated rows once."""
    cells = values.select("read_id", "field_name", F.trim("value").alias("value"), "confidence", "evidence", "source").where("value <> '' and field_name is not null")
    return cells.join(reading_groups(reads), "read_id")


def surviving_readings(reads: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_type, number_key, field_name, read_id, value): the reading whose value survives, by status, evidence,
    confidence, time and id, in this order; duplicates of a file never supply a value."""
    rows = competing_values(reads, values).where("status is null or status <> 'duplicate'")
    criteria = [
        rank_in(F.col("status"), STATUS_ORDER),
        rank_in(F.coalesce(F.nullif(F.trim("evidence"), F.lit("")), F.lit("none")), EVIDENCE_ORDER),
        -F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0)),
        -F.coalesce(F.unix_micros("received_at"), F.lit(-(1 << 62))),
        F.col("read_id"),
        F.col("value"),
    ]
    return survive(rows, ["doc_type", "number_key", "field_name"], criteria, ["read_id", "value"])


# ---- Bayesian fusion --------------------------------------------------------------------------------------------------
#: False values a field can take, per true one, for the chance of two sources erring alike.
FALSE_VALUES = 50.0
PRIOR_COPY = 0.1
COPY_RATE = 0.8


def _independence(shared_true: float, shared_false: float, differ: float, a1: float, a2: float) -> float:
    """Posterior chance that neither of two sources copies the other, from what they share (log scale)."""
    pt, pf = a1 * a2, (1 - a1) * (1 - a2) / FALSE_VALUES
    pd = max(1e-9, 1 - pt - pf)
    mean = (a1 + a2) / 2
    ct, cf = COPY_RATE * mean + (1 - COPY_RATE) * pt, COPY_RATE * (1 - mean) + (1 - COPY_RATE) * pf
    cd = max(1e-9, (1 - COPY_RATE) * pd)
    gain = shared_true * np.log(ct / max(pt, 1e-9)) + shared_false * np.log(cf / max(pf, 1e-9)) + differ * np.log(cd / pd)
    return float(1 / (1 + PRIOR_COPY / (1 - PRIOR_COPY) * np.exp(np.clip(gain, -50, 50))))


def _pair_counts(claims: DataFrame, common: DataFrame) -> dict[tuple[str, str], tuple[float, float, float]]:
    """For each pair of sources that meet, on how many items they share a true value, share a false one, and differ.

    ``claims``: (item, source, value, share, truth), ``share`` being the part of the source's claims of the item that
    give the value: a source that gives several values shares and differs in part. Where truth is null, what is shared
    counts as true. ``common``: (a, b, n), on how many items both make a claim. One shuffle by (item, value); only pairs of
    sources that hold the same value are formed, at most the pairs of sources for a value, and summed before they move.
    """
    per_value = claims.groupBy("item", "value").agg(F.first("truth", ignorenulls=True).alias("truth"), F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"))
    true = F.coalesce(F.col("value") == F.col("truth"), F.lit(True))
    pairs = _pairs_of(per_value.where(F.size("s") > 1).select(true.alias("true"), "s"), "true")
    both = F.col("x.share") * F.col("y.share")
    sums = pairs.groupBy(F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(F.when(F.col("true"), both)).alias("t"), F.sum(F.when(~F.col("true"), both)).alias("f"))
    out = {}
    for r in common.join(sums, ["a", "b"], "left").collect():  # at most max_sources squared numbers
        t, f = float(r["t"] or 0.0), float(r["f"] or 0.0)
        out[(r["a"], r["b"])] = (t, f, max(0.0, r["n"] - t - f))
    return out


def _pairs_of(df: DataFrame, *keep: str) -> DataFrame:
    """Each pair of different entries of the sorted array ``s`` as ``x`` and ``y``."""
    return df.select(*keep, F.posexplode("s").alias("i", "x"), "s").select(*keep, "x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y"))


def _common_items(claims: DataFrame) -> DataFrame:
    """(a, b, n): on how many items each pair of sources makes a claim."""
    per_item = claims.groupBy("item").agg(F.array_sort(F.collect_set(F.struct("source"))).alias("s")).where(F.size("s") > 1)
    return _pairs_of(per_item).groupBy(F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.count("*").alias("n"))


def _vote_weights(counts: dict[tuple[str, str], tuple[float, float, float]], accuracy: dict[str, float]) -> dict[str, float]:
    """How much of each source's vote is its own: the less accurate of two dependent sources is taken for the copier."""
    own = {n: 1.0 for n in accuracy}
    for (a, b), (true, false, differ) in counts.items():
        chance = _independence(true, false, differ, accuracy[a], accuracy[b])
        own[a if accuracy[a] < accuracy[b] else b] *= 1 - COPY_RATE * (1 - chance)
    return own


def fuse(claims: DataFrame, *, claimant: str | None = None, rounds: int = 4, max_sources: int = 1000) -> DataFrame:
    """(item, value, posterior, n_sources): the value of highest posterior of each item.

    ``claims``: (item, source, value), item being of any type that can be grouped, and, where several records speak through
    one source, the column ``claimant`` that tells them apart: each has a vote of its own. Every distinct value of an item
    is a candidate. Accuracy and copying are those of the source. Dependence is first judged from agreement alone. Each
    round, votes are summed by item and value (map-side combined); the likeliest values give new accuracies and, for each
    pair of sources, how often they share true and false values, which gives the chance of copying; copied votes count
    less. Only numbers per source and pair of sources reach the driver.
    """
    claims = claims.where("item is not null and source is not null and value is not null")
    once = claims.select("item", "source", "value", F.col(claimant or "source").alias("claimant")).distinct()
    counted = cut(once.groupBy("item", "source", "value").agg(F.count("*").alias("n")))
    of_source = counted.groupBy("item", "source").agg(F.sum("n").alias("__all"))
    claims = cut(counted.join(of_source, ["item", "source"]).select("item", "source", "value", "n", (F.col("n") / F.col("__all")).alias("share")))
    names = sorted(r[0] for r in bounded_rows(claims.select("source").distinct(), max_sources, "the sources"))
    common = cut(_common_items(claims))
    accuracy = {n: 0.8 for n in names}
    weight = _vote_weights(_pair_counts(claims.withColumn("truth", F.lit(None).cast("string")), common), accuracy)
    best = None
    for _ in range(rounds):
        votes_of = {n: weight[n] * float(np.log(FALSE_VALUES * accuracy[n] / (1 - accuracy[n]))) for n in names}
        vote = F.coalesce(F.try_element_at(literal_map(votes_of, "double"), F.col("source")), F.lit(0.0))
        # The values of an item may be any number: they are summed, never listed.
        votes = claims.groupBy("item", "value").agg(F.sum(F.col("n") * vote).alias("v"), F.count("*").alias("n_sources"))
        top = votes.groupBy("item").agg(F.max_by(F.struct("value", "n_sources"), F.struct("v", "value")).alias("top"), F.max("v").alias("most"))
        total = votes.select("item", "v").join(top, "item").groupBy("item").agg(F.first("top").alias("top"), F.first("most").alias("most"), F.sum(F.exp(F.col("v") - F.col("most"))).alias("sum"))
        best = cut(total.select("item", F.col("top.value").alias("value"), (1 / (F.col("sum") + F.exp(-F.col("most")) * FALSE_VALUES)).alias("posterior"), F.col("top.n_sources").alias("n_sources")))
        judged = cut(claims.join(best.select("item", F.col("value").alias("truth"), "posterior"), "item"))
        chance = F.when(F.col("value") == F.col("truth"), F.col("posterior")).otherwise((1 - F.col("posterior")) / FALSE_VALUES)
        right = judged.groupBy("source").agg((F.sum(F.col("n") * chance) / F.sum("n")).alias("a")).collect()
        accuracy |= {r[0]: float(min(0.99, max(0.05, r[1]))) for r in right}
        weight = _vote_weights(_pair_counts(judged, common), accuracy)
    return best


def comparison_key(c: Column) -> Column:
    """What two values must share to count as one: letters and digits of any script, without case and accents of the Latin
    alphabet, with the signs that numbers and dates need; '' where nothing is left."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, UNACCENTED), r"[^\p{L}\p{N}.,:/-]", "")


def fused_readings(reads: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_type, number_key, field_name, value, posterior, n_sources) by Bayesian fusion: every reading votes,
    with the accuracy of the channel it came through.

    Values are compared by ``comparison_key``; the value given is the most frequent printed form of the winning key, the
    smallest of equals. Values whose key is empty make no claim.
    """
    group = ["doc_type", "number_key", "field_name"]
    rows = competing_values(reads, values).where("status is null or status <> 'duplicate'")
    rows = cut(rows.select(F.struct(*group).alias("item"), "read_id", F.coalesce("source", "reader").alias("source"), comparison_key(F.col("value")).alias("key"), "value").where("key <> ''").distinct())
    best = fuse(rows.select("item", "read_id", "source", F.col("key").alias("value")), claimant="read_id")
    forms = rows.groupBy("item", "key", "value").agg(F.count("*").alias("n")).groupBy("item", "key").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("form"))
    out = best.join(forms.withColumnRenamed("key", "value"), ["item", "value"])
    return out.select(*[F.col("item")[g].alias(g) for g in group], F.col("form").alias("value"), "posterior", "n_sources")

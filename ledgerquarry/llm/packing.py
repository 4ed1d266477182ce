"""Texts into containers of fixed capacity: pattern packing by non-negative least squares.

Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver. There, patterns of few documents that
fill a container, exactly where the histogram allows, are enumerated; repeat counts are fitted to the histogram by
non-negative least squares, rounded, and trimmed to what exists; what is left is packed by best fit, also on the
histogram. The plan says which ranks of each length go to which container; its size depends on the capacity and the
number of patterns, not on the corpus. Documents are then ranked within their length and looked up.

Ranks come from counts per (length, salt), so a length that a third of all documents share is ranked by many tasks.

Defined cases: null texts are left out; a text without tokens has one piece of 0 tokens in container -1; a text longer
than the capacity is cut into full containers and a rest, and nothing else is split; repeated rows are packed each; an
empty table gives no rows; a capacity under 1 is refused.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerquarry.functions.text import literal_map
from ledgerquarry.runtime import cut

CAPACITY = 2048
PATTERNS = 3000
MOST_DOCS = 64
ROWS_PER_SALT = 1_000_000
FIT_STEPS = 1000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for pdf in batches:
            texts, sizes = pdf["__text"].tolist(), []
            start = 0
            while start < len(texts):  # a bounded number of characters at a time
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) < 500_000):
                    chars += len(texts[stop])
                    stop += 1
                sizes += [len(e.ids) for e in tokenizer.encode_batch(texts[start:stop], add_special_tokens=False)]
                start = stop
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": sizes})

    return run


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; the tokenizer file must lie at the same path on every worker."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).where(F.col(text).isNotNull())
    return rows.mapInPandas(_counter(tokenizer), f"doc_id {kind}, n_tokens int")


class Plan:
    """Container numbers for each length and rank: intervals of ranks, each going to consecutive containers."""

    def __init__(self) -> None:
        self.taken: dict[int, int] = {}
        self.intervals: list[tuple[int, int, int]] = []
        self.containers = 0

    def use(self, pattern: dict[int, int], times: int) -> None:
        for length, many in pattern.items():
            for _ in range(many):
                start = self.taken.get(length, 0)
                self.intervals.append((length, start, self.containers))
                self.taken[length] = start + times
        self.containers += times


def enumerate_patterns(counts: np.ndarray, capacity: int, n: int, seed: int = 11) -> list[dict[int, int]]:
    """Up to ``n`` patterns of few documents: the first documents drawn as the histogram has them, the last one or two
    chosen to fill the container exactly if such lengths exist, else best."""
    rng = np.random.default_rng(seed)
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    share = counts[lengths] / counts[lengths].sum()
    present = counts > 0
    found: dict[tuple[tuple[int, int], ...], dict[int, int]] = {}
    draws = rng.choice(lengths, size=(n, MOST_DOCS), p=share)
    must = rng.permutation(np.resize(lengths, n))
    for first, rest in zip(must, draws):
        space, docs = capacity - int(first), [int(first)]
        for x in rest:
            x = int(x)
            if space - x < 0 or len(docs) >= MOST_DOCS - 2:
                break
            # Stop drawing where one or two lengths can close the container exactly.
            if len(docs) > 1 and space <= lengths[-1] and present[space]:
                break
            docs.append(x)
            space -= x
        if space > 0:
            if space < len(present) and present[space]:
                docs.append(space)
                space = 0
            else:
                fit = lengths[lengths < space]
                pair = fit[present[space - fit]] if len(fit) else fit
                if len(pair):
                    x = int(pair[rng.integers(len(pair))])
                    docs += [x, space - x]
                    space = 0
                elif len(fit):
                    docs.append(int(fit[-1]))
        values, many = np.unique(docs, return_counts=True)
        pattern = {int(v): int(m) for v, m in zip(values, many)}
        found.setdefault(tuple(sorted(pattern.items())), pattern)
    return list(found.values())


def fit_counts(patterns: list[dict[int, int]], counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares of the histogram by patterns, by accelerated projected gradient."""
    # The matrix (lengths x patterns) is sparse: a pattern has few lengths.
    cells = [(length, j, many) for j, p in enumerate(patterns) for length, many in p.items()]
    row, col, val = (np.array(x) for x in zip(*cells))
    ahead = lambda x: np.bincount(row, weights=val * x[col], minlength=len(counts))
    back = lambda r: np.bincount(col, weights=val * r[row], minlength=len(patterns))
    h, v = counts.astype(float), np.ones(len(patterns))
    for _ in range(12):
        v = back(ahead(v))
        v /= max(float(np.linalg.norm(v)), 1e-30)
    bound = float(np.linalg.norm(back(ahead(v)))) * 1.05 or 1.0
    x = np.full(len(patterns), float(h @ np.arange(len(h))) / len(patterns) / (len(h) - 1))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(ahead(y) - h) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + ((t - 1) / t2) * (new - x), new, t2
    return x


def make_plan(counts: np.ndarray, capacity: int, n_patterns: int = PATTERNS) -> Plan:
    """``counts[i]``: pieces of i tokens, i from 0 to ``capacity``."""
    plan, left = Plan(), counts.astype(np.int64).copy()
    left[0] = 0
    if left[capacity]:
        plan.use({capacity: 1}, int(left[capacity]))
        left[capacity] = 0
    patterns = enumerate_patterns(left, capacity, n_patterns)
    if patterns:
        repeats = np.floor(fit_counts(patterns, left) + 0.5).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            times = min([int(repeats[j]), *(int(left[x] // m) for x, m in patterns[j].items())])
            if times > 0:
                plan.use(patterns[j], times)
                for x, m in patterns[j].items():
                    left[x] -= times * m
    # The residual: the longest first, each container filled with the longest that fit; repeated while counts allow.
    present = [int(x) for x in np.flatnonzero(left)]
    while present:
        space, pattern = capacity, {}
        i = len(present) - 1
        while i >= 0 and space > 0:
            i = int(np.searchsorted(present, space, "right")) - 1 if i == len(present) - 1 or present[i] > space else i
            if i < 0:
                break
            x = present[i]
            many = min(space // x, int(left[x]))
            if many:
                pattern[x] = many
                space -= many * x
            i -= 1
        times = min(int(left[x] // m) for x, m in pattern.items())
        plan.use(pattern, times)
        for x, m in pattern.items():
            left[x] -= times * m
            if left[x] == 0:
                del present[int(np.searchsorted(present, x))]
    return plan


def _lookup(plan: Plan, columns: list[str]):
    rows = np.array(sorted(plan.intervals), dtype=np.int64).reshape(-1, 3)
    parts = np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []
    by_length = {int(p[0, 0]): (p[:, 1], p[:, 2]) for p in parts}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), -1, dtype=np.int64)
            lengths, ranks = pdf["n_tokens"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for at in np.split(order, cuts):
                if len(at) and lengths[at[0]] > 0:
                    starts, containers = by_length[int(lengths[at[0]])]
                    k = np.searchsorted(starts, ranks[at], "right") - 1
                    out[at] = containers[k] + ranks[at] - starts[k]
            yield pdf.assign(container=out)[columns]

    return run


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, n_patterns: int = PATTERNS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container) for every piece of every text.

    Shuffles: the histogram (partial sums), counts per length and salt, and one of the small (id, length) rows for ranks.
    A length has as many salts as its count asks for, so no task ranks more than about ``rows_per_salt`` pieces.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least one token")
    sizes = token_counts(docs, doc_id, text, tokenizer)
    starts = F.when(F.col("n_tokens") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity)))
    pieces = sizes.select("doc_id", "n_tokens", F.posexplode(starts).alias("piece", "start_token"))
    pieces = cut(pieces.select("doc_id", "piece", "start_token", F.least(F.col("n_tokens") - F.col("start_token"), F.lit(capacity)).alias("n_tokens")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect():  # at most capacity + 1 rows
        counts[r["n_tokens"]] = r["n"]
    plan = make_plan(counts, capacity, n_patterns)
    salts = literal_map({str(n): int(c // rows_per_salt) + 1 for n, c in enumerate(counts) if c >= rows_per_salt}, "int")
    n_salts = F.coalesce(F.try_element_at(salts, F.col("n_tokens").cast("string")), F.lit(1))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), n_salts).cast("int"))
    groups = pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("n_tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = groups.select(F.col("n_tokens").alias("n2"), F.col("salt").alias("salt2"), F.coalesce(before, F.lit(0)).alias("offset"))
    order = F.row_number().over(W.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", order.cast("bigint")).join(offsets, (F.col("n_tokens") == F.col("n2")) & (F.col("salt") == F.col("salt2")))
    ranked = ranked.select("doc_id", "piece", "start_token", "n_tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    kind, columns = dict(pieces.dtypes)["doc_id"], ["doc_id", "piece", "start_token", "n_tokens", "container"]
    packed = ranked.mapInPandas(_lookup(plan, columns), f"doc_id {kind}, piece int, start_token int, n_tokens int, container bigint")
    return packed.withColumnRenamed("doc_id", doc_id)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How full the containers are: one row with their number, tokens, share used and the fullest."""
    each = packed.where("container >= 0").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("share_used"), F.max("used").alias("fullest"))

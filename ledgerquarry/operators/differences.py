"""Differences between two copies of one dataset.

Copies may hold several rows under one key. Rows that agree in every compared field cancel first, by multiplicity.
What is left is paired within its key at the least total number of differing fields; rows that stay unpaired are
missing on the other side.

Defined cases: a null is a value of its own (equal to null, different from anything else); a null key equals a null
key; an empty copy makes every row of the other one-sided; ties in the pairing are settled by the order of values, so
the reported difference counts are always the same; extra columns are ignored and may bear any name.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.runtime import cut

LEFT_ONLY, RIGHT_ONLY = "left_only", "right_only"
#: Leftover rows of one key whose costs are held as a matrix; larger keys are paired over their distinct values.
EXACT_GROUP_ROWS = 400


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order``; one aggregation with map-side combine, so hot keys are safe."""
    last = F.max_by(F.struct(*[F.col(f) for f in fields]), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, *[F.col("__last")[f].alias(f) for f in fields])


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (rows <= columns) by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = (reduced < low[1:]) & ~used[1:]
            low[1:][better] = reduced[better]
            way[1:][better] = j0
            free = np.where(used[1:], np.inf, low[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def _pair_group(fields: list[str], columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["__n"].abs().astype(int))]
        values = pdf[fields].astype(object).where(pdf[fields].notna(), None)
        order = sorted(range(len(pdf)), key=lambda i: [(x is not None, x if x is not None else 0) for x in values.iloc[i]])
        pdf, values = pdf.iloc[order].reset_index(drop=True), values.iloc[order].to_numpy()
        sign = pdf["__n"].to_numpy() > 0
        a, b = np.flatnonzero(sign), np.flatnonzero(~sign)
        swap = len(a) > len(b)
        r, c = (b, a) if swap else (a, b)
        cost = np.array([[sum(x != y for x, y in zip(values[i], values[j])) for j in c] for i in r], dtype=float).reshape(len(r), len(c))
        pairs = [(r[i], c[j]) for i, j in assign(cost)] if len(r) else []
        pairs = [(j, i) if swap else (i, j) for i, j in pairs]
        left = dict(pairs)
        right = {j for _, j in pairs}
        rows = [(i, left.get(i)) for i in a] + [(None, j) for j in b if j not in right]
        keys = [c for c in columns if c.startswith("__k")]
        out = []
        for i, j in rows:
            base = pdf.iloc[i if i is not None else j]
            row = {k: base[k] for k in keys} | {"__inl": i is not None, "__inr": j is not None, "__count": 1}
            for n, f in enumerate(fields):
                row[f"__l{n}"] = values[i][n] if i is not None else None
                row[f"__r{n}"] = values[j][n] if j is not None else None
            out.append(row)
        return pd.DataFrame(out, columns=columns)

    return run


def transport(left: list[tuple], right: list[tuple], n_left: list[int], n_right: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, count): values of both sides paired, by multiplicity, at the least total of differing fields.

    Pairs meet in hubs, one for each set of fields and their values, that cost what the other fields may differ; so the
    graph grows with the values, not with their pairs. The flow is the cheapest at every step (shortest paths with
    potentials) and sent in bulk (levels, blocking flows), so the total is the least. Hubs without fields take what
    agrees in nothing, so the smaller side is always used up.
    """
    d = len(left[0]) if left else 0
    to, cap, cost, graph = [], [], [], [[] for _ in range(2 + len(left) + len(right))]

    def add(u: int, v: int, c: int, w: int) -> None:
        for x, y, c_, w_ in ((u, v, c, w), (v, u, 0, -w)):
            graph[x].append(len(to))
            to.append(y), cap.append(c_), cost.append(w_)

    first_right, want = 2 + len(left), min(sum(n_left), sum(n_right))
    for i, n in enumerate(n_left):
        add(0, 2 + i, n, 0)
    for j, n in enumerate(n_right):
        add(first_right + j, 1, n, 0)
    for size in range(d):
        for same in itertools.combinations(range(d), size):
            sides: dict[tuple, tuple[list[int], list[int]]] = {}
            for side, values in enumerate((left, right)):
                for i, v in enumerate(values):
                    sides.setdefault(tuple(v[f] for f in same), ([], []))[side].append(i)
            for a, b in sides.values():
                if a and b:
                    graph.append([])
                    for i in a:
                        add(2 + i, len(graph) - 1, want, d - size)
                    for j in b:
                        add(len(graph) - 1, first_right + j, want, 0)
    price, sent = [0] * len(graph), 0
    while sent < want:
        far = [None] * len(graph)
        far[0], heap = 0, [(0, 0)]
        while heap:
            x, u = heapq.heappop(heap)
            if x > far[u]:
                continue
            if u == 1:
                break
            for e in graph[u]:
                if cap[e]:
                    v, y = to[e], x + cost[e] + price[u] - price[to[e]]
                    if far[v] is None or y < far[v]:
                        far[v] = y
                        heapq.heappush(heap, (y, v))
        price = [p + (far[1] if x is None else min(x, far[1])) for p, x in zip(price, far)]
        while True:
            level, queue = [-1] * len(graph), [0]
            level[0] = 0
            for u in queue:
                for e in graph[u]:
                    v = to[e]
                    if cap[e] and level[v] < 0 and cost[e] + price[u] == price[v]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[1] < 0:
                break
            at, path, u = [0] * len(graph), [], 0
            while True:
                if u == 1:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    sent, path, u = sent + push, [], 0
                while at[u] < len(graph[u]):
                    e = graph[u][at[u]]
                    if cap[e] and level[to[e]] == level[u] + 1 and cost[e] + price[u] == price[to[e]]:
                        break
                    at[u] += 1
                else:
                    if u == 0:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                    continue
                path.append(e)
                u = to[e]
    pairs = []
    for hub in range(first_right + len(right), len(graph)):
        come = [[to[e] - 2, cap[e ^ 1] if e & 1 == 0 else cap[e]] for e in graph[hub] if to[e] < first_right]
        go = [[to[e] - first_right, cap[e ^ 1]] for e in graph[hub] if to[e] >= first_right]
        come, go = [x for x in come if x[1]], [x for x in go if x[1]]
        while come and go:
            n = min(come[-1][1], go[-1][1])
            pairs.append((come[-1][0], go[-1][0], n))
            for side in (come, go):
                side[-1][1] -= n
                if not side[-1][1]:
                    side.pop()
    return pairs


def _pair_values(fields: list[str], columns: list[str]):
    """The leftovers of one key, one row per value with a signed count, paired at the least total by ``transport``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[fields].astype(object).where(pdf[fields].notna(), None)
        rows = sorted(zip(map(tuple, values.to_numpy()), pdf["__n"].astype(int)), key=lambda r: [(x is not None, x if x is not None else 0) for x in r[0]])
        left, right = [r for r in rows if r[1] > 0], [(v, -n) for v, n in rows if n < 0]
        pairs = transport([v for v, _ in left], [v for v, _ in right], [n for _, n in left], [n for _, n in right])
        more_l, more_r = [n for _, n in left], [n for _, n in right]
        for i, j, n in pairs:
            more_l[i] -= n
            more_r[j] -= n
        pairs += [(i, None, n) for i, n in enumerate(more_l) if n] + [(None, j, n) for j, n in enumerate(more_r) if n]
        keys = [pdf[c].iloc[0] for c in columns if c.startswith("__k")]
        none = (None,) * len(fields)
        out = [(*keys, *(none if i is None else left[i][0]), *(none if j is None else right[j][0]), i is not None, j is not None, n) for i, j, n in pairs]
        return pd.DataFrame(out, columns=columns)

    return run


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], *, exact_group_rows: int = EXACT_GROUP_ROWS) -> DataFrame:
    """One row per differing pair or unmatched row: keys, ``diff`` (left_only, right_only or a field's name), ``n``.

    A pair that differs in several fields gives one row for each. ``n`` counts repeats. Shuffles once on the key: both
    sides are summed by (key, values) with opposite signs, so identical rows cancel before anything is paired.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    v = [f"__v{i}" for i in range(len(fields))]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], *[F.col(c).alias(a) for c, a in zip(fields, v)], F.lit(sign).cast("bigint").alias("__n"))

    # Only rows that differ are left here, and every later step reads them again: they are written once.
    left_over = cut(side(left, 1).unionByName(side(right, -1)).groupBy(*k, *v).agg(F.sum("__n").alias("__n")).where("__n <> 0"))
    # Per key: how many rows are left on each side, and, when there is one of each at most, the rows themselves.
    pos, neg = F.when(F.col("__n") > 0, F.struct(*v)), F.when(F.col("__n") < 0, F.struct(*v))
    per_key = left_over.groupBy(*k).agg(
        F.sum(F.abs("__n")).alias("__rows"),
        F.sum(F.when(F.col("__n") > 0, F.col("__n")).otherwise(0)).alias("__nl"),
        F.sum(F.when(F.col("__n") < 0, -F.col("__n")).otherwise(0)).alias("__nr"),
        F.max(pos).alias("__a"), F.max(neg).alias("__b"),
    )
    wide = [f"__l{i}" for i in range(len(v))] + [f"__r{i}" for i in range(len(v))]
    simple = per_key.where("__nl <= 1 and __nr <= 1").select(
        *k, *[F.col("__a")[c].alias(f"__l{i}") for i, c in enumerate(v)], *[F.col("__b")[c].alias(f"__r{i}") for i, c in enumerate(v)],
        (F.col("__nl") > 0).alias("__inl"), (F.col("__nr") > 0).alias("__inr"), F.lit(1).cast("bigint").alias("__count"),
    )
    busy = per_key.where("__nl > 1 or __nr > 1").select(*[F.col(c).alias(f"{c}_") for c in k], "__rows")
    many = left_over.join(busy, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in k]).drop(*[f"{c}_" for c in k])
    types = dict(left_over.dtypes)
    columns = [*k, *wide, "__inl", "__inr", "__count"]
    schema = ", ".join([f"{c} {types[c]}" for c in k] + [f"__l{i} {types[c]}" for i, c in enumerate(v)] + [f"__r{i} {types[c]}" for i, c in enumerate(v)] + ["__inl boolean", "__inr boolean", "__count bigint"])
    exact = many.where(F.col("__rows") <= exact_group_rows).drop("__rows").groupBy(*k).applyInPandas(_pair_group(v, columns), schema)
    pairs = simple.unionByName(exact)
    if not busy.where(F.col("__rows") > exact_group_rows).isEmpty():
        pairs = pairs.unionByName(many.where(F.col("__rows") > exact_group_rows).drop("__rows").groupBy(*k).applyInPandas(_pair_values(v, columns), schema))
    diff = F.when(~F.col("__inr"), F.array(F.lit(LEFT_ONLY))).when(~F.col("__inl"), F.array(F.lit(RIGHT_ONLY))).otherwise(
        F.filter(F.array(*[F.when(~F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")), F.lit(name)) for i, name in enumerate(fields)]), lambda x: x.isNotNull())
    )
    return pairs.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], F.explode(diff).alias("diff"), F.col("__count").alias("n")).groupBy(*keys, "diff").agg(F.sum("n").alias("n"))

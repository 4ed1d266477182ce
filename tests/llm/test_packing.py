import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerquarry.llm import packing as P

needs_tokenizer = pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer file")


@given(st.lists(st.integers(0, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, dtype=int)
    plan = P.make_plan(counts, 64, 50)
    used, ranks = Counter(), Counter()
    for length, start, first in plan.intervals:
        own = sorted(s for x, s, _ in plan.intervals if x == length)
        after = [s for s in own if s > start]
        times = (after[0] if after else plan.taken[length]) - start
        ranks[length] += times
        for c in range(first, first + times):
            used[c] += length
    assert all(v <= 64 for v in used.values())
    assert all(ranks[n] == c for n, c in enumerate(counts) if n > 0)
    assert plan.containers == len(used)


def test_plan_is_tight():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(5, 0.8, 200_000).astype(int), 1, 2048), minlength=2049)
    plan = P.make_plan(counts, 2048)
    assert counts @ np.arange(2049) / (plan.containers * 2048) > 0.995


def test_fit_is_non_negative_and_close():
    patterns = [{1: 2, 3: 1}, {2: 1}, {3: 3}]
    x = P.fit_counts(patterns, np.array([0, 20, 7, 40]))
    assert (x >= 0).all() and np.allclose(x, [10, 7, 10], atol=0.1)


@needs_tokenizer
def test_pack(spark):
    from tokenizers import Tokenizer

    texts = ["one two three"] * 30 + ["word " * 500, "", None, "a", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, "one two three", 5)], "doc_id bigint, text string, piece int")
    got = P.pack(df, capacity=64).collect()
    tokenizer = Tokenizer.from_file(P.TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts) if t is not None}
    total, used = Counter(), Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        used[r.container] += r.n_tokens
    assert all(total[i] == n * (2 if i == 0 else 1) for i, n in want.items()) and 32 not in {r.doc_id for r in got}
    assert max(used.values()) <= 64 and used[-1] == 0 and [r.container for r in got if r.doc_id == 31] == [-1]
    pieces = Counter(r.doc_id for r in got)
    assert all(n == 1 for i, n in pieces.items() if i and want[i] <= 64) and pieces[30] == -(-want[30] // 64)
    salted = Counter()
    for r in P.pack(df, capacity=64, rows_per_salt=3).collect():  # a frequent length is ranked in many parts
        salted[r.container] += r.n_tokens
    assert sorted(salted.values()) == sorted(used.values()) and set(salted) == set(used)
    assert P.pack(df.where("false"), capacity=64).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, capacity=0)

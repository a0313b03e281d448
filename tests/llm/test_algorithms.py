"""Top N and co-occurrence against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scenarium.llm import cooccur, topn

ITEM = "level string, group_key string, item_key string, score double, tie bigint, num bigint, extra string, rnk int"


@pytest.mark.parametrize("heap_rows", [5, 400_000])
def test_top(spark, heap_rows):
    rng = random.Random(2)
    rows = []
    for i in range(1500):  # one group has most items; ties in all but the key; repeated rows; nulls and NaN
        level = rng.choice("ab")
        group = rng.choice(["hot"] * 6 + ["x", "y", "", None])
        score = rng.choice([0.5, 0.9, 0.9, None, math.nan, round(rng.random(), 2), 0.0, -0.0])
        rows.append((level, group, rng.choice([f"k{i % 40}", None]), score, rng.choice([None, 0, 1]), rng.choice([None, i % 50]), "e", 1))
    rows += rows[::7]
    limits = {"a": 3, "b": 2}
    by: dict = {}
    for r in rows:
        if r[1] is not None and r[3] is not None and not math.isnan(r[3]):
            last = (1 << 63) - 1
            tie, num = (last if x is None else x for x in r[4:6])
            by.setdefault(r[:2], set()).add((-r[3] + 0.0, tie, num, r[2]))
    want = set()
    for (level, group), items in by.items():
        for n, (_, _, num, key) in enumerate(sorted(items, key=lambda x: (*x[:3], x[3] is not None, x[3] or ""))[: limits[level]]):
            want.add((level, group, key if key is not None else str(num), n + 1))
    df = spark.createDataFrame(rows, ITEM).repartition(6)
    got = [tuple(r) for r in topn.top_items(df, limits, heap_rows).collect()]
    assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}
    assert {r for r in got} == want and len(got) == len(want)
    assert topn.top_items(df.limit(0), limits).count() == 0


def brute(records):
    one, two, n = Counter(), Counter(), 0
    for r in records:
        items = sorted({x for x in r or [] if x is not None})
        n += bool(items)
        one.update(items)
        two.update(combinations(items, 2))
    return one, two, n


@pytest.mark.parametrize(("cells", "block"), [(3, 5), (2_000_000, 1_000_000)])
def test_pairs(spark, monkeypatch, cells, block):
    monkeypatch.setattr(cooccur, "PAIR_BLOCK", block)
    rng = random.Random(4)
    records = [[rng.choice(["hot", "a", "b", "ç", None, *"cdefgh"]) for _ in range(rng.randrange(7))] + ["hot"] * (i % 3 == 0) for i in range(200)] + [None, [], [None], ["solo"]]
    records.append([f"w{i}" for i in range(40)])  # longer than a block of pairs
    one, two, n = brute(records)
    df = spark.createDataFrame([(r, "x") for r in records], "items array<string>, n string").repartition(3)
    got = {(r.item_a, r.item_b): r.n for r in cooccur.pair_counts(df, cells, 4).collect()}
    assert got == {**{(k, k): v for k, v in one.items()}, **two}
    found = cooccur.together(df, 3, 3, cells=cells, slices=4).collect()
    assert {(r.item_a, r.item_b) for r in found} == {k for k, v in two.items() if v >= 3 and v * n >= 3 * one[k[0]] * one[k[1]]}
    assert all(r.n == n and r.n_a == one[r.item_a] for r in found)
    more = {(r.item_a, r.item_b): r for r in cooccur.together(df, 1, 0, 5.0, cells, 4).collect()}
    h = lambda *xs: sum(x * math.log(x) for x in xs if x)
    llr = {(a, b): 2 * (h(v, one[a] - v, one[b] - v, n - one[a] - one[b] + v, n) - h(one[a], one[b], n - one[a], n - one[b])) for (a, b), v in two.items()}
    assert more.keys() == {k for k, v in llr.items() if v >= 5.0} and all(r.llr == pytest.approx(llr[k]) for k, r in more.items())


def test_log_likelihood(spark):
    got = spark.range(1).select(cooccur.log_likelihood(*(F.lit(x).cast("bigint") for x in (10, 20, 30, 1000))).alias("x")).first().x
    obs = [[10, 10], [20, 960]]
    want = 2 * sum(o * math.log(o / (sum(row) * sum(r[j] for r in obs) / 1000)) for row in obs for j, o in enumerate(row))
    assert got == pytest.approx(want)
    assert cooccur.together(spark.createDataFrame([], "items array<string>")).count() == 0

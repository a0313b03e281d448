"""Set metrics per row and their averages per condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITION = ["detector", "scene_model", "captioner"]


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))


def set_prf(pred: Column, ref: Column, prefix: str = "") -> dict[str, Column]:
    """Precision, recall and F1 of two arrays without copies; both empty: 1, one empty: 0. Null counts as empty."""
    empty = F.array().cast("array<string>")
    pred, ref = F.coalesce(pred, empty), F.coalesce(ref, empty)
    hits = F.size(F.array_intersect(pred, ref)).cast("double")
    n, m = F.size(pred), F.size(ref)
    p = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.try_divide(hits, n))
    r = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.try_divide(hits, m))
    f = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (hits == 0), 0.0).otherwise(F.try_divide(2 * hits, (n + m).cast("double")))
    return {f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": f}


def total_weight(items: Column, weight: Column) -> Column:
    """Sum of a MAP's values over an array of keys; items the map lacks weigh nothing."""
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.element_at(weight, x), F.lit(0.0)))


def weighted_prf(pred: Column, ref: Column, weight: Column, prefix: str = "weighted_") -> dict[str, Column]:
    """As ``set_prf``, each item counting with its weight in a MAP; 0 where a side weighs nothing."""
    n, m = F.size(pred), F.size(ref)
    both = total_weight(F.array_intersect(pred, ref), weight)
    rule = lambda x: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(x)
    p = F.coalesce(F.try_divide(both, total_weight(pred, weight)), F.lit(0.0))
    r = F.coalesce(F.try_divide(both, total_weight(ref, weight)), F.lit(0.0))
    return {f"{prefix}precision": rule(p), f"{prefix}recall": rule(r), f"{prefix}f1": rule(_f1(p, r))}


def condition_means(rows: DataFrame, metrics: list[str], by: list[str] = CONDITION) -> DataFrame:
    """Per condition: n, and the mean of each metric over the rows where it is defined (null and NaN are not)."""
    mean = lambda c: F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in metrics])


def best_pairwise(pairs: DataFrame, preds: DataFrame, refs: DataFrame, similarity: DataFrame, key: str) -> DataFrame:
    """(key, similarity): (sum of each item's best on the other side) / (number of items); both sides empty 1, one empty 0.

    ``pairs``: key of all rows; ``preds`` and ``refs``: (key, item); ``similarity``: (a, b, s), symmetric, absent pairs are 0. Items of one key
    are joined with each other only, through the similarity table, whose pairs are those with a common ancestor.
    """
    p, r = preds.select(key, F.col("item").alias("a")).distinct(), refs.select(key, F.col("item").alias("b")).distinct()
    near = p.join(similarity, "a").join(r, [key, "b"]).select(key, "a", "b", "s")
    best = lambda side: near.groupBy(key, side).agg(F.max("s").alias("s")).groupBy(key).agg(F.sum("s").alias(f"s_{side}"))
    n = p.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(r.groupBy(key).agg(F.count(F.lit(1)).alias("m")), key, "full")
    all_ = pairs.select(key).distinct().join(n, key, "left").join(best("a"), key, "left").join(best("b"), key, "left").na.fill(0)
    score = F.when((F.col("n") == 0) & (F.col("m") == 0), 1.0).when((F.col("n") == 0) | (F.col("m") == 0), 0.0)
    return all_.select(key, score.otherwise((F.col("s_a") + F.col("s_b")) / (F.col("n") + F.col("m"))).alias("similarity"))


def column_group(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A projection that fails on missing columns, naming them."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(columns)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

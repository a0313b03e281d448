"""Sound families of labels and verbs, and how well a prediction's families agree with a reference's or a scene's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium import dims
from scenarium.functions.text import count_bin
from scenarium.operators.metrics import set_prf, weighted_prf


def family_of(label: Column, scene: bool = False, known: list[str] | None = None) -> Column:
    """A folded label's family: the first that lists it, else its category's, else null. ``known`` restricts the lists."""
    table = dims.SCENE_FAMILY_OF if scene else dims.SOUND_FAMILY_OF
    table = {k: v for k, v in table.items() if known is None or k in known}
    by_category = dims.lookup({label: dims.CATEGORY_FAMILY[c] for label, c in dims.CATEGORY_OF.items()}, label)
    return F.coalesce(dims.lookup(table, label), by_category)


def family_weight(family: Column) -> Column:
    return dims.lookup(dims.FAMILY_WEIGHTS, family, dims.NO_FAMILY_WEIGHT)


def label_weight(label: Column) -> Column:
    """A label's own importance, else its family's, else that of none."""
    return F.coalesce(dims.lookup(dims.LABEL_WEIGHT_OF, label), family_weight(family_of(label)))


def verb_family(verb: Column) -> Column:
    """A folded verb's family, or that of other verbs; null for no verb."""
    return F.when(F.coalesce(verb, F.lit("")) != "", dims.lookup(dims.VERB_FAMILY_OF, verb, dims.OTHER_VERB))


def ambience(group: Column) -> Column:
    return dims.lookup(dims.AMBIENCE, group, "unknown")


def family_counts(rows: DataFrame, key: str, label: str = "label", count: str | None = "n", scene: bool = False) -> DataFrame:
    """(key, family, n): sum of counts (null: 1) per family; labels without a family are left out."""
    n = F.coalesce(F.col(count).cast("bigint"), F.lit(1).cast("bigint")) if count else F.lit(1).cast("bigint")
    return rows.select(key, family_of(F.col(label), scene).alias("family"), n.alias("n")).where("family is not null").groupBy(key, "family").agg(F.sum("n").alias("n"))


def family_metrics(keys: DataFrame, pred: DataFrame, ref: DataFrame, key: str, families_too: bool = False) -> DataFrame:
    """Per key: agreement of count bins (plain and weighted), recall of discrete families (plain and weighted), P/R/F1 of families.

    ``pred`` and ``ref``: (key, family, n). A full outer join of the two meets each family once; no family at all gives 1.
    ``families_too``: with the families themselves, as pf and rf.
    """
    both = pred.select(key, "family", F.col("n").alias("p")).join(ref.select(key, "family", F.col("n").alias("r")), [key, "family"], "full")
    w, same = family_weight(F.col("family")), count_bin(F.coalesce("p", F.lit(0))) == count_bin(F.coalesce("r", F.lit(0)))
    discrete = F.col("family").isin(dims.DISCRETE_FAMILIES)
    weigh = lambda test: F.sum(F.when(test, w).otherwise(0.0))
    has_p, has_r = F.col("p").isNotNull(), F.col("r").isNotNull()
    each = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(same).alias("n_same"), F.sum(w).alias("w_all"), weigh(same).alias("w_same"),
        F.count_if(discrete & has_r).alias("d_ref"), F.count_if(discrete & has_r & has_p).alias("d_hit"), weigh(discrete & has_r).alias("dw_ref"), weigh(discrete & has_r & has_p).alias("dw_hit"),
        F.array_sort(F.collect_list(F.when(has_p, F.col("family")))).alias("pf"), F.array_sort(F.collect_list(F.when(has_r, F.col("family")))).alias("rf"),
    )
    out = keys.select(key).distinct().join(each, key, "left")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(1.0))
    none = F.array().cast("array<string>")
    out = out.withColumns({"pf": F.coalesce("pf", none), "rf": F.coalesce("rf", none)})
    table = F.create_map(*[F.lit(x) for pair in dims.FAMILY_WEIGHTS.items() for x in pair])
    return out.select(
        key, share("n_same", "n_all").alias("count_bin_accuracy"), share("w_same", "w_all").alias("weighted_count_bin_accuracy"), share("d_hit", "d_ref").alias("discrete_presence_recall"),
        share("dw_hit", "dw_ref").alias("weighted_discrete_presence_recall"), *[c.alias(n) for n, c in set_prf(F.col("pf"), F.col("rf"), "family_").items()],
        *[c.alias(n) for n, c in weighted_prf(F.col("pf"), F.col("rf"), table, "weighted_family_").items()], *(["pf", "rf"] if families_too else []),
    )


def expected_share(counts: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, score): the part of a row's families, by weight times count, that its scene group (key, group) expects; 0 without families."""
    expected = [(g, f) for g, fs in dims.SCENE_EXPECTED.items() for f in fs]
    fits = F.concat_ws("|", "group", "family").isin([f"{g}|{f}" for g, f in expected])
    w = family_weight(F.col("family")) * F.greatest("n", F.lit(1))
    rows = groups.select(key, "group").join(counts, key, "left")
    summed = rows.groupBy(key).agg(F.sum(F.when(fits, w).otherwise(0.0)).alias("s"), F.sum(w).alias("t"))
    return summed.select(key, F.coalesce(F.try_divide("s", "t"), F.lit(0.0)).alias("score"))


def io_consistency(group: Column, declared: Column, inferred: Column) -> Column:
    """1.0 if the group's side is known and either the declared or the inferred one agrees, else 0.0."""
    side = F.when(group.isin(dims.INDOOR_GROUPS), "indoor").when(group.isin(list(dims.SCENE_EXPECTED)), "outdoor")
    return F.when((declared == side) | (inferred == side), 1.0).otherwise(0.0)

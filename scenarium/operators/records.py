"""Records of single predictions: scenes, sounds, structure and validity, read from stored bodies of either schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium import dims
from scenarium.functions.text import canonical, normalised
from scenarium.functions.variants import elements, once
from scenarium.operators import families, rules
from scenarium.operators.metrics import set_prf, weighted_prf

#: Fixed value: how a figure that does not apply is written.
NOT_APPLICABLE = "n/a"


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def parsed(bodies: DataFrame, keys: list[str], aliases: Column) -> DataFrame:
    """What the records need of readable bodies (keys, __v): kind, scene, entities (id, label, n), acts (subject, verb, object), evidence
    terms and visual terms (null where the body has none), labels in canonical form. Elements that are no objects are left out."""
    v = F.col("__v")
    text = lambda x, p: F.try_variant_get(x, p, "string")
    objects = lambda p: F.filter(elements(v, p), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    nodes = objects("$.core.nodes")
    ents = F.transform(objects("$.core.entities"), lambda x: F.struct(text(x, "$.id").alias("id"), canonical(text(x, "$.label"), aliases).alias("label"), F.coalesce(F.try_variant_get(x, "$.count_estimate", "bigint"), F.lit(1).cast("bigint")).alias("n")))
    acts = F.transform(objects("$.core.observed_interactions"), lambda x: F.struct(text(x, "$.subject_id").alias("s"), canonical(text(x, "$.verb"), aliases).alias("verb"), text(x, "$.object_id").alias("o")))
    evidence = F.flatten(F.transform(nodes, lambda x: F.transform(elements(x, "$.visual_evidence_terms"), lambda t: canonical(F.try_variant_get(t, "$", "string"), aliases))))
    said = F.transform(elements(v, "$.core.visual_terms"), lambda t: canonical(F.try_variant_get(t, "$", "string"), aliases))
    has = lambda name: F.array_contains(F.map_keys(F.try_variant_get(v, "$.core", "map<string,variant>")), name)
    default = F.coalesce(has("nodes"), F.lit(False))
    return once(
        bodies, kind=F.when(default, "audioset").otherwise("legacy"), scene_label=F.coalesce(text(v, "$.core.scene.label"), F.lit("")), indoor_outdoor=F.coalesce(text(v, "$.core.scene.indoor_outdoor"), F.lit("unknown")),
        scene_confidence=F.try_variant_get(v, "$.core.scene.confidence", "double"), entities=ents, acts=acts, evidence=evidence, terms=F.when(has("visual_terms"), said),
    ).select(*keys, "kind", "scene_label", "indoor_outdoor", "scene_confidence", "entities", "acts", "evidence", "terms")


def labels(kind: Column) -> Column:
    """A prediction's canonical labels: visual terms of a default core, entities' of a legacy one."""
    own = F.when(kind == "audioset", F.coalesce("terms", _none())).otherwise(F.transform("entities", lambda e: e["label"]))
    return F.array_distinct(F.filter(own, lambda x: x.isNotNull() & (x != "")))


def triples() -> Column:
    """Interactions whose ids name labelled entities, as distinct ``subject::verb::object``; of equal ids the last entity stands."""
    named = F.filter("entities", lambda e: e["id"].isNotNull() & (e["id"] != "") & e["label"].isNotNull() & (e["label"] != ""))
    of = lambda at: F.element_at(F.filter(named, lambda e: e["id"] == at), -1)["label"]
    each = F.transform("acts", lambda a: F.struct(of(a["s"]).alias("s"), a["verb"].alias("v"), of(a["o"]).alias("o")))
    good = F.filter(each, lambda t: t["s"].isNotNull() & t["v"].isNotNull() & t["o"].isNotNull() & (t["v"] != ""))
    return F.array_distinct(F.transform(good, lambda t: F.concat_ws("::", t["s"], t["v"], t["o"])))


def structured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """P/R/F1 of labels and of interactions as triples. ``rows``: parsed, with ref and ref_triples (canonical; null: none)."""
    rows = once(rows, own=labels(F.col("kind")), own_triples=triples())
    return rows.select(*keys, *[c.alias(n) for n, c in set_prf(F.col("own"), F.col("ref"), "entity_").items()], *[c.alias(n) for n, c in set_prf(F.col("own_triples"), F.col("ref_triples"), "relationship_").items()])


def _counts(rows: DataFrame, key: str, items: Column, scene: bool) -> DataFrame:
    each = rows.select(key, F.explode(items).alias("x")).select(key, F.col("x.label").alias("label"), F.col("x.n").alias("n"))
    return families.family_counts(each, key, scene=scene)


def _ones(items: Column) -> Column:
    return F.transform(F.coalesce(items, _none()), lambda x: F.struct(x.alias("label"), F.lit(1).cast("bigint").alias("n")))


def _counted() -> Column:
    return F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["n"].alias("n")))


def scene_records(rows: DataFrame, key: str, scenes: dict[str, str], carried: list[str]) -> DataFrame:
    """The record of scene awareness of each prediction. ``rows``: parsed, with ref (canonical labels; null: none).

    A default core is counted by its nodes' evidence terms, a legacy one by its entities' estimates. scene_confidence is ``n/a``
    where the body has none.
    """
    group = dims.lookup(scenes, normalised(F.col("scene_label")))
    rows = once(rows, scene_group=group)
    own = F.when(F.col("kind") == "audioset", _ones(F.col("evidence"))).otherwise(_counted())
    groups = rows.select(key, F.col("scene_group").alias("group"))
    pred = families.expected_share(_counts(rows, key, own, True), groups, key).withColumnRenamed("score", "pred_entity_scene_consistency")
    ref = families.expected_share(_counts(rows, key, _ones(F.col("ref")), True), groups, key).withColumnRenamed("score", "gt_entity_scene_consistency")
    outdoor = [g for g in dims.SCENE_EXPECTED if g not in dims.INDOOR_GROUPS]
    inferred = rules.indoor_outdoor(normalised(F.col("scene_label")), F.col("scene_group"), dims.INDOOR_GROUPS, outdoor)
    told = F.coalesce(F.col("scene_confidence").cast("decimal(12,4)").cast("string"), F.lit(NOT_APPLICABLE))
    out = rows.select(
        key, *carried, "scene_label", F.coalesce("scene_group", F.lit("unknown")).alias("scene_group"), told.alias("scene_confidence"), F.col("scene_group").isNotNull().cast("double").alias("scene_group_known"),
        families.io_consistency(F.col("scene_group"), F.col("indoor_outdoor"), inferred).alias("scene_indoor_outdoor_consistency"),
    )
    return out.join(pred, key).join(ref, key)


def means(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group: n and the mean of each column over the rows where it applies; null where it applies to none."""
    number = lambda c: F.col(c).try_cast("double")  # noqa: E731  (``n/a`` and blank texts are no numbers)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(number(c)).alias(c) for c in columns])


def soundscape_records(rows: DataFrame, key: str, scenes: dict[str, str], carried: list[str]) -> DataFrame:
    """The record of sound families of each prediction: its entities and interactions against the reference's.

    ``rows``: parsed, with ref (canonical labels) and ref_verbs (canonical verbs); null: none. Families count entities' estimates on
    the prediction's side, labels on the reference's. No family or label on either side gives 1.
    """
    group = dims.lookup(scenes, normalised(F.col("scene_label")))
    own = F.array_distinct(F.filter(F.transform("entities", lambda e: e["label"]), lambda x: x.isNotNull() & (x != "")))
    rows = once(rows, scene_group=group, own=own, other=F.coalesce("ref", _none()))
    fam = families.family_metrics(rows, _counts(rows, key, _counted(), False), _counts(rows, key, _ones(F.col("other")), False), key, families_too=True)
    weights = F.map_from_entries(F.transform(F.array_union("own", "other"), lambda x: F.struct(x, families.label_weight(x))))
    verbs = lambda c: F.array_distinct(F.array_compact(F.transform(c, families.verb_family)))
    rows = once(rows, __w=weights, vp=verbs(F.transform("acts", lambda a: a["verb"])), vr=verbs(F.coalesce("ref_verbs", _none())))
    back = families.ambience(F.col("scene_group"))
    inferred = rules.indoor_outdoor(normalised(F.col("scene_label")), F.col("scene_group"), dims.INDOOR_GROUPS, [g for g in dims.SCENE_EXPECTED if g not in dims.INDOOR_GROUPS])
    exact = rows.select(
        key, *carried, "scene_label", F.coalesce("scene_group", F.lit("unknown")).alias("scene_family"), back.alias("background_family"), F.col("scene_group").isNotNull().cast("double").alias("scene_family_known"),
        (back != "unknown").cast("double").alias("background_family_known"), "indoor_outdoor", ((F.col("indoor_outdoor") != "unknown") | (inferred != "unknown")).cast("double").alias("indoor_outdoor_known"),
        *[c.alias(n) for n, c in set_prf(F.col("own"), F.col("other"), "entity_exact_").items()], *[c.alias(n) for n, c in weighted_prf(F.col("own"), F.col("other"), F.col("__w"), "weighted_entity_exact_").items()],
        *[c.alias(n) for n, c in set_prf(F.col("vp"), F.col("vr"), "interaction_family_").items()],
        F.size("vp").cast("bigint").alias("n_pred_interaction_families"), F.size("vr").cast("bigint").alias("n_gt_interaction_families"),
    )
    discrete = lambda c: F.array_intersect(c, F.array(*map(F.lit, dims.DISCRETE_FAMILIES)))
    table = F.create_map(*[F.lit(x) for pair in dims.FAMILY_WEIGHTS.items() for x in pair])
    fam = fam.withColumns({"dp": discrete("pf"), "dr": discrete("rf")})
    size = lambda c: F.size(c).cast("bigint")
    fam = fam.select(
        key, *[F.col(f"{w}family_{m}").alias(f"{w}entity_family_{m}") for w in ("", "weighted_") for m in ("precision", "recall", "f1")],
        *[c.alias(n) for n, c in set_prf(F.col("dp"), F.col("dr"), "discrete_family_").items()], *[c.alias(n) for n, c in weighted_prf(F.col("dp"), F.col("dr"), table, "weighted_discrete_family_").items()],
        F.col("count_bin_accuracy").alias("family_count_bin_accuracy"), F.col("weighted_count_bin_accuracy").alias("weighted_family_count_bin_accuracy"),
        F.col("discrete_presence_recall").alias("weighted_discrete_presence_recall"), F.col("weighted_discrete_presence_recall").alias("acoustic_weighted_discrete_presence_recall"),
        size("pf").alias("n_pred_families"), size("rf").alias("n_gt_families"), size("dp").alias("n_pred_discrete_families"), size("dr").alias("n_gt_discrete_families"),
    )
    return exact.join(fam, key)


def scene_relevance(rows: DataFrame, groups: DataFrame, table: dict[str, dict[str, float]], key: str) -> DataFrame:
    """``rows`` (key, label normalised, ...) with ``scene_relevance``: the greatest that ``table`` (group -> label -> relevance) gives the
    label in one of the key's scene groups (key, group); 0 without any. The table is a parameter of a detector's vocabularies."""
    pairs = {f"{g}|{label}": float(x) for g, of in table.items() for label, x in of.items()}
    held = groups.groupBy(key).agg(F.collect_set("group").alias("__groups"))  # a scene has a handful
    rows = rows.join(held, key, "left")
    score = lambda g: dims.lookup(pairs, F.concat(g, F.lit("|"), F.col("label")), 0.0)
    return rows.withColumn("scene_relevance", F.coalesce(F.array_max(F.transform("__groups", score)), F.lit(0.0))).drop("__groups")

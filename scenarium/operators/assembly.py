"""Whole records put together from the single operators: evidence sets, projections, per-image records, staged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium.functions.text import ascii_folded, canonical, label_or, unit_confidence
from scenarium.functions.variants import elements
from scenarium.operators import captions, families, rules
from scenarium.operators.metrics import set_prf, weighted_prf
from scenarium.operators.providers import call_gates



def _empty() -> Column:
    return F.array().cast("array<string>")


def tags(label: Column, table: dict[str, list[str]]) -> Column:
    """Tags a table (term -> tags) has for a label; where it has none, those of all terms the label contains, in the order of the table.

    ``table`` is a fixed dimension of some hundred terms at most, and stands in the plan: no join compares texts.
    """
    exact = lookup_list(table, label)
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, own)).alias("tags")) for t, own in table.items()])
    near = F.array_distinct(F.flatten(F.transform(F.filter(each, lambda x: F.contains(label, x["term"])), lambda x: x["tags"])))
    return F.coalesce(exact, near)


def lookup_list(table: dict[str, list[str]], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for term, own in table.items() for x in (F.lit(term), F.array(*map(F.lit, own)))]), key)


def evidence(key: str, *sources: tuple[DataFrame, str], aliases: Column) -> DataFrame:
    """(key, term): every source's texts (DataFrame, column), folded as they are and in canonical form."""
    parts = [df.select(key, F.explode(F.array(ascii_folded(F.col(c)), canonical(F.col(c), aliases))).alias("term")) for df, c in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("term is not null and term <> ''").distinct()


def predicted_nodes(stored: DataFrame, fired: DataFrame, usable: DataFrame, key: str, source: str = "core_nodes") -> DataFrame:
    """(key, rule_id) of a prediction: its stored nodes (``core_nodes``, ``vlm_nodes``), the rules its terms fire (``core_rules``), or both
    (``union``); only ids of ``usable`` (rule_id)."""
    rows = {"core_nodes": stored, "vlm_nodes": stored, "core_rules": fired, "union": stored.select(key, "rule_id").unionByName(fired.select(key, "rule_id"))}
    if source not in rows:
        raise ValueError(f"unknown source {source}")
    return rows[source].select(key, "rule_id").join(usable.select("rule_id").distinct(), "rule_id", "left_semi").distinct()


def diagnostics(items: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, ids, names): a key's node ids (item), and their names, sorted and joined by ``|``. ``names``: (id, name)."""
    rows = items.select(key, "item").distinct().join(names.select(F.col("id").alias("item"), "name"), "item", "left")
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("ids"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


def projection(detections: DataFrame, rule_table: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """(key, visual_terms, nodes, caption, acoustic_caption): a default core from detections (key, ord, term, confidence), rules and scenes
    (key, label, indoor_outdoor).

    Terms are in order of their first box; every scene has a row.
    """
    first = detections.where("term is not null").groupBy(key, "term").agg(F.min("ord").alias("o"))
    terms = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "term"))), lambda x: x["term"]).alias("visual_terms"))
    nodes = rules.projected(detections, rule_table, key)
    number = F.regexp_extract("node_id", "(\\d+)", 1).cast("bigint")
    listed = nodes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("o"), F.struct("node_id", "rule_id", "name", "confidence", "terms").alias("node")))), lambda x: x["node"]).alias("nodes"))
    said = captions.acoustic_caption(nodes.select(key, "name", "confidence", number.alias("ord"), "instance_count"), key)
    rows = scenes.join(terms, key, "left").join(listed, key, "left").join(said, key, "left").withColumn("visual_terms", F.coalesce("visual_terms", _empty()))
    return rows.select(key, "visual_terms", "nodes", captions.visual_caption(F.col("label"), F.col("indoor_outdoor"), F.col("visual_terms")).alias("caption"), "acoustic_caption")


def legacy_core(scenes: DataFrame, entities: DataFrame, interactions: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, core JSON): scene, entities, interactions, relations and a plain caption as one legacy core."""
    listed = lambda df, name, *c: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    rows = scenes.join(listed(entities, "entities", "id", "label", "category", "count_estimate", "confidence"), key, "left")
    rows = rows.join(listed(interactions, "observed_interactions", "subject_id", "verb", "object_id", "confidence"), key, "left")
    rows = rows.join(listed(relations, "spatial_relations", "subject_id", "relation", "object_id", "confidence"), key, "left")
    scene = F.struct(F.col("label"), F.coalesce("indoor_outdoor", F.lit("unknown")).alias("indoor_outdoor"))
    caption = F.concat(F.lit("A "), "label", F.lit(" scene."))
    return rows.select(key, F.to_json(F.struct(F.col(key).alias("image_id"), scene.alias("scene"), "entities", "observed_interactions", "spatial_relations", caption.alias("caption"))).alias("core"))


def legacy_acoustic(cores: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, pos, id, name, evidence, confidence, inference_type): acoustic nodes of a payload (key, payload VARIANT) that can stand.

    Ids of ``nodes`` (id, name) by id or by name, each once, evidence required; unknown kinds of inference are uncertain.
    """
    raw = cores.select(key, F.posexplode(elements(F.col("payload"), "$.acoustic_semantics.nodes")).alias("pos", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    text = lambda p: F.try_variant_get("x", p, "string")
    kind = F.lower(F.trim(F.coalesce(text("$.inference_type"), F.lit("uncertain"))))
    raw = raw.select(
        key, "pos", F.trim(F.coalesce(text("$.id"), F.lit(""))).alias("given"), label_or(text("$.name"), "").alias("said"), F.trim(F.coalesce(text("$.evidence"), F.lit(""))).alias("evidence"),
        unit_confidence(text("$.confidence"), 0.5).alias("confidence"), F.when(kind.isin("visible_source", "visible_action", "scene_affordance"), kind).otherwise("uncertain").alias("inference_type"),
    )
    by_id = nodes.select(F.col("id").alias("given"), F.col("id").alias("id1"))
    by_name = nodes.groupBy(label_or(F.col("name"), "").alias("said")).agg(F.max("id").alias("id2"))
    found = raw.join(by_id, "given", "left").join(by_name, "said", "left").withColumn("id", F.coalesce("id1", "id2")).where("id is not null and evidence <> ''")
    once = found.withColumn("__i", F.row_number().over(Window.partitionBy(key, "id").orderBy("pos"))).where("__i = 1")
    return once.join(nodes.select("id", "name"), "id").select(key, "pos", "id", "name", "evidence", "confidence", "inference_type")


def staged(answers: DataFrame, allowed_scenes: list[str]) -> DataFrame:
    """Staged answers (scene, indoor_outdoor, terms, nodes, caption, ...) with what counts: later calls' parts are dropped
    where an earlier one ruled the call out. ``calls`` is how many were worth making."""
    gate = call_gates(F.col("scene"), allowed_scenes, F.col("terms"))
    out = answers.withColumns(
        {"terms": F.when(gate["ask_terms"], F.coalesce("terms", _empty())).otherwise(_empty()), "nodes": F.when(gate["ask_nodes"], F.col("nodes")), "caption": F.when(gate["ask_captions"], F.col("caption"))}
    )
    calls = F.lit(2) + gate["ask_terms"].cast("int") + gate["ask_nodes"].cast("int") + gate["ask_captions"].cast("int")
    return out.withColumn("calls", calls)


def manifest_summary(bodies: DataFrame, key: str) -> DataFrame:
    """(key, kind, image_id, scene_label, scene_confidence, indoor_outdoor, caption, n_nodes, n_visual_terms, n_entities, n_interactions, coverage, density) of
    readable bodies (key, __v); counts of the other schema's parts are null."""
    v = F.col("__v")
    text = lambda p: F.try_variant_get(v, p, "string")
    n = lambda p: F.size(elements(v, p)).cast("bigint")
    default = F.array_contains(F.map_keys(F.try_variant_get(v, "$.core", "map<string,variant>")), "nodes")
    return bodies.select(
        key, F.when(default, "audioset").otherwise("legacy").alias("kind"), text("$.core.image_id").alias("image_id"), text("$.core.scene.label").alias("scene_label"),
        F.try_variant_get(v, "$.core.scene.confidence", "double").alias("scene_confidence"), text("$.core.scene.indoor_outdoor").alias("indoor_outdoor"), text("$.core.caption").alias("caption"),
        F.when(default, n("$.core.nodes")).alias("n_nodes"), F.when(default, n("$.core.visual_terms")).alias("n_visual_terms"), F.when(~default, n("$.core.entities")).alias("n_entities"),
        F.when(~default, n("$.core.observed_interactions")).alias("n_interactions"), F.try_variant_get(v, "$.extended.global_geometry.total_object_coverage", "double").alias("coverage"),
        F.try_variant_get(v, "$.extended.global_geometry.object_density_proxy", "double").alias("density"),
    )


def clip_score(cosine: Column) -> Column:
    """100 times the cosine of image and text, at least 0; null without an image."""
    return F.greatest(F.lit(0.0), 100.0 * cosine)


def requested(report: DataFrame, metrics: list[str], columns: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Only the columns of the metrics asked for; an error on unknown ones."""
    unknown = [m for m in metrics if m not in columns]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return report.select(*keys, *[c for m in metrics for c in columns[m]])

"""Template captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium.functions.text import embedding_label, english_list, finished_caption, scene_phrase, sound_phrase, verb_form, with_article

VERBALISED = {"left_of": "to the left of", "right_of": "to the right of", "above": "above", "below": "below"}
CONTEXT_CATEGORIES = ["object", "structure", "vegetation", "vehicle", "tool", "food"]


def visual_caption(label: Column, indoor_outdoor: Column, terms: Column) -> Column:
    """The scene, and the first eight terms."""
    scene = F.concat(F.lit("The image shows "), scene_phrase(label, indoor_outdoor))
    some = F.slice(F.coalesce(terms, F.array().cast("array<string>")), 1, 8)
    return finished_caption(F.array(F.when(F.size(some) == 0, scene).otherwise(F.concat(scene, F.lit(" with "), english_list(some)))))


def acoustic_caption(nodes: DataFrame, key: str) -> DataFrame:
    """(key, acoustic_caption) of nodes (key, name, confidence, ord, instance_count), most confident first, ties in order."""
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), F.col("ord").alias("o"), sound_phrase(F.col("name"), F.col("instance_count")).alias("p"))
    sounds = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"])
    said = nodes.where("name is not null").groupBy(key).agg(sounds.alias("s"))
    return said.select(key, finished_caption(F.array(F.concat(english_list(F.col("s")), F.lit(" would plausibly be heard")))).alias("acoustic_caption"))


def ranked_entities(entities: DataFrame, key: str) -> DataFrame:
    """Entities (key, id, ord, label, category, confidence, count_estimate, importance) with ``place``, the most important label first."""
    best = F.max(F.coalesce("importance", F.lit(0.0))).over(Window.partitionBy(key, "label"))
    w = Window.partitionBy(key).orderBy(F.desc("best"), F.desc("confidence"), F.desc("count_estimate"), "ord")
    return entities.withColumn("best", best).withColumn("place", F.row_number().over(w).cast("bigint"))


def spatial_sentences(relations: DataFrame, entities: DataFrame, key: str, most: int = 2) -> DataFrame:
    """(key, spatial): the ``most`` most confident relations in words; none between objects and structures, or of unknown ids."""
    side = lambda s: entities.select(key, F.col("id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label"), F.col("category").isin("object", "structure").alias(f"{s}_dull"))
    named = relations.where(F.col("relation").isin(list(VERBALISED))).join(side("subject"), [key, "subject_id"]).join(side("object"), [key, "object_id"]).where("not (subject_dull and object_dull)")
    words = F.element_at(F.create_map(*[F.lit(x) for p in VERBALISED.items() for x in p]), F.col("relation"))
    text = F.concat(F.lit("The "), F.col("subject_label"), F.lit(" is "), words, F.lit(" the "), F.col("object_label"))
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "ord")
    top = named.withColumns({"i": F.row_number().over(w), "text": text}).where(F.col("i") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), ". ").alias("spatial"))


def full_caption(scenes: DataFrame, entities: DataFrame, interactions: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, caption): scene, up to eight entities, three interactions, five labels of context, two relations.

    ``scenes``: key, label, indoor_outdoor. ``entities``: as for ``ranked_entities``. ``interactions``: key, ord, subject_id, verb, object_id.
    """
    ranked = ranked_entities(entities, key).withColumn("phrase", with_article(F.col("label"), F.col("count_estimate")))
    in_order = lambda what, c: F.transform(F.array_sort(F.collect_list(F.struct(what, c))), lambda x: x[c])
    main = ranked.where("place <= 8").groupBy(key).agg(F.array_distinct(in_order("place", "phrase")).alias("main"))
    side = lambda s: ranked.select(key, F.col("id").alias(f"{s}_id"), F.col("phrase").alias(f"{s}_text"))
    acts = interactions.join(side("subject"), [key, "subject_id"]).join(side("object"), [key, "object_id"])
    capital = F.concat(F.upper(F.substring("subject_text", 1, 1)), F.lower(F.substring(F.col("subject_text"), 2, 100_000)))
    acts = acts.withColumn("text", F.concat_ws(" ", capital, verb_form(F.col("verb")), "object_text"))
    done = acts.groupBy(key).agg(F.slice(in_order("ord", "text"), 1, 3).alias("acts"))
    used = acts.select(key, F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    rest = ranked.where(F.col("category").isin(CONTEXT_CATEGORIES)).join(used, [key, "id"], "left_anti")
    context = rest.groupBy(key).agg(F.slice(F.array_distinct(in_order("place", "label")), 1, 5).alias("context"))
    none = F.array().cast("array<string>")
    all_ = scenes.join(main, key, "left").join(done, key, "left").join(context, key, "left").join(spatial_sentences(relations, entities, key), key, "left")
    listed = lambda c, text: F.when(F.size(F.coalesce(c, none)) > 0, F.array(F.concat(F.lit(text), english_list(F.col(c))))).otherwise(none)
    parts = F.concat(
        F.array(F.concat(F.lit("The image shows "), scene_phrase(F.col("label"), F.col("indoor_outdoor")))), listed("main", "Visible elements include "),
        F.coalesce("acts", none), listed("context", "Additional contextual elements include "), F.when(F.col("spatial").isNotNull(), F.array("spatial")).otherwise(none),
    )
    return all_.select(key, finished_caption(parts).alias("caption"))


def scene_text(label: Column, indoor_outdoor: Column) -> Column:
    """A scene for a sentence encoder: ``label side.``, the label alone, or ``unknown scene``."""
    side = F.coalesce(embedding_label(indoor_outdoor), F.lit(""))
    return F.when(label.isNull(), "unknown scene").when(side != "", F.concat(embedding_label(label), F.lit(" "), side, F.lit("."))).otherwise(embedding_label(label))


def entity_text(labels: Column) -> Column:
    """Sorted distinct labels in a row, or ``entities: none``."""
    some = _distinct(labels)
    return F.when(F.size(some) > 0, F.array_join(some, " ")).otherwise("entities: none")


def interaction_text(triplets: Column) -> Column:
    """Sorted distinct interactions, each ``subject relation object``, or ``interactions: none``."""
    some = _distinct(triplets)
    return F.when(F.size(some) > 0, F.concat(F.lit("interactions: "), F.array_join(some, " ; "))).otherwise("interactions: none")


def description(label: Column, indoor_outdoor: Column, entities: Column, interactions: Column) -> Column:
    """A paragraph of scene, entities and interactions for a sentence encoder."""
    scene, side = F.coalesce(embedding_label(label), F.lit("")), F.coalesce(embedding_label(indoor_outdoor), F.lit(""))
    e, i = _distinct(entities), _distinct(interactions)
    place = F.when(side != "", F.concat(F.lit(" scene in an "), side, F.lit(" setting."))).otherwise(" scene.")
    parts = F.array_compact(
        F.array(
            F.when(scene != "", F.concat(F.lit("The image shows a "), scene, place)),
            F.when(F.size(e) > 0, F.concat(F.lit("Visible entities include "), english_list(e, oxford=False), F.lit("."))),
            F.when(F.size(i) > 0, F.concat(F.lit("Observed interactions include "), english_list(i, oxford=False), F.lit("."))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("No structured visual content is available.")


def _distinct(texts: Column) -> Column:
    clean = F.transform(F.coalesce(texts, F.array().cast("array<string>")), embedding_label)
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


def caption_payload(entities: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, payload JSON) for a language model: ten best entities, and three best relations by 0.45 subject + 0.35 object importance + 0.20 confidence.

    A relation needs an importance of 0.45 on one side.
    """
    ranked = ranked_entities(entities, key)
    top = ranked.where("place <= 10").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "count_estimate"))), lambda x: F.struct(x["label"].alias("label"), x["count_estimate"].alias("count"))).alias("entities"))
    side = lambda s: ranked.select(key, F.col("id").alias(f"{s}_id"), F.col("label").alias(s), F.coalesce("importance", F.lit(0.0)).alias(f"{s}_w"))
    named = relations.join(side("subject"), [key, "subject_id"]).join(side("object"), [key, "object_id"]).where(F.greatest("subject_w", "object_w") >= 0.45)
    score = 0.45 * F.col("subject_w") + 0.35 * F.col("object_w") + 0.20 * F.col("confidence")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    best = named.withColumn("score", score).withColumn("i", F.row_number().over(w)).where("i <= 3")
    rels = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "subject", "relation", "object"))), lambda x: F.concat_ws(" ", x["subject"], x["relation"], x["object"])).alias("relations"))
    return top.join(rels, key, "left").select(key, F.to_json(F.struct("entities", "relations")).alias("payload"))

"""Queries of records per prediction and of reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenarium import dims
from scenarium.functions import geometry as G
from scenarium.functions import text as T
from scenarium.functions.variants import with_readable
from scenarium.operators import assembly, captionmetrics, captions, fusion, hierarchy, metrics, ontology, payload, providers, records, reports, suppression
from scenarium.plans import evaluation as E
from scenarium.plans.records_sql import build
from scenarium.plans.tables import table

#: Illustration of a detector's scene vocabulary over the tables' labels: group -> label -> relevance.
RELEVANCE = {
    "urban_transport": {"person": 1.0, "car": 0.95, "bus": 0.95, "truck": 0.95, "bicycle": 0.9, "traffic light": 0.9, "tram": 0.85, "bench": 0.85},
    "market_public": {"person": 1.0, "crowd": 1.0, "vendor": 1.0, "basket": 0.9, "fruit": 0.9, "stall": 0.85, "awning": 0.85},
    "coastal_water": {"boat": 0.85, "fishing boat": 0.85, "gull": 0.85},
}
#: Illustration of tags: term -> tags.
TAGS = {"car": ["/m/t01"], "bus": ["/m/t01", "/m/t02"], "dog": ["/m/t03"], "boat": ["/m/t04"], "man": ["/m/t05"], "woman": ["/m/t05"], "bird": ["/m/t06"], "engine": ["/m/t02"]}


def _conditions(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, detector, scene_model, captioner) of an image's first prediction."""
    rows = table(spark, folder, "core_preds").where("image_id is not null")
    first = rows.groupBy("image_id").agg(F.min_by(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in metrics.CONDITION]), "pred_id").alias("c"))
    return first.select("image_id", "c.*")


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Readable bodies, parsed, with the references of their image: labels, triples and verbs of its legacy entities."""
    rows = with_readable(E._once(spark, folder, "nested_preds", "nested_id").select("nested_id", "image_id", "body"), "body", "__v")
    parsed = records.parsed(rows, ["nested_id", "image_id"], E._aliases())
    refs = E._references(spark, folder).withColumnRenamed("objects", "ref")
    ents = E._once(spark, folder, "entities", "pred_id", "id").select("pred_id", "id", "image_id", T.canonical(F.col("label"), E._aliases()).alias("label")).where("label <> '' and image_id is not null")
    acts = E._once(spark, folder, "interactions", "row_id").select("pred_id", F.col("subject_id").alias("s"), F.col("object_id").alias("o"), T.canonical(F.col("verb"), E._aliases()).alias("verb")).where("verb <> ''")
    side = lambda x: ents.select("pred_id", F.col("id").alias(x), F.col("label").alias(f"{x}_label"), *(["image_id"] if x == "s" else []))
    told = acts.join(side("s"), ["pred_id", "s"]).join(side("o"), ["pred_id", "o"])
    told = told.groupBy("image_id").agg(F.collect_set(F.concat_ws("::", "s_label", "verb", "o_label")).alias("ref_triples"), F.collect_set("verb").alias("ref_verbs"))
    out = parsed.join(refs, "image_id", "left").join(told, "image_id", "left").join(_conditions(spark, folder), "image_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in metrics.CONDITION})


def _rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


_CARRIED = ["image_id", *metrics.CONDITION]


def structured_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(records.structured(_parsed(spark, folder), ["nested_id", *_CARRIED]))


def _scenes(spark: SparkSession, folder: str) -> DataFrame:
    return records.scene_records(_parsed(spark, folder), "nested_id", E.SCENES, _CARRIED)


def scene_records(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_scenes(spark, folder))


SCENE_FIGURES = ["scene_confidence", "scene_group_known", "scene_indoor_outdoor_consistency", "pred_entity_scene_consistency", "gt_entity_scene_consistency"]


def scene_records_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(records.means(_scenes(spark, folder), metrics.CONDITION, SCENE_FIGURES))


def report_scene(spark: SparkSession, folder: str) -> DataFrame:
    return reports.metric_group(scene_records_by_condition(spark, folder), "scene")


def soundscape_records(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(records.soundscape_records(_parsed(spark, folder), "nested_id", E.SCENES, _CARRIED))


def report_soundscape(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.soundscape_records(_parsed(spark, folder), "nested_id", E.SCENES, _CARRIED)
    figures = [c for c in reports.GROUPS["legacy_soundscape"] if c not in (*metrics.CONDITION, "n")]
    out = reports.metric_group(records.means(rows, metrics.CONDITION, figures), "legacy_soundscape")
    return out.withColumns({c: F.round(c, 4) for c in figures})


def validation_records(spark: SparkSession, folder: str) -> DataFrame:
    """The validity of every stored body, unreadable ones included: one row each, with the figures of its schema."""
    rows = E._once(spark, folder, "nested_preds", "nested_id").select("nested_id", "image_id", "body")
    return _rounded(payload.validation_records(rows, "nested_id", table(spark, folder, "onto_nodes").select("id")))


def _chair(spark: SparkSession, folder: str) -> DataFrame:
    rows, names = E._chair_input(spark, folder)
    found = captionmetrics.mentions(rows.select("pred_id", captionmetrics.searched(F.col("caption"), F.coalesce("scene.label", F.lit(""))).alias("text")), names, "pred_id")
    return captionmetrics.chair_report(rows.join(found, "pred_id"), F.col("ref"), F.when(F.col("visual_terms").isNotNull(), F.col("pred")), metrics.CONDITION)


def chair_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    """Hallucination against the reference's objects and against what the prediction itself declares."""
    return _rounded(_chair(spark, folder))


def report_chair(spark: SparkSession, folder: str) -> DataFrame:
    return reports.metric_group(chair_by_condition(spark, folder), "chair")


def report_caption(spark: SparkSession, folder: str) -> DataFrame:
    """SPICE needs a scene-graph parser of its own and is empty here."""
    rows = E.cider_by_condition(spark, folder).withColumnsRenamed({"cider": "CIDEr", "n_caption_refs": "n"}).withColumn("SPICE", F.lit(None).cast("double"))
    return reports.metric_group(rows, "caption")


def report_audioset(spark: SparkSession, folder: str) -> DataFrame:
    """Averages per captioner pair's condition: node, parent and top-level F1 and both similarities of every image both captioners saw."""
    prf = E.hierarchical_prf(spark, folder)
    both = prf.join(E.best_similarity(spark, folder), "image_id", "left").join(_conditions(spark, folder), "image_id")
    named = {"node_f1": "audioset_exact_node_f1", "parent_f1": "audioset_parent_f1", "top_f1": "audioset_top_level_f1", "lca_similarity": "audioset_lca_similarity", "distance_similarity": "audioset_tree_distance_similarity"}
    return _rounded(reports.metric_group(records.means(both.withColumnsRenamed(named), metrics.CONDITION, list(named.values())), "audioset"))


def label_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "detections").select(T.ascii_folded(F.col("label")).alias("label")).where("label <> ''").distinct()
    return rows.select("label", F.array_join(F.array_sort(assembly.tags(F.col("label"), TAGS)), "|").alias("tags"))


def importance_in_scene(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of each grounded box with its relevance in the prediction's scene; the first box of a prediction counts as interacting."""
    rows = E._geometry(spark, folder)
    groups = E._once(spark, folder, "core_preds", "pred_id").select("pred_id", dims.lookup(E.SCENES, T.normalised(F.col("scene.label"))).alias("group")).where("group is not null")
    told = records.scene_relevance(rows.withColumn("label", T.normalised(F.col("label"))), groups, RELEVANCE, "pred_id")
    score = fusion.semantic_importance(F.col("salience_score"), fusion.category_of(F.col("label")), F.col("scene_relevance"), F.col("ord") == 0)
    return told.select("row_id", "scene_relevance", score.alias("importance"))


def suppressed_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes left by the whole pipeline: confidence, overlap, aliases."""
    return suppression.suppressed(E._keyed(E._boxes(spark, folder))).select(F.col("id").alias("row_id"))


def strong_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of each detector from a confidence of 0.2."""
    det = E._once(spark, folder, "detections", "det_id").where("confidence >= 0.2 and not isnan(confidence)")
    return det.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("n_images"))


def box_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes read as centre and size, as corners, and rescaled to twice the width and half the height."""
    b = G.Box.of()
    corners = G.Box.from_centre(b.x1, b.y1, b.x2, b.y2)
    scaled = G.rescaled(b, F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(0.5))
    named = {f"c_{n}": c for n, c in zip(("x1", "y1", "x2", "y2"), corners)} | {f"s_{n}": c for n, c in zip(("x1", "y1", "x2", "y2"), scaled)}
    return E._boxes(spark, folder).select("row_id", *[F.round(c, 4).alias(n) for n, c in named.items()])


def strict_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The other box of its prediction that each box overlaps most, by more than 0.2."""
    rows = E._boxes(spark, folder)
    boxes = rows.select("pred_id", F.col("row_id").alias("box_id"), "x1", "y1", "x2", "y2")
    others = rows.select("pred_id", F.col("row_id").alias("match_id"), F.col("row_id").alias("ord"), "x1", "y1", "x2", "y2")
    return fusion.best_match(boxes, others, "pred_id", inclusive=False, but_itself=True).select("box_id", "match_id", F.round("iou", 6).alias("iou"))


def environments(spark: SparkSession, folder: str) -> DataFrame:
    """Crowd and activity of each legacy prediction, from its people and interactions."""
    ents = E._once(spark, folder, "entities", "pred_id", "id").where("label is not null")
    people = F.sum(F.when(fusion.category_of(T.normalised(F.col("label"))) == "human", F.coalesce("count_estimate", F.lit(1))).otherwise(0))
    acts = E._once(spark, folder, "interactions", "row_id").groupBy("pred_id").agg(F.count(F.lit(1)).alias("acts"))
    rows = ents.groupBy("pred_id").agg(people.alias("humans")).join(acts, "pred_id", "left")
    return rows.select("pred_id", *[c.alias(n) for n, c in fusion.environment(F.col("humans"), F.coalesce("acts", F.lit(0))).items()])


def encoder_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts a sentence encoder compares, of every readable body: scene, labels, interactions."""
    rows = _parsed(spark, folder)
    said = F.when(F.col("kind") == "audioset", F.col("terms")).otherwise(F.transform("entities", lambda e: e["label"]))
    ref = F.transform("ref_triples", lambda t: F.replace(t, F.lit("::"), F.lit(" ")))
    return rows.select(
        "nested_id", captions.scene_text(F.nullif("scene_label", F.lit("")), F.col("indoor_outdoor")).alias("scene"), captions.entity_text(said).alias("entities"), captions.entity_text(F.col("ref")).alias("ref_entities"),
        captions.interaction_text(ref).alias("ref_interactions"),
    )


def text_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of a prediction's labels and its reference's, by the stand-in encoder; the reference's texts are encoded with it."""
    rows = encoder_texts(spark, folder).select("nested_id", "entities", "ref_entities")
    return providers.encoded(rows, "nested_id", ["entities", "ref_entities"]).select("nested_id", F.round(metrics.cosine(F.col("entities_vector"), F.col("ref_entities_vector")), 5).alias("cosine"))


def rule_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rules in words, and as the prompt that lists them."""
    rows = E._rules(spark).select("rule_id", "name", providers.rule_text(F.col("groups")).alias("rule"))
    return rows.withColumn("prompt", providers.prompt("nodes_from_rules", rules=F.array(F.concat("name", F.lit(": "), "rule"))))


def node_paths(spark: SparkSession, folder: str) -> DataFrame:
    """All root paths of each node of the base ontology, in names."""
    nodes, edges = E._base(spark, folder)
    paths = hierarchy.root_paths(nodes, edges, hierarchy.cycle_nodes(hierarchy.contract(nodes, edges)))
    named = ontology.path_names(paths, ontology.nodes_table(table(spark, folder, "onto_nodes")))
    return named.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("path")), " / ").alias("paths"))


def node_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each condition's predictions name a node, most first: ``id:count``; of the base ontology's usable nodes."""
    usable = ontology.nodes_table(table(spark, folder, "onto_nodes").where("ontology_id = 'base'")).where("usable").select(F.col("id").alias("audioset_id"))
    preds = E._once(spark, folder, "core_preds", "pred_id").select("pred_id", F.coalesce("captioner", F.lit("")).alias("captioner"))
    rows = E._once(spark, folder, "core_nodes", "pred_id", "node_id").join(usable, "audioset_id", "left_semi").join(preds, "pred_id")
    counts = rows.groupBy("captioner", "audioset_id").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("audioset_id").alias("id"))))
    return counts.groupBy("captioner").agg(F.array_join(F.transform(order, lambda x: F.concat(x["id"], F.lit(":"), (-x["m"]).cast("string"))), "|").alias("node_counts"))


def clip_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Image-text scores of neighbouring embeddings, averaged by label."""
    rows = table(spark, folder, "embeddings")
    right = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    score = assembly.clip_score(metrics.cosine(F.col("embedding"), F.col("e2")))
    return rows.join(right, "vec_id").withColumn("score", score).groupBy((F.col("vec_id") % 10).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("CLIPScore"))


QUERIES = {
    f.__name__: f
    for f in (
        suppressed_boxes, strong_detections, box_forms, strict_matches, environments, encoder_texts, text_similarity, rule_texts, node_paths, node_counts, clip_scores,
        structured_metrics, scene_records, scene_records_by_condition, report_scene, soundscape_records, report_soundscape, validation_records, chair_by_condition, report_chair,
        report_caption, report_audioset, label_tags, importance_in_scene,
    )
}
SQL = build(E.SQL, E.ALIASES, E.RULES, E.SCENES, RELEVANCE, TAGS)

"""Queries of description and evaluation, on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium import dims
from scenarium.functions import geometry as G
from scenarium.functions import text as T
from scenarium.functions.variants import with_readable
from scenarium.operators import assembly, captionmetrics, captions, families, fusion, geometry, hierarchy, metrics, ontology, payload, rules, suppression
from scenarium.plans.evaluation_sql import build
from scenarium.plans.tables import table
from scenarium.storage import Scratch

#: Size of the images the boxes are on.
WIDTH, HEIGHT = 640.0, 480.0
#: Illustration rules over the tables' terms: id, name, evidence.
RULES = [
    ("/m/r01", "Street traffic", "car or bicycle or bus and person or man or woman"),
    ("/m/r02", "Kitchen work", "stove or oven or kettle and person or woman or man"),
    ("/m/r03", "Fishing boat", "fishing boat"),
    ("/m/r04", "Market crowd", "stall or awning and shopper"),
    ("/m/r05", "Playground", "swing or slide or seesaw and toddler or kite"),
    ("/m/r06", "Train", "locomotive or freight wagon"),
]
#: Aliases of object names: alias -> canonical.
ALIASES = {"man": "person", "woman": "person", "tramcar": "tram", "bike": "bicycle", "lake": "water"}
STOP_WORDS = ["a", "an", "the", "of", "and", "with", "in", "two", "there"]
#: Groups of the tables' scenes.
SCENES = {
    "street market": "market_public", "tram stop": "urban_transport", "bus depot": "urban_transport", "railway platform": "urban_transport", "harbor quay": "coastal_water",
    "beach": "coastal_water", "fish pond": "garden_park", "city park": "garden_park", "playground": "sports_recreation", "snowy slope": "sports_recreation",
    "forest path": "natural_outdoor", "river bank": "natural_outdoor", "hay meadow": "rural_traditional", "stable": "rural_traditional", "kitchen": "indoor_domestic",
    "laundry room": "indoor_domestic", "bakery": "public_indoor", "airport hall": "public_indoor", "office": "education_health_office", "classroom": "education_health_office",
    "repair shop": "industrial_workshop", "construction site": "industrial_workshop", "concert hall": "entertainment_culture", "rehearsal room": "entertainment_culture",
}


def _once(spark: SparkSession, folder: str, name: str, *keys: str) -> DataFrame:
    """A table with each key once: a repeated delivery has the same content."""
    return table(spark, folder, name).dropDuplicates(list(keys))


def _aliases() -> F.Column:
    return F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])


def _places(c: F.Column | str, places: int = 6) -> F.Column:
    """Halves up in plain double arithmetic, which all engines do alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**places) + 0.5) / float(10**places)


def _steady(c: F.Column | str) -> F.Column:
    """Six places, up from 0.7: sums of boxes with one decimal never stand at that threshold, so their order can't matter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.3) / 1e6


def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("label")
    return table(spark, folder, "detections").select("label").distinct().select(
        "label", T.ascii_folded(c).alias("folded"), T.scene_label(c).alias("scene"), T.normalised(c).alias("normalised"), T.label_or(c, "unknown").alias("or_unknown"),
        T.embedding_label(c).alias("embedding"), T.canonical(c, _aliases()).alias("canonical"), T.singular_phrase(T.ascii_folded(c)).alias("singular"),
    )


def confidence_unit(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "detections", "det_id").select("det_id", F.round(T.unit_confidence(F.col("confidence"), 0.5), 6).alias("confidence"))


def caption_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "core_preds", "pred_id").where("caption is not null")
    return rows.select("pred_id", T.segments(F.col("caption")).alias("segments"), captionmetrics.searched(F.col("caption"), F.col("scene.label")).alias("searched"))


def english_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "core_preds", "pred_id").select("pred_id", F.array_compact("visual_terms").alias("t")).where("t is not null")
    return rows.select("pred_id", T.english_list(F.col("t")).alias("oxford"), T.english_list(F.col("t"), oxford=False).alias("plain"))


def count_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "entities", "pred_id", "id")
    return rows.groupBy(T.count_bin(F.coalesce("count_estimate", F.lit(0))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def path_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "pred_files", "file_id").where("json_path is not null").select("file_id", T.path_condition(F.col("json_path")).alias("c")).select("file_id", "c.*")


def schema_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Readable bodies by the kind of their schema."""
    rows = with_readable(_once(spark, folder, "nested_preds", "nested_id").select("nested_id", "body"), "body", "__v")
    return rows.groupBy(payload.schema_kind(F.try_variant_get("__v", "$.core", "variant")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Groundings as boxes of their prediction."""
    rows = _once(spark, folder, "groundings", "row_id").where("size(bbox) = 4 and pred_id is not null and visual_label_raw is not null")
    box = G.Box.from_array(F.col("bbox"))
    return rows.select(
        "pred_id", "row_id", "ord", F.col("visual_label_raw").alias("label"), F.coalesce("detector_confidence", F.lit(0.0)).alias("confidence"), "source", *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))]
    )


def _geometry(spark: SparkSession, folder: str) -> DataFrame:
    return geometry.entity_geometry(_boxes(spark, folder), F.lit(WIDTH), F.lit(HEIGHT))


def box_geometry(spark: SparkSession, folder: str) -> DataFrame:
    det = _once(spark, folder, "detections", "det_id").where("confidence between 0 and 1 and not isnan(confidence)")
    rows = geometry.entity_geometry(det, F.lit(WIDTH), F.lit(HEIGHT))
    return rows.select("det_id", "label", "x1", "y1", "x2", "y2", _places("bbox_area_ratio").alias("area_ratio"), "relative_size", "position_coarse", "is_central", _places("salience_score").alias("salience"))


def box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Each box and the next of its prediction."""
    w = Window.partitionBy("pred_id").orderBy("ord", "row_id")
    rows = _boxes(spark, folder).withColumns({f"n_{c}": F.lead(c).over(w) for c in ("row_id", "x1", "y1", "x2", "y2")}).where("n_row_id is not null")
    a, b = G.Box.of(), G.Box.of("n_")
    return rows.select("row_id", F.col("n_row_id").alias("next_id"), F.round(G.iou(a, b), 6).alias("iou"), F.round(G.containment(a, b), 6).alias("inside"))


def category_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = _geometry(spark, folder).withColumn("category", fusion.category_of(F.col("label")))
    per = geometry.global_geometry(rows, "pred_id")
    flat = per.select("pred_id", "total_object_coverage", "object_density_proxy", F.explode("category_counts").alias("category", "n"), "category_coverage")
    part = F.element_at("category_coverage", F.col("category"))
    return flat.select("pred_id", "category", "n", _steady(part).alias("part"), _steady("total_object_coverage").alias("total"), _places("object_density_proxy").alias("density"))


def _keyed(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"key": F.col("pred_id").cast("string"), "id": F.col("row_id")})


def nms_kept(spark: SparkSession, folder: str) -> DataFrame:
    return suppression.nms(_keyed(_boxes(spark, folder)), 0.3).select(F.col("id").alias("row_id"))


def nms_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Non-maximum suppression of all detections, one image of which holds a tenth of them."""
    det = _once(spark, folder, "detections", "det_id").where("confidence between 0 and 1 and not isnan(confidence)")
    return suppression.nms(det.select(F.col("image_id").alias("key"), F.col("det_id").alias("id"), "confidence", "ord", "x1", "y1", "x2", "y2"), 0.5).select(F.col("id").alias("det_id"))


def alias_kept(spark: SparkSession, folder: str) -> DataFrame:
    return suppression.alias_suppression(_keyed(_boxes(spark, folder))).select(F.col("id").alias("row_id"))


def detection_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of two detectors' boxes per image, filtered at 0.5."""
    det = _once(spark, folder, "detections", "det_id").where("image_id is not null")
    counts = lambda s: det.where(F.col("source") == s).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if((F.col("confidence") >= 0.5) & ~F.isnan("confidence")).alias("n_filtered"))
    return suppression.count_differences(counts("det_flint"), counts("det_quartz"))[0]


def detection_differences_all(spark: SparkSession, folder: str) -> DataFrame:
    """As ``detection_differences``, of every two detectors of an image, the lesser name as the first; boxes without a source are of none."""
    det = _once(spark, folder, "detections", "det_id").where("image_id is not null and source is not null")
    counts = det.groupBy("image_id", "source").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if((F.col("confidence") >= 0.5) & ~F.isnan("confidence")).alias("n_filtered"))
    side = lambda s: counts.select("image_id", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "n_raw", "n_filtered")])
    both = side("before").join(side("after"), "image_id").where("source_before < source_after")
    return both.withColumn("filtered_delta", F.col("n_filtered_after") - F.col("n_filtered_before"))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, name string, evidence string").withColumn("groups", rules.parsed(F.col("evidence")))


def rule_terms(spark: SparkSession, folder: str) -> DataFrame:
    return rules.terms_of(_rules(spark)).select("rule_id", F.col("group_no").cast("bigint").alias("group_no"), "term")


def _term_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "core_preds", "pred_id")
    return rows.select("pred_id", F.explode("visual_terms").alias("t")).select("pred_id", T.normalised(F.col("t")).alias("term")).where("trim(term) <> ''").distinct()


def rules_fired(spark: SparkSession, folder: str) -> DataFrame:
    return rules.fired(_term_rows(spark, folder), _rules(spark), "pred_id")


def rule_nodes(spark: SparkSession, folder: str) -> DataFrame:
    det = _once(spark, folder, "detections", "det_id").where("image_id is not null and confidence between 0 and 1 and not isnan(confidence)")
    rows = det.select("image_id", T.normalised(F.col("label")).alias("term"), "confidence")
    return rules.projected(rows, _rules(spark), "image_id").withColumn("terms", F.array_join("terms", "|"))


def prompt_batches(spark: SparkSession, folder: str) -> DataFrame:
    return rules.prompt_batches(_term_rows(spark, folder))


def ontology_names(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "onto_nodes").where("ontology_id = 'base'")
    return ontology.names_to_ids(ontology.nodes_table(raw))


def ontology_names_all(spark: SparkSession, folder: str) -> DataFrame:
    """As ``ontology_names``, over all ontologies: a name in several has its least id."""
    return ontology.names_to_ids(ontology.nodes_table(table(spark, folder, "onto_nodes")))


def ontology_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return ontology.integrity(table(spark, folder, "onto_nodes").select("id", "child_ids"))


def ontology_parents(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = hierarchy.edges_of(table(spark, folder, "onto_nodes"))
    return ontology.parents_or_self(nodes.withColumnRenamed("node", "id"), edges)


def ontology_leaves(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "onto_nodes")
    return ontology.leaves(ontology.nodes_table(raw), hierarchy.edges_of(raw)[1])


def _base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.edges_of(table(spark, folder, "onto_nodes").where("ontology_id = 'base'"))


def ontology_distances(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.ancestors(hierarchy.contract(*_base(spark, folder), "ancestors"))


def ontology_distances_all(spark: SparkSession, folder: str) -> DataFrame:
    """As ``ontology_distances``, over all ontologies."""
    return hierarchy.ancestors(hierarchy.contract(*hierarchy.edges_of(table(spark, folder, "onto_nodes")), "ancestors"))


def _node_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, item) of what two captioners' predictions of an image say: one as the prediction, one as the reference."""
    preds = _once(spark, folder, "core_preds", "pred_id").select("pred_id", "image_id", "captioner").where("image_id is not null")
    nodes = table(spark, folder, "core_nodes").select("pred_id", "audioset_id").where("audioset_id is not null")
    rows = nodes.join(preds, "pred_id")
    of = lambda c: rows.where(F.col("captioner") == c).select("image_id", F.col("audioset_id").alias("item")).distinct()
    return of("cap_alder"), of("cap_cedar")


def hierarchical_prf(spark: SparkSession, folder: str) -> DataFrame:
    """P/R/F1 of nodes, of their parents (or themselves) and of their top levels, per image with both."""
    pred, ref = _node_sets(spark, folder)
    nodes, edges = hierarchy.edges_of(table(spark, folder, "onto_nodes"))
    up = ontology.parents_or_self(nodes.withColumnRenamed("node", "id"), edges).select(F.col("node").alias("item"), F.col("parent").alias("to"))
    tops = hierarchy.roots_above(hierarchy.contract(nodes, edges)).select(F.col("node").alias("item"), F.col("root").alias("to"))
    out = pred.select("image_id").distinct().join(ref.select("image_id").distinct(), "image_id", "left_semi")
    for name, lift in (("node", None), ("parent", up), ("top", tops)):
        sets = []
        for side, rows in (("p", pred), ("r", ref)):
            lifted = rows if lift is None else rows.join(lift, "item").select("image_id", F.col("to").alias("item"))
            sets.append(lifted.groupBy("image_id").agg(F.collect_set("item").alias(f"{side}_{name}")))
        out = out.join(sets[0], "image_id", "left").join(sets[1], "image_id", "left")
    columns = {}
    for name in ("node", "parent", "top"):
        columns |= metrics.set_prf(F.col(f"p_{name}"), F.col(f"r_{name}"), f"{name}_")
    return out.select("image_id", *[F.round(c, 6).alias(n) for n, c in columns.items()])


def hierarchical_prf_all(spark: SparkSession, folder: str) -> DataFrame:
    """As ``hierarchical_prf``, of every prediction against each other captioner's nodes of its image.

    A prediction whose image no other captioner has is in one row without ref_captioner and figures. A side without nodes is empty.
    """
    preds = _once(spark, folder, "core_preds", "pred_id").select("pred_id", "image_id", F.coalesce("captioner", F.lit("")).alias("captioner"))
    said = table(spark, folder, "core_nodes").select("pred_id", F.col("audioset_id").alias("item")).where("item is not null").distinct()
    nodes, edges = hierarchy.edges_of(table(spark, folder, "onto_nodes"))
    up = ontology.parents_or_self(nodes.withColumnRenamed("node", "id"), edges).select(F.col("node").alias("item"), F.col("parent").alias("to"))
    tops = hierarchy.roots_above(hierarchy.contract(nodes, edges)).select(F.col("node").alias("item"), F.col("root").alias("to"))
    refs = preds.where("image_id is not null").select("image_id", F.col("captioner").alias("ref_captioner")).distinct()
    out = preds.join(refs.withColumnRenamed("image_id", "i"), (F.col("image_id") == F.col("i")) & (F.col("captioner") != F.col("ref_captioner")), "left").drop("i")
    for name, lift in (("node", None), ("parent", up), ("top", tops)):
        lifted = said if lift is None else said.join(lift, "item").select("pred_id", F.col("to").alias("item"))
        own = lifted.groupBy("pred_id").agg(F.collect_set("item").alias(f"p_{name}"))
        of_ref = lifted.join(preds.withColumnRenamed("captioner", "ref_captioner"), "pred_id").groupBy("image_id", "ref_captioner").agg(F.collect_set("item").alias(f"r_{name}"))
        out = out.join(own, "pred_id", "left").join(of_ref, ["image_id", "ref_captioner"], "left")
    columns = {}
    for name in ("node", "parent", "top"):
        columns |= metrics.set_prf(F.col(f"p_{name}"), F.col(f"r_{name}"), f"{name}_")
    return out.select("pred_id", "image_id", "captioner", "ref_captioner", *[F.when(F.col("ref_captioner").isNotNull(), F.round(c, 6)).alias(n) for n, c in columns.items()])


def best_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Average best pairwise similarity of the two node sets of each image, within the base ontology."""
    return _similar(*_base(spark, folder), *_node_sets(spark, folder), "image_id")


def best_similarity_all(spark: SparkSession, folder: str) -> DataFrame:
    """As ``best_similarity``, over all ontologies."""
    return _similar(*hierarchy.edges_of(table(spark, folder, "onto_nodes")), *_node_sets(spark, folder), "image_id")


def _reach(nodes: DataFrame, edges: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, anc, near) of the asked ``items`` (item) only, and (node, depth) of all nodes."""
    scratch = Scratch(nodes.sparkSession, "reach")
    nodes, edges = scratch.write(nodes, "nodes"), scratch.write(edges, "edges")
    done = hierarchy.contract(nodes, edges, "ancestors")
    asked = items.select(F.col("item").alias("node")).distinct()
    reach = scratch.write(hierarchy.ancestors(done).join(asked, "node", "left_semi"), "reach")
    return reach, scratch.write(hierarchy.measures(nodes, edges, hierarchy.cycle_nodes(done)).select("node", "depth"), "depths")


def _similar(nodes: DataFrame, edges: DataFrame, pred: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """(key, lca_similarity, distance_similarity) of two node sets (key, item) within an ontology."""
    scratch = Scratch(nodes.sparkSession, "similar")  # each is read several times, and its plan is long
    pred, ref = (scratch.write(x.join(nodes.select(F.col("node").alias("item")), "item", "left_semi"), "sets") for x in (pred, ref))
    reach, depths = _reach(nodes, edges, pred.select("item").union(ref.select("item")))
    pairs = pred.select(key, F.col("item").alias("a")).join(ref.select(key, F.col("item").alias("b")), key).select("a", "b").distinct()
    near = scratch.write(ontology.similarities(pairs, reach, depths), "near")
    both = pred.select(key).union(ref.select(key)).distinct()
    one = lambda c, name: metrics.best_pairwise(both, pred, ref, near.select("a", "b", F.col(c).alias("s")), key).select(key, F.round("similarity", 6).alias(name))
    return one("lca", "lca_similarity").join(one("near", "distance_similarity"), key)


def common_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest common ancestor, by depth, name and id, of every two nodes that two captioners said of one image; base ontology."""
    nodes, edges = _base(spark, folder)
    pred, ref = _node_sets(spark, folder)
    known = nodes.select(F.col("node").alias("item"))
    pred, ref = pred.join(known, "item", "left_semi"), ref.join(known, "item", "left_semi")
    pairs = pred.select("image_id", F.col("item").alias("a")).join(ref.select("image_id", F.col("item").alias("b")), "image_id").select("a", "b").distinct()
    names = ontology.nodes_table(table(spark, folder, "onto_nodes")).select("id", "name")
    found = ontology.similarities(pairs, *_reach(nodes, edges, pairs.select(F.col("a").alias("item")).union(pairs.select("b"))), names)
    return found.where("lca_id is not null").select("a", "b", "lca_id", "distance")


def entity_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    det = _once(spark, folder, "detections", "det_id").where("image_id is not null and confidence between 0 and 1 and not isnan(confidence)")
    # Places repeat within an image; the key makes them one order.
    return fusion.entities(det.select("image_id", F.struct("ord", "det_id").alias("ord"), "label", "confidence"), "image_id")


def grounding_matches(spark: SparkSession, folder: str) -> DataFrame:
    """For each box at an odd place, the box at an even place of its prediction that it overlaps most."""
    rows = _boxes(spark, folder)
    odd = rows.where("ord % 2 = 1").select("pred_id", F.col("row_id").alias("box_id"), "x1", "y1", "x2", "y2")
    even = rows.where("ord % 2 = 0").select("pred_id", F.col("row_id").alias("match_id"), F.col("row_id").alias("ord"), "x1", "y1", "x2", "y2")
    return fusion.best_match(odd, even, "pred_id").select("box_id", "match_id", F.round("iou", 6).alias("iou"))


def grounding_matches_all(spark: SparkSession, folder: str) -> DataFrame:
    """For each box, the other box of its prediction that it overlaps most; the least row_id of equal ones."""
    rows = _boxes(spark, folder)
    boxes = rows.select("pred_id", F.col("row_id").alias("box_id"), "x1", "y1", "x2", "y2")
    others = rows.select("pred_id", F.col("row_id").alias("match_id"), F.col("row_id").alias("ord"), "x1", "y1", "x2", "y2")
    return fusion.best_match(boxes, others, "pred_id", but_itself=True).select("box_id", "match_id", F.round("iou", 6).alias("iou"))


def interactions_top(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "interactions", "row_id").where("subject_id is not null and object_id is not null")
    ready = rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("ord", F.struct("ord", "row_id"))
    return fusion.top_interactions(ready, "pred_id").select("pred_id", "subject_id", "verb", "object_id", "row_id")


def spatial_relations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _geometry(spark, folder).withColumns({"id": F.col("row_id").cast("string"), "ord": F.col("row_id")})
    out = fusion.spatial_relations(rows, "pred_id", WIDTH, HEIGHT)
    return out.select("subject_id", "relation", "object_id", _places("confidence").alias("confidence"), "rnk")


def semantic_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _geometry(spark, folder)
    score = fusion.semantic_importance(F.col("salience_score"), fusion.category_of(F.col("label")), F.lit(0.0), F.col("ord") == 0)
    return rows.select("row_id", score.alias("importance"))


def visual_captions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "core_preds", "pred_id").where("scene.label is not null")
    return rows.select("pred_id", captions.visual_caption(F.col("scene.label"), F.col("scene.indoor_outdoor"), F.array_compact("visual_terms")).alias("caption"))


def acoustic_captions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "core_nodes", "pred_id", "node_id").where("node_id is not null")
    number = F.regexp_extract("node_id", "(\\d+)", 1).try_cast("bigint")
    return captions.acoustic_caption(rows.select("pred_id", F.col("audioset_name").alias("name"), "confidence", number.alias("ord"), F.size("visual_evidence_terms").cast("bigint").alias("instance_count")), "pred_id")


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "core_preds", "pred_id")
    return rows.select("pred_id", captions.description(F.col("scene.label"), F.col("scene.indoor_outdoor"), F.col("visual_terms"), F.lit(None).cast("array<string>")).alias("text"))


def _scene_of_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, label, indoor_outdoor) that an image's first prediction with a scene gives it."""
    rows = table(spark, folder, "core_preds").where("image_id is not null and scene.label is not null")
    return rows.groupBy("image_id").agg(F.min_by("scene", "pred_id").alias("s")).select("image_id", "s.label", "s.indoor_outdoor")


def full_captions(spark: SparkSession, folder: str) -> DataFrame:
    ents = _once(spark, folder, "entities", "pred_id", "id").where("label is not null and id is not null")
    number = F.regexp_extract("id", "(\\d+)", 1).try_cast("bigint")
    rows = ents.select("pred_id", "id", number.alias("ord"), T.normalised(F.col("label")).alias("label"), F.coalesce("category", F.lit("object")).alias("category"), T.unit_confidence(F.col("confidence")).alias("confidence"), F.coalesce("count_estimate", F.lit(1).cast("bigint")).alias("count_estimate"), F.lit(0.0).alias("importance"))
    acts = _once(spark, folder, "interactions", "row_id").select("pred_id", F.struct("ord", "row_id").alias("ord"), "subject_id", "verb", "object_id")
    scenes = ents.groupBy("pred_id").agg(F.min("image_id").alias("image_id")).join(_scene_of_images(spark, folder), "image_id", "left")
    scenes = scenes.select("pred_id", F.coalesce("label", F.lit("visual")).alias("label"), F.coalesce("indoor_outdoor", F.lit("unknown")).alias("indoor_outdoor"))
    none = acts.limit(0).select("pred_id", "subject_id", F.lit("").alias("relation"), "object_id", F.lit(0.0).alias("confidence"), F.lit(0).alias("ord"))
    return captions.full_caption(scenes, rows, acts, none, "pred_id")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, objects): canonical labels of an image's legacy entities, its reference."""
    rows = table(spark, folder, "entities").where("image_id is not null").select("image_id", T.canonical(F.col("label"), _aliases()).alias("o")).where("o <> ''")
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_set("o")).alias("objects"))


def _pred_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with their canonical terms and their image's reference (empty where it has none)."""
    rows = _once(spark, folder, "core_preds", "pred_id").select("pred_id", "image_id", *metrics.CONDITION, "caption", "scene", "visual_terms")
    none = F.array().cast("array<string>")
    terms = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("visual_terms", none), lambda t: T.canonical(t, _aliases())), lambda t: t.isNotNull() & (t != ""))))
    return rows.withColumn("pred", terms).join(_references(spark, folder), "image_id", "left").withColumn("ref", F.coalesce("objects", none)).drop("objects")


def set_prf_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    """Exact set precision, recall and F1 of predicted against reference objects, averaged per condition."""
    rows = _pred_sets(spark, folder).withColumns(metrics.set_prf(F.col("pred"), F.col("ref")))
    means = metrics.condition_means(rows, ["precision", "recall", "f1"])
    return means.select(*metrics.CONDITION, "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def set_prf(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pred_sets(spark, folder)
    return rows.select("pred_id", *[F.round(c, 6).alias(n) for n, c in metrics.set_prf(F.col("pred"), F.col("ref")).items()])


def weighted_prf(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pred_sets(spark, folder)
    weights = F.map_from_entries(F.transform(F.array_union("pred", "ref"), lambda x: F.struct(x, families.label_weight(x))))
    rows = rows.withColumn("w", weights)
    return rows.select("pred_id", *[F.round(c, 6).alias(n) for n, c in metrics.weighted_prf(F.col("pred"), F.col("ref"), F.col("w")).items()])


def label_families(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("label")
    rows = table(spark, folder, "entities").select(T.ascii_folded(F.col("label")).alias("label")).where("label <> ''").distinct()
    return rows.select("label", families.family_of(c).alias("family"), families.family_of(c, scene=True).alias("scene_family"), families.label_weight(c).alias("weight"), fusion.category_of(c).alias("category"))


def verb_families(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "interactions").select(T.ascii_folded(F.col("verb")).alias("verb")).where("verb <> ''").distinct()
    return rows.select("verb", families.verb_family(F.col("verb")).alias("family"), T.verb_form(F.col("verb")).alias("form"))


def _family_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _pred_sets(spark, folder).select("pred_id", "pred", "ref")
    side = lambda c: families.family_counts(rows.select("pred_id", F.explode(c).alias("label")), "pred_id", count=None)
    return rows, side("pred"), side("ref")


def family_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _family_sides(spark, folder)[1]


def family_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = families.family_metrics(*_family_sides(spark, folder), "pred_id")
    return out.select("pred_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "pred_id"])


def scene_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How far a prediction's families fit its scene's group, and whether its side does."""
    rows = _pred_sets(spark, folder).withColumn("group", dims.lookup(SCENES, T.normalised(F.col("scene.label"))))
    counts = families.family_counts(rows.select("pred_id", F.explode("pred").alias("label")), "pred_id", count=None, scene=True)
    score = families.expected_share(counts, rows, "pred_id")
    inferred = rules.indoor_outdoor(T.normalised(F.col("scene.label")), F.col("group"), dims.INDOOR_GROUPS, [g for g in dims.SCENE_EXPECTED if g not in dims.INDOOR_GROUPS])
    io = families.io_consistency(F.col("group"), F.col("scene.indoor_outdoor"), inferred)
    return rows.join(score, "pred_id").select("pred_id", F.coalesce("group", F.lit("unknown")).alias("scene_group"), families.ambience(F.col("group")).alias("ambience"), io.alias("io_consistency"), F.round("score", 6).alias("score"))


def _chair_input(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _pred_sets(spark, folder).where("caption is not null")
    names = captionmetrics.vocabulary(_references(spark, folder).select(F.explode("objects").alias("object")).distinct(), STOP_WORDS)
    return rows, names


def chair_v2(spark: SparkSession, folder: str) -> DataFrame:
    rows, names = _chair_input(spark, folder)
    found = captionmetrics.mentions(rows.select("pred_id", captionmetrics.searched(F.col("caption"), F.coalesce("scene.label", F.lit(""))).alias("text")), names, "pred_id")
    ref = F.transform("ref", T.singular_phrase)
    out = rows.join(found, "pred_id")
    return out.select("pred_id", F.array_join("mentioned", "|").alias("mentioned"), *[c.alias(n) if n != "chair_i" else F.round(c, 6).alias(n) for n, c in captionmetrics.chair(F.col("mentioned"), ref).items()])


def chair_v2_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pred_sets(spark, folder).select("pred_id", *metrics.CONDITION).join(chair_v2(spark, folder), "pred_id")
    out = captionmetrics.chair_means(rows, metrics.CONDITION)
    return out.select(*metrics.CONDITION, "n", "n_chair", *[F.round(c, 5).alias(c) for c in ("chair_i", "avg_mentioned", "avg_hallucinated")])


def chair_v1(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pred_sets(spark, folder).where("caption is not null")
    names = _references(spark, folder).select(F.explode("objects").alias("name")).distinct()
    found = captionmetrics.mentions_loose(rows.select("pred_id", F.col("caption").alias("text")), names, "pred_id")
    out = rows.join(found, "pred_id")
    return out.select("pred_id", F.array_join("mentioned", "|").alias("mentioned"), *[c.alias(n) if n != "chair_i" else F.round(c, 6).alias(n) for n, c in captionmetrics.chair(F.col("mentioned"), F.col("ref")).items()])


def _cider(spark: SparkSession, folder: str, raw: bool = False) -> DataFrame:
    """Every caption, within its condition, against one caption of each other captioner of its image."""
    rows = _once(spark, folder, "core_preds", "pred_id").where("caption is not null and image_id is not null and captioner is not null")
    cands = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in metrics.CONDITION], F.col("pred_id").alias("id"), F.col("image_id").alias("image"), F.col("captioner").alias("by"), F.col("caption").alias("text"))
    refs = rows.groupBy(F.col("image_id").alias("image"), F.col("captioner").alias("by")).agg(F.min_by("caption", "pred_id").alias("text"))
    return captionmetrics.cider(cands, refs, metrics.CONDITION, raw=raw)


def cider(spark: SparkSession, folder: str) -> DataFrame:
    return _cider(spark, folder).select(F.col("id").alias("pred_id"), F.round("cider", 4).alias("cider"))


def cider_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    out = _cider(spark, folder).groupBy(*metrics.CONDITION).agg(F.count(F.lit(1)).alias("n_caption_refs"), F.avg("cider").alias("cider"))
    return out.withColumn("cider", F.round("cider", 4))


def cider_untokenised(spark: SparkSession, folder: str) -> DataFrame:
    """As ``cider``, of the captions as they stand: what white space separates, with capitals and punctuation."""
    return _cider(spark, folder, raw=True).select(F.col("id").alias("pred_id"), F.round("cider", 4).alias("cider"))


def embedding_cosine(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    right = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return rows.join(right, "vec_id").select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("e2")), 5).alias("cosine"))


def payload_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The best JSON object of each model output, or why there is none."""
    rows = _once(spark, folder, "staged_outputs", "output_id")
    return payload.extracted(rows, "output_id", "raw_output")


def payload_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_readable(_once(spark, folder, "nested_preds", "nested_id").select("nested_id", "body"), "body", "__v")
    out = payload.validation(rows, "nested_id")
    return out.withColumns({c: F.round(c, 6) for c in ("terms_declared_ratio", "interaction_valid_ratio")})


def payload_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised entities of legacy bodies."""
    rows = with_readable(_once(spark, folder, "nested_preds", "nested_id").select("nested_id", "body"), "body", "__v")
    cores = payload.with_core(rows.select("nested_id", F.to_json("__v").alias("json")), "nested_id")
    return payload.legacy_entities(cores, "nested_id").drop("old_id")


def payload_interactions(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_readable(_once(spark, folder, "nested_preds", "nested_id").select("nested_id", "body"), "body", "__v")
    cores = payload.with_core(rows.select("nested_id", F.to_json("__v").alias("json")), "nested_id")
    return payload.legacy_edges(cores, payload.legacy_entities(cores, "nested_id"), "nested_id", "observed_interactions", "verb", "interact with")


def payload_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What readable default cores violate, by kind of violation."""
    rows = with_readable(_once(spark, folder, "nested_preds", "nested_id").select("nested_id", "body"), "body", "__v")
    cores = rows.select("nested_id", F.try_variant_get("__v", "$.core", "variant").alias("core")).where(payload.schema_kind(F.col("core")) == "audioset")
    return cores.select("nested_id", F.explode(payload.core_errors(F.col("core"))).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def prediction_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of legacy predictions: entity labels and verbs, as they are and canonical."""
    ents, acts = table(spark, folder, "entities").select("pred_id", "label"), table(spark, folder, "interactions").select("pred_id", "verb")
    return assembly.evidence("pred_id", (ents, "label"), (acts, "verb"), aliases=_aliases())


def predicted_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes a prediction stores or its terms' rules fire, of the usable ones."""
    raw = table(spark, folder, "onto_nodes")
    usable = ontology.nodes_table(raw).where("usable").select(F.col("id").alias("rule_id")).unionByName(_rules(spark).select("rule_id"))
    stored = table(spark, folder, "core_nodes").select("pred_id", F.col("audioset_id").alias("rule_id"))
    return assembly.predicted_nodes(stored, rules_fired(spark, folder), usable, "pred_id", "union")


def node_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "core_nodes").select("pred_id", F.col("audioset_id").alias("item")).where("item is not null")
    return assembly.diagnostics(items, ontology.nodes_table(table(spark, folder, "onto_nodes")), "pred_id")


def manifest_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_readable(_once(spark, folder, "nested_preds", "nested_id").select("nested_id", "body"), "body", "__v")
    return assembly.manifest_summary(rows, "nested_id")


def projections(spark: SparkSession, folder: str) -> DataFrame:
    """Default cores made from the detections of each image."""
    det = _once(spark, folder, "detections", "det_id").where("image_id is not null and confidence between 0 and 1 and not isnan(confidence)")
    rows = det.select("image_id", F.struct("ord", "det_id").alias("ord"), F.nullif(T.normalised(F.col("label")), F.lit("")).alias("term"), "confidence")
    scenes = det.select("image_id").distinct().join(_scene_of_images(spark, folder), "image_id", "left")
    scenes = scenes.withColumns({"label": F.coalesce("label", F.lit("visual")), "indoor_outdoor": F.coalesce("indoor_outdoor", F.lit("unknown"))})
    out = assembly.projection(rows, _rules(spark), scenes, "image_id")
    return out.select("image_id", F.array_join("visual_terms", "|").alias("visual_terms"), F.coalesce(F.size("nodes"), F.lit(0)).cast("bigint").alias("n_nodes"), "caption", "acoustic_caption")


def metric_group_projection(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.column_group(set_prf_by_condition(spark, folder), [*metrics.CONDITION, "n", "f1"])


QUERIES = {
    f.__name__: f
    for f in (
        set_prf_by_condition, set_prf, weighted_prf, text_forms, confidence_unit, caption_segments, english_lists, count_bins, path_conditions, schema_counts, box_geometry,
        box_overlaps, category_coverage, nms_kept, nms_detections, alias_kept, detection_differences, detection_differences_all, rule_terms, rules_fired, rule_nodes, prompt_batches, ontology_names, ontology_names_all,
        ontology_integrity, ontology_parents, ontology_leaves, ontology_distances, ontology_distances_all, hierarchical_prf, hierarchical_prf_all, best_similarity, best_similarity_all, common_ancestors, entity_aggregate, grounding_matches, grounding_matches_all, interactions_top,
        spatial_relations, semantic_importance, visual_captions, acoustic_captions, descriptions, full_captions, label_families, verb_families, family_counts, family_metrics,
        scene_evidence, chair_v2, chair_v2_by_condition, chair_v1, cider, cider_by_condition, cider_untokenised, embedding_cosine, payload_objects, payload_validation, payload_entities, payload_interactions,
        payload_errors, prediction_evidence, predicted_nodes, node_diagnostics, manifest_summary, projections, metric_group_projection,
    )
}
SQL = build(ALIASES, RULES, STOP_WORDS, SCENES, WIDTH, HEIGHT)

"""From boxes to entities, interactions and spatial relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium import dims
from scenarium.functions import geometry as G
from scenarium.functions.text import normalised

#: Parts a group's boxes are spread over where they meet each other.
SALTS = 8


def category_of(label: Column, given: Column | None = None) -> Column:
    """A label's category; a valid given one stands."""
    found = dims.lookup(dims.CATEGORY_OF, label, dims.DEFAULT_CATEGORY)
    return found if given is None else F.when(normalised(given).isin(dims.VALID_CATEGORIES), normalised(given)).otherwise(found)


def entities(boxes: DataFrame, key: str) -> DataFrame:
    """(key, id, label, category, count_estimate, confidence): boxes of one label and category as one entity.

    ``boxes``: key, ord, label, confidence. Ids e1, e2, ... follow the first box of each.
    """
    label = normalised(F.col("label"))
    here = boxes.where("label is not null").select(key, "ord", label.alias("label"), category_of(label).alias("category"), "confidence")
    each = here.groupBy(key, "label", "category").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("count_estimate"), F.min("ord").alias("first"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first", "label"))
    return each.select(key, F.concat(F.lit("e"), number.cast("string")).alias("id"), "label", "category", "count_estimate", "confidence")


def best_match(boxes: DataFrame, candidates: DataFrame, key: str, least: float = 0.2, inclusive: bool = True, only: Column | None = None, but_itself: bool = False) -> DataFrame:
    """(key, box_id, match_id, iou): for each box, the candidate of its key it overlaps most; the first of equal ones.

    ``boxes``: key, box_id, x1..y2; ``candidates``: key, match_id, ord, x1..y2 and what ``only`` tests. The threshold is
    inclusive or strict. ``but_itself``: the candidates are the boxes, and none matches itself. Candidates are replicated to SALTS parts of their key, boxes go to one: a hot key is spread.
    """
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    c = (candidates.where(only) if only is not None else candidates).select(key, "match_id", F.col("ord").alias("m_ord"), *[F.col(x).alias(f"m_{x}") for x in ("x1", "y1", "x2", "y2")], spread.alias("salt"))
    b = boxes.withColumn("salt", F.pmod(F.xxhash64("box_id"), F.lit(SALTS)).cast("bigint"))
    met = b.join(c, [key, "salt"])
    near = (met.where("box_id <> match_id") if but_itself else met).withColumn("iou", G.iou(G.Box.of(), G.Box.of("m_")))
    near = near.where(F.col("iou") >= least if inclusive else F.col("iou") > least)
    best = F.max_by(F.struct("match_id", "iou"), F.struct(F.col("iou"), -F.col("m_ord")))
    return near.groupBy(key, "box_id").agg(best.alias("m")).select(key, "box_id", F.col("m.match_id").alias("match_id"), F.col("m.iou").alias("iou"))


def observed_interactions(triplets: DataFrame, entity_boxes: DataFrame, key: str) -> DataFrame:
    """(key, ord, subject_id, verb, object_id, confidence) of a model's triplets; those without a match are dropped.

    ``triplets``: key, ord, verb, confidence, h and o (STRUCT<x1,y1,x2,y2>); subjects must be human. ``entity_boxes``: key, match_id,
    ord, category, x1..y2.
    """
    side = lambda s: triplets.select(key, F.col("ord").alias("box_id"), f"{s}.*")
    subject = best_match(side("h"), entity_boxes, key, only=F.col("category") == "human").select(key, F.col("box_id").alias("ord"), F.col("match_id").alias("subject_id"))
    object_ = best_match(side("o"), entity_boxes, key).select(key, F.col("box_id").alias("ord"), F.col("match_id").alias("object_id"))
    return triplets.join(subject, [key, "ord"]).join(object_, [key, "ord"]).select(key, "ord", "subject_id", "verb", "object_id", "confidence")


def top_interactions(rows: DataFrame, key: str) -> DataFrame:
    """The most confident interaction of each (subject, object); the first of equal ones."""
    w = Window.partitionBy(key, "subject_id", "object_id").orderBy(F.desc("confidence"), "ord")
    return rows.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def semantic_importance(salience: Column, category: Column, scene_relevance: Column, interacts: Column) -> Column:
    """0.45 salience + 0.30 category + 0.20 scene + 0.05 interaction, within 0 and 1, to four places (halves up)."""
    weight = dims.lookup(dims.CATEGORY_WEIGHTS, category, 0.3)
    score = 0.45 * salience + 0.30 * weight + 0.20 * F.coalesce(scene_relevance, F.lit(0.0)) + 0.05 * F.when(interacts, 1.0).otherwise(0.0)
    return F.floor(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))) * 10_000 + 0.5) / 10_000


def environment(humans: Column, interactions: Column) -> dict[str, Column]:
    """Crowd level by the number of people, activity by whether anything is done."""
    crowd = F.when(humans <= 0, "empty").when(humans <= 2, "sparse").otherwise("moderate")
    return {"crowd_level": crowd, "activity_level": F.when(interactions > 0, "medium").otherwise("low"), "lighting": F.lit("unknown")}


def spatial_candidate(label: Column, size: Column) -> Column:
    """Whether an entity takes part in relations: never background, always known things, others unless they fill the image."""
    known = [*dims.SPATIAL_LABELS["compact"], *dims.SPATIAL_LABELS["structure"]]
    return ~label.isin(dims.SPATIAL_LABELS["background"]) & (label.isin(known) | (size != "dominant"))


def spatial_relations(
    boxes: DataFrame, key: str, width: float, height: float, axis: float = 0.15, overlapping: float = 0.35, least: float = 0.15, per_subject: int = 3, salience: float = 0.30,
) -> DataFrame:
    """(key, subject_id, relation, object_id, confidence, rnk): relations between the eligible boxes of each key.

    ``boxes``: key, id STRING, ord BIGINT, label (normalised), relative_size, salience_score, x1..y2 (clipped). Each pair has its most
    confident relation: overlapping by IoU, left or right by the horizontal distance, above or below by the vertical one, as parts of the
    image. Of a relation and its inverse the one whose subject comes first stays; each subject keeps its ``per_subject`` best.

    The confidence is the same from both sides, so only pairs with the subject first are made: half of them, spread over SALTS parts.
    """
    eligible = boxes.where((F.col("salience_score") >= salience) & spatial_candidate(F.col("label"), F.col("relative_size"))).select(key, "id", "ord", "x1", "y1", "x2", "y2")
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    a = eligible.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("bigint"))
    b = eligible.select(key, *[F.col(c).alias(f"b_{c}") for c in ("id", "ord", "x1", "y1", "x2", "y2")], spread.alias("salt"))
    pairs = a.join(b, [key, "salt"]).where("ord < b_ord")
    s, o = G.Box.of(), G.Box.of("b_")
    dx, dy, both = F.abs(s.cx - o.cx) / width, F.abs(s.cy - o.cy) / height, G.iou(s, o)
    option = lambda test, name, value, rank: F.when(test, F.struct(value.alias("confidence"), F.lit(-rank).alias("rank"), name.alias("relation")))
    options = F.array_compact(
        F.array(
            option(both >= overlapping, F.lit("overlapping"), F.least(both, F.lit(1.0)), 0),
            option((dx >= axis) & (dx >= dy), F.when(s.cx < o.cx, "left_of").otherwise("right_of"), F.least(dx, F.lit(1.0)), 1),
            option((dy >= axis) & (dy > dx), F.when(s.cy < o.cy, "above").otherwise("below"), F.least(dy, F.lit(1.0)), 2),
        )
    )
    best = F.array_max(F.filter(options, lambda x: x["confidence"] >= least))
    rows = pairs.withColumn("best", best).where("best is not null").select(key, F.col("id").alias("subject_id"), "best.relation", F.col("b_id").alias("object_id"), "best.confidence", "b_ord")
    w = Window.partitionBy(key, "subject_id").orderBy(F.desc("confidence"), "b_ord")
    return rows.withColumn("rnk", F.row_number().over(w).cast("bigint")).where(F.col("rnk") <= per_subject).drop("b_ord")


def without_inverses(relations: DataFrame, key: str) -> DataFrame:
    """Relations (key, subject_id, relation, object_id, confidence, ord) without those whose inverse or mirror is more confident, or equal and first."""
    inverse = F.coalesce(dims.lookup(dims.INVERSES, F.col("relation")), F.when(F.col("relation").isin(dims.SYMMETRIC), F.col("relation")))
    first, second = F.least("subject_id", "object_id"), F.greatest("subject_id", "object_id")
    kind = F.when(inverse.isNull(), F.concat_ws("|", "subject_id", "relation")).otherwise(F.when(F.col("subject_id") == first, F.col("relation")).otherwise(inverse))
    w = Window.partitionBy(key, first, second, kind).orderBy(F.desc("confidence"), "ord")
    return relations.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")

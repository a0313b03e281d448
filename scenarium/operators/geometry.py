"""Geometry of detections and of whole images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.functions import geometry as G
from scenarium.functions.text import normalised


def entity_geometry(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """``detections`` (label, x1..y2, confidence, ...) with clipped boxes and all fields derived from them."""
    box = G.clipped(G.Box.of(), width, height)
    here = detections.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box)))
    box = G.Box.of()
    ratio = F.least(G.area_ratio(box, width, height), F.lit(1.0))
    return here.withColumns(
        {
            "label": normalised(F.col("label")), "bbox_area_ratio": ratio, "relative_size": G.size_class(ratio), "position_coarse": G.grid_place(box, width, height),
            "is_central": G.central(box, width, height), "salience_score": G.salience(box, F.col("confidence"), width, height),
        }
    )


def global_geometry(entities: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image: covered area, density, and count and coverage of each category (null: object).

    ``entities``: key, category, bbox_area_ratio. Two aggregations, both with partial sums before their shuffle: an image
    that holds a third of all boxes sends one row per category and task.
    """
    per = entities.groupBy(key, F.coalesce("category", F.lit("object")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("bbox_area_ratio").alias("part"))
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", v))))
    return per.groupBy(key).agg(
        F.least(F.sum("part"), F.lit(1.0)).alias("total_object_coverage"), F.least(F.sum("n") / 20.0, F.lit(1.0)).alias("object_density_proxy"),
        entry("n").alias("category_counts"), entry("part").alias("category_coverage"),
    )

"""Reports over many rows' metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.operators.metrics import column_group

#: Columns of the metric groups of reports.
GROUPS = {
    "caption": ["detector", "scene_model", "captioner", "CIDEr", "SPICE", "n"],
    "chair": ["detector", "scene_model", "captioner", "CHAIRi_VG", "CHAIRi_JSON", "avg_caption_objects_mentioned", "avg_hallucinated_vg", "avg_hallucinated_json", "n"],
    "scene": ["detector", "scene_model", "captioner", "scene_group_known", "pred_entity_scene_consistency", "n"],
    "legacy_soundscape": [
        "detector", "scene_model", "captioner", "weighted_entity_family_f1", "weighted_discrete_family_f1", "acoustic_weighted_discrete_presence_recall", "interaction_family_f1", "n",
    ],
    "audioset": [
        "detector", "scene_model", "captioner", "audioset_exact_node_f1", "audioset_parent_f1", "audioset_top_level_f1", "audioset_lca_similarity", "audioset_tree_distance_similarity", "n",
    ],
}


def metric_group(rows: DataFrame, group: str) -> DataFrame:
    """A group's columns of a report; an error that names the missing ones."""
    return column_group(rows, GROUPS[group])


def merged(keys: list[str], *families: DataFrame) -> DataFrame:
    """Per-row metrics of several families side by side, all of the first one's rows."""
    out = families[0]
    for f in families[1:]:
        out = out.join(f, keys, "left")
    return out


def sweep(**options: list) -> list[dict]:
    """Every combination of a run's options."""
    out: list[dict] = [{}]
    for name, values in options.items():
        out = [o | {name: v} for o in out for v in values]
    return out


def biggest_drops(both: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` images that lost most detections between two runs (a top-k report)."""
    return both.orderBy("filtered_delta", "image_id").limit(most)


def summary(both: DataFrame) -> DataFrame:
    """One row: images in both runs and means of their counts before and after."""
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_filtered_before").alias("mean_before"), F.avg("n_filtered_after").alias("mean_after"), F.avg("filtered_delta").alias("mean_delta")
    )

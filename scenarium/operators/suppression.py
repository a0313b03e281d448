"""Greedy suppression of boxes: non-maximum suppression and suppression of aliases.

Boxes are taken by confidence; one that conflicts with a box already kept is dropped. What a dropped box overlaps does not
matter, so no join of pairs can express it. Here it runs in rounds over blocks: the best BLOCK boxes of every image are decided
in one task per image, the rest is freed of what the kept ones suppress, in parallel, and the next block, GROWTH times larger up
to a bound, follows. An image with few boxes takes one round; one with a third of all boxes takes more, but never a task of more
than MOST_BLOCKS * BLOCK boxes. Conflicts among the rest are never listed: in a crowded image they are nearly all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium import dims
from scenarium.functions import geometry as G
from scenarium.functions.text import normalised
from scenarium.storage import Scratch

#: Boxes of one image that a task decides at a time.
BLOCK = 4000
#: How blocks grow from round to round, and up to how many times the first one: some megabytes.
GROWTH, MOST_BLOCKS = 4, 16
#: Undecided boxes in one part of an image, against which its kept ones are held.
PART = 20_000
_FIELDS = ["x1", "y1", "x2", "y2"]

Conflict = Callable[[G.Box, G.Box, Column, Column], Column]


def _measures(b: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IoU of boxes with one box, the part of each that it covers, and the part of it that each covers."""
    area = lambda x: np.maximum(0, x[..., 2] - x[..., 0]) * np.maximum(0, x[..., 3] - x[..., 1])
    inter = np.maximum(0, np.minimum(b[:, 2], one[2]) - np.maximum(b[:, 0], one[0])) * np.maximum(0, np.minimum(b[:, 3], one[3]) - np.maximum(b[:, 1], one[1]))
    a, o = area(b), area(one)
    union = a + o - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, inter / union, 0.0), np.where(a > 0, inter / a, 0.0), (inter / o if o > 0 else np.zeros(len(b)))


def _greedy(boxes: np.ndarray, groups: np.ndarray, conflict: Callable[[tuple, int], np.ndarray]) -> np.ndarray:
    """Which of one image's boxes, best first, are kept."""
    alive = np.ones(len(boxes), dtype=bool)
    for i in range(len(boxes)):
        if alive[i] and i + 1 < len(boxes):
            rest = np.flatnonzero(alive[i + 1 :]) + i + 1
            rest = rest[groups[rest] == groups[i]] if groups[i] >= 0 else rest[:0]
            if len(rest):
                alive[rest[conflict(_measures(boxes[rest], boxes[i]), groups[i])]] = False
    return alive


def _decided(df: DataFrame, conflict: Callable[[tuple, int], np.ndarray]) -> DataFrame:
    """(key, id, kept) of boxes (key, id, rank, x1..y2, grp), one block of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            boxes = np.stack([table.column(c).to_numpy() for c in _FIELDS], axis=1)
            groups = table.column("grp").to_numpy()
            kept = np.ones(table.num_rows, dtype=bool)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if b - a > 1:
                    kept[a:b] = _greedy(boxes[a:b], groups[a:b], conflict)
            return pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), table.column("id").combine_chunks(), pa.array(kept)], ["key", "id", "kept"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come sorted by key: all but the last key of what is held is complete.
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = table.column("key")
            last = keys[-1].as_py()
            n = table.num_rows
            while n and keys[n - 1].as_py() == last:
                n -= 1
            if n:
                yield flush(table.slice(0, n))
            held = table.slice(n).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    ready = df.repartition("key").sortWithinPartitions("key", "rank")
    return ready.select("key", "id", *_FIELDS, "grp").mapInArrow(run, "key string, id bigint, kept boolean")


def _greedy_rounds(boxes: DataFrame, local: Callable[[tuple, int], np.ndarray], conflict: Conflict, block: int) -> DataFrame:
    """(key, id) of the kept boxes. ``boxes``: key STRING, id BIGINT (unique), confidence, ord, x1..y2, grp INT (-1: never in conflict)."""
    scratch = Scratch(boxes.sparkSession, "suppression")
    order = [F.desc("confidence"), F.col("ord"), F.col("id")]
    left = boxes.select("key", "id", "confidence", "ord", *_FIELDS, "grp")
    kept: list[DataFrame] = []
    most = block * MOST_BLOCKS
    while True:
        ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= block)
        ranked = scratch.write(ranked, "block")
        verdict = scratch.write(_decided(ranked, local), "verdict")
        new = scratch.write(ranked.join(verdict.where("kept"), ["key", "id"], "left_semi"), "kept")
        kept.append(new.select("key", "id"))
        # Only images with a full block can have more.
        full = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= block).select("key")
        rest = left.join(full, "key", "left_semi").join(ranked.select("key", "id"), ["key", "id"], "left_anti")
        sizes, n = scratch.counted(rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("bigint").alias("parts")), "sizes")
        if not n:
            break
        rest = rest.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        keep = new.join(sizes, "key").select("key", F.col("grp").alias("k_grp"), *[F.col(c).alias(f"k_{c}") for c in _FIELDS], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        test = (F.col("grp") == F.col("k_grp")) & (F.col("grp") >= 0) & conflict(G.Box.of(), G.Box.of("k_"), F.col("grp"), F.col("k_grp"))
        r, k = rest.alias("r"), keep.alias("k")
        free = r.join(k, (F.col("r.key") == F.col("k.key")) & (F.col("r.part") == F.col("k.part")) & test, "left_anti")
        left, n = scratch.counted(free.select("key", "id", "confidence", "ord", *_FIELDS, "grp"), "left")
        if not n:
            break
        block = min(block * GROWTH, most)
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def nms(boxes: DataFrame, threshold: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(key, id) of boxes that no better kept one overlaps with an IoU of ``threshold`` or more, whatever the labels.

    ``boxes``: key STRING, id BIGINT (unique), confidence DOUBLE, ord BIGINT (place in the detector's list, which breaks
    ties), x1..y2. Boxes without area conflict with none; null confidence comes last; rows with a null key are one image.
    """
    ready = boxes.withColumns({"key": F.coalesce("key", F.lit("\u0000")), "grp": F.lit(0), "confidence": F.coalesce("confidence", F.lit(-1.0))})
    out = _greedy_rounds(ready, lambda m, g: m[0] >= threshold, lambda b, k, _g, _h: G.iou(b, k) >= threshold, block)
    return out.withColumn("key", F.nullif("key", F.lit("\u0000")))


def alias_suppression(boxes: DataFrame, iou: float = 0.30, contained: float = 0.65, human_iou: float = 0.75, block: int = BLOCK) -> DataFrame:
    """(key, id) of boxes left when labels that stand for one thing (people, cattle, carts) overlap: the better one.

    Boxes of people conflict from ``human_iou``; others of a group from ``iou``, or if one covers ``contained`` of the other.
    Boxes of labels outside the groups stay. ``boxes`` as for ``nms``, with label.
    """
    names = list(dims.ALIAS_GROUPS)
    human = names.index("human")
    group = dims.lookup({w: names.index(g) for w, g in dims.ALIAS_GROUP_OF.items()}, normalised(F.col("label")), -1)
    ready = boxes.withColumns({"key": F.coalesce("key", F.lit("\u0000")), "grp": group, "confidence": F.coalesce("confidence", F.lit(-1.0))})

    def local(m: tuple, g: int) -> np.ndarray:
        return m[0] >= human_iou if g == human else (m[0] >= iou) | (m[1] >= contained) | (m[2] >= contained)

    def conflict(b: G.Box, k: G.Box, g: Column, _h: Column) -> Column:
        alike = (G.iou(b, k) >= iou) | (G.containment(b, k) >= contained) | (G.containment(k, b) >= contained)
        return F.when(g == human, G.iou(b, k) >= human_iou).otherwise(alike)

    return _greedy_rounds(ready, local, conflict, block).withColumn("key", F.nullif("key", F.lit("\u0000")))


def suppressed(boxes: DataFrame, min_confidence: float = 0.20, nms_iou: float = 0.85, alias_iou: float = 0.30, contained: float = 0.65, block: int = BLOCK) -> DataFrame:
    """Detections after the confidence filter (inclusive), NMS and alias suppression; their labels normalised."""
    strong = boxes.where(F.col("confidence") >= min_confidence).withColumn("label", normalised(F.col("label")))
    once = strong.join(nms(strong, nms_iou, block).select("id"), "id", "left_semi")
    return once.join(alias_suppression(once, alias_iou, contained, block=block).select("id"), "id", "left_semi")


def count_differences(before: DataFrame, after: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(both, only_before, only_after) of two runs' counts (key, n_raw, n_filtered): differences of the images in both."""
    a = before.select(key, F.col("n_raw").alias("n_raw_before"), F.col("n_filtered").alias("n_filtered_before"))
    b = after.select(key, F.col("n_raw").alias("n_raw_after"), F.col("n_filtered").alias("n_filtered_after"))
    both = a.join(b, key).withColumn("filtered_delta", F.col("n_filtered_after") - F.col("n_filtered_before"))
    columns = [key, "n_raw_before", "n_raw_after", "n_filtered_before", "n_filtered_after", "filtered_delta"]
    return both.select(columns), a.join(b, key, "left_anti"), b.join(a, key, "left_anti")

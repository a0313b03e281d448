"""Top N items within every group, by mergeable bounded heaps.

Every task keeps, per group, at most N items in order of score (descending), tie-breakers and the unique identifier; a
new item enters only if it beats the last. Heaps are written when a task ends, or when it holds more of them than fit,
so memory is bounded by a parameter and a group of any size leaves N rows per task. After the shuffle the heaps of a
group, which stand together by a sort of the group's key alone, are merged by the same step as they stream by: what is held of a group is
N rows and the batch at hand. An item delivered again ties with itself in every respect and is kept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task holds in its heaps before it hands them on and starts anew.
HEAP_ROWS = 400_000
#: New rows that wait for the heaps at a time.
WAIT_ROWS = 200_000
SCHEMA = "level string, group_key string, item_key string, score double, tie bigint, num bigint"


def _codes(batch: pa.Table, name: str) -> np.ndarray:
    return batch.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _places(keys: pa.Array) -> np.ndarray:
    """The place of each key among all, by bytes."""
    words = keys.fill_null("").dictionary_encode()
    place = np.empty(len(words.dictionary), dtype=np.int64)
    place[np.argsort(np.array([w.encode() for w in words.dictionary.to_pylist()], dtype=object), kind="stable")] = np.arange(len(place))
    return place[words.indices.to_numpy(zero_copy_only=False)]


def _tied(table: pa.Table, order: np.ndarray, *columns: np.ndarray) -> bool:
    """Whether two rows are equal in all columns but their item_key."""
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for c in columns:
        sorted_ = c[order]
        same &= sorted_[1:] == sorted_[:-1]
    if not same.any():
        return False
    at = np.flatnonzero(same)
    keys = table.column("item_key").combine_chunks().fill_null("")
    return keys.take(pa.array(order[at])).to_pylist() != keys.take(pa.array(order[at + 1])).to_pylist()


def _best(table: pa.Table, limits: dict[str, int]) -> tuple[pa.Table, np.ndarray]:
    """The first N rows of each group, N by level, in order, with their ranks from 1; exact copies once."""
    if not table.num_rows:
        return table, np.empty(0, dtype=np.int64)
    level, group = _codes(table, "level"), _codes(table, "group_key")
    score, tie, num = (table.column(c).to_numpy() for c in ("score", "tie", "num"))
    item = np.zeros(len(score), dtype=np.int64)
    order = np.lexsort((num, tie, -score, group, level))
    if _tied(table, order, level, group, score, tie, num):
        item = _places(table.column("item_key").combine_chunks())
        order = np.lexsort((item, num, tie, -score, group, level))
    level, group, score, tie, num, item = (x[order] for x in (level, group, score, tie, num, item))
    new_group = np.ones(len(order), dtype=bool)
    new_group[1:] = (level[1:] != level[:-1]) | (group[1:] != group[:-1])
    copy = np.zeros(len(order), dtype=bool)
    copy[1:] = ~new_group[1:] & (score[1:] == score[:-1]) & (tie[1:] == tie[:-1]) & (num[1:] == num[:-1]) & (item[1:] == item[:-1])
    kept = np.cumsum(~copy)  # rank among distinct items
    first = np.maximum.accumulate(np.where(new_group, kept, 0))
    names = table.column("level").combine_chunks().dictionary_encode().dictionary.to_pylist()
    limit = np.array([limits[x] for x in names])[level]
    good = ~copy & (kept - first < limit)
    return table.take(pa.array(order[good])), (kept - first)[good] + 1


def heaps(items: DataFrame, limits: dict[str, int], heap_rows: int = HEAP_ROWS, wait_rows: int = WAIT_ROWS) -> DataFrame:
    """Per task and group, the best N of ``items`` (SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= wait_rows:
                held, _ = _best(pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(waiting)]), limits)
                waiting, n = [], 0
                if held.num_rows > heap_rows:
                    yield from held.to_batches(max_chunksize=50_000)
                    held = None
        if waiting or held is not None:
            tables = [*([held] if held is not None else []), *([pa.Table.from_batches(waiting)] if waiting else [])]
            yield from _best(pa.concat_tables(tables), limits)[0].to_batches(max_chunksize=50_000)

    return items.select(*[f.split()[0] for f in SCHEMA.split(", ")]).mapInArrow(run, SCHEMA)


def merged(parts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(level, group_key, item_key, rnk): heaps of all tasks (SCHEMA) merged by group. A task gets whole groups, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if open_ is None else pa.concat_tables([open_, table])
            # The last group may go on in the next batch.
            level, group = (table.column(c)[-1] for c in ("level", "group_key"))
            last = pc.and_(pc.equal(table.column("level"), level), pc.equal(table.column("group_key"), group))
            yield from ranked(table.filter(pc.invert(last)))
            open_, _ = _best(table.filter(last), limits)
        if open_ is not None:
            yield from ranked(open_)

    def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        best, ranks = _best(table, limits)
        keys = pc.coalesce(best.column("item_key"), best.column("num").cast(pa.string()))
        yield from pa.table([best.column("level"), best.column("group_key"), keys, pa.array(ranks, pa.int64())], names=["level", "group_key", "item_key", "rnk"]).to_batches()

    together = parts.repartition("level", "group_key").sortWithinPartitions("level", "group_key")
    return together.mapInArrow(run, "level string, group_key string, item_key string, rnk bigint")


def top_items(items: DataFrame, limits: dict[str, int], heap_rows: int = HEAP_ROWS) -> DataFrame:
    """(level, group_key, item_key, rnk) of the best N items of every group.

    ``items``: level STRING (a key of ``limits``, which gives N), group_key, item_key STRING, score DOUBLE, tie BIGINT, num
    BIGINT. Order: score descending, then tie, num and item_key ascending; a null tie or num comes last. A null item_key
    stands for num in decimals. Items with a null group, and scores that are null or NaN, take no part. Empty input gives
    no rows. Memory of a task: bounded before the shuffle by ``heap_rows``, after it by a batch; a hot group arrives as N rows per task.
    """
    last = F.lit((1 << 63) - 1)
    clean = items.where("group_key is not null and score is not null and not isnan(score)")
    clean = clean.withColumns({"tie": F.coalesce("tie", last), "num": F.coalesce("num", last), "score": F.col("score") + F.lit(0.0)})
    return merged(heaps(clean, limits, heap_rows), limits)

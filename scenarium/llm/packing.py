"""Filling fixed-capacity containers, by bounded-space online packing.

Every task keeps a fixed number of open windows. An item goes into the fullest window it fits into; when none fits, the
fullest window is emitted and a new one opened. What is open at a task's end is merged: the windows of several
tasks are the items of the next round, each whole, until one task's worth is left. Memory is bounded by the
number of windows, whatever the number of items, and each item is moved at most once per round, by reference.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.storage import Scratch

CAPACITY = 2048
#: Windows a task keeps open.
WINDOWS = 64
#: Tasks whose leftovers one task merges in a round.
FAN_IN = 32
_PACKED = "container bigint, key bigint, piece int, start bigint, size bigint, open boolean"


class Windows:
    """Open windows by their free space. ``emit`` gets the number of each window that is closed."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free: list[tuple[int, int]] = []  # (free space, window), sorted
        self.next = 0
        self.full: int | None = None  # the window that was last filled to the brim

    def place(self, size: int) -> tuple[int, int | None]:
        """(window, emitted window or None) for an item."""
        emitted = None
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            space, window = self.free.pop(k)
        else:
            if len(self.free) >= self.most:
                emitted = self.free.pop(0)[1]
            space, window = self.capacity, self.next
            self.next += 1
        if space > size:
            insort(self.free, (space - size, window))
        else:
            self.full = window
        return window, emitted


def split(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, size): an item larger than the capacity as full pieces and a rest, others as one piece.

    Items of null, zero or negative size need no container and give no row.
    """
    n = F.ceil(F.col("size") / capacity).cast("bigint")
    pieces = sizes.where("size > 0").select(F.col(key).alias("key"), "size", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return pieces.select("key", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("size") - start, F.lit(capacity).cast("bigint")).alias("size"))


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(container, key, piece, start, size): every piece of every item of ``sizes`` (key BIGINT, size BIGINT) in a container.

    An item is in one container unless it alone exceeds the capacity; then its full pieces have one each and its rest is
    packed like an item. Repeated keys are items of their own. Container numbers are unique, not consecutive.
    """
    scratch = Scratch(sizes.sparkSession, "packing")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, own = TaskContext.get().partitionId() << 32, Windows(capacity, windows)
        held: dict[int, list[tuple[int, int, int, int]]] = {}
        out: list[tuple] = []

        def write(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], [f.split()[0] for f in _PACKED.split(", ")])

        for batch in batches:
            for item in zip(*(batch.column(i).to_pylist() for i in range(4))):
                window, emitted = own.place(item[3])
                held.setdefault(window, []).append(item)
                if emitted is not None:
                    out += [(base | emitted, *x, False) for x in held.pop(emitted)]
                if own.full == window:
                    own.full = None
                    out += [(base | window, *x, False) for x in held.pop(window)]
            if len(out) > 50_000:
                yield write(out)
                out = []
        still = {w for _, w in own.free}
        for window, items in held.items():
            out += [(base | window, *x, window in still) for x in items]
        yield write(out)

    packed = scratch.write(split(sizes, key, capacity).select("key", "piece", "start", "size").mapInArrow(first, _PACKED), "packed")
    closed, open_ = packed.where("not open").drop("open"), packed.where("open").drop("open")
    left = scratch.write(open_.groupBy("container").agg(F.sum("size").alias("size")), "left")
    moved: DataFrame | None = None
    tasks = max(1, packed.select(F.shiftright("container", 32)).distinct().count())
    round_ = 0
    while True:
        tasks, round_ = max(1, -(-tasks // fan_in)), round_ + 1
        number = 1 << 62 | round_ << 52

        def merge(batches: Iterator[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
            base, own = number | TaskContext.get().partitionId() << 28, Windows(capacity, windows)
            rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(2)))), key=lambda r: (-r[1], r[0]))
            to = [base | own.place(size)[0] for _, size in rows]
            still = {base | w for _, w in own.free}
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(to, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([t in still for t in to], pa.bool_())],
                ["container", "to", "size", "open"],
            )

        # Ranges of containers, so that neither the number of tasks nor a task's share grows with the data.
        spread = left.repartition(tasks) if tasks == 1 else left.repartitionByRange(tasks, "container")
        step = scratch.write(spread.mapInArrow(merge, "container bigint, to bigint, size bigint, open boolean"), "merged")
        link = step.select("container", "to")
        moved = link if moved is None else scratch.write(moved.withColumnRenamed("to", "mid").join(link.withColumnRenamed("container", "mid"), "mid", "left").select("container", F.coalesce("to", "mid").alias("to")), "moved")
        if tasks == 1:
            break
        left = scratch.write(step.where("open").groupBy(F.col("to").alias("container")).agg(F.sum("size").alias("size")), "left")
    final = open_.join(moved, "container").select(F.col("to").alias("container"), "key", "piece", "start", "size")
    return closed.unionByName(final).withColumnRenamed("key", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, the sum of sizes, the least number of containers any packing needs, the share in use."""
    each = packed.groupBy("container").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    used = F.count(F.lit(1))
    return each.agg(
        used.alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pieces"), total.alias("size"), F.ceil(total / capacity).cast("bigint").alias("least"),
        F.coalesce(F.max("size"), F.lit(0)).cast("bigint").alias("fullest"), F.when(used > 0, total / (used * capacity)).alias("filled"),
    )

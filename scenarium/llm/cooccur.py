"""Items that appear together, by stripes.

Per task, each item has a stripe: an associative array of the items that follow it in a record and how often they do. Stripes are
written when a task ends or its stripes reach a size, so memory is bounded. They are shuffled by item and by a slice of
the neighbours' hashes: an item found in a third of all records is merged by as many tasks as its stripe has slices.
Merging adds the arrays by key, stripe by stripe, as those of an item and slice stream by one after another. An item's own
count travels in its stripe, under its own name. Pairs are then kept by lift and by the log-likelihood ratio's significance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.storage import Scratch

#: Cells (item, neighbour) a task holds before it writes its stripes.
STRIPE_CELLS = 2_000_000
#: Pairs expanded at a time, however long a record is.
PAIR_BLOCK = 1_000_000
#: Slices of an item's stripe.
SLICES = 16
#: Least log-likelihood ratio of a pair. A pair found three times and three times as often as by chance has 2 * (3 * ln 3 - 2) = 2.59
#: at least (each cell of its table adds O * ln(O / E) - O + E >= 0), so that this takes none of those away.
LEAST_RATIO = 2.5
SCHEMA = "item string, slice int, neighbours array<string>, counts array<bigint>"


class _Stripes:
    """Counts of (item, neighbour) by number, with the numbers' names."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.keys = np.empty(0, dtype=np.int64)
        self.counts = np.empty(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def code(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            k = self.number.get(w)
            if k is None:
                k = self.number[w] = len(self.names)
                self.names.append(w)
            out[i] = k
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append(a << 31 | b)
        self.n_waiting += len(a)
        if self.n_waiting >= PAIR_BLOCK:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        both = np.concatenate([self.keys, keys])
        self.keys, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate([self.counts, counts]), minlength=len(self.keys)).astype(np.int64)

    def records(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        """Add all pairs of each record; ``codes`` are its items in order, records one after another."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.add(codes, codes)
        for k in np.unique(lengths):
            if k < 2:
                continue
            rows = starts[lengths == k]
            if k * (k - 1) // 2 <= PAIR_BLOCK:
                i, j = np.triu_indices(int(k), 1)
                step = max(1, PAIR_BLOCK // len(i))
                for at in range(0, len(rows), step):
                    block = codes[rows[at : at + step, None] + np.arange(k)]
                    self.add(block[:, i].ravel(), block[:, j].ravel())
            else:  # a record too long to expand at once: one item's neighbours after another
                for r in rows:
                    items = codes[r : r + k]
                    for n in range(int(k) - 1):
                        self.add(np.full(k - 1 - n, items[n]), items[n + 1 :])

    def write(self, slices: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        if len(self.keys):
            a, b = self.keys >> 31, self.keys & ((1 << 31) - 1)
            part = np.array([zlib.crc32(w.encode()) % slices for w in self.names], dtype=np.int64)
            order = np.lexsort((b, part[b], a))
            a, b, counts = a[order], b[order], self.counts[order]
            group = a * slices + part[b]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            names = pa.array(self.names, pa.string())
            offsets = pa.array(np.concatenate([first, [len(a)]]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(a[first])), pa.array((group[first] % slices).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(b))), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                ["item", "slice", "neighbours", "counts"],
            )
        self.__init__()


def stripes(records: DataFrame, cells: int = STRIPE_CELLS, slices: int = SLICES) -> DataFrame:
    """(item, slice, neighbours, counts) of ``records`` (items: sorted distinct ARRAY<STRING>), per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Stripes()
        for batch in batches:
            lists = batch.column(0).drop_null()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held.records(held.code(lists.flatten().to_pylist()), lengths)
            if len(held.keys) >= cells:
                yield from held.write(slices)
        yield from held.write(slices)

    return records.select("items").mapInArrow(run, SCHEMA)


class _Merge:
    """Stripes of one (item, slice) after another, added by neighbour."""

    def __init__(self) -> None:
        self.at: tuple[str, int] | None = None
        self.names: list[pa.Array] = []
        self.counts: list[pa.Array] = []
        self.n = 0
        self.done: list[tuple[str, pa.Array, pa.Array]] = []
        self.n_done = 0

    def add(self, at: tuple[str, int], names: pa.Array, counts: pa.Array) -> None:
        if at != self.at:
            self.close()
            self.at = at
        self.names.append(names)
        self.counts.append(counts)
        self.n += len(names)
        if self.n > STRIPE_CELLS:  # of many tasks: what is held stays as large as the merged stripe
            self.names, self.counts = ([x] for x in self.summed())
            self.n = len(self.names[0])

    def summed(self) -> tuple[pa.Array, pa.Array]:
        if len(self.names) == 1:
            return self.names[0], self.counts[0]
        codes = pa.concat_arrays(self.names).dictionary_encode()
        sums = np.zeros(len(codes.dictionary), dtype=np.int64)
        np.add.at(sums, codes.indices.to_numpy(), pa.concat_arrays(self.counts).to_numpy())
        return codes.dictionary, pa.array(sums)

    def close(self) -> None:
        if self.at is not None:
            names, counts = self.summed()
            self.done.append((self.at[0], names, counts))
            self.n_done += len(names)
        self.at, self.names, self.counts, self.n = None, [], [], 0

    def ready(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            items = pa.array([x for x, _, _ in self.done], pa.string())
            sizes = np.array([len(n) for _, n, _ in self.done])
            columns = [items.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.concat_arrays([n for _, n, _ in self.done]), pa.concat_arrays([c for _, _, c in self.done])]
            yield pa.RecordBatch.from_arrays(columns, ["item_a", "item_b", "n"])
        self.done, self.n_done = [], 0


def pair_counts(records: DataFrame, cells: int = STRIPE_CELLS, slices: int = SLICES) -> DataFrame:
    """(item_a, item_b, n): records that hold both, item_a <= item_b; item_a = item_b: records that hold the item.

    ``records``: items ARRAY<STRING>, one row per record; nulls and repeated items in a record don't count.
    """
    clean = records.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).where("size(items) > 0")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Merge()
        for batch in batches:
            names, counts = batch.column(2), batch.column(3)
            for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                held.add(at, names[i].values, counts[i].values)
            if held.n_done > PAIR_BLOCK // 10:
                yield from held.ready()
        held.close()
        yield from held.ready()

    sent = stripes(clean, cells, slices).repartition("item", "slice").sortWithinPartitions("item", "slice")
    return sent.mapInArrow(merge, "item_a string, item_b string, n bigint")


def log_likelihood(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two items' independence, from their 2x2 table."""
    h = lambda k: F.when(k > 0, k * F.log(k)).otherwise(F.lit(0.0))
    d = lambda c: c.cast("double")
    ab, a, b, rest = d(n_ab), d(n_a - n_ab), d(n_b - n_ab), d(n - n_a - n_b + n_ab)
    return F.lit(2.0) * (h(ab) + h(a) + h(b) + h(rest) + h(d(n)) - h(d(n_a)) - h(d(n_b)) - h(d(n - n_a)) - h(d(n - n_b)))


def together(records: DataFrame, least: int = 3, lift: int = 3, ratio: float = LEAST_RATIO, cells: int = STRIPE_CELLS, slices: int = SLICES) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr): pairs in at least ``least`` records, ``lift`` times as often as by chance, with a
    log-likelihood ratio of at least ``ratio`` (whichever way they differ from chance).

    n is the number of records with an item. ``lift`` is compared in exact arithmetic: n_ab * n >= lift * n_a * n_b. Empty
    input, and records of one item, give no pairs.
    """
    scratch = Scratch(records.sparkSession, "together")
    records, n = scratch.counted(records.select(F.array_compact("items").alias("items")).where("size(items) > 0"), "records")
    counts = scratch.write(pair_counts(records, cells, slices), "counts")
    single = counts.where("item_a = item_b")
    a, b = single.select("item_a", F.col("n").alias("n_a")), single.select("item_b", F.col("n").alias("n_b"))
    pairs = counts.where((F.col("item_a") < F.col("item_b")) & (F.col("n") >= least)).withColumnRenamed("n", "n_ab")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    found = pairs.join(a, "item_a").join(b, "item_b").withColumn("n", F.lit(n).cast("bigint"))
    found = found.where(big("n_ab") * big("n") >= F.lit(lift).cast("decimal(19,0)") * (big("n_a") * big("n_b")))
    times = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    llr = log_likelihood(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n"))
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", times.alias("lift"), llr.alias("llr")).where(F.col("llr") >= ratio)

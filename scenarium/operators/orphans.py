"""References to records that do not exist.

A Bloom filter over the parents' keys, built from the raw rows, proves most dangling references at the scan, before anything is
shuffled: a key the filter has not seen is certainly no parent. Only references the filter lets through are joined with
the parents, which also tells whether the target came after the reference or had been deleted before it. Repeated
deliveries are united afterwards, each part for itself.

The filter's size follows the number of parents' rows, up to a bound, so what is broadcast has a proven limit. Beyond the number of
keys that bound is good for it merely lets more references through to the join: results never depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenarium.functions.text import reference_key
from scenarium.storage import Scratch

#: Bits of the filter per row of the parents: 1% false positives.
BITS_A_KEY = 10
#: Bytes of a broadcast filter, at least and at most: 64 MiB are good for 54 million keys at 1%, and for 100 million at 10%.
LEAST_BYTES, MOST_BYTES = 1 << 14, 64 << 20
#: A filter is built in blocks of this many bytes, so that no task holds more than its own copy and one block of others.
BLOCK_BYTES = 1 << 18
HASHES = 5


def filter_bytes(keys: int) -> int:
    """The size of a filter for ``keys`` rows: a power of two within the bounds."""
    wanted = max(1, keys) * BITS_A_KEY / 8
    return min(MOST_BYTES, max(LEAST_BYTES, 1 << math.ceil(math.log2(wanted))))


@dataclass(frozen=True)
class Bloom:
    """Bits of a filter, for ``might_contain`` over arrays of 64-bit hashes."""

    bits: np.ndarray

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        return places(hashes, len(self.bits) * 8)

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self.places(hashes):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def places(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """The bit places of each hash: double hashing of its two halves."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) % np.uint64(n_bits)).astype(np.int64) for i in range(HASHES)]


def build_filter(keys: DataFrame, n_bytes: int) -> Bloom:
    """A filter over the one BIGINT column of ``keys`` (hashes; repeated ones and nulls do no harm).

    Each task fills a filter of its own and emits its non-empty blocks; blocks of the same place are united by OR in a
    tree of two levels. The driver receives ``n_bytes`` at most.
    """
    column, blocks = keys.columns[0], max(1, n_bytes // BLOCK_BYTES)
    n_bytes = blocks * BLOCK_BYTES if n_bytes >= BLOCK_BYTES else n_bytes
    step = n_bytes // blocks

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(0, dtype=bool)
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(h) and not len(flags):
                flags = np.zeros(n_bytes * 8, dtype=bool)
            for at in places(h, n_bytes * 8):
                flags[at] = True
        bits = np.packbits(flags, bitorder="little") if len(flags) else np.zeros(n_bytes, dtype=np.uint8)
        parts = [(k, bits[k * step : (k + 1) * step]) for k in range(blocks)]
        parts = [(k, b.tobytes()) for k, b in parts if b.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["block", "bits"]
        )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(b.as_buffer(), dtype=np.uint8)
                held[k] = held[k] | new if k in held else new.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["block", "bits"]
        )

    schema = "block int, bits binary"
    merged = keys.select(F.col(column).cast("bigint")).mapInArrow(fill, schema)
    merged = merged.repartition(blocks, "block").mapInArrow(unite, schema)
    bits = np.zeros(n_bytes, dtype=np.uint8)
    for row in merged.toLocalIterator():
        bits[row.block * step : (row.block + 1) * step] |= np.frombuffer(row.bits, dtype=np.uint8)
    return Bloom(bits)


def key_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def find_orphans(references: DataFrame, parents: DataFrame, n_bytes: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """References without a valid target.

    ``references``: scope BIGINT, key STRING (null or blank: no reference), arrived TIMESTAMP, and any other columns,
    which are carried along. ``parents``: scope BIGINT, key STRING, arrived, deleted TIMESTAMP (null: not deleted).
    Keys are compared within a scope, trimmed and in lower case. Returns the references' columns with ``status``:

    * ``missing``: no such target;
    * ``late``: the target's first delivery is after the reference;
    * ``deleted``: the target had been deleted when (or before) the reference arrived.

    Several parents of one key count as one, there from the first arrival until the last of them is deleted. A null
    ``arrived`` of a reference leaves only ``missing`` to find; of a parent, it counts as always there. Null scopes match
    nothing. Empty parents: all references are missing.

    ``keys``: columns that tell a reference from others. Deliveries with equal ones are one reference, which arrived with the
    first of them; the result then has ``keys``, arrived and status only. Without ``keys`` a reference may be repeated and gives as many rows.
    """
    spark = references.sparkSession
    targets = parents.select("scope", reference_key(F.col("key")).alias("__k"), "arrived", "deleted").where("__k is not null and scope is not null")
    bloom = build_filter(targets.select(key_hash("scope", "__k").alias("h")), n_bytes or filter_bytes(parents.count()))
    shared = spark.sparkContext.broadcast(bloom.bits)

    @F.pandas_udf("boolean")
    def maybe_known(h: pd.Series) -> pd.Series:
        return pd.Series(Bloom(shared.value).might_contain(h.to_numpy()))

    refs = references.withColumn("__k", reference_key(F.col("key"))).where("__k is not null")
    if keys is not None:
        refs = refs.select(*keys, "scope", "__k", "arrived")
    # Written once, at the scan: both parts are read from here, and the filter is asked once for each row.
    refs = Scratch(spark, "references").write(refs.withColumn("__maybe", maybe_known(key_hash("scope", "__k"))), "flagged")
    always, never = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    known = targets.groupBy("scope", "__k").agg(
        F.min(F.coalesce(F.col("arrived").cast("timestamp_ntz"), always)).alias("__from"),
        F.max(F.coalesce(F.col("deleted").cast("timestamp_ntz"), never)).alias("__until"),
    )
    definite, possible = refs.where("not __maybe"), refs.where("__maybe")
    if keys is not None:
        # A reference's deliveries have one scope and key, so all of them are in the same part.
        definite, possible = united(definite, keys), united(possible, keys)
    definite = definite.withColumn("status", F.lit("missing"))
    at = F.col("arrived").cast("timestamp_ntz")
    verified = (
        possible.join(known, ["scope", "__k"], "left")
        .withColumn(
            "status",
            F.when(F.col("__from").isNull(), "missing").when(F.col("__from") > at, "late").when(F.col("__until") <= at, "deleted"),
        )
        .where("status is not null")
    )
    keep = [*(references.columns if keys is None else [*keys, "arrived"]), "status"]
    return definite.select(keep).unionByName(verified.select(keep))


def united(refs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per reference: the first arrival. Partial aggregation runs before the shuffle; scope and key, the same in every
    delivery, are grouped by, too, so that only the time is aggregated, which needs no sort."""
    return refs.groupBy(*dict.fromkeys([*keys, "scope", "__k"])).agg(F.min("arrived").alias("arrived"))


def orphan_report(orphans: DataFrame, period: Column) -> DataFrame:
    """Orphans per table, field, period and status. ``orphans``: tbl, field, status and what ``period`` needs."""
    return orphans.groupBy("tbl", "field", F.coalesce(period, F.lit("unknown")).alias("period"), "status").agg(F.count(F.lit(1)).alias("n"))

"""A bitmap of fixed size over 64-bit hashes: a prefilter whose false hits cost rows and never change results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaloom.llm._shared import share_bits

#: 2**27 bits are 16 MB, whatever the input. Beyond some 10**8 entries it lets more rows through, none less.
BITS = 27
_SEGMENT = 20


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap may contain."""
    at = slots(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def shared_bitmap(hashes: DataFrame):
    """Broadcast bitmap of a table with one column of longs; segments are built by the executors."""
    slot = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - BITS)
    dealt = hashes.select(slot.alias("slot")).distinct().withColumn("segment", F.shiftright("slot", _SEGMENT)).repartition("segment")

    def run(batches):
        parts: dict = {}
        for batch in batches:
            slot, segment = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(segment):
                flags = parts.setdefault(int(k), np.zeros(1 << _SEGMENT, dtype=bool))
                flags[slot[segment == k] & ((1 << _SEGMENT) - 1)] = True
        for k, flags in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    width = 1 << (_SEGMENT - 3)
    for row in dealt.mapInArrow(run, "segment bigint, bits binary").toLocalIterator():
        bits[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return share_bits(hashes.sparkSession, bits)

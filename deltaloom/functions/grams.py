"""Byte grams that stand for a text in an index: whatever a text contains as a substring shares its window minima."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

#: Kinds of sought texts by their least length in bytes: (bytes, gram, window). Of each window of grams the least is kept.
KINDS = ((1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (8, 8, 1), (15, 8, 8), (71, 8, 64))
GRAMS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("gram", T.LongType())]))


def _minima_at(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """The least gram of the window that starts at each byte; grams up to 8 bytes are told apart exactly, in an order that looks random."""
    n = len(data) - gram + 1
    if n < window:
        return np.zeros(0, np.uint64)
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        packed |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):  # a bijection
        packed = (packed ^ (packed >> np.uint64(shift))) * np.uint64(factor)
    span = 1
    while span < window:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    return packed


def window_minima(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """The different least grams of all windows of a text."""
    return np.unique(_minima_at(data, gram, window)).view(np.int64)


@pandas_udf(GRAMS)
def _minima(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    def one(text, wanted):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        return [{"kind": int(k), "gram": int(g)} for k in wanted for g in window_minima(data, *KINDS[k][1:]).tolist()]

    return pd.Series([one(t, k) for t, k in zip(texts, kinds)])


def kind_of(text) -> Column:
    """Number of the kind of a sought text; null for an empty one."""
    size, out = F.octet_length(text), F.lit(None).cast("int")
    for k, (least, _, _) in enumerate(KINDS):
        out = F.when(size >= least, k).otherwise(out)
    return out


def minima(text, kinds: Column) -> Column:
    """Array of (kind, gram) of a text for each of the kinds."""
    return _minima(text, kinds)


#: Bytes of texts that are indexed at once; a longer text is taken alone.
STEP_BYTES = 1 << 20


def index_rows(rows: DataFrame, kinds: list[int], wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Rows (t_, gram_) of rows (t_, text_): the minima of each text for the kinds, only those in ``wanted`` (sorted, by kind) if it is given."""
    schema = T.StructType([rows.schema["t_"], T.StructField("gram_", T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("gram", T.LongType())]))])

    def run(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            first, ends = 0, np.cumsum([len(x) for x in column.to_pylist()])
            while first < len(column):
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right")))
                yield from indexed(batch.column(0).slice(first, last - first), column.slice(first, last - first).to_pylist())
                first = last

    def indexed(ids, texts):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.array([len(x) for x in texts])
        owner, stop = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
        for kind in kinds:
            _, gram, window = KINDS[kind]
            found = _minima_at(data, gram, window).view(np.int64)
            inside = np.arange(len(found)) + gram + window - 1 <= stop[: len(found)]  # windows within one text
            at = np.flatnonzero(inside & np.isin(found, wanted[kind]) if wanted is not None else inside)
            found, whose = found[at], owner[at]
            order = np.lexsort((found, whose))
            found, whose = found[order], whose[order]
            new = np.append(True, (found[1:] != found[:-1]) | (whose[1:] != whose[:-1]))[: len(found)]
            if len(found):
                found, whose = found[new], whose[new]
                both = pa.StructArray.from_arrays([pa.array(np.full(len(found), kind, dtype=np.int32)), pa.array(found)], names=["kind", "gram"])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), both], names=["t_", "gram_"])

    return rows.mapInArrow(run, schema)

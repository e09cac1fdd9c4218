"""Helpers that several operators share: Arrow buffers, word spans, hashes, tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one vectorised step looks at (a single longer document is still taken whole).
STEP_BYTES = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only the named columns (doc_id and text unless told otherwise)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, str]:
    """(what a text operator reads: the id, or with ``carry`` a struct of the whole row, and the text; the key's DDL)."""
    name = "row" if carry else id_col
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name) if carry else F.col(id_col)
    source = docs.select(key, F.col(text_col).cast("string").alias("text_"))
    return source, f"`{name}` {source.schema[0].dataType.simpleString()}"


def training_part(id_col, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def small_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 200_000) -> None:
    """Arrow batches bounded by bytes: few whole texts, for each Python worker holds a few batches, but many numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def share(spark: SparkSession, value):
    """Broadcast an object of bounded size as bytes that executors can read without this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def share_bits(spark: SparkSession, bits: np.ndarray):
    """Broadcast a bitmap; the driver, which never reads it, keeps no copy once it is written out."""
    shared = spark.sparkContext.broadcast(bits)
    if hasattr(shared, "_value"):
        del shared._value  # loaded again from its file if asked for
    return shared


def view_bits(shared) -> np.ndarray:
    return shared.value


def save_model(spark: SparkSession, model, path: str) -> None:
    """Keep a trained model (a field, a language model, a machine) in a folder that the driver can read again."""
    spark.createDataFrame([(bytearray(cloudpickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str):
    """A model of save_model, to be passed to the operator that would train one."""
    return cloudpickle.loads(bytes(spark.read.parquet(path).first().model))


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own, on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_out(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a table in the shared folder and read it again: later steps survive lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Let the driver notice which tables nothing refers to any more, so that their shuffle files go before the next large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what training in the driver has freed; allocators keep it otherwise, beside all that the driver does later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def text_chunks(column: pa.Array, step: int = STEP_BYTES):
    """Yield (first, last, data, bounds): documents first..last-1 as one uint8 array, bounds their offsets in it.

    Nulls count as empty texts. No text is ever split between chunks.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _FOLD[data]


def word_spans(data: np.ndarray, bounds: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+``: (starts, ends, words per document). Words never cross documents."""
    n = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    prev = np.empty(n + 1, dtype=bool)
    prev[0], prev[1:] = False, inside
    here = np.empty(n + 1, dtype=bool)
    here[:n], here[n] = inside, False
    starts = np.flatnonzero(here & (~prev | cut))
    ends = np.flatnonzero(prev & (~here | cut))
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of words that stand for the words: they have no algebra by which texts could be built to collide.

    Words of one length up to 8 bytes never collide (every step is a bijection of their bytes); longer ones get a
    cryptographic digest.
    """

    def __init__(self):
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        self.seeds = mix(np.arange(1, 10, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        size = ends - starts
        long, short = np.flatnonzero(size > 8), np.minimum(size, 8)
        out = mix((eight[starts] & self.masks[short]) ^ self.seeds[short])
        if len(long):
            text, digest = memoryview(data), hashlib.blake2b
            found = b"".join([digest(text[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())])
            out[long] = np.frombuffer(found, dtype="<u8")
        return out


class SpanHasher:
    """64-bit hashes of byte spans from one prefix sum, for features only: texts can be built to collide.

    The tables of powers are reused between chunks.
    """

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = powers(_MULT, n), powers(_INV, n)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=prefix[1:])
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

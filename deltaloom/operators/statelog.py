"""Keyed state as a log of deltas: a batch writes what it changed, and many deltas are compacted into one base."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.operators import incremental

#: Deltas beyond which the next write compacts, and buckets of keys in a delta.
MOST_DELTAS, BUCKETS = 16, 32


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    _, _, held = incremental._folder(spark, f"{folder}/log")
    return sorted(int(n) for n in held if n.isdigit())


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, content) of the newest manifest; number 0 and no segments where there is none."""
    numbers = _manifests(spark, folder)
    if not numbers:
        return 0, {"segments": [], "batch": None, "keys": []}
    text = spark.read.text(f"{folder}/log/{numbers[-1]}", wholetext=True).first()
    return numbers[-1], json.loads(text.value)


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Make ``content`` manifest ``number``; False if another writer has that number. The file appears whole, by one rename that replaces nothing."""
    path, fs, _ = incremental._folder(spark, f"{folder}/log")
    fs.mkdirs(path(f"{folder}/log"))
    made = f"{folder}/log/_tmp-{uuid.uuid4().hex}"
    stream = fs.create(path(made), False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if incremental.rename_new(spark, made, f"{folder}/log/{number}"):
        return True
    fs.delete(path(made), False)
    return False


def _segments(spark: SparkSession, folder: str, content: dict) -> DataFrame | None:
    out = None
    for segment in content["segments"]:
        rows = spark.read.schema(segment["schema"]).parquet(f"{folder}/data/{segment['name']}").withColumn("seq_", F.lit(segment["number"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "seq_", "bucket_")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq_").alias("last"))
    return latest.select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])


def read_log(spark: SparkSession, folder: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The latest row of every key; None if nothing was written. With ``buckets`` only those are read."""
    content = _manifest(spark, folder)[1]
    rows = _segments(spark, folder, content)
    if rows is None:
        return None
    return _latest(rows if buckets is None else rows.where(F.col("bucket_").isin(buckets)), content["keys"])


def _write(rows: DataFrame, folder: str, keys: list[str], number: int) -> dict:
    name = uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket_", bucket).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{folder}/data/{name}")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["bucket_ int"]
    return {"name": name, "number": number, "schema": ", ".join(types)}


def merge_batch(now: DataFrame, folder: str, keys: list[str], batch: int | None = None) -> int:
    """Merge a batch (keys and values, one row a key) into the log and return the number of its manifest.

    Rows whose values changed are written with version one higher, new keys with version 1, unchanged keys not at all: what is
    written grows with the batch. A ``batch`` number that the log has seen changes nothing. Whoever loses the race for a manifest number
    merges again onto the winner's state. After MOST_DELTAS deltas the same commit replaces them by one base; folders that
    no manifest names any more are deleted when they are incremental.STALE_HOURS old, so readers can finish.
    """
    spark = now.sparkSession
    while True:
        number, content = _manifest(spark, folder)
        if batch is not None and content["batch"] is not None and batch <= content["batch"]:
            return number
        touched = [row[0] for row in now.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
        state = read_log(spark, folder, touched)
        state = now.limit(0).withColumn("version", F.lit(0)) if state is None else state.join(now.select(keys), keys, "left_semi")
        fresh = incremental.update_state(state, now, keys).join(state.select(*keys, "version"), [*keys, "version"], "left_anti")
        segments = [*content["segments"], _write(fresh, folder, keys, number + 1)]
        if len(segments) > MOST_DELTAS:
            rows = _segments(spark, folder, {"segments": segments})
            segments = [_write(_latest(rows, keys), folder, keys, number + 1)]
        if commit(spark, folder, number + 1, {"segments": segments, "batch": batch if batch is not None else content["batch"], "keys": keys}):
            _sweep(spark, folder, {s["name"] for s in segments})
            return number + 1


def _sweep(spark: SparkSession, folder: str, live: set[str]) -> None:
    for below, kept in (("data", live), ("log", {str(n) for n in _manifests(spark, folder)[-1:]})):
        path, fs, held = incremental._folder(spark, f"{folder}/{below}")
        for name, age in held.items():
            if name not in kept and age > incremental.STALE_HOURS:
                fs.delete(path(f"{folder}/{below}/{name}"), True)

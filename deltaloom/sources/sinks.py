"""Writers: change lists, reports, templates and plans as JSON, CSV or Parquet that appear whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.operators.incremental import _folder, rename_new

#: Characters of old and new text that a change list shows.
PREVIEW = 200


def preview(changes: DataFrame, old: str = "old_body", new: str = "new_body", most: int = PREVIEW) -> DataFrame:
    """Change rows with the first characters of both texts in place of the texts."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, most)
    return changes.withColumn("old_preview", cut(old)).withColumn("new_preview", cut(new)).drop(old, new)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back what a writer killed between its two renames had moved aside; True if something was put back. Every writer does so first."""
    path = path.rstrip("/")
    folder, _, name = path.rpartition("/")
    of, fs, held = _folder(spark, folder or ".")
    aside = sorted((age, n) for n, age in held.items() if n.startswith(f"{name}._old-"))
    return bool(aside) and name not in held and rename_new(spark, f"{folder}/{aside[0][1]}" if folder else aside[0][1], path)


def _replace(df: DataFrame, path: str, write) -> None:
    """Write to a folder beside ``path`` and put it in its place when it is whole; the old one stays as ``.bak``.

    A job that fails leaves the old files as they were. The old folder is moved aside, the new one into its place, and both renames are
    checked: if the second fails the old one goes back. A writer killed between them leaves both folders whole under other names, and
    ``recover`` or the next writer puts the old one back.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    mark = uuid.uuid4().hex
    made, aside, bak = f"{path}._tmp-{mark}", f"{path}._old-{mark}", f"{path}.bak"
    of, fs, _ = _folder(spark, path)
    try:
        write(df.write, made)
    except Exception:
        fs.delete(of(made), True)
        raise
    had = fs.exists(of(path))
    if had and not rename_new(spark, path, aside):
        raise OSError(f"{path} could not be moved aside")
    if not rename_new(spark, made, path):
        if had:
            rename_new(spark, aside, path)
        fs.delete(of(made), True)
        raise OSError(f"another writer has put files at {path}")
    if had:
        fs.delete(of(bak), True)
        rename_new(spark, aside, bak)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    _replace(df, path, lambda writer, to: writer.json(to))


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    _replace(df, path, lambda writer, to: writer.partitionBy(*partitions).parquet(to))


def write_csv(df: DataFrame, path: str) -> None:
    _replace(df, path, lambda writer, to: writer.option("header", True).csv(to))


def ticket_template(spark: SparkSession, count: int, prefix: str = "") -> DataFrame:
    """An empty ledger of ``count`` numbered tickets."""
    from deltaloom.operators.tickets import ticket_number

    return spark.range(1, count + 1).select(F.col("id").cast("int").alias("seq"), F.lit("").alias("title"), ticket_number(F.lit(prefix), "id").alias("ticket_no"))


def plan_report(items: DataFrame) -> DataFrame:
    """A plan as lines of a markdown list, manual items first."""
    rank = F.when(F.col("status") == "manual", 0).when(F.col("status") == "review", 1).otherwise(2)
    line = F.concat(F.lit("- "), "status", F.lit(" "), "action", F.lit(" "), F.coalesce("function_name", F.lit("")), F.lit(": "), "reason")
    return items.select(rank.alias("rank"), line.alias("line")).orderBy("rank", "line")


def merge_batches(*parts: DataFrame) -> DataFrame:
    """Batches one after another with their number, in the order given."""
    out = parts[0].withColumn("batch", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("batch", F.lit(k)))
    return out


def write_versioned(df: DataFrame, folder: str) -> str:
    """A new version beside the earlier ones, which stay as back-up."""
    from deltaloom.operators.incremental import write_state

    return write_state(df, folder)

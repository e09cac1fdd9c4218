"""Fingerprint state: what changed since the last run, what depends on it, and what need not be done again."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions import text
from deltaloom.operators.changes import ADDED, DELETED, MODIFIED


def file_fingerprints(files: DataFrame) -> DataFrame:
    """Files (path, mtime, size, content) with a content hash of 16 hex digits."""
    return files.select("path", "mtime", "size", text.short_hash(F.col("content").cast("string")).alias("content_hash"))


def function_fingerprints(functions: DataFrame) -> DataFrame:
    """Functions (path, name, signature, body) with the hashes of both texts; keyed by path and name."""
    return functions.select("path", "name", text.short_hash("signature").alias("signature_hash"), text.short_hash("body").alias("body_hash"))


def statement_fingerprints(functions: DataFrame) -> DataFrame:
    """Rows (path, name, line, hash of 8 digits) of a body's lines, without blank lines, comments and lone braces."""
    lines = functions.select("path", "name", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\r|\n")).alias("pos", "raw"), F.coalesce("line_start", F.lit(0)).alias("start"))
    lines = lines.withColumn("code", F.trim("raw")).where("code <> '' and not startswith(code, '//') and not startswith(code, '/*') and code not in ('{', '}')")
    return lines.select("path", "name", (F.col("start") + F.col("pos")).alias("line"), text.short_hash("code", 8).alias("hash"))


def detect(previous: DataFrame, current: DataFrame, keys: list[str], values: list[str], keep_same: bool = True) -> DataFrame:
    """Keys with change added, deleted, modified or same, by null-safe equality of the value columns."""
    a = previous.select(*keys, F.struct(*values).alias("before"))
    b = current.select(*keys, F.struct(*values).alias("now"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("before").isNull(), ADDED).when(F.col("now").isNull(), DELETED).when(F.col("before").eqNullSafe(F.col("now")), "same").otherwise(MODIFIED)
    out = both.select(*keys, kind.alias("change"))
    return out if keep_same else out.where("change <> 'same'")


def statement_changes(previous: DataFrame, current: DataFrame, by_line: bool = True) -> DataFrame:
    """Changed statements of each function: by line number, or by how often each statement hash occurs."""
    if by_line:
        return detect(previous, current, ["path", "name", "line"], ["hash"], keep_same=False)
    count = lambda df: df.groupBy("path", "name", "hash").agg(F.count("*").alias("n"))
    return detect(count(previous), count(current), ["path", "name", "hash"], ["n"], keep_same=False)


def tasks(previous: DataFrame, current: DataFrame, with_signature: bool = True) -> DataFrame:
    """Functions to generate anew or skip; without ``with_signature`` a changed signature alone does not count."""
    values = ["body_hash", "signature_hash"] if with_signature else ["body_hash"]
    found = detect(previous, current, ["path", "name"], values).where("change <> 'deleted'")
    return found.select("path", "name", F.when(F.col("change") == "same", "skip").otherwise("generate").alias("action"))


def dependents(changed: DataFrame, edges: DataFrame, name: str = "name") -> DataFrame:
    """Callers of changed functions that did not change themselves."""
    callers = edges.join(changed.select(F.col(name).alias("callee")).distinct(), "callee", "left_semi").select(F.col("caller").alias(name)).distinct()
    return callers.join(changed.select(name), name, "left_anti")


def merge_lines(cached: DataFrame, fresh: DataFrame, changed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lines (keys, line, logic): cached ones, with fresh ones at changed lines; a line that is gone stays away."""
    keys = [*(keys or ["name"]), "line"]
    gone = changed.where("change = 'deleted'").select(keys)
    touched = changed.where("change <> 'deleted'").select(keys)
    kept = cached.join(gone, keys, "left_anti").join(touched, keys, "left_anti").select(*keys, "logic", F.lit("cached").alias("origin"))
    return kept.unionByName(fresh.join(touched, keys, "left_semi").select(*keys, "logic", F.lit("fresh").alias("origin")))


def constraints(terms: DataFrame, usage: DataFrame, files: int = 2) -> DataFrame:
    """The names to keep for global symbols: those locked, or used in ``files`` files or more."""
    spread = usage.groupBy("symbol").agg(F.count_distinct("path").alias("n_files"))
    both = terms.join(spread, "symbol", "left")
    return both.where(F.col("locked") | (F.coalesce("n_files", F.lit(0)) >= files)).select("symbol", "cn", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def apply_constraints(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (symbol, cn) with constrained symbols' names put in place."""
    both = rows.join(rules.select("symbol", F.col("cn").alias("fixed")), "symbol", "left")
    return both.select("symbol", F.coalesce("fixed", "cn").alias("cn"), F.coalesce(F.col("fixed") != F.col("cn"), F.lit(False)).alias("changed"))


def update_state(state: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """The next state: current rows, and none that are gone; version counts how often a key changed."""
    values = [c for c in current.columns if c not in keys]
    both = current.alias("c").join(state.select(*keys, F.struct(*values).alias("before"), "version"), keys, "left")
    same = F.col("before").eqNullSafe(F.struct(*[F.col(f"c.{v}").alias(v) for v in values]))
    return both.select(*keys, *[F.col(f"c.{v}").alias(v) for v in values], F.when(F.col("before").isNull(), 1).when(same, F.col("version")).otherwise(F.col("version") + 1).cast("int").alias("version"))


#: Hours after which what an interrupted write left behind is deleted.
STALE_HOURS = 24


def _folder(spark, folder: str):
    """(path factory, file system, names below ``folder`` with their age in hours)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = jvm.java.lang.System.currentTimeMillis()
    held = {s.getPath().getName(): (now - s.getModificationTime()) / 3_600_000 for s in fs.listStatus(path(folder))} if fs.exists(path(folder)) else {}
    return path, fs, held


def rename_new(spark, made: str, target: str) -> bool:
    """Move a finished file or folder to a name that nobody has; False if it exists, also if another writer made it meanwhile."""
    jvm = spark.sparkContext._jvm
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    path, fs, _ = _folder(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(path(target)).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(path(made)), fs.makeQualified(path(target)), never)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.toString():
            return False
        raise
    return True


def _versions(names) -> list[int]:
    return [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]


def write_state(state: DataFrame, folder: str) -> str:
    """Write a new version of the state beside the old ones and return its path; readers take the largest number.

    A version appears by one rename, so an interrupted write leaves only a folder that no reader looks at, and later writes
    delete it when it is STALE_HOURS old. The rename replaces and enters nothing that exists: if another writer took the number
    meanwhile, the next one is taken.
    """
    path, fs, held = _folder(state.sparkSession, folder)
    fs.mkdirs(path(folder))
    for name, age in held.items():
        if name.startswith("_tmp-") and age > STALE_HOURS:
            fs.delete(path(f"{folder}/{name}"), True)
    made = f"{folder}/_tmp-{uuid.uuid4().hex}"
    state.write.parquet(made)
    while True:
        target = f"{folder}/v={max(_versions(_folder(state.sparkSession, folder)[2]), default=0) + 1}"
        if rename_new(state.sparkSession, made, target):
            return target


def read_state(spark, folder: str) -> DataFrame | None:
    """The latest version written by write_state, or the state of a log that statelog.merge_batch wrote; None if there is none."""
    names = _folder(spark, folder)[2]
    if "log" in names:
        from deltaloom.operators import statelog

        return statelog.read_log(spark, folder)
    done = _versions(names)
    return spark.read.parquet(f"{folder}/v={max(done)}") if done else None


def needs_refresh(policy: str, newest_source: float, built: float | None) -> bool:
    """Whether an index is built anew: always, off, or auto (a source is newer than it)."""
    if policy not in ("always", "off", "auto"):
        raise ValueError(f"unknown policy: {policy}")
    return policy == "always" or (policy == "auto" and (built is None or newest_source > built))


def resume_point(done: DataFrame, order: list[str]) -> DataFrame:
    """The last finished row in order: one row, none if nothing is done."""
    return done.orderBy(*[F.desc(c) for c in order]).limit(1)


def effective_ordinals(lines: DataFrame, usable: Column, keys: list[str], ord_col: str = "line") -> DataFrame:
    """Usable lines with their running number from 0 in each key."""
    return lines.where(usable).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(ord_col)) - 1)

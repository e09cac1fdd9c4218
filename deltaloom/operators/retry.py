"""Bounded rounds of attempts: each key keeps its best candidate and leaves when it is good, stalls or runs out of rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from deltaloom.plans.session import materialise

#: Fixed value: rounds of attempts.
ROUNDS = 3


def retry_rounds(tasks: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], rounds: int = ROUNDS, baseline: DataFrame | None = None) -> DataFrame:
    """(key, candidate, score, defects, round, reason): what each task ends with.

    ``attempt(open tasks, round)`` returns (key, candidate, score, defects), one row a key; a key it leaves out counts as not improved.
    Fewer defects are better, then a higher score. A key leaves accepted once its best has no defects, stalled after a round that
    did not improve on it, exhausted after the last round; those that end with defects take their row of ``baseline`` (key, candidate), if it has
    one. Only open keys are attempted again, and each round is a written table. Keys must be unique; nulls are never attempted.
    """
    columns = [key, "candidate", "score", "defects", "round"]
    open_, best, done = tasks.where(F.col(key).isNotNull()), None, None
    for n in range(1, rounds + 1):
        tried = attempt(open_, n).select(key, F.struct(F.col("candidate").alias("candidate"), F.col("score").cast("double").alias("score"), F.col("defects").cast("long").alias("defects"), F.lit(n).alias("round")).alias("new"))
        both = open_.select(key).join(tried, key, "left")
        both = both.withColumn("old", F.lit(None).cast(both.schema["new"].dataType)) if best is None else both.join(best, key, "left")
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.defects") < F.col("old.defects")) | ((F.col("new.defects") == F.col("old.defects")) & (F.col("new.score") > F.col("old.score"))))
        now = both.select(key, F.when(better, F.col("new")).otherwise(F.col("old")).alias("old"), better.alias("better"))
        reason = F.when(F.col("old.defects") == 0, "accepted").when(~F.col("better"), "stalled").when(F.lit(n == rounds), "exhausted")
        now = materialise(now.select(key, "old", reason.alias("reason")), "round")
        left = now.where("reason IS NOT NULL")
        done = left if done is None else done.unionByName(left)
        best = now.where("reason IS NULL").select(key, "old")
        open_ = tasks.join(best.select(key), key, "left_semi")
        if best.isEmpty():
            break
    out = done.select(key, "old.candidate", "old.score", "old.defects", "old.round", "reason")
    if baseline is None:
        return out.select(*columns, "reason")
    kept = out.join(baseline.select(key, F.col("candidate").alias("base_")), key, "left")
    falls = F.col("base_").isNotNull() & ((F.col("defects") > 0) | F.col("defects").isNull())
    return kept.select(key, F.when(falls, F.col("base_")).otherwise(F.col("candidate")).alias("candidate"), "score", "defects", "round", F.when(falls, "baseline").otherwise(F.col("reason")).alias("reason"))

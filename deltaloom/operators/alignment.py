"""Alignment of sequences too long for one array: anchors first, edit scripts only between them."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from deltaloom.functions import similarity
from deltaloom.operators.ordering import number_rows, running_sum
from deltaloom.plans.session import materialise

#: Elements on both sides of a stretch, multiplied, up to which it is aligned as two arrays.
STRETCH_CELLS = 4_000_000


def _heaviest(runs: pd.DataFrame) -> list[bool]:
    """Which runs (in old order; at: place in the new order, n: elements) form the heaviest chain that rises in both orders."""
    ends, weights, best, back = [], [], [], []
    for k, (at, n) in enumerate(zip(runs["at"].tolist(), runs["n"].tolist())):
        where = bisect_left(ends, at)
        before = weights[where - 1] if where else (0, -1)
        total = (before[0] + n, k)
        best.append(total[0])
        back.append(before[1])
        if where < len(ends) and ends[where] == at:
            if weights[where][0] >= total[0]:
                continue
            weights[where] = total
        else:
            ends.insert(where, at)
            weights.insert(where, total)
        stop = where + 1
        while stop < len(ends) and weights[stop][0] <= total[0]:
            stop += 1
        del ends[where + 1 : stop], weights[where + 1 : stop]
    kept, at = [False] * len(best), weights[-1][1] if weights else -1
    while at >= 0:
        kept[at] = True
        at = back[at]
    return kept


def _anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(seq, stretch, i, j): values that both sides of a stretch hold once, as many as rise together."""
    keys = ["seq", "stretch"]
    once = lambda rows, name: rows.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("at").alias(name)).where("n = 1").drop("n")
    both = once(old, "i").join(once(new, "j"), [*keys, "value"]).drop("value")
    placed = number_rows(both, [F.col(c) for c in (*keys, "j")], "place")  # over all sequences: only steps of one matter
    ranged = materialise(placed.repartitionByRange(*keys, "i").withColumn("part_", F.spark_partition_id()), "ranged")
    by_i = Window.partitionBy("part_", *keys).orderBy("i")  # a run that goes on in the next range of rows is two that follow each other
    fresh = F.when(F.col("place") - F.lag("place").over(by_i) == 1, 0).otherwise(1)
    run = F.shiftleft(F.col("part_").cast("long"), 40) + F.sum("fresh").over(by_i)
    ranked = materialise(ranged.withColumn("fresh", fresh).withColumn("run", run).drop("fresh", "part_"), "anchors")
    runs = ranked.groupBy(*keys, "run").agg(F.min("place").alias("at"), F.count("*").alias("n"))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("run")
        return group.loc[_heaviest(group), [*keys, "run"]]

    seq = ranked.schema["seq"].dataType.simpleString()
    kept = runs.groupBy(*keys).applyInPandas(chain, f"seq {seq}, stretch bigint, run bigint")
    return ranked.join(kept, [*keys, "run"]).select(*keys, "i", "j")


def _between(rows: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """Rows that are no anchor, their stretch split by the anchors before them; numbers of stretches stay unique in a sequence."""
    marks = anchors.select("seq", "stretch", F.col(name).alias("at"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("mark"))
    every = rows.withColumn("mark", F.lit(0)).join(marks.select("seq", "at"), ["seq", "at"], "left_anti").select("seq", "stretch", "at", "value", "mark").unionByName(marks)
    return running_sum(every, [F.col("seq"), F.col("at")], "mark", "passed").where("mark = 0").select("seq", F.struct("stretch", "passed").alias("where"), "at", "value")


def align(old: DataFrame, new: DataFrame, seq: str, ord_col: str, value: str) -> DataFrame:
    """(seq, tag, old_ord, new_ord): equal, delete or insert for every element of two versions of each sequence.

    Values that occur once on both sides anchor the alignment: neighbours that stay neighbours collapse to runs, and the
    heaviest chain of runs that rises on both sides is kept (one task holds a sequence's runs: as many as it has moves and the table ranges of rows, not elements).
    Positions and stretches are numbered over ranges of rows, so no task sorts a whole sequence.
    Stretches between anchors are treated alike until no value is unique in them on both sides. Elements equal at
    the ends of what is left are paired in order; the rest is aligned as two arrays, up to STRETCH_CELLS, and beyond that deleted and
    inserted (a valid script, though not a least one). Nulls are values like others; ``ord_col`` must be unique in a sequence.
    """
    null = F.lit("\0null")
    sides = []
    for rows in (old, new):
        told = rows.select(F.col(seq).alias("seq"), F.col(ord_col).alias("ord"), F.coalesce(F.col(value).cast("string"), null).alias("value"))
        sides.append(materialise(number_rows(told, [F.col("seq"), F.col("ord")], "at"), "sequence"))
    whole = [side.select("seq", F.lit(0).cast("long").alias("stretch"), "at", "value") for side in sides]
    pairs, open_ = None, whole
    while True:
        found = materialise(_anchors(*open_), "anchors")
        if pairs is not None and found.isEmpty():
            break
        pairs = found.select("seq", "i", "j") if pairs is None else pairs.unionByName(found.select("seq", "i", "j"))
        split = [_between(rows, found, name) for rows, name in zip(open_, ("i", "j"))]
        names = split[0].select("seq", "where").distinct().intersect(split[1].select("seq", "where").distinct())
        numbered = materialise(number_rows(names, [F.col("seq"), F.col("where")], "stretch"), "stretches")
        open_ = [materialise(rows.join(numbered, ["seq", "where"]).select("seq", "stretch", "at", "value"), "stretch") for rows in split]
        if numbered.isEmpty():
            break
    pairs = materialise(pairs.unionByName(_ends(*open_)), "pairs")
    rest = [rows.join(pairs.select("seq", F.col(name).alias("at")), ["seq", "at"], "left_anti") for rows, name in zip(open_, ("i", "j"))]
    pairs = pairs.unionByName(_arrays(*rest))
    a, b = (side.select("seq", F.col("at").alias(name), F.col("ord").alias(f"{label}_ord")) for side, name, label in zip(sides, ("i", "j"), ("old", "new")))
    equal = pairs.join(a, ["seq", "i"]).join(b, ["seq", "j"])
    gone, come = a.join(pairs, ["seq", "i"], "left_anti"), b.join(pairs, ["seq", "j"], "left_anti")
    blank = lambda side, name: F.lit(None).cast(side.schema["ord"].dataType).alias(name)
    out = equal.select("seq", F.lit("equal").alias("tag"), "old_ord", "new_ord")
    out = out.unionByName(gone.select("seq", F.lit("delete").alias("tag"), "old_ord", blank(sides[1], "new_ord"))).unionByName(come.select("seq", F.lit("insert").alias("tag"), blank(sides[0], "old_ord"), "new_ord"))
    return out.withColumnRenamed("seq", seq)


def _ends(old: DataFrame, new: DataFrame) -> DataFrame:
    """(seq, i, j) of the equal elements at the beginning of each stretch, then of those at the end of what is left of it."""
    keys, found = ["seq", "stretch"], None
    for falling in (False, True):
        order = Window.partitionBy(*keys).orderBy(F.desc("at") if falling else F.asc("at"))
        place = [rows.withColumn("k", F.row_number().over(order)) for rows in (old, new)]
        met = place[0].select(*keys, "k", F.col("at").alias("i"), F.col("value").alias("x")).join(place[1].select(*keys, "k", F.col("at").alias("j"), F.col("value").alias("y")), [*keys, "k"])
        differs = F.max(F.when(F.col("x") != F.col("y"), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        same = materialise(met.withColumn("differs", differs).where("differs = 0").select("seq", "i", "j"), "ends")
        found = same if found is None else found.unionByName(same)
        old, new = (rows.join(same.select("seq", F.col(name).alias("at")), ["seq", "at"], "left_anti") for rows, name in ((old, "i"), (new, "j")))
    return found


def _arrays(old: DataFrame, new: DataFrame) -> DataFrame:
    """(seq, i, j) from the edit scripts of stretches that fit two arrays."""
    keys = ["seq", "stretch"]
    sizes = [rows.groupBy(*keys).agg(F.count("*").alias(name)) for rows, name in ((old, "m"), (new, "n"))]
    fit = materialise(sizes[0].join(sizes[1], keys).where(F.col("m") * F.col("n") <= STRETCH_CELLS).select(keys), "stretches")
    gather = lambda rows, name: rows.join(fit, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias(name))
    both = gather(old, "a").join(gather(new, "b"), keys)
    script = both.withColumn("op", F.explode(F.filter(similarity.opcodes_udf(F.col("a.value"), F.col("b.value")), lambda o: o["tag"] == "equal")))
    step = script.select("seq", "a", "b", "op", F.explode(F.sequence(F.lit(0), F.col("op.i2") - F.col("op.i1") - 1)).alias("k"))
    return step.select("seq", F.get("a.at", F.col("op.i1") + F.col("k")).alias("i"), F.get("b.at", F.col("op.j1") + F.col("k")).alias("j"))

"""Quality: evidence summaries, scores, issue rows, structural gates, best candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions import text


def step_summary(steps: DataFrame, group: str, kind: str = "kind", confidence: str = "confidence") -> DataFrame:
    """Per group: kinds histogram (sorted entries), unknown ratio and mean confidence, three places."""
    per_kind = steps.groupBy(group, kind).agg(F.count("*").alias("n"), F.sum(confidence).alias("c"))
    entries = F.array_sort(F.collect_list(F.struct(kind, "n")))
    out = per_kind.groupBy(group).agg(entries.alias("kinds"), F.sum("n").alias("steps"), F.sum(F.when(F.col(kind) == "unknown", F.col("n")).otherwise(0)).alias("unknown"), F.sum("c").alias("c"))
    return out.select(group, "kinds", "steps", F.round(F.col("unknown") / F.col("steps"), 3).alias("unknown_ratio"), F.round(F.col("c") / F.col("steps"), 3).alias("avg_confidence"))


def score(steps: Column, unknown: Column, empty_else: Column, variables: Column, low: Column, expressions: Column, fallback: Column, has_comment: Column, degraded: Column) -> Column:
    """Evidence score 0-100, one place: what is unknown, empty, uncertain, unparsed or missing costs points."""
    share = lambda part, whole, points: F.when(whole > 0, points * part / whole).otherwise(0.0)
    raw = 100 - share(unknown, steps, 30) - 2 * empty_else - share(low, variables, 20) - share(fallback, expressions, 15) - F.when(has_comment, 0).otherwise(10) - F.when(degraded, 5).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 1)))


def flags(**tests: Column) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def issues(rows: DataFrame, key: str, counters: dict[str, str], most: int = 32) -> DataFrame:
    """Counters above zero as issue rows (key, code, message), deduplicated, the first ``most`` of each key by code."""
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.concat(F.lit(label + ": "), F.col(code).cast("string")).alias("message"), F.col(code).cast("long").alias("n")) for code, label in counters.items()])
    long = rows.select(key, F.inline(each)).where("n > 0").dropDuplicates([key, "code", "message"])
    order = Window.partitionBy(key).orderBy("code", "message")
    return long.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(key, "code", "message")


def best_candidate(rows: DataFrame, key: str, defects: str, score_col: str, candidate: str) -> DataFrame:
    """The candidate with the fewest structural defects, then the highest score, then the least name."""
    order = Window.partitionBy(key).orderBy(defects, F.desc(score_col), candidate)
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def preference(structural: Column, unknown: Column, low: Column) -> Column:
    """Penalty of a candidate: structural defects outweigh everything else."""
    return structural * 1000 + unknown * 10 + low


def inspect_lines(lines: DataFrame, body: str = "text") -> DataFrame:
    """Issue codes of each line: unbalanced brackets, raw code left over, blank placeholders, doubled words."""
    raw = F.coalesce(body, F.lit(""))
    found = flags(
        unbalanced=~text.opening_balance(body),
        code_left=raw.rlike(r"->|;\s*$|==|&&|\|\|"),
        placeholder=raw.rlike(r"\?\?\?|TODO|TBD|待人工"),
        doubled=raw.rlike(r"(?i)\b([a-z]{3,})\s+\1\b"),
    )
    return lines.withColumn("codes", found)


def needs_rewrite(bad_lines: Column, votes: list[Column], least: int = 2) -> Column:
    """A text is written anew with any bad line or ``least`` votes."""
    total = sum((F.coalesce(v.cast("int"), F.lit(0)) for v in votes), F.lit(0))
    return (bad_lines > 0) | (total >= least)


def evidence_kinds(*tests: Column) -> Column:
    """How many kinds of evidence a symbol has."""
    return sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))


def progress(items: DataFrame, done: Column) -> DataFrame:
    """One row: how many items there are, how many are done, and their share in percent (100 of none)."""
    sums = items.agg(F.count("*").alias("total"), F.count_if(done).alias("done"))
    return sums.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("done") / F.col("total"), 1)).otherwise(100.0))


def evidence_rows(comments: DataFrame, variables: DataFrame, expressions: DataFrame, steps: DataFrame) -> DataFrame:
    """Evidence of functions as rows (key, kind, item, confidence) of four collectors.

    ``comments``: (key, text); ``variables``: (key, name, meaning, is_param): a parameter counts 0.8 with a meaning and 0.3 without, a
    local one 0.7 and 0.2; ``expressions``: (key, text, parsed); ``steps``: (key, kind, text, confidence).
    """
    told = F.trim(F.coalesce("meaning", F.lit(""))) != ""
    weight = F.when(F.col("is_param"), F.when(told, 0.8).otherwise(0.3)).otherwise(F.when(told, 0.7).otherwise(0.2))
    rows = comments.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("key", F.lit("comment").alias("kind"), F.trim("text").alias("item"), F.lit(1.0).alias("confidence"))
    rows = rows.unionByName(variables.select("key", F.lit("variable").alias("kind"), F.col("name").alias("item"), weight.alias("confidence")))
    rows = rows.unionByName(expressions.select("key", F.lit("expression").alias("kind"), F.col("text").alias("item"), F.when(F.col("parsed"), 1.0).otherwise(0.0).alias("confidence")))
    return rows.unionByName(steps.select("key", F.concat(F.lit("step:"), "kind").alias("kind"), F.col("text").alias("item"), "confidence"))


def status_summary(items: DataFrame, status: str = "status") -> DataFrame:
    return items.groupBy(status).agg(F.count("*").alias("n"))


def resolution_summary(names: DataFrame, low: float = 0.6) -> DataFrame:
    """Names by source: how many, locked, and of low confidence."""
    return names.groupBy("source").agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"), F.count_if(F.col("confidence") < low).alias("low"))


def validate_candidates(suggestions: DataFrame, known: DataFrame, locked: DataFrame) -> DataFrame:
    """Issues of suggested names (item, ident, cn): invented identifiers and overridden locked names; accepted per item."""
    invented = suggestions.join(known.select("ident").distinct(), "ident", "left_anti").select("item", "ident", F.lit("invented_symbol").alias("code"))
    clash = suggestions.join(locked.select("ident", F.col("cn").alias("fixed")), "ident").where("cn <> fixed").select("item", "ident", F.lit("locked_override").alias("code"))
    bad = invented.unionByName(clash)
    items = suggestions.select("item").distinct()
    return items.join(bad.groupBy("item").agg(F.array_sort(F.collect_set(F.concat_ws(":", "code", "ident"))).alias("issues")), "item", "left").select("item", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), F.col("issues").isNull().alias("accepted"))

"""Human decisions and patches: stale checks, upserts that keep people's fields, line rules, text audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def decisions_on(bundle: DataFrame, decisions: DataFrame, key: str = "key") -> DataFrame:
    """Decisions (key, source_hash, decision) against the bundle (key, hash): applied, stale or unknown."""
    both = decisions.join(bundle.select(key, F.col("hash").alias("now")), key, "left")
    state = F.when(F.col("now").isNull(), "unknown").when(F.col("now") != F.col("source_hash"), "stale").otherwise("applied")
    return both.select(key, "decision", state.alias("state"))


def merge_workspace(existing: DataFrame, current: DataFrame, key: str, content: list[str], human: list[str]) -> DataFrame:
    """Current rows with people's fields of existing ones; approved rows keep their content too."""
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in [*content, *human]], F.lit(True).alias("was"))
    both = current.select(key, *content).join(old, key, "left")
    approved = F.coalesce(F.col("was"), F.lit(False)) & F.coalesce(F.col("old_status") == "approved", F.lit(False)) if "status" in human else F.lit(False)
    return both.select(key, *[F.when(approved, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in content], *[F.col(f"old_{c}").alias(c) for c in human])


def patches_for(rows: DataFrame, patches: DataFrame, keys: list[Column]) -> DataFrame:
    """Patches (pkey, ord, field, value) of each row's keys, general first; the last value of a field wins.

    ``rows`` needs an ``id``; ``keys`` go from general to specific. Returns (id, field, value).
    """
    levels = F.array(*[F.struct(F.lit(k).alias("level"), key.alias("pkey")) for k, key in enumerate(keys)])
    asked = rows.select("id", F.inline(levels))
    order = Window.partitionBy("id", "field").orderBy(F.desc("level"), F.desc("ord"))
    return asked.join(patches, "pkey").withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "field", "value")


def rule_matches(index: Column, line: Column, rule: Column) -> Column:
    """A line rule's test: its given ones of index, line (whole), contains and regex all hold; at least one is given."""
    given = F.coalesce(rule["index"].cast("string"), rule["line"], rule["contains"], rule["regex"]).isNotNull()
    fits = (rule["index"].isNull() | (rule["index"] == index)) & (rule["line"].isNull() | (rule["line"] == line))
    fits &= (rule["contains"].isNull() | line.contains(F.coalesce(rule["contains"], F.lit("")))) & (rule["regex"].isNull() | F.regexp_like(line, F.coalesce(rule["regex"], F.lit(""))))
    return given & fits


def revise_lines(lines: DataFrame, rules: DataFrame, key: str = "doc", ord_col: str = "ord", body: str = "text") -> DataFrame:
    """Apply rules (key, rule_ord, action, index, line, contains, regex, value) to lines.

    ``replace`` and ``delete`` act on the lines that fit, the first rule that fits counts; ``prepend`` and ``append``
    add a line to the document. Lines are numbered anew.
    """
    edits = rules.where(F.col("action").isin("replace", "delete"))
    rule = F.struct("index", "line", "contains", "regex")
    met = lines.join(edits.select(key, "rule_ord", "action", "value", rule.alias("rule")), key, "left")
    hit = F.when(rule_matches(F.col(ord_col), F.col(body), F.col("rule")), F.struct("rule_ord", "action", "value"))
    best = met.groupBy(key, ord_col, body).agg(F.min(hit).alias("hit"))
    kept = best.where(F.col("hit").isNull() | (F.col("hit.action") != "delete")).select(key, F.lit(1).alias("part"), F.col(ord_col).cast("long").alias("o"), F.when(F.col("hit").isNotNull(), F.col("hit.value")).otherwise(F.col(body)).alias(body))
    ends = rules.where(F.col("action").isin("prepend", "append")).select(key, F.when(F.col("action") == "prepend", 0).otherwise(2).alias("part"), F.col("rule_ord").cast("long").alias("o"), F.col("value").alias(body))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("part", "o")) - 1
    return kept.unionByName(ends).withColumn(ord_col, nth).select(key, ord_col, body)


def audit(texts: DataFrame, wanted: DataFrame, key: str = "doc", body: str = "text") -> DataFrame:
    """Issues of texts against (key, must boolean, phrase): a phrase that is missing, or there and must not be."""
    met = texts.join(wanted, key)
    there = F.coalesce(F.col(body), F.lit("")).contains(F.col("phrase"))
    return met.where(there != F.col("must")).select(key, "phrase", F.when(F.col("must"), "missing").otherwise("forbidden").alias("issue"))


def bundle_hash(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """One digest for each group over its keys and values in key order."""
    ordered = F.array_sort(F.collect_list(F.concat_ws("=", key, F.coalesce(value, F.lit("")))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


def user_blocks(code: Column) -> Column:
    """Protected blocks of generated code as name -> body."""
    pattern = r"(?s)/\* USER CODE BEGIN (\w+) \*/(.*?)/\* USER CODE END \1 \*/"
    return F.map_from_arrays(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), F.regexp_extract_all(code, F.lit(pattern), F.lit(2)))


def approved_rules(decisions: DataFrame, key: str = "key") -> DataFrame:
    """Line rules of approved decisions (key, status, line, value): each replaces its line."""
    good = decisions.where("status = 'approved'")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    null = F.lit(None)
    return good.select(F.col(key).alias("doc"), nth.alias("rule_ord"), F.lit("replace").alias("action"), null.cast("long").alias("index"), "line", null.cast("string").alias("contains"), null.cast("string").alias("regex"), "value")

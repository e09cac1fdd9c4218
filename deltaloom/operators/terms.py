"""Terminology: consistency of translations, repairs, ranked upserts, retrieval and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions import text
from deltaloom.operators.ordering import number_rows
from deltaloom.plans.session import materialise

#: Trust in where a term comes from.
SOURCE_RANK = {
    "manual_locked": 100,
    "manual": 95,
    "symbol_dict": 92,
    "comment_prebuild": 84,
    "comment_rule": 76,
    "symbol_memory": 68,
    "ai": 64,
    "rule_guess": 42,
    "unknown": 0,
}


def source_rank(source) -> Column:
    name = F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("unknown"))
    ranks = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    return F.coalesce(ranks[name], F.when(name.startswith("ai"), SOURCE_RANK["ai"]), F.lit(0))


def mappings(*sources: DataFrame) -> DataFrame:
    """One table (symbol, variant, place) of several; blank symbols and variants are left out."""
    rows = sources[0].select("symbol", "variant", "place")
    for more in sources[1:]:
        rows = rows.unionByName(more.select("symbol", "variant", "place"))
    return rows.select(F.trim("symbol").alias("symbol"), F.trim("variant").alias("variant"), "place").where("symbol <> '' and variant <> ''")


def consistency(rows: DataFrame, ignored: list[str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """One row for each symbol: variants, whether they agree, severity, suggestion, whether the dictionary disagrees.

    Variants agree if one is left after the ``ignored`` parts are taken out. The suggestion is the dictionary's
    (symbol, expected), else the longest variant (ties: the least) that is not marked for manual work.
    """
    plain = F.col("variant")
    for part in ignored or []:
        plain = F.replace(plain, F.lit(part), F.lit(""))
    seen = rows.withColumn("plain", F.trim(plain)).groupBy("symbol").agg(F.array_sort(F.collect_set("variant")).alias("variants"), F.count_distinct("plain").alias("n_plain"), F.count("*").alias("n_places"))
    seen = seen.withColumn("consistent", (F.size("variants") <= 1) | (F.col("n_plain") <= 1))
    typed = F.col("symbol").rlike(f"({'|'.join(text.TYPE_SUFFIXES)})$")
    close = (F.size("variants") == 2) & (F.get("variants", F.lit(0)).contains(F.get("variants", F.lit(1))) | F.get("variants", F.lit(1)).contains(F.get("variants", F.lit(0))))
    broad = F.col("symbol").startswith("g_") | ~F.col("symbol").rlike("^[lvp]_")
    severity = F.when(typed & close, "low").when(typed, "medium").when(broad, "high").otherwise("medium")
    valid = F.filter("variants", lambda v: ~v.startswith("待人工"))
    longest = F.array_min(F.transform(valid, lambda v: F.struct((-F.length(v)).alias("l"), v.alias("v"))))["v"]
    seen = seen.withColumn("severity", F.when(~F.col("consistent"), severity))
    if dictionary is not None:
        seen = seen.join(dictionary.select("symbol", "expected"), "symbol", "left")
    else:
        seen = seen.withColumn("expected", F.lit(None).cast("string"))
    seen = seen.withColumn("suggestion", F.when(~F.col("consistent"), F.coalesce("expected", longest, F.get("variants", F.lit(0)))))
    clash = ~F.col("consistent") & F.col("expected").isNotNull() & ~F.array_contains("variants", F.col("expected"))
    return seen.withColumn("dictionary_conflict", F.coalesce(clash, F.lit(False)))


def consistency_score(report: DataFrame) -> DataFrame:
    """Totals and the share of consistent symbols in percent (100 without symbols)."""
    return report.agg(F.count("*").alias("total"), F.count_if("consistent").alias("consistent")).withColumn("score", F.when(F.col("total") > 0, 100.0 * F.col("consistent") / F.col("total")).otherwise(100.0))


def repair_hints(report: DataFrame) -> DataFrame:
    """Rows (symbol, current, suggested, action, severity): renames, and alignments with the dictionary."""
    bad = report.where(~F.col("consistent")).select("*", F.explode("variants").alias("current"))
    rename = bad.where(F.col("current") != F.col("suggestion")).select("symbol", "current", F.col("suggestion").alias("suggested"), F.lit("rename").alias("action"), "severity")
    align = bad.where("dictionary_conflict").select("symbol", "current", F.col("expected").alias("suggested"), F.lit("align_with_dict").alias("action"), F.lit("high").alias("severity"))
    return rename.unionByName(align)


def repair_patch(hints: DataFrame, severities: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    """One replacement for each symbol: the dictionary's over a rename's, then the least."""
    kept = hints.where(F.lower(F.coalesce("severity", F.lit("medium"))).isin(*severities) & (F.trim("symbol") != "") & (F.trim("suggested") != ""))
    order = Window.partitionBy("symbol").orderBy(F.when(F.col("action") == "align_with_dict", 0).otherwise(1), "suggested")
    return kept.withColumn("r", F.row_number().over(order)).where("r = 1").select("symbol", "suggested", "action")


def apply_patch(terms: DataFrame, patch: DataFrame) -> DataFrame:
    """Terms (symbol, variant) with patched symbols' variants replaced, and whether each changed."""
    both = terms.join(patch.select("symbol", "suggested"), "symbol", "left")
    return both.select("symbol", F.coalesce("suggested", "variant").alias("variant"), (F.col("suggested").isNotNull() & (F.col("suggested") != F.col("variant"))).alias("changed"))


def dominant(rows: DataFrame) -> DataFrame:
    """The most frequent variant of each symbol; ties go to the one met first (least ``ord``)."""
    counted = rows.groupBy("symbol", "variant").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    order = Window.partitionBy("symbol").orderBy(F.desc("n"), "first", "variant")
    return counted.withColumn("r", F.row_number().over(order)).where("r = 1").select("symbol", "variant", "n")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge term records (ident, cn, source, confidence, locked) by trust.

    A locked record keeps its name; otherwise the higher (rank, confidence) wins and an equal newcomer replaces. The loser's
    name becomes a candidate, and an alias if the newcomer loses with rank 80 or more or the old name loses.
    """
    side = lambda df, p: df.where((F.trim("ident") != "") & (F.trim("cn") != "")).select("ident", *[F.col(c).alias(f"{p}_{c}") for c in ("cn", "source", "confidence", "locked")], source_rank("source").alias(f"{p}_rank"))
    both = side(current, "o").join(side(incoming, "n"), "ident", "full_outer")
    old, new = F.col("o_cn").isNotNull(), F.col("n_cn").isNotNull()
    differs = F.col("o_cn") != F.col("n_cn")
    outranked = (F.col("o_rank") > F.col("n_rank")) | ((F.col("o_rank") == F.col("n_rank")) & (F.col("o_confidence") > F.col("n_confidence")))
    locked = F.coalesce(F.col("o_locked"), F.lit(False))
    keeps = F.when(~new, True).when(~old, False).otherwise((locked | (differs & outranked)))
    action = F.when(~new, "kept").when(~old, "inserted").when(locked & ~differs, "kept").when(keeps, "kept_candidate").otherwise("replaced")
    both = both.withColumn("keeps", keeps).withColumn("differs", F.coalesce(old & new & differs, F.lit(False)))
    pick = lambda c: F.when(F.col("keeps"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    confidence = F.when(F.col("keeps"), F.col("o_confidence")).when(old & new & ~differs, F.greatest("o_confidence", "n_confidence")).otherwise(F.col("n_confidence"))
    return both.select(
        "ident",
        pick("cn").alias("cn"),
        pick("source").alias("source"),
        pick("rank").alias("source_rank"),
        confidence.alias("confidence"),
        (locked | F.coalesce(F.col("n_locked"), F.lit(False))).alias("locked"),
        F.when(F.col("differs") & F.col("keeps"), F.col("n_cn")).alias("candidate"),
        F.when(F.col("differs") & ~F.col("keeps"), F.col("o_cn")).when(F.col("differs") & F.col("keeps") & ~locked & (F.col("n_rank") >= 80), F.col("n_cn")).alias("alias"),
        action.alias("action"),
    )


#: Postings of one (feature, value) beyond which it is hot: it is read for surviving candidates only, where bounds allow that.
HOT_POSTINGS = 10_000


def _feature_scores(shared: DataFrame, weight: Column) -> DataFrame:
    by_feature = shared.groupBy("query_id", "item_id", "feature").agg(F.count("*").alias("n"))
    return by_feature.withColumn("points", F.coalesce(weight, F.lit(0)) + F.least(F.lit(2), F.col("n") - 1))


def retrieval_candidates(queries: DataFrame, items: DataFrame, weights: dict[str, int], most: int = 6, hot: int = HOT_POSTINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates (query_id, item_id), queries that must read hot postings whole (query_id), distinct item features), written tables.

    Hot values can add at most a known bound to an item of a query. Items found by other values have scores from those; if the
    ``most``-th of them beats the bound, no item that only hot values share can come in, and of those found only the ones within
    the bound of the ``most``-th survive.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("feature")]
    asked, held = materialise(queries.distinct(), "asked"), materialise(items.distinct(), "held")
    postings = held.groupBy("feature", "value").agg((F.count("*") > hot).alias("hot"))
    asked = materialise(asked.join(postings, ["feature", "value"]), "asked")  # values that no item has add nothing
    bound = asked.where("hot").groupBy("query_id", "feature").agg(F.count("*").alias("h"))
    bound = bound.groupBy("query_id").agg(F.sum(F.greatest(F.lit(0), F.coalesce(weight, F.lit(0)) + F.least(F.lit(2), F.col("h")))).alias("most_more"))
    rare = asked.where("NOT hot").select("query_id", "feature", "value").join(held, ["feature", "value"])
    partial = materialise(_feature_scores(rare, weight).groupBy("query_id", "item_id").agg(F.sum("points").alias("so_far")), "partial")
    order = Window.partitionBy("query_id").orderBy(F.desc("so_far"), "item_id")
    last = partial.withColumn("r", F.row_number().over(order)).where(F.col("r") == most).select("query_id", F.col("so_far").alias("bar"))
    limits = materialise(asked.select("query_id").distinct().join(bound, "query_id", "left").join(last, "query_id", "left").select("query_id", F.coalesce("most_more", F.lit(0)).alias("most_more"), "bar"), "limits")
    whole = limits.where("most_more > 0 AND (bar IS NULL OR bar <= most_more)").select("query_id")
    kept = partial.join(limits, "query_id").where("bar IS NULL OR so_far + most_more >= bar").join(whole, "query_id", "left_anti").select("query_id", "item_id")
    return materialise(kept, "candidates"), whole, held


def retrieve(queries: DataFrame, items: DataFrame, weights: dict[str, int], most: int = 6, hot: int = HOT_POSTINGS) -> DataFrame:
    """Top ``most`` items for each query by weighted shared features.

    ``queries``/``items``: rows (query_id / item_id, feature, value). Each shared distinct (feature, value) adds the
    feature's weight (0 or more); further shared values of a feature add 1 each, at most 2 more. The features meet in an equi-join on the
    inverted index; values with more than ``hot`` postings only meet candidates that can still come in, which are joined on
    the item. Queries whose bounds do not allow that read all their postings. Ties go to the smaller item.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("feature")]
    kept, whole, held = retrieval_candidates(queries, items, weights, most, hot)
    asked = queries.distinct()
    near = kept.join(held, "item_id").join(asked, ["query_id", "feature", "value"]).select("query_id", "item_id", "feature", "value")
    far = asked.join(whole, "query_id", "left_semi").join(held, ["feature", "value"]).select("query_id", "item_id", "feature", "value")
    scored = _feature_scores(near.unionByName(far), weight).groupBy("query_id", "item_id").agg(F.sum("points").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def resolve_names(idents: DataFrame, *ladder: tuple[DataFrame, str, float]) -> DataFrame:
    """The first name of a ladder of (rows (ident, cn), source, confidence) tables; the identifier itself at confidence 0.2."""
    rows = None
    for rank, (table, source, confidence) in enumerate(ladder):
        step = table.where(F.trim("cn") != "").groupBy("ident").agg(F.min("cn").alias("cn")).select("ident", "cn", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rank"))
        rows = step if rows is None else rows.unionByName(step)
    best = rows.groupBy("ident").agg(F.min_by(F.struct("cn", "source", "confidence"), "rank").alias("best"))
    both = idents.select("ident").distinct().join(best, "ident", "left")
    return both.select("ident", F.coalesce("best.cn", "ident").alias("display"), F.coalesce("best.source", F.lit("raw")).alias("source"), F.coalesce("best.confidence", F.lit(0.2)).alias("confidence"))


def admit(memory: DataFrame, incoming: DataFrame, least: float = 0.72, kinds: int = 2) -> DataFrame:
    """Symbol memory after admission: rows (ident, cn, confidence, n_kinds) that reach both bars; the higher confidence stays."""
    good = incoming.where((F.col("confidence") >= least) & (F.col("n_kinds") >= kinds))
    order = Window.partitionBy("ident").orderBy(F.desc("confidence"), F.col("old").desc(), "cn")
    both = memory.withColumn("old", F.lit(True)).unionByName(good.withColumn("old", F.lit(False)))
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "old")


def concept_confidence(n: Column, same_module: Column, local_hits: Column, same_family: Column) -> Column:
    """Confidence of a concept from counts of its evidence, 0.38 to 0.98, three places."""
    total = 0.38 + F.least(F.lit(0.18), 0.04 * n) + F.least(F.lit(0.18), 0.06 * same_module) + F.least(F.lit(0.10), 0.05 * local_hits) + F.least(F.lit(0.10), 0.04 * same_family)
    return F.round(F.least(F.lit(0.98), total), 3)


def scoped_concepts(evidence: DataFrame, asks: DataFrame, scopes: tuple[str, ...] = ("file", "module", "family"), least: int = 1) -> DataFrame:
    """(ask, token, concept, level, support, n_evidence, confidence): what a token means where it is asked, from the nearest scope that tells.

    ``evidence``: (token, text, one column for each scope, nearest first, each within the next); ``asks``: (ask, token, the same columns).
    All scopes are counted in one pass over grouping sets. The nearest scope with ``least`` rows of evidence decides, else
    the whole table; there the most frequent text wins (ties: the longest, then the least). ``level`` is the scope's number. Null scopes are no
    scope, null and empty texts no evidence; asks without any evidence are not returned.
    """
    known = evidence.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("token", F.trim("text").alias("text"), *scopes)
    sets = [["token", "text", s] for s in scopes] + [["token", "text"]]
    level = F.lit(len(scopes))
    for k, s in reversed(list(enumerate(scopes))):
        level = F.when(F.grouping(s) == 0, k).otherwise(level)
    counted = known.groupingSets(sets, "token", "text", *scopes).agg(F.count("*").alias("n"), level.alias("level"), *[F.grouping(s).alias(f"g_{s}") for s in scopes])
    place = F.when(F.col("level") == len(scopes), F.lit("")).otherwise(F.coalesce(*[F.when(F.col(f"g_{s}") == 0, F.col(s).cast("string")) for s in scopes]))
    counted = counted.withColumn("place", place).where("place IS NOT NULL")
    rank = F.struct(-F.col("n"), -F.length("text"), F.col("text"))
    told = counted.groupBy("token", "level", "place").agg(F.sum("n").alias("support"), F.min_by("text", rank).alias("concept"))
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.col(s).cast("string").alias("place")) for k, s in enumerate(scopes)], F.struct(F.lit(len(scopes)).alias("level"), F.lit("").alias("place")))
    met = asks.select("ask", "token", F.explode(places).alias("p")).select("ask", "token", "p.level", "p.place").join(told, ["token", "level", "place"])
    at = lambda k: F.coalesce(F.max(F.when(F.col("level") == k, F.col("support"))), F.lit(0))
    good = (F.col("support") >= least) | (F.col("level") == len(scopes))
    best = met.groupBy("ask", "token").agg(F.min_by(F.struct("concept", "level", "support"), F.when(good, F.col("level"))).alias("best"), *[at(k).alias(f"s{k}") for k in range(len(scopes) + 1)])
    inner = [F.col("s0"), *[F.greatest(F.lit(0), F.col(f"s{k}") - F.col(f"s{k - 1}")) for k in range(1, len(scopes))]] + [F.lit(0)] * 3
    total = F.col(f"s{len(scopes)}")
    return best.select("ask", "token", "best.concept", "best.level", "best.support", total.alias("n_evidence"), concept_confidence(total, inner[1], inner[0], inner[2]).alias("confidence"))


def batches(symbols: DataFrame, column: str, size: int = 50) -> DataFrame:
    """Symbols in batches of ``size`` in order of their first token and name."""
    prefix = F.lower(F.regexp_extract(column, r"^([A-Za-z0-9]+)", 1))
    ranked = number_rows(symbols.select(column).distinct(), [prefix, F.col(column)], "n", 0)
    return ranked.select(column, F.floor(F.col("n") / size).cast("long").alias("batch"))

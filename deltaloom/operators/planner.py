"""Update plans: which documents a code change touches, and what may be done without a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deltaloom.functions import similarity, text
from deltaloom.operators.assign import greedy
from deltaloom.operators.graph import reach
from deltaloom.operators.ordering import block_join
from deltaloom.plans.session import materialise

#: Bars of a rename and of an alignment.
RENAME_SCORE, RENAME_LENGTH = 0.78, 20
SURE, LIKELY = 0.98, 0.92
#: Changed symbols that are broadcast.
FEW_WORDS = 100_000
#: Words of declarations that never carry an impact.
DECLARATION_WORDS = "const extern static struct typedef union enum unsigned signed volatile void char short int long float double return include define ifdef ifndef endif pragma true false null".split()


def align(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Document entries (entry_id, func_name, prototype) against code functions (name, rel_path, signature).

    matched_high needs exactly one function of that name; the confidence tells whether signatures agree too.
    """
    code = functions.groupBy("name").agg(F.count("*").alias("n"), F.min("rel_path").alias("rel_path"), F.min("signature").alias("signature"))
    both = entries.withColumn("func_name", F.trim(F.coalesce("func_name", F.lit("")))).join(code, F.col("func_name") == F.col("name"), "left")
    fold = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s;]+", "")
    status = F.when(F.col("func_name") == "", "no_doc_function").when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched_high")
    same = (fold("prototype") != "") & (fold("prototype") == fold("signature"))
    one = F.col("status") == "matched_high"
    both = both.withColumn("status", status)
    return both.select("entry_id", "func_name", "status", F.coalesce("n", F.lit(0)).alias("candidates"), F.when(one, F.col("rel_path")).alias("rel_path"), F.when(one & same, SURE).when(one, LIKELY).otherwise(0.0).alias("confidence"))


def override(alignment: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual alignments (entry_id, rel_path) take the place of found ones, and add unseen entries."""
    both = alignment.join(manual.select("entry_id", F.col("rel_path").alias("manual_path")), "entry_id", "full_outer")
    set_ = F.col("manual_path").isNotNull()
    return both.select("entry_id", "func_name", F.when(set_, "manual").otherwise(F.col("status")).alias("status"), F.coalesce("manual_path", "rel_path").alias("rel_path"), F.when(set_, 1.0).otherwise(F.col("confidence")).alias("confidence"))


def _core(body: Column, *names: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    for name in names:
        plain = F.when(F.coalesce(name, F.lit("")) != "", F.regexp_replace(plain, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")), F.lit("__FUNC__"))).otherwise(plain)
    return F.regexp_replace(plain, r"\s+", "")


def renames(deleted: DataFrame, added: DataFrame, least: float = RENAME_SCORE) -> DataFrame:
    """Deleted and added functions (idx, rel_path, name, body) of one file that are one function renamed.

    Bodies are compared without comments, blanks and both names; pairs are taken by falling (score, deleted, added).
    """
    a = deleted.select("rel_path", F.col("idx").alias("old_idx"), F.col("name").alias("old_name"), F.col("body").alias("old_body"))
    b = added.select("rel_path", F.col("idx").alias("new_idx"), F.col("name").alias("new_name"), F.col("body").alias("new_body"))
    met = a.join(b.hint("merge"), "rel_path").withColumn("x", _core(F.col("old_body"), F.col("old_name"), F.col("new_name"))).withColumn("y", _core(F.col("new_body"), F.col("old_name"), F.col("new_name")))
    met = met.where((F.length("x") >= RENAME_LENGTH) & (F.length("y") >= RENAME_LENGTH) & (similarity.length_bound(F.col("x"), F.col("y")) >= least))
    scored = met.withColumn("score", similarity.ratio(F.col("x"), F.col("y"), junk=True)).where(F.col("score") >= least)
    kept = greedy(scored.select("rel_path", "old_idx", "new_idx", "old_name", "new_name", "score"), "old_idx", "new_idx", "score", descending_ids=True)
    return kept.withColumn("score", F.round("score", 4))


def changed_symbols(old: Column, new: Column) -> Column:
    """Identifiers on one side only, without short ones and words of declarations."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))
    either = F.array_union(F.array_except(words(old), words(new)), F.array_except(words(new), words(old)))
    sized = r"(?i)^(?:u?int|uint|float|double|bool)\d*(?:_t)?$"
    return F.array_sort(F.filter(either, lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(*DECLARATION_WORDS) & ~s.rlike(sized)))


def header_impact(headers: DataFrame, includes: DataFrame, functions: DataFrame, direct: DataFrame) -> DataFrame:
    """Functions of files that reach a changed header by includes and use one of its changed symbols.

    ``headers``: (header, symbols); ``includes``: (rel_path, header); ``functions``: (rel_path, name, tokens);
    ``direct``: (rel_path, name) changed themselves. Returns (rel_path, name, headers).
    """
    edges = includes.select(F.col("header").alias("source"), F.col("rel_path").alias("target"))
    is_header = F.lower("target").rlike(r"\.(h|hpp)$")
    closure = reach(headers.select(F.col("header").alias("node")), edges.where(is_header)).select(F.col("root").alias("changed"), F.col("node").alias("header"))
    touched = closure.join(includes.hint("merge"), "header").select("changed", "rel_path").distinct()
    symbols = materialise(headers.select(F.col("header").alias("changed"), F.explode("symbols").alias("symbol")).where("symbol IS NOT NULL").distinct(), "symbols")
    words = symbols.select("symbol").distinct()
    words = F.broadcast(words) if words.count() <= FEW_WORDS else words.hint("merge")
    # only the changed symbols of a function are shuffled, not all its tokens
    used = functions.select("rel_path", "name", F.explode(F.array_distinct("tokens")).alias("symbol")).join(words, "symbol")
    using = touched.join(used.hint("merge"), "rel_path").join(symbols, ["changed", "symbol"])
    kept = using.join(direct.select("rel_path", "name").distinct(), ["rel_path", "name"], "left_anti")
    return kept.groupBy("rel_path", "name").agg(F.array_sort(F.collect_set("changed")).alias("headers"))


def classify(changes: DataFrame, index: DataFrame) -> DataFrame:
    """Plan items of changes (idx, change_kind, rel_path, function_name) by how many entries (name, entry_id) match.

    A modified function with one entry is safe; new, renamed and deleted ones are for review; the rest is manual.
    """
    known = index.groupBy(F.col("name").alias("function_name")).agg(F.count("*").alias("n"), F.min("entry_id").alias("entry_id"))
    both = changes.join(known, "function_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind, n = F.col("change_kind"), F.col("n")
    status = F.when((kind == "modified_function") & (n == 1), "safe").when(kind.isin("new_function", "deleted_function", "renamed_function") & (n <= 1) & ~((kind == "deleted_function") & (n == 0)), "review").when((kind == "renamed_function"), "review").otherwise("manual")
    how = F.when(kind == "header_changed", "header changes may affect many functions").when(n == 1, "one entry matches").when(n > 1, "several entries match").otherwise("no entry matches")
    return both.select("idx", kind.alias("action"), status.alias("status"), "rel_path", "function_name", F.when(n == 1, F.col("entry_id")).alias("entry_id"), how.alias("reason"))


def merge_impacts(items: DataFrame) -> DataFrame:
    """One item for each (rel_path, function_name, entry_id): headers united; manual outweighs review."""
    return items.groupBy("rel_path", "function_name", "entry_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("headers")))).alias("headers"), F.when(F.bool_or(F.col("status") == "manual"), "manual").otherwise("review").alias("status"))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (idx, decision) to plan items: skip, manual, or an edit; safe items are applied, applied ones stay."""
    both = items.join(decisions.select("idx", "decision"), "idx", "left")
    d, s = F.col("decision"), F.col("status")
    after = F.when(s == "applied", "applied").when(d == "skip", "skipped_review").when(d == "manual", "manual_review").when(d.isin("delete", "replace", "insert"), "applied_review").when(s == "safe", "applied").otherwise(s)
    return both.withColumn("status", after).drop("decision")


def match_decisions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions (decision_id, action, rel_path, function_name; null: any) that fit exactly one item, with its idx."""
    fits = lambda c: F.col(f"d.{c}").isNull() | (F.col(f"d.{c}") == F.col(f"i.{c}"))
    met = block_join(items.alias("i"), decisions.alias("d"), "decision_id", fits("action") & fits("rel_path") & fits("function_name"))
    counted = met.groupBy(F.col("d.decision_id").alias("decision_id")).agg(F.count("*").alias("n"), F.min("i.idx").alias("idx"))
    return counted.where("n = 1").select("decision_id", "idx")


def pick_name(prefer: str = "any") -> Column:
    """A change's function name: the preferred side first, blanks passed over."""
    order = {"any": ("function_name", "new_function_name", "old_function_name"), "new": ("new_function_name", "function_name", "old_function_name"), "old": ("old_function_name", "function_name", "new_function_name")}[prefer]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in order], F.lit(""))

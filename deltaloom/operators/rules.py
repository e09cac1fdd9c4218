"""Rules as tables: forward chaining over facts to a fixed point, ordered rule lists, and the elements of simple C statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deltaloom.plans.session import materialise

#: Relations of comparison operators, as they are and with the sides swapped.
RELATIONS = {"==": ("equals", "equals"), "!=": ("not_equals", "not_equals"), "<": ("less_than", "greater_than"), "<=": ("less_equal", "greater_equal"), ">": ("greater_than", "less_than"), ">=": ("greater_equal", "less_equal")}
#: What returned names stand for.
RETURNS = {
    "null": "NULL null",
    "true": "TRUE true",
    "false": "FALSE false",
    "success": "E_OK STATUS_OK OK RET_OK SUCCESS",
    "failure": "E_FAIL E_NOT_OK STATUS_FAIL FAIL RET_FAIL FAILURE",
    "error": "STATUS_ERROR ERROR RET_ERR RET_ERROR",
    "busy": "E_BUSY",
    "bad_parameter": "E_PARAM",
    "invalid": "E_INVALID",
    "timeout": "E_TIMEOUT",
    "passed": "PASS",
}
#: Rules up to this number are broadcast, and joined by shuffle beyond it.
BROADCAST_RULES = 10_000
CONDITION = r"^\s*([^<>=!&|]+?)\s*(==|!=|<=|>=|<|>)\s*([^<>=!&|]+?)\s*;?\s*$"
MEMSET = r"^\s*memset\s*\(\s*(?:\([^)]*\)\s*)?&?\s*([^,()]+?)\s*,\s*([^,()]+?)\s*,"
MEMCPY = r"^\s*(?:memcpy|memmove)\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*,"
ASSIGN = r"^\s*([^=<>!]*[^=<>!+*/%&|^\s-])\s*=\s*([^=]+?)\s*;?\s*$"
RETURN = r"^\s*return\b\s*([A-Za-z_0-9]*)\s*;?\s*$"
ZERO, CONSTANT = r"^(0[UuLl]*|0x0[UuLl]*)$", r"^([0-9][0-9A-Za-z]*|[A-Z_][A-Z0-9_]*)$"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, list[tuple[str, str]]]]) -> DataFrame:
    """Rows (rule, n, at, property, value, to_property, to_value), one for each condition, of rules (property, value, conditions).

    A condition without a value holds for any.
    """
    rows = [(k, len(conditions), at, p, v, to_property, to_value) for k, (to_property, to_value, conditions) in enumerate(rules) for at, (p, v) in enumerate(conditions)]
    return spark.createDataFrame(rows, "rule int, n int, at int, property string, value string, to_property string, to_value string")


def forward_chain(facts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """All facts (key, property, value) that rules of ``rule_table``'s shape derive from the given ones, those included.

    Only new facts meet the rules in a round. Which conditions of which rules a key has met is kept, so a rule fires in the round
    that meets its last condition, whatever rounds met the others; each round is a written table. Rounds end when nothing is new, at
    the latest after as many as there are rules. Null facts match nothing; an empty table gives an empty one.
    """
    columns = [key, "property", "value"]
    small = F.broadcast if rules.count() <= BROADCAST_RULES else (lambda rows: rows)
    fresh = seen = materialise(facts.select(columns).where("property IS NOT NULL").distinct(), "facts")
    conditions = rules.select("rule", "n", "at", "property", F.col("value").alias("wanted"))
    heads, met = rules.select("rule", F.col("to_property").alias("property"), F.col("to_value").alias("value")).distinct(), None
    while not fresh.isEmpty():
        hits = fresh.join(small(conditions), "property").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("value"))).select(key, "rule", "n", "at").distinct()
        now = materialise(hits if met is None else hits.join(met, [key, "rule", "at"], "left_anti").select(key, "rule", "n", "at"), "met")
        met = now if met is None else met.unionByName(now)
        fired = met.join(now.select(key, "rule").distinct(), [key, "rule"], "left_semi").groupBy(key, "rule", "n").agg(F.count("*").alias("held")).where("held = n")
        made = fired.join(small(heads), "rule").select(columns).distinct()
        fresh = materialise(made.join(seen, columns, "left_anti"), "facts")
        seen = seen.unionByName(fresh)
    return seen


def first_match(rows: DataFrame, key: str, words: Column, rules: DataFrame) -> DataFrame:
    """(key, label, priority): the label of the first rule that holds, for rows with an array of words.

    ``rules``: (priority, place, word, label); ``place`` is any, first or last. All rules are tried in one join on the word, so the
    plan does not grow with them, and the least priority wins (ties: the least label). Rows that no rule fits are not returned.
    """
    each = rows.select(F.col(key), F.size(words).alias("n_"), F.posexplode(words).alias("at_", "word"))
    fits = (F.col("place") == "any") | ((F.col("place") == "first") & (F.col("at_") == 0)) | ((F.col("place") == "last") & (F.col("at_") == F.col("n_") - 1))
    small = F.broadcast if rules.count() <= BROADCAST_RULES else (lambda rows: rows)
    best = each.join(small(rules), "word").where(fits).groupBy(key).agg(F.min(F.struct("priority", "label")).alias("best"))
    return best.select(key, "best.label", "best.priority")


def element_rules() -> list[tuple[str, str, list[tuple[str, str]]]]:
    """Rules from the facts of ``statement_facts`` to elements; later ones build on what earlier ones derive."""
    rules = [("relation", swapped if flag == "yes" else plain, [("op", op), ("swapped", flag)]) for op, (plain, swapped) in RELATIONS.items() for flag in ("yes", "no")]
    rules += [("action", "clear", [("call", "fill"), ("zero", "yes")]), ("action", "fill", [("call", "fill"), ("zero", "no")]), ("action", "copy", [("call", "copy")])]
    rules += [("action", "clear", [("call", "assign"), ("zero", "yes")]), ("action", "set_true", [("call", "assign"), ("truth", "true")]), ("action", "set_false", [("call", "assign"), ("truth", "false")])]
    rules += [("label", label, [("returns", name)]) for label, names in RETURNS.items() for name in names.split()]
    rules += [("element", kind, [(kind_property, None)]) for kind, kind_property in (("condition", "relation"), ("action", "action"), ("return", "label"))]
    rules += [("check", "null", [("relation", r), ("right", "NULL")]) for r in ("equals", "not_equals")]
    rules += [("effect", "constant", [("action", a)]) for a in ("clear", "set_true", "set_false")]
    rules += [("outcome", "good", [("label", x)]) for x in ("success", "passed", "true")] + [("outcome", "bad", [("label", x)]) for x in ("failure", "error", "busy", "bad_parameter", "invalid", "timeout", "null", "false")]
    return rules + [("branch", "guard", [("check", "null"), ("element", "condition")]), ("state", "reset", [("effect", "constant"), ("element", "action")])]


def statement_facts(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, property, value): what the text of single conditions, actions and returns shows; other statements show nothing."""
    part = lambda pattern, k: F.regexp_extract(F.coalesce(F.col(code), F.lit("")), pattern, k)
    yes = lambda test: F.when(test, "yes").otherwise("no")
    has = lambda pattern: F.coalesce(F.col(code), F.lit("")).rlike(pattern)
    left, op, right = (part(CONDITION, k) for k in (1, 2, 3))
    swapped = left.rlike(CONSTANT) & ~right.rlike(CONSTANT)
    target, value = (F.when(has(MEMSET), part(MEMSET, k)).when(has(MEMCPY), part(MEMCPY, k)).otherwise(part(ASSIGN, k)) for k in (1, 2))
    call = F.when(has(MEMSET), "fill").when(has(MEMCPY), "copy").when(has(ASSIGN), "assign")
    truth = F.when(value.isin("TRUE", "true", "1", "0x1"), "true").when(value.isin("FALSE", "false"), "false")
    compared, acts, returns = has(CONDITION), call.isNotNull() & ~has(RETURN), has(RETURN)
    found = {
        "op": F.when(compared, op), "swapped": F.when(compared, yes(swapped)), "left": F.when(compared, F.when(swapped, right).otherwise(left)), "right": F.when(compared, F.when(swapped, left).otherwise(right)),
        "call": F.when(acts, call), "zero": F.when(acts, yes(value.rlike(ZERO))), "truth": F.when(acts, truth), "target": F.when(acts, target), "value": F.when(acts, value),
        "returns": F.when(returns, part(RETURN, 1)),
    }
    facts = F.array(*[F.struct(F.lit(p).alias("property"), v.alias("value")) for p, v in found.items()])
    return rows.select(F.col(key), F.explode(facts).alias("f")).select(key, "f.property", "f.value").where("value IS NOT NULL")


def elements(rows: DataFrame, key: str, code: str, names: DataFrame | None = None) -> DataFrame:
    """(key, element, meaning, subject, object, check, effect, outcome, branch, state) of simple conditions, actions and returns.

    ``meaning`` is a relation, an action or the label of what is returned; ``subject`` and ``object`` its sides, translated by ``names``
    (ident, cn) where it has them. Constants are compared to the right: ``0 < x`` reads as x greater than 0. Statements of other
    shapes have no element and no row. Null and empty texts have none; rows are told apart by ``key``, which must be unique.
    """
    derived = forward_chain(statement_facts(rows, key, code), rule_table(rows.sparkSession, element_rules()), key)
    pick = lambda p: F.max(F.when(F.col("property") == p, F.col("value")))
    wide = derived.groupBy(key).agg(*[pick(p).alias(p) for p in ("element", "relation", "action", "label", "left", "right", "target", "value", "check", "effect", "outcome", "branch", "state")]).where("element IS NOT NULL")
    moved = F.col("action").isin("copy", "fill")
    out = wide.select(key, "element", F.coalesce("relation", "action", "label").alias("meaning"), F.coalesce("left", "target").alias("subject"), F.coalesce("right", F.when(moved, F.col("value"))).alias("object"), "check", "effect", "outcome", "branch", "state")
    if names is None:
        return out
    told = names.groupBy("ident").agg(F.min("cn").alias("cn"))
    for side in ("subject", "object"):
        out = out.join(told.select(F.col("ident").alias(side), F.col("cn").alias("cn_")), side, "left").withColumn(side, F.coalesce("cn_", side)).drop("cn_")
    return out.select(key, "element", "meaning", "subject", "object", "check", "effect", "outcome", "branch", "state")

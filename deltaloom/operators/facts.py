"""Facts about symbols and functions: flows, roles, inferred names, provider choice, fallback lookups, retries, code output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions.steps import steps_udf
from deltaloom.plans.session import materialise

#: What opens the names of state members; members that hold an output's limits.
STATE_MEMBERS, LIMIT_MEMBERS = ("state", "status", "flag", "bit_"), ("outmax", "outmin")
#: Parts of type names and of symbol names that tell what a symbol is.
INTEGER_TYPES, REAL_TYPES = ("uint", "int", "short", "long", "char"), ("float", "double", "iq", "fq")
LIMIT_NAMES, BRAKE_NAMES = ("limit", "limt", "lmt"), ("brk", "break")
#: Roles and the evidence that each needs; a role may stand more than once.
ROLE_RULES = [
    ("output_limit", ("limit_member_write",)),
    ("clamp_result", ("clamped",)),
    ("output_value", ("pointer_write",)),
    ("state_output", ("state_member_write",)),
    ("return_value", ("return_flow",)),
    ("call_result", ("produced", "assigned")),
    ("bit_result", ("tag:results_bit32",)),
    ("snapshot", ("tag:results_bit32", "compared_to_static_prev")),
    ("snapshot", ("tag:results_bit32", "used_in_change_detection")),
    ("previous_snapshot", ("paired", "name:static")),
    ("member_snapshot", ("member_source",)),
    ("snapshot", ("member_compared",)),
    ("previous_snapshot", ("member_differs",)),
    ("change_baseline", ("member_differs",)),
    ("state_snapshot", ("state_member_source",)),
    ("state_value", ("state_member_source",)),
    ("counter_value", ("stepped", "type:integer")),
    ("accumulator", ("stepped", "type:real")),
    ("counter_value", ("compared_to_number", "type:integer")),
    ("state_value", ("state_field_read",)),
    ("state_value", ("tag:state",)),
    ("state_value", ("tag:status",)),
    ("evaluated_value", ("type:eval",)),
]
#: Roles that rest on others.
DERIVED_RULES = [
    ("resettable_counter", ("role:counter_value", "set_to_zero")),
    ("limited_value", ("role:output_limit", "name:limit")),
    ("limited_value", ("role:clamp_result", "name:limit")),
    ("brake_limit", ("role:output_limit", "name:brake")),
    ("brake_limit", ("role:clamp_result", "name:brake")),
]


def step_table(functions: DataFrame) -> DataFrame:
    return functions.select("rel_path", F.col("name").alias("function"), F.inline(steps_udf("body")))


def _words(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))


def sink_patterns(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Where symbols (key, symbol) flow to in logic steps (key, kind, target, value): a pointer, a member, a result, an argument.

    An assignment counts if its value opens with the symbol; the last member's name tells states and limits.
    """
    value, member = F.trim(F.coalesce("value", F.lit(""))), F.lower(F.regexp_extract("target", r"(?:\.|->)\s*(\w+)\s*$", 1))
    moved = (F.col("kind") == "assignment") & (F.regexp_extract(value, r"^([A-Za-z_]\w*)", 1) == F.col("symbol"))
    tests = {
        "pointer_write": moved & F.startswith(F.trim("target"), F.lit("*")),
        "member_write": moved & (member != ""),
        "state_member_write": moved & F.regexp_like(member, F.lit(f"^(?:{'|'.join(STATE_MEMBERS)})")),
        "limit_member_write": moved & member.isin(*LIMIT_MEMBERS),
        "return_flow": F.col("kind") == "return",
        "argument": F.col("kind") == "call",
    }
    used = steps.withColumn("symbol", F.explode(_words("value"))).join(symbols.select("key", "symbol").distinct().hint("merge"), ["key", "symbol"])
    return used.select("key", "symbol", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()]))).alias("pattern")).distinct()


def clamped(blocks: DataFrame, steps: DataFrame) -> DataFrame:
    """Symbols that a block's condition holds against a peer and that are set to that peer inside the block.

    ``blocks``: (key, condition, line_start, line_end); ``steps``: (key, kind, operator, target, value, line).
    """
    sides = [F.regexp_extract_all("condition", F.lit(r"([A-Za-z_]\w*)\s*[<>]=?\s*([A-Za-z_]\w*)"), F.lit(k)).alias(name) for k, name in ((1, "symbol"), (2, "peer"))]
    held = blocks.select("key", "line_start", "line_end", F.explode(F.arrays_zip(*sides)).alias("z")).select("key", "line_start", "line_end", "z.symbol", "z.peer")
    sets = steps.where("kind = 'assignment' and operator = '='").select("key", F.trim("target").alias("symbol"), F.trim("value").alias("peer"), "line")
    return held.join(sets, ["key", "symbol", "peer"]).where(F.col("line").between(F.col("line_start"), F.col("line_end"))).select("key", "symbol").distinct()


def symbol_evidence(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (key, symbol, evidence) of symbols (key, symbol, type) by steps: sinks, steps, sources, comparisons, type and name.

    Steps are written once, for five tests read them. Both sides grow with the code, so none is broadcast, however small its file looks.
    """
    steps = materialise(steps, "steps")
    named = symbols.select("key", "symbol").distinct().hint("merge")
    target = F.regexp_extract(F.trim("target"), r"^([A-Za-z_]\w*)$", 1)
    sets = steps.where("kind = 'assignment'").withColumn("symbol", target).join(named, ["key", "symbol"])
    value = F.trim(F.coalesce("value", F.lit("")))
    source = (F.col("operator") == "=") & value.rlike(r"\.|->") & ~F.array_contains(_words(value), F.col("symbol"))
    own = {
        "assigned": F.col("operator") == "=",
        "stepped": F.col("operator").isin("++", "--", "+=", "-="),
        "set_to_zero": (F.col("operator") == "=") & value.rlike(r"^0[uUlLfF]*$"),
        "produced": (F.col("operator") == "=") & value.rlike(r"^(?:\([^()]*\)\s*)?[A-Za-z_]\w*\s*\("),
        "member_source": source,
        "state_member_source": source & F.lower(value).rlike(rf"(?:\.|->)\s*(?:{'|'.join(STATE_MEMBERS)})"),
    }
    tests = steps.where("kind in ('if', 'else_if', 'while', 'for')").select("key", F.col("text").alias("condition"), F.explode(_words("text")).alias("symbol")).join(named, ["key", "symbol"])
    near = lambda tail: F.regexp_like("condition", F.concat(F.lit(r"\b"), "symbol", F.lit(tail)))
    members = sets.where(source).select("key", "symbol", F.regexp_replace(value, r"\s+", "").alias("member"))
    met = members.join(tests.hint("merge"), ["key", "symbol"]).withColumn("plain", F.regexp_replace("condition", r"\s+", ""))
    either = lambda op: F.contains("plain", F.concat("symbol", F.lit(op), "member")) | F.contains("plain", F.concat("member", F.lit(op), "symbol"))
    kind, name = F.lower(F.coalesce("type", F.lit(""))), F.lower("symbol")
    declared = {
        "type:integer": kind.rlike("|".join(INTEGER_TYPES)),
        "type:real": kind.rlike("|".join(REAL_TYPES)) & ~kind.rlike("|".join(INTEGER_TYPES)),
        "type:eval": kind.contains("eval"),
        "name:limit": name.rlike("|".join(LIMIT_NAMES)),
        "name:brake": name.rlike("|".join(BRAKE_NAMES)),
        "name:static": name.rlike("^(?:l_)?s_"),
    }
    listed = lambda rows, kinds: rows.select("key", "symbol", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds.items()]))).alias("evidence"))
    found = listed(sets, own).unionByName(listed(tests, {"compared": near(r"\s*(?:[<>]=?|==|!=)"), "compared_to_number": near(r"\s*[<>]=?\s*\d")}))
    found = found.unionByName(listed(met, {"member_compared": either("==") | either("!="), "member_differs": either("!=")})).unionByName(listed(symbols, declared))
    return found.unionByName(sink_patterns(steps, symbols).withColumnRenamed("pattern", "evidence")).distinct()


def dataflow_roles(evidence: DataFrame) -> DataFrame:
    """Rows (key, symbol, role): every role all of whose evidence a symbol has; some roles are evidence for others.

    ``evidence``: (key, symbol, evidence), of symbol_evidence, clamped (as ``clamped``), argument tags (``tag:name``), consumers.
    """
    spark = evidence.sparkSession

    def step(held: DataFrame, rules: list) -> DataFrame:
        table = spark.createDataFrame([(k, role, x, len(needs)) for k, (role, needs) in enumerate(rules) for x in needs], "rule int, role string, evidence string, needs int")
        met = held.join(F.broadcast(table), "evidence")  # a fixed list of rules
        return met.groupBy("key", "symbol", "rule", "role", "needs").agg(F.count_distinct("evidence").alias("n")).where("n = needs").select("key", "symbol", "role").distinct()

    evidence = materialise(evidence, "evidence")
    first = materialise(step(evidence, ROLE_RULES), "roles")
    more = step(evidence.unionByName(first.select("key", "symbol", F.concat(F.lit("role:"), "role").alias("evidence"))), DERIVED_RULES)
    return first.unionByName(more).distinct()


def signatures(steps: DataFrame) -> DataFrame:
    """Rows (key, kind, item, ord) of what logic steps (key, ord, kind, text, target, value) hold: each condition, member access,
    returned value and callee once, where it first stands."""
    tests = steps.where("kind in ('if', 'else_if', 'while', 'for', 'switch')").select("key", F.lit("condition").alias("kind"), F.col("text").alias("item"), "ord")
    given = steps.where("kind = 'return'").select("key", F.lit("return").alias("kind"), F.col("value").alias("item"), "ord")
    called = steps.where("kind = 'call'").select("key", F.lit("callee").alias("kind"), F.col("target").alias("item"), "ord")
    member = F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*(?:\s*\[[^\]]*\])*(?:\s*(?:\.|->)\s*[A-Za-z_]\w*(?:\s*\[[^\]]*\])*)+"), F.lit(0))
    held = steps.select("key", F.lit("member").alias("kind"), F.explode(F.transform(member, lambda m: F.regexp_replace(m, r"\s+", ""))).alias("item"), "ord")
    rows = tests.unionByName(given).unionByName(called).unionByName(held).where("trim(item) <> ''")
    return rows.groupBy("key", "kind", "item").agg(F.min("ord").alias("ord"))


def function_records(steps: DataFrame, parameters: DataFrame) -> DataFrame:
    """One record for each function: its conditions, members, returned values and callees in order, its parameters with their directions.

    ``parameters``: (key, pos, param, direction); a function of either table has a record.
    """
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "item")))), lambda x: x["item"]).alias(f"{kind}s")
    kinds = ("condition", "member", "return", "callee")
    steps, parameters = materialise(steps.select("key", "ord", "kind", "text", "target", "value"), "steps"), materialise(parameters.select("key", "pos", "param", "direction"), "parameters")
    held = signatures(steps).groupBy("key").agg(*map(listed, kinds))
    named = parameters.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "param", "direction"))), lambda p: F.struct(p["param"].alias("param"), p["direction"].alias("direction"))).alias("parameters"))
    keys = steps.select("key").union(parameters.select("key")).distinct()
    both = keys.join(held.hint("merge"), "key", "left").join(named.hint("merge"), "key", "left")
    none = F.array().cast("array<string>")
    return both.select("key", *[F.coalesce(f"{k}s", none).alias(f"{k}s") for k in kinds], F.coalesce("parameters", F.array().cast("array<struct<param:string,direction:string>>")).alias("parameters"))


def producers(calls_in_lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The call whose result is assigned to each symbol: (key, symbol, producer)."""
    pattern = F.concat(F.lit(r"\b"), F.col("symbol"), F.lit(r"\s*=\s*(?:\([^()]*\)\s*)?([A-Za-z_]\w*)\s*\("))
    met = calls_in_lines.join(symbols, "key").withColumn("producer", F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))).where("producer <> ''")
    return met.select("key", "symbol", "producer").distinct()


#: What a word in an argument, and in the name of the called function, tells of the result.
ARGUMENT_TAGS = (
    ("RESULTS_BIT32", "results_bit32"), ("RESULTS", "results"), ("FLEVEL", "fault_level"), ("FAULT_LEVEL", "fault_level"), ("STATE", "state"), ("STATUS", "state"), ("RIU", "riu"), ("CCDL", "ccdl"), ("KZZZ", "kzzz"),
    ("LEFT", "left"), ("_L_", "left"), ("RIGHT", "right"), ("_R_", "right"), ("IFBIT", "ifbit"), ("MBIT", "mbit"), ("PUBIT", "pubit"),
)
CALL_TAGS = (("STATEGET", "state"), ("STATUSGET", "state"), ("RESULTGET", "results"))
#: Prefixes of locals and statics that a pair of symbols may differ by, and how many partners count.
STORAGE_PREFIX, MOST_PAIRS = "^(?:l_s_|l_|s_)", 4


def producing_calls(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, symbol, callee, arguments) of the calls whose results are assigned: the first line that has one, arguments at top-level commas."""
    head = F.concat(F.lit(r"\b"), F.col("symbol"), F.lit(r"\b\s*=(?!=)\s*([A-Za-z_]\w*)\s*\((.*?)\)\s*;?\s*$"))
    grab = lambda k: F.call_function("regexp_extract", F.col("text"), head, F.lit(k))
    met = lines.join(symbols, "key").withColumn("callee", grab(1)).where("callee <> ''")
    first = met.withColumn("inner_", grab(2)).groupBy("key", "symbol").agg(F.min_by(F.struct("callee", "inner_"), "ord").alias("c"))
    parts = F.filter(F.transform(F.split("c.inner_", r",(?![^()]*\))"), lambda x: F.trim(x)), lambda x: x != "")
    return first.select("key", "symbol", F.col("c.callee").alias("callee"), parts.alias("arguments"))


def bind_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """(key, symbol, callee, position, argument, parameter, direction): each argument of a call site joined to the callee's parameter.

    ``calls``: rows of producing_calls; ``parameters``: (callee, position from 0, parameter, direction). Arguments beyond the
    parameters, and those of functions that are not known, stay with a null parameter; functions defined twice give each of their parameters.
    """
    sites = calls.select("key", "symbol", "callee", F.posexplode("arguments").alias("position", "argument"))
    return sites.join(parameters.select("callee", "position", "parameter", "direction"), ["callee", "position"], "left").select("key", "symbol", "callee", "position", "argument", "parameter", "direction")


def argument_tags(bound: DataFrame) -> DataFrame:
    """(key, symbol, tag): tags by words in the arguments, in the parameters they are bound to, and in the callee's name."""
    listed = lambda tags: F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("tag")) for w, t in tags])
    held = lambda text, tags: F.transform(F.filter(listed(tags), lambda x: F.contains(F.upper(F.coalesce(F.col(text), F.lit(""))), x["word"])), lambda x: x["tag"])
    tags = F.array_distinct(F.concat(held("argument", ARGUMENT_TAGS), held("parameter", ARGUMENT_TAGS), held("callee", CALL_TAGS)))
    return bound.select("key", "symbol", F.explode(tags).alias("tag")).distinct()


def paired_symbols(symbols: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(key, symbol, pairs): the first MOST_PAIRS symbols of the same key that differ by a storage prefix only; none: no row.

    Of each stem one more than that is kept, so a symbol can be left out of its own list and no group is gathered whole.
    """
    stems = symbols.withColumn("stem", F.regexp_replace("symbol", STORAGE_PREFIX, "")).where("stem <> ''").groupBy("key", "stem", "symbol").agg(F.min(ord_col).alias("o"))
    nth = F.row_number().over(Window.partitionBy("key", "stem").orderBy("o", "symbol"))
    few = stems.withColumn("nth", nth).where(F.col("nth") <= MOST_PAIRS + 1).groupBy("key", "stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "symbol"))), lambda x: x["symbol"]).alias("known"))
    both = stems.join(few, ["key", "stem"]).withColumn("pairs", F.slice(F.filter("known", lambda x: x != F.col("symbol")), 1, MOST_PAIRS))
    return both.where(F.size("pairs") > 0).select("key", "symbol", "pairs")


def roles(patterns: DataFrame) -> DataFrame:
    """One role for each symbol by its patterns: the first that fits of output, state, result, index, limit, input, local."""
    held = patterns.groupBy("key", "symbol").agg(F.collect_set("pattern").alias("p"))
    has = lambda x: F.array_contains("p", x)
    role = F.when(has("pointer_write"), "output").when(has("state_member_write"), "state").when(has("return_flow") | has("returned"), "result").when(has("indexed"), "index").when(has("compared") & ~has("assigned"), "limit").when(has("argument"), "input").otherwise("local")
    return held.select("key", "symbol", role.alias("role"))


def inferred_confidence(candidate: Column, is_macro: Column, hinted: Column, guessed: Column, owned: Column, produced: Column, tagged: Column, consumed: Column, returned: Column, kinds: Column) -> Column:
    """Confidence of an inferred name: the highest floor among its evidence; 0 without a candidate."""
    floor = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    best = F.greatest(
        F.when(is_macro, 0.72).otherwise(0.62), floor(guessed, 0.75), floor(owned, 0.78), floor(produced | (kinds >= 3), 0.82), floor(hinted | tagged | consumed | returned, 0.84)
    )
    return F.when(F.coalesce(candidate, F.lit("")) != "", best).otherwise(0.0)


def persist_scope(confidence: Column, kinds: Column, is_macro: Column) -> Column:
    """project, session_only or none: what may be remembered."""
    return F.when(is_macro & (confidence > 0), "session_only").when((confidence >= 0.82) & (kinds >= 2), "project").when(confidence >= 0.60, "session_only").otherwise("none")


def payload_quality(blocks: Column, signed_calls: Column, owned_members: Column, typed_locals: Column) -> Column:
    """Quality 0.5-1 of a provider's facts by what they hold."""
    bonus = lambda test, value: F.when(F.coalesce(test, F.lit(0)) > 0, value).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(0.5 + bonus(blocks, 0.15) + bonus(signed_calls, 0.15) + bonus(owned_members, 0.1) + bonus(typed_locals, 0.1), 2))


def choose_provider(first: DataFrame, fallback: DataFrame, least: float = 0.3) -> DataFrame:
    """Per key the first provider's facts, unless they are missing, lack structure, or are poor and the fallback's are better.

    Rows (key, quality, misses_structure, payload).
    """
    a = first.select("key", F.col("quality").alias("q"), "misses_structure", F.col("payload").alias("a"))
    b = fallback.select("key", F.col("quality").alias("fq"), F.col("payload").alias("b"))
    both = a.join(b, "key", "full_outer")
    poor = (F.col("q") < least) & (F.col("fq") > F.col("q"))
    back = F.col("a").isNull() | ((F.col("misses_structure") | poor) & F.col("b").isNotNull())
    return both.select("key", F.when(back, F.col("b")).otherwise(F.col("a")).alias("payload"), F.when(back, "fallback").otherwise("first").alias("provider"))


def lookup(asked: DataFrame, records: DataFrame, ladder: list[list[str]], unique_last: bool = True) -> DataFrame:
    """Records for asked rows by the first key list of ``ladder`` that finds one (the least ``record_id``).

    With ``unique_last`` the last step counts only if it finds exactly one record. Returns (ask_id, record_id, step).
    """
    rows = None
    for step, keys in enumerate(ladder):
        met = asked.select("ask_id", *keys).join(records.select("record_id", *keys), keys).groupBy("ask_id").agg(F.min("record_id").alias("record_id"), F.count_distinct("record_id").alias("n"))
        if unique_last and step == len(ladder) - 1:
            met = met.where("n = 1")
        met = met.select("ask_id", "record_id", F.lit(step).alias("step"))
        rows = met if rows is None else rows.unionByName(met)
    return rows.groupBy("ask_id").agg(F.min_by("record_id", "step").alias("record_id"), F.min("step").alias("step"))


def retry_tasks(failures: DataFrame, functions: DataFrame) -> DataFrame:
    """Failed functions (file_path, func_name, ...) with their parsed function: the exact name, else one that differs in case only."""
    named = functions.select(F.col("rel_path").alias("file_path"), "name", "ord").hint("merge")
    exact = failures.join(named, (failures.file_path == named.file_path) & (failures.func_name == named.name)).select(failures["*"], "name", F.lit("exact").alias("match"))
    rest = failures.join(exact.select("file_path", "func_name").hint("merge"), ["file_path", "func_name"], "left_anti")
    first = named.groupBy("file_path", F.lower("name").alias("low")).agg(F.min_by("name", "ord").alias("name"))
    folded = rest.withColumn("low", F.lower("func_name")).join(first.hint("merge"), ["file_path", "low"], "left").drop("low")
    folded = folded.withColumn("match", F.when(F.col("name").isNull(), "missing").otherwise("case"))
    return exact.unionByName(folded.select(exact.columns))


def callee_summaries(functions: DataFrame, calls: DataFrame, most: int = 6) -> DataFrame:
    """For each caller its first ``most`` distinct callees with a summary: of the same module, else of a project-unique name, else a stub.

    ``functions``: (module, name, summary); ``calls``: (module, caller, callee, ord).
    """
    order = Window.partitionBy("module", "caller").orderBy("ord", "callee")
    kept = calls.groupBy("module", "caller", "callee").agg(F.min("ord").alias("ord")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    own = functions.groupBy("module", F.col("name").alias("callee")).agg(F.min("summary").alias("own"))
    only = functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("summary").alias("only")).where("n = 1").drop("n")
    both = kept.join(own, ["module", "callee"], "left").join(only, "callee", "left")
    return both.select("module", "caller", "callee", "rank", F.coalesce("own", "only", F.concat(F.lit("calls "), "callee")).alias("summary"), F.when(F.col("own").isNotNull(), "module").when(F.col("only").isNotNull(), "project").otherwise("stub").alias("source"))


def first_definitions(rows: DataFrame) -> DataFrame:
    """The first translation of each identifier (ident, cn, kind, ord), and which macros have none: translated is false."""
    some = rows.withColumn("cn", F.nullif(F.trim(F.coalesce("cn", F.lit(""))), F.lit("")))
    first = some.groupBy("ident").agg(F.min_by("cn", F.when(F.col("cn").isNotNull(), F.col("ord"))).alias("cn"), F.min_by("kind", "ord").alias("kind"))
    return first.withColumn("translated", F.col("cn").isNotNull()).where("translated or kind = 'macro'")


def layered(*tables: DataFrame) -> DataFrame:
    """Dictionaries (ident, cn) laid over each other: later tables win."""
    rows = None
    for rank, table in enumerate(tables):
        step = table.groupBy("ident").agg(F.max("cn").alias("cn")).withColumn("rank", F.lit(rank))
        rows = step if rows is None else rows.unionByName(step)
    return rows.groupBy("ident").agg(F.max_by("cn", "rank").alias("cn"), F.max("rank").alias("rank"))


def usage_snippets(lines: DataFrame, symbols: DataFrame, most: int = 3, width: int = 160) -> DataFrame:
    """The first ``most`` lines of each key that use a symbol, cut to ``width`` characters."""
    met = lines.join(symbols, "key").where(F.regexp_like("text", F.concat(F.lit(r"\b"), "symbol", F.lit(r"\b"))))
    order = Window.partitionBy("key", "symbol").orderBy("ord")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("key", "symbol", "rank", F.substring(F.trim("text"), 1, width).alias("snippet"))


def merge_user_blocks(generated: Column, blocks: Column, names: list[str]) -> Column:
    """Generated code with the bodies of protected blocks put back from a map name -> body."""
    out = generated
    for name in names:
        pattern = rf"(?s)(/\* USER CODE BEGIN {name} \*/).*?(/\* USER CODE END {name} \*/)"
        kept = F.regexp_replace(blocks[F.lit(name)], r"([\\$])", r"\\$1")
        out = F.when(blocks[F.lit(name)].isNotNull(), F.regexp_replace(out, F.lit(pattern), F.concat(F.lit("$1"), kept, F.lit("$2")))).otherwise(out)
    return out


def header_text(functions: DataFrame, macros: DataFrame, module: str = "module") -> DataFrame:
    """C headers of modules: guard, macros (name, value, note), prototypes with their comments, in order."""
    line = F.concat(F.lit("#define "), "name", F.lit(" "), F.coalesce("value", F.lit("")), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" /* "), "note", F.lit(" */"))).otherwise(""))
    defs = macros.groupBy(module).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.rtrim(line).alias("l")))), lambda x: x["l"]), "\n").alias("defs"))
    proto = F.concat(F.when(F.coalesce("brief", F.lit("")) != "", F.concat(F.lit("/* "), "brief", F.lit(" */\n"))).otherwise(""), "prototype", F.lit(";"))
    text = functions.groupBy(module).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", proto.alias("l")))), lambda x: x["l"]), "\n").alias("protos"))
    guard = F.concat(F.upper(F.regexp_replace(module, r"\W", "_")), F.lit("_H"))
    both = text.join(defs, module, "full_outer")
    return both.select(module, F.concat(F.lit("#ifndef "), guard, F.lit("\n#define "), guard, F.lit("\n\n"), F.coalesce(F.concat("defs", F.lit("\n\n")), F.lit("")), F.coalesce(F.concat("protos", F.lit("\n\n")), F.lit("")), F.lit("#endif\n")).alias("text"))


def patch_markdown_rows(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """Table rows ``| name | ... |`` of markdown lines (doc, ord, text) replaced by patches (doc, name, row)."""
    name = F.trim(F.regexp_extract("text", r"^\s*\|\s*`?([^|`]+?)`?\s*\|", 1))
    both = lines.withColumn("name", name).join(patches.select("doc", "name", "row"), ["doc", "name"], "left")
    return both.select("doc", "ord", F.coalesce("row", "text").alias("text"), F.col("row").isNotNull().alias("patched"))


def regression_choice(rounds: DataFrame, most: int = 3) -> DataFrame:
    """The round each key ends with: rounds (key, round, penalty) go on while the penalty falls, ``most`` at most."""
    order = Window.partitionBy("key").orderBy("round")
    best = F.min("penalty").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stalled = F.max(F.coalesce((F.col("penalty") >= best).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    going = rounds.withColumn("stalled", stalled).where((F.col("stalled") == 0) & (F.col("round") < most))
    return going.groupBy("key").agg(F.min_by("round", F.struct("penalty", "round")).alias("round"), F.min("penalty").alias("penalty"))

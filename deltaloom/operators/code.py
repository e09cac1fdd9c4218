"""Fact tables of C projects: functions, calls, accesses, effects, control blocks, comments, members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.functions import clang
from deltaloom.plans.session import materialise


def function_table(files: DataFrame, dead_code: bool = False) -> DataFrame:
    """One row for each function of files (rel_path, content); code that ``#if 0`` hides is left out unless ``dead_code``."""
    source = F.col("content") if dead_code else clang.mask_dead_udf("content")
    likely = files.where(F.col("content").contains("(") & F.col("content").contains("{"))
    return likely.select("rel_path", F.inline(clang.functions_udf(source)))


def duplicate_names(functions: DataFrame) -> DataFrame:
    """Keys name, name#2, ... of a file's functions in order."""
    nth = F.row_number().over(Window.partitionBy("rel_path", "name").orderBy("ord"))
    return functions.withColumn("name_key", F.when(nth == 1, F.col("name")).otherwise(F.concat("name", F.lit("#"), nth.cast("string"))))


def core_text(body: Column) -> Column:
    """A function's text without its first line, so that a renamed function keeps its core."""
    return F.regexp_replace(body, r"^[^\n]*\n", "")


def call_table(functions: DataFrame) -> DataFrame:
    """Calls (rel_path, caller, ord, callee, line, args) without self calls."""
    rows = functions.select("rel_path", F.col("name").alias("caller"), "line_start", F.inline(clang.calls_udf("body")))
    return rows.where("callee <> caller").withColumn("line", F.col("line") + F.col("line_start")).drop("line_start")


def access_table(functions: DataFrame) -> DataFrame:
    rows = functions.select("rel_path", F.col("name").alias("function"), "line_start", F.inline(clang.accesses_udf("body")))
    return rows.withColumn("line", F.col("line") + F.col("line_start")).drop("line_start")


def effect_table(functions: DataFrame) -> DataFrame:
    return functions.select("rel_path", F.col("name").alias("function"), F.inline(clang.effects_udf("body", "params")))


def propagate_effects(functions: DataFrame, calls: DataFrame, effects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(effects on callers' arguments by one call, issues).

    A callee counts if its name is unique and the call passes as many arguments as it has parameters; a pointer
    parameter's write becomes a write to the argument in its place. Other calls of known names are issues.
    """
    unique = functions.groupBy("name").agg(F.count("*").alias("n"), F.min("params").alias("params"))
    met = calls.join(unique, calls.callee == unique.name)
    good = met.where((F.col("n") == 1) & (F.size("args") == F.size("params")))
    why = F.when(F.col("n") > 1, "ambiguous_callee").otherwise("argument_count")
    issues = met.where(~((F.col("n") == 1) & (F.size("args") == F.size("params")))).select("rel_path", "caller", "callee", "line", why.alias("issue"))
    formal = F.transform("params", lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\W*$", 1))
    root = F.regexp_extract("target", r"([A-Za-z_]\w*)", 1)
    writes = effects.where("kind = 'param_write'").select(F.col("function").alias("callee"), root.alias("formal"), "operation")
    placed = good.select("rel_path", "caller", "callee", "line", F.posexplode(F.arrays_zip(formal.alias("formal"), F.col("args").alias("actual"))).alias("pos", "z"))
    hit = placed.select("rel_path", "caller", "callee", "line", F.col("z.formal").alias("formal"), F.col("z.actual").alias("actual")).join(writes, ["callee", "formal"])
    return hit.select("rel_path", F.col("caller").alias("function"), F.lit("callee_effect").alias("kind"), F.regexp_replace("actual", r"^&", "").alias("target"), F.concat(F.lit("call "), "callee").alias("operation"), "line"), issues


def block_table(functions: DataFrame) -> DataFrame:
    return functions.select("rel_path", F.col("name").alias("function"), F.inline(clang.blocks_udf("body")))


def local_table(functions: DataFrame) -> DataFrame:
    """Declared locals that are no parameters."""
    rows = functions.select("rel_path", F.col("name").alias("function"), "params", F.inline(clang.locals_udf("body")))
    formal = F.transform("params", lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)\W*$", 1))
    return rows.where(~F.array_contains(formal, F.col("name"))).drop("params")


def parameter_table(functions: DataFrame) -> DataFrame:
    """Parameters (name, type) with their direction by how the body uses them: input, output or input_output."""
    rows = functions.select("rel_path", F.col("name").alias("function"), "body", F.posexplode("params").alias("pos", "raw"))
    rows = rows.withColumn("param", F.regexp_extract("raw", r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*$", 1)).withColumn("type", F.trim(F.regexp_replace("raw", r"[A-Za-z_]\w*\s*(?:\[[^\]]*\])?\s*$", "")))
    code = F.regexp_replace("body", r"^[^{]*\{", "")
    write = F.regexp_like(code, F.concat(F.lit(r"(?:\*\s*"), "param", F.lit(r"|\b"), "param", F.lit(r"\s*(?:->|\[)[^=;]*)\s*[-+*/|&^]?=(?!=)")))
    read = F.regexp_like(code, F.concat(F.lit(r"\b"), "param", F.lit(r"\b")))
    return rows.select("rel_path", "function", "pos", "param", "type", F.when(write & F.col("raw").contains("*"), F.when(read, "input_output").otherwise("output")).otherwise("input").alias("direction"))


def include_table(files: DataFrame) -> DataFrame:
    return files.select("rel_path", F.explode(clang.includes_udf("content")).alias("include"))


def member_table(files: DataFrame) -> DataFrame:
    return files.select("rel_path", F.inline(clang.members_udf("content")))


def symbol_comments(files: DataFrame) -> DataFrame:
    """Declared symbols and the comment on their line: (rel_path, line, ident, comment, kind)."""
    lines = files.select("rel_path", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    named = lines.withColumn("comment", F.trim(F.regexp_extract("text", r"/\*+\s*(.*?)\s*\*+/|//\s*(.*)$", 1)))
    named = named.withColumn("comment", F.when(F.col("comment") == "", F.trim(F.regexp_extract("text", r"//\s*(.*)$", 1))).otherwise(F.col("comment")))
    macro = F.regexp_extract("text", r"^\s*#\s*define\s+([A-Za-z_]\w*)", 1)
    symbol = F.regexp_extract("text", r"^[\w\s\*]+?\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=[^;]*)?;", 1)
    ident = F.when(macro != "", macro).otherwise(symbol)
    return named.select("rel_path", (F.col("line") + 1).alias("line"), ident.alias("ident"), "comment", F.when(macro != "", "macro").otherwise("symbol").alias("kind")).where("ident <> '' and comment <> ''")


def header_symbols(files: DataFrame) -> DataFrame:
    """What files name (rel_path, ord, ident, kind, value, line): macros, enumerators, typedefs, variables, prototypes."""
    return files.select("rel_path", F.inline(clang.symbols_udf("content")))


def typedef_bases(typedefs: DataFrame, most_steps: int = 16) -> DataFrame:
    """Rows (ident, base) of typedefs (ident, value): the type at the end of each chain; a chain that runs in a circle ends at its start."""
    step = typedefs.groupBy(F.col("ident").alias("from_")).agg(F.min("value").alias("to_"))
    out = step.select(F.col("from_").alias("ident"), F.col("to_").alias("base"))
    for _ in range(most_steps.bit_length()):  # a step follows twice as many links as the one before
        jump = out.select(F.col("ident").alias("from_"), F.col("base").alias("to_"))
        out = materialise(out.join(jump, (out.base == jump.from_) & (out.base != out.ident), "left").select("ident", F.coalesce("to_", "base").alias("base")), "typedefs")
    return out.join(step, F.col("base") == F.col("from_"), "left").select("ident", F.when(F.col("from_").isNotNull(), F.col("ident")).otherwise(F.col("base")).alias("base"))


def comment_table(files: DataFrame) -> DataFrame:
    """Comments of files (rel_path, end_line, text, next_line): runs with only blanks between are one; next_line is where code follows."""
    return files.select("rel_path", F.inline(clang.comments_udf("content")))


def preceding_comments(functions: DataFrame, comments: DataFrame) -> DataFrame:
    """The comment of comment_table that stands before each function with nothing but blanks between: an equi-join on the line."""
    met = functions.select("rel_path", "name", "ord", F.col("line_start").alias("next_line")).join(comments, ["rel_path", "next_line"])
    return met.select("rel_path", "name", "ord", F.col("text").alias("comment"))


def comment_fields(comments: DataFrame, key: str = "name", body: str = "text") -> DataFrame:
    """Labelled sections of comment blocks: @brief, @param, @return and plain labels ``Label:`` carried to following lines."""
    lines = comments.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"^\s*/?\*+\s?|\*+/\s*$|^\s*//+", "")))
    label = F.lower(F.regexp_extract("line", r"^(?:[@\\](\w+)|(\w[\w ]{0,20})\s*[:：])", 1))
    plain = F.lower(F.regexp_extract("line", r"^(\w[\w ]{0,20})\s*[:：]", 1))
    mark = F.coalesce(F.nullif(label, F.lit("")), F.nullif(plain, F.lit("")))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("label", F.coalesce(F.last(mark, True).over(order), F.lit("text")))
    value = F.trim(F.regexp_replace("line", r"^(?:[@\\]\w+|\w[\w ]{0,20}\s*[:：])\s*", ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value != "", F.struct("pos", value.alias("v"))))), lambda x: x["v"]), "\n")
    return lines.groupBy(key, "label").agg(joined.alias("value"))


def usage_patterns(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """How lines (key, text) use symbols (key, symbol): assigned, compared, indexed, called, returned, stepped, masked."""
    name = F.concat(F.lit(r"\b"), F.col("symbol"), F.lit(r"\b"))
    patterns = {"assigned": r"\s*(?:\[[^\]]*\])?\s*[-+*/|&^]?=(?!=)", "compared": r"\s*(?:==|!=|<=|>=|<|>)", "indexed": r"\s*\[", "called": r"\s*\(", "stepped": r"\s*(?:\+\+|--)", "masked": r"\s*[&|]\s*(?:0[xX][0-9a-fA-F]+|[A-Z])"}
    tests = [F.when(F.regexp_like("text", F.concat(name, F.lit(tail))), F.lit(kind)) for kind, tail in patterns.items()]
    tests.append(F.when(F.regexp_like("text", F.concat(F.lit(r"\breturn\b[^;]*"), name)), F.lit("returned")))
    met = lines.join(symbols, "key").where(F.contains("text", "symbol"))
    return met.select("key", "symbol", F.explode(F.array_compact(F.array(*tests))).alias("pattern")).groupBy("key", "symbol", "pattern").agg(F.count("*").alias("n"))


def classify(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first (pattern, label) rule that a value fits."""
    out = F.lit(otherwise).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(value.rlike(pattern), label).otherwise(out)
    return out


def cross_check(first: DataFrame, second: DataFrame, tolerance: int = 1) -> DataFrame:
    """Functions (rel_path, name, line) of two parsers: both, moved (lines differ by more), only_first, only_second."""
    a, b = (df.groupBy("rel_path", "name").agg(F.min("line").alias(side)) for df, side in ((first, "a"), (second, "b")))
    both = a.join(b, ["rel_path", "name"], "full_outer")
    return both.select("rel_path", "name", F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").when(F.abs(F.col("a") - F.col("b")) > tolerance, "moved").otherwise("both").alias("status"))

"""Queries on C source: the tables hold none, so the files are built from the part table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.operators import changes, code, graph, incremental, planner, sections
from deltaloom.plans.registry import query, table
from deltaloom.plans.session import materialise, spread


def project(spark: SparkSession, sf_dir: str, version: str = "") -> DataFrame:
    """Files (rel_path, content), one for each part; ``old`` and ``new`` are two versions that differ.

    ``u<key>.c`` includes ``m<size>.h``, defines ``f<key>`` that writes through a pointer and calls ``f<key + 1>``, and
    hides a function behind ``#if 0``. In the new version the constant of every seventh part grows, every
    eleventh function has another name, every thirteenth file is gone and every seventeenth is new.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    key, k, new = F.col("p_partkey").cast("string"), F.col("p_partkey"), F.lit(version == "new")
    part = part.where({"new": "p_partkey % 13 <> 4", "old": "p_partkey % 17 <> 5"}.get(version, "true"))
    part = spread(part, "p_partkey")
    constant = F.when(new & (k % 7 == 0), F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    name = F.when(new & (k % 11 == 0), F.concat(F.lit("renamed_f"), key)).otherwise(F.concat(F.lit("f"), key))
    text = F.concat(
        F.lit('#include "m'), F.col("p_size").cast("string"), F.lit('.h"\n#define LIMIT_'), key, F.lit(" "), constant, F.lit(" /* limit */\n/* "), "p_name", F.lit(" */\nint "), name,
        F.lit("(int a, int *out) {\n    int local_value = a + "), constant, F.lit('; // adds { "x"\n    *out = local_value;\n    g_total += local_value;\n    if (a > LIMIT_'), key,
        F.lit(") {\n        f"), (k + 1).cast("string"), F.lit("(a, out);\n    } else {\n        local_value++;\n    }\n    return local_value;\n}\n#if 0\nvoid dead_"), key, F.lit("(void) { }\n#endif\n"),
    )
    return part.select(F.concat(F.lit("u"), key, F.lit(".c")).alias("rel_path"), text.alias("content"))


@query("SELECT concat('u', p_partkey, '.c') AS rel_path, concat('f', p_partkey) AS name, 4::int AS line_start, 14::int AS line_end, 2::bigint AS n_params FROM part")
def code_functions(spark, sf_dir):
    found = code.function_table(project(spark, sf_dir))
    return found.select("rel_path", "name", "line_start", "line_end", F.size("params").cast("long").alias("n_params"))


@query("SELECT concat('f', p_partkey) AS caller, concat('f', p_partkey + 1) AS callee, 9::int AS line, 'a,out' AS args FROM part")
def code_calls(spark, sf_dir):
    calls = code.call_table(code.function_table(project(spark, sf_dir)))
    return calls.select("caller", "callee", "line", F.array_join("args", ",").alias("args"))


@query("SELECT kind, count(*) AS n FROM part, (VALUES ('param_write'), ('global_write'), ('return')) k(kind) GROUP BY kind")
def code_effects(spark, sf_dir):
    return code.effect_table(code.function_table(project(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT concat('f', p_partkey) AS function, 'out' AS target, concat('call f', p_partkey + 1) AS operation FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def code_effect_propagation(spark, sf_dir):
    functions = code.function_table(project(spark, sf_dir))
    found, _ = code.propagate_effects(functions, code.call_table(functions), code.effect_table(functions))
    return found.select("function", "target", "operation")


@query("SELECT kind, condition, depth, count(*) AS n FROM (SELECT 'if' AS kind, concat('a > LIMIT_', p_partkey) AS condition, 0::int AS depth FROM part UNION ALL SELECT 'else', '', 0 FROM part) GROUP BY ALL")
def code_blocks(spark, sf_dir):
    return code.block_table(code.function_table(project(spark, sf_dir))).groupBy("kind", "condition", "depth").agg(F.count("*").alias("n"))


@query("SELECT concat('f', p_partkey) AS function, param, direction FROM part, (VALUES ('a', 'input'), ('out', 'input_output')) k(param, direction)")
def code_parameters(spark, sf_dir):
    return code.parameter_table(code.function_table(project(spark, sf_dir))).select("function", "param", "direction")


@query("SELECT concat('f', p_partkey) AS function, 'local_value' AS name, concat('a + ', p_size) AS value FROM part")
def code_locals(spark, sf_dir):
    return code.local_table(code.function_table(project(spark, sf_dir))).select("function", "name", "value")


@query("SELECT concat('u', p_partkey, '.c') AS rel_path, concat('m', p_size, '.h') AS include FROM part")
def code_includes(spark, sf_dir):
    return code.include_table(project(spark, sf_dir))


@query("SELECT symbol, kind, n * k::bigint AS n FROM (SELECT count(*) AS n FROM part), (VALUES ('local_value', 'write', 2), ('out', 'write', 1), ('g_total', 'write', 1), ('g_total', 'read', 1), ('a', 'read', 1), ('local_value', 'read', 2)) t(symbol, kind, k) WHERE n > 0")
def code_accesses(spark, sf_dir):
    return code.access_table(code.function_table(project(spark, sf_dir))).groupBy("symbol", "kind").agg(F.count("*").alias("n"))


_SPANS = """k AS (SELECT p_partkey AS k, p_partkey % 17 <> 5 AS old, p_partkey % 13 <> 4 AS new FROM part)"""


@query(f"""WITH {_SPANS} SELECT change_kind, count(*) AS n FROM (SELECT CASE WHEN old AND NOT new THEN 'deleted_file' WHEN new AND NOT old THEN 'new_file' WHEN k % 7 = 0 THEN 'modified_function' WHEN k % 11 = 0 THEN 'file_global_changed' END AS change_kind FROM k WHERE old OR new) WHERE change_kind IS NOT NULL GROUP BY change_kind""")
def code_changes(spark, sf_dir):
    found = changes.code_changes(project(spark, sf_dir, "old"), project(spark, sf_dir, "new"))
    return changes.change_summary(found, "change_kind")


@query("SELECT concat('f', p_partkey) AS old_name, concat('renamed_f', p_partkey) AS new_name FROM part WHERE p_partkey % 17 <> 5 AND p_partkey % 13 <> 4 AND p_partkey % 11 = 0")
def code_renames(spark, sf_dir):
    old, new = (materialise(code.function_table(project(spark, sf_dir, version)).select("rel_path", "name", "body"), "functions") for version in ("old", "new"))
    idx = F.xxhash64("rel_path", "name")
    keep = old.select("rel_path").intersect(new.select("rel_path"))
    gone = old.join(new, ["rel_path", "name"], "left_anti").join(keep, "rel_path").select("rel_path", idx.alias("idx"), "name", "body")
    come = new.join(old, ["rel_path", "name"], "left_anti").join(keep, "rel_path").select("rel_path", idx.alias("idx"), "name", "body")
    return planner.renames(gone, come).select("old_name", "new_name")


@query("SELECT concat('u', p_partkey, '.c') AS rel_path, concat('f', p_partkey) AS name FROM part WHERE p_size < 10")
def header_impact(spark, sf_dir):
    """Functions of files that include a changed header (sizes below 10) and use one of its changed symbols."""
    files = project(spark, sf_dir)
    functions = code.function_table(files).select("rel_path", "name", F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)).alias("tokens"))
    sizes = table(spark, sf_dir, "part").where("p_size < 10").select("p_size").distinct()
    headers = sizes.select(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit(".h")).alias("header"), planner.changed_symbols(F.lit("extern int g_total;"), F.lit("extern long;")).alias("symbols"))
    includes = code.include_table(files).withColumnRenamed("include", "header")
    direct = spark.createDataFrame([], "rel_path string, name string")
    return planner.header_impact(headers, includes, functions, direct).select("rel_path", "name")


@query("SELECT concat('LIMIT_', p_partkey) AS ident, 'limit' AS comment, 'macro' AS kind FROM part")
def code_symbol_comments(spark, sf_dir):
    return code.symbol_comments(project(spark, sf_dir)).where("kind = 'macro'").select("ident", "comment", "kind")


@query("SELECT concat('f', p_partkey) AS node FROM part WHERE p_partkey - 1 NOT IN (SELECT p_partkey FROM part)")
def code_entry_functions(spark, sf_dir):
    functions = code.function_table(project(spark, sf_dir))
    return graph.entry_nodes(functions.select(F.col("name").alias("node")), code.call_table(functions))


@query("""WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 13 <> 4), o AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 17 <> 5)
SELECT CASE WHEN k % 11 = 0 THEN concat('renamed_f', k) ELSE concat('f', k) END AS name, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k IN (SELECT k FROM o) THEN 'skip' ELSE 'generate' END AS action FROM k""")
def function_regeneration(spark, sf_dir):
    a, b = (incremental.function_fingerprints(code.function_table(project(spark, sf_dir, version)).withColumnRenamed("rel_path", "path")) for version in ("old", "new"))
    return incremental.tasks(a, b).select("name", "action")


@query("SELECT concat('f', p_partkey) AS name, p_name AS comment FROM part")
def code_preceding_comments(spark, sf_dir):
    """The comment that stands before each function."""
    files = project(spark, sf_dir)
    return code.preceding_comments(code.function_table(files), code.comment_table(files)).select("name", "comment")


@query("SELECT concat('u', p_partkey, '.c') AS rel_path, concat('f', p_partkey) AS name_key, 11::bigint AS core_lines FROM part")
def code_function_keys(spark, sf_dir):
    """Functions by their unique keys, and how many lines their core has."""
    found = code.duplicate_names(code.function_table(project(spark, sf_dir)))
    return found.select("rel_path", "name_key", (F.size(F.split(code.core_text(F.col("body")), "\n")) + 1).cast("long").alias("core_lines"))


@query("SELECT concat('f', p_partkey) AS callee, concat('f', p_partkey - 1) AS caller FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)")
def code_callers(spark, sf_dir):
    """Callers of each defined function, from the edges of the functions' callee lists."""
    functions = code.function_table(project(spark, sf_dir))
    callees = code.call_table(functions).groupBy(F.col("caller").alias("name")).agg(F.array_agg("callee").alias("callees"))
    edges = graph.call_edges(functions.select("name", "ord").join(callees, "name"))
    return edges.join(functions.select(F.col("name").alias("callee")), "callee", "left_semi").select("callee", "caller")


@query("SELECT 'f' || p_partkey AS name, 'f' || lag(p_partkey) OVER w AS prev_name, 'f' || lead(p_partkey) OVER w AS next_name FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)")
def code_neighbours(spark, sf_dir):
    """Each function with those before and after it among the files of one header."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc"), F.col("p_partkey").alias("ord"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"))
    return sections.neighbours(rows, "name").select("name", "prev_name", "next_name")


@query("SELECT concat('LIMIT_', p_partkey) AS ident, 'macro' AS kind, p_size::varchar AS value FROM part")
def code_header_symbols(spark, sf_dir):
    """Macros of the files with their values."""
    return code.header_symbols(project(spark, sf_dir)).where("kind = 'macro'").select("ident", "kind", "value")


@query("""WITH l AS (SELECT unnest(['#include', '#define', '/*', 'int', '    int', '    *out', '    g_total', '    if', '        f', '    } else', '        local', '    }', '    return', '}', '#if 0', 'void', '#endif', '']) AS line, unnest(range(0, 18)) AS ord)
SELECT concat('u', p_partkey, '.c') AS rel_path, depth_before::bigint AS depth, count(*) AS n FROM part, (SELECT ord, CASE WHEN ord BETWEEN 4 AND 7 OR ord = 12 OR ord = 13 THEN 1 WHEN ord BETWEEN 8 AND 11 THEN 2 ELSE 0 END AS depth_before FROM l) GROUP BY ALL""")
def code_nesting(spark, sf_dir):
    """How many lines of each file stand at which brace depth (text in comments masked)."""
    from deltaloom.functions import clang

    lines = project(spark, sf_dir).select(F.col("rel_path").alias("doc"), F.posexplode(F.split(clang.mask_udf("content"), "\n")).alias("ord", "text"))
    return sections.nesting(lines).groupBy(F.col("doc").alias("rel_path"), F.col("depth_before").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("SELECT concat('u', p_partkey, '.c') AS rel_path, CASE WHEN p_partkey % 13 = 4 THEN 'deleted' WHEN p_partkey % 17 = 5 THEN 'added' WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'modified' ELSE 'same' END AS change FROM part WHERE p_partkey % 13 <> 4 OR p_partkey % 17 <> 5")
def code_file_fingerprints(spark, sf_dir):
    """Files of two versions by their fingerprints."""
    sides = [incremental.file_fingerprints(project(spark, sf_dir, v).select(F.col("rel_path").alias("path"), F.lit(0).alias("mtime"), F.length("content").alias("size"), "content")) for v in ("old", "new")]
    return incremental.detect(*sides, ["path"], ["size", "content_hash"]).select(F.col("path").alias("rel_path"), "change")

"""Queries of symbol and function facts, lookups, decisions and state, on generated C files and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import code as code_ops, facts, incremental, planner, quality, terms, tickets
from deltaloom.plans.code import project
from deltaloom.plans.registry import query, table
from deltaloom.plans.session import materialise
from deltaloom.sources import readers


@query("SELECT kind, sum(k)::bigint AS n FROM part, (VALUES ('assignment', 4), ('if', 1), ('else', 1), ('call', 1), ('end_block', 2), ('return', 1)) t(kind, k) GROUP BY kind")
def logic_steps(spark, sf_dir):
    return facts.step_table(code_ops.function_table(project(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'local_value' AS symbol, pattern, count(*) AS n FROM part, (VALUES ('pointer_write'), ('return_flow')) t(pattern) GROUP BY pattern")
def symbol_sinks(spark, sf_dir):
    functions = code_ops.function_table(project(spark, sf_dir))
    steps = facts.step_table(functions).withColumnRenamed("rel_path", "key")
    symbols = functions.select(F.col("rel_path").alias("key"), F.lit("local_value").alias("symbol"))
    return facts.sink_patterns(steps, symbols).groupBy("symbol", "pattern").agg(F.count("*").alias("n"))


@query("SELECT symbol, role, count(*) AS n FROM part, (VALUES ('local_value', 'output_value'), ('local_value', 'return_value'), ('local_value', 'counter_value'), ('g_total', 'counter_value')) t(symbol, role) GROUP BY ALL")
def symbol_roles(spark, sf_dir):
    """Data-flow roles of two integers of every function."""
    functions = materialise(code_ops.function_table(project(spark, sf_dir)), "functions")
    steps = facts.step_table(functions).withColumnRenamed("rel_path", "key")
    symbols = functions.select(F.col("rel_path").alias("key"), F.explode(F.array(F.lit("local_value"), F.lit("g_total"))).alias("symbol"), F.lit("int").alias("type"))
    return facts.dataflow_roles(facts.symbol_evidence(steps, symbols)).groupBy("symbol", "role").agg(F.count("*").alias("n"))


@query("SELECT concat('u', p_partkey, '.c') AS key, concat('a > LIMIT_', p_partkey) AS conditions, '' AS members, 'local_value' AS returns, concat('f', p_partkey + 1) AS callees, 'a=input,out=input_output' AS parameters FROM part")
def function_records(spark, sf_dir):
    """Every function with its conditions, members, results, callees and parameters."""
    functions = materialise(code_ops.function_table(project(spark, sf_dir)), "functions")
    steps = facts.step_table(functions).withColumnRenamed("rel_path", "key")
    found = facts.function_records(steps, code_ops.parameter_table(functions).withColumnRenamed("rel_path", "key"))
    joined = F.array_join(F.transform("parameters", lambda p: F.concat(p["param"], F.lit("="), p["direction"])), ",")
    return found.select("key", *[F.array_join(c, ",").alias(c) for c in ("conditions", "members", "returns", "callees")], joined.alias("parameters"))


@query("SELECT concat('u', p_partkey, '.c') AS file_path, CASE WHEN p_partkey % 3 = 0 THEN concat('F', p_partkey) WHEN p_partkey % 3 = 1 THEN concat('f', p_partkey) ELSE 'nowhere' END AS func_name, CASE p_partkey % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'exact' ELSE 'missing' END AS match FROM part")
def retry_tasks(spark, sf_dir):
    functions = materialise(code_ops.function_table(project(spark, sf_dir)).select("rel_path", "name", "ord"), "functions")
    k = F.regexp_extract("rel_path", r"(\d+)", 1)
    name = F.when(k.cast("long") % 3 == 0, F.concat(F.lit("F"), k)).when(k.cast("long") % 3 == 1, F.concat(F.lit("f"), k)).otherwise("nowhere")
    failures = functions.select(F.col("rel_path").alias("file_path"), name.alias("func_name"))
    return facts.retry_tasks(failures, functions).select("file_path", "func_name", "match")


@query("""WITH a AS (SELECT o_orderkey AS ask_id, o_custkey AS cust, o_orderpriority AS prio FROM orders), r AS (SELECT min(o_orderkey) AS record_id, o_custkey AS cust, o_orderpriority AS prio FROM orders WHERE o_orderstatus = 'F' GROUP BY 2, 3),
e AS (SELECT ask_id, record_id, 0 AS step FROM a JOIN r USING (cust, prio)), u AS (SELECT cust, min(record_id) AS record_id FROM r GROUP BY cust HAVING count(*) = 1)
SELECT ask_id, record_id, step::int AS step FROM e UNION ALL SELECT ask_id, u.record_id, 1 FROM a JOIN u USING (cust) WHERE ask_id NOT IN (SELECT ask_id FROM e)""")
def fallback_lookup(spark, sf_dir):
    """Orders look up filled ones: same customer and priority, else the customer's only filled one."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask_id"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"), "o_orderstatus")
    records = rows.where("o_orderstatus = 'F'").groupBy("cust", "prio").agg(F.min("ask_id").alias("record_id"))
    return facts.lookup(rows.select("ask_id", "cust", "prio"), records, [["cust", "prio"], ["cust"]])


@query("""WITH f AS (SELECT n_regionkey AS module, concat('n', n_nationkey) AS name, n_name AS summary FROM nation WHERE length(n_name) % 3 <> 1), c AS (SELECT r_regionkey AS module, concat('n', n_nationkey) AS callee, n_nationkey AS ord FROM region, nation),
k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY ord, callee) AS rank FROM c), o AS (SELECT module, name AS callee, min(summary) AS own FROM f GROUP BY 1, 2), u AS (SELECT name AS callee, min(summary) AS only_ FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT module, callee, coalesce(own, only_, concat('calls ', callee)) AS summary, CASE WHEN own IS NOT NULL THEN 'module' WHEN only_ IS NOT NULL THEN 'project' ELSE 'stub' END AS source FROM k LEFT JOIN o USING (module, callee) LEFT JOIN u USING (callee) WHERE rank <= 6""")
def callee_summaries(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    known = nation.where("length(n_name) % 3 <> 1").select(F.col("n_regionkey").alias("module"), name.alias("name"), F.col("n_name").alias("summary"))
    calls = nation.select(name.alias("callee"), F.col("n_nationkey").alias("ord"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("module")).join(region.select(F.col("r_regionkey").alias("module")), "module").withColumn("caller", F.lit("main"))
    return facts.callee_summaries(known, calls).select("module", "callee", "summary", "source")


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 3 OR p_size < 15 OR p_partkey % 5 = 1 THEN 'fallback' ELSE 'first' END AS provider FROM part""")
def provider_choice(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = part.where("p_partkey % 5 <> 1").select(F.col("p_partkey").alias("key"), (F.col("p_size") / 50).alias("quality"), (F.col("p_partkey") % 7 == 3).alias("misses_structure"), F.lit("a").alias("payload"))
    back = part.select(F.col("p_partkey").alias("key"), F.lit(0.5).alias("quality"), F.lit(False).alias("misses_structure"), F.lit("b").alias("payload"))
    return facts.choose_provider(first, back).select("key", "provider")


@query("""WITH a AS (SELECT p_name AS ident, max(p_brand) AS cn FROM part GROUP BY 1), b AS (SELECT p_name AS ident, max(p_type) AS cn FROM part WHERE p_size > 25 GROUP BY 1) SELECT ident, coalesce(b.cn, a.cn) AS cn, CASE WHEN b.cn IS NULL THEN 0 ELSE 1 END::int AS rank FROM a LEFT JOIN b USING (ident)""")
def layered_dictionary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return facts.layered(part.select(F.col("p_name").alias("ident"), F.col("p_brand").alias("cn")), part.where("p_size > 25").select(F.col("p_name").alias("ident"), F.col("p_type").alias("cn")))


@query("""WITH r AS (SELECT p_name AS ident, CASE WHEN p_size > 40 THEN p_brand ELSE '' END AS cn, p_partkey AS ord FROM part) SELECT ident, arg_min(cn, ord) FILTER (WHERE cn <> '') AS cn, count(*) FILTER (WHERE cn <> '') > 0 AS translated FROM r GROUP BY ident""")
def first_definitions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("ident"), F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise("").alias("cn"), F.lit("macro").alias("kind"), F.col("p_partkey").alias("ord"))
    return facts.first_definitions(rows).select("ident", "cn", "translated")


@query("""SELECT o_custkey AS name, o_orderkey AS line, CASE WHEN o_orderstatus = 'O' THEN 'fresh' ELSE 'cached' END AS origin FROM orders WHERE o_orderstatus <> 'P'""")
def merged_lines(spark, sf_dir):
    """Orders as lines of customers: open ones changed, pending ones are gone."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("line"), "o_orderstatus")
    lines = rows.withColumn("logic", F.lit("x"))
    changed = rows.select("name", "line", F.when(F.col("o_orderstatus") == "O", "modified").when(F.col("o_orderstatus") == "P", "deleted").alias("change")).where("change is not null")
    return incremental.merge_lines(lines.select("name", "line", "logic"), lines.select("name", "line", "logic"), changed).select("name", "line", "origin")


@query("""WITH u AS (SELECT p_name AS symbol, count(DISTINCT p_brand) AS n FROM part GROUP BY 1), t AS (SELECT p_name AS symbol, min(p_type) AS cn, bool_or(p_size = 50) AS locked FROM part GROUP BY 1) SELECT symbol, cn, n AS n_files FROM t JOIN u USING (symbol) WHERE locked OR n >= 5""")
def consistency_constraints(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.col("p_name").alias("symbol")).agg(F.min("p_type").alias("cn"), F.bool_or(F.col("p_size") == 50).alias("locked"))
    return incremental.constraints(names, part.select(F.col("p_name").alias("symbol"), F.col("p_brand").alias("path")), 5)


@query("""SELECT coalesce(p_partkey, m) AS entry_id, CASE WHEN m IS NOT NULL THEN 'manual' ELSE 'found' END AS status, CASE WHEN m IS NOT NULL THEN 1.0 ELSE 0.92 END::double AS confidence FROM (SELECT p_partkey FROM part WHERE p_size < 40) FULL JOIN (SELECT p_partkey AS m FROM part WHERE p_size > 30) ON p_partkey = m""")
def manual_overrides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.where("p_size < 40").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("func_name"), F.lit("found").alias("status"), F.lit("a").alias("rel_path"), F.lit(0.92).alias("confidence"))
    manual = part.where("p_size > 30").select(F.col("p_partkey").alias("entry_id"), F.lit("b").alias("rel_path"))
    return planner.override(found, manual).select("entry_id", "status", "confidence")


@query("""WITH f AS (SELECT DISTINCT p_name AS rel_path FROM part), w AS (SELECT rel_path, row_number() OVER (ORDER BY rel_path DESC) AS ord FROM f WHERE rel_path < 'h') SELECT rel_path, row_number() OVER (ORDER BY w.ord IS NULL, w.ord, rel_path) AS position FROM f LEFT JOIN w USING (rel_path)""")
def ordered_files(spark, sf_dir):
    from pyspark.sql import Window

    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("rel_path")).distinct()
    wanted = files.where("rel_path < 'h'").withColumn("ord", F.row_number().over(Window.orderBy(F.desc("rel_path"))).cast("long"))
    return readers.ordered_files(files, wanted).select("rel_path", F.col("position").cast("long").alias("position"))


@query("""SELECT o_custkey AS item, o_orderkey AS ident, code FROM (SELECT o_custkey, o_orderkey, CASE WHEN c_custkey IS NULL THEN 'invented_symbol' WHEN c_acctbal < 0 AND o_orderstatus <> 'F' THEN 'locked_override' END AS code FROM orders LEFT JOIN customer ON c_custkey = o_orderkey % 2000) WHERE code IS NOT NULL""")
def candidate_validation(spark, sf_dir):
    """Orders suggest a status for a customer; unknown customers are invented, those in debt are locked at F."""
    orders = table(spark, sf_dir, "orders")
    made = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 2000).alias("ident"), F.col("o_orderstatus").alias("cn"))
    customer = table(spark, sf_dir, "customer")
    checked = quality.validate_candidates(made, customer.select(F.col("c_custkey").alias("ident")), customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("ident"), F.lit("F").alias("cn")))
    bad = checked.where("not accepted").select("item", F.explode("issues").alias("i"))
    return bad.join(made, "item").select(F.col("owner").alias("item"), F.col("item").alias("ident"), F.split("i", ":")[0].alias("code"))


@query("""SELECT l_partkey::varchar AS rel_path, array_to_string(list_sort(list_distinct(list(l_shipmode))), ',') AS headers, CASE WHEN bool_or(l_returnflag = 'R') THEN 'manual' ELSE 'review' END AS status FROM (SELECT l_partkey, l_returnflag, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def merged_impacts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("rel_path"), F.lit("f").alias("function_name"), F.lit("e").alias("entry_id"), F.array("l_linestatus").alias("headers"), F.when(F.col("l_returnflag") == "R", "manual").otherwise("review").alias("status"))
    return planner.merge_impacts(rows).select("rel_path", F.array_join("headers", ",").alias("headers"), "status")


@query("""WITH o AS (SELECT c_mktsegment AS ident, concat('n', c_nationkey) AS cn, 0.75::double AS confidence FROM customer WHERE c_acctbal < 0), n AS (SELECT c_mktsegment, concat('c', c_custkey), c_acctbal / 10000 FROM customer WHERE c_acctbal / 10000 >= 0.72 AND c_nationkey % 5 >= 2),
b AS (SELECT *, 0 AS k FROM o UNION ALL SELECT *, 1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY confidence DESC, k, cn) AS rank FROM b) SELECT ident, cn, confidence FROM r WHERE rank = 1""")
def memory_admission(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    old = customer.where("c_acctbal < 0").select(F.col("c_mktsegment").alias("ident"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("cn"), F.lit(0.75).alias("confidence"), F.lit(2).alias("n_kinds"))
    new = customer.select(F.col("c_mktsegment").alias("ident"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cn"), (F.col("c_acctbal") / 10000).alias("confidence"), (F.col("c_nationkey") % 5).alias("n_kinds"))
    return terms.admit(old, new).select("ident", "cn", "confidence")


@query("""WITH c AS (SELECT o_orderkey AS change_id, o_orderkey AS ord FROM orders), m AS (SELECT o_orderkey AS change_id, (o_orderkey * 7) % 1000003 AS seq FROM orders WHERE o_orderstatus = 'F') SELECT change_id, row_number() OVER (ORDER BY seq IS NULL, seq, ord) AS position FROM c LEFT JOIN m USING (change_id)""")
def ticket_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    made = orders.select(F.col("o_orderkey").alias("change_id"), F.col("o_orderkey").alias("ord"))
    matches = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("change_id"), (F.col("o_orderkey") * 7 % 1000003).alias("seq"), F.lit(1.0).alias("score"), F.lit("").alias("reason"))
    return tickets.ordered(made, matches).select("change_id", F.col("position").cast("long").alias("position"))


@query("""WITH s AS (SELECT user_id AS key, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE value > 50) AS h, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1)
SELECT key, round(least(0.98, 0.38 + least(0.18, 0.04 * n) + least(0.18, 0.06 * v) + least(0.10, 0.05 * h) + least(0.10, 0.04 * c)), 3)::double AS confidence FROM s""")
def concept_confidence(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("value") > 50).alias("h"), F.count_if(F.col("event_type") == "click").alias("c"))
    return per.select("key", terms.concept_confidence(F.col("n"), F.col("v"), F.col("h"), F.col("c")).alias("confidence"))

"""Queries on the star-schema, event and text tables: graphs, terms, tables, plans, quality, revisions, retrieval."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from deltaloom.functions import text
from deltaloom.operators import changes, graph, incremental, planner, quality, revise, sections, terms, tickets
from deltaloom.plans.registry import query, table

# region > nation > customer > order as caller -> callee
_EDGES = """edges AS (SELECT concat('r', n_regionkey) AS caller, concat('n', n_nationkey) AS callee, n_nationkey::bigint AS ord FROM nation
UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), c_custkey FROM customer
UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey), o_orderkey FROM orders)"""


def hierarchy(spark, sf_dir, orders: bool = True):
    """Edges (caller, callee, ord) from regions to nations to customers to orders."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("caller"), name("n", "n_nationkey").alias("callee"), F.col("n_nationkey").cast("long").alias("ord"))
    out = out.unionByName(table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("caller"), name("c", "c_custkey").alias("callee"), F.col("c_custkey").alias("ord")))
    return out.unionByName(table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("caller"), name("o", "o_orderkey").alias("callee"), F.col("o_orderkey").alias("ord"))) if orders else out


@query(f"WITH {_EDGES} SELECT DISTINCT caller AS node FROM edges WHERE caller NOT IN (SELECT callee FROM edges)")
def entry_nodes(spark, sf_dir):
    edges = hierarchy(spark, sf_dir)
    return graph.entry_nodes(edges.select(F.col("caller").alias("node")), edges)


@query(f"WITH {_EDGES} SELECT callee, count(DISTINCT caller) AS n_callers FROM edges GROUP BY callee")
def callers(spark, sf_dir):
    return hierarchy(spark, sf_dir).groupBy("callee").agg(F.count_distinct("caller").alias("n_callers"))


@query(f"WITH {_EDGES}, d AS (SELECT caller, callee, min(ord) AS o FROM edges GROUP BY 1, 2) SELECT caller, count(*) AS n, md5(string_agg(callee, ',' ORDER BY o, callee)) AS digest FROM d GROUP BY caller")
def callee_map(spark, sf_dir):
    found = graph.callee_map(hierarchy(spark, sf_dir))
    return found.select("caller", F.size("callees").cast("long").alias("n"), F.md5(F.array_join("callees", ",")).alias("digest"))


@query(f"WITH {_EDGES}, k AS (SELECT DISTINCT caller AS source, callee AS target, 'calls' AS kind FROM edges) SELECT source, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, target) AS rank FROM k) WHERE rank <= 15")
def neighbours(spark, sf_dir):
    edges = hierarchy(spark, sf_dir).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("kind"))
    return graph.neighbours(edges, ["calls"], 15).select("source", "target", F.col("rank").cast("long").alias("rank"))


@query("""SELECT concat('r', r_regionkey) AS level0, CASE WHEN n_nationkey IS NULL THEN '-' ELSE concat('n', n_nationkey) END AS level1, CASE WHEN c_custkey IS NULL THEN '-' ELSE concat('c', c_custkey) END AS level2,
CASE WHEN o_orderkey IS NULL THEN '-' ELSE concat('o', o_orderkey) END AS level3 FROM region JOIN (SELECT DISTINCT n_regionkey FROM nation) ON n_regionkey = r_regionkey LEFT JOIN nation n ON n.n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey""")
def call_tree_flat(spark, sf_dir):
    edges = hierarchy(spark, sf_dir)
    roots = edges.where("caller like 'r%'").select(F.col("caller").alias("node"))
    return graph.call_tree(roots, edges)


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT concat('o', o_orderkey) AS root FROM orders WHERE o_orderstatus = 'F'),
r(root, node, depth) AS (SELECT root, root, 0 FROM s UNION ALL SELECT root, e.caller, depth + 1 FROM r JOIN edges e ON e.callee = r.node WHERE depth < 2)
SELECT node, count(DISTINCT root) AS n_roots, min(depth)::int AS depth FROM r WHERE depth > 0 GROUP BY node""")
def impact_bfs(spark, sf_dir):
    """What stands within two steps above orders of status F."""
    edges = hierarchy(spark, sf_dir).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("kind"))
    changed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    found = graph.impact(changed, edges, 2).where("depth > 0")
    return found.groupBy("node").agg(F.count_distinct("root").alias("n_roots"), F.min("depth").alias("depth"))


_STEPS = "steps AS (SELECT DISTINCT event_type AS source, nxt AS target FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"


@query(f"WITH RECURSIVE {_STEPS}, r(root, node) AS (SELECT source, source FROM steps UNION SELECT target, target FROM steps UNION SELECT r.root, s.target FROM r JOIN steps s ON s.source = r.node) SELECT root, node FROM r")
def include_closure(spark, sf_dir):
    """Transitive closure of the event-type transition graph, cycles included."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(order).alias("target")).where("target is not null").distinct()
    nodes = steps.select(F.col("source").alias("node")).union(steps.select("target")).distinct()
    return graph.reach(nodes, steps).select("root", "node")


@query(f"""WITH {_EDGES}, n AS (SELECT node, min(rank) AS rank FROM (SELECT caller AS node, CASE left(caller, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS rank FROM edges UNION ALL SELECT callee, CASE left(callee, 1) WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END FROM edges) GROUP BY node),
k AS (SELECT node FROM n ORDER BY rank, node LIMIT 200) SELECT DISTINCT caller AS source, callee AS target FROM edges WHERE caller IN (SELECT node FROM k) AND callee IN (SELECT node FROM k)""")
def graph_overview(spark, sf_dir):
    """The first 200 nodes of the hierarchy, from the top, and the edges among them (a capped overview)."""
    edges = hierarchy(spark, sf_dir)
    level = F.instr(F.lit("rnco"), F.substring("node", 1, 1)) - 1
    nodes = edges.select(F.col("caller").alias("node")).union(edges.select("callee")).select("node", level.alias("ord"))
    _, inner = graph.overview(nodes, edges.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("kind")), 200)
    return inner.select("source", "target")


@query("SELECT concat('n', n_nationkey) AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def dependents(spark, sf_dir):
    """Nations whose customers changed (those in debt)."""
    customer = table(spark, sf_dir, "customer")
    edges = customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("caller"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("callee"))
    changed = customer.where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    return incremental.dependents(changed, edges)


_TERMS = "m AS (SELECT p_type AS symbol, p_brand AS variant FROM part WHERE trim(p_type) <> '' AND trim(p_brand) <> '')"
_REPORT = f"""{_TERMS}, r AS (SELECT symbol, count(DISTINCT variant) AS n_variants, count(DISTINCT replace(variant, 'Brand', '')) AS n_plain, count(*) AS n_places FROM m GROUP BY symbol),
b AS (SELECT symbol, variant, row_number() OVER (PARTITION BY symbol ORDER BY length(variant) DESC, variant) AS k FROM (SELECT DISTINCT symbol, variant FROM m)),
rep AS (SELECT r.symbol, n_variants, n_places, n_variants <= 1 OR n_plain <= 1 AS consistent, CASE WHEN NOT (n_variants <= 1 OR n_plain <= 1) THEN 'high' END AS severity, CASE WHEN NOT (n_variants <= 1 OR n_plain <= 1) THEN b.variant END AS suggestion FROM r JOIN b ON b.symbol = r.symbol AND b.k = 1)"""


def _part_terms(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return terms.mappings(parts.select(F.col("p_type").alias("symbol"), F.col("p_brand").alias("variant"), F.col("p_partkey").alias("place")))


@query(f"WITH {_REPORT} SELECT * FROM rep")
def term_consistency(spark, sf_dir):
    report = terms.consistency(_part_terms(spark, sf_dir), ["Brand"])
    return report.select("symbol", F.size("variants").cast("long").alias("n_variants"), "n_places", "consistent", "severity", "suggestion")


@query(f"WITH {_REPORT} SELECT count(*) AS total, sum(consistent::int)::bigint AS consistent, CASE WHEN count(*) > 0 THEN 100.0::double * sum(consistent::int) / count(*) ELSE 100.0 END::double AS score FROM rep")
def term_score(spark, sf_dir):
    return terms.consistency_score(terms.consistency(_part_terms(spark, sf_dir), ["Brand"]))


@query(f"WITH {_REPORT} SELECT symbol, suggestion AS suggested, 'rename' AS action FROM rep WHERE NOT consistent AND n_variants > 1")
def term_repair_patch(spark, sf_dir):
    return terms.repair_patch(terms.repair_hints(terms.consistency(_part_terms(spark, sf_dir), ["Brand"])))


@query("WITH c AS (SELECT p_type AS symbol, p_brand AS variant, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, f, variant) AS k FROM c) SELECT symbol, variant, n FROM r WHERE k = 1")
def dominant_translation(spark, sf_dir):
    return terms.dominant(table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol"), F.col("p_brand").alias("variant"), F.col("p_partkey").alias("ord")))


@query("""WITH o AS (SELECT concat('p', p_partkey) AS ident, p_name AS cn, CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'symbol_memory' ELSE 'rule_guess' END AS source, CASE p_size % 3 WHEN 0 THEN 95 WHEN 1 THEN 68 ELSE 42 END AS rank, 0.5::double AS confidence, p_size % 7 = 0 AS locked FROM part WHERE p_partkey % 5 <> 1),
n AS (SELECT concat('p', p_partkey) AS ident, p_type AS cn, CASE p_size % 2 WHEN 0 THEN 'symbol_dict' ELSE 'ai' END AS source, CASE p_size % 2 WHEN 0 THEN 92 ELSE 64 END AS rank, 0.6::double AS confidence FROM part WHERE p_partkey % 5 <> 2),
j AS (SELECT coalesce(o.ident, n.ident) AS ident, o.cn AS ocn, n.cn AS ncn, o.source AS os, n.source AS ns, o.confidence AS oc, n.confidence AS nc, coalesce(o.locked, false) AS locked, o.cn IS NOT NULL AS old, n.cn IS NOT NULL AS new, coalesce(o.cn <> n.cn, false) AS differs, o.rank > n.rank OR (o.rank = n.rank AND o.confidence > n.confidence) AS outranked FROM o FULL JOIN n ON o.ident = n.ident),
k AS (SELECT *, CASE WHEN NOT new THEN true WHEN NOT old THEN false ELSE locked OR (differs AND outranked) END AS keeps FROM j)
SELECT ident, CASE WHEN keeps THEN ocn ELSE ncn END AS cn, CASE WHEN keeps THEN os ELSE ns END AS source, CASE WHEN keeps THEN oc WHEN old AND new AND NOT differs THEN greatest(oc, nc) ELSE nc END AS confidence,
CASE WHEN NOT new THEN 'kept' WHEN NOT old THEN 'inserted' WHEN locked AND NOT differs THEN 'kept' WHEN keeps THEN 'kept_candidate' ELSE 'replaced' END AS action FROM k""")
def term_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("ident", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    old_source = F.when(F.col("p_size") % 3 == 0, "manual").when(F.col("p_size") % 3 == 1, "symbol_memory").otherwise("rule_guess")
    old = part.where("p_partkey % 5 <> 1").select("ident", F.col("p_name").alias("cn"), old_source.alias("source"), F.lit(0.5).alias("confidence"), (F.col("p_size") % 7 == 0).alias("locked"))
    new = part.where("p_partkey % 5 <> 2").select("ident", F.col("p_type").alias("cn"), F.when(F.col("p_size") % 2 == 0, "symbol_dict").otherwise("ai").alias("source"), F.lit(0.6).alias("confidence"), F.lit(False).alias("locked"))
    return terms.upsert(old, new).select("ident", "cn", "source", "confidence", "action")


@query("""WITH u AS (SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error') AS unknown, count(*) FILTER (WHERE value < 0.1) AS low, count(*) FILTER (WHERE event_type = 'view') AS seen FROM events GROUP BY user_id)
SELECT user_id, steps, greatest(0.0, least(100.0, round(100 - 30.0::double * unknown / steps - 20.0::double * low / steps - CASE WHEN seen > 0 THEN 0 ELSE 10 END, 1))) AS score FROM u""")
def quality_score(spark, sf_dir):
    """Users as functions, events as steps and variables."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("unknown"), F.count_if(F.col("value") < 0.1).alias("low"), F.count_if(F.col("event_type") == "view").alias("seen"))
    value = quality.score(F.col("steps"), F.col("unknown"), F.lit(0), F.col("steps"), F.col("low"), F.lit(0), F.lit(0), F.col("seen") > 0, F.lit(False))
    return per.select("user_id", "steps", value.alias("score"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value < 0.1) AS low, count(*) FILTER (WHERE value IS NULL) AS missing FROM events GROUP BY user_id)
SELECT user_id, code, message FROM (SELECT user_id, 'errors' AS code, concat('errors: ', errors) AS message, errors AS n FROM u UNION ALL SELECT user_id, 'low', concat('low values: ', low), low FROM u UNION ALL SELECT user_id, 'missing', concat('missing values: ', missing), missing FROM u) WHERE n > 0""")
def quality_issue_rows(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") < 0.1).alias("low"), F.count_if(F.col("value").isNull()).alias("missing"))
    return quality.issues(per, "user_id", {"errors": "errors", "low": "low values", "missing": "missing values"})


@query("""WITH k AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, sum(n)::bigint AS steps, sum(CASE WHEN kind = 'error' THEN n ELSE 0 END) AS unknown, string_agg(concat(kind, '=', n), ',' ORDER BY kind) AS kinds FROM k GROUP BY 1) SELECT user_id, steps, kinds FROM s""")
def step_summary(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.lit(1.0).alias("confidence"))
    found = quality.step_summary(steps, "user_id")
    return found.select("user_id", "steps", F.array_join(F.transform("kinds", lambda k: F.concat(k["kind"], F.lit("="), k["n"].cast("string"))), ",").alias("kinds"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error')::int, value DESC, event_id) AS k FROM events WHERE value IS NOT NULL) SELECT user_id, event_id FROM r WHERE k = 1")
def best_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("defects"))
    return quality.best_candidate(rows, "user_id", "defects", "value", "event_id").select("user_id", "event_id")


@query(r"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}', 0)) AS value FROM benchmark), d AS (SELECT DISTINCT doc_id AS item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}', 0)) AS value FROM documents WHERE text IS NOT NULL),
s AS (SELECT query_id, item_id, 2 + least(2, count(*) - 1) AS score FROM q JOIN d USING (value) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, score::bigint AS score, rank FROM r WHERE rank <= 6""")
def retrieve_topk(spark, sf_dir):
    """The six documents that share most long words with each benchmark item (top-k report)."""
    side = lambda df, key, name: df.where("text is not null").select(F.col(key).alias(name), F.lit("word").alias("feature"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("value"))
    found = terms.retrieve(side(table(spark, sf_dir, "benchmark"), "item_id", "query_id"), side(table(spark, sf_dir, "documents"), "doc_id", "item_id"), {"word": 2})
    return found.select("query_id", "item_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"WITH s AS (SELECT DISTINCT p_name AS name FROM part), r AS (SELECT name, row_number() OVER (ORDER BY lower(regexp_extract(name, '^([A-Za-z0-9]+)', 1)), name) AS k FROM s) SELECT name, ((k - 1) // 50)::bigint AS batch FROM r")
def symbol_batches(spark, sf_dir):
    return terms.batches(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "name")


@query("SELECT n_nationkey, concat('M', n_regionkey, '_', lpad(CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS varchar), 3, '0')) AS new_id FROM nation")
def module_renumber(spark, sf_dir):
    return sections.renumber(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey").select("n_nationkey", "new_id")


@query("""WITH o AS (SELECT p_name, concat_ws(chr(1), p_brand, p_type, p_size) AS d, count(*) AS a FROM part WHERE p_partkey % 11 <> 4 GROUP BY 1, 2), n AS (SELECT p_name, concat_ws(chr(1), p_brand, p_type, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END) AS d, count(*) AS b FROM part WHERE p_partkey % 11 <> 5 GROUP BY 1, 2),
j AS (SELECT coalesce(o.p_name, n.p_name) AS p_name, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM o FULL JOIN n ON o.p_name = n.p_name AND o.d = n.d),
k AS (SELECT p_name, sum(greatest(a - b, 0))::bigint AS gone, sum(greatest(b - a, 0))::bigint AS come, sum(a) AS na, sum(b) AS nb FROM j GROUP BY 1)
SELECT p_name, CASE WHEN na = 0 THEN 'added' WHEN nb = 0 THEN 'deleted' ELSE 'modified' END AS change, gone, come FROM k WHERE gone > 0 OR come > 0""")
def table_row_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    old = part.where("p_partkey % 11 <> 4")
    new = part.where("p_partkey % 11 <> 5").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return changes.table_rows_diff(old, new, "p_name", ["p_brand", "p_type", "p_size"])


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 11 <> 4), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 5)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'only_code' WHEN b.p_partkey IS NULL THEN 'only_doc' WHEN a.p_brand = b.p_brand AND a.p_size = b.p_size THEN 'same' ELSE 'conflict' END AS status FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def four_way_sync(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    code = part.where("p_partkey % 11 <> 5").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return changes.four_way(part.where("p_partkey % 11 <> 4"), code, "p_partkey", ["p_brand", "p_size"])


@query("""SELECT 'p_partkey' AS column_name, count(DISTINCT p_partkey) AS n_distinct, 0::bigint AS n_blank, count(DISTINCT p_partkey) = count(*) AS is_key FROM part UNION ALL
SELECT 'p_name', count(DISTINCT p_name), count(*) FILTER (WHERE coalesce(trim(p_name), '') = ''), count(DISTINCT p_name) = count(*) AND count(*) FILTER (WHERE coalesce(trim(p_name), '') = '') = 0 FROM part""")
def key_columns(spark, sf_dir):
    return changes.key_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_name"])


@query("""WITH f AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1), e AS (SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN f.n IS NULL THEN 'unmatched' WHEN f.n > 1 THEN 'ambiguous' ELSE 'matched_high' END AS status FROM e LEFT JOIN f ON f.name = e.p_name) GROUP BY status""")
def alignment_status(spark, sf_dir):
    """Line items as entries that name a part, parts as functions."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    entries = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entry_id"), F.col("name").alias("func_name"), F.lit("").alias("prototype"))
    code = part.select("name", F.lit("").alias("rel_path"), F.lit("").alias("signature"))
    return quality.status_summary(planner.align(entries, code))


@query("""WITH k AS (SELECT p_name AS function_name, count(*) AS n, min(p_partkey) AS e FROM part GROUP BY 1), c AS (SELECT l_orderkey * 10 + l_linenumber AS idx, CASE l_returnflag WHEN 'R' THEN 'deleted_function' WHEN 'A' THEN 'new_function' ELSE 'modified_function' END AS kind, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT action, status, count(*) AS n FROM (SELECT kind AS action, CASE WHEN kind = 'modified_function' AND n = 1 THEN 'safe' WHEN kind IN ('new_function', 'deleted_function') AND n <= 1 AND NOT (kind = 'deleted_function' AND n = 0) THEN 'review' ELSE 'manual' END AS status FROM c JOIN k ON function_name = p_name) GROUP BY 1, 2""")
def plan_items(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "R", "deleted_function").when(F.col("l_returnflag") == "A", "new_function").otherwise("modified_function")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), kind.alias("change_kind"), F.lit("").alias("rel_path"), F.col("name").alias("function_name"))
    plan = planner.classify(rows, part.select("name", F.col("p_partkey").cast("string").alias("entry_id")))
    return changes.change_summary(plan, "action", "status")


@query("""WITH b AS (SELECT o_orderkey AS key, md5(o_orderstatus) AS hash FROM orders), d AS (SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 100000000 ELSE 0 END AS key, md5(CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END) AS source_hash, o_orderpriority AS decision FROM orders)
SELECT state, decision, count(*) AS n FROM (SELECT decision, CASE WHEN b.hash IS NULL THEN 'unknown' WHEN b.hash <> source_hash THEN 'stale' ELSE 'applied' END AS state FROM d LEFT JOIN b USING (key)) GROUP BY 1, 2""")
def review_decisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    bundle = orders.select(F.col("o_orderkey").alias("key"), F.md5("o_orderstatus").alias("hash"))
    key = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 10 == 0, 100000000).otherwise(0)
    made = orders.select(key.alias("key"), F.md5(F.when(F.col("o_orderkey") % 10 == 1, "X").otherwise(F.col("o_orderstatus"))).alias("source_hash"), F.col("o_orderpriority").alias("decision"))
    return changes.change_summary(revise.decisions_on(bundle, made), "state", "decision")


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 1 END AS price, o_orderpriority AS note, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'draft' END AS status FROM orders""")
def workspace_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("status"))
    new = orders.select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") + 1).alias("price"))
    return revise.merge_workspace(old, new, "key", ["price"], ["note", "status"])


@query("""WITH p AS (SELECT 'all' AS pkey, 'color' AS field, 'grey' AS value, 0 AS ord UNION ALL SELECT p_brand, 'color', 'blue', 1 FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#3') UNION ALL SELECT DISTINCT p_name, 'shade', 'dark', 2 FROM part WHERE p_name < 'm')
SELECT id, field, value FROM (SELECT p_partkey AS id, field, value, row_number() OVER (PARTITION BY p_partkey, field ORDER BY l DESC, ord DESC) AS k FROM (SELECT p_partkey, 0 AS l, 'all' AS pkey FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_name FROM part) JOIN p USING (pkey)) WHERE k = 1""")
def patch_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name")
    patches = spark.createDataFrame([("all", "color", "grey", 0)], "pkey string, field string, value string, ord int")
    patches = patches.unionByName(part.where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("pkey"), F.lit("color").alias("field"), F.lit("blue").alias("value"), F.lit(1).alias("ord")).distinct())
    patches = patches.unionByName(part.where("p_name < 'm'").select(F.col("p_name").alias("pkey"), F.lit("shade").alias("field"), F.lit("dark").alias("value"), F.lit(2).alias("ord")).distinct())
    return revise.patches_for(part, patches, [F.lit("all"), F.col("p_brand"), F.col("p_name")])


@query("SELECT o_custkey AS customer, sha256(string_agg(concat(o_orderkey, '=', coalesce(o_orderstatus, '')), chr(10) ORDER BY concat(o_orderkey, '=', coalesce(o_orderstatus, '')))) AS digest FROM orders GROUP BY 1")
def bundle_fingerprints(spark, sf_dir):
    return revise.bundle_hash(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus"), "customer", "k", "o_orderstatus")


@query("WITH s AS (SELECT c_mktsegment AS source, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 9000) AS locked, count(*) FILTER (WHERE c_acctbal / 10000 < 0.6) AS low FROM customer GROUP BY 1) SELECT * FROM s")
def resolution_summary(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), (F.col("c_acctbal") > 9000).alias("locked"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return quality.resolution_summary(names)


@query("""SELECT ident, display, source, confidence FROM (SELECT concat('n', n_nationkey) AS ident, CASE WHEN n_regionkey = 0 THEN upper(n_name) WHEN n_regionkey < 3 THEN n_name ELSE concat('n', n_nationkey) END AS display, CASE WHEN n_regionkey = 0 THEN 'dictionary' WHEN n_regionkey < 3 THEN 'comment' ELSE 'raw' END AS source, CASE WHEN n_regionkey = 0 THEN 0.99 WHEN n_regionkey < 3 THEN 0.95 ELSE 0.2 END::double AS confidence FROM nation)""")
def name_resolution(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("ident", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    first = nation.where("n_regionkey = 0").select("ident", F.upper("n_name").alias("cn"))
    second = nation.where("n_regionkey < 3").select("ident", F.col("n_name").alias("cn"))
    return terms.resolve_names(nation, (first, "dictionary", 0.99), (second, "comment", 0.95))


@query(r"SELECT s_suppkey, lower(regexp_replace(s_name, '[#_]+', ' ', 'g')) AS words FROM supplier")
def identifier_words(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.regexp_replace("s_name", "[#_]+", " ")).alias("words"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) SELECT host, count(*) AS n, min(page_id) AS first_page FROM h GROUP BY host""")
def host_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    return pages.groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""WITH a AS (SELECT p_name AS k, p_partkey FROM part), u AS (SELECT k FROM a GROUP BY k HAVING count(*) = 1) SELECT p_partkey FROM a WHERE k IN (SELECT k FROM u)""")
def unique_part_names(spark, sf_dir):
    from deltaloom.operators.assign import unique_keys

    return unique_keys(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey")


@query("""WITH t AS (SELECT s_suppkey, concat(n_name, 'X') AS typed FROM supplier JOIN nation ON n_nationkey = s_nationkey), m AS (SELECT s_suppkey, n_nationkey, levenshtein(typed, n_name) AS d, greatest(length(typed), length(n_name)) AS g FROM t, nation),
b AS (SELECT *, min(d) OVER (PARTITION BY s_suppkey) AS l FROM m WHERE d <= 2 AND 1 - d::double / g >= 0.8), c AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS ties FROM b WHERE d = l) SELECT s_suppkey, n_nationkey AS nearest FROM c WHERE ties = 1""")
def bounded_edit_match(spark, sf_dir):
    """Suppliers' nation names with one letter more, matched back by bounded edit distance (ties match nothing)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    asked = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("n_name", F.lit("X")).alias("typed"))
    met = asked.join(F.broadcast(nation), F.levenshtein("typed", "n_name", 2) >= 0).withColumn("e", text.nearest_edit("typed", "n_name")).where("e.ratio >= 0.8")
    order = Window.partitionBy("s_suppkey")
    best = met.withColumn("least", F.min("e.distance").over(order)).where("e.distance = least").withColumn("ties", F.count("*").over(order)).where("ties = 1")
    return best.select("s_suppkey", F.col("n_nationkey").alias("nearest"))

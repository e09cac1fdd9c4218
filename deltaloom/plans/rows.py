"""Queries of small row operators: normalisers, look-ahead, gates, reports, indexes, table differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.functions import text
from deltaloom.operators import changes, graph, incremental, planner, quality, revise, sections
from deltaloom.plans.registry import query, table
from deltaloom.plans.relations import hierarchy
from deltaloom.plans.sqltext import VERSIONS, fold_title
from deltaloom.plans.versions import versions
from deltaloom.sources import readers, sinks

_IDENT = "CASE p_size % 4 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN concat('g_', p_name) WHEN 2 THEN concat(p_name, '_t') ELSE p_name END"


@query(rf"SELECT p_partkey, CASE WHEN regexp_matches(x, '^[A-Z][A-Z0-9_]*$') THEN 'macro' WHEN starts_with(x, 'g_') THEN 'global' WHEN x LIKE '%\_t' ESCAPE '\' THEN 'type' ELSE 'symbol' END AS kind FROM (SELECT p_partkey, trim({_IDENT}) AS x FROM part)")
def symbol_kinds(spark, sf_dir):
    name = F.when(F.col("p_size") % 4 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("g_"), "p_name")).when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit("_t"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.symbol_kind(name).alias("kind"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]') AS cjk FROM documents")
def cjk_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_cjk("text").alias("cjk"))


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE concat(p_name, '_', k) END AS unique_title FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_titles(spark, sf_dir):
    return sections.unique_titles(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "unique_title")


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING) AS next_purchase FROM events")
def look_ahead(spark, sf_dir):
    """The first purchase among the eleven events that follow each one."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.struct("ts", "event_id").alias("ord"), "event_id", "event_type")
    return sections.look_ahead(rows, F.col("event_type") == "purchase", F.col("event_id"), "next_purchase").select("event_id", "next_purchase")


@query("""WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS bad, bool_or(value > 90) AS a, bool_or(value < 1) AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY user_id)
SELECT user_id, coalesce(a::int, 0) + coalesce(b::int, 0) + coalesce(c::int, 0) AS kinds, bad > 0 OR coalesce(a::int, 0) + coalesce(b::int, 0) >= 2 AS rewrite FROM u""")
def evidence_votes(spark, sf_dir):
    """Kinds of evidence of each user, and whether the user's text would be written anew."""
    votes = [F.col(c) for c in "abc"]
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.bool_or(F.col("value") > 90).alias("a"), F.bool_or(F.col("value") < 1).alias("b"), F.bool_or(F.col("event_type") == "purchase").alias("c"))
    return per.select("user_id", quality.evidence_kinds(*votes).alias("kinds"), quality.needs_rewrite(F.col("bad"), votes[:2]).alias("rewrite"))


@query(f"WITH {VERSIONS} SELECT o.ord AS doc_id FROM old o JOIN new n ON o.ord = n.ord WHERE coalesce(o.title, '') <> coalesce(n.title, '') AND {fold_title('o.title')} <> {fold_title('n.title')}")
def title_edits(spark, sf_dir):
    """Titles that differ by more than foot-note marks (none of the simulated ones do)."""
    old, new = versions(spark, sf_dir)
    pairs = old.select("ord", F.col("title").alias("old_title")).join(new.select("ord", F.col("title").alias("new_title")), "ord")
    return changes.title_changes(pairs, "old_title", "new_title").select(F.col("ord").alias("doc_id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def resume_point(spark, sf_dir):
    """The last filled order (one row, by its meaning)."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return incremental.resume_point(done, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT 0::int AS part, 'digraph graph {' AS line UNION ALL SELECT 2, '}' UNION ALL SELECT DISTINCT 1, concat('  "r', n_regionkey, '" -> "n', n_nationkey, '";') FROM nation UNION ALL SELECT DISTINCT 1, concat('  "n', c_nationkey, '" -> "c', c_custkey, '";') FROM customer""")
def dot_lines(spark, sf_dir):
    edges = hierarchy(spark, sf_dir, orders=False).select(F.col("caller").alias("source"), F.col("callee").alias("target"))
    return graph.to_dot(edges).select("part", "line")


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END::int AS rank, concat('- ', CASE o_orderstatus WHEN 'F' THEN 'safe' WHEN 'O' THEN 'review' ELSE 'manual' END, ' edit ', o_orderkey, ': ', o_orderpriority) AS line FROM orders""")
def plan_lines(spark, sf_dir):
    """Orders as plan items, as lines of a report."""
    status = F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "review").otherwise("manual")
    items = table(spark, sf_dir, "orders").select(status.alias("status"), F.lit("edit").alias("action"), F.col("o_orderkey").cast("string").alias("function_name"), F.col("o_orderpriority").alias("reason"))
    return sinks.plan_report(items)


@query("""SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)::int AS rule_ord, o_orderpriority AS line, o_orderkey::varchar AS value FROM orders WHERE o_orderstatus = 'F'""")
def approved_rules(spark, sf_dir):
    """Filled orders as approved decisions of their customers."""
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open")
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), status.alias("status"), F.struct("o_orderpriority", "o_orderkey").alias("line"), F.col("o_orderkey").cast("string").alias("value"))
    return revise.approved_rules(made).select("doc", F.col("rule_ord").cast("int").alias("rule_ord"), F.col("line.o_orderpriority").alias("line"), "value")


@query("""SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), ''), nullif(trim(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE ' ' END), ''), '') AS name FROM orders""")
def picked_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("function_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(" ").alias("new_function_name"), F.lit(None).cast("string").alias("old_function_name"))
    return rows.select("o_orderkey", planner.pick_name().alias("name"))


@query(r"""SELECT conv_id, trim(string_agg(rtrim(concat(turn, chr(9), trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g')))), chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY conv_id""")
def table_texts(spark, sf_dir):
    """Turns as rows of a table, as text."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.array(x["turn"].cast("string"), x["role"])).alias("rows"))
    return rows.select("conv_id", text.cells_to_text("rows").alias("body"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1)::double AS percent FROM orders""")
def progress(spark, sf_dir):
    return quality.progress(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@query("""WITH l AS (SELECT r_regionkey AS doc, 0 AS ord, r_name AS title, r_name AS module, 1 AS lvl FROM region UNION ALL SELECT n_regionkey, 1 + n_nationkey, n_name, NULL, 2 FROM nation)
SELECT r_name AS module, n_name AS unit, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::bigint AS position FROM nation JOIN region ON r_regionkey = n_regionkey""")
def module_units(spark, sf_dir):
    """Nations as units under the heading of their region."""
    heads = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), F.lit(0).cast("long").alias("ord"), F.lit(1).alias("level"), F.col("r_name").alias("text"))
    units = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), (1 + F.col("n_nationkey")).cast("long").alias("ord"), F.lit(2).alias("level"), F.col("n_name").alias("text"))
    return sections.module_units(heads.unionByName(units)).select("module", "unit", F.col("position").cast("long").alias("position"))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderpriority AS v, count(*) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), n AS (SELECT o_custkey AS doc, o_orderpriority AS v, count(*) AS b FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2)
SELECT doc, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::bigint AS gone, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::bigint AS come FROM o FULL JOIN n USING (doc, v) GROUP BY doc HAVING gone > 0 OR come > 0""")
def keyless_rows(spark, sf_dir):
    """Customers' order priorities in two states, as tables without a key: rows ordered, so that the script keeps all that both have."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.struct("o_orderpriority", "o_orderkey").alias("ord"), F.col("o_orderpriority").alias("v"), "o_orderstatus")
    found = changes.sequence_rows_diff(rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus <> 'O'"), ["v"])
    return found.groupBy("doc").agg(F.sum(F.size("old_rows")).cast("long").alias("gone"), F.sum(F.size("new_rows")).cast("long").alias("come"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?s)<(?:h[1-4]|p|li)[^>]*>.*?</', 0)) AS raw FROM pages) SELECT page_id, count(*) AS n_blocks, count(*) FILTER (WHERE regexp_matches(raw, '^<h[1-4]')) AS n_heads FROM l GROUP BY page_id""")
def html_block_counts(spark, sf_dir):
    found = readers.html_blocks(table(spark, sf_dir, "pages"))
    return found.groupBy(F.col("doc").alias("page_id")).agg(F.count("*").alias("n_blocks"), F.count("level").alias("n_heads"))


@query(r"""SELECT doc_id, len(string_split_regex(text, '\r\n|\r|\n'))::bigint AS n_blocks FROM documents WHERE text IS NOT NULL""")
def text_block_counts(spark, sf_dir):
    return readers.text_blocks(table(spark, sf_dir, "documents")).groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_blocks"))

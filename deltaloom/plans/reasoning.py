"""Queries of rules, scopes, names, retrieval bounds and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import alignment, changes, facts, graph, retry, rules, sections, terms
from deltaloom.operators.ordering import number_rows
from deltaloom.plans.registry import query, table
from deltaloom.plans.sqltext import TITLE, VERSIONS, fold_title
from deltaloom.plans.versions import versions

#: Statements made of a part's key and size; residues of 14 tell the shape.
STATEMENTS = (
    "speed_@ == NULL", "LIMIT_@ < speed_@", "speed_@ >= @", "0x@ != flag_@", "memset(&buf_@, 0, 8)", "memset((u8)buf_@, 0xFF, 8);", "memcpy(dst_@, src_@, 4);", "flag_@ = TRUE;", "count_@ = 0u;", "return E_OK;", "return NULL",
    "return @;", "state_@ = next_@ + 1;", "a_@ && b_@",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _elements_sql() -> str:
    listed = ", ".join(_quoted(s) for s in STATEMENTS)
    rows = [(k, at, p, v, to_p, to_v, len(c)) for k, (to_p, to_v, c) in enumerate(rules.element_rules()) for at, (p, v) in enumerate(c)]
    conditions = ", ".join(f"({k}, {at}, {_quoted(p)}, {'NULL' if v is None else _quoted(v)}, {_quoted(to_p)}, {_quoted(to_v)}, {n})" for k, at, p, v, to_p, to_v, n in rows)
    grab = lambda pattern, n: f"regexp_extract(code, {_quoted(pattern)}, {n})"
    has = lambda pattern: f"regexp_matches(code, {_quoted(pattern)})"
    return rf"""
WITH RECURSIVE s AS (SELECT p_partkey AS id, replace([{listed}][1 + p_partkey % {len(STATEMENTS)}], '@', p_size::varchar) AS code FROM part),
x AS (SELECT id, code, {has(rules.CONDITION)} AS compared, {has(rules.RETURN)} AS returns, {grab(rules.CONDITION, 1)} AS l, {grab(rules.CONDITION, 2)} AS op, {grab(rules.CONDITION, 3)} AS r,
      CASE WHEN {has(rules.MEMSET)} THEN 'fill' WHEN {has(rules.MEMCPY)} THEN 'copy' WHEN {has(rules.ASSIGN)} THEN 'assign' END AS call,
      CASE WHEN {has(rules.MEMSET)} THEN {grab(rules.MEMSET, 1)} WHEN {has(rules.MEMCPY)} THEN {grab(rules.MEMCPY, 1)} ELSE {grab(rules.ASSIGN, 1)} END AS target,
      CASE WHEN {has(rules.MEMSET)} THEN {grab(rules.MEMSET, 2)} WHEN {has(rules.MEMCPY)} THEN {grab(rules.MEMCPY, 2)} ELSE {grab(rules.ASSIGN, 2)} END AS val FROM s),
y AS (SELECT *, regexp_matches(l, '{rules.CONSTANT}') AND NOT regexp_matches(r, '{rules.CONSTANT}') AS swapped, call IS NOT NULL AND NOT returns AS acts FROM x),
base(id, p, v) AS (
  SELECT id, 'op', op FROM y WHERE compared UNION ALL SELECT id, 'swapped', CASE WHEN swapped THEN 'yes' ELSE 'no' END FROM y WHERE compared
  UNION ALL SELECT id, 'left', CASE WHEN swapped THEN r ELSE l END FROM y WHERE compared UNION ALL SELECT id, 'right', CASE WHEN swapped THEN l ELSE r END FROM y WHERE compared
  UNION ALL SELECT id, 'call', call FROM y WHERE acts UNION ALL SELECT id, 'zero', CASE WHEN regexp_matches(val, '{rules.ZERO}') THEN 'yes' ELSE 'no' END FROM y WHERE acts
  UNION ALL SELECT id, 'truth', CASE WHEN val IN ('TRUE', 'true', '1', '0x1') THEN 'true' ELSE 'false' END FROM y WHERE acts AND val IN ('TRUE', 'true', '1', '0x1', 'FALSE', 'false')
  UNION ALL SELECT id, 'target', target FROM y WHERE acts UNION ALL SELECT id, 'value', val FROM y WHERE acts
  UNION ALL SELECT id, 'returns', {grab(rules.RETURN, 1)} FROM y WHERE returns),
rule(k, i, p, v, to_p, to_v, n) AS (VALUES {conditions}),
chain(step, id, facts) AS (
  SELECT 0, id, list_distinct(list(struct_pack(p := p, v := v))) FROM base GROUP BY id
  UNION ALL
  SELECT step + 1, id, facts FROM (
    SELECT c.step, c.id, list_concat(any_value(c.facts), list(DISTINCT struct_pack(p := h.to_p, v := h.to_v))) AS facts
    FROM chain c JOIN (SELECT step, id, k, to_p, to_v, n FROM (SELECT DISTINCT d.step, d.id, r.k, r.i, r.to_p, r.to_v, r.n FROM (SELECT step, id, unnest(facts) AS f FROM chain) d JOIN rule r ON r.p = d.f.p AND (r.v IS NULL OR r.v = d.f.v)) GROUP BY ALL HAVING count(*) = n) h ON h.id = c.id AND h.step = c.step
    WHERE NOT list_contains(c.facts, struct_pack(p := h.to_p, v := h.to_v)) GROUP BY c.step, c.id)),
facts AS (SELECT id, unnest(arg_max(facts, step)) AS f FROM chain GROUP BY id),
wide AS (SELECT id, {', '.join(f"max(CASE WHEN f.p = '{p}' THEN f.v END) AS {p}_" for p in ('element', 'relation', 'action', 'label', 'left', 'right', 'target', 'value', 'check', 'effect', 'outcome', 'branch', 'state'))} FROM facts GROUP BY id)
SELECT id, element_ AS element, coalesce(relation_, action_, label_) AS meaning, coalesce(left_, target_) AS subject, coalesce(right_, CASE WHEN action_ IN ('copy', 'fill') THEN value_ END) AS object, check_ AS "check", effect_ AS effect, outcome_ AS outcome, branch_ AS branch, state_ AS state
FROM wide WHERE element_ IS NOT NULL"""


@query(_elements_sql())
def semantic_elements(spark, sf_dir):
    """Conditions, actions and returns by forward chaining of rule rows."""
    shape = F.get(F.array(*map(F.lit, STATEMENTS)), (F.col("p_partkey") % len(STATEMENTS)).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(shape, F.lit("@"), F.col("p_size").cast("string")).alias("code"))
    return rules.elements(rows, "id", "code")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
rule AS (SELECT word, row_number() OVER (ORDER BY reverse(word), word) AS priority, ['any', 'first', 'last'][1 + length(word) % 3] AS place, upper(word) AS label FROM w),
t AS (SELECT p_partkey AS id, len(string_split(p_name, ' ')) AS n, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)
SELECT id, arg_min(label, priority) AS label, min(priority) AS priority FROM t JOIN rule USING (word) WHERE place = 'any' OR (place = 'first' AND i = 0) OR (place = 'last' AND i = n - 1) GROUP BY id""")
def ordered_rules(spark, sf_dir):
    """The first of an ordered list of rules, one for each word of the part names, that holds for a part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"))
    words = parts.select(F.explode("words").alias("word")).distinct()
    numbered = number_rows(words, [F.reverse("word"), F.col("word")], "priority")
    place = F.get(F.array(F.lit("any"), F.lit("first"), F.lit("last")), F.length("word") % 3)
    return rules.first_match(parts, "id", F.col("words"), numbered.select("priority", place.alias("place"), "word", F.upper("word").alias("label")))


@query("""WITH e AS (SELECT string_split(p_name, ' ')[1] AS token, p_type AS text, p_brand AS file, left(p_brand, 7) AS module, p_size % 5 AS family FROM part WHERE p_partkey % 3 <> 0),
a AS (SELECT p_partkey AS ask, string_split(p_name, ' ')[1] AS token, p_brand AS file, left(p_brand, 7) AS module, p_size % 5 AS family FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT token, 0 AS level, file AS place, text, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT token, 1, module, text, count(*) FROM e GROUP BY ALL UNION ALL SELECT token, 2, family::varchar, text, count(*) FROM e GROUP BY ALL UNION ALL SELECT token, 3, '', text, count(*) FROM e GROUP BY ALL),
t AS (SELECT token, level, place, sum(n)::bigint AS support, arg_min(text, struct_pack(a := -n, b := -length(text), c := text)) AS concept FROM c GROUP BY ALL),
m AS (SELECT ask, a.token, level, support, concept FROM a JOIN t ON t.token = a.token AND ((level = 0 AND place = file) OR (level = 1 AND place = module) OR (level = 2 AND place = family::varchar) OR level = 3)),
b AS (SELECT ask, token, min(level) FILTER (support >= 2 OR level = 3) AS level, coalesce(max(support) FILTER (level = 0), 0) AS s0, coalesce(max(support) FILTER (level = 1), 0) AS s1, coalesce(max(support) FILTER (level = 2), 0) AS s2, coalesce(max(support) FILTER (level = 3), 0) AS n_evidence FROM m GROUP BY ALL)
SELECT b.ask, b.token, concept, b.level, support, n_evidence, round(least(0.98, 0.38 + least(0.18, 0.04 * n_evidence) + least(0.18, 0.06 * greatest(0, s1 - s0)) + least(0.10, 0.05 * s0) + least(0.10, 0.04 * greatest(0, s2 - s1))), 3)::double AS confidence FROM b JOIN m USING (ask, token, level)""")
def scoped_concepts(spark, sf_dir):
    """What the first word of a part's name means, from the nearest of brand, maker and size class that has two rows of evidence."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ask"), F.get(F.split("p_name", " "), F.lit(0)).alias("token"), F.col("p_type").alias("text"), F.col("p_brand").alias("file"), F.substring("p_brand", 1, 7).alias("module"), (F.col("p_size") % 5).alias("family"))
    return terms.scoped_concepts(parts.where("ask % 3 <> 0"), parts.where("ask % 3 = 0").drop("text"), least=2)


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN concat(p_brand, '_', 2 + p_size % 9) ELSE p_brand END AS title FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS nth FROM r),
free AS (SELECT title, n, row_number() OVER (PARTITION BY title ORDER BY n) AS k FROM (SELECT title, unnest(range(2, 40 + c)) AS n FROM (SELECT title, count(*) AS c FROM r GROUP BY title)) x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.title = concat(x.title, '_', x.n)))
SELECT id, CASE WHEN nth = 1 THEN f.title ELSE concat(f.title, '_', n) END AS unique_title FROM f LEFT JOIN free ON free.title = f.title AND free.k = nth - 1""")
def unique_titles_taken(spark, sf_dir):
    """Brands told apart by numbers, where some rows carry such numbers already."""
    parts = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 4 == 1, F.concat("p_brand", F.lit("_"), (2 + F.col("p_size") % 9).cast("string"))).otherwise(F.col("p_brand"))
    return sections.unique_titles(parts.select(F.col("p_partkey").alias("id"), title.alias("title")), "title", "id").select("id", "unique_title")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), e AS (SELECT DISTINCT o_custkey AS a, (o_orderkey * 7919) % n AS b FROM orders, n WHERE o_orderkey % 9 = 0),
v AS (SELECT a AS v FROM e UNION SELECT b FROM e), r(root, node) AS (SELECT v, v FROM v UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT x.root AS node, max(x.node) AS component FROM r x JOIN r y ON y.root = x.node AND y.node = x.root GROUP BY x.root)
SELECT node, component, n_reached FROM c JOIN (SELECT root AS node, count(*) AS n_reached FROM r GROUP BY root) USING (node)""")
def cyclic_reach(spark, sf_dir):
    """Components of a cyclic graph of customers, and how many customers each reaches, counted on component sets."""
    n = table(spark, sf_dir, "customer").count()
    edges = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("source"), ((F.col("o_orderkey") * 7919) % n).alias("target"))
    return graph.reach_sizes(edges)


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS key, 1 AS n, 'c1' AS candidate, ((p_partkey * 7 + 13) % 50)::double AS score, greatest(0, p_partkey % 5 - p_partkey % 3)::bigint AS defects, 1 AS round, true AS better FROM part
UNION ALL SELECT key, n, CASE WHEN b THEN concat('c', n) ELSE candidate END, CASE WHEN b THEN s ELSE score END, CASE WHEN b THEN d ELSE defects END, CASE WHEN b THEN n ELSE round END, b
 FROM (SELECT *, d < defects OR (d = defects AND s > score) AS b FROM (SELECT key, n + 1 AS n, candidate, score, defects, round, ((key * 7 + (n + 1) * 13) % 50)::double AS s, greatest(0, key % 5 - (n + 1) * (key % 3))::bigint AS d FROM t WHERE n < 3 AND defects > 0 AND better))),
e AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
SELECT key, CASE WHEN defects > 0 AND key % 2 = 0 THEN 'base' ELSE candidate END AS candidate, score, defects, round, CASE WHEN defects > 0 AND key % 2 = 0 THEN 'baseline' WHEN defects = 0 THEN 'accepted' WHEN NOT better THEN 'stalled' ELSE 'exhausted' END AS reason FROM e""")
def retry_outcomes(spark, sf_dir):
    """Rounds of attempts for every part: keys leave at different rounds, and even ones have a baseline."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))

    def attempt(rows, n):
        return rows.select("key", F.lit(f"c{n}").alias("candidate"), ((F.col("key") * 7 + n * 13) % 50).alias("score"), F.greatest(F.lit(0), F.col("key") % 5 - n * (F.col("key") % 3)).alias("defects"))

    return retry.retry_rounds(parts, "key", attempt, baseline=parts.where("key % 2 = 0").withColumn("candidate", F.lit("base")))


@query("""WITH l AS (SELECT l_linestatus AS seq, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT seq, CASE WHEN ord % 11 = 3 THEN 'insert' WHEN ord % 11 = 7 THEN 'delete' ELSE 'equal' END AS tag, CASE WHEN ord % 11 <> 3 THEN ord END AS old_ord, CASE WHEN ord % 11 <> 7 THEN ord + 1 END AS new_ord FROM l""")
def long_alignment(spark, sf_dir):
    """All lines of a status as one sequence, in two versions that miss different lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    value = F.concat(F.lit("line "), F.col("ord").cast("string"))
    old, new = lines.where("ord % 11 <> 3").withColumn("value", value), lines.where("ord % 11 <> 7").withColumn("value", value).withColumn("ord", F.col("ord") + 1)
    return alignment.align(old, new, "seq", "ord", "value")


_TAGS = ", ".join(f"('{w}', '{t}')" for w, t in facts.ARGUMENT_TAGS)
_CALLS = ("x_@ = StateGet(LEFT_@, level_@);", "x_@ = ResultGet(riu_@);", "x_@ = Other(a_@, b_@, c_@);", "x_@ == Other(LEFT_1);")
_PARAMETERS = (("StateGet", 0, "side", "input"), ("StateGet", 1, "fault_level", "input"), ("Other", 0, "plain", "input"), ("Other", 1, "_r_side", "input_output"))


@query(rf"""WITH l AS (SELECT p_partkey AS key, concat('x_', p_size) AS symbol, replace([{', '.join(_quoted(c) for c in _CALLS)}][1 + p_partkey % 4], '@', p_size::varchar) AS text FROM part),
c AS (SELECT key, symbol, regexp_extract(text, '= ([A-Za-z]+)\(', 1) AS callee, string_split(regexp_extract(text, '\((.*)\)', 1), ', ') AS args FROM l WHERE NOT contains(text, '==')),
b AS (SELECT key, symbol, callee, unnest(range(len(args))) AS position, unnest(args) AS argument FROM c),
p(callee, position, parameter, direction) AS (VALUES {', '.join(f"('{c}', {k}, '{n}', '{d}')" for c, k, n, d in _PARAMETERS)}),
t(word, tag) AS (VALUES {_TAGS}), u(word, tag) AS (VALUES {', '.join(f"('{w}', '{t}')" for w, t in facts.CALL_TAGS)}),
j AS (SELECT b.*, parameter FROM b LEFT JOIN p ON p.callee = b.callee AND p.position = b.position)
SELECT DISTINCT key, symbol, tag FROM (SELECT key, symbol, tag FROM j, t WHERE contains(upper(argument), word) OR contains(upper(coalesce(parameter, '')), word) UNION ALL SELECT key, symbol, tag FROM j, u WHERE contains(upper(callee), word))""")
def argument_tags(spark, sf_dir):
    """Tags of symbols by the calls that produce them: arguments bound to the parameters of the called functions."""
    shape = F.get(F.array(*map(F.lit, _CALLS)), (F.col("p_partkey") % 4).cast("int"))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(1).alias("ord"), F.replace(shape, F.lit("@"), F.col("p_size").cast("string")).alias("text"), F.concat(F.lit("x_"), F.col("p_size").cast("string")).alias("symbol"))
    calls = facts.producing_calls(lines.drop("symbol"), lines.select("key", "symbol"))
    known = spark.createDataFrame(list(_PARAMETERS), "callee string, position int, parameter string, direction string")
    return facts.argument_tags(facts.bind_arguments(calls, known))


@query("""WITH s AS (SELECT o_custkey AS key, min(o_orderkey) AS ord, concat(['', 'l_', 's_', 'l_s_'][1 + o_orderkey % 4], 'v', o_orderkey % 3) AS symbol FROM orders GROUP BY 1, 3),
m AS (SELECT a.key, a.symbol, b.symbol AS other, row_number() OVER (PARTITION BY a.key, a.symbol ORDER BY b.ord, b.symbol) AS r FROM s a JOIN s b ON a.key = b.key AND a.symbol <> b.symbol AND regexp_replace(a.symbol, '^(?:l_s_|l_|s_)', '') = regexp_replace(b.symbol, '^(?:l_s_|l_|s_)', ''))
SELECT key, symbol, string_agg(other, ',' ORDER BY r) AS pairs FROM m WHERE r <= 4 GROUP BY 1, 2""")
def paired_symbols(spark, sf_dir):
    """Symbols of a customer's orders that differ by a storage prefix only."""
    prefix = F.get(F.array(*map(F.lit, ("", "l_", "s_", "l_s_"))), (F.col("o_orderkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.concat(prefix, F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("symbol"))
    return facts.paired_symbols(rows).select("key", "symbol", F.array_join("pairs", ",").alias("pairs"))


@query(f"WITH {VERSIONS}, k AS (SELECT ord, did, concat(title, ' ', ord % 500) AS key FROM old) SELECT ord, did AS document_id, count(*) OVER (PARTITION BY key) > 1 AS duplicate_key, count(*) OVER (PARTITION BY did) > 1 AS duplicate_id FROM k")
def section_diagnostic(spark, sf_dir):
    """Sections of the old version whose key or document number is not their own."""
    old, _ = versions(spark, sf_dir)
    rows = old.select("ord", "title", F.concat("title", F.lit(" "), (F.col("ord") % 500).cast("string")).alias("key"))
    return sections.diagnostic(rows).select("ord", "document_id", "duplicate_key", "duplicate_id")


_RENAMED = f"CASE doc_id % 11 WHEN 4 THEN concat({TITLE}, ' bis') WHEN 5 THEN concat({TITLE}, '12') WHEN 6 THEN replace({TITLE}, ' ', '  ') WHEN 7 THEN NULL ELSE {TITLE} END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {TITLE} AS a, {_RENAMED} AS b FROM documents) WHERE coalesce(a, '') <> coalesce(b, '') AND {fold_title('a')} <> {fold_title('b')}")
def title_rewrites(spark, sf_dir):
    """Titles that really change, among titles that get a foot-note mark, more white space, or nothing."""
    docs = table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id") % 19 == 7, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    docs = docs.withColumn("a", F.concat(F.lit("Doc "), "lang", F.lit(" (SDD-"), "source", F.lit("-"), number.cast("string"), F.lit(")")))
    kind = F.col("doc_id") % 11
    renamed = F.when(kind == 4, F.concat("a", F.lit(" bis"))).when(kind == 5, F.concat("a", F.lit("12"))).when(kind == 6, F.replace("a", F.lit(" "), F.lit("  "))).when(kind == 7, None).otherwise(F.col("a"))
    return changes.title_changes(docs.withColumn("b", renamed), "a", "b").select("doc_id")


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_quantity)::int AS q FROM lineitem GROUP BY 1, 2),
o AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN '' ELSE n::varchar END AS a, CASE WHEN doc % 3 = 0 THEN 'same' ELSE q::varchar END AS b FROM l WHERE doc % 7 <> 1 AND n <> 3),
m0 AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN '' ELSE n::varchar END AS a, CASE WHEN doc % 3 = 0 THEN 'same' WHEN n = 2 THEN (q + 1)::varchar ELSE q::varchar END AS b FROM l WHERE doc % 7 <> 2 AND n <> CASE WHEN doc % 3 = 0 THEN 3 ELSE 4 END),
m AS (SELECT * FROM m0 UNION ALL SELECT DISTINCT doc, '', 'more' FROM m0 WHERE doc % 3 = 0),
d AS (SELECT doc FROM o INTERSECT SELECT doc FROM m),
k AS (SELECT coalesce(x.doc, y.doc) AS doc, coalesce(x.a, y.a) AS row_key, concat(x.a, chr(9), x.b) AS old_row, concat(y.a, chr(9), y.b) AS new_row, x.doc IS NULL AS came, y.doc IS NULL AS went FROM (SELECT * FROM o WHERE doc % 3 <> 0 AND doc IN (FROM d)) x FULL JOIN (SELECT * FROM m WHERE doc % 3 <> 0 AND doc IN (FROM d)) y ON x.doc = y.doc AND x.a = y.a)
SELECT doc, 'key' AS way, CASE WHEN came THEN 'added' WHEN went THEN 'deleted' ELSE 'modified' END AS change, row_key, CASE WHEN NOT came THEN old_row END AS old_row, CASE WHEN NOT went THEN new_row END AS new_row FROM k WHERE came OR went OR old_row <> new_row
UNION ALL SELECT doc, CASE WHEN count(*) = 1 THEN 'key' ELSE 'sequence' END, 'added', CASE WHEN count(*) = 1 THEN 'more' END, NULL, concat('', chr(9), 'more') FROM o WHERE doc % 3 = 0 AND doc IN (FROM d) GROUP BY doc
UNION ALL SELECT doc, 'all', 'deleted', NULL, concat(a, chr(9), b), NULL FROM o WHERE doc NOT IN (FROM d)
UNION ALL SELECT doc, 'all', 'added', NULL, NULL, concat(a, chr(9), b) FROM m WHERE doc NOT IN (FROM d)""")
def table_ladder(spark, sf_dir):
    """Changed rows of every order's table of lines: by its key, by sequence where no column is a key, or whole where one side lacks it."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.min("l_quantity").cast("int").alias("q"))
    plain = F.col("doc") % 3 == 0
    shaped = lambda rows: rows.select("doc", "ord", F.when(plain, "").otherwise(F.col("ord").cast("string")).alias("n"), F.when(plain, "same").otherwise(F.col("q").cast("string")).alias("q"))
    old = shaped(lines.where("doc % 7 <> 1 AND ord <> 3"))
    new = lines.where("doc % 7 <> 2").where(F.when(plain, F.col("ord") != 3).otherwise(F.col("ord") != 4))
    new = shaped(new.withColumn("q", F.when(F.col("ord") == 2, F.col("q") + 1).otherwise(F.col("q"))))
    more = new.where(plain).select("doc").distinct().select("doc", F.lit(99).alias("ord"), F.lit("").alias("n"), F.lit("more").alias("q"))
    return changes.table_changes(old, new.unionByName(more), ["n", "q"])

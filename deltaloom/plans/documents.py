"""Queries on documents, pages and conversations: versions, pairing, segments, normalisers, fingerprints."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from deltaloom.functions import text
from deltaloom.operators import assign, changes, incremental, pairing, planner, revise, sections, tickets
from deltaloom.plans.registry import query, table
from deltaloom.plans.session import spread
from deltaloom.plans.sqltext import NUMBER, TITLE, VERSIONS, fold_text, fold_title
from deltaloom.plans.versions import versions

_DETAIL = f"""WITH {VERSIONS},
both_ AS (SELECT coalesce(o.ord, n.ord) AS ord, o.ord AS a, n.ord AS b, o.title AS ot, n.title AS nt, {fold_text('o.body')} AS fo, {fold_text('n.body')} AS fn,
          length(o.body) AS old_chars, length(n.body) AS new_chars FROM old o FULL JOIN new n ON o.ord = n.ord),
c AS (SELECT *, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' WHEN fo <> fn THEN 'modified' ELSE 'same' END AS change FROM both_)"""


@query(f"{_DETAIL} SELECT change, count(*) AS n FROM c GROUP BY change")
def doc_changes_by_type(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return changes.change_summary(changes.version_changes(old, new, "ord", "body"), "change")


@query(f"{_DETAIL} SELECT ord AS doc_id, change, old_chars, new_chars FROM c WHERE change <> 'same'")
def doc_changes_detail(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    found = changes.version_changes(old, new, "ord", "body").where("change <> 'same'")
    return found.select(F.col("ord").alias("doc_id"), "change", F.length("old_body").cast("long").alias("old_chars"), F.length("new_body").cast("long").alias("new_chars"))


@query(f"WITH {VERSIONS} SELECT o.ord AS doc_id, o.body <> n.body AS body_noise, o.title <> n.title AS title_noise FROM old o JOIN new n ON o.ord = n.ord WHERE (o.body <> n.body AND {fold_text('o.body')} = {fold_text('n.body')}) OR (o.title <> n.title AND {fold_title('o.title')} = {fold_title('n.title')})")
def noise_only_edits(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    both = old.alias("o").join(new.alias("n"), "ord")
    body, title = F.col("o.body") != F.col("n.body"), F.col("o.title") != F.col("n.title")
    noise = (body & ~changes.differs(F.col("o.body"), F.col("n.body"))) | (title & (text.fold_title("o.title") == text.fold_title("n.title")))
    return both.where(noise).select(F.col("ord").alias("doc_id"), body.alias("body_noise"), title.alias("title_noise"))


@query("SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_keys_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_PAIR = f"""WITH {VERSIONS},
o1 AS (SELECT *, {fold_title('title')} AS leaf, count(*) OVER (PARTITION BY did) AS c FROM old),
n1 AS (SELECT *, {fold_title('title')} AS leaf, count(*) OVER (PARTITION BY did) AS c FROM new),
uid AS (SELECT o1.ord AS a, n1.ord AS b FROM o1 JOIN n1 USING (did) WHERE o1.c = 1 AND n1.c = 1),
o2 AS (SELECT *, count(*) OVER (PARTITION BY did, leaf) AS k FROM o1 WHERE ord NOT IN (SELECT a FROM uid)),
n2 AS (SELECT *, count(*) OVER (PARTITION BY did, leaf) AS k FROM n1 WHERE ord NOT IN (SELECT b FROM uid)),
uidt AS (SELECT o2.ord AS a, n2.ord AS b FROM o2 JOIN n2 USING (did, leaf) WHERE o2.k = 1 AND n2.k = 1),
fk AS (SELECT 1),
o3 AS (SELECT ord, concat(split_part(key, ' > ', 1), ' > ', split_part(key, ' > ', 2), ' > ', leaf) AS fk, count(*) OVER (PARTITION BY concat(split_part(key, ' > ', 1), ' > ', split_part(key, ' > ', 2), ' > ', leaf)) AS k FROM o2 WHERE ord NOT IN (SELECT a FROM uidt)),
n3 AS (SELECT ord, concat(split_part(key, ' > ', 1), ' > ', split_part(key, ' > ', 2), ' > ', leaf) AS fk, count(*) OVER (PARTITION BY concat(split_part(key, ' > ', 1), ' > ', split_part(key, ' > ', 2), ' > ', leaf)) AS k FROM n2 WHERE ord NOT IN (SELECT b FROM uidt)),
keyed AS (SELECT o3.ord AS a, n3.ord AS b FROM o3 JOIN n3 USING (fk) WHERE o3.k = 1 AND n3.k = 1),
pairs AS (SELECT a, b, 'uid' AS method FROM uid UNION ALL SELECT a, b, 'uid_title' FROM uidt UNION ALL SELECT a, b, 'key' FROM keyed),
every AS (SELECT * FROM pairs UNION ALL SELECT ord, NULL, 'none' FROM old WHERE ord NOT IN (SELECT a FROM pairs) UNION ALL SELECT NULL, ord, 'none' FROM new WHERE ord NOT IN (SELECT b FROM pairs))"""


@query(f"{_PAIR} SELECT method, count(*) AS pairs, sum((b IS NULL)::int)::bigint AS only_old, sum((a IS NULL)::int)::bigint AS only_new FROM every GROUP BY method")
def pair_phase_counts(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return pairing.match_report(pairing.pair_sections(old, new, fuzzy=False)).drop("mean_score")


@query(f"{_PAIR} SELECT a AS old_ord, b AS new_ord, method FROM every")
def section_pairs(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return pairing.pair_sections(old, new, fuzzy=False).select("old_ord", "new_ord", "method")


@query()
def fuzzy_pairs(spark, sf_dir):
    """All phases of pairing, the similarity of what exact keys leave included, within a parent and across parents."""
    old, new = versions(spark, sf_dir)
    return pairing.pair_sections(old, new)


@query(f"SELECT doc_id, title, did AS document_id FROM (SELECT doc_id, {TITLE} AS title, concat('SDD-', source, '-', {NUMBER}) AS did FROM documents)")
def doc_id_extract(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    rows = old.select("ord", "title").unionByName(new.where("ord % 17 = 3").select("ord", F.regexp_replace("title", r"\)12$", ")").alias("title")))
    return rows.select(F.col("ord").alias("doc_id"), "title", text.document_id("title").alias("document_id"))


@query(f"SELECT doc_id, md5({fold_text('text')}) AS folded, length({fold_text('text')}) AS n FROM documents")
def folded_text(spark, sf_dir):
    folded = text.fold_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded).alias("folded"), F.length(folded).cast("long").alias("n"))


@query(rf"""WITH b AS (SELECT conv_id, turn, role, text, regexp_extract(trim(coalesce(text, '')), '^([a-z])[).\s]', 1) AS l, regexp_extract(trim(coalesce(text, '')), '^([1-9]\d?)[).\s]', 1) AS d FROM conversations),
s AS (SELECT *, CASE WHEN role = 'system' OR turn = 0 THEN 1 ELSE 0 END AS fresh, nullif(coalesce(nullif(l, ''), d), '') AS item FROM b),
g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section_ord FROM s),
f AS (SELECT *, coalesce(last_value(item IGNORE NULLS) OVER (PARTITION BY conv_id, section_ord ORDER BY turn ROWS UNBOUNDED PRECEDING), '_MAIN') AS seg_id FROM g)
SELECT conv_id, turn, section_ord::bigint AS section_ord, seg_id, row_number() OVER (PARTITION BY conv_id, section_ord, seg_id ORDER BY turn) - 1 AS seg_pos FROM f""")
def segments_forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_ord", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order))
    found = sections.segments(rows, "conv_id", "section_ord", "turn")
    return found.select("conv_id", "turn", "section_ord", "seg_id", F.col("seg_pos").cast("long").alias("seg_pos"))


@query("""WITH o AS (SELECT conv_id, role, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations WHERE turn % 7 <> 3 GROUP BY 1, 2),
n AS (SELECT conv_id, role, string_agg(coalesce(CASE WHEN turn % 5 = 2 THEN concat(text, ' (edited)') ELSE text END, ''), chr(10) ORDER BY turn) AS body FROM conversations WHERE turn % 7 <> 4 GROUP BY 1, 2)
SELECT conv_id, seg_id, change FROM (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.role, n.role) AS seg_id,
CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'deleted' WHEN """ + f"{fold_text('o.body')} <> {fold_text('n.body')}" + """ THEN CASE WHEN trim(o.body) <> '' AND trim(n.body) = '' THEN 'deleted' WHEN trim(n.body) <> '' AND trim(o.body) = '' THEN 'added' ELSE 'modified' END END AS change
FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.role = n.role) WHERE change IS NOT NULL""")
def segment_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def side(df):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
        return df.groupBy("conv_id", F.col("role").alias("seg_id")).agg(joined.alias("body"))

    edited = rows.withColumn("text", F.when(F.col("turn") % 5 == 2, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    old, new = side(rows.where("turn % 7 <> 3")), side(edited.where("turn % 7 <> 4"))
    ids = old.select("conv_id").union(new.select("conv_id")).distinct()
    pairs = ids.select(F.col("conv_id").alias("old_ord"), F.col("conv_id").alias("new_ord"), F.lit("key").alias("method"), F.lit(1.0).alias("score"))
    found = changes.segment_changes(old.withColumnRenamed("conv_id", "ord"), new.withColumnRenamed("conv_id", "ord"), pairs)
    return found.select(F.coalesce("old_ord", "new_ord").alias("conv_id"), "seg_id", "change")


_BLOCKS = r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?s)<(h[1-4]|p|li)[^>]*>(.*?)</', 0)) AS raw, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?s)<(h[1-4]|p|li)[^>]*>(.*?)</', 0), 1) - 1 AS pos FROM pages),
t AS (SELECT page_id, pos, regexp_extract(raw, '^<(h[1-4]|p|li)', 1) AS tag, trim(regexp_replace(regexp_replace(raw, '<[^>]*>|</$', '', 'g'), '\s+', ' ', 'g')) AS body FROM b)"""


def _page_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?s)<(h[1-4]|p|li)[^>]*>(.*?)</"), F.lit(0))).alias("pos", "raw"))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>|</$", ""), r"\s+", " "))
    return pages.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("raw", "^<(h[1-4]|p|li)", 1).alias("tag"), body.alias("body"))


@query(_BLOCKS + " SELECT page_id, tag, count(*) AS n, sum(length(body))::bigint AS chars FROM t GROUP BY page_id, tag")
def heading_blocks(spark, sf_dir):
    return _page_blocks(spark, sf_dir).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query(_BLOCKS + """, h AS (SELECT *, CASE WHEN tag LIKE 'h%' THEN substr(tag, 2, 1)::int END AS level FROM t),
f AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN pos END) OVER w AS section_ord, last_value(CASE WHEN level IS NOT NULL THEN body END IGNORE NULLS) OVER w AS title FROM h WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT page_id, section_ord, title, count(*) FILTER (WHERE level IS NULL AND body <> '') AS n_blocks FROM f WHERE section_ord IS NOT NULL GROUP BY page_id, section_ord, title""")
def page_sections(spark, sf_dir):
    blocks = _page_blocks(spark, sf_dir).select(F.col("page_id").alias("doc"), F.col("pos").alias("ord"), F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).alias("level"), F.col("body").alias("text"))
    found = sections.to_sections(sections.segments(sections.heading_context(blocks)))
    return found.select(F.col("doc").alias("page_id"), "section_ord", "title", F.col("n_blocks").cast("long").alias("n_blocks"))


@query("""SELECT item_id, concat('BENCH-WT-', lpad(CAST(row_number() OVER (ORDER BY item_id) AS varchar), greatest(2, length(CAST(row_number() OVER (ORDER BY item_id) AS varchar)))::int, '0')) AS ticket_no,
row_number() OVER (ORDER BY item_id) AS problem_index FROM benchmark""")
def ticket_numbers(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"))
    none = spark.createDataFrame([], "seq long, title string, ticket_no string")
    return tickets.by_position(items, none, prefix="bench").select(F.col("ord").alias("item_id"), "ticket_no", "problem_index")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH v AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE doc_id % 17 <> 3),
w AS (SELECT doc_id, unnest(string_split(CASE doc_id % 13 WHEN 0 THEN concat(text, ' Revised sentence.') WHEN 1 THEN replace(text, ' ', '  ') ELSE text END, chr(10))) AS raw,
generate_subscripts(string_split(CASE doc_id % 13 WHEN 0 THEN concat(text, ' Revised sentence.') WHEN 1 THEN replace(text, ' ', '  ') ELSE text END, chr(10)), 1) - 1 AS line FROM documents WHERE doc_id % 17 <> 5),
a AS (SELECT doc_id, line, substr(sha256(trim(raw)), 1, 8) AS h FROM v WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '//') AND NOT starts_with(trim(raw), '/*') AND trim(raw) NOT IN ('{{', '}}')),
b AS (SELECT doc_id, line, substr(sha256(trim(raw)), 1, 8) AS h FROM w WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '//') AND NOT starts_with(trim(raw), '/*') AND trim(raw) NOT IN ('{{', '}}'))
SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line = b.line) WHERE change IS NOT NULL GROUP BY change""")
def statement_changes(spark, sf_dir):
    sides = [df.select(F.lit("").alias("path"), F.col("ord").cast("string").alias("name"), F.col("body"), F.lit(0).alias("line_start")) for df in versions(spark, sf_dir)]
    found = incremental.statement_changes(*map(incremental.statement_fingerprints, sides))
    return changes.change_summary(found, "change")


@query(f"WITH {VERSIONS} SELECT coalesce(o.ord, n.ord) AS doc_id, CASE WHEN o.ord IS NULL THEN 'added' WHEN n.ord IS NULL THEN 'deleted' WHEN sha256(o.body) <> sha256(n.body) THEN 'modified' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.ord = n.ord")
def file_fingerprint_changes(spark, sf_dir):
    a, b = (df.select(F.col("ord").alias("doc_id"), text.short_hash("body").alias("h")) for df in versions(spark, sf_dir))
    return incremental.detect(a, b, ["doc_id"], ["h"])


@query(f"WITH {VERSIONS} SELECT n.ord AS doc_id, CASE WHEN o.ord IS NOT NULL AND sha256(o.body) = sha256(n.body) AND sha256(o.title) = sha256(n.title) THEN 'skip' ELSE 'generate' END AS action FROM new n LEFT JOIN old o ON o.ord = n.ord")
def function_tasks(spark, sf_dir):
    sides = [incremental.function_fingerprints(df.select(F.lit("").alias("path"), F.col("ord").cast("string").alias("name"), F.col("title").alias("signature"), "body")) for df in versions(spark, sf_dir)]
    return incremental.tasks(*sides).select(F.col("name").cast("long").alias("doc_id"), "action")


@query(f"WITH {VERSIONS} SELECT n.ord AS doc_id, CASE WHEN o.ord IS NULL OR sha256(o.body) = sha256(n.body) THEN 1 ELSE 2 END::int AS version FROM new n LEFT JOIN old o ON o.ord = n.ord")
def state_update(spark, sf_dir):
    a, b = (df.select(F.col("ord").alias("doc_id"), text.short_hash("body").alias("h")) for df in versions(spark, sf_dir))
    return incremental.update_state(a.withColumn("version", F.lit(1)), b, ["doc_id"]).select("doc_id", "version")


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b([A-Za-z_]\w*)\b', 1)) AS a, list_distinct(regexp_extract_all(CASE doc_id % 13 WHEN 0 THEN concat(text, ' Revised sentence.') WHEN 1 THEN replace(text, ' ', '  ') ELSE text END, '\b([A-Za-z_]\w*)\b', 1)) AS b FROM documents WHERE doc_id % 17 NOT IN (3, 5))
SELECT doc_id, array_to_string(list_sort(list_filter(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))), lambda s: length(s) >= 3)), ',') AS symbols FROM t""")
def symmetric_symbols(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    both = old.select("ord", F.col("body").alias("a")).join(new.select("ord", F.col("body").alias("b")), "ord")
    return both.select(F.col("ord").alias("doc_id"), F.array_join(planner.changed_symbols(F.col("a"), F.col("b")), ",").alias("symbols"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line, CASE WHEN line = 0 THEN 'HEAD' ELSE raw END AS body FROM l WHERE NOT contains(raw, '###') OR line = 0),
a AS (SELECT *, 1 AS part FROM k UNION ALL SELECT doc_id, 0, 'END', 2 FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(body, chr(10) ORDER BY part, line)) AS digest FROM a GROUP BY doc_id""")
def revision_apply(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kinds = "rule_ord int, action string, index int, line string, contains string, regex string, value string"
    rules = spark.createDataFrame([(0, "replace", 0, None, None, None, "HEAD"), (1, "delete", None, None, "###", None, None), (2, "append", None, None, None, None, "END")], kinds)
    out = revise.revise_lines(lines, docs.select("doc").join(F.broadcast(rules), F.lit(True)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return out.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.md5(joined).alias("digest"))


@query("""SELECT doc_id, phrase, CASE WHEN must THEN 'missing' ELSE 'forbidden' END AS issue FROM documents, (VALUES (true, 'the'), (false, '###'), (false, 'token')) r(must, phrase) WHERE contains(coalesce(text, ''), phrase) <> must""")
def golden_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    rules = spark.createDataFrame([(True, "the"), (False, "###"), (False, "token")], "must boolean, phrase string")
    return revise.audit(docs, docs.select("doc").join(F.broadcast(rules), F.lit(True))).withColumnRenamed("doc", "doc_id")


@query("""WITH b AS (SELECT item_id, trim(text) AS title FROM benchmark), d AS (SELECT doc_id, text FROM documents)
SELECT doc_id, item_id AS seq, 0.62::double AS score FROM d JOIN b ON contains(coalesce(text, ''), title) AND length(title) >= 2""")
def ticket_match_texts(spark, sf_dir):
    """Benchmark items as tickets against documents as changes without numbers, paths and symbols: the rules on titles."""
    blank = F.array().cast("array<string>")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("title"), blank.alias("ids"), blank.alias("paths"), blank.alias("idents"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("change_id"), F.lit("").alias("key"), F.lit("").alias("seg"), F.col("text").alias("blob"), blank.alias("ids"), blank.alias("paths"), blank.alias("idents"))
    return tickets.rule_scores(items, docs, with_text=False).select(F.col("change_id").alias("doc_id"), "seq", "score")


def ticket_sides(spark, sf_dir):
    """Nations as tickets whose titles name a number, a path, a file, a symbol, a title, a key or a word; parts as changes."""
    k, words = F.col("n_nationkey").cast("string"), F.array(*[F.lit(x) for x in ("check (SDD-part-", "crash in src/u", "build of lib/u", "fix func_", "module ", "area ", "text of ")])
    ends = F.array(*[F.lit(x) for x in (")", ".c", ".c", " now", "", "", "")])
    kind = (F.col("n_nationkey") % 7).cast("int")
    name = F.when(kind == 6, F.concat(F.lower(F.substring("n_name", 1, 1)), F.lit("问题"))).otherwise(k)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.get(words, kind), name, F.get(ends, kind)).alias("title"))
    p, text_of = F.col("p_partkey"), lambda x: x.cast("string")
    key = F.concat(F.lit("area "), text_of(F.col("p_size") % 5), F.lit(" > module "), text_of(p % 50))
    blob = F.concat(F.lit("text of "), "p_name", F.lit(" in src/u"), text_of(p % 70), F.lit(".c see SDD-part-"), text_of(p % 80))
    made = spread(table(spark, sf_dir, "part"), "p_partkey").select(p.alias("change_id"), key.alias("key"), F.concat(F.lit("func_"), text_of(p % 60)).alias("seg"), blob.alias("blob"))
    return tickets.features(nations, F.col("title")), tickets.features(made, F.concat_ws("\n", "key", "seg", "blob"), F.col("seg"))


def _sql_features(body: str) -> str:
    ids = rf"list_distinct(list_transform(list_concat(regexp_extract_all({body}, '{text.ID_SLASH}'), list_filter(regexp_extract_all({body}, '{text.ID_PARTS}'), lambda x: regexp_matches(x, '\d'))), lambda x: upper(x)))"
    paths = rf"list_distinct(list_transform(regexp_extract_all({body}, '{tickets.PATH}', 0), lambda x: lower(x)))"
    idents = f"list_distinct(list_transform(regexp_extract_all({body}, '{tickets.IDENT}'), lambda x: lower(x)))"
    stop = ", ".join(f"'{w}'" for w in tickets.STOP_WORDS)
    return f"{ids} AS ids, {paths} AS paths, list_filter({idents}, lambda x: length(x) >= 4 AND NOT list_contains([{stop}], x)) AS idents"


_TICKETS = f"""t0 AS (SELECT n_nationkey::bigint AS seq, CASE n_nationkey % 7 WHEN 0 THEN concat('check (SDD-part-', n_nationkey, ')') WHEN 1 THEN concat('crash in src/u', n_nationkey, '.c') WHEN 2 THEN concat('build of lib/u', n_nationkey, '.c')
 WHEN 3 THEN concat('fix func_', n_nationkey, ' now') WHEN 4 THEN concat('module ', n_nationkey) WHEN 5 THEN concat('area ', n_nationkey) ELSE concat('text of ', lower(substr(n_name, 1, 1)), '问题') END AS title FROM nation),
t AS (SELECT *, trim(regexp_replace(title, '问题$', '')) AS core, {_sql_features('title')} FROM t0),
c0 AS (SELECT p_partkey AS change_id, concat('area ', p_size % 5, ' > module ', p_partkey % 50) AS key, concat('func_', p_partkey % 60) AS seg, concat('text of ', p_name, ' in src/u', p_partkey % 70, '.c see SDD-part-', p_partkey % 80) AS blob FROM part),
c AS (SELECT *, concat('module ', change_id % 50) AS leaf, {_sql_features("concat_ws(chr(10), key, seg, blob)")} FROM c0),
base AS (SELECT change_id, seq, CASE WHEN list_has_any(t.ids, c.ids) THEN 0.95 ELSE 0 END AS a, CASE WHEN list_has_any(t.paths, c.paths) THEN 0.88 WHEN list_has_any(list_transform(t.paths, lambda x: regexp_replace(x, '^.*/', '')), list_transform(c.paths, lambda x: regexp_replace(x, '^.*/', ''))) THEN 0.80 ELSE 0 END AS b,
 coalesce(list_max(list_transform(list_intersect(t.idents, c.idents), lambda x: CASE WHEN length(x) >= 6 THEN 0.82 ELSE 0.72 END)), 0) AS s,
 CASE WHEN contains(leaf, title) OR contains(title, leaf) THEN 0.70 WHEN contains(key, title) THEN 0.68 WHEN length(core) >= 2 AND (contains(key, core) OR contains(blob, core)) THEN 0.62 ELSE 0 END AS w FROM t, c),
scores AS (SELECT change_id, seq, greatest(a, b, s, w)::double AS score FROM base WHERE greatest(a, b, s, w) >= 0.42)"""


@query(f"WITH {_TICKETS} SELECT * FROM scores")
def ticket_match_rules(spark, sf_dir):
    """All rules but the text similarity, which no SQL has: numbers, paths, file names, symbols, titles, keys, words."""
    return tickets.rule_scores(*ticket_sides(spark, sf_dir), with_text=False).select("change_id", "seq", "score")


@query()
def ticket_match_similar(spark, sf_dir):
    """All eight rules, the text similarity included."""
    return tickets.rule_scores(*ticket_sides(spark, sf_dir)).select("change_id", "seq", "score", "reason")


@query(f"""WITH RECURSIVE {_TICKETS}, e AS (SELECT *, row_number() OVER (ORDER BY score DESC, change_id, seq) AS k FROM scores),
g AS (SELECT 0::bigint AS k, []::bigint[] AS cs, []::bigint[] AS ts, NULL::bigint AS change_id, NULL::bigint AS seq
 UNION ALL SELECT e.k, list_append(y.cs, e.change_id), list_append(y.ts, e.seq), e.change_id, e.seq FROM (SELECT g.cs, g.ts, min(e.k) AS k FROM g, e WHERE e.k > g.k AND NOT list_contains(g.cs, e.change_id) AND NOT list_contains(g.ts, e.seq) GROUP BY g.cs, g.ts) y JOIN e ON e.k = y.k)
SELECT change_id, seq FROM g WHERE seq IS NOT NULL""")
def ticket_assignment(spark, sf_dir):
    """One change for each ticket, and one ticket for each change, by falling score."""
    return tickets.assign(ticket_match_rules(spark, sf_dir)).select("change_id", "seq")


@query(f"""WITH RECURSIVE {_TICKETS}, e AS (SELECT *, row_number() OVER (ORDER BY score DESC, change_id, seq) AS k FROM scores),
g AS (SELECT 0::bigint AS k, []::bigint[] AS cs, []::bigint[] AS ts, NULL::double AS score
 UNION ALL SELECT e.k, list_append(y.cs, e.change_id), list_append(y.ts, e.seq), e.score FROM (SELECT g.cs, g.ts, min(e.k) AS k FROM g, e WHERE e.k > g.k AND NOT list_contains(g.cs, e.change_id) AND NOT list_contains(g.ts, e.seq) GROUP BY g.cs, g.ts) y JOIN e ON e.k = y.k)
SELECT count(score) AS matched, round(avg(score), 4) AS mean_score, (SELECT count(*) FROM part) - count(score) AS unmatched_changes, (SELECT count(*) FROM nation) - count(score) AS unmatched_tickets FROM g""")
def ticket_match_report(spark, sf_dir):
    """How many tickets and changes were matched."""
    asked, made = ticket_sides(spark, sf_dir)
    return tickets.match_report(made, asked, tickets.assign(ticket_match_rules(spark, sf_dir)))


@query("""WITH u AS (SELECT text, doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL AND text <> '') SELECT doc_id FROM u WHERE n = 1""")
def unique_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text") != "", F.md5("text")).alias("h"))
    return assign.unique_keys(docs, "h").select("doc_id")

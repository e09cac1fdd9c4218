"""Readers, writers and row operators, each on a small fixture."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import text
from deltaloom.operators import changes, graph, incremental, quality, sections, tickets
from deltaloom.sources import readers, sinks
from deltaloom.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# sources


def test_decoding_tries_encodings_in_order(spark):
    raw = [(b"\xef\xbb\xbfplain",), ("中".encode("gb18030"),), (b"\xff\xfe\xfa",), (None,), (b"",)]
    got = [r[0] for r in spark.createDataFrame(raw, "b binary").coalesce(1).select(readers.decode_udf("b")).collect()]
    assert got[0] == "plain" and got[1] == "中" and got[2] is not None and got[3:] == ["", ""]


def test_ledgers(spark, tmp_path):
    (tmp_path / "tab.tsv").write_text("no\ttitle\tticket\n1\tone\tA-1\n2\ttwo\t\n", "utf-8")
    assert rows(readers.read_ticket_csv(spark, str(tmp_path / "tab.tsv")), "seq", "title", "ticket_no") == [(1, "one", "A-1"), (2, "two", "")]
    (tmp_path / "list.json").write_text(json.dumps([{"seq": 4, "title": "four"}, {"seq": "No. 5", "title": "five"}]))
    assert rows(readers.read_ticket_json(spark, str(tmp_path / "list.json")), "seq", "title") == [(4, "four"), (5, "five")]
    assert readers.map_headers(["序号", "问题描述", "单号"]) == {"seq": "序号", "title": "问题描述", "ticket_no": "单号"}
    assert readers.map_headers(["a", "b", "c"]) == {"seq": "a", "title": "b", "ticket_no": "c"}


def test_changes_and_indexes(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"change_kind": "new_function", "function_name": "f"}, {"change_kind": "header_changed", "old_text": "x"}]))
    assert [(r.change_kind, r.function_name, r.old_text) for r in readers.read_changes(spark, str(tmp_path / "c.json")).orderBy("idx").collect()] == [("new_function", "f", None), ("header_changed", None, "x")]
    (tmp_path / "i.json").write_text(json.dumps({"entries": {"a": {"title": "A", "n": 2}, "b": "plain"}}))
    assert rows(readers.read_index(spark, str(tmp_path / "i.json"), "entries"), "key", "fields") == [("a", {"title": "A", "n": "2"}), ("b", {"value": "plain"})]
    (tmp_path / "l.json").write_text(json.dumps([{"symbol": "s", "cn": "S"}, {"cn": "no key"}]))
    assert rows(readers.read_index(spark, str(tmp_path / "l.json")), "key") == [("s",)]


def test_graph_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "f", "function", "f", "./src/a.c", 3, 9, "int f()"), (2, "f", "function", "f", "lib/a.c", 1, 2, "int f()")], "id long, name string, kind string, qualified_name string, file_path string, start_line int, end_line int, signature string")
    nodes.write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([(1, 2, "calls", 4)], "source long, target long, kind string, line int").write.parquet(str(tmp_path / "e"))
    n, e = readers.graph_tables(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert rows(e, "source", "target") == [(1, 2)]
    wanted = spark.createDataFrame([("f", "src/a.c"), ("f", "zzz.c")], "name string, file_path string")
    assert rows(readers.pick_nodes(wanted, n), "asked", "id") == [("src/a.c", 1), ("zzz.c", 1)]


def test_graph_tables_of_a_database(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "g.db")
    con.execute("create table nodes (id integer, name text, kind text, qualified_name text, file_path text, start_line integer, end_line integer, signature text)")
    con.execute("create table edges (source integer, target integer, kind text, line integer)")
    con.execute("insert into nodes values (1, 'f', 'function', 'f', 'a.c', 1, 2, 'int f()')")
    con.execute("insert into edges values (1, 1, 'calls', 2)")
    con.commit()
    con.close()
    n, e = readers.graph_database(spark, str(tmp_path / "g.db"))
    assert rows(n, "id", "name", "start_line") == [(1, "f", 1)] and rows(e, "source", "kind", "line") == [(1, "calls", 2)]


# normalisers


def test_headings_and_cells(spark):
    made = spark.createDataFrame([("Intro", "Heading 2", None), ("SDD-12-3 start", "Normal", None), ("a long line of text that holds no number at all", "Normal", None), ("Top", "Normal", 0)], "t string, s string, o int")
    assert [r[0] for r in made.coalesce(1).select(text.is_heading("t", "s", "o")).collect()] == [2, 4, None, 1]
    cells = spark.createDataFrame([([["a ", "b\nc"], ["", None]],)], "r array<array<string>>")
    assert cells.select(text.cells_to_text("r")).first()[0] == "a\tb c"
    names = spark.createDataFrame([("MAX_1",), ("g_x",), ("size_t",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.coalesce(1).select(text.symbol_kind("n")).collect()] == ["macro", "global", "type", "symbol", "symbol"]
    assert [r[0] for r in spark.createDataFrame([("ab中",), ("ab",), (None,)], "t string").coalesce(1).select(text.has_cjk("t")).collect()] == [True, False, False]


def test_heading_functions(spark):
    blocks = [("d", 0, 1, "Start (SDD-1-1)"), ("d", 1, None, "words"), ("d", 2, None, "int start(int a);"), ("d", 3, 2, "Again (SDD-1-2)"), ("d", 4, None, "void start(void)"), ("d", 5, 1, "None (SDD-9-9)")]
    assert rows(sections.heading_functions(spark.createDataFrame(blocks, "doc string, ord int, level int, text string")), "function", "ids") == [("start", ["SDD-1-1", "SDD-1-2"])]


def test_look_ahead_and_names(spark):
    lines = spark.createDataFrame([("d", k, "x" if k % 5 else "hit") for k in range(12)], "doc string, ord int, text string")
    got = {r.ord: r.found for r in sections.look_ahead(lines, F.col("text") == "hit", F.col("ord"), "found", 3).collect()}
    assert got[1] is None and got[2] == 5 and got[9] == 10 and got[11] is None
    near = {r.ord: (r.prev_text, r.next_text) for r in sections.neighbours(lines.limit(2), "text").collect()}
    assert near == {0: (None, "x"), 1: ("hit", None)}
    named = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "t string, i int")
    assert rows(sections.unique_titles(named, "t", "i"), "i", "unique_title") == [(1, "a"), (1, "b"), (2, "a_2")]
    assert rows(sections.nesting(spark.createDataFrame([("d", 0, "f {"), ("d", 1, "a"), ("d", 2, "}")], "doc string, ord int, text string")), "ord", "depth_before", "depth_after") == [(0, 0, 1), (1, 1, 1), (2, 1, 0)]


# changes


def test_table_ladder(spark):
    kinds = "doc string, ord int, name string, size string"
    old = spark.createDataFrame([("k", 0, "a", "1"), ("k", 1, "b", "2"), ("k", 2, "c", "2"), ("s", 0, "x", "1"), ("s", 1, "x", "1"), ("s", 2, "y", "1"), ("o", 0, "q", "1")], kinds)
    new = spark.createDataFrame([("k", 0, "b", "3"), ("k", 1, "a", "1"), ("k", 2, "d", "2"), ("s", 0, "x", "1"), ("s", 1, "y", "1"), ("s", 2, "y", "1"), ("n", 0, "r", None)], kinds)
    got = rows(changes.table_changes(old, new, ["name", "size"]), "doc", "way", "change", "row_key", "old_row", "new_row")
    assert set(got) == {
        ("k", "key", "modified", "b", "b\t2", "b\t3"), ("k", "key", "deleted", "c", "c\t2", None), ("k", "key", "added", "d", None, "d\t2"),
        ("s", "sequence", "deleted", None, "x\t1", None), ("s", "sequence", "added", None, None, "y\t1"),
        ("o", "all", "deleted", None, "q\t1", None), ("n", "all", "added", None, None, "r\t"),
    }
    assert changes.table_changes(old, old, ["name", "size"]).count() == 0


def test_table_ladder_shuffles_no_row_for_each_column(spark, monkeypatch):
    plans, write = [], changes.materialise
    monkeypatch.setattr(changes, "materialise", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, label))[1])
    old = spark.createDataFrame([("k", 0, "a", "1"), ("k", 1, "b", "1"), ("k", 2, None, "2")], "doc string, ord int, name string, size string")
    assert changes.table_changes(old, old.where("ord < 2"), ["name", "size"]).select("way", "change").collect() == [("sequence", "deleted")]
    assert plans and not any("Expand" in plan for plan in plans)


def test_snippets(spark):
    old = "\n".join(f"line {k}" for k in range(12))
    made = spark.createDataFrame([("a", old, old.replace("line 5", "LINE 5")), ("b", old, old), ("c", None, "new")], "k string, old_text string, new_text string")
    got = {r.k: r for r in changes.change_snippets(made, "k", context=1).collect()}
    assert set(got) == {"a", "c"} and got["a"].old_snippet == "line 4\nline 5\nline 6" and got["a"].new_snippet == "line 4\nLINE 5\nline 6" and got["a"].line == 6
    titles = spark.createDataFrame([(1, "A1", "A"), (2, "A", "B"), (3, None, "")], "k int, a string, b string")
    assert rows(changes.title_changes(titles, "a", "b"), "k") == [(2,)]


# tickets


def brute_scores(asked, made):
    """Every rule on every pair, one after the other."""
    import difflib
    import re

    out = {}
    for t in asked:
        for c in made:
            key, blob = c["key"] or "", c["blob"] or ""
            path = key.lower().replace("\\", "/")
            paths = set(c["paths"]) | ({path} if "/" in path or re.search(r"\.[ch]$", path) else set())
            base = lambda ps: {p.rsplit("/", 1)[-1] for p in ps}
            title = (t["title"] or "").strip()
            core = re.sub("(需求变更|变更|修改|冗余|删除|新增|问题)$", "", title).strip()
            leaf = ([p for p in key.split(" > ") if p.strip()] or [""])[-1].strip()
            hits = [h for h in set(t["idents"]) & (set(c["idents"]) | {(c["seg"] or "").lower()}) if len(h) >= 4]
            found = []
            if set(t["ids"]) & set(c["ids"]):
                found.append(0.95)
            if set(t["paths"]) & paths:
                found.append(0.88)
            elif base(t["paths"]) & base(paths):
                found.append(0.80)
            if hits:
                found.append(0.82 if max(map(len, hits)) >= 6 else 0.72)
            if len(title) >= 2:
                if leaf and (title in leaf or leaf in title):
                    found.append(0.70)
                elif title in key:
                    found.append(0.68)
                elif len(core) >= 2 and (core in key or core in blob):
                    found.append(0.62)
            short, body = (re.sub(r"\s+", "", x.lower()) for x in (title, blob[:500]))
            part = body[: max(3 * len(short), 80)]
            ratio = difflib.SequenceMatcher(None, short, part).ratio() if short and part else float(short == part)
            if ratio >= 0.55:
                found.append(0.45 + 0.25 * ratio)
            if found and max(found) >= 0.42:
                out[c["change_id"], t["seq"]] = round(min(1.0, max(found)), 9)
    return out


def test_rule_scores_against_brute_force(spark):
    asked = [(1, "fix (SDD-1-2)"), (2, "speed_limit wrong"), (3, "in src/main.c"), (4, "Battery"), (5, "other/main.c broken"), (6, "motor control变更"), (7, "x"), (8, None), (9, "the text of a change that is alike"), (10, "area one")]
    made = [(10, "k > (SDD-1-2)", "_MAIN", "text"), (11, "k", "f", "uses speed_limit here"), (12, "src/main.c", "g", "body"), (13, "x > Battery level", "_MAIN", "t"), (14, "nothing", "h", "else motor control"), (15, None, None, None), (16, "area one > two", "main", "the text of a change that is alive"), (17, "a > src/main.c", "speed", "in lib/main.c SDD-1-2 speed_limit")]
    t = tickets.features(spark.createDataFrame(asked, "seq int, title string"), F.coalesce("title", F.lit("")))
    c = tickets.features(spark.createDataFrame(made, "change_id int, key string, seg string, blob string"), F.concat_ws("\n", "key", "seg", "blob"), F.coalesce("seg", F.lit("")))
    wanted = brute_scores([r.asDict() for r in t.collect()], [r.asDict() for r in c.collect()])
    got = tickets.rule_scores(t, c).collect()
    assert {(r.change_id, r.seq): round(r.score, 9) for r in got} == wanted
    assert {why.split(":")[0] for r in got for why in r.reason.split("+")} >= {"doc_id", "path", "symbol", "title<leaf", "title<key", "keyword", "sim"}
    report = tickets.match_report(c, t, tickets.assign(tickets.rule_scores(t, c))).first()
    assert report.matched + report.unmatched_tickets == len(asked) and report.matched + report.unmatched_changes == len(made)


# quality, state, writers


def test_evidence(spark):
    frame = lambda data, kinds: spark.createDataFrame(data, kinds)
    got = rows(quality.evidence_rows(frame([("f", " note "), ("f", "")], "key string, text string"), frame([("f", "a", "left", True), ("f", "b", None, True), ("f", "c", "x", False), ("f", "d", "", False)], "key string, name string, meaning string, is_param boolean"), frame([("f", "a+b", True)], "key string, text string, parsed boolean"), frame([("f", "call", "go()", 0.9)], "key string, kind string, text string, confidence double")), "kind", "item", "confidence")
    assert got == sorted([("comment", "note", 1.0), ("variable", "a", 0.8), ("variable", "b", 0.3), ("variable", "c", 0.7), ("variable", "d", 0.2), ("expression", "a+b", 1.0), ("step:call", "go()", 0.9)], key=str)
    row = spark.range(1).select(quality.evidence_kinds(F.lit(True), F.lit(None).cast("boolean"), F.lit(True)), quality.needs_rewrite(F.lit(0), [F.lit(True), F.lit(False)]), quality.needs_rewrite(F.lit(1), []), quality.preference(F.lit(1), F.lit(2), F.lit(3)), F.size(quality.flags(a=F.lit(True), b=F.lit(False)))).first()
    assert tuple(row) == (2, False, True, 1023, 1)
    assert tuple(quality.progress(spark.range(0), F.col("id") > 0).first()) == (0, 0, 100.0)


def test_interrupted_writes_leave_the_state(spark, tmp_path):
    folder = tmp_path / "state"
    one = spark.createDataFrame([(1, "a", 1)], "k int, h string, version int")
    incremental.write_state(one, str(folder))
    for name in ("v=2.tmp", "_tmp-abc", "v=x"):
        (folder / name).mkdir()
    boom = F.udf(lambda x: 1 / 0, "int")
    with pytest.raises(Exception, match="division|ZeroDivision"):
        incremental.write_state(one.withColumn("version", boom("k")), str(folder))
    assert rows(incremental.read_state(spark, str(folder)), "k", "version") == [(1, 1)]
    incremental.write_state(one.withColumn("version", F.lit(7)), str(folder))
    assert rows(incremental.read_state(spark, str(folder)), "k", "version") == [(1, 7)]
    assert incremental.resume_point(one, ["k"]).first().k == 1


def test_failed_writes_leave_the_old_files(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, "x")], "k int, t string")
    for write, read in ((sinks.write_json, spark.read.json), (sinks.write_csv, spark.read.option("header", True).csv), (sinks.write_parquet, spark.read.parquet)):
        target = f"{path}-{write.__name__}"
        write(first, target)
        with pytest.raises(Exception, match="division|ZeroDivision"):
            write(first.withColumn("t", F.udf(lambda x: str(1 / 0))("k")), target)
        assert [r.t for r in read(target).collect()] == ["x"]
        write(first.withColumn("t", F.lit("y")), target)
        assert [r.t for r in read(target).collect()] == ["y"] and [r.t for r in read(f"{target}.bak").collect()] == ["x"]
    assert sinks.write_versioned(first, str(tmp_path / "v")).endswith("v=1")


def test_reports_and_graphs(spark):
    items = spark.createDataFrame([("safe", "edit", "f", "one"), ("manual", "edit", None, "two")], "status string, action string, function_name string, reason string")
    assert [r.line for r in sinks.plan_report(items).collect()] == ["- manual edit : two", "- safe edit f: one"]
    a, b = (spark.createDataFrame([(k,)], "k int") for k in (1, 2))
    assert rows(sinks.merge_batches(a, b), "k", "batch") == [(1, 0), (2, 1)]
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "calls")], "source string, target string, kind string")
    assert [r.line for r in graph.to_dot(edges, "g").collect()] == ["digraph g {", '  "a" -> "b";', '  "b" -> "c";', "}"]
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node string, ord int")
    kept, inner = graph.overview(nodes, edges, 2)
    assert rows(kept, "node") == [("a",), ("b",)] and rows(inner, "source", "target") == [("a", "b")]
    functions = spark.createDataFrame([("a", ["a", "b", "b", " "], 0), ("a", ["c"], 1), ("d", ["c"], 0)], "name string, callees array<string>, ord int")
    made = graph.call_edges(functions)
    assert rows(made, "caller", "callee") == [("a", "c"), ("d", "c")] and rows(graph.callers_of(made, "c"), "caller") == [("a",), ("d",)]


def test_stream_takes_the_last_of_a_key(spark, tmp_path):
    source, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "x", 1)], "k int, body string, n int").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k int, body string, n int").parquet(source)
    streams.track_fingerprints(stream, state, str(tmp_path / "cp"), ["k"], "body", order="n").trigger(availableNow=True).start().awaitTermination()
    want = {r.k: r.h for r in spark.createDataFrame([(1, "b"), (2, "x")], "k int, body string").select("k", text.short_hash("body").alias("h")).collect()}
    assert {r.k: r.hash for r in incremental.read_state(spark, state).collect()} == want

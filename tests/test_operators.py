import random

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import assign, candidates, changes, graph, incremental, pairing, planner, quality, revise, sections, terms, tickets


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_greedy_equals_sequential(spark):
    pick = random.Random(1)
    for _ in range(4):
        edges = list({(i, j): (i, j, pick.choice([0.5, 0.6, 0.7])) for i, j in ((pick.randrange(7), pick.randrange(7)) for _ in range(20))}.values())
        wanted, a, b = [], set(), set()
        for i, j, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
            if i not in a and j not in b:
                wanted.append((i, j))
                a.add(i), b.add(j)
        found = assign.greedy(spark.createDataFrame(edges, "i int, j int, s double"), "i", "j", "s")
        assert rows(found, "i", "j") == sorted(wanted)
    assert assign.greedy(spark.createDataFrame([], "i int, j int, s double"), "i", "j", "s").count() == 0


SECTION = "ord int, title string, key string, body string"


def test_pairing_phases(spark):
    old = [(0, "A (SDD-1-1)", "x > A", "one"), (1, "B (SDD-2-2)", "x > B1", "two"), (2, "C (SDD-2-2)", "x > C", "three"), (3, "Plain", "x > Plain1", "four"), (4, "Almost the same title here", "x > Almost the same title here", "some body text that stays"), (5, "Gone", "x > Gone", "zzz")]
    new = [(0, "B (SDD-2-2)", "x > B2", "two"), (1, "C (SDD-2-2)", "x > C", "three"), (2, "A new (SDD-1-1)", "x > A", "one"), (3, "Plain", "x > Plain", "four"), (4, "Almost the same titles here", "x > Almost the same titles here", "some body text that stays"), (5, "Fresh and new", "y > Fresh", "qqqq")]
    found = pairing.pair_sections(spark.createDataFrame(old, SECTION), spark.createDataFrame(new, SECTION))
    got = {(r.old_ord, r.new_ord): r.method for r in found.collect()}
    assert got == {(0, 2): "uid", (1, 0): "uid_title", (2, 1): "uid_title", (3, 3): "key", (4, 4): "fuzzy", (5, None): "none", (None, 5): "none"}


def test_pairing_identity_and_empty(spark):
    same = spark.createDataFrame([(k, f"T{k} x", f"a > T{k} x", None) for k in range(4)], SECTION)
    assert {r.method for r in pairing.pair_sections(same, same).collect()} == {"key"}
    none = spark.createDataFrame([], SECTION)
    assert {(r.old_ord, r.method) for r in pairing.pair_sections(same, none).collect()} == {(k, "none") for k in range(4)}


def test_segment_changes(spark):
    seg = "ord int, seg_id string, body string"
    old = spark.createDataFrame([(1, "_MAIN", "same  text"), (1, "a", "old"), (1, "b", "gone"), (2, "a", "x"), (2, "b", "y"), (3, "_MAIN", "only")], seg)
    new = spark.createDataFrame([(1, "_MAIN", "same text"), (1, "a", "new"), (1, "c", "come")], seg)
    pairs = spark.createDataFrame([(1, 1, "key", 1.0), (2, None, "none", 0.0), (3, None, "none", 0.0)], "old_ord int, new_ord int, method string, score double")
    assert rows(changes.segment_changes(old, new, pairs), "old_ord", "seg_id", "change") == [(1, "a", "modified"), (1, "b", "deleted"), (1, "c", "added"), (2, "*", "deleted"), (3, "_MAIN", "deleted")]


def test_swap_turns_added_into_deleted(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    b = spark.createDataFrame([(2, "y z"), (3, None)], "k int, t string")
    assert rows(changes.version_changes(a, b, "k", "t"), "k", "change") == [(1, "deleted"), (2, "modified"), (3, "added")]
    assert rows(changes.version_changes(b, a, "k", "t"), "k", "change") == [(1, "added"), (2, "modified"), (3, "deleted")]


def test_heading_context_resets_deeper_levels(spark):
    blocks = spark.createDataFrame([("d", 0, None, "before"), ("d", 1, 1, "One"), ("d", 2, 2, "Two"), ("d", 3, None, "body"), ("d", 4, None, "a) item"), ("d", 5, 1, "Next"), ("d", 6, None, "tail")], "doc string, ord int, level int, text string")
    found = sections.segments(sections.heading_context(blocks))
    keys = {r.ord: (r.key, r.seg_id) for r in found.collect()}
    assert keys[3] == ("One > Two", "_MAIN") and keys[4] == ("One > Two", "a") and keys[6] == ("Next", "_MAIN") and keys[0][0] == ""
    assert rows(sections.to_sections(found), "section_ord", "key", "n_blocks") == [(1, "One", 0), (2, "One > Two", 2), (5, "Next", 1)]


def test_lines_and_numbers(spark):
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(["IF x", "ELSE", "END IF", "set a", "set a", ""])], "doc string, ord int, text string")
    assert rows(sections.drop_void_else(lines), "ord", "text", "source_ords") == [(0, "IF x", [0]), (2, "END IF", [2]), (3, "set a", [3, 4])]
    ids = spark.createDataFrame([("M_001",), ("M_007",), ("K_9",)], "id string")
    assert rows(sections.next_id(ids, "id"), "next_id") == [("K_10",), ("M_008",)]
    heads = spark.createDataFrame([("d", 0, 1), ("d", 3, 2), ("d", 5, 2), ("d", 9, 1)], "doc string, ord int, level int")
    assert rows(sections.section_ends(heads), "ord", "end_ord") == [(0, 9), (3, 5), (5, 9), (9, None)]


def test_tree_and_closure(spark):
    edges = spark.createDataFrame([("main", "a", 0), ("main", "b", 1), ("a", "c", 0), ("c", "main", 0), ("c", "d", 1), ("d", "e", 0)], "caller string, callee string, ord int")
    roots = spark.createDataFrame([("main",)], "node string")
    assert rows(graph.call_tree(roots, edges), "level0", "level1", "level2", "level3") == [("main", "a", "c", "d"), ("main", "b", "-", "-")]
    assert rows(graph.call_tree(roots, edges.limit(0)), "level0", "level1") == [("main", "-")]
    pairs = edges.select(F.col("caller").alias("source"), F.col("callee").alias("target"))
    reached = {r.node: r.depth for r in graph.reach(roots, pairs).collect()}
    assert reached == {"main": 0, "a": 1, "b": 1, "c": 2, "d": 3, "e": 4}
    inc = spark.createDataFrame([("x.c", "sub/h.h"), ("x.c", "k.h")], "rel_path string, include string")
    heads = spark.createDataFrame([("lib/sub/h.h",), ("h.h",)], "rel_path string")
    assert rows(graph.include_edges(inc, heads), "rel_path", "header") == [("x.c", "h.h")]


def test_terms(spark):
    table = spark.createDataFrame([("g_a", "speed", 1), ("g_a", "speed value", 2), ("x_u8", "ab", 1), ("x_u8", "abc", 2), ("ok", "one", 1)], "symbol string, variant string, place int")
    report = terms.consistency(table)
    got = {r.symbol: (r.consistent, r.severity, r.suggestion) for r in report.collect()}
    assert got == {"g_a": (False, "high", "speed value"), "x_u8": (False, "low", "abc"), "ok": (True, None, None)}
    assert terms.consistency_score(report).first().score == pytest.approx(100 / 3)
    assert rows(terms.repair_patch(terms.repair_hints(report)), "symbol", "suggested") == [("g_a", "speed value")]
    words = spark.createDataFrame([("a", "x"), ("a", "y")], "symbol string, expected string").where("expected = 'x'")
    bad = terms.consistency(spark.createDataFrame([("a", "p", 1), ("a", "q", 2)], "symbol string, variant string, place int"), dictionary=words)
    assert rows(terms.repair_patch(terms.repair_hints(bad)), "symbol", "suggested", "action") == [("a", "x", "align_with_dict")]
    record = "ident string, cn string, source string, confidence double, locked boolean"
    old = spark.createDataFrame([("a", "A", "manual", 0.5, False), ("b", "B", "ai", 0.9, True), ("c", "C", "ai", 0.3, False)], record)
    new = spark.createDataFrame([("a", "A2", "symbol_dict", 0.9, False), ("b", "B2", "manual", 1.0, False), ("c", "C2", "manual", 0.9, False), ("d", "D", "zzz", 0.1, False)], record)
    got = {r.ident: (r.cn, r.action, r.candidate, r.alias) for r in terms.upsert(old, new).collect()}
    assert got == {"a": ("A", "kept_candidate", "A2", "A2"), "b": ("B", "kept_candidate", "B2", None), "c": ("C2", "replaced", None, "C"), "d": ("D", "inserted", None, None)}


def test_tickets(spark):
    df = spark.createDataFrame([("dfks112", 1), ("DFKS112-WT-", 123), ("", 1)], "p string, n int")
    assert [r[0] for r in df.select(tickets.ticket_number("p", "n")).collect()] == ["DFKS112-WT-01", "DFKS112-WT-123", ""]
    df = spark.createDataFrame([("AB-WT-07",), ("AB-WT",), (None,)], "raw string")
    assert [r[0] for r in df.select(tickets.ensure_number("raw", F.lit(3), F.lit("X"))).collect()] == ["AB-WT-07", "AB-WT-03", "X-WT-03"]
    t = tickets.features(spark.createDataFrame([(1, "fix (SDD-1-2)"), (2, "speed_limit wrong"), (3, "in src/main.c"), (4, "Battery")], "seq int, title string"), F.col("title"))
    c = spark.createDataFrame([(10, "k > (SDD-1-2)", "_MAIN", "text"), (11, "k", "f", "uses speed_limit here"), (12, "src/main.c", "g", "body"), (13, "x > Battery level", "_MAIN", "t"), (14, "nothing", "h", "else")], "change_id int, key string, seg string, blob string")
    c = tickets.features(c, F.concat_ws("\n", "key", "seg", "blob"), F.col("seg"))
    scores = {(r.change_id, r.seq): r.score for r in tickets.rule_scores(t, c).collect()}
    assert scores[(10, 1)] == 0.95 and scores[(11, 2)] == 0.82 and scores[(12, 3)] == 0.95 and scores[(13, 4)] == 0.82
    assert rows(tickets.STRATEGIES["rules"](t, c), "change_id", "seq") == [(10, 1), (11, 2), (12, 3), (13, 4)]
    answers = tickets.answers_from_text(spark.createDataFrame([('```json\n{"matches": [{"seq": 1, "index": 14, "score": 0.9}]}\n```',), ("junk",)], "a string"), "a")
    both = tickets.hybrid(lambda a, b: tickets.assign(tickets.rule_scores(a, b).where("score >= 0.9")), tickets.external(answers))
    assert rows(both(t, c), "change_id", "seq") == [(10, 1), (12, 3)]


def test_incremental(spark):
    funcs = "path string, name string, signature string, body string, line_start int"
    a = spark.createDataFrame([("p", "f", "int f()", "{\n a;\n // c\n}", 1), ("p", "g", "int g()", "x", 9)], funcs)
    b = spark.createDataFrame([("p", "f", "int f()", "{\n b;\n // d\n}", 1), ("p", "h", "int h()", "x", 9), ("q", "g", "int g()", "x", 9)], funcs)
    assert rows(incremental.statement_changes(incremental.statement_fingerprints(a), incremental.statement_fingerprints(b)), "path", "name", "line", "change") == [("p", "f", 2, "modified"), ("p", "g", 9, "deleted"), ("p", "h", 9, "added"), ("q", "g", 9, "added")]
    done = incremental.tasks(incremental.function_fingerprints(a), incremental.function_fingerprints(b))
    assert {r.action for r in done.collect()} == {"generate"}
    edges = spark.createDataFrame([("x", "f"), ("f", "y")], "caller string, callee string")
    assert rows(incremental.dependents(spark.createDataFrame([("f",)], "name string"), edges), "name") == [("x",)]
    assert incremental.needs_refresh("auto", 2.0, 1.0) and not incremental.needs_refresh("auto", 1.0, 2.0) and not incremental.needs_refresh("off", 9.0, None)


def test_state_versions(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert incremental.read_state(spark, folder) is None
    first = spark.createDataFrame([(1, "a", 1)], "k int, h string, version int")
    incremental.write_state(first, folder)
    now = spark.createDataFrame([(1, "b"), (2, "c")], "k int, h string")
    incremental.write_state(incremental.update_state(incremental.read_state(spark, folder), now, ["k"]), folder)
    assert rows(incremental.read_state(spark, folder), "k", "h", "version") == [(1, "b", 2), (2, "c", 1)]


def test_planner(spark):
    funcs = "idx int, rel_path string, name string, body string"
    gone = spark.createDataFrame([(0, "a.c", "old_name", "int old_name(int x) { return x + 1; /* c */ }"), (1, "b.c", "q", "int q() { return 1; }")], funcs)
    come = spark.createDataFrame([(2, "a.c", "new_name", "int new_name(int x) { return x + 1; }"), (3, "c.c", "q2", "int q2() { return 1; }")], funcs)
    assert rows(planner.renames(gone, come), "old_name", "new_name") == [("old_name", "new_name")]
    symbols = spark.createDataFrame([("extern int speed; typedef struct A A_t;", "extern int velocity;")], "a string, b string").select(planner.changed_symbols(F.col("a"), F.col("b"))).first()[0]
    assert symbols == ["A_t", "speed", "velocity"]
    plan = spark.createDataFrame([(0, "modified_function", "a.c", "f"), (1, "new_function", "a.c", "n"), (2, "deleted_function", "a.c", "f"), (3, "modified_function", "a.c", "zz"), (4, "header_changed", "h.h", "")], "idx int, change_kind string, rel_path string, function_name string")
    index = spark.createDataFrame([("f", "E1")], "name string, entry_id string")
    got = {r.idx: r.status for r in planner.classify(plan, index).collect()}
    assert got == {0: "safe", 1: "review", 2: "review", 3: "manual", 4: "manual"}
    decided = planner.decide(planner.classify(plan, index), spark.createDataFrame([(1, "insert"), (2, "skip")], "idx int, decision string"))
    assert {r.idx: r.status for r in decided.collect()} == {0: "applied", 1: "applied_review", 2: "skipped_review", 3: "manual", 4: "manual"}


def test_revise_and_quality(spark):
    bundle = spark.createDataFrame([("a", "h1"), ("b", "h2")], "key string, hash string")
    made = spark.createDataFrame([("a", "h1", "ok"), ("b", "zz", "ok"), ("c", "h", "ok")], "key string, source_hash string, decision string")
    assert rows(revise.decisions_on(bundle, made), "key", "state") == [("a", "applied"), ("b", "stale"), ("c", "unknown")]
    blocks = spark.createDataFrame([("x /* USER CODE BEGIN A */keep/* USER CODE END A */ y",)], "c string")
    assert blocks.select(revise.user_blocks(F.col("c"))).first()[0] == {"A": "keep"}
    lines = quality.inspect_lines(spark.createDataFrame([("f(a",), ("fine",), ("the the end",), (None,)], "text string"))
    assert [r.codes for r in lines.collect()] == [["unbalanced"], [], ["doubled"], []]
    one = spark.range(1).select(quality.score(F.lit(10), F.lit(1), F.lit(1), F.lit(4), F.lit(1), F.lit(0), F.lit(0), F.lit(False), F.lit(True)))
    assert one.first()[0] == 100 - 3 - 2 - 5 - 10 - 5


def test_global_numbers_and_blocks(spark):
    from deltaloom.operators.ordering import block_join, number_rows

    values = list(range(200))
    random.Random(5).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    assert {r.v: r.n for r in number_rows(df, [F.col("v")], "n", 10).collect()} == {v: v + 10 for v in values}
    few = spark.createDataFrame([(k,) for k in range(25)], "k int")
    met = block_join(df, few, "k", F.col("v") % 50 == F.col("k"), most=4)
    assert rows(met, "v", "k") == sorted((v, v % 50) for v in values if v % 50 < 25)
    decisions = spark.createDataFrame([(1, "safe", None, None), (2, None, "a.c", "f"), (3, None, None, None)], "decision_id int, action string, rel_path string, function_name string")
    items = spark.createDataFrame([(7, "safe", "a.c", "f"), (8, "edit", "b.c", "g")], "idx int, action string, rel_path string, function_name string")
    assert rows(planner.match_decisions(decisions, items), "decision_id", "idx") == [(1, 7), (2, 7)]


@pytest.mark.parametrize("few", [1_000, 0])
def test_greedy_of_few_ends_cuts_no_edge_that_counts(spark, monkeypatch, few):
    """Four tickets and many changes: the rounds see as many edges of a ticket as there are tickets, with the same result."""
    monkeypatch.setattr(assign, "FEW_ENDS", few)
    pick = random.Random(5)
    rows = [(i, j, pick.randrange(4) / 4) for i in range(60) for j in range(4)] + [(i, 3, 2.0) for i in (1, 1, 2)] + [(1, 3, 0.1)]
    edges = spark.createDataFrame(rows, "a long, b long, s double")
    want, left, right = [], set(), set()
    for s, i, j in sorted((-s, i, j) for i, j, s in rows):
        if i not in left and j not in right:
            want.append((i, j, -s))
            left.add(i)
            right.add(j)
    assert sorted(tuple(r) for r in assign.greedy(edges, "a", "b", "s").collect()) == sorted(want)
    order = [F.desc("s"), F.asc("a"), F.asc("b")]
    if few:
        assert assign._hopeful(edges, "b", order).count() == 16


def test_an_index_holds_only_the_grams_that_are_sought(spark, monkeypatch):
    written = {}
    plain = candidates.materialise
    monkeypatch.setattr(candidates, "materialise", lambda df, label: written.setdefault(label, plain(df, label)))
    texts = spark.createDataFrame([(k, f"text of number {k} " * 40) for k in range(20)] + [(99, None), (100, "")], "t long, text string")
    needles = spark.createDataFrame([(1, "number 7 text"), (2, ""), (3, None), (4, "absent words"), (5, "7")], "s long, needle string")
    found = {(r.s, r.t) for r in candidates.containment_pairs(needles, texts, "s", "needle", "t", "text").collect()}
    assert {(1, 7), (5, 7), (5, 17)} <= found
    assert written["grams"].count() <= 20 * 4  # before: over a thousand grams of every kind
    written.clear()
    monkeypatch.setattr(candidates, "FEW_GRAMS", 0)
    assert found <= {(r.s, r.t) for r in candidates.containment_pairs(needles, texts, "s", "needle", "t", "text").collect()}

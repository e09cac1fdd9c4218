"""Candidate joins, rules, retrieval bounds, components, long alignments, retry rounds and the state log against brute force."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltaloom.functions import blocks, similarity
from deltaloom.operators import alignment, candidates, facts, graph, incremental, pairing, retry, rules, sections, statelog, terms, tickets
from deltaloom.plans.session import materialise


def test_matching_blocks_with_a_bound():
    pick = random.Random(4)
    word = lambda: "".join(pick.choices("abcdeé", k=pick.randint(1, 6)))
    for n in (150, 400):
        a = " ".join(word() for _ in range(n))
        words = a.split(" ")
        for k in range(0, n, 3):
            words[k] = word()
        for b in (" ".join(words), " ".join(words[n // 2 :] + words[: n // 2]), " ".join(word() for _ in range(n)), a):
            want = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            assert similarity.matched(a, b) == want
            assert similarity.matched(a, b, want) == want and similarity.matched(a, b, want - 0.5) == want
            assert similarity.matched(a, b, want + 1) in (0, want)


def test_containment_candidates_lose_nothing(spark):
    pick = random.Random(2)
    texts = ["".join(pick.choices("abc é日", k=pick.choice((0, 1, 5, 40, 300)))) for _ in range(120)] + [None]
    needles = ["", None, "absent from all of them"] + [t[a : a + n] for t in texts if t for n in (1, 2, 3, 4, 7, 8, 14, 15, 30, 71, 150) for a in (pick.randint(0, len(t)),)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    s = spark.createDataFrame(list(enumerate(needles)), "seq long, needle string")
    got = {(r.seq, r.id) for r in candidates.containment_pairs(s, t, "seq", "needle", "id", "body").collect()}
    want = {(i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if x and y and x in y}
    assert want <= got and len(got) < 3 * len(want)
    assert candidates.containment_pairs(s.limit(0), t, "seq", "needle", "id", "body").count() == 0


@pytest.mark.parametrize("cell", [2_000, 3])
def test_length_candidates_lose_nothing(spark, monkeypatch, cell):
    monkeypatch.setattr(candidates, "CELL_ROWS", cell)
    pick = random.Random(3)
    a = [(i, pick.choice((0, 1, 2, 5, 40, 41, 300)), i % 2) for i in range(40)]
    b = [(i, pick.choice((0, 1, 3, 16, 90, 41, 5000)), i % 3) for i in range(40)]
    x, y = spark.createDataFrame(a, "i long, n long, p long"), spark.createDataFrame(b, "j long, m long, q long")
    for least in (0.244, 0.55, 0.9):
        close = lambda m, n: m + n == 0 or 2 * min(m, n) >= least * (m + n)
        got = sorted((r.i, r.j) for r in candidates.length_pairs(x, y, F.col("n"), F.col("m"), least).collect())
        assert got == sorted((i, j) for i, n, _ in a for j, m, _ in b if close(n, m))
        got = sorted((r.i, r.j) for r in candidates.length_pairs(x, y, F.col("n"), F.col("m"), least, (["p"], ["q"])).collect())
        assert got == sorted((i, j) for i, n, p in a for j, m, q in b if p == q and close(n, m))


def test_bounds_of_many_pairs_lose_none():
    """Pairs that reach what they need stay, whatever the letters; of those that do not some go."""
    pick = random.Random(5)
    blocks_of = lambda x, y: sum(z.size for z in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    lost = gone = 0
    for letters in ("ab", "abcde ", "abcdefghijklmnop \n", "日本語abc é😀x"):
        for kinds in (3, 12, 60):
            words = ["".join(pick.choices(letters, k=pick.randint(1, 9))) for _ in range(kinds)]
            a = ["".join(pick.choice(words) for _ in range(n)) for n in (0, 1, 3, 20, 60, 90)]
            b = ["".join(pick.choice(words) for _ in range(n)) for n in (0, 2, 20, 60, 80)] + [a[4], a[3][::-1], a[3] + "zz" + a[4]]
            held = np.array([[blocks_of(x, y) for y in b] for x in a], dtype=float)
            for more in (0, 1):
                alive = np.ones(held.shape, dtype=bool)
                blocks.drop_hopeless(a, b, alive, held + more - 1e-6)
                lost, gone = lost + (0 if more else int((~alive).sum())), gone + int((~alive).sum())
            titles = ["".join(pick.choice(words) for _ in range(n))[:80] for n in (0, 1, 4, 5, 20)]
            ratio = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
            assert (blocks.title_bounds(titles, titles[::-1]) >= np.array([[ratio(x, y) for y in titles[::-1]] for x in titles]) - 1e-12).all()
    assert lost == 0 and gone > 100


def test_fuzzy_pairs_compare_few_pairs_one_by_one(spark, monkeypatch):
    """Texts of one language and one length, all unlike: no pair is compared letter by letter, the one that is alike is found."""
    pick = random.Random(8)
    words = ["".join(pick.choices("etaoinshrdlu", k=pick.randint(2, 8))) for _ in range(400)]
    text = lambda: " ".join(pick.choice(words) for _ in range(150))
    sides = [[("en > src > Doc en (%d)" % (k + s), "Doc en (%d)" % (k + s), text()) for k in range(30)] for s in (100, 500)]
    sides[1][7] = (*sides[1][7][:2], sides[0][3][2][:500] + text()[:400])
    old, new = (pd.DataFrame([(i, t, t, k, "en > src", body) for i, (k, t, body) in enumerate(side)], columns=["ord", "f_title", "f_leaf", "f_key", "parent", "body"]) for side in sides)
    asked = []
    monkeypatch.setattr(pairing, "text_ratio", lambda a, b, least=0.0: asked.append(a) or similarity.text_ratio(a, b, least))
    found = pairing._cell_scores(old, new, pairing.LEAST_SCORE, (0.24, 0.38))
    assert [(i, j) for i, j, _ in found] == [(3, 7)] and sum(len(t) > 100 for t in asked) < 0.1 * 30 * 30  # bodies, without titles


def test_fuzzy_pairs_equal_brute_force(spark, sf_dir):
    """All phases over the two simulated versions, the similarity phases computed pair by pair in plain Python."""
    from deltaloom.plans.versions import versions

    old, new = versions(spark, sf_dir)
    plan = pairing.pair_sections(old, new)
    got = {(r.old_ord, r.new_ord): (r.method, round(r.score, 9)) for r in plan.collect()}
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()
    rest = [[r for r in pairing.prepare(side).collect()] for side in (old, new)]
    used = [{k[0] for k, v in got.items() if v[0] in ("uid", "uid_title", "key")}, {k[1] for k, v in got.items() if v[0] in ("uid", "uid_title", "key")}]
    a, b = ([r for r in side if r.ord not in gone] for side, gone in zip(rest, used))
    ratio = lambda x, y: 1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()

    def score(x, y):
        title = max(ratio(x.f_title, y.f_title), ratio(x.f_leaf, y.f_leaf), ratio(x.f_key, y.f_key))
        raw = 0.55 * title + 0.45 * ratio(x.body, y.body)
        return min(1.0, raw + 0.06) if x.parent and x.parent == y.parent else raw

    edges = sorted((-s, x.ord, y.ord) for x in a for y in b for s in (score(x, y),) if s >= pairing.LEAST_SCORE)
    want, left, right = {}, set(), set()
    for s, i, j in edges:
        if i not in left and j not in right:
            want[i, j] = ("fuzzy", round(-s, 9))
            left.add(i)
            right.add(j)
    assert {k: v for k, v in got.items() if v[0] == "fuzzy"} == want


def test_ticket_rules_have_no_nested_loop(spark):
    blank = "array<string>"
    t = spark.createDataFrame([(1, "ab", [], [], []), (2, "long title of a ticket修改", [], [], []), (3, "x", [], [], []), (4, None, [], [], [])], f"seq long, title string, ids {blank}, paths {blank}, idents {blank}")
    c = spark.createDataFrame([(1, "part > a", "", "zab", [], [], []), (2, "ab > q", "", "", [], [], []), (3, "k > w", "", "see long title of a ticket now", [], [], []), (4, "k > long", "", None, [], [], []), (5, "k", "", "Long title of a ticket 修改", [], [], [])], f"change_id long, key string, seg string, blob string, ids {blank}, paths {blank}, idents {blank}")
    found = tickets.rule_scores(t, c)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r.change_id, r.seq): (round(r.score, 3), r.reason) for r in found.collect()}
    assert got[1, 1] == (0.7, "title<leaf+sim:0.80") and got[2, 1] == (0.68, "title<key") and got[3, 2][0] >= 0.62 and got[4, 2] == (0.7, "title<leaf") and "sim:" in got[5, 2][1]
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 2), (4, 2), (5, 2)} | {(4, 4), (2, 4)}  # two empty texts are alike


def test_forward_chaining_reaches_the_fixed_point(spark):
    table = rules.rule_table(spark, [("b", "1", [("a", "1")]), ("c", "1", [("b", "1"), ("x", None)]), ("d", "1", [("c", "1"), ("a", "1")]), ("a", "1", [("d", "1")]), ("e", "1", [("zz", "1")])])
    facts = spark.createDataFrame([(1, "a", "1"), (1, "x", "7"), (2, "a", "1"), (2, "a", "1"), (3, None, "1"), (4, "x", None)], "id int, property string, value string")
    got = sorted((r.id, r.property, str(r.value)) for r in rules.forward_chain(facts, table, "id").collect())
    assert got == [(1, "a", "1"), (1, "b", "1"), (1, "c", "1"), (1, "d", "1"), (1, "x", "7"), (2, "a", "1"), (2, "b", "1"), (4, "x", "None")]
    assert rules.forward_chain(facts.limit(0), table, "id").count() == 0


def test_elements_of_statements(spark):
    code = ["0 < x", "if_flag == NULL", "memset((u8 *)&buf[2], 0x0, 4)", "memmove(a, b, 2);", "f = false;", "return E_TIMEOUT;", "return x + 1;", "a == b && c", "x += 1;", None, ""]
    rows = spark.createDataFrame(list(enumerate(code)), "id int, code string")
    names = spark.createDataFrame([("x", "speed"), ("x", "speed"), ("a", "target")], "ident string, cn string")
    got = {r.id: (r.element, r.meaning, r.subject, r.object) for r in rules.elements(rows, "id", "code", names).collect()}
    assert got == {0: ("condition", "greater_than", "speed", "0"), 1: ("condition", "equals", "if_flag", "NULL"), 2: ("action", "clear", "buf[2]", None), 3: ("action", "copy", "target", "b"), 4: ("action", "set_false", "f", None), 5: ("return", "timeout", None, None)}


def test_rule_lists_do_not_grow_the_plan(spark):
    rows = spark.createDataFrame([(1, ["get", "speed"]), (2, ["speed", "get"]), (3, []), (4, None)], "id int, words array<string>")
    table = spark.createDataFrame([(k, "any", f"w{k}", f"L{k}") for k in range(48)] + [(50, "first", "get", "reader"), (49, "last", "get", "late")], "priority int, place string, word string, label string")
    found = rules.first_match(rows, "id", F.col("words"), table)
    assert {r.id: r.label for r in found.collect()} == {1: "reader", 2: "late"} and found._jdf.queryExecution().toString().count("CASE WHEN") == 0


def test_retrieval_skips_hot_postings(spark):
    """A value that all items share is looked up for surviving candidates only; the rows are those of the whole join."""
    pick = random.Random(6)
    weights = {"word": 3, "tag": 1}
    items = [(i, "tag", "everywhere") for i in range(400)] + [(i, "word", f"w{pick.randint(0, 60)}") for i in range(400) for _ in range(3)]
    asked = [(q, "tag", "everywhere") for q in range(12)] + [(q, "word", f"w{pick.randint(0, 60)}") for q in range(10) for _ in range(4)] + [(20, "tag", "nowhere")]
    a, b = spark.createDataFrame(asked, "query_id int, feature string, value string"), spark.createDataFrame(items, "item_id int, feature string, value string")
    want = {}
    for q in {x[0] for x in asked}:
        scores = []
        for i in range(400):
            mine = {(f, v) for k, f, v in asked if k == q} & {(f, v) for k, f, v in items if k == i}
            by = {f: sum(x[0] == f for x in mine) for f in weights}
            if mine:
                scores.append((-sum(weights[f] + min(2, n - 1) for f, n in by.items() if n), i))
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(sorted(scores)[:6], 1)}
    for hot in (50, 10_000):
        assert {(r.query_id, r.rank): (r.item_id, r.score) for r in terms.retrieve(a, b, weights, hot=hot).collect()} == want
    kept, whole, _ = terms.retrieval_candidates(a, b, weights, hot=50)
    assert {r.query_id for r in whole.collect()} >= {10, 11} and whole.count() < 6 and kept.count() < 1000  # of 4,800 pairs in the whole join


def test_scopes_widen_until_one_tells(spark):
    evidence = [("t", "near", "f1", "m1", "g1"), ("t", "mid", "f2", "m1", "g1"), ("t", "mid", "f3", "m1", "g1"), ("t", "far", "f9", "m9", "g9"), ("t", " ", "f1", "m1", "g1"), ("t", None, "f1", "m1", "g1"), ("u", "x", None, None, None)]
    e = spark.createDataFrame(evidence, "token string, text string, file string, module string, family string")
    a = spark.createDataFrame([(1, "t", "f1", "m1", "g1"), (2, "t", "f2", "m2", "g1"), (3, "t", None, None, None), (4, "v", "f1", "m1", "g1"), (5, "u", "f1", "m1", "g1")], "ask int, token string, file string, module string, family string")
    got = lambda least: {r.ask: (r.concept, r.level, r.support) for r in terms.scoped_concepts(e, a, least=least).collect()}
    assert got(1) == {1: ("near", 0, 1), 2: ("mid", 0, 1), 3: ("mid", 3, 4), 5: ("x", 3, 1)}
    assert got(2) == {1: ("mid", 1, 3), 2: ("mid", 2, 3), 3: ("mid", 3, 4), 5: ("x", 3, 1)}


def test_suffixes_pass_names_that_exist(spark):
    titles = ["a", "a", "a_2", "a", "a_4", "b", "b", "a_2", None, None, "a_02", "a_0"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = [r.unique_title for r in sections.unique_titles(df, "title", "id").orderBy("id").collect()]
    assert got == ["a", "a_3", "a_2", "a_5", "a_4", "b", "b_2", "a_2_2", None, None, "a_02", "a_0"]


def test_strong_components(spark):
    pick = random.Random(9)
    for n, m in ((12, 14), (20, 34)):
        edges = [(pick.randint(0, n), pick.randint(0, n)) for _ in range(m)]
        df = spark.createDataFrame(edges, "source int, target int")
        nodes = {x for e in edges for x in e}
        reach = {v: {v} for v in nodes}
        for _ in nodes:
            for a, b in edges:
                for v in nodes:
                    if a in reach[v]:
                        reach[v].add(b)
        want = {v: max(u for u in reach[v] if v in reach[u]) for v in nodes}
        assert {r.node: r.component for r in graph.strong_components(df).collect()} == want
        starts = spark.createDataFrame([(v,) for v in (0, 1, 2, 99)], "node int")
        assert {(r.root, r.node) for r in graph.reachable(starts, df).collect()} == {(v, u) for v in (0, 1, 2, 99) for u in reach.get(v, {v})}
    dense = spark.createDataFrame([(k, (k * d + 1) % 200) for k in range(200) for d in (1, 3, 7, 11)], "source int, target int")
    assert graph.component_closure(dense)[1].count() == 1  # 40,000 pairs of nodes, one of components


def test_reach_sizes(spark, monkeypatch):
    pick = random.Random(3)
    edges = [(pick.randint(0, 40), pick.randint(0, 40)) for _ in range(48)] + [(None, 3), (5, None), (7, 7)]
    reach = {x: {x} for e in edges for x in e if x is not None}
    for _ in reach:
        for a, b in (e for e in edges if None not in e):
            for seen in reach.values():
                if a in seen:
                    seen.add(b)
    want = {(v, max(u for u in r if v in reach[u]), len(r)) for v, r in reach.items()}
    assert sorted(map(tuple, graph.reach_sizes(spark.createDataFrame(edges, "source int, target int")).collect())) == sorted(want)

    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append((label, made := materialise(df, label))) or made)
    ring = [(k, (k + 1) % 90) for k in range(90)]  # 30 nodes lead to the ring in steps, and it leads to 30
    tails = [(100 + k, 101 + k) for k in range(30)] + [(130, 0), (9, 200)] + [(200 + k, 201 + k) for k in range(30)]
    got = {r.node: (r.component, r.n_reached) for r in graph.reach_sizes(spark.createDataFrame(ring + tails, "source int, target int")).collect()}
    assert got == {k: (89, 121) for k in range(90)} | {100 + k: (100 + k, 152 - k) for k in range(31)} | {200 + k: (200 + k, 31 - k) for k in range(31)}
    assert len(written) < 120  # rounds do not go along the ring, 90 each way, one edge at a time
    assert sum(made.count() for label, made in written if label == "pairs") < 1000  # 961 within the tails; 930 more lead through the ring


def check_alignment(spark, old, new):
    side = lambda rows: spark.createDataFrame([(s, k * 10, v) for s, values in rows.items() for k, v in enumerate(values)], "seq string, ord int, value string")
    rows = alignment.align(side(old), side(new), "seq", "ord", "value").collect()
    equal = {}
    for s in {*old, *new}:
        mine = [r for r in rows if r.seq == s]
        assert sorted(r.old_ord for r in mine if r.tag != "insert") == [k * 10 for k in range(len(old.get(s, [])))]
        assert sorted(r.new_ord for r in mine if r.tag != "delete") == [k * 10 for k in range(len(new.get(s, [])))]
        pairs = sorted((r.old_ord // 10, r.new_ord // 10) for r in mine if r.tag == "equal")
        assert all(old[s][i] == new[s][j] for i, j in pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        equal[s] = len(pairs)
    return equal


def test_alignment_of_sequences(spark):
    pick = random.Random(12)
    old, new, least = {}, {}, {}
    for s in range(12):
        values = [f"v{k}" for k in range(60)] if s % 2 else [pick.choice("abcdefgh") for _ in range(40)]
        edited = [v for v in values if pick.random() > 0.15]
        for _ in range(4):
            edited.insert(pick.randint(0, len(edited)), f"new{pick.randint(0, 99)}")
        if s % 3 == 0:
            edited = edited[10:] + edited[:10]
        old[str(s)], new[str(s)] = values, edited
        if s % 2:  # all values unique: the least script is the longest rising chain
            place = {v: k for k, v in enumerate(edited)}
            best: list = []
            import bisect

            for v in values:
                if v in place:
                    k = bisect.bisect_left(best, place[v])
                    best[k : k + 1] = [place[v]]
            least[str(s)] = len(best)
    old["same"], new["same"], old["gone"], new["come"] = ["x"] * 50, ["x"] * 52, ["y", None], ["z"]
    equal = check_alignment(spark, old, new)
    assert {s: equal[s] for s in least} == least and equal["same"] == 50 and equal["gone"] == equal["come"] == 0


def test_alignment_never_makes_one_array(spark, monkeypatch):
    """With anchors between them no stretch needs an array: 20,000 elements with no cell allowed."""
    monkeypatch.setattr(alignment, "STRETCH_CELLS", 0)
    values = [f"v{k}" for k in range(20_000)]
    assert check_alignment(spark, {"s": values}, {"s": values[:7_000] + ["n"] + values[7_500:]})["s"] == 19_500


def test_retry_rounds(spark):
    tasks = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, None)], "key int")
    plan = {(1, 1): (5, 0), (2, 1): (5, 2), (2, 2): (6, 2), (2, 3): (9, 0), (3, 1): (5, 2), (3, 2): (5, 2), (4, 1): (1, 3), (4, 2): (1, 2), (4, 3): (1, 1)}
    seen = []

    def attempt(rows, n):
        keys = [r.key for r in rows.collect()]
        seen.append(sorted(keys))
        return spark.createDataFrame([(k, f"c{n}", *plan[k, n]) for k in keys if (k, n) in plan], "key int, candidate string, score int, defects int")

    base = spark.createDataFrame([(3, "base"), (1, "base")], "key int, candidate string")
    got = {r.key: tuple(r)[1:] for r in retry.retry_rounds(tasks, "key", attempt, baseline=base).collect()}
    assert got == {1: ("c1", 5.0, 0, 1, "accepted"), 2: ("c3", 9.0, 0, 3, "accepted"), 3: ("base", 5.0, 2, 1, "baseline"), 4: ("c3", 1.0, 1, 3, "exhausted"), 5: (None, None, None, None, "stalled")}
    assert seen == [[1, 2, 3, 4, 5], [2, 3, 4], [2, 4]]


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_state_log(spark, tmp_path, monkeypatch):
    log, row = str(tmp_path / "log"), "k long, hash string"
    batch = lambda pairs: spark.createDataFrame(pairs, row)
    assert incremental.read_state(spark, log) is None
    statelog.merge_batch(batch([(k, f"hash {k} " * 20) for k in range(5_000)]), log, ["k"], 0)
    base = folder_bytes(tmp_path)
    statelog.merge_batch(batch([(1, "new"), (2, "hash 2 " * 20), (9_999, "x")]), log, ["k"], 1)
    assert folder_bytes(tmp_path) - base < base / 20  # what is written grows with the batch
    statelog.merge_batch(batch([(1, "never")]), log, ["k"], 1)  # the batch that ran again
    state = {r.k: (r.hash, r.version) for r in incremental.read_state(spark, log).where("k IN (1, 2, 3, 9999)").collect()}
    assert state == {1: ("new", 2), 2: ("hash 2 " * 20, 1), 3: ("hash 3 " * 20, 1), 9_999: ("x", 1)}
    monkeypatch.setattr(statelog, "MOST_DELTAS", 3)
    for n in range(2, 7):
        statelog.merge_batch(batch([(1, f"n{n}")]), log, ["k"], n)
        assert len(statelog._manifest(spark, log)[1]["segments"]) <= 3
    assert {r.k: r.version for r in incremental.read_state(spark, log).where("k < 3").collect()} == {0: 1, 1: 7, 2: 1}
    assert incremental.read_state(spark, log).count() == 5_001


def test_state_log_with_two_writers_and_a_crash(spark, tmp_path, monkeypatch):
    """Of two writers of one number one wins and the other merges again; a writer killed before its commit changes nothing."""
    log = str(tmp_path / "log")
    one, two = spark.createDataFrame([(1, "a")], "k long, hash string"), spark.createDataFrame([(1, "b"), (2, "c")], "k long, hash string")
    real, raced = statelog.commit, []

    def late(spark_, folder, number, content):
        if not raced:
            raced.append(number)
            statelog.merge_batch(two, log, ["k"])
        return real(spark_, folder, number, content)

    monkeypatch.setattr(statelog, "commit", late)
    statelog.merge_batch(one, log, ["k"])
    assert {r.k: (r.hash, r.version) for r in incremental.read_state(spark, log).collect()} == {1: ("a", 2), 2: ("c", 1)}

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(statelog, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        statelog.merge_batch(two, log, ["k"])
    assert {r.k: r.hash for r in incremental.read_state(spark, log).collect()} == {1: "a", 2: "c"}


def test_two_writers_of_versions(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "versions")
    rows = lambda v: spark.createDataFrame([(v,)], "v int")
    real, raced = incremental.rename_new, []

    def late(spark_, made, target):
        if not raced:
            raced.append(target)
            incremental.write_state(rows(1), folder)
        return real(spark_, made, target)

    monkeypatch.setattr(incremental, "rename_new", late)
    assert incremental.write_state(rows(2), folder).endswith("v=2")
    assert spark.read.parquet(f"{folder}/v=1").first().v == 1 and incremental.read_state(spark, folder).first().v == 2


def test_arguments_and_pairs(spark):
    lines = spark.createDataFrame([("f", 1, "x = Get(a, g(b, c), LEFT);"), ("f", 2, "x = Late(q);"), ("f", 3, "y == Get(a);"), ("f", 4, "l_y = StateGet();"), ("g", 1, None)], "key string, ord int, text string")
    symbols = spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "l_y"), ("g", "x")], "key string, symbol string")
    calls = facts.producing_calls(lines, symbols)
    assert {(r.key, r.symbol, r.callee, tuple(r.arguments)) for r in calls.collect()} == {("f", "x", "Get", ("a", "g(b, c)", "LEFT")), ("f", "l_y", "StateGet", ())}
    known = spark.createDataFrame([("Get", 0, "fault_level", "input")], "callee string, position int, parameter string, direction string")
    bound = facts.bind_arguments(calls, known)
    assert {(r.position, r.argument, r.parameter) for r in bound.collect()} == {(0, "a", "fault_level"), (1, "g(b, c)", None), (2, "LEFT", None)}
    assert {(r.symbol, r.tag) for r in facts.argument_tags(bound).collect()} == {("x", "fault_level"), ("x", "left")}
    rows = spark.createDataFrame([("k", 3, "v"), ("k", 1, "l_v"), ("k", 2, "s_v"), ("k", 2, "s_v"), ("k", 5, "l_"), ("k", 6, "w")], "key string, ord int, symbol string")
    assert {r.symbol: r.pairs for r in facts.paired_symbols(rows).collect()} == {"v": ["l_v", "s_v"], "l_v": ["s_v", "v"], "s_v": ["l_v", "v"]}


def test_diagnostic(spark):
    rows = spark.createDataFrame([(1, "A (SDD-x-1)", "k"), (2, "B (SDD-x-1)", "j"), (3, "C", "k"), (4, None, None), (5, "", ""), (6, "", "")], "ord int, title string, key string")
    got = {r.ord: (r.duplicate_key, r.duplicate_id) for r in sections.diagnostic(rows).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (False, False), 5: (False, False), 6: (False, False)}


def test_fuzzy_candidates_are_not_shuffled_as_pairs(spark):
    """Texts are dealt to cells before the join; no exchange stands above it."""
    rows = spark.createDataFrame([(k, f"t{k}", f"a > t{k}", "body " * (k + 1)) for k in range(6)], "ord long, title string, key string, body string")
    x, y = pairing._sides(*(pairing.prepare(side) for side in (rows, rows)))
    met = candidates.length_pairs(x, y, F.length("old_body"), F.length("new_body"), 0.3, least_cells=4)
    plan = pairing.pair_scores(met, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("Join Inner")[0]
    assert met.count() == sum(2 * min(a, b) >= 0.3 * (a + b) for a in range(5, 31, 5) for b in range(5, 31, 5))


def test_alignment_numbers_over_ranges(spark, monkeypatch):
    """No window takes a whole sequence: what numbers positions, places and stretches are ranges of rows, whatever their number."""
    plans, write = [], alignment.materialise
    monkeypatch.setattr(alignment, "materialise", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, label))[1])
    values = [f"v{k}" for k in range(3_000)]
    moved = values[1_500:1_600] + values[:700] + ["n"] + values[750:1_500] + values[1_600:]
    assert check_alignment(spark, {"s": values, "t": values[:9]}, {"s": moved, "t": ["x", *values[2:9]]}) == {"s": 2_850, "t": 7}
    windows = [line for plan in plans for line in plan.split("\n") if "Window [" in line and "differs" not in line and "_w" not in line and " k#" not in line and "AS k" not in line]
    assert windows and all("part_" in line for line in windows)

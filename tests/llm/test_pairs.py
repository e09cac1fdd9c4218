"""Embeddings, licenses, decontamination and the pipeline against brute force, and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import decontaminate, embeddings, licenses


def brute_links(vectors, threshold=0.95):
    ids = [i for i, v in vectors]
    unit = {}
    for i, v in vectors:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        unit[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None
    links = {i: {j for j in ids if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in ids}
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([component[i], *(component[j] for j in links[i])])
            changed |= low < component[i]
            component[i] = low
    return {i: (len(links[i]), component[i], component[i] == i) for i in ids}


def planted(seed, groups=25, size=8, dim=24):
    pick = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = pick.normal(size=dim)
        for _ in range(size):
            rows.append([float(np.float32(x)) for x in base + pick.normal(size=dim) * 0.12])
    rows += [rows[0]] * 12 + [[float(x) for x in pick.normal(size=dim)] for _ in range(150)]
    order = pick.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)]


def test_embeddings_recall(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 30)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "LEAST_RECALL", 0.0)
    rows = planted(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    wanted = brute_links(rows)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in wanted.values())
    assert all(got[i][0] <= wanted[i][0] for i in wanted) and found >= 0.95 * true
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.95 * len(wanted)


def spread_pairs(seed, pairs, dim=64, cosine=0.953):
    """Unit vectors without clusters, and one for each that is turned by the cosine's angle."""
    pick = np.random.default_rng(seed)
    x = embeddings.unit(pick.normal(size=(pairs, dim)))
    turn = pick.normal(size=x.shape)
    turn = embeddings.unit(turn - np.einsum("ij,ij->i", turn, x)[:, None] * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * turn


def test_embeddings_overlap_of_a_thousand_shards():
    sample, _ = spread_pairs(8, 8000)
    centre = embeddings.centroids(sample, 1000, rounds=3)
    count = embeddings.overlap(centre, spread_pairs(11, 1500)[0], 0.95)
    near = [np.argsort(-(v @ centre.T), axis=1) for v in spread_pairs(9, 1500)]
    together = lambda k: np.mean([len(set(a) & set(b)) > 0 for a, b in zip(near[0][:, :k], near[1][:, :k])])
    assert together(embeddings.OVERLAP) < 0.93 and together(count) >= 0.98
    assert count < 40


def test_embeddings_recall_of_spread_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 12)
    monkeypatch.setattr(embeddings, "BLOCK", 256)
    monkeypatch.setattr(embeddings, "SAMPLE", 600)
    x, y = spread_pairs(10, 1500)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate((x, y)))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert embeddings.audit_recall(df, embeddings.near_duplicates(df), queries=3000) >= 0.97


def test_embeddings_of_any_scale(spark):
    pick = np.random.default_rng(2)
    base = pick.normal(size=(20, 8))
    rows = [*base, *(base + pick.normal(size=base.shape) * 1e-3), np.full(8, 1e-200), np.full(8, 2e-200), np.full(8, 1e200), np.full(8, -1e200), np.full(8, 5e-324)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    scaled = [(i, [float(x) for x in np.array(v) / np.abs(v).max()]) for i, v in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(scaled) and got[40][0] == 3


def test_dense_groups_leave_no_pair_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    pick = np.random.default_rng(3)
    base = pick.normal(size=16)
    rows = [(i, [float(x) for x in base + pick.normal(size=16) * 0.01]) for i in range(400)] + [(400 + i, [float(x) for x in pick.normal(size=16)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, audited=0).collect()}
    assert got == brute_links(rows)
    links = embeddings.near_links(embeddings.representatives(df, "vec_id", "embedding"))
    assert links.count() < 400 * 40  # of 79,800 pairs


def test_embeddings_audit_widens_the_search(spark, monkeypatch):
    seen = []
    named = embeddings._named
    monkeypatch.setattr(embeddings, "_named", lambda *a: seen.append(a[-1]) or named(*a))
    monkeypatch.setattr(embeddings, "audit_recall", lambda *a: 0.5 if len(seen) < 3 else 0.99)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert [r.n_links for r in embeddings.near_duplicates(df).collect()] == [1, 1] and seen == [1, 2, 4]


def test_embeddings_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (9, [2.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [-0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, rep string, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_links(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.audit_recall(df, embeddings.near_duplicates(df)) == 1.0


def brute_licenses(rows, templates):
    import re

    def grams(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower())]
    out = {}
    for i, text in rows:
        words = split(text) if text is not None else []
        for name, template in templates.items():
            asked = [w for w in split(template) if w]
            wanted, n = grams(asked), len(asked)
            if not wanted:
                continue
            size = n + 2 * int(np.ceil(n * 0.25))
            best = max((len(wanted & grams(words[s : s + size])) / len(wanted) for s in range(len(words))), default=0)
            if best >= 0.8:
                out[i, name] = best
    return out


def test_licenses(spark, docs, texts, edge_docs, no_docs):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    words = apache.split()
    rows = [(1, f"intro words {mit} tail"), (2, "  " + " ".join(w for k, w in enumerate(words) if k not in (20, 60)) + " end"), (3, " ".join(words[: len(words) // 2])), (4, "Released under the MIT License. " * 3), (5, None), (6, ""), (7, "released UNDER the\nmit   license"), (8, "é" + mit.upper())]
    for name, table, source in (("planted", spark.createDataFrame(rows, "doc_id long, text string"), rows), ("documents", docs, texts.items())):
        got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan(table).collect()}
        assert got == pytest.approx(brute_licenses(source, licenses.TEMPLATES)), name
    assert licenses.scan(edge_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    assert licenses.scan(docs, templates={}).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_canonical_words(spark):
    rows = spark.createDataFrame([("Ann has 5.3 km and Bob İx 7kg. The end 12",), ("",), ("  -- ",)], "t string")
    got = rows.select(decontaminate.canonical_words(F.col("t")).alias("c"), decontaminate.plain_words(F.col("t")).alias("p")).collect()
    n, who, unit = decontaminate._NUMBER, decontaminate._NAME, decontaminate._UNIT
    assert [w for w in got[0].c if w] == ["ann", "has", n, unit, "and", who, who, n, unit, "the", "end", n]
    assert got[0].p == ["Ann", "has", "5.3", "km", "and", "Bob", "Ix", "7", "kg", "The", "end", "12"]
    assert [w for w in got[1].c + got[2].c if w] == [] and got[1].p == []


ITEM = "A train leaves the station with 40 passengers and then Alice counts 15 km of track before 40 people go home again today"


def test_decontamination_cases(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (1, ITEM), (4, "plain words without any slot at all in this benchmark question here")], "item_id long, text string")
    same = ITEM.replace("40", "99").replace("Alice", "Bob").replace("15", "8")
    broken = ITEM.replace("40", "99", 1).replace("Alice", "Bob")  # 40 has two partners
    rows = [(1, f"noise before {ITEM} noise"), (2, f"x y z {same} after"), (3, f"k {broken} k"), (4, "nothing of it"), (5, None), (6, ""), (7, "well plain words without any slot at all in this benchmark question here ok"), (8, ITEM[:60]), (7, "well plain words without any slot at all in this benchmark question here ok"), (None, ITEM)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, item string, at int"), items).collect()}
    assert (1, 1) in got and not got[1, 1].reparameterised and got[1, 1].coverage >= 0.8
    assert (2, 1) in got and got[2, 1].reparameterised
    assert set(got) == {(1, 1), (2, 1), (7, 4)}  # in 3 one value has two partners


SHORT = "yesterday Tom bought 3 apples for 2 dollars and Ann bought 4 pears for 5 dollars"


def test_decontamination_of_several_variants(spark):
    items = spark.createDataFrame([(1, SHORT)], "item_id long, text string")

    def variant(who, a, other, b):
        return f"yesterday {who} bought {a} apples for {a + 5} dollars and {other} bought {b} pears for {b + 3} dollars"

    kim, eve, long = variant("Kim", 12, "Lea", 30), variant("Eve", 44, "Max", 70), "w " * 12
    rows = [(1, f"{kim} {eve}"), (2, f"{SHORT} {kim}"), (3, f"{SHORT} {kim} {eve}"), (4, f"{kim} then {eve} then {variant('Pia', 9, 'Sam', 8)}"), (5, kim), (6, f"{eve} {long} {SHORT} and {kim}"), (7, "nothing of it"), (8, "bought 3 apples for 2 dollars " * 9)]
    got = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert all(r.coverage == 1.0 for r in got.values())
    assert {i for i, r in got.items() if not r.reparameterised} == {2, 3, 6}
    near = spark.createDataFrame([(1, f"{ITEM} today")], "item_id long, text string")
    same = ITEM.replace("40", "99").replace("Alice", "Bob").replace("15", "8")
    other = ITEM.replace("40", "71").replace("Alice", "Eve").replace("15", "6")
    loose = [x.replace("of track", "of very old track") for x in (same, other)]  # words put in
    rows = [(1, " ".join(loose)), (2, same.replace("before 99", "before 12")), (3, ITEM.replace("40", "99", 1))]
    got = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), near, coverage=0.7).collect()}
    alone = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame([(1, loose[0])], "doc_id long, text string"), near, coverage=0.7).collect()}
    assert got[1].n_matched == alone[1].n_matched
    assert all(got[i].n_matched < got[1].n_windows for i in (2, 3) if i in got)


def test_short_items_are_found_as_a_whole(spark):
    items = [(1, "What is 2 + 2?"), (2, "7 8 9 10 11 12 13 Yes"), (3, "yes"), (4, "true false"), (5, "-- !"), (6, "Tom has 3 km"), (6, "Tom has 3 km")]
    rows = [(1, "so what is 2 2 then"), (2, "what is 2 + 3"), (3, "WHAT IS\n2 - 2"), (4, "1 7 8 9 10 11 12 13 yes no"), (5, "7 8 9 10 11 12 13 no"), (6, "Yes!"), (7, "yes it is"), (8, "True, false."), (9, "tom HAS 3 km"), (10, "tom has 4 km"), (11, ""), (12, None), (None, "yes"), (1, "what is 2 2")]
    got = sorted((r.doc_id, r.item_id, r.n_windows, r.n_matched, r.reparameterised) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(i, k, 1, 1, False) for i, k in ((1, 1), (3, 1), (4, 2), (6, 3), (8, 4), (9, 6))]


def brute_slots(words, plain, item_words, item_plain, reach=decontaminate.REACH):
    """(windows, best count of one occurrence, whether only with other values) of an item in a text, word by word."""
    marks = (decontaminate._NUMBER, decontaminate._NAME, decontaminate._UNIT)
    grams = {at: item_words[at : at + 5] for at in range(len(item_words) - 4)}
    grams = {at: g for at, g in grams.items() if sum(w not in marks for w in g) >= 2}
    span = max(grams) - min(grams) + 5 if grams else 0
    hits = []
    for pos in range(len(words) - 4):
        for at, g in grams.items():
            if words[pos : pos + 5] == g:
                slots = [k for k in range(5) if g[k] in marks]
                hits.append((at, pos, [(item_plain[at + k].lower(), plain[pos + k].lower()) for k in slots]))
    places = {}
    for at, pos, pairs in hits:
        own = {("all",), ("line", pos - at)} | ({("same",)} if all(a == b for a, b in pairs) else set())
        for r in reach:
            width = max(2, int(r * span))
            own |= {(r, half, (pos - at + half * (width // 2)) // width) for half in (0, 1)}
        for place in own:
            places.setdefault(place, []).append((at, pairs))
    best = (0, False)
    for found in places.values():
        votes = {}
        for _, pairs in found:
            for a, b in pairs:
                votes.setdefault(a, {}).setdefault(b, 0)
                votes[a][b] += 1
        agreed = {a: min(v, key=lambda b: (-v[b], b)) for a, v in votes.items()}
        count = len({at for at, pairs in found if all(agreed[a] == b for a, b in pairs)})
        best = max(best, (count, not any(a != b for a, b in agreed.items())))
    return len(grams), best[0], not best[1]


def test_slots_against_brute_force(spark):
    import random

    pick = random.Random(31)
    items = [(1, SHORT), (2, f"{ITEM} today")]
    names, rows = ("Kim", "Eve", "Lea", "Max", "Pia"), []
    for i in range(60):
        copies = []
        for _ in range(pick.randint(1, 4)):
            text = pick.choice(items)[1]
            for old in ("40", "15", "3", "2", "4", "5"):
                if pick.random() < 0.5:
                    text = text.replace(f" {old} ", f" {pick.randint(6, 99)} ", pick.choice((1, -1)))
            for old in ("Alice", "Tom", "Ann"):
                if pick.random() < 0.5:
                    text = text.replace(old, pick.choice(names))
            words = text.split()
            if pick.random() < 0.3:
                del words[pick.randrange(len(words))]
            copies.append(" ".join(words))
        rows.append((i, " and ".join(copies)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    words = lambda df, i: {r[0]: ([w for w in r[1] if w], r[2]) for r in df.select(i, decontaminate.canonical_words(F.col("text")), decontaminate.plain_words(F.col("text"))).collect()}
    wanted = {}
    for item, (iw, ip) in words(bench, "item_id").items():
        for doc, (dw, dp) in words(docs, "doc_id").items():
            total, matched, changed = brute_slots(dw, dp, iw, ip)
            if matched >= 0.8 * total:
                wanted[doc, item] = (total, matched, changed)
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.reparameterised) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == wanted and 20 < len(got) < 2 * len(rows)


def test_decontamination_against_brute_force(spark, docs, texts, sf_dir, edge_docs, no_docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    words = lambda df, i, t: {r[0]: [w for w in r[1] if w] for r in df.select(i, decontaminate.canonical_words(F.col(t))).collect()}
    mine, theirs = words(docs, "doc_id", "text"), words(items, "item_id", "text")
    wanted = set()
    for item, ws in theirs.items():
        grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        grams = [g for g in grams if sum(w[0] not in (decontaminate._NUMBER, decontaminate._NAME, decontaminate._UNIT) for w in g) >= 2]
        for doc, own in mine.items():
            held = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            if grams and sum(g in held for g in grams) >= 0.8 * len(grams):
                wanted.add((doc, item))
    assert got == wanted
    assert decontaminate.contaminated(edge_docs, items).count() == 0 and decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, sf_dir, texts):
    import corpus_pipeline
    from deltaloom.llm import bpe, langid, secrets, simhash  # noqa: F401

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(100001, None, "en", "s", 0), (100002, "", "en", "s", 0), (100003, "12 34 !!", "en", "s", 8)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= kept
        if name == "language":
            assert kept - now == {100001, 100002, 100003}
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in simhash.similar_documents(before).collect()}
            assert now == {i for i in kept if groups[i] == i}
        if name == "benchmark":
            leaks = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert now == kept - leaks
        if name == "secrets":
            assert now == kept
            for r in docs.collect():
                assert r.n_chars == len(r.text) and not secrets.base_spans(r.text)
        kept = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = out.join(docs.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    assert rows.count() == len(kept) and rows.where("decoded_sha256 <> h").count() == 0


def stage_rows(spark, sf_dir, rows, extra="") -> dict:
    """What each stage makes of the same rows, by name."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in extra.split()})
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        out[name] = sorted(([*r] for r in found.collect()), key=str)
        assert name == "tokens" or found.columns == docs.columns
    return out


def test_stages_on_edge_rows(spark, sf_dir, texts):
    pick = [texts[i] for i in sorted(texts) if len(texts[i].split()) > 60][:3]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(1).collect()]
    leak = f"{pick[2]} {items[0]}"
    rows = [(3, pick[0]), (5, pick[0]), (5, pick[1]), (7, pick[1]), (7, pick[1]), (8, leak), (8, pick[2]), (None, pick[0]), (None, leak), (9, None), (10, ""), (11, "word " * 40_000), (12, 'token = "abcdef123456" end')]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    got = stage_rows(spark, sf_dir, rows, extra="key row fingerprint h ids")
    by = {name: [(r[0], r[1]) for r in found] for name, found in got.items()}
    same = lambda a, b: sorted(a, key=str) == sorted(b, key=str)
    given = [r[:2] for r in rows]
    assert same(by["language"], [(i, t) for i, t in given if t])
    # 5 keeps the text that no smaller id has; the repeated row stays once; rows without an id stay
    gone = [(5, pick[0]), (7, pick[1]), (7, pick[1]), (10, "")]
    near = [x for x in given if x not in gone]
    assert same([x for x in by["near_duplicates"] if x[0] != 8], [x for x in near if x[0] != 8])
    assert same(by["benchmark"], [(i, t) for i, t in given if t != leak])
    assert len(by["secrets"]) == len(given) and {i: t for i, t in by["secrets"]}[12].count("[SECRET]") == 1
    assert len(got["tokens"]) == len(given)
    assert all(found == [] for found in stage_rows(spark, sf_dir, []).values())

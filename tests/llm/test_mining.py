"""Collocations, conversation repair and personal data against brute force, and on edge rows."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from deltaloom.llm import collocations, conversations, pii
from deltaloom.llm._shared import text_chunks

# --- collocations


def brute_phrases(rows, least, share=80, top=2000):
    """lang -> ordered rows, from (lang, text)."""
    grams, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    key = (lang, tuple(words[i : i + n]))
                    grams[key] = grams.get(key, 0) + 1
    candidates = {k: a for k, a in grams.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in candidates.items():
        longer = [b for (other, h), b in candidates.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, k = min((2000000 * a // (grams[lang, g[:k]] + grams[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, -score, -a, " ".join(g).encode(), grams[lang, g[:k]], grams[lang, g[k:]]))
    found = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        found += [(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for rank, (_, s, a, p, l, r) in enumerate(group, 1) if rank <= top]
    return found


def phrases(df, **more):
    return sorted(tuple(r) for r in collocations.phrases_of(df, **more).collect())


def test_phrases_against_brute_force(spark, monkeypatch):
    """Small blocks cut inside texts and pieces; rows of two languages, one hot phrase, long keys packed by ranks."""
    rng = np.random.default_rng(3)
    words = ["Aa", "b", "c,", "d", "é", "f.", "g\n", "h\th", "i;"]
    rows = [(("en", "fr", None)[k % 3], " ".join(rng.choice(words, 40))) for k in range(60)] + [("en", "the hot phrase is here " * 50)] * 2
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 37)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert phrases(df, least=9) == sorted(brute_phrases(rows, 9))
    monkeypatch.setattr(collocations, "MANY", 1)  # eight bytes a word
    assert phrases(df, least=9, top=3) == sorted(brute_phrases(rows, 9, top=3))
    assert phrases(df, least=9, share=40, longest=4) == sorted(brute_phrases(rows, 9, share=40))


def test_phrases_of_real_texts(spark, docs):
    rows = [(r.lang, r.text) for r in docs.limit(60).collect()]
    assert phrases(spark.createDataFrame(rows, "lang string, text string"), least=6) == sorted(brute_phrases(rows, 6))


def test_packing_beyond_64_bits():
    columns = [np.array([5, 5, 1, 5], dtype=np.uint32), np.array([7, 7, 2, 7], dtype=np.uint32), np.array([9, 9, 3, 8], dtype=np.uint32), np.array([1, 1, 4, 1], dtype=np.uint32)]
    for top in (9, 1 << 30):
        kinds, count = collocations._packed(columns, top)
        assert sorted(zip(zip(*(x.tolist() for x in kinds)), count.tolist())) == [((1, 2, 3, 4), 1), ((5, 7, 8, 1), 1), ((5, 7, 9, 1), 2)]


def test_phrases_edges(spark, edge_docs, no_docs):
    assert phrases(no_docs) == []
    assert [r[2:4] for r in phrases(edge_docs)] == [("word word word word", 29_997)]
    assert phrases(edge_docs.limit(0)) == []
    assert phrases(spark.createDataFrame([(None, "a b " * 40), ("und", "a b")], "lang string, text string"))[0][0] == "und"


# --- conversations


def brute_repair(turns):
    """(facts, cost, audit, digest) of rows (turn, role, text), by all shortest paths over (place, state) with whole strings."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", ())}
    for i in range(len(turns) + 1):
        for _ in range(4):
            for s in range(4):
                if (i, s) in best:
                    c, a, t = best[i, s]
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if (s, x) in step:
                            to = (i, step[s, x])
                            best[to] = min(best.get(to, (9**9, "", ())), (c + 5, a + "I", (*t, f"{name}:")))
        if i == len(turns):
            break
        _, role, text = turns[i]
        more = 5 if faults[i] == "truncated" else 0
        for s in range(4):
            if (i, s) not in best:
                continue
            c, a, t = best[i, s]
            ways = [(s, c + 2, "D", t)]
            if faults[i] not in ("blank", "duplicate"):
                if (s, role[:1]) in step:
                    ways.append((step[s, role[:1]], c + more, "K", (*t, f"{role}:{text}")))
                ways += [(step[s, x], c + 1 + more, "R", (*t, f"{name}:{text}")) for x, name in (("u", "user"), ("a", "assistant")) if (s, x) in step]
            for to, cost, letter, kept in ways:
                best[i + 1, to] = min(best.get((i + 1, to), (9**9, "", ())), (cost, a + letter, kept))
    cost, audit, kept = min(best[len(turns), s] for s in (0, 3) if (len(turns), s) in best)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def repaired(df):
    return {r.conv_id: tuple(r)[1:] for r in conversations.repair(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def random_turns(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "No", " \t", "", "What?", "é!\n", "so…"]
    return [(int(t) if rng.random() > 0.1 else None, str(rng.choice(roles, p=[0.4, 0.35, 0.1, 0.1, 0.05])), str(rng.choice(texts)) + (f" {k}." if rng.random() < 0.5 else "")) for k, t in enumerate(np.sort(rng.integers(0, 2 * n, n)))]


def test_repair_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    convs = {c: random_turns(rng, int(rng.integers(1, 10))) for c in range(150)} | {1000: random_turns(rng, 300), None: random_turns(rng, 5)}
    rows = [(c, *t, "x") for c, turns in convs.items() for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").repartition(5)
    want = {c: brute_repair(turns) for c, turns in convs.items()}
    assert repaired(df) == want
    monkeypatch.setattr(conversations, "PIECE_TURNS", 3)  # every longer conversation is joined from pieces
    assert repaired(df) == want


def test_first_layers_are_least_costs():
    rng = np.random.default_rng(8)
    for _ in range(20):
        turns = random_turns(rng, 6)
        symbols = np.array([[3 * conversations.initial_of(r) + int(rng.integers(0, 3)) for _, r, _ in turns]])
        table = conversations.costs(symbols)[0]
        cost, audit, _ = conversations.traced(symbols, conversations.ENDS[None, :], np.zeros(1, np.int64))
        assert cost[0] == min(table[0, 0], table[0, 3]) and len(audit[0].replace("I", "")) == 6
        half = conversations.costs(symbols[:, :3])[0], conversations.costs(symbols[:, 3:])[0]
        assert (np.minimum((half[0][:, :, None] + half[1][None]).min(1), conversations.NEVER) == table).all()


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, cost string, part string"
    assert repaired(spark.createDataFrame([], schema)) == {}
    rows = [(1, None, None, None, "c", "p"), (2, 3, "user", "x" * 300_000 + ".", "c", "p"), (2, 4, "assistant", "ok.", "c", "p"), (3, 1, "system", "s.", "c", "p")]
    got = repaired(spark.createDataFrame(rows, schema))
    none = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 1, 0, 0, 0, 2, "D", none) and got[2][5:7] == (0, "KK") and got[3][5:] == (2, "D", none)


def test_damaged_rows_are_all_accounted_for(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    df = conversations.op12_conversations(spark, sf_dir)
    assert {r.conv_id for r in df.collect()} == {r.conv_id for r in rows.collect()}


# --- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
            good = (True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 8 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_patterns(texts):
    odd = ["a@b.c@d.e", "@@a@b.c", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 01.02.03.004", "+1 (2) 3-4 5678 901", "4111 1111 1111 1111-", "a.b@c..d", "a@b-.-c.", "a@b.c.d@e.f x%+@q.w", "+12345678+12345678", "0000000001.2.3.4", "é@é.é ü+1 234 567 89"]
    rng = np.random.default_rng(1)
    odd += ["".join(rng.choice(list("a@.1+- ()9%é"), 30)) for _ in range(3000)]
    for text in [*odd, *[t or "" for t in texts.values()]]:
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 1000) == []  # in time that grows with the text


@pytest.fixture(scope="module")
def field(texts):
    return pii.train([t or "" for t in texts.values()])


def tagged(field, text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = pii.Candidates()(data, np.array([0, len(data)]))
    return found, field.decode(found)


def test_messages_are_exact_on_trees(field):
    """Two chains joined by one link form a tree: the beliefs must be the marginals of the whole product."""
    found, _ = tagged(field, "call 555-3824 now then 555-3824 9 ok")
    assert found["links"].tolist() == [[0, 1]] and found["first"].tolist() == [0, 1]
    e = field.emissions(found)
    _, forward, backward, _, _ = field.messages(e, found)
    belief = np.exp(pii._norm(forward + backward))
    want = np.zeros_like(belief)
    for path in itertools.product(range(pii._LABELS), repeat=3):
        weight = np.exp(sum(e[k, y] for k, y in enumerate(path)) + field.start[path[0]] + field.start[path[1]] + field.move[path[1], path[2]] + field.skip[path[0], path[1]])
        for k, y in enumerate(path):
            want[k, y] += weight
    assert np.allclose(belief, want / want.sum(1, keepdims=True), atol=1e-9)


def test_viterbi_is_the_best_path(field):
    found, tags = tagged(field, "x +1 (743) 555-3824 9 y")
    e = field.messages(field.emissions(found), found)[0]
    value = lambda p: sum(e[k, y] for k, y in enumerate(p)) + field.start[p[0]] + sum(field.move[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(pii._LABELS), repeat=len(tags)), key=value)
    assert abs(value(best) - value(tags.tolist())) < 1e-9


def test_labels_agree_across_a_document(field):
    """The same bare number is personal where a distant mention is, and nothing where the distant mention is not."""
    middle = " ".join(["plain words follow here"] * 30)
    _, named = tagged(field, f"phone 743-555-3824 {middle} 743-555-3824 again")
    _, other = tagged(field, f"order 743-555-3824 {middle} 743-555-3824 again")
    assert named.tolist() == [7, 7] and other.tolist() == [0, 0]
    held = pii.generated_documents(200, seed=99)
    right = wrong = missed = 0
    for text, spans in held:
        found, tags = tagged(field, text)
        got = {(int(tags[k] - 1) // 2, int(found["starts"][k])) for k in np.flatnonzero(tags % 2 == 1)}
        want = {(kind, a) for kind, a, _ in spans}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right > 0.97 * (right + missed) and wrong < 0.03 * (right + wrong)


def test_pii_operator(spark, docs, texts, field, edge_docs, edge_rows, no_docs):
    rows = {r.doc_id: r for r in pii.scan(docs, field=field).collect()}
    for doc, text in texts.items():
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(text or "")]
        spans = [s for s in rows[doc].spans.split(",") if s]
        assert rows[doc].base_spans == ",".join(base) and set(base) <= set(spans)
        assert [rows[doc][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in base) for k in pii.KINDS]
        assert rows[doc].n_added == len(spans) - len(base)
        places = [(pii.KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])) for s in spans]
        assert places == sorted(places) and all(0 <= a < b <= len(text or "") for _, a, b in places)
    assert pii.scan(edge_docs, field=field).count() == len(edge_rows)
    assert pii.scan(no_docs, field=field).count() == 0
    assert pii.scan(no_docs).count() == 0
    assert pii.scan(edge_docs, field=field, carry=True).where("row.text_ = 'x'").count() == len(edge_rows)


def test_spans_depend_on_the_text_alone(field, texts):
    """Texts scanned together give the tags of each scanned alone; entities are never joined across texts."""
    some = [t or "" for t in texts.values()][:80]
    for _, _, data, bounds in text_chunks(pa.array(some)):
        found = pii.Candidates()(data, bounds)
        together = field.decode(found)
        for k, text in enumerate(some):
            assert together[found["owner"] == k].tolist() == tagged(field, text)[1].tolist()


def test_redacted_texts(spark, field):
    df = spark.createDataFrame([(1, "mail é a.b@c.de or +1 (743) 555-3824."), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in pii.redact(df, field=field).orderBy("doc_id").collect()] == ["mail é [EMAIL] or [PHONE].", None, ""]

"""Queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from deltaloom.llm import bpe, collocations, conversations, conversations_sql, decontaminate, embeddings, langid, licenses, lm, pii, quality, secrets, simhash, substring

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_secrets": secrets.op3_secrets,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_licenses": licenses.op5_licenses,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_lm_scores": lm.op7_lm_scores,
    "op8_language_id": langid.op8_language_id,
    "op9_quality": quality.op9_quality,
    "op10_substring": substring.op10_substring,
    "op11_collocations": collocations.op11_collocations,
    "op12_conversations": conversations.op12_conversations,
    "op13_pii": pii.op13_pii,
}

#: The others hold trained models, seeded 64-bit hashes, tokenizers or look-behind patterns; tests/llm has their brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
parts AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON node = vec_id LEFT JOIN counts ON a = vec_id""",
    "op10_substring": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM p JOIN f USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT words.doc_id, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY words.k)) AS digest FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY 1)
SELECT w.doc_id, len(ws)::bigint AS n_words, len(ws) - coalesce(n, 0) AS n_removed, coalesce(digest, sha256('')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op11_collocations": r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::bigint AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, g, string_split(g, ' ') AS ws, c AS a FROM f WHERE m >= 2 AND c >= 30),
part AS MATERIALIZED (SELECT struct_pack(lang := lang, g := g) AS key, c FROM f WHERE c >= 30),
cut AS MATERIALIZED (SELECT *, array_to_string(list_slice(ws, 1, k), ' ') AS left, array_to_string(list_slice(ws, k + 1, m), ' ') AS right FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
cuts AS (SELECT cand.lang, cand.g, a, k, x.c AS l, y.c AS r, (2000000::hugeint * a) // (x.c::hugeint + y.c) AS score
         FROM cut cand JOIN part x ON x.key = struct_pack(lang := cand.lang, g := cand.left) JOIN part y ON y.key = struct_pack(lang := cand.lang, g := cand.right)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(list_slice(ws, i, i + s - 1), ' ') AS g, max(a) AS most FROM (SELECT lang, ws, a, m, s, unnest(range(1, m - s + 2)) AS i FROM cand, (VALUES (2), (3)) v(s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT best.lang, best.g AS phrase, a, l, r, score FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.g = best.g WHERE NOT coalesce(100::hugeint * most >= 80::hugeint * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::bigint AS score FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000""",
    "op12_conversations": conversations_sql.sql(),
}

"""DuckDB SQL for op12_conversations: cheapest edits turn by turn, as one recursive step for each turn of all conversations.

A state holds (v, t): the cost in nine digits followed by the edits so far, and the repaired text so far, each line after a
newline. The least v is the cheapest, and among those the least audit.
"""

from __future__ import annotations


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, letter: str, text: str = "''", where: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {where} THEN struct_pack(v := lpad((left({state}.v, 9)::int + {cost})::varchar, 9, '0') || substr({state}.v, 10) || '{letter}', t := {state}.t || {text}) END"


def _inserted(state: str, role: str) -> str:
    return _way(state, "5", "I", f"chr(10) || '{role}:'")


def _steps() -> tuple[str, str, str]:
    """What a turn makes of the states, then insertions of a user turn, then of an assistant turn."""
    stays, extra = "f <> 1", "(CASE WHEN f = 2 THEN 5 ELSE 0 END)"
    keep = lambda s, x: _way(s, extra, "K", "chr(10) || role || ':' || text", f"{stays} AND x = '{x}'")
    rerole = lambda s, r: _way(s, f"1 + {extra}", "R", f"chr(10) || '{r}:' || text", stays)
    gone = lambda s: _way(s, "2", "D")
    to_user = [w for s in ("d0", "d1", "d3") for w in (keep(s, "u"), rerole(s, "user"))]
    first = f"{gone('d0')} AS d0, {_least(gone('d1'), keep('d0', 's'))} AS d1, {_least(gone('d2'), *to_user)} AS d2, {_least(gone('d3'), keep('d2', 'a'), rerole('d2', 'assistant'))} AS d3"
    user = f"d0, d1, {_least('d2', *(_inserted(s, 'user') for s in ('d0', 'd1', 'd3')))} AS d2, d3"
    return first, user, f"d0, d1, d2, {_least('d3', _inserted('d2', 'assistant'))} AS d3"


def sql() -> str:
    first, user, assistant = _steps()
    none = "NULL::STRUCT(v VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE tab AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS x FROM range(256) r(i))),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')), ''), lambda c: ascii(c)::bigint) AS bytes FROM conversations),
kinds AS (SELECT given.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) % 20 AS k FROM given, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE k <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, turn, role, text, left(role, 1) AS x, row_number() OVER w AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS ending
             FROM damaged JOIN convs ON convs.conv_id IS NOT DISTINCT FROM damaged.conv_id WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS MATERIALIZED (SELECT *, ending = '' AS blank, ending <> '' AND again > 1 AS duplicate, ending <> '' AND again = 1 AND right(ending, 1) NOT IN ('.', '!', '?') AS truncated, lag(x) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered),
facts AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
          count(*) FILTER (i > 1 AND concat(before, x) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c),
turns AS MATERIALIZED (SELECT c, i, x, role, text, CASE WHEN blank OR duplicate THEN 1 WHEN truncated THEN 2 ELSE 0 END AS f FROM faults),
dp AS (SELECT c, 0::bigint AS i, struct_pack(v := '000000000', t := '') AS d0, {none} AS d1, struct_pack(v := '000000005I', t := chr(10) || 'user:') AS d2, struct_pack(v := '000000010II', t := chr(10) || 'user:' || chr(10) || 'assistant:') AS d3 FROM facts
       UNION ALL
       SELECT c, i, {assistant} FROM (SELECT c, i, {user} FROM (SELECT c, i, {first} FROM (SELECT dp.c, turns.i, x, role, text, f, d0, d1, d2, d3 FROM dp JOIN turns ON turns.c = dp.c AND turns.i = dp.i + 1)))),
best AS (SELECT dp.c, {_least('d0', 'd3')} AS b FROM dp JOIN facts ON facts.c = dp.c AND facts.n = dp.i)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(b.v, 9)::bigint, 0) AS cost, coalesce(substr(b.v, 10), '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM convs LEFT JOIN facts USING (c) LEFT JOIN best USING (c)"""

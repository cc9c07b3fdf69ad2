"""DuckDB SQL for the secret scan."""

from __future__ import annotations

import math

from motionspark.llm.secret_scan import ACCESS, ALLOWED, ASSIGN, ASSIGN_LENGTH, CLASSES, HEX, KINDS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(name: str, pattern: str, rank: int, group: int = 0) -> str:
    p = _text(pattern)
    return f"""{name} AS (
  SELECT doc_id, {rank} AS rank, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS v,
               unnest(list_slice(string_split_regex(t, {p}), 1, -2)) AS g, unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS i
        FROM d WHERE regexp_matches(t, {p})))"""


def oracle() -> str:
    parts = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        _found("assign", ASSIGN, 0, 2), _found("access", ACCESS, 1), _found("hex", HEX, 2),
        f"""s0 AS MATERIALIZED (SELECT doc_id, s, rank, s + length(m) AS e FROM assign WHERE length(v) >= {ASSIGN_LENGTH}
  UNION ALL SELECT doc_id, s, rank, s + length(m) FROM access UNION ALL SELECT doc_id, s, rank, s + length(m) FROM hex)""",
    ]
    for k, c in enumerate(CLASSES):
        rank, window = KINDS.index(c.kind), c.window
        keep = " AND ".join([*(f"regexp_matches(m, {_text(p)})" for p in c.needs), *(f"NOT regexp_matches(m, {_text(p)})" for p in ALLOWED)])
        table = ", ".join(str(0 if n < 2 else round(n * math.log2(n) * 1e6)) for n in range(window + 1))
        m = "lower(m)" if c.fold else "m"
        parts += [
            _found(f"c{k}", c.pattern, rank),
            f"w{k} AS (SELECT doc_id, s, unnest(range(length(m) - {window} + 1)) AS k, {m} AS m FROM c{k} WHERE {keep})",
            f"x{k} AS (SELECT doc_id, s, k, unnest(string_split(substr(m, k + 1, {window}), '')) AS ch FROM w{k})",
            f"""h{k} AS (SELECT doc_id, s, k FROM (SELECT doc_id, s, k, ch, count(*) AS n FROM x{k} GROUP BY ALL)
  GROUP BY ALL HAVING sum(([{table}])[n + 1]) <= {c.limit})""",
            f"a{k} AS (SELECT doc_id, s + min(k) AS s, {rank} AS rank, s + max(k) + {window} AS e FROM h{k} GROUP BY doc_id, h{k}.s)",
            f"""s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT * FROM a{k}
  WHERE NOT EXISTS (FROM s{k} WHERE s{k}.doc_id = a{k}.doc_id AND s{k}.s < a{k}.e AND a{k}.s < s{k}.e))""",
        ]
    names = "[" + ", ".join(_text(n) for n in KINDS) + "]"
    one = f"({names})[rank + 1] || ':' || s || ':' || e"
    return f"""
WITH {",\n".join(parts)},
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg({one}, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg({one}, ',' ORDER BY s, rank) AS spans FROM s{len(CLASSES)} GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

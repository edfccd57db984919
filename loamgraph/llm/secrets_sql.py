"""SQL of operator 1, written from the contract to check the plan: spans from the pieces between matches, entropy by counting each window anew."""

from __future__ import annotations

from .secrets import ALLOW


def secrets_sql() -> str:
    either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    name = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    patterns = {
        "assign": f"({name})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "cand": "[A-Za-z0-9+/_=-]+",
    }
    least = {"assign": "length(g) >= 6", "access": "length(s) >= 20", "hex": "length(s) >= 24", "cand": "length(s) >= 20"}
    allow = " OR ".join("regexp_matches(s, '" + p + "')" for p in ALLOW)

    def found(kind: str) -> str:
        p = patterns[kind]
        return f"""{kind}_m AS (SELECT rid, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {2 if kind == "assign" else 0}) AS g FROM d WHERE regexp_matches(t, '{p}')),
{kind}_o AS (SELECT rid, unnest(m) AS s, unnest(g) AS g, unnest(p[1:len(m)]) AS piece, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m),
{kind}_f AS (SELECT * FROM (SELECT rid, s, g, CAST(sum(length(piece)) OVER w + sum(length(s)) OVER w - length(s) AS BIGINT) AS a FROM {kind}_o WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {least[kind]})"""

    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{found("assign")}, {found("access")}, {found("hex")}, {found("cand")},
base AS (SELECT rid, a, 0 AS k, a + length(s) AS b, 'assign' AS kind FROM assign_f UNION ALL SELECT rid, a, 1, a + length(s), 'access' FROM access_f UNION ALL SELECT rid, a, 2, a + length(s), 'hex' FROM hex_f),
c AS (SELECT row_number() OVER () AS cid, rid, a, s, regexp_matches(s, '^([0-9a-f]*|[0-9A-F]*)$') AS h FROM cand_f WHERE NOT ({allow})),
win AS (SELECT cid, rid, a, h, i, unnest(string_split(substr(s, i + 1, 20), '')) AS ch FROM (SELECT *, unnest(range(0, length(s) - 19)) AS i FROM c)),
ent AS (SELECT cid, rid, a, h, i, -sum(n / 20.0::DOUBLE * log2(n / 20.0::DOUBLE)) AS e FROM (SELECT cid, rid, a, h, i, ch, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL),
hot AS (SELECT *, CASE WHEN i - lag(i) OVER w <= 20 THEN 0 ELSE 1 END AS fresh FROM ent WHERE e >= CASE WHEN h THEN 3.0 ELSE 3.8 END - 1e-9 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = ent.rid AND b.a < ent.a + i + 20 AND ent.a + i < b.b) WINDOW w AS (PARTITION BY cid ORDER BY i)),
more AS (SELECT rid, x.a + min(i) AS a, CASE WHEN h THEN 3 ELSE 4 END AS k, x.a + max(i) + 20 AS b, CASE WHEN h THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind FROM (SELECT *, sum(fresh) OVER (PARTITION BY cid ORDER BY i) AS island FROM hot) x GROUP BY cid, rid, x.a, h, island),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more),
j AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""

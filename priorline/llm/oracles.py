"""DuckDB statements for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY source_size / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, w * max(lv) OVER ()) AS target,
             CAST(CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
             CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), substr(bin(d.size), 1, 3),
                                md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.size) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(u + rate * i) - floor(u + rate * (i - 1)) AS BIGINT) * size AS taken
FROM r
"""


def _spans(kind: str, at: int, pattern: str, keep: str = "TRUE") -> str:
    """One kind's spans: lengths of the pieces between matches and of the matches, summed up to each match."""
    return f"""SELECT doc_id, {at} AS k, '{kind}' AS kind, hit,
       CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS s
FROM (SELECT doc_id, pieces, hits, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(body, '{pattern}') AS pieces, regexp_extract_all(body, '{pattern}') AS hits FROM b
            WHERE regexp_matches(body, '{pattern}')))
WHERE {keep}"""


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_VALUE = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
f AS ({_spans("assign", 0, _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN_VALUE}', 1)) >= 6")}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]{16,}")}
UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}")}
UNION ALL {_spans("key_block", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----")}
UNION ALL {_spans("web_token", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")}
UNION ALL {_spans("url_login", 5, r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{3,128}@")}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT b.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(body) AS blob
FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""

LINES = r"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM a),
w AS (SELECT doc_id, line_no, doc_id * 10000000 + line_no AS p, list_filter(string_split_regex(line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS w FROM l),
d1 AS (SELECT array_to_string(w, chr(1)) AS t, any_value(w) AS w, min(p) AS p FROM w WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT t, p, len(w) AS n, i, array_to_string(w[:i - 1] || w[i + 1:], chr(1)) AS var
      FROM (SELECT t, w, p, unnest(range(1, len(w) + 1)) AS i FROM d1 WHERE len(w) >= 5)),
near AS (SELECT a.t, b.p FROM v a JOIN (SELECT var, i, n, min(p) AS p FROM v GROUP BY ALL) b ON a.var = b.var AND a.i = b.i AND a.n = b.n WHERE b.p < a.p
         UNION ALL SELECT a.t, b.p FROM v a JOIN d1 b ON a.var = b.t WHERE len(b.w) >= 5 AND b.p < a.p
         UNION ALL SELECT b.t, a.p FROM v a JOIN d1 b ON a.var = b.t WHERE len(b.w) >= 5 AND a.p < b.p),
e AS (SELECT t, min(p) AS p FROM (SELECT t, p FROM d1 UNION ALL SELECT t, p FROM near) GROUP BY t),
x AS (SELECT w.doc_id, w.line_no FROM w JOIN e ON array_to_string(w.w, chr(1)) = e.t WHERE len(w.w) > 0 AND w.p > e.p),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM x GROUP BY doc_id)
SELECT a.doc_id, CAST(len(a.ls) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_dropped, coalesce(g.dropped, '') AS dropped
FROM a LEFT JOIN g ON a.doc_id = g.doc_id
"""

ORACLES = {"op3_line_dedup": LINES, "op1_secret_scans": SECRETS, "op5_mixing": MIXING}

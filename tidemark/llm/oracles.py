"""What DuckDB SQL can say of the queries' results, by plainer ways than the operators take."""

from __future__ import annotations

from tidemark.llm.quality_rules import ALPHA, DELTA, LEVELS, RULES

#: Components of links (a, b), both directions, over ids: the smallest id that each reaches.
_REACH = "reach(id, r) AS (SELECT a, b FROM links UNION SELECT l.a, reach.r FROM links l JOIN reach ON l.b = reach.id)"

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""

_W = r"[^\x20\x09-\x0D]+"
_over = lambda cuts: " OR ".join(f"coalesce({sql.replace('/ n_words', '/ nullif(n_words, 0)')} > {c}, FALSE)" for (sql, _), c in zip(RULES.values(), cuts, strict=True))
_rows = " UNION ALL ".join(f"SELECT stratum, {i} AS i, {', '.join(f'CAST({c} AS DOUBLE) AS cut_{r}' for r, c in zip(RULES, cuts, strict=True))}, count(*) AS n, count(*) FILTER ({_over(cuts)}) AS k FROM held GROUP BY stratum" for i, cuts in enumerate(LEVELS))
QUALITY_RULES = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS w FROM t),
win AS (SELECT rid, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
s AS (SELECT rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')))) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
held AS (SELECT lang AS stratum, f.* FROM f JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
c AS ({_rows}),
p AS (SELECT c.*, CASE WHEN k > n * {ALPHA} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) FROM (SELECT unnest(range(0, k + 1)) AS j)) END <= {DELTA} / (SELECT count(DISTINCT stratum) FROM held) AS ok FROM c),
e AS (SELECT *, min(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY stratum) AS stop FROM p),
cut AS (SELECT * FROM e WHERE ok AND (stop IS NULL OR i < stop) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY i DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_over([f'cut_{r}' for r in RULES])}) AS kept FROM f LEFT JOIN cut ON f.lang = cut.stratum"""

NEAR_DUP = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n ON n.doc_id = a JOIN n m ON m.doc_id = b WHERE 5 * c >= 4 * (n.n + m.n - c)), {_REACH}
SELECT d.doc_id, least(d.doc_id, coalesce(k.r, d.doc_id)) AS class_id, d.doc_id = least(d.doc_id, coalesce(k.r, d.doc_id)) AS kept FROM documents d LEFT JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) k ON k.id = d.doc_id"""

URLS = r"""WITH u AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, p, verdict)),
m AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY len(h) DESC, len(p) DESC) AS k FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.rid = m.rid AND k = 1"""

_ASSIGN = """((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


#: Private keys that are whole; the operator's pattern also takes those whose end is missing.
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-{1,4}[^-])*-{5,}END [A-Z ]*PRIVATE KEY-----"
_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


def _found(kind: str, rank: int, pattern: str, test: str) -> str:
    """Rows (rid, kind, start, end): places are lengths of what comes before, text and matches, as in a split by the pattern."""
    return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s, m[i] AS hit, g[i] AS g
FROM (SELECT rid, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0}) AS g, regexp_split_to_array(t, '{pattern}') AS b FROM t WHERE regexp_matches(t, '{pattern}'))) WHERE {test}"""


SECRETS = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({_found('assign', 0, _ASSIGN, 'len(g[i]) >= 12')} UNION ALL {_found('access', 1, 'AKIA[A-Z0-9]+', 'len(m[i]) >= 18')} UNION ALL {_found('hex', 2, '[0-9a-f]+', 'len(m[i]) >= 16')} UNION ALL {_found('pem', 3, _PEM, 'TRUE')} UNION ALL {_found('jwt', 4, _JWT, 'TRUE')}),
y AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + len(hit) AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + len(hit) AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS spans FROM x GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN y USING (rid)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH}
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(r, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r, e.vec_id)) AS kept FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id LEFT JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) k ON k.id = e.vec_id"""

"""DuckDB SQL of the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _linked(n: int, more: str = "") -> str:
    """Classes of documents whose sets of n-word shingles are alike, by all pairs that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) >= {n} THEN list_distinct(list_transform(range(1, len(l) - {n - 2}), lambda i: array_to_string(l[i:i + {n - 1}], ' ')))
                          WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.o AS component_id{more}
FROM s JOIN (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id) c USING (doc_id)"""


OP5 = _linked(4, ", s.doc_id = c.o AS kept")
OP12 = _linked(5)

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l FROM documents),
w AS (SELECT doc_id, len(l) AS n, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS pos, unnest(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i + 49 <= len(l) THEN md5(array_to_string(l[i:i + 49], ' ')) END)) AS k FROM d),
f AS (SELECT *, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS late FROM w),
c AS (SELECT *, bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) AS n, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, substr(h, 2 * pos - 1, 2) AS byte, pos, CASE WHEN 2 * pos + 198 <= length(h) THEN md5(substr(h, 2 * pos - 1, 200)) END AS k
      FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS pos FROM d)),
f AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS late FROM w),
c AS (SELECT *, bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) AS n, count_if(gone) AS n_removed, count_if(opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, group: int, test: str) -> str:
    return f"""SELECT r, owner, repo, {kind} AS kind, m, v, a, a + length(m) AS b FROM (
 SELECT r, owner, repo, unnest(ms) AS m, unnest(vs) AS v, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS a
 FROM (SELECT r, owner, repo, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS gs FROM d)) WHERE {test}"""


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS repo, source AS owner, coalesce(text, '') AS t FROM documents),
base AS ({_spans(0, _ASSIGN, 1, "length(v) >= 6")} UNION ALL {_spans(1, "AKIA[A-Z0-9]+", 0, "length(m) >= 20")} UNION ALL {_spans(2, "[0-9a-f]+", 0, "length(m) >= 24")}),
tokens AS ({_spans(3, "[A-Za-z0-9+/_=-]{16,}", 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
free AS (SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.a < t.b AND t.a < b.b)),
held AS (SELECT * FROM base UNION ALL SELECT * FROM free),
owners AS (SELECT v, count(DISTINCT coalesce(owner, chr(0))) AS n_owners, count(DISTINCT coalesce(repo, -1)) AS n_repos FROM held GROUP BY v),
judged AS (SELECT *, n_owners <= 2 AND n_repos <= 10 AS live, ['assign', 'access', 'hex', 'owner'][kind + 1] || ':' || a::BIGINT || ':' || b::BIGINT AS s FROM held JOIN owners USING (v)),
per AS (SELECT r, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans,
  count_if(kind < 3 AND live) AS n_live, count_if(kind < 3 AND NOT live) AS n_shared FROM judged GROUP BY r)
SELECT repo AS doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared FROM d LEFT JOIN per USING (r)"""

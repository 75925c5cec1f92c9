"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from keyfold.llm.queries import BLOCK_DOCS, SHARES

OP2 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, row_number() OVER () AS rid,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    lower(coalesce(regexp_extract(url, '\?([^#]*)', 1), '')) AS query
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
listed AS (
  SELECT rid, max(struct_pack(size := length(rhost || rpath), verdict := verdict, rule := rhost || rpath)) AS best
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
t AS (
  SELECT DISTINCT rid, unnest(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(regexp_replace(lower(path), '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x),
    list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x))) AS tok
  FROM p),
lt AS (SELECT t.rid, listed.best.verdict = 'block' AS block, tok FROM listed JOIN t ON t.rid = listed.rid),
tot AS (SELECT count(*) AS n, count(*) FILTER (best.verdict = 'block') AS nb FROM listed),
grown(rid, block, ante, tok) AS (
  SELECT rid, block, [tok], tok FROM lt
  UNION ALL
  SELECT g.rid, g.block, list_append(g.ante, lt.tok), lt.tok FROM grown g JOIN lt ON lt.rid = g.rid AND lt.tok > g.tok),
sets AS (SELECT ante, count(*) AS a, count(*) FILTER (block) AS b FROM grown GROUP BY ante),
good AS (
  SELECT ante FROM sets, tot WHERE b >= 2 AND b >= ceil(0.02 * n) AND b::DOUBLE / a >= 0.6 AND (b::DOUBLE / a) / (nb::DOUBLE / n) > 1),
own AS (SELECT rid, list(tok) AS toks FROM t GROUP BY rid),
hit AS (SELECT DISTINCT rid FROM own JOIN good ON list_has_all(toks, ante))
SELECT p.page_id, p.host, p.path, listed.best.rule AS rule,
  coalesce(listed.best.verdict, CASE WHEN hit.rid IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN listed.rid IS NOT NULL THEN 'list' WHEN hit.rid IS NOT NULL THEN 'association' ELSE 'default' END AS decided_by
FROM p LEFT JOIN listed ON listed.rid = p.rid LEFT JOIN hit ON hit.rid = p.rid
"""

# The schedule of one period is found here by a recursive walk over the slots.
OP8 = f"""
WITH RECURSIVE src AS (
  SELECT source, k, (row_number() OVER (ORDER BY source NULLS LAST)) - 1 AS i FROM (
    SELECT DISTINCT source, CASE source {' '.join(f"WHEN '{s}' THEN {k}" for s, k in SHARES.items())} ELSE 1 END AS k FROM documents)),
tot AS (SELECT sum(k)::BIGINT AS m, list(k ORDER BY i) AS ks FROM src),
walk(t, s, done) AS (
  SELECT -1::BIGINT, -1::BIGINT, list_transform(ks, lambda x: 0::BIGINT) FROM tot
  UNION ALL
  SELECT t + 1, pick.i, list_transform(done, lambda x, j: x + CASE WHEN j = pick.i + 1 THEN 1 ELSE 0 END)
  FROM (
    SELECT t, done, list_min(list_filter(list_transform(ks, lambda k, j: CASE
        WHEN done[j] < k AND (done[j] * m) // k <= t + 1
        THEN struct_pack(due := -((-(done[j] + 1) * m) // k), rel := (done[j] * m) // k, i := (j - 1)::BIGINT) END), lambda x: x IS NOT NULL)) AS pick
    FROM walk, tot WHERE t + 1 < m)),
tpl AS (SELECT t, s AS i, (row_number() OVER (PARTITION BY s ORDER BY t)) - 1 AS j FROM walk WHERE t >= 0),
ranked AS (
  SELECT d.doc_id, d.source, src.i, src.k,
    (row_number() OVER (PARTITION BY src.i ORDER BY md5(d.doc_id::VARCHAR), d.doc_id)) - 1 AS rnk
  FROM documents d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
slotted AS (
  SELECT r.*, ((r.rnk // {BLOCK_DOCS}) // r.k) * tot.m + tpl.t AS slot
  FROM ranked r, tot JOIN tpl ON true WHERE tpl.i = r.i AND tpl.j = (r.rnk // {BLOCK_DOCS}) % r.k),
ends AS (
  SELECT min((b // k) * m + tpl.t) AS horizon FROM (SELECT i, any_value(k) AS k, (count(*) + {BLOCK_DOCS} - 1) // {BLOCK_DOCS} AS b FROM ranked GROUP BY i) e, tot, tpl
  WHERE tpl.i = e.i AND tpl.j = e.b % e.k)
SELECT doc_id, source, slot::BIGINT AS mix_slot,
  (row_number() OVER (ORDER BY slot, rnk)) - 1 AS mix_position, slot < horizon AS mix_on_target
FROM slotted, ends
"""

_LEDGER = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM f) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c ON c.rid = d.rid),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines > 3 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)::BIGINT AS failure_bits FROM m)
"""

OP10 = f"{_LEDGER} SELECT *, failure_bits & 3 <> 0 AS base_failed, failure_bits & 15 = 0 AS kept, 'standard-1' AS policy FROM b"

ABLATION = f"""{_LEDGER},
r(policy, mask, rule, bit) AS (VALUES ('base-1', 3, 'few_words', 1), ('base-1', 3, 'repeated_windows', 2), ('standard-1', 15, 'few_words', 1),
  ('standard-1', 15, 'repeated_windows', 2), ('standard-1', 15, 'symbol_heavy', 4), ('standard-1', 15, 'duplicate_lines', 8))
SELECT policy, rule, count(*) FILTER (failure_bits & bit <> 0) AS n_failed, count(*) FILTER (failure_bits & mask = bit) AS n_only_this,
  count(*) FILTER (failure_bits & mask <> 0) AS n_rejected, count(*) AS n_docs FROM b, r GROUP BY policy, mask, rule, bit
"""

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex, payload_bytes) AS keeper FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS complete FROM d
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT m.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, m.vec_id) AS component_id, coalesce(c.component_id, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN c ON c.u = m.vec_id LEFT JOIN n ON n.u = m.vec_id
"""

SQL: dict[str, str] = {"op1_warc": OP1, "op5_vector_dedup": OP5, "op2_url_filters": OP2, "op8_mixing": OP8, "op10_quality_rules": OP10, "quality_ablation": ABLATION}

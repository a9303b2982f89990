"""DuckDB SQL for the results of operators that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
#: A-Z only, as the contracts say.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: 50 bytes that also start in a smaller document; bytes as pairs of hexadecimal digits.
OP2 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
 w AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM (SELECT doc_id, i, md5(substr(t, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, t, unnest(range(length(t) // 2 - 49)) AS i FROM d WHERE length(t) >= 100))),
 e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE least < doc_id),
 s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run),
 k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
 j AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
 SELECT d.doc_id, CAST(length(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(t, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)"""

#: Sets of shingles, pairs of distinct sets that share enough of them, what is reachable over pairs.
OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
 k AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS k FROM s GROUP BY doc_id),
 one AS (SELECT k, min(doc_id) AS doc_id, any_value(n) AS n FROM k GROUP BY k),
 o AS (SELECT one.k, one.n, sh FROM one JOIN s USING (doc_id)),
 p AS (SELECT a.k AS a, b.k AS b FROM o a JOIN o b ON a.sh = b.sh AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 r(k, t) AS (SELECT k, k FROM one UNION SELECT r.k, p.b FROM r JOIN p ON r.t = p.a),
 c AS (SELECT r.k, min(one.doc_id) AS component_id FROM r JOIN one ON r.t = one.k GROUP BY r.k),
 l AS (SELECT a AS k, count(*) AS n_links FROM p GROUP BY a)
 SELECT w.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN l USING (k)"""

#: Words in runs of 50 that also start in a smaller document.
OP7 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
 r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50))),
 g AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS j FROM r WHERE least < doc_id),
 x AS (SELECT doc_id, j, ws[j] AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w WHERE len(ws) > 0)),
 k AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY j) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, j) GROUP BY x.doc_id)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_TERMS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Words of documents inside an occurrence of an item's window.
OP10 = f"""WITH w AS (SELECT doc_id, {_TERMS} AS ws FROM documents), b AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
 i AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM (SELECT item_id, ws, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0))),
 q AS (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w JOIN (SELECT DISTINCT n FROM i) ON len(ws) >= n)),
 m AS (SELECT doc_id, p, q.n, item_id FROM q JOIN i ON q.win = i.win AND q.n = i.n),
 h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, p + unnest(range(n)) AS j FROM m) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: Twenty bytes are four groups of forty bits, each eight digits of five.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1({0}), 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '')"
#: The largest page of equal payloads is the response of the others.
OP8 = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, row_number() OVER w AS r, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST))
 SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32.format("t")} AS payload_digest, CASE WHEN r = 1 OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN m END AS refers_to, url FROM p"""

_D = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
#: Rounds written out one by one; ties of a part go to the smaller entry.
OP12 = """WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, r, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS x FROM v, range(8) t(part)),
 c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 16)""" + "".join(
    f""",
 a{i} AS MATERIALIZED (SELECT p.r, p.part, min(p.vec_id) AS vec_id, min(p.label) AS label, any_value(x) AS x, min({_D}) AS d, arg_min(e, {_D} * 16 + e) AS e FROM p JOIN c{i} USING (part) GROUP BY p.r, p.part)"""
    + (
        f""",
 n{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT part, e, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY part, e, j) GROUP BY part, e),
 c{i + 1} AS MATERIALIZED (SELECT part, e, CAST(coalesce(n{i}.c, c{i}.c) AS BIGINT[]) AS c FROM c{i} LEFT JOIN n{i} USING (part, e))"""
        if i < 6
        else ""
    )
    for i in range(7)
) + """,
 o AS (SELECT r, min(vec_id) AS vec_id, min(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c6) AS codebooks_sha256 FROM o"""

#: Every pair of groups over every kept term of their language, zero counts included.
OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 w AS (SELECT r, lang, source, unnest(ws) AS t FROM d),
 k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, t, count(*) AS c FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
 x AS (SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)),
 p AS (SELECT lang, source, t, c, 1 + 1000000000 * CAST(c + 5 AS HUGEINT) // CAST(sum(c) OVER s + 5 * count(*) OVER s AS HUGEINT) AS p FROM x WINDOW s AS (PARTITION BY lang, source)),
 l AS (SELECT lang, t, 1 + 1000000000 * CAST(c + 5 AS HUGEINT) // CAST(sum(c) OVER s + 5 * count(*) OVER s AS HUGEINT) AS q FROM (SELECT lang, t, sum(c) AS c FROM c GROUP BY lang, t) WINDOW s AS (PARTITION BY lang)),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', t, CAST(p - q AS BIGINT) FROM p JOIN l USING (lang, t) WHERE c > 0 AND p > q)
 SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM u) WHERE part = 'pair' OR rank <= 50"""

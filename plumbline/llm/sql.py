"""What a second SQL engine can say of the operators: whole results of 1, 3, 4, 11 and 12."""

from __future__ import annotations

from plumbline.llm import quality, secrets

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGITS = " || ".join(f"substr({_BASE32}, (v >> {s} & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))

WARC = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(sha1(h), (5 * i + 1)::INT, 5))::BIGINT), lambda v: {_DIGITS}), '') AS payload_digest FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, payload_digest, CASE page_id WHEN top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, url FROM d"""

_WORD_LISTS = r"""w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

QUALITY = rf"""WITH {_WORD_LISTS},
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) o(j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
length(regexp_replace(t, '[^!]+', '', 'g')) AS shouts, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals, length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS letters
FROM w JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, {quality.BASE_FAILED} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
OR 100 * shouts > 20 * n_words OR 100 * capitals > 40 * word_chars OR 100 * letters < 50 * word_chars) AS kept FROM b"""


def secret_spans() -> str:
    """Every rule's matches, placed by the lengths of what lies between them."""
    parts = []
    for no, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        size = f"length(regexp_extract_all(t, '{pattern}', {r.group})[k])"
        gaps = f"list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:k], lambda x: length(x)))"
        before = f"coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
        parts.append(
            f"SELECT doc_id, {no} AS no, '{r.kind}' AS kind, ({gaps} + {before})::BIGINT AS s, length(m[k]) AS n FROM "
            f"(SELECT doc_id, t, regexp_extract_all(t, '{pattern}', 0) AS m FROM d WHERE regexp_matches(t, '{pattern}')), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS k) WHERE {size} >= {r.least}"
        )
    count = lambda kind: f"count(*) FILTER (kind = '{kind}')::BIGINT AS n_{kind}"
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no){where}, '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {count('assign')}, {count('access')}, {count('hex')}, {joined(f' FILTER (no < {len(secrets.BASE_RULES)})')} AS base, {joined('')} AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def clustering(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Every round as tables of its own: all distances, then floors of means by component."""
    floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, x AS c FROM v ORDER BY j LIMIT {k})",
    ]
    for t in range(rounds + 1):
        gap = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min({{'d': d, 'j': j}}) AS best FROM (SELECT r, j, {gap} AS d FROM v, c{t}) GROUP BY r)")
        if t < rounds:
            parts.append(
                f"m{t} AS (SELECT j, list({floor} ORDER BY i) AS c FROM (SELECT best.j AS j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{t} JOIN v USING (r), LATERAL (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY ALL) GROUP BY j), "
                f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))"
            )
    last = f"SELECT vec_id, best.j::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.j)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON best.j = j"
    return f"WITH {', '.join(parts)} {last}"


_SHIFT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda v: {_SHIFT.format('v')})"

#: Words that lose a letter are equal then (one is longer), or equal once both lose it at one place.
SPELLING = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS id, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(id) + 1), lambda i: ('0x' || hex(encode(id))[(2 * i - 1)::INT:(2 * i)::INT])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a & 255, b) + 1)::INT])), 4294967295) AS h FROM counted, crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) > 1),
cut AS MATERIALIZED (SELECT DISTINCT word, n, CASE WHEN same THEN i END AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w), (VALUES (true), (false)) s(same)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
UNION SELECT a.word, w.word, w.n FROM cut a JOIN w ON a.rest = w.word UNION SELECT w.word, a.word, a.n FROM cut a JOIN w ON a.rest = w.word),
best AS (SELECT word, count(DISTINCT near) AS n_near, min({{'less': -near_n, 'form': near}}) AS b FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * w.n THEN b.form END AS form, CASE WHEN -b.less >= 10 * w.n THEN -b.less END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) c USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op3_quality_rules": QUALITY, "op4_secret_scan": secret_spans(), "op11_centroid_clustering": clustering(), "op12_spelling_variants": SPELLING}

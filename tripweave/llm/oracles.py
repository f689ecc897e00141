"""DuckDB SQL for the operators that SQL can express; each takes the name of a table like documents."""

from __future__ import annotations


def quality_rules(table: str) -> str:
    """One row per document with the columns of its quality verdict."""
    names = ("fail_base", "fail_symbols", "fail_lines")
    sums = ", ".join(f"sum({n})::DOUBLE AS x_{n}, sum({n} * {n} / documents::DOUBLE) AS q_{n}" for n in names)
    moments = ", ".join(f"(q_{n} - x_{n} * x_{n} / n) / (k - 1) AS b_{n}, (x_{n} - q_{n}) / (n - k) AS w_{n}" for n in names)
    strengths = ", ".join(
        f"CASE WHEN k > 1 AND n > k AND b_{n} > w_{n} AND b_{n} + (usual - 1) * w_{n} > 0 THEN least((b_{n} + (usual - 1) * w_{n}) / (b_{n} - w_{n}) - 1, 1000000.0) ELSE 1000000.0 END AS s_{n}" for n in names
    )
    over = " OR ".join(f"({n} + x_{n} / n * s_{n}) / (documents + s_{n}) > 0.5" for n in names)
    return f"""
WITH qr_t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM {table}),
qr_w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM qr_t),
qr_i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM qr_w WHERE len(ws) >= 8),
qr_r AS (SELECT doc_id, list(i) AS places FROM (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS v FROM qr_i) GROUP BY doc_id, v HAVING count(*) > 1),
qr_p AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, unnest(places) AS i FROM qr_r), (SELECT unnest(range(0, 8)) AS k)),
qr_n AS (SELECT doc_id, count(*) AS n FROM qr_p GROUP BY doc_id),
qr_m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(ws) < 20 OR 100 * coalesce(n, 0) > 30 * len(ws) AS base_failed
  FROM qr_w w LEFT JOIN qr_n r ON w.doc_id = r.doc_id),
qr_h AS (SELECT source, count(*) AS documents, count(*) FILTER (base_failed) AS fail_base, count(*) FILTER (5 * n_symbols > word_chars) AS fail_symbols, count(*) FILTER (2 * n_dup_lines > n_lines) AS fail_lines FROM qr_m GROUP BY source),
qr_a AS (SELECT count(*) AS k, sum(documents)::DOUBLE AS n, sum(documents::DOUBLE * documents) AS n2, {sums} FROM qr_h),
qr_b AS (SELECT *, (n - n2 / n) / nullif(k - 1, 0) AS usual, {moments.replace('(k - 1)', 'nullif(k - 1, 0)').replace('(n - k)', 'nullif(n - k, 0)')} FROM qr_a),
qr_s AS (SELECT *, {strengths} FROM qr_b),
qr_v AS (SELECT source AS host, {over} AS host_rejected FROM qr_h, qr_s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, n_lines, host_rejected
FROM qr_m JOIN qr_v ON source IS NOT DISTINCT FROM host"""


def exact_duplicates(table: str) -> str:
    return f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM {table} WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def mix(table: str) -> str:
    return f"""
WITH mx_d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS draw FROM {table}),
mx_s AS (SELECT source AS s, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM mx_d GROUP BY source),
mx_c AS (SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM mx_s),
mx_o AS (SELECT *, row_number() OVER o AS turn, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lv FROM mx_c WINDOW o AS (ORDER BY cap / weight, s NULLS LAST)),
mx_l AS (SELECT lv AS level FROM mx_o WHERE cap > lv * weight ORDER BY turn LIMIT 1),
mx_t AS (SELECT s, source_size, CASE WHEN cap <= lv * weight THEN cap::DOUBLE ELSE (SELECT level FROM mx_l) * weight END AS target FROM mx_o),
mx_p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM mx_t),
mx_r AS (SELECT d.*, p.*, target - whole * source_size AS part, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM mx_d d JOIN mx_p p ON source IS NOT DISTINCT FROM s),
mx_m AS (SELECT *, part > 0 AND upto <= part AS more FROM mx_r),
mx_g AS (SELECT *, part - coalesce(sum(size) FILTER (more) OVER (PARTITION BY source), 0)::BIGINT AS gap FROM mx_m),
mx_e AS (SELECT *, row_number() OVER (PARTITION BY source, more OR part <= 0 OR abs(size - gap) >= gap ORDER BY abs(size - gap), draw, doc_id, size) = 1 AND NOT (more OR part <= 0 OR abs(size - gap) >= gap) AS last FROM mx_g)
SELECT doc_id, size, source_size, target, (size * (whole + (more OR last)::BIGINT))::BIGINT AS taken FROM mx_e"""

"""DuckDB SQL of the registered operator queries, where SQL can express them."""

from __future__ import annotations

from multisvm.llm.licenses import CONTAINMENT, LONG_REACH, SHINGLE, TEMPLATES
from multisvm.llm.quality_rules import STOP_WORDS

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_rules_sql(of: str = "documents") -> str:
    """Metrics and verdict of the quality rules over the table or subquery ``of``."""
    stop = "[" + ", ".join(map(_literal, STOP_WORDS)) + "]"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {of}),
    w AS (SELECT r, doc_id, text, {WORDS} AS ws,
                 list_filter(string_split(text, chr(10)), lambda x: translate(x, {WHITE}, '') <> '') AS ls FROM d),
    tok AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
    gram AS (SELECT r, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3,
                    lead(x, 4) OVER o AS x4 FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
    rep AS (SELECT r, i, (x4 IS NOT NULL AND count(*) OVER (PARTITION BY r, x, x1, x2, x3, x4) > 1)::INT AS f FROM gram),
    cov AS (SELECT r, max(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM rep),
    n AS (SELECT r, sum(c) AS n FROM cov GROUP BY r),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(text, {WHITE}, ''))::BIGINT AS word_chars,
                 (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                 len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: list_contains({stop}, x)))::BIGINT AS n_stop_words
          FROM w LEFT JOIN n USING (r)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed
        AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2.0 AND 15.0, true)
        AND coalesce(n_symbols / nullif(n_words, 0) <= 0.1, true)
        AND coalesce((n_stop_words + 1) / nullif(n_words, 0) >= 0.04, true)
        AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.35, true) AS kept
    FROM b"""


def license_scans_sql() -> str:
    """Exact containment of every template in every window of four template
    lengths that starts at a multiple of one, without bands."""
    back = ", ".join(f"({i})" for i in range(LONG_REACH))
    values = ", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in TEMPLATES)
    split = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return rf"""
    WITH t AS (SELECT template_id, ws, least(len(ws), {SHINGLE}) AS n FROM
               (SELECT template_id, {split.format("body")} AS ws FROM (VALUES {values}) v(template_id, body)) WHERE len(ws) > 0),
    ts AS (SELECT template_id, n, len(ws) - n + 1 AS span, unnest(list_transform(range(0, len(ws) - n + 1),
               lambda i: array_to_string(ws[i + 1:i + n], ' '))) AS s FROM t),
    td AS (SELECT DISTINCT template_id, n, span, s FROM ts),
    tn AS (SELECT template_id, span, count(*) AS k FROM td GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS r, doc_id, {split.format("coalesce(text, '')")} AS ws FROM documents),
    g AS (SELECT r, doc_id, n, unnest(range(0, len(ws) - n + 1)) AS i,
                 unnest(list_transform(range(0, len(ws) - n + 1), lambda i: array_to_string(ws[i + 1:i + n], ' '))) AS s
          FROM d, (SELECT DISTINCT n FROM t) WHERE len(ws) >= n),
    hit AS (SELECT g.r, g.doc_id, td.template_id, td.span, g.i, g.s FROM g JOIN td USING (n, s)),
    win AS (SELECT r, doc_id, template_id, span, i, s, i // span - b AS wno FROM hit, (VALUES {back}) v(b) WHERE i // span >= b),
    m AS (SELECT r, doc_id, template_id, span, wno, count(DISTINCT s) AS c, min(i) AS i FROM win GROUP BY ALL),
    ok AS (SELECT DISTINCT doc_id, template_id, wno, c / k AS share, i FROM m JOIN tn USING (template_id, span)
           WHERE c / k >= {CONTAINMENT})
    SELECT doc_id, template_id, max(share) AS containment, count(DISTINCT wno)::BIGINT AS n_windows, min(i)::BIGINT AS first_word
    FROM ok GROUP BY ALL"""


def substrings_sql(of: str = "documents") -> str:
    """Every window of 35 words counted as such; words under one found twice go."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM {of}),
    win AS (SELECT r, unnest(range(0, len(ws) - 34)) AS i,
                   unnest(list_transform(range(0, len(ws) - 34), lambda i: array_to_string(ws[i + 1:i + 35], ' '))) AS s
            FROM d WHERE len(ws) >= 35),
    rep AS (SELECT r, i, (count(*) OVER (PARTITION BY s) > 1)::INT AS f FROM win),
    tok AS (SELECT r, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS x FROM d),
    cov AS (SELECT r, i, x, coalesce(max(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS c
            FROM tok LEFT JOIN rep USING (r, i)),
    k AS (SELECT r, sum(c)::BIGINT AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (c = 0), '') AS kept FROM cov GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (r)"""


def top_k_sql() -> str:
    return """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def line_dedup_sql() -> str:
    """Lines of 20 code points and more that three documents hold go, but for the largest document's."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT r, doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d),
    k AS (SELECT *, translate(trim(x, {WHITE}), '{upper}', '{lower}') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 3),
    v AS (SELECT r, i, x, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f USING (key)),
    s AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM v GROUP BY r)
    SELECT doc_id, len(ls)::BIGINT AS n_lines, n::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d JOIN s USING (r)"""


def hard_negatives_sql() -> str:
    return """
    WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
          FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    r AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": top_k_sql(), "op3_quality_rules": quality_rules_sql(), "op4_substring_dedup": substrings_sql(), "op10_license_scans": license_scans_sql(),
            "op11_line_dedup": line_dedup_sql(), "op13_hard_negatives": hard_negatives_sql()}

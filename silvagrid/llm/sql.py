"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
WITH rules(host_rule, path_rule, act) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, row_number() OVER () AS n, strpos(url, '://') AS mark,
               substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parts AS (
  SELECT page_id, n,
    CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM cut),
fit AS (
  SELECT n, host_rule || path_rule AS rule, act, row_number() OVER (PARTITION BY n
    ORDER BY length(host_rule || path_rule) DESC, length(host_rule) DESC, act DESC) AS place
  FROM parts JOIN rules ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (n)
"""


def raking(documents: str, power: float = 0.9, sweeps: int = 30, seed: int = 29) -> str:
    """CTEs up to ``mixed``: every row of ``documents`` with its probability and decision."""
    parts = [f"""
marked AS (SELECT *, coalesce(source, '(none)') AS ax_source, coalesce(lang, '(none)') AS ax_lang,
  CASE WHEN contains(text, ' | ') THEN 'tabular' WHEN contains(lower(text), 'license') THEN 'licensed' ELSE 'prose' END AS ax_topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n_tokens FROM {documents}),
w0 AS (SELECT ax_source, ax_lang, ax_topic, sum(n_tokens)::BIGINT AS tokens,
  sum(n_tokens)::DOUBLE / greatest(sum(sum(n_tokens)) OVER (), 1)::DOUBLE AS weight FROM marked GROUP BY ALL)"""]
    for axis in ("source", "lang", "topic"):
        parts.append(f"""
t_{axis} AS (SELECT ax_{axis}, pow(sum(tokens)::DOUBLE, {power}) / sum(pow(sum(tokens)::DOUBLE, {power})) OVER () AS target
  FROM w0 GROUP BY ax_{axis} HAVING sum(tokens) > 0)""")
    step = 0
    for _ in range(sweeps):
        for axis in ("source", "lang", "topic"):
            parts.append(f"""
w{step + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY ax_{axis}) > 0
  THEN weight * (coalesce(target, 0) / sum(weight) OVER (PARTITION BY ax_{axis})) ELSE 0 END AS weight)
  FROM w{step} w LEFT JOIN (SELECT ax_{axis}, target FROM t_{axis}) USING (ax_{axis}))""")
            step += 1
    parts.append(f"""
rates AS (SELECT ax_source, ax_lang, ax_topic,
  coalesce((weight / nullif(tokens, 0)) / max(weight / nullif(tokens, 0)) OVER (), 1) AS probability FROM w{step}),
mixed AS (SELECT marked.*, probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 8))::BIGINT / 4294967296.0 < probability AS kept
  FROM marked JOIN rates USING (ax_source, ax_lang, ax_topic))""")
    return ",".join(parts)


MIXING = f"""WITH {raking("documents")}
SELECT ax_source AS source, ax_lang AS lang, ax_topic AS topic, doc_id, n_tokens,
  round(probability, 6) AS probability, kept FROM mixed"""

COLLOCATIONS = r"""
WITH cut AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
piece AS (SELECT lang, unnest(pieces) AS piece FROM cut),
words AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM piece),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, w[i : i + k - 1] AS g
  FROM (SELECT p, lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, g, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, h.f AS l, t.f AS r, n, h.k AS cut,
    ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM f c JOIN f h ON h.lang = c.lang AND h.k < c.k AND h.g = c.g[1 : h.k]
    JOIN f t ON t.lang = c.lang AND t.k = c.k - h.k AND t.g = c.g[h.k + 1 : c.k] JOIN totals ON totals.lang = c.lang
  WHERE c.k > 1),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, f, g[i : j] AS g
  FROM (SELECT lang, f, g, k, unnest(range(1, k + 1)) AS i FROM f WHERE k > 2), (SELECT unnest(range(1, 6)) AS j)
  WHERE j > i AND j <= k AND j - i + 1 < k),
longest AS (SELECT lang, g, max(f) AS outer_f FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN longest USING (lang, g)
  WHERE NOT coalesce(100 * outer_f >= 100 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op4_url_filter": URL_FILTER, "op9_mixing": MIXING, "op11_collocations": COLLOCATIONS}

"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_OP1 = r"""
WITH rules(rule_host, rule_path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hits AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict
FROM urls LEFT JOIN hits USING (n)
"""

_OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) AS body,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE
      16 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) END AS marks
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""



def _op12(rounds: int = 4) -> str:
    """The rounds written out, each a table; plain squared distances."""
    def assign(i: int) -> str:
        return (f"near{i} AS MATERIALIZED (SELECT n, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM ("
                f"SELECT c.n, c.part, b.entry, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
                f"FROM cut c JOIN book{i} b USING (part)) GROUP BY n, part)")

    def refit(i: int) -> str:
        return (f"mean{i} AS (SELECT part, entry, list(m ORDER BY pos) AS v FROM (SELECT part, entry, pos, "
                f"CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END::BIGINT AS m FROM ("
                f"SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM cut JOIN near{i - 1} USING (n, part)) "
                f"GROUP BY part, entry, pos) GROUP BY part, entry), "
                f"book{i} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{i - 1} b LEFT JOIN mean{i} m USING (part, entry))")

    steps = ", ".join(s for i in range(rounds) for s in (assign(i), refit(i + 1)))
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label,
         list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS MATERIALIZED (SELECT n, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM x, range(4) p(part)),
book0 AS MATERIALIZED (SELECT part, n AS entry, v FROM cut WHERE n < 256), {steps}, {assign(rounds)},
digest AS (SELECT sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM (
  SELECT part, entry, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM book{rounds})),
coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM x JOIN coded USING (n)
"""


ORACLE = {"op1_url_filter": _OP1, "op4_chat_format": _OP4, "op12_vector_codes": _op12()}

# Queries without SQL, with the reason; tests/llm checks them against brute force.
NO_ORACLE = {
    "op2_best_fit_packing": "tokenizer ids and best-fit bins are beyond SQL",
    "op3_nearest_neighbours": "approximate graph search; recall is measured against brute force",
    "op5_quality_rules": "repeated word windows and line rules of whole texts are too slow in SQL",
    "op6_jaccard_join": "connected components of a similarity join are too slow in SQL on whole tables",
    "op7_quality_classifier": "hashed n-gram models and sampling by hash are beyond SQL",
    "op8_token_counts": "byte-pair merges are beyond SQL",
    "op9_mix_sources": "exponential keys come from a hash that SQL does not have",
    "op10_token_files": "tokenizer ids and files are beyond SQL",
    "op11_embedding_whitening": "eigenvectors are beyond SQL",
    "op13_license_scan": "hundreds of patterns with suppression are beyond SQL",
    "pipeline": "chains the above",
}

"""The derived views of ``plans/views.py`` as DuckDB SQL (CTE bodies), used
by the oracle queries. Same arithmetic as the Spark side."""

TOK = "list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"


def tok(x: str) -> str:
    return TOK.format(x=x)


CORPUS_V = "SELECT lang AS domain, doc_id AS chunk_id, source, text AS content FROM documents"

QUERY_V = ("SELECT b.item_id AS query_id, d.lang AS domain, b.text AS query "
           "FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")

VEC_V = ("SELECT d.lang AS domain, e.vec_id AS chunk_id, e.embedding AS vec "
         "FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")

QUERY_VEC_V = ("SELECT q.query_id, q.domain, q.query, e.embedding AS qvec, q.query_id AS exclude_id "
               f"FROM ({QUERY_V}) q JOIN embeddings e ON e.vec_id = q.query_id")

AUDIT_V = """SELECT CAST(event_id AS VARCHAR) AS audit_id, ts AS "timestamp", CAST(ts AS DATE) AS date,
  CAST(user_id AS VARCHAR) AS session_id,
  'query about ' || event_type || ' ' || props AS redacted_query,
  CASE event_type WHEN 'click' THEN 'billing' WHEN 'view' THEN 'billing'
    WHEN 'purchase' THEN 'returns' WHEN 'signup' THEN 'returns' WHEN 'error' THEN 'escalation' END AS routed_to,
  ((event_id * 104729) % 1000) / 1000.0::DOUBLE AS router_confidence,
  ['documents/' || event_type || '.txt'] AS retrieved_sources,
  ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS final_confidence,
  ((event_id * 7919) % 1000) / 1000.0::DOUBLE < 0.65::DOUBLE AS low_confidence_flag,
  CAST(floor(value * 10) AS BIGINT) AS response_latency_ms,
  (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) < 2 AS cache_hit
FROM events"""

POLICY_V = """SELECT lang AS domain, doc_id AS chunk_id, source,
  (CASE WHEN doc_id % 5 = 1 THEN 'Section ' || CAST(doc_id % 7 AS VARCHAR) || ' ' ELSE '' END)
  || text ||
  (CASE WHEN doc_id % 10 = 0 THEN ' See section ' || CAST(doc_id % 7 AS VARCHAR) ELSE '' END) AS content
FROM documents"""

TURNS_V = """SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id AS seq,
  CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, event_type AS content
FROM events"""

CACHE_V = """SELECT CAST(label AS VARCHAR) AS domain, vec_id AS entry_id, embedding AS vec,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id AS BIGINT)) AS stored_at
FROM embeddings"""

LOOKUP_V = """SELECT lookup_id, domain,
  CASE WHEN nrm = 0 THEN mixed ELSE list_transform(mixed, lambda x: x / nrm) END AS vec, ts
FROM (
  SELECT lookup_id, domain, mixed, ts,
    sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(mixed, lambda x: x * x)), lambda a, b: a + b)) AS nrm
  FROM (
    SELECT e.vec_id AS lookup_id, CAST(e.label AS VARCHAR) AS domain,
      CASE WHEN p.embedding IS NULL THEN list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))
        ELSE list_transform(list_zip(e.embedding, p.embedding),
          lambda z: CAST(z[1] AS DOUBLE) + ((e.vec_id % 10) * 0.1::DOUBLE) * CAST(z[2] AS DOUBLE)) END AS mixed,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(e.vec_id + 30 + e.vec_id % 90 AS BIGINT)) AS ts
    FROM embeddings e LEFT JOIN embeddings p ON p.vec_id = xor(e.vec_id, 1)
  )
)"""


def sum_list(expr: str) -> str:
    """Sequential left-fold sum of a DOUBLE list (0.0 for empty)."""
    return f"list_reduce(list_prepend(0.0::DOUBLE, {expr}), lambda a, b: a + b)"


def dot(a: str, b: str) -> str:
    return sum_list(f"list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))")


def sq_l2(a: str, b: str) -> str:
    return sum_list(
        f"list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) "
        f"* (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))")

AGENT_CASE = ("CASE event_type WHEN 'click' THEN 'billing' WHEN 'view' THEN 'billing' WHEN 'purchase' THEN 'returns' "
              "WHEN 'signup' THEN 'returns' WHEN 'error' THEN 'escalation' END")

ROUTER_RAW_V = f"""SELECT event_id, CASE event_id % 8
  WHEN 0 THEN '{{"category": "' || cat || '", "confidence": ' || c || '}}'
  WHEN 1 THEN '{{"category": "' || upper(substring(cat, 1, 1)) || substring(cat, 2, 100) || ' ", "confidence": "' || c || '"}}'
  WHEN 2 THEN '{{"category": "shipping", "confidence": ' || c || '}}'
  WHEN 3 THEN 'Sure! {{"category": "' || cat || '", "confidence": ' || c || '}} Hope that helps.'
  WHEN 4 THEN 'I think this is about ' || cat || '.'
  WHEN 5 THEN '{{"category": "' || cat || '", "confidence": 1.2.3}}'
  WHEN 6 THEN '{{"category": "' || cat || '", "confidence": null}}'
  ELSE '[' || c || ']' END AS raw
FROM (SELECT event_id, {AGENT_CASE} AS cat,
        '0.' || lpad(CAST((event_id * 104729) % 1000 AS VARCHAR), 3, '0') AS c FROM events)"""

MODEL_OUT_V = """SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN 'ANSWER: ' || text || chr(10) || 'CONFIDENCE: ' || rating
  WHEN 1 THEN 'ANSWER: ' || text
  WHEN 2 THEN 'CONFIDENCE: ' || rating
  ELSE text END AS raw
FROM (SELECT doc_id, text, CASE doc_id % 5
  WHEN 0 THEN '0.' || lpad(CAST((doc_id * 37) % 100 AS VARCHAR), 2, '0')
  WHEN 1 THEN '0.85/1.0' WHEN 2 THEN '1.5' WHEN 3 THEN '85%'
  ELSE 'about 0.7 or 0.' || CAST(doc_id % 10 AS VARCHAR) END AS rating FROM documents)"""

EVAL_CASES_V = """SELECT item_id AS case_id, 'case ' || CAST(item_id AS VARCHAR) AS description, text AS query,
  CASE WHEN item_id % 11 <> 0 THEN ['billing', 'returns', 'escalation'][item_id % 3 + 1] END AS expected_agent,
  CASE WHEN item_id % 11 <> 0 THEN (CASE WHEN item_id % 2 = 0 THEN 'contains' ELSE 'icontains' END) END AS match_type,
  CASE WHEN item_id % 11 <> 0 THEN (CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[3] ELSE upper(string_split(text, ' ')[3]) END) END AS match_value,
  CASE WHEN item_id % 11 = 0 THEN ['has_sources', 'ood_handled', 'min_length_20'][(item_id // 11) % 3 + 1] END AS custom_check,
  CASE item_id % 5 WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 0.9::DOUBLE END AS min_confidence,
  CASE item_id % 7 WHEN 1 THEN 300.5::DOUBLE WHEN 2 THEN 100.0::DOUBLE END AS max_latency_ms
FROM benchmark"""

EVAL_OUTPUTS_V = """SELECT b.item_id AS case_id,
  b.text || (CASE WHEN b.item_id % 5 = 0 THEN ' Refunds take 90 days.' ELSE '' END)
  || (CASE WHEN b.item_id % 10 = 0 THEN ' Returns within 30 days.' ELSE '' END)
  || chr(10) || '<!--CXMETA:{"agent": "' || ['billing', 'returns', 'escalation'][least(b.item_id % 4, 2) + 1]
  || '", "sources": ' || (CASE WHEN b.item_id % 6 = 0 THEN '[]' ELSE '["documents/' || ['billing', 'returns', 'escalation'][least(b.item_id % 4, 2) + 1] || '/policy.txt"]' END)
  || ', "confidence": 0.' || lpad(CAST((b.item_id * 7919) % 1000 AS VARCHAR), 3, '0')
  || ', "latency_ms": ' || CAST(CAST(floor(e.value * 10) * 3 AS BIGINT) AS VARCHAR) || (CASE WHEN b.item_id % 4 = 3 THEN '.5' ELSE '' END) || '}-->' AS output
FROM benchmark b LEFT JOIN events e ON e.event_id = b.item_id"""

COMPLETIONS_V = f"""WITH a AS (SELECT audit_id, redacted_query, CAST(audit_id AS BIGINT) AS k FROM ({AUDIT_V}))
SELECT audit_id, 'precise' AS variant, redacted_query || repeat(' detail', CAST(k % 90 AS INTEGER)) AS completion FROM a
UNION ALL
SELECT audit_id, 'empathetic', CASE WHEN k % 4 = 0 THEN 'I don''t have enough information.'
  ELSE 'Sure, ' || redacted_query || repeat(' more', CAST(k % 120 AS INTEGER)) END FROM a
UNION ALL
SELECT audit_id, 'structured', repeat('x', CAST(k % 60 AS INTEGER)) FROM a WHERE k % 5 <> 0"""

REQUESTS_V = """SELECT doc_id AS request_id,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN repeat(source, 40) ELSE source END AS session_id,
  text AS query FROM documents"""

UPLOADS_V = """SELECT page_id AS upload_id, ['billing', 'returns', 'escalation', 'shipping'][page_id % 4 + 1] AS domain,
  CASE page_id % 5 WHEN 0 THEN stem || '.txt' WHEN 1 THEN 'notes/' || stem || '.md' WHEN 2 THEN upper(stem) || '.MD'
    WHEN 3 THEN stem || '.pdf' ELSE '.md' END AS filename,
  CAST(octet_length(encode(html)) * (CASE WHEN page_id % 7 = 0 THEN 10000 ELSE 1 END) AS BIGINT) AS size_bytes,
  CASE WHEN page_id % 9 = 0 THEN ' ' || chr(10) || chr(9) || ' ' ELSE html END AS content
FROM (SELECT *, regexp_replace(string_split(regexp_replace(url, '\\?.*$', ''), '/')[-1], '[^A-Za-z0-9_-]', '', 'g') AS stem FROM pages)"""

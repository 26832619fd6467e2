"""DuckDB SQL twins of the registered queries (the correctness oracle)."""

from __future__ import annotations

from .sqlviews import CORPUS_V, QUERY_V, QUERY_VEC_V, VEC_V, sq_l2, tok

ORACLE: dict[str, str] = {}

BM25_CTES = f"""
corpus AS ({CORPUS_V}),
toks AS (SELECT domain, chunk_id, {tok('content')} AS toks FROM corpus),
chunk_len AS (SELECT domain, chunk_id, CAST(len(toks) AS BIGINT) AS dl FROM toks),
postings AS (SELECT domain, chunk_id, term, count(*) AS tf
             FROM (SELECT domain, chunk_id, unnest(toks) AS term FROM toks) GROUP BY domain, chunk_id, term),
cstats AS (SELECT domain, count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM chunk_len GROUP BY domain),
dfs AS (SELECT p.domain, p.term, count(*) AS df FROM postings p GROUP BY p.domain, p.term),
idf0 AS (SELECT d.domain, d.term, d.df, ln(c.n - d.df + 0.5) - ln(d.df + 0.5) AS idf0
         FROM dfs d JOIN cstats c USING (domain)),
avgidf AS (SELECT domain, avg(idf0) AS avg_idf FROM idf0 GROUP BY domain),
term_stats AS (SELECT i.domain, i.term, i.df,
   round(CASE WHEN i.idf0 < 0 THEN 0.25 * a.avg_idf ELSE i.idf0 END, 12) AS idf
   FROM idf0 i JOIN avgidf a USING (domain)),
impacts AS (SELECT p.domain, p.term, p.chunk_id, p.tf,
   t.idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))) AS weight
   FROM postings p JOIN chunk_len l USING (domain, chunk_id) JOIN cstats c USING (domain)
   JOIN term_stats t USING (domain, term))
"""

BM25_TOPK_CTES = BM25_CTES + f""",
queries AS ({QUERY_V}),
qterms AS (SELECT query_id, domain, term, count(*) AS qtf
           FROM (SELECT query_id, domain, unnest({tok('query')}) AS term FROM queries)
           GROUP BY query_id, domain, term),
bm25_scores AS (SELECT q.query_id, q.domain, i.chunk_id, round(sum(q.qtf * i.weight), 9) AS score
           FROM qterms q JOIN impacts i USING (domain, term) GROUP BY q.query_id, q.domain, i.chunk_id),
bm25_hits AS (SELECT * FROM (
   SELECT query_id, domain, chunk_id, score,
     row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, chunk_id ASC) AS rank
   FROM bm25_scores WHERE score > 0) WHERE rank <= 5)
"""

ORACLE["tokenize"] = f"""
SELECT doc_id AS chunk_id, CAST(len({tok('text')}) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct({tok('text')})) AS BIGINT) AS n_distinct
FROM documents"""

ORACLE["bm25_term_stats"] = f"WITH {BM25_CTES} SELECT domain, term, df, round(idf, 6) AS idf FROM term_stats"

ORACLE["bm25_corpus_stats"] = f"""WITH {BM25_CTES}
SELECT c.domain, c.n, round(c.avgdl, 6) AS avgdl, round(a.avg_idf, 6) AS avg_idf
FROM cstats c JOIN avgidf a USING (domain)"""

ORACLE["bm25_topk"] = f"""WITH {BM25_TOPK_CTES}
SELECT query_id, domain, CAST(rank AS BIGINT) AS rank, chunk_id, round(score, 6) AS score FROM bm25_hits"""

ORACLE["bm25_scores"] = f"""WITH {BM25_TOPK_CTES}
SELECT query_id, domain, chunk_id, round(score, 6) AS score FROM bm25_scores"""

VEC_CTES = f"""
qvecs AS ({QUERY_VEC_V}),
vectors AS ({VEC_V}),
vec_scores AS (SELECT q.query_id, q.domain, v.chunk_id, {sq_l2('q.qvec', 'v.vec')} AS dist
   FROM qvecs q JOIN vectors v ON v.domain = q.domain AND v.chunk_id <> q.exclude_id),
vec_hits AS (SELECT * FROM (SELECT query_id, domain, chunk_id, dist, 1.0 / (1.0 + dist) AS score,
     row_number() OVER (PARTITION BY query_id, domain ORDER BY dist ASC, chunk_id ASC) AS rank
   FROM vec_scores) WHERE rank <= 5)
"""

NORM_CTES = """
vec_norm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
     ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
   FROM vec_hits WINDOW w AS (PARTITION BY query_id, domain)),
bm25_norm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
     ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
   FROM bm25_hits WINDOW w AS (PARTITION BY query_id, domain))
"""

FUSE_CTES = f"""
both_lists AS (
   SELECT query_id, domain, chunk_id, rank, norm, 0 AS list_no, 0.6 AS w FROM vec_norm
   UNION ALL
   SELECT query_id, domain, chunk_id, rank, norm, 1 AS list_no, 0.4 AS w FROM bm25_norm),
with_fp AS (SELECT b.*, left(c.content, 100) AS fp FROM both_lists b JOIN ({CORPUS_V}) c USING (domain, chunk_id)),
fused AS (SELECT query_id, domain, fp, round(sum(w * norm), 9) AS fused,
     min({{'list_no': list_no, 'rank': rank, 'chunk_id': chunk_id}}) AS first
   FROM with_fp GROUP BY query_id, domain, fp),
fused_top AS (SELECT * FROM (SELECT query_id, domain, first.chunk_id AS chunk_id, fused,
     first.list_no AS first_list, first.rank AS first_rank,
     row_number() OVER (PARTITION BY query_id, domain ORDER BY fused DESC, first.list_no, first.rank) AS rank
   FROM fused) WHERE rank <= 5),
hybrid AS (SELECT *, CASE WHEN max(fused) OVER w = min(fused) OVER w THEN 1.0
     ELSE (fused - min(fused) OVER w) / (max(fused) OVER w - min(fused) OVER w) END AS score
   FROM fused_top WINDOW w AS (PARTITION BY query_id, domain))
"""

HYBRID_CTES = BM25_TOPK_CTES + "," + VEC_CTES + "," + NORM_CTES + "," + FUSE_CTES

ORACLE["vector_topk"] = f"""WITH {VEC_CTES}
SELECT query_id, domain, CAST(rank AS BIGINT) AS rank, chunk_id, round(dist, 6) AS dist, round(score, 6) AS score
FROM vec_hits"""

ORACLE["score_normalize"] = f"""WITH {BM25_TOPK_CTES}, {VEC_CTES}, {NORM_CTES}
SELECT query_id, domain, 'vector' AS list, CAST(rank AS BIGINT) AS rank, chunk_id, round(norm, 6) AS norm FROM vec_norm
UNION ALL
SELECT query_id, domain, 'bm25' AS list, CAST(rank AS BIGINT) AS rank, chunk_id, round(norm, 6) AS norm FROM bm25_norm"""

ORACLE["hybrid_fuse"] = f"""WITH {HYBRID_CTES}
SELECT query_id, domain, first.chunk_id AS chunk_id, round(fused, 6) AS fused,
  CAST(first.list_no AS BIGINT) AS first_list, CAST(first.rank AS BIGINT) AS first_rank FROM fused"""

ORACLE["hybrid_topk"] = f"""WITH {HYBRID_CTES}
SELECT query_id, domain, CAST(rank AS BIGINT) AS rank, chunk_id, round(fused, 6) AS fused, round(score, 6) AS score
FROM hybrid"""

# ---------------------------------------------------------------- text jobs
from ..functions.text import IP_REDACTION, REDACTIONS  # noqa: E402
from ..operators.tfidf import TFIDF_SEED  # noqa: E402


def redact_sql(x: str, with_ip: bool = False) -> str:
    for _, pat, repl in REDACTIONS + ((IP_REDACTION,) if with_ip else ()):
        x = f"regexp_replace({x}, '{pat}', '{repl}', 'g')"
    return x


def redaction_counts_sql(x: str) -> list[tuple[str, str]]:
    out, cur = [], x
    for name, pat, repl in REDACTIONS + (IP_REDACTION,):
        out.append((name.lower(), f"CAST(len(regexp_extract_all({cur}, '{pat}')) AS BIGINT)"))
        cur = f"regexp_replace({cur}, '{pat}', '{repl}', 'g')"
    return out


ORACLE["redact_documents"] = f"""
SELECT doc_id, r <> text AS changed, CAST(length(r) AS BIGINT) AS n_chars, md5(r) AS redacted_md5
FROM (SELECT doc_id, text, {redact_sql('text')} AS r FROM documents)"""

_cnt = redaction_counts_sql("text")
ORACLE["pii_counts"] = f"""
WITH c AS (SELECT lang AS domain, {', '.join(f'{e} AS {n}' for n, e in _cnt)} FROM documents)
SELECT domain, count(*) AS docs,
  CAST(sum(CASE WHEN email + phone + credit_card + ssn + ip_address > 0 THEN 1 ELSE 0 END) AS BIGINT) AS docs_with_pii,
  {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n, _ in _cnt)}
FROM c GROUP BY domain"""

ORACLE["chunk_fixed"] = f"""
WITH c AS ({CORPUS_V}),
n AS (SELECT *, CASE WHEN length(content) > 0 THEN greatest(1, CAST(ceil((length(content) - 64) / 448.0) AS BIGINT)) ELSE 0 END AS cnt FROM c),
e AS (SELECT domain, chunk_id AS doc_id, content, unnest(range(cnt)) AS chunk_no FROM n)
SELECT domain, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, doc_id * 1000000 + chunk_no AS chunk_id,
  CAST(length(substring(content, chunk_no * 448 + 1, 512)) AS BIGINT) AS n_chars,
  md5(substring(content, chunk_no * 448 + 1, 512)) AS content_md5
FROM e"""

_seed_rows = ", ".join(f"('seed-{i}', '{t}')" for i, t in enumerate(TFIDF_SEED))
_wt = "list_filter(regexp_extract_all(lower({x}), '[\\pL\\pN_]+'), lambda t: length(t) >= 2)"
TFIDF_CTES = f"""
fitdocs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, text FROM documents
            UNION ALL SELECT * FROM (VALUES {_seed_rows}) s(doc_key, text)),
fittoks AS (SELECT doc_key, {_wt.format(x='text')} AS t FROM fitdocs),
fitgrams AS (SELECT doc_key, unnest(t || (CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM fittoks),
fittf AS (SELECT doc_key, term, count(*) AS tf FROM fitgrams GROUP BY doc_key, term),
fitstats AS (SELECT term, sum(tf) AS total, count(*) AS df FROM fittf GROUP BY term),
fittop AS (SELECT * FROM fitstats ORDER BY total DESC, term ASC LIMIT 512),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, term, CAST(total AS BIGINT) AS total, df,
   ln((1 + (SELECT count(*) FROM fitdocs)) / (1 + df)) + 1 AS idf FROM fittop)
"""

ORACLE["tfidf_vocab"] = f"WITH {TFIDF_CTES} SELECT idx, term, total, df, round(idf, 6) AS idf FROM vocab"

ORACLE["tfidf_vectors"] = f"""WITH {TFIDF_CTES},
c AS ({CORPUS_V}),
ct AS (SELECT chunk_id, {_wt.format(x='content')} AS t FROM c),
cg AS (SELECT chunk_id, unnest(t || (CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM ct),
ctf AS (SELECT chunk_id, term, count(*) AS tf FROM cg GROUP BY chunk_id, term),
w AS (SELECT ctf.chunk_id, v.idx, (1 + ln(ctf.tf)) * v.idf AS w FROM ctf JOIN vocab v USING (term)),
sp AS (SELECT chunk_id, list({{'idx': idx, 'w': w}}) AS m FROM w GROUP BY chunk_id),
raw AS (SELECT c.domain, c.chunk_id,
   list_transform(range(512), lambda i: coalesce(struct_extract(list_filter(sp.m, lambda e: e.idx = i)[1], 'w'), 0.0::DOUBLE)) AS raw
   FROM c LEFT JOIN sp USING (chunk_id)),
nr AS (SELECT *, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(raw, lambda x: x * x)), lambda a, b: a + b)) AS nrm FROM raw)
SELECT domain, chunk_id,
  list_transform(CASE WHEN nrm = 0 THEN list_transform(range(512), lambda i: 1.0::DOUBLE / sqrt(512.0::DOUBLE))
                 ELSE list_transform(raw, lambda x: x / nrm) END, lambda x: round(x, 6)) AS vec
FROM nr"""

ORACLE["fingerprint_dupes"] = f"""
WITH c AS ({CORPUS_V})
SELECT 'fp100' AS kind, domain, min(chunk_id) AS first_chunk_id, count(*) AS n FROM c GROUP BY domain, left(content, 100) HAVING count(*) > 1
UNION ALL
SELECT 'fp80' AS kind, domain, min(chunk_id) AS first_chunk_id, count(*) AS n FROM c GROUP BY domain, left(content, 80) HAVING count(*) > 1"""

ORACLE["placeholder_docs"] = """
WITH domains AS (SELECT * FROM (VALUES ('billing'), ('returns'), ('escalation'), ('en'), ('de'), ('fr'), ('es')) d(domain)),
docs AS (SELECT lang AS domain, source, text FROM documents),
ph AS (SELECT domain, 'placeholder' AS source, 'No documents loaded for ' || domain || '.' AS text
       FROM domains WHERE domain NOT IN (SELECT DISTINCT domain FROM docs)),
full_docs AS (SELECT * FROM docs UNION ALL SELECT * FROM ph)
SELECT domain, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(source) AS min_source
FROM full_docs GROUP BY domain"""

# ---------------------------------------------------------------- audit / KPI
from .sqlviews import AUDIT_V  # noqa: E402

TAIL_CTES = f"""
audit AS ({AUDIT_V}),
tail7 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY "timestamp" DESC, audit_id DESC) AS back
   FROM audit WHERE date <= DATE '2024-01-30' AND date > DATE '2024-01-30' - INTERVAL 7 DAY) WHERE back <= 500),
win7 AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY "timestamp", audit_id) AS BIGINT) AS pos FROM tail7),
sample50 AS (SELECT * FROM win7 ORDER BY md5(audit_id || '42') LIMIT 50)
"""


def kpi_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON TRUE"
    return f"""(WITH a AS (SELECT {g}coalesce(cache_hit, false) AS hit, coalesce(low_confidence_flag, false) AS low,
        coalesce(response_latency_ms, 0) AS lat, coalesce(final_confidence, 0.0) AS conf FROM {src}),
  m AS (SELECT {g}count(*) AS total_queries,
        round(sum(CAST(hit AS INTEGER)) / count(*), 4) AS cache_hit_rate,
        round(sum(CAST(low AS INTEGER)) / count(*), 4) AS low_confidence_rate,
        round(sum(lat) / count(*), 1) AS avg_latency_ms,
        round(sum(conf) / count(*), 4) AS avg_confidence FROM a {gb}),
  h AS (SELECT {g}lat, count(*) AS c FROM a {gb}{', ' if group else 'GROUP BY '}lat),
  hc AS (SELECT *, sum(c) OVER ({part} ORDER BY lat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
        sum(c) OVER ({'PARTITION BY ' + group if group else ''}) AS n FROM h),
  p AS (SELECT {g}min(lat) AS p95_latency_ms FROM hc WHERE cum >= greatest(0, floor(0.95::DOUBLE * n) - 1) + 1 {gb})
  SELECT {g}total_queries, cache_hit_rate, low_confidence_rate, avg_latency_ms, CAST(p95_latency_ms AS BIGINT) AS p95_latency_ms, avg_confidence
  FROM m JOIN p {on})"""


ORACLE["audit_tail"] = f"""
WITH audit AS ({AUDIT_V}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, audit_id DESC) AS back
   FROM audit WHERE date = DATE '2024-01-30') WHERE back <= 100)
SELECT CAST(row_number() OVER (ORDER BY "timestamp", audit_id) AS BIGINT) AS pos, audit_id, "timestamp", session_id,
  routed_to, final_confidence FROM t"""

ORACLE["audit_window_7d"] = f"WITH {TAIL_CTES} SELECT date, pos, audit_id, \"timestamp\" FROM win7"

ORACLE["kpi_metrics"] = f"WITH audit AS ({AUDIT_V}) SELECT * FROM {kpi_sql('audit')}"

ORACLE["routing_distribution"] = f"""WITH audit AS ({AUDIT_V})
SELECT coalesce(routed_to, 'unknown') AS agent, count(*) AS n FROM audit GROUP BY 1"""

ORACLE["kpi_targets"] = f"""WITH audit AS ({AUDIT_V}), m AS (SELECT * FROM {kpi_sql('audit')}),
long AS (UNPIVOT (SELECT CAST(cache_hit_rate AS DOUBLE) AS cache_hit_rate, CAST(low_confidence_rate AS DOUBLE) AS low_confidence_rate,
   CAST(avg_latency_ms AS DOUBLE) AS avg_latency_ms, CAST(p95_latency_ms AS DOUBLE) AS p95_latency_ms,
   CAST(avg_confidence AS DOUBLE) AS avg_confidence FROM m)
   ON cache_hit_rate, low_confidence_rate, avg_latency_ms, p95_latency_ms, avg_confidence INTO NAME metric VALUE value),
targets AS (SELECT * FROM (VALUES ('cache_hit_rate', 0.40::DOUBLE, false), ('low_confidence_rate', 0.15::DOUBLE, true),
   ('avg_latency_ms', 1500.0::DOUBLE, true), ('p95_latency_ms', 3500.0::DOUBLE, true), ('avg_confidence', 0.80::DOUBLE, false))
   t(metric, target, lower_is_better))
SELECT metric, round(value, 6) AS value, target, lower_is_better,
  CASE WHEN lower_is_better THEN value <= target ELSE value >= target END AS passed
FROM long JOIN targets USING (metric)"""

ORACLE["kpi_daily"] = f"WITH audit AS ({AUDIT_V}) SELECT * FROM {kpi_sql('audit', 'date')}"

ORACLE["audit_sample"] = f"WITH {TAIL_CTES} SELECT audit_id, date, \"timestamp\", routed_to FROM sample50"

ORACLE["kpi_report"] = f"WITH {TAIL_CTES} SELECT * FROM {kpi_sql('sample50')}"

ORACLE["audit_records"] = f"""WITH audit AS ({AUDIT_V}),
resp AS (SELECT audit_id, date, routed_to, router_confidence,
   CASE WHEN cache_hit AND CAST(audit_id AS BIGINT) % 3 = 0 THEN NULL ELSE retrieved_sources END AS sources,
   CASE WHEN cache_hit AND CAST(audit_id AS BIGINT) % 3 = 0 THEN NULL ELSE final_confidence + 0.00004::DOUBLE END AS confidence,
   CASE WHEN cache_hit THEN NULL ELSE low_confidence_flag END AS low_confidence,
   response_latency_ms AS latency_ms, cache_hit FROM audit)
SELECT audit_id, date, routed_to, round(router_confidence, 4) AS router_confidence,
  CASE WHEN cache_hit THEN coalesce(sources, []::VARCHAR[]) ELSE sources END AS retrieved_sources,
  round(CASE WHEN cache_hit THEN coalesce(confidence, 1.0::DOUBLE) ELSE confidence END, 4) AS final_confidence,
  CASE WHEN cache_hit THEN coalesce(low_confidence, false) ELSE low_confidence END AS low_confidence_flag,
  CAST(latency_ms AS BIGINT) AS response_latency_ms, coalesce(cache_hit, false) AS cache_hit
FROM resp"""

# ---------------------------------------------------------------- parsers / confidence
from ..functions.domains import DISCLAIMERS, SYSTEM_PROMPTS  # noqa: E402
from ..functions.parse import ROUTING_TERMS  # noqa: E402
from .sqlviews import MODEL_OUT_V, ROUTER_RAW_V  # noqa: E402


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


PARSE_ROUTER_CTES = f"""
rr AS ({ROUTER_RAW_V}),
r1 AS (SELECT event_id, raw, {strip_sql('raw')} AS s FROM rr),
r2 AS (SELECT *, json_valid(s) AS valid FROM r1),
r3 AS (SELECT *, valid AND starts_with(s, '{{') AND ends_with(s, '}}')
                 AND (CASE WHEN valid THEN json_type(s) END) = 'OBJECT' AS is_obj FROM r2),
r4 AS (SELECT *, valid AND NOT is_obj AS non_obj,
        CASE WHEN is_obj THEN json_type(s, '$.category') END AS cat_t,
        CASE WHEN is_obj THEN json_type(s, '$.confidence') END AS conf_t,
        CASE WHEN is_obj THEN json_extract_string(s, '$.category') END AS cat_s,
        CASE WHEN is_obj THEN json_extract_string(s, '$.confidence') END AS conf_s FROM r3),
r5 AS (SELECT *, is_obj AND ((cat_t IS NOT NULL AND cat_t <> 'VARCHAR') OR conf_t IN ('NULL', 'ARRAY', 'OBJECT')) AS bad,
        CASE WHEN conf_t IS NULL THEN 0.5::DOUBLE WHEN conf_t = 'BOOLEAN' THEN (CASE WHEN conf_s = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
             ELSE TRY_CAST(conf_s AS DOUBLE) END AS json_conf,
        lower({strip_sql("coalesce(cat_s, '')")}) AS json_cat,
        lower(regexp_extract(raw, '(?i)"category"\\s*:\\s*"(\\w+)"', 1)) AS rx_cat,
        regexp_extract(raw, '"confidence"\\s*:\\s*([0-9.]+)', 1) AS rx_conf FROM r4),
parsed AS (SELECT event_id,
   CASE WHEN non_obj OR bad THEN 'escalation'
        WHEN is_obj AND json_conf IS NOT NULL AND json_cat IN ('billing', 'returns', 'escalation') THEN json_cat
        WHEN rx_cat IN ('billing', 'returns', 'escalation') THEN rx_cat ELSE 'escalation' END AS category,
   CASE WHEN non_obj OR bad THEN 0.5::DOUBLE
        WHEN is_obj AND json_conf IS NOT NULL AND json_cat IN ('billing', 'returns', 'escalation') THEN json_conf
        ELSE coalesce(CASE WHEN rx_conf <> '' THEN TRY_CAST(rx_conf AS DOUBLE) END, 0.5::DOUBLE) END AS confidence,
   non_obj OR bad AS failed FROM r5),
routed AS (SELECT event_id, CASE WHEN failed THEN 'escalation' WHEN confidence < 0.65::DOUBLE THEN 'escalation' ELSE category END AS category,
   CASE WHEN failed THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM parsed)
"""

ORACLE["parse_router"] = f"WITH {PARSE_ROUTER_CTES} SELECT event_id, category, confidence, failed FROM parsed"
ORACLE["route_queries"] = f"WITH {PARSE_ROUTER_CTES} SELECT event_id, category, confidence FROM routed"


def _sq(s: str) -> str:
    return s.replace("'", "''")


_dom_rows = ", ".join(f"('{d}', '{_sq(SYSTEM_PROMPTS[d])}', '{_sq(DISCLAIMERS[d])}')" for d in SYSTEM_PROMPTS)
ORACLE["domain_dispatch"] = f"""WITH {PARSE_ROUTER_CTES},
doms AS (SELECT * FROM (VALUES {_dom_rows}) d(agent, system_prompt, disclaimer))
SELECT r.event_id, d.agent, d.disclaimer, md5(d.system_prompt) AS system_prompt_md5
FROM routed r LEFT JOIN doms d ON d.agent = CASE WHEN r.category IN ('billing', 'returns', 'escalation') THEN r.category ELSE 'escalation' END"""

_wr = "regexp_extract_all(lower(text), '[\\pL\\pN_]+')"
_cnts = {c: f"len(list_filter(toks, lambda t: t IN ({', '.join(repr(x) for x in ts)})))" for c, ts in ROUTING_TERMS.items()}
ORACLE["route_lexical"] = f"""
WITH t AS (SELECT doc_id, {_wr} AS toks FROM documents),
c AS (SELECT doc_id, {', '.join(f'{e} AS n_{c}' for c, e in _cnts.items())} FROM t),
b AS (SELECT *, n_billing + n_returns + n_escalation AS total, greatest(n_billing, n_returns, n_escalation) AS best FROM c),
w AS (SELECT *, (CASE WHEN n_billing = best THEN 1 ELSE 0 END) + (CASE WHEN n_returns = best THEN 1 ELSE 0 END)
        + (CASE WHEN n_escalation = best THEN 1 ELSE 0 END) AS n_best,
      CASE WHEN n_billing = best THEN 'billing' WHEN n_returns = best THEN 'returns' ELSE 'escalation' END AS winner FROM b),
r AS (SELECT doc_id, CASE WHEN total > 0 AND n_best = 1 THEN winner ELSE 'escalation' END AS cat,
        CASE WHEN total > 0 AND n_best = 1 THEN best / total ELSE 0.5::DOUBLE END AS conf FROM w)
SELECT doc_id, CASE WHEN conf < 0.65::DOUBLE THEN 'escalation' ELSE cat END AS category, round(conf, 6) AS confidence FROM r"""

ANSWER_CTES = f"""
mo AS ({MODEL_OUT_V}),
pa AS (SELECT doc_id,
   CASE WHEN regexp_matches(raw, '(?is)ANSWER:') THEN {strip_sql("regexp_extract(raw, '(?is)ANSWER:\\s*(.*?)(?:\\n\\s*CONFIDENCE:|$)', 1)")}
        ELSE {strip_sql('raw')} END AS answer,
   CASE WHEN regexp_matches(raw, '(?is)CONFIDENCE:') THEN {strip_sql("regexp_extract(raw, '(?is)CONFIDENCE:\\s*(.*)', 1)")}
        ELSE '' END AS rating_text FROM mo),
pr AS (SELECT doc_id, rating_text, regexp_extract_all(coalesce(rating_text, ''), '\\b(0(?:\\.\\d+)?|1(?:\\.0+)?)\\b', 1) AS m FROM pa),
rating AS (SELECT doc_id, rating_text, CASE WHEN len(m) > 0 AND TRY_CAST(m[-1] AS DOUBLE) IS NOT NULL
     THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(m[-1] AS DOUBLE))) ELSE 0.5::DOUBLE END AS rating FROM pr)
"""

ORACLE["parse_answer"] = f"""WITH {ANSWER_CTES}
SELECT doc_id, md5(answer) AS answer_md5, CAST(length(answer) AS BIGINT) AS answer_len, rating_text FROM pa"""

ORACLE["parse_rating"] = f"WITH {ANSWER_CTES} SELECT doc_id, rating FROM rating"

RS_CTES = f"""{HYBRID_CTES},
rs_agg AS (SELECT query_id, domain, count(*) AS n_hits, sum(score * (1.0::DOUBLE / rank)) / sum(1.0::DOUBLE / rank) AS rs
   FROM hybrid GROUP BY query_id, domain),
rscore AS (SELECT q.query_id, q.domain, CAST(coalesce(a.n_hits, 0) AS BIGINT) AS n_hits, coalesce(a.rs, 0.0::DOUBLE) AS retrieval_score
   FROM queries q LEFT JOIN rs_agg a USING (query_id, domain))
"""

ORACLE["retrieval_score"] = f"WITH {RS_CTES} SELECT query_id, domain, n_hits, round(retrieval_score, 6) AS retrieval_score FROM rscore"

ORACLE["confidence"] = f"""WITH {RS_CTES}, {ANSWER_CTES},
j AS (SELECT s.*, r.rating_text, r.rating, ((s.query_id * 104729) % 1000) / 1000.0::DOUBLE AS router_confidence
      FROM rscore s LEFT JOIN rating r ON r.doc_id = s.query_id),
l AS (SELECT *, CASE WHEN coalesce(rating_text, '') = '' THEN 0.5::DOUBLE ELSE rating END AS llm_score FROM j),
f AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.3::DOUBLE * router_confidence + 0.4::DOUBLE * retrieval_score + 0.3::DOUBLE * llm_score)), 4) AS confidence FROM l)
SELECT query_id, domain, round(retrieval_score, 6) AS retrieval_score, llm_score, confidence, confidence < 0.65::DOUBLE AS low_confidence FROM f"""

ORACLE["present_answers"] = f"""WITH audit AS ({AUDIT_V})
SELECT audit_id, substring(audit_id, 1, 8) AS audit_short,
  CASE WHEN coalesce(final_confidence, 0.0) >= 0.65::DOUBLE THEN 'good' WHEN coalesce(final_confidence, 0.0) >= 0.5::DOUBLE THEN 'warn' ELSE 'bad' END AS band,
  CAST(round(coalesce(final_confidence, 0.0) * 100) AS BIGINT) AS pct,
  list_transform(retrieved_sources, lambda p: string_split_regex(p, '[\\\\/]')[-1]) AS files
FROM audit"""

# ---------------------------------------------------------------- reference graph
from ..functions.text import REFERENCE_PATTERNS  # noqa: E402
from .sqlviews import POLICY_V  # noqa: E402

_phr = ", ".join(f"regexp_extract(content, '(?i)({p})', 1)" for p in REFERENCE_PATTERNS)
GRAPH_CTES = f"""
policy AS ({POLICY_V}),
phr AS (SELECT domain, chunk_id, list_filter([{_phr}], lambda x: x <> '') AS phrases FROM policy),
nodes AS (SELECT domain, chunk_id, source, left(content, 80) AS fp80 FROM policy),
refs AS (SELECT domain, chunk_id, unnest(list_distinct(flatten(list_transform(phrases, lambda p: {tok('p')})))) AS word FROM phr),
words AS (SELECT domain, chunk_id, unnest(list_distinct({tok('content')})) AS word FROM policy),
edges AS (SELECT DISTINCT r.domain, r.chunk_id AS src, w.chunk_id AS dst FROM refs r JOIN words w
          ON w.domain = r.domain AND w.word = r.word WHERE r.chunk_id <> w.chunk_id)
"""

ORACLE["reference_phrases"] = f"WITH {GRAPH_CTES} SELECT domain, chunk_id, phrases FROM phr WHERE len(phrases) > 0"
ORACLE["reference_edges"] = f"WITH {GRAPH_CTES} SELECT domain, src, dst FROM edges"
ORACLE["graph_stats"] = f"""WITH {GRAPH_CTES},
n AS (SELECT domain, count(*) AS nodes FROM nodes GROUP BY domain),
e AS (SELECT domain, count(*) AS edges FROM edges GROUP BY domain)
SELECT n.domain, n.nodes, CAST(coalesce(e.edges, 0) AS BIGINT) AS edges FROM n LEFT JOIN e USING (domain)"""

ORACLE["graph_expand"] = f"""WITH {GRAPH_CTES}, {VEC_CTES},
seed_rows AS (SELECT s.query_id, s.domain, s.rank, s.chunk_id, n.source, n.fp80 FROM vec_hits s JOIN nodes n USING (domain, chunk_id)),
seed_fps AS (SELECT DISTINCT query_id, domain, fp80 FROM seed_rows),
start AS (SELECT DISTINCT f.query_id, f.domain, n.chunk_id FROM seed_fps f JOIN nodes n USING (domain, fp80)),
succ AS (SELECT s.query_id, s.domain, w.chunk_id FROM start s JOIN refs r USING (domain, chunk_id)
         JOIN words w ON w.domain = r.domain AND w.word = r.word),
pred AS (SELECT s.query_id, s.domain, r.chunk_id FROM start s JOIN words w USING (domain, chunk_id)
         JOIN refs r ON r.domain = w.domain AND r.word = w.word),
nxt AS (SELECT * FROM succ UNION SELECT * FROM pred EXCEPT SELECT * FROM start),
added AS (SELECT a.query_id, a.domain, a.chunk_id, n.source, n.fp80 FROM nxt a JOIN nodes n USING (domain, chunk_id)
          ANTI JOIN seed_fps f USING (query_id, domain, fp80)),
added1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain, fp80 ORDER BY chunk_id) AS r FROM added) WHERE r = 1),
nseeds AS (SELECT query_id, domain, count(*) AS n FROM seed_rows GROUP BY query_id, domain)
SELECT query_id, domain, CAST(rank AS BIGINT) AS pos, chunk_id, source, true AS seed FROM seed_rows
UNION ALL
SELECT a.query_id, a.domain, CAST(s.n + row_number() OVER (PARTITION BY a.query_id, a.domain ORDER BY a.chunk_id) AS BIGINT) AS pos,
  a.chunk_id, a.source, false AS seed FROM added1 a JOIN nseeds s USING (query_id, domain)"""

# ---------------------------------------------------------------- sessions / cache
from .sqlviews import CACHE_V, LOOKUP_V, TURNS_V, dot  # noqa: E402


def sessions_sql(ttl_seconds: int) -> str:
    return f"""
t AS ({TURNS_V}),
l AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) AS prev FROM t),
n AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {ttl_seconds * 1_000_000} THEN 1 ELSE 0 END AS is_new FROM l),
e AS (SELECT *, sum(is_new) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS epoch FROM n),
s AS (SELECT *, row_number() OVER (PARTITION BY session_id, epoch ORDER BY ts, seq) AS turn_no FROM e)
"""


ORACLE["sessionize"] = f"""WITH {sessions_sql(1800)}
SELECT session_id, seq, CAST(epoch AS BIGINT) AS epoch, CAST(turn_no AS BIGINT) AS turn_no FROM s"""

_line = "upper(substring(coalesce(role, 'user'), 1, 1)) || lower(substring(coalesce(role, 'user'), 2)) || ': ' || coalesce({c}, '')"

ORACLE["session_context"] = f"""WITH {sessions_sql(6 * 3600)},
h AS (SELECT *, list({_line.format(c='content')}) OVER (PARTITION BY session_id, epoch ORDER BY turn_no
        ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lines FROM s)
SELECT session_id, seq, CAST(epoch AS BIGINT) AS epoch, CAST(turn_no AS BIGINT) AS turn_no,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_history,
  CASE WHEN coalesce(len(lines), 0) > 0 THEN array_to_string(lines, chr(10)) ELSE '' END AS history_text FROM h"""

ORACLE["format_history"] = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, count(*) AS n_turns, string_agg({_line.format(c='text')}, chr(10) ORDER BY turn) AS history_text
FROM r WHERE rn <= 20 GROUP BY conv_id"""

CACHE_CTES = f"""
ce AS ({CACHE_V}), lk AS ({LOOKUP_V}),
cand AS (SELECT lk.lookup_id, ce.entry_id, ce.stored_at, {dot('lk.vec', 'ce.vec')} AS sim
   FROM lk JOIN ce ON ce.domain = lk.domain AND ce.stored_at <= lk.ts AND lk.ts < ce.stored_at + INTERVAL 3600 SECOND),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY sim DESC, stored_at, entry_id) AS r
   FROM cand WHERE sim > 0) WHERE r = 1),
res AS (SELECT lk.lookup_id, lk.domain, b.entry_id AS best_entry_id, b.sim AS best_sim, coalesce(b.sim >= 0.92::DOUBLE, false) AS hit
   FROM lk LEFT JOIN best b USING (lookup_id))
"""

ORACLE["cache_lookup"] = f"WITH {CACHE_CTES} SELECT lookup_id, domain, best_entry_id, round(best_sim, 6) AS best_sim, hit FROM res"
ORACLE["cache_misses"] = f"WITH {CACHE_CTES} SELECT lookup_id, domain FROM res WHERE NOT hit"

ORACLE["cache_exact"] = f"""WITH audit AS ({AUDIT_V}),
lk AS (SELECT audit_id AS lookup_id, "timestamp" AS ts, md5(routed_to || ':' || redacted_query) AS key FROM audit),
en AS (SELECT audit_id AS entry_id, "timestamp" AS stored_at, md5(routed_to || ':' || redacted_query) AS key FROM audit WHERE NOT cache_hit),
c AS (SELECT lk.lookup_id, en.entry_id, en.stored_at FROM lk JOIN en ON en.key = lk.key AND en.stored_at < lk.ts
      AND lk.ts < en.stored_at + INTERVAL 3600 SECOND),
agg AS (SELECT lookup_id, count(*) AS n_live, arg_max(entry_id, {{'s': stored_at, 'e': entry_id}}) AS entry_id FROM c GROUP BY lookup_id)
SELECT lk.lookup_id, lk.key, agg.n_live IS NOT NULL AS exact_hit, CAST(coalesce(agg.n_live, 0) AS BIGINT) AS n_live, agg.entry_id
FROM lk LEFT JOIN agg USING (lookup_id)"""

# ---------------------------------------------------------------- eval suite
from ..functions.assertions import KNOWN_NUMBERS, SUSPICIOUS_PATTERNS  # noqa: E402
from .sqlviews import EVAL_CASES_V, EVAL_OUTPUTS_V  # noqa: E402

_known = ", ".join("'" + k.lower().replace("'", "''") + "'" for k in KNOWN_NUMBERS)
EVAL_CTES = f"""
cases AS ({EVAL_CASES_V}),
outs AS ({EVAL_OUTPUTS_V}),
j0 AS (SELECT c.*, o.output, regexp_extract(coalesce(o.output, ''), '<!--CXMETA:(.+?)-->', 1) AS m FROM cases c LEFT JOIN outs o USING (case_id)),
j AS (SELECT *,
   CASE WHEN json_valid(m) THEN json_extract_string(m, '$.agent') END AS agent,
   CASE WHEN json_valid(m) THEN CAST(json_extract(m, '$.sources') AS VARCHAR[]) END AS sources,
   CASE WHEN json_valid(m) THEN TRY_CAST(json_extract_string(m, '$.confidence') AS DOUBLE) END AS conf,
   CASE WHEN json_valid(m) THEN TRY_CAST(json_extract_string(m, '$.latency_ms') AS DOUBLE) END AS lat,
   {strip_sql("regexp_replace(coalesce(output, ''), '\\n*<!--CXMETA:.+?-->', '')")} AS clean FROM j0),
jf AS (SELECT *, lower(clean) AS lt FROM j),
jk AS (SELECT *, len(list_filter([{_known}], lambda k: contains(lt, k))) > 0 AS known,
   regexp_extract(lt, '{SUSPICIOUS_PATTERNS[0]}', 0) AS f1, regexp_extract(lt, '{SUSPICIOUS_PATTERNS[1]}', 0) AS f2 FROM jf),
jx AS (SELECT *, list_filter([CASE WHEN f1 <> '' AND NOT known THEN f1 END, CASE WHEN f2 <> '' AND NOT known THEN f2 END],
   lambda x: x IS NOT NULL) AS flags, coalesce(conf, 0.0::DOUBLE) AS c0, coalesce(lat, 0.0::DOUBLE) AS l0,
   coalesce(max_latency_ms, 8000.0::DOUBLE) AS lm, coalesce(min_confidence, 0.60::DOUBLE) AS cm,
   coalesce(sources, []::VARCHAR[]) AS s0 FROM jk),
arows AS (
 SELECT case_id, 1 AS ord, 'has_source' AS assertion, len(s0) > 0 AS pass, CASE WHEN len(s0) > 0 THEN 1.0 ELSE 0.0 END AS score,
   CASE WHEN len(s0) > 0 THEN 'Cited ' || CAST(len(s0) AS VARCHAR) || ' source(s): ' || array_to_string(s0, ', ')
        ELSE 'No source documents cited — potential hallucination' END AS reason FROM jx
 UNION ALL
 SELECT case_id, 2, 'latency', l0 <= lm, CASE WHEN l0 <= lm THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (l0 - lm) / lm) END,
   CASE WHEN l0 <= lm THEN 'Latency ' || (CASE WHEN l0 = floor(l0) THEN CAST(CAST(l0 AS BIGINT) AS VARCHAR) ELSE CAST(l0 AS VARCHAR) END) || 'ms ≤ ' || (CASE WHEN lm = floor(lm) THEN CAST(CAST(lm AS BIGINT) AS VARCHAR) ELSE CAST(lm AS VARCHAR) END) || 'ms' ELSE 'Slow: ' || (CASE WHEN l0 = floor(l0) THEN CAST(CAST(l0 AS BIGINT) AS VARCHAR) ELSE CAST(l0 AS VARCHAR) END) || 'ms > ' || (CASE WHEN lm = floor(lm) THEN CAST(CAST(lm AS BIGINT) AS VARCHAR) ELSE CAST(lm AS VARCHAR) END) || 'ms' END FROM jx
 UNION ALL
 SELECT case_id, 3, 'confidence', c0 >= cm, c0,
   CASE WHEN c0 >= cm THEN 'Confidence ' || printf('%.3f', c0) || ' ≥ ' || (CASE WHEN cm = floor(cm) THEN CAST(CAST(cm AS BIGINT) AS VARCHAR) ELSE CAST(cm AS VARCHAR) END) ELSE 'Low confidence: ' || printf('%.3f', c0) || ' < ' || (CASE WHEN cm = floor(cm) THEN CAST(CAST(cm AS BIGINT) AS VARCHAR) ELSE CAST(cm AS VARCHAR) END) END FROM jx
 UNION ALL
 SELECT case_id, 4, 'no_fabricated_facts', len(flags) = 0, CASE WHEN len(flags) = 0 THEN 1.0 ELSE 0.0 END,
   CASE WHEN len(flags) = 0 THEN 'No fabricated facts detected' ELSE 'Possible fabricated facts: "' || array_to_string(flags, '", "') || '"' END FROM jx
 UNION ALL
 SELECT case_id, 5, custom_check,
   CASE custom_check WHEN 'has_sources' THEN len(s0) > 0
     WHEN 'ood_handled' THEN coalesce(agent = 'escalation', false) OR coalesce(conf, 1.0) < 0.65::DOUBLE
     ELSE length(coalesce(output, '')) > 20 END AS p,
   CASE WHEN (CASE custom_check WHEN 'has_sources' THEN len(s0) > 0
     WHEN 'ood_handled' THEN coalesce(agent = 'escalation', false) OR coalesce(conf, 1.0) < 0.65::DOUBLE
     ELSE length(coalesce(output, '')) > 20 END) THEN 1.0 ELSE 0.0 END,
   CASE custom_check
     WHEN 'has_sources' THEN CASE WHEN len(s0) > 0 THEN 'Has sources for cross-domain query' ELSE 'No sources on cross-domain query' END
     WHEN 'ood_handled' THEN CASE WHEN coalesce(agent = 'escalation', false) OR coalesce(conf, 1.0) < 0.65::DOUBLE
        THEN 'OOD query correctly handled ' ELSE 'OOD query not flagged ' END
        || '(agent=' || coalesce(agent, 'undefined') || ', confidence=' || printf('%.2f', coalesce(conf, 1.0)) || ')'
     ELSE CASE WHEN length(coalesce(output, '')) > 20 THEN 'Got meaningful response to short query' ELSE 'Response too short' END END
 FROM jx WHERE custom_check IS NOT NULL
 UNION ALL
 SELECT case_id, 5, 'correct_agent', expected_agent IS NULL OR expected_agent = '' OR coalesce(agent = expected_agent, false),
   CASE WHEN expected_agent IS NULL OR expected_agent = '' OR coalesce(agent = expected_agent, false) THEN 1.0 ELSE 0.0 END,
   CASE WHEN expected_agent IS NULL OR expected_agent = '' THEN 'No expected_agent set'
        WHEN coalesce(agent = expected_agent, false) THEN 'Correctly routed to ' || agent
        ELSE 'Wrong agent: expected "' || expected_agent || '", got "' || coalesce(agent, 'undefined') || '"' END
 FROM jx WHERE custom_check IS NULL
 UNION ALL
 SELECT case_id, 6, match_type,
   CASE WHEN match_type = 'icontains' THEN contains(lower(coalesce(output, '')), lower(match_value)) ELSE contains(coalesce(output, ''), match_value) END,
   CASE WHEN (CASE WHEN match_type = 'icontains' THEN contains(lower(coalesce(output, '')), lower(match_value)) ELSE contains(coalesce(output, ''), match_value) END) THEN 1.0 ELSE 0.0 END,
   CASE WHEN (CASE WHEN match_type = 'icontains' THEN contains(lower(coalesce(output, '')), lower(match_value)) ELSE contains(coalesce(output, ''), match_value) END)
     THEN 'Assertion passed' ELSE 'Expected output to ' || match_type || ' "' || match_value || '"' END
 FROM jx WHERE custom_check IS NULL AND match_type IS NOT NULL),
cres AS (SELECT c.case_id, c.description, coalesce(min(CAST(a.pass AS INTEGER)) = 1, false) AS pass FROM cases c
   LEFT JOIN arows a USING (case_id) GROUP BY c.case_id, c.description),
cmeta AS (SELECT r.case_id, r.pass, j.lat, j.conf FROM cres r JOIN jx j USING (case_id))
"""

ORACLE["parse_eval_meta"] = f"""WITH {EVAL_CTES}
SELECT case_id, agent, CAST(len(coalesce(sources, []::VARCHAR[])) AS BIGINT) AS n_sources, conf AS confidence, lat AS latency_ms,
  md5(clean) AS clean_md5, CAST(length(clean) AS BIGINT) AS clean_len FROM jx"""

ORACLE["eval_assertions"] = f"""WITH {EVAL_CTES}
SELECT case_id, CAST(ord AS BIGINT) AS ord, assertion, pass, round(CAST(score AS DOUBLE), 6) AS score, reason FROM arows"""

ORACLE["eval_edge_cases"] = f"""WITH {EVAL_CTES}
SELECT case_id, assertion AS "check", pass, reason FROM arows WHERE ord = 5 AND case_id IN (SELECT case_id FROM cases WHERE custom_check IS NOT NULL)"""

ORACLE["eval_summary"] = f"""WITH {EVAL_CTES},
rt AS (SELECT sum(CASE WHEN assertion = 'correct_agent' AND reason <> 'No expected_agent set' THEN 1 ELSE 0 END) AS routing_total,
   sum(CASE WHEN assertion = 'correct_agent' AND reason <> 'No expected_agent set' AND pass THEN 1 ELSE 0 END) AS routing_correct,
   sum(CASE WHEN assertion IN ('has_source', 'no_fabricated_facts') THEN 1 ELSE 0 END) AS hallucination_total,
   sum(CASE WHEN assertion IN ('has_source', 'no_fabricated_facts') AND NOT pass THEN 1 ELSE 0 END) AS hallucinations FROM arows),
tt AS (SELECT count(*) AS total_tests, CAST(sum(CAST(pass AS INTEGER)) AS BIGINT) AS passed,
   CAST(round(avg(lat)) AS BIGINT) AS avg_latency_ms,
   CASE WHEN count(conf) > 0 THEN ((sum(CAST(round(conf * 1000000) AS BIGINT)) + count(conf) * 500) // (count(conf) * 1000))
     / CAST(1000 AS DOUBLE) END AS avg_confidence FROM cmeta),
h AS (SELECT lat, count(*) AS c FROM cmeta WHERE lat IS NOT NULL GROUP BY lat),
hc AS (SELECT *, sum(c) OVER (ORDER BY lat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(c) OVER () AS n FROM h),
p AS (SELECT min(lat) AS p95 FROM hc WHERE cum >= floor(n * 0.95::DOUBLE) + 1)
SELECT total_tests, passed, round(passed / total_tests * 100, 1) AS accuracy_pct,
  CAST(routing_total AS BIGINT) AS routing_total, CAST(routing_correct AS BIGINT) AS routing_correct,
  CASE WHEN routing_total > 0 THEN round(routing_correct / routing_total * 100, 1) END AS routing_accuracy_pct,
  CAST(hallucination_total AS BIGINT) AS hallucination_total, CAST(hallucinations AS BIGINT) AS hallucinations,
  CASE WHEN hallucination_total > 0 THEN round(hallucinations / hallucination_total * 100, 1) END AS hallucination_rate_pct,
  avg_latency_ms, p95 AS p95_latency_ms, avg_confidence
FROM tt, rt, p"""

ORACLE["eval_failures"] = f"""WITH {EVAL_CTES}
SELECT c.case_id, c.description, list(a.reason ORDER BY a.ord) AS reasons
FROM cases c JOIN arows a USING (case_id) WHERE NOT a.pass GROUP BY c.case_id, c.description"""

from .sqlviews import CACHE_V as _CACHE_V, LOOKUP_V as _LOOKUP_V, dot as _dot, sum_list as _sum_list  # noqa: E402

ORACLE["low_confidence_queue"] = f"""SELECT audit_id, "timestamp", routed_to, final_confidence FROM ({AUDIT_V}) WHERE coalesce(final_confidence, 0) < 0.65::DOUBLE"""

ORACLE["vector_cosine"] = f"""WITH j AS (SELECT e.entry_id AS vec_id, list_transform(e.vec, lambda x: CAST(x AS DOUBLE)) AS a0, l.vec AS b FROM ({_CACHE_V}) e JOIN ({_LOOKUP_V}) l ON l.lookup_id = e.entry_id),
n AS (SELECT *, sqrt({_sum_list('list_transform(a0, lambda x: x * x)')}) AS nrm FROM j),
s AS (SELECT vec_id, b, CASE WHEN nrm = 0 THEN a0 ELSE list_transform(a0, lambda x: x / nrm) END AS a FROM n)
SELECT vec_id, round({_dot('a', 'b')}, 6) AS cosine, round(1.0::DOUBLE / (1.0::DOUBLE + {sq_l2('a', 'b')}), 6) AS similarity FROM s"""

# ---------------------------------------------------------------- optimizer / validation
from ..operators.optimizer import PROMPT_VARIANTS  # noqa: E402
from .sqlviews import COMPLETIONS_V, REQUESTS_V, UPLOADS_V  # noqa: E402

_var_rows = ", ".join(f"({i}, '{n}', '{_sq(p)}')" for i, (n, p) in enumerate(PROMPT_VARIANTS))
OPT_CTES = f"""
audit AS ({AUDIT_V}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, audit_id DESC) AS back
   FROM audit WHERE date = DATE '2024-01-30') WHERE back <= 200),
tp AS (SELECT *, row_number() OVER (ORDER BY "timestamp", audit_id) AS pos FROM t),
inputs AS (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS rank, audit_id,
   coalesce(redacted_query, '') AS query FROM tp WHERE coalesce(low_confidence_flag, false)) WHERE rank <= 20),
variants AS (SELECT * FROM (VALUES {_var_rows}) v(ord, variant, system_prompt)),
prompts AS (SELECT i.rank, i.audit_id, v.ord, v.variant,
   v.system_prompt || chr(10) || chr(10) || 'Documents:' || chr(10) || 'Sample context for optimization.' || chr(10) || chr(10)
   || 'Query: ' || i.query || chr(10) || chr(10) || 'Answer:' AS prompt FROM inputs i, variants v),
comp AS ({COMPLETIONS_V}),
scored AS (SELECT p.rank, p.audit_id, p.ord, p.variant, c.completion,
   {strip_sql('c.completion')} AS a FROM prompts p LEFT JOIN comp c USING (audit_id, variant)),
scores AS (SELECT rank, audit_id, ord, variant,
   CASE WHEN completion IS NULL THEN 0.0::DOUBLE WHEN contains(lower(a), 'i don''t have enough information') THEN 0.3::DOUBLE
        WHEN length(a) < 50 THEN 0.4::DOUBLE ELSE least(1.0::DOUBLE, length(a) / 500.0::DOUBLE) END AS score FROM scored)
"""

ORACLE["optimizer_inputs"] = f"WITH {OPT_CTES} SELECT rank, audit_id, query FROM inputs"
ORACLE["variant_prompts"] = f"WITH {OPT_CTES} SELECT rank, audit_id, CAST(ord AS BIGINT) AS ord, variant, prompt FROM prompts"
ORACLE["variant_scores"] = f"WITH {OPT_CTES} SELECT rank, audit_id, variant, round(score, 6) AS score FROM scores"
ORACLE["variant_winner"] = f"""WITH {OPT_CTES},
m AS (SELECT ord, variant, round(avg(score), 4) AS score, count(*) AS samples FROM scores GROUP BY ord, variant)
SELECT CAST(ord AS BIGINT) AS ord, variant, score, samples, row_number() OVER (ORDER BY score DESC, ord) = 1 AS best FROM m"""

ORACLE["optimizer_report"] = f"""WITH {OPT_CTES},
m AS (SELECT ord, variant, round(avg(score), 4) AS score, count(*) AS samples FROM scores GROUP BY ord, variant),
b AS (SELECT variant FROM m ORDER BY score DESC, ord LIMIT 1)
SELECT (SELECT map_from_entries(list((variant, score) ORDER BY variant)) FROM m) AS scores, b.variant AS best_variant,
  v.system_prompt AS best_prompt, (SELECT max(samples) FROM m) AS samples_tested FROM b JOIN variants v USING (variant)"""

ORACLE["validate_requests"] = f"""WITH r AS ({REQUESTS_V}),
v AS (SELECT request_id, CASE WHEN session_id IS NULL THEN 'session_id_missing'
   WHEN length(session_id) < 1 THEN 'session_id_too_short' WHEN length(session_id) > 128 THEN 'session_id_too_long'
   WHEN query IS NULL THEN 'query_missing' WHEN length(query) < 1 THEN 'query_too_short'
   WHEN length(query) > 2000 THEN 'query_too_long' END AS reject_reason FROM r)
SELECT request_id, reject_reason IS NULL AS valid, reject_reason FROM v"""

ORACLE["validate_uploads"] = f"""WITH u AS ({UPLOADS_V}),
n AS (SELECT *, string_split(coalesce(filename, ''), '/')[-1] AS safe_name FROM u),
e AS (SELECT *, lower(regexp_extract(safe_name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM n),
v AS (SELECT *, CASE WHEN NOT coalesce(domain IN ('billing', 'returns', 'escalation'), false) THEN 'invalid_domain'
   WHEN safe_name = '' OR ext NOT IN ('.txt', '.md') THEN 'unsupported_type'
   WHEN size_bytes > 5242880 THEN 'too_large'
   WHEN regexp_replace(coalesce(content, ''), '^[ \\t\\n\\r\\x0b\\x0c]+|[ \\t\\n\\r\\x0b\\x0c]+$', '', 'g') = '' THEN 'empty' END AS reject_reason FROM e)
SELECT upload_id, safe_name, ext, reject_reason IS NULL AS valid, reject_reason FROM v"""


# ---------------------------------------------------------------- splitter
def chunks_sql(text: str, separators=("\n\n", "\n", " ", ""), size: int = 512, overlap: int = 64, level: int = 0) -> str:
    """The list of chunks of a text: the same fold, by list functions."""
    a, b = f"a{level}", f"b{level}"
    sep, later = separators[0], separators[1:]
    lit = "'" + sep + "'" if "\n" not in sep else " || ".join(["chr(10)"] * len(sep))
    pieces = (f"list_filter(list_transform(string_split({text}, {lit}), lambda p, i: CASE WHEN i > 1 THEN {lit} || p ELSE p END), lambda p: p <> '')"
              if sep else f"string_split({text}, '')")
    state = "{{'chunks': {0}, 'win': {1}, 'len': {2}, 'p': {3}}}".format
    joined = strip_sql(f"array_to_string({a}.win, '')")
    closed = f"CASE WHEN {joined} <> '' THEN list_append({a}.chunks, {joined}) ELSE {a}.chunks END"
    n = f"length({b}.p)"
    first = f"(list_filter(range(1, len({a}.win) + 2), lambda i: coalesce(list_sum(list_transform({a}.win[i:], lambda w: length(w))), 0) <= least({overlap}, {size} - {n}))[1])"
    tail = f"{a}.win[{first}:]"
    deeper = chunks_sql(f"{b}.p", later, size, overlap, level + 1) if later else f"[{b}.p]"
    none = "[]::VARCHAR[]"
    step = f"""CASE WHEN {n} >= {size} THEN {state(f'list_concat({closed}, {deeper})', none, '0::BIGINT', "''")}
        WHEN len({a}.win) = 0 OR {a}.len + {n} <= {size} THEN {state(f'{a}.chunks', f'list_append({a}.win, {b}.p)', f'({a}.len + {n})::BIGINT', "''")}
        ELSE {state(closed, f'list_append({tail}, {b}.p)', f'(coalesce(list_sum(list_transform({tail}, lambda w: length(w))), 0) + {n})::BIGINT', "''")} END"""
    folded = f"list_reduce(list_prepend({state(none, none, '0::BIGINT', chr(39) * 2)}, list_transform({pieces}, lambda p: {state(none, none, '0::BIGINT', 'p')})), lambda {a}, {b}: {step})"
    end = f"list_transform([{folded}], lambda {a}: {closed})[1]"
    return f"CASE WHEN contains({text}, {lit}) THEN {end} ELSE {chunks_sql(text, later, size, overlap, level)} END" if later else end


CHUNKS_V = f"""SELECT domain, source, doc_id, unnest(range(0, len(c))) AS chunk_no, unnest(c) AS content FROM (
  SELECT lang AS domain, source, doc_id, CASE WHEN t <> '' THEN {chunks_sql('t')} END AS c FROM (SELECT lang, source, doc_id, {redact_sql('text')} AS t FROM documents))"""

ORACLE["chunk_documents"] = f"""SELECT domain, source, doc_id, chunk_no, doc_id * 1000000 + chunk_no AS chunk_id, CAST(length(content) AS BIGINT) AS n_chars, content FROM ({CHUNKS_V})"""

ORACLE["corpus_stats"] = f"""WITH ch AS MATERIALIZED ({CHUNKS_V}),
tk AS (SELECT domain, doc_id, chunk_no, {tok('content')} AS toks FROM ch),
v AS (SELECT domain, count(DISTINCT term) AS vocab_terms FROM (SELECT domain, unnest(toks) AS term FROM tk) GROUP BY domain),
a AS (SELECT domain, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avgdl FROM tk GROUP BY domain),
c AS (SELECT domain, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, CAST(max(length(content)) AS BIGINT) AS max_chunk_chars, round(avg(length(content)), 6) AS avg_chunk_chars FROM ch GROUP BY domain)
SELECT c.*, vocab_terms, round(avgdl, 6) AS avgdl FROM c LEFT JOIN v USING (domain) LEFT JOIN a USING (domain)"""

# ---------------------------------------------------------------- answers / requests
from ..functions import prompts as _PR  # noqa: E402
from ..config import LLM_FAILURE_TEXT  # noqa: E402


def hybrid_ctes_for(corpus_sql: str) -> str:
    """The hybrid chain over another corpus (the corpus CTE is shared)."""
    return (BM25_TOPK_CTES.replace(f"corpus AS ({CORPUS_V})", f"corpus AS ({corpus_sql})") + "," + VEC_CTES + ","
            + NORM_CTES + "," + FUSE_CTES.replace(f"JOIN ({CORPUS_V}) c", "JOIN corpus c"))


def expand_sql(seeds: str) -> str:
    return f"""
seed_rows AS (SELECT s.query_id, s.domain, s.rank, s.chunk_id, n.source, n.fp80 FROM {seeds} s JOIN nodes n USING (domain, chunk_id)),
seed_fps AS (SELECT DISTINCT query_id, domain, fp80 FROM seed_rows),
start AS (SELECT DISTINCT f.query_id, f.domain, n.chunk_id FROM seed_fps f JOIN nodes n USING (domain, fp80)),
succ AS (SELECT s.query_id, s.domain, w.chunk_id FROM start s JOIN refs r USING (domain, chunk_id)
         JOIN words w ON w.domain = r.domain AND w.word = r.word),
pred AS (SELECT s.query_id, s.domain, r.chunk_id FROM start s JOIN words w USING (domain, chunk_id)
         JOIN refs r ON r.domain = w.domain AND r.word = w.word),
nxt AS (SELECT * FROM succ UNION SELECT * FROM pred EXCEPT SELECT * FROM start),
added AS (SELECT a.query_id, a.domain, a.chunk_id, n.source, n.fp80 FROM nxt a JOIN nodes n USING (domain, chunk_id)
          ANTI JOIN seed_fps f USING (query_id, domain, fp80)),
added1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain, fp80 ORDER BY chunk_id) AS r FROM added) WHERE r = 1),
nseeds AS (SELECT query_id, domain, count(*) AS n FROM seed_rows GROUP BY query_id, domain),
expanded AS (SELECT query_id, domain, CAST(rank AS BIGINT) AS pos, chunk_id, source, true AS seed FROM seed_rows
  UNION ALL
  SELECT a.query_id, a.domain, CAST(s.n + row_number() OVER (PARTITION BY a.query_id, a.domain ORDER BY a.chunk_id) AS BIGINT),
    a.chunk_id, a.source, false FROM added1 a JOIN nseeds s USING (query_id, domain))
"""


def _lit(s: str) -> str:
    return "'" + _sq(s) + "'"


ANSWERS_CTES = f"""{hybrid_ctes_for(POLICY_V)}, {GRAPH_CTES}, {expand_sql('hybrid')}, {PARSE_ROUTER_CTES}, {ANSWER_CTES},
doms AS (SELECT * FROM (VALUES {_dom_rows}) d(agent, system_prompt, disclaimer)),
reqs AS (SELECT q.query_id, q.domain, q.query, r.category, r.confidence AS router_confidence,
   CASE WHEN r.category IN ('billing', 'returns', 'escalation') THEN r.category ELSE 'escalation' END AS agent
   FROM queries q JOIN routed r ON r.event_id = q.query_id),
ctx0 AS (SELECT e.query_id, e.pos, e.source, c.content FROM expanded e JOIN corpus c USING (domain, chunk_id) WHERE e.pos <= 5),
ctx1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM ctx0),
ctx AS (SELECT query_id, string_agg('[' || CAST(i AS VARCHAR) || '] (Source: ' || coalesce(source, 'unknown') || ')' || chr(10) || content,
   chr(10) || chr(10) ORDER BY i) AS context FROM ctx1 WHERE i <= 5 GROUP BY query_id),
s1 AS (SELECT query_id, coalesce(source, 'unknown') AS src, min(pos) AS p FROM expanded GROUP BY query_id, coalesce(source, 'unknown')),
srcs AS (SELECT query_id, list(src ORDER BY p) AS sources FROM s1 GROUP BY query_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
hist AS (SELECT conv_id AS query_id, string_agg({_line.format(c='text')}, chr(10) ORDER BY turn) AS history_text
   FROM hr WHERE rn <= 20 GROUP BY conv_id),
rsq AS (SELECT query_id, n_hits, retrieval_score FROM rscore_p),
ans0 AS (SELECT r.*, d.system_prompt, d.disclaimer, coalesce(h.history_text, '') AS history_text,
   coalesce(c.context, '') AS context, coalesce(s.sources, []::VARCHAR[]) AS sources,
   coalesce(x.retrieval_score, 0.0::DOUBLE) AS retrieval_score
   FROM reqs r LEFT JOIN doms d USING (agent) LEFT JOIN hist h USING (query_id) LEFT JOIN ctx c USING (query_id)
   LEFT JOIN srcs s USING (query_id) LEFT JOIN rsq x USING (query_id)),
ans1 AS (SELECT a.*, system_prompt || chr(10)
     || (CASE WHEN history_text <> '' THEN chr(10) || 'Conversation History:' || chr(10) || history_text || chr(10) ELSE '' END)
     || chr(10) || {_lit(_PR.ANSWER_RULES)} || 'Documents:' || chr(10) || context || chr(10) || chr(10)
     || 'Customer Query: ' || query || chr(10) || chr(10) || {_lit(_PR.ANSWER_FORMAT)} AS prompt,
   coalesce(p.answer, {_lit(LLM_FAILURE_TEXT)}) AS answer, coalesce(p.rating_text, '') AS rating_text, rt.rating
   FROM ans0 a LEFT JOIN pa p ON p.doc_id = a.query_id LEFT JOIN rating rt ON rt.doc_id = a.query_id),
ans2 AS (SELECT *, CASE WHEN rating_text = '' THEN 0.5::DOUBLE ELSE rating END AS llm_score FROM ans1),
answers AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.3::DOUBLE * router_confidence
   + 0.4::DOUBLE * retrieval_score + 0.3::DOUBLE * llm_score)), 4) AS confidence FROM ans2)
"""
ANSWERS_CTES = ANSWERS_CTES.replace("rsq AS (SELECT query_id, n_hits, retrieval_score FROM rscore_p),", """rs_agg AS (SELECT query_id, domain, count(*) AS n_hits, sum(score * (1.0::DOUBLE / rank)) / sum(1.0::DOUBLE / rank) AS rs
   FROM hybrid GROUP BY query_id, domain),
rsq AS (SELECT query_id, rs AS retrieval_score FROM rs_agg),""")

ORACLE["answers"] = f"""WITH {ANSWERS_CTES}
SELECT query_id, domain, agent, md5(answer) AS answer_md5, confidence, confidence < 0.65::DOUBLE AS low_confidence, sources, disclaimer
FROM answers"""

ORACLE["build_prompts"] = f"WITH {ANSWERS_CTES} SELECT query_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len FROM answers"
ORACLE["context_blocks"] = f"WITH {ANSWERS_CTES} SELECT query_id, md5(context) AS context_md5, CAST(length(context) AS BIGINT) AS context_len FROM answers"
ORACLE["answer_sources"] = f"WITH {ANSWERS_CTES} SELECT query_id, sources FROM answers"
ORACLE["rating_prompts"] = f"""WITH {ANSWERS_CTES}
SELECT query_id, md5({_lit(_PR.ROUTER_PROMPT_HEAD)} || query) AS router_prompt_md5,
  md5({_lit(_PR.RATING_PROMPT_HEAD)} || substring(context, 1, 800) || chr(10) || chr(10) || 'Answer:' || chr(10)
      || substring(answer, 1, 400) || {_lit(_PR.RATING_PROMPT_TAIL)}) AS rating_prompt_md5
FROM answers"""
SERVICE_REQUESTS_V = f"""SELECT query_id, domain, TIMESTAMP '2024-01-30 12:00:00' + to_seconds(query_id) AS ts,
  CASE WHEN query_id % 9 = 4 THEN '' ELSE 'session-' || CAST(query_id % 7 AS VARCHAR) END AS session_id,
  CASE WHEN query_id % 14 = 6 THEN '' ELSE query || (CASE WHEN query_id % 4 = 1 THEN ' Write to user' || CAST(query_id AS VARCHAR) || '@example.com please.' ELSE '' END) END AS query,
  query_id * 37 % 2000 AS latency_ms FROM ({QUERY_V})"""
# the flow up to the cache, then the answers of the misses only
REQUEST_CTES = f"""
sreq AS ({SERVICE_REQUESTS_V}),
schk AS (SELECT *, CASE WHEN length(session_id) < 1 THEN 'session_id_too_short' WHEN length(session_id) > 128 THEN 'session_id_too_long'
   WHEN length(query) < 1 THEN 'query_too_short' WHEN length(query) > 2000 THEN 'query_too_long' END AS reject_reason FROM sreq),
{PARSE_ROUTER_CTES},
sroute AS (SELECT s.query_id, s.domain, s.ts, s.session_id, {redact_sql('s.query')} AS query, s.latency_ms,
   coalesce(r.category, 'escalation') AS category, coalesce(r.confidence, 0.5::DOUBLE) AS router_confidence
   FROM schk s LEFT JOIN routed r ON r.event_id = s.query_id AND r.event_id % 10 <> 3 WHERE reject_reason IS NULL),
centry AS (SELECT d.domain, text AS query, item_id, CASE WHEN item_id % 6 = 0 THEN TIMESTAMP '2024-01-30 11:50:00' ELSE TIMESTAMP '2024-01-30 09:00:00' END AS stored_at
   FROM benchmark, (SELECT unnest(['billing', 'returns', 'escalation']) AS domain) d WHERE item_id % 3 = 0),
shit AS (SELECT s.*, 'cached answer ' || CAST(c.item_id AS VARCHAR) AS answer, s.category AS agent, ['documents/' || s.category || '.txt'] AS sources,
   CASE WHEN c.item_id % 12 <> 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM sroute s JOIN centry c
   ON c.domain = s.category AND c.query = s.query AND c.stored_at < s.ts AND s.ts < c.stored_at + INTERVAL 3600 SECOND),
smiss AS (SELECT * FROM sroute ANTI JOIN shit USING (query_id))"""
_miss_v = "SELECT query_id, domain, query FROM smiss"
MISS_CTES = REQUEST_CTES + "," + (ANSWERS_CTES.replace(QUERY_V, _miss_v).replace(f"{PARSE_ROUTER_CTES},", "")
    .replace("""reqs AS (SELECT q.query_id, q.domain, q.query, r.category, r.confidence AS router_confidence,
   CASE WHEN r.category IN ('billing', 'returns', 'escalation') THEN r.category ELSE 'escalation' END AS agent
   FROM queries q JOIN routed r ON r.event_id = q.query_id)""", "reqs AS (SELECT query_id, domain, query, category, router_confidence, category AS agent FROM smiss)"))

ORACLE["request_audit"] = f"""WITH {MISS_CTES}
SELECT CAST(query_id AS VARCHAR) AS audit_id, ts AS "timestamp", session_id, query AS redacted_query, category AS routed_to, round(router_confidence, 4) AS router_confidence,
  sources AS retrieved_sources, round(confidence, 4) AS final_confidence, false AS low_confidence_flag, latency_ms AS response_latency_ms, true AS cache_hit FROM shit
UNION ALL
SELECT CAST(a.query_id AS VARCHAR), m.ts, m.session_id, m.query, m.category, round(m.router_confidence, 4), a.sources, round(a.confidence, 4),
  a.confidence < 0.65::DOUBLE, m.latency_ms, false FROM answers a JOIN smiss m USING (query_id)"""

ORACLE["request_effects"] = f"""WITH {MISS_CTES}
SELECT 'turn' AS kind, query_id, session_id AS place, '0 user' AS what, md5(query) AS content_md5 FROM smiss
UNION ALL SELECT 'turn', a.query_id, m.session_id, '1 assistant', md5(a.answer) FROM answers a JOIN smiss m USING (query_id)
UNION ALL SELECT 'cache', NULL, m.category, md5(m.category || ':' || m.query), md5(a.answer) FROM answers a JOIN smiss m USING (query_id)
UNION ALL SELECT 'reject', query_id, '', reject_reason, '' FROM schk WHERE reject_reason IS NOT NULL"""

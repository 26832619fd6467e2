"""Registered queries of the training-data operators, with production
parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, html_extract, line_dedup, merkle, quality, sentence_pieces, sharding, token_files, toxicity
from .common import shared_path, stored, table
from .ngram_join import similar_components
from .packing import pack, token_pieces
from .pseudonyms import pseudonymise
from .quality import assess
from .sharding import place
from .tokens import public_path

#: Key of the pseudonyms in the registered queries; a real job passes its own.
PSEUDONYM_KEY = "registered-queries"
#: From this probability on a document counts as toxic.
TOXIC = 0.5
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(token_pieces(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")), "pieces")
    return pack(pieces, 4096)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select(
        "doc_id", "p_disruptive", "p_toxic", "p_severe", (F.col("p_toxic") >= TOXIC).alias("toxic"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PSEUDONYM_KEY, count_col="n_replaced")


def op4_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_path("piece_bpe_32k.model")
    return sentence_pieces.digest(sentence_pieces.encode(table(spark, sf_dir, "documents"), model), model)


def op5_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))
    return place(docs, "doc_id", SHARDS)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op8_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-planes")
    manifest = token_files.write_files(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return token_files.read_files(manifest, path)


def op9_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op10_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_check(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digest(docs, line_dedup.keep_bitmaps(docs))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
    "op4_piece_scan": op4_piece_scan,
    "op5_lookup_sharding": op5_lookup_sharding,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_line_quality": op7_line_quality,
    "op8_plane_files": op8_plane_files,
    "op9_minimum_cut": op9_minimum_cut,
    "op10_dimension_scan": op10_dimension_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}


def _sharding_sql() -> str:
    slots = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""
        WITH t AS (SELECT string_split('{slots}', ',') AS shard_of),
        d AS (SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars,
                     CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
        SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(t.shard_of[slot + 1], 3, '0') AS shard FROM d, t"""


def _quality_sql() -> str:
    p = quality.PARAMS
    words = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    phrases = " OR ".join(f"contains(lower(line), '{x}')" for x in quality.BOILERPLATE)
    count = "(length(line) - length(regexp_replace(line, '{}', '', 'g')))"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words.format("coalesce(text, '')")} AS w FROM documents),
        word AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM word) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        line AS (SELECT doc_id, line, lw, len(lw) AS n FROM (SELECT doc_id, line, {words.format("line")} AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(lw) > 0),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM line GROUP BY doc_id),
        good AS (SELECT doc_id, sum(n) AS n FROM (SELECT DISTINCT doc_id, line, lw, n FROM line) WHERE NOT (
            {count.format('[#*$%&|<>]')} > n * {p['symbol_rate']}
            OR (len(list_filter(lw, lambda x: x = '|')) >= {p['nav_bars']} AND len(list_filter(lw, lambda x: x = '|')) * {p['nav_words']} >= n)
            OR ({count.format('[A-Z]')} >= {p['shout_letters']} AND {count.format('[A-Z]')} > 2 * {count.format('[a-z]')})
            OR (n >= {p['stammer_words']} AND 4 * len(list_distinct(lw)) < n)
            OR (n <= {p['boiler_words']} AND ({phrases}))
            OR (n >= {p['open_words']} AND NOT regexp_matches(line, '{quality.SENTENCE_MARKS}'))) GROUP BY doc_id),
        s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(good.n, 0) AS BIGINT) AS n_kept_words
              FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN good USING (doc_id))
        SELECT *, n_words < {p['min_words']} OR 100 * n_repeat_words > {p['max_repeat_pct']} * n_words AS base_failed,
               NOT (n_words < {p['min_words']} OR 100 * n_repeat_words > {p['max_repeat_pct']} * n_words) AND n_kept_words >= {1 - p['max_lost']} * n_words AS kept
        FROM s"""


def _divergence_sql() -> str:
    share = f"1 + ({divergence.SCALE}::HUGEINT * ({{}} + {divergence.SMOOTH})) // ({{}} + {divergence.SMOOTH} * terms)"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.MIN_DOCS}),
        cell AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN cell USING (lang, source) GROUP BY ALL),
        l AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY ALL),
        p AS (SELECT gt.lang, gt.source, kept.term, coalesce(cell.n, 0) AS n, {share.format("coalesce(cell.n, 0)", "gt.total")} AS p, {share.format("kept.n", "l.total")} AS q
              FROM gt JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN cell ON cell.lang = gt.lang AND cell.source = gt.source AND cell.term = kept.term),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
        every AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""


def _merkle_sql(levels: int = 14) -> str:
    """For up to 3 ** ``levels`` documents of a source and as many sources."""
    field = lambda c, e=None: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({e or c}::VARCHAR)) || ':' || {e or c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else None) for c in merkle.FIELDS) + ")"
    ctes = [f"""
        step AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b::BIGINT)) AS t),
        crc AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), step),
        d AS (SELECT documents.doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf,
                     CASE WHEN crc % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS given FROM documents LEFT JOIN crc USING (doc_id)),
        l0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, doc_id, leaf, given FROM d),
        f0 AS (SELECT tree, pos, n, doc_id, leaf, given AS folded, '' AS path FROM l0),
        n0 AS (SELECT tree, pos, n, leaf AS digest FROM l0)"""]

    def climb(n, f, name):
        for k in range(levels):
            ctes.append(f"""
        r{name}{k} AS MATERIALIZED (SELECT tree, pos // 3 AS run, any_value(n) AS n, list(digest ORDER BY pos) AS ds FROM {n} GROUP BY ALL),
        n{name}{k + 1} AS (SELECT tree, run AS pos, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM r{name}{k}),
        f{name}{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.pos // 3 AS pos, (f.n + 2) // 3 AS n,
            CASE WHEN f.n = 1 THEN folded ELSE sha256(array_to_string(ds[1:f.pos % 3] || [folded] || ds[f.pos % 3 + 2:], '')) END AS folded,
            path || array_to_string(ds[1:f.pos % 3] || ds[f.pos % 3 + 2:], '') AS path) FROM {f} f JOIN r{name}{k} r ON f.tree = r.tree AND f.pos // 3 = r.run)""")
            n, f = f"n{name}{k + 1}", f"f{name}{k + 1}"
        return n, f

    n, f = climb("n0", "f0", "")
    ctes.append(f"""
        s AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, digest FROM {n}),
        g AS (SELECT 0 AS tree, f.tree AS pos, s.n, f.doc_id, f.leaf, f.folded, f.path, s.digest AS subroot FROM {f} f JOIN s ON s.pos = f.tree)""")
    n, f = climb("s", "g", "t")
    return "WITH " + ",".join(ctes) + f"""
        SELECT doc_id, leaf, subroot, {n}.digest AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = {n}.digest AS verified FROM {f}, {n}"""


_LINE_DEDUP_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    line AS (SELECT row, doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
             FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM d)),
    often AS (SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= {line_dedup.MIN_CHARS}
              GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= {line_dedup.MIN_DOCS}),
    marked AS (SELECT row, line.doc_id, pos, line, often.key IS NOT NULL AND line.doc_id IS DISTINCT FROM keeper AS gone FROM line LEFT JOIN often USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY row"""


ORACLE: dict[str, str] = {
    "op5_lookup_sharding": _sharding_sql(),
    "op7_line_quality": _quality_sql(),
    "op11_source_divergence": _divergence_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op13_line_dedup": _LINE_DEDUP_SQL,
}

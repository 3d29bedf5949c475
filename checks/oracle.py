"""The same results in plain SQL, written independently of the Spark plans."""

from __future__ import annotations

from attestra.domain import (
    DEFAULT_EMBEDDING_MODEL,
    DEFAULT_PROMPT,
    EXTRACTIVE_PROFILE,
    MESSAGE_ANSWERED,
    MESSAGE_REFUSED,
)
from attestra.functions import redaction
from attestra.functions.text import (
    ASTRAL_COMPLEMENT,
    HIDDEN_TEXT_PATTERN,
    NON_WHITESPACE,
    SCANNED_PDF_PATTERN,
    TERM_SEPARATOR,
    WHITESPACE,
    WHITESPACE_CHARS,
)
from attestra.operators import replay as replay_texts
from checks.constants import (
    ALLOWED_HOSTS,
    ENTRY_TYPES,
    SERVED_DIMENSION,
    SINCE,
    SNAPSHOT_HASH,
    SNAPSHOT_ID,
    UNTIL,
)

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def terms(x: str, fold: bool = True) -> str:
    text = f"lower({x})"
    if fold:
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
            text = f"replace({text}, '{a}', '{b}')"
    return (
        f"list_filter(regexp_split_to_array({text}, {quoted(TERM_SEPARATOR)}), "
        "lambda t: length(t) > 1 OR strlen(t) > 3)"
    )


def trim(x: str) -> str:
    return f"trim({x}, {quoted(WHITESPACE_CHARS)})"


def normalized(x: str) -> str:
    return trim(f"replace(replace({x}, chr(0), ''), chr(13) || chr(10), chr(10))")


def utf16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, {quoted(ASTRAL_COMPLEMENT)}, '', 'g')))"


def stable(prefix: str, *parts: str) -> str:
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"'{prefix}_' || substr(sha256(concat_ws(chr(0), {joined})), 1, 24)"


REV = f"""rev AS (
  SELECT doc_id, lang, source || '/' || doc_id AS source_path, sha256(text) AS content_sha256,
    text AS raw, {normalized('text')} AS text FROM documents)"""

TOK = f"""tok AS (
  SELECT *, list_filter(regexp_split_to_array(text, {quoted(WHITESPACE + '+')}), lambda t: t <> '')
    AS tokens FROM rev)"""

WIN = """win AS (
  SELECT *, i * 700 AS token_start, least(i * 700 + 800, len(tokens)) AS token_end,
    array_to_string(tokens[i * 700 + 1 : i * 700 + 800], ' ') AS chunk_text
  FROM (SELECT *, unnest(generate_series(0, ceil(greatest(len(tokens) - 800, 0) / 700.0)::INT)) AS i
        FROM tok WHERE len(tokens) > 0))"""

CHUNKS = f"""chunks AS (
  SELECT source_path, i AS chunk_index, chunk_text,
    {stable('chunk', quoted(SNAPSHOT_ID), 'source_path', 'i', 'sha256(chunk_text)')} AS chunk_id
  FROM win)"""

QUESTIONS = "asked AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"

CORPUS = ",\n".join((REV, TOK, WIN, CHUNKS, QUESTIONS))

TERMS = f"""cterm AS (
  SELECT chunk_id, list_distinct({terms('chunk_text')}) AS ts FROM chunks),
posting AS (SELECT chunk_id, len(ts) AS n_terms, unnest(ts) AS term FROM cterm),
freq AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
total AS (SELECT count(*) AS n FROM chunks),
qterm AS (SELECT query_id, unnest(list_distinct({terms('query_text')})) AS term FROM asked),
qweight AS (
  SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w
  FROM qterm LEFT JOIN freq USING (term), total),
qtotal AS (SELECT query_id, sum(w) AS qw FROM qweight GROUP BY query_id),
matched AS (
  SELECT query_id, chunk_id, any_value(n_terms) AS n_terms, sum(w) AS m
  FROM posting JOIN qweight USING (term) GROUP BY query_id, chunk_id),
based AS (
  SELECT query_id, chunk_id, m / qw AS base, least(0.2, m / greatest(10, n_terms)) AS density
  FROM matched JOIN qtotal USING (query_id)),
scored AS (
  SELECT query_id, chunk_id, round(least(1.0, base), 6) AS coverage,
    round(least(1.0, base + base * density), 6) AS evidence FROM based),
everything AS (
  SELECT a.query_id, c.chunk_id, coalesce(coverage, 0.0) AS coverage,
    coalesce(evidence, 0.0) AS evidence
  FROM asked a CROSS JOIN chunks c LEFT JOIN scored s
    ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id)"""

BM25 = """bm AS (
  SELECT query_id, 'bm25' AS method, chunk_id, evidence AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, chunk_id) AS rank
  FROM everything QUALIFY rank <= 50)"""
LEXICAL_DENSE = """dn AS (
  SELECT query_id, 'dense' AS method, chunk_id, coverage AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, chunk_id) AS rank
  FROM everything QUALIFY rank <= 50)"""
FUSION = """cand AS (SELECT * FROM dn UNION ALL SELECT * FROM bm),
merged AS (
  SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score,
    coalesce(max(score) FILTER (method = 'bm25'), 0.0) AS evidence
  FROM cand GROUP BY query_id, chunk_id),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM merged),
cited AS (
  SELECT query_id, chunk_id, score, evidence,
    row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
  FROM fused WHERE evidence >= 0.3 QUALIFY
    row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8),
gate AS (
  SELECT query_id, greatest(max(score), 0.0) AS best_evidence,
    greatest(max(score), 0.0) < 0.3 AS out_of_corpus FROM bm GROUP BY query_id)"""

RETRIEVAL = ",\n".join((CORPUS, TERMS, BM25, LEXICAL_DENSE, FUSION))

# ---- text, hashes, redaction --------------------------------------------------------------------

ORACLES["text_terms"] = f"""
SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct,
  sha256(array_to_string(t, '|')) AS terms_sha256
FROM (SELECT doc_id, {terms('text')} AS t FROM documents)"""

ORACLES["normalized_text"] = f"""
SELECT doc_id, sha256(t) AS text_sha256, {utf16('t')} AS utf16_length
FROM (SELECT doc_id, {normalized('text')} AS t FROM documents)"""

ORACLES["extraction_flags"] = f"""
WITH src AS (
  SELECT source || '/' || doc_id AS source_path, text,
    CASE WHEN lang = 'de' THEN 'pdf' ELSE 'markdown' END AS source_type FROM documents
  UNION ALL SELECT 'page/' || page_id, html, 'markdown' FROM pages),
flag AS (
  SELECT source_path, source_type, regexp_matches(text, {quoted(HIDDEN_TEXT_PATTERN)}) AS hidden,
    source_type = 'pdf' AND regexp_matches(text, {quoted(SCANNED_PDF_PATTERN)}) AS ocr_used FROM src)
SELECT source_path, source_type, ocr_used,
  concat_ws(',', CASE WHEN hidden THEN 'hidden-text-warning' END,
            CASE WHEN ocr_used THEN 'ocr-used' END) AS warnings FROM flag"""

ORACLES["document_identity"] = f"""
WITH {REV} SELECT source_path, content_sha256, left(content_sha256, 12) AS short_hash,
  {stable('doc', 'source_path')} AS doc_key, {stable('src', 'source_path')} AS source_key FROM rev"""

_word = "regexp_replace(html, '<w:tab\\s*/>', chr(9), 'g')"
_word = f"replace({_word}, '</w:p>', chr(10))"
_word = f"regexp_replace({_word}, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _word = f"replace({_word}, '{_a}', '{_b}')"
ORACLES["word_xml_text"] = f"""
SELECT page_id, sha256(t) AS text_sha256, length(t) AS n_chars
FROM (SELECT page_id, {_word} AS t FROM pages)"""

_html = "regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g')"
_html = f"regexp_replace({_html}, '(?is)<style.*?</style>', ' ', 'g')"
_html = f"regexp_replace({_html}, '<[^>]+>', ' ', 'g')"


def numeric_entities(x: str, pattern: str, value: str) -> str:
    pieces = f"regexp_split_to_array({x}, {quoted(pattern)})"
    codes = f"regexp_extract_all({x}, {quoted(pattern)}, 1)"
    return (
        f"array_to_string(list_transform(list_zip({pieces}, {codes}), lambda p: p[1] || "
        f"CASE WHEN p[2] IS NULL OR p[2] = '' THEN '' ELSE chr({value}) END), '')"
    )


ORACLES["html_article"] = f"""
WITH plain AS (SELECT page_id, {_html} AS t FROM pages),
dec AS (SELECT page_id, {numeric_entities('t', '&#([0-9]+);', 'p[2]::INT')} AS t FROM plain),
hex AS (SELECT page_id,
  {numeric_entities('t', '&#[xX]([0-9a-fA-F]+);', "('0x' || p[2])::INT")} AS t FROM dec),
nam AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(t, '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'),
  '(?i)&apos;', '''', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g') AS t FROM hex),
vis AS (SELECT page_id, regexp_replace(t, {quoted(WHITESPACE + '+')}, ' ', 'g') AS v FROM nam),
pos AS (SELECT page_id, v, strpos(v, '&copy;') AS e,
  CASE WHEN regexp_matches(v, '\\S') THEN length(v) - length(ltrim(v, {quoted(WHITESPACE_CHARS)})) + 1
  ELSE 0 END AS s FROM vis),
cut AS (SELECT *, {trim('substr(v, s, greatest(e - s, 0))')} AS body FROM pos),
chk AS (SELECT *, CASE WHEN s <= 0 THEN 'start marker missing'
  WHEN e <= 0 OR e <= s THEN 'end marker missing'
  WHEN regexp_matches(body, '(?i)&[a-z]+;|&#[0-9]+;') THEN 'undecoded entity'
  WHEN body = '' THEN 'empty body' END AS problem FROM cut)
SELECT page_id, sha256(v) AS visible_sha256,
  CASE WHEN problem IS NULL THEN sha256(body) END AS body_sha256, problem FROM chk"""

ORACLES["secret_scan"] = f"""
SELECT origin, count(*) AS n_texts,
  count(*) FILTER (regexp_matches(text, {quoted(redaction.PROMPT_SECRET_PATTERN)})) AS n_secrets
FROM (SELECT 'documents' AS origin, text FROM documents
      UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY origin"""

_hosts = ", ".join(quoted(h) for h in ALLOWED_HOSTS)
ORACLES["egress_check"] = f"""
SELECT page_id, host, host IN ({_hosts}) AS allowed
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)"""

ORACLES["operational_log"] = """
SELECT event_id, sha256(user_id::VARCHAR) AS user_id_hash, event_id::VARCHAR AS query_id,
  trunc(value)::INT::VARCHAR AS latency_ms, event_type AS outcome,
  concat_ws('|', '[redacted]', event_id::VARCHAR, trunc(value)::INT::VARCHAR,
    sha256(user_id::VARCHAR), event_type, '[redacted]', '[redacted]') AS redacted FROM events"""

ORACLES["redact_nested"] = """
SELECT event_id, '{"query":"[redacted]","nested":{"db_credential":"[redacted]"},"items":'
  || '[{"password":"[redacted]","keep":' || replace(props, ' ', '') || '},7,["pii"]],"n":'
  || event_id || '}' AS redacted FROM events"""

ORACLES["canonical_properties"] = """
SELECT event_id, '{"a":' || event_id || ',"props":' || replace(props, ' ', '')
  || ',"z":[1.5,null,true]}' AS canonical FROM events"""

# ---- vectors ------------------------------------------------------------------------------------

ORACLES["vector_literals"] = """
SELECT vec_id, sha256('[' || array_to_string(
  list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']') AS literal_sha256
FROM embeddings"""

ORACLES["vector_validation"] = """
SELECT vec_id, CASE label WHEN 1 THEN 'all-zero' WHEN 2 THEN 'non-finite' WHEN 3 THEN 'dimension'
  END AS problem FROM embeddings"""

CENTROIDS = """cell AS (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
  FROM embeddings),
mean AS (SELECT label, i, round(avg(x), 6) AS x FROM cell GROUP BY label, i),
centroid AS (SELECT label, list(x ORDER BY i) AS c FROM mean GROUP BY label)"""

ORACLES["label_cosine"] = f"""
WITH {CENTROIDS} SELECT vec_id, label,
  round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS cosine
FROM embeddings JOIN centroid USING (label)"""

ORACLES["dense_top_k"] = f"""
WITH {CENTROIDS}, s AS (
  SELECT c.label AS query_id, vec_id AS id,
    round(list_cosine_similarity(embedding::DOUBLE[], c.c), 6) AS score
  FROM embeddings CROSS JOIN centroid c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
FROM s QUALIFY rank <= 50"""


def hash_cells(source: str, key: str, text: str, dimension: int, name: str) -> str:
    """Cell sums of the hash embedding of every row of a relation."""
    return f"""{name}_t AS (SELECT {key}, {terms(text, fold=False)} AS ts FROM {source}),
{name}_u AS (SELECT {key}, unnest(CASE WHEN len(ts) = 0 THEN [''] ELSE ts END) AS t FROM {name}_t),
{name}_n AS (SELECT {key}, t, count(*) AS k FROM {name}_u GROUP BY ALL),
{name}_h AS (SELECT t, sha256(t) AS h FROM (SELECT DISTINCT t FROM {name}_n)),
{name}_g AS (SELECT t, h, unnest(range(8)) AS g FROM {name}_h),
{name}_b AS (SELECT t, ('0x' || substr(h, g * 8 + 1, 4))::INT % {dimension} AS cell,
  (1 - 2 * (('0x' || substr(h, g * 8 + 5, 2))::INT % 2))
    * (10 + ('0x' || substr(h, g * 8 + 7, 2))::INT % 7) AS w FROM {name}_g),
{name}_s AS (SELECT {key}, cell, sum(k * w)::DOUBLE AS x
  FROM {name}_n JOIN {name}_b USING (t) GROUP BY {key}, cell),
{name}_m AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_s GROUP BY {key})"""


ORACLES["hash_embedding_cells"] = f"""
WITH {hash_cells('documents', 'doc_id', 'text', 16, 'e')},
grid AS (SELECT doc_id, unnest(range(16)) AS cell FROM documents)
SELECT doc_id, cell, round(CASE WHEN norm > 0 THEN coalesce(x, 0.0) / norm ELSE 0.0 END, 6) AS value
FROM grid LEFT JOIN e_s USING (doc_id, cell) LEFT JOIN e_m USING (doc_id)"""

ORACLES["index_size"] = f"""
WITH {CORPUS} SELECT count(*) AS chunk_count, count(*) * (1024 * 4 + 16 * 4) AS index_bytes
FROM chunks"""

ORACLES["embedding_cache_lookup"] = """
WITH cached AS (SELECT sha256(text) AS h, count(*) AS copies FROM documents GROUP BY 1),
want AS (SELECT doc_id, sha256(text) AS h FROM documents
  UNION ALL SELECT -item_id - 1, sha256(text) FROM benchmark)
SELECT doc_id, copies::VARCHAR AS copies, copies IS NULL AS miss FROM want LEFT JOIN cached USING (h)"""

# ---- corpus -------------------------------------------------------------------------------------

def snapshot_sql(kind: str, base: str) -> str:
    return f"""
WITH {CORPUS}, b AS ({base}), n AS (SELECT count(*) AS document_count FROM rev),
c AS (SELECT count(*) AS chunk_count FROM chunks)
SELECT {stable('snap', "'1'", 'base_hash')} AS id, 1 AS sequence,
  CASE WHEN chunk_count = 0 THEN base_hash ELSE sha256(base_hash || ':' || chunk_count) END
    AS snapshot_hash, base_hash, '{DEFAULT_EMBEDDING_MODEL}' AS embedding_model_version,
  'chunker-800-100-v1' AS chunker_version, 'active' AS status, document_count, chunk_count,
  '{kind}' AS digest_kind FROM b, n, c"""


def tree_sql(rows: str, key: str, digest: str) -> str:
    return f"""SELECT sha256(string_agg(leaf, '|' ORDER BY bucket)) AS base_hash FROM (
  SELECT substr(sha256({key}), 1, 4) AS bucket, sha256(string_agg({digest}, '|' ORDER BY {key})) AS leaf
  FROM {rows} GROUP BY 1)"""


ORACLES["corpus_snapshot"] = snapshot_sql("tree", tree_sql("rev", "source_path", "content_sha256"))
ORACLES["ingest_events"] = f"""
WITH snap AS ({ORACLES["corpus_snapshot"]})
SELECT 1 AS sequence, 'corpus.ingest.completed' AS entry_type,
  'corpus-ingest-completed' AS outcome, embedding_model_version, id AS corpus_snapshot_id,
  snapshot_hash AS corpus_snapshot_hash, sha256('system-ingest') AS user_id_hash,
  '{{"chunkCount":' || chunk_count || ',"documentCount":' || document_count || '}}' AS metadata,
  'not-applicable' AS model_version FROM snap"""
ORACLES["next_sequence"] = """
SELECT CAST(max(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 3 ELSE 2 END) + 1 AS INTEGER) AS next_sequence
FROM documents"""
# Only documents of the latest active snapshot are chunked, counted and ranked.
CURRENT = ",\n".join(
    (REV, TOK, WIN, CHUNKS.replace("FROM win", "FROM win WHERE lang NOT IN ('en', 'de')"), QUESTIONS)
)
ORACLES["active_snapshot_ranking"] = f"""
WITH {CURRENT}, {TERMS}, {BM25}, {LEXICAL_DENSE}
SELECT query_id, method, rank, chunk_id, score FROM dn
UNION ALL SELECT query_id, method, rank, chunk_id, score FROM bm"""
ORACLES["corpus_snapshot_flat"] = snapshot_sql(
    "flat", "SELECT sha256(string_agg(content_sha256, '|' ORDER BY source_path)) AS base_hash FROM rev"
)

OFFSETS = f"""gap AS (
  SELECT *, regexp_split_to_array(text, {quoted(NON_WHITESPACE + '+')}) AS gaps,
    strpos(text, chunk_text) AS found_at FROM win),
span AS (
  SELECT *, CASE WHEN found_at > 0 THEN {utf16('substr(text, 1, found_at - 1)')}
    ELSE {utf16("(array_to_string(gaps[1 : token_start + 1], '') || array_to_string(tokens[1 : token_start], ''))")}
    END AS char_start,
  CASE WHEN found_at > 0 THEN {utf16('substr(text, 1, found_at - 1 + length(chunk_text))')}
    ELSE {utf16("(array_to_string(gaps[1 : token_end], '') || array_to_string(tokens[1 : token_end], ''))")}
    END AS char_end FROM gap)"""

ORACLES["chunk_records"] = f"""
WITH {REV}, {TOK}, {WIN}, {OFFSETS}
SELECT {stable('chunk', quoted(SNAPSHOT_ID), 'source_path', 'i', 'sha256(chunk_text)')} AS chunk_id,
  {stable('doc', 'source_path')} AS doc_id, {stable('src', 'source_path')} AS source_document_id,
  'markdown' AS source_type, source_path, 1 AS page_start, 1 AS page_end, char_start, char_end,
  token_start, token_end, i AS chunk_index, sha256(chunk_text) AS chunk_sha256,
  '{SNAPSHOT_ID}' AS corpus_snapshot_id, '{SNAPSHOT_HASH}' AS corpus_snapshot_hash,
  CASE WHEN regexp_matches(raw, {quoted(HIDDEN_TEXT_PATTERN)}) THEN 'hidden-text-warning' ELSE '' END
    AS extraction_warnings, false AS ocr_used FROM span"""

STORED = """stored AS (
  SELECT source || '/' || doc_id AS source_path,
    sha256(CASE WHEN toxic = 1 THEN lower(text) ELSE text END) AS stored_sha256
  FROM documents JOIN labels USING (doc_id))"""

ORACLES["changed_documents"] = f"""
WITH {REV}, {STORED} SELECT source_path, content_sha256 FROM rev LEFT JOIN stored USING (source_path)
WHERE stored_sha256 IS DISTINCT FROM content_sha256"""


def _ingest(changed: str, extra: str) -> str:
    return f"""
WITH {CORPUS}{extra}, n AS (SELECT count(*) AS c FROM chunks),
f AS (SELECT count(*) AS d, count(*) FILTER ({changed}) AS ch,
  count(*) FILTER (regexp_matches(raw, {quoted(HIDDEN_TEXT_PATTERN)})) AS wn
  FROM rev {"LEFT JOIN stored USING (source_path)" if extra else ""})
SELECT false AS dry_run, d AS document_count, ch AS changed_document_count,
  CASE WHEN ch = 0 THEN 0 ELSE c END AS chunk_count,
  CASE WHEN ch = 0 THEN 0 ELSE c * 4160 END AS estimated_index_bytes, wn AS warning_count,
  ch > 0 AS activated, ch = 0 AS no_op FROM f, n"""


ORACLES["ingest_summary"] = _ingest("stored_sha256 IS DISTINCT FROM content_sha256", ", " + STORED)
ORACLES["ingest_no_op"] = _ingest("false", "")

MANIFEST = """e AS (SELECT source || '/' || doc_id AS chunk_id, '{"chunkId":'
  || to_json(source || '/' || doc_id)::VARCHAR || ',"textSha256":"' || sha256(text) || '"}' AS e
  FROM documents)"""
ORACLES["corpus_manifest_hash"] = f"""
WITH {MANIFEST}, h AS (SELECT chunk_id, sha256(e) AS d FROM e), t AS ({tree_sql("h", "chunk_id", "d")})
SELECT sha256('{{"chunkCount":' || (SELECT count(*) FROM e) || ',"chunks":"' || base_hash || '"}}')
  AS corpus_hash FROM t"""
ORACLES["corpus_manifest_hash_flat"] = f"""
WITH {MANIFEST}
SELECT sha256('{{"chunkCount":' || count(*) || ',"chunks":[' || string_agg(e, ',' ORDER BY e) || ']}}')
  AS corpus_hash FROM e"""

ORACLES["source_spans"] = f"""
WITH {REV}, {TOK}, {WIN}, {OFFSETS}
SELECT source_path, min(i) AS chunk_index FROM span WHERE char_start >= 2000 GROUP BY source_path"""

ORACLES["source_span_lookup"] = f"""
WITH r AS ({ORACLES["chunk_records"]}), d AS (SELECT source || '/' || doc_id AS source_path,
  unnest(generate_series(0, length({normalized('text')}), 1000)) AS "offset" FROM documents)
SELECT source_path, "offset"::INT AS "offset", chunk_id, chunk_index::VARCHAR AS chunk_index,
  char_start::VARCHAR AS char_start
FROM (SELECT d.source_path, "offset", r.chunk_id, r.chunk_index, r.char_start, row_number() OVER (
    PARTITION BY d.source_path, "offset" ORDER BY r.chunk_index) AS k
  FROM d LEFT JOIN r ON r.source_path = d.source_path AND r.char_start >= "offset") WHERE k = 1"""
ORACLES["pinned_sources"] = """
WITH f AS (SELECT page_id AS source_id, page_id % 6 <> 1 OR lower(html) = html AS same_text,
  starts_with(url, 'https://') AS secure_url, page_id % 5 <> 2 AS dated FROM pages)
SELECT *, same_text AND secure_url AND dated AS pinned FROM f"""
_AD = "'<!--\\s*ad ([0-9]+)\\s*-->'"
ORACLES["marked_chunks"] = f"""
WITH c AS (SELECT page_id, regexp_extract_all(html, {_AD}, 1) AS ids,
  regexp_split_to_array(html, {_AD})[2:] AS bodies FROM pages),
u AS (SELECT page_id, generate_subscripts(ids, 1) - 1 AS chunk_index, unnest(ids) AS chunk_id,
  unnest(bodies) AS body FROM c)
SELECT page_id::VARCHAR AS source_path, chunk_index, chunk_id, sha256({trim('body')}) AS text_sha256
FROM u"""

ORACLES["repeated_chunk_ids"] = """
SELECT sha256(l) AS chunk_id, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> ''
GROUP BY l HAVING count(*) > 1"""

# ---- ranking ------------------------------------------------------------------------------------

ORACLES["term_weights"] = f"""
WITH {CORPUS}, {TERMS} SELECT term, df, n AS n_chunks,
  round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM freq, total"""
ORACLES["lexical_candidates"] = f"""
WITH {RETRIEVAL} SELECT query_id, method, rank, chunk_id, score FROM cand"""
ORACLES["fused_ranking"] = f"""
WITH {RETRIEVAL} SELECT query_id, rank, chunk_id, score, evidence FROM fused"""
ORACLES["cited_evidence"] = f"""
WITH {RETRIEVAL} SELECT query_id, rank, chunk_id, score, evidence FROM cited"""
ORACLES["evidence_bars"] = f"""
WITH {RETRIEVAL} SELECT query_id, rank, chunk_id, least(100, greatest(10,
  ceil(score / max(score) OVER (PARTITION BY query_id) * 10)::INT * 10)) AS bar FROM cited"""
ORACLES["refusal_gate"] = f"""
WITH {RETRIEVAL} SELECT query_id, best_evidence, out_of_corpus FROM gate"""

HASH_DENSE = f"""{hash_cells('chunks', 'chunk_id', 'chunk_text', SERVED_DIMENSION, 'c')},
{hash_cells('asked', 'query_id', 'query_text', SERVED_DIMENSION, 'q')},
dots AS (
  SELECT query_id, chunk_id, sum(q_s.x * c_s.x) AS dot FROM q_s JOIN c_s USING (cell)
  GROUP BY query_id, chunk_id),
cosines AS (
  SELECT query_id, chunk_id, round(coalesce(dot, 0) / (q_m.norm * c_m.norm), 6) AS score
  FROM q_m CROSS JOIN c_m LEFT JOIN dots USING (query_id, chunk_id)),
hd AS (
  SELECT query_id, 'dense' AS method, chunk_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM cosines QUALIFY rank <= 50)"""

ORACLES["served_dense_ranking"] = f"""
WITH {CORPUS}, {HASH_DENSE} SELECT query_id, rank, chunk_id, score FROM hd"""

ORACLES["cached_dense_ranking"] = (
    "SELECT * FROM (" + ORACLES["served_dense_ranking"] + ") WHERE query_id % 2 = 0"
)
ORACLES["cache_misses"] = f"""
WITH {CORPUS} SELECT query_id, sha256(query_text) AS text_sha256 FROM asked
WHERE query_text NOT IN (SELECT chunk_text FROM chunks)
  AND query_text NOT IN (SELECT query_text FROM asked WHERE query_id % 2 = 0)"""
ORACLES["unusable_scores"] = """
WITH s AS (SELECT user_id AS query_id, event_type AS method, 'c' || lpad(event_id::VARCHAR, 8, '0') AS chunk_id,
  round(value, 6) AS score FROM events
  WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, chunk_id) AS rank FROM s),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM r GROUP BY ALL),
g AS (SELECT q.query_id, greatest(coalesce(max(score), 0.0), 0.0) AS best_evidence
  FROM (SELECT DISTINCT user_id AS query_id FROM events) q LEFT JOIN s USING (query_id) GROUP BY 1)
SELECT f.query_id, chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, chunk_id) AS rank,
  score, best_evidence, best_evidence < 0.3 AS out_of_corpus FROM f JOIN g USING (query_id)"""
ORACLES["semantic_retrieval"] = f"""
WITH {CORPUS}, {TERMS}, {BM25}, {HASH_DENSE},
top AS (SELECT query_id, method, chunk_id, score FROM hd),
everyone AS (
  SELECT a.query_id, c.chunk_id, coalesce(t.score, 0.0) AS score
  FROM asked a CROSS JOIN chunks c LEFT JOIN top t
    ON t.query_id = a.query_id AND t.chunk_id = c.chunk_id),
dn AS (
  SELECT query_id, 'dense' AS method, chunk_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM everyone QUALIFY rank <= 50),
{FUSION} SELECT query_id, rank, chunk_id, score, evidence FROM cited"""



def lexemes(x: str) -> str:
    split = f"regexp_split_to_array(lower({x}), {quoted(TERM_SEPARATOR)})"
    return f"list_filter({split}, lambda t: t <> '')"


COVERS = f"""seq AS (SELECT chunk_id, {lexemes('chunk_text')} AS s FROM chunks),
want AS (SELECT query_id, list_distinct({lexemes('query_text')}) AS w FROM asked),
pos AS (SELECT chunk_id, generate_subscripts(s, 1) AS p, unnest(s) AS t FROM seq),
qlex AS (SELECT query_id, len(w) AS n, unnest(w) AS t FROM want WHERE len(w) > 0),
hit AS (SELECT query_id, chunk_id, n, p, t FROM pos JOIN qlex USING (t)),
full_match AS (SELECT query_id, chunk_id FROM hit GROUP BY query_id, chunk_id
  HAVING count(DISTINCT t) = any_value(n)),
kept AS (SELECT hit.* FROM hit JOIN full_match USING (query_id, chunk_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p) AS k FROM kept),
latest AS (
  SELECT a.query_id, a.chunk_id, a.p, a.k, b.t, max(b.p) AS lp, max(b.k) AS lk, any_value(a.n) AS n
  FROM numbered a JOIN numbered b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.k <= a.k
  GROUP BY a.query_id, a.chunk_id, a.p, a.k, b.t),
ends AS (SELECT query_id, chunk_id, p, k, min(lp) AS lp, min(lk) AS lk FROM latest
  GROUP BY query_id, chunk_id, p, k HAVING count(*) = any_value(n)),
covers AS (SELECT query_id, chunk_id, lp, lk, min(p) AS p, min(k) AS k FROM ends
  GROUP BY query_id, chunk_id, lp, lk),
ranked_terms AS (SELECT query_id, chunk_id,
  round(sum(0.1 / (1 + (p - lp) - (k - lk))), 6) AS score FROM covers GROUP BY query_id, chunk_id),
served_all AS (
  SELECT a.query_id, c.chunk_id, coalesce(r.score, 0.0) AS score
  FROM asked a CROSS JOIN chunks c LEFT JOIN ranked_terms r
    ON r.query_id = a.query_id AND r.chunk_id = c.chunk_id),
tr AS (
  SELECT query_id, 'bm25' AS method, chunk_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM served_all QUALIFY rank <= 50)"""
ORACLES["supplied_scores"] = f"""
WITH {CORPUS}, {HASH_DENSE},
given AS (SELECT query_id, chunk_id, floor((score - 0.35) * 10) / 10 AS v FROM hd),
full_map AS (SELECT a.query_id, c.chunk_id, coalesce(round(v, 6), 0.0) AS score
  FROM asked a CROSS JOIN chunks c LEFT JOIN given g
    ON g.query_id = a.query_id AND g.chunk_id = c.chunk_id)
SELECT query_id, chunk_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM full_map QUALIFY rank <= 50"""

ORACLES["served_terms_ranking"] = f"""
WITH {CORPUS}, {COVERS} SELECT query_id, rank, chunk_id, score FROM tr"""

ORACLES["served_retrieval"] = f"""
WITH {CORPUS}, {HASH_DENSE}, {COVERS},
both_lists AS (SELECT * FROM hd UNION ALL SELECT * FROM tr),
opened AS (SELECT query_id FROM both_lists GROUP BY query_id HAVING max(score) >= 0.3),
merged AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score
  FROM both_lists GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM merged JOIN opened USING (query_id) QUALIFY rank <= 8"""

# ---- stored snapshots ---------------------------------------------------------------------------


def stored_corpus(sequence: int, where: str) -> str:
    """The chunks an ingest stores, with the ids of its own snapshot."""
    rev = REV.replace("FROM documents)", f"FROM documents WHERE {where})")
    base = tree_sql("rev", "source_path", "content_sha256")
    snap = stable("snap", quoted(str(sequence)), "base_hash")
    chunk = stable("chunk", "snap_id", "source_path", "i", "sha256(chunk_text)")
    return f"""{rev},
{TOK},
{WIN},
snap AS (SELECT {snap} AS snap_id, base_hash FROM ({base})),
chunks AS (SELECT source_path, i AS chunk_index, chunk_text, {chunk} AS chunk_id FROM win, snap),
{QUESTIONS}"""


NEWER, OLDER = stored_corpus(2, "true"), stored_corpus(1, "lang = 'en'")


def stored_listing(sequence: int, where: str) -> str:
    return f"""SELECT {sequence} AS sequence, * FROM (
  WITH {stored_corpus(sequence, where)} SELECT any_value(snap_id) AS id,
    sha256(any_value(base_hash) || ':' || count(*)) AS snapshot_hash, 'active' AS status,
    (SELECT count(*) FROM rev) AS document_count, count(*) AS chunk_count FROM chunks, snap)"""


ORACLES["stored_snapshots_listing"] = (
    stored_listing(1, "lang = 'en'") + " UNION ALL " + stored_listing(2, "true")
)
ORACLES["stored_retrieval"] = f"""
WITH {NEWER}, {TERMS}, {BM25}, {LEXICAL_DENSE}, {FUSION}
SELECT query_id, rank, chunk_id, score, evidence FROM cited"""
ORACLES["stored_older_retrieval"] = f"""
WITH {OLDER}, {TERMS}, {BM25}, {LEXICAL_DENSE}, {FUSION}
SELECT query_id, rank, chunk_id, score, evidence FROM cited"""
ORACLES["stored_served_retrieval"] = ORACLES["served_retrieval"].replace(CORPUS, NEWER)
ORACLES["stored_chunks"] = f"""
WITH {stored_corpus(2, 'true')}, r AS ({ORACLES["chunk_records"]}),
n AS (SELECT count(*) AS n FROM chunks)
SELECT c.chunk_id, source_path, chunk_index, char_start, char_end, chunk_sha256,
  snap_id AS corpus_snapshot_id, sha256(base_hash || ':' || n) AS corpus_snapshot_hash
FROM chunks c JOIN r USING (source_path, chunk_index), snap, n"""

# ---- answers ------------------------------------------------------------------------------------

ANSWERS = f"""evid AS (
  SELECT query_id, rank, c.chunk_id, chunk_text FROM cited JOIN chunks c USING (chunk_id)),
sent AS (
  SELECT query_id, rank, chunk_id, generate_subscripts(ss, 1) AS sr, unnest(ss) AS sentence FROM (
    SELECT query_id, rank, chunk_id, list_filter(string_split(regexp_replace({trim(
      "regexp_replace(chunk_text, " + quoted(WHITESPACE + '+') + ", ' ', 'g')")},
      '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM evid)),
qseq AS (SELECT query_id, {terms("string_split(query_text, chr(10) || chr(10))[1]")} AS q FROM asked),
sscore AS (
  SELECT query_id, rank, chunk_id, sr, sentence, CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0.0
    ELSE round(len(list_filter(q, lambda t: list_contains(w, t))) / len(q), 6) END AS s
  FROM (SELECT *, {terms('sentence')} AS w FROM sent) JOIN qseq USING (query_id)),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank, sr) AS cr FROM sscore
  QUALIFY cr <= 3 AND (s > 0 OR cr = 1)),
ans AS (
  SELECT query_id, string_agg('CLAIM: ' || sentence || ' [chunk:' || chunk_id || ']', chr(10)
    ORDER BY cr) AS answer, count(*) AS n_claims FROM picked GROUP BY query_id)"""

ORACLES["cited_answers"] = f"""
WITH {RETRIEVAL}, {ANSWERS}
SELECT query_id, CASE WHEN out_of_corpus THEN 'refused-out-of-corpus' ELSE 'answered' END AS outcome,
  answer, sha256(answer) AS answer_hash, coalesce(n_claims, 0) AS n_claims, 0 AS n_errors,
  '{EXTRACTIVE_PROFILE.model_version}' AS model_version, '1.0.0' AS prompt_version, 42 AS seed,
  '{EXTRACTIVE_PROFILE.id}' AS provider_profile_id,
  sha256('{DEFAULT_PROMPT.id}:1.0.0') AS prompt_hash,
  CASE WHEN out_of_corpus THEN '{MESSAGE_REFUSED}' ELSE '{MESSAGE_ANSWERED}' END AS operator_message
FROM gate LEFT JOIN ans USING (query_id)"""

ORACLES["echo_answers"] = f"""
WITH {RETRIEVAL}
SELECT query_id, CASE WHEN out_of_corpus THEN 'refused-out-of-corpus' ELSE 'answered' END AS outcome,
  CASE WHEN NOT out_of_corpus THEN 'CLAIM: Die Antwort ist durch den Korpus belegt. [chunk:'
    || chunk_id || ']' END AS answer
FROM gate LEFT JOIN (SELECT * FROM cited WHERE rank = 1) USING (query_id)"""

ORACLES["blocked_answers"] = f"""
WITH {RETRIEVAL}
SELECT query_id, CASE WHEN out_of_corpus THEN 'refused-out-of-corpus' WHEN query_id % 2 = 0
    THEN 'answered' ELSE 'blocked-uncited' END AS outcome,
  CASE WHEN NOT out_of_corpus AND query_id % 2 = 0
    THEN 'CLAIM: Die Antwort ist durch den Korpus belegt. [chunk:' || chunk_id || ']' END AS answer,
  CASE WHEN NOT out_of_corpus AND query_id % 2 = 1 THEN 'missing_citation' ELSE '' END AS errors,
  CASE WHEN NOT out_of_corpus AND query_id % 2 = 0 THEN 1 ELSE 0 END AS n_claims
FROM gate LEFT JOIN (SELECT * FROM cited WHERE rank = 1) USING (query_id)"""

LINES = f"""marked AS (
  SELECT conv_id || '-' || turn AS query_id, array_to_string(list_transform(
    string_split(text, chr(10)), lambda l, k: CASE WHEN k % 3 = 0 THEN l
      ELSE l || ' [chunk:turn-' || (turn - 1) || ']' END), chr(10)) AS answer
  FROM conversations WHERE role = 'assistant'),
kept_lines AS (
  SELECT query_id, list_filter(list_transform(regexp_split_to_array(answer, '\\n+'),
    lambda l: {trim('l')}), lambda l: l <> '') AS ls FROM marked),
line AS (SELECT query_id, generate_subscripts(ls, 1) - 1 AS claim_index, unnest(ls) AS l
  FROM kept_lines),
claim AS (
  SELECT query_id, claim_index, {stable('claim', 'claim_index', 'l')} AS claim_id,
    sha256({trim("regexp_replace(regexp_replace(l, " + quoted(WHITESPACE + '*') +
    " || '\\[chunk:[A-Za-z0-9_-]+\\]', '', 'g'), '(?i)^CLAIM:' || " + quoted(WHITESPACE + '*') +
    ", '')")}) AS text_sha256,
    regexp_extract_all(l, '\\[chunk:([A-Za-z0-9_-]+)\\]', 1) AS cited FROM line)"""

ORACLES["parsed_claims"] = f"""
WITH {LINES} SELECT query_id, claim_index, claim_id, text_sha256,
  array_to_string(cited, ',') AS cited FROM claim"""

ORACLES["claim_errors"] = f"""
WITH {LINES}, c AS (
  SELECT query_id, claim_index, unnest(CASE WHEN len(cited) = 0 THEN [NULL] ELSE cited END) AS chunk_id
  FROM claim),
known AS (SELECT conv_id || '-' || (turn + 1) AS query_id, 'turn-' || turn AS chunk_id,
  CASE WHEN turn = 0 THEN 'first' ELSE 'later' END AS snap FROM conversations WHERE role = 'user'),
j AS (SELECT query_id, claim_index, coalesce(chunk_id, 'claim has no citation') AS detail,
  CASE WHEN chunk_id IS NULL THEN 'missing_citation' WHEN snap IS NULL THEN 'invalid_chunk'
    WHEN snap <> 'first' THEN 'wrong_snapshot' END AS code
  FROM c LEFT JOIN known USING (query_id, chunk_id))
SELECT * FROM j WHERE code IS NOT NULL"""

# ---- ledger -------------------------------------------------------------------------------------


def _case(index: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v[index]}'" for k, v in ENTRY_TYPES.items())
    return f"CASE event_type {arms} END"


INPUTS = f"""inputs AS (
  SELECT event_id, 'user-' || user_id AS ledger_id, {_case(0)} AS entry_type, {_case(1)} AS outcome,
    CASE WHEN event_type IN ('view', 'error', 'purchase')
      THEN 'Was gilt für "' || event_id || '"?' END AS query_text,
    CASE WHEN event_type = 'view' THEN props END AS generated_answer,
    CASE WHEN event_type IN ('view', 'error', 'purchase')
      THEN 'model-' || ((props->>'$.k')::INT % 3) END AS model_version,
    CASE WHEN event_type IN ('view', 'error', 'purchase') THEN 42 END AS seed,
    sha256(user_id::VARCHAR) AS user_id_hash, epoch_us(ts) // 1000 AS timestamp_ms,
    replace(props, ' ', '') AS metadata FROM events)"""


def _js(x: str) -> str:
    return f"coalesce(to_json({x})::VARCHAR, 'null')"


_NA = '"not-applicable"'
PAYLOAD_HEAD = (
    "'{\"claimCitations\":[],\"corpusSnapshotHash\":" + _NA + ",\"corpusSnapshotId\":" + _NA
    + ",\"embeddingModelVersion\":" + _NA + ",\"entryType\":' || " + _js("entry_type")
    + " || ',\"generatedAnswer\":' || " + _js("generated_answer")
    + " || ',\"generatedAnswerSha256\":' || " + _js("sha256(generated_answer)")
    + " || ',\"metadata\":' || metadata || ',\"modelVersion\":' || "
    + _js("coalesce(model_version, 'not-applicable')")
    + " || ',\"outcome\":' || " + _js("outcome") + " || ',\"previousHash\":\"'"
)
PAYLOAD_MIDDLE = (
    "'\",\"promptHash\":" + _NA + ",\"promptVersion\":" + _NA + ",\"providerProfileId\":" + _NA
    + ",\"providerReplayCapability\":\"unsupported\",\"querySha256\":' || "
    + _js("sha256(coalesce(query_text, ''))") + " || ',\"queryText\":' || " + _js("query_text")
    + " || ',\"retrievedChunks\":[],\"seed\":' || coalesce(seed::VARCHAR, 'null') || ',\"sequence\":'"
)
PAYLOAD_TAIL = (
    "',\"temperature\":0,\"timestampMs\":' || timestamp_ms || ',\"userIdHash\":\"' "
    "|| user_id_hash || '\"}'"
)
CHAIN = f"""{INPUTS},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY timestamp_ms, event_id) AS sequence,
    {PAYLOAD_HEAD} AS head, {PAYLOAD_MIDDLE} AS middle, {PAYLOAD_TAIL} AS tail FROM inputs),
chain AS (
  SELECT ledger_id, sequence, event_id, repeat('0', 64) AS previous_hash,
    head || repeat('0', 64) || middle || sequence || tail AS payload FROM numbered WHERE sequence = 1
  UNION ALL
  SELECT n.ledger_id, n.sequence, n.event_id, sha256(c.previous_hash || c.payload),
    head || sha256(c.previous_hash || c.payload) || middle || n.sequence || tail
  FROM chain c JOIN numbered n ON n.ledger_id = c.ledger_id AND n.sequence = c.sequence + 1)"""

ORACLES["ledger_append"] = f"""
WITH RECURSIVE {CHAIN} SELECT c.ledger_id, c.sequence, c.event_id, previous_hash,
  sha256(previous_hash || payload) AS id, sha256(coalesce(query_text, '')) AS query_sha256,
  sha256(payload) AS payload_sha256 FROM chain c JOIN inputs USING (event_id)"""

ORACLES["ledger_verify"] = f"""
WITH {INPUTS} SELECT ledger_id, true AS ok, count(*) AS checked_rows,
  NULL::VARCHAR AS first_invalid_sequence, NULL::VARCHAR AS reason FROM inputs GROUP BY ledger_id"""

ORACLES["ledger_verify_tampered"] = f"""
WITH {INPUTS}, s AS (SELECT ledger_id, count(*) AS n, substr(ledger_id, 6)::BIGINT % 5 AS kind
  FROM inputs GROUP BY ledger_id)
SELECT ledger_id, kind = 0 OR n < 3 AS ok, CASE WHEN kind = 0 OR n < 3 THEN n ELSE 2 END AS checked_rows,
  CASE WHEN kind > 0 AND n >= 3 THEN '3' END AS first_invalid_sequence,
  CASE WHEN n >= 3 THEN CASE kind WHEN 1 THEN 'canonical payload mismatch'
    WHEN 2 THEN 'previous hash mismatch' WHEN 3 THEN 'row hash mismatch'
    WHEN 4 THEN 'signature missing' END END AS reason FROM s"""

_CUTOFF = f"epoch_ms(TIMESTAMP '{SINCE[:10]}')"
ORACLES["ledger_verify_incremental"] = f"""
WITH {INPUTS}, s AS (SELECT ledger_id, count(*) FILTER (timestamp_ms < {_CUTOFF}) AS n_before,
  count(*) FILTER (timestamp_ms >= {_CUTOFF}) AS n_after, substr(ledger_id, 6)::BIGINT % 3 AS kind
  FROM inputs GROUP BY ledger_id),
v AS (SELECT *, n_after > 0 AND (kind = 2 OR kind = 1 AND n_before = 0) AS bad FROM s)
SELECT ledger_id, NOT bad AS ok, CASE WHEN bad THEN 0 ELSE n_after END AS checked_rows,
  CASE WHEN bad THEN (n_before + 1)::VARCHAR END AS first_invalid_sequence,
  CASE WHEN bad THEN 'canonical payload mismatch' END AS reason FROM v"""

_window = (
    f"timestamp_ms BETWEEN epoch_ms(TIMESTAMP '{SINCE[:10]}') AND epoch_ms(TIMESTAMP '{UNTIL[:10]}')"
)
ORACLES["ledger_window"] = f"""
WITH {INPUTS} SELECT event_id, ledger_id, entry_type,
  coalesce(model_version, 'not-applicable') AS model_version, 'not-applicable' AS prompt_version,
  'unsupported' AS provider_replay_capability, sha256(generated_answer) AS generated_answer_sha256,
  seed::VARCHAR AS seed, timestamp_ms,
  strftime(make_timestamp_ms(timestamp_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_iso
FROM inputs WHERE {_window} AND entry_type <> 'replay.passed'"""

ORACLES["retention_view"] = f"""
WITH {INPUTS}, gone AS (SELECT sha256(user_id::VARCHAR) AS user_id_hash,
  sha256(user_id || ':deleted') AS tomb FROM events GROUP BY user_id HAVING max(value) > 300)
SELECT event_id, coalesce(tomb, i.user_id_hash) AS user_id_hash, CASE WHEN tomb IS NULL THEN metadata
  ELSE metadata[1:-2] || ',"operatorIdentityDeleted":true,"tombstoneHash":"' || tomb || '"}}' END
  AS metadata FROM inputs i LEFT JOIN gone ON gone.user_id_hash = i.user_id_hash"""

ORACLES["report_facts"] = f"""
WITH {INPUTS}, w AS (SELECT * FROM inputs WHERE {_window} AND entry_type <> 'report.generated'),
q AS (SELECT count(*) FILTER (entry_type LIKE 'query.%') AS n,
  count(*) FILTER (entry_type LIKE 'query.%' AND outcome = 'refused-out-of-corpus') AS r FROM w)
SELECT '{SINCE}' AS since, '{UNTIL}' AS until, (SELECT coalesce(string_agg(m, ',' ORDER BY m), '')
  FROM (SELECT DISTINCT model_version AS m FROM w WHERE model_version IS NOT NULL)) AS model_versions,
  '' AS prompt_versions, '' AS embedding_versions, '' AS corpus_snapshots,
  '' AS corpus_snapshot_hashes, n AS query_volume,
  CASE WHEN n = 0 THEN 0.0 ELSE round(r / n, 6) END AS refusal_rate FROM q"""

ORACLES["outcome_breakdown"] = f"""
WITH {INPUTS} SELECT outcome, count(*) AS n FROM inputs WHERE {_window} GROUP BY outcome"""

ORACLES["health"] = f"""
WITH {CORPUS} SELECT (SELECT count(*) FROM events) AS ledger_rows,
  (SELECT count(*) FROM chunks) AS chunk_rows"""

ORACLES["replay_status"] = f"""
WITH {RETRIEVAL}, {ANSWERS},
e AS (
  SELECT query_id, answer, CASE WHEN query_id % 7 = 3 THEN answer || ' ' ELSE answer END AS stored,
    CASE WHEN query_id % 5 = 1 AND query_id % 2 = 1 THEN 'corpus_snapshot'
      WHEN query_id % 5 = 2 THEN 'prompt' WHEN query_id % 5 = 3 THEN 'embedding_model'
      WHEN query_id % 5 = 4 THEN 'model' END AS drift
  FROM gate LEFT JOIN ans USING (query_id)),
r AS (
  SELECT *, CASE WHEN drift IS NOT NULL THEN 'drift' WHEN stored IS NULL THEN 'error'
    WHEN stored <> answer THEN 'drift' ELSE 'passed' END AS status FROM e),
d AS (
  SELECT *, CASE WHEN drift IS NOT NULL THEN drift WHEN stored IS NULL THEN 'unknown'
    WHEN stored <> answer THEN 'provider_infrastructure' END AS artifact FROM r)
SELECT query_id::VARCHAR AS id, status, artifact AS drift_artifact,
  CASE WHEN drift IS NOT NULL THEN 'false' WHEN stored IS NULL THEN NULL
    ELSE (stored = answer)::VARCHAR END AS byte_equal,
  sha256(stored) AS generated_answer_sha256,
  CASE WHEN drift IS NULL AND stored IS NOT NULL THEN sha256(answer) END
    AS regenerated_answer_sha256,
  CASE WHEN status = 'passed' THEN '{replay_texts.MESSAGE_PASSED}'
    ELSE '{replay_texts.MESSAGE_DRIFT}' || artifact || '.' END AS operator_message FROM d"""

ORACLES["replay_from_ledger"] = f"""
WITH {RETRIEVAL}, {ANSWERS},
e AS (
  SELECT query_id, answer, CASE WHEN query_id % 7 = 3 THEN answer || ' ' ELSE answer END AS stored,
    CASE WHEN query_id % 5 = 1 AND query_id % 2 = 1 THEN 'corpus_snapshot'
      WHEN query_id % 5 = 2 THEN 'prompt' WHEN query_id % 5 = 3 THEN 'embedding_model'
      WHEN query_id % 5 = 4 THEN 'model' END AS drift
  FROM gate LEFT JOIN ans USING (query_id))
SELECT 'supported' AS profile, query_id::VARCHAR AS id,
  CASE WHEN drift IS NOT NULL THEN 'drift' WHEN stored IS NULL THEN 'error'
    WHEN stored <> answer THEN 'drift' ELSE 'passed' END AS status,
  CASE WHEN drift IS NOT NULL THEN 'false' WHEN stored IS NOT NULL THEN (stored = answer)::VARCHAR
    END AS byte_equal,
  CASE WHEN drift IS NOT NULL THEN drift WHEN stored IS NULL THEN 'unknown'
    WHEN stored <> answer THEN 'provider_infrastructure' END AS drift_artifact
FROM e
UNION ALL
SELECT 'unsupported', query_id::VARCHAR, 'unsupported', NULL, drift FROM e"""

# ---- evaluation ---------------------------------------------------------------------------------

ORACLES["replay_pairs"] = """
SELECT sha256((c.event_id - 1)::VARCHAR) AS original_id, sha256(c.event_id::VARCHAR) AS replay_id,
  'replay-success' AS replay_outcome,
  CASE v.event_type WHEN 'view' THEN 'answered' WHEN 'click' THEN 'replay-success' END AS original_outcome
FROM (SELECT event_id FROM events WHERE event_type = 'click') c
LEFT JOIN events v ON v.event_id = c.event_id - 1"""
ORACLES["result_summary"] = f"""
WITH {RETRIEVAL}, {ANSWERS}
SELECT CASE WHEN out_of_corpus THEN 'refused-out-of-corpus' ELSE 'answered' END AS outcome, answer,
  {stable('query', 'sha256(query_text)', "'session'")} AS query_id, '{SNAPSHOT_ID}' AS corpus_snapshot_id,
  '{SNAPSHOT_HASH}' AS corpus_snapshot_hash, sha256(answer) AS answer_hash, coalesce(n_claims, 0) AS n_claims,
  sha256(query_id::VARCHAR) AS ledger_entry_id
FROM gate JOIN asked USING (query_id) LEFT JOIN ans USING (query_id)"""
VERBATIM = """verbatim AS (
  SELECT DISTINCT query_id FROM asked a JOIN (
    SELECT text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents) d
  ON d.line = string_split(a.query_text, chr(10))[1] AND contains(d.text, a.query_text))"""

ORACLES["gate_separation"] = f"""
WITH {RETRIEVAL}, {VERBATIM},
numbered AS (SELECT query_id, evidence AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC) AS k FROM everything),
stat AS (SELECT query_id, max(score) AS b, avg(score) AS m, stddev_pop(score) AS sd,
  coalesce(max(score) FILTER (k = 2), 0.0) AS s2,
  query_id IN (SELECT query_id FROM verbatim) AS inside FROM numbered GROUP BY query_id),
form AS (
  SELECT inside, 'best' AS form, b AS v FROM stat
  UNION ALL SELECT inside, 'best_minus_mean', b - m FROM stat
  UNION ALL SELECT inside, 'standard_score', CASE WHEN sd = 0 THEN 0.0 ELSE (b - m) / sd END FROM stat
  UNION ALL SELECT inside, 'best_over_mean', CASE WHEN m = 0 THEN 0.0 ELSE b / m END FROM stat
  UNION ALL SELECT inside, 'best_minus_second', b - s2 FROM stat
  UNION ALL SELECT inside, 'mean', m FROM stat)
SELECT form, round(min(v) FILTER (inside) - max(v) FILTER (NOT inside), 6) AS separation
FROM form GROUP BY form"""

VERDICTS = f"""verdict AS (
  SELECT g.query_id, true AS grounded, true AS covered,
    (query_id IN (SELECT query_id FROM verbatim)) = (NOT out_of_corpus) AS refusal,
    [CASE WHEN len({terms('query_text')}) > 30 THEN 'long' ELSE 'short' END,
     CASE WHEN query_id IN (SELECT query_id FROM verbatim) THEN 'verbatim' ELSE 'other' END] AS tags
  FROM gate g JOIN asked USING (query_id))"""
_RATES = """round(avg(grounded::INT), 6) AS groundedness,
  round(avg(covered::INT), 6) AS citation_accuracy, round(avg(refusal::INT), 6) AS refusal_correctness"""

ORACLES["case_verdicts"] = """
WITH l AS (SELECT doc_id, lang, source, string_split(text, chr(10))[1:3] AS ls FROM documents),
c AS (SELECT doc_id, lang, source, doc_id % 10 <> 3 AS present,
  len(list_filter(ls, lambda x: length(x) % 9 = 0)) = 0 AS grounded,
  len(list_filter(ls, lambda x: length(x) % 9 <> 0)) > 0 AS has_lang,
  len(list_filter(ls, lambda x: length(x) % 9 <> 0 AND length(x) % 2 = 1)) > 0 AS has_source FROM l)
SELECT doc_id AS id, present AND grounded AS grounded, present AND CASE doc_id % 4
    WHEN 0 THEN (has_lang OR has_source AND lang = source) AND (has_source OR has_lang AND lang = source)
    WHEN 1 THEN has_lang ELSE true END AS cited_expected,
  present AND doc_id % 3 <> 0 AS refusal_correct FROM c"""


def _six(x: str) -> str:
    return f"regexp_replace(printf('%.6f', {x}), '\\.?0+$', '')"


_PINNED = (
    f'{{"chunkerVersion":"chunker-800-100-v1","corpusHash":"{SNAPSHOT_HASH}",'
    f'"embeddingModelVersion":"{DEFAULT_EMBEDDING_MODEL}","modelVersion":"{EXTRACTIVE_PROFILE.model_version}",'
    f'"promptVersion":"{DEFAULT_PROMPT.version}"}}'
)
_BARS = '{"citation_accuracy":0.95,"groundedness":0.95,"refusal_correctness":0.9}'


ORACLES["golden_run"] = f"""
WITH {RETRIEVAL}, {VERBATIM}, verdict AS (
  SELECT g.query_id, true AS grounded, query_id % 5 <> 0 AS covered,
    (query_id IN (SELECT query_id FROM verbatim)) = (NOT out_of_corpus) AS refusal,
    CASE WHEN query_id IN (SELECT query_id FROM verbatim) THEN 'verbatim' ELSE 'other' END AS tag
  FROM gate g),
m AS (SELECT count(*) AS n, {_RATES} FROM verdict),
t AS (SELECT tag, count(*) AS n, {_RATES} FROM verdict GROUP BY tag),
j AS (SELECT '{{' || string_agg('"' || tag || '":{{"caseCount":' || n || ',"citation_accuracy":'
  || {_six('citation_accuracy')} || ',"groundedness":' || {_six('groundedness')}
  || ',"refusal_correctness":' || {_six('refusal_correctness')} || '}}', ',' ORDER BY tag) || '}}' AS tags FROM t),
o AS (SELECT *, CASE WHEN groundedness >= 0.95 AND citation_accuracy >= 0.95 AND refusal_correctness >= 0.9
  THEN 'passed' ELSE 'failed' END AS status FROM m, j)
SELECT n AS case_count, status, tags AS per_tag_breakdown, {quoted(_PINNED)} AS pinned_tuple,
  '{{"caseCount":' || n || ',"citation_accuracy":' || {_six('citation_accuracy')} || ',"groundedness":'
  || {_six('groundedness')} || ',"perTagBreakdown":' || tags || ',"pinnedTuple":' || {quoted(_PINNED)}
  || ',"refusal_correctness":' || {_six('refusal_correctness')} || ',"status":"' || status || '","thresholds":'
  || {quoted(_BARS)} || '}}' AS output_json, groundedness, citation_accuracy, refusal_correctness FROM o"""
ORACLES["evaluation_run"] = f"""
WITH {RETRIEVAL}, {VERBATIM}, {VERDICTS} SELECT count(*) AS case_count,
  CASE WHEN avg(refusal::INT) >= 0.9 THEN 'passed' ELSE 'failed' END AS status, {_RATES} FROM verdict"""
ORACLES["evaluation_by_tag"] = f"""
WITH {RETRIEVAL}, {VERBATIM}, {VERDICTS}, t AS (SELECT *, unnest(tags) AS tag FROM verdict)
SELECT tag, count(*) AS case_count, {_RATES} FROM t GROUP BY tag"""

# ---- time-driven --------------------------------------------------------------------------------

TIMED = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ts_ms FROM events)"


def anchored(key: str, window: int, limit: int) -> str:
    """Window starts by recursion: the next one is the first event after the last one ended."""
    return f"""
WITH RECURSIVE {TIMED}, starts AS (
  SELECT {key}, min(ts_ms) AS s FROM ev GROUP BY {key}
  UNION ALL
  SELECT {key}, s FROM (
    SELECT w.{key}, (SELECT min(e.ts_ms) FROM ev e WHERE e.{key} = w.{key} AND e.ts_ms >= w.s + {window})
      AS s FROM starts w) WHERE s IS NOT NULL),
placed AS (
  SELECT event_id, ts_ms, e.{key}, s, row_number() OVER (
    PARTITION BY e.{key}, s ORDER BY ts_ms, event_id) AS k
  FROM ev e ASOF JOIN starts w ON e.{key} = w.{key} AND e.ts_ms >= w.s)
SELECT event_id, s AS window_start_ms, least(k, {limit + 1}) AS attempt, k <= {limit} AS allowed
FROM placed"""


ORACLES["attempt_limits"] = anchored("event_type", 900_000, 5)
ORACLES["attempt_limits_per_user"] = anchored("user_id", 12 * 3_600_000, 2)

ORACLES["ledger_capacity"] = f"""
WITH {TIMED} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id)
  AS row_in_scope FROM ev QUALIFY row_in_scope <= 40"""

ORACLES["session_validity"] = f"""
WITH {TIMED}, l AS (SELECT user_id, ts_ms AS s FROM ev WHERE event_type = 'signup'),
j AS (SELECT event_id, ts_ms, s FROM (SELECT * FROM ev WHERE event_type <> 'signup') e
  ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts_ms >= l.s)
SELECT event_id, CASE WHEN ts_ms - s < 28800000 THEN s::VARCHAR END AS session_start_ms,
  coalesce(ts_ms - s < 28800000, false) AS authorized FROM j"""

ORACLES["challenge_use"] = f"""
WITH {TIMED}, l AS (SELECT user_id, ts_ms AS s FROM ev WHERE event_type = 'signup'),
j AS (SELECT event_id, e.user_id, ts_ms, s FROM (SELECT * FROM ev WHERE event_type = 'click') e
  ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts_ms >= l.s),
v AS (SELECT event_id, user_id, ts_ms, CASE WHEN ts_ms - s < 86400000 THEN s END AS s FROM j)
SELECT event_id, s::VARCHAR AS issued_ms, s IS NOT NULL AND
  row_number() OVER (PARTITION BY user_id, s ORDER BY ts_ms, event_id) = 1 AS accepted FROM v"""

_HALF_DAY = 43_200_000
# Client windows are kept as start and count, one map each.
def write_limit_sql(scope: str, client: str, kind: str, per_client: int, per_scope: int, window: int) -> str:
    return f"""
WITH RECURSIVE {TIMED},
nr AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ts_ms, event_id) AS k FROM (
  SELECT event_id, ts_ms, {scope} AS scope, {client} AS client FROM ev)),
fold AS (
  SELECT scope, 0::BIGINT AS k, NULL::BIGINT AS event_id, false AS allowed,
    MAP([]::{kind}[], []::BIGINT[]) AS cs, MAP([]::{kind}[], []::BIGINT[]) AS cn,
    NULL::BIGINT AS gs, 0 AS gn
  FROM (SELECT DISTINCT scope FROM nr)
  UNION ALL
  SELECT scope, k, event_id, ok,
    CASE WHEN ok AND new_client THEN map_concat(cs, MAP([client], [ts_ms])) ELSE cs END,
    CASE WHEN NOT ok THEN cn WHEN new_client THEN map_concat(cn, MAP([client], [1::BIGINT]))
      ELSE map_concat(cn, MAP([client], [cn[client] + 1])) END,
    CASE WHEN ok AND new_scope THEN ts_ms ELSE gs END,
    CASE WHEN NOT ok THEN gn WHEN new_scope THEN 1 ELSE gn + 1 END
  FROM (
    SELECT *, (new_client OR cn[client] < {per_client}) AND (new_scope OR gn < {per_scope}) AS ok FROM (
      SELECT n.scope, n.k, n.event_id, n.client, n.ts_ms, cs, cn, gs, gn,
        gs IS NULL OR n.ts_ms - gs >= {window} AS new_scope,
        cs[n.client] IS NULL OR n.ts_ms - cs[n.client] >= {window} AS new_client
      FROM fold f JOIN nr n ON n.scope = f.scope AND n.k = f.k + 1)))
SELECT event_id, allowed FROM fold WHERE k > 0"""


ORACLES["write_limits"] = write_limit_sql("event_type", "user_id", "BIGINT", 2, 4, _HALF_DAY)
ORACLES["write_limits_one_scope"] = write_limit_sql("'all'", "event_type", "VARCHAR", 20, 60, _HALF_DAY)

ORACLES["chunk_provenance"] = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, text, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS p
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)),
part AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
    CASE WHEN i % 7 = 6 THEN p || '~' ELSE p END AS part FROM raw WHERE p <> ''),
fold AS (
  SELECT doc_id, text, 0::BIGINT AS k, 1::BIGINT AS cur, '' AS rest, 0 AS missing FROM documents
  UNION ALL
  SELECT doc_id, text, k, CASE WHEN rel > 0 THEN cur + rel - 1 + length(part) ELSE cur END,
    CASE WHEN rel > 0 THEN rest || substr(text, cur, rel - 1) || ' ' ELSE rest END,
    missing + CASE WHEN rel > 0 THEN 0 ELSE 1 END
  FROM (SELECT f.doc_id, f.text, p.k, p.part, cur, rest, missing,
          strpos(substr(f.text, cur), p.part) AS rel
        FROM fold f JOIN part p ON p.doc_id = f.doc_id AND p.k = f.k + 1)),
final AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM fold)
SELECT doc_id AS source_id, k AS n_chunks, missing AS n_missing, k > 0 AND missing = 0 AND
  regexp_replace(rest || substr(text, cur), '\\([0-9]+\\)|' || {quoted(WHITESPACE + '+')}, '', 'g') = ''
  AS verbatim FROM final WHERE r = 1"""

"""The operators of this package as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import (
    bloom_dedup,
    chosen_path,
    decontamination,
    language_id,
    license_scan,
    line_dedup,
    packing,
    suffix_dedup,
    toxicity,
    url_filter,
    vector_codes,
    voronoi_knn,
    whitening,
)
from attestra.llm.common import crc_remainder
from attestra.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PACKING_VOCABULARY = "word_bpe_49k.json"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, d)).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack_documents(
        documents(spark, d), vocabulary_path(PACKING_VOCABULARY), with_ids=False
    )
    return pieces.drop("ids").withColumnRenamed("id", "doc_id")


@query
def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontamination.find_contamination(
        documents(spark, d), read_table(spark, d, "benchmark")
    )
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return decontamination.contaminated(found).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        "contaminated",
    )


def words_sql(text: str) -> str:
    """The words of a text: A-Z lower-cased, runs of digits, letters and characters above 0x7F."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLES["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS k FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
met AS (
  SELECT doc_id, i, k, item_id FROM (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (
      SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows)))
  JOIN windows USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    scored = toxicity.score_toxicity(
        documents(spark, d), read_table(spark, d, "labels"), train_where=~held_out
    )
    return scored.withColumnRenamed("id", "doc_id").select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


@query
def op5_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, d, "pages")).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score"
    )


@query
def op6_chosen_path(spark: SparkSession, d: str) -> DataFrame:
    return chosen_path.similar_groups(documents(spark, d)).select(
        F.col("id").alias("doc_id"), "class_id", F.col("group").alias("group_id"), "n_links"
    )


ORACLES["op6_chosen_path"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM d)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (
  SELECT a, b, c = p.n AND c = q.n AS same
  FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, b FROM reach r JOIN link ON a = other),
own AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, group_id, coalesce(n_links, 0) AS n_links
FROM (SELECT doc_id, min(other) AS group_id FROM reach GROUP BY doc_id) LEFT JOIN own USING (doc_id)
"""


@query
def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, d)).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLES["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT keyed.doc_id, place, line, first_id IS NOT NULL AND keyed.doc_id <> first_id AS lost
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    found = language_id.identify_language(documents(spark, d), train_where=~held_out)
    return found.withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query
def op9_voronoi_knn(spark: SparkSession, d: str) -> DataFrame:
    return voronoi_knn.knn_join(read_table(spark, d, "embeddings"), F.col("id") % 50 == 0)


ORACLES["op9_voronoi_knn"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op10_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, d)).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLES["op10_suffix_dedup"] = """
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (
  SELECT doc_id, i, hash(b[i : i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM n)),
repeated AS (SELECT doc_id, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
runs AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, 0))::INT AS fresh FROM repeated)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM runs GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
pieces AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM spans
  UNION ALL SELECT doc_id, max(z), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(hex(b[p.a : coalesce(p.z, n + 1) - 1]), '' ORDER BY p.a) AS x
  FROM pieces p JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN x IS NULL THEN b ELSE unhex(x) END) AS kept_sha256
FROM n LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op11_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(read_table(spark, d, "embeddings"), label=F.col("label"))
    return coded.withColumnRenamed("id", "vec_id").withColumn(
        "codebooks_sha256", F.lit(books.digest() if books else None).cast("string")
    )


def vector_codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every round as two tables: the nearest entry of each part, the moved entries."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v
  FROM kept, range({parts}) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v
  FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, p, any_value(pieces.v) AS v,
         min({{'d': list_sum(list_transform(list_zip(pieces.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best
  FROM pieces JOIN book{i} b USING (p) GROUP BY vec_id, p
)""")
        if i < rounds:
            steps.append(f"""
book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM (
      SELECT p, best.e AS e, place, sum(v[place]) AS s, count(*) AS n
      FROM near{i}, range(1, 1 + len(v)) AS t(place) GROUP BY ALL
    ) GROUP BY p, e
  ) m USING (p, e)
)""")
    return "WITH" + ",".join(steps) + f"""
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v[place] AS VARCHAR), ',' ORDER BY p, e, place))
        FROM book{rounds}, range(1, 1 + len(v)) AS t(place)) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLES["op11_vector_codes"] = vector_codes_sql(parts=8, entries=16, rounds=6, scale=4096)


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read_table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op13_bloom_dedup(spark: SparkSession, d: str) -> DataFrame:
    return bloom_dedup.dedup_exact(documents(spark, d)).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLES["op13_bloom_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

"""Strict readers for evaluation inputs and vector caches."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.vector import vector_problem

GOLDEN_SCHEMA = (
    "id string, question string, expected_outcome string, expected_chunks array<string>, "
    "tags array<string>"
)
PROBE_SCHEMA = "id string, class string, question string, note string"
CACHE_ENTRY = r'"([^"\\]+)"\s*:\s*\[([^\[\]]*)$'
# What a case may expect and how a probe may be labelled.
EXPECTED_OUTCOMES = ("answered", "refused-out-of-corpus", "blocked-unsafe")
PROBE_CLASSES = ("in-corpus", "out-of-corpus")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def _require(rows: DataFrame, rules: dict[str, Column], what: str) -> DataFrame:
    """Fail on an empty set, a broken row or a repeated id; counts only, no rows, reach the driver."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(rule, 1)).alias(message) for message, rule in rules.items()],
    ).first()
    if counts["n"] == 0:
        raise ValueError(f"{what} set is empty")
    for message in rules:
        if counts[message]:
            raise ValueError(f"{message} in {counts[message]} row(s)")
    repeated = rows.groupBy("id").count().filter("count > 1").select("id").limit(1).collect()
    if repeated:
        raise ValueError(f"Duplicate {what.lower()} ID: {repeated[0]['id']}")
    return rows


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    rules = {
        "Missing case ID": _missing("id"),
        "Missing question": _missing("question"),
        "Missing or invalid expected_outcome": F.coalesce(
            ~F.col("expected_outcome").isin(*EXPECTED_OUTCOMES), F.lit(True)
        ),
    }
    rows = _require(_parsed(spark, path, GOLDEN_SCHEMA), rules, "Golden")
    return rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    rules = {
        "Missing probe ID": _missing("id"),
        "Missing question": _missing("question"),
        "Missing or invalid class": F.coalesce(~F.col("class").isin(*PROBE_CLASSES), F.lit(True)),
        "Missing note": _missing("note"),
    }
    return _require(_parsed(spark, path, PROBE_SCHEMA), rules, "Probe")


def read_vector_cache(spark: SparkSession, path: str) -> DataFrame:
    """``text_sha256, vector`` of a cache file; a bad vector or missing provenance fails the read.

    The file is one JSON object, however large: ``provenance`` and ``vectors``, hash to numbers. It is
    read as text records that end with a bracket, one for each vector, so several tasks read ranges of
    it. What is left of the records is the frame around them, which has to be whole.
    """
    records = spark.read.option("lineSep", "]").text(path)
    numbers = F.split(F.regexp_extract("value", CACHE_ENTRY, 2), ",")
    entries = records.select(
        F.regexp_extract("value", CACHE_ENTRY, 1).alias("text_sha256"),
        F.transform(numbers, lambda x: F.trim(x).try_cast("double")).alias("vector"),
        F.regexp_replace("value", CACHE_ENTRY, "").alias("frame"),
    )
    frames = entries.filter(~F.col("frame").rlike(r"^[\s,]*$")).select("frame").limit(4).collect()
    frame = "".join(r["frame"] for r in frames)
    found = re.search(r'"provenance"\s*:\s*(\{[^{}]*\})', frame)
    provenance = json.loads(found.group(1)) if found else {}
    if not provenance.get("dimension") or not re.search(r'"vectors"\s*:\s*\{', frame):
        raise ValueError(f"{path}: missing provenance or vectors")
    rest = frame.replace(found.group(0), "").replace('"vectors"', "")
    if re.search(r"[^\s{},:]", rest) or rest.count("{") != rest.count("}"):
        raise ValueError(f"{path}: not a vector cache: {rest[:80]!r}")
    vectors = entries.filter("text_sha256 <> ''").select("text_sha256", "vector")
    problem = vector_problem(F.col("vector"), provenance["dimension"])
    broken = vectors.select("text_sha256", problem.alias("p")).filter("p IS NOT NULL").first()
    if broken:
        raise ValueError(f"{path}: cached vector {broken['text_sha256']} is unusable: {broken['p']}")
    return vectors


def lookup_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Vectors of ``text`` by content hash; a miss fails the job, there is no lexical fallback."""
    key = F.sha2("text", 256)
    joined = texts.withColumn("text_sha256", key).join(cache, "text_sha256", "left")
    message = F.concat(F.lit("no cached embedding for text sha256 "), F.col("text_sha256"))
    failed = F.raise_error(message).cast("array<double>")
    return joined.withColumn(
        "vector", F.when(F.col("vector").isNull(), failed).otherwise(F.col("vector"))
    )


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``texts`` the cache holds no vector for, with the hash they would be stored under."""
    keyed = texts.withColumn("text_sha256", F.sha2("text", 256))
    return keyed.join(cache.select("text_sha256"), "text_sha256", "left_anti")

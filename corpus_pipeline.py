"""A corpus pipeline: toxicity, line dedup, similarity join, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored before the next stage
reads it. All but the last return the columns of ``docs``; ``n_chars`` follows the text where a stage
changes it. Null and empty texts pass all filters. Rows with a null id are never dropped for what
other documents hold. Rows that repeat an id stay or go together in the join. Further columns are
kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import chosen_path, decontamination, line_dedup, packing, toxicity
from attestra.llm.common import cut
from attestra.llm.queries import PACKING_VOCABULARY, vocabulary_path
from attestra.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of several documents stay in the first of them only."""
    kept = line_dedup.without_shared_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the smallest id."""
    groups = chosen_path.similar_groups(docs)
    gone = groups.filter(F.col("id") != F.col("group")).select(F.col("id").alias("_gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too large a share of benchmark passages go."""
    found = decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    bad = decontamination.contaminated(found).filter("contaminated").select(
        F.col("id").alias("_bad_id"), F.sha2("text", 256).alias("_bad_text")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.sha2("text", 256) == F.col("_bad_text"))
    return docs.join(bad, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    pieces = packing.pack_documents(docs, vocabulary_path(PACKING_VOCABULARY), with_ids=False)
    return pieces.drop("ids").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("similarity_join", drop_similar),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The classifier, the chosen paths and the tokenizer have no SQL form; tests compare each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs

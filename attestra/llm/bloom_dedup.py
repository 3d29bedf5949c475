"""Exact duplicates of whole texts behind a two-pass Bloom filter, in DataFrame functions only.

Pass one sets two slots of a fixed-size filter for each row, from two halves of a 64-bit hash of its
text, and keeps the slots that were set more than once. Counting is combined before the shuffle, so a
text that fills a third of the table is one slot count per task. Pass two looks both slots of each row
up: a row with a slot nobody else set is the only one of its text and passes straight through. Only
the possibly repeated rows are grouped, by the SHA-256 of their texts, and only (digest, id) of them
moves; a text never does.

The filter has ``filter_bits`` slots whatever the input, so the broadcast table of its 64-bit words has
at most ``filter_bits / 64`` rows. A table of very many more rows than slots fills the filter: then more
rows are grouped, the result is the same. The groups found are broadcast while they number at most
``broadcast_groups``; beyond that the possibly repeated rows join them by digest, from a stored table so
that the join may split a hot text.

Defined results: a null text counts as empty. A null id is smaller than every other. Rows that repeat
both id and text count each for ``group_size``; ``dedup_exact`` marks them alike (all kept or none),
``without_copies`` leaves one row of each text. Other columns, of whatever name, play no part. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import cut, id_and_text
from attestra.operators.topk import fits_broadcast

FILTER_BITS = 1 << 26
BROADCAST_GROUPS = 1 << 19
HALF_SEED_BITS = 32


def slots(text: Column, filter_bits: int) -> list[Column]:
    """The two slots of a text: one in each half of the filter."""
    half = filter_bits // 2
    value = F.xxhash64(text)
    return [
        value.bitwiseAND(F.lit(half - 1)),
        F.shiftrightunsigned(value, HALF_SEED_BITS).bitwiseAND(F.lit(half - 1)) + F.lit(half),
    ]


def word(slot: Column) -> Column:
    return F.shiftrightunsigned(slot, 6)


def bit(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(63)).cast("int")


def repeated_slots(texts: DataFrame, filter_bits: int) -> DataFrame:
    """(word, bits): the slots that at least two rows set, 64 to a word."""
    set_slots = texts.select(F.explode(F.array(*slots(F.col("text"), filter_bits))).alias("slot"))
    twice = set_slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("slot")))
    return twice.groupBy(word(F.col("slot")).alias("word")).agg(F.bit_or(one).alias("bits"))


def with_possible(rows: DataFrame, text: Column, filter_words: DataFrame, filter_bits: int) -> DataFrame:
    """``rows`` with ``_digest``, the SHA-256 of a text that may be repeated, else null."""
    found = rows
    for number, slot in enumerate(slots(text, filter_bits)):
        side = F.broadcast(filter_words.toDF(f"_word{number}", f"_bits{number}"))
        found = found.withColumn("_slot", slot).join(side, word(F.col("_slot")) == F.col(f"_word{number}"), "left")
        shifted = F.call_function("shiftrightunsigned", F.col(f"_bits{number}"), bit(F.col("_slot")))
        found = found.withColumn(f"_set{number}", F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False)))
        found = found.drop("_slot", f"_word{number}", f"_bits{number}")
    digest = F.when(F.col("_set0") & F.col("_set1"), F.unhex(F.sha2(text, 256)))
    return found.withColumn("_digest", digest).drop("_set0", "_set1")


def repeated_texts(possible: DataFrame, id_column: Column) -> DataFrame:
    """(_key, _size, _best, _best_rows): texts of several rows, with the id that stays and its rows."""
    rows = possible.filter(F.col("_digest").isNotNull()).select(
        F.col("_digest").alias("_key"), id_column.alias("_best")
    )
    counted = rows.groupBy("_key", "_best").agg(F.count(F.lit(1)).alias("_n"))
    groups = counted.groupBy("_key").agg(
        F.sum("_n").alias("_size"), F.max(F.struct("_best", "_n")).alias("_top")
    )
    return groups.filter("_size > 1").select(
        "_key", "_size", F.col("_top._best").alias("_best"), F.col("_top._n").alias("_best_rows")
    )


def with_groups(
    rows: DataFrame, id_column: str, text_column: str, filter_bits: int, broadcast_groups: int
) -> DataFrame:
    """``rows`` with _size, _best and _best_rows of their text where it repeats, else null."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    identity = F.col(id_column).cast("long")
    filter_words = cut(repeated_slots(rows.select(text.alias("text")), filter_bits))
    possible = with_possible(rows, text, filter_words, filter_bits)
    groups = cut(repeated_texts(possible, identity))
    meets = F.col("_digest") == F.col("_key")
    if fits_broadcast(groups, broadcast_groups):
        joined = possible.join(F.broadcast(groups), meets, "left")
    else:
        nothing = [F.lit(None).cast(groups.schema[name].dataType).alias(name) for name in groups.columns]
        single = possible.filter(F.col("_digest").isNull()).select("*", *nothing)
        joined = possible.filter(F.col("_digest").isNotNull()).join(groups, meets, "left").unionByName(single)
    return joined.drop("_digest")


def dedup_exact(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    filter_bits: int = FILTER_BITS,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """One row per document row: id, text, keep_id (largest id of the text), group_size, kept."""
    found = with_groups(id_and_text(docs, id_column, text_column), "id", "text", filter_bits, broadcast_groups)
    repeats = F.col("_size").isNotNull()
    keep = F.when(repeats, F.col("_best")).otherwise(F.col("id"))
    return found.select(
        "id",
        "text",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
    )


def without_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    filter_bits: int = FILTER_BITS,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """``docs`` with all its columns, one row for each text."""
    found = with_groups(docs, id_column, text_column, filter_bits, broadcast_groups)
    stays = F.col("_size").isNull() | F.col("_best").eqNullSafe(F.col(id_column).cast("long"))
    several = F.coalesce(F.col("_best_rows") > 1, F.lit(False))
    kept = found.filter(stays)
    alone, alike = kept.filter(~several), kept.filter(several).dropDuplicates(["_key"])
    return alone.unionByName(alike).select(*[F.col(f"`{name}`") for name in docs.columns])

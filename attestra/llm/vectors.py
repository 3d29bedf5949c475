"""Vectors the operators of this package can use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scaled components stay below this bound, so that products and sums of squares fit 64 bits.
COMPONENT_LIMIT = 1 << 26


def usable_vectors(rows: DataFrame, scale: int, id_column: str, vector_column: str, **others: Column) -> DataFrame:
    """(id, x, others): vectors as integers ``floor(scale * component)``.

    Left out: null vectors, vectors with a null or non-finite component, empty ones, and those shorter
    than the longest of the rest. A component that reaches ``COMPONENT_LIMIT`` once scaled is an error.
    """
    found = rows.select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(vector_column, lambda c: c.cast("double")).alias("c"),
        *[column.alias(name) for name, column in others.items()],
    ).filter(
        F.col("c").isNotNull()
        & (F.size("c") > 0)
        & ~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    sizes = found.agg(F.min(F.size("c")).alias("least"), F.max(F.size("c")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        found = found.filter(F.size("c") == sizes["most"])
    whole = F.transform(
        "c",
        lambda c: F.when(F.abs(c) * scale < COMPONENT_LIMIT - 1, F.floor(c * scale).cast("int"))
        .otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {COMPONENT_LIMIT}")).cast("int")),
    )
    return found.select("id", whole.alias("x"), *others)


def integer_matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64)

"""Epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(moment: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60
    fraction = F.floor(F.extract(F.lit("SECOND"), moment) * 1000).cast("bigint")
    return (
        F.unix_date(F.to_date(moment)).cast("bigint") * 86_400_000
        + seconds.cast("bigint") * 1000
        + fraction
    )

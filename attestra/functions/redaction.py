"""Keep query text, secrets and personal data out of operational records."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Key and secret patterns, and the INFO-level allowlist.
FORBIDDEN_KEY_PATTERN = (
    r"(^query$|query.*text|chunk.*text|answer.*text|prompt.*text|provider.*key"
    r"|db.*credential|password|secret|pii)"
)
PROMPT_SECRET_PATTERN = (
    r"sk-[A-Za-z0-9]|postgres://|DATABASE_URL|ANTHROPIC_API_KEY|OPENAI_API_KEY"
)
REDACTED = "[redacted]"
INFO_FIELDS = {
    "user_id_hash": ("user_id_hash", "userIdHash"),
    "query_id": ("query_id", "queryId"),
    "latency_ms": ("latency_ms", "latencyMs"),
    "outcome": ("outcome",),
}


def redact_map(meta: Column) -> Column:
    """Redact a flat string map by key."""
    return F.transform_values(
        meta,
        lambda key, value: F.when(
            key.rlike("(?i)" + FORBIDDEN_KEY_PATTERN), F.lit(REDACTED)
        ).otherwise(value),
    )


def has_prompt_secret(text: Column) -> Column:
    return text.rlike(PROMPT_SECRET_PATTERN)


def assert_no_prompt_secrets(text: Column) -> Column:
    """The text itself; the job fails on one that carries deployment secrets."""
    message = F.lit("Prompt contains deployment secret material")
    return F.when(has_prompt_secret(text), F.raise_error(message).cast("string")).otherwise(text)


def egress_allowed(host: Column, allowlist: list[str]) -> Column:
    return host.isin(allowlist) if allowlist else F.lit(False)


def operational_info(meta: Column) -> Column:
    """The four fields an INFO record may carry, snake case before camel case, after redaction."""
    redacted = redact_map(meta)
    return F.struct(
        *[
            F.coalesce(*[F.try_element_at(redacted, F.lit(k)) for k in keys]).alias(name)
            for name, keys in INFO_FIELDS.items()
        ]
    )


_FORBIDDEN = re.compile(FORBIDDEN_KEY_PATTERN, re.IGNORECASE)


def _redact(value: object) -> object:
    if isinstance(value, dict):
        return {k: REDACTED if _FORBIDDEN.search(k) else _redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_redact(v) if isinstance(v, dict) else v for v in value]
    return value


@F.pandas_udf(StringType())
def redact_json(raw: pd.Series) -> pd.Series:
    """Redact nested JSON records; map-valued list items are followed, nested lists are not."""
    return raw.map(
        lambda t: json.dumps(_redact(json.loads(t)), ensure_ascii=False, separators=(",", ":")),
        na_action="ignore",
    )

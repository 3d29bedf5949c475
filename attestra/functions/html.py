"""Article bodies out of web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import text as T

# Markers of the default page layout and the entities that are decoded.
BODY_START = r"\(1\)\s"
BODY_END = "© Europäische Union"
NAMED_ENTITIES = (
    ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "),
)
RESIDUAL_ENTITY = r"(?i)&[a-z]+;|&#\d+;"
NUMERIC_ENTITY = r"&#(\d+);"
HEX_ENTITY = r"&#[xX]([0-9a-fA-F]+);"


def _code_point(digits: Column, base: int) -> Column:
    number = F.conv(digits, base, 10).cast("bigint")
    encoded = (
        F.when(number < 0x80, F.format_string("%02X", number))
        .when(
            number < 0x800,
            F.format_string("%02X%02X", 0xC0 + F.floor(number / 64), 0x80 + number % 64),
        )
        .when(
            number < 0x10000,
            F.format_string(
                "%02X%02X%02X",
                0xE0 + F.floor(number / 4096),
                0x80 + F.floor(number / 64) % 64,
                0x80 + number % 64,
            ),
        )
        .otherwise(
            F.format_string(
                "%02X%02X%02X%02X",
                0xF0 + F.floor(number / 262144),
                0x80 + F.floor(number / 4096) % 64,
                0x80 + F.floor(number / 64) % 64,
                0x80 + number % 64,
            )
        )
    )
    return F.decode(F.unhex(encoded), "UTF-8")


def _decode_numbers(text: Column, pattern: str, base: int) -> Column:
    """Replace numeric entities: text pieces and decoded characters alternate."""
    pieces = F.split(text, pattern)
    digits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    decoded = F.zip_with(
        pieces,
        digits,
        lambda piece, code: F.concat(
            piece, F.when(code.isNull(), F.lit("")).otherwise(_code_point(code, base))
        ),
    )
    return F.when(text.rlike(pattern), F.array_join(decoded, "")).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Decimal, then hexadecimal, then the named entities; each kind in one pass.

    The ampersand is decoded last: ``&amp;lt;`` must end as ``&lt;``, not as ``<``.
    """
    text = _decode_numbers(text, NUMERIC_ENTITY, 10)
    text = _decode_numbers(text, HEX_ENTITY, 16)
    ordered = [e for e in NAMED_ENTITIES if e[0] != "amp"] + [NAMED_ENTITIES[0]]
    for name, char in ordered:
        text = F.regexp_replace(text, f"(?i)&{name};", char)
    return text


def visible_text(html: Column) -> Column:
    """Page text: scripts, styles and tags become blanks, entities are decoded, blanks collapse."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.regexp_replace(decode_entities(text), f"{T.WHITESPACE}+", " ")


def article_body(
    visible: Column, start_pattern: str = BODY_START, end_marker: str = BODY_END
) -> Column:
    """Struct ``body, problem``: the text between the markers or why there is none."""
    start = F.regexp_instr(visible, F.lit(start_pattern))
    end = F.instr(visible, end_marker)
    body = T.trim_unicode(F.substring(visible, start, F.greatest(end - start, F.lit(0))))
    problem = (
        F.when(start <= 0, F.lit("start marker missing"))
        .when((end <= 0) | (end <= start), F.lit("end marker missing"))
        .when(body.rlike(RESIDUAL_ENTITY), F.lit("undecoded entity"))
        .when(body == "", F.lit("empty body"))
    )
    return F.struct(F.when(problem.isNull(), body).alias("body"), problem.alias("problem"))

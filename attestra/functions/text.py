"""Text primitives as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide tokens, offsets and warnings, so they must not drift.
WHITESPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
WIDE_WHITESPACE = (
    r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# The same for Python's expressions.
WIDE_BLANKS = "[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NON_WHITESPACE = WHITESPACE.replace("[", "[^", 1)
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
TERM_SEPARATOR = r"[^\p{L}\p{N}-]+"
ASTRAL_COMPLEMENT = r"[^\x{10000}-\x{10FFFF}]"
UMLAUT_FOLDS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
HIDDEN_TEXT_PATTERN = r"(?i)hidden-text|white-on-white|opacity:0"
SCANNED_PDF_PATTERN = r"(?i)scanned-pdf|ocr-required"
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+"


def trim_unicode(text: Column) -> Column:
    """Trim the full Unicode whitespace set, not only ASCII blanks."""
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def normalize_text(text: Column) -> Column:
    """Drop NUL characters, turn CRLF into LF, trim."""
    cleaned = F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return trim_unicode(cleaned)


def fold_german(text: Column) -> Column:
    """Transliterate umlauts and eszett of already lower-cased text."""
    for umlaut, folded in UMLAUT_FOLDS:
        text = F.replace(text, F.lit(umlaut), F.lit(folded))
    return text


def _term_array(lowered: Column) -> Column:
    # A term has at least two UTF-16 units; one astral character (4 bytes) already counts as two.
    return F.filter(
        F.split(lowered, TERM_SEPARATOR),
        lambda t: (F.length(t) > 1) | (F.octet_length(t) > 3),
    )


def terms(text: Column) -> Column:
    """Search terms with umlaut folding, duplicates kept."""
    return _term_array(fold_german(F.lower(text)))


def embedding_tokens(text: Column) -> Column:
    """Tokens of the hash embedding: like ``terms`` but without umlaut folding."""
    return _term_array(F.lower(text))


def whitespace_tokens(text: Column) -> Column:
    """Chunker tokens: maximal runs of non-whitespace."""
    return F.array_remove(F.split(plain_blanks(text), r"\s+"), "")


def plain_blanks(text: Column) -> Column:
    """Every blank as an ASCII one; no character changes its place."""
    # Blanks beyond ASCII only occur in text that has multi-byte characters at all.
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.regexp_replace(text, WIDE_WHITESPACE, " ")
    )


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; offsets are defined in those units."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(
        F.length(text) + F.length(F.regexp_replace(text, ASTRAL_COMPLEMENT, ""))
    )


def sentences(text: Column) -> Column:
    """Collapse whitespace, then split after sentence-final punctuation."""
    collapsed = trim_unicode(F.regexp_replace(plain_blanks(text), r"\s+", " "))
    return F.filter(F.split(collapsed, SENTENCE_BOUNDARY), lambda s: s != "")


def hidden_text(text: Column) -> Column:
    return text.rlike(HIDDEN_TEXT_PATTERN)


def scanned_pdf(text: Column, source_type: Column) -> Column:
    return (source_type == "pdf") & text.rlike(SCANNED_PDF_PATTERN)


def extraction_warnings(text: Column, source_type: Column, extracted: Column | None = None) -> Column:
    """Warnings from extraction first, then hidden-text, then OCR use."""
    flags = F.array_compact(
        F.array(
            F.when(hidden_text(text), F.lit("hidden-text-warning")),
            F.when(scanned_pdf(text, source_type), F.lit("ocr-used")),
        )
    )
    return flags if extracted is None else F.concat(extracted, flags)


def word_xml_to_text(xml: Column) -> Column:
    """Flatten word-processor XML: tabs, paragraph ends, then tags, then three entities."""
    text = F.regexp_replace(xml, r"<w:tab\s*/>", "\t")
    text = F.replace(text, F.lit("</w:p>"), F.lit("\n"))
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text

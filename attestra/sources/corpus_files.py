"""A directory of markdown, DOCX and PDF files as revisions."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from attestra.functions import text as T

# Extensions and extraction warnings.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "md": "markdown"}
DOCX_FALLBACK = "docx-text-fallback"
PDF_FALLBACK = "pdf-text-fallback"
OCR_USED = "ocr-used"
OCR_FALLBACK = "pdf-ocr-fallback"
OCR_RESOLUTION = "200"
OCR_LANGUAGES = "deu+eng"

EXTRACTED = StructType(
    [
        StructField("text", StringType()),
        StructField("ocr_used", BooleanType()),
        StructField("warnings", ArrayType(StringType())),
    ]
)


def assert_inside_root(directory: str, root: str) -> str:
    resolved, base = os.path.abspath(directory), os.path.abspath(root)
    if resolved != base and not resolved.startswith(base.rstrip("/") + "/"):
        raise ValueError("Corpus path escapes configured root")
    return resolved


def source_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    mapping = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(mapping, extension)


def _run(*command: str) -> str:
    done = subprocess.run(command, check=True, capture_output=True)
    return done.stdout.decode("utf-8", "replace")


def _ocr(path: str, folder: str, raw: bytes) -> tuple[str, bool, list[str]]:
    try:
        _run("pdftoppm", "-png", "-r", OCR_RESOLUTION, path, os.path.join(folder, "page"))
        pages = sorted(p for p in os.listdir(folder) if p.endswith(".png"))
        texts = [
            _run("tesseract", os.path.join(folder, p), "stdout", "-l", OCR_LANGUAGES) for p in pages
        ]
        return "\n\n".join(texts), True, [OCR_USED]
    except (OSError, subprocess.CalledProcessError):
        return raw.decode("utf-8", "replace"), True, [OCR_USED, OCR_FALLBACK]


def _pdf(raw: bytes) -> tuple[str, bool, list[str]]:
    if shutil.which("pdftotext") is None:
        return raw.decode("utf-8", "replace"), True, [PDF_FALLBACK]
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "document.pdf")
        with open(path, "wb") as out:
            out.write(raw)
        try:
            text = _run("pdftotext", "-layout", path, "-")
        except (OSError, subprocess.CalledProcessError):
            return raw.decode("utf-8", "replace"), True, [PDF_FALLBACK]
        lowered = text.lower()
        marked = "scanned-pdf" in lowered or "ocr-required" in lowered
        if text.replace("\0", "").strip() and not marked:
            return text, False, []
        return _ocr(path, folder, raw)


def _docx_xml(raw: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            return archive.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None


@F.pandas_udf(StringType())
def docx_xml(content: pd.Series) -> pd.Series:
    return content.map(_docx_xml)


@F.pandas_udf(EXTRACTED)
def pdf_text(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_pdf(raw) for raw in content], columns=["text", "ocr_used", "warnings"])


def any_case(extension: str) -> str:
    """A glob for files with an extension in any spelling."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)


def read_files(
    spark: SparkSession, directory: str, root: str | None = None, kind: str | None = None
) -> DataFrame:
    """``path, content`` of the files of one kind, or of all kinds, below a directory that must lie
    inside ``root``. Names that start with ``_`` or ``.`` are hidden files and left out, as in
    every Spark source."""
    inside = assert_inside_root(directory, root or directory)
    wanted = [extension for extension, k in EXTENSIONS.items() if kind in (None, k)]
    parts = [
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", any_case(extension))
        .load(inside)
        for extension in wanted
    ]
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    return files.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), "content")


def extract_revisions(markdown: DataFrame, docx: DataFrame, pdf: DataFrame) -> DataFrame:
    """Revisions of the files of each kind (``path, content``).

    Markdown is decoded natively. DOCX and PDF go through Arrow-batched helpers, each only on its
    own files, so every file is read once.
    """
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    none = F.array().cast("array<string>")

    def part(files: DataFrame, kind: str, text: Column, ocr: Column, warnings: Column) -> DataFrame:
        return files.select(
            "path", F.lit(kind).alias("source_type"), "content", text.alias("text"),
            ocr.alias("ocr"), warnings.alias("found"),
        )

    xml = docx_xml("content")
    markdown = part(markdown, "markdown", raw, F.lit(False), none)
    docx = part(
        docx,
        "docx",
        F.coalesce(T.word_xml_to_text(xml), raw),
        F.lit(False),
        F.when(xml.isNull(), F.array(F.lit(DOCX_FALLBACK))).otherwise(none),
    )
    extracted = pdf.withColumn("_e", pdf_text("content"))
    pdf = part(extracted, "pdf", F.col("_e.text"), F.col("_e.ocr_used"), F.col("_e.warnings"))
    found = markdown.unionByName(docx).unionByName(pdf)
    text, kind = F.col("text"), F.col("source_type")
    return found.select(
        F.col("path").alias("source_path"),
        "source_type",
        F.sha2("content", 256).alias("content_sha256"),
        T.normalize_text(text).alias("text"),
        (F.col("ocr") | T.scanned_pdf(text, kind)).alias("ocr_used"),
        T.extraction_warnings(text, kind, F.col("found")).alias("warnings"),
    )


def read_revisions(spark: SparkSession, directory: str, root: str | None = None) -> DataFrame:
    kinds = ("markdown", "docx", "pdf")
    return extract_revisions(*(read_files(spark, directory, root, kind) for kind in kinds))




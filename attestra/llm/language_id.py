"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter n-grams. Each language is clustered into a
few centroids (spherical k-means in numpy, fitted on at most about ``SAMPLE_PER_LANGUAGE`` rows a
language); a text gets the language of the centroid with the largest cosine. Texts farther from all
centroids than the training texts of the winning language usually are get ``rejected``.

Defined results: null texts and texts without a letter get ``und`` and score 0. Documents with a
null language or id are not learned from. Repeated ids are judged row by row. Without any training
row every text gets ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import id_and_text, small_batches, text_bytes, text_slices
from attestra.llm.samples import bounded_sample, fit_in_task, with_texts

BITS = 12
DIMENSIONS = 1 << BITS
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 3
UNKNOWN = "und"

# Letters (A-Z lower-cased, bytes above 0x7F) stay, all else is a blank.
LETTERS = np.full(256, 0x20, np.uint32)
for _code in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    LETTERS[_code] = _code
for _code in range(0x41, 0x5B):
    LETTERS[_code] = _code + 32


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed 2- and 3-byte runs per row, as a dense matrix."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    counts = np.zeros(n * DIMENSIONS, np.float32)
    codes = LETTERS[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    for size in (2, 3):
        if len(codes) < size:
            continue
        value = codes[: len(codes) - size + 1].copy()
        for step in range(1, size):
            value = (value << np.uint32(8)) | codes[step : len(codes) - size + 1 + step]
        value += np.uint32(size << 28)
        slot = (value * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        whole = row[: len(value)] == row[size - 1 :]
        counts += np.bincount((row[: len(value)] + slot)[whole], minlength=len(counts)).astype(np.float32)
    return counts.reshape(n, DIMENSIONS)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def cluster(vectors: np.ndarray, wanted: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means, started from rows far apart."""
    chosen = [vectors.mean(axis=0)]
    for _ in range(min(wanted, len(vectors)) - 1):
        nearest = (vectors @ unit_rows(np.array(chosen)).T).max(axis=1)
        chosen.append(vectors[int(nearest.argmin())])
    centroids = unit_rows(np.array(chosen))
    for _ in range(rounds):
        owner = (vectors @ centroids.T).argmax(axis=1)
        means = [
            vectors[owner == c].mean(axis=0) if (owner == c).any() else centroids[c]
            for c in range(len(centroids))
        ]
        centroids = unit_rows(np.array(means))
    return centroids


class LanguageModel:
    def __init__(self, texts: list[str], languages: list[str], frequencies: np.ndarray, total: int):
        """``frequencies``: in how many of ``total`` texts each hashed run occurs."""
        self.languages = sorted(set(languages))
        counts = np.concatenate(
            [ngram_counts(pa.array(texts[i : i + 64], pa.string())) for i in range(0, len(texts), 64)]
            or [np.zeros((0, DIMENSIONS), np.float32)]
        )
        self.idf = np.log((1 + total) / (1 + frequencies)).astype(np.float32) + 1
        vectors, labels = self.vectors(counts), np.array(languages)
        rows = [cluster(vectors[labels == name], CENTROIDS) for name in self.languages]
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.centroids = np.concatenate(rows).astype(np.float32) if rows else None
        self.least = np.zeros(len(rows))
        for i, name in enumerate(self.languages):
            own = (vectors[labels == name] @ self.centroids[self.owner == i].T).max(axis=1)
            self.least[i] = np.quantile(own, 0.01)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts) * self.idf)

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        n = len(texts)
        seen = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        if self.centroids is None:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        cosine = self.vectors(ngram_counts(texts)) @ self.centroids.T
        best = cosine.argmax(axis=1)
        winner = self.owner[best]
        score = np.where(seen, np.clip(cosine[np.arange(n), best], 0, 1), 0.0).astype(np.float64)
        names = [self.languages[w] if s else UNKNOWN for w, s in zip(winner, seen)]
        return names, score, ~seen | (score < self.least[winner])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed run occurs, over all rows, and the number of rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in text_slices(batches):
            for start in range(0, batch.num_rows, 64):
                part = ngram_counts(batch.column("text").slice(start, 64))
                counts[:-1] += (part > 0).sum(axis=0)
                counts[-1] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(counts)], ["place", "n"])

    found = np.zeros(DIMENSIONS + 1, np.int64)
    for row in docs.select("text").mapInArrow(task, "place long, n long").groupBy("place").sum("n").collect():
        found[row[0]] = row[1]
    return found[:-1], int(found[-1])


def train_language_model(docs: DataFrame) -> LanguageModel:
    """``docs``: id, text, lang of the rows that may be learned from. Frequencies are counted over all
    of them, centroids fitted on the sample."""
    docs = docs.dropna()
    frequencies, total = document_frequencies(docs)
    chosen = bounded_sample(docs.select("id", "lang"), "lang", SAMPLE_PER_LANGUAGE)
    sample = with_texts(chosen, docs.drop("lang"))
    model = LanguageModel.__new__(LanguageModel)
    model.__dict__.update(fit_in_task(sample, lambda c: vars(LanguageModel(c["text"], c["lang"], frequencies, total))))
    return model


def identify_language(
    docs: DataFrame,
    train_where: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """One row per document row: id, lang_pred, score (cosine), rejected. ``train_where`` (over the
    given columns) says which rows may be learned from."""
    small_batches(docs.sparkSession)
    train = docs if train_where is None else docs.filter(train_where)
    model = train_language_model(
        train.select(
            F.col(id_column).cast("long").alias("id"),
            F.col(text_column).cast("string").alias("text"),
            F.col(lang_column).cast("string").alias("lang"),
        )
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, score, rejected = model.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                ["id", "lang_pred", "score", "rejected"],
            )

    return id_and_text(docs, id_column, text_column).mapInArrow(
        task, "id long, lang_pred string, score double, rejected boolean"
    )

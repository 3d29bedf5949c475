"""Helpers the operators of this package share: Arrow batches, words, shingles, stored steps."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import checkpoint_directory, small_batches as small_batches

SLICE_BYTES = 2 << 20
ROWS_A_TASK = 1 << 16

# A word is a run of digits, a-z and bytes above 0x7F once A-Z are lower-cased. Zero separates.
WORD_BYTES = np.zeros(256, np.uint8)
for _code in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    WORD_BYTES[_code] = _code
for _code in range(0x41, 0x5B):
    WORD_BYTES[_code] = _code + 32

# Random odd multipliers of the word hash, drawn once from a fixed seed.
_draw = np.random.default_rng(20240229)
BYTE_CODES = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODES[0] = 0
BASE = int(_draw.integers(1, 2**62)) * 4 + 1
UNBASE = pow(BASE, -1, 2**64)
SHINGLE_BASE = np.uint64(int(_draw.integers(1, 2**62)) * 4 + 3)


def process_store() -> dict:
    """A dictionary that lives as long as the Python worker.

    Task functions are unpickled for every task, so their own globals do not outlive one.
    """
    name = "_attestra_llm_store"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.store = {}
        sys.modules[name] = module
    return sys.modules[name].store


def cut(frame: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and read it from there."""
    checkpoint_directory(frame.sparkSession)
    return frame.checkpoint(eager=True)


def in_few_tasks(stored: DataFrame, rows: int) -> DataFrame:
    """A stored frame of ``rows`` narrow rows, read by no more tasks than these rows need. Each task of
    each job costs the driver memory, and a session may fix a large number of partitions."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.coalesce(max(cores, -(-rows // ROWS_A_TASK)))


def id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names."""
    return docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )


def crc_remainder(id_column: Column, modulus: int) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``most`` bytes of text; a longer row is alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and the offset of every row, with one more at the end."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: int, n: int, name: str) -> np.ndarray:
    store = process_store()
    have = store.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        grown = np.full(size, np.uint64(base))
        grown[0] = 1
        have = store[name] = np.multiply.accumulate(grown)
    return have[:n]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Words:
    """The words of some texts: hash, first and last byte, and the words of row r are
    ``bounds[r]:bounds[r+1]``."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        low = WORD_BYTES[self.data]
        n = len(low)
        inside = low != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        rows = self.offsets[:-1][self.offsets[:-1] < n]
        begins[rows] = inside[rows]
        self.low = low
        self.starts = np.flatnonzero(begins)
        ends = inside
        ends[:-1] &= ~(inside[1:] & ~begins[1:])
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        if len(self.starts):
            terms = BYTE_CODES[low] * powers(BASE, n, "powers")
            sums = np.add.reduceat(terms, self.starts)
            self.hash = mix(sums * powers(UNBASE, n, "unpowers")[self.starts])
        else:
            self.hash = np.zeros(0, np.uint64)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, index: int) -> bytes:
        return self.low[self.starts[index] : self.ends[index]].tobytes()

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words and their rows; a row with fewer words, but not
        none, has the run of all its words."""
        n, rows = len(self.hash), self.row_of_word()
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = self.hash.copy()
        for step in range(1, size):
            total *= SHINGLE_BASE
            total[: n - step] += self.hash[step:]
        last = np.arange(n) + size - 1
        whole = last < self.bounds[rows + 1]
        hashes, owners = [mix(total[whole])], [rows[whole]]
        counts = np.diff(self.bounds)
        for row in np.flatnonzero((counts > 0) & (counts < size)):
            value = int(counts[row])
            for h in self.hash[self.bounds[row] : self.bounds[row + 1]].tolist():
                value = (value * int(SHINGLE_BASE) + h) % (1 << 64)
            hashes.append(mix(np.array([value], np.uint64)))
            owners.append(np.array([row]))
        return np.concatenate(hashes), np.concatenate(owners)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for a list of single lower-case words."""
    return Words(pa.array([w.decode() for w in words], pa.string())).hash

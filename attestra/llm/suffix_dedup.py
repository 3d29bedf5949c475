"""Byte strings of ``length`` bytes that start more than once, removed everywhere.

The plan is that of difference-cover suffix sorting - name sampled positions, recurse on names, merge
the remaining starts, compare neighbours with equal prefixes - with two changes that keep the data
moved in proportion to a fraction of the text. The sample is chosen by content: a start's sampled
position is the smallest hash of the 16-byte runs inside its ``length`` bytes, so equal strings have it
at the same distance, which is what a difference cover guarantees. And names are fingerprints of
substrings instead of ranks of sorted triples, so equal prefixes become neighbours by grouping on their
names, a hot name is counted before it is shuffled, and one round names any length.

Starts with a common sampled position form blocks of ``WIDTHS[0]`` distances. A block has two names: of
its core (the bytes all starts of the block cover) and of its union (all bytes its starts cover). A
block whose core is nowhere else has no repeated start; blocks with equal unions repeat whole. Where
equal cores have different unions, one representative of each union goes to the next level, which
cuts it into narrower blocks; at the last level a block is a single start and the verdict is exact.

A start is known by document id (for a null id a hash of the text), a check of the text, and position. Union names have 128 bits. Defined
results: a null or empty text has no bytes. Shorter texts than ``length`` lose nothing. Rows that repeat
an id and its text hold the same strings twice and lose them. Null ids take part like others. Kept bytes
need not be valid UTF-8. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import (
    BASE,
    BYTE_CODES,
    UNBASE,
    cut,
    id_and_text,
    mix,
    powers,
    small_batches,
    text_bytes,
    text_slices,
)

LENGTH = 400
SAMPLE = 16
WIDTHS = (128, 16, 1)
SECOND_BASE = (BASE * BASE * 5 + 8) % (1 << 64) | 5
SECOND_UNBASE = pow(SECOND_BASE, -1, 1 << 64)
SLICE = 1 << 20
# Set in the hash of its text that stands for a null id, which cannot be joined on.
NO_ID = -(1 << 63)

BLOCKS = "core long, u1 long, u2 long, id long, check int, start int, size int, reach int"
COLUMNS = [part.split()[0] for part in BLOCKS.split(", ")]


class Fingerprints:
    """Hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        codes = BYTE_CODES[data]
        self.sums, self.unpowers = [], []
        for base, unbase, name in ((BASE, UNBASE, ""), (SECOND_BASE, SECOND_UNBASE, "2")):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * powers(base, n, "powers" + name), out=total[1:])
            self.sums.append(total)
            self.unpowers.append(powers(unbase, n + 1, "unpowers" + name))

    def of(self, start: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        return (sums[start + size] - sums[start]) * self.unpowers[which][start]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row, from minima within fixed stretches."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    padded = padded.reshape(-1, width)
    onward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], onward[width - 1 : n])


def sampled_positions(prints: Fingerprints, n: int, length: int) -> np.ndarray:
    """For every start the sampled position within its ``length`` bytes."""
    runs = n - SAMPLE + 1
    starts = np.arange(runs, dtype=np.uint64)
    hashed = mix(prints.of(np.arange(runs), SAMPLE))
    keyed = (hashed & np.uint64(0xFFFFFFFF00000000)) | starts
    return (window_minimum(keyed, length - SAMPLE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def name_blocks(
    prints: Fingerprints, start: np.ndarray, sampled: np.ndarray, piece: np.ndarray, width: int, length: int
) -> dict[str, np.ndarray]:
    """Blocks of consecutive ``start`` values of one piece with a common sampled position and
    distance block: names, first start, number of starts, distance to the sampled position."""
    number = (sampled - start) // width
    edge = np.ones(len(start), bool)
    edge[1:] = (
        (sampled[1:] != sampled[:-1]) | (number[1:] != number[:-1]) | (piece[1:] != piece[:-1])
    )
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(start)))
    at, spot, number = start[first], sampled[first], number[first].astype(np.uint64)
    salt = mix(number * np.uint64(1024) + np.uint64(width))
    core = mix(prints.of(spot - number.astype(np.int64) * width, length - width + 1) + salt)
    covered = size + length - 1
    salt = mix(size.astype(np.uint64) + np.uint64(1 << 20) * np.uint64(width))
    return {
        "core": core.view(np.int64),
        "u1": mix(prints.of(at, covered) + salt).view(np.int64),
        "u2": mix(prints.of(at, covered, 1) ^ salt).view(np.int64),
        "piece": piece[first],
        "start": at,
        "size": size,
        "reach": spot - at,
    }


def block_rows(found: dict[str, np.ndarray], ids: np.ndarray, checks: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found[c]) for c in ("core", "u1", "u2")]
        + [pa.array(ids), pa.array(checks, pa.int32())]
        + [pa.array(x.astype(np.int32)) for x in (start, found["size"], found["reach"])],
        COLUMNS,
    )


def text_check() -> Column:
    """31 bits of the text, which tell rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return F.shiftright(F.crc32(text), 1).cast("int")


def document_blocks(docs: DataFrame, length: int) -> DataFrame:
    """The blocks of all starts of all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            data, offsets = text_bytes(batch.column("text"))
            if len(data) < length:
                continue
            prints = Fingerprints(data)
            sampled = sampled_positions(prints, len(data), length)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[: len(sampled)]
            start = np.flatnonzero(np.arange(len(sampled)) + length <= offsets[1:][row])
            if not len(start):
                continue
            found = name_blocks(prints, start, sampled[start], row[start], WIDTHS[0], length)
            raw = data.tobytes()
            checks = batch.column("check").to_numpy()
            owner = found["piece"]
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield block_rows(found, ids[owner], checks[owner], found["start"] - offsets[owner])

    return docs.mapInArrow(task, BLOCKS)


def piece_blocks(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Narrower blocks of stored pieces (id, check, start, size, reach, bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "bytes", SLICE):
            size = batch.column("size").to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size + length - 1)])[:-1]
            piece = np.repeat(np.arange(len(size)), size)
            within = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
            start = offsets[piece] + within
            sampled = (offsets + batch.column("reach").to_numpy())[piece]
            found = name_blocks(Fingerprints(data), start, sampled, piece, width, length)
            owner = found["piece"]
            first = batch.column("start").to_numpy()[owner] + found["start"] - offsets[owner]
            yield block_rows(
                found, batch.column("id").to_numpy()[owner], batch.column("check").to_numpy()[owner], first
            )

    return pieces.mapInArrow(task, BLOCKS)


def resolve(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts that repeat, blocks to look at more closely)."""
    names = ["core", "u1", "u2"]
    cores = cut(blocks.groupBy("core").count().filter("count > 1").select("core"))
    blocks = cut(blocks.join(cores, "core"))
    classes = cut(
        blocks.groupBy(*names).agg(
            F.count("*").alias("n"), F.min(F.struct("id", "check", "start", "size", "reach")).alias("one")
        )
    )
    repeated = blocks.join(classes.filter("n > 1").select(*names), names)
    mixed = cut(
        classes.groupBy("core")
        .agg(F.count("*").alias("unions"), F.min("n").alias("least"))
        .filter("unions > 1 AND least = 1")
        .select("core")
    )
    closer = classes.join(mixed, "core").select("one.*")
    return repeated.select("id", "check", "start", "size"), cut(closer)


PIECES = "id long, check int, start int, size int, reach int, bytes binary"


def cut_pieces(docs: DataFrame, closer: DataFrame, length: int) -> DataFrame:
    """The bytes of the blocks to look at, taken from their documents."""
    wanted = closer.groupBy("id", "check").agg(F.collect_set(F.struct("start", "size", "reach")).alias("parts"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("id", "check", "text", "parts"))
            for owner, check, text, parts in zip(*columns):
                raw = (text or "").encode()
                out += [
                    {**part, "id": owner, "check": check,
                     "bytes": raw[part["start"] : part["start"] + part["size"] + length - 1]}
                    for part in parts
                ]
            yield pa.RecordBatch.from_pylist(out, schema=ARROW_PIECES)

    # A row repeated as a whole has the pieces of one row.
    return (
        docs.join(wanted.hint("shuffle_hash"), ["id", "check"])
        .mapInArrow(task, PIECES)
        .dropDuplicates(["id", "check", "start", "size"])
    )


ARROW_PIECES = pa.schema(
    [("id", pa.int64())]
    + [(name, pa.int32()) for name in ("check", "start", "size", "reach")]
    + [("bytes", pa.binary())]
)


def narrower_pieces(pieces: DataFrame, closer: DataFrame, length: int) -> DataFrame:
    """The parts of stored pieces that ``closer`` blocks are."""
    parts = closer.select(
        F.col("id").alias("_id"),
        F.col("check").alias("_check"),
        F.col("start").alias("_start"),
        F.col("size").alias("_size"),
        F.col("reach").alias("_reach"),
    )
    within = (
        (F.col("id") == F.col("_id"))
        & (F.col("check") == F.col("_check"))
        & (F.col("_start") >= F.col("start"))
        & (F.col("_start") < F.col("start") + F.col("size"))
    )
    first = F.col("_start") - F.col("start") + 1
    return pieces.join(parts, within).select(
        "id",
        "check",
        F.col("_start").alias("start"),
        F.col("_size").alias("size"),
        F.col("_reach").alias("reach"),
        F.substring("bytes", first, F.col("_size") + length - 1).alias("bytes"),
    )


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(id, check, start, size): runs of starts whose string starts elsewhere too."""
    found, closer = resolve(document_blocks(docs, length))
    pieces = None
    for width in WIDTHS[1:]:
        if closer.isEmpty():
            break
        if pieces is None:
            pieces = cut(cut_pieces(docs, closer, length))
        else:
            pieces = narrower_pieces(pieces, closer, length)
        more, closer = resolve(piece_blocks(pieces, width, length))
        found = found.unionByName(more)
    return found


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document row: id, kept (binary), n_bytes, n_removed, spans (byte ranges)."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs, id_column, text_column).withColumn("unnamed", F.col("id").isNull())
    stand_in = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(NO_ID))
    docs = docs.withColumns({"id": F.coalesce("id", stand_in), "check": text_check()})
    starts = repeated_starts(docs, length)
    # A group is one text: documents without an id, or that share one, do not meet here. Copies among
    # them have the same runs.
    runs = starts.groupBy("id", "check").agg(F.collect_set(F.struct("start", "size")).alias("runs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            kept, totals, spans = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs")):
                raw = (text or "").encode()
                edges = np.zeros((0, 2), np.int64)
                if runs.is_valid:
                    values = runs.values
                    start, size = (values.field(i).to_numpy() for i in range(2))
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + size + length - 1, -1)
                    covered = np.cumsum(change)[:-1] > 0
                    steps = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                    edges = np.flatnonzero(steps).reshape(-1, 2)
                outer = np.concatenate([[0], edges.ravel(), [len(raw)]]).reshape(-1, 2).tolist()
                kept.append(b"".join([raw[a:b] for a, b in outer]))
                totals.append(len(raw))
                spans.append(edges.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("unnamed"),
                    pa.array(kept, pa.binary()),
                    pa.array(totals, pa.int64()),
                    pa.array([t - len(k) for t, k in zip(totals, kept)], pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                ],
                ["id", "unnamed", "kept", "n_bytes", "n_removed", "spans"],
            )

    out = docs.join(runs.hint("shuffle_hash"), ["id", "check"], "left").mapInArrow(
        task, "id long, unnamed boolean, kept binary, n_bytes long, n_removed long, spans array<array<long>>"
    )
    return out.withColumn("id", F.when(~F.col("unnamed"), F.col("id"))).drop("unnamed")

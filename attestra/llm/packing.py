"""Order-preserving packing of token streams into windows of at most ``size`` tokens.

Each task packs the documents of its partition in the order it reads them, so nothing is shuffled.
Windows are cut by dynamic programming over document ends, sentence ends and, where neither comes
for a while, plain token positions. A window costs its padding, a cut inside a document costs a
truncation penalty. Padding is linear in the window's start, so the best start within reach is the
head of a monotone queue and a boundary costs constant time; lengths that need no padding (powers
of two) are looked up besides. The plan is made over segments of ``SEGMENT`` tokens; the last
``REPLANNED`` windows of a segment are planned again together with what follows, so memory stays
bounded by a segment and the longest document.

Defined results: a null or empty text is its end token alone. Repeated ids are packed as separate
documents. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from attestra.llm.common import (
    BASE,
    UNBASE,
    id_and_text,
    powers,
    process_store,
    small_batches,
    text_slices,
)

SEGMENT = 1 << 18
REPLANNED = 8
HARD_STEP = 256
SENTENCE_PENALTY = 48
HARD_PENALTY = 192
WINDOW_COST = 8
CACHED_PIECES = 250_000
CACHED_LENGTH = 64
TEXT_SLICE = 2 << 20


def printable_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


# Code points below this bound need no composition, and one character lower-cases to one.
PLAIN = 0x250
SPACE, LETTER, NUMBER, OTHER, UNUSUAL = range(5)
# The white space of the vocabulary's pattern below PLAIN, and its short forms.
BLANKS = (*range(9, 14), 32, 0x85, 0xA0)
SHORT_FORMS = ("s", "t", "m", "d", "re", "ve", "ll")


def plain_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case code of every code point below PLAIN."""
    kinds = np.full(PLAIN + 1, OTHER, np.uint8)
    lower = np.arange(PLAIN + 1, dtype=np.uint32)
    for code in range(PLAIN):
        low = chr(code).lower()
        category = unicodedata.category(chr(code))[0]
        if len(low) != 1:
            kinds[code] = UNUSUAL
            continue
        lower[code] = ord(low)
        kinds[code] = {"L": LETTER, "N": NUMBER}.get(category, OTHER)
    kinds[list(BLANKS)] = SPACE
    kinds[PLAIN] = UNUSUAL
    return kinds, lower


class TwoGenerations:
    """A bounded cache: what is asked for stays, what is not goes with the older half."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def values(self, keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        """The value of every key; ``make`` is called for those not known."""
        found = list(map(self.young.get, keys))
        for place in [i for i, value in enumerate(found) if value is None]:
            key = keys[place]
            value = self.old.get(key)
            found[place] = value = make(key) if value is None else value
            if len(key) <= CACHED_LENGTH:
                if len(self.young) >= self.limit:
                    self.old, self.young = self.young, {}
                self.young[key] = value
        return found


class WordTokens:
    """Token ids (unsigned, little-endian) of texts.

    The vocabulary cuts a text into words, single digits, short forms and runs of marks; no token
    crosses one of these pieces. All pieces of a slice of texts are found and hashed in numpy, each
    distinct one is looked up once, and only pieces never met before reach the library. Texts with
    characters outside the Latin blocks or with the vocabulary's special strings go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = TwoGenerations(CACHED_PIECES)
        self.shown = printable_bytes()
        self.kinds, self.lower = plain_tables()
        self.codes = np.random.default_rng(7).integers(1, 2**63, PLAIN + 1, dtype=np.uint64) * np.uint64(2)
        self.codes = self.codes[np.minimum(self.lower, PLAIN)] + np.uint64(1)
        # A lower case beyond PLAIN belongs to one character below it.
        far = np.flatnonzero(self.lower > PLAIN)
        self.codes[far] += np.uint64(2) * far.astype(np.uint64)
        self.codes[self.kinds == SPACE] = 0
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, index in vocabulary.items():
            core = piece.removesuffix("</w>")
            if piece != core and core and set(core) <= set(".!?"):
                self.sentence_end[index] = True

    def of_piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else "".join([self.shown[b] for b in piece.encode()])
        return array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()

    def of_any(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def starts(self, kinds: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        before = np.concatenate([[SPACE], kinds[:-1]])
        begins = (kinds != SPACE) & ((kinds != before) | (kinds == NUMBER))
        marks = np.flatnonzero(begins & (low == ord("'")))
        marks = marks[marks + 1 < len(low)]
        marks = marks[kinds[marks + 1] == LETTER]
        for form in SHORT_FORMS:
            fits = marks[marks + len(form) < len(low)]
            for place, letter in enumerate(form, 1):
                fits = fits[low[fits + place] == ord(letter)]
            begins[fits + 1] = False
            after = fits + 1 + len(form)
            after = after[after < len(low)]
            begins[after[kinds[after] == LETTER]] = True
        return np.flatnonzero(begins)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        code = np.minimum(code, PLAIN).astype(np.uint16)
        unusual = np.flatnonzero(self.kinds[code] == UNUSUAL)
        odd = set(np.searchsorted(ends, unusual, "right").tolist())
        if "<|" in joined:
            odd |= {i for i, text in enumerate(texts) if "<|" in text}
        for i in odd:
            code[ends[i] - lengths[i] : ends[i]] = ord(" ")
        kinds, low = self.kinds[code], self.lower[code]
        starts = self.starts(kinds, low)
        if len(starts):
            flat, counts = self.of_pieces(code, kinds, low, starts)
        else:
            flat, counts = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        until = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, ends)]
        found = np.split(flat, until[:-1])[: len(texts)]
        for i in odd:
            found[i] = self.of_any(texts[i])
        return found

    def of_pieces(
        self, code: np.ndarray, kinds: np.ndarray, low: np.ndarray, starts: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each piece has."""
        n = len(code)
        terms = self.codes[code]
        terms *= powers(BASE, n, "powers")
        hashes = np.add.reduceat(terms, starts) * powers(UNBASE, n, "unpowers")[starts]
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        text = low.astype("<u4").tobytes().decode("utf-32-le")
        begin = starts[first]
        # A piece ends at a blank or where the next one begins.
        stops = np.flatnonzero(kinds == SPACE)
        blank = np.append(stops, n)[np.searchsorted(stops, begin)]
        end = np.minimum(blank, np.append(starts, n)[first + 1])
        pieces = [text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        each = self.known.values(pieces, self.of_piece)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        offsets = np.cumsum(sizes) - sizes
        counts = sizes[which]
        places = np.repeat(offsets[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.frombuffer(b"".join(each), "<u4")[places], counts


def word_tokens(path: str) -> WordTokens:
    store = process_store()
    if path not in store:
        store[path] = WordTokens(path)
    return store[path]


def candidates(
    ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, hard_step: int = HARD_STEP
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end and the penalty of cutting there. ``ends``: document ends.
    No two neighbours are further apart than ``hard_step``."""
    known = np.minimum(ids, len(sentence_end) - 1)
    soft = np.flatnonzero(sentence_end[known]) + 1
    place = np.unique(np.concatenate([[0], soft, ends]))
    gaps = np.diff(place)
    wide = np.flatnonzero(gaps > hard_step)
    hard = [np.arange(place[i] + hard_step, place[i + 1], hard_step) for i in wide]
    hard = np.concatenate(hard) if hard else np.zeros(0, np.int64)
    every = np.concatenate([place, hard])
    cost = np.concatenate(
        [np.full(len(place), SENTENCE_PENALTY), np.full(len(hard), HARD_PENALTY)]
    )
    cost[: len(place)][np.isin(place, ends, assume_unique=True)] = 0
    cost[0] = 0
    order = np.argsort(every, kind="stable")
    return every[order], cost[order]


def free_starts(place: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Earlier boundaries at a distance that needs no padding, ``size`` or a power of two: those of
    boundary j are ``found[begin[j]:begin[j + 1]]``."""
    index = np.full(place[-1] + 1, -1, np.int64)
    index[place] = np.arange(len(place))
    ends, starts = [], []
    for length in {size, *(1 << k for k in range(size.bit_length()))}:
        later = np.searchsorted(place, length)
        at = index[place[later:] - length]
        hit = np.flatnonzero(at >= 0)
        ends.append(hit + later)
        starts.append(at[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    begin = np.searchsorted(ends[order], np.arange(len(place) + 1))
    return starts[order].tolist(), begin.tolist()


def cheapest_cuts(place: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indexes of the boundaries that end windows, the last boundary included."""
    free, begin = free_starts(place, size)
    at, fee = place.tolist(), penalty.tolist()
    best, came = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), increasing
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - size:
            queue.popleft()
        value, start = queue[0][0] + size - here, queue[0][1]
        for i in free[begin[j] : begin[j + 1]]:
            if best[i] < value:
                value, start = best[i], i
        value += fee[j] + WINDOW_COST
        best[j], came[j] = value, start
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


class Packer:
    """The documents of one task that still wait for a window."""

    COLUMNS = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")

    def __init__(self, size: int, sentence_end: np.ndarray, first_sequence: int, with_ids: bool):
        self.size, self.sentence_end, self.with_ids = size, sentence_end, with_ids
        self.sequence = first_sequence
        self.docs: list[list] = []  # id, all its tokens, tokens already packed
        self.waiting = 0

    def add(self, owner: int | None, tokens: np.ndarray) -> None:
        self.docs.append([owner, tokens, 0])
        self.waiting += len(tokens)

    def pieces(self, final: bool) -> list[tuple]:
        if not self.docs or not (final or self.waiting >= max(SEGMENT, 4 * REPLANNED * self.size)):
            return []
        ids = np.concatenate([tokens[done:] for _, tokens, done in self.docs])
        ends = np.cumsum([len(tokens) - done for _, tokens, done in self.docs])
        place, penalty = candidates(ids, ends, self.sentence_end, min(HARD_STEP, self.size))
        cuts = cheapest_cuts(place, penalty, self.size)
        if not final:
            cuts = cuts[:-REPLANNED]
        out, begin, current = [], 0, 0
        for cut in place[cuts].tolist():
            offset = 0
            while begin < cut:
                owner, tokens, done = self.docs[current]
                take = min(len(tokens) - done, cut - begin)
                piece = ids[begin : begin + take]
                out.append(
                    (owner, done, take, zlib.crc32(piece.tobytes()), len(tokens), self.sequence,
                     offset, piece.tolist() if self.with_ids else None)
                )
                begin, offset, self.docs[current][2] = begin + take, offset + take, done + take
                if done + take == len(tokens):
                    current += 1
            self.sequence += 1
        self.docs = self.docs[current:]
        self.waiting -= begin
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 4096,
    end_id: int = 2,
    with_ids: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset within the sequence, ids (null unless ``with_ids``). Sequences are padded to ``size``
    by their user, except where their length is a power of two."""
    small_batches(docs.sparkSession)
    schema = (
        "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, ids array<long>"
    )
    types = [*repeat(pa.int64(), 7), pa.list_(pa.int64())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_path)
        end = np.array([end_id], "<u4")
        first = TaskContext.get().partitionId() << 32
        packer = Packer(size, words.sentence_end, first, with_ids)

        def arrow(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, list(Packer.COLUMNS))

        for batch in text_slices(batches, most=TEXT_SLICE):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for owner, found in zip(batch.column("id").to_pylist(), words.ids(texts)):
                packer.add(owner, np.concatenate([found, end]))
                yield from arrow(packer.pieces(final=False))
        yield from arrow(packer.pieces(final=True))

    return id_and_text(docs, id_column, text_column).mapInArrow(task, schema)

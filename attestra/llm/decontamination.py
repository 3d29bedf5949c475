"""Benchmark passages in training documents.

The test items' words form a generalised suffix automaton. A document's words stream through it;
the length of the longest match ending at each word tells which words lie in a window of ``window``
consecutive item words (an item with fewer words is one window). Spans of hit words are reported,
and removed or the document rejected where they exceed the limit on coverage.

The automaton is built in each worker from a block of at most ``BLOCK_WORDS`` item words. Larger
benchmarks are split into blocks by item; each block scans the documents and only hits are grouped.

Defined results: null or empty texts have no words. Items with a null id or without words are
ignored; rows repeating an item id are one item with several texts. Document rows that repeat an id
are judged each by its own text. Empty documents or items give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Words, id_and_text, small_batches, text_slices

BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of the items' word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.following: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.windows: dict[int, set[int]] = {}
        self.whole: dict[int, set[tuple[int, int]]] = {}
        for item, words in items:
            state = 0
            for place, word in enumerate(words, 1):
                state = self.following[state][word]
                if place >= window:
                    self.windows.setdefault(self.shortened(state, window), set()).add(item)
                    state = self.shortened(state, window)
            if len(words) < window:
                self.whole.setdefault(self.shortened(state, len(words)), set()).add(
                    (len(words), item)
                )

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.following.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.following[target]))
        self.link[target] = copy
        while state >= 0 and self.following[state].get(word) == target:
            self.following[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.following[last].get(word)
        if target is not None:
            exact = self.length[target] == self.length[last] + 1
            return target if exact else self._split(last, word, target)
        made = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.following[state]:
            self.following[state][word] = made
            state = self.link[state]
        if state >= 0:
            target = self.following[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[made] = target if exact else self._split(state, word, target)
        return made

    def shortened(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what this state stands for."""
        while state and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[int], first: int, hit: np.ndarray, items: set[int]) -> int:
        """Stream words (all known ones) and mark the hit ones from ``first`` on; the longest
        match is returned."""
        following, link, lengths = self.following, self.link, self.length
        state = matched = longest = 0
        for place, word in enumerate(words, first + 1):
            while state and word not in following[state]:
                state = link[state]
                matched = lengths[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            longest = max(longest, matched)
            if matched >= self.window:
                hit[place - self.window : place] = True
                items |= self.windows[self.shortened(state, self.window)]
            if self.whole:
                above = state
                while above > 0:
                    for size, item in self.whole.get(above, ()):
                        if size <= matched:
                            hit[place - size : place] = True
                            items.add(item)
                    above = link[above]
        return longest


class Items:
    """A block of items, their vocabulary by hash, and the automaton."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.string()))
        self.vocabulary, known = np.unique(words.hash, return_inverse=True)
        bounds = words.bounds.tolist()
        lists = [known[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        items = [(item, found) for item, found in zip(ids, lists) if found]
        self.shortest = min([window, *(len(found) for _, found in items)])
        self.automaton = SuffixAutomaton(items, window)

    def matches(self, words: Words) -> Iterator[tuple[int, np.ndarray, set[int], int]]:
        """(row, hit words, items, longest match) of rows with a hit."""
        if not len(self.vocabulary) or not len(words.hash):
            return
        place = np.searchsorted(self.vocabulary, words.hash)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == words.hash
        # A word no item has resets the automaton, so only runs of known words are streamed.
        rows = words.row_of_word()
        opens = known.copy()
        opens[1:] &= ~(known[:-1] & (rows[1:] == rows[:-1]))
        starts = np.flatnonzero(opens)
        closes = known.copy()
        closes[:-1] &= ~(known[1:] & (rows[1:] == rows[:-1]))
        ends = np.flatnonzero(closes) + 1
        enough = ends - starts >= self.shortest
        found: dict[int, list] = {}
        for start, end in zip(starts[enough].tolist(), ends[enough].tolist()):
            row = int(rows[start])
            low, high = words.bounds[row], words.bounds[row + 1]
            hit, items, longest = found.get(row) or (np.zeros(high - low, bool), set(), 0)
            longest = max(
                longest,
                self.automaton.scan(place[start:end].tolist(), int(start - low), hit, items),
            )
            found[row] = [hit, items, longest]
        for row, (hit, items, longest) in found.items():
            if items:
                yield row, hit, items, longest


def spans_of(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


SCHEMA = (
    "id long, text string, n_words long, longest long, items array<long>, spans array<array<long>>"
)


def scan_block(docs: DataFrame, ids: list[int], texts: list[str], window: int, only_hits: bool) -> DataFrame:
    """Each document with its word count, longest match, items and spans of hit words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(ids, texts, window)
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            counts = np.diff(words.bounds)
            n = batch.num_rows
            longest, items, spans = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
            for row, hit, found, match in block.matches(words):
                longest[row], items[row], spans[row] = match, sorted(found), spans_of(hit)
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text"),
                    pa.array(counts, pa.int64()),
                    pa.array(longest, pa.int64()),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                ],
                ["id", "text", "n_words", "longest", "items", "spans"],
            )
            yield out.filter(pa.array([bool(x) for x in items])) if only_hits else out

    return docs.mapInArrow(task, SCHEMA)


def merged_spans(spans):
    """Sorted spans joined where they touch, as a column expression."""
    from pyspark.sql import types as T

    pair = T.ArrayType(T.LongType())

    def step(done, span):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (F.get(span, F.lit(0)) <= F.get(last, F.lit(1)))
        grown = F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), F.get(span, F.lit(1))))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(before, F.array(grown))).otherwise(
            F.concat(done, F.array(span))
        )

    empty = F.array().cast(T.ArrayType(pair))
    return F.aggregate(F.array_sort(spans), empty, step)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document row: id, text, n_words, longest, items, spans (word ranges), n_hit."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = id_and_text(docs, id_column, text_column)
    items = id_and_text(items, item_column, item_text_column).dropna().filter(F.length("text") > 0)
    # Bytes bound words: a block's texts on the driver stay within a few megabytes.
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // (2 * block_words)) or 1

    def block(number: int, only_hits: bool) -> DataFrame:
        chosen = items
        if blocks > 1:
            chosen = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        rows = chosen.orderBy("id").collect()
        return scan_block(docs, [r.id for r in rows], [r.text for r in rows], window, only_hits)

    if blocks == 1:
        found = block(0, only_hits=False)
    else:
        hits = block(0, only_hits=True)
        for number in range(1, blocks):
            hits = hits.unionByName(block(number, only_hits=True))
        # Rows with the same id and text have the same hits, so a digest of both is the key.
        key = F.sha2(F.concat_ws("\n", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text")), 256)
        hits = hits.groupBy(key.alias("key")).agg(
            F.max("longest").alias("longest_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"),
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        )
        plain = scan_block(docs, [], [], window, only_hits=False)
        found = plain.withColumn("key", key).join(hits, "key", "left").select(
            "id",
            "text",
            "n_words",
            F.coalesce("longest_hit", "longest").alias("longest"),
            F.coalesce("all_items", "items").alias("items"),
            F.when(F.col("all_spans").isNull(), F.col("spans"))
            .otherwise(merged_spans(F.col("all_spans")))
            .alias("spans"),
        )
    size = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0))
    )
    return found.withColumn("n_hit", size)


def contaminated(found: DataFrame, percent: int = 5) -> DataFrame:
    """``found`` with the verdict: hit words are at least ``percent`` of all words."""
    return found.withColumn(
        "contaminated",
        (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")),
    )


def without_spans(found: DataFrame, most: int = 0) -> DataFrame:
    """``found`` with spans of more than ``most`` words cut out of the texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                long = [s for s in spans if s[1] - s[0] > most]
                if not long:
                    continue
                raw, base, first = texts[row].encode(), words.offsets[row], words.bounds[row]
                kept, done = [], 0
                for start, end in long:
                    kept.append(raw[done : words.starts[first + start] - base])
                    done = words.ends[first + end - 1] - base
                texts[row] = b"".join([*kept, raw[done:]]).decode()
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return found.mapInArrow(task, found.schema)

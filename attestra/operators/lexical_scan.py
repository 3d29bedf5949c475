"""Best chunks per query straight from the postings, without a row per (query, chunk) pair.

The weights of a batch of queries are compressed rows: every asked term with its few queries. A task
adds, for the chunks of a batch, the rows of the terms each chunk holds, in pieces of bounded size, and
keeps a running best-k per query and ranking. A pair whose score is below its query's k-th best so far
goes no further, so at most k rows per query leave a task, however many chunks share its common words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestra.operators.topk import best_rows
from attestra.session import cut_lineage

# Weights of one pass: a row each for a query and a term of it.
WEIGHT_ROWS = 1_000_000
PAIRS = 2_000_000
BEST = "best"


def half_up(values: np.ndarray, decimals: int) -> np.ndarray:
    scale = 10.0**decimals
    return np.floor(values * scale + 0.5) / scale


class Weights:
    """Terms by queries, the weight a term adds to a query, as compressed rows."""

    def __init__(self, rows: list):
        self.queries = sorted({r["query_id"] for r in rows})
        self.terms = sorted({r["term"] for r in rows})
        column = {q: i for i, q in enumerate(self.queries)}
        line = {t: i for i, t in enumerate(self.terms)}
        of_term = np.array([line[r["term"]] for r in rows], np.int64)
        order = np.argsort(of_term, kind="stable")
        self.column = np.array([column[r["query_id"]] for r in rows], np.int64)[order]
        self.weight = np.array([r["weight"] for r in rows], float)[order]
        self.begin = np.searchsorted(of_term[order], np.arange(len(self.terms) + 1))
        self.totals = np.ones(len(self.queries))
        for r in rows:
            self.totals[column[r["query_id"]]] = r["query_weight"]

    def matched(self, terms: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunk, query and total weight of every pair that shares a term, for some chunks at a time."""
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        found = pc.index_in(terms.flatten(), value_set=pa.array(self.terms, pa.string()))
        found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(terms)), lengths)[found >= 0]
        found = found[found >= 0]
        sizes = self.begin[found + 1] - self.begin[found]
        many = len(self.queries)
        # Whole chunks with about PAIRS pairs and as many sums at a time.
        cost = np.concatenate([[0], np.cumsum(np.bincount(owner, sizes, len(terms)) + many)])
        chunk = 0
        while chunk < len(terms):
            until = max(chunk + 1, int(np.searchsorted(cost, cost[chunk] + PAIRS, side="right")) - 1)
            low, high = np.searchsorted(owner, [chunk, until])
            own, size = found[low:high], sizes[low:high]
            place = np.repeat(self.begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            spot = np.repeat(owner[low:high] - chunk, size) * many + self.column[place]
            total = np.bincount(spot, self.weight[place], (until - chunk) * many)
            pair = np.flatnonzero(total)
            yield pair // many + chunk, pair % many, total[pair]
            chunk = until


    def scores(
        self, query: np.ndarray, total: np.ndarray, length: np.ndarray, max_density: float, decimals: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Coverage and evidence of pairs."""
        base = total / self.totals[query]
        density = np.minimum(max_density, total / length)
        return half_up(np.minimum(1, base), decimals), half_up(np.minimum(1, base + base * density), decimals)


class Best:
    """Running best ``k`` per query: score, id and path."""

    def __init__(self, queries: int, k: int):
        nothing = np.zeros(0), np.zeros(0, "<U1"), np.zeros(0, object)
        self.k, self.kept = k, [nothing] * queries
        self.bar = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, chunk: np.ndarray, ids: np.ndarray, paths: np.ndarray) -> None:
        live = score >= self.bar[query]
        query, score, chunk = query[live], score[live], chunk[live]
        order = np.argsort(query, kind="stable")
        query, score, chunk = query[order], score[order], chunk[order]
        cuts = np.flatnonzero(np.diff(query, prepend=-1, append=-1)) if len(query) else []
        for low, high in zip(cuts, cuts[1:]):
            j, own = int(query[low]), chunk[low:high]
            scores, names, places = self.kept[j]
            scores, names = np.concatenate([scores, score[low:high]]), np.concatenate([names, ids[own]])
            places = np.concatenate([places, paths[own]])
            scores, names, rows = best_rows(scores, names, self.k, np.arange(len(scores)))
            self.kept[j] = scores, names, places[rows]
            if len(scores) == self.k:
                self.bar[j] = scores[-1]


def scan_block(
    postings: DataFrame,
    rows: list,
    query_type,
    k: int,
    methods: tuple[str, str],
    formula: tuple[float, float, int],
    bound: float,
) -> DataFrame:
    block = Weights(rows)
    max_density, min_length, decimals = formula
    ddl = f"query_id {query_type.simpleString()}, method string, chunk_id string, source_path string, score double"
    schema = pa.schema(
        [("query_id", to_arrow_type(query_type))]
        + [(c, pa.string()) for c in ("method", "chunk_id", "source_path")]
        + [("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(block.queries)
        kept = {method: Best(many, k) for method in methods}
        highest = np.full(many, -1.0)
        for batch in batches:
            ids = np.asarray(batch.column("chunk_id").to_pylist(), dtype=str)
            paths = np.asarray(batch.column("source_path").to_pylist(), dtype=object)
            length = np.maximum(min_length, batch.column("n_terms").to_numpy())
            for chunk, query, total in block.matched(batch.column("terms")):
                coverage, evidence = block.scores(query, total, length[chunk], max_density, decimals)
                np.maximum.at(highest, query, evidence)
                clears = coverage >= bound
                for method, scores in zip(methods, (coverage, evidence)):
                    kept[method].add(query[clears], scores[clears], chunk[clears], ids, paths)
        out = [
            (block.queries[j], method, i, p, s)
            for method, best in kept.items()
            for j, (scores, names, places) in enumerate(best.kept)
            for s, i, p in zip(scores.tolist(), names.tolist(), places.tolist())
        ]
        out += [(q, BEST, None, None, s) for q, s in zip(block.queries, highest.tolist()) if s >= 0]
        columns = zip(*out) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return postings.select("chunk_id", "source_path", "n_terms", "terms").mapInArrow(run, ddl)


def sum_block(postings: DataFrame, rows: list, query_type, formula: tuple[float, float, int]) -> DataFrame:
    block = Weights(rows)
    max_density, min_length, decimals = formula
    numbers = ("best", "second", "scored", "sum", "squares")
    ddl = f"query_id {query_type.simpleString()}, best double, second double, scored bigint, sum double, squares double"
    types = [pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema([("query_id", to_arrow_type(query_type)), *zip(numbers, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(block.queries)
        top = np.full((2, many), -np.inf)
        scored, units, squares = np.zeros(many, np.int64), np.zeros(many), np.zeros(many)
        for batch in batches:
            length = np.maximum(min_length, batch.column("n_terms").to_numpy())
            for chunk, query, total in block.matched(batch.column("terms")):
                _, evidence = block.scores(query, total, length[chunk], max_density, decimals)
                scored += np.bincount(query, minlength=many)
                units += np.bincount(query, evidence, many)
                squares += np.bincount(query, evidence * evidence, many)
                order = np.lexsort((-evidence, query))
                begin = np.flatnonzero(np.diff(query[order], prepend=-1))
                for place in (0, 1):
                    at = begin + place
                    at = at[at < np.append(begin[1:], len(order))[: len(at)]]
                    new = np.full(many, -np.inf)
                    new[query[order[at]]] = evidence[order[at]]
                    top = np.sort(np.vstack([top, new]), axis=0)[:0:-1]
        held = np.flatnonzero(scored)
        columns = [top[0], np.where(np.isinf(top[1]), np.nan, top[1]), scored, units, squares]
        arrays = [pa.array([block.queries[j] for j in held], schema[0].type)]
        arrays += [pa.array(c[held], t, from_pandas=True) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return postings.select("n_terms", "terms").mapInArrow(run, ddl)


def weight_blocks(weights: DataFrame, weight_rows: int) -> Iterator[list]:
    """Weights of whole queries, about ``weight_rows`` at a time."""
    # Few weights are read in one go; more are stored and taken block by block.
    rows = weights.limit(weight_rows + 1).collect()
    if len(rows) <= weight_rows:
        yield rows
        return
    weights = cut_lineage(weights)
    blocks = -(-weights.count() // weight_rows)
    for number in range(blocks):
        yield weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()


def scan_sums(
    postings: DataFrame, weights: DataFrame, formula: tuple[float, float, int], weight_rows: int = WEIGHT_ROWS
) -> DataFrame:
    """``query_id, best, second, scored, sum, squares`` of the evidence of every task's chunks."""
    query_type = weights.schema["query_id"].dataType
    parts = [sum_block(postings, rows, query_type, formula) for rows in weight_blocks(weights, weight_rows)]
    return reduce(DataFrame.unionByName, parts)


def scan_lists(
    postings: DataFrame,
    weights: DataFrame,
    k: int,
    methods: tuple[str, str],
    formula: tuple[float, float, int],
    bound: float = 0.0,
    weight_rows: int = WEIGHT_ROWS,
) -> DataFrame:
    """``query_id, method, chunk_id, source_path, score``: the best ``k`` of every task per query and
    ranking among chunks with at least ``bound`` coverage, and as method ``BEST`` the highest
    evidence of every task over all chunks.

    ``weights``: ``query_id, term, weight, query_weight``. One pass over the postings takes about
    ``weight_rows`` of them, ten thousand questions of a hundred terms; more take further passes.
    """
    query_type = weights.schema["query_id"].dataType
    parts = [
        scan_block(postings, rows, query_type, k, methods, formula, bound)
        for rows in weight_blocks(weights, weight_rows)
    ]
    return reduce(DataFrame.unionByName, parts)

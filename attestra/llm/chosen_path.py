"""Jaccard similarity join of word-shingle sets along chosen paths.

Documents with equal sets form a class, one member stands for it. A set is embedded as ``COORDINATES``
minimum hashes for each run, so that runs are independent. A run starts all sets at one node; a node picks one or two coordinates by its own hash
and sends every set to a child for the value it has there, so sets that share sampled tokens stay
together. Buckets of one set vanish, buckets of at most ``LIMIT`` sets are compared at once by their
embedding. In larger ones all sets are compared with one of them, drawn by hash, and linked to it if
similar; those clearly similar to it stop there, since the exact check meets its whole cluster (and what
is similar to them is, by the triangle inequality of the Jaccard distance, not far from the drawn one
either), the others are split again, up to ``DEPTH`` levels. So dense buckets empty quickly.
What is still together then joins as it is. Runs are repeated so that a pair at the threshold whose
buckets stay large down to the last level comes apart in all of them with a probability below one in a
thousand (``expected_recall``).

Candidate links give clusters; the sets of a cluster meet and are compared exactly, block against block
where a cluster is large, so neither a bucket nor a cluster is collected whole. Links are counted and
their components found; pairs are never written.

Defined results: a document without words has no set: it is its own group and has no links. One with
fewer words than a shingle has the set of its whole word sequence. Null ids are given back as their
own (null) group without links. Rows that repeat an id count as documents, and are one node of the
graph. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Words, cut, id_and_text, in_few_tasks, mix, small_batches, text_slices
from attestra.llm.components import connected_components

SHINGLE = 5
PERCENT = 80
COORDINATES = 32
RUNS = 8
FIRST_DEPTH = 2
DEPTH = 6
SECOND_CHOICE = 0.43
LIMIT = 64
CANDIDATE_MATCHES = 16  # of the 32 coordinates of a run; a pair at 0.8 agrees on fewer with probability 2e-5
CLOSE_MATCHES = 22  # of 32 coordinates: so near to the set drawn from a bucket that it speaks for both
BLOCK_SETS = 2048
BLOCK_SHINGLES = 1 << 21
PACK_SHINGLES = 1 << 18
STREAM_ROWS = 8192

COORDINATE_SEED = 77
CHILD = np.uint64(0x9E3779B97F4A7C15)


def expected_recall(similarity: float = PERCENT / 100, depth: int = DEPTH, runs: int = RUNS) -> float:
    """Probability that two sets are together in some bucket ``depth`` levels down. Within a run they
    agree on a fixed part of its coordinates; each run has its own."""
    n, parted = COORDINATES, 0.0
    for k in range(n + 1):
        together = 1.0
        for _ in range(depth):
            apart = 1 - together
            one = (k * apart + n - k) / n
            two = (k * (k - 1) * apart**2 + 2 * k * (n - k) * apart + (n - k) * (n - k - 1)) / (n * (n - 1))
            together = 1 - (1 - SECOND_CHOICE) * one - SECOND_CHOICE * two
        parted += comb(n, k) * similarity**k * (1 - similarity) ** (n - k) * (1 - together)
    return 1 - parted**runs


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes ordered by row, and the bounds of each row."""
    words = Words(texts)
    hashes, rows = words.shingles(SHINGLE)
    order = np.argsort(rows, kind="stable")
    return hashes[order], np.searchsorted(rows[order], np.arange(len(texts) + 1))


def embed(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """(id, digest, size, signature) of documents with a set; the signature holds all runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(COORDINATE_SEED)
        drawn = draw.integers(0, 2**63, (runs * COORDINATES, 2), dtype=np.uint64)
        masks, factors = drawn[:, 0], drawn[:, 1] * np.uint64(2) + np.uint64(1)
        for batch in text_slices(batches):
            hashes, bounds = shingle_sets(batch.column("text"))
            some = np.flatnonzero(np.diff(bounds) > 0)
            sets = [np.unique(hashes[bounds[row] : bounds[row + 1]]) for row in some]
            values = np.zeros((len(some), runs * COORDINATES), "<u2")
            if len(some):
                for i in range(runs * COORDINATES):
                    least = np.minimum.reduceat((hashes ^ masks[i]) * factors[i], bounds[:-1][some])
                    values[:, i] = mix(least) >> np.uint64(48)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(some)),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([x.tobytes() for x in values], pa.binary()),
                ],
                ["id", "digest", "size", "signature"],
            )

    return docs.mapInArrow(task, "id long, digest binary, size long, signature binary")


def signatures(column: pa.Array) -> np.ndarray:
    """Rows of ``COORDINATES`` values; several a set where its signature holds all runs."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


def children(nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent row, child node): one level down along each node's chosen coordinates."""
    choices = mix(nodes ^ CHILD)
    first = choices % np.uint64(COORDINATES)
    again = (choices >> np.uint64(20)) % np.uint64(1 << 20) < np.uint64(int(SECOND_CHOICE * (1 << 20)))
    step = np.uint64(1) + (choices >> np.uint64(44)) % np.uint64(COORDINATES - 1)
    rows = np.concatenate([np.arange(len(nodes)), np.flatnonzero(again)])
    spot = np.concatenate([first, ((first + step) % np.uint64(COORDINATES))[again]])
    value = values[rows, spot.astype(np.int64)].astype(np.uint64)
    return rows, mix(mix(nodes[rows] + CHILD * (spot + np.uint64(1))) + value)


PATHS = "node long, id long, signature binary"


def path_rows(nodes: np.ndarray, ids: pa.Array, marks: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes.view(np.int64)), ids.take(take), marks.take(take)], ["node", "id", "signature"]
    )


def first_paths(sets: DataFrame, runs: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = signatures(batch.column("signature"))  # row: set, then run
            roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * CHILD)
            nodes = np.tile(roots, batch.num_rows)
            owner = np.arange(len(values))
            for _ in range(FIRST_DEPTH):
                rows, nodes = children(nodes, values[owner])
                owner = owner[rows]
            ids = batch.column("id").take(pa.array(np.arange(len(values)) // runs))
            yield path_rows(nodes, ids, pa.array([x.tobytes() for x in values], pa.binary()), owner)

    return sets.select("id", "signature").mapInArrow(task, PATHS)


def longer_paths(paths: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_numpy().view(np.uint64)
            rows, nodes = children(nodes, signatures(batch.column("signature")))
            yield path_rows(nodes, batch.column("id"), batch.column("signature"), rows)

    return paths.select("node", "id", "signature").mapInArrow(task, PATHS)


def joined_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        fresh = label.copy()
        np.minimum.at(fresh, left, least)
        np.minimum.at(fresh, right, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def bucket_links(buckets: DataFrame) -> DataFrame:
    """Links (a, b) that span the similar sets of each small bucket."""

    def links(nodes: np.ndarray, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, nodes))
        nodes, ids, values = nodes[order], ids[order], values[order]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, LIMIT):
            near = np.flatnonzero(nodes[step:] == nodes[:-step])
            if not len(near):
                break
            agree = (values[near] == values[near + step]).sum(axis=1) >= CANDIDATE_MATCHES
            left.append(near[agree])
            right.append(near[agree] + step)
        label = joined_labels(len(ids), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                held.append(
                    (
                        batch.column("node").to_numpy(),
                        batch.column("id").to_numpy(),
                        signatures(batch.column("signature")),
                    )
                )
            if sum(len(x[0]) for x in held) >= STREAM_ROWS:
                nodes, ids, values = (np.concatenate(x) for x in zip(*held))
                done = int(np.searchsorted(nodes, nodes[-1]))  # the last bucket may go on
                if done:
                    yield links(nodes[:done], ids[:done], values[:done])
                held = [(nodes[done:], ids[done:], values[done:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    ordered = buckets.select("node", "id", "signature").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(task, "a long, b long")


def draw_key():
    """A different order of sets in every bucket."""
    return F.xxhash64("node", "id")


def agreement_with_drawn(large: DataFrame) -> DataFrame:
    """Large buckets with ``agree``: coordinates a set shares with the set drawn from its bucket."""
    drawn = large.filter(draw_key() == F.col("least")).select(
        F.col("node").alias("_node"), F.col("signature").alias("_drawn"), F.col("id").alias("drawn")
    )
    met = large.join(drawn, F.col("node") == F.col("_node"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, drawn = signatures(batch.column("signature")), signatures(batch.column("_drawn"))
                agree = pa.array((own == drawn).sum(axis=1), pa.int32())
                yield batch.drop_columns(["_drawn"]).append_column("agree", agree)

    columns = met.select("node", "id", "signature", "drawn", "_drawn")
    return columns.mapInArrow(task, "node long, id long, signature binary, drawn long, agree int")


def candidate_links(sets: DataFrame, runs: int) -> DataFrame:
    """Links that connect candidates; walks down the paths level by level."""
    paths, small, linked = first_paths(sets, runs), None, []
    for depth in range(FIRST_DEPTH, DEPTH + 1):
        sizes = paths.groupBy("node").agg(F.count("*").alias("n"), F.min(draw_key()).alias("least"))
        # Stored apart, so that the join is free to split the sets of a large bucket.
        sizes = cut(sizes.filter(F.col("n") > 1))
        crowd = F.when(F.col("n") > LIMIT, F.col("n"))
        nodes, rows, crowded = (x or 0 for x in sizes.agg(F.count("*"), F.sum("n"), F.sum(crowd)).first())
        together = in_few_tasks(cut(paths.join(in_few_tasks(sizes, nodes), "node")), rows)
        few = together.filter(F.col("n") <= LIMIT)
        small = few if small is None else small.unionByName(few)
        if not crowded:
            break
        large = in_few_tasks(cut(agreement_with_drawn(together.filter(F.col("n") > LIMIT))), crowded)
        near = F.lit(True) if depth == DEPTH else F.col("agree") >= CANDIDATE_MATCHES
        linked.append(large.filter(near).select(F.col("id").alias("a"), F.col("drawn").alias("b")))
        paths = longer_paths(large.filter(F.col("agree") < CLOSE_MATCHES))
    # Nodes of different levels differ, so the small buckets of all levels are compared in one pass.
    found = bucket_links(small)
    for links in linked:
        found = found.unionByName(links)
    return found


def exact_links(left: list, right: list, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with at least ``percent`` Jaccard similarity. ``same``: both sides are one
    block, and pairs come once."""
    sets = left if same else left + right
    sizes = np.array([len(x) for x in sets], np.int64)
    n = len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column) >= 2
    number = np.cumsum(shared) - 1
    kept = shared[column]
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = (n, n) if same else (len(left), len(right))
    common = np.zeros((a, b), np.float32)
    width = 2048
    for start in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [start, start + width])
        cells = np.zeros((n, width), np.float32)
        cells[row[low:high], column[low:high] - start] = 1
        common += cells @ cells.T if same else cells[:a] @ cells[a:].T
    one, other = sizes[:a], sizes if same else sizes[a:]
    near = 100 * common >= percent * (one[:, None] + other[None, :] - common)
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    return (i, j) if same else (i, j + a)


def first_of_each(table: pa.Table) -> pa.Array:
    """Rows ordered by cluster and id, without those that repeat an id and its set: one that comes from
    several tasks is a single member, whose weight counts its documents."""
    clusters, ids = table["cluster"].to_numpy(), table["id"].to_numpy()
    kept = np.ones(len(ids), bool)
    same = (clusters[1:] == clusters[:-1]) & (ids[1:] == ids[:-1])
    seen: set[bytes] = set()
    for row in (np.flatnonzero(same) + 1).tolist():
        if row == 1 or not same[row - 2]:
            seen = {table["shingles"][row - 1].as_py()}
        value = table["shingles"][row].as_py()
        kept[row] = value not in seen
        seen.add(value)
    return pa.array(np.flatnonzero(kept))


CONFIRMED = "id long, links long, parent long"


def confirm(percent: int):
    """Compares the sets of one group of the exact check: whole clusters, or two blocks of one."""

    def cluster(ids: np.ndarray, weights: np.ndarray, sides: np.ndarray, sets: list, same: bool) -> tuple:
        order = np.lexsort((ids, sides))
        ids, weights, sides = ids[order], weights[order], sides[order]
        sets = [sets[i] for i in order]
        cutoff = int(np.searchsorted(sides, 1))
        if not same and cutoff in (0, len(ids)):  # the other block is empty
            return (np.zeros(0, np.int64),) * 3
        i, j = exact_links(sets if same else sets[:cutoff], [] if same else sets[cutoff:], same, percent)
        counts = np.bincount(i, weights[j], minlength=len(ids)) + np.bincount(j, weights[i], minlength=len(ids))
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # labels follow the ids' order
        label = joined_labels(len(ids), rank[i], rank[j])
        return ids, counts.astype(np.int64), np.sort(ids)[label[rank]]

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()  # a whole cluster or a block with itself
        table = table.sort_by([("cluster", "ascending"), ("id", "ascending")]).combine_chunks()
        table = table.take(first_of_each(table))
        clusters, ids = table["cluster"].to_numpy(), table["id"].to_numpy()
        weights, sides = table["weight"].to_numpy(), table["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        edges = [*np.flatnonzero(np.r_[True, clusters[1:] != clusters[:-1]]).tolist(), len(ids)]
        parts = [
            cluster(ids[a:b], weights[a:b], sides[a:b], sets[a:b], same)
            for a, b in zip(edges, edges[1:])
            if b - a > 1
        ]
        columns = zip(*parts) if parts else ((), (), ())
        return pa.table(
            {
                name: pa.array(np.concatenate([np.zeros(0, np.int64), *column]))
                for name, column in zip(("id", "links", "parent"), columns)
            }
        )

    return solve


def exact_check(docs: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(id, links, parent) from comparing all sets of each cluster. ``classes``: id, size, weight."""
    members = cut(classes.select("id", "size", "weight", "digest").join(clusters, "id"))
    shapes = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    blocks = F.greatest(
        F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
    ).cast("int")
    shapes = cut(shapes.select("group", blocks.alias("blocks")))
    total = members.agg(F.sum("size")).first()[0] or 0
    packs = max(1, -(-total // PACK_SHINGLES))
    members = members.join(shapes, "group")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, bytes]] = set()  # rows that repeat an id and its text meet in one task
        for batch in text_slices(batches):
            hashes, bounds = shingle_sets(batch.column("text"))
            found = [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
            digests = pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary())
            out = pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "group", "weight", "blocks")] + [pa.array(found, pa.binary())],
                ["id", "group", "weight", "blocks", "shingles"],
            )
            own = pc.equal(digests, batch.column("digest")).to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_pylist()
            for row in np.flatnonzero(own).tolist():
                member = (ids[row], digests[row].as_py())
                own[row] = member not in sent
                sent.add(member)
            yield out.filter(pa.array(own))

    texts = docs.join(members.hint("shuffle_hash"), "id").mapInArrow(
        sets, "id long, group long, weight long, blocks int, shingles binary"
    )
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    # A set meets every block of its cluster: with its own block it is on one side, else on the side
    # its number gives.
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met")
    sent = texts.select("id", "group", "weight", "blocks", "shingles", block.alias("block"), met)
    whole = F.col("blocks") == 1
    sent = sent.select(
        F.col("group").alias("cluster"),
        "id",
        "weight",
        "shingles",
        (F.col("block") > F.col("met")).cast("int").alias("side"),
        F.when(whole, F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(F.col("group")).alias("k1"),
        F.when(whole, -1).otherwise(F.least("block", "met")).alias("k2"),
        F.when(whole, -1).otherwise(F.greatest("block", "met")).alias("k3"),
    )
    return sent.groupBy("k1", "k2", "k3").applyInArrow(confirm(percent), CONFIRMED)


def similar_groups(
    docs: DataFrame,
    percent: int = PERCENT,
    runs: int = RUNS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document row: id, class_id (smallest id with an equal set), group (smallest id of
    its component), n_links (documents of at least ``percent`` Jaccard similarity besides it)."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs, id_column, text_column)
    known = docs.filter(F.col("id").isNotNull())
    embedded = cut(embed(known, runs))
    classes = cut(
        embedded.groupBy("digest").agg(
            F.min("id").alias("id"),
            F.count("*").alias("weight"),
            F.first("size").alias("size"),
            F.first("signature").alias("signature"),
        )
    )
    clusters = connected_components(candidate_links(classes, runs))
    confirmed = cut(exact_check(known, classes, clusters, percent))
    groups = connected_components(confirmed.select(F.col("id").alias("a"), F.col("parent").alias("b")))
    links = confirmed.groupBy("id").agg(F.sum("links").alias("links"))
    described = cut(
        classes.select("id", "digest", "weight")
        .join(links, "id", "left")
        .join(groups, "id", "left")
        .select(
            "digest",
            F.col("id").alias("class_id"),
            F.coalesce("group", "id").alias("group"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        )
    )
    with_set = embedded.select("id", "digest").join(described, "digest").drop("digest")
    # Rows without a set are those the embedding left out.
    without = docs.filter(F.col("id").isNull() | ~has_words(F.col("text"))).select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("group"), F.lit(0).cast("long").alias("n_links")
    )
    return with_set.unionByName(without)


def has_words(text):
    return F.coalesce(text, F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")

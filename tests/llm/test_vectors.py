import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import vector_codes, whitening
from attestra.llm.queries import ORACLES, QUERIES
from checks import compare

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, code double"


def odd_vectors(n=60, dim=8, seed=3):
    """Nulls, non-finite and empty vectors, repeated rows, ties, another length, null ids and labels."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.integers(-3, 4, dim) / 4], int(rng.integers(3)) if i % 5 else None)
            for i in range(n)]
    rows += [(200, None, 1), (201, [], 1), (202, [math.nan] * dim, 1), (203, [math.inf] + [0.0] * (dim - 1), 1),
             (204, [None] + [0.0] * (dim - 1), None), (205, [0.5] * (dim - 1), 2)]
    rows += [rows[0], rows[0], (3, [0.25] * dim, 1), (None, [1.0] * dim, None), (None, [1.0] * dim, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "a", 7, None) for i, v, l in rows], SCHEMA).repartition(3)


def usable(rows, scale):
    kept = [(i, v, l) for i, v, l in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    most = max((len(v) for _, v, _ in kept), default=0)
    return [(i, [math.floor(scale * c) for c in v], l) for i, v, l in kept if len(v) == most]


# ---- codes --------------------------------------------------------------------------------------


def coded_by_hand(rows, parts, entries, rounds, scale):
    kept = usable(rows, scale)
    width = len(kept[0][1]) // parts
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[first[i][p * width : (p + 1) * width] for i in ids] for p in range(parts)]

    def nearest(v, p):
        piece = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = [[[] for _ in ids] for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                members[p][nearest(v, p)[1]].append(v[p * width : (p + 1) * width])
        books = [[[sum(c) // len(c) for c in zip(*m)] if m else e for m, e in zip(members[p], books[p])]
                 for p in range(parts)]
    out, totals = [], {}
    for i, v, label in kept:
        best = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in best)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    flat = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, c, e, totals[l]) for i, c, e, l in out), key=str), hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("parts, entries, rounds, labels", [(2, 16, 6, 1 << 18), (4, 5, 3, 0), (8, 1, 2, 1 << 18), (1, 200, 1, 0)])
def test_codes_equal_brute_force(spark, parts, entries, rounds, labels):
    rows = odd_vectors()
    got, books = vector_codes.compress_vectors(
        frame(spark, rows), parts, entries, rounds, label=F.col("label"), broadcast_labels=labels)
    want, digest = coded_by_hand(rows, parts, entries, rounds, 4096)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert books.digest() == digest


def test_orchard_search_finds_the_first_nearest_entry():
    rng = np.random.default_rng(9)
    for spread in (2, 50, 4000):
        book = rng.integers(-spread, spread, (16, 3))
        book[7] = book[2]
        points = np.concatenate([rng.integers(-spread, spread, (3000, 3)), book])
        entry, distance, measured = vector_codes.orchard_search(points, book, vector_codes.neighbour_lists(book))
        gaps = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (entry == gaps.argmin(1)).all() and (distance == gaps.min(1)).all()
        assert measured <= gaps.size
    # Points near their entries see a small part of the book.
    book = rng.integers(-10**6, 10**6, (200, 4))
    points = book[rng.integers(0, 200, 4000)] + rng.integers(-9, 10, (4000, 4))
    _, _, measured = vector_codes.orchard_search(points, book, vector_codes.neighbour_lists(book))
    assert measured < 0.3 * 4000 * 200


def test_decoding_gives_the_error(spark):
    rows = odd_vectors()
    got, books = vector_codes.compress_vectors(frame(spark, rows), 4, 8, 3)
    vectors = {}
    for i, v, _ in usable(rows, 4096):
        vectors.setdefault(i, []).append(v)
    for r in got.collect():
        restored = books.decode(np.frombuffer(bytes.fromhex(r.code), np.uint8)[None].astype(int))[0]
        assert r.error in [int(((np.array(v) - restored) ** 2).sum()) for v in vectors[r.id]]


def test_codes_of_nothing_and_bad_shapes(spark):
    got, books = vector_codes.compress_vectors(frame(spark, [(1, None, 1)]), 2)
    assert got.collect() == [] and books is None
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(frame(spark, odd_vectors(dim=7)), 2)
    with pytest.raises(Exception, match="reaches"):
        vector_codes.compress_vectors(frame(spark, [(1, [1e9], 1)]), 1)


def test_codes_query_equals_sql(spark):
    got = QUERIES["op11_vector_codes"](spark, SMALL).toPandas()
    want = compare.connect(SMALL).execute(ORACLES["op11_vector_codes"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.normalized(got) == compare.normalized(want)


# ---- whitening ----------------------------------------------------------------------------------


def check_whitening(rows, got, components, scale=256):
    kept = usable(rows, scale)
    distinct = np.array(sorted({tuple(v) for _, v, _ in kept}), np.int64)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(kept) * count
    for c in range(1, count + 1):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == c)
        wanted = [(i, v, (np.array(v) - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])) for i, v, _ in kept]
        sign = np.sign(sum(a * b for (_, _, _, a), (_, _, b) in zip(
            mine, sorted(wanted, key=lambda t: (t[0] is None, t[0] or 0, int(((n * np.array(t[1]) - sums) ** 2).sum()))))))
        want = sorted((i is None, i or 0, int(((n * np.array(v) - sums) ** 2).sum()), sign * w) for i, v, w in wanted)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        np.testing.assert_allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-9)
    for r in got:
        assert r.n == n and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.2]], 0) for i in range(80)]
    rows += odd_vectors(dim=6)[60:]
    got = whitening.whiten(frame(spark, rows)).withColumnRenamed("id", "vec_id").collect()
    check_whitening(rows, got, 4)


def test_whitening_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op12_whitening"](spark, SMALL).collect(), 4)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (2, [2.0, 4.0], 0)])).collect()
    assert sorted(round(abs(r.whitened), 12) for r in two) == [1.0, 1.0, 1.0]
    assert {(r.component, r.n, round(r.explained, 12)) for r in two} == {(1, 2, 1.0)}


def test_moments_are_exact(spark):
    rng = np.random.default_rng(8)
    matrix = rng.integers(-(2**25), 2**25, (40, 5))
    found = whitening.moments(spark.createDataFrame([(row.tolist(),) for row in matrix], "x array<int>").repartition(4))
    exact = [[int(c) for c in row] for row in matrix]
    sums = [sum(c) for c in zip(*exact)]
    assert found.sums == sums
    for i in range(5):
        for j in range(5):
            assert found.scaled[i][j] == sum((40 * r[i] - sums[i]) * (40 * r[j] - sums[j]) for r in exact) // 40
    fitted = whitening.Whitening(40, sums, np.eye(5), [])
    big = [sum((40 * c - s) ** 2 for c, s in zip(row, sums)) for row in exact]
    assert fitted.deviation(matrix) == [v if v < 2**63 else None for v in big]


def orthonormal(n, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    return q


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 2, 1, 0.5, 0.25],
    [3, 3 - 1e-9, 3 - 2e-9, 2, 1 + 1e-8, 1, 0.5, 0.1],
    [5, 5 - 1e-5, 5 - 2e-5, 5 - 3e-5, 5 - 4e-5, 1, 1e-7, 1e-9],
])
def test_clustered_eigenvalues_are_told_apart(values):
    q = orthonormal(len(values), 2)
    d = np.array([np.longdouble(str(v)) for v in values])
    got_values, got = whitening.refined_eigenvectors((q * d) @ q.T * 1000)
    np.testing.assert_allclose((got_values / 1000).astype(float), values, rtol=1e-15, atol=1e-17)
    # The angle a perturbation of one rounding makes: eps over the gap.
    gap = min(abs(d[i] - d[j]) for i in range(len(d)) for j in range(i))
    overlap = np.abs(got.T @ q)
    assert np.abs(overlap - np.eye(len(d))).max() < 100 * np.finfo(np.longdouble).eps * d[0] / gap


def test_equal_eigenvalues_keep_an_orthonormal_basis():
    q = orthonormal(6, 5)
    values, got = whitening.refined_eigenvectors((q * np.array([2, 2, 2, 1, 0, 0], np.longdouble)) @ q.T)
    assert np.abs(got.T @ got - np.eye(6)).max() < 1e-17
    np.testing.assert_allclose(values.astype(float), [2, 2, 2, 1, 0, 0], atol=1e-17)
    assert whitening.refined_eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]

"""Embedding whitening against exact fractions and plain eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pagescan.llm import whitening
from pagescan.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def plain(rows, components=16):
    """{row number: [(component, n, deviation, projection, explained)]} of (id, vector) rows, from fractions and eigh."""
    whole = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, (_, v) in enumerate(rows)
             if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    unique = sorted(set(whole.values()))
    n, dim = len(unique), len(unique[0])
    sums = [sum(u[k] for u in unique) for k in range(dim)]
    centred = [[Fraction(u[k] * n - sums[k], n) for k in range(dim)] for u in unique]
    cov = np.array([[float(sum(d[i] * d[j] for d in centred) / n) for j in range(dim)] for i in range(dim)])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for i, x in whole.items():
        d = np.array([float(Fraction(x[k] * n - sums[k], n)) for k in range(dim)])
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(dim))
        out[i] = [(c + 1, n, deviation, float(d @ vector[:, c]) / math.sqrt(value[c]), value[c] / np.trace(cov))
                  for c in range(min(components, dim))]
    return out


def check(got, rows):
    want = plain(rows)
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    ids = {rows[i][0]: w for i, w in want.items()}
    assert set(by_row) == set(ids)
    flip = {}
    for key, found in by_row.items():
        found.sort(key=lambda r: r.component)
        for r, (component, n, deviation, white, explained) in zip(found, ids[key], strict=True):
            assert (r.component, r.n, r.deviation) == (component, n, deviation)
            assert r.explained == pytest.approx(explained, rel=1e-9)
            assert 0 <= r.identity_error < 1e-9
            if abs(white) > 1e-3 and component not in flip:
                flip[component] = math.copysign(1, white * r.whitened)
            assert r.whitened == pytest.approx(flip.get(component, 1) * white, abs=1e-7)


def test_query_against_fractions(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    check(got, rows)


def test_odd_rows(spark, rng):
    rows = [(i, [rng.gauss(0, k + 1) for k in range(5)]) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 2.0, 3.0, 4.0]),
             (104, [1.0, float("nan"), 2.0, 3.0, 4.0]), (105, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (106, [-0.0, 0.0, -1e-9, 1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(3)
    rows = [(i, [float(np.float32(c)) if c is not None else None for c in v] if v else None) for i, v in rows]
    check(whitening.whiten(frame).collect(), rows)
    odd = frame.union(spark.createDataFrame([(200, [], None), (201, [1.0], None), (202, [3e38] * 5, None)], SCHEMA))
    assert {r.vec_id for r in whitening.whiten(odd).select("vec_id").collect()} == set(range(40)) | {100, 101, 106}


def test_null_and_repeated_ids_clashing_names_empty_table(spark):
    rows = [(None, [1.0, 2.0], 1), (7, [3.0, 5.0], 2), (7, [3.0, 5.0], 3), (8, [0.0, -4.0], 4)]
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(rows, SCHEMA).select(
        "*", *[F.lit(i).alias(c) for i, c in enumerate(["x", "n", "component", "whitened", "_keep", "dim", "at", "i", "j", "v"])])
    got = whitening.whiten(frame).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n) for r in got) == [
        (False, 7, 1, 3), (False, 7, 1, 3), (False, 7, 2, 3), (False, 7, 2, 3), (False, 8, 1, 3), (False, 8, 2, 3),
        (True, 0, 1, 3), (True, 0, 2, 3)]
    kept = whitening.whiten(frame, keep=["vec_id", "label", "x"])
    assert kept.columns[:3] == ["vec_id", "label", "x"] and kept.count() == 8
    assert whitening.whiten(frame.limit(0)).count() == 0


def test_components_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained) for r in whitening.whiten(one).collect()} == {
        (1, 1, 0, None, None), (2, 1, 0, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {round(r.explained, 9) for r in got} == {1.0, 0.0}


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [1e12 * i, 3.0 * i]) for i in range(4)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(v[k] for v in x) for k in range(2)]
    want = [sum((4 * v[k] - sums[k]) ** 2 for k in range(2)) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    assert got == {i: w if w < 2 ** 63 else None for i, w in enumerate(want)}


def turned(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    list(range(1, 41)), [1.0] * 6 + [2.0] * 6 + [5.0], [1 + 1e-9 * k for k in range(8)] + [3, 3 + 1e-12, 7],
    [10.0 ** -k for k in range(12)], [1.0], [2.0, 2.0], [0.0, 0.0, 1.0]])
def test_refined_eigenvectors(values):
    matrix = turned(values)
    matrix = (matrix + matrix.T) / 2
    value, vector = whitening.eigen(matrix)
    norm = max(values)
    assert np.abs(np.sort(values)[::-1] - value).max() < 1e-14 * norm * len(values)
    assert np.abs(vector.T @ vector - np.eye(len(values))).max() < 1e-14
    assert np.abs(matrix @ vector - vector * value).max() < 1e-14 * norm * len(values)
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    if len(values) > 2:
        assert np.abs(rough.T @ rough - np.eye(len(values))).max() > 1e-9


def test_clustered_vectors_are_told_apart():
    """Gaps far below float32 are resolved to what double precision allows."""
    values = [3.0, 3.0 - 1e-8, 3.0 - 2e-8, 1.0]
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(4, 4)))
    wide = (q.astype(np.longdouble) * np.array(values, np.longdouble)) @ q.T.astype(np.longdouble)
    value, vector = whitening.eigen((wide + wide.T) / 2)
    assert np.abs(np.abs((vector * q).sum(axis=0)) - 1).max() < 1e-12
    assert np.abs(value - values).max() < 1e-15 * 12

import math
from fractions import Fraction

import numpy as np
import pytest

from cellweave.llm import whitening
from tests.llm import plain

DDL = "vec_id long, embedding array<float>, label int"


def plain_whiten(rows, components=8):
    """(vec_id, component, n, deviation, whitened, explained) by fractions and one eigendecomposition."""
    good = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    total = [sum(x[k] for _, x in good) for k in range(d)]
    y = [[n * x[k] - total[k] for k in range(d)] for _, x in good]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    out = []
    for (i, _), r in zip(good, y):
        for k in range(min(components, d)):
            w = float(np.dot([float(Fraction(c, n)) for c in r], u[:, -1 - k])) / math.sqrt(e[-1 - k])
            out.append((i, k + 1, n, sum(c * c for c in r), w, e[-1 - k] / np.trace(v)))
    return out


def close(ours, theirs):
    """Rows agree, but for one sign a component."""
    ours, theirs = (sorted(r, key=lambda x: (x[1], str(x[0]), x[3], abs(x[4]))) for r in (ours, theirs))
    assert [r[:4] for r in ours] == [r[:4] for r in theirs]
    sign = {}
    for a, b in zip(ours, theirs):
        assert abs(a[5] - b[5]) <= 1e-9 * b[5]
        assert abs(abs(a[4]) - abs(b[4])) < 1e-8
        if abs(b[4]) > 1e-6:
            assert sign.setdefault(a[1], a[4] * b[4] > 0) == (a[4] * b[4] > 0)


def test_against_fractions(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=12) * np.linspace(0.1, 0.7, 12)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [0.0] * 11), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1) for r in rows + bad], DDL).repartition(7)).collect()
    assert max(r["identity_error"] for r in got) < 1e-9
    close([(r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got], plain_whiten(rows))


def test_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{plain.SF}/embeddings.parquet").collect()]
    got = whitening.op12_whitening(spark, plain.SF).collect()
    assert dict(whitening.op12_whitening(spark, plain.SF).dtypes)["deviation"] == "bigint"
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    close([(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got], plain_whiten(rows))


@pytest.mark.parametrize("size", [1, 1e4, 1e14])
def test_scatter_is_exact(spark, size):
    """Also of entries whose sums need many primes, and of more rows than one product takes."""
    draw = np.random.default_rng(2)
    n = 300 if size > 1 else 20_000
    rows = [[float(c) for c in v] for v in draw.normal(size=(n, 3)) * size]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    centre = [round(sum(v[k] for v in x) / n) for k in range(3)]
    reach = max(abs(v[k] - centre[k]) for v in x for k in range(3))
    df = spark.createDataFrame([(v,) for v in rows], "embedding array<double>").repartition(3)
    got = whitening.scatter(df, "embedding", np.array(centre, np.int64), n * reach * reach)
    assert got.tolist() == [[sum((v[a] - centre[a]) * (v[b] - centre[b]) for v in x) for b in range(3)] for a in range(3)]
    stats = whitening.sums(df, "embedding")
    assert [s[2] for s in stats] == [sum(v[k] for v in x) for k in range(3)]


def test_deviations_without_overflow():
    y = np.array([[(1 << 61) + 3, -(1 << 60) - 5, 7]], np.int64)
    assert whitening.squares(y) == [sum(c * c for c in y[0].tolist())]
    assert whitening.squares(y.astype(object)) == whitening.squares(y)


def test_tables_without_variance_or_vectors(spark):
    equal = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], DDL)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in equal] == [(2, 0, None, None, None)] * 4
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], DDL)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], DDL)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k], 0) for k in range(9)], DDL)).where("whitened is null")
    assert {r["component"] for r in line.collect()} == {2}


def test_clashing_columns(spark):
    rows = [(k, [k * 0.1, k * k * 0.01, 1.0 / (k + 1)], k, k, k) for k in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, n int, component int"))
    assert got.count() == 60 and got.columns[:3] == ["vec_id", "component", "n"]

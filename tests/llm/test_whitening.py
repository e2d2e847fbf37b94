import math

import numpy as np
import pytest

from sparkintel.llm.whitening import whiten


def plain(rows, components=8):
    """(id, component) to values, by numpy over exact integers."""
    kept = [(k, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, width = len(kept), len(kept[0][1])
    sums = [sum(x[d] for _, x in kept) for d in range(width)]
    deviation = [sum((n * x[d] - sums[d]) ** 2 for d in range(width)) for _, x in kept]
    centred = np.array([[(n * x[d] - sums[d]) / n for d in range(width)] for _, x in kept])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return kept, deviation, centred @ axes / np.sqrt(values), values / (centred**2).sum() * n


def made(n, width, seed=3):
    rng = np.random.default_rng(seed)
    return [(k, [float(c) for c in rng.normal(size=width) * np.linspace(1, 3, width)]) for k in range(n)]


@pytest.mark.parametrize("slab_rows, block_rows", [(1 << 27, 1024), (70, 16)])
def test_against_numpy(spark, slab_rows, block_rows):
    rows = made(150, 10)
    rows += [(7, rows[0][1]), (None, rows[3][1])]  # a repeated id, a null id, copies
    odd = [(900, None), (901, []), (902, [math.nan] + [0.0] * 9), (903, [math.inf] + [0.0] * 9), (904, [None] + [0.0] * 9), (905, [1.0, 2.0]), (906, [1e30] + [0.0] * 9)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, number int, vector string").repartition(5)
    got = whiten(table, slab_rows=slab_rows, block_rows=block_rows).collect()
    kept, deviation, white, explained = plain(rows)
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {len(kept)}
    key = lambda k, d: (k is None, k or 0, d)
    order = sorted(range(len(kept)), key=lambda i: key(kept[i][0], deviation[i]))
    for c in range(8):
        own = sorted((r for r in got if r["component"] == c + 1), key=lambda r: key(r["vec_id"], r["deviation"]))
        assert [(r["vec_id"], r["deviation"]) for r in own] == [(kept[i][0], deviation[i]) for i in order]
        mine, theirs = np.array([r["whitened"] for r in own]), white[order, c]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert all(abs(r["explained"] - explained[c]) < 1e-10 for r in own)
    assert got[0]["identity_error"] < 1e-9


def test_fewer_dimensions_than_components(spark):
    rows = made(40, 3)
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 120 and sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)


def test_nothing_to_whiten(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0


def test_only_dimensions_that_vary(spark):
    rows = [(k, [v[0], 0.5, v[1]]) for k, v in made(30, 2)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_deviation_beyond_64_bits(spark):
    rows = [(k, [0.0 if k else 1e12, 1.0 * k]) for k in range(20)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 0)

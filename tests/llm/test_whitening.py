import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label string, x int, n string"


def brute(vectors, most=32):
    """(n, deviations, whitened up to sign, explained) by the full covariance."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = x - sums / n
    values, turn = np.linalg.eigh(off.T @ off / n)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, off @ turn / np.sqrt(values), values / np.trace(off.T @ off / n)


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if e is None else float(e) for e in v], "l", 1, "n") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def agree(got, vectors, ids, most=32):
    n, deviation, white, explained = brute(vectors, most)
    k = white.shape[1]
    place = {i: at for at, i in enumerate(ids)}
    found = np.full(white.shape, np.nan)
    for r in got:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[place[r.vec_id]])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(got) == n * k and len({r.identity_error for r in got}) == 1
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-6


@pytest.mark.parametrize("shape", ["flat", "falling", "few dimensions"])
def test_against_full_covariance(spark, shape):
    from docgate.llm.whitening import whiten

    rng = np.random.default_rng(4)
    d = 8 if shape == "few dimensions" else 70
    scale = np.linspace(1, 0.8, d) if shape == "flat" else 0.7 ** np.arange(d) * 40 + 0.4
    vectors = rng.standard_normal((900, d)) * scale + rng.standard_normal(d)
    assert (got := whiten(table(spark, vectors).repartition(5))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(got.collect(), vectors, range(900))


def test_passes_end_in_a_small_range_and_go_to_all_dimensions_in_a_flat_one(spark):
    from docgate.llm.whitening import centre_of, fit, rows_of

    rng = np.random.default_rng(5)
    # 40 whole-number directions of 70 dimensions: the range is found, and the rest has no variance
    inside = np.concatenate([rng.integers(-90, 90, (500, 40)) / 64, np.zeros((500, 30))], axis=1)
    rows, size = rows_of(table(spark, inside))
    model = fit(rows, size, centre_of(rows, size))
    assert not model.completed and model.passes < 4
    rows, size = rows_of(table(spark, rng.standard_normal((500, 70))))
    model = fit(rows, size, centre_of(rows, size))
    assert model.completed and model.components.shape == (70, 32)
    assert np.abs(model.components.T @ model.components - np.eye(32)).max() < 1e-12


def test_rows_that_do_not_count(spark):
    from docgate.llm.whitening import Centre, whiten

    rng = np.random.default_rng(6)
    good = rng.standard_normal((50, 5))
    bad = [None, [], [1.0] * 4, [None] * 5, [float("nan")] * 5, [1.0, 2.0, 3.0, 4.0, float("inf")], [1e300] * 5]
    df = table(spark, [*good.tolist(), *bad])
    agree(whiten(df).collect(), good, range(50))
    twice = df.unionByName(df)
    assert whiten(twice).filter("n = 100").count() == 500
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id >= 50")).count() in (0,)
    assert whiten(table(spark, [[1.0, 2.0]] * 3)).count() == 0  # no variance
    assert {r.component for r in whiten(table(spark, [[1.0, 2.0], [1.0, 3.0], [1.0, 5.0]])).collect()} == {1}
    assert whiten(df.selectExpr("CAST(NULL AS LONG) AS vec_id", "embedding")).filter("vec_id IS NULL").count() == 250
    far = Centre(10**10, np.array([0, 0]), 10**3)
    assert far.deviations(np.array([[1000, 0], [0, 0]])).to_pylist() == [None, 0]


def test_query_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    from docgate.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    agree(QUERIES["op12_embedding_whitening"](spark, sf).collect(), t["embedding"].to_pylist(), t["vec_id"].to_pylist())

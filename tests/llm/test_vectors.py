import numpy as np

from pyspark.sql import functions as F

from wayloom.llm.neardup_vectors import compared_share, near_duplicate_vectors, tile_links

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def test_tile_is_brute_force():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 24))
    a, b = (np.float32(centre[rng.integers(0, 20, 90)] + 0.25 * rng.normal(size=(90, 24))).astype(float) for _ in range(2))
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    for x, y, same in ((a, b, False), (a, a, True)):
        c = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= 0.93
        want = np.argwhere(np.triu(c, 1) if same else c)
        assert len(want) and (np.stack(tile_links(x, y, axes, 0.93, same), axis=1) == want).all()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = centre[i % 12] + 0.2 * rng.normal(size=16) if i % 3 else centre[i % 12]
        rows.append((i, [float(x) for x in np.float32(v)], i % 2, "x"))
    odd = [(200, None, 0, "x"), (201, [], 0, "x"), (202, [0.0] * 16, 0, "x"), (203, [float("nan")] + [1.0] * 15, 0, "x"), (204, [None] + [1.0] * 15, 0, "x"), (205, [1.0] * 5, 0, "x"), (206, rows[0][1], None, "x"), (None, rows[0][1], 0, "x"), (207, [float("inf")] + [1.0] * 15, 0, "x")]
    got = near_duplicate_vectors(spark.createDataFrame(rows + odd, SCHEMA), 0.93, chunk=16).collect()
    assert len(got) == len(rows) + len(odd)
    v = np.array([r[1] for r in rows])
    n = np.linalg.norm(v, axis=1)
    link = ((v @ v.T) / np.outer(n, n) >= 0.93) & (np.arange(160)[:, None] % 2 == np.arange(160)[None] % 2)
    np.fill_diagonal(link, False)
    comp = np.arange(160)
    for _ in range(160):
        comp = np.minimum(comp, np.where(link, comp[None], 999).min(axis=1))
    by = {r["vec_id"]: r for r in got}
    assert link.any()
    for i in range(160):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (link[i].sum(), comp[i], comp[i] == i)
    for r in odd:
        x = by[r[0]]
        assert (x["n_links"], x["component_id"], x["kept"]) == (0, r[0], True)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_vectors(df).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 3, "x"), (1, [1.0, 2.0], 3, "x"), (2, [2.0, 4.0], 3, "x")], SCHEMA)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(twice).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_lengths_and_repeated_ids(spark):
    rows = [(k, [1.0, 2.0, 3.0 + k / 100], 0, "x") for k in range(5)] + [(10, [1.0, 2.0], 0, "x"), (11, [1.0, 2.0], 0, "x"), (12, [2.0, 4.1], 0, "x"), (13, [5.0], 0, "x"), (14, [7.0], 0, "x")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 10: (2, 10), 11: (2, 10), 12: (2, 10), 13: (1, 13), 14: (1, 13)}
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0, "x"), (1, b, 0, "x"), (2, [2.0, 0.01, 0.0], 0, "x"), (3, [0.01, 3.0, 0.0], 0, "x")]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_slabs_lose_no_link_and_spare_comparisons(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 3)) * [4, 1, 1] + rng.normal(size=(400, 1))
    rows = [(k, [float(y) for y in np.float32(x)], 0, "x") for k, x in enumerate(v)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(frame, 0.995, chunk=8).collect()}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T) >= 0.995).sum(axis=1) - 1))
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()
    assert compared_share(frame.select("label", F.col("embedding").alias("v")), axes, 0.995) < 0.6

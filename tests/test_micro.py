"""Small fixtures with results known by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.functions.region import Region
from wayloom.operators import cluster, gcn, graph, metrics, od, vocab
from wayloom.operators import trips as tr
from wayloom.sources import tables

R = Region()


def test_region_corners_and_json(spark):
    assert (R.num_x, R.num_y) == (10, 10)
    assert Region.from_json(R.to_json()) == R
    df = spark.createDataFrame([(R.min_lon, R.min_lat), (R.max_lon - 1e-6, R.max_lat - 1e-6)], "lon double, lat double")
    got = df.select(R.cell_inside(F.col("lon"), F.col("lat")).alias("c")).collect()
    assert [r["c"] for r in got] == [0, 99]
    around = Region.around(120.15, 30.27, 1000, 2000)
    assert around.num_x * around.x_step >= 1000 and around.min_lon < 120.15 < around.max_lon and around.min_lat < 30.27 < around.max_lat


def test_centres_fall_into_their_cells(spark):
    got = R.centres(spark).select("cell", R.cell(F.col("lon"), F.col("lat")).alias("back")).collect()
    assert len(got) == 100 and all(r["cell"] == r["back"] for r in got)


def test_speed_levels_and_clock(spark):
    df = spark.createDataFrame([(20.0, 0), (20.1, 3600), (40.0, 86399), (60.0, 86400), (None, 59)], "v double, sec int")
    got = df.select(geo.speed_level(F.col("v")).alias("l"), geo.clock(F.col("sec")).alias("c"), geo.hour_of(F.col("sec")).alias("h")).collect()
    assert [r["l"] for r in got] == [1, 2, 3, 4, None]
    assert [r["c"] for r in got] == ["00:00:00", "01:00:00", "23:59:59", "24:00:00", "00:00:59"]
    assert [r["h"] for r in got] == [0, 1, 23, 23, 0]


def test_one_point_trips_go_and_no_time_gives_no_speed(spark):
    points = spark.createDataFrame([(1, 5, 1, 10, 1, 120.15, 30.25), (2, 5, 1, 10, 2, 120.15, 30.25), (2, 5, 1, 10, 3, 120.16, 30.25)], "user_id long, month int, day int, sec int, event_id long, lon double, lat double")
    t = tables.trips_from_points(points, R)
    assert [r["trip_key"] for r in t.collect()] == ["2_5_1"]
    assert tr.segments(t).collect()[0]["speed"] is None
    assert tr.speed_summary(t).collect()[0]["levels"] == ""


def _graph(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, flow long")


def test_line_graph(spark):
    g = _graph(spark, [(1, 2), (2, 3), (2, 1), (3, 3)])
    assert sorted(r["name"] for r in graph.line_nodes(g).collect()) == ["1_2", "2_1", "2_3"]
    assert sorted(map(tuple, graph.line_edges(g).collect())) == [("1_2", "2_1"), ("1_2", "2_3"), ("2_1", "1_2")]


def test_measures_of_two_cycles(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3)]
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "cell long, community long")
    g = _graph(spark, pairs)
    got = {r["community"]: (r["cut"], r["volume"], r["conductance"]) for r in metrics.conductance(g, labels).collect()}
    assert got == {0: (1, 7, 1 / 8), 1: (1, 7, 1 / 8)}
    m, q = len(pairs), 0.0
    for i in range(6):
        for j in range(6):
            if i // 3 == j // 3:
                q += ((i, j) in pairs) - sum(a == i for a, _ in pairs) * sum(b == j for _, b in pairs) / m
    assert metrics.modularity(g, labels).first()["q"] == pytest.approx(q / m)
    assert all(r["in_triangle"] == 0 for r in metrics.triangle_participation(g, labels).collect())
    with_triangle = _graph(spark, [*pairs, (0, 2)])
    assert {r["community"]: r["in_triangle"] for r in metrics.triangle_participation(with_triangle, labels).collect()} == {0: 3, 1: 0}


def test_best_matching_is_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        t = rng.integers(0, 20, (n, n))
        assert sum(t[i, j] for i, j in enumerate(metrics.best_matching(t))) == max(sum(t[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_perfect_clustering_scores(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(9)], "t int, p int")
    assert metrics.clustering_scores(df, "t", "p") == pytest.approx({"accuracy": 1.0, "macro_f1": 1.0, "nmi": 1.0, "ari": 1.0})


def test_propagation_is_the_dense_product(spark):
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((6, 6)) < 0.4, 1)
    a = (a | a.T).astype(float)
    links = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if a[i, j]], "i long, j long")
    nodes = spark.range(6).withColumnRenamed("id", "i")
    x = rng.random((6, 2))
    loop = a + np.eye(6)
    d = loop.sum(axis=1)
    s = loop / np.sqrt(np.outer(d, d)) + np.eye(6)
    s /= s.sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, k, float(x[i, k])) for i in range(6) for k in range(2)], "i long, k int, x double")
    got = np.zeros((6, 2))
    for r in graph.propagate(graph.normalised(links, nodes), rows, 3).collect():
        got[r["i"], r["k"]] = r["x"]
    assert np.allclose(got, s @ s @ s @ x)


def _points(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, 120.15 + float(x) * 0.01, 30.27 + float(y) * 0.01) for i, (x, y) in enumerate(rng.random((n, 2)))], "id long, lon double, lat double")


def test_dbscan_is_brute_force(spark):
    pts = _points(spark)
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(pts, 120.0, 4).collect()}
    rows = pts.collect()
    x = np.array([(geo.easting_of(r["lon"]), geo.northing_of(r["lat"])) for r in rows])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 120
    core = near.sum(axis=1) >= 4
    for i in range(len(x)):
        if core[i]:
            assert all(got[i] == got[j] for j in np.flatnonzero(near[i] & core))
        elif not (near[i] & core).any():
            assert got[i] == -1
        else:
            assert got[i] in {got[j] for j in np.flatnonzero(near[i] & core)}


def test_knn_is_brute_force(spark):
    pts = _points(spark, 40)
    got = {}
    for r in cluster.knn_graph(pts, 3, 100.0).collect():
        got.setdefault(r["p"], {})[r["rank"]] = r["q"]
    x = np.array([(geo.easting_of(r["lon"]), geo.northing_of(r["lat"])) for r in pts.collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        want = [j for j in np.argsort(d[i]) if j != i][:3]
        assert [got[i][k] for k in (1, 2, 3)] == want


def test_delaunay_circles_are_empty():
    xy = np.random.default_rng(5).random((30, 2)) * 1000
    edges = cluster._triangulate(xy)
    assert len(edges) <= 3 * len(xy) - 6
    nearest = {tuple(sorted((i, int(np.argsort(((xy - xy[i]) ** 2).sum(axis=1))[1])))) for i in range(len(xy))}
    assert nearest <= edges  # each point's nearest neighbour is a Delaunay neighbour


def test_kruskal_bound_and_hull(spark):
    pts = _points(spark, 30)
    e = cluster.knn_graph(pts, 4, 100.0).select(F.col("p").alias("a"), F.col("q").alias("b"), F.col("metres").alias("distance"))
    got = cluster.bounded_kruskal(pts, e, 5).collect()
    assert len(got) == 30
    hull = cluster.hulls(pts.withColumn("cluster", F.lit(1).cast("long"))).first()
    assert hull["n"] == 30 and hull["area"] > 0
    one = cluster.hulls(pts.where("id < 2").withColumn("cluster", F.col("id"))).collect()
    assert all(r["n"] == 1 and r["area"] > 0 for r in one)


def test_communities_label_every_vertex(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(base, base + 4) if a < b] + [(0, 10)]
    g = _graph(spark, pairs)
    want = {frozenset(range(4)), frozenset(range(10, 14))}
    values = spark.createDataFrame([(v, v // 10) for v in [*range(4), *range(10, 14)]], "cell long, value long")
    both = _graph(spark, pairs + [(b, a) for a, b in pairs])  # a walk follows the direction of edges
    for df in (gcn.louvain(g), gcn.stoc(g, values, 0.5), gcn.sa_cluster(both, values, 2), gcn.edge_betweenness(g, 2)):
        found = {}
        for r in df.collect():
            found.setdefault(r["community"], set()).add(r["cell"])
        assert {frozenset(v) for v in found.values()} == want


def test_vocabulary_ties_and_first(spark):
    counts = spark.createDataFrame([(5, 3), (2, 3), (9, 8), (1, 1)], "cell long, n long")
    assert [(r["cell"], r["id"]) for r in vocab.vocabulary(counts, 3, 2).orderBy("id").collect()] == [(9, 4), (2, 5), (5, 6)]
    assert [(r["cell"], r["id"]) for r in vocab.vocabulary(counts, 3, 2, True).orderBy("id").collect()] == [(2, 4), (5, 5)]


def test_files_round_trip(spark, sf_dir, tmp_path):
    from wayloom.sources import fixtures as fx

    t = fx.numbered_trips(spark, sf_dir)
    tables.write_trips(t, str(tmp_path / "trips"))
    back = tables.read_trips(spark, str(tmp_path / "trips"))
    assert back.count() == t.count()
    plan = tr.scope(back, 1, (5, 6))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    tok = tr.tokens(t, R)
    tables.write_token_lines(tok, "tokens", str(tmp_path / "tok"))
    lines = tables.read_token_lines(spark, str(tmp_path / "tok"))
    assert lines.count() == tok.count() and lines.first()["tokens"][0] == 1
    flows = od.grid_rows(od.dense_slices(od.slices(t, R), 0, 3, [0, 1]), R, 0, [0, 1])
    tables.write_csv(flows, str(tmp_path / "grid"))
    assert tables.read_flow_csv(spark, str(tmp_path / "grid")).count() == 16
    assert tables.grid_geo(spark).count() == 100


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from wayloom.streaming.slices import slice_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = slice_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="0 seconds").writeStream.format("memory").queryName("slices").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("slices").collect())) == sorted(map(tuple, slice_counts(events).collect()))
    finally:
        q.stop()


def test_rows_only_queries_run(spark, sf_dir):
    from wayloom.plans.oracles import ORACLES
    from wayloom.plans.queries import REGISTRY

    for name in sorted(set(REGISTRY) - set(ORACLES) - {"dbscan", "stme"}):
        assert REGISTRY[name](spark, sf_dir).count() > 0, name


def test_both_ends_of_trips_are_clustered(spark, sf_dir):
    from wayloom.plans.queries import REGISTRY
    from wayloom.sources import fixtures

    ends = tr.endpoints(fixtures.trips(spark, sf_dir)).select(F.xxhash64("trip_key", "flag").alias("id"), "flag").collect()
    flags = {r["id"]: r["flag"] for r in ends}
    assert len(flags) == len(ends)
    for name in ("dbscan", "stme"):
        assert {r["id"] for r in REGISTRY[name](spark, sf_dir).collect()} == set(flags)
    assert {flags[r["id"]] for r in REGISTRY["point_compression"](spark, sf_dir).collect()} == {0, 1}


def test_gcc_places_cells_with_single_trips(spark, sf_dir):
    from wayloom.plans.queries import REGISTRY

    nodes = {c for r in REGISTRY["line_graph_nodes"](spark, sf_dir).collect() for c in (r["src"], r["dst"])}
    assert {r["i"] for r in REGISTRY["gcc"](spark, sf_dir).collect()} == nodes


def test_join_split_equals_a_plain_join_and_splits_hot_keys(spark):
    from wayloom.plans.lineage import join_split

    many = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 500).cast("long").alias("k"), F.lit(1).cast("long").alias("k2"), F.col("id").alias("x"))
    one = many.where("k is not null").groupBy("k", "k2").agg(F.count("*").alias("n"), F.max("x").alias("top")).where("k < 400")
    want = sorted(map(str, many.join(one.drop("n"), ["k", "k2"], "left").select("k", "k2", "x", "top").collect()))
    assert sorted(map(str, join_split(many, one, ["k", "k2"], "n", 6000).collect())) == want
    assert sorted(map(str, join_split(many, one, ["k", "k2"], "n", 6000, "top < 0").collect())) == want


def test_a_cluster_needs_a_named_shared_folder():
    from wayloom.plans import lineage

    class Unnamed:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_dir(Unnamed)


def test_stme_by_hand():
    """Two tight groups and a far point: each group grows from its densest point, the far one is noise."""
    ids = [1, 2, 3, 4, 11, 12, 13, 14, 99]
    near = [[2, 3, 4], [1, 3, 4], [1, 2, 4], [3, 2, 1], [12, 13, 14], [11, 13, 14], [11, 12, 14], [13, 12, 11], [14, 13, 12]]
    refined = [[2, 3], [1, 3, 4], [1, 2, 4], [3, 2], [12, 13, 14], [11, 13], [11, 12, 14], [13, 11], []]
    far = [3.0, 1.0, 1.5, 3.0, 2.0, 2.5, 2.1, 4.0, 50.0]
    assert cluster.expand_clusters(ids, far, near, refined, 2) == [2, 2, 2, 2, 11, 11, 11, 11, -1]
    # with three refined neighbours wanted, 1 and 4 are no cores but are reached; noise that was judged first is taken in later
    assert cluster.expand_clusters(ids, [0.5, *far[1:]], near, refined, 3) == [2, 2, 2, 2, 11, 11, 11, 11, -1]
    # its refined neighbours all taken, a point joins their label and begins nothing
    assert cluster.expand_clusters([1, 2, 3, 4], [1, 2, 3, 4], [[2, 3]] * 4, [[2, 3], [1, 3], [1, 2], [2, 3]], 2) == [1, 1, 1, 1]


def _stme_plain(xy, k, shared, least):
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    sets = [set(r) for r in near.tolist()]
    refined = [[j for j in near[i].tolist() if i in sets[j] and len(sets[i] & sets[j]) >= shared] for i in range(len(xy))]
    return cluster.expand_clusters(list(range(len(xy))), np.sqrt(np.take_along_axis(d, near[:, -1:], 1)[:, 0]).tolist(), near.tolist(), refined, least)


def test_stme_over_joins_equals_plain(spark):
    rng = np.random.default_rng(4)
    lon = np.concatenate([120.11 + 0.002 * rng.normal(size=60), 120.16 + 0.003 * rng.normal(size=60), rng.uniform(120.1, 120.2, 30)])
    lat = np.concatenate([30.25 + 0.002 * rng.normal(size=60), 30.28 + 0.002 * rng.normal(size=60), rng.uniform(30.23, 30.3, 30)])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))], "id long, lon double, lat double")
    x = geo.RADIUS * lon * geo.RADIAN
    s = np.sin(lat * geo.RADIAN)
    xy = np.stack([x, geo.HALF_RADIUS * np.log((1 + s) / (1 - s))], axis=1)
    want = _stme_plain(xy, 10, 5, 4)
    got = {r["id"]: r["cluster"] for r in cluster.stme(pts, 10, 5, 4, 400.0).collect()}
    assert [got[i] for i in range(150)] == want and len(set(want)) > 2 and -1 in want
    rounds = {r["id"]: (r["cluster"], r["round"]) for r in cluster.stme_rounds(pts, [(10, 5, 4), (6, 2, 2)], 400.0).collect()}
    assert all(rounds[i] == (c, 0) for i, c in enumerate(want) if c != -1) and {r for c, r in rounds.values()} <= {0, 1, None}
    parts = cluster.stme_within(pts, cluster.stme(pts, 10, 5, 4, 400.0), 6, 2, 2).collect()
    assert {r["id"] for r in parts} == {i for i, c in enumerate(want) if c != -1} and all(got[r["part"]] == r["cluster"] for r in parts if r["part"] != -1)
    report = cluster.stme_report(pts, [(10, 5, 4)], 400.0)
    assert abs(report["noise"].first()["noise"] - np.mean(np.array(want) == -1)) < 1e-9
    assert report["hulls"].count() == len(set(want) - {-1})


def test_greedy_compression(spark):
    ends, poi_at = np.array([[0.0, 0], [10, 0], [20, 0], [100, 0], [500, 0]]), np.array([[-40.0, 0], [12, 0], [130, 0]])
    # the first gathers 0, 10 and 20 within 50; POI 7 (at 12) and 5 (at -40) are near two or more of them, 7 near all
    assert cluster.greedy_compression([1, 2, 3, 4, 9], ends, [5, 7, 8], poi_at, 50.0) == {1: 7, 2: 7, 3: 7, 4: 8}
    lonlat = [(i, x / geo.RADIUS / geo.RADIAN, 0.0) for i, (x, _) in zip([1, 2, 3, 4, 9], ends.tolist(), strict=True)]
    pois = [(i, "x", x / geo.RADIUS / geo.RADIAN, 0.0) for i, (x, _) in zip([5, 7, 8], poi_at.tolist(), strict=True)]
    got = cluster.compress_to_poi(spark.createDataFrame(lonlat, "id long, lon double, lat double"), spark.createDataFrame(pois, "poi_id long, category string, lon double, lat double"), 50.0)
    assert dict(map(tuple, got.collect())) == {1: 7, 2: 7, 3: 7, 4: 8}


def test_spherical_dbscan(spark):
    rng = np.random.default_rng(6)
    at = np.stack([120.1 + 0.01 * rng.random(80), 60.0 + 0.005 * rng.random(80)], axis=1)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "id long, lon double, lat double")
    r = np.radians(at)
    h = np.sin((r[:, None, 1] - r[None, :, 1]) / 2) ** 2 + np.cos(r[:, None, 1]) * np.cos(r[None, :, 1]) * np.sin((r[:, None, 0] - r[None, :, 0]) / 2) ** 2
    near = 2 * geo.RADIUS * np.arcsin(np.sqrt(h)) <= 60
    cores = set(np.flatnonzero(near.sum(axis=1) >= 4).tolist())
    got = {x["id"]: x["cluster"] for x in cluster.dbscan(pts, 60.0, 4, sphere=True).collect()}
    assert cores and {i for i in range(80) if got[i] == -1} == {i for i in range(80) if i not in cores and not any(near[i, j] for j in cores)}
    assert all(got[i] == got[j] for i in cores for j in cores if near[i, j])


def test_walk_medoids_and_weights():
    link = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)):
        link[a, b] = link[b, a] = 1
    values = np.array([[0, 0], [0, 1], [0, 0], [1, 1], [1, 0], [1, 1]])
    owner, medoids = gcn.walk_medoids(link, values, 2)
    assert len(set(owner[:3])) == len(set(owner[3:])) == 1 and owner[0] != owner[3] and {m // 3 for m in medoids.tolist()} == {0, 1}


def test_gcc_lowers_the_loss_and_infers(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(30, 4)) + [5, 0, 0, 0], rng.normal(size=(30, 4)) + [0, 5, 0, 0]])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>")
    found, w, centres, losses = gcn.gcc_fit(rows, 4, 2)
    got = {r["i"]: r["cluster"] for r in found.collect()}
    assert len({got[i] for i in range(30)}) == len({got[i] for i in range(30, 60)}) == 1 and got[0] != got[59]
    assert np.allclose(w.T @ w, np.eye(2), atol=1e-9) and all(a >= b for a, b in zip(losses, losses[1:]))
    g = np.array([got[i] for i in range(60)])
    assert abs(np.linalg.norm(x - centres[g] @ w.T) - losses[-1]) < 1e-3
    again, loss = gcn.gcc_infer(rows, w, 4, 2)
    same = {r["i"]: r["cluster"] for r in again.collect()}
    assert len({(got[i], same[i]) for i in got}) == 2 and abs(loss - losses[-1]) < 1e-3

"""The named queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import cluster as cl
from wayloom.operators import gcn, graph, metrics, od, poi, vocab
from wayloom.operators import trips as tr
from wayloom.sources import fixtures as fx
from wayloom.plans.lineage import cut
from wayloom.sources import tables

REGION = fx.REGION
MONTH, DAYS, HOURS = 1, (5, 20), (6, 20)
BRUSH = [11, 12, 13, 21, 22, 23, 31, 32, 33]
WHITE = list(range(0, 100, 3))
RADIUS_M = 300.0
DIM = 64
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _flow(spark, d) -> DataFrame:
    return od.flow(fx.trips(spark, d))


def _edges(spark, d) -> DataFrame:
    return graph.edges(_flow(spark, d))


def _cells(spark) -> DataFrame:
    return spark.range(REGION.cells).select(F.col("id").alias("cell"))


def _labels(spark) -> DataFrame:
    """Ten stripes of cells, the communities of the measures."""
    return _cells(spark).withColumn("community", F.col("cell") % 10)


def _brushed(spark, d) -> DataFrame:
    return graph.brushed(_edges(spark, d), BRUSH)


def _listed(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as comma-separated text."""
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in names})


def _rounded(df: DataFrame, n: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


# ---- scalar functions and filters


@query
def grid_cell_assign(spark, d):
    return fx.gps(spark, d).select("event_id", F.coalesce(REGION.cell_inside(F.col("lon"), F.col("lat")), F.lit(-1)).alias("cell"))


@query
def spacetime_cell(spark, d):
    g = fx.gps(spark, d)
    return g.where(REGION.contains(F.col("lon"), F.col("lat"))).select("event_id", REGION.space_time_cell(F.col("lon"), F.col("lat"), F.col("sec")).alias("st_cell"))


@query
def mercator_round_trip(spark, d):
    g = fx.gps(spark, d).select("event_id", geo.easting(F.col("lon")).alias("x"), geo.northing(F.col("lat")).alias("y"))
    return g.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(geo.longitude(F.col("x")), 6).alias("lon"), F.round(geo.latitude(F.col("y")), 6).alias("lat"))


@query
def region_centres(spark, d):
    u, v = REGION.unit_centre(F.col("cell"))
    return _rounded(REGION.centres(spark).withColumns({"unit_x": u, "unit_y": v}), 6, "lon", "lat", "unit_x", "unit_y")


@query
def circular_range(spark, d):
    return fx.gps(spark, d).where(geo.in_circular_range(79200, 7200, F.col("sec"))).select("event_id", "sec")


@query
def slice_angle(spark, d):
    s = REGION.slice(F.col("sec"))
    return fx.gps(spark, d).select("event_id", s.alias("slice"), F.round(geo.slice_angle(s, 96), 6).alias("angle"))


@query
def clock_format(spark, d):
    return fx.gps(spark, d).select("event_id", geo.clock(F.col("sec")).alias("clock"))


@query
def point_lists(spark, d):
    """Points written as a JSON column and read back."""
    t = fx.trips(spark, d).select("trip_key", tables.encode_points(F.col("points")).alias("point_list"))
    back = tables.decode_points(t, F.col("point_list"))
    return back.select("trip_key", F.size("points").alias("n"), F.element_at("points", 1)["sec"].alias("first_sec"), F.element_at("points", -1)["sec"].alias("last_sec"))


@query
def poi_labels(spark, d):
    p = fx.poi(spark, d)
    return p.select("poi_id", poi.category_label(F.concat(F.lit("/poi/"), F.col("category"), F.lit(".xlsx")), {"ECONOMY": "BASIC"}).alias("label"))


@query
def region_filter_points(spark, d):
    return tr.endpoints_in_region(fx.trips(spark, d), REGION).select("trip_key", "flag", "sec")


@query
def region_filter_trips(spark, d):
    return fx.trips(spark, d).where("od_in_region").select("trip_key", "n")


@query
def rect_trips(spark, d):
    return tr.within_rectangle(fx.trips(spark, d), 120.18, 30.24, 120.12, 30.29).select("trip_key", "n")


@query
def hour_filter_od(spark, d):
    return tr.endpoints(tr.scope(fx.trips(spark, d), MONTH, DAYS, HOURS)).select("trip_key", "flag", "sec")


@query
def od_pairs_strict(spark, d):
    return tr.od_pairs(fx.trips(spark, d), MONTH, DAYS, HOURS).select("trip_key", "o_cell", "d_cell")


@query
def clipped_trips(spark, d):
    return tr.clip(fx.trips(spark, d), REGION, 2, 6).select("trip_key", F.size("points").cast("long").alias("n"))


@query
def trip_endpoints(spark, d):
    return tr.endpoints(fx.trips(spark, d)).select("trip_key", "month", "day", "flag", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "sec")


@query
def trip_numbers(spark, d):
    return fx.numbered_trips(spark, d).select("trip_key", F.col("idx").cast("long").alias("idx"))


@query
def stride_sample(spark, d):
    return tr.stride(fx.numbered_trips(spark, d), 5).select("trip_key")


@query
def bbox(spark, d):
    return _rounded(tr.bounds(fx.trips(spark, d)), 6, "min_lon", "max_lon", "min_lat", "max_lat")


@query
def distinct_coords(spark, d):
    return tr.endpoints(fx.trips(spark, d)).select(F.round("lon", 5).alias("lon"), F.round("lat", 6).alias("lat")).dropDuplicates(["lon", "lat"])


# ---- segments, speed, trips


@query
def trip_segments(spark, d):
    return tr.segments(fx.trips(spark, d)).select("trip_key", F.col("seq").cast("long").alias("seq"), "sec_a", "sec_b", F.round("metres", 3).alias("metres"))


@query
def segment_speed(spark, d):
    return tr.segments(fx.trips(spark, d)).select("trip_key", F.col("seq").cast("long").alias("seq"), F.round("speed", 4).alias("speed"), "level")


@query
def trip_speed_summary(spark, d):
    return _rounded(tr.speed_summary(fx.trips(spark, d)), 4, "displacement_speed", "mean_segment_speed", "min_speed", "max_speed")


@query
def trip_lookup(spark, d):
    t = fx.numbered_trips(spark, d)
    return tr.lookup(t, tr.stride(t, 7)).select("trip_key", "n", "start_sec", "end_sec")


@query
def gis_rows(spark, d):
    return _rounded(tr.gis_rows(fx.trips(spark, d)), 6, "lon", "lat")


# ---- counts and flows


@query
def daily_counts(spark, d):
    return od.daily_counts(fx.trips(spark, d), MONTH)


@query
def hourly_counts(spark, d):
    return od.hourly_counts(fx.trips(spark, d), MONTH, DAYS)


@query
def od_flow(spark, d):
    return _flow(spark, d)


@query
def od_flow_topk(spark, d):
    return od.top_flow(_flow(spark, d), 50)


@query
def od_hot_endpoints(spark, d):
    return od.hot_endpoints(fx.trips(spark, d), 1)


@query
def hot_grid_graph(spark, d):
    return od.hot_grid_graph(fx.trips(spark, d), 1)


@query
def od_cells_used(spark, d):
    return od.cells_used(od.top_flow(_flow(spark, d), 50))


@query
def od_heat(spark, d):
    return od.heat(fx.trips(spark, d), list(range(0, 50)), list(range(50, 100)), MONTH, 20, 7)


@query
def flow_slices(spark, d):
    return od.slices(fx.trips(spark, d), REGION)


@query
def flow_slices_same(spark, d):
    return od.slices(fx.trips(spark, d), REGION, True)


@query
def flow_slices_dense(spark, d):
    return od.dense_slices(od.slices(fx.trips(spark, d), REGION), 480, 575, [0, 11, 22, 33, 44, 55])


@query
def flow_grid_export(spark, d):
    return od.grid_rows(od.dense_slices(od.slices(fx.trips(spark, d), REGION), 480, 575, [0, 11, 22]), REGION, 480, [0, 11, 22])


@query
def flow_history_vec(spark, d):
    return _listed(od.history(od.slices(fx.trips(spark, d), REGION), 480, 575), "history")


@query
def od_union_days(spark, d):
    t = fx.trips(spark, d)
    return tr.endpoints(tr.scope(t, MONTH, (5, 5))).unionByName(tr.endpoints(tr.scope(t, MONTH, (6, 6)))).select("trip_key", "flag", "sec")


@query
def cell_points(spark, d):
    return od.cell_points(tr.endpoints(fx.trips(spark, d)), REGION).select("cell", "trip_key", "flag")


@query
def adjacency_out(spark, d):
    return _listed(od.adjacency(_flow(spark, d)), "neighbours")


@query
def adjacency_in(spark, d):
    return _listed(od.adjacency(_flow(spark, d), False), "neighbours")


@query
def cluster_centers(spark, d):
    return _rounded(od.centres(od.cell_points(tr.endpoints(fx.trips(spark, d)), REGION)), 9, "lon", "lat")


@query
def cluster_degree(spark, d):
    return od.cluster_degree(_flow(spark, d))


@query
def cluster_flow_history(spark, d):
    return od.cluster_history(fx.trips(spark, d))


@query
def whitelist_intersect(spark, d):
    return _listed(od.adjacency(_flow(spark, d)).where(F.col("cell").isin(WHITE)).withColumn("neighbours", F.array_intersect("neighbours", F.array(*[F.lit(c).cast("long") for c in WHITE]))), "neighbours")


# ---- graphs


@query
def od_graph_filtered(spark, d):
    return _brushed(spark, d)


@query
def line_graph_nodes(spark, d):
    return graph.line_nodes(_edges(spark, d))


@query
def line_graph_edges(spark, d):
    return graph.line_edges(_edges(spark, d))


@query
def node_degree(spark, d):
    return graph.degrees(graph.line_edges(_brushed(spark, d)))


@query
def brush_expand(spark, d):
    return graph.brush_neighbours(_edges(spark, d), BRUSH)


def _pairs(spark, d) -> DataFrame:
    """Node pairs of the 60 greatest flows without loops."""
    top = od.top_flow(_flow(spark, d).where("o_cell <> d_cell"), 60)
    return graph.pair_distances(graph.line_nodes(graph.edges(top)), REGION.centres(spark))


@query
def odpair_distance(spark, d):
    return _rounded(_pairs(spark, d), 4, "distance")


@query
def fake_edges(spark, d):
    return _rounded(graph.with_fake_edges(graph.line_edges(_edges(spark, d)), _pairs(spark, d)), 4, "distance")


@query
def edge_communities(spark, d):
    return graph.edge_communities(_edges(spark, d), _labels(spark))


@query
def community_sizes(spark, d):
    return graph.community_sizes(_labels(spark).join(od.cells_used(_flow(spark, d)), "cell", "left_semi"))


@query
def community_links(spark, d):
    return graph.community_links(_edges(spark, d), _labels(spark))


@query
def anti_remaining(spark, d):
    return graph.remaining(_cells(spark), od.cells_used(od.top_flow(_flow(spark, d), 30)))


@query
def conductance(spark, d):
    return _rounded(metrics.conductance(_edges(spark, d), _labels(spark)), 6, "conductance")


@query
def modularity(spark, d):
    return _rounded(metrics.modularity(_edges(spark, d), _labels(spark)), 8, "q")


@query
def tpr(spark, d):
    return _rounded(metrics.triangle_participation(_edges(spark, d), _labels(spark)), 6, "tpr")


@query
def trips_by_node(spark, d):
    return graph.trips_by_node(fx.trips(spark, d), graph.line_nodes(_brushed(spark, d)))


def _trip_features(spark, d) -> DataFrame:
    f = fx.features(spark, d)
    n = f.count()
    t = fx.trips(spark, d).select("trip_key", F.pmod(F.col("user_id") * 31 + F.col("day"), F.lit(n)).alias("vec_id"))
    return t.join(f, "vec_id").select("trip_key", "feature")


@query
def node_features_mean(spark, d):
    nodes = graph.line_nodes(_brushed(spark, d))
    mean = graph.node_features(nodes, graph.trips_by_node(fx.trips(spark, d), nodes), _trip_features(spark, d), DIM)
    return mean.select("name", "n", F.posexplode("feature").alias("k", "x")).withColumn("x", F.round("x", 6))


# ---- points of interest


@query
def poi_within_radius(spark, d):
    return poi.within_radius(fx.gps(spark, d), fx.poi(spark, d), "event_id", RADIUS_M, 3, category=False)


@query
def poi_profile(spark, d):
    return poi.near_profile(fx.gps(spark, d), fx.poi(spark, d), RADIUS_M)


@query
def poi_top3(spark, d):
    near = poi.within_radius(fx.gps(spark, d), fx.poi(spark, d), "event_id", RADIUS_M)
    return poi.top_categories(near, "event_id").withColumn("rank", F.col("rank").cast("long"))


@query
def poi_knn(spark, d):
    ends = tr.endpoints(fx.trips(spark, d)).where("flag = 0").select("trip_key", "lon", "lat")
    return _rounded(poi.nearest(ends, fx.poi(spark, d), "trip_key", "poi_id", 3), 3, "metres").withColumn("rank", F.col("rank").cast("long"))


@query
def trip_detail(spark, d):
    """Trips of brushed nodes: clock times, most frequent category near the origin, mean segment speed and levels."""
    t = fx.trips(spark, d)
    named = graph.trips_by_node(t, graph.line_nodes(_brushed(spark, d)))
    o = t.select("trip_key", F.col("o_lon").alias("lon"), F.col("o_lat").alias("lat"))
    top = poi.top_categories(poi.within_radius(o, fx.poi(spark, d), "trip_key", RADIUS_M), "trip_key", 1).select("trip_key", F.col("category").alias("origin_poi"))
    speeds = tr.speed_summary(t).select("trip_key", F.round("mean_segment_speed", 2).alias("mean_speed"), "levels")
    times = t.select("trip_key", geo.clock(F.col("start_sec")).alias("start"), geo.clock(F.col("end_sec")).alias("end"))
    return named.join(times, "trip_key").join(speeds, "trip_key").join(top, "trip_key", "left").select("name", "trip_key", "start", "end", "origin_poi", "mean_speed", "levels")


# ---- vocabulary and tokens


def _counts(spark, d) -> DataFrame:
    return vocab.cell_counts(fx.gps(spark, d), REGION)


def _vocabulary(spark, d) -> DataFrame:
    return vocab.vocabulary(_counts(spark, d), 60, 2)


@query
def cell_histogram(spark, d):
    return _counts(spark, d)


@query
def hot_vocab(spark, d):
    return _vocabulary(spark, d)


@query
def vocab_knn(spark, d):
    v = _vocabulary(spark, d)
    return vocab.nearest_hot(v, v, REGION, 5).withColumn("rank", F.col("rank").cast("long"))


@query
def cell_to_vocab(spark, d):
    return vocab.cell_to_id(_counts(spark, d), _vocabulary(spark, d), REGION)


@query
def trip_tokens(spark, d):
    return _listed(tr.tokens(fx.trips(spark, d), REGION, _vocabulary(spark, d)), "tokens")


@query
def dedup_tokens(spark, d):
    return _listed(tr.tokens(fx.trips(spark, d), REGION).withColumn("tokens", tr.collapse(F.col("tokens"))), "tokens")


@query
def token_padding(spark, d):
    return _listed(tr.padded(tr.tokens(fx.trips(spark, d), REGION)).withColumn("length", F.col("length").cast("long")), "tokens")


@query
def split_80_10_10(spark, d):
    return tr.split_train(fx.trips(spark, d), ["user_id"]).select("trip_key", "part")


@query
def noise_variants(spark, d):
    return tr.noise(fx.trips(spark, d), 4).withColumn("seq", F.col("seq").cast("long"))


# ---- neighbours, propagation, scores


def _knn(spark) -> DataFrame:
    """The four nearest cells of each cell of the grid, ties by cell."""
    c = _cells(spark)
    return vocab.nearest_hot(c, c, REGION, 4).select(F.col("cell").alias("p"), F.col("neighbour").alias("q"))


@query
def jaccard_edges(spark, d):
    return _rounded(graph.jaccard_edges(_knn(spark)), 6, "distance")


@query
def shared_neighbors(spark, d):
    return graph.shared_neighbours(_knn(spark), 1)


def _undirected(spark, d, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Edges in both directions and vertices of the flows of at least least trips."""
    e = graph.without_loops(_edges(spark, d)).where(F.col("flow") >= least)
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))).alias("e")).select("e.*").distinct()
    return both, both.select("i").distinct()


@query
def adjacency_normalized(spark, d):
    return _rounded(graph.normalised(*_undirected(spark, d, 2)), 8, "w")


def _cell_features(nodes: DataFrame) -> DataFrame:
    i = F.col("i")
    return nodes.select("i", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((i * 37 + k * 11) % 19).cast("double").alias("x")) for k in range(3)])).alias("e")).select("i", "e.k", "e.x")


@query
def feature_propagation(spark, d):
    both, nodes = _undirected(spark, d, 2)
    return _rounded(graph.propagate(graph.normalised(both, nodes), _cell_features(nodes), 2), 6, "x")


@query
def contingency(spark, d):
    f = fx.features(spark, d).withColumn("pred", (F.col("feature")[0] > 0).cast("int"))
    return metrics.contingency(f, "label", "pred")


@query
def inertia(spark, d):
    f = fx.features(spark, d)
    means = f.groupBy("label").agg(F.array(*[F.avg(F.col("feature")[k]) for k in range(DIM)]).alias("centre"))
    return _rounded(metrics.inertia(f, means), 3, "inertia")


@query
def davies_bouldin(spark, d):
    return _rounded(metrics.davies_bouldin(fx.features(spark, d), "label", DIM), 5, "davies_bouldin")


@query
def run_summary(spark, d):
    return _rounded(metrics.run_summary(fx.table(spark, d, "events"), "value"), 6, "mean", "std")


@query
def metric_log(spark, d):
    lines = fx.table(spark, d, "events").where("event_type = 'click'").select(F.concat(F.lit("acc: 0."), F.col("event_id").cast("string"), F.lit(" (0.5) nmi 1."), F.col("user_id").cast("string")).alias("value"))
    return metrics.parsed_log(lines)


@query
def event_slices(spark, d):
    from wayloom.streaming.slices import slice_counts

    out = slice_counts(fx.table(spark, d, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


# ---- checked by their invariants


def _end_points(spark, d) -> DataFrame:
    """Both ends of each trip."""
    return tr.endpoints(fx.trips(spark, d)).select(F.xxhash64("trip_key", "flag").alias("id"), "lon", "lat")


@query
def kmeans(spark, d):
    return cl.kmeans(fx.features(spark, d), 10)


@query
def two_axes(spark, d):
    return cl.two_axes(fx.features(spark, d))


@query
def dbscan(spark, d):
    return cl.dbscan(_end_points(spark, d), 300.0, 5)


@query
def stme(spark, d):
    return cl.stme(_end_points(spark, d), 12, 6, 7, 400.0)


@query
def delaunay_clusters(spark, d):
    pts = od.centres(od.cell_points(tr.endpoints(fx.trips(spark, d)), REGION)).select(F.col("cell").alias("id"), "lon", "lat")
    return cl.delaunay_clusters(cut(pts), 6, REGION.x_step, 8)


@query
def hulls(spark, d):
    pts = od.cell_points(tr.endpoints(fx.trips(spark, d)), REGION).select(F.col("cell").alias("cluster"), "lon", "lat")
    return cl.densities(cl.hulls(pts)).select("cluster", "n", "area", "density", F.size("polygon").alias("corners"))


@query
def agglomerative(spark, d):
    return cl.agglomerative(REGION.centres(spark).withColumnRenamed("cell", "id"), 15)


@query
def point_compression(spark, d):
    return cl.compress_to_poi(_end_points(spark, d), fx.poi(spark, d), 700.0)


@query
def gcc(spark, d):
    both, nodes = _undirected(spark, d)
    f = _cell_features(nodes).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("feature"))
    return gcn.gcc(both, nodes, f, 3, 8)


@query
def louvain(spark, d):
    return gcn.louvain(_edges(spark, d))


@query
def sa_cluster(spark, d):
    return gcn.sa_cluster(_edges(spark, d), _labels(spark).withColumnRenamed("community", "value"), 10)


@query
def stoc(spark, d):
    return gcn.stoc(_edges(spark, d), _labels(spark).withColumnRenamed("community", "value"), 0.6)


@query
def edge_betweenness(spark, d):
    return gcn.edge_betweenness(od.top_flow(_flow(spark, d), 40).select(F.col("o_cell").alias("src"), F.col("d_cell").alias("dst")), 3)


@query
def edge_sample(spark, d):
    return graph.line_edges(_edges(spark, d)).where(F.pmod(F.xxhash64("source", "target"), F.lit(20)) == 0)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


from wayloom.plans import extended as _extended  # noqa: E402, F401 - registers its queries

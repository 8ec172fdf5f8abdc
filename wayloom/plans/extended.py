"""More named queries: communities that the engine finds, slices, sequences, embeddings, areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import cluster as cl
from wayloom.operators import gcn, graph, metrics, od, sequences
from wayloom.operators import trips as tr
from wayloom.plans.lineage import cut
from wayloom.plans.queries import DIM, REGION, WHITE, _brushed, _edges, _flow, _labels, _listed, _rounded, _vocabulary, query
from wayloom.sources import fixtures as fx
from wayloom.sources import tables


@query
def numbered_all(spark, d):
    """Every trip's number in the order of its key."""
    return sequences.numbered(fx.trips(spark, d).select("trip_key"), [F.col("trip_key")])


@query
def od_order_slice(spark, d):
    """A fifth of all trips, from a third on, in the order of start and key."""
    return sequences.order_slice(fx.trips(spark, d).select("trip_key", "start_sec"), [F.col("start_sec"), F.col("trip_key")])


@query
def hot_cell_flow(spark, d):
    return od.hot_flow(fx.trips(spark, d), WHITE, 1)


@query
def masked_pairs(spark, d):
    """The first 200 OD pairs with a flow and both cells on the list."""
    mask = _flow(spark, d).where(F.col("o_cell").isin(WHITE) & F.col("d_cell").isin(WHITE))
    return od.first_masked(mask, mask, 200).withColumn("number", F.col("number").cast("long"))


def _slices(spark, d):
    return od.slices(fx.trips(spark, d), REGION)


@query
def slice_line_nodes(spark, d):
    return graph.slice_line_graph(_slices(spark, d), 528)[0]


@query
def slice_line_edges(spark, d):
    """Line graph of all flows of two hours, folded to one slice."""
    folded = _slices(spark, d).withColumn("slice", F.floor(F.col("slice") % 96 / 8)).groupBy("slice", "o_cell", "d_cell").agg(F.sum("flow").alias("flow"))
    return graph.slice_line_graph(cut(folded), 6)[1]


@query
def sliding_history(spark, d):
    """History of 96 slices before each of four, as text."""
    return _listed(od.sliding_history(_slices(spark, d), 576, 579, 96), "history")


@query
def flow_totals(spark, d):
    return od.flow_totals(_flow(spark, d))


@query
def od_index_pairs(spark, d):
    index = F.col("o_cell") * 100 + F.col("d_cell")
    o, e = od.pair_of(F.col("od"))
    return _flow(spark, d).select(index.alias("od")).select("od", o.alias("o_cell"), e.alias("d_cell"))


@query
def nearest_centre(spark, d):
    return tr.nearest_centre(fx.gps(spark, d), REGION.centres(spark), "event_id")


@query
def region_time_filter(spark, d):
    return fx.gps(spark, d).where(REGION.contains_at(F.col("lon"), F.col("lat"), F.col("sec"), 21600, 72000)).select("event_id")


@query
def polygon_time_cell(spark, d):
    """User mod 7 stands for a polygon's id."""
    return fx.gps(spark, d).select("event_id", REGION.polygon_time_cell(F.col("user_id") % 7, 7, F.col("sec")).alias("cell"))


@query
def gps_keys(spark, d):
    return fx.gps(spark, d).select("event_id", geo.gps_key(F.round("lon", 5), F.round("lat", 6), F.col("sec")).alias("key"))


@query
def trip_key_parts(spark, d):
    day, index = tables.parts_of_key(F.col("short"))
    rows = fx.numbered_trips(spark, d).select("trip_key", tables.trip_key(F.col("day"), F.col("idx")).alias("short"))
    return rows.select("trip_key", "short", day.alias("day"), index.alias("idx"))


@query
def node_name_parts(spark, d):
    o, e = tables.pair_of_name(F.col("name"))
    return graph.line_nodes(_edges(spark, d)).select("name", o.alias("src"), e.alias("dst"))


@query
def colour_scale(spark, d):
    value = F.col("flow").cast("double")
    return _flow(spark, d).select("o_cell", "d_cell", F.round(geo.three_stops(value, 1.0, 3.0, 9.0), 6).alias("place"))


@query
def array_places(spark, d):
    f = fx.features(spark, d)
    return f.select("vec_id", geo.place_of_least(F.col("feature")).alias("least"), geo.place_of_greatest(F.col("feature")).alias("greatest"))


@query
def neighbour_distance(spark, d):
    """Jaccard distance of both ends' out-neighbourhoods for every edge without loops."""
    near = od.adjacency(_flow(spark, d))
    e = graph.without_loops(_edges(spark, d)).join(near.select(F.col("cell").alias("src"), F.col("neighbours").alias("a")), "src").join(near.select(F.col("cell").alias("dst"), F.col("neighbours").alias("b")), "dst")
    return e.select("src", "dst", F.round(geo.jaccard_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query
def repeated_keys(spark, d):
    return tr.repeated_keys(tr.endpoints_in_region(fx.trips(spark, d), REGION), 2, 500)


@query
def poi_in_bounds(spark, d):
    return tables.within_bounds(fx.poi(spark, d), tr.endpoints(tr.scope(fx.trips(spark, d), 1, (5, 5))).select("lon", "lat")).select("poi_id")


@query
def sequence_batches(spark, d):
    rows = tr.tokens(fx.trips(spark, d), REGION, _vocabulary(spark, d))
    got = sequences.batches(rows, 128)
    return _listed(got.withColumn("length", F.col("length").cast("long")), "tokens")


@query
def shuffled_order(spark, d):
    """A shuffled order and the number that leads back from each place."""
    rows = sequences.numbered(fx.trips(spark, d).select("trip_key"), [F.col("trip_key")])
    placed = sequences.numbered(rows, [F.xxhash64("number", F.lit(1)), F.col("number")], "place")
    return sequences.inverse_permutation(placed).join(rows, "number").select("place", "number", "trip_key")


@query
def length_buckets(spark, d):
    rows = tr.tokens(fx.trips(spark, d), REGION).withColumn("other", tr.collapse(F.col("tokens")))
    return sequences.length_buckets(rows, [(2, 2), (4, 4), (8, 6)], "tokens", "other").select("trip_key", "bucket")


@query
def noisy_token_pairs(spark, d):
    """Tokens of two noisy copies of each trip, and its own."""
    trips = fx.trips(spark, d)
    return _listed(sequences.token_pairs(tr.noise(trips, 2), trips, REGION), "source", "target")


@query
def trip_embedding(spark, d):
    f = sequences.embed(fx.trips(spark, d), REGION, 16)
    return f.select("trip_key", F.round(F.aggregate("feature", F.lit(0.0), lambda t, x: t + x * x), 6).alias("square"))


def _found(spark, d):
    """Communities of the whole flow graph by local moving."""
    return cut(gcn.louvain(_edges(spark, d)))


@query
def louvain_quality(spark, d):
    """Modularity of the communities found and of the ten stripes."""
    e = _edges(spark, d)
    both = [metrics.modularity(e, x).select(F.lit(n).alias("labels"), F.round("q", 8).alias("q")) for n, x in (("louvain", _found(spark, d)), ("stripes", _labels(spark)))]
    return both[0].unionByName(both[1])


@query
def found_conductance(spark, d):
    return _rounded(metrics.conductance(_edges(spark, d), _found(spark, d)), 6, "conductance")


@query
def mean_conductance(spark, d):
    return _rounded(metrics.mean_over_communities(metrics.conductance(_edges(spark, d), _labels(spark)), "conductance"), 8, "mean")


@query
def mean_tpr(spark, d):
    return _rounded(metrics.mean_over_communities(metrics.triangle_participation(_edges(spark, d), _labels(spark)), "tpr"), 8, "mean")


@query
def community_members(spark, d):
    return _listed(graph.community_members(_labels(spark).join(od.cells_used(_flow(spark, d)), "cell", "left_semi")), "members")


@query
def community_lines(spark, d):
    """Lines between the centres of each community's OD pairs."""
    nodes, e = graph.line_nodes(_edges(spark, d)), _edges(spark, d)
    labels = graph.edge_communities(e, _labels(spark))
    return _rounded(graph.centre_lines(labels, nodes, REGION.centres(spark)), 6, "lon", "lat").withColumn("index", F.col("index").cast("long"))


@query
def community_trips(spark, d):
    e = graph.without_loops(_edges(spark, d))
    return graph.community_trips(graph.edge_communities(e, _labels(spark)), graph.trips_by_node(fx.trips(spark, d), graph.line_nodes(e)))


def _brushed_counts(spark, d):
    return graph.node_trip_counts(graph.line_nodes(_brushed(spark, d)), fx.trips(spark, d))


@query
def node_trip_counts(spark, d):
    return _rounded(_brushed_counts(spark, d), 6, "share")


@query
def mean_trips(spark, d):
    return graph.mean_trips(_brushed_counts(spark, d))


@query
def connected_labels(spark, d):
    """Line-graph nodes inside stripes that have a link in the brushed line graph."""
    e = _brushed(spark, d)
    return graph.without_isolated(graph.edge_communities(e, _labels(spark)), graph.line_edges(e))


@query
def silhouette(spark, d):
    return _rounded(metrics.silhouette(fx.features(spark, d), "label"), 5, "silhouette")


@query
def clustering_scores(spark, d):
    """Of the signs of two features against the labels."""
    f = fx.features(spark, d).withColumn("pred", (F.col("feature")[0] > 0).cast("int") * 2 + (F.col("feature")[1] > 0).cast("int"))
    return _rounded(metrics.scores(f, "label", "pred"), 6, "accuracy", "macro_f1", "nmi", "ari")


@query
def dbscan_sphere(spark, d):
    return cl.dbscan(tr.endpoints(fx.trips(spark, d)).select(F.xxhash64("trip_key", "flag").alias("id"), "lon", "lat"), 120.0, 5, sphere=True)


@query
def dbscan_noise(spark, d):
    """Noise share and number of clusters of the origins, and their number."""
    found = cut(cl.dbscan(tr.endpoints(fx.trips(spark, d)).where("flag = 0").select(F.xxhash64("trip_key").alias("id"), "lon", "lat"), 300.0, 5))
    return _rounded(cl.noise_share(found), 8, "noise").crossJoin(F.broadcast(cl.noise_points(found).agg(F.count("*").alias("noise_points"))))


@query
def stme_rounds(spark, d):
    ends = tr.endpoints(fx.trips(spark, d)).select(F.xxhash64("trip_key", "flag").alias("id"), "lon", "lat")
    return cl.stme_rounds(ends, [(12, 6, 7), (8, 4, 4)], 400.0)


@query
def hull_overlaps(spark, d):
    """Hulls of the endpoints of each tenth of the users."""
    pts = tr.endpoints(fx.trips(spark, d)).join(fx.trips(spark, d).select("trip_key", "user_id"), "trip_key").select((F.col("user_id") % 10).alias("cluster"), "lon", "lat")
    return _rounded(cl.hull_overlaps(cl.hulls(pts), 0.05), 10, "shared", "only_a", "only_b")


@query
def poi_graph(spark, d):
    """Flows between the representative points of interest of trips' ends."""
    trips = cut(fx.trips(spark, d).drop("points"))
    ends = tr.endpoints(trips).select(F.xxhash64("trip_key", "flag").alias("id"), "trip_key", "flag", "lon", "lat")
    found = cl.compress_to_poi(ends.select("id", "lon", "lat"), fx.poi(spark, d), 700.0)
    return cl.poi_edges(trips, cut(ends.join(found, "id").select("trip_key", "flag", "poi_id")))


@query
def random_baseline(spark, d):
    nodes = graph.line_nodes(_brushed(spark, d)).select(F.xxhash64("name").alias("i"))
    return cl.kmeans(gcn.random_features(nodes, DIM).withColumnRenamed("i", "vec_id"), 5)

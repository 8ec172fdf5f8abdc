"""Flow graphs, line graphs, brushes, communities and sparse propagation, as edge and vertex tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.plans.lineage import cut


def edges(flows: DataFrame) -> DataFrame:
    """(src, dst, flow)."""
    return flows.select(F.col("o_cell").alias("src"), F.col("d_cell").alias("dst"), "flow")


def name(src: Column, dst: Column, sep: str = "_") -> Column:
    return F.concat_ws(sep, src, dst)


def without_loops(graph: DataFrame) -> DataFrame:
    return graph.where("src <> dst")


def brushed(graph: DataFrame, brush: list[int]) -> DataFrame:
    """Edges without loops that have at least one end in the brush."""
    return without_loops(graph).where(F.col("src").isin(brush) | F.col("dst").isin(brush))


def brush_neighbours(graph: DataFrame, brush: list[int]) -> DataFrame:
    """The brush and all cells one edge away in either direction."""
    hit = graph.where(F.col("src").isin(brush) | F.col("dst").isin(brush))
    spark = graph.sparkSession
    own = spark.createDataFrame([(b,) for b in brush], "cell long")
    return hit.select(F.explode(F.array("src", "dst")).alias("cell")).unionByName(own).distinct()


def line_nodes(graph: DataFrame) -> DataFrame:
    """(name, src, dst): every edge without loops is a node, also one without neighbours."""
    g = without_loops(graph)
    return g.select(name(F.col("src"), F.col("dst")).alias("name"), "src", "dst").distinct()


def line_edges(graph: DataFrame) -> DataFrame:
    """(source, target): consecutive edges u-v and v-w. The middle vertex is the join's key; a busy one is split by AQE's skew join."""
    g = without_loops(graph).select("src", "dst").distinct()
    a, b = g.select(F.col("src").alias("u"), F.col("dst").alias("v")), g.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    return a.join(b, "v").select(name(F.col("u"), F.col("v")).alias("source"), name(F.col("v"), F.col("w")).alias("target"))


def degrees(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(name, degree): ends of links at each node."""
    return links.select(F.explode(F.array(source, target)).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def pair_distances(nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b, distance) of all node pairs a < b by name, from the cells' centres; the output itself has n (n - 1) / 2 rows, so nodes is a selection."""
    at = nodes.join(centres.select(F.col("cell").alias("src"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat")), "src").join(centres.select(F.col("cell").alias("dst"), F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat")), "dst")
    cols = ["name", "o_lon", "o_lat", "d_lon", "d_lat"]
    a, b = at.select(*[F.col(c).alias(f"a_{c}") for c in cols]), at.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, F.col("a_name") < F.col("b_name"))
    end = lambda s, e: (F.col(f"{s}_{e}_lon"), F.col(f"{s}_{e}_lat"))
    return pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), geo.od_pair_distance(end("a", "o"), end("a", "d"), end("b", "o"), end("b", "d")).alias("distance"))


def with_fake_edges(links: DataFrame, distances: DataFrame) -> DataFrame:
    """(a, b, distance, fake): node pairs joined by a link in either direction, and as fake edges the pairs that no link joins."""
    real = links.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    return distances.join(real.withColumn("real", F.lit(True)), ["a", "b"], "left").select("a", "b", "distance", F.col("real").isNull().alias("fake"))


def edge_communities(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, community) of edges whose two ends have the same label (cell, community)."""
    l1, l2 = labels.select(F.col("cell").alias("src"), "community"), labels.select(F.col("cell").alias("dst"), F.col("community").alias("other"))
    return graph.join(l1, "src").join(l2, "dst").where("community = other").select(name(F.col("src"), F.col("dst")).alias("name"), "community").distinct()


def community_sizes(labels: DataFrame, least: int = 5) -> DataFrame:
    """(community, members, ok): ok where there are more than least."""
    return labels.groupBy("community").agg(F.count("*").alias("members")).withColumn("ok", F.col("members") > least)


def community_links(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (c1, c2) of edges between communities."""
    l1, l2 = labels.select(F.col("cell").alias("src"), F.col("community").alias("c1")), labels.select(F.col("cell").alias("dst"), F.col("community").alias("c2"))
    return graph.join(l1, "src").join(l2, "dst").where("c1 <> c2").select("c1", "c2").distinct()


def trips_by_node(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, trip_key) of trips that run along a node's OD pair."""
    return trips.where("od_in_region").join(nodes.select("name", F.col("src").alias("o_cell"), F.col("dst").alias("d_cell")), ["o_cell", "d_cell"]).select("name", "trip_key")


def node_features(nodes: DataFrame, trip_nodes: DataFrame, trip_features: DataFrame, dim: int) -> DataFrame:
    """(name, n, feature): mean feature of each node's trips, zeros for a node without any. Sums are kept by dimension, so partial sums meet before the shuffle."""
    joined = trip_nodes.join(trip_features, "trip_key")
    mean = joined.groupBy("name").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("feature")[k]) for k in range(dim)]).alias("feature"))
    return nodes.select("name").join(mean, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("feature", F.array(*[F.lit(0.0)] * dim)).alias("feature"))


def normalised(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, j, w): self-loops added, scaled by both ends' degrees, self-loops added again, then rows scaled to sum 1.

    graph has (i, j) in both directions, once each; nodes has (i).
    """
    looped = graph.select("i", "j", F.lit(1.0).alias("w")).unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))).groupBy("i", "j").agg(F.sum("w").alias("w"))
    degree = looped.groupBy("i").agg(F.sum("w").alias("d"))
    sym = looped.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))
    again = sym.select("i", "j", (F.col("w") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("w"))
    rows = again.groupBy("i").agg(F.sum("w").alias("s"))
    return again.join(rows, "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))


def propagate(adjacency: DataFrame, features: DataFrame, power: int) -> DataFrame:
    """(i, k, x) after power products of adjacency (i, j, w) with features (i, k, x): a join and a partial sum a hop, cut after every third, so that plans stay short."""
    x = features
    for hop in range(power):
        x = adjacency.join(x.select(F.col("i").alias("j"), "k", "x"), "j").groupBy("i", "k").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        if hop % 3 == 2:
            x = cut(x)
    return x


def shared_neighbours(knn: DataFrame, least: int) -> DataFrame:
    """(a, b, shared): mutual neighbours of a kNN table (p, q) that share at least least neighbours."""
    mutual = knn.join(knn.select(F.col("p").alias("q"), F.col("q").alias("p")), ["p", "q"]).where("p < q")
    k1, k2 = knn.select("p", F.col("q").alias("m")), knn.select(F.col("p").alias("q"), F.col("q").alias("m"))
    return mutual.join(k1, "p").join(k2, ["q", "m"]).groupBy(F.col("p").alias("a"), F.col("q").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def jaccard_edges(knn: DataFrame) -> DataFrame:
    """(a, b, distance) of kNN edges: 1 less the share of common neighbours among both ends' neighbours."""
    sets = knn.groupBy("p").agg(F.collect_set("q").alias("s"))
    ab = knn.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    both = ab.join(sets.select(F.col("p").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("p").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", (F.lit(1.0) - F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("distance"))


def remaining(vertices: DataFrame, taken: DataFrame, key: str = "cell") -> DataFrame:
    return vertices.join(taken.select(key).distinct(), key, "left_anti")


def slice_line_graph(flows: DataFrame, at: int, mask: DataFrame | None = None, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the line graph of one slice's positive flows, over the first most masked pairs."""
    from wayloom.operators import od

    chosen = None if mask is None else od.first_masked(flows, mask, most)
    g = edges(od.slice_flows(flows, at, chosen))
    return line_nodes(g), line_edges(g)


def with_value(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Line-graph nodes with the value (name, value) that is given for them, NULL where none is."""
    return nodes.join(values.select("name", "value"), "name", "left")


def without_isolated(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(name, community) of nodes that have a link."""
    return labels.join(degrees(links).select("name"), "name", "left_semi")


def visible(pairs: DataFrame, spatial: bool) -> DataFrame:
    """Pairs of with_fake_edges to draw: fake ones in the spatial mode only."""
    return pairs if spatial else pairs.where(~F.col("fake"))


def community_members(labels: DataFrame, key: str = "cell") -> DataFrame:
    """(community, n, members): members in order; a community without any has no row."""
    return labels.where("community is not null").groupBy("community").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("members"))


def node_trip_counts(nodes: DataFrame, trips: DataFrame) -> DataFrame:
    """(name, trips, share): distinct trips along each node's OD pair and their place between the least and the greatest count, 0 where all are equal."""
    n = nodes.select("name").join(trips_by_node(trips, nodes).groupBy("name").agg(F.countDistinct("trip_key").alias("trips")), "name", "left").select("name", F.coalesce("trips", F.lit(0)).alias("trips"))
    ends = n.agg(F.min("trips").alias("low"), F.max("trips").alias("high"))
    share = F.coalesce(F.try_divide(F.col("trips") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return n.join(F.broadcast(ends)).select("name", "trips", share.alias("share"))


def mean_trips(counts: DataFrame) -> DataFrame:
    """(mean_trips): trips of each node on average, rounded down."""
    return counts.agg(F.floor(F.sum("trips") / F.greatest(F.count("*"), F.lit(1))).alias("mean_trips"))


def community_trips(labels: DataFrame, node_trips: DataFrame) -> DataFrame:
    """(community, trip_key): trips of each community's nodes, once each."""
    return node_trips.join(labels.select("name", "community"), "name").select("community", "trip_key").distinct()


def centre_lines(labels: DataFrame, nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(community, line_name, index, lon, lat): for a map, two rows for each node of a community, its origin's and its destination's centre; index counts a community's rows by node."""
    at = nodes.join(labels.select("name", "community"), "name")
    o, d = (centres.select(F.col("cell").alias(c), F.struct(F.lit(k).alias("k"), "lon", "lat").alias(e)) for k, (c, e) in enumerate((("src", "o"), ("dst", "d"))))
    rows = at.join(o, "src").join(d, "dst").select("community", "name", F.explode(F.array("o", "d")).alias("e"))
    own = Window.partitionBy("community").orderBy("name", "e.k")
    return rows.select("community", F.col("name").alias("line_name"), (F.row_number().over(own) - 1).alias("index"), "e.lon", "e.lat")


def by_distance(weighted: DataFrame) -> DataFrame:
    """Edges (a, b, distance) by ascending distance, ties by ends."""
    return weighted.orderBy("distance", "a", "b")

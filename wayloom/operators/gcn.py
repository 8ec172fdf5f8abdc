"""Communities by graph convolution, local moving, attribute walks and similarity balls.

Sparse products, assignments and means are joins and aggregates; the driver holds only k x d centres and d x f rotations. The operators at the end are sequential over a selected graph of some thousand nodes and run as one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.graph import normalised, propagate
from wayloom.plans.lineage import cut


def _bounded(edges: DataFrame, most: int = 5_000_000) -> DataFrame:
    """edges, after a count: what is sequential takes them in one task."""
    n = edges.count()
    if n > most:
        raise ValueError(f"{n} edges are too many for one task; narrow the selection")
    return edges


def _gram(rows: DataFrame, dim: int, left: str, right: str) -> np.ndarray:
    """Sum over rows of the outer product of two arrays; dim^2 sums."""
    pairs = rows.select(F.posexplode(left).alias("i", "x"), right).select("i", "x", F.posexplode(right).alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    out = np.zeros((dim, dim))
    for r in pairs.collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def _total(rows: DataFrame, dim: int, column: str) -> tuple[int, np.ndarray]:
    """Number of rows and sum of an array column."""
    got = rows.agg(F.count("*").alias("n"), F.array(*[F.coalesce(F.sum(F.col(column)[r]), F.lit(0.0)) for r in range(dim)]).alias("s")).first()
    return got["n"], np.array(got["s"])


def _projected(x: DataFrame, w: np.ndarray) -> DataFrame:
    """x with z, the feature times w."""
    return x.withColumn("z", F.array(*[sum((F.col("x")[r] * F.lit(float(w[r, c])) for r in range(w.shape[0])), F.lit(0.0)) for c in range(w.shape[1])]))


def _nearest(z: DataFrame, centres: np.ndarray) -> DataFrame:
    """z with cluster, the nearest of centres, ties to the least number."""
    square = [sum(((F.col("z")[c] - F.lit(float(v))) ** 2 for c, v in enumerate(centre)), F.lit(0.0)) for centre in centres]
    best = F.array_min(F.array(*[F.struct(s.alias("s"), F.lit(j).alias("j")) for j, s in enumerate(square)]))
    return z.withColumn("cluster", best["j"])


def _sums(placed: DataFrame, dim: int) -> dict[int, tuple[int, np.ndarray]]:
    """Number of members and sum of their features for each cluster."""
    got = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[r]) for r in range(dim)]).alias("x")).collect()
    return {r["cluster"]: (r["n"], np.array(r["x"])) for r in got}


def _means(sums: dict[int, tuple[int, np.ndarray]], w: np.ndarray, k: int) -> np.ndarray:
    """Mean projection of each cluster; zeros for one without members."""
    out = np.zeros((k, w.shape[1]))
    for j, (n, total) in sums.items():
        out[j] = total @ w / n
    return out


def _first_clusters(x: DataFrame, w: np.ndarray, k: int, seed: int) -> DataFrame:
    """x placed by k-means over its projection."""
    data = _projected(x, w).withColumn("features", array_to_vector("z"))
    placed = KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data)
    return placed.withColumnRenamed("prediction", "cluster").drop("features")


def propagated(graph: DataFrame, nodes: DataFrame, features: DataFrame, power: int) -> DataFrame:
    """(i, x): features (i, feature) after power products with the normalised adjacency of graph (i, j), written."""
    long = features.select("i", F.posexplode("feature").alias("k", "x"))
    x = propagate(cut(normalised(graph, nodes)), long, power)
    return cut(x.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("x")))


def gcc_fit(x: DataFrame, dim: int, k: int, low: int | None = None, max_iter: int = 30, tol: float = 1e-6, seed: int = 1) -> tuple[DataFrame, np.ndarray, np.ndarray, list[float]]:
    """(i, cluster) of propagated features x (i, x), with W (dim x low), the centres and the losses.

    W starts as the principal axes of x, clusters and centres as k-means over x W. Then W by SVD of X^T F[G], G by the nearest centre and F as the clusters' means take turns, until the norm of X - F[G] W^T falls by less than tol. The driver holds sums of dim and dim x dim only.
    """
    k, low = max(1, k), low or min(dim, max(2, k))
    n, total = _total(x, dim, "x")
    gram = _gram(x.select("x", F.col("x").alias("y")), dim, "x", "y")
    w = np.linalg.eigh(gram - np.outer(total, total) / max(n, 1))[1][:, ::-1][:, :low]
    if n < k:
        k = max(1, n)
    placed = _first_clusters(x, w, k, seed)
    sums = _sums(placed, dim)
    centres, losses, last = _means(sums, w, k), [], None
    for _ in range(max_iter):
        u, _, v = np.linalg.svd(sum(np.outer(own, centres[j]) for j, (_, own) in sums.items()), full_matrices=False)
        w = u @ v
        placed = _nearest(_projected(x, w), centres)
        sums = _sums(placed, dim)
        centres = _means(sums, w, k)
        square = np.trace(gram) - sum(2 * (own @ w) @ centres[j] - m * centres[j] @ centres[j] for j, (m, own) in sums.items())
        loss = float(np.sqrt(max(square, 0.0)))
        if last is not None and last - loss < tol:
            break
        losses.append(loss)
        last = loss
    return placed.select("i", F.col("cluster").cast("long").alias("cluster")), w, centres, losses


def gcc_infer(x: DataFrame, w: np.ndarray, dim: int, k: int, seed: int = 1) -> tuple[DataFrame, float]:
    """(i, cluster) of propagated features under a stored W, and the loss: k-means over x W, then one more assignment and mean."""
    sums = _sums(_first_clusters(x, w, k, seed), dim)
    placed = _nearest(_projected(x, w), _means(sums, w, k))
    sums = _sums(placed, dim)
    centres = _means(sums, w, k)
    gram = _gram(x.select("x", F.col("x").alias("y")), dim, "x", "y")
    square = np.trace(gram) - sum(2 * (own @ w) @ centres[j] - m * centres[j] @ centres[j] for j, (m, own) in sums.items())
    return placed.select("i", F.col("cluster").cast("long").alias("cluster")), float(np.sqrt(max(square, 0.0)))


def gcc(graph: DataFrame, nodes: DataFrame, features: DataFrame, dim: int, k: int, power: int = 5, low: int | None = None, max_iter: int = 30, tol: float = 1e-6, seed: int = 1) -> DataFrame:
    """(i, cluster): graph-convolutional clustering with k = max(1, k); gcc_fit over the propagated features."""
    return gcc_fit(propagated(graph, nodes, features, power), dim, k, low, max_iter, tol, seed)[0]


def random_features(nodes: DataFrame, dim: int, seed: int = 1) -> DataFrame:
    """(i, feature): numbers from 0 to 1 by a hash of node, place and seed; the baseline without trips."""
    return nodes.select("i", F.array(*[F.pmod(F.xxhash64("i", F.lit(r), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) for r in range(dim)]).alias("feature"))


def best_power(graph: DataFrame, nodes: DataFrame, features: DataFrame, dim: int, k: int, most: int = 8) -> int:
    """The propagation order after which the within-cluster loss first falls by less than a hundredth."""
    last = None
    for p in range(1, most + 1):
        long = propagate(cut(normalised(graph, nodes)), features.select("i", F.posexplode("feature").alias("k", "x")), p)
        spread = long.join(gcc(graph, nodes, features, dim, k, p), "i")
        loss = spread.groupBy("cluster", "k").agg(F.var_pop("x").alias("v"), F.count("*").alias("n")).agg(F.sum(F.col("v") * F.col("n"))).first()[0]
        if last is not None and last - loss < 0.01 * abs(last):
            return p - 1
        last = loss
    return most


def louvain(graph: DataFrame, resolution: float = 0.7, key: str = "cell") -> DataFrame:
    """(key, community): first level of local moving on the undirected weights of graph (src, dst, flow), nodes in ascending order, ties to the least community.

    Moves depend on those before, so one task holds the selected graph's edges.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, float]] = {}
        for a, b, w in sorted(zip(pdf["src"], pdf["dst"], pdf["flow"], strict=True)):
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
        degree = {v: sum(e.values()) for v, e in near.items()}
        two_m = sum(degree.values())
        own, total = {v: v for v in near}, dict(degree)
        moved = True
        while moved:
            moved = False
            for v in sorted(near):
                total[own[v]] -= degree[v]
                gain: dict[int, float] = {own[v]: 0.0}
                for u, w in near[v].items():
                    if u != v:
                        gain[own[u]] = gain.get(own[u], 0.0) + w
                score = {c: g - resolution * degree[v] * total[c] / two_m for c, g in gain.items()}
                best = min(score, key=lambda c: (-score[c], c))
                if score[best] > score[own[v]] + 1e-12:
                    own[v], moved = best, True
                total[own[v]] += degree[v]
        return pd.DataFrame({key: list(own), "community": list(own.values())})

    rows = _bounded(graph.select(F.lit(0).alias("g"), "src", "dst", F.col("flow").cast("double").alias("flow")))
    return rows.groupBy("g").applyInPandas(kernel, f"{key} long, community long")


def sa_cluster(graph: DataFrame, attributes: DataFrame, k: int, restart: float = 0.5, length: int = 5, rounds: int = 50, key: str = "cell", values: tuple[str, ...] = ("value",)) -> DataFrame:
    """(key, community): k-medoids over a random walk on a graph augmented by one vertex for each value of each attribute column.

    From a vertex the walk goes on to a neighbour with weight 1 and to each attribute's vertex with that attribute's weight; from an attribute vertex to those that have it, evenly. Medoids are first the k vertices of greatest density, then the members nearest to their cluster's mean. After each round an attribute's weight moves half way to its share of the members' agreement with their medoids. It ends when no vertex changes its cluster, or after rounds.
    The walk matrix is dense, so one task holds a selected graph of up to some thousand vertices.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(key)
        ids = right[key].to_numpy()
        links = {(a, b) for a, b in zip(left["src"], left["dst"], strict=True)}
        at = {v: i for i, v in enumerate(ids)}
        link = np.zeros((len(ids), len(ids)))
        for a, b in links:
            if a in at and b in at:
                link[at[a], at[b]] = 1
        owner, medoids = walk_medoids(link, right[list(values)].to_numpy(), k, restart, length, rounds)
        return pd.DataFrame({key: ids, "community": ids[medoids][owner]})

    if attributes.count() > 5000:
        raise ValueError("the walk matrix is dense; narrow the selection to 5,000 vertices")
    return graph.withColumn("g", F.lit(0)).groupBy("g").cogroup(attributes.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(kernel, f"{key} long, community long")


def walk_medoids(link: np.ndarray, values: np.ndarray, k: int, restart: float = 0.5, length: int = 5, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each vertex and the clusters' medoids; link is 0/1, values has a column for each attribute."""
    n, m = len(link), values.shape[1]
    member = [(values[:, [j]] == np.unique(values[:, j])[None]).astype(float) for j in range(m)]
    weight = np.ones(m)

    def walked() -> np.ndarray:
        out = link.sum(axis=1, keepdims=True) + weight.sum()
        there = np.hstack([link / out, *[w * x / out for w, x in zip(weight, member, strict=True)]])
        back = np.vstack([(x / x.sum(axis=0)).T for x in member])
        p = np.vstack([there, np.hstack([back, np.zeros((len(back), len(back)))])])
        total, step = np.zeros_like(p), np.eye(len(p))
        for t in range(1, length + 1):
            step = step @ p
            total += restart * (1 - restart) ** t * step
        return total[:n, :n]

    walk = walked()
    medoids = np.argsort(-(1 - np.exp(-(walk**2) / 2)).sum(axis=0), kind="stable")[:k]
    owner = np.zeros(n, int)
    for _ in range(rounds):
        before, owner = owner, np.argmax(walk[:, medoids], axis=1)
        agree = np.zeros(m)
        for c in range(len(medoids)):
            own = np.flatnonzero(owner == c)
            if len(own):
                medoids[c] = own[np.argmin(np.linalg.norm(walk[own] - walk[own].mean(axis=0), axis=1))]
                agree += (values[own] == values[medoids[c]]).sum(axis=0)
        weight = (weight + agree / agree.sum()) / 2
        walk = walked()
        if (owner == before).all():
            break
    return owner, medoids


def bottom_sketch(graph: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank): of each vertex the k neighbours of least hash, a sketch of its neighbourhood."""
    own = Window.partitionBy("src").orderBy(F.xxhash64("dst"), "dst")
    return graph.select("src", "dst").distinct().withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def stoc(graph: DataFrame, attributes: DataFrame, tau: float, alpha: float = 0.5, key: str = "cell") -> DataFrame:
    """(key, community): balls of vertices within tau of a seed, grown breadth-first; the seed is the least vertex left.

    The distance mixes the Jaccard distance of neighbourhoods with the difference of values (key, value), scaled by their range. Balls are taken one after another, so one task holds a selected graph.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(key)
        value = dict(zip(right[key], right["value"], strict=True))
        near: dict[int, set[int]] = {v: set() for v in value}
        for a, b in zip(left["src"], left["dst"], strict=True):
            if a in near and b in near and a != b:
                near[a].add(b), near[b].add(a)
        spread = (max(value.values()) - min(value.values())) or 1
        owner: dict[int, int] = {}

        def far(a, b):
            s, t = near[a] | {a}, near[b] | {b}
            return alpha * (1 - len(s & t) / len(s | t)) + (1 - alpha) * abs(value[a] - value[b]) / spread

        for seed in sorted(near):
            if seed in owner:
                continue
            owner[seed], front = seed, [seed]
            while front:
                front = sorted({u for v in front for u in near[v] if u not in owner and far(seed, u) <= tau})
                owner.update((u, seed) for u in front)
        return pd.DataFrame({key: list(owner), "community": list(owner.values())})

    return _bounded(graph).withColumn("g", F.lit(0)).groupBy("g").cogroup(attributes.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(kernel, f"{key} long, community long")


def edge_betweenness(graph: DataFrame, k: int, key: str = "cell") -> DataFrame:
    """(key, community): edges of greatest betweenness (Brandes) are cut until there are k components; for demonstration graphs, in one task."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)

        def parts():
            label: dict[int, int] = {}
            for s in sorted(near):
                if s not in label:
                    stack = [s]
                    while stack:
                        v = stack.pop()
                        if v not in label:
                            label[v] = s
                            stack += near[v]
            return label

        while len(set((label := parts()).values())) < k and any(near.values()):
            score: dict[tuple[int, int], float] = {}
            for s in near:
                dist, paths, order, i = {s: 0}, {s: 1.0}, [s], 0
                while i < len(order):
                    v = order[i]
                    i += 1
                    for u in near[v]:
                        if u not in dist:
                            dist[u], paths[u] = dist[v] + 1, 0.0
                            order.append(u)
                        if dist[u] == dist[v] + 1:
                            paths[u] += paths[v]
                due = dict.fromkeys(order, 0.0)
                for u in reversed(order):
                    for v in near[u]:
                        if dist[v] == dist[u] - 1:
                            c = paths[v] / paths[u] * (1 + due[u])
                            e = (min(u, v), max(u, v))
                            score[e] = score.get(e, 0.0) + c
                            due[v] += c
            a, b = min(score, key=lambda e: (-round(score[e], 9), e))
            near[a].discard(b)
            near[b].discard(a)
        return pd.DataFrame({key: list(label), "community": list(label.values())})

    return _bounded(graph.select(F.lit(0).alias("g"), "src", "dst"), 200_000).groupBy("g").applyInPandas(kernel, f"{key} long, community long")
